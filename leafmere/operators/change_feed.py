"""Applying a change feed: a bucketed copy-on-write table of records, merged bucket by bucket under a manifest.

The base is hashed by (namespace, key) into buckets, each a file sorted by them. A batch of changes is reduced to a row a
record and routed by the same hash into a run of bucket files of its own, whose names tell which buckets a change falls
into. Only these are read again: the two sorted runs of a bucket are merged in one task, without moving a row of the
base, and written as a replacement file. One manifest, put in place by a rename, then names the files of all buckets;
readers see the old or the new state. Deletions stay as rows marked ``deleted``, so that a late older change cannot
bring a record back. ``vacuum`` removes the files that no kept manifest names.

The version with the highest hlc is current and at equal hlc that of the greater device id; a null hlc of the base or a
null device id is below all others. At equal hlc and device a deletion is above a value and then the greater body wins.

Defined cases: a change without key, kind or hlc, or of an unknown kind, has no effect; letter case and dashes of a key and
letter case and blanks of a kind do not matter; an added or updated record is set whether or not it existed; a null
namespace is a namespace of its own; repeated rows change nothing; empty tables are allowed; further columns of the
inputs, whatever their names, are not read. A key with any share of the rows is reduced to a row a task before the shuffle.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.operators.cutting import new_folder

RECORD = T.StructType([T.StructField("ns", T.StringType()), T.StructField("key", T.StringType()), T.StructField("hlc", T.LongType()),
                       T.StructField("device_id", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("body", T.StringType())])


def plain_key(key: Column) -> Column:
    """A key in lower case without dashes and outer blanks; null for a blank one."""
    plain = F.lower(F.translate(F.trim(key), "-", ""))
    return F.when(plain != "", plain)


def plain_kind(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"^\s+|\s+$", ""))


def latest(rows: DataFrame) -> DataFrame:
    """The current version of each (ns, key) of rows in RECORD's columns."""
    best = F.max(F.struct("hlc", "device_id", "deleted", "body")).alias("v")
    return rows.groupBy("ns", "key").agg(best).select("ns", "key", "v.*")


def base_rows(store: DataFrame, ns: str = "ns", key: str = "kv_key") -> DataFrame:
    """A table of live records in RECORD's columns; rows without a key are left out."""
    out = store.select(F.col(ns).alias("ns"), plain_key(F.col(key)).alias("key"), F.col("hlc").cast("bigint").alias("hlc"), F.col("device_id").cast("string").alias("device_id"), F.lit(False).alias("deleted"), F.col("body").cast("string").alias("body"))
    return out.where("key is not null")


def change_rows(feed: DataFrame, ns: str = "ns", key: str = "doc_key", kind: str = "change_type") -> DataFrame:
    """The changes that have an effect, in RECORD's columns."""
    kinds = plain_kind(F.col(kind))
    out = feed.where(kinds.isin("added", "updated", "deleted") & F.col("hlc").isNotNull())
    deleted = kinds == "deleted"
    out = out.select(F.col(ns).alias("ns"), plain_key(F.col(key)).alias("key"), F.col("hlc").cast("bigint").alias("hlc"), F.col("device_id").cast("string").alias("device_id"), deleted.alias("deleted"), F.when(~deleted, F.col("body").cast("string")).alias("body"))
    return out.where("key is not null")


#: A bucket's file as it is written: its namespace, which is never null there, first.
STORED = "space string, key string, hlc bigint, device_id string, deleted boolean, body string"
#: Bytes of the base that a bucket should hold at most.
BUCKET_BYTES = 256 << 20


def stored(rows: DataFrame) -> DataFrame:
    """Rows in RECORD's columns as STORED: a namespace after a sign, nothing for a null one."""
    return rows.select(F.coalesce(F.concat(F.lit("="), "ns"), F.lit("")).alias("space"), "key", "hlc", "device_id", "deleted", "body")


def restored(rows: DataFrame) -> DataFrame:
    """Rows of STORED in RECORD's columns."""
    return rows.select(F.when(F.col("space") != "", F.expr("substring(space, 2)")).alias("ns"), "key", "hlc", "device_id", "deleted", "body")


class BucketTable:
    """Records under ``root`` in ``buckets`` sorted hash buckets; every commit adds a manifest and leaves older ones valid."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    @classmethod
    def create(cls, base: DataFrame, root: str | None = None, buckets: int | None = None) -> BucketTable:
        """A table with the newest version of each record of ``base``; as many buckets as a shuffle has parts, or more if
        their size asks for it."""
        spark = base.sparkSession
        root = root or new_folder(spark, "bucket-table")
        if buckets is None:
            size = int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            # A size that Spark does not know is given as next to infinite.
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if size < 1 << 60 else 0)
        table = cls(spark, root, {"version": -1, "buckets": buckets, "files": {}})
        table._commit(table._write(stored(latest(base)), "data-00000000"))
        return table

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: int | None = None) -> BucketTable:
        """The table as of ``version``, else its newest state."""
        if version is None:
            versions = _versions(spark, root)
            if not versions:
                raise FileNotFoundError(f"no table under {root}")
            version = max(versions)
        text = "".join(r[0] for r in spark.read.text(f"{root}/manifest-{version:08d}.json", wholetext=True).collect())
        return cls(spark, root, json.loads(text))

    def rows(self) -> DataFrame:
        """All rows, deletions too."""
        files = [f for fs in self.manifest["files"].values() for f in fs]
        if not files:
            return self.spark.createDataFrame([], RECORD)
        return restored(self.spark.read.schema(STORED).parquet(*files))

    def live(self) -> DataFrame:
        return self.rows().where("not deleted").drop("deleted")

    def apply(self, changes: DataFrame) -> BucketTable:
        """The table after ``changes`` (RECORD's columns), in any order and any number of times."""
        version = self.manifest["version"] + 1
        run = f"changes-{version:08d}-{uuid.uuid4().hex[:8]}"
        routed = self._write(stored(latest(changes)), run)
        try:
            if not routed:
                return self
            held = {b: f for b, f in self.manifest["files"].items() if b in routed}
            with self._bucketed({b: f for b, f in routed.items()}) as new, self._bucketed(held) as old:
                value = lambda df, name: df.select("space", "key", F.struct("hlc", "device_id", "deleted", "body").alias(name))
                both = value(old, "before").hint("merge").join(value(new, "change"), ["space", "key"], "full_outer")
                merged = both.select("space", "key", F.greatest("before", "change").alias("v")).select("space", "key", "v.*")
                written = self._write(merged, f"data-{version:08d}", True)
        finally:
            _delete(self.spark, f"{self.root}/{run}")
        after = BucketTable(self.spark, self.root, self.manifest)
        after._commit({b: f for b, f in self.manifest["files"].items() if b not in routed} | written)
        return after

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files and manifests that none of the newest ``keep`` versions needs; returns how many data files went."""
        versions = sorted(_versions(self.spark, self.root))
        kept = {f for v in versions[-keep:] for fs in BucketTable.load(self.spark, self.root, v).manifest["files"].values() for f in fs}
        gone = 0
        for v in versions[:-keep]:
            for files in BucketTable.load(self.spark, self.root, v).manifest["files"].values():
                gone += sum(_delete(self.spark, f) for f in files if f not in kept)
            _delete(self.spark, f"{self.root}/manifest-{v:08d}.json")
        return gone

    def _write(self, rows: DataFrame, folder: str, placed: bool = False) -> dict[str, list[str]]:
        """Files by bucket under ``folder``, each sorted. Buckets hash as shuffles do, so a shuffle of as many parts as there are
        buckets, or ``placed`` rows, leave one file a bucket."""
        n, path, name = self.manifest["buckets"], f"{self.root}/{folder}", f"leafmere_{uuid.uuid4().hex}"
        if not placed and n != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(n, "space", "key")
        # A run that died before its commit may have left files, which no manifest names.
        rows.write.format("parquet").mode("overwrite").option("path", path).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").bucketBy(n, "space", "key").sortBy("space", "key").saveAsTable(name)
        self.spark.sql(f"drop table {name}")
        fs, where = _hadoop(self.spark, path)
        files: dict[str, list[str]] = {}
        for status in fs.listStatus(where):
            file = status.getPath()
            if m := re.fullmatch(r"part-.*_(\d+)(?:\..*)?", file.getName()):
                files.setdefault(str(int(m[1])), []).append(file.toString())
        return files

    @contextmanager
    def _bucketed(self, files: dict[str, list[str]]) -> Iterator[DataFrame]:
        """The rows of some buckets, which Spark knows to be hashed and sorted, from files in any of the table's folders."""
        name, n = f"leafmere_{uuid.uuid4().hex}", self.manifest["buckets"]
        named = [f for fs in files.values() for f in fs]
        folders = sorted({f.rpartition("/")[0] for f in named})
        self.spark.sql(f"create table {name} ({STORED}, folder int) using parquet partitioned by (folder) clustered by (space, key) sorted by (space, key) into {n} buckets location '{self.root}/none-{name}'")
        sorted_scan = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(sorted_scan, None)
        try:
            if folders:
                self.spark.sql(f"alter table {name} add " + " ".join(f"partition (folder={i}) location '{f}'" for i, f in enumerate(folders)))
            # Files are sorted and each bucket has one, so that their order needs no sort.
            self.spark.conf.set(sorted_scan, "true")
            rows = self.spark.table(name)
            # Files of other buckets and older versions are left out before they are opened; their names hold an id of their write.
            yield rows.where(F.col("_metadata.file_name").isin([f.rpartition("/")[2] for f in named])).drop("folder")
        finally:
            self.spark.sql(f"drop table {name}")
            _delete(self.spark, f"{self.root}/none-{name}")
            if before is None:
                self.spark.conf.unset(sorted_scan)
            else:
                self.spark.conf.set(sorted_scan, before)

    def _commit(self, files: dict[str, list[str]]) -> None:
        version = self.manifest["version"] + 1
        manifest = {"version": version, "buckets": self.manifest["buckets"], "files": files}
        fs, final = _hadoop(self.spark, f"{self.root}/manifest-{version:08d}.json")
        _, draft = _hadoop(self.spark, f"{new_folder(self.spark, 'manifest')}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.root} was committed by another writer")
        self.manifest = manifest


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, where: str) -> bool:
    fs, path = _hadoop(spark, where)
    return bool(fs.delete(path, True))


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _hadoop(spark, root)
    if not fs.exists(path):
        return []
    return [int(m[1]) for f in fs.listStatus(path) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))]


def current_records(store: DataFrame, feed: DataFrame) -> DataFrame:
    """(ns, kv_key, hlc, device_id, body) of the records that are live once ``feed`` is applied to ``store``."""
    table = BucketTable.create(base_rows(store)).apply(change_rows(feed))
    table.vacuum()
    return table.live().withColumnRenamed("key", "kv_key")

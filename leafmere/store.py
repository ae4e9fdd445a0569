"""A document store over one mutation log: collections, writes, versions, search, import and export, sync, upkeep.

Documents are JSON in the log and VARIANT when read. Every write is one append; a reader sees all of it or none. The
log's folder is named by a small state file that compaction swaps, so a rewrite never disturbs readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.functions.keys import Clock, new_key
from leafmere.operators import log as logs
from leafmere.operators import search as searching
from leafmere.operators.filters import Filter
from leafmere.operators.indexes import TextIndex
from leafmere.operators.query import Collection
from leafmere.operators.schema import variant_violations
from leafmere.sources import ndjson
from leafmere.sources.folder import Folder

LOG = T.StructType([T.StructField("ns", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("hlc", T.LongType()), T.StructField("op", T.StringType()), T.StructField("device_id", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("promoted_from", T.LongType())])


class Store:
    def __init__(self, spark: SparkSession, root: str, device_id: str = "local", clock: Clock | None = None):
        self.spark, self.root, self.device_id = spark, root.rstrip("/"), device_id
        self.folder = Folder(spark, self.root)
        if self.folder.read("state.json") is None:
            self.folder.swap("state.json", json.dumps({"log": "log-0"}).encode(), None)
        self.clock = clock or Clock()
        self.clock.last = max(self.clock.last, self.end())

    # The log

    def log_path(self) -> str:
        return f"{self.root}/{json.loads(self.folder.read('state.json'))['log']}"

    def log(self, ns: str | None = None) -> DataFrame:
        path = self.log_path()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(path)
        return rows if ns is None else rows.where(F.col("ns") == ns)

    def end(self) -> int:
        """The highest clock value in the log, 0 for an empty one."""
        return self.log().agg(F.max("hlc")).first()[0] or 0

    def append(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG]).write.mode("append").parquet(self.log_path())

    def _rows(self, ns: str, docs: DataFrame | Iterable[dict], hlc: int) -> DataFrame:
        """Log rows of documents given as dicts, with or without _id, or as a DataFrame (_id, doc).

        Dicts follow each other in the clock, so the last one of a key is current; of a DataFrame's rows of one key, which have
        no order, the greatest document counts.
        """
        if not isinstance(docs, DataFrame):
            listed = [dict(d) for d in docs]
            if bad := sorted({k for d in listed for k in d if k.startswith("_") and k != "_id"}):
                raise ValueError(f"reserved fields {bad}")
            self.clock.last = max(self.clock.last, hlc + len(listed))
            rows = self.spark.createDataFrame([(d.get("_id") or new_key(), hlc + i, json.dumps({k: v for k, v in d.items() if k != "_id"})) for i, d in enumerate(listed)], "_id string, hlc long, doc string")
        else:
            doc = F.to_json("doc") if isinstance(docs.schema["doc"].dataType, T.VariantType) else F.col("doc")
            rows = docs.select("_id", doc.alias("doc")).groupBy("_id").agg(F.lit(hlc).alias("hlc"), F.max("doc").alias("doc"))
        return rows.select(F.lit(ns).alias("ns"), "_id", "hlc", F.lit("put").alias("op"), F.lit(self.device_id).alias("device_id"), "doc")

    def _checked(self, ns: str, rows: DataFrame) -> DataFrame:
        rule = self.schema(ns)
        if rule is not None:
            found = variant_violations(rule, F.parse_json("doc"))
            some = rows.select(found.alias("v")).where(F.size("v") > 0).limit(20).collect()
            if some:
                raise ValueError("; ".join(f"{x.path} {x.message}" for r in some for x in r.v))
        return rows

    # Reads

    def collection(self, ns: str) -> Collection:
        """The documents of a collection: (_id, doc VARIANT)."""
        return Collection(logs.snapshot(self.log(ns)).select("_id", F.parse_json("doc").alias("doc")))

    def typed(self, ns: str, schema: str) -> Collection:
        """The documents with the fields of a DDL schema as columns."""
        return Collection(logs.snapshot(self.log(ns)).select("_id", F.from_json("doc", schema).alias("d")).select("_id", "d.*"))

    def collections(self) -> list[str]:
        return sorted(r[0] for r in logs.snapshot(self.log()).select("ns").distinct().collect())

    def as_of(self, ns: str, hlc: int) -> Collection:
        return Collection(logs.as_of(self.log(ns), hlc).select("_id", F.parse_json("doc").alias("doc")))

    # Writes

    def put(self, ns: str, docs: DataFrame | Iterable[dict]) -> int:
        hlc = self.clock.now()
        self.append(self._checked(ns, self._rows(ns, docs, hlc)))
        return hlc

    def insert(self, ns: str, docs: DataFrame | Iterable[dict]) -> int:
        return self._put_if(ns, docs, "left_semi", "a document with this key exists")

    def replace(self, ns: str, docs: DataFrame | Iterable[dict]) -> int:
        return self._put_if(ns, docs, "left_anti", "no document has this key")

    def _put_if(self, ns: str, docs, join: str, message: str) -> int:
        hlc = self.clock.now()
        rows = self._rows(ns, docs, hlc).cache()
        try:
            if not rows.join(logs.snapshot(self.log(ns)).select("_id"), "_id", join).isEmpty():
                raise ValueError(message)
            self.append(self._checked(ns, rows))
        finally:
            rows.unpersist()
        return hlc

    def delete(self, ns: str, keys: Iterable[str] | None = None, where: Filter | None = None) -> int:
        """Delete documents by key, by filter or, with neither, all of the collection."""
        found = self._chosen(ns, keys, where)
        hlc = self.clock.now()
        self.append(found.select(F.lit(ns).alias("ns"), "_id", F.lit(hlc).alias("hlc"), F.lit("delete").alias("op"), F.lit(self.device_id).alias("device_id")))
        return hlc

    def update(self, ns: str, changes: dict, keys: Iterable[str] | None = None, where: Filter | None = None) -> int:
        """Set top-level fields of the chosen documents; other fields and the key stay."""
        if any(k.startswith("_") for k in changes):
            raise ValueError("reserved fields cannot be set")
        found = self._chosen(ns, keys, where)
        old = F.try_variant_get("doc", "$", "map<string,variant>")
        new = F.try_variant_get(F.parse_json(F.lit(json.dumps(changes))), "$", "map<string,variant>")
        kept = F.map_filter(old, lambda k, v: ~k.isin(list(changes)))
        rows = found.select("_id", F.to_json(F.map_concat(kept, new)).alias("doc"))
        hlc = self.clock.now()
        self.append(self._checked(ns, self._rows(ns, rows, hlc)))
        return hlc

    def _chosen(self, ns: str, keys: Iterable[str] | None, where: Filter | None) -> DataFrame:
        if keys is not None and where is not None:
            raise ValueError("choose by keys or by a filter")
        c = self.collection(ns)
        if keys is not None:
            return c.df.where(F.col("_id").isin(list(keys)))
        return c.df if where is None else c.where(where).df()

    def batch(self, puts: dict[str, Iterable[dict]], deletes: dict[str, Iterable[str]] | None = None) -> int:
        """Writes to several collections as one append."""
        hlc = self.clock.now()
        parts = [self._checked(ns, self._rows(ns, docs, hlc)) for ns, docs in puts.items()]
        for ns, keys in (deletes or {}).items():
            gone = self._chosen(ns, keys, None)
            parts.append(gone.select(F.lit(ns).alias("ns"), "_id", F.lit(hlc).alias("hlc"), F.lit("delete").alias("op"), F.lit(self.device_id).alias("device_id"), F.lit(None).cast("string").alias("doc")))
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            self.append(out)
        return hlc

    # Versions

    def versions(self, ns: str, key: str) -> DataFrame:
        return logs.history(self.log(ns), key, newest_first=True)

    def promote(self, ns: str, key: str, hlc: int) -> int:
        new = self.clock.now()
        rows = logs.promoted(self.log(ns).drop("promoted_from"), key, hlc, new, self.device_id)
        if self.log(ns).where((F.col("_id") == key) & (F.col("hlc") == hlc)).isEmpty():
            raise KeyError(f"{key} has no version {hlc}")
        self.append(rows)
        return new

    # Search

    def _texts(self, rows: DataFrame, field: str) -> DataFrame:
        """(_id, field) of (_id, doc VARIANT); the field is null unless it is a string."""
        value = F.try_variant_get("doc", f"$.{field}", "variant")
        return rows.select("_id", F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("doc", f"$.{field}", "string")).alias(field))

    def text_index(self, ns: str, field: str, **terms) -> TextIndex:
        """The index of a field, current with the log: built on its first use, then followed by overlays."""
        options = "".join(f"-{k}={v}" for k, v in sorted(terms.items()))
        index = TextIndex(self.spark, f"{self.root}/index/{ns}{options}", field, owner=self.device_id, **terms)
        log = self.log(ns)
        end, rows = log.agg(F.max("hlc"), F.count("*")).first()

        def changed(after: int) -> DataFrame:
            # A key that changed may have a version that counts below the index's end, so all of its versions are looked at.
            keys = log.where(F.col("hlc") > after).select("_id").distinct()
            now = logs.newest(log.join(keys, "_id", "left_semi"))
            return self._texts(now.select("_id", F.when(F.col("op") != "delete", F.try_parse_json("doc")).alias("doc")), field)

        index.refresh(end or 0, rows, lambda: self._texts(self.collection(ns).df, field), changed, lambda upto: log.where(F.col("hlc") <= upto).count())
        return index

    def search(self, ns: str, query: str, fields: list[str], where: Filter | None = None, limit: int = 10, offset: int = 0, documents: bool = False, **terms) -> DataFrame:
        """Hits (_id, score, {field}:bm25, rank) over text fields, from their indexes; only strings that are not empty count.

        documents: with the document of each hit of the page as ``doc``.
        """
        docs = self.collection(ns)
        kept = docs.where(where).df().select("_id") if where is not None else None
        legs = {f: self.text_index(ns, f, **terms).scores(query, kept) for f in fields}
        hits = searching.best_fields(legs, "_id", limit, offset)
        return hits.join(docs.df, "_id", "left").orderBy("rank") if documents else hits

    def hybrid(self, ns: str, query: str, fields: list[str], vectors: DataFrame, query_vector: list[float], limit: int = 10, offset: int = 0, **terms) -> DataFrame:
        legs = [self.search(ns, query, fields, limit=100, **terms), searching.semantic(vectors, "_id", "vec", query_vector)]
        return searching.rrf(legs, "_id", limit=limit, offset=offset)

    # Schemas

    def schema(self, ns: str) -> dict | None:
        text = self.folder.read(f"schema-{ns}.json")
        return None if text is None else json.loads(text)

    def set_schema(self, ns: str, rule: dict | None) -> None:
        name = f"schema-{ns}.json"
        if rule is None:
            self.folder.delete(name)
        else:
            variant_violations(rule, F.parse_json(F.lit("{}")))
            self.folder.write(name, json.dumps(rule).encode())

    def invalid(self, ns: str) -> DataFrame:
        """(_id, path, message) of all violations of the stored documents."""
        found = variant_violations(self.schema(ns) or {}, F.col("doc"))
        return self.collection(ns).df.select("_id", F.explode(found).alias("v")).select("_id", "v.path", "v.message")

    # Import, export

    def import_file(self, ns: str, path: str, on_conflict: str = "replace", checked: bool = False) -> int:
        """Import NDJSON. A line that is no object with an ``_id`` stops the import before anything is written. Of several lines of a
        key the last counts, under ``ignore`` the first. An import passes the schema by unless it is to be ``checked``."""
        lines = ndjson.sound_lines(ndjson.read_lines(self.spark, path))
        incoming = ndjson.one_line_a_key(lines, last=on_conflict != "ignore").select("_id", "doc")
        if on_conflict == "error":
            return self.insert(ns, incoming)
        if on_conflict == "ignore":
            incoming = incoming.join(self.collection(ns).df.select("_id"), "_id", "left_anti")
        elif on_conflict != "replace":
            raise ValueError(f"unknown rule {on_conflict}")
        hlc = self.clock.now()
        rows = self._rows(ns, incoming, hlc)
        self.append(self._checked(ns, rows) if checked else rows)
        return hlc

    def export(self, ns: str, path: str) -> None:
        ndjson.export(self.collection(ns).df, path)

    def dump(self, path: str) -> None:
        ndjson.dump({ns: self.collection(ns).df for ns in self.collections()}, path)

    def restore(self, path: str) -> int:
        hlc = self.clock.now()
        docs = ndjson.restore_file(self.spark, path).where("_id is not null")
        self.append(docs.select(F.col("collection").alias("ns"), "_id", F.lit(hlc).alias("hlc"), F.lit("put").alias("op"), F.lit(self.device_id).alias("device_id"), F.to_json("doc").alias("doc")))
        return hlc

    # Sync

    def pull(self, other: Store) -> int:
        """Take over the other store's mutations above this store's mark of each device; returns their number.

        Marks are kept per device and row, so mutations that arrive late at the other store are not passed over as
        long as they are above the mark of their own device.
        """
        known = json.loads(self.folder.read("marks.json") or b"{}")
        marks = self.spark.createDataFrame([(d, h) for d, h in known.items()], "device_id string, hwm long")
        # Below the floor deletions may be gone here, so that an old mutation could bring a record back.
        floor = json.loads(self.folder.read("floor.json") or b"0")
        rows = logs.pulled(logs.accepted(other.log(), floor, self.clock.wall()), marks).where(F.col("device_id") != self.device_id).cache()
        try:
            n = rows.count()
            if n:
                self.append(rows)
                for r in rows.groupBy("device_id").agg(F.max("hlc").alias("h")).collect():
                    known[r.device_id] = max(known.get(r.device_id, 0), r.h)
                self.folder.write("marks.json", json.dumps(known).encode())
                self.clock.last = max(self.clock.last, *known.values())
            return n
        finally:
            rows.unpersist()

    # Upkeep

    def compact(self, now_ms: int | None = None, versions: int | None = 4, days: int | None = 90, horizon: int | None = None) -> None:
        """Rewrite the log with the versions that retention keeps, without deletions older than the horizon, once each."""
        old = self.folder.etag("state.json")
        name = f"log-{self.end()}-{(old or '')[:8]}"
        kept = logs.retained(logs.merged(self.log()), now_ms if now_ms is not None else self.clock.wall(), versions, days)
        if horizon is not None:
            kept = logs.without_tombstones(kept, horizon)
        kept.write.mode("overwrite").parquet(f"{self.root}/{name}")
        if not self.folder.swap("state.json", json.dumps({"log": name}).encode(), old):
            raise RuntimeError("the log was compacted by another writer meanwhile")
        if horizon is not None:
            self.folder.write("floor.json", json.dumps(max(horizon, json.loads(self.folder.read("floor.json") or b"0"))).encode())

    def verify(self) -> DataFrame:
        """(ns, checked, errors) by collection."""
        kind = F.schema_of_variant(F.try_parse_json("doc"))
        return logs.snapshot(self.log()).groupBy("ns").agg(F.count("*").alias("checked"), F.count_if(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).alias("errors"))

    def statistics(self) -> DataFrame:
        return self.log().groupBy("ns").agg(F.count("*").alias("mutations"), F.countDistinct("_id").alias("records"), F.min("hlc").alias("least_hlc"), F.max("hlc").alias("most_hlc"))

    def field(self, path: str) -> Column:
        return F.try_variant_get("doc", f"$.{path}", "string")

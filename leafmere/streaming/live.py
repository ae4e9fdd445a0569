"""Live results over a growing mutation log with Structured Streaming.

The newest version of each record is kept in a bucketed table (change_feed.py): a batch of mutations rewrites the buckets it
falls into and no others, whatever the log has grown to, and applying it again after a failure changes nothing. ``watch``
evaluates a query on that table after every batch that touched its namespace and hands over the whole result, as it was
after just that batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafmere.operators.change_feed import BucketTable
from leafmere.operators.log import accepted


def log_stream(spark, path: str, schema: StructType | str, files_a_batch: int | None = None) -> DataFrame:
    """The mutation log under ``path`` as a stream of its new Parquet files; each file is taken once."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


FIXED = ("ns", "_id", "hlc", "op", "device_id")


def _records(batch: DataFrame) -> DataFrame:
    """A batch of the log in the columns of a bucketed table; what is not part of them goes into the body."""
    rest = [c for c in batch.columns if c not in FIXED]
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit(None).cast("string")
    gone = F.col("op") == "delete"
    return batch.select("ns", F.col("_id").alias("key"), "hlc", "device_id", gone.alias("deleted"), F.when(~gone, body).alias("body"))


def _log(records: DataFrame, schema: StructType) -> DataFrame:
    """The rows of a bucketed table in the columns of the log."""
    rest = StructType([f for f in schema if f.name not in FIXED])
    out = records.withColumns({"_id": F.col("key"), "op": F.when(F.col("deleted"), "delete").otherwise("put")})
    if rest.fields:
        out = out.withColumn("__rest", F.from_json("body", rest)).select("*", "__rest.*")
    return out.select(*[F.col(f.name) for f in schema])


def _applied(batch: DataFrame, root: str) -> BucketTable:
    """The table under ``root`` after a batch; it is made by the first."""
    try:
        table = BucketTable.load(batch.sparkSession, root).apply(_records(batch))
    except FileNotFoundError:
        table = BucketTable.create(_records(batch), root)
    table.vacuum(2)
    return table


def watch(stream: DataFrame, path: str, ns: str, query: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Call ``emit(result, batch)`` with the query's whole result whenever a batch touched the namespace.

    path: where the log is; the state is kept beside the checkpoint. trigger: e.g. {"processingTime": "50 milliseconds"}, which
    gathers writes as a debounce would, or {"availableNow": True}.
    """
    schema = stream.schema

    def evaluate(batch: DataFrame, number: int) -> None:
        mine = batch.where(F.col("ns") == ns)
        if not mine.isEmpty():
            table = _applied(mine, f"{checkpoint}-state")
            emit(query(_log(table.rows().where("not deleted"), schema)), number)

    return stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch_key(stream: DataFrame, path: str, ns: str, key: str, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return watch(stream, path, ns, lambda docs: docs.where(F.col("_id") == key), emit, checkpoint, trigger)


def current(stream: DataFrame, floor: int = 0, now_ms: int | None = None) -> DataFrame:
    """(ns, _id, hlc, device_id, op): a streaming aggregate for update or complete mode; needs no watermark, since a
    record's state is one row whatever comes late."""
    best = F.max(F.struct("hlc", "device_id", "op")).alias("v")
    return accepted(stream, floor, now_ms).groupBy("ns", "_id").agg(best).select("ns", "_id", "v.*")


def with_event_time(stream: DataFrame, late: str = "60 seconds") -> DataFrame:
    """The log with ``event_time`` from its clock and a watermark on it."""
    return stream.withColumn("event_time", F.timestamp_millis(F.shiftright("hlc", 16))).withWatermark("event_time", late)


def status_counts(stream: DataFrame, state: str = "state") -> DataFrame:
    """(state, n), for complete mode."""
    return stream.groupBy(state).agg(F.count("*").alias("n"))


def write_events(stream: DataFrame, emit: Callable[[list[str], int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Call ``emit(namespaces, batch)`` with the namespaces that each batch touched."""
    def note(batch: DataFrame, number: int) -> None:
        emit(sorted(r[0] for r in batch.select("ns").where("ns is not null").distinct().collect()), number)

    return stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep ``path`` as a bucketed table of the newest version of each record; every batch rewrites the buckets it touches."""
    def keep(batch: DataFrame, number: int) -> None:
        _applied(batch, path)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version of each record, deletions too, of a table that ``current_table`` keeps, in the log's columns."""
    return _log(BucketTable.load(spark, path).rows(), schema)

"""Operators over an append-only mutation log with columns ns, _id, hlc, op ('put' or 'delete'), device_id and a value.

The newest version of a record wins: the highest hlc, at equal hlc the greater device id. Windows and aggregates are
partitioned by record, and the snapshot is a max aggregate, which reduces a hot record before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmere.operators.running import running

RECORD = ["ns", "_id"]
DAY_MS = 86_400_000


def comparable(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the columns that have an order."""
    return [n for n in names if not any(t in df.schema[n].dataType.simpleString() for t in ("map<", "variant"))]


def merged(*logs: DataFrame) -> DataFrame:
    """All logs as one, each mutation once; of rows that differ only in their values the greatest counts."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    identity = [*RECORD, "hlc", "op", "device_id"]
    rest = [c for c in out.columns if c not in identity]
    if not rest:
        return out.dropDuplicates(identity)
    order = comparable(out, rest)
    best = out.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest)))
    return best.toDF(*identity, "v").select(*identity, "v.*").select(*out.columns)


def newest(log: DataFrame) -> DataFrame:
    """The current version of every record, deletions too; at equal hlc and device a deletion, then the greater values."""
    rest = [c for c in log.columns if c not in (*RECORD, "hlc", "device_id")]
    order = F.struct("hlc", "device_id", *[(F.col("op") == "delete").alias("__gone")] * ("op" in rest), *comparable(log, rest))
    best = log.groupBy(*RECORD).agg(F.max_by(F.struct("hlc", "device_id", *rest), order).alias("v"))
    return best.select(*RECORD, "v.*").select(*log.columns)


def snapshot(log: DataFrame) -> DataFrame:
    return newest(log).where("op <> 'delete'")


def as_of(log: DataFrame, hlc: int | Column) -> DataFrame:
    """The records as they were at ``hlc``."""
    return snapshot(log.where(F.col("hlc") <= hlc))


def version_at(log: DataFrame, hlc: int | Column) -> DataFrame:
    return log.where(F.col("hlc") == hlc)


def history(log: DataFrame, key: str | None = None, newest_first: bool = False) -> DataFrame:
    out = log if key is None else log.where(F.col("_id") == key)
    return out.orderBy(*RECORD, F.col("hlc").desc() if newest_first else F.col("hlc").asc(), "device_id")


def policy(ns: Column) -> Column:
    """How a namespace is compacted: version chains are kept whole, all others collapse to the newest version."""
    return F.when(ns.startswith("$$"), "collapse").when(ns.startswith("$ver:"), "retain").otherwise("collapse")


def compacted(log: DataFrame, horizon: int | None = None, all_levels: bool = True) -> DataFrame:
    """The log without collapsed versions and, given the horizon and all levels, without old deletions."""
    kept = log.where(policy(F.col("ns")) == "retain").unionByName(newest(log.where(policy(F.col("ns")) == "collapse")))
    return without_tombstones(kept, horizon) if horizon is not None and all_levels else kept


def without_tombstones(log: DataFrame, horizon: int) -> DataFrame:
    return log.where(~((F.col("op") == "delete") & (F.col("hlc") < horizon)))


def gc_horizon(devices: DataFrame, now_ms: int, self_id: str, stale_days: int = 90) -> DataFrame:
    """One row (horizon): the least current_hlc of all devices, stale peers left aside, this device never."""
    fresh = F.shiftright("current_hlc", 16) >= now_ms - stale_days * DAY_MS
    return devices.where(fresh | (F.col("device_id") == self_id)).agg(F.min("current_hlc").alias("horizon"))


def pulled(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Mutations above the reader's high-water mark of their device; devices without a mark count from 0.

    marks: (device_id, hwm), a row a device.
    """
    out = log.join(marks, "device_id", "left")
    return out.where(F.col("hlc") > F.coalesce("hwm", F.lit(0))).drop("hwm").select(*log.columns)


def accepted(log: DataFrame, floor: int, now_ms: int | None = None, drift_ms: int = 60_000) -> DataFrame:
    """Mutations above the floor below which deletions may be gone, and no further ahead of the wall clock than ``drift_ms``."""
    out = log.where(F.col("hlc") > floor)
    return out if now_ms is None else out.where(F.shiftright("hlc", 16) <= now_ms + drift_ms)


def evicted(marks: DataFrame, now_ms: int, stale_days: int = 90) -> DataFrame:
    """Devices that are stale by the clock and behind every live peer: (device_id, current_hlc, evicted)."""
    live = F.shiftright("current_hlc", 16) >= now_ms - stale_days * DAY_MS
    least = marks.where(live).agg(F.min("current_hlc").alias("least"))
    return marks.crossJoin(F.broadcast(least)).select("device_id", "current_hlc", F.coalesce(~live & (F.col("current_hlc") < F.col("least")), F.lit(False)).alias("evicted"))


def retained(log: DataFrame, now_ms: int, versions: int | None = 4, days: int | None = 90) -> DataFrame:
    """Versions that retention keeps: the newest, those among the newest ``versions``, those no older than ``days``.

    Both None keeps all; versions 0 without days keeps none. A record whose newest version is a deletion older than
    the days goes whole. Ages of exactly the days are kept.
    """
    if versions is None and days is None:
        return log
    if versions == 0 and days is None:
        return log.limit(0)
    age = F.lit(now_ms) - F.shiftright("hlc", 16)
    young = log.where(age <= (days * DAY_MS if days is not None else -1))
    # Numbering stops at the bound before the shuffle, so that a record with any share of the rows sends few of them.
    w = Window.partitionBy(*RECORD).orderBy(F.col("hlc").desc(), F.col("device_id").desc())
    top = log.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= max(versions or 0, 1)).drop("__rank")
    kept = top.unionByName(young).dropDuplicates([*RECORD, "hlc", "op", "device_id"]) if days is not None else top
    if days is None:
        return kept
    purged = newest(log.select(*RECORD, "hlc", "device_id", "op")).where((F.col("op") == "delete") & (age > days * DAY_MS)).select(*RECORD)
    return kept.join(purged, RECORD, "left_anti").select(*log.columns)


def promoted(log: DataFrame, key: str, hlc: int, new_hlc: int, device_id: str) -> DataFrame:
    """The row that makes an older version current again, with ``promoted_from``; empty where there is no such version
    or a deleted record would be deleted again."""
    chosen = log.where((F.col("_id") == key) & (F.col("hlc") == hlc))
    gone = newest(log.where(F.col("_id") == key)).where("op = 'delete'").select(*RECORD)
    again = chosen.where("op = 'delete'").join(gone, RECORD, "left_anti")
    out = chosen.where("op <> 'delete'").unionByName(again)
    return out.withColumn("promoted_from", F.col("hlc")).withColumn("hlc", F.lit(new_hlc).cast("bigint")).withColumn("device_id", F.lit(device_id))


def forks(writes: DataFrame, devices_at_once: int = 500) -> DataFrame:
    """Pairs of competing writes: each write with the latest earlier write to the same record by every other device.

    writes: (ns, _id, device_id, seq, hlc), seq unique within a record. Result: (ns, _id, seq_a, device_a, seq_b, device_b,
    winner) with b the earlier one. A running maximum a device takes the place of a join of a record with itself; the
    names of a store's devices are known to the driver, and so many of them are followed in one pass.
    """
    devices = sorted(r[0] for r in writes.select("device_id").distinct().where("device_id is not null").collect())
    groups = [devices[i : i + devices_at_once] for i in range(0, len(devices), devices_at_once)] or [[]]
    return reduce(DataFrame.unionAll, [_forks_with(writes, g) for g in groups])


def _forks_with(writes: DataFrame, devices: list[str]) -> DataFrame:
    """The pairs of forks whose earlier write is of one of the devices."""
    if not devices:
        return writes.limit(0).select(*RECORD, F.col("seq").alias("seq_a"), F.col("device_id").alias("device_a"), F.col("seq").alias("seq_b"), F.col("device_id").alias("device_b"), F.col("device_id").alias("winner"))
    rows = writes.select(*RECORD, "device_id", "seq", "hlc")
    for i, d in enumerate(devices):
        rows = rows.withColumn(f"w{i}", F.when(F.col("device_id") == d, F.struct("seq", "hlc", "device_id")))
    earlier = running(rows, RECORD, [F.col("seq").asc()], {f"e{i}": ("max", f"w{i}") for i in range(len(devices))})
    pairs = earlier.select(*RECORD, F.col("seq").alias("seq_a"), F.col("device_id").alias("device_a"), F.col("hlc").alias("hlc_a"), F.explode(F.array(*[F.col(f"e{i}") for i in range(len(devices))])).alias("b"))
    pairs = pairs.where(F.col("b").isNotNull() & (F.col("b.device_id") != F.col("device_a")))
    wins = F.struct(F.col("hlc_a").alias("h"), F.col("device_a").alias("d")) > F.struct(F.col("b.hlc").alias("h"), F.col("b.device_id").alias("d"))
    return pairs.select(*RECORD, "seq_a", "device_a", F.col("b.seq").alias("seq_b"), F.col("b.device_id").alias("device_b"), F.when(wins, F.col("device_a")).otherwise(F.col("b.device_id")).alias("winner"))


def visible(log: DataFrame, device_id: str, cursors: DataFrame) -> DataFrame:
    """What a device sees: its own writes and those of peers pushed no later than its cursor (device_id, cursor)."""
    seen = log.join(cursors, "device_id", "left")
    return snapshot(seen.where((F.col("device_id") == device_id) | (F.col("push_seq") <= F.col("cursor"))).drop("cursor"))


def delta(before: DataFrame, after: DataFrame, key: str = "_id", version: str = "hlc") -> DataFrame:
    """(key, change) between two snapshots: added, updated (another version) or deleted."""
    a = before.select(F.col(key).alias("k_a"), F.col(version).alias("v_a"))
    b = after.select(F.col(key).alias("k_b"), F.col(version).alias("v_b"))
    change = F.when(F.col("k_a").isNull(), "added").when(F.col("k_b").isNull(), "deleted").when(~F.col("v_a").eqNullSafe(F.col("v_b")), "updated")
    return a.join(b, F.col("k_a") == F.col("k_b"), "full_outer").select(F.coalesce("k_b", "k_a").alias(key), change.alias("change")).where("change is not null")


def puts(docs: DataFrame, ns: str, hlc: int, device_id: str, key: str = "_id") -> DataFrame:
    """Log rows that set each document, at one clock value for the whole batch, whose keys are unique."""
    return docs.withColumn("ns", F.lit(ns)).withColumn("hlc", F.lit(hlc).cast("bigint")).withColumn("op", F.lit("put")).withColumn("device_id", F.lit(device_id)).withColumnRenamed(key, "_id")


def inserts(docs: DataFrame, current: DataFrame, ns: str, hlc: int, device_id: str) -> DataFrame:
    """puts of documents that must not exist yet."""
    if not docs.join(current.where(F.col("ns") == ns), "_id", "left_semi").isEmpty():
        raise ValueError("a document with this key exists")
    return puts(docs, ns, hlc, device_id)


def replacements(docs: DataFrame, current: DataFrame, ns: str, hlc: int, device_id: str) -> DataFrame:
    """puts of documents that must exist."""
    if not docs.join(current.where(F.col("ns") == ns), "_id", "left_anti").isEmpty():
        raise ValueError("no document has this key")
    return puts(docs, ns, hlc, device_id)


def deletions(keys: DataFrame, current: DataFrame, ns: str, hlc: int, device_id: str) -> DataFrame:
    """Log rows that delete the keys that exist."""
    gone = keys.select("_id").distinct().join(current.where(F.col("ns") == ns), "_id", "left_semi")
    return gone.select(F.lit(ns).alias("ns"), "_id", F.lit(hlc).cast("bigint").alias("hlc"), F.lit("delete").alias("op"), F.lit(device_id).alias("device_id"))


def updated(docs: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Documents with top-level fields set where the condition holds; the key cannot be set."""
    if "_id" in changes:
        raise ValueError("a document's key cannot be changed")
    met = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return docs.withColumns({name: F.when(met, value).otherwise(F.col(name)) if name in docs.columns else F.when(met, value) for name, value in changes.items()})

"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

Items are dealt to shards by hash, each shard of about ``per_shard`` containers' worth, and every shard is packed in
one task: items in decreasing size, each into the tightest open container that takes it, found in logarithmic time.
All but one container of a shard are more than half full, so sharding costs under one container in ``per_shard``.

Defined cases: only an item over the capacity is split, into full pieces with a container each and one remainder; an
item of size 0 is put where it fits; a null size counts as 0; repeated rows are items of their own; an item with a
null identifier is packed like any other; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.llm.bpe import token_count
from leafmere.operators.cutting import cut


class OpenContainers:
    """Open containers by remaining capacity: a segment tree of counts with a stack of containers at each leaf."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.stacks.setdefault(remaining, []).append(container)
        at = remaining + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """(container, its remaining capacity) of the open container with the least capacity of ``size`` or more."""
        at, count = size + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.stacks[remaining].pop(), remaining


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item, in the order given; sizes must decrease for best-fit decreasing."""
    open_ones, out, made = OpenContainers(capacity), [], 0
    for size in sizes:
        if (found := open_ones.take_tightest(size)) is None:
            found = made, capacity
            made += 1
        container, remaining = found
        out.append(container)
        open_ones.add(remaining - size, container)
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, per_shard: int = 1000) -> DataFrame:
    """(key, piece, size, container) of all pieces: ``piece`` counts an item's pieces from 1, ``container`` is unique."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = cut(items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")))
    weight, rows = sized.agg(F.sum("size"), F.count("*")).first()
    # Shards bound a task's work by containers and by rows.
    shards = max(1, -(-(weight or 0) // (capacity * per_shard)), -(-rows // (200 * per_shard)))
    full = F.floor((F.col("size") - 1) / capacity)
    pieces = F.when(F.col("size") > capacity, F.sequence(F.lit(1).cast("bigint"), full + 1)).otherwise(F.array(F.lit(1).cast("bigint")))
    cutup = sized.select("key", F.col("size").alias("whole"), F.monotonically_increasing_id().alias("row"), F.explode(pieces).alias("piece"))
    cutup = cutup.select("key", "row", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("whole") - (F.col("piece") - 1) * capacity).cast("int").alias("size"))
    # Rows of one key and pieces of one huge item spread over the shards like other items.
    cutup = cutup.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    schema = T.StructType([cutup.schema["key"], T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType())])

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        first = table.column("shard")[0].as_py() << 32 if len(table) else 0
        containers = best_fit(table.column("size").to_pylist(), capacity)
        return table.select(["key", "piece", "size"]).append_column("container", pa.array([first + c for c in containers], pa.int64()))

    return cutup.groupBy("shard").applyInArrow(shard, schema).withColumnRenamed("key", key)


def pack_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """(key, piece, size, container): texts packed by their number of tokens of a public tokenizer."""
    return pack(documents.select(F.col(key), token_count(F.col(text), tokenizer).alias("tokens")), key, "tokens", capacity)


def split_items(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the items that had to be split."""
    return packed.where("piece = 2").select(key).distinct()

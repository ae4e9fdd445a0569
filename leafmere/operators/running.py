"""Running aggregates over sorted groups of any size, none of which has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmere.operators.cutting import cut

PART = "__part"


def running(df: DataFrame, group: list[str], order: list[Column], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each new column name: (``sum``, ``min`` or ``max``, column), that aggregate over the rows of the same group
    that sort strictly before the row by ``order``; null on a group's first row. ``order`` must be total within a group.

    Rows are range-partitioned by group and order, so a group of a third of all rows spreads over as many parts as its
    share; one aggregate of a row a group and part carries the totals of earlier parts. Null group values form a group,
    and without group columns all rows are one.
    An empty df gives an empty result.
    """
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    keys = [F.col(g) for g in group]
    spread = cut(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))
    totals = spread.groupBy(*group, PART).agg(*[of[how](c).alias(f"__{name}") for name, (how, c) in aggregates.items()])
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(PART).alias("__p"), *[of[how](f"__{name}").over(before).alias(f"__{name}") for name, (how, _) in aggregates.items()])
    same = F.col(PART) == F.col("__p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(totals, same, "left")
    for name, (how, c) in aggregates.items():
        here = of[how](c).over(inside)
        earlier = F.col(f"__{name}")
        both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}[how](earlier, here)
        out = out.withColumn(name, both)
    return out.drop(PART, "__p", *[f"__{n}" for n in aggregates], *[f"__g{i}" for i in range(len(group))])

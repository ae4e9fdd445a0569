"""One ranking from several differently scaled scores by median rank aggregation.

Every item is ranked in each component among the items that carry it; an item's place in the final order follows its
weighted median rank, then its mean rank, then its identifier. Only ranks are compared, so a component's range or
distribution has no weight.

The hits of a query are brought together once, by one shuffle, and ranked there by windows, which spill. A query with more than
``WHOLE_QUERY`` rows is not brought together: its ranks are running counts over ranges of its values (running.py), with the same
result.

Defined cases: repeated rows count once; a component that is null or NaN is not carried; items of equal value share the
mean of their ranks; an item without any carried component comes last, with null ranks; an even median is the mean of
the two middle ranks. An empty table gives an empty ranking. Columns of the input that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmere.llm.neighbours import sent
from leafmere.operators.cutting import cut
from leafmere.operators.running import running

#: Rows of a query up to which one task holds it.
WHOLE_QUERY = 200_000


def of_all_queries(hits: DataFrame, query: str, result: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``result`` of the hits of ordinary queries, by query and whole, and of those of the largest queries, not whole."""
    large = sent(hits.groupBy(query).count().where(F.col("count") > WHOLE_QUERY).select(F.col(query).alias("__large")))
    if large is None:
        return result(hits, True)
    same = F.col(query).eqNullSafe(F.col("__large"))
    return result(hits.join(large, same, "left_anti"), True).unionAll(result(hits.join(large, same, "left_semi"), False))


def before(df: DataFrame, group: list[str], order: list[Column], aggregates: dict[str, tuple[str, str]], whole: bool) -> DataFrame:
    """What ``running`` gives, by a window if the groups are whole."""
    if not whole:
        return running(df, group, order, aggregates)
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    return df.withColumns({name: of[how](c).over(over) for name, (how, c) in aggregates.items()})


def distinct_hits(hits: DataFrame, query: str, item: list[str], score: str, fields: str, whole: bool) -> DataFrame:
    """(q, item (struct), score, entries) of every distinct hit, its components in order of their names."""
    entries = F.array_sort(F.map_entries(fields)).alias("entries")
    rows = hits.select(F.col(query).alias("q"), F.struct(*item).alias("item"), F.col(score).cast("double").alias("score"), entries)
    # Hits that lie by query need no further shuffle to be told apart.
    return rows.repartition("q").distinct() if whole else cut(rows.distinct())


def long_scores(hits: DataFrame) -> DataFrame:
    """One row a distinct hit and component: q, item, score, name, value; value null where it is not carried."""
    out = hits.select("q", "item", "score", F.explode_outer("entries").alias("entry"))
    value = F.col("entry.value").cast("double")
    return out.select("q", "item", "score", F.col("entry.key").alias("name"), F.when(~F.isnan(value), value).alias("value"))


def component_ranks(scores: DataFrame, whole: bool) -> DataFrame:
    """The rows of ``scores`` with the rank of each value among those of its query and component; null where none is carried."""
    if whole:
        down = Window.partitionBy("q", "name").orderBy(F.col("value").desc_nulls_last())
        ties = F.count("*").over(Window.partitionBy("q", "name", "value"))
        return scores.withColumn("rank", F.when(F.col("value").isNotNull(), F.rank().over(down) + (ties - 1) / 2))
    values = scores.where("value is not null").groupBy("q", "name", "value").agg(F.count("*").alias("n"))
    # From the greatest value down, the hits before a value are those that rank above it.
    out = before(values, ["q", "name"], [F.col("value").desc()], {"above": ("sum", "n")}, whole)
    ranks = out.select("q", "name", "value", (F.coalesce("above", F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))
    same = F.col("s.q").eqNullSafe(F.col("r.q")) & (F.col("s.name") == F.col("r.name")) & (F.col("s.value") == F.col("r.value"))
    return scores.alias("s").join(ranks.alias("r"), same, "left").select("s.*", "r.rank")


def weighted_median(ranks: Column) -> Column:
    """Weighted median of an array of structs (rank, weight): the mean of the lower and upper one."""
    ordered = F.array_sort(ranks)
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["weight"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(a: Column, x: Column) -> Column:
        upto = a["sum"] + x["weight"]
        return F.struct(upto.alias("sum"), F.when(a["low"].isNull() & (upto * 2 >= total), x["rank"]).otherwise(a["low"]).alias("low"),
                        F.when(a["high"].isNull() & (upto * 2 > total), x["rank"]).otherwise(a["high"]).alias("high"))

    ends = F.aggregate(ordered, start, step)
    return (ends["low"] + ends["high"]) / 2


def median_ranking(hits: DataFrame, query: str = "query_id", item: tuple[str, ...] = ("ns", "doc_key"), score: str = "score",
                   fields: str = "field_scores", weights: dict[str, float] | None = None) -> DataFrame:
    """(query, *item, median_rank, mean_rank, place) for every distinct item of every query; place counts from 1.

    weights: a positive weight by component name, 1 where a name is missing.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        if not w > 0:
            raise ValueError(f"weight of {name} must be positive")
        weight = F.when(F.col("name") == name, F.lit(float(w))).otherwise(weight)

    def ranked(some: DataFrame, whole: bool) -> DataFrame:
        ranks = component_ranks(long_scores(distinct_hits(some, query, list(item), score, fields, whole)), whole)
        pairs = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", weight.alias("weight"))))
        items = ranks.groupBy("q", "item").agg(pairs.alias("ranks"), F.avg("rank").alias("mean_rank"))
        items = items.withColumn("median_rank", weighted_median(F.col("ranks"))).drop("ranks").withColumn("one", F.lit(1))
        order = [F.col("median_rank").asc_nulls_last(), F.col("mean_rank").asc_nulls_last(), F.col("item").asc()]
        placed = before(items, ["q"], order, {"place": ("sum", "one")}, whole)
        return placed.select(F.col("q").alias(query), *[F.col(f"item.{c}").alias(c) for c in item], "median_rank", "mean_rank", (F.coalesce("place", F.lit(0)) + 1).alias("place"))

    return of_all_queries(hits, query, ranked)


def ruled_queries(hits: DataFrame, query: str = "query_id", item: tuple[str, ...] = ("ns", "doc_key"), score: str = "score",
                  fields: str = "field_scores", least_hits: int = 8) -> DataFrame:
    """(query) of each query whose stored score follows one component: the component ranks and the scores agree strictly.

    At least two component names must occur in the query's hits, and one of them must be carried by ``least_hits`` hits
    or more with different values, a larger value always with a strictly larger score. A missing or NaN score agrees
    with nothing.
    """
    # The hits of a rank have one value; over is the least score of those that rank above it.
    worth = F.when(~F.isnan("score"), F.col("score"))

    def ruled(some: DataFrame, whole: bool) -> DataFrame:
        scores = long_scores(distinct_hits(some, query, list(item), score, fields, whole))
        # A row a rank; hits that carry nothing have none, and only tell of the name.
        places = component_ranks(scores.where("name is not null"), whole).groupBy("q", "name", "rank").agg(
            F.count("*").alias("n"), F.min(worth).alias("least"), F.max(worth).alias("most"), F.max(worth.isNull().cast("int")).alias("odd"))
        values = before(places, ["q", "name"], [F.col("rank").asc_nulls_last()], {"over": ("min", "least")}, whole)
        carried = F.col("rank").isNotNull()
        broken = carried & ((F.col("odd") == 1) | (F.col("over") <= F.col("most")))
        by_name = values.groupBy("q", "name").agg(F.sum(F.when(carried, F.col("n"))).alias("hits"), F.count_if(carried).alias("values"), F.max(F.coalesce(broken, F.lit(False))).alias("broken"))
        rules = (F.col("hits") >= least_hits) & (F.col("values") > 1) & ~F.col("broken")
        by_query = by_name.groupBy("q").agg(F.count("*").alias("names"), F.max(F.coalesce(rules, F.lit(False))).alias("ruled"))
        return by_query.where("names > 1 and ruled").select(F.col("q").alias(query))

    return of_all_queries(hits, query, ruled)

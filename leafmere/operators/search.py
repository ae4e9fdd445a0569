"""Ranked search: BM25 over fields, cosine over quantised vectors and reciprocal rank fusion of both.

All scores are plain SQL expressions. Query terms and query vectors are bounded by the query and are broadcast; what
comes from the corpus is joined on keys. Ties are ordered by document key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmere.functions.text import search_terms
from leafmere.operators.running import running

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, field: str, **terms) -> DataFrame:
    """(key, term, tf, dl): how often each term is in the field of each document, and the field's length in terms."""
    words = docs.where(F.length(field) > 0).select(F.col(key), search_terms(F.col(field), **terms).alias("__words"))
    each = words.select(key, F.size("__words").cast("bigint").alias("dl"), F.explode("__words").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus(docs: DataFrame, key: str, field: str, **terms) -> DataFrame:
    """One row (n, total): documents with a term or more, and terms in all. Needs no shuffle of terms."""
    lengths = docs.where(F.length(field) > 0).select(F.size(search_terms(F.col(field), **terms)).cast("bigint").alias("dl"))
    return lengths.agg(F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("total"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, df: Column, dl: Column, n: Column, total: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (total / n)))


def query_terms(spark: SparkSession, query: str, **terms) -> DataFrame:
    """Distinct terms of a query, one row each."""
    return spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(search_terms(F.col("q"), **terms))).alias("term"))


def field_scores(docs: DataFrame, key: str, field: str, query: str, candidates: DataFrame | None = None, **terms) -> DataFrame:
    """(key, score) of the documents with a query term in the field; ``key`` is unique.

    candidates restrict hits and document frequencies, while the number and lengths of documents stay the whole corpus's.
    Terms are counted where a document is read: no term is shuffled, and one row of statistics is all that is broadcast.
    The second pass only takes texts apart that hold a term as a part of a word or more.
    """
    wanted = [r[0] for r in query_terms(docs.sparkSession, query, **terms).collect()]
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)

    def counted(rows: DataFrame) -> DataFrame:
        words = rows.select(key, search_terms(F.col(field), **terms).alias("__words"))
        times = lambda t: (F.size("__words") - F.size(F.array_remove("__words", t))).cast("bigint")
        return words.select(key, F.size("__words").cast("bigint").alias("dl"), *[times(t).alias(f"tf{i}") for i, t in enumerate(wanted)])

    frequencies = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    texts = docs.where(F.length(field) > 0)
    # Conditions on counts would be moved below them and take every text apart twice, so they are part of the sums.
    whole = [F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("total")]
    within = texts
    if not terms.get("stemmed"):
        lowered = F.lower(F.col(field))
        within = texts.where(reduce(lambda a, b: a | b, [lowered.contains(t) for t in wanted]))
    hits = counted(within)
    if candidates is None:
        stats = counted(texts).agg(*whole, *frequencies)
    else:
        hits = hits.join(candidates.select(key).distinct(), key, "left_semi")
        stats = hits.agg(*frequencies).crossJoin(corpus(docs, key, field, **terms))
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"tf{i}") > 0, bm25(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("dl"), F.col("n"), F.col("total"))).otherwise(0.0) for i in range(len(wanted))])
    return hits.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")


def ranked(hits: DataFrame, key: str, score: str = "score", limit: int | None = None, offset: int = 0) -> DataFrame:
    """hits with ``rank`` counted from 1 by score, then key; the page after ``offset``, or all of them without a limit."""
    order = [F.col(score).desc(), F.col(key).asc()]
    if limit is None:
        # All ranks at once are a running count over ranges of the order, which no task holds whole.
        out = running(hits.withColumn("__one", F.lit(1)), [], order, {"__before": ("sum", "__one")})
        out = out.withColumn("rank", (F.coalesce("__before", F.lit(0)) + 1).cast("bigint")).drop("__one", "__before")
    else:
        # The page is cut by a distributed top-k before its rows are numbered.
        out = hits.orderBy(*order).limit(limit + offset).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return out.where(F.col("rank") > offset) if offset else out


def lexical(docs: DataFrame, key: str, fields: list[str], query: str, candidates: DataFrame | None = None, limit: int | None = 10, offset: int = 0, **terms) -> DataFrame:
    """(key, score, {field}:bm25..., rank): the best field decides."""
    return best_fields({f: field_scores(docs, key, f, query, candidates, **terms) for f in fields}, key, limit, offset)


def best_fields(scores: dict[str, DataFrame], key: str, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """(key, score, {field}:bm25..., rank) of (key, score) by field."""
    legs = [df.select(key, F.lit(f).alias("__field"), "score") for f, df in scores.items()]
    merged = reduce(DataFrame.unionAll, legs).groupBy(key).agg(F.max("score").alias("score"), *[F.max(F.when(F.col("__field") == f, F.col("score"))).alias(f"{f}:bm25") for f in scores])
    return ranked(merged, key, "score", limit, offset)


def quantised(vec: Column) -> Column:
    """One byte a dimension: round((f + 1) / 2 * 255), clamped to 0..255."""
    return F.transform(vec, lambda f: F.greatest(F.lit(0), F.least(F.lit(255), F.round((f.cast("double") + 1) / 2 * 255).cast("int"))))


def dequantised(units: Column) -> Column:
    return F.transform(units, lambda u: u / 255.0 * 2 - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(values: list[float]) -> list[float]:
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values] if norm else list(values)


def cosine_scores(vectors: DataFrame, key: str, vec: str, query: list[float], candidates: DataFrame | None = None) -> DataFrame:
    """(key, score): dot product of the unit query and the quantised vectors, the best of a key; other lengths are skipped.

    Scores have nine decimals, so that the order of additions never decides between equal vectors.
    """
    q = F.array(*[F.lit(float(v)) for v in unit(query)])
    rows = vectors if candidates is None else vectors.join(candidates.select(key).distinct(), key, "left_semi")
    scored = rows.where(F.size(vec) == len(query)).select(key, F.round(dot(q, dequantised(quantised(F.col(vec)))), 9).alias("score"))
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def semantic(vectors: DataFrame, key: str, vec: str, query: list[float], candidates: DataFrame | None = None, top: int | None = 100, field: str = "vec") -> DataFrame:
    """(key, score, {field}:cosine, rank) of the ``top`` documents by cosine_scores."""
    return ranked(cosine_scores(vectors, key, vec, query, candidates), key, "score", top).withColumn(f"{field}:cosine", F.col("score"))


def fused(legs: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score): sum of 1 / (k + rank) over the legs, each with ``rank``; a leg without a document adds 0."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    parts = [leg.select(key, (1.0 / (k + F.col("rank"))).alias("part")) for leg in legs]
    return reduce(DataFrame.unionAll, parts).groupBy(key).agg(F.sum("part").alias("score"))


def rrf(legs: list[DataFrame], key: str, k: int = RRF_K, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """(key, score, rank): a page of the fused legs."""
    return ranked(fused(legs, key, k), key, "score", limit, offset)


def search(docs: DataFrame, key: str, query: str, fields: list[str] | None = None, text_fields: tuple[str, ...] = (), vectors: DataFrame | None = None, vec: str = "vec", query_vector: list[float] | None = None, where: Column | None = None,
           mode: str = "auto", candidates: int = 100, limit: int = 10, offset: int = 0, rrf_k: int = RRF_K, **terms) -> tuple[DataFrame | None, list[str]]:
    """(hits, skipped fields). mode: auto, lexical, semantic or hybrid; auto takes both legs if both are there.

    The condition is resolved once and restricts both legs. An empty query gives no hits (None).
    """
    if mode not in ("auto", "lexical", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    asked = list(fields) if fields is not None else list(text_fields)
    known = [f for f in asked if f in text_fields]
    skipped = [f for f in asked if f not in text_fields]
    if not query.strip():
        return None, skipped
    lexical_leg, semantic_leg = bool(known) and mode != "semantic", vectors is not None and query_vector is not None and mode != "lexical"
    kept = docs.where(where).select(key) if where is not None else None
    both = lexical_leg and semantic_leg
    legs = []
    if lexical_leg:
        legs.append(lexical(docs, key, known, query, kept, candidates if both else limit, 0 if both else offset, **terms))
    if semantic_leg:
        hits = semantic(vectors, key, vec, query_vector, kept, candidates)
        legs.append(hits if both else hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)))
    if not legs:
        return None, skipped
    return (rrf(legs, key, rrf_k, limit, offset) if both else legs[0]), skipped

"""Sliding word windows over texts, with byte spans, and search over the chunks of attached blobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.functions.text import TOKEN, search_terms
from leafmere.operators.search import K1, B, cosine_scores, fused, idf, query_terms, ranked


def chunk_count(words: Column, size: int = 300, overlap: int = 50) -> Column:
    """1 for up to ``size`` words, else one more for each further step; 0 for no words."""
    step = size - overlap
    return F.when(words == 0, 0).when(words <= size, 1).otherwise(1 + F.ceil((words - size) / step)).cast("int")


def cumulated(lengths: Column) -> Column:
    """The running sums of each array of numbers without nulls."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def sums(arrays: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.diff(arrays.offsets.to_numpy()))])
        total = np.concatenate([[0], np.cumsum(arrays.flatten().to_numpy().astype(np.int64))])
        out = total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32)))

    return sums(lengths)


def chunks(docs: DataFrame, key: str, text: str, size: int = 300, overlap: int = 50) -> DataFrame:
    """(key, chunk, start_word, end_word, word_count, byte_start, byte_end, chunk_text) of every window of ``size`` words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    # Words with whatever stands before them; their lengths, cumulated once a text, give the places of each word.
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).*?{TOKEN}"), F.lit(0))
    # The words themselves, in the same order.
    names = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    rows = docs.where(F.col(text).isNotNull()).select(key, parts.alias("__parts"), names.alias("__words"))
    rows = rows.withColumn("__n", F.size("__words")).withColumn("__ends", cumulated(F.transform("__parts", lambda p: F.octet_length(p))))
    windows = rows.select("*", F.posexplode(F.sequence(F.lit(0), chunk_count(F.col("__n"), size, overlap) - 1)).alias("chunk", "__i")).where("__n > 0")
    start = F.col("chunk") * (size - overlap)
    end = F.least(F.col("__n"), start + size)
    windows = windows.withColumn("start_word", start).withColumn("end_word", end)
    first = F.get("__words", F.col("start_word"))
    byte_start = F.get("__ends", F.col("start_word")) - F.octet_length(first)
    byte_end = F.get("__ends", F.col("end_word") - 1)
    count = F.col("end_word") - F.col("start_word")
    body = F.concat(first, F.array_join(F.slice("__parts", F.col("start_word") + 2, count - 1), ""))
    return windows.select(key, "chunk", "start_word", "end_word", count.alias("word_count"), byte_start.alias("byte_start"), byte_end.alias("byte_end"), F.slice("__words", F.col("start_word") + 1, count).alias("words"), body.alias("chunk_text"))


def blob_bm25(chunked: DataFrame, key: str, query: str, stop: bool = True) -> DataFrame:
    """(key, score): every blob is a corpus of its chunks, each term counts by its best chunk.

    The length of a chunk is its raw number of words, while the average is taken over its terms, as the service
    that this follows has it.
    """
    terms = F.filter(search_terms(F.array_join("words", " "), stop), lambda w: w.isNotNull())
    rows = chunked.select(key, "chunk", F.col("word_count").alias("dl"), terms.alias("terms"))
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total"))
    wanted = F.broadcast(query_terms(chunked.sparkSession, query, stop=stop))
    hits = rows.select(key, "chunk", "dl", F.explode("terms").alias("term")).join(wanted, "term").groupBy(key, "chunk", "dl", "term").agg(F.count("*").alias("tf"))
    found = hits.groupBy(key, "term").agg(F.count("*").alias("df"))
    scored = hits.join(found, [key, "term"]).join(stats, key)
    tf, dl = F.col("tf"), F.col("dl")
    score = idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (F.col("total") / F.col("n"))))
    return scored.groupBy(key, "term").agg(F.max(score).alias("s")).groupBy(key).agg(F.sum("s").alias("score"))


def best_blob(scores: DataFrame, refs: DataFrame, blob: str = "sha256", doc: str = "_id", limit: int | None = 10, offset: int = 0) -> DataFrame:
    """(doc, blob, score, rank): every referencing document by its best blob; equal scores go to the lesser blob."""
    met = refs.select(doc, blob).distinct().join(scores, blob)
    best = met.groupBy(doc).agg(F.min_by(F.struct(blob, "score"), F.struct((-F.col("score")).alias("s"), F.col(blob).alias("b"))).alias("v")).select(doc, "v.*")
    return ranked(best, doc, "score", limit, offset)


def blob_cosine(vectors: DataFrame, key: str, vec: str, query: list[float]) -> DataFrame:
    """(key, score): every blob by its chunk nearest to the query; vectors are quantised as in other searches."""
    return cosine_scores(vectors, key, vec, query)


def search_blobs(chunked: DataFrame, refs: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, blob: str = "sha256", doc: str = "_id", vec: str = "vec", candidates: int = 100, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """(doc, blob, score, rank, snippet) of the documents that refer to the best blobs; both legs are fused if both are there.

    Only blobs with a reference in ``refs`` take part, so no rank is spent on others. The snippet is a blob's first chunk.
    """
    kept = refs.select(blob).distinct()
    lexical_leg = blob_bm25(chunked, blob, query).join(kept, blob, "left_semi")
    scores = lexical_leg
    if vectors is not None and query_vector is not None:
        semantic_leg = blob_cosine(vectors, blob, vec, query_vector).join(kept, blob, "left_semi")
        scores = fused([ranked(lexical_leg, blob, limit=candidates), ranked(semantic_leg, blob, limit=candidates)], blob)
    hits = best_blob(scores, refs, blob, doc, limit, offset)
    snippets = chunked.where("chunk = 0").select(blob, F.col("chunk_text").alias("snippet"))
    return hits.join(snippets, blob, "left").select(doc, blob, "score", "rank", "snippet")

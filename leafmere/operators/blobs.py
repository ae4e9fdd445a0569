"""References from documents to content-addressed blobs: extraction, counts, collection of garbage, indexing states."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = "vault://sha256/"


def uri_pattern(scheme: str = SCHEME) -> str:
    return r"\Q" + scheme + r"\E([0-9a-f]{64})(?![0-9a-f])"


def references(doc_json: Column, scheme: str = SCHEME) -> Column:
    """Distinct blob hashes that a document in JSON form refers to, in order of appearance."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(doc_json, F.lit(uri_pattern(scheme)), F.lit(1)), F.array().cast("array<string>")))


def reference_rows(docs: DataFrame, key: str = "_id", doc_json: str = "doc", scheme: str = SCHEME) -> DataFrame:
    """(key, sha256), a row a document and blob."""
    return docs.select(key, F.explode(references(F.col(doc_json), scheme)).alias("sha256"))


def reference_paths(docs: DataFrame, key: str = "_id", doc_json: str = "doc", scheme: str = SCHEME) -> DataFrame:
    """(key, sha256, path): the first path, in path order, at which a document holds each reference, at any depth. A document that is
    no JSON has none."""
    pattern = re.compile(re.escape(scheme) + r"([0-9a-f]{64})(?![0-9a-f])")

    @F.pandas_udf("array<struct<sha256: string, path: string>>")
    def paths(bodies: pd.Series) -> pd.Series:
        out = []
        for body in bodies:
            first: dict[str, str] = {}
            try:
                todo = [("$", json.loads(body))] if body is not None else []
            except (ValueError, RecursionError):
                todo = []
            while todo:
                path, value = todo.pop()
                if isinstance(value, dict):
                    todo += [(f"{path}.{k}", v) for k, v in value.items()]
                elif isinstance(value, list):
                    todo += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
                elif isinstance(value, str):
                    for sha in pattern.findall(value):
                        first[sha] = min(first.get(sha, path), path)
            out.append([{"sha256": k, "path": v} for k, v in sorted(first.items())])
        return pd.Series(out)

    # Only documents that name the scheme leave the JVM; a key may stand in several rows.
    rows = docs.where(F.col(doc_json).contains(scheme)).select(key, F.explode(paths(F.col(doc_json))).alias("r"))
    return rows.groupBy(key, "r.sha256").agg(F.min("r.path").alias("path"))


def reference_counts(refs: DataFrame, key: str = "_id") -> DataFrame:
    """(sha256, n): documents that refer to each blob, each counted once."""
    return refs.select(key, "sha256").distinct().groupBy("sha256").agg(F.count("*").alias("n"))


def garbage(blobs: DataFrame, *refs: DataFrame) -> DataFrame:
    """Blobs to which no live document or kept version refers."""
    out = blobs
    for r in refs:
        out = out.join(r.select("sha256").distinct(), "sha256", "left_anti")
    return out


def reference_changes(before: Column, after: Column) -> Column:
    """Struct (added, removed) of two arrays of references; null counts as none."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (before, after))
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"))


def indexing_states(blobs: DataFrame, states: DataFrame, known: tuple[str, ...] = ("indexed", "failed", "unsupported", "pending")) -> DataFrame:
    """(state, n) over all blobs: their state; without one stub or pending, by whether the bytes are here.

    blobs: (sha256, present); states: (sha256, state), a row a blob. A state that is not known counts as pending.
    """
    state = F.when(F.col("state").isNotNull(), F.when(F.col("state").isin(*known), F.col("state")).otherwise("pending")).when(~F.col("present"), "stub").otherwise("pending")
    return blobs.join(states.select("sha256", "state"), "sha256", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))

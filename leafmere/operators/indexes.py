"""Search indexes kept as tables: postings of text fields, quantised vectors of embedded ones, with a state.

An index is built when it is first asked for. A text index then follows the log by overlays of what changed, which are
merged into its base from time to time; a vector index is built again when the log has moved past it or its model has
changed. States: undefined (never built), building, current, stale (behind the log or of another model), syncing. What is
written goes to new folders and becomes visible by the state file, so readers never see half of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmere.operators import search
from leafmere.sources.folder import Folder


@dataclass(frozen=True)
class State:
    status: str = "undefined"
    built_through: int = 0
    model_id: str = ""
    data: str = ""


class Index:
    """One field's index under ``root``; ``build`` makes its table from the current documents."""

    def __init__(self, spark: SparkSession, root: str, field: str, build: Callable[[DataFrame], DataFrame], model_id: str = ""):
        self.spark, self.field, self.build, self.model_id = spark, field, build, model_id
        self.folder = Folder(spark, f"{root}/{field}")

    def state(self, log_end: int | None = None) -> State:
        text = self.folder.read("state.json")
        if text is None:
            return State()
        state = State(**json.loads(text))
        behind = log_end is not None and state.built_through < log_end
        return State("stale", state.built_through, state.model_id, state.data) if behind or state.model_id != self.model_id else state

    def reindex(self, docs: DataFrame, log_end: int) -> State:
        old = self.folder.etag("state.json")
        data = f"{self.folder.path}/data-{log_end}-{(old or 'new')[:12]}"
        self.build(docs).write.mode("overwrite").parquet(data)
        state = State("current", log_end, self.model_id, data)
        if not self.folder.swap("state.json", json.dumps(asdict(state)).encode(), old):
            raise RuntimeError("the index was built by another writer meanwhile")
        return state

    def table(self, docs: DataFrame, log_end: int) -> DataFrame:
        """The index table, built first unless it is current."""
        state = self.state(log_end)
        if state.status != "current":
            state = self.reindex(docs, log_end)
        return self.spark.read.parquet(state.data)


def vector_index(spark: SparkSession, root: str, field: str, embed: Callable[[Column], Column], model_id: str, key: str = "_id") -> Index:
    """(key, units): the embedded field in one byte a dimension. ``embed`` gives array<float> of unit length."""
    build = lambda docs: docs.where(F.length(field) > 0).select(key, search.quantised(embed(F.col(field))).alias("units"))
    return Index(spark, root, field, build, model_id)



@dataclass(frozen=True)
class TextState:
    """What the state file of a text index names: segments 0 (the base) to ``segments`` - 1 under ``data``, and the statistics."""

    status: str = "undefined"
    built_through: int = 0
    rows_through: int = 0
    data: str = ""
    segments: int = 0
    n: int = 0
    total: int = 0
    overlaid: int = 0


class TextIndex:
    """Postings of a text field as a base and overlays of later changes, under ``root``.

    A segment holds the postings (term, key, tf, dl), sorted by term over ranges of term and key, so that a frequent term spreads
    over many files and a query opens those of its terms only, and what it changed (key, dl), dl null for a document that is gone.
    The newest segment that names a document counts; older postings of it are passed over. Document and term totals are kept
    with the state, so that no search counts them. Writers take a lease while they build or add a segment, and one swap of the
    state file makes it visible.
    """

    def __init__(self, spark: SparkSession, root: str, field: str, key: str = "_id", owner: str = "local", lease_seconds: float = 3600, **terms):
        self.spark, self.root, self.field, self.key, self.owner, self.lease_seconds, self.terms = spark, root, field, key, owner, lease_seconds, terms
        self.folder = Folder(spark, f"{root}/{field}")

    def _held(self) -> TextState:
        text = self.folder.read("state.json")
        return TextState() if text is None else TextState(**json.loads(text))

    def state(self, log_end: int | None = None, log_rows: int | None = None) -> TextState:
        """The state; building or syncing while a writer holds the lease, stale if the log ends later or has other rows up to the
        index's end."""
        held = self._held()
        work = self.folder.read("work.json")
        if work is not None and json.loads(work)["until"] > time.time():
            return replace(held, status="building" if held.status == "undefined" else "syncing")
        if held.status == "current" and (log_end is not None and held.built_through < log_end or log_rows is not None and log_rows != held.rows_through):
            return replace(held, status="stale")
        return held

    @contextmanager
    def _working(self):
        if not self.folder.lease("work.json", self.owner, self.lease_seconds):
            raise RuntimeError("another writer is at work on the index")
        try:
            yield self._held(), self.folder.etag("state.json")
        finally:
            self.folder.release("work.json", self.owner)

    def _swap(self, state: TextState, before: str | None) -> TextState:
        if not self.folder.swap("state.json", json.dumps(asdict(state)).encode(), before):
            raise RuntimeError("the index was changed by another writer meanwhile")
        return state

    def _write(self, data: str, seq: int, postings: DataFrame, changes: DataFrame) -> None:
        rows = postings.select(self.key, "term", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"), F.lit(seq).alias("seq"))
        rows.repartitionByRange("term", self.key).sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{data}/postings-{seq:06d}")
        changes.select(self.key, F.col("dl").cast("bigint").alias("dl"), F.lit(seq).alias("seq")).write.mode("overwrite").parquet(f"{data}/changes-{seq:06d}")

    def _changes(self, state: TextState, first: int = 0) -> DataFrame:
        return self.spark.read.parquet(*[f"{state.data}/changes-{i:06d}" for i in range(first, state.segments)])

    def _current_lengths(self, state: TextState) -> DataFrame:
        """(key, dl) of each document as its newest segment has it."""
        newest = self._changes(state).groupBy(self.key).agg(F.max(F.struct("seq", "dl")).alias("v"))
        return newest.select(self.key, F.col("v.dl").alias("dl")).where("dl is not null")

    def _lengths(self, docs: DataFrame) -> DataFrame:
        words = F.size(search.search_terms(F.col(self.field), **self.terms))
        return docs.select(self.key, F.when(F.length(self.field) > 0, F.when(words > 0, words)).cast("bigint").alias("dl"))

    def build(self, docs: DataFrame, through: int = 0, rows: int = 0) -> TextState:
        """A new base of all documents (key, field)."""
        with self._working() as (_, before):
            data = f"{self.folder.path}/data-{uuid.uuid4().hex}"
            self._write(data, 0, search.postings(docs, self.key, self.field, **self.terms), self._lengths(docs).where("dl is not null"))
            state = TextState("current", through, rows, data, 1)
            n, total = self._changes(state).agg(F.count("*"), F.sum("dl")).first()
            return self._swap(replace(state, n=n, total=total or 0), before)

    def sync(self, changed: DataFrame, through: int = 0, rows: int = 0) -> TextState:
        """Add a segment with the documents that changed: (key, field), a row a key, the field null for one that is gone."""
        with self._working() as (held, before):
            if held.status == "undefined":
                raise RuntimeError("the index was never built")
            seq = held.segments
            self._write(held.data, seq, search.postings(changed, self.key, self.field, **self.terms), self._lengths(changed))
            segment = self.spark.read.parquet(f"{held.data}/changes-{seq:06d}")
            old = self._current_lengths(held).join(segment.select(self.key), self.key, "left_semi").agg(F.count("*"), F.sum("dl")).first()
            new = segment.agg(F.count("dl"), F.sum("dl"), F.count("*")).first()
            return self._swap(replace(held, built_through=through, rows_through=rows, segments=seq + 1, n=held.n - old[0] + new[0], total=held.total - (old[1] or 0) + (new[1] or 0), overlaid=held.overlaid + new[2]), before)

    def compact(self) -> TextState:
        """One base from all segments, without the postings that later ones override."""
        with self._working() as (held, before):
            data = f"{self.folder.path}/data-{uuid.uuid4().hex}"
            self._write(data, 0, self.postings(held), self._current_lengths(held))
            return self._swap(replace(held, data=data, segments=1, overlaid=0), before)

    def postings(self, state: TextState | None = None, wanted: list[str] | None = None) -> DataFrame:
        """(key, term, tf, dl) of the documents as they are now, of all terms or of some."""
        held = state or self._held()
        rows = self.spark.read.parquet(*[f"{held.data}/postings-{i:06d}" for i in range(held.segments)])
        if wanted is not None:
            rows = rows.where(F.col("term").isin(wanted))
        if held.segments == 1:
            return rows.drop("seq")
        later = self._changes(held, 1).groupBy(self.key).agg(F.max("seq").alias("__seq"))
        kept = rows.join(later, self.key, "left").where(F.col("__seq").isNull() | (F.col("__seq") == F.col("seq")))
        return kept.select(self.key, "term", "tf", "dl")

    def refresh(self, log_end: int, log_rows: int, docs: Callable[[], DataFrame], changed: Callable[[int], DataFrame], earlier_rows: Callable[[int], int]) -> TextState:
        """The state after whatever is needed to be current: a build, a segment of what ``changed`` after the index's end or, where
        rows came late below that end (``earlier_rows`` counts them), a new build; compacted once a fifth is overlaid."""
        state = self.state(log_end, log_rows)
        if state.status == "current":
            return state
        held = self._held()
        if held.status == "undefined" or earlier_rows(held.built_through) != held.rows_through:
            return self.build(docs(), log_end, log_rows)
        state = self.sync(changed(held.built_through), log_end, log_rows)
        return self.compact() if state.overlaid * 5 > max(state.n, 1) else state

    def scores(self, query: str, candidates: DataFrame | None = None) -> DataFrame:
        """(key, score) by BM25; no text is read. candidates restrict hits and document frequencies, not the totals."""
        wanted = [r[0] for r in search.query_terms(self.spark, query, **self.terms).collect()]
        state = self._held()
        hits = self.postings(state, wanted)
        if candidates is not None:
            hits = hits.join(candidates.select(self.key).distinct(), self.key, "left_semi")
        # A row a term of the query.
        found = hits.groupBy("term").agg(F.count("*").alias("df"))
        part = search.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(max(state.n, 1)), F.lit(max(state.total, 1)))
        return hits.join(F.broadcast(found), "term").groupBy(self.key).agg(F.sum(part).alias("score")).where("score > 0")

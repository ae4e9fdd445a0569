"""Similar vectors by cross-polytope hashing with multiprobe tables and exact reranking.

A pseudo-rotation (three rounds of random signs and a Hadamard transform) sends a unit vector to the signed axis it is
nearest to; a table's bucket joins several such axes, the last one possibly over fewer dimensions. ``Plan`` sets the
number of axes by the number of vectors, so that buckets stay small, and then the tables and probes by the collision
probability at the sought cosine, measured on random pairs.

``similar_classes`` finds all pairs of a cosine or more: every vector is entered in its bucket and in the buckets one
probe away, vectors that share a bucket are compared by sketches, and what is left exactly. ``nearest`` finds the k
nearest of each query: it probes the buckets that the query is nearest to in every table, ranks what they hold by
vectors of one byte a dimension, and the best of these exactly.

Defined cases: null and zero vectors and those with a null, NaN or infinite component are in no result; rows of one
vec_id count once, and if they differ, the greatest (model, vector) counts; vectors of other models or other dimensions
are never compared; rows without a current model are left out; exact copies under several ids are one class, told by the
vectors themselves, whose members are given beside the pairs. Empty tables give empty results. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import add
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmere.operators.cutting import cut

#: Signs of random projections; rows of one bucket are alike enough that fewer would let many pairs through.
SKETCH_BITS = 256
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Standard deviations by which a sketch may differ more than expected before a pair is left out.
SKETCH_SIGMAS = 4.0
#: Different vectors of a bucket above which they are compared block by block, by matrix products, in blocks of about so many.
HOT_BUCKET = 4096
#: Rows up to which a small table of hot buckets or hashes is sent to all tasks, some 20 bytes each.
HOT_SENT = 100_000
#: Vectors of a cell of neighbouring buckets, which one task searches.
CELL_ROWS = 20_000
#: Entries of a part of the join of buckets, some 40 bytes each.
PART_ROWS = 100_000
#: Probes of a query in a table, at most, before more tables are taken.
MOST_PROBES = 1024


def padded(dim: int) -> int:
    return 1 << max(1, dim - 1).bit_length() if dim > 1 else 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, in n log n additions, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=4096)
def rotation(dim: int, seed: int) -> np.ndarray:
    """The pseudo-rotation as a matrix: up to some hundred dimensions one product is faster than the butterflies."""
    d = padded(dim)
    signs = np.random.default_rng([seed, d]).choice([-1.0, 1.0], (3, d))
    x = np.eye(d)[:dim]
    for s in signs:
        x = hadamard(x * s)
    return x.astype(np.float32)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    if x.shape[1] <= 512:
        return x @ rotation(x.shape[1], seed)
    d = padded(x.shape[1])
    y = np.zeros((len(x), d), np.float32)
    y[:, : x.shape[1]] = x
    for s in np.random.default_rng([seed, d]).choice([-1.0, 1.0], (3, d)).astype(np.float32):
        y = hadamard(y * s).astype(np.float32)
    return y


def nearest_axes(x: np.ndarray, seed: int, width: int, ranks: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(signed axes, their values) of the ``ranks`` nearest axes of each row, among the first ``width`` dimensions."""
    y = rotate(x, seed)[:, :width]
    size = np.abs(y)
    each, axes, values = np.arange(len(x)), [], []
    for _ in range(min(ranks, width)):
        at = size.argmax(1)
        values.append(size[each, at].copy())
        axes.append(2 * at + (y[each, at] < 0))
        size[each, at] = -1
    return np.stack(axes, 1), np.stack(values, 1)


@dataclass(frozen=True)
class Plan:
    """Dimensions of the axes of a bucket, the number of tables and of buckets that a vector is entered in per table."""

    widths: tuple[int, ...]
    tables: int
    probes: int

    @staticmethod
    def of(vectors: int, dim: int, cosine: float, recall: float = 0.99, probes: int = 2, bucket: int = 8) -> Plan:
        widths = axis_widths(max(1.0, np.log2(max(vectors, 2) / bucket)), padded(dim))
        a, b = random_pairs(np.random.default_rng(7), 3000, dim, cosine)
        met = Plan(widths, 4, probes).meets(a, b)
        tables = int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(met, 1e-4), 0.999))))
        return Plan(widths, max(3, tables), probes)

    def meets(self, a: np.ndarray, b: np.ndarray) -> float:
        """Share of rows of a and b that share a bucket of one table, one of them in its own bucket."""
        ka, kb = self.keys(a), self.keys(b)
        return float(((ka[:, :, :1] == kb).any(2) | (kb[:, :, :1] == ka).any(2)).mean())

    def keys(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Buckets (rows, tables, probes) of unit vectors, the own bucket first."""
        n, k, probes = len(x), len(self.widths), probes or self.probes
        out = np.empty((n, self.tables, probes), np.int64)
        for t in range(self.tables):
            parts = [nearest_axes(x, t * 64 + j, w) for j, w in enumerate(self.widths)]
            weight = np.ones(k, np.int64)
            for j in range(k - 2, -1, -1):
                weight[j] = weight[j + 1] * 2 * self.widths[j + 1]
            own = sum(p[0][:, 0] * w for p, w in zip(parts, weight))
            out[:, t, 0] = own
            if probes > 1:
                # The nearest other buckets differ in one axis, where the next axis costs least.
                cost = np.concatenate([p[1][:, :1] - p[1][:, 1:] for p in parts], 1)
                change = np.concatenate([(p[0][:, 1:] - p[0][:, :1]) * w for p, w in zip(parts, weight)], 1)
                best = np.argsort(cost, 1)[:, : probes - 1]
                out[:, t, 1 : 1 + best.shape[1]] = own[:, None] + np.take_along_axis(change, best, 1)
                out[:, t, 1 + best.shape[1] :] = own[:, None]
        return out


    @property
    def buckets(self) -> int:
        """Buckets of a table."""
        return int(np.prod([2 * w for w in self.widths]))

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """The ``probes`` buckets (rows, probes) of a table whose axes lie nearest to each unit vector, nearest first."""
        n, keys, sums = len(x), None, None
        for j, w in enumerate(self.widths):
            y = rotate(x, table * 64 + j)[:, :w]
            axes = np.empty((n, 2 * w), np.float32)
            axes[:, 0::2], axes[:, 1::2] = y, -y
            # Only axes on the vector's own side are worth a probe.
            few = min(w + 1, 2 * w)
            at = np.argpartition(-axes, few - 1, 1)[:, :few]
            near = np.take_along_axis(axes, at, 1)
            if keys is None:
                keys, sums = at.astype(np.int64), near
            else:
                keys = (keys[:, :, None] * (2 * w) + at[:, None, :]).reshape(n, -1)
                sums = (sums[:, :, None] + near[:, None, :]).reshape(n, -1)
            if keys.shape[1] > self.probes:
                best = np.argpartition(-sums, self.probes - 1, 1)[:, : self.probes]
                keys, sums = np.take_along_axis(keys, best, 1), np.take_along_axis(sums, best, 1)
        order = np.argsort(-sums, 1, kind="stable")
        return np.take_along_axis(keys, order, 1)

    @staticmethod
    def for_nearest(vectors: int, dim: int, k: int, recall: float = 0.9, bucket: int = 4) -> Plan:
        """Tables and probes that find the k-th nearest of so many vectors with this probability if they lie at random, the
        hardest case: its cosine is then the k / vectors quantile of random ones. Closer neighbours are found more surely."""
        share = min(0.5, max(k, 1) / max(vectors, 2))
        cosine = min(0.9, NormalDist().inv_cdf(1 - share) / np.sqrt(dim))
        rng = np.random.default_rng(9)
        a, b = random_pairs(rng, 1000, dim, cosine)
        widths = axis_widths(max(1.0, np.log2(max(vectors, 2) / bucket)), padded(dim))
        most = Plan(widths, 2, min(MOST_PROBES, int(np.prod([2 * w for w in widths]))))
        own = most.keys(b, 1)[:, :, 0]
        # The place of the neighbour's bucket in the query's order of probes, over two tables.
        places = np.concatenate([np.where((hit := most.probed(a, t) == own[:, t, None]).any(1), hit.argmax(1), most.probes) for t in range(2)])
        for tables in (4, 6, 8, 12, 16, 24, 32):
            needed = 1 - (1 - recall) ** (1 / tables)
            if (places < most.probes).mean() >= needed:
                return Plan(widths, tables, int(np.sort(places)[min(len(places) - 1, int(np.ceil(needed * len(places))))]) + 1)
        return Plan(widths, 32, most.probes)


def random_pairs(rng: np.random.Generator, n: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at a cosine."""
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    norm = np.linalg.norm(b, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.where(norm > 0, norm, 1)
    return a.astype(np.float32), b.astype(np.float32)


def axis_widths(bits: float, d: int) -> tuple[int, ...]:
    """Dimensions of the axes of a bucket number of about so many bits."""
    widths: list[int] = []
    while bits > 0.5 or not widths:
        w = int(min(d, max(2, 2 ** round(bits - 1))))
        widths.append(w)
        bits -= np.log2(2 * w)
    return tuple(widths)


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCH_BITS signs of random projections of each row, as 64-bit numbers."""
    planes = np.random.default_rng(11).standard_normal((x.shape[1], SKETCH_BITS)).astype(np.float32)
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_unlike(cosine: float) -> int:
    """Sketch bits in which a pair at ``cosine`` differs at most."""
    p = np.arccos(cosine) / np.pi
    return int(SKETCH_BITS * p + SKETCH_SIGMAS * np.sqrt(SKETCH_BITS * p * (1 - p)))


def usable_vectors(entries: DataFrame, states: DataFrame) -> DataFrame:
    """(vec_id, model, vec) of the rows with a usable vector of a current model; repeated rows stay."""
    current = F.lower(F.trim("index_status")) == "current"
    model = F.lower(F.trim("model_id"))
    models = states.where(current & (model != "")).groupBy("ns", "field_name").agg(F.min(model).alias("model"))
    # NaN is the greatest of a list and nulls are passed over, so the two ends tell of all components.
    most, least = F.array_max("vec").cast("double"), F.array_min("vec").cast("double")
    good = (F.size(F.array_compact("vec")) == F.size("vec")) & ~F.isnan(most) & (most < float("inf")) & (least > float("-inf")) & ((most != 0) | (least != 0))
    rows = entries.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good).select("vec_id", "ns", "field_name", "vec")
    return rows.join(models, ["ns", "field_name"]).select("vec_id", "model", F.col("vec").cast("array<float>").alias("vec"))


def matrices(batch: pa.RecordBatch | pa.Table, name: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of a batch for each dimension in it."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = values[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
        # Divided by the greatest component first, since squares of tiny ones vanish.
        x /= np.abs(x).max(1)[:, None]
        yield rows, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def hashed(classes: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(id, model, dim, s0.., buckets) of every row of (id, model, vec): a sketch and the buckets of all tables, the own
    one of each table first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, x in matrices(batch) if batch.num_rows else ():
                n, dim = x.shape
                plan = plans[dim]
                keys, bits = plan.keys(x), sketch(x)
                some = batch.take(pa.array(which))
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (a.size // n)), pa.array(np.ascontiguousarray(a).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("model"), pa.array(np.full(n, dim, np.int32)), *[pa.array(b.copy()) for b in bits.T], lists(keys)],
                    names=["id", "model", "dim", *SKETCH, "buckets"])

    sketches = ", ".join(f"{c} bigint" for c in SKETCH)
    return classes.mapInArrow(rows, f"id bigint, model string, dim int, {sketches}, buckets array<bigint>")


def one_vector_an_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, model, vec) with a row a vec_id; the shuffle by vec_id is the one that later joins on it use again."""
    best = vectors.groupBy("vec_id").agg(F.max(F.struct("model", "vec")).alias("v"))
    return best.select("vec_id", "v.model", "v.vec")


def sizes(vectors: DataFrame) -> list[tuple[str, int, int]]:
    """(model, dimension, rows); a row a model and dimension comes to the driver."""
    return [tuple(r) for r in vectors.groupBy("model", F.size("vec").alias("dim")).count().collect()]


def plans_for(sized: list[tuple[str, int, int]], cosine: float, recall: float = 0.99, probes: int = 2) -> dict[int, Plan]:
    """A plan by dimension, for the model that has most vectors of it; sized: as from sizes."""
    most: dict[int, int] = {}
    for _, dim, n in sized:
        most[dim] = max(n, most.get(dim, 0))
    return {dim: Plan.of(n, dim, cosine, recall, probes) for dim, n in most.items()}


def entered_rows(rows: DataFrame, probes: int) -> DataFrame:
    """(key, id, sketch, own): a row for each bucket that a vector is entered in; own marks its own bucket."""
    # A bucket's place in the list gives its table and whether it is the own one.
    out = rows.select("model", "dim", "id", *SKETCH, F.posexplode("buckets").alias("at", "bucket"))
    table = F.floor(F.col("at") / probes).cast("int")
    return out.select(F.xxhash64("model", "dim", table, "bucket").alias("key"), "id", *SKETCH, (F.col("at") % probes == 0).alias("own"))


def sent(rows: DataFrame) -> DataFrame | None:
    """The rows, sent to all tasks while they are few; None if there are none."""
    some = rows.limit(HOT_SENT + 1).collect()
    if not some:
        return None
    return rows if len(some) > HOT_SENT else F.broadcast(rows.sparkSession.createDataFrame(some, rows.schema))


def hot_buckets(rows: DataFrame, probes: int) -> DataFrame | None:
    """(hot, blocks) of the buckets that more than HOT_BUCKET different ids are entered in, None if there are none; no
    blocks for a bucket that is nobody's own one."""
    entered = entered_rows(rows, probes).select("key", "id", "own")
    many = sent(entered.groupBy("key").count().where(F.col("count") > HOT_BUCKET).select(F.col("key").alias("hot")))
    if many is None:
        return None
    # Copies of a vector are one class in the join, so the ids of the few buckets with many rows are told apart.
    ids = entered.join(many, F.col("key") == F.col("hot"), "left_semi").groupBy("key", "id").agg(F.max("own").alias("own"))
    counts = ids.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where(F.col("n") > HOT_BUCKET)
    return sent(counts.select(F.col("key").alias("hot"), F.when(F.col("own"), F.ceil(F.col("n") / HOT_BUCKET)).otherwise(0).cast("int").alias("blocks")))


def candidate_pairs(rows: DataFrame, probes: int, cosine: float, parts: int, hot: DataFrame | None = None) -> DataFrame:
    """(a, b) of the ids that share a bucket which is not hot, one of them as its own, and whose sketches allow the cosine;
    a < b. Buckets are dealt to so many parts."""
    entered = entered_rows(rows, probes)
    own, unlike = F.col("a.own") | F.col("b.own"), reduce(add, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCH])
    if hot is not None:
        entered = entered.join(hot, F.col("key") == F.col("hot"), "left_anti")
    entered = entered.repartition(parts, "key")
    met = entered.alias("a").join(entered.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & own & (unlike <= most_unlike(cosine)))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def hot_pairs(rows: DataFrame, classes: DataFrame, probes: int, cosine: float, hot: DataFrame) -> DataFrame:
    """(a, b) of the ids that share a hot bucket and have the cosine; a < b.

    The ids of a hot bucket are cut into blocks of about HOT_BUCKET, and every two blocks, and each with itself, are
    multiplied in a task of their own, so all pairs of the bucket meet, whatever share of the rows it holds.
    """
    crowd = entered_rows(rows, probes).join(hot.where("blocks > 0"), F.col("key") == F.col("hot")).select("key", "id", "blocks")
    crowd = crowd.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(classes.select("id", "vec"), "id")
    # The lesser block is at the left, so a row stands there with each block from its own on, at the right with those up to it.
    left = crowd.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select("key", F.col("block").alias("low"), F.col("other").alias("high"), "id", "vec")
    right = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).select("key", F.col("other").alias("low"), F.col("block").alias("high"), "id", "vec").toDF("key_b", "low_b", "high_b", "id_b", "vec_b")

    def products(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            (_, x), (_, y) = next(matrices(a)), next(matrices(b, "vec_b"))
            ia, ib = a.column("id").to_numpy(), b.column("id_b").to_numpy()
            for at in range(0, len(x), 1024):
                # In single precision here, with room for rounding; the pairs are checked in double precision afterwards.
                r, c = np.nonzero(x[at : at + 1024] @ y.T >= cosine - 1e-4)
                out.append((ia[at + r], ib[c]))
        p, q = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        low, high = np.minimum(p, q), np.maximum(p, q)
        return pa.table({"a": low[low < high], "b": high[low < high]})

    return left.groupBy("key", "low", "high").cogroup(right.groupBy("key_b", "low_b", "high_b")).applyInArrow(products, "a bigint, b bigint").distinct()


def similar_classes(vectors: DataFrame, cosine: float, recall: float = 0.99, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), members (id, vec_id)): pairs of representatives with at least this cosine, a < b, and the further ids
    of each representative's vector.

    vectors: as from usable_vectors. A class is the rows of one model with the same vector, its representative the least
    vec_id; a vector without copies represents itself and is no member. Every pair at the cosine itself is found with
    probability ``recall`` or more and then exactly checked; copies are found without fail.
    """
    sized = sizes(vectors)
    plans = plans_for(sized, cosine, recall, probes)
    parts = max(1, sum(n * plans[dim].tables * probes for _, dim, n in sized) // PART_ROWS)
    kept = one_vector_an_id(vectors)
    # Rows whose hash nobody shares have no copies; only the others are grouped by the vectors themselves.
    hashes = vectors.select("vec_id", F.xxhash64("model", "vec").alias("h"))
    shared = sent(hashes.groupBy("h").agg((F.min("vec_id") != F.max("vec_id")).alias("many")).where("many").select("h"))
    members = vectors.select("vec_id", F.col("vec_id").alias("id")).limit(0)
    classes = kept.select(F.col("vec_id").alias("id"), "model", "vec")
    if shared is not None:
        copied = kept.withColumn("h", F.xxhash64("model", "vec")).join(shared, "h", "left_semi")
        firsts = copied.groupBy("h", "model", "vec").agg(F.min("vec_id").alias("id"))
        members = copied.join(firsts, ["h", "model", "vec"]).where("vec_id <> id").select("id", "vec_id")
        members = cut(members)
        classes = classes.join(members.select(F.col("vec_id").alias("id")), "id", "left_anti")
    # Hashing twice is cheaper than keeping the hashes: counting moves no vectors, and the rest shares one shuffle of them.
    hot = hot_buckets(hashed(vectors.select(F.xxhash64("model", "vec").alias("id"), "model", "vec"), plans), probes)
    found = hashed(classes, plans)
    pairs = candidate_pairs(found, probes, cosine, parts, hot)
    if hot is not None:
        pairs = pairs.unionAll(hot_pairs(found, kept.withColumnRenamed("vec_id", "id"), probes, cosine, hot)).distinct()
    return checked(pairs, kept.withColumnRenamed("vec_id", "id"), cosine), members


def similar_pairs(vectors: DataFrame, cosine: float, recall: float = 0.99, probes: int = 2) -> DataFrame:
    """(vec_id_a, vec_id_b), vec_id_a < vec_id_b: the pairs of similar_classes, expanded to all ids, those of copies too."""
    pairs, members = similar_classes(vectors, cosine, recall, probes)
    all_ids = members.unionAll(members.select("id", F.col("id").alias("vec_id")).distinct())
    a, b = all_ids.toDF("a", "vec_a"), all_ids.toDF("b", "vec_b")
    found = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("vec_a", "a").alias("a"), F.coalesce("vec_b", "b").alias("b"))
    within = all_ids.join(all_ids.toDF("id", "other"), "id").where("vec_id < other").select("vec_id", "other")
    return found.unionAll(within).select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b"))


def exact_cosine(va: Column, vb: Column) -> Column:
    """Cosine of two arrays in double precision."""
    va, vb = va.cast("array<double>"), vb.cast("array<double>")
    dot = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    return dot / (norm(va) * norm(vb))


def checked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of one model whose vectors have at least the cosine."""
    pair = lambda end: F.struct(F.col(end).alias("id"), "a", "b")
    ends = pairs.select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.*")
    each = ends.join(classes, "id").groupBy("a", "b").agg(F.min("model").alias("m"), F.max("model").alias("n"), F.max(F.when(F.col("id") == F.col("a"), F.col("vec"))).alias("va"), F.max(F.when(F.col("id") == F.col("b"), F.col("vec"))).alias("vb"))
    return each.where((F.col("m") == F.col("n")) & (exact_cosine(F.col("va"), F.col("vb")) >= cosine)).select("a", "b")


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one byte a dimension, scale) of unit vectors."""
    scale = np.abs(x).max(1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def binaries(codes: np.ndarray) -> pa.Array:
    n, d = codes.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * d), pa.py_buffer(np.ascontiguousarray(codes))])


CELL = ["model", "dim", "table", "cell"]
ENTRY = "model string, dim int, table int, cell bigint, id bigint, bucket bigint, scale float, code binary"
PROBE = "model string, dim int, table int, cell bigint, id bigint, buckets array<bigint>, scale float, code binary"


def entries(rows: DataFrame, plans: dict[tuple[str, int], tuple[Plan, int]], probing: bool) -> DataFrame:
    """A row for each vector and table with its own bucket, or, ``probing``, a row for each vector, table and cell with the
    buckets that it probes there. rows: (id, model, vec); plans: plan and number of cells by model and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), object)
            ids = batch.column("id").to_numpy()
            for which, x in matrices(batch) if batch.num_rows else ():
                for model in np.unique(models[which].astype(str)):
                    plan, cells = plans[model, x.shape[1]]
                    some = np.flatnonzero(models[which] == model)
                    for at in range(0, len(some), 1024):
                        part = some[at : at + 1024]
                        own = None if probing else plan.keys(x[part], 1)[:, :, 0]
                        codes, scale = coded(x[part])
                        for t in range(plan.tables):
                            if probing:
                                buckets = np.sort(plan.probed(x[part], t), 1)
                                cell = buckets * cells // plan.buckets
                                first = np.ones(cell.shape, bool)
                                first[:, 1:] = cell[:, 1:] != cell[:, :-1]
                                starts = np.flatnonzero(first.ravel())
                                at_row, at_cell = starts // cell.shape[1], cell.ravel()[starts]
                                column = pa.ListArray.from_arrays(pa.array(np.append(starts, cell.size).astype(np.int32)), pa.array(buckets.ravel()))
                            else:
                                at_row, at_cell = np.arange(len(part)), own[:, t] * cells // plan.buckets
                                column = pa.array(own[:, t])
                            n = len(at_row)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([model] * n, pa.string()), pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(at_cell), pa.array(ids[which[part]][at_row]), column, pa.array(scale[at_row]), binaries(codes[at_row])],
                                names=["model", "dim", "table", "cell", "id", "buckets" if probing else "bucket", "scale", "code"])

    return rows.mapInArrow(run, PROBE if probing else ENTRY)


def searched(k: int, counting: bool):
    """A function of a cell's entries and probes: (q, id, near) of the ``k`` nearest entries by their codes in each query's
    probed buckets or, counting, (q, null, number of entries in them)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            bytes_of = lambda t: np.frombuffer(t.column("code").combine_chunks().buffers()[2], np.int8).reshape(len(t), -1)
            left = left.sort_by("bucket").combine_chunks()
            right = right.combine_chunks()
            held, ids, x, xs = left.column("bucket").to_numpy(), left.column("id").to_numpy(), bytes_of(left), left.column("scale").to_numpy()
            asked, q, qs = right.column("id").to_numpy(), bytes_of(right), right.column("scale").to_numpy()
            lists = right.column("buckets").combine_chunks()
            buckets, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(right)), np.diff(lists.offsets.to_numpy()))
            low, high = np.searchsorted(held, buckets), np.searchsorted(held, buckets, "right")
            some = high > low
            low, size, of = low[some], (high - low)[some], of[some]
            ends = np.cumsum(size)
            met = np.bincount(of, size, len(right)).astype(np.int64)
            if counting:
                return pa.table({"q": pa.array(asked), "id": pa.nulls(len(right), pa.int64()), "near": pa.array(met.astype(np.float32))})
            x = x.astype(np.float32) * xs[:, None]
            ends = np.searchsorted(of, np.arange(len(right) + 1))
            for i in np.flatnonzero(met):
                start, count = low[ends[i] : ends[i + 1]], size[ends[i] : ends[i + 1]]
                rows = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(met[i])
                near = x[rows] @ q[i].astype(np.float32)
                near[ids[rows] == asked[i]] = -np.inf
                best = np.argpartition(-near, k - 1)[:k] if len(near) > k else np.arange(len(near))
                best = best[near[best] > -np.inf]
                out.append((np.full(len(best), asked[i]), ids[rows[best]], near[best] * qs[i]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": columns[0], "id": columns[1], "near": columns[2].astype(np.float32)})

    return search


def probed_cells(vectors: DataFrame, kept: DataFrame, asked: DataFrame, k: int, recall: float, counting: bool = False) -> tuple[DataFrame, int]:
    """((q, id, near), tables): what ``searched`` gives for all cells, and the most tables of a plan.

    kept: ``vectors``, once an id. Sizes are those of ``vectors``, so that counting moves none of them; repeated rows only make
    for more blocks.
    """
    plans = {(m, d): (Plan.for_nearest(n, d, k, recall), max(1, n // CELL_ROWS)) for m, d, n in sizes(vectors)}
    if not plans:
        return kept.select(F.col("vec_id").alias("q"), F.col("vec_id").alias("id"), F.lit(0.0).cast("float").alias("near")).limit(0), 1
    rows = entries(kept.select(F.col("vec_id").alias("id"), "model", "vec"), plans, False)
    probes = entries(asked.select(F.col("vec_id").alias("id"), "model", "vec"), plans, True)
    # Cells with far more rows than planned, because their buckets are crowded, are cut into blocks that each probe visits.
    raw = entries(vectors.select(F.col("vec_id").alias("id"), "model", "vec"), plans, False)
    crowded = sent(raw.groupBy(*CELL).count().where(F.col("count") > 2 * CELL_ROWS).select(*CELL, F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("blocks")))
    rows, probes = rows.withColumn("block", F.lit(0)), probes.withColumn("block", F.lit(0))
    if crowded is not None:
        blocks = F.coalesce("blocks", F.lit(1))
        rows = rows.join(crowded, CELL, "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).drop("blocks")
        probes = probes.join(crowded, CELL, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    cell = [*CELL, "block"]
    found = rows.groupBy(*cell).cogroup(probes.groupBy(*cell)).applyInArrow(searched(3 * k, counting), "q bigint, id bigint, near float")
    return found, max(p.tables for p, _ in plans.values())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.9) -> DataFrame:
    """(vec_id, rank, neighbour, cosine): the k nearest other vectors of each query vector, among all of its model.

    queries: a stated set of rows of ``vectors``' columns, which may be all of them. Only vectors of probed buckets are
    compared; their codes rank them, and the best 3 k of each query are ranked again by exact cosines. ``recall`` is that of the
    k-th neighbour among vectors without any structure, see Plan.for_nearest. Equal cosines are ordered by vec_id.
    """
    kept, asked = one_vector_an_id(vectors), one_vector_an_id(queries)
    found, tables = probed_cells(vectors, kept, asked, k, recall)
    # A row may come from every table, so that many more are kept until repeated ones are dropped.
    by_code = Window.partitionBy("q").orderBy(F.col("near").desc(), "id")
    few = found.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= 3 * k * tables).select("q", "id").distinct()
    near = few.join(kept.select(F.col("vec_id").alias("id"), "vec"), "id")
    pairs = near.join(asked.select(F.col("vec_id").alias("q"), F.col("vec").alias("q_vec")), "q").select("q", "id", exact_cosine(F.col("vec"), F.col("q_vec")).alias("cosine"))
    order = Window.partitionBy("q").orderBy(F.col("cosine").desc(), F.col("id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbour"), "cosine")


def compared(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.9) -> DataFrame:
    """(vec_id, compared): how many entries nearest() compares with each query, one that is met in two tables counted twice."""
    found, _ = probed_cells(vectors, one_vector_an_id(vectors), one_vector_an_id(queries), k, recall, True)
    return found.groupBy(F.col("q").alias("vec_id")).agg(F.sum("near").cast("bigint").alias("compared"))

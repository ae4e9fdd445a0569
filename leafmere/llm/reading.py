"""Reading levels: interpolated n-gram models, surprisal over whole texts, isotonic regression onto graded levels.

For each level of a graded sample a model mixes word pairs, words and character trigrams, so that any word has a
probability; the shares of the three are fitted on the half of the passages that the counts leave out. A text's surprisal
distribution under each model, its mean, deviation and quantiles over all words, and the shares of words each model expects most go into one linear index, fitted by
ridge regression on passages that the models have not seen (held out by folds). The index of held-out passages is
mapped onto the graded levels by isotonic regression, so a harder text never gets a lower level.

A level is given to English running text only, which is told by general properties and not by the sample's words: most of
what is not white space are letters, and a fifth of the words or more are function words of English. A text on one line
with fewer than ``one_liner`` words, or on several lines with fewer than ``few_words``, is a one-liner.

Defined cases: a null, empty or blank text has no level and 0 words, as have one-liners, logs, tables, dumps and other
languages; ``lang`` is not read. Texts are read whole. Repeated rows are treated alike; other columns stay as they are.
The sample is bounded by ``most_samples`` rows, the first by sample id; levels or passages that are null are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmere.llm.bpe import ragged_places, slices

# Common function words of English.
FUNCTION_WORDS = """a an the and or but nor if then than that this these those it its he she they we you i me him her us them my your
his our their who whom whose which what when where why how is are was were be been being am do does did done have has had having will would
shall should can could may might must not no to of in on at by for with from into onto upon over under about between among through during
before after since until while because so as up down out off again also only just too very more most some any each every all both such
other another there here""".split()
FOLDS = 5
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Weight of the ridge regression.
RIDGE = 1.0
#: Surprisals are counted in bins of this many nats, so quantiles cover a text in one pass.
BIN, BINS = 0.25, 160
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("surprisal", T.DoubleType()), T.StructField("surprisal_sd", T.DoubleType()), *[T.StructField(f"surprisal_p{int(q * 100)}", T.DoubleType()) for q in QUANTILES],
                       T.StructField("unknown_share", T.DoubleType()), T.StructField("letter_share", T.DoubleType()), T.StructField("function_share", T.DoubleType()), T.StructField("difficulty", T.DoubleType()), T.StructField("level", T.IntegerType())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, number of words of each, share of letters among its bytes that are not white space).

    A word is a run of letters in lower case; all bytes of signs beyond ASCII count as letters.
    """
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64, n + 1, lowered.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(lowered.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    ends = offsets - low
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | first[1:]
    lengths = np.flatnonzero(stop) + 1 - starts
    content = data[letter]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(content.tobytes()))
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])[ends]
    letters, inked = np.diff(sums(letter)), np.diff(sums(data > 32))
    return words, np.diff(np.searchsorted(starts, ends)), letters / np.maximum(inked, 1)


@dataclass
class Models:
    """The models of all levels over one vocabulary; ids are places in ``vocabulary``, the last id an unknown word."""

    levels: list[int]
    vocabulary: pa.Array
    word_logs: np.ndarray
    pair_keys: np.ndarray
    pair_shares: np.ndarray
    trigram_logs: np.ndarray
    shares: np.ndarray

    @staticmethod
    def fit(passages: list[str], graded: list[int]) -> Models:
        """Models of all passages, mixed as fits every second passage best under the counts of the others."""
        models = Models.counted(passages, graded)
        seen, held = passages[::2], passages[1::2]
        if set(graded[::2]) == set(graded[1::2]) == set(graded):
            models.shares = Models.counted(seen, graded[::2]).fitted_shares(held, graded[1::2])
        return models

    @staticmethod
    def counted(passages: list[str], graded: list[int]) -> Models:
        levels = sorted(set(graded))
        words, counts, _ = words_of(pa.array(passages, pa.string()))
        vocabulary = words.unique()
        size = len(vocabulary)
        ids = pc.index_in(words, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        level = np.repeat(np.array([levels.index(g) for g in graded]), counts)
        inner = np.ones(len(ids), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        of_words = np.zeros((len(levels), size + 1))
        np.add.at(of_words, (level, ids), 1)
        # Words share the rest of the mass with the unknown word by how many kinds there are (Witten and Bell).
        kinds = (of_words[:, :size] > 0).sum(1, keepdims=True)
        total = of_words.sum(1, keepdims=True)
        shares = (of_words + kinds / (size + 1)) / (total + kinds)
        keys = ids[:-1] * (size + 1) + ids[1:]
        keys, at = keys[inner[1:]], level[1:][inner[1:]]
        pair_keys, place = np.unique(keys, return_inverse=True)
        of_pairs = np.zeros((len(levels), len(pair_keys)))
        np.add.at(of_pairs, (at, place), 1)
        before = of_words[:, pair_keys // (size + 1)]
        pair_shares = of_pairs / np.maximum(before, 1)
        spelling = np.stack([trigrams(words.filter(pa.array(level == k))) for k in range(len(levels))])
        return Models(levels, vocabulary, shares, pair_keys, pair_shares, spelling, np.full(3, 1 / 3))

    def fitted_shares(self, passages: list[str], graded: list[int], rounds: int = 20) -> np.ndarray:
        """Shares of the word pair, word and character models under which the known words of passages are likeliest (EM)."""
        words, counts, _ = words_of(pa.array(passages, pa.string()))
        level = np.repeat([self.levels.index(g) for g in graded], counts)
        parts, unknown, _ = self.parts(words, counts)
        p = np.concatenate([q[:, (level == k) & ~unknown] for k, q in enumerate(parts)], 1)
        shares = np.full(3, 1 / 3)
        for _ in range(rounds):
            whole = shares[:, None] * p
            shares = (whole / np.maximum(whole.sum(0), 1e-30)).mean(1) if p.shape[1] else shares
        return shares

    def parts(self, words: pa.Array, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        """(of each level the probabilities of every word by pairs, by words and by characters; whether the word is unknown; of each
        level the probability of every word if it is unknown)."""
        size = len(self.vocabulary)
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, self.vocabulary)
        kind_ids = pc.fill_null(known, size).to_numpy(zero_copy_only=False).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids = kind_ids[code]
        keys = np.empty(len(ids), np.int64)
        keys[1:] = ids[:-1] * (size + 1) + ids[1:]
        if len(ids):
            keys[(np.cumsum(counts) - counts)[counts > 0]] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(len(self.pair_keys) - 1, 0))
        hit = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        parts, rare, unknown = [], [], self.word_logs[:, size].mean()
        for k in range(len(self.levels)):
            spelled = np.exp(word_spelling(coded.dictionary, self.trigram_logs[k]))
            pairs = np.where(hit, self.pair_shares[k][at], 0) if len(self.pair_keys) else np.zeros(len(keys))
            parts.append(np.stack([pairs, self.word_logs[k][ids], spelled[code]]))
            # An unknown word tells by its spelling only, whatever the number of words that a level has shown.
            rare.append((unknown * spelled)[code])
        return parts, ids == size, rare

    def surprisals(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surprisal in nats of every word under every level's model, whether the word is unknown)."""
        parts, unknown, rare = self.parts(words, counts)
        out = [-np.log(np.maximum(np.where(unknown, r, self.shares @ p), 1e-30)) for p, r in zip(parts, rare)]
        return np.stack(out), unknown


def trigrams(words: pa.Array) -> np.ndarray:
    """Natural logs of interpolated character trigrams over 28 signs (end, a to z, any other), for kinds of words."""
    counts = np.full((28, 28, 28), 0.0)
    coded, places = characters(words.unique())
    for a, b, c in windows(coded, places):
        np.add.at(counts, (a, b, c), 1)
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + 28)
    two = counts.sum(0)
    two = 0.9 * two / np.maximum(two.sum(1, keepdims=True), 1) + 0.1 * one
    three = 0.9 * counts / np.maximum(counts.sum(2, keepdims=True), 1) + 0.1 * two[None]
    return np.log(three)


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signs of all words with an end sign after each, where each word ends)."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 1) - 1
    out = np.zeros(int(lengths.sum()) + len(words), np.int64)
    body = np.ones(len(out), bool)
    body[ends] = False
    raw = data[ragged_places(offsets[:-1], lengths)]
    out[body] = np.where(raw < 128, raw.astype(np.int64) - 96, 27)
    return out, ends


def windows(signs: np.ndarray, ends: np.ndarray):
    """Every sign with the two before it in its word, the end sign standing before a word."""
    a, b = np.zeros_like(signs), np.zeros_like(signs)
    b[1:] = signs[:-1]
    a[2:] = signs[:-2]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    a[starts] = 0
    later = starts[1:] + 1
    a[later[later < len(a)]] = 0
    yield a, b, signs


def word_spelling(words: pa.Array, logs: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(0)
    signs, ends = characters(words)
    total = np.zeros(len(words))
    for a, b, c in windows(signs, ends):
        running = np.concatenate([[0], np.cumsum(logs[a, b, c])])
        total = running[ends + 1] - running[np.concatenate([[0], ends[:-1] + 1])]
    return total


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, y) of the non-decreasing function of least squares, by pooling adjacent violators."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([a, a, b, 1.0])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([v for p in pools for v in (p[0], p[1])])
    return xs, np.repeat([p[2] / p[3] for p in pools], 2)


@dataclass
class Grader:
    """Models of the whole sample, the index over surprisal distributions, its mapping onto levels and the bounds of English
    running text."""

    models: Models
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    one_liner: int
    few_words: int
    least_letters: float = 0.6
    least_function: float = 0.2

    @staticmethod
    def fit(passages: list[str], graded: list[int], one_liner: int = 40, few_words: int = 12) -> Grader:
        if not passages:
            raise ValueError("the graded sample is empty")
        fold = np.random.default_rng(3).permutation(len(passages)) % max(2, min(FOLDS, len(passages)))
        models = Models.fit(passages, graded)
        x = features(measured(pa.array(passages, pa.string()), models))
        for f in range(int(fold.max()) + 1):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test) and {graded[i] for i in train} == set(graded):
                m = Models.fit([passages[i] for i in train], [graded[i] for i in train])
                x[test] = features(measured(pa.array([passages[i] for i in test], pa.string()), m))
        levels = np.array(graded, float)
        index = np.empty(len(passages))
        for f in range(int(fold.max()) + 1):
            # The index that is mapped comes from weights that have not seen the passage, too.
            index[fold == f] = indexed(x[fold == f], ridge(x[fold != f], levels[fold != f]) if (fold != f).any() else ridge(x, levels))
        return Grader(models, ridge(x, levels), isotonic(index, levels), one_liner, few_words)

    def index(self, m: dict[str, np.ndarray]) -> np.ndarray:
        return indexed(features(m), self.weights)

    def level(self, index: np.ndarray) -> np.ndarray:
        return np.floor(np.interp(index, *self.steps) + 0.5).astype(np.int32)

    def running(self, m: dict[str, np.ndarray]) -> np.ndarray:
        enough = np.where(m["lines"] > 1, self.few_words, self.one_liner)
        return (m["n_words"] >= enough) & (m["function_share"] >= self.least_function) & (m["letter_share"] >= self.least_letters)


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row a text: mean, deviation and quantiles of its surprisals under each level's model, and the share of its words that
    each model expects most."""
    # Only what sets the models apart counts, since words that surprise all of them alike tell of a topic, not of a level.
    apart = [v - v.mean(1, keepdims=True) for v in (m["means"], m["deviations"], *m["quantiles"].transpose(2, 0, 1))]
    return np.concatenate([*apart, m["least"]], 1)


def ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (middle, spread, weight) of the columns of x and, last, (0, 1, constant)."""
    middle, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1)
    z = (x - middle) / spread
    w = np.linalg.solve(z.T @ z + RIDGE * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return np.append(np.stack([middle, spread, w], 1), [[0, 1, y.mean()]], 0)


def indexed(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x - weights[:-1, 0]) / weights[:-1, 1] @ weights[:-1, 2] + weights[-1, 2]


def measured(texts: pa.Array, models: Models) -> dict[str, np.ndarray]:
    """Surprisal statistics of each text, over all its words."""
    parts = [measured_slice(part, models) for part in slices(texts)] or [measured_slice(texts, models)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def measured_slice(texts: pa.Array, models: Models) -> dict[str, np.ndarray]:
    words, counts, letters = words_of(texts)
    by_level, unknown = models.surprisals(words, counts)
    ends, n = np.concatenate([[0], np.cumsum(counts)]), np.maximum(counts, 1)
    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.float64)])[ends])
    means = np.stack([sums(s) for s in by_level], 1) / n[:, None]
    first = by_level.argmin(0)
    least = np.stack([sums(first == k) for k in range(len(by_level))], 1) / n[:, None]
    squares = np.stack([sums(s * s) for s in by_level], 1) / n[:, None]
    text = np.repeat(np.arange(len(counts)) * BINS, counts)
    quantiles = np.empty((len(counts), len(by_level), len(QUANTILES)))
    for k, s in enumerate(by_level):
        bins = np.minimum((s / BIN).astype(np.int64), BINS - 1)
        upto = np.bincount(text + bins, minlength=len(counts) * BINS).reshape(-1, BINS).cumsum(1)
        for i, q in enumerate(QUANTILES):
            quantiles[:, k, i] = (upto < np.ceil(q * counts)[:, None]).sum(1) * BIN
    known = pc.is_in(words, pa.array(FUNCTION_WORDS, words.type)).to_numpy(zero_copy_only=False)
    lines = pc.count_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[^ \t\r\n][^\r\n]*").to_numpy(zero_copy_only=False)
    return {"n_words": counts, "lines": lines, "means": means, "deviations": np.sqrt(np.maximum(squares - means**2, 0)), "quantiles": quantiles, "least": least,
            "unknown_share": sums(unknown) / n, "letter_share": letters, "function_share": sums(known) / n}


def fitted(sample: DataFrame, most_samples: int = 10_000, one_liner: int = 40, few_words: int = 12) -> Grader:
    """A grader from at most ``most_samples`` graded passages."""
    rows = sample.where("passage is not null and reading_level is not null").orderBy("sample_id").limit(most_samples).select("passage", "reading_level").collect()
    return Grader.fit([r[0] for r in rows], [r[1] for r in rows], one_liner, few_words)


def graded(text: Column, grader: Grader) -> Column:
    """Struct of RESULT for ``text``; difficulty, the index, and level are null where there is no level. Surprisals are those
    under the model that a text surprises least."""
    @F.arrow_udf(RESULT)
    def grade(texts: pa.Array) -> pa.Array:
        m = measured(texts, grader.models)
        none = ~grader.running(m)
        best = m["means"].argmin(1)
        of = lambda v: v[np.arange(len(best)), best]
        values = [m["n_words"], of(m["means"]), of(m["deviations"]), *of(m["quantiles"]).T, m["unknown_share"], m["letter_share"], m["function_share"]]
        columns = [pa.array(np.ascontiguousarray(v), pa.int64() if i == 0 else pa.float64()) for i, v in enumerate(values)]
        index = grader.index(m)
        columns += [pa.array(index, pa.float64(), mask=none), pa.array(grader.level(index), pa.int32(), mask=none)]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in RESULT.fields])

    return grade(text)


def with_levels(documents: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, surprisal..., difficulty, level) of every document."""
    return documents.select(key, graded(F.col(text), fitted(sample)).alias("g")).select(key, "g.*")


def profile(levels: DataFrame) -> DataFrame:
    """(level, n_docs, n_words) of with_levels' result; level null for documents without one."""
    return levels.groupBy("level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))

"""Byte-level BPE over Arrow batches: padded numpy matrices in which every row merges one pair a round.

A batch's texts are cut into pre-tokens by class runs over their code points, the distinct pre-tokens are laid out as
rows of byte ids in matrices of one length bucket each, and every row merges its leftmost pair of least rank each
round until no row has a pair left. Texts are processed whole; distinct pre-tokens are encoded once a batch.

Defined cases: a null or empty text gives an empty list (never null); names of special tokens in a text are ordinary
text; a lone surrogate cannot occur in a Spark string. Repeated rows are encoded alike. Columns other than the text are
not touched, since encoding is a column expression.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "byte_bpe_50k"
NO_PAIR = np.int32(2**31 - 1)
#: Rows of a matrix times its width stay under this many cells.
CELLS = 1 << 21
#: Texts of a batch are taken in slices of about this many bytes (one text at least), which bounds the arrays beside them.
SLICE_BYTES = 8 << 20
#: Pre-tokens of more bytes than this take the heap, whose time grows as n log n instead of n squared.
LONG_ROW = 1536
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of the public vocabulary file ``name`` (ranks by base64 token)."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class PairTable:
    """Open-addressing hash of (left id, right id) to the id of the merged token, probed for whole arrays at once."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs, np.int64).T
        keys = left << 32 | right
        self.bits = int(len(keys) * 4 - 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]] = keys[todo[wins]]
            self.values[at[wins]] = merged[todo[wins]]
            todo = todo[~wins]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of the pairs, NO_PAIR where there is none; ids below 0 are padding."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).ravel()
        out = np.full(keys.size, NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            have = self.keys[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (have != -1)
            todo, slot = todo[on], slot[on] + 1 & (1 << self.bits) - 1
        return out.reshape(shape)


@lru_cache(maxsize=4)
def pair_table(path: str) -> PairTable:
    return PairTable(path)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point by Unicode's general category, in the vocabulary's sense of letter, number and space."""
    import regex

    classes = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(name, every):
            classes[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def pre_token_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where a pre-token starts, for code points of texts laid end to end; doc_starts are the texts' first places."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = code_point_classes()[points]
    doc_first = np.zeros(n + 1, bool)
    doc_first[doc_starts[doc_starts < n]] = True
    doc_first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= doc_first[:n]
    # The last space of a run before other text leaves the run: a plain blank joins what follows, another sign stands alone.
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~doc_first[1:n]
    start[ends_run] = True
    joins = np.flatnonzero(ends_run & (points == 32)) + 1
    start[joins] = False
    # An apostrophe that begins a pre-token takes a contraction's letters with it.
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~doc_first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~doc_first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "sdmt"])
        pair = (one == 108) & (two == 108) | (one == 118) & (two == 101) | (one == 114) & (two == 101)
        for which, length in ((short, 2), (pair & ~short, 3)):
            at = quote[which]
            start[at + 1] = False
            after = at + length
            inside = after < n
            after = after[inside]
            # What follows starts anew unless it is the start of something already, or a blank that joins the next run.
            start[after[kind[after] == LETTER]] = True
    return start


def merge_rows(rows: np.ndarray, table: PairTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of ids padded with -1 to their final ids: (row numbers, matrix) for each round's finished rows."""
    done, which = [], np.arange(len(rows))
    ranks = table.lookup(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.full((len(rows), 0), NO_PAIR, np.int32)
    while len(which):
        at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(which), np.int64)
        best = ranks[np.arange(len(which)), at] if ranks.shape[1] else np.full(len(which), NO_PAIR)
        finished = best == NO_PAIR
        if finished.any():
            done.append((which[finished], rows[finished]))
            on = ~finished
            which, rows, ranks, at, best = which[on], rows[on], ranks[on], at[on], best[on]
            if not len(which):
                break
        n, width = rows.shape
        each = np.arange(n)
        rows[each, at] = best
        # Compaction: cells right of the merged pair move one to the left.
        moved = np.arange(width - 1)[None, :] > at[:, None]
        rows = np.where(moved, rows[:, 1:], rows[:, :-1])
        moved = np.arange(max(width - 2, 0))[None, :] > at[:, None]
        ranks = np.where(moved, ranks[:, 1:], ranks[:, :-1]) if width > 2 else np.full((n, 0), NO_PAIR, np.int32)
        if ranks.shape[1]:
            right = at < ranks.shape[1]
            r, c = each[right], at[right]
            ranks[r, c] = table.lookup(rows[r, c], rows[r, c + 1])
            left = at > 0
            r, c = each[left], at[left]
            ranks[r, c - 1] = table.lookup(rows[r, c - 1], rows[r, c])
        used = int((rows >= 0).sum(1).max())
        if used < rows.shape[1]:
            rows, ranks = rows[:, :used], ranks[:, : max(used - 1, 0)]
    return done


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The same merges for one very long row: a heap of pairs over a linked list."""
    ids, n = ids.astype(np.int32), len(ids)
    ranks = table.lookup(ids[:-1], ids[1:])
    after, before, value = list(range(1, n + 1)), list(range(-1, n - 1)), ids.tolist()
    heap = [(int(r), i, value[i], value[i + 1]) for i, r in enumerate(ranks) if r != NO_PAIR]
    heapq.heapify(heap)
    # A row holds few different pairs, each of which is looked up once.
    known: dict[tuple[int, int], int] = {}

    def push(i: int, j: int) -> None:
        pair = value[i], value[j]
        if (r := known.get(pair)) is None:
            r = known[pair] = int(table.lookup(np.array(pair[:1]), np.array(pair[1:]))[0])
        if r != NO_PAIR:
            heapq.heappush(heap, (r, i, *pair))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if value[i] != a or j >= n or value[j] != b:
            continue
        value[i], value[j] = r, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([v for v in value if v >= 0], np.int32)


def ragged_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every piece, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def encode_words(words: pa.Array, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, number of ids of each) for distinct, non-empty words."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    counts, pieces, owners = np.zeros(n, np.int64), [], []
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < n:
        width = int(lengths[order[at]])
        if width > LONG_ROW:
            w = order[at]
            ids = merge_long(table.byte_ids[data[offsets[w] : offsets[w + 1]]], table)
            counts[w] = len(ids)
            pieces.append(ids)
            owners.append(np.array([w]))
            at += 1
            continue
        # A bucket spans an eighth in length, so that padding stays small.
        widest = min(width + max(width // 8, 0), LONG_ROW)
        upto = int(np.searchsorted(lengths[order], widest, "right"))
        upto = min(upto, at + max(1, CELLS // max(widest, 1)))
        some = order[at:upto]
        size = lengths[some]
        rows = np.full((len(some), int(size.max())), -1, np.int32)
        rows[np.arange(rows.shape[1])[None, :] < size[:, None]] = table.byte_ids[data[ragged_places(offsets[some], size)]]
        for which, matrix in merge_rows(rows, table):
            real = matrix >= 0
            counts[some[which]] = real.sum(1)
            pieces.append(matrix[real])
            owners.append(some[which])
        at = upto
    if not pieces:
        return np.zeros(0, np.int32), counts
    flat, owner = np.concatenate(pieces), np.concatenate(owners)
    ends = np.cumsum(counts[owner])
    place = np.empty(n, np.int64)
    place[owner] = ends - counts[owner]
    return flat[ragged_places(place, counts)], counts


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all texts as one string array, number of them in each text); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    raw = texts.buffers()[2].slice(low, high - low) if high > low else pa.py_buffer(b"")
    data = np.frombuffer(raw, np.uint8)
    doc_bytes = offsets - low
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(n, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data.astype(np.uint32) if len(lead) == len(data) else np.frombuffer(raw.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc_starts = np.searchsorted(lead, doc_bytes) if len(lead) < len(data) else doc_bytes
    start = np.flatnonzero(pre_token_starts(points, doc_starts[:-1]))
    counts = np.diff(np.searchsorted(start, doc_starts))
    cuts = np.append(lead[start], len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts), raw), counts


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of ``texts`` of about ``most`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def encoded_slice(texts: pa.Array, path: str, with_ids: bool) -> tuple[np.ndarray, np.ndarray]:
    words, per_text = pre_tokens(texts)
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    ids, counts = encode_words(coded.dictionary.cast(pa.string()), pair_table(path))
    each = counts[code]
    flat = ids[ragged_places((np.cumsum(counts) - counts)[code], each)] if with_ids else ids[:0]
    ends = np.concatenate([[0], np.cumsum(each)])
    last = np.cumsum(per_text)
    return flat, ends[last] - ends[last - per_text]


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, number of ids of each text)."""
    parts = [encoded_slice(part, path, True) for part in slices(texts)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def count_batch(texts: pa.Array, path: str) -> np.ndarray:
    """Number of ids of each text, without laying out the ids."""
    return np.concatenate([np.zeros(0, np.int64), *[encoded_slice(part, path, False)[1] for part in slices(texts)]])


def token_ids(text: Column, path: str | None = None) -> Column:
    """Column of the ids of ``text``: array<int>, empty for a null or empty text."""
    where = path or tokenizer_path()

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        flat, counts = encode_batch(texts, where)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Column of the number of ids of ``text``: bigint, 0 for a null or empty text."""
    where = path or tokenizer_path()

    @F.arrow_udf(T.LongType())
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(count_batch(texts, where).astype(np.int64))

    return counts(text)

"""Benchmark decontamination by spaced-seed hashing.

Method. Texts become lower-case words (runs of letters and digits; other ASCII characters separate). Fixed masks choose positions of
a word window and ignore the others; the chosen words are hashed. Hashes of all benchmark windows meet those of all document
windows, so a hit survives substitutions at ignored positions. Around each hit the two texts are aligned and compared word by
word: they overlap if some ``VERIFY`` aligned words (all of a shorter item) agree in at least ``AGREE`` of them. The masks of ``covering`` leave
out every set of so many positions as may differ, so no such overlap lacks a hit.

The benchmark is a stated query set. It is read in blocks of at most ``BLOCK_WORDS`` words (the checked bound of what is
broadcast), and every document is probed against every block, in one pass over the texts for each block.

Items of fewer words than ``VERIFY`` have covering masks of their own length; items of fewer than ``LEAST`` words can't prove a leak and
are left out. Defined results: null or empty texts overlap with nothing; null ids are carried as null; repeated rows give repeated
results, repeated item rows one; extra columns are ignored by overlaps() and carried by clean(); empty tables give no rows, and
an empty benchmark leaves all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .arrays import U64, Texts

#: Positions that count; each mask tolerates other places of substitutions.
MASKS = ("11111111", "11011011011", "1011011011011", "1010101010101")
VERIFY, AGREE, LEAST = 13, 0.8, 5
BLOCK_WORDS = 1_000_000
_SLOTS = 1 << 22

_WORD = np.zeros(256, np.uint8)
for _c in range(256):
    _WORD[_c] = _c if _c >= 128 or chr(_c).isalnum() else 32
_WORD[65:91] += 32


def least_agreeing(n: int) -> int:
    """Words that must agree of n aligned ones."""
    return int(np.ceil(AGREE * n))


def covering(n: int) -> list[str]:
    """Masks of n words of which at least one ignores all places that differ, wherever they are.

    With d differing words, n places are dealt into d + 2 runs and every choice of d runs is ignored by one mask.
    """
    d = n - least_agreeing(n)
    part = [k * (d + 2) // n for k in range(n)]
    return ["".join("0" if p in out else "1" for p in part) for out in combinations(range(d + 2), d)]


class Tokens:
    """Word hashes of texts, their rows and where each row begins."""

    def __init__(self, texts: Texts):
        plain = Texts(texts.ids, _WORD[texts.data], texts.offsets)
        starts, ends, self.row = plain.words()
        self.hash = A.spans_hash(plain.data, starts, ends, A.BYTE_BASE)
        counts = np.bincount(self.row, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def seeds(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows under a mask, and their hashes."""
        n = len(mask)
        if len(self.row) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        m = len(self.row) - n + 1
        h = np.full(m, hash_of_mask(mask), U64)
        for k, c in enumerate(mask):
            if c == "1":
                h *= U64(A.WORD_BASE)
                h += self.hash[k : k + m]
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        return at, A.mix(h[at])


def hash_of_mask(mask: str) -> int:
    return (int(mask, 2) * A.SECOND_BASE) % (1 << 64)


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        t = Texts.of(pa.array(range(len(ids)), pa.int64()), pc.utf8_lower(pa.array(texts, pa.string())))
        self.ids, self.tokens = ids, Tokens(t)
        sizes = np.diff(self.tokens.first)
        short = sorted({int(n) for n in sizes if LEAST <= n < VERIFY})
        self.masks = list(dict.fromkeys([*MASKS, *covering(VERIFY), *(m for n in short for m in covering(n))]))
        at, h = zip(*(self.tokens.seeds(m) for m in self.masks), strict=True)
        at, h = np.concatenate(at), np.concatenate(h)
        ok = sizes[self.tokens.row[at]] >= LEAST if len(at) else np.zeros(0, bool)
        order = np.argsort(h[ok], kind="stable")
        self.at, self.seed = at[ok][order], h[ok][order]
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(self.seed % U64(_SLOTS)).astype(np.int64)] = True


def verify(d: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Most agreeing words in a window of two aligned sequences of hashes, all agreeing words, and the words from the first to
    the last agreeing one."""
    same = d == b
    n = min(VERIFY, len(b))
    if len(same) < n:
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(same)])
    at = np.flatnonzero(same)
    return int((sums[n:] - sums[:-n]).max()), int(same.sum()), int(at[-1] - at[0] + 1) if len(at) else 0


#: Pairs of one document's and the items' windows under one mask up to which they are listed one by one.
FEW_PAIRS = 1 << 14


def _shifts(t: Tokens, index: Index, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> set[tuple[int, int, int]]:
    """(row, item, shift) of all hits. Documents with few are listed; in one that repeats itself, the places of each seed in document
    and item are laid over each other instead, so that time and memory grow with the lengths of the texts and not with their product."""
    row = t.row[at]
    many = np.bincount(row, n, len(t.first) - 1)[row] > FEW_PAIRS
    out: set[tuple[int, int, int]] = set()
    one = ~many
    pos, q = np.repeat(at[one], n[one]), index.at[A.ranges(lo[one], n[one])]
    if len(pos):
        r, i = t.row[pos], index.tokens.row[q]
        out.update(map(tuple, np.unique(np.stack([r, i, (pos - t.first[r]) - (q - index.tokens.first[i])]), axis=1).T.tolist()))
    for r in np.unique(row[many]):
        mine = np.flatnonzero(row == r)
        size = int(t.first[r + 1] - t.first[r])
        seen: dict[int, np.ndarray] = {}
        for first in np.unique(lo[mine]):  # one seed
            places = at[mine[lo[mine] == first]] - t.first[r]
            there = np.zeros(size, bool)
            there[places] = True
            for q in index.at[first : first + n[mine[lo[mine] == first][0]]]:
                i = int(index.tokens.row[q])
                b = int(q - index.tokens.first[i])
                length = int(index.tokens.first[i + 1] - index.tokens.first[i])
                line = seen.setdefault(i, np.zeros(size + length, bool))  # shift s at s + length
                line[length - b : length - b + size] |= there
        for i, line in seen.items():
            length = int(index.tokens.first[i + 1] - index.tokens.first[i])
            out.update((int(r), i, int(s) - length) for s in np.flatnonzero(line))
    return out


def _find(index: Index, texts: Texts) -> Iterator[tuple[int, int, int, int, int, int]]:
    """row, item, first word in the document and in the item, span, agreeing words: the best alignment of each row and item."""
    t = Tokens(texts)
    hits: set[tuple[int, int, int]] = set()
    for mask in index.masks:
        at, h = t.seeds(mask)
        maybe = np.flatnonzero(index.slots[(h % U64(_SLOTS)).astype(np.int64)])
        lo, hi = np.searchsorted(index.seed, h[maybe]), np.searchsorted(index.seed, h[maybe], "right")
        real = hi > lo
        if real.any():
            hits |= _shifts(t, index, at[maybe][real], lo[real], (hi - lo)[real])
    top: dict[tuple[int, int], tuple] = {}
    for r, i, s in sorted(hits):
        b0, b1 = index.tokens.first[i], index.tokens.first[i + 1]
        d0, d1 = t.first[r], t.first[r + 1]
        lo_, hi_ = max(0, -s), min(b1 - b0, d1 - d0 - s)
        best, agree, span = verify(t.hash[d0 + s + lo_ : d0 + s + hi_], index.tokens.hash[b0 + lo_ : b0 + hi_])
        if best >= least_agreeing(min(VERIFY, int(b1 - b0))):
            x = (agree, span, s + lo_, lo_)
            if x > top.get((r, i), (0,)):
                top[(r, i)] = x
    for (r, i), (agree, span, d, b) in top.items():
        yield r, i, d, b, span, agree


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    ids, texts, n = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += len(r[1].split()) + 1
        if n >= BLOCK_WORDS:
            yield Index(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield Index(ids, texts)


def _unsorted(batches: Iterator[pa.RecordBatch], id_col: int, text_col: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            text = pc.utf8_lower(part.column(text_col).cast(pa.large_string()))
            yield part, Texts.of(pa.array(range(part.num_rows), pa.int64()), text)


OVERLAPS = "doc_id long, item_id long, n_agree long, n_span long, item_words long, doc_word long, item_word long"
_OVERLAPS = [x.split()[0] for x in OVERLAPS.split(", ")]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap, at their best alignment."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], OVERLAPS)
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            sizes = np.diff(index.tokens.first)
            for part, texts in _unsorted(batches, 0, 1):
                rows = [(part.column(0)[r].as_py(), index.ids[i], agree, span, int(sizes[i]), int(d), int(b)) for r, i, d, b, span, agree in _find(index, texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _OVERLAPS)

        out = out.unionByName(source.mapInArrow(run, OVERLAPS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns, in one pass for each block of the benchmark."""
    spark, text_col = docs.sparkSession, docs.columns.index("text")
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts in _unsorted(batches, 0, text_col):
                hit = np.zeros(part.num_rows, bool)
                hit[[r for r, *_ in _find(shared.value, texts)]] = True
                yield part.filter(pa.array(~hit))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Removal of repeated word passages by fixed-block anchors.

A passage is a window of ``WINDOW`` words. A word goes when a window that covers it has a word sequence that also starts
earlier (a smaller id, or the same document and an earlier word); windows are judged on the input.

Method.
1. Anchors. Every document is cut into non-overlapping reference blocks of ``BLOCK`` words; their hashes are the index.
   Each rolling window of BLOCK words is a probe. 2 * BLOCK - 1 <= WINDOW, so a repeated passage always holds a whole reference
   block of the other document, which the probe at the same place in this one hits. Hashes go to the shuffle packed, five
   bytes each and grouped by key.
2. Hits. In each key, probes that meet an index block of another place are answered to the documents on both sides.
3. Extension. Documents meet the answers; every passage around a hit is hashed whole (96 bits, not compared word by word) and goes to the key of that
   hash, where the earliest start is found. All passages that lie on a repeat longer than WINDOW are hits of their own, so
   together the answers cover the maximal exact repeats, as runs.
4. The runs meet the texts again, and the covered words are taken out.

Repeats inside a unit of documents (one task's few MB) are settled in step 1, in the same order, and send nothing further:
a passage that a third of all rows share costs one entry for each unit. Nothing is collected on the driver.

Defined results: null or empty text has no words; rows without an id count as one document before all others; rows with the
same id are one place in the order, so a window at the same word of both is no earlier one and both keep it; what goes from a row
is told by its id and its text; extra columns are ignored; no rows give no
rows; short documents keep all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .arrays import U64, Texts

WINDOW, BLOCK = 20, 10
TEXT, REPLY, COVER, PROBE, CANDIDATE = 0, 1, 2, 3, 4


class Words:
    """Word hashes of a unit, and the windows that stay inside a document."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.starts, self.ends, self.row = texts.words()
        self.hash = A.spans_hash(texts.data, self.starts, self.ends, A.BYTE_BASE)
        counts = np.bincount(self.row, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def windows(self, n: int) -> np.ndarray:
        """Starts (word numbers of the unit) of the windows of n words."""
        if len(self.row) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])

    def hashes(self, at: np.ndarray, n: int, base: int = A.WORD_BASE) -> np.ndarray:
        return A.spans_hash(self.hash, at, at + n, base)


def _repeats(w: Words, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mask of the windows that also start earlier in the unit, by (id, word). Equal hashes are compared word by word."""
    ids, start = w.texts.ids[w.row[at]], at - w.first[w.row[at]]
    order = np.argsort(h, kind="stable")
    same_id = w.texts.ids[1:] == w.texts.ids[:-1]
    if same_id.any():  # else the unit's order is that of (id, word)
        order = np.lexsort((start, ids, h))
    s = h[order]
    again = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
    out = np.zeros(len(at), bool)
    if again.any():
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(s))))
        a, b = at[order[again]], at[order[lead[again]]]
        first = order[lead[again]]
        same = (ids[order[again]] != ids[first]) | (start[order[again]] != start[first])
        for k in range(0, WINDOW):
            same &= w.hash[a + k] == w.hash[b + k]
        out[order[again]] = same
    return out


def _tags(texts: Texts) -> np.ndarray:
    """Hash of every text, which tells rows of one id apart."""
    return A.spans_hash(texts.data, texts.offsets[:-1], texts.offsets[1:], A.SECOND_BASE)


def _repeated(parts: list[Texts]) -> np.ndarray:
    """Ids that several texts have."""
    ids, n = np.unique(np.concatenate([p.ids for p in parts]), return_counts=True)
    return ids[n > 1]


def _cover(w: Words, at: np.ndarray, n_keys: int, tags: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """COVER blobs: ids, first words inside their documents, and tags of windows that go."""
    if len(at):
        row = w.row[at]
        ids, start = w.texts.ids[row], at - w.first[row]
        for key, pick in A.by_key(A.home(ids, n_keys)):
            yield key, COVER, A.pack(ids[pick], start[pick], tags[row[pick]].view("V8"))


def _probe(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for unit in A.units(batches):
                w = Words(unit)
                at = w.windows(WINDOW)
                if not len(at):
                    continue
                settled = _repeats(w, at, w.hashes(at, WINDOW))
                yield from _cover(w, at[settled], n_keys, _tags(unit))
                # Probes inside at least one passage that is not settled.
                open_ = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(open_, at[~settled], 1)
                np.add.at(open_, at[~settled] + WINDOW - BLOCK + 1, -1)
                probes = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
                h = w.hashes(probes, BLOCK)
                block = (probes - w.first[w.row[probes]]) % BLOCK == 0
                keys = (h % U64(n_keys)).astype(np.int32)
                ids = unit.ids[w.row[probes]]
                five = _five(h >> U64(24))
                for key, pick in A.by_key(keys):
                    yield key, PROBE, A.pack(ids[pick], five[pick], block[pick].astype(np.uint8))

        yield from A.blobs(rows())

    return run


def _five(h: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 40 as rows of five bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").reshape(-1)


def _wide(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five.view(np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _hits(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for key, held in A.keyed(batches):
                for blob in held.get(COVER, ()):
                    yield key, COVER, blob
                if PROBE not in held:
                    continue
                parts = [A.unpack(b) for b in held[PROBE]]
                ids, h, block = (np.concatenate([p[k] for p in parts]) for k in range(3))
                h = _wide(h)
                order = np.argsort(h, kind="stable")
                s = h[order]
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                n = np.diff(np.concatenate([first, [len(s)]]))
                hit = (n > 1) & (np.add.reduceat(block[order].astype(np.int64), first) > 0)
                pick = order[np.repeat(hit, n)]
                # The answer to a document is the hash; the low bits tell it from the other keys' hashes.
                for to, mine in A.by_key(A.home(ids[pick], n_keys)):
                    at = pick[mine]
                    at = at[np.argsort(ids[at], kind="stable")]
                    yield to, REPLY, A.pack(ids[at], _five(h[at]), np.full(1, key, np.int64))

        yield from A.blobs(rows())

    return run


def _texts(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for unit in A.units(batches):
                for key, pick in A.by_key(A.home(unit.ids, n_keys)):
                    yield key, TEXT, unit.take(pick).pack()

        yield from A.blobs(rows())

    return run


def _members(row: np.ndarray, value: np.ndarray, rows2: np.ndarray, values2: np.ndarray) -> np.ndarray:
    """Whether (row, value) is among the pairs given second."""
    return np.isin(A.mix(value ^ A.mix(row.astype(U64) + U64(1))), A.mix(values2 ^ A.mix(rows2.astype(U64) + U64(1))))


def _extend(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for key, held in A.keyed(batches):
                for blob in held.get(COVER, ()):
                    yield key, COVER, blob
                if REPLY not in held:
                    continue
                replies = [A.unpack(b) for b in held[REPLY]]
                ids = np.concatenate([r[0] for r in replies])
                tag = np.concatenate([A.mix(_wide(r[1]) ^ (r[2].astype(U64) << U64(40))) for r in replies])
                parts = [Texts.unpack(b) for b in held.get(TEXT, ())]
                if not parts:
                    continue
                several = _repeated(parts)
                for texts in _by_size(parts):
                    texts = texts.take(np.flatnonzero(np.isin(texts.ids, ids)))
                    if not len(texts):
                        continue
                    w = Words(texts)
                    probes = w.windows(BLOCK)
                    h = w.hashes(probes, BLOCK)
                    own = A.mix((h >> U64(24)) ^ ((h % U64(n_keys)) << U64(40)))
                    hit = probes[_members(texts.ids[w.row[probes]], own, ids, tag)]
                    near = np.zeros(len(w.row) + 1, np.int64)  # passages that hold a hit
                    np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
                    np.add.at(near, hit + 1, -1)
                    at = w.windows(WINDOW)
                    at = at[np.cumsum(near)[at] > 0]
                    if not len(at):
                        continue
                    h1 = w.hashes(at, WINDOW)
                    settled = _repeats(w, at, h1)
                    # All texts of an id are here, so that one text alone needs no tag.
                    tags = np.where(np.isin(texts.ids, several), _tags(texts), U64(0)) if len(several) else np.zeros(len(texts), U64)
                    yield from _cover(w, at[settled], n_keys, tags)
                    at, h1 = at[~settled], h1[~settled]
                    h2 = w.hashes(at, WINDOW, A.SECOND_BASE)
                    row = w.row[at]
                    ids1, start = texts.ids[row], at - w.first[row]
                    for to, pick in A.by_key((h1 % U64(n_keys)).astype(np.int32)):
                        yield to, CANDIDATE, A.pack(ids1[pick], start[pick], h1[pick].view("V8"), (h2[pick] >> U64(32)).astype(np.uint32).view("V4"), tags[row[pick]].view("V8"))

        yield from A.blobs(rows())

    return run


def _by_size(parts: list[Texts], size: int = 4 << 20) -> Iterator[Texts]:
    """Whole texts of a key in units, ordered by id."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p.data)
        if n >= size:
            whole = Texts.join(held)
            yield whole.take(np.argsort(whole.ids, kind="stable"))
            held, n = [], 0
    if held:
        whole = Texts.join(held)
        yield whole.take(np.argsort(whole.ids, kind="stable"))


def _earliest(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for key, held in A.keyed(batches):
                for blob in held.get(COVER, ()):
                    yield key, COVER, blob
                if CANDIDATE not in held:
                    continue
                parts = [A.unpack(b) for b in held[CANDIDATE]]
                ids, start, h1, h2, tags = (np.concatenate([p[k] for p in parts]) for k in range(5))
                order = np.lexsort((start, ids, h2.view(np.uint32), h1.view(np.uint64)))
                a, b = h1.view(np.uint64)[order], h2.view(np.uint32)[order]
                again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
                lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
                later = order[again & ((ids[order] != ids[lead]) | (start[order] != start[lead]))]
                for to, mine in A.by_key(A.home(ids[later], n_keys)):
                    at = later[mine]
                    at = at[np.lexsort((start[at], ids[at]))]
                    yield to, COVER, A.pack(ids[at], start[at], tags[at])

        yield from A.blobs(rows())

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in A.keyed(batches):
            cover = [A.unpack(b) for b in held.get(COVER, ())]
            ids = np.concatenate([c[0] for c in cover]) if cover else np.zeros(0, np.int64)
            starts = np.concatenate([c[1] for c in cover]) if cover else np.zeros(0, np.int64)
            tags = np.concatenate([c[2] for c in cover]).view(U64) if cover else np.zeros(0, U64)
            order = np.argsort(ids, kind="stable")
            ids, starts, tags = ids[order], starts[order], tags[order]
            parts = [Texts.unpack(blob) for blob in held.get(TEXT, ())]
            several = set(_repeated(parts).tolist()) if parts else set()
            for texts in parts:
                own = _tags(texts)
                begin, end, row = texts.words()
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                out = []
                for i in range(len(texts)):
                    a, b = first[i], first[i + 1]
                    lo, hi = np.searchsorted(ids, texts.ids[i]), np.searchsorted(ids, texts.ids[i], "right")
                    go = np.zeros(b - a + 1, np.int64)
                    if hi > lo:
                        at = starts[lo:hi]
                        if int(texts.ids[i]) in several:
                            at = at[tags[lo:hi] == own[i]]
                        at = at[at + WINDOW <= b - a]
                        np.add.at(go, at, 1)
                        np.add.at(go, at + WINDOW, -1)
                    keep = np.cumsum(go)[:-1] == 0
                    # runs of kept words with single spaces
                    raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                    if keep.all():
                        kept = b" ".join(raw.split())
                    else:
                        base = int(texts.offsets[i])
                        edge = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
                        kept = b" ".join(b" ".join(raw[begin[a + s] - base : end[a + e - 1] - base].split()) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))
                    doc = int(texts.ids[i])
                    out.append((None if doc == -(1 << 63) else doc, int(b - a), int(b - a - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT, strict=True)], schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys, n = A.key_count(source)

    def meet(df: DataFrame, step) -> DataFrame:
        return df.repartition(n, "key").sortWithinPartitions("key").mapInArrow(step, A.BLOBS)

    texts = source.mapInArrow(_texts(keys), A.BLOBS)
    hits = meet(source.mapInArrow(_probe(keys), A.BLOBS), _hits(keys))
    candidates = meet(hits.unionAll(texts), _extend(keys))
    cover = meet(candidates, _earliest(keys))
    return cover.unionAll(texts).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_remove(with_text), RESULT)

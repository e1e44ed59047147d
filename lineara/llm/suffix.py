"""Removal of byte strings that earlier documents hold, by prefix-free parsing.

A string is any ``LENGTH`` bytes of one document. A byte goes when a string that covers it also starts in a document with a
smaller id; strings are judged on the input.

Method.
1. Parse. A rolling hash of ``TRIGGER`` bytes is taken at every byte; the smallest in every window of a string's length is a
   trigger. Triggers cut a document into phrases: a phrase is the run of string starts that have the same trigger, with the
   bytes up to the end of the last such string. Every string lies in exactly one phrase, and equal strings, wherever they
   stand, have the same trigger at the same place: no string of one trigger's phrases is a prefix of another's. The
   triggers go to the shuffle packed, five bytes each.
2. Triggers that more than one document holds are answered to those documents; all other text needs no ordering.
3. Dictionary. Phrases of answered triggers go to the key of their trigger, where equal ones become one dictionary entry with
   the parse's list of places. An entry's strings are all taken from its smallest document on.
4. Corpus order. Inside a trigger, the suffixes of different dictionary entries are sorted by their first LENGTH bytes (a suffix
   array of the dictionary); runs of equal suffixes, joined with the parse, give the smallest document of each string. Ordering
   is by trigger first, then by suffix: equal strings never meet across triggers, so no global merge is needed.
5. The runs meet the texts again and the covered bytes are taken out.

Phrases repeated inside a unit of documents are settled there, so a passage that a third of all rows share costs one entry for
each unit. Nothing is collected on the driver.

Defined results: null or empty text has no bytes; rows without an id count as one document before all others; rows with the same
id are the same document, so they remove nothing from each other; extra columns are ignored; no rows give no rows. The kept bytes
are returned as binary, because a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .arrays import U64, Texts
from .substring import COVER, PROBE, REPLY, TEXT, _by_size, _five, _members, _texts, _wide

LENGTH, TRIGGER = 50, 24
PHRASE = 5


class Parse:
    """Phrases of a unit: first and last string start, trigger hash and row."""

    def __init__(self, texts: Texts):
        self.texts = texts
        lengths = np.maximum(np.diff(texts.offsets) - LENGTH + 1, 0)
        starts = A.ranges(texts.offsets[:-1], lengths)
        if not len(starts):
            self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.trigger = np.zeros(0, U64)
            return
        h = rolling(texts.data, TRIGGER)
        # The upper half orders, the position breaks ties to the left.
        low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        width, n = 1, LENGTH - TRIGGER + 1
        while 2 * width <= n:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < n:
            low = np.minimum(low[: len(low) - (n - width)], low[n - width :])
        owner = (low[starts] & U64(0xFFFFFFFF)).astype(np.int64)
        del low
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        self.lo = starts[cut]
        self.hi = starts[np.concatenate([cut[1:], [len(starts)]]) - 1]
        self.trigger = A.mix(h[owner[cut]])
        self.row = np.searchsorted(texts.offsets, self.lo, "right") - 1


def rolling(data: np.ndarray, width: int, step: int = 1 << 18) -> np.ndarray:
    """Hash of the ``width`` bytes at every byte."""
    out = np.empty(max(0, len(data) - width + 1), U64)
    p, q = A.powers(A.BYTE_BASE, step + width), A.powers(A.inverse(A.BYTE_BASE), step + width)
    for a in range(0, len(out), step):
        part = data[a : a + step + width - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * p[: len(part)], out=sums[1:])
        m = len(part) - width + 1
        out[a : a + m] = A.mix((sums[width:] - sums[:m]) * q[:m])
    return out


def _first_of_runs(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _triggers(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for unit in A.units(batches):
                p = Parse(unit)
                if not len(p.lo):
                    continue
                ids = unit.ids[p.row]
                order = np.lexsort((ids, p.trigger))
                order = order[_first_of_runs(p.trigger[order], ids[order])]  # one of each trigger and document
                first = _first_of_runs(p.trigger[order])
                n = np.diff(np.concatenate([first, [len(order)]]))
                shared = order[np.repeat(n > 1, n)]
                for key, pick in A.by_key(A.home(ids[shared], n_keys)):
                    at = shared[pick]
                    at = at[np.argsort(ids[at], kind="stable")]
                    yield key, REPLY, A.pack(ids[at], p.trigger[at].view("V8"))
                entry = order[first]
                keys = (p.trigger[entry] % U64(n_keys)).astype(np.int32)
                for key, pick in A.by_key(keys):
                    at = entry[pick]
                    sort = np.argsort(ids[at], kind="stable")
                    yield key, PROBE, A.pack(ids[at][sort], _five(p.trigger[at][sort] >> U64(24)), (n[pick][sort] > 1).astype(np.uint8))

        yield from A.blobs(rows())

    return run


def _shared(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for key, held in A.keyed(batches):
                for blob in held.get(REPLY, ()):
                    yield key, REPLY, blob
                if PROBE not in held:
                    continue
                parts = [A.unpack(b) for b in held[PROBE]]
                ids, five, many = (np.concatenate([p[k] for p in parts]) for k in range(3))
                h = _wide(five)
                order = np.argsort(h, kind="stable")
                first = _first_of_runs(h[order])
                n = np.diff(np.concatenate([first, [len(order)]]))
                pick = order[np.repeat(n > 1, n)]
                pick = pick[many[pick] == 0]  # the others are answered already
                for to, mine in A.by_key(A.home(ids[pick], n_keys)):
                    at = pick[mine]
                    at = at[np.argsort(ids[at], kind="stable")]
                    yield to, REPLY, A.pack(ids[at], five[at], np.full(1, key, np.int64))

        yield from A.blobs(rows())

    return run


def _tag(trigger: np.ndarray, n_keys: int) -> np.ndarray:
    return A.mix((trigger >> U64(24)) ^ ((trigger % U64(n_keys)) << U64(40)))


def _dictionary(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for _, held in A.keyed(batches):
                if REPLY not in held:
                    continue
                replies = [A.unpack(b) for b in held[REPLY]]
                ids = np.concatenate([r[0] for r in replies])
                tag = np.concatenate([A.mix(_wide(r[1]) ^ (r[2].astype(U64) << U64(40))) if len(r) > 2 else _tag(r[1].view(U64), n_keys) for r in replies])
                for texts in _by_size([Texts.unpack(b) for b in held.get(TEXT, ())]):
                    texts = texts.take(np.flatnonzero(np.isin(texts.ids, ids)))
                    p = Parse(texts)
                    pick = np.flatnonzero(_members(texts.ids[p.row], _tag(p.trigger, n_keys), ids, tag))
                    if not len(pick):
                        continue
                    lo, hi, trigger, row = p.lo[pick], p.hi[pick] + LENGTH, p.trigger[pick], p.row[pick]
                    doc, start = texts.ids[row], lo - texts.offsets[row]
                    later = _later(doc, *(A.spans_hash(texts.data, lo, hi, b) for b in (A.BYTE_BASE, A.SECOND_BASE)))
                    yield from _cover(doc[later], start[later], (hi - lo)[later], n_keys)
                    keep = np.flatnonzero(~later)
                    for key, mine in A.by_key((trigger[keep] % U64(n_keys)).astype(np.int32)):
                        at = keep[mine]
                        size = hi[at] - lo[at]
                        yield key, PHRASE, A.pack(doc[at], start[at].astype(np.int32), size.astype(np.int32), _five(trigger[at] >> U64(24)), texts.data[A.ranges(lo[at], size)])

        yield from A.blobs(rows())

    return run


def _later(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Mask of the entries whose content also stands in a smaller document."""
    order = np.lexsort((doc, h2, h1))
    first = _first_of_runs(h1[order], h2[order])
    n = np.diff(np.concatenate([first, [len(order)]]))
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > np.repeat(doc[order[first]], n)
    return out


def _cover(doc: np.ndarray, start: np.ndarray, size: np.ndarray, n_keys: int) -> Iterator[tuple[int, int, bytes]]:
    for key, pick in A.by_key(A.home(doc, n_keys)):
        at = pick[np.lexsort((start[pick], doc[pick]))]
        yield key, COVER, A.pack(doc[at], start[at].astype(np.int32), size[at].astype(np.int32))


def corpus_order(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, first string and number of strings of the runs that a smaller owner's entry also holds.

    The suffixes of all entries are sorted by their first LENGTH bytes.
    """
    n = sizes - LENGTH + 1
    at, entry = A.ranges(offsets, n), np.repeat(np.arange(len(n)), n)
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").reshape(-1)
    order = np.argsort(text, kind="stable")
    first = _first_of_runs(text[order])
    least = np.minimum.reduceat(owner[entry[order]], first)
    gone = np.zeros(len(at), bool)
    gone[order] = np.repeat(least, np.diff(np.concatenate([first, [len(order)]]))) < owner[entry[order]]
    edge = np.concatenate([[0], gone.astype(np.int8), [0]])
    starts_entry = np.concatenate([[True], entry[1:] != entry[:-1]])
    begin = np.flatnonzero(gone & (starts_entry | ~edge[:-2].astype(bool)))
    ends_entry = np.concatenate([entry[1:] != entry[:-1], [True]])
    end = np.flatnonzero(gone & (ends_entry | ~edge[2:].astype(bool))) + 1
    return entry[begin], at[begin] - offsets[entry[begin]], end - begin


def _order(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for key, held in A.keyed(batches):
                for blob in held.get(COVER, ()):
                    yield key, COVER, blob
                if PHRASE not in held:
                    continue
                parts = [A.unpack(b) for b in held.pop(PHRASE)]
                doc, start, size, five, data = (np.concatenate([p[k] for p in parts]) for k in range(5))
                del parts
                start, size = start.astype(np.int64), size.astype(np.int64)
                offsets = np.cumsum(size) - size
                h1, h2 = (A.spans_hash(data, offsets, offsets + size, b) for b in (A.BYTE_BASE, A.SECOND_BASE))
                order = np.lexsort((doc, h2, h1))
                first = _first_of_runs(h1[order], h2[order])
                n = np.diff(np.concatenate([first, [len(order)]]))
                entry = np.empty(len(doc), np.int64)
                entry[order] = np.repeat(np.arange(len(first)), n)
                rep = order[first]  # a place of each entry, in its smallest document
                owner = doc[rep]
                later = doc > owner[entry]
                yield from _cover(doc[later], start[later], size[later], n_keys)
                # Entries that share their trigger with another entry, in pieces of whole triggers.
                h = _wide(five[rep])
                by = np.argsort(h, kind="stable")
                cut = _first_of_runs(h[by])
                m = np.diff(np.concatenate([cut, [len(by)]]))
                by = by[np.repeat(m > 1, m)]
                m = m[m > 1]
                piece = np.cumsum(size[rep[by]]) // (1 << 20)
                group = np.repeat(np.arange(len(m)), m)
                piece = piece[np.searchsorted(group, group)]  # that of the trigger's first entry
                own = np.flatnonzero(~later)
                own = own[np.argsort(entry[own], kind="stable")]
                own_entry = entry[own]
                for _, mine in A.by_key(piece):
                    e = by[mine]
                    which, s, k = corpus_order(data, offsets[rep[e]], size[rep[e]], owner[e])
                    e = e[which]
                    # every place of the entry in its smallest document
                    a, b = np.searchsorted(own_entry, e), np.searchsorted(own_entry, e, "right")
                    place = own[A.ranges(a, b - a)]
                    times = b - a
                    yield from _cover(doc[place], start[place] + np.repeat(s, times), np.repeat(k + LENGTH - 1, times), n_keys)

        yield from A.blobs(rows())

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in A.keyed(batches):
            cover = [A.unpack(b) for b in held.get(COVER, ())]
            ids, start, size = (np.concatenate([c[k] for c in cover]) if cover else np.zeros(0, np.int64) for k in range(3))
            order = np.argsort(ids, kind="stable")
            ids, start, size = ids[order], start[order].astype(np.int64), size[order].astype(np.int64)
            for blob in held.get(TEXT, ()):
                texts = Texts.unpack(blob)
                out = []
                for i in range(len(texts)):
                    data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                    lo, hi = np.searchsorted(ids, texts.ids[i]), np.searchsorted(ids, texts.ids[i], "right")
                    removed = spans = 0
                    if hi > lo:
                        a, b = start[lo:hi], start[lo:hi] + size[lo:hi]
                        fits = b <= len(data)
                        go = np.zeros(len(data) + 1, np.int32)
                        np.add.at(go, a[fits], 1)
                        np.add.at(go, b[fits], -1)
                        gone = np.cumsum(go)[:-1] > 0
                        removed = int(gone.sum())
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                        data = data[~gone]
                    kept, doc = data.tobytes(), int(texts.ids[i])
                    out.append((None if doc == -(1 << 63) else doc, int(texts.offsets[i + 1] - texts.offsets[i]), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT, strict=True)], schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys, n = A.key_count(source)

    def meet(df: DataFrame, step) -> DataFrame:
        return df.repartition(n, "key").sortWithinPartitions("key").mapInArrow(step, A.BLOBS)

    texts = source.mapInArrow(_texts(keys), A.BLOBS)
    answers = meet(source.mapInArrow(_triggers(keys), A.BLOBS), _shared(keys))
    phrases = meet(answers.unionAll(texts), _dictionary(keys))
    cover = meet(phrases, _order(keys))
    return cover.unionAll(texts).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_remove(with_text), RESULT)

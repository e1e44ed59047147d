"""Alignment of the tokens of two tokenizers, and how often ids of one are linked with ids of the other.

Method. Both tokenizers cut the same bytes: a space and the text. Divide and conquer: within an interval the end of a token of A near the
middle is looked up by bisection among the ends of B's tokens, then the next ends to either side, until one is an end of both; the
interval is cut there and both halves go on. An interval without a common end inside is a group. All intervals of a unit of
documents take their steps together. Tokens of A and B in one group are linked, each with each.

Counts. A unit (about ``UNIT`` bytes of documents, or one longer document) is written as one row: its documents' groups in short, how
often each document links which pair, and for each pair of ids in how many documents of the unit. Spark adds the latter up over all
units, finds each A id's highest count, and joins the counts back to the units' pairs; so no row of a shuffle belongs to a single
document, no pair is hot beyond one row a unit, and nothing of the corpus passes through the driver. In a group of more than ``WIDE``
links equal ids are counted before they are paired.

Encoding. Where a space follows something else than white space, neither tokenizer has a token across: A's pattern begins a part there,
and B cannot merge across if no piece of its vocabulary has U+2581 behind another character, which is checked; else B takes whole texts.
Texts are thus encoded by segments, and each task keeps the ids of up to ``KEPT`` segments. The vocabulary files are read on the driver
and sent to the tasks (a few megabytes).

Defined results: null or empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros, and an
empty digest. Rows repeated count as documents of their own; rows without doc_id count too and keep a null id. No rows give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir
from . import arrays as A

UNIT, WIDE = 1 << 20, 1024
#: Segments whose ids a task keeps.
KEPT = 600_000
NO_ID = -(1 << 63)
_PLAIN = np.array([0x20 < i < 0x7F for i in range(256)])  # ASCII that is no white space anywhere


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of segments, and whether what stands before each place is certainly no white space.

    Every text begins with a space. A space behind something else than white space begins a segment, unless it is the text's last byte.
    Characters whose UTF-8 begins with E1, E2 or E3 may be white space; of two bytes, only C2 85 and C2 A0 are.
    """
    back = lambda k: np.concatenate([np.full(min(k, len(data)), 32, np.uint8), data[: max(0, len(data) - k)]])
    one, two, three = back(1), back(2), back(3)
    safe = _PLAIN[one] | ((one >= 0x80) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ((three < 0xE1) | (three > 0xE3)))
    begins = (data == 32) & safe
    begins[offsets[1:] - 1] = False
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins), np.append(safe, _PLAIN[data[-1]] if len(data) else True)


@dataclass
class Vocabulary:
    """Bytes of each id: data[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> Vocabulary:
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids + 1] - self.offsets[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[A.ranges(self.offsets[ids], self.lengths(ids))]


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers in a task, and the ids of segments met so far."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        table = _byte_level()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        level = lambda t: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
        self.a_vocab = Vocabulary.of([level(names.get(i, "")) for i in range(max(names) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_vocab = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)  # B merges across words
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _add(self, hashes: np.ndarray, raw: list[bytes], apart: np.ndarray) -> None:
        """Encode new segments. A takes all at once, as it has no token across their borders, and is cut by the bytes of its tokens;
        segments that end in what may be white space are encoded alone. B adds the space that each segment begins with."""
        order = np.argsort(apart, kind="stable")
        raw, joined = [raw[i] for i in order], len(raw) - int(apart.sum())
        ids = np.array(self.a.encode_batch_fast([b"".join(raw[:joined]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int32)
        places = np.searchsorted(np.cumsum(self.a_vocab.lengths(ids)), np.cumsum([len(r) for r in raw[:joined]]), "right") if joined else np.zeros(0, np.int64)
        rest = [self.a.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids for r in raw[joined:]]
        lists = self.b.encode([r[1:].decode("utf-8", "replace") for r in raw], num_threads=1)
        flat = lambda x: np.fromiter(chain.from_iterable(x), np.int32)
        for side, (got, ends) in enumerate([
            (np.concatenate([ids, flat(rest)]), np.concatenate([places, len(ids) + np.cumsum([len(x) for x in rest])])),
            (flat(lists), np.cumsum([len(x) for x in lists])),
        ]):
            self.first[side] = np.concatenate([self.first[side], len(self.ids[side]) + ends]).astype(np.int64)
            self.ids[side] = np.concatenate([self.ids[side], got])
        every, slot = np.concatenate([self.hashes, hashes[order]]), np.concatenate([self.slot, len(self.slot) + np.arange(len(raw))])
        order = np.argsort(every)
        self.hashes, self.slot = every[order], slot[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts, each of which begins with the added space, and where each text's begin.

        Segments are known by a 64-bit hash. If two shared one, the joined bytes of a text would differ from it: see ``alone``.
        """
        starts, safe = segments(data, offsets)
        if self.whole:
            starts = offsets[:-1]
        ends = np.append(starts[1:], len(data))
        h, at, inverse = np.unique(A.spans_hash(data, starts, ends, A.BYTE_BASE), return_index=True, return_inverse=True)
        new = ~np.isin(h, self.hashes)
        if len(self.hashes) + new.sum() > KEPT:
            self._clear()
            new[:] = True
        mine = at[new]
        self._add(h[new], [data[s:e].tobytes() for s, e in zip(starts[mine], ends[mine], strict=True)], ~safe[ends[mine]])
        slots = self.slot[np.searchsorted(self.hashes, h)][inverse]
        upto = np.searchsorted(starts, offsets)
        out = []
        for ids, first in zip(self.ids, self.first, strict=True):
            n = first[slots + 1] - first[slots]
            out.append((ids[A.ranges(first[slots], n)], np.concatenate([[0], np.cumsum(n)])[upto].astype(np.int64)))
        if len(self.ids[0]) + len(self.ids[1]) > 8 * KEPT:
            self._clear()  # long segments, which hardly return
        return out

    def alone(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one text, encoded whole."""
        return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int32), np.array(self.b.encode(text, num_threads=1), np.int32)


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Places in ``ends_a`` of all ends that A and B share, by divide and conquer.

    ``ends`` ascend over all documents; ``first`` is where each document's tokens begin, and the last ends of a document agree.
    """
    found = [first_a[1:] - 1]
    lo, hi, blo, bhi = first_a[:-1], first_a[1:] - 1, first_b[:-1], first_b[1:] - 1  # inner ends of A: lo to hi - 1
    while True:
        some = (hi > lo) & (bhi > blo)
        lo, hi, blo, bhi = lo[some], hi[some], blo[some], bhi[some]
        if not len(lo):
            return np.sort(np.concatenate(found))
        middle = (lo + hi) // 2
        cut, there = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        active, away = np.arange(len(lo)), 0
        while len(active):
            for at in (middle[active] + away, middle[active] - away)[: 1 + (away > 0)]:
                inside = (at >= lo[active]) & (at < hi[active]) & (cut[active] < 0)
                k, at = active[inside], at[inside]
                b = np.searchsorted(ends_b, ends_a[at])
                hit = (ends_b[b] == ends_a[at]) & (b < bhi[k])
                cut[k[hit]], there[k[hit]] = at[hit], b[hit]
            away += 1
            m = middle[active]
            active = active[(cut[active] < 0) & ((m + away < hi[active]) | (m - away >= lo[active]))]
        got = cut >= 0
        cut, there = cut[got], there[got]
        found.append(cut)
        pairs = lambda left, right: np.stack([left, right], axis=1).ravel()  # noqa: E731  intervals stay in order
        lo, hi = pairs(lo[got], cut + 1), pairs(cut, hi[got])
        blo, bhi = pairs(blo[got], there + 1), pairs(there, bhi[got])


class Aligned:
    """A unit of documents, aligned: a and b ids, where each document's tokens begin, and where each group's begin."""

    def __init__(self, enc: Encoders, texts: A.Texts):
        size = np.diff(texts.offsets)
        offsets = texts.offsets + np.arange(len(texts) + 1)  # each text behind a space
        data = np.full(int(offsets[-1]), 32, np.uint8)
        data[A.ranges(offsets[:-1] + 1, size)] = texts.data
        sides = enc.encode(data, offsets) if len(texts) else [(np.zeros(0, np.int32), np.zeros(1, np.int64))] * 2
        same = (size > 0) & self._same(enc, sides, data, offsets)
        again = np.flatnonzero((size > 0) & ~same)
        if len(again):  # texts that a tokenizer changes
            apart = [enc.alone(texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes().decode("utf-8", "replace")) for k in again]
            for side in (0, 1):
                ids, first = sides[side]
                parts = np.split(ids, first[1:-1])
                for k, both in zip(again, apart, strict=True):
                    parts[k] = both[side]
                sides[side] = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            same = (size > 0) & self._same(enc, sides, data, offsets)
        (a, fa), (b, fb) = sides
        self.ids, kept = texts.ids, np.flatnonzero(same)
        self.a, self.first_a = self._only(a, fa, same)
        self.b, self.first_b = self._only(b, fb, same)
        ends_a, ends_b = np.cumsum(enc.a_vocab.lengths(self.a)), np.cumsum(enc.b_vocab.lengths(self.b))
        at = cuts(ends_a, ends_b, self.first_a[np.append(kept, len(size))], self.first_b[np.append(kept, len(size))]) if len(kept) else np.zeros(0, np.int64)
        self.end_a = at + 1
        self.end_b = np.searchsorted(ends_b, ends_a[at]) + 1
        self.end_byte = ends_a[at]
        self.doc = np.searchsorted(self.first_a, at, "right") - 1

    @staticmethod
    def _same(enc: Encoders, sides: list, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the tokens of both sides give a text back."""
        size = np.diff(offsets)
        same = np.ones(len(size), bool)
        for vocab, (ids, first) in zip((enc.a_vocab, enc.b_vocab), sides, strict=True):
            same &= np.diff(np.concatenate([[0], np.cumsum(vocab.lengths(ids))])[first]) == size
        for vocab, (ids, first) in zip((enc.a_vocab, enc.b_vocab), sides, strict=True):
            kept = np.flatnonzero(same)
            got = vocab.joined(ids[A.ranges(first[kept], np.diff(first)[kept])])
            differs = np.flatnonzero(got != data[A.ranges(offsets[kept], size[kept])])
            if len(differs):
                same[kept[np.searchsorted(np.cumsum(size[kept]), differs, "right")]] = False
        return same

    @staticmethod
    def _only(ids: np.ndarray, first: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.where(same, np.diff(first), 0)
        return ids[A.ranges(first[:-1], n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B in each group."""
        return np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)

    def group_span(self) -> np.ndarray:
        """Where each document's groups begin."""
        return np.searchsorted(self.doc, np.arange(len(self.ids) + 1))

    def digests(self, written: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups as text; empty without tokens. ``written``: ids behind a comma, a bar, a semicolon."""
        na, nb = self.sizes()
        total = np.cumsum(na + nb)
        start = total - na - nb
        out = np.empty(int(total[-1]) if len(total) else 0, object)
        for ids, n, at, sign in ((self.a, na, start, 2), (self.b, nb, start + na, 1)):
            place = A.ranges(at, n)
            out[place] = written[0][ids]
            head = np.cumsum(n) - n
            out[at] = written[sign][ids[head]]
        docs = self.group_span()
        pieces, sums = out.tolist(), np.concatenate([[0], total])
        return [hashlib.sha256(b"".join(pieces[sums[i] : sums[j]])[1:]).hexdigest() if j > i else "" for i, j in zip(docs[:-1], docs[1:], strict=True)]

    def links(self, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(document and pair as one number, times): how often a document links a pair of ids; a pair is a * n_b + b."""
        na, nb = self.sizes()
        span = (int(self.a.max()) + 1 if len(self.a) else 1) * n_b
        total = na * nb
        slim = np.flatnonzero(total <= WIDE)
        g = np.repeat(slim, total[slim])
        k = A.ranges(np.zeros(len(slim), np.int64), total[slim])
        i, j = np.divmod(k, nb[g])
        pairs = self.a[(self.end_a - na)[g] + i] * n_b + self.b[(self.end_b - nb)[g] + j]
        keys, times = np.unique(self.doc[g] * span + pairs, return_counts=True)
        parts, counts = [keys], [times]
        for g in np.flatnonzero(total > WIDE):
            x, cx = np.unique(self.a[self.end_a[g] - na[g] : self.end_a[g]], return_counts=True)
            y, cy = np.unique(self.b[self.end_b[g] - nb[g] : self.end_b[g]], return_counts=True)
            parts.append((self.doc[g] * span + x[:, None] * n_b + y[None, :]).ravel())
            counts.append((cx[:, None] * cy[None, :]).ravel())
        if len(parts) > 1:
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, inverse, np.concatenate(counts))
        doc, pair = np.divmod(keys, span)
        return np.stack([doc, pair]), times


@dataclass
class Files:
    """Contents of the two vocabulary files."""

    a_json: str
    b_model: bytes

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Files:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


GROUPS = "doc_id long, a array<int>, b array<int>, groups array<struct<a_end:int,b_end:int,byte_end:long>>"


def groups(docs: DataFrame, files: Files) -> DataFrame:
    """Tokens and groups of every document: ids of A and of B, and for each group where its tokens and its bytes end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoders(files.a_json, files.b_model)
        for texts in A.units(batches, UNIT):
            u = Aligned(enc, texts)
            spans = u.group_span()
            doc = u.doc
            byte_first = np.concatenate([[0], u.end_byte])[spans[doc]]
            ends = pa.StructArray.from_arrays([pa.array((u.end_a - u.first_a[doc]).astype(np.int32)), pa.array((u.end_b - u.first_b[doc]).astype(np.int32)), pa.array(u.end_byte - byte_first)], ["a_end", "b_end", "byte_end"])
            lists = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), v) for f, v in ((u.first_a, pa.array(u.a.astype(np.int32))), (u.first_b, pa.array(u.b.astype(np.int32))), (spans, ends))]
            yield pa.RecordBatch.from_arrays([pa.array(u.ids, mask=u.ids == NO_ID), *lists], ["doc_id", "a", "b", "groups"])

    return _rows(docs).mapInArrow(run, GROUPS)


def units(docs: DataFrame, files: Files) -> DataFrame:
    """(unit, n_b, pairs, docs): a row for each unit, packed: pairs with the unit's documents that link them, and the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoders(files.a_json, files.b_model)
        task, n_b = TaskContext.get(), len(enc.b_vocab)
        numbers = [str(i).encode() for i in range(max(len(enc.a_vocab), n_b))]
        written = tuple(np.array([sign + x for x in numbers], object) for sign in (b",", b"|", b";"))
        for k, texts in enumerate(A.units(batches, UNIT)):
            u = Aligned(enc, texts)
            (doc, pair), times = u.links(n_b)
            known, which = np.unique(pair, return_inverse=True)
            shas = b"".join(bytes.fromhex(s) if s else bytes(32) for s in u.digests(written))
            body = A.pack(u.ids, np.diff(u.first_a), np.diff(u.first_b), np.diff(u.group_span()), np.searchsorted(doc, np.arange(len(u.ids) + 1)), which.astype(np.int32), times.astype(np.int32 if times.max(initial=0) < 1 << 31 else np.int64), np.frombuffer(shas, np.uint8))
            unit = (task.partitionId() << 32) | k
            yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([n_b]), pa.array([A.pack(known, np.bincount(which, minlength=len(known)).astype(np.int32))], pa.binary()), pa.array([body], pa.binary())], ["unit", "n_b", "pairs", "docs"])

    return _rows(docs).mapInArrow(run, "unit long, n_b long, pairs binary, docs binary")


def unit_pairs(made: DataFrame) -> DataFrame:
    """(unit, n_b, pair, n): in how many documents of a unit a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, n_b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                pair, n = A.unpack(blob.as_py())
                same = [pa.array(np.full(len(pair), x)) for x in (unit, n_b)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(pair), pa.array(n)], ["unit", "n_b", "pair", "n"])

    return made.select("unit", "n_b", "pairs").mapInArrow(run, "unit long, n_b long, pair long, n int")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): documents that link a pair corpus-wide, and whether its A id has no pair of more."""
    total = unit_pairs(made).groupBy("pair", "n_b").agg(F.sum("n").alias("n"))
    ids = total.select("pair", F.expr("pair div n_b").alias("a_id"), (F.col("pair") % F.col("n_b")).alias("b_id"), "n")
    # An A id has at most as many rows as B's vocabulary.
    return ids.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a_id")))


def figures(made: DataFrame, counts: DataFrame) -> DataFrame:
    """The row of every document: its tokens, groups and links, and what the corpus-wide counts say of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_a, n_b, n_groups, first, which, times, shas = A.unpack(batch.column(0)[row].as_py())
                met = batch.column(1)[row].values
                pair, n, best = (np.asarray(met.field(f).cast(pa.int64())) if met is not None else np.zeros(0, np.int64) for f in range(3))
                order = np.argsort(pair)
                n, best = n[order], best[order]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                times = times.astype(np.int64)
                sha = [shas[32 * i : 32 * i + 32].tobytes().hex() if c else "" for i, c in enumerate(n_a)]
                out = [n_a, n_b, n_groups, sums(times), sums(times * best[which]), sums(times * n[which])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *(pa.array(x, pa.int64()) for x in out), pa.array(sha, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    met = unit_pairs(made).join(counts.select("pair", F.col("n").alias("all"), "best"), "pair")
    met = met.groupBy("unit").agg(F.collect_list(F.struct("pair", "all", "best")).alias("met"))  # bounded by the unit's bytes
    rows = made.select("unit", "docs").join(met, "unit", "left").select("docs", F.coalesce("met", F.array().cast("array<struct<pair:bigint,all:bigint,best:boolean>>")).alias("met"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, files: Files) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"
    units(docs, files).write.parquet(f"{path}/units")  # unit numbers are made by tasks: what follows reads one written version of them
    made = spark.read.parquet(f"{path}/units")
    pair_counts(made).write.parquet(f"{path}/counts")
    return figures(made, spark.read.parquet(f"{path}/counts"))

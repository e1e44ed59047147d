"""Array helpers for tasks that read texts: rolling hashes over bytes and words, and packed blobs for the shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

U64 = np.uint64
_DELIM = np.zeros(256, bool)
_DELIM[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(16)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, step: int = 1 << 19) -> np.ndarray:
    """Hash of values[s:e] for every span; starts ascend. Works through the values in pieces, so tables stay small."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        hi = max(at + 1, int(np.searchsorted(starts, lo + step)))
        s, e = starts[at:hi] - lo, ends[at:hi] - lo
        n = int(e.max())
        sums = np.zeros(n + 1, U64)
        np.cumsum((values[lo : lo + n].astype(U64) + U64(1)) * powers(base, n), out=sums[1:])
        out[at:hi] = mix((sums[e] - sums[s]) * powers(inverse(base), n + 1)[s] + (e - s).astype(U64))
        at = hi
    return out


class Texts:
    """A unit of documents: their bytes one after another, and their ids in the order given."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Texts:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
        if texts.null_count:  # what lies under a null isn't text
            lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            keep = np.repeat(np.asarray(texts.is_valid()), np.diff(offsets))
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(lengths)])
        return cls(np.asarray(ids.cast(pa.int64())), data, (offsets - offsets[0]).astype(np.int64))

    def take(self, rows: np.ndarray) -> Texts:
        lengths = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return Texts(self.ids[rows], self.data[ranges(self.offsets[rows], lengths)], offsets)

    def words(self, gaps: np.ndarray = _DELIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the row of each; ``gaps`` tells the bytes that lie between words."""
        gap = gaps[self.data]
        first = np.zeros(len(gap) + 1, bool)
        first[self.offsets[:-1]] = True
        first = first[:-1] if len(gap) else first[:0]
        begin = np.ones(len(gap), bool)
        begin[1:] = gap[:-1]
        starts = np.flatnonzero(~gap & (begin | first))
        end = np.ones(len(gap), bool)
        end[:-1] = gap[1:] | first[1:]
        ends = np.flatnonzero(~gap & end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def pack(self) -> bytes:
        return pack(self.ids, self.offsets, self.data)

    @classmethod
    def unpack(cls, blob: bytes) -> Texts:
        ids, offsets, data = unpack(blob)
        return cls(ids, data, offsets)

    @classmethod
    def join(cls, parts: list[Texts]) -> Texts:
        lengths = np.concatenate([np.diff(p.offsets) for p in parts])
        return cls(np.concatenate([p.ids for p in parts]), np.concatenate([p.data for p in parts]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def units(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[Texts]:
    """Documents of (id, text) batches in units of about ``size`` bytes, ordered by id; a longer text is a unit alone.

    Rows without an id count as one document smaller than all others.
    """
    held: list[Texts] = []
    n = 0
    for batch in batches:
        ids = pc.fill_null(batch.column(0).cast(pa.int64()), -(1 << 63))
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_binary())), 0))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size - n, "right")))
            held.append(Texts.of(ids.slice(at, to - at), batch.column(1).slice(at, to - at)))
            n += int(ends[to - 1]) - done
            at = to
            if n >= size or at < batch.num_rows:
                whole = Texts.join(held)
                yield whole.take(np.argsort(whole.ids, kind="stable"))
                held, n = [], 0
    if held:
        whole = Texts.join(held)
        yield whole.take(np.argsort(whole.ids, kind="stable"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; ascending whole numbers are stored as differences, by planes of bytes."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        body = a
        ordered = a.dtype.kind in "iu" and a.itemsize == 8 and len(a) > 1
        if ordered:
            body = np.concatenate([a[:1], np.diff(a)])
        raw = body.tobytes() if body.itemsize == 1 else np.ascontiguousarray(body.view(np.uint8).reshape(-1, body.itemsize).T).tobytes()
        parts += [np.array([ord(a.dtype.kind), a.itemsize, len(a), ordered], np.int64).tobytes(), raw]
    return zstandard.ZstdCompressor(3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (count,), at, out = np.frombuffer(raw[:8], np.int64), 8, []
    for _ in range(count):
        kind, width, n, ordered = (int(x) for x in np.frombuffer(raw[at : at + 32], np.int64))
        at += 32
        dtype = np.dtype(f"{chr(kind)}{width}")
        planes = np.frombuffer(raw[at : at + n * width], np.uint8)
        at += n * width
        a = planes.view(dtype) if width == 1 else np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(dtype)
        out.append(np.cumsum(a, dtype=dtype) if ordered else a)
    return out


def by_key(keys: np.ndarray, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Every key with the positions that hold it, in their order."""
    at = np.argsort(keys, kind="stable") if order is None else order
    s = keys[at]
    if not len(s):
        return
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
        yield int(s[a]), at[a:b]


BLOBS = "key int, kind int, blob binary"
_BLOBS = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def blobs(rows: Iterator[tuple[int, int, bytes]], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (key, kind, blob) rows."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[2])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _BLOBS, strict=True)], schema=_BLOBS)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _BLOBS, strict=True)], schema=_BLOBS)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The blobs of every key by kind, from batches sorted by key."""
    now, held = None, {}
    for batch in batches:
        for key, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


#: Bytes of text for one key and for one partition of the shuffle, and the fewest keys.
KEY_BYTES, PARTITION_BYTES, KEYS = 8 << 20, 64 << 20, 32


def key_count(docs: DataFrame) -> tuple[int, int]:
    """(keys, partitions) in proportion to the bytes of text.

    Every unit of documents sends a packed row to nearly every key, so there are at most four keys a partition: rows of the shuffle
    grow with units times partitions, as those of any shuffle do.
    """
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    return min(max(KEYS, -(-total // KEY_BYTES)), max(KEYS, 4 * partitions)), partitions


def home(ids: np.ndarray, n: int) -> np.ndarray:
    """The key of the documents with these ids, below n."""
    return (mix(ids.astype(U64)) % U64(n)).astype(np.int64)

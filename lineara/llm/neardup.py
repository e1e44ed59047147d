"""Near-duplicate groups by MinHash bands, odd sketches and full sets.

A document's set holds its distinct five-word shingles (A-Z lower-cased); two documents are linked when their Jaccard
similarity is at least a percentage. Groups are the connected components of all links.

Method.
1. One pass over the texts gives each document 192 MinHash samples, folded twice: into 32 band hashes of six samples, and into
   an odd sketch, a bitmap in which every sample flips one bit. The exclusive or of two sketches has about as many ones as
   the samples differ in, which at high similarity tells the similarity closely.
2. Equal sets (128-bit fingerprints of whole sets) become one class with its smallest id; groups of copies end here.
3. Each band bucket names leaders (its smallest class, and its hub, the class with most company in all its buckets); a class is a
   candidate with its first leader and with its HUBS strongest hubs. Candidates whose sketches are far apart are dropped, the others are confirmed on full
   sets: the leader's set meets its members', in salted groups of bounded size.
4. Confirmed links give components. A bucket whose classes are in one component is done. In those that still hold several, the
   open ones, members of different components are compared by sketch, in pairs of bounded blocks, and confirmed on full sets on the
   spot, so only links leave the task. Open buckets that share a member form one cluster, so a text goes to one cluster however many
   open buckets it has. No pair that shares a bucket is left out, and pairs that are connected already are not compared. A pair at
   the least similarity shares no bucket with a chance of 3e-7 (85 %) or 6e-5 (80 %); unlike documents (30 %) share one in 2 % of pairs.
5. Components again, over all confirmed links.

Defined results: no words or null text: an empty set, linked with nothing; fewer than five words: the whole sequence is the one
shingle; rows without an id are never linked and have no component, but are kept; rows with one id and different texts count as
linked; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import components
from ..session import shared_dir
from . import arrays as A
from .arrays import U64, Texts

SHINGLE = 5
SAMPLES, BANDS, ROWS = 192, 32, 6
SKETCH_WORDS = 8
#: A candidate is dropped when its estimate is this far below the least similarity (over five standard deviations).
SLACK = 0.25
#: Hubs that a class is compared with before the blocks of step 4, which take in all other pairs.
HUBS = 3
#: Members of a leader, or of a cluster's block, in one group, and shingles of a block.
GROUP, BLOCK_SHINGLES = 2000, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240101)
_MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
_SEED = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ordered by document and hash, and where each document's begin."""
    low = Texts(texts.ids, _LOWER[texts.data], texts.offsets)
    starts, ends, row = low.words()
    h = A.spans_hash(low.data, starts, ends, A.BYTE_BASE)
    n = np.bincount(row, minlength=len(texts)).astype(np.int64)
    first = np.cumsum(n) - n
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = A.ranges(first, count)
    doc = np.repeat(np.arange(len(texts)), count)
    h = A.spans_hash(h, at, at + np.minimum(n[doc], SHINGLE), A.WORD_BASE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))]).astype(np.int64)


def samples(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples (SAMPLES, documents); every document has a shingle. In pieces that stay in the cache."""
    out = np.empty((SAMPLES, len(first) - 1), U64)
    at = 0
    while at < out.shape[1]:
        to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 15), "right")) - 1)
        x, cut = h[first[at] : first[to]], first[at:to] - first[at]
        for i in range(SAMPLES):
            out[i, at:to] = np.minimum.reduceat(x * _MULTIPLY[i], cut)
        at = to
    return out


def fold(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents, BANDS) and odd sketches (documents, SKETCH_WORDS)."""
    n = mins.shape[1]
    bands = np.zeros((n, BANDS), U64)
    for b in range(BANDS):
        for i in range(b * ROWS, (b + 1) * ROWS):
            bands[:, b] = A.mix(bands[:, b] ^ mins[i]) + U64(b)
    sketch = np.zeros((n, SKETCH_WORDS), U64)
    every = np.arange(n)
    for i in range(SAMPLES):
        bit = A.mix(mins[i] ^ _SEED[i]) >> U64(55)  # of 512
        sketch[every, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
    return bands, sketch


SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>, bands array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _nested(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(a).reshape(-1).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for unit in A.units(batches, 2 << 20):
        h, first = shingles(unit)
        n = np.diff(first)
        has = np.flatnonzero(n)
        fp = np.zeros((2, len(unit)), U64)
        sketch, bands = np.zeros((len(unit), SKETCH_WORDS), U64), np.zeros((len(unit), BANDS), U64)
        if len(has):
            bands[has], sketch[has] = fold(samples(h, np.concatenate([first[has], first[-1:]])))
            for k in range(2):
                fp[k, has] = np.add.reduceat(A.mix(h ^ _SEED[k]), first[has])
        ids = pa.array(unit.ids, mask=unit.ids == -(1 << 63))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), _nested(sketch), _nested(bands)], schema=_SIGNED)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(3)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([z.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "z"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        leader, group, own = None, None, None

        def of(blob: bytes) -> np.ndarray:
            data = np.frombuffer(z.decompress(blob), np.uint8)
            return shingles(Texts(np.zeros(1, np.int64), data, np.array([0, len(data)])))[0]

        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 200):
                for r in batch.slice(at, 200).to_pylist():
                    key = (r["leader"], r["salt"])
                    if r["leads"]:
                        group, leader, own = key, r["doc_id"], of(r["z"])
                    elif key == group:
                        other = of(r["z"])
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            out.append((leader, r["doc_id"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def packed(texts: DataFrame) -> DataFrame:
    """(doc_id, z): the texts compressed, which is what the shuffles carry."""
    return texts.where("doc_id is not null").mapInArrow(_compress, "doc_id long, z binary")


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts`` has (doc_id, text)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("n"))
    members = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), F.lit(False).alias("leads"))
    leaders = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(True).alias("leads"))
    rows = packed(texts).join(members.unionByName(leaders), "doc_id").repartition(n, "leader", "salt")
    return rows.sortWithinPartitions("leader", "salt", F.desc("leads")).mapInArrow(_confirm(percent), "a long, b long")


def _most(least: float) -> int:
    """Ones that the exclusive or of two sketches has at the similarity ``least``."""
    bits = 64 * SKETCH_WORDS
    flips = 2 * SAMPLES * (1 - least)  # of the samples that differ
    return int(np.ceil(bits / 2 * (1 - np.exp(-2 * flips / bits))))


def near(x: Column, y: Column, least: float) -> Column:
    """Whether two odd sketches tell a similarity of ``least`` or more."""
    ones = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    return ones <= _most(least)


def _compare(percent: int, least: float):
    most = _most(least)

    def pairs(held: list[tuple]) -> Iterator[tuple[int, int]]:
        ids, comp, right = (np.array([r[k] for r in held]) for k in range(3))
        sketch = np.array([r[3] for r in held]).view(U64)
        z = zstandard.ZstdDecompressor()
        texts = [z.decompress(r[4]) for r in held]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        h, first = shingles(Texts(ids, np.frombuffer(b"".join(texts), np.uint8), offsets))
        _, h = np.unique(h, return_inverse=True)
        n, mark = np.diff(first), np.zeros(int(h.max(initial=0)) + 1, bool)
        one = not right.any()  # a block against itself
        x = np.flatnonzero(~right)
        y = x if one else np.flatnonzero(right)
        for i in x:
            rest = y[(comp[y] != comp[i]) & ((y > i) | (not one))]
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1) <= most]
            if len(rest):
                own = h[first[i] : first[i + 1]]
                mark[own] = True
                both = np.add.reduceat(mark[h[A.ranges(first[rest], n[rest])]].astype(np.int64), np.cumsum(n[rest]) - n[rest])
                mark[own] = False
                for k in rest[100 * both >= percent * (n[i] + n[rest] - both)]:
                    yield int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (found := list(pairs(held))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for cluster, i, j, *row in zip(*(part.column(k).to_pylist() for k in range(8)), strict=True):
                    if (cluster, i, j) != now:
                        yield from flush(held)
                        now, held = (cluster, i, j), []
                    held.append(row)
        yield from flush(held)

    return run


def across(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of one cluster, near by sketch and confirmed on full sets.

    ``members``: doc_id, cluster, component, n_shingles, sketch. A cluster of more than GROUP members or BLOCK_SHINGLES shingles is cut
    into blocks, and each pair of blocks is a group of its own, so groups are bounded however large a cluster is.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(GROUP), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("_k"))
    rows = members.join(sizes, "cluster").withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.col("_k")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select("doc_id", "cluster", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "component", (F.col("_i") > F.col("_j")).alias("right"), "sketch")
    rows = packed(texts).join(rows, "doc_id").select("cluster", "i", "j", "doc_id", "component", "right", "sketch", "z")
    return rows.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_compare(percent, percent / 100 - SLACK), "a long, b long")


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    shared = shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = f"{shared}/signed-{uuid.uuid4().hex}"
    texts.mapInArrow(_sign, SIGNED).write.parquet(path)
    signed = spark.read.schema(SIGNED).parquet(path)
    least = percent / 100 - SLACK

    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = classes.checkpoint()
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2", "n_shingles"), ["doc_id", "fp1", "fp2", "n_shingles"], "left_semi")
    sketches = reps.select("doc_id", "n_shingles", "sketch")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))

    # Leaders: the smallest class of a bucket, and its hub, the class that meets most others in all its buckets.
    lead = buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = buckets.join(lead, "bucket").checkpoint()
    score = held.groupBy("doc_id").agg(F.sum("n").alias("score"))
    hub = held.join(score, "doc_id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("hub"))
    # One row a class: it has at most BANDS buckets, so its leaders fit in a short array.
    led = held.join(hub, "bucket").groupBy("doc_id").agg(F.min("low").alias("first"), F.collect_set("low").alias("lows"), F.sort_array(F.collect_set("hub"), False).alias("hubs")).checkpoint()
    own = F.array_distinct(F.concat(F.array("first"), F.transform(F.slice("hubs", 1, HUBS), lambda h: -h["minus"])))
    pairs = led.select("doc_id", F.explode(own).alias("x")).where("x <> doc_id")
    pairs = pairs.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct().checkpoint()

    def sketched(p: DataFrame, side: str) -> DataFrame:
        return p.join(sketches.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"s{side}")), side)

    passed = sketched(sketched(pairs, "a"), "b").where(near(F.col("sa"), F.col("sb"), least)).select("a", "b")
    links = confirmed(texts, passed, percent).checkpoint()
    labels = components(links)

    # Open buckets still hold several components; what chains of them connect is a cluster, named by its smallest class.
    placed = held.select("doc_id", "bucket", "low").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = placed.select("doc_id", "bucket", "low", F.coalesce("component", "doc_id").alias("component")).checkpoint()
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    members = placed.join(open_, "bucket").groupBy("doc_id").agg(F.min("low").alias("first"), F.collect_set("low").alias("lows"), F.first("component").alias("component")).checkpoint()
    if members.isEmpty():
        return _result(signed, classes, labels)
    # Every member hangs on its first leader, so only leaders need to be connected.
    chains = members.select(F.col("first").alias("a"), F.explode("lows").alias("b")).where("a <> b").distinct()
    heads = components(chains).select(F.col("id").alias("first"), F.col("component").alias("head"))
    split = members.join(heads, "first", "left").select("doc_id", F.coalesce("head", "first").alias("cluster"), "component")
    more = across(texts, split.join(sketches, "doc_id"), percent).checkpoint()
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    return _result(signed, classes, labels)


def _result(signed: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    found = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(found, ["fp1", "fp2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))

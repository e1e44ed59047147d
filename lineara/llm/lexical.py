"""Ranked lexical search: a stated set of items against all documents, by dense products of blocks.

Method. The items' terms are the vocabulary. One scan of the documents packs each unit of about four megabytes into a tile: for every
document its number of terms and how often it holds each term of the vocabulary. From the tiles come the corpus figures (documents,
terms, documents by term). Then every tile is multiplied: rows of items times weights (a block of ``TILE_ITEMS`` items has a compact
vocabulary of its own) times columns of document impacts, in float64 by BLAS. The terms of a block are cut so that no partial sum can
reach 2 ** 53, which keeps float64 exact; the parts are added up as 64-bit integers.

Top rows are kept by tile and task: the score at rank k is found, all documents that reach it are taken, ties included, and ordered by
score and id before the cut. Spark then ranks what the tasks kept, first by salted parts of an item and then by item.

Terms of documents meet the vocabulary by a 64-bit hash and are then compared byte by byte. Items come in blocks of about
``ITEM_TERMS`` terms: only one block is on the driver and in the tasks at a time, and each is one more scan.

Defined results: null or empty texts have no terms; documents without terms count in no figure and are never ranked; items without
terms have no rows. A row is a document of its own even if its id or text repeats, and so is an item's row. Rows without doc_id rank
before others of their score. No documents or no items give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir
from . import arrays as A

K = 20
#: Terms of the items of one block, which bounds what is broadcast.
ITEM_TERMS = 1 << 20
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 64, 1024, 4096
#: Whole numbers below it are exact in float64; an impact is below IMPACT.
EXACT, IMPACT = 1 << 53, 1_000_000
#: Parts of an item's rows that are ranked on their own first.
PARTS = 32
NO_ID = -(1 << 63)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_GAPS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_ASCII_LOWER))


@dataclass
class Block:
    """Items and their vocabulary, ordered by hash: term t is data[offsets[t]:offsets[t + 1]]; counts are (item, term, repeats)."""

    ids: list
    base: int
    hashes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Block:
        found = [terms_of(text) for _, text in rows]
        words = sorted({t for terms in found for t in terms})
        raw = [w.encode() for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        base = A.WORD_BASE
        while len(np.unique(hashes := A.spans_hash(data, offsets[:-1], offsets[1:], base))) < len(words):
            base += 2  # terms of the vocabulary never share a hash
        order = np.argsort(hashes)
        place = {words[t]: i for i, t in enumerate(order.tolist())}
        lengths = np.diff(offsets)[order]
        item = np.repeat(np.arange(len(rows)), [len(t) for t in found])
        term = np.array([place[t] for terms in found for t in terms], np.int64)
        pair, repeats = np.unique(item * max(1, len(words)) + term, return_counts=True)
        item, term = np.divmod(pair, max(1, len(words)))
        return cls([i for i, _ in rows], base, hashes[order], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), data[A.ranges(offsets[:-1][order], lengths)], item, term, repeats)

    def counts(self, texts: A.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each document, and (document, term, times) of the vocabulary."""
        data = _LOWER[texts.data]
        starts, ends, row = texts.words(_GAPS)
        n = np.bincount(row, minlength=len(texts)).astype(np.int64)
        h = A.spans_hash(data, starts, ends, self.base)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (np.diff(self.offsets)[at] == ends - starts))
        at, size = at[hit], (ends - starts)[hit]
        differ = data[A.ranges(starts[hit], size)] != self.data[A.ranges(self.offsets[at], size)]
        good = np.ones(len(hit), bool)
        if differ.any():
            good[np.repeat(np.arange(len(hit)), size)[differ]] = False
        pair, times = np.unique(row[hit][good] * len(self.hashes) + at[good], return_counts=True)
        doc, term = np.divmod(pair, len(self.hashes))
        return n, doc, term, times


def blocks(items: DataFrame, most: int) -> Iterator[Block]:
    """Items in blocks of about ``most`` terms, by hash; rows that hold a term are counted before anything is collected."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(f"({TERM})"))))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        got = sorted(((r["item_id"], r["text"]) for r in mine.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        block = Block.of(got)
        if len(block.hashes):
            yield block


TILES = "docs long, terms long, term array<int>, df array<int>, tile binary"


def tiles(docs: DataFrame, block: Block) -> DataFrame:
    """Documents packed with what they hold of the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in A.units(batches):
            n, doc, term, times = block.counts(texts)
            seen, df = np.unique(term, return_counts=True)
            some = np.unique(doc)  # documents that hold nothing of the vocabulary can't score
            tile = A.pack(texts.ids[some], n[some], np.searchsorted(some, doc).astype(np.int32), term.astype(np.int32), times)
            lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (seen, df)]
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), *lists, pa.array([tile], pa.binary())], ["docs", "terms", "term", "df", "tile"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TILES)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(times: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Impact of a term that a document of this length holds so many times; below IMPACT."""
    m = 100 - 25 + (25 * length * n) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def products(block: Block, weight: np.ndarray) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each tile of items its first item and its parts: (terms, float64 weights of items by terms), cut below the exact bound."""
    out = []
    most = EXACT // IMPACT - 1
    for first in range(0, len(block.ids), TILE_ITEMS):
        mine = (block.item >= first) & (block.item < first + TILE_ITEMS)
        vocab, col = np.unique(block.term[mine], return_inverse=True)
        dense = np.zeros((min(TILE_ITEMS, len(block.ids) - first), len(vocab)), np.int64)
        dense[block.item[mine] - first, col] = block.repeats[mine] * weight[block.term[mine]]
        parts = []
        while len(vocab):
            part = np.minimum(dense, most)  # a larger weight is given in several parts
            upto = np.cumsum(part.max(axis=0))
            at = 0
            while at < len(vocab):
                done = int(upto[at - 1]) if at else 0
                to = min(at + TILE_TERMS, max(at + 1, int(np.searchsorted(upto, done + most, "right"))))
                parts.append((vocab[at:to], part[:, at:to].astype(np.float64)))
                at = to
            dense = dense - part
            left = np.flatnonzero(dense.any(axis=0))
            vocab, dense = vocab[left], dense[:, left]
        out.append((first, parts))
    return out


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id; all that reach the k-th score take part before the cut."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def best(tiles: DataFrame, block: Block, weight: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in every task."""
    schedule = products(block, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        column = np.full(len(block.hashes), -1, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                ids, length, doc, term, times = A.unpack(blob.as_py())
                impact = impacts(times, length[doc], n, total).astype(np.float64)
                for lo in range(0, len(ids), TILE_DOCS):
                    a, b = np.searchsorted(doc, [lo, lo + TILE_DOCS])
                    here, rows, some, value = ids[lo : lo + TILE_DOCS], doc[a:b] - lo, term[a:b], impact[a:b]
                    for first, parts in schedule:
                        scores = np.zeros((len(parts[0][1]) if parts else 0, len(here)), np.int64)
                        for vocab, dense in parts:
                            column[vocab] = np.arange(len(vocab))
                            col = column[some]
                            column[vocab] = -1
                            hit = col >= 0
                            right = np.zeros((len(vocab), len(here)))
                            right[col[hit], rows[hit]] = value[hit]
                            scores += (dense @ right).astype(np.int64)
                        for i, line in enumerate(scores):
                            if not line.any():
                                continue
                            s, d = held.get(first + i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            if len(s) == k and line.max() < s[-1]:
                                continue
                            s, d = np.concatenate([s, line]), np.concatenate([d, here])
                            top = first_k(s, d, k)
                            held[first + i] = s[top], d[top]
        if held:
            item = np.repeat(list(held), [len(s) for s, _ in held.values()])
            out = [item.astype(np.int32), np.concatenate([d for _, d in held.values()]), np.concatenate([s for s, _ in held.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["item", "doc_id", "score"])

    found = tiles.select("tile").mapInArrow(run, "item int, doc_id long, score long")
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for keys in (["item", "part"], ["item"]):
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item."""
    spark = docs.sparkSession
    out = []
    for number, block in enumerate(blocks(items, item_terms)):
        path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}/{number}"
        tiles(docs, block).write.parquet(path)
        made = spark.read.parquet(path)
        figures = made.agg(F.sum("docs").alias("n"), F.sum("terms").alias("total")).first()
        if not figures["n"]:
            continue
        pairs = made.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
        df = np.zeros(len(block.hashes), np.int64)
        for r in pairs.toLocalIterator():  # at most the block's vocabulary
            df[r["term"]] = r["df"]
        found = best(made, block, weights(figures["n"], df), figures["n"], figures["total"], k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, pa.int64())}))
        out.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else empty

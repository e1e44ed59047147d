"""Language identification by rank-order profiles.

Method. Letters of a text, lower-cased, form words; a word with a gap on either side gives its n-grams of one to three characters. A
document's profile is its ``PLACES`` most frequent n-grams, a language's profile the same over all texts it is learned from. The
out-of-place distance of the two adds up, over the document's n-grams, how far the places differ, or ``PLACES`` where the language's
profile lacks the n-gram. The language of the smallest distance is the prediction. N-grams of equal frequency share the mean of their
places, so that no order of characters decides between them.

N-grams are whole numbers (three code points of 21 bits), so no hash can collide. Learning counts all rows it may use: tasks add up
n-grams by language before the shuffle, and only the first places of each language are kept, cut in every task before they meet
(``row_number`` with a limit). Only profiles, ``PLACES`` rows a language, come to the driver; more than ``LANGUAGES`` languages are an
error, which bounds what is sent to the tasks. Texts are counted in pieces of ``PIECE`` characters, so a long one needs no more memory
than its own counts.

Defined results: null text, or one without letters, is ``und`` with score 0; so is any text if nothing was learned. Equal distances
go to the language that sorts first. A row without doc_id has no remainder: held_out is null, and nothing is learned from it; nor is
anything learned from a null lang. Rows repeated count as often as they stand and are predicted alike. No rows give no rows. Extra
columns are ignored. ``score`` is 1 less the distance as a share of the largest possible one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Places of a profile, and most languages.
PLACES, LANGUAGES = 400, 4096
#: Characters counted at once, and distinct n-grams of one language held by a task before they are sent on.
PIECE, HELD = 1 << 20, 1 << 18
#: Parts of a language's n-grams that are ranked on their own first.
PARTS = 64
FOLDS = 5
GAP = (1 << 21) - 1
_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or GAP."""
    out = np.full(0x110000, GAP, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _grams(points: np.ndarray) -> np.ndarray:
    """All n-grams of code points that begin and end with a gap; gaps don't repeat."""
    p = points.astype(_U)
    b = p[1:-1]
    letter = b != GAP
    one = b[letter]
    two = (p[:-1] << _U(21)) | p[1:]  # a gap and a letter, or two letters: gaps never follow each other
    three = ((p[:-2] << _U(42)) | (b << _U(21)) | p[2:])[letter]
    return np.concatenate([one, two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and how often each occurs."""
    keys, times = np.zeros(0, _U), np.zeros(0, np.int64)
    table, carry = _letters(), np.array([GAP], np.uint32)
    for at in range(0, len(text), PIECE):
        last = at + PIECE >= len(text)
        points = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([carry, points, np.full(int(last), GAP, np.uint32)])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != GAP) | (points[:-1] != GAP)
        points = points[keep]
        if not last:  # the next piece begins at this one's last gap, so no word is cut
            cut = int(np.flatnonzero(points == GAP)[-1])
            carry, points = points[cut:], points[: cut + 1]
        if len(points) > 2:
            k, n = np.unique(_grams(points), return_counts=True)
            keys, times = merged([keys, k], [times, n]) if len(keys) else (k, n)
    return keys, times


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(times), len(k)).astype(np.int64)


def places(keys: np.ndarray, times: np.ndarray, most: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, ties by n-gram, and their places from 1; n-grams of equal frequency share the mean of their places."""
    if len(keys) > 4 * most:
        least = np.partition(times, -most)[-most]
        keep = times >= least
        keys, times = keys[keep], times[keep]
    order = np.lexsort((keys, -times))[:most]
    t = times[order]
    begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    ends = np.concatenate([begins[1:], [len(t)]]).astype(np.int64)
    return keys[order], np.repeat((begins + 1 + ends) / 2, ends - begins)


class Profiles:
    """Places of n-grams in every language's profile."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], times: list[np.ndarray], most: int = PLACES):
        self.langs, self.most = langs, most
        held = [places(k, t, most) for k, t in zip(keys, times, strict=True)]
        self.vocab = np.unique(np.concatenate([k for k, _ in held])) if held else np.zeros(0, _U)
        self.table = np.full((len(self.vocab) + 1, len(langs)), np.nan, np.float64)  # the last row: n-grams of no profile
        for c, (k, p) in enumerate(held):
            self.table[np.searchsorted(self.vocab, k), c] = p

    def nearest(self, text: str | None) -> tuple[str, float]:
        keys, times = counted(text) if text else (np.zeros(0, _U), ())
        if not len(keys) or not self.langs:
            return "und", 0.0
        mine, place = places(keys, times, self.most)
        at = np.minimum(np.searchsorted(self.vocab, mine), len(self.vocab) - 1)
        at = np.where(self.vocab[at] == mine, at, len(self.vocab))
        apart = np.abs(self.table[at] - place[:, None])
        far = np.where(np.isnan(apart), self.most, np.minimum(apart, self.most)).sum(axis=0)
        best = int(np.argmin(far))  # langs are in order, so a tie goes to the first
        return self.langs[best], 1.0 - float(far[best]) / (self.most * len(mine))


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS) == 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, times): n-grams of all rows that have a lang, added up in the tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(lang: str) -> pa.RecordBatch:
            k, n = merged(*(list(x) for x in zip(*held.pop(lang), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k)).dictionary_encode().cast(pa.string()), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "gram", "times"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k, n = counted(text.as_py() or "")
                if len(k):
                    parts = held.setdefault(lang, [])
                    parts.append((k, n))
                    if len(parts) >= 64:
                        held[lang] = parts = [merged(*(list(x) for x in zip(*parts, strict=True)))]
                        if len(parts[0][0]) >= HELD:
                            yield out(lang)
            if sum(len(k) for parts in held.values() for k, _ in parts) >= 4 * HELD:
                for lang in list(held):
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, times long")
    return rows.groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def profiles(docs: DataFrame, most: int = PLACES) -> DataFrame:
    """(lang, gram, times, place) of every language that ``docs`` states; ``place`` is 1 for the most frequent n-gram."""
    rows = gram_counts(docs).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # the first places of each part, so that no task meets a language's n-grams from all tasks
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("times"), "gram"))).where(F.col("place") <= most)
    return rows.drop("part")


def learn(docs: DataFrame, most: int = PLACES) -> Profiles:
    """Profiles on the driver: ``most`` rows for each of at most LANGUAGES languages."""
    found = profiles(docs, most).select("lang", "gram", "times").limit(LANGUAGES * most + 1).toArrow().sort_by("lang")
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > LANGUAGES or found.num_rows > LANGUAGES * most:
        raise ValueError(f"more than {LANGUAGES} languages")
    lang = np.searchsorted(langs, found.column("lang").to_pylist()) if langs else np.zeros(0, np.int64)
    gram, times = np.asarray(found.column("gram")).view(_U), np.asarray(found.column("times"))
    return Profiles(langs, [gram[lang == c] for c in range(len(langs))], [times[lang == c] for c in range(len(langs))], most)


def predict(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.nearest(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, most: int = PLACES) -> DataFrame:
    """Language of every document by profiles that are learned from the other folds' rows: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), most)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Mixing to target weights with soft domain membership.

Method. A classifier fitted on the labels table predicts each document's posteriors over three domains: ``toxic`` (labelled toxic),
``junk`` (bad quality, not toxic), ``clean`` (the rest). It is a softmax regression on hashed words, word-form shapes and a few
shares, fitted in numpy by one task on a sample of at most ``TRAIN_ROWS`` labelled documents, drawn by hash of the id; only the
weights (a fixed number) come to the driver.

Documents of that sample keep the domain that their label states, as it needs no prediction; all others get what the classifier says, in
thousandths.

Documents of that sample keep the domain that their label states, as it needs no prediction; all others get what the classifier says, in
thousandths.

With t tokens and posteriors p of document d, rates r >= 0 (at most ``max_rate``, if one is given) minimise the squared distance of
A r = sum of r * t * p from the targets T, and, among all rates that do, stay nearest to 1: a ridge of ``RIDGE`` of the mean supply
draws each rate there. Projected gradient: the rates of an iteration are the projection clip(1 - p' m) of a step from 1, where m adds up
the gradients (A r - T) of the iterations, each scaled by the curvature of the documents that stand between their bounds and halved
until the objective falls. It ends where the gradient is ``TOLERANCE`` of all tokens; the scaling changes the way there and not the
minimum.

A rate depends on the posteriors alone, so documents are first added up by posteriors: at most 501,501 rows at any size of the corpus.
Only totals leave the executors in an iteration.

A document is then emitted floor(r + u) times, u uniform from a hash of its id and text.

Defined results: null or empty text has no tokens, the class priors as posteriors and its rate like any other; without labels all
documents are ``clean``; labels of several rows for one id count by their largest toxic and smallest quality; a domain without
supply keeps its target unmet (least squares); rows repeated get equal rates; no rows give no rows; extra columns are carried by
mix().
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from . import arrays as A
from .arrays import U64, Texts

DOMAINS = ("clean", "junk", "toxic")
BUCKETS = 1 << 15
#: Most labelled documents the classifier is fitted on.
TRAIN_ROWS = 6000
STEPS, ITERATIONS, TOLERANCE = 150, 200, 1e-7
#: Standard deviations from an even spread that a word needs to take part in the classifier.
CHANCE = 2.5
#: Weight of the distance from rate 1, reached in two stages, and how often a step is halved at most.
RIDGE, HALVES = (1e-2, 1e-4), 12
#: Parts of one in which posteriors are given.
PARTS = 1000
#: Share of all tokens by which a mixture may miss its targets without a word in the log.
NEAR = 1e-3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_PLAIN = np.zeros(256, np.uint8)  # letters and digits, lower-cased; other ASCII becomes a gap
for _c in range(256):
    _PLAIN[_c] = _LOWER[_c] if _c >= 128 or chr(_c).isalnum() else 32


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets by document, where each document's begin, dense shares (documents, 3), tokens."""
    plain = Texts(texts.ids, _PLAIN[texts.data], texts.offsets)
    starts, ends, row = plain.words()
    h = A.spans_hash(plain.data, starts, ends, A.BYTE_BASE)
    key = np.unique((row.astype(U64) << U64(20)) | (h % U64(BUCKETS)))
    doc = (key >> U64(20)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    tokens = np.diff(np.searchsorted(texts.words()[2], np.arange(len(texts) + 1)))
    size = np.maximum(np.diff(texts.offsets), 1)
    sums = [np.concatenate([[0], np.cumsum(t[texts.data])]) for t in (_SYMBOL, _UPPER)]
    dense = np.stack([np.minimum(1, 10 * (s[texts.offsets[1:]] - s[texts.offsets[:-1]]) / size) for s in sums] + [np.ones(len(texts))], axis=1)
    return (key & U64(BUCKETS - 1)).astype(np.int32), first, dense, tokens


class Classifier:
    def __init__(self, words: np.ndarray, dense: np.ndarray):
        self.words, self.dense = words, dense

    @classmethod
    def fit(cls, buckets: np.ndarray, first: np.ndarray, dense: np.ndarray, label: np.ndarray) -> Classifier:
        """Softmax regression by gradient steps with momentum and a small ridge; deterministic."""
        k, n = len(DOMAINS), len(label)
        words, w2 = np.zeros((BUCKETS, k)), np.zeros((dense.shape[1], k))
        if not n:
            w2[-1, 0] = 20.0
            return cls(words, w2)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        goal = np.eye(k)[label]
        count = np.bincount(buckets, minlength=BUCKETS)
        scale = 1 / np.sqrt(1 + count)[:, None]  # a step of like size for rare and frequent words
        # Words that are spread over the domains as chance would have it stay out: they only fit the sample.
        share = goal.mean(axis=0)
        inside = np.stack([np.bincount(buckets[(label == c)[doc]], minlength=BUCKETS) for c in range(k)], axis=1)
        z = np.abs(inside - count[:, None] * share) / np.sqrt(count[:, None] * share * (1 - share) + 0.5)
        scale = scale * np.clip((z.max(axis=1) - CHANCE) / 2, 0, 1)[:, None]
        takes = scale[buckets, 0] > 0  # the other words keep a weight of nothing
        first = np.concatenate([[0], np.cumsum(takes)])[first].astype(np.int64)
        buckets, doc = buckets[takes], doc[takes]
        vel, vel2 = np.zeros_like(words), np.zeros_like(w2)
        for _ in range(STEPS):
            p = cls(words, w2)._softmax(cls(words, w2)._scores(buckets, first, dense))
            err = p - goal
            g = np.stack([np.bincount(buckets, err[doc, c], BUCKETS) for c in range(k)], axis=1)
            vel = 0.9 * vel - 0.05 * (g + 0.3 * words) * scale
            vel2 = 0.9 * vel2 - 0.5 * (dense.T @ err) / n
            words = np.clip(words + vel * scale, -4, 4)
            w2 += vel2
        return cls(words.astype(np.float32), w2)

    def _scores(self, buckets: np.ndarray, first: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, len(DOMAINS))), np.cumsum(self.words[buckets], axis=0, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]] + dense @ self.dense

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        buckets, first, dense, tokens = features(texts)
        return self._softmax(self._scores(buckets, first, dense)), tokens


def _parts(batches: Iterator[pa.RecordBatch], text_col: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield part, Texts.of(pa.array(range(part.num_rows), pa.int64()), part.column(text_col))


def drawn(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(labelled_id, label) of at most ``rows`` labelled documents, drawn by hash."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return one.select(F.col("doc_id").cast("long").alias("labelled_id"), label.alias("label")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents; their distinct buckets, not their texts, come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 1):
            buckets, first, dense, _ = features(texts)
            packed = [x.astype(np.uint16).tobytes() for x in np.split(buckets, first[1:-1])] if len(texts) else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(list(dense), pa.list_(pa.float64())), part.column(2)], ["doc_id", "buckets", "dense", "label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        buckets = [np.frombuffer(x.as_buffer(), np.uint16) for b in held for x in b.column(1)]
        dense = np.array([x for b in held for x in b.column(2).to_pylist()]).reshape(-1, 3)
        label = np.array([x for b in held for x in b.column(3).to_pylist()], np.int64)
        first = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int64)
        model = Classifier.fit(np.concatenate(buckets) if buckets else np.zeros(0, np.uint16), first, dense, label)
        yield pa.RecordBatch.from_arrays([pa.array([np.float32(model.words).tobytes()]), pa.array([np.float64(model.dense).tobytes()])], ["words", "dense"])

    # The sample is small and bounded, so its ids are broadcast; repeated documents may repeat rows, hence the second limit.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn(labels, rows)), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")
    sample = found.mapInArrow(run, "doc_id long, buckets binary, dense array<double>, label int").orderBy("doc_id", "label").limit(rows)
    # One task holds the bounded sample and gives one row; an empty one gives one as well, or none where Spark drops the task.
    got = sample.coalesce(1).mapInArrow(fit, "words binary, dense binary").first()
    if got is None:
        return Classifier.fit(np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros((0, 3)), np.zeros(0, np.int64))
    return Classifier(np.frombuffer(got["words"], np.float32).reshape(BUCKETS, -1), np.frombuffer(got["dense"]).reshape(-1, len(DOMAINS)))


def _known(p: np.ndarray, label: pa.Array) -> np.ndarray:
    """Posteriors in whole parts of one; where a label is known, its domain alone."""
    out = np.round(p * PARTS) / PARTS
    out[:, 0] = np.maximum(0, np.round(PARTS - PARTS * out[:, 1:].sum(axis=1))) / PARTS
    at = np.asarray(pc.fill_null(label, -1))
    out[at >= 0] = np.eye(len(DOMAINS))[at[at >= 0]]
    return out


def posteriors(docs: DataFrame, model: Classifier, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens and p_<domain> of every document, and u for the rounding; without ``labels`` all of it is predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 1):
            p, tokens = model.predict(texts)
            p = _known(p, part.column(3))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), *(pa.array(p[:, c]) for c in range(len(DOMAINS))), part.column(2)], ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "u"])

    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", u.alias("u"))
    if labels is None:
        rows = rows.withColumn("label", F.lit(None).cast("int"))
    else:
        rows = rows.join(F.broadcast(drawn(labels)), F.col("doc_id") == F.col("labelled_id"), "left").select("doc_id", "text", "u", "label")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + "".join(f"p_{d} double, " for d in DOMAINS) + "u double")


def descend(evaluate: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray, np.ndarray]]], target: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(m, A r) at the minimum. ``evaluate`` gives for each m: the sum of t * value of a document's part of the objective, A r, and the
    sum of t * p p' over documents between their bounds."""
    k = len(target)
    m = np.zeros(k)
    reached = evaluate([m])[0][1]
    for ridge in RIDGE:
        rho = ridge * total / k
        m = (reached - target) / rho if m.any() else m
        value, reached, inner = evaluate([m])[0]
        for _ in range(ITERATIONS):
            gradient = reached - target - rho * m
            if np.abs(gradient).max() <= TOLERANCE * total:
                break
            step = np.linalg.solve(inner + rho * np.eye(k), gradient)
            tries = [m + step / 2**i for i in range(HALVES)]
            whole = lambda v, x: v + x @ target + rho * (x @ x) / 2
            now, slope = whole(value, m), gradient @ step
            found = evaluate(tries)
            i = next((i for i, (v, *_) in enumerate(found) if whole(v, tries[i]) <= now - 1e-4 * slope / 2**i + 1e-12 * abs(now)), None)
            if i is None:
                break  # as near as float64 comes
            m, (value, reached, inner) = tries[i], found[i]
        else:
            raise RuntimeError(f"no end after {ITERATIONS} iterations: {reached} for {target}")
    return m, reached


def fit_rates(post: DataFrame, weights: dict[str, float], max_rate: float | None, anchor: str | None = None) -> tuple[list[float], dict]:
    """m of ``rate``, and what the rates reach. ``anchor``: the domain whose target is its whole supply, which sets the size of the
    mixture; without it, the mixture has as many tokens as the input."""
    k = len(DOMAINS)
    names = [f"p_{d}" for d in DOMAINS]
    path = f"{shared_dir(post.sparkSession)}/posteriors-{uuid.uuid4().hex}"
    post.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0").coalesce(8).write.parquet(path)  # bounded: see above
    cells = post.sparkSession.read.parquet(path)
    p, t = [F.col(n) for n in names], F.col("n_tokens")
    supply = np.array([x or 0.0 for x in cells.agg(*[F.sum(t * x) for x in p]).first()])
    share = np.array([weights.get(d, 0.0) for d in DOMAINS])
    target = share / share.sum() * supply.sum()
    if anchor:
        target = share * (supply[DOMAINS.index(anchor)] / share[DOMAINS.index(anchor)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def evaluate(ms: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        each = cells.select(t, *p, F.posexplode(F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in ms])).alias("try", "m"))
        ahead = F.lit(1.0) - sum(F.col("m")[i] * c for i, c in enumerate(p))
        r = _clip(ahead, max_rate)
        between = F.when((ahead > 0) & (F.lit(True) if max_rate is None else ahead < max_rate), t).otherwise(0)
        sums = [F.sum(t * r * (ahead - r / 2)), *[F.sum(t * r * x) for x in p], *[F.sum(between * p[i] * p[j]) for i, j in pairs]]
        out = []
        for row in each.groupBy("try").agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).orderBy("try").collect():  # a row for each try
            got, inner = list(row)[1:], np.zeros((k, k))
            for (i, j), x in zip(pairs, got[1 + k :], strict=True):
                inner[i, j] = inner[j, i] = x
            out.append((got[0], np.array(got[1 : 1 + k]), inner))
        return out

    m, reached = descend(evaluate, target, supply.sum()) if supply.sum() else (np.zeros(k), supply)
    return m.tolist(), {"supply": supply.tolist(), "target": target.tolist(), "reached": reached.tolist()}


def _clip(x, most: float | None):
    x = F.greatest(F.lit(0.0), x)
    return x if most is None else F.least(F.lit(float(most)), x)


def rate(m: list[float], max_rate: float | None):
    """The rate as an expression of the posteriors."""
    return _clip(F.lit(1.0) - sum(float(x) * F.col(f"p_{d}") for x, d in zip(m, DOMAINS, strict=True)), max_rate)


def rates_of(p: np.ndarray, m: list[float], max_rate: float | None) -> np.ndarray:
    """The same for an array of posteriors."""
    return np.clip(1.0 - p @ np.array(m), 0.0, max_rate)


def plan(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float | None, anchor: str | None) -> tuple[Classifier, DataFrame, list[float], dict]:
    model = train(docs, labels)
    path = f"{shared_dir(docs.sparkSession)}/posteriors-{uuid.uuid4().hex}"
    posteriors(docs, model, labels).write.parquet(path)
    post = docs.sparkSession.read.parquet(path)
    m, said = fit_rates(post, weights, max_rate, anchor)
    off = max(abs(a - b) for a, b in zip(said["reached"], said["target"], strict=True))
    if off > NEAR * max(sum(said["supply"]), 1.0):  # a target that can't be met: these are the least-squares figures
        logging.getLogger(__name__).warning("the mixture misses its targets: %s", said)
    return model, post, m, said


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, max_rate: float | None = None, anchor: str | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every document."""
    _, post, m, _ = plan(docs, labels, weights, max_rate, anchor)
    out = post.withColumn("rate", rate(m, max_rate))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("u")).cast("int")).drop("u")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, max_rate: float | None = 1.0, anchor: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns."""
    model, _, m, _ = plan(docs, labels, weights, max_rate, anchor)
    names = docs.columns
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    known = drawn(labels).select(F.col("labelled_id").alias("_labelled_id"), F.col("label").alias("_label"))
    source = docs.select("*", u.alias("_u")).join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("_labelled_id"), "left").drop("_labelled_id")
    text_col = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, text_col):
            r = rates_of(_known(model.predict(texts)[0], part.column(len(names) + 1)), m, max_rate)
            times = np.floor(r + np.asarray(part.column(len(names)))).astype(np.int64)
            yield part.select(names).take(pa.array(np.repeat(np.arange(len(times)), times)))

    return source.mapInArrow(run, docs.schema)

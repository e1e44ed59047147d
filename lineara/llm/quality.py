"""Quality rules from a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Method. Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets
are counted, both over every document: the raw corpus (all rows) and the trusted target (rows whose label says good quality
and not toxic). The target is smoothed toward the raw distribution: a bucket's ratio is
log((t + PRIOR) / (e + PRIOR)), where t is its count in the target and e the count that the raw distribution leads to expect
there. A bucket of which the target is too small to tell anything so has a ratio near 0, however many labels there are. A document's score
is the mean ratio over its n-grams, so length cancels; it is kept when the score is at least ``THRESHOLD`` and the base rules pass.
Texts of trusted documents are scored on a target without their own counts, as if they had no label. Nothing is drawn at
random: equal texts get equal verdicts, since a copy of a trusted text is scored without that text's counts as well.

The base rules count words, code points in words, symbols, repeated lines and words in repeated five-word windows with
array functions inside the row; pairs are hashed once, for the score and for the windows. The hash of a text tells whether
a trusted document has it.

A bit table of fixed size (``BITS``) tells inside the scan which rows can't have a trusted id, or a trusted text's hash. Only the
others are shuffled to meet the trusted rows, in an exact join dealt over ``SALTS`` parts of each key; the plan is the same at every
size, and a full table costs shuffle, not rows. Only texts that meet a trusted one are scored without own counts.

The model (two counts for each bucket) and the bit tables, all of fixed size, are scalar subqueries: one row each passes through the driver.

Defined results: null or empty text has no words, so its base rules fail and its score is null; null labels or ids are not
trusted; repeated label rows count once, repeated documents each; an empty table gives no rows; without any trusted row the
ratio is 0 for every bucket, and only the base rules decide; extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_dir

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Added to every count by the plain ratio of ``model``, which ``judge`` doesn't use.
SMOOTH = 0.5
#: Occurrences of a bucket in the target, as the raw distribution expects them, that are added to those counted.
PRIOR = 16.0
#: Least mean log-likelihood ratio, in nats an n-gram.
THRESHOLD = -0.1

#: Bits of the table that tells which keys may be trusted, and parts into which the rows of one key are dealt.
BITS, SALTS = 1 << 22, 16

#: Repeated windows of a text up to which their places are looked up one by one.
FEW = 16

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairs(w: Column) -> Column:
    """Hash of every word with its next neighbour."""
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))), 1, F.greatest(F.size(w) - 1, F.lit(0)))


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words covered by n-word windows that occur twice or more in the array of words."""
    return let(pairs(w), lambda p: repeated_in(p, n))


def repeated_in(p: Column, n: int = 5) -> Column:
    """The same from the hashes of ``pairs``: a window is hashed by the fewest pairs that hold all its words.

    Window hashes are sorted as plain numbers to find those that occur again. The places of a few are looked up directly; where
    there are more than ``FEW``, hashes are sorted with their places instead, so a long text never takes quadratic time.
    """

    def at_few(h: Column, again: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(again, F.get(h, i)))

    def at_many(h: Column) -> Column:
        def alike(s: Column) -> Column:
            found = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), alike)

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def twice(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        return let(again, lambda g: let(F.when(F.size(g) <= FEW, at_few(h, g)).otherwise(at_many(h)), covered))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice(h))

    later = sorted({*range(2, n - 1, 2), n - 2} - {0})
    hashes = F.transform(F.slice(p, 1, F.size(p) - (n - 2)), lambda x, i: F.xxhash64(x, *[F.get(p, i + k) for k in later]))
    return F.when(F.size(p) < n, F.lit(0)).otherwise(let(hashes, count))


def signals(text: Column, w: Column, p: Column) -> dict[str, Column]:
    """The base counts, all long, from a text, its words and their pairs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_in(p).cast("long"),
    }


def bucket(h: Column, buckets: int = BUCKETS) -> Column:
    """``h`` modulo the number of buckets; a mask is the cheaper form where that is a power of two."""
    return F.pmod(h, F.lit(buckets)) if buckets & (buckets - 1) else h.bitwiseAND(F.lit(buckets - 1).cast("long"))


def hashes_of(w: Column, p: Column) -> Column:
    """Hash of every word and of every pair of neighbours."""
    return F.concat(F.transform(w, lambda x: F.xxhash64(x)), p)


def ngrams(w: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    return F.transform(hashes_of(w, pairs(w)), lambda h: bucket(h, buckets))


def gram_rows(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``ngrams`` of every text, as column b; words become rows first, so that Spark compiles the hashing."""
    each = texts.select(words(F.col("text")).alias("w")).select(F.posexplode("w").alias("i", "x"), "w")
    last = F.col("i") + 1 == F.size("w")
    both = F.array(bucket(F.xxhash64("x"), buckets), F.when(~last, bucket(F.xxhash64("x", F.get("w", F.col("i") + 1)), buckets)))
    return each.select(F.explode(both).alias("b")).where("b is not null")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()


def _dense(rows: DataFrame, size: int, place: str, value: Column) -> DataFrame:
    """One row with the array of ``value`` at places 0 to ``size`` - 1; rows missing from ``rows`` have null columns."""
    every = rows.sparkSession.range(size).withColumnRenamed("id", "_at").join(rows, F.col("_at") == F.col(place), "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("_at", value.alias("x")))).alias("a"))
    return one.select(F.transform("a", lambda s: s["x"]).alias("a"))


def filter_of(keys: DataFrame, h: Column):
    """A function that tells, from the hash of a row's key, whether ``keys`` may have it: false is sure."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    words = keys.groupBy(F.floor(F.pmod(h, F.lit(BITS)) / 64).alias("w")).agg(F.bit_or(bit).alias("x"))  # at most BITS / 64 rows
    table = _dense(words, BITS // 64, "w", F.coalesce("x", F.lit(0).cast("long"))).scalar()

    def may_have(h: Column) -> Column:
        return F.coalesce(F.getbit(F.get(table, F.floor(F.pmod(h, F.lit(BITS)) / 64).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1, F.lit(False))

    return may_have


def _salted(rows: DataFrame, keys: DataFrame, on: list[str], how: str, by: list[str]) -> DataFrame:
    """``rows`` joined with distinct ``keys``; equal keys of rows that differ in ``by`` are dealt over SALTS tasks. The salt
    depends on the row alone, so that a task that is run again deals its rows in the same way."""
    many = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(many.hint("merge"), [*on, "_salt"], how).drop("_salt")


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """b, n and t: the count of each bucket that occurs over all rows of ``docs``, and over those whose id is in ``trusted``."""
    w = docs.select(F.col("doc_id").alias("_id"), "text")
    may_be = filter_of(trusted, F.xxhash64("_id"))
    # Buckets are counted inside the scan of all texts; the trusted ones are counted again over their own rows.
    raw = gram_rows(w, buckets).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    own = _salted(w.where(may_be(F.xxhash64("_id"))), trusted, ["_id"], "inner", ["_id", "text"])
    own = gram_rows(own, buckets).groupBy("b").agg(F.count(F.lit(1)).alias("t"))
    return raw.join(own, "b", "left").select("b", "n", F.coalesce("t", F.lit(0)).alias("t"))


def counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[tuple[int, int, int]]:
    """The rows of ``bucket_counts``: at most one for each bucket."""
    return [tuple(r) for r in bucket_counts(docs, trusted_ids(labels), buckets).collect()]


def model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log p_target - log p_raw of every bucket with add-``SMOOTH`` smoothing, counted over all rows of ``docs``."""
    rows = counts(docs, labels, buckets)
    total, target = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not target:
        return [0.0] * buckets
    base = math.log((total + SMOOTH * buckets) / (target + SMOOTH * buckets))
    out = [base] * buckets
    for b, n, t in rows:
        out[b] = base + math.log((t + SMOOTH) / (n + SMOOTH))
    return out


def score(w: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of an array of words; null without words."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")  # folded to a literal once
    n = F.lit(len(ratios))
    # Each word with the next one, in one pass; the last has no next one and stands for itself only.
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.get(table, F.pmod(F.xxhash64(x), n)) + F.when(y.isNull(), F.lit(0.0)).otherwise(F.get(table, F.pmod(F.xxhash64(x, y), n))))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1))


class Ratios:
    """The smoothed ratios of all buckets, as array columns to be added to the rows that are scored.

    Each array is a scalar subquery that one expression uses once, so that Spark puts its value into that expression.
    """

    def __init__(self, counted: DataFrame, buckets: int = BUCKETS):
        self.buckets = buckets
        sums = counted.agg(F.sum("n"), F.sum("t")).first()
        self.total, self.target = float(max(sums[0] or 1, 1)), float(sums[1] or 0)
        n, t = F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
        ratio = F.log((t + PRIOR) / (n * (self.target / self.total) + PRIOR))
        self.ratio, self.n, self.t = (_dense(counted, buckets, "b", x).scalar() for x in (ratio, n, t))

    def on_all(self, w: Column, p: Column) -> Column:
        """Mean ratio of an array of words and of its pairs on the whole target, with column _ratio; null without words."""
        total = F.aggregate(hashes_of(w, p), F.lit(0.0), lambda a, h: a + F.get("_ratio", bucket(h, self.buckets)))
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1))

    def on_rest(self, w: Column, p: Column) -> Column:
        """The same on the target without the words' own counts, with columns _n and _t."""
        zero = F.lit(0.0)

        def mean(s: Column) -> Column:
            size = F.size(s)
            share = F.greatest((F.lit(self.target) - size) / F.lit(self.total), zero)
            starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
            # Every distinct bucket with how often it occurs.
            runs = let(starts, lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(size)), lambda i, j: F.struct(F.get(s, i).alias("b"), (j - i).alias("c"))))
            one = lambda x: F.log((F.greatest(F.get("_t", x["b"]) - x["c"], zero) + PRIOR) / (share * F.get("_n", x["b"]) + PRIOR))
            return F.aggregate(runs, zero, lambda a, x: a + x["c"] * one(x)) / size

        return F.when(F.size(w) > 0, let(F.sort_array(F.transform(hashes_of(w, p), lambda h: bucket(h, self.buckets))), mean))


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Hashes (_k1, _k2) of the texts of trusted documents."""
    may_be = filter_of(trusted, F.xxhash64("_id"))
    keyed = docs.select(F.col("doc_id").alias("_id"), "text").where(may_be(F.xxhash64("_id"))).select("_id", F.xxhash64("text").alias("_k1"), F.hash("text").alias("_k2"))
    return _salted(keyed, trusted, ["_id"], "inner", ["_id", "_k1"]).select("_k1", "_k2").distinct()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``score``, ``base_failed`` and ``kept``."""
    shared_dir(docs.sparkSession)  # where the slim tables below are kept
    ids = trusted_ids(labels).checkpoint()
    ratios = Ratios(bucket_counts(docs, ids).checkpoint())
    trusted = trusted_texts(docs, ids).checkpoint()
    text, h = F.col("text"), F.xxhash64("text")
    may_be = filter_of(trusted, F.col("_k1"))

    def judged(rows: DataFrame, own: Column | None) -> DataFrame:
        # One struct from words bound once: a filter on `kept` must not repeat the split for every word.
        rows = rows.select("*", ratios.ratio.alias("_ratio"), *([] if own is None else [ratios.n.alias("_n"), ratios.t.alias("_t")]))

        def all_of(w: Column) -> Column:
            return let(pairs(w), lambda p: measured(w, p))

        def measured(w: Column, p: Column) -> Column:
            score = ratios.on_all(w, p) if own is None else F.when(own, ratios.on_rest(w, p)).otherwise(ratios.on_all(w, p))
            return let(F.struct(*[c.alias(n) for n, c in signals(text, w, p).items()], score.alias("score")), verdict)

        def verdict(q: Column) -> Column:
            failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
            kept = ~failed & F.coalesce(q["score"] >= threshold, F.lit(False))
            return F.struct(failed.alias("base_failed"), kept.alias("kept"), *[q[n].alias(n) for n in NAMES], q["score"].alias("score"))

        return rows.select(*docs.columns, let(words(text), all_of).alias("_q"))

    other = judged(docs.where(~may_be(h)), None)
    like = docs.where(may_be(h)).select("*", h.alias("_k1"), F.hash("text").alias("_k2"))
    like = _salted(like, trusted.withColumn("_own", F.lit(True)), ["_k1", "_k2"], "left", ["doc_id", "_k1"])
    out = other.unionByName(judged(like, F.coalesce("_own", F.lit(False))))
    # Spark puts a filter's columns into the scan: one on `kept` must find a single field to look at, or the struct is computed for each.
    return out.select(*docs.columns, *[F.col(f"_q.{n}").alias(n) for n in ("base_failed", "kept", *NAMES, "score")])

"""Keyed writes, logs and proofs as functions from frames to frames; a writer stores their result as the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in their place or added. Of several new rows of a key the one largest by ``order`` counts."""
    if order is not None:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def backfilled(rows: DataFrame, column: str, value: Column, stale: Column | None = None) -> DataFrame:
    """A stamped column, computed where it is null and, if given, where it is stale."""
    todo = F.col(column).isNull() if stale is None else F.col(column).isNull() | stale
    return rows.withColumn(column, F.when(todo, value).otherwise(F.col(column)))


def pending(rows: DataFrame, column: str, source: str) -> bool:
    """Whether any row still lacks its stamp."""
    return not rows.where(F.col(column).isNull() & F.col(source).isNotNull()).isEmpty()


def newest(log: DataFrame, key: str, keep: int, by: str | None = None) -> DataFrame:
    """The ``keep`` newest rows of a log, or of each ``by``."""
    if by is None:
        return log.orderBy(F.desc(key)).limit(keep)
    return log.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(key)))).where(F.col("_n") <= keep).drop("_n")


def run_finished(log: DataFrame, run: int, before: DataFrame, after: DataFrame) -> DataFrame:
    """A run log with one run finished: verdicts counted, and how many tokens were added, removed or changed their status."""
    from .tokens import status_changes

    diff = status_changes(before, after).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    tally = after.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "invalid", "unvalidated")])
    row = diff.withColumn("_one", F.lit(1)).join(tally.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumns({"run": F.lit(run).cast("long"), "state": F.lit("ok")})
    return upsert(log, row.select(*log.columns), ["run"])


def cast_ballots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ballots (voter, choice, at) with the latest of each voter."""
    both = old.unionByName(new)
    return both.groupBy("voter").agg(F.max_by(F.struct("choice", "at"), F.struct("at", "choice")).alias("b")).select("voter", "b.*")


def tally(ballots: DataFrame, options: DataFrame) -> DataFrame:
    """Votes of every option, those without any included; other choices don't count."""
    counts = ballots.groupBy(F.col("choice").alias("option")).agg(F.count(F.lit(1)).alias("votes"))
    return options.join(counts, "option", "left").select("option", F.coalesce("votes", F.lit(0)).alias("votes"))


def _pair(a: Column, b: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.least(a, b), F.greatest(a, b))), 256)


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Frames (i, h) from the leaves to the root. A level is a grouping of neighbours, half as large as the one before, so there are
    log2(n) of them; an odd last node goes up unchanged."""
    out = [leaves.select("i", "h")]
    n = leaves.count()
    while n > 1:
        halves = out[-1].groupBy(F.expr("i div 2").alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.count(F.lit(1)).alias("n"))
        out.append(halves.select("i", F.when(F.col("n") == 2, _pair(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("h")))
        n = (n + 1) // 2
    return out


def merkle_root(leaves: DataFrame) -> DataFrame:
    """(h) of the tree over leaf digests (i from 0, h hex), whose pairs are sorted before they are hashed; no row without leaves."""
    return _levels(leaves)[-1].select("h")


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """(i, proof) of every leaf: the digests of its siblings from below; a node without a sibling adds none."""
    levels = _levels(leaves)
    rows = levels[0].select("i", F.col("i").alias("at"), F.array().cast("array<string>").alias("proof"))
    for level in levels[:-1]:
        other = level.select(F.expr("CASE WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END").alias("at"), F.col("h").alias("s"))
        rows = rows.join(other, "at", "left").select("i", F.expr("at div 2").alias("at"), F.when(F.col("s").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array("s"))).alias("proof"))
    return rows.select("i", "proof")


def proven(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether a leaf's proof leads to the root; a step that is no digest proves nothing."""
    ok = F.forall(proof, lambda s: s.rlike("^[0-9a-f]{64}$"))
    return F.when(ok, F.aggregate(proof, leaf, lambda h, s: _pair(h, s)) == root).otherwise(False)

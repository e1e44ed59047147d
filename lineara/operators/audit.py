"""Report on builds that no matcher knows: families, their open places, what a pin would need, and the weekly summary of it.

Programs (id, program) of one family have as many pushes and the same bytes around them. All steps are joins and grouped counts over one
row for each push; what is listed for a family is bounded by the pushes of one program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exact as E, scripts as S

#: Open places are listed up to this number; a family with more only says how many there are.
LISTED = 64
POOL_START = 0x6B


def laid(programs: DataFrame) -> DataFrame:
    """(id, family, pushes, length, program, values) of readable programs."""
    rows = programs.select("id", "program", S.laid_out("program").alias("l")).where("l.n is not null")
    return rows.select("id", F.concat_ws(":", F.col("l.n").cast("string"), F.hex("l.gap_digest")).alias("family"), F.col("l.n").alias("pushes"), F.length("program").alias("length"), "program", F.col("l.values").alias("values"))


def places(laid_out: DataFrame) -> DataFrame:
    """(family, place, value_first): open places, whose value differs inside the family, and their value in the member of the smallest id."""
    each = laid_out.select("id", "family", F.posexplode("values").alias("place", "value"))
    return each.groupBy("family", "place").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("value", "id").alias("value_first")).where("lo < hi").select("family", "place", "value_first")


def families(laid_out: DataFrame, open_places: DataFrame, trades: DataFrame, trials: DataFrame, digest=S.h32) -> DataFrame:
    """A family's members, lengths, trades, open places, sample and best trial (of ``programs.best_trials``); most trades first.

    ``reach`` is ``exact`` for a single deployment, whose places can't be told and which only its digest could pin, else ``skeleton``.
    """
    per = trades.groupBy(F.col("market_covenant_id").alias("id")).agg(F.count(F.lit(1)).alias("t"))
    rows = laid_out.drop("values").join(per, "id", "left")
    out = rows.groupBy("family").agg(
        F.first("pushes").alias("push_count"), F.sort_array(F.collect_set("length")).alias("program_lens"), F.count(F.lit(1)).alias("instances"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("trades"), F.min("id").alias("sample_covenant"), F.min_by("program", "id").alias("sample"),
    )
    found = open_places.groupBy("family").agg(F.count(F.lit(1)).alias("slots"), F.sort_array(F.collect_list("place")).alias("slot_indices"))
    out = out.join(found, "family", "left").join(trials, "family", "left")
    slots = F.coalesce("slots", F.lit(0))
    listed = F.when(slots <= LISTED, F.coalesce("slot_indices", F.array().cast("array<int>")))
    return out.select(
        "family", "push_count", "program_lens", "instances", "trades", slots.alias("slots"), listed.alias("slot_indices"), "sample_covenant", digest(F.col("sample")).alias("sample_program_hash"),
        (F.hex(F.substring("sample", 1, 1)) == f"{POOL_START:02X}").alias("pool_shaped"), "v_place", "fee_model", "trades_clean", "trades_off_curve", F.when(F.col("instances") < 2, "exact").otherwise("skeleton").alias("reach"),
    ).orderBy(F.desc("trades"), "push_count", "family")


def role_guesses(laid_out: DataFrame, open_places: DataFrame) -> DataFrame:
    """(family, role, places, sample_value): what open places may stand for, for a person to name.

    Places that share a value in the family's first member are one constant if every member repeats its own value in all of them:
    ``key`` with 32 bytes throughout, ``number`` with numbers throughout. A single place is ``self_length`` if it states each
    member's own length. The two overlap where a length is repeated.
    """
    each = laid_out.select("id", "family", "length", F.posexplode("values").alias("place", "value")).hint("merge").join(open_places, ["family", "place"])
    number = E.little_endian(F.when(F.length("value") > 0, F.col("value")))
    member = each.groupBy("family", "value_first", "id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("value") == F.max("value")).alias("same"), (F.min(F.length("value")) == 32).alias("key"), F.bool_and(number.isNotNull()).alias("number")
    )
    groups = member.groupBy("family", "value_first").agg(F.max("n").alias("n"), F.bool_and("same").alias("same"), F.bool_and("key").alias("key"), F.bool_and("number").alias("number"))
    role = F.when(F.col("key"), "key").when(F.col("number"), "number")
    groups = groups.where("n >= 2 and same").withColumn("role", role).where("role is not null").select("family", "value_first", "role")
    shared = open_places.join(groups, ["family", "value_first"]).groupBy("family", "value_first", "role").agg(F.sort_array(F.collect_list("place")).alias("places"))
    shared = shared.select("family", "role", "places", F.when(F.col("role") == "number", E.little_endian(F.col("value_first"))).alias("sample_value"))
    own = each.groupBy("family", "place").agg(F.bool_and(F.coalesce(number == F.col("length"), F.lit(False))).alias("own")).where("own")
    return shared.unionByName(own.select("family", F.lit("self_length").alias("role"), F.array("place").alias("places"), F.lit(None).cast("long").alias("sample_value")))


def totals(unmatched: DataFrame, laid_out: DataFrame) -> DataFrame:
    """One row: covenants that no matcher knows, how many of their programs were recovered, how many not, and the families."""
    n = unmatched.agg(F.count(F.lit(1)).alias("unmatched_covenants"))
    got = laid_out.join(unmatched.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("recovered"), F.countDistinct("family").alias("families"))
    return n.join(got).withColumn("unrecoverable", F.col("unmatched_covenants") - F.col("recovered"))  # one row each


def pinned(ledger: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The ledger of pins (skeleton, first_pinned_by, date, revision) with how many programs have each today; none is 0, as a pin's
    origin doesn't end with its deployments."""
    n = verdicts.groupBy("skeleton").agg(F.count(F.lit(1)).alias("instances"))
    return ledger.join(n, "skeleton", "left").fillna(0, ["instances"])


def unstamped(ledger: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Skeletons in use without a row in the ledger; there should be none."""
    return skeletons.select("skeleton").distinct().join(ledger, "skeleton", "left_anti")


def _rank(*more: Column) -> list[Column]:
    return [F.desc_nulls_last("trades"), F.desc_nulls_last("instances"), *more]


def top_families(found: DataFrame, n: int = 3) -> DataFrame:
    """(network, place, instances, trades, sample_covenant): each network's first families by trades, then by deployments."""
    at = F.row_number().over(W.partitionBy("network").orderBy(*_rank(F.col("sample_covenant"))))
    return found.withColumn("place", at).where(F.col("place") <= n).select("network", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instances", "trades")], "sample_covenant")


def headline_runs(runs: DataFrame) -> DataFrame:
    """Each network's run whose figures count: the newest that ended well, else the newest; (network, run_id, outcome and figures)."""
    best = F.max_by(F.struct(*[c for c in runs.columns if c != "network"]), F.struct((F.coalesce("outcome", F.lit("")) == "ok").alias("ok"), "run_id"))
    return runs.groupBy("network").agg(best.alias("r")).select("network", "r.*")


def specimen(top: DataFrame) -> DataFrame:
    """The unknown family with the most trades over all networks, ties to more deployments, then by network and sample; no row if none
    has a trade."""
    return top.where("trades > 0").orderBy(*_rank(F.col("network"), F.col("sample_covenant"))).limit(1).select("network", "instances", "trades", "sample_covenant")

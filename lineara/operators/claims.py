"""Verified holders: who may vote, what they hear of, and the public file of their claims.

records: (holder, balance, alerts, unreachable, participation, phases, bucket), one row for each holder; ``participation`` is an array of
(round_id, closed_ms), ``phases`` a map from token to phase and ``bucket`` a balance class, both as last reported to the holder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import shared_dir
from . import upkeep

#: Least proven balance of a ballot, a policy.
FLOOR = 100


def balance_of(holdings: DataFrame, token: str | None = None) -> DataFrame:
    """(holder, balance) over (holder, token_id, balance): of one token, or of all."""
    rows = holdings if token is None else holdings.where(F.col("token_id") == token)
    return rows.groupBy("holder").agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("balance"))


def eligibility(voters: DataFrame, records: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(holder, ok, reason) of those who want to vote: ``unverified`` without a record, ``below floor`` by the balance last proven."""
    known = records.select("holder", F.coalesce("balance", F.lit(0)).alias("balance"))
    rows = voters.select("holder").distinct().join(known, "holder", "left")
    reason = F.when(F.col("balance").isNull(), "unverified").when(F.col("balance") < floor, "below floor")
    return rows.select("holder", reason.isNull().alias("ok"), reason.alias("reason"))


def participation(records: DataFrame, source: str) -> DataFrame:
    """One claim (v, address, badge, granted_ms, source) for each round that a holder took part in."""
    rows = records.select(F.col("holder").alias("address"), F.explode("participation").alias("p"))
    return rows.select(F.lit(1).alias("v"), "address", F.concat(F.lit("voted-"), F.col("p.round_id").cast("string")).alias("badge"), F.coalesce(F.col("p.closed_ms"), F.lit(0)).alias("granted_ms"), F.lit(source).alias("source"))


def deliverable(records: DataFrame, latest: DataFrame) -> DataFrame:
    """(holder, kind, token_id, before, after): changes between what holders were last told and ``latest`` (holder, phases, bucket).

    Only holders who asked for messages and can be reached; a token or a class that wasn't known before is no change.
    """
    asked = F.coalesce("alerts", F.lit(False)) & ~F.coalesce("unreachable", F.lit(False))
    rows = records.where(asked).select("holder", F.col("phases").alias("p0"), F.col("bucket").alias("b0")).join(latest.select("holder", "phases", "bucket"), "holder")
    told = lambda kind, token, a, b: F.struct(F.lit(kind).alias("kind"), token.alias("token_id"), a.alias("before"), b.alias("after"))
    phases = F.transform(F.map_entries("phases"), lambda e: told("phase", e["key"], F.try_element_at("p0", e["key"]), e["value"]))
    balance = F.array(told("balance", F.lit(None).cast("string"), F.col("b0"), F.col("bucket")))
    news = F.concat(F.coalesce(phases, F.array_repeat(balance[0], 0)), balance)
    changed = F.filter(news, lambda x: (x["before"] != "") & (x["after"] != "") & (x["before"] != x["after"]))
    return rows.select("holder", F.inline(changed))


def canonical(rows: DataFrame) -> Column:
    """A row as JSON with its columns in the order of their names, so that the same facts give the same bytes."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})


def numbered(claims: DataFrame) -> DataFrame:
    """(i, claim, leaf) of all claims in the order of their canonical bytes, without gaps from 0.

    Places come from range partitions: each task counts its own part, and only the parts' sizes are added up in one place.
    """
    shared_dir(claims.sparkSession)
    parts = claims.select(canonical(claims).alias("claim")).repartitionByRange("claim").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(W.partitionBy("part").orderBy("claim")) - 1
    rows = parts.withColumn("at", at).join(F.broadcast(before), "part")  # a row for each partition
    return rows.select((F.col("before") + F.col("at")).alias("i"), "claim", F.sha2("claim", 256).alias("leaf"))


def passport(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, claim, leaf, proof) of all claims, and (h), the root over their leaves; no root without claims."""
    rows = numbered(claims).checkpoint()
    leaves = rows.select("i", F.col("leaf").alias("h"))
    return rows.join(upkeep.merkle_proofs(leaves), "i"), upkeep.merkle_root(leaves)


def appended(index: DataFrame, rows: DataFrame) -> DataFrame:
    """An index (covenant_id, base, name) with further covenants (covenant_id, base). A name that several covenants have is told apart by
    the head of their ids, those that were in the index before included; covenants that are in it already stay once."""
    more = rows.select("covenant_id", "base").distinct().join(index.select("covenant_id"), "covenant_id", "left_anti")
    every = index.select("covenant_id", "base").unionByName(more)
    n = every.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "base").select("covenant_id", "base", F.when(F.col("n") > 1, F.concat("base", F.lit("-"), F.substring("covenant_id", 1, 4))).otherwise(F.col("base")).alias("name"))


def activity_columns(events: DataFrame, width: int, tip: int | None = None, start: int | None = None, most: int = 200) -> DataFrame:
    """(place, daa, births, moves, burns, total): one row for each bucket of ``width`` up to the tip, the empty ones included, the newest
    ``most``. Without a tip the newest bucket with events is the last; without events and tip there is no row. ``most`` is a chart's width.
    """
    last = events.agg(F.max(F.expr(f"accepting_daa div {width}")).alias("hi"), F.min(F.expr(f"accepting_daa div {width}")).alias("lo"))
    hi = F.col("hi") if tip is None else F.lit(tip // width)
    lo = F.coalesce("lo", hi) if start is None else F.lit(start // width)
    lo = F.greatest(lo, hi - (most - 1))
    grid = last.where(hi.isNotNull()).select(F.explode(F.sequence(F.least(lo, hi), hi)).alias("b"), F.least(lo, hi).alias("first"))
    kinds = {"births": "genesis", "moves": "transition", "burns": "burn"}
    n = events.groupBy(F.expr(f"accepting_daa div {width}").alias("b")).agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()])
    rows = grid.join(n, "b", "left").fillna(0, list(kinds))
    return rows.select((F.col("b") - F.col("first")).alias("place"), (F.col("b") * width).alias("daa"), *kinds, (F.col("births") + F.col("moves") + F.col("burns")).alias("total"))

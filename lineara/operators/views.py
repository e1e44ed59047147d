"""What pages show: index entries, balances over time, holders and how they are linked, claims against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: Units of score in a day.
SCORES = 864_000


def moves() -> Column:
    """Moves of a coin's summary: its events but for the birth, if it was seen, and the burn, if it is retired."""
    dead = F.col("live_states") == 0
    return F.greatest(F.lit(0), F.col("event_count") - F.col("genesis_daa").isNotNull().cast("int") - dead.cast("int"))


def filtered(index: DataFrame, query: str = "", status: str | None = None, order: str = "activity", limit: int = 50) -> DataFrame:
    """Index rows by status and text, in the order of the menu; ties go to the smaller id."""
    rows = index.where(F.lower(F.concat_ws(" ", "name", "covenant_id")).contains(query.lower())) if query else index
    if status is not None:
        rows = rows.where((F.col("live_states") > 0) == (status == "alive"))
    key = {"activity": F.desc("last_activity_daa"), "newest": F.desc_nulls_last("genesis_daa"), "oldest": F.asc_nulls_last("genesis_daa"), "richest": F.desc("live_value"), "moves": F.desc("moves")}[order]
    return rows.orderBy(key, "covenant_id").limit(limit)


def balances_at_events(events: DataFrame, cells: DataFrame) -> DataFrame:
    """(covenant_id, accepting_daa, balance): a coin's value after each score at which it has events.

    A live cell counts from its creation on; a spent one up to the first event after it. Both ends are changes of the balance at a score,
    so one running sum over the coin's changes replaces a comparison of every cell with every event. Scans in order go over a coin's days
    (``SCORES`` units of score), and what lies beyond a day comes from one row a day, so a coin with a third of all rows is a task a day.
    """
    at = events.select("covenant_id", "accepting_daa").distinct()
    marks = at.select("covenant_id", F.col("accepting_daa").alias("d"), F.lit(0).cast("long").alias("v"), F.lit(True).alias("event"))
    born = cells.select("covenant_id", F.col("created_daa").alias("d"), F.col("value").alias("v"), F.lit(False).alias("event"))
    day, key = F.floor(F.col("d") / SCORES), ["covenant_id", "_day"]
    days = W.partitionBy("covenant_id").orderBy("_day")  # one row a day
    # The end of a spent cell: the first event after its creation, of the same day or else of a later one.
    spent = cells.where("spent_block is not null").select("covenant_id", F.col("created_daa").alias("d"), F.col("value").alias("v")).groupBy("covenant_id", "d").agg(F.sum("v").alias("v"))
    both = spent.select("*", F.lit(None).cast("long").alias("e")).unionByName(at.select("covenant_id", F.col("accepting_daa").alias("d"), F.lit(None).cast("long").alias("v"), F.col("accepting_daa").alias("e"))).withColumn("_day", day)
    later = both.groupBy(*key).agg(F.min("e").alias("_e")).select(*key, F.min("_e").over(days.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    after = F.min("e").over(W.partitionBy(*key).orderBy("d").rangeBetween(1, W.unboundedFollowing))
    ends = both.withColumn("_same", after).where("v is not null").join(later, key).withColumn("x", F.coalesce("_same", "_later"))
    gone = ends.where("x is not null").select("covenant_id", F.col("x").alias("d"), (-F.col("v")).alias("v"), F.lit(False).alias("event"))
    changes = marks.unionByName(born).unionByName(gone).groupBy("covenant_id", "d").agg(F.sum("v").alias("v"), F.bool_or("event").alias("event")).withColumn("_day", day)
    before = changes.groupBy(*key).agg(F.sum("v").alias("_v")).select(*key, (F.sum("_v").over(days) - F.col("_v")).alias("_before"))
    total = F.sum("v").over(W.partitionBy(*key).orderBy("d"))  # one row for each score of the day
    rows = changes.withColumn("_total", total).where("event").join(before, key)
    return rows.select("covenant_id", F.col("d").alias("accepting_daa"), (F.col("_total") + F.col("_before")).alias("balance"))


def holder_ranks(held: DataFrame, limit: int) -> DataFrame:
    """The largest positive balances of each token with their rank and share of the token's total. Spark keeps ``limit`` rows of a token
    in each task before the shuffle, as the rank is filtered by a number."""
    rows = held.where("balance > 0")
    total = rows.groupBy("token_id").agg(F.sum("balance").alias("total"))
    rank = F.row_number().over(W.partitionBy("token_id").orderBy(F.desc("balance"), "owner"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    return top.join(total, "token_id").select("token_id", "owner", "balance", "rank", F.round(F.col("balance") / F.col("total"), 6).alias("share"))


def holder_links(deltas: DataFrame, holders: DataFrame) -> DataFrame:
    """Pairs of holders of a token between whom it moved: how often, and the newest event. ``holders``: (token_id, owner)."""
    h = holders.select("token_id", "owner").distinct()
    rows = deltas.where("owner_from is not null and owner_to is not null and owner_from <> owner_to")
    rows = rows.join(h.withColumnRenamed("owner", "owner_from"), ["token_id", "owner_from"], "left_semi").join(h.withColumnRenamed("owner", "owner_to"), ["token_id", "owner_to"], "left_semi")
    return rows.groupBy("token_id", F.least("owner_from", "owner_to").alias("a"), F.greatest("owner_from", "owner_to").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest"))


def minter_directory(pins: DataFrame, cells: DataFrame) -> DataFrame:
    """Minters with their live states and value and the tokens that they pin, in order."""
    now = cells.groupBy("covenant_id").agg(F.count_if(F.col("spent_block").isNull()).alias("live_states"), F.sum(F.when(F.col("spent_block").isNull(), F.col("value")).otherwise(0)).alias("live_value"))
    mine = pins.groupBy(F.col("minter_covenant_id").alias("covenant_id")).agg(F.array_join(F.array_sort(F.collect_set("token_id")), ",").alias("tokens"))
    return mine.join(now, "covenant_id", "left").select("covenant_id", "tokens", F.coalesce("live_states", F.lit(0)).alias("live_states"), F.coalesce("live_value", F.lit(0)).alias("live_value"))


def valued_cells(proven: DataFrame, cells: DataFrame) -> DataFrame:
    """By token: live cells with a proven state and their value, and those whose value isn't known."""
    rows = proven.join(cells.select("txid", "output_index", "value"), ["txid", "output_index"], "left")
    return rows.groupBy("token_id").agg(F.count("value").alias("cells"), F.coalesce(F.sum("value"), F.lit(0)).alias("value"), F.count_if(F.col("value").isNull()).alias("omitted_unvalued"))


def claims_checked(listed: DataFrame, facts: DataFrame) -> DataFrame:
    """Listed claims against chain facts: match, differ, not_stated or unproven for each, and whether all that is stated matches.

    ``listed``: covenant_id, genesis_txid, curve_covenant_id, pool_covenant_id, creator; ``facts``: covenant_id, known, genesis_txid,
    owners (array of owner keys now), genesis_owners.
    """
    f = facts.select("covenant_id", "known", F.col("genesis_txid").alias("fact_txid"), "owners", "genesis_owners")
    rows = listed.join(f, "covenant_id", "left")
    known = F.coalesce("known", F.lit(False))
    now, first = (F.coalesce(c, F.array().cast("array<string>")) for c in ("owners", "genesis_owners"))
    owns = lambda who, ident: F.coalesce(F.exists(who, lambda o: (F.length(o) == 66) & (F.substring(o, 3, 64) == ident)), F.lit(False))
    some = lambda who: F.exists(who, lambda o: o.startswith("02"))
    txid = F.when(F.col("genesis_txid").isNull(), "not_stated").when(F.col("fact_txid").isNull(), "unproven").when(F.col("genesis_txid") == F.col("fact_txid"), "match").otherwise("differ")
    curve, pool = F.col("curve_covenant_id"), F.col("pool_covenant_id")
    market = F.when(curve.isNull() & pool.isNull(), "not_stated").when(~known, "unproven").when(owns(now, curve) | owns(now, pool), "match").when(some(now), "differ").otherwise("unproven")
    creator = F.when(F.col("creator").isNull(), "not_stated").when(~known | (F.size(first) == 0), "unproven").when(owns(first, F.col("creator")), "match").when(some(first), "unproven").otherwise("differ")
    out = rows.select("covenant_id", txid.alias("genesis_check"), market.alias("market_check"), creator.alias("creator_check"))
    checks = F.array("genesis_check", "market_check", "creator_check")
    passed = F.exists(checks, lambda c: c == "match") & F.forall(checks, lambda c: c.isin("match", "not_stated"))
    return out.withColumn("all_checks_passed", passed)


def reorg_summary(log: DataFrame, now_ms: int) -> DataFrame:
    """One row: reorganisations (at_ms, rolled_back) of the last hour, of all time, and blocks rolled back."""
    return log.agg(F.count_if(F.col("at_ms") >= now_ms - 3_600_000).alias("last_hour"), F.count(F.lit(1)).alias("all_time"), F.coalesce(F.sum("rolled_back"), F.lit(0)).alias("depth"))


def reconciled(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Pending transactions (txid, version, kind) of a snapshot and of the live feed: the higher version of each wins, live on a tie."""
    rows = snapshot.select("txid", "version", "kind", F.lit(0).alias("live")).unionByName(live.select("txid", "version", "kind", F.lit(1).alias("live")))
    return rows.groupBy("txid").agg(F.max_by(F.struct("version", "kind"), F.struct("version", "live")).alias("r")).select("txid", "r.*")

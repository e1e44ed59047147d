"""Markets: replay of trades against the program, gated summaries, candles, unknown builds, orders and vesting.

Trades follow the ledger's schema (token_id, seq, market_covenant_id, side, base_amount, quote_sompi, ...). Prices are pairs of whole
numbers; they become floats only in candles, which are for charts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact as E

DAY_MS = 86_400_000
BLOCK = 1024
#: Candle widths in milliseconds, finest first.
WIDTHS = (900_000, 3_600_000, 14_400_000, 86_400_000)


def replay(trades: DataFrame, v: Column, fee_bps: Column) -> DataFrame:
    """By market: trades that fit the curve before the first violation of its invariant, whether there is one, and how far was checked.

    Trades that other covenants took part in are stored but never judged; trades off the curve aren't counted. The history is cut into
    blocks of seq, so that a market with a third of all trades is many tasks.
    """
    k0, k1, b0, b1 = (F.col(c) for c in ("kas_before_sompi", "kas_after_sompi", "base_before", "base_after"))
    quote, base = F.col("quote_sompi"), F.col("base_amount")
    on = (F.col("co_covenants") == 0) & E.bracket_holds(v, k0, k1, b0, b1, quote, base, F.col("side") == "buy", fee_bps)
    rows = trades.select("market_covenant_id", "seq", on.alias("on"), E.invariant_holds(v, k0, k1, b0, b1, quote, fee_bps).alias("inv"))
    ok, bad = F.col("on") & F.col("inv"), F.col("on") & ~F.col("inv")
    blocks = rows.groupBy("market_covenant_id", F.floor(F.col("seq") / BLOCK).alias("block")).agg(
        F.min(F.when(bad, F.col("seq"))).alias("bad"), F.max("seq").alias("last"), F.collect_list(F.when(ok, F.col("seq"))).alias("ok")
    )
    first = blocks.groupBy("market_covenant_id").agg(F.min("bad").alias("first_bad"), F.max("last").alias("last_seq"))
    rows = blocks.join(first, "market_covenant_id")
    counted = F.when(F.col("first_bad").isNull(), F.size("ok")).otherwise(F.size(F.filter("ok", lambda s: s < F.col("first_bad"))))
    out = rows.groupBy("market_covenant_id").agg(F.sum(counted).alias("exercised"), F.first("first_bad").alias("b"), F.first("last_seq").alias("l"))
    return out.select("market_covenant_id", F.col("b").isNull().alias("invariant_ok"), "exercised", F.coalesce("b", "l").alias("checked_through"))


def summary(publishable: DataFrame, tip_ms: int | None) -> DataFrame:
    """By token: the last trade that is large enough to price, and the day before the tip: volume, trades, change in basis points.

    A token with any trade without a time has no figures of the day. The change compares the newest priceable trade with the newest
    one before the day.
    """
    big, at = F.col("quote_sompi") >= E.MIN_PRICEABLE, F.col("accepting_time_ms")
    pair = F.struct("quote_sompi", "base_amount", "side", "accepting_daa")
    order = F.struct("seq")
    start = (tip_ms or 0) - DAY_MS
    inside = at.between(start, tip_ms) if tip_ms is not None else F.lit(False)
    t = publishable.groupBy("token_id").agg(
        F.max_by(F.when(big, pair), F.when(big, order)).alias("last"), F.max_by(F.when(big & (at < start), pair), F.when(big & (at < start), order)).alias("old"),
        F.count_if(at.isNull()).alias("untimed"), F.sum(F.when(inside, E.whole(F.col("quote_sompi")))).alias("vol"), F.count_if(inside).alias("n"),
    )
    timed = (F.col("untimed") == 0) & F.lit(tip_ms is not None)
    change = E.change_bps(F.col("old.quote_sompi"), F.col("old.base_amount"), F.col("last.quote_sompi"), F.col("last.base_amount"))
    return t.select(
        "token_id", F.col("last.quote_sompi").alias("last_quote_sompi"), F.col("last.base_amount").alias("last_base_amount"), F.col("last.side").alias("last_side"), F.col("last.accepting_daa").alias("last_daa"),
        F.when(timed & (F.col("n") > 0), F.col("vol").cast("long")).alias("volume_24h_sompi"), F.when(timed & (F.col("n") > 0), F.col("n")).alias("trades_24h"), F.when(timed, change).alias("change_24h_bps"),
        F.when(F.col("last").isNull(), "no trade large enough to price").alias("unpriced_reason"), F.when(F.col("untimed") > 0, "some trades have no time").alias("window_note"),
    )


def reserves(cells: DataFrame) -> DataFrame:
    """By covenant: its live value, if it sits in exactly one cell, and the number of live cells."""
    rows = cells.where("spent_block is null").groupBy("covenant_id").agg(F.count(F.lit(1)).alias("live_cells"), F.sum("value").alias("v"))
    return rows.select("covenant_id", "live_cells", F.when(F.col("live_cells") == 1, F.col("v")).alias("reserve_sompi"))


def candles(trades: DataFrame, width: int | None = None) -> DataFrame:
    """Open, high, low, close, volume and last transaction by time bucket, for each token; by ``width``, or the finest of WIDTHS that
    gives at most 120 buckets. Tokens with fewer than three charted trades, or with any without a time, have none."""
    ok = trades.where((F.col("co_covenants") == 0) & (F.col("quote_sompi") > 0) & (F.col("base_amount") > 0) & F.col("txid").isNotNull())
    span = ok.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"), F.count("accepting_time_ms").alias("timed"), (F.max("accepting_time_ms") - F.min("accepting_time_ms")).alias("span")).where("n >= 3 and n = timed")
    w = F.lit(WIDTHS[-1])
    for x in reversed(WIDTHS[:-1]):
        w = F.when(F.col("span") / x <= 120, x).otherwise(w)
    span = span.select("token_id", (F.lit(width) if width else w).cast("long").alias("width"))
    rows = ok.join(span, "token_id").withColumn("price", F.col("quote_sompi") / F.col("base_amount"))
    start = (F.col("accepting_time_ms") - F.pmod(F.col("accepting_time_ms"), F.col("width"))).alias("t0")
    return rows.groupBy("token_id", start).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("quote_sompi").alias("volume_sompi"), F.max_by("txid", "seq").alias("last_txid"), F.first("width").alias("width"),
    )


def composition(tokens: DataFrame, programs: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """One row: markets that tokens link to, by whether their program is matched, unmatched or not revealed."""
    linked = tokens.where("market_covenant_id is not null").select(F.col("market_covenant_id").alias("covenant_id")).distinct()
    rows = linked.join(programs, "covenant_id", "left")
    known = F.col("skeleton").isin(*allowed)
    return rows.agg(F.count(F.lit(1)).alias("examined"), F.count_if(known).alias("matched"), F.count_if(~known).alias("unmatched"), F.count_if(F.col("skeleton").isNull()).alias("unrevealed"), F.count_if(known & ~F.col("invariant_ok")).alias("invariant_failed"))


def _shape() -> list[Column]:
    n = F.col("program_len")
    return [F.coalesce(n, F.lit(-1)).alias("len_key"), F.coalesce("program_pushes", F.lit(-1)).alias("pushes_key"), F.when(n.isNull(), F.col("program_hash")).otherwise("").alias("hash_key")]


def unknown_totals(programs: DataFrame) -> DataFrame:
    """One row: families of unmatched programs, and their covenants."""
    rows = programs.where(F.col("skeleton").startswith("unmatched")).groupBy(*_shape()).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("covenants"))


def unknown_builds(programs: DataFrame, covenants: DataFrame, trades: DataFrame, limit: int) -> DataFrame:
    """Families of unmatched programs of one shape (length and pushes; the hash where the length isn't known), by what rides on them."""
    mine = programs.where(F.col("skeleton").startswith("unmatched"))
    only = mine.select(F.col("covenant_id").alias("market_covenant_id")).distinct()
    per = trades.join(only, "market_covenant_id", "left_semi").groupBy(F.col("market_covenant_id").alias("covenant_id")).agg(F.count(F.lit(1)).alias("t"), F.sum("quote_sompi").alias("v"), F.countDistinct("token_id").alias("k"), F.max("accepting_daa").alias("d"))
    facts = covenants.select("covenant_id", "genesis_daa", "last_activity_daa")
    rows = mine.join(per, "covenant_id", "left").join(facts, "covenant_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.groupBy(*_shape()).agg(
        F.min("program_hash").alias("program_hash"), F.countDistinct("covenant_id").alias("covenants"), F.sum(zero("t")).alias("trades"), F.sum(zero("v")).alias("volume"), F.max(zero("k")).alias("tokens"),
        F.min(F.nullif("genesis_daa", F.lit(0))).alias("first_daa"), F.nullif(F.max(F.greatest(zero("last_activity_daa"), zero("d"))), F.lit(0)).alias("last_daa"), F.min("covenant_id").alias("sample_covenant"),
    )
    return out.orderBy(F.desc("volume"), F.desc("trades"), F.desc("covenants"), "program_hash").limit(limit)


def directory_page(entries: DataFrame, after: str | None, limit: int) -> DataFrame:
    """Markets by id descending after a cursor, each row with the number of all entries."""
    total = entries.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))  # one row
    rows = entries if after is None else entries.where(F.col("covenant_id") < after)
    return rows.orderBy(F.desc("covenant_id")).limit(limit).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def order_states(orders: DataFrame, cells: DataFrame) -> DataFrame:
    """State of resting orders (covenant_id, expiry_daa): open while a cell is live, else filled if the cell was
    spent at or before the expiry and cancelled if later. Cells need spent_daa."""
    last = cells.groupBy("covenant_id").agg(F.bool_or(F.col("spent_block").isNull()).alias("open"), F.max("spent_daa").alias("resolved_daa"))
    state = F.when(F.col("open"), "open").when(F.col("resolved_daa") > F.col("expiry_daa"), "cancelled").otherwise("filled")
    return orders.join(last, "covenant_id").select(*orders.columns, state.alias("state"), F.when(~F.col("open"), F.col("resolved_daa")).alias("resolved_daa"))


def best_first(orders: DataFrame, limit: int) -> DataFrame:
    """Open orders by price, cheapest first: a float orders the candidates, and equal floats fall back to the pair and the id."""
    price = F.col("quote_sompi").cast("decimal(38,18)") / F.col("base_amount").cast("decimal(20,0)")
    return orders.where("state = 'open' and base_amount > 0").orderBy(price, "quote_sompi", "covenant_id").limit(limit)


def vesting(schedules: DataFrame, tip: int | None) -> DataFrame:
    """Schedules (total, start_score, duration_score, claimed) with their status, what is vested and what can be claimed at the tip."""
    total, start, span = F.col("total"), F.col("start_score"), F.col("duration_score")
    if tip is None:
        none = F.lit(None).cast("long")
        return schedules.select("*", F.lit("unknown").alias("status"), none.alias("vested_at_tip"), none.alias("claimable"))
    status = F.when(start > tip, "not_started").when(start + span > tip, "vesting").otherwise("vested")
    got = E.vested(total, start, span, tip)
    return schedules.select("*", status.alias("status"), got.alias("vested_at_tip"), F.greatest(F.lit(0), got - F.col("claimed")).alias("claimable"))

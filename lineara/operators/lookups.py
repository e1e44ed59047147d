"""Lookups that pages use: by template, hash, transaction, market or schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_templates(summaries: DataFrame, cells: DataFrame, templates: list[str]) -> DataFrame:
    """Summaries of covenants with a cell whose template, stated or revealed, is one of those named; newest activity first."""
    hit = cells.where(F.col("template").isin(*templates) | F.col("revealed_template").isin(*templates)).select("covenant_id").distinct() if templates else cells.limit(0).select("covenant_id")
    return summaries.join(hit, "covenant_id", "left_semi").orderBy(F.desc("last_activity_daa"), F.desc("covenant_id"))


def seen_by(covenants: DataFrame, events: DataFrame, daa: int) -> DataFrame:
    """(covenant_id, seen): whether a covenant has an event at or below a score."""
    old = events.where(F.col("accepting_daa") <= daa).select("covenant_id").distinct().withColumn("seen", F.lit(True))
    return covenants.select("covenant_id").join(old, "covenant_id", "left").select("covenant_id", F.coalesce("seen", F.lit(False)).alias("seen"))


def trade_of(trades: DataFrame, txid: str) -> DataFrame:
    """How a transaction was read as a trade, if it was; the first by token and place if several tokens moved."""
    return trades.where(F.col("txid") == txid).orderBy("token_id", "seq").limit(1)


def tokens_of_market(tokens: DataFrame, programs: DataFrame, market: str) -> DataFrame:
    """Tokens whose link is the market, or that its program names as its token or as its share of the pool."""
    named = programs.where(F.col("covenant_id") == market).select(F.explode(F.array("token_covenant_id", "lp_token_covenant_id")).alias("token_id")).where("token_id is not null").distinct()
    linked = tokens.where(F.col("market_covenant_id") == market).select("token_id")
    return tokens.join(linked.unionByName(named).distinct(), "token_id", "left_semi")


def kept_schedules(schedules: DataFrame, cells: DataFrame) -> DataFrame:
    """Vesting schedules whose first cell is still there; cells that are gone take their schedule with them."""
    at = cells.select(F.col("covenant_id").alias("lock_id"), F.col("txid").alias("genesis_txid"), F.col("output_index").alias("genesis_index"))
    return schedules.join(at, ["lock_id", "genesis_txid", "genesis_index"], "left_semi").select(*schedules.columns)


def schedule_of(schedules: DataFrame, cells: DataFrame, ident: str) -> DataFrame:
    """The schedule of a token or of a lock."""
    return kept_schedules(schedules.where((F.col("token_id") == ident) | (F.col("lock_id") == ident)), cells).orderBy("token_id").limit(1)


def schedule_page(schedules: DataFrame, after: tuple[int, str] | None, limit: int) -> DataFrame:
    """Schedules by start and token, both falling, after an exclusive cursor."""
    rows = schedules
    if after is not None:
        start, token = after
        rows = rows.where((F.col("start_score") < start) | ((F.col("start_score") == start) & (F.col("token_id") < token)))
    return rows.orderBy(F.desc("start_score"), F.desc("token_id")).limit(limit)


def token_actions(events: DataFrame, deltas: DataFrame, txid: str) -> DataFrame:
    """What a transaction did to tokens: the deltas of its events, which meet them by covenant and place.

    Both tables are first cut to the transaction's covenants, which its size bounds. A filter by value, unlike a join, goes below the
    window over a covenant that numbers its places, so other histories are neither sent nor sorted.
    """
    here = F.col("txid") == txid
    who = F.col("covenant_id").isin([r[0] for r in events.where(here).select("covenant_id").distinct().collect()])
    mine = events.where(who).where(here).select("covenant_id", "seq")
    return deltas.where(who).join(mine, ["covenant_id", "seq"]).select("token_id", "kind", "amount", "seq", "delta_idx")


def reorg_feed(log: DataFrame, limit: int) -> DataFrame:
    """Reorganisations (id, daa, at_ms, rolled_back), newest first."""
    return log.orderBy(F.desc("id")).limit(limit).select("daa", "at_ms", "rolled_back")


def template_hashes(cells: DataFrame) -> DataFrame:
    """(covenant_id, template_hash): the programs that a covenant proved; an empty hash says that a cell was looked at in vain."""
    return cells.where("template_hash is not null and template_hash <> ''").select("covenant_id", "template_hash").distinct()


def covenants_by_hash(cells: DataFrame, digest: str) -> DataFrame:
    return cells.where(F.col("template_hash") == digest).select("covenant_id").distinct()


def hashes_by_template(cells: DataFrame) -> DataFrame:
    """For each revealed template the number of its hashes, and the hash if there is only one."""
    rows = cells.where("revealed_template is not null and revealed_template <> '' and template_hash is not null and template_hash <> ''")
    lo, hi = F.min("template_hash"), F.max("template_hash")
    return rows.groupBy("revealed_template").agg(F.countDistinct("template_hash").alias("hashes"), F.when(lo == hi, hi).alias("only_hash"))


def market_entries(tokens: DataFrame, programs: DataFrame, summaries: DataFrame, allowed: tuple[str, ...], least: int) -> DataFrame:
    """Published markets: verified tokens whose market is a known build that broke no invariant over at least ``least`` trades, with the
    build's phase and the last price."""
    ok = programs.where(F.col("skeleton").isin(*allowed) & F.col("invariant_ok") & (F.col("exercised_trades") >= least)).select(F.col("covenant_id").alias("market_covenant_id"), "skeleton", "phase")
    return tokens.where("status = 'verified'").join(ok, "market_covenant_id").join(summaries, "token_id", "left")


def market_directory(entries: DataFrame, phase: str | None = None, priced: bool | None = None, after: str | None = None, limit: int = 50) -> DataFrame:
    """Published markets of a phase, priced or not, by token falling after an exclusive cursor."""
    if phase not in (None, "bonding", "graduated"):
        raise ValueError("phase must be bonding or graduated")
    rows = entries if phase is None else entries.where(F.col("phase") == phase)
    rows = rows if priced is None else rows.where(F.col("last_quote_sompi").isNotNull() == F.lit(priced))
    rows = rows if after is None else rows.where(F.col("token_id") < after)
    return rows.orderBy(F.desc("token_id")).limit(limit)


#: Which kind of event a chip of the page stands for.
CHIPS = {"born": "genesis", "moved": "transition", "retired": "burn"}


def of_kind(events: DataFrame, chip: str) -> DataFrame:
    """Events of a chip; any other chip shows all."""
    return events.where(F.col("kind") == CHIPS[chip]) if chip in CHIPS else events


def event_shapes(events: DataFrame, cells: DataFrame) -> DataFrame:
    """What each event did to its covenant's cells: how many it spent, how many it made, and the value spent."""
    spent = cells.where("spent_txid is not null").groupBy("covenant_id", F.col("spent_txid").alias("txid")).agg(F.count(F.lit(1)).alias("consumed"), F.sum("value").alias("consumed_value"))
    made = cells.groupBy("covenant_id", "txid").agg(F.count(F.lit(1)).alias("created"))
    rows = events.select("covenant_id", "seq", "txid").join(spent, ["covenant_id", "txid"], "left").join(made, ["covenant_id", "txid"], "left")
    return rows.select("covenant_id", "seq", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("consumed", "created", "consumed_value")])

"""Feeds and pages in a stable order, each a keyset filter and a top-k.

A cursor is exclusive: a page starts right after it, and pages of any size, one after another, give every row once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: The canonical order of events inside one accepting score: rows without an index come last.
CANONICAL = ("tx_index is null", "tx_index", "txid", "covenant_id", "seq")


def canonical(events: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """A page of events by score and canonical order; the cursor is a score and how many rows of it are done."""
    inside = W.partitionBy("accepting_daa").orderBy(*[F.expr(x) for x in CANONICAL])
    rows = events
    if after is not None:
        rows = rows.where(F.col("accepting_daa") >= after[0])
        rank = F.row_number().over(inside)
        # Only the cursor's own group needs ranks; a group is what one score accepted.
        group = rows.where(F.col("accepting_daa") == after[0]).withColumn("_r", rank).where(F.col("_r") > after[1]).drop("_r")
        rows = group.unionByName(rows.where(F.col("accepting_daa") > after[0]))
    return rows.orderBy("accepting_daa", *[F.expr(x) for x in CANONICAL]).limit(limit)


def after_all(columns: list[tuple[Column, object, bool]]) -> Column:
    """Strictly after a cursor in a lexicographic order of (column, value, descending)."""
    out, same = [], F.lit(True)
    for c, x, down in columns:
        out.append(same & ((c < F.lit(x)) if down else (c > F.lit(x))))
        same = same & (c == F.lit(x))
    return reduce(lambda a, b: a | b, out)


def gated_trades(trades: DataFrame, tokens: DataFrame, programs: DataFrame, allowed: tuple[str, ...], least: int = 3) -> DataFrame:
    """Trades of verified tokens on markets whose program is allowed, holds its invariant and was exercised often enough. The gates are
    semi joins on one distinct key each."""
    ok = tokens.where("status = 'verified'").select("token_id").distinct()
    market = programs.where(F.col("invariant_ok") & F.col("skeleton").isin(*allowed) & (F.col("exercised_trades") >= least)).select(F.col("covenant_id").alias("market_covenant_id")).distinct()
    return trades.join(market, "market_covenant_id", "left_semi").join(ok, "token_id", "left_semi")


def trades_page(gated: DataFrame, after: tuple[int, str, int] | None, limit: int, *, token: str | None = None, market: str | None = None, side: str | None = None) -> DataFrame:
    """Newest trades by (score, token, seq), all descending, with optional filters."""
    for name, x in (("token_id", token), ("market_covenant_id", market), ("side", side)):
        gated = gated if x is None else gated.where(F.col(name) == x)
    keys = ["accepting_daa", "token_id", "seq"]
    if after is not None:
        gated = gated.where(after_all([(F.col(k), x, True) for k, x in zip(keys, after, strict=True)]))
    return gated.orderBy(*[F.desc(k) for k in keys]).limit(limit)


def token_event_page(deltas: DataFrame, token: str, after: int | None, limit: int, down: bool = False) -> DataFrame:
    """``limit`` whole events of a token with all their deltas, after (or, going down, before) the event ``after``."""
    rows = deltas.where(F.col("token_id") == token)
    if after is not None:
        rows = rows.where(F.col("seq") < after if down else F.col("seq") > after)
    page = rows.select("seq").distinct().orderBy(F.desc("seq") if down else "seq").limit(limit)
    return rows.join(F.broadcast(page), "seq")  # at most ``limit`` rows


def id_range(rows: DataFrame, key: str, prefix: str, limit: int, width: int = 64) -> DataFrame:
    """Rows whose hex id begins with a prefix, as a range of ids that a scan can prune by."""
    return rows.where(F.col(key).between(prefix.ljust(width, "0"), prefix.ljust(width, "f"))).orderBy(key).limit(limit)


def first_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in an order, by an aggregate instead of a window, so that partial results meet in the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def spread_samples(events: DataFrame, samples: int) -> DataFrame:
    """Blocks nearest at or below evenly spread scores, both ends included; a stated list of targets, each looked up in an aggregate."""
    bounds = events.agg(F.min("accepting_daa"), F.max("accepting_daa")).first()
    if bounds[0] is None:
        return events.select(F.lit(0).alias("sample"), "accepting_block", "accepting_daa").limit(0)
    targets = [bounds[1] - (bounds[1] - bounds[0]) * i // (max(samples, 2) - 1) for i in range(samples)]
    at = F.struct("accepting_daa", "accepting_block")
    best = events.agg(*[F.max(F.when(F.col("accepting_daa") <= t, at)).alias(f"s{i}") for i, t in enumerate(targets)])
    rows = F.array(*[F.struct(F.lit(i).alias("sample"), F.col(f"s{i}.accepting_block"), F.col(f"s{i}.accepting_daa")) for i in range(samples)])
    return best.select(F.inline(rows))


def recent_blocks(events: DataFrame, limit: int) -> DataFrame:
    return events.select("accepting_block", "accepting_daa").distinct().orderBy(F.desc("accepting_daa"), "accepting_block").limit(limit)


def matching_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event, subscription) pairs; a null covenant or kind of a subscription matches all.

    Subscriptions to a covenant meet its events by the covenant, whatever their kind. Those to none are sent to every task: each
    of them matches a share of all events, and a join by kind would make all events of one kind a single task's.
    """
    e = events.select("covenant_id", "kind", "seq")
    s = subscriptions.select(F.col("id").alias("subscription_id"), F.col("covenant_id").alias("_c"), F.col("kind").alias("_k"))
    fits = F.col("_k").isNull() | (F.col("kind") == F.col("_k"))
    coin = e.join(s.where("_c is not null"), (F.col("covenant_id") == F.col("_c")) & fits)
    wide = e.join(F.broadcast(s.where("_c is null")), fits)
    names = ["covenant_id", "kind", "seq", "subscription_id"]
    return coin.select(*names).unionByName(wide.select(*names))


def ranked_suggestions(rows: DataFrame, query: str, name: str, ident: str, recency: str, limit: int = 8) -> DataFrame:
    """Names that begin with the query, then those that hold it, then ids that begin with it; newest first inside each."""
    q, n = query.lower(), F.lower(F.col(name))
    score = F.when(n.startswith(q), 0).when(n.contains(q), 1).when(F.lower(F.col(ident)).startswith(q), 2)
    return rows.withColumn("score", score).where("score is not null").orderBy("score", F.desc(recency), ident).limit(limit)

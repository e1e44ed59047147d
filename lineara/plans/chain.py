"""The ledger's tables as views of the driver's tables, in Spark and in DuckDB.

covenants, events, cells, tokens, token events, trades and market programs follow the ledger's schema; ids are hex digests of the
driver's keys. ``SQL`` states every view, so a query over the views and its SQL start from the same rows. Places in a history are
numbered on the driver's columns, before any id is made: digests don't compress, and those of a view would be most of what its shuffle
sends. Where a view is asked for ``raw`` ids, they stay the driver's keys until ``digested`` names them after the query's own shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..session import table

BASE = 1_704_067_200
MATCHED = ("Brand#1", "Brand#2", "Brand#3")

_S = "CAST(floor(epoch(ts)) AS BIGINT)"
SQL = {
    "events_": f"""SELECT sha256('c' || user_id) AS covenant_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
        CASE event_type WHEN 'signup' THEN 'genesis' WHEN 'error' THEN 'burn' ELSE 'transition' END AS kind, sha256('t' || (event_id // 3)) AS txid,
        ({_S} - {BASE}) // 3600 * 36000 AS accepting_daa, sha256('b' || (({_S} - {BASE}) // 3600)) AS accepting_block,
        CASE WHEN event_id % 11 <> 0 THEN event_id % 7 END AS tx_index, CASE WHEN event_id % 13 <> 0 THEN {_S} * 1000 END AS accepting_time_ms,
        CASE WHEN event_id % 17 = 0 THEN encode('ab') WHEN event_id % 6 = 0 THEN encode('{{"p":"abc-20","op":"' || event_type || '","tick":"T' || (user_id % 5) || '"}}')
            WHEN event_id % 6 = 1 THEN encode(lower(hex(encode(props)))) WHEN event_id % 6 = 2 THEN unhex(substr(sha256(event_type), 1, 8) || repeat('00', 16)) || encode(event_type)
            WHEN event_id % 6 = 3 THEN encode(props) WHEN event_id % 6 = 4 THEN encode('{{"t":"' || event_type || '"}}') END AS payload, event_id FROM events""",
    "covenants": """SELECT sha256('c' || user_id) AS covenant_id, CASE WHEN user_id % 10 <> 3 THEN arg_min(e.txid, e.seq) END AS genesis_txid,
        CASE WHEN user_id % 10 <> 3 THEN arg_min(e.accepting_daa, e.seq) END AS genesis_daa, user_id % 10 <> 3 AS lineage_complete, count(*) AS event_count,
        max(e.accepting_daa) AS last_activity_daa FROM (SELECT DISTINCT user_id FROM events) JOIN events_ e ON e.covenant_id = sha256('c' || user_id) GROUP BY user_id""",
    "cells": """SELECT sha256('t' || l_orderkey) AS txid, l_linenumber AS output_index, sha256('c' || l_suppkey) AS covenant_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
        (l_orderkey * 7919 + l_linenumber) % 720 * 36000 AS created_daa, sha256('b' || ((l_orderkey * 7919 + l_linenumber) % 720)) AS created_block,
        CASE WHEN l_linestatus <> 'O' THEN sha256('b' || (l_orderkey % 720)) END AS spent_block, CASE WHEN l_linestatus <> 'O' THEN sha256('t' || (l_orderkey + 1)) END AS spent_txid,
        CASE l_partkey % 6 WHEN 1 THEN '' WHEN 2 THEN 'p2pk' WHEN 3 THEN 'p2sh commitment' WHEN 4 THEN 'mecenas' WHEN 5 THEN 'escrow' END AS template,
        CASE l_partkey % 7 WHEN 0 THEN 'token' WHEN 1 THEN 'p2x' WHEN 2 THEN '' END AS revealed_template,
        CASE l_partkey % 3 WHEN 0 THEN unhex('20' || sha256('k' || (l_suppkey % 40)) || 'ac') WHEN 1 THEN unhex('aa20' || sha256('h' || l_partkey) || '87') ELSE encode('raw') END AS spk_script
        FROM lineitem""",
    "tokens": """SELECT sha256('n' || s_suppkey) AS token_id, CASE WHEN s_acctbal > 0 THEN 'verified' WHEN s_suppkey % 2 = 0 THEN 'invalid' ELSE 'unvalidated' END AS status,
        CASE WHEN s_suppkey % 4 <> 0 THEN sha256('m' || (s_suppkey % 30)) END AS market_covenant_id, s_name AS name FROM supplier""",
    "programs": """SELECT sha256('m' || p_partkey) AS covenant_id, CASE WHEN p_size % 4 = 0 THEN 'unmatched' ELSE p_brand END AS skeleton, p_size % 5 <> 0 AS invariant_ok,
        p_size % 9 AS exercised_trades, CASE WHEN p_size % 3 <> 0 THEN p_size % 7 END AS program_len, CASE WHEN p_size % 3 <> 0 THEN p_size % 2 END AS program_pushes,
        sha256('h' || (p_partkey % 11)) AS program_hash FROM part WHERE p_partkey < 25""",
    "trades": f"""SELECT sha256('n' || l_suppkey) AS token_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag) - 1 AS seq,
        sha256('t' || l_orderkey) AS txid, sha256('m' || (l_partkey % 30)) AS market_covenant_id, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
        CAST(l_quantity AS BIGINT) * 1000 AS base_amount, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS quote_sompi, l_linenumber // 5 AS co_covenants,
        l_orderkey // 16 AS accepting_daa, CASE WHEN l_suppkey % 5 <> 0 OR l_orderkey % 50 <> 0 THEN l_orderkey * 60000 END AS accepting_time_ms,
        CASE WHEN l_linenumber % 4 <> 0 THEN '0' || (l_partkey % 4) || sha256('o' || (l_orderkey % 25)) END AS counterparty FROM lineitem""",
    "token_events": """SELECT sha256('n' || l_suppkey) AS token_id, sha256('c' || l_suppkey) AS covenant_id, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS seq,
        row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag) - 1 AS delta_idx, CASE WHEN l_returnflag = 'R' THEN 'burn' WHEN l_returnflag = 'N' THEN 'mint' ELSE 'transfer' END AS kind,
        CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS BIGINT) END AS amount, '00' || sha256('o' || (l_partkey % 25)) AS owner_from, '0' || (l_partkey % 4) || sha256('o' || (l_orderkey % 25)) AS owner_to FROM lineitem""",
    "states": """SELECT sha256('n' || (l_suppkey % 40)) AS token_id, sha256('t' || l_orderkey) AS txid, l_orderkey AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'in' ELSE 'out' END AS side, l_linenumber AS idx,
        '0' || (l_partkey % 4) || sha256('o' || (l_partkey % 9)) AS owner, CAST(l_quantity AS BIGINT) // 10 AS amount, l_returnflag = 'N' AS minter, l_partkey % 23 <> 0 AS proven FROM lineitem""",
}
_NEEDS = {"covenants": ["events_"]}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the views it names, and further named parts, as common table expressions."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({x})" for n, x in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def ident(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), key.cast("string")), 256)


def _ids(raw: tuple[str, ...], **ids: tuple[str, Column]) -> list[Column]:
    """Id columns by name, as digests or, of those in ``raw``, as the driver's keys."""
    return [(key.cast("long") if name in raw else ident(kind, key)).alias(name) for name, (kind, key) in ids.items()]


def digested(rows: DataFrame, **kinds: str) -> DataFrame:
    """Rows of raw ids with the ids of the ledger: the kind of each column's ids by its name."""
    return rows.withColumns({name: ident(kind, _c(name)) for name, kind in kinds.items()})


def _c(name: str) -> Column:
    return F.col(name)


def _text(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


def events(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    s, e = F.unix_seconds(F.col("ts").cast("timestamp")), _c("event_id")
    hour = F.call_function("div", s - BASE, F.lit(3600))
    lane = F.concat(F.unhex(F.concat(F.substring(F.sha2(_c("event_type"), 256), 1, 8), F.lit("00" * 16))), _text(_c("event_type")))
    payload = (
        F.when(e % 17 == 0, _text("ab")).when(e % 6 == 0, _text('{"p":"abc-20","op":"', _c("event_type"), '","tick":"T', _c("user_id") % 5, '"}'))
        .when(e % 6 == 1, _text(F.lower(F.hex(F.encode("props", "UTF-8"))))).when(e % 6 == 2, lane).when(e % 6 == 3, _text(_c("props"))).when(e % 6 == 4, _text('{"t":"', _c("event_type"), '"}'))
    )
    rows = table(spark, sf_dir, "events").withColumn("seq", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    return rows.select(
        *_ids(raw, covenant_id=("c", _c("user_id")), txid=("t", F.call_function("div", e, F.lit(3)))), "seq",
        F.when(_c("event_type") == "signup", "genesis").when(_c("event_type") == "error", "burn").otherwise("transition").alias("kind"),
        (hour * 36000).alias("accepting_daa"), ident("b", hour).alias("accepting_block"),
        F.when(e % 11 != 0, e % 7).alias("tx_index"), F.when(e % 13 != 0, s * 1000).alias("accepting_time_ms"), payload.alias("payload"), "event_id", "user_id",
    )


def covenants(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    whole = F.col("user_id") % 10 != 3
    out = events(spark, sf_dir, "txid").groupBy("user_id").agg(F.min_by(F.struct("txid", "accepting_daa"), "seq").alias("t"), F.count(F.lit(1)).alias("event_count"), F.max("accepting_daa").alias("last_activity_daa"))
    return out.select(*_ids(raw, covenant_id=("c", F.col("user_id")), genesis_txid=("t", F.when(whole, F.col("t.txid")))), F.when(whole, F.col("t.accepting_daa")).alias("genesis_daa"), whole.alias("lineage_complete"), "event_count", "last_activity_daa")


def cells(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    part, order, at = _c("l_partkey"), _c("l_orderkey"), (_c("l_orderkey") * 7919 + _c("l_linenumber")) % 720
    spent = _c("l_linestatus") != "O"
    name = F.when(part % 6 == 1, "").when(part % 6 == 2, "p2pk").when(part % 6 == 3, "p2sh commitment").when(part % 6 == 4, "mecenas").when(part % 6 == 5, "escrow")
    key, hashed = ident("k", _c("l_suppkey") % 40), ident("h", part)
    script = F.when(part % 3 == 0, F.unhex(F.concat(F.lit("20"), key, F.lit("ac")))).when(part % 3 == 1, F.unhex(F.concat(F.lit("aa20"), hashed, F.lit("87")))).otherwise(_text("raw"))
    return table(spark, sf_dir, "lineitem").select(
        *_ids(raw, txid=("t", order), covenant_id=("c", _c("l_suppkey"))), _c("l_linenumber").alias("output_index"), F.round(_c("l_extendedprice") * 100).cast("long").alias("value"),
        (at * 36000).alias("created_daa"), ident("b", at).alias("created_block"), F.when(spent, ident("b", order % 720)).alias("spent_block"), F.when(spent, ident("t", order + 1)).alias("spent_txid"),
        name.alias("template"), F.when(part % 7 == 0, "token").when(part % 7 == 1, "p2x").when(part % 7 == 2, "").alias("revealed_template"), script.alias("spk_script"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        ident("n", k).alias("token_id"), F.when(_c("s_acctbal") > 0, "verified").when(k % 2 == 0, "invalid").otherwise("unvalidated").alias("status"),
        F.when(k % 4 != 0, ident("m", k % 30)).alias("market_covenant_id"), _c("s_name").alias("name"),
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = _c("p_size"), _c("p_partkey")
    return table(spark, sf_dir, "part").where(key < 25).select(
        ident("m", key).alias("covenant_id"), F.when(size % 4 == 0, "unmatched").otherwise(_c("p_brand")).alias("skeleton"), (size % 5 != 0).alias("invariant_ok"), (size % 9).alias("exercised_trades"),
        F.when(size % 3 != 0, size % 7).alias("program_len"), F.when(size % 3 != 0, size % 2).alias("program_pushes"), ident("h", key % 11).alias("program_hash"),
    )


def trades(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    order, line = _c("l_orderkey"), _c("l_linenumber")
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").withColumn("seq", (place - 1).cast("long")).select(
        *_ids(raw, token_id=("n", _c("l_suppkey")), txid=("t", order), market_covenant_id=("m", _c("l_partkey") % 30)), "seq", F.when(_c("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (_c("l_quantity").cast("long") * 1000).alias("base_amount"), (F.round(_c("l_extendedprice") * 100).cast("long") * 10000).alias("quote_sompi"),
        F.call_function("div", line, F.lit(5)).cast("int").alias("co_covenants"), F.call_function("div", order, F.lit(16)).alias("accepting_daa"),
        F.when((_c("l_suppkey") % 5 != 0) | (order % 50 != 0), order * 60000).alias("accepting_time_ms"),
        F.when(line % 4 != 0, F.concat(F.lit("0"), (_c("l_partkey") % 4).cast("string"), ident("o", order % 25))).alias("counterparty"),
    )


def token_events(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    flag = _c("l_returnflag")
    history = W.partitionBy("l_suppkey").orderBy("l_orderkey")
    event = W.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", (F.dense_rank().over(history) - 1).cast("long")).withColumn("delta_idx", (F.row_number().over(event) - 1).cast("long"))
    return rows.select(
        *_ids(raw, token_id=("n", _c("l_suppkey")), covenant_id=("c", _c("l_suppkey"))), "seq", "delta_idx", F.when(flag == "R", "burn").when(flag == "N", "mint").otherwise("transfer").alias("kind"),
        F.when(_c("l_linenumber") != 6, _c("l_quantity").cast("long")).alias("amount"), F.concat(F.lit("00"), ident("o", _c("l_partkey") % 25)).alias("owner_from"),
        F.concat(F.lit("0"), (_c("l_partkey") % 4).cast("string"), ident("o", _c("l_orderkey") % 25)).alias("owner_to"),
    )


def states(spark: SparkSession, sf_dir: str, *raw: str) -> DataFrame:
    """Judged token states of transactions, spent (in) and created (out)."""
    part = _c("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        *_ids(raw, token_id=("n", _c("l_suppkey") % 40), txid=("t", _c("l_orderkey"))), _c("l_orderkey").alias("seq"), F.when(_c("l_linenumber") % 2 == 1, "in").otherwise("out").alias("side"),
        _c("l_linenumber").alias("idx"), F.concat(F.lit("0"), (part % 4).cast("string"), ident("o", part % 9)).alias("owner"), F.call_function("div", _c("l_quantity").cast("long"), F.lit(10)).alias("amount"),
        (_c("l_returnflag") == "N").alias("minter"), (part % 23 != 0).alias("proven"),
    )

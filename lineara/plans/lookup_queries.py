"""Lookups over the ledger's views, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import coins as C, lookups as K, market as M
from ..session import table
from . import chain as V, chain_queries as Q

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


def _hash(kind: str, key) -> str:
    import hashlib

    return hashlib.sha256(f"{kind}{key}".encode()).hexdigest()


@query(V.sql("SELECT * FROM s WHERE covenant_id IN (SELECT covenant_id FROM cells WHERE template IN ('mecenas', 'token') OR revealed_template IN ('mecenas', 'token'))", "covenants", "cells", s=Q._SUMMARY))
def covenants_with_templates(spark, sf_dir):
    cells = V.cells(spark, sf_dir)
    return K.with_templates(C.summaries(V.covenants(spark, sf_dir), cells), cells, ["mecenas", "token"])


@query(V.sql("SELECT covenant_id, EXISTS (SELECT 1 FROM events_ e WHERE e.covenant_id = c.covenant_id AND accepting_daa <= 360000) AS seen FROM covenants c", "covenants"))
def seen_at_or_below(spark, sf_dir):
    return K.seen_by(V.covenants(spark, sf_dir), V.events(spark, sf_dir), 360_000)


@query(V.sql("SELECT * FROM trades WHERE txid = sha256('t77') ORDER BY token_id, seq LIMIT 1", "trades"))
def trade_by_txid(spark, sf_dir):
    return K.trade_of(V.trades(spark, sf_dir), _hash("t", 77))


@query(V.sql("SELECT * FROM tokens WHERE token_id = sha256('n7')", "tokens"))
def token_by_id(spark, sf_dir):
    return V.tokens(spark, sf_dir).where(F.col("token_id") == _hash("n", 7))


@query(V.sql("SELECT * FROM programs WHERE covenant_id = sha256('m7')", "programs"))
def market_program_by_id(spark, sf_dir):
    return V.programs(spark, sf_dir).where(F.col("covenant_id") == _hash("m", 7))


@query(V.sql("SELECT * FROM tokens WHERE market_covenant_id = sha256('m6') OR token_id IN (SELECT sha256('n' || (p_size % 9)) FROM part WHERE sha256('m' || p_partkey) = sha256('m6') UNION SELECT sha256('n' || (p_size % 7)) FROM part WHERE sha256('m' || p_partkey) = sha256('m6') AND p_size % 3 <> 0)", "tokens"))
def tokens_for_market(spark, sf_dir):
    size = F.col("p_size")
    ident = lambda kind, c: F.sha2(F.concat(F.lit(kind), c.cast("string")), 256)
    programs = table(spark, sf_dir, "part").select(ident("m", F.col("p_partkey")).alias("covenant_id"), ident("n", size % 9).alias("token_covenant_id"), F.when(size % 3 != 0, ident("n", size % 7)).alias("lp_token_covenant_id"))
    return K.tokens_of_market(V.tokens(spark, sf_dir), programs, _hash("m", 6))


# A schedule for each second line of an order; every third names a coin that has no such cell.
_PLANS = "SELECT sha256('n' || l_orderkey) AS token_id, sha256('c' || (l_suppkey + CASE WHEN l_orderkey % 3 = 0 THEN 1000000 ELSE 0 END)) AS lock_id, l_orderkey % 500 AS start_score, sha256('t' || l_orderkey) AS genesis_txid, l_linenumber AS genesis_index FROM lineitem WHERE l_linenumber = 2"
_KEPT = "SELECT DISTINCT p.* FROM plans p JOIN cells u ON u.covenant_id = p.lock_id AND u.txid = p.genesis_txid AND u.output_index = p.genesis_index"


def _plans(spark, sf_dir):
    o = F.col("l_orderkey")
    ident = lambda kind, c: F.sha2(F.concat(F.lit(kind), c.cast("string")), 256)
    lock = F.col("l_suppkey") + F.when(o % 3 == 0, 1_000_000).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 2")
    return rows.select(ident("n", o).alias("token_id"), ident("c", lock).alias("lock_id"), (o % 500).alias("start_score"), ident("t", o).alias("genesis_txid"), F.col("l_linenumber").alias("genesis_index")).distinct()


@query(V.sql("SELECT * FROM kept", "cells", plans=_PLANS, kept=_KEPT))
def vesting_schedules_kept(spark, sf_dir):
    return K.kept_schedules(_plans(spark, sf_dir), V.cells(spark, sf_dir))


@query(V.sql("SELECT * FROM kept WHERE token_id = sha256('n100') OR lock_id = sha256('n100') ORDER BY token_id LIMIT 1", "cells", plans=_PLANS, kept=_KEPT))
def vesting_schedule_of(spark, sf_dir):
    return K.schedule_of(_plans(spark, sf_dir), V.cells(spark, sf_dir), _hash("n", 100))


@query(V.sql("SELECT * FROM kept WHERE start_score < 400 OR (start_score = 400 AND token_id < '8') ORDER BY start_score DESC, token_id DESC LIMIT 40", "cells", plans=_PLANS, kept=_KEPT))
def vesting_page(spark, sf_dir):
    return K.schedule_page(K.kept_schedules(_plans(spark, sf_dir), V.cells(spark, sf_dir)), (400, "8"), 40)


@query(V.sql("SELECT t.token_id, t.kind, t.amount, t.seq, t.delta_idx FROM events_ e JOIN token_events t ON t.covenant_id = e.covenant_id AND t.seq = e.seq WHERE e.txid = sha256('t5')", "events_", "token_events"))
def token_actions_of_tx(spark, sf_dir):
    deltas = V.token_events(spark, sf_dir, "token_id", "covenant_id")
    return V.digested(K.token_actions(V.events(spark, sf_dir, "covenant_id"), deltas, _hash("t", 5)), token_id="n")


@query("SELECT event_id * 10 AS daa, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS at_ms, event_id % 5 + 1 AS rolled_back FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 25")
def reorg_feed(spark, sf_dir):
    e = F.col("event_id")
    log = table(spark, sf_dir, "events").where("event_type = 'error'").select(e.alias("id"), (e * 10).alias("daa"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("at_ms"), (e % 5 + 1).alias("rolled_back"))
    return K.reorg_feed(log, 25)


_HASHED = "SELECT sha256('c' || l_suppkey) AS covenant_id, CASE l_partkey % 7 WHEN 0 THEN 'token' WHEN 1 THEN 'p2x' WHEN 2 THEN '' WHEN 3 THEN 'lock' END AS revealed_template, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN sha256('h' || CASE l_partkey % 7 WHEN 3 THEN 0 ELSE l_suppkey % 6 END) END AS template_hash FROM lineitem"


def _hashed(spark, sf_dir):
    part = F.col("l_partkey")
    ident = lambda kind, c: F.sha2(F.concat(F.lit(kind), c.cast("string")), 256)
    name = F.when(part % 7 == 0, "token").when(part % 7 == 1, "p2x").when(part % 7 == 2, "").when(part % 7 == 3, "lock")
    return table(spark, sf_dir, "lineitem").select(ident("c", F.col("l_suppkey")).alias("covenant_id"), name.alias("revealed_template"), F.when(part % 4 == 0, "").when(part % 4 == 1, ident("h", F.when(part % 7 == 3, F.lit(0)).otherwise(F.col("l_suppkey") % 6))).alias("template_hash"))


@query(V.sql("SELECT DISTINCT covenant_id, template_hash FROM h WHERE template_hash <> ''", h=_HASHED))
def template_hashes(spark, sf_dir):
    return K.template_hashes(_hashed(spark, sf_dir))


@query(V.sql("SELECT DISTINCT covenant_id FROM h WHERE template_hash = sha256('h3')", h=_HASHED))
def covenants_by_template_hash(spark, sf_dir):
    return K.covenants_by_hash(_hashed(spark, sf_dir), _hash("h", 3))


@query(V.sql("SELECT revealed_template, count(DISTINCT template_hash) AS hashes, CASE WHEN count(DISTINCT template_hash) = 1 THEN max(template_hash) END AS only_hash FROM h WHERE revealed_template <> '' AND template_hash <> '' GROUP BY 1", h=_HASHED))
def hashes_by_template(spark, sf_dir):
    return K.hashes_by_template(_hashed(spark, sf_dir))


_LAST = "SELECT token_id, arg_max(quote_sompi, seq) FILTER (quote_sompi >= 100000000) AS last_quote_sompi FROM trades GROUP BY 1"
_ENTRIES = """SELECT t.token_id, t.name, t.market_covenant_id, p.skeleton, CASE WHEN p.skeleton = 'Brand#1' THEN 'graduated' ELSE 'bonding' END AS phase, last_quote_sompi FROM tokens t JOIN programs p ON p.covenant_id = t.market_covenant_id LEFT JOIN last l ON l.token_id = t.token_id
    WHERE t.status = 'verified' AND p.skeleton IN ('Brand#1', 'Brand#2', 'Brand#3') AND p.invariant_ok AND p.exercised_trades >= 2"""


@query(V.sql("SELECT * FROM entries WHERE phase = 'bonding' AND last_quote_sompi IS NOT NULL AND token_id < 'f' ORDER BY token_id DESC LIMIT 20", "tokens", "programs", "trades", last=_LAST, entries=_ENTRIES))
def market_directory(spark, sf_dir):
    programs = V.programs(spark, sf_dir).withColumn("phase", F.when(F.col("skeleton") == "Brand#1", "graduated").otherwise("bonding"))
    last = M.summary(V.trades(spark, sf_dir), None).select("token_id", "last_quote_sompi")
    entries = K.market_entries(V.tokens(spark, sf_dir), programs, last, V.MATCHED, 2).select("token_id", "name", "market_covenant_id", "skeleton", "phase", "last_quote_sompi")
    return K.market_directory(entries, "bonding", True, "f", 20)


@query(V.sql("SELECT covenant_id, seq, kind FROM events_ WHERE kind = 'burn'", "events_"))
def events_of_kind(spark, sf_dir):
    return K.of_kind(V.events(spark, sf_dir), "retired").select("covenant_id", "seq", "kind")


@query(V.sql("""SELECT covenant_id, seq, coalesce(n, 0) AS consumed, coalesce(m, 0) AS created, CAST(coalesce(v, 0) AS BIGINT) AS consumed_value FROM events_
    LEFT JOIN (SELECT covenant_id, spent_txid AS txid, count(*) AS n, sum(value) AS v FROM cells WHERE spent_txid IS NOT NULL GROUP BY 1, 2) USING (covenant_id, txid) LEFT JOIN (SELECT covenant_id, txid, count(*) AS m FROM cells GROUP BY 1, 2) USING (covenant_id, txid)""", "events_", "cells"))
def event_shapes(spark, sf_dir):
    return K.event_shapes(V.events(spark, sf_dir), V.cells(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

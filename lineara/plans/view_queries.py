"""Queries of what pages show, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import display as P, owners as O
from ..operators import coins as C, tokens as T, views as X
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


_INDEX = {"s": Q._SUMMARY, "i": f"SELECT covenant_id, {Q._NAME} AS name, genesis_daa, last_activity_daa, live_states, live_value, greatest(0, event_count - CASE WHEN genesis_daa IS NULL THEN 0 ELSE 1 END - CASE WHEN live_states = 0 THEN 1 ELSE 0 END) AS moves FROM s"}


def _index(spark, sf_dir):
    rows = C.summaries(V.covenants(spark, sf_dir), V.cells(spark, sf_dir))
    return rows.select("covenant_id", O.friendly_name(F.col("covenant_id")).alias("name"), "genesis_daa", "last_activity_daa", "live_states", "live_value", X.moves().alias("moves"))


@query(V.sql("SELECT * FROM i WHERE contains(lower(name || ' ' || covenant_id), 'a') AND live_states > 0 ORDER BY moves DESC, covenant_id LIMIT 20", "covenants", "cells", **_INDEX))
def index_by_moves(spark, sf_dir):
    return X.filtered(_index(spark, sf_dir), "a", "alive", "moves", 20)


@query(V.sql("SELECT * FROM i ORDER BY genesis_daa NULLS LAST, covenant_id LIMIT 20", "covenants", "cells", **_INDEX))
def index_oldest(spark, sf_dir):
    return X.filtered(_index(spark, sf_dir), order="oldest", limit=20)


@query(V.sql("""SELECT covenant_id, d AS accepting_daa, CAST(coalesce((SELECT sum(value) FROM c u WHERE u.covenant_id = e.covenant_id AND created_daa <= d AND (live OR nxt IS NULL OR d < nxt)), 0) AS BIGINT) AS balance FROM e""", "events_", "cells",
    e="SELECT DISTINCT covenant_id, accepting_daa AS d FROM events_", c="SELECT covenant_id, created_daa, spent_block IS NULL AS live, sum(value) AS value, (SELECT min(d) FROM e WHERE e.covenant_id = cells.covenant_id AND d > created_daa) AS nxt FROM cells GROUP BY ALL"))
def balances_at_events(spark, sf_dir):
    return V.digested(X.balances_at_events(V.events(spark, sf_dir, "covenant_id"), V.cells(spark, sf_dir, "covenant_id")), covenant_id="c")


_HELD = "SELECT token_id, owner, sum(amount) AS balance FROM states WHERE side = 'out' AND proven GROUP BY 1, 2 HAVING sum(amount) > 0"


@query(V.sql("SELECT token_id, owner, CAST(balance AS BIGINT) AS balance, r AS rank, round(balance / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY balance DESC, owner) AS r, sum(balance) OVER (PARTITION BY token_id) AS total FROM h) WHERE r <= 10", "states", h=_HELD))
def holder_ranks(spark, sf_dir):
    held = T.balances(V.states(spark, sf_dir).where("side = 'out'")).withColumn("balance", F.col("balance").cast("long"))
    return X.holder_ranks(held, 10)


@query(V.sql("SELECT token_id, least(owner_from, owner_to) AS a, greatest(owner_from, owner_to) AS b, count(*) AS n, max(seq) AS newest FROM token_events WHERE owner_from <> owner_to AND (token_id, owner_from) IN (SELECT * FROM h) AND (token_id, owner_to) IN (SELECT * FROM h) GROUP BY 1, 2, 3", "token_events", h="SELECT token_id, owner_to FROM token_events WHERE seq > 5 UNION SELECT token_id, owner_from FROM token_events WHERE seq > 5"))
def holder_links(spark, sf_dir):
    deltas = V.token_events(spark, sf_dir, "token_id")
    holders = deltas.where("seq > 5").select("token_id", F.explode(F.array("owner_to", "owner_from")).alias("owner"))
    return V.digested(X.holder_links(deltas, holders), token_id="n")


@query(V.sql("SELECT covenant_id, tokens, coalesce(n, 0) AS live_states, CAST(coalesce(v, 0) AS BIGINT) AS live_value FROM (SELECT covenant_id, string_agg(DISTINCT token_id, ',' ORDER BY token_id) AS tokens FROM token_events WHERE kind = 'mint' AND seq < 4 GROUP BY 1) LEFT JOIN (SELECT covenant_id, count(*) FILTER (spent_block IS NULL) AS n, sum(value) FILTER (spent_block IS NULL) AS v FROM cells GROUP BY 1) USING (covenant_id)", "token_events", "cells"))
def minter_directory(spark, sf_dir):
    pins = V.token_events(spark, sf_dir).where("kind = 'mint' and seq < 4").select(F.col("covenant_id").alias("minter_covenant_id"), "token_id")
    return X.minter_directory(pins, V.cells(spark, sf_dir))


@query(V.sql("SELECT token_id, count(value) AS cells, CAST(coalesce(sum(value), 0) AS BIGINT) AS value, count(*) FILTER (value IS NULL) AS omitted_unvalued FROM (SELECT token_id, CASE WHEN idx <> 3 THEN 1 END AS k, txid, idx FROM states WHERE side = 'in' AND proven) p LEFT JOIN (SELECT txid, output_index, max(value) AS value FROM cells GROUP BY 1, 2) c ON c.txid = p.txid AND c.output_index = p.idx AND p.k = 1 GROUP BY 1", "states", "cells"))
def valued_token_cells(spark, sf_dir):
    proven = V.states(spark, sf_dir).where("side = 'in' and proven").select("token_id", "txid", F.when(F.col("idx") != 3, F.col("idx")).alias("output_index"))
    one = V.cells(spark, sf_dir).groupBy("txid", "output_index").agg(F.max("value").alias("value"))
    return X.valued_cells(proven, one)


_LISTED = "SELECT sha256('c' || c_custkey) AS covenant_id, CASE WHEN c_custkey % 4 <> 0 THEN sha256('g' || (c_custkey % 5)) END AS genesis_txid, CASE WHEN c_custkey % 3 <> 0 THEN sha256('m' || (c_custkey % 7)) END AS curve, CASE WHEN c_custkey % 2 = 0 THEN sha256('o' || (c_custkey % 3)) END AS creator, c_custkey AS k FROM customer"


@query(f"""WITH l AS ({_LISTED}), f AS (SELECT *, k % 11 <> 0 AS has, k % 6 <> 0 AS known, sha256('g' || (k % 10 % 5)) AS fact_txid, '02' || sha256('m' || (k % 14 % 7 + k % 2)) AS own, CASE WHEN k % 8 = 0 THEN '02' ELSE '00' END || sha256('o' || (k % 6 % 3 + k % 5 % 2)) AS first FROM l),
    c AS (SELECT covenant_id, CASE WHEN genesis_txid IS NULL THEN 'not_stated' WHEN NOT has THEN 'unproven' WHEN genesis_txid = fact_txid THEN 'match' ELSE 'differ' END AS genesis_check,
    CASE WHEN curve IS NULL THEN 'not_stated' WHEN NOT has OR NOT known THEN 'unproven' WHEN substr(own, 3) = curve THEN 'match' ELSE 'differ' END AS market_check,
    CASE WHEN creator IS NULL THEN 'not_stated' WHEN NOT has OR NOT known THEN 'unproven' WHEN substr(first, 3) = creator THEN 'match' WHEN first LIKE '02%' THEN 'unproven' ELSE 'differ' END AS creator_check FROM f)
    SELECT *, (genesis_check = 'match' OR market_check = 'match' OR creator_check = 'match') AND genesis_check IN ('match', 'not_stated') AND market_check IN ('match', 'not_stated') AND creator_check IN ('match', 'not_stated') AS all_checks_passed FROM c""")
def registry_checks(spark, sf_dir):
    k = F.col("c_custkey")
    h = lambda p, x: F.sha2(F.concat(F.lit(p), x.cast("string")), 256)
    rows = table(spark, sf_dir, "customer").select(k)
    listed = rows.select(h("c", k).alias("covenant_id"), F.when(k % 4 != 0, h("g", k % 5)).alias("genesis_txid"), F.when(k % 3 != 0, h("m", k % 7)).alias("curve_covenant_id"), F.lit(None).cast("string").alias("pool_covenant_id"), F.when(k % 2 == 0, h("o", k % 3)).alias("creator"))
    kind = F.when(k % 8 == 0, "02").otherwise("00")
    facts = rows.where(k % 11 != 0).select(
        h("c", k).alias("covenant_id"), (k % 6 != 0).alias("known"), h("g", k % 10 % 5).alias("genesis_txid"), F.array(F.concat(F.lit("02"), h("m", k % 14 % 7 + k % 2))).alias("owners"), F.array(F.concat(kind, h("o", k % 6 % 3 + k % 5 % 2))).alias("genesis_owners"),
    )
    return X.claims_checked(listed, facts)


@query("SELECT count(*) FILTER (epoch_ms(ts) >= 1706000000000 - 3600000) AS last_hour, count(*) AS all_time, CAST(coalesce(sum(event_id % 4), 0) AS BIGINT) AS depth FROM events WHERE event_type = 'error'")
def reorg_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_id") % 4).alias("rolled_back"))
    return X.reorg_summary(rows, 1_706_000_000_000)


@query("""SELECT user_id AS txid, arg_max(event_id % 5, (event_id % 5, live, event_id)) AS version, max(live) AS n FROM (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS live FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1""".replace(", max(live) AS n", ""))
def pending_reconciled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("txid"), (F.col("event_id") % 5).alias("version"), F.col("event_type").alias("kind"))
    return X.reconciled(rows.where("kind = 'view'"), rows.where("kind = 'click'")).select("txid", "version")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%G-W%V') AS week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday,
    CASE WHEN o_totalprice <= 0 THEN 'zero' WHEN o_totalprice < 150000 THEN 'dust' ELSE 'above' END AS size_class, least(5000 * (1 << greatest(0, least(o_orderkey % 9, 5) - 1)), 60000) AS wait,
    1700000000000 - (1000000 - o_orderkey) * 100 AS at_ms FROM orders""")
def shown_orders(spark, sf_dir):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", P.iso_date(ms).alias("day"), P.iso_week(ms).alias("week"), P.monday(ms).alias("monday"), P.balance_class(F.col("o_totalprice"), 150_000).alias("size_class"),
        P.backoff(F.col("o_orderkey") % 9, 5000, 60_000).alias("wait"), P.daa_to_ms(F.col("o_orderkey"), 1_000_000, 1_700_000_000_000).alias("at_ms"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

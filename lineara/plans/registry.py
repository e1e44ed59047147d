"""Every query of the library over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact, payload
from ..operators import coins, holdings as H, ledger as L, tokens, traffic
from ..session import shared_dir, table
from . import chain_queries, lineage_queries, lookup_queries, proof_queries, report_queries, traffic_queries, view_queries

FLAGSHIP = "activity_histogram"
KINDS = ["signup", "purchase", "error", "click", "view"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


S = "CAST(floor(epoch(ts)) AS BIGINT)"
_PIVOT = ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS)
_CENTS = "CAST({} AS DECIMAL(18,2))"


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_PIVOT}, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def activity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day, pivoted by kind with conditional counts."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KINDS], F.countDistinct("user_id").alias("n_users")
    )


@query("""SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_holders, count(*) FILTER (o_orderstatus = 'O') AS n_open,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, max(o_totalprice) AS max_value FROM orders""")
def stats_global(spark, sf_dir):
    return H.stats(table(spark, sf_dir, "orders"))


@query(f"SELECT {S} // 14400 * 14400 AS bucket, {_PIVOT} FROM events WHERE {S} >= 1704500000 GROUP BY 1")
def activity_buckets(spark, sf_dir):
    return L.activity(table(spark, sf_dir, "events"), KINDS, 14400, F.lit(1704500000))


@query(f"""WITH r AS (SELECT * FROM events WHERE {S} >= greatest(0, (SELECT max({S}) FROM events) - 86400)), b AS (SELECT user_id, sum(CAST(value AS DECIMAL(18,2))) AS v FROM r WHERE event_type = 'signup' GROUP BY 1),
    n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1) SELECT count(*) FILTER (event_type = 'signup') AS births, count(*) FILTER (event_type = 'click') AS moves, count(*) FILTER (event_type = 'error') AS burns,
    count(DISTINCT user_id) AS active, CAST((SELECT coalesce(sum(v), 0) FROM b) AS DOUBLE) AS value_born, (SELECT user_id FROM n ORDER BY n DESC, user_id LIMIT 1) AS busiest, (SELECT n FROM n ORDER BY n DESC, user_id LIMIT 1) AS busiest_n,
    (SELECT user_id FROM b ORDER BY v DESC, user_id LIMIT 1) AS biggest, CAST((SELECT v FROM b ORDER BY v DESC, user_id LIMIT 1) AS DOUBLE) AS biggest_value FROM r""")
def digest_window(spark, sf_dir):
    return L.digest(table(spark, sf_dir, "events"), L.DAY)


@query("SELECT user_id, count(*) AS n_events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def busiest_entity(spark, sf_dir):
    return L.busiest(table(spark, sf_dir, "events"), 10)


_SPANS = f"""WITH born AS (SELECT user_id, min({S}) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1),
    spans AS (SELECT {S} * 10 - t0 * 10 AS life FROM events JOIN born USING (user_id) WHERE event_type = 'error' AND {S} >= t0)"""


def _lives(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "genesis").when(F.col("event_type") == "error", "burn")
    return coins.lifespans(table(spark, sf_dir, "events").select(F.col("user_id").alias("covenant_id"), kind.alias("kind"), (L.seconds(F.col("ts")) * 10).alias("accepting_daa")))


@query(f"{_SPANS} SELECT class, label, coalesce(n, 0) AS n FROM ({chain_queries._LABELS}) LEFT JOIN (SELECT {chain_queries._CLASS} AS class, count(*) AS n FROM spans GROUP BY 1) USING (class)")
def lifespan_histogram(spark, sf_dir):
    return coins.lifespan_classes(_lives(spark, sf_dir))


@query(f"{_SPANS} SELECT life AS median FROM (SELECT life, row_number() OVER (ORDER BY life) - 1 AS i, count(*) OVER () AS n FROM spans) WHERE i = n // 2")
def lifespan_median_upper(spark, sf_dir):
    return L.upper_median(_lives(spark, sf_dir), "life")


@query("""WITH b AS (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1)
    SELECT o_orderpriority, count(*) AS n_cells, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM lineitem l JOIN b ON l.l_orderkey = b.l_orderkey AND l_shipdate = d JOIN orders ON o_orderkey = l.l_orderkey GROUP BY 1""")
def born_value(spark, sf_dir):
    """Value of the cells that were created first in their transaction, by class; one shuffle of the cells."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    first = lines.groupBy("l_orderkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"), F.sum(L.money(F.col("l_extendedprice"))).alias("v"))
    first = first.groupBy("l_orderkey").agg(F.min_by(F.struct("n", "v"), "l_shipdate").alias("f"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return first.join(orders, "l_orderkey").groupBy("o_orderpriority").agg(F.sum("f.n").alias("n_cells"), F.sum("f.v").cast("double").alias("value"))


_HELD = "(SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS balance, count(*) AS n_orders FROM orders GROUP BY 1)"


@query(f"SELECT o_custkey, CAST(balance AS DOUBLE) AS balance, n_orders FROM {_HELD} h ORDER BY h.balance DESC, o_custkey LIMIT 20")
def holders_topk(spark, sf_dir):
    return H.holders_page(H.balances(table(spark, sf_dir, "orders")), None, 20)


@query(f"SELECT o_custkey, CAST(balance AS DOUBLE) AS balance, n_orders FROM {_HELD} h WHERE h.balance < 900000.00 OR (h.balance = 900000.00 AND o_custkey > 7) ORDER BY h.balance DESC, o_custkey LIMIT 20")
def holders_page(spark, sf_dir):
    return H.holders_page(H.balances(table(spark, sf_dir, "orders")), ("900000.00", 7), 20)


@query(f"""SELECT o_custkey, CAST(CAST(balance * 100 AS HUGEINT) * 10000 // (SELECT CAST(sum(balance) * 100 AS HUGEINT) FROM {_HELD}) AS BIGINT) AS bps
    FROM {_HELD} h ORDER BY h.balance DESC, o_custkey LIMIT 50""")
def holder_shares(spark, sf_dir):
    return H.shares_bps(H.balances(table(spark, sf_dir, "orders")), 50)


@query(f"""WITH p AS (SELECT c_mktsegment, sum(balance) AS s FROM customer JOIN {_HELD} ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_mktsegment, CASE WHEN (SELECT sum(s) FROM p) = (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) THEN CAST(s AS DOUBLE) END AS supply FROM p""")
def supply_split_audit(spark, sf_dir):
    return H.split_audit(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


@query("""WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, bool_or(l_returnflag = 'N') AS minter FROM lineitem GROUP BY 1),
    k AS (SELECT *, CASE WHEN s IS NULL THEN 'opaque' WHEN s > CAST(o_totalprice AS DECIMAL(18,2)) THEN 'mint' WHEN s < CAST(o_totalprice AS DECIMAL(18,2)) THEN 'burn' ELSE 'transfer' END AS kind FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
    SELECT kind, coalesce(kind IN ('mint', 'burn') AND NOT minter, false) AS violation, count(*) AS n FROM k GROUP BY 1, 2""")
def conservation_classify(spark, sf_dir):
    return H.conservation(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_entities, count(*) AS n_cells FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def multi_entity_txs(spark, sf_dir):
    return H.multi_entity(table(spark, sf_dir, "lineitem"), 3)


_PAIRS = """(SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x
    JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2)"""


@query(f"SELECT * FROM {_PAIRS}")
def co_move_edges(spark, sf_dir):
    return H.co_moves(table(spark, sf_dir, "lineitem"))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {_PAIRS} UNION SELECT b, a FROM {_PAIRS}), reach(id, r) AS (SELECT a, a FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a)
    SELECT id, min(r) AS family FROM reach GROUP BY 1""")
def families_components(spark, sf_dir):
    shared_dir(spark)
    return H.families(H.co_links(table(spark, sf_dir, "lineitem")))


@query(f"""WITH s AS (SELECT DISTINCT {S} AS hi FROM events), g AS (SELECT lag(hi) OVER (ORDER BY hi) AS lo, hi FROM s)
    SELECT lo, hi, hi - lo AS gap FROM g WHERE lo IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 5""")
def find_gap_lag(spark, sf_dir):
    return L.widest_gaps(table(spark, sf_dir, "events"), 5)


_FEED = f"SELECT {S} AS second, event_id, user_id, event_type FROM events"


@query(f"{_FEED} ORDER BY 1, 2 LIMIT 100")
def feed_canonical(spark, sf_dir):
    return L.feed(table(spark, sf_dir, "events"), None, 100)


@query(f"{_FEED} WHERE {S} > 1704800000 OR ({S} = 1704800000 AND event_id > 5) ORDER BY 1, 2 LIMIT 100")
def feed_after_cursor(spark, sf_dir):
    return L.feed(table(spark, sf_dir, "events"), (1704800000, 5), 100)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def resequence(spark, sf_dir):
    return L.resequence(table(spark, sf_dir, "events"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events WHERE strftime(ts, '%Y-%m-%d') NOT IN ('2024-01-10', '2024-01-11') GROUP BY 1")
def rollback_recompute(spark, sf_dir):
    """Entities' figures after two days of blocks are retracted: the log without them is aggregated anew."""
    ev = table(spark, sf_dir, "events").withColumn("block", F.date_format("ts", "yyyy-MM-dd"))
    removed = spark.createDataFrame([("2024-01-10",), ("2024-01-11",)], "block string")
    return L.rollback(ev, removed, "block").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, user_id, event_type FROM events")
def gap_merge_dedup(spark, sf_dir):
    """A log with a hole, and recovered rows that overlap with it, give the whole log."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    third = F.pmod(F.col("event_id"), F.lit(3))
    return L.gap_merge(ev.where(third != 1), ev.where(third != 0), ["event_id"])


@query("""SELECT * EXCLUDE n FROM (SELECT conv_id, turn, role AS value, lag(role) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE n = 1 OR value IS DISTINCT FROM before""")
def state_diffs_lag(spark, sf_dir):
    return L.state_changes(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def balance_asof(spark, sf_dir):
    return L.as_of(table(spark, sf_dir, "events"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


_SESSIONS = f"""(SELECT user_id, session, min(s) AS begins, max(s) AS ends, count(*) AS n_events FROM (
    SELECT user_id, s, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS session FROM (
    SELECT user_id, event_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 1800 THEN 1 ELSE 0 END AS new FROM (SELECT *, {S} AS s FROM events))) GROUP BY 1, 2)"""


@query(f"SELECT * FROM {_SESSIONS}")
def sessions_30m(spark, sf_dir):
    return L.sessions(table(spark, sf_dir, "events"), 1800)


@query(f"SELECT n_events, count(*) AS n_sessions, CAST(max(ends - begins) AS BIGINT) AS longest FROM {_SESSIONS} GROUP BY 1")
def session_counts(spark, sf_dir):
    return L.sessions(table(spark, sf_dir, "events"), 1800).groupBy("n_events").agg(F.count(F.lit(1)).alias("n_sessions"), F.max(F.col("ends") - F.col("begins")).alias("longest"))


@query(f"""SELECT {S} // 3600 * 3600 AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    count(*) AS n_trades, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume, arg_max(event_id, (ts, event_id)) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def ohlc_candles(spark, sf_dir):
    return L.candles(table(spark, sf_dir, "events").where("event_type = 'purchase'"), L.HOUR)


_PLACE = "CASE " + " ".join(f"WHEN value / 10 <= {x} THEN {i}" for i, x in enumerate(traffic.LATENCIES[:-1])) + f" ELSE {len(traffic.LATENCIES) - 1} END"
_BOUND = "[" + ", ".join(map(str, traffic.LATENCIES[:-1])) + ", NULL]"


@query(f"""WITH c AS (SELECT {_PLACE} AS place, count(*) AS n FROM events GROUP BY 1), r AS (SELECT place, sum(n) OVER (ORDER BY place) AS upto, sum(n) OVER () AS total FROM c)
    SELECT CAST(any_value(total) AS BIGINT) AS total, {_BOUND}[min(place) FILTER (upto >= ceil(total * 50 / 100)) + 1] AS p50, {_BOUND}[min(place) FILTER (upto >= ceil(total * 95 / 100)) + 1] AS p95 FROM r""")
def latency_histogram_p50_p95(spark, sf_dir):
    return traffic.latency(table(spark, sf_dir, "events").select((F.col("value") / 10).alias("seconds")))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (event_type = 'signup') AS plus, count(*) FILTER (event_type = 'error') AS minus FROM events GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM c), (SELECT max(d) FROM c), INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(plus, 0) AS plus, coalesce(minus, 0) AS minus, CAST(sum(coalesce(plus, 0) - coalesce(minus, 0)) OVER (ORDER BY d) AS BIGINT) AS alive FROM s LEFT JOIN c USING (d)""")
def cumulative_flow(spark, sf_dir):
    return L.flow(table(spark, sf_dir, "events"), "signup", "error")


@query("""SELECT p_type, count(*) AS n_templates, count(DISTINCT p_brand) AS n_brands, max(CASE p_brand WHEN 'Brand#1' THEN 3 WHEN 'Brand#2' THEN 2 ELSE 1 END) AS best,
    CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM part GROUP BY 1""")
def template_stats(spark, sf_dir):
    best = F.when(F.col("p_brand") == "Brand#1", 3).when(F.col("p_brand") == "Brand#2", 2).otherwise(1)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_templates"), F.countDistinct("p_brand").alias("n_brands"), F.max(best).alias("best"), L.total(F.col("p_retailprice")).alias("value")
    )


@query("""SELECT CASE WHEN strlen(text) < 4 THEN '' WHEN text LIKE '{"%' THEN 'json' WHEN text LIKE '7b22%' THEN 'jsonhex' ELSE 'tag:' || lower(substr(hex(encode(text)), 1, 8)) END AS tag, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
    FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def payload_tag_breakdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(payload.payload_tag(F.encode("text", "UTF-8")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("""WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT user_id AS token_id, a.status AS was, b.status AS now, CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (user_id) WHERE a.status IS DISTINCT FROM b.status""")
def verdict_diff(spark, sf_dir):
    """Entities whose last status differs between two windows, or that only one of them has."""
    ev, at = table(spark, sf_dir, "events"), lambda d: F.lit(d).cast("timestamp_ntz")
    last = lambda rows: rows.groupBy(F.col("user_id").alias("token_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return tokens.status_changes(last(ev.where(F.col("ts") < at("2024-01-05"))), last(ev.where(F.col("ts") >= at("2024-01-20"))))


@query("SELECT c_custkey, c_name, CASE WHEN c_name = 'Customer#000000012' THEN 100 WHEN starts_with(c_name, 'Customer#0000001') THEN 50 WHEN contains(c_name, '12') THEN 10 END AS score FROM customer WHERE score IS NOT NULL ORDER BY score DESC, c_custkey LIMIT 25")
def search_ranked(spark, sf_dir):
    name = F.col("c_name")
    score = F.when(name == "Customer#000000012", 100).when(name.startswith("Customer#0000001"), 50).when(name.contains("12"), 10)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "c_custkey").limit(25)


@query("""SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS HUGEINT) * least(greatest(1000000000 - CAST(floor(epoch(o_orderdate)) AS BIGINT), 0), 200000000) // 200000000 AS BIGINT) AS vested FROM orders""")
def vesting_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", exact.vested(F.floor("o_totalprice"), L.seconds(F.col("o_orderdate")), 200_000_000, 1_000_000_000).alias("vested"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS b1, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS q1 FROM events GROUP BY 1),
    p AS (SELECT strftime(d, '%Y-%m-%d') AS day, lag(b1) OVER (ORDER BY d) AS b0, lag(q1) OVER (ORDER BY d) AS q0, b1, q1 FROM d)
    SELECT day, b0, q0, b1, q1, CAST(CASE WHEN b0 > 0 AND q0 > 0 AND b1 > 0 THEN (CAST(q1 AS HUGEINT) * b0 - CAST(q0 AS HUGEINT) * b1) * 10000 // (CAST(q0 AS HUGEINT) * b1) END AS BIGINT) AS bps FROM p""")
def change_bps_cross(spark, sf_dir):
    from pyspark.sql import Window as W

    day = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("b1"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("q1"))
    w = W.orderBy("day")  # one row a day
    rows = day.select("day", F.lag("b1").over(w).alias("b0"), F.lag("q1").over(w).alias("q0"), "b1", "q1")
    return rows.withColumn("bps", exact.change_bps(*[F.col(c) for c in ("q0", "b0", "q1", "b1")]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | chain_queries.queries() | traffic_queries.queries() | view_queries.queries() | proof_queries.queries() | lookup_queries.queries() | report_queries.queries() | lineage_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _ORACLE | chain_queries.oracle_sql() | traffic_queries.oracle_sql() | view_queries.oracle_sql() | proof_queries.oracle_sql() | lookup_queries.oracle_sql() | report_queries.oracle_sql() | lineage_queries.oracle_sql()

"""The traffic report and the streaming queries over the driver's events, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import traffic as T, upkeep as U
from ..session import shared_dir, table
from ..streaming import windows as W

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests of an access log."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    n, text = e % 9, lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    uri = (
        F.when(n == 0, "/").when(n == 1, "/tokens").when(n == 2, text("/data/mainnet/c/", F.sha2(text("c", u), 256), ".json")).when(n == 3, text("/data/mainnet/addr/a:", u, "?x=1")).when(n == 4, "/health")
        .when(n == 5, "/wp-login.php").when(n == 6, "/explore/").when(n == 7, "/data/stream").otherwise("/img/logo.png")
    )
    agent = F.when(u % 7 == 0, "Googlebot/2.1").when(u % 7 == 1, "curl/8").otherwise("Mozilla/5.0")
    one = lambda x: F.when(x.isNotNull(), F.array(x))
    heads = F.map_filter(
        F.create_map(
            F.lit("user-agent"), one(agent), F.lit("Cf-Connecting-Ip"), one(F.when(u % 3 != 0, text("u", u, ", proxy"))), F.lit("Sec-Fetch-Site"), one(F.when(e % 4 == 0, "same-origin")),
            F.lit("Referer"), one(F.when(e % 4 == 1, "https://www.lineara.example/x").when(e % 4 == 2, "https://other.example/")),
        ), lambda k, v: v.isNotNull(),
    )
    request = F.struct(F.when(e % 10 == 0, "POST").otherwise("GET").alias("method"), uri.alias("uri"), heads.alias("headers"), F.lit("r").alias("remote_ip"), text("i", u).alias("client_ip"))
    return table(spark, sf_dir, "events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200).alias("status"), F.floor(F.col("value") * 100).alias("size"), (F.col("value") / 50).alias("duration"), request.alias("request"),
    )


_LOG = """WITH l AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status, CAST(floor(value * 100) AS BIGINT) AS size, value / 50 AS duration, event_id % 9 AS p,
    user_id % 7 = 0 OR event_id % 9 = 5 AS bot, user_id % 7 > 1 AS browser, event_id % 10 <> 0 AS get, event_id % 4 < 2 AS own, user_id, CASE WHEN user_id % 3 <> 0 THEN 'u' || user_id ELSE 'i' || user_id END AS key FROM events),
    r AS (SELECT *, get AND status < 400 AND browser AND p IN (0, 1, 6) AS page_view, p IN (2, 3, 7) AS api, p IN (2, 3, 7) AND own AS first_party, CASE p WHEN 0 THEN '/' WHEN 1 THEN '/tokens' WHEN 2 THEN '/data/mainnet/c/:id.json' WHEN 3 THEN '/data/mainnet/addr/:address' WHEN 4 THEN '/health'
    WHEN 5 THEN '/wp-login.php' WHEN 6 THEN '/explore/' WHEN 7 THEN '/data/stream' ELSE '/img/logo.png' END AS endpoint FROM l)"""
_COUNTERS = """count(*) AS requests, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_out, count(*) FILTER (status >= 400) AS errors, count(*) FILTER (bot) AS bot_requests, count(*) FILTER (api) AS api_calls, count(*) FILTER (first_party) AS first_party_api_calls,
    count(*) FILTER (api AND NOT first_party) AS external_api_calls, count(*) FILTER (p = 4) AS health_checks, count(*) FILTER (page_view) AS page_views"""


def _rows(spark, sf_dir):
    return T.prepared(access_log(spark, sf_dir))


@query(f"{_LOG} SELECT {_COUNTERS}, count(DISTINCT key) FILTER (page_view) AS unique_visitors, count(DISTINCT key) FILTER (browser AND (page_view OR first_party)) AS active_browsers FROM r")
def traffic_totals(spark, sf_dir):
    return T.totals(_rows(spark, sf_dir))


@query(f"{_LOG} SELECT key, CAST(sum(CASE WHEN gap > 1800 OR gap IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sessions FROM (SELECT key, ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) AS gap FROM r WHERE page_view) GROUP BY 1")
def traffic_sessions(spark, sf_dir):
    return T.page_sessions(_rows(spark, sf_dir))


@query(f"{_LOG} SELECT (status // 100) || 'xx' AS class, count(*) AS n FROM r GROUP BY 1")
def traffic_status(spark, sf_dir):
    return T.status_classes(_rows(spark, sf_dir))


_PLACE = "CASE " + " ".join(f"WHEN duration <= {x} THEN {i}" for i, x in enumerate(T.LATENCIES[:-1])) + f" ELSE {len(T.LATENCIES) - 1} END"
_BOUND = "[" + ", ".join(map(str, T.LATENCIES[:-1])) + ", NULL]"


@query(f"""{_LOG}, c AS (SELECT {_PLACE} AS place, count(*) AS n FROM r WHERE p <> 7 GROUP BY 1), u AS (SELECT place, sum(n) OVER (ORDER BY place) AS upto, sum(n) OVER () AS total FROM c)
    SELECT CAST(any_value(total) AS BIGINT) AS total, {_BOUND}[min(place) FILTER (upto >= ceil(total * 50 / 100)) + 1] AS p50, {_BOUND}[min(place) FILTER (upto >= ceil(total * 95 / 100)) + 1] AS p95 FROM u""")
def traffic_latency(spark, sf_dir):
    return T.latency(_rows(spark, sf_dir).where("not stream").select(F.col("duration").alias("seconds")))


@query(f"{_LOG} SELECT endpoint, count(*) AS n FROM r WHERE page_view GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def traffic_top_pages(spark, sf_dir):
    return T.top(_rows(spark, sf_dir), "page_view", 10)


@query(f"{_LOG} SELECT endpoint, count(*) AS n FROM r WHERE api GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def traffic_top_api(spark, sf_dir):
    return T.top(_rows(spark, sf_dir), "api", 10)


@query(f"{_LOG} SELECT strftime(to_timestamp(ts), '%Y-%m-%d %H:00') AS hour, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def traffic_busiest_hour(spark, sf_dir):
    return T.busiest_hour(_rows(spark, sf_dir))


@query(f"{_LOG} SELECT ts // 21600 * 21600 AS bucket, {_COUNTERS} FROM r GROUP BY 1")
def traffic_series(spark, sf_dir):
    return T.series(_rows(spark, sf_dir), 21600)


_NOW, _SPANS = 1_706_500_000, {"5m": 300, "24h": 86400, "7d": 604800, "30d": 2592000}
_WINDOWS = "(VALUES " + ", ".join(f"('{n}', {_NOW - s})" for n, s in _SPANS.items()) + ") w(name, since)"


@query(f"{_LOG} SELECT name AS \"window\", {_COUNTERS} FROM r JOIN {_WINDOWS} ON ts >= since GROUP BY 1")
def multi_window_traffic(spark, sf_dir):
    return T.windows(_rows(spark, sf_dir), float(_NOW), _SPANS)


# Streaming: the same file, read as a stream until it ends.


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over what is there and return its result, which the sink keeps below the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/" + ("all" if mode == "complete" else f"b={number}"))

    # Rows of an output that has none still need a schema, hence the empty first folder.
    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


_S = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"SELECT {_S} // 3600 * 3600 AS start, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1")
def stream_activity(spark, sf_dir):
    out = drained(W.activity(event_stream(spark, sf_dir), "1 hour", "1 day", ["signup", "error"]), "complete")
    return out.withColumn("start", F.unix_seconds("start"))


@query(f"SELECT e AS \"end\", count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM (SELECT value, unnest(range({_S} // 21600 * 21600 + 21600, {_S} // 21600 * 21600 + 21600 + 86400, 21600)) AS e FROM events) GROUP BY 1")
def stream_trailing_day(spark, sf_dir):
    out = drained(W.trailing(event_stream(spark, sf_dir), "24 hours", "6 hours", "1 day"), "complete")
    return out.withColumn("end", F.unix_seconds("end"))


@query(f"""SELECT user_id, min(s) AS begins, max(s) + 1800 AS ends, count(*) AS n FROM (SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM (
    SELECT user_id, event_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 1800 THEN 1 ELSE 0 END AS new FROM (SELECT *, {_S} AS s FROM events))) GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    out = drained(W.sessions(rows, "30 minutes", "1 day"), "complete")
    return out.withColumns({c: F.unix_seconds(c) for c in ("begins", "ends")})


@query(f"SELECT user_id AS key, {_S} AS at, was, event_type AS now FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS was FROM events) WHERE was <> event_type")
def stream_changes(spark, sf_dir):
    out = drained(W.changes(event_stream(spark, sf_dir), "user_id", "event_type"), "append")
    return out.select("key", F.unix_seconds("ts").alias("at"), "was", "now")


# Keyed writes and proofs.


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def upsert_latest(spark, sf_dir):
    """Orders before a date are the table; the rest is upserted with the latest row of each key."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    early = rows.where(F.col("at.o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    old = early.groupBy("o_custkey").agg(F.max_by(F.struct("at", "status"), "at").alias("r")).select("o_custkey", "r.*")
    late = rows.where(F.col("at.o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return U.upsert(old, late, ["o_custkey"], "at").select("o_custkey", "status")


_PICK = "['a', 'b', 'c', 'd'][(event_id % 4) + 1]"


@query(f"WITH b AS (SELECT user_id, arg_max({_PICK}, (ts, {_PICK})) AS c FROM events GROUP BY 1) SELECT o AS option, count(c) AS votes FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS o) LEFT JOIN b ON c = o GROUP BY 1")
def ballot_tally(spark, sf_dir):
    choice = F.get(F.array(*map(F.lit, "abcd")), (F.col("event_id") % 4).cast("int"))
    ballots = table(spark, sf_dir, "events").select(F.col("user_id").alias("voter"), choice.alias("choice"), F.col("ts").alias("at"))
    early = F.col("at") < F.lit("2024-01-15").cast("timestamp_ntz")
    options = spark.createDataFrame([(x,) for x in "abcde"], "option string")
    return U.tally(U.cast_ballots(ballots.where(early), ballots.where(~early)), options)


@query("""WITH RECURSIVE tree(level, i, h, n) AS (SELECT 0, row_number() OVER (ORDER BY c_custkey) - 1, sha256(c_name), (SELECT count(*) FROM customer) FROM customer
    UNION ALL SELECT level + 1, i // 2, CASE WHEN b IS NULL THEN a ELSE sha256(unhex(least(a, b) || greatest(a, b))) END, (n + 1) // 2 FROM (SELECT level, i, h AS a, lead(h) OVER (PARTITION BY level ORDER BY i) AS b, n FROM tree WHERE n > 1) WHERE i % 2 = 0)
    SELECT h FROM tree WHERE n = 1""")
def merkle_root(spark, sf_dir):
    # The places of the leaves follow the key, which is dense in this table.
    leaves = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.sha2("c_name", 256).alias("h"))
    return U.merkle_root(leaves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

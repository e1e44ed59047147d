"""Report over an access log: one row for each request (ts, status, size, duration, request).

``prepared`` derives what every figure needs in one native pass; the figures are aggregates over it. Rows of the report's own
dashboard are left out. Missing fields count as nothing. Ties of a top list go to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

GAP = 30 * 60

# Fixed values of the report: paths, extensions, marks of bots, patterns, and upper bounds of the latency classes in seconds.
API = "/data/"
INTERNAL = ("/health", "/healthz")
DASHBOARD = "/ops/traffic"
NO_PAGE_PREFIXES = ("/data/", "/og/", "/badge/", "/img/", "/share/", "/ops/")
NO_PAGES = ("/sitemap.xml", "/feed.xml", "/robots.txt", "/favicon.ico")
PAGES = ("/", "/build", "/changelog", "/decode", "/dev", "/explore", "/guide", "/guide.html", "/playground", "/preflight", "/tokens")
ASSETS = (".avif", ".css", ".gif", ".ico", ".jpeg", ".jpg", ".js", ".json", ".map", ".mp4", ".png", ".svg", ".webm", ".webmanifest", ".woff", ".woff2")
BOTS = "bot|crawler|spider|slurp|facebookexternalhit|twitterbot|discordbot|telegrambot|whatsapp|uptime|monitoring|probe"
PROBES = r"(?i)(^|/)(?:wp-|xmlrpc(?:\.php)?|cgi-bin|\.env|phpmyadmin|actuator|admin(?:/|$))|\.php(?:/|$)"
LATENCIES = (0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.0, 2.5, 5.0, 10.0, float("inf"))


def header(headers: Column, name: str) -> Column:
    """First value of a header, whatever the case of its name; '' if there is none."""
    found = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower()))
    return F.coalesce(F.get(F.get(found, F.lit(0)), F.lit(0)), F.lit(""))


def normalized(path: Column) -> Column:
    """A path with ids, addresses and long numbers named instead of spelled."""
    path = F.regexp_replace(path, r"(?<=/)[0-9a-fA-F]{32,}(?=/|$|\.json)", ":id")
    path = F.regexp_replace(path, r"(?<=/addr/)[^/]+(?=/|$)", ":address")
    return F.regexp_replace(path, r"(?<=/)\d{4,}(?=/|$)", ":n")


def visitor(request: Column) -> Column:
    """The edge's address of the visitor, else the proxy's; '' if there is none."""
    tries = [F.nullif(F.trim(F.substring_index(header(request["headers"], n), ",", 1)), F.lit("")) for n in ("Cf-Connecting-Ip", "True-Client-Ip", "X-Forwarded-For")]
    return F.coalesce(*tries, F.nullif(request["client_ip"], F.lit("")), request["remote_ip"], F.lit(""))


def prepared(log: DataFrame, hosts: tuple[str, ...] = ("lineara.example", "www.lineara.example")) -> DataFrame:
    """Requests with their path, flags and visitor key; ``hosts`` are the site's own, for requests that it refers to itself."""
    r = F.col("request")
    path = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(r["uri"], F.lit("/")), r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), F.lit("")), F.lit("/"))
    agent = F.lower(header(r["headers"], "User-Agent"))
    rows = log.select(
        F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("ts"), F.coalesce(F.col("status").cast("int"), F.lit(0)).alias("status"), F.greatest(F.lit(0), F.coalesce(F.col("size").cast("long"), F.lit(0))).alias("size"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("duration").cast("double"), F.lit(0.0))).alias("duration"), F.coalesce(r["method"], F.lit("")).alias("method"), path.alias("path"), agent.alias("agent"),
        visitor(r).alias("key"), F.lower(header(r["headers"], "Sec-Fetch-Site")).alias("site"), F.lower(F.regexp_extract(header(r["headers"], "Referer"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)).alias("host"),
    )
    p, s = F.col("path"), F.col("status")
    rows = rows.where((p != DASHBOARD) & ~p.startswith(DASHBOARD + "/"))
    marked = F.col("agent").rlike(BOTS)
    browser = F.col("agent").contains("mozilla/") & ~marked
    asset = F.lower(F.regexp_extract(p, r"[^/](\.[^./]+)$", 1)).isin(*ASSETS)
    page = F.col("method").isin("GET", "HEAD") & (s >= 200) & (s < 400) & browser & ~asset & ~p.rlike(PROBES) & ~p.isin(*NO_PAGES, *INTERNAL)
    for x in NO_PAGE_PREFIXES:
        page = page & ~p.startswith(x)
    bare = F.regexp_replace(p, "/+$", "")
    page = page & F.when(bare == "", "/").otherwise(bare).isin(*PAGES)
    api = p.startswith(API)
    return rows.select(
        "ts", "status", "size", "duration", "path", "key", browser.alias("browser"), (marked | p.rlike(PROBES)).alias("bot"), page.alias("page_view"), api.alias("api"),
        (api & (F.col("site").isin("same-origin", "same-site") | F.col("host").isin(*hosts))).alias("first_party"), p.isin(*INTERNAL).alias("health"), p.endswith("/stream").alias("stream"), normalized(p).alias("endpoint"),
    )


def counters() -> list[Column]:
    n = F.count_if
    return [
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_out"), n(F.col("status") >= 400).alias("errors"), n("bot").alias("bot_requests"), n("api").alias("api_calls"),
        n("first_party").alias("first_party_api_calls"), n(F.col("api") & ~F.col("first_party")).alias("external_api_calls"), n("health").alias("health_checks"), n("page_view").alias("page_views"),
    ]


def totals(rows: DataFrame) -> DataFrame:
    """One row: counters, unique visitors of pages, active browsers."""
    seen = F.col("key") != ""
    return rows.agg(
        *counters(), F.countDistinct(F.when(F.col("page_view") & seen, F.col("key"))).alias("unique_visitors"),
        F.countDistinct(F.when(F.col("browser") & seen & (F.col("page_view") | F.col("first_party")), F.col("key"))).alias("active_browsers"),
    )


def page_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of page views: a new one begins more than GAP seconds after the visitor's latest view so far. A visitor's views are
    cut at days and stitched, so that a key with a third of all rows is a task a day."""
    views = rows.where(F.col("page_view") & (F.col("key") != "")).select("key", "ts", F.floor(F.col("ts") / 86400).alias("d"))
    inside = W.partitionBy("key", "d").orderBy("ts")
    new = views.withColumn("gap", F.col("ts") - F.lag("ts").over(inside))
    days = new.groupBy("key", "d").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("gap") > GAP).alias("n"))
    before = F.lag("last").over(W.partitionBy("key").orderBy("d"))  # one row for each of the visitor's days
    starts = F.when(before.isNull() | (F.col("first") - before > GAP), 1).otherwise(0)
    return days.withColumn("starts", starts).groupBy("key").agg(F.sum(F.col("n") + F.col("starts")).alias("sessions"))


def status_classes(rows: DataFrame) -> DataFrame:
    name = F.when(F.col("status") == 0, "unknown").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    return rows.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """One row with the upper bound of the class in which each percentile falls (null for the open class), and the count."""
    place = F.lit(len(LATENCIES) - 1)
    for i, upper in reversed(list(enumerate(LATENCIES[:-1]))):
        place = F.when(F.col("seconds") <= upper, i).otherwise(place)
    counts = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.sum(F.when(F.col("place") <= i, F.col("n")).otherwise(0)).alias(f"u{i}") for i in range(len(LATENCIES))])

    def bound(p: int) -> Column:
        target, out = F.ceil(F.col("total") * p / 100), F.lit(None).cast("double")
        for i, upper in reversed(list(enumerate(LATENCIES[:-1]))):
            out = F.when(F.col(f"u{i}") >= target, F.lit(upper)).otherwise(out)
        return F.when(F.col("total") == 0, F.lit(0.0)).otherwise(out).alias(f"p{p}")

    return one.select("total", *[bound(p) for p in percents])


def top(rows: DataFrame, flag: str, limit: int) -> DataFrame:
    """Commonest endpoints of the requests with a flag."""
    return rows.where(flag).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "endpoint").limit(limit)


def busiest_hour(rows: DataFrame) -> DataFrame:
    hour = F.date_format(F.timestamp_seconds(F.floor(F.col("ts"))), "yyyy-MM-dd HH:00")
    return rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hour").limit(1)


def series(rows: DataFrame, width: int = 3600) -> DataFrame:
    width = max(60, width)
    return rows.groupBy((F.floor(F.col("ts") / width) * width).cast("long").alias("bucket")).agg(*counters())


def windows(rows: DataFrame, now: float, spans: dict[str, int]) -> DataFrame:
    """Counters of several trailing windows from one scan: each row counts in every window that reaches back to it."""
    names = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(now - s).alias("since")) for n, s in spans.items()])
    fits = F.filter(names, lambda w: F.col("ts") >= w["since"])
    return rows.select("*", F.explode(F.transform(fits, lambda w: w["window"])).alias("window")).groupBy("window").agg(*counters())

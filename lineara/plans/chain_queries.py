"""Queries over the ledger's views of the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact as E, owners as O
from ..operators import coins as C, feeds as D, market as M, tokens as T
from . import chain as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


_SEM = """coalesce(max(CASE WHEN revealed_template IS NOT NULL AND revealed_template <> '' AND revealed_template NOT LIKE 'p2%' THEN revealed_template WHEN template NOT LIKE 'p2%' THEN template END),
    max(coalesce(nullif(revealed_template, ''), template)))"""
_HAS = "((template IS NOT NULL AND template <> '') OR (revealed_template IS NOT NULL AND revealed_template <> ''))"
_SUMMARY = f"""SELECT c.*, (SELECT count(*) FROM cells u WHERE u.covenant_id = c.covenant_id AND spent_block IS NULL) AS live_states,
    CAST((SELECT coalesce(sum(value), 0) FROM cells u WHERE u.covenant_id = c.covenant_id AND spent_block IS NULL) AS BIGINT) AS live_value,
    CAST((SELECT coalesce(sum(value), 0) FROM cells u WHERE u.covenant_id = c.covenant_id AND u.created_daa = c.genesis_daa) AS BIGINT) AS born_value,
    (SELECT {_SEM} FROM cells u WHERE u.covenant_id = c.covenant_id AND {_HAS}) AS template FROM covenants c"""


def _summaries(spark, sf_dir):
    return C.summaries(V.covenants(spark, sf_dir), V.cells(spark, sf_dir))


@query(V.sql("SELECT * FROM s ORDER BY last_activity_daa DESC, covenant_id DESC LIMIT 25", "covenants", "cells", s=_SUMMARY))
def summary_page(spark, sf_dir):
    return C.recency_page(_summaries(spark, sf_dir), None, 25)


@query(V.sql("SELECT * FROM s WHERE last_activity_daa < 25236000 OR (last_activity_daa = 25236000 AND covenant_id < '8') ORDER BY last_activity_daa DESC, covenant_id DESC LIMIT 25", "covenants", "cells", s=_SUMMARY))
def summary_page_after(spark, sf_dir):
    return C.recency_page(_summaries(spark, sf_dir), (25236000, "8"), 25)


@query(V.sql("SELECT * FROM s WHERE covenant_id = sha256('c7')", "covenants", "cells", s=_SUMMARY))
def summary_of_one(spark, sf_dir):
    one = F.col("covenant_id") == F.sha2(F.lit("c7"), 256)
    return C.summaries(V.covenants(spark, sf_dir).where(one), V.cells(spark, sf_dir).where(one))


@query(V.sql("SELECT count(*) AS n FROM covenants", "covenants"))
def covenant_count(spark, sf_dir):
    return V.covenants(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(V.sql("""SELECT (SELECT count(*) FROM covenants) AS covenants, (SELECT count(*) FROM events_) AS events, (SELECT max(accepting_daa) FROM events_) AS last_daa,
    (SELECT count(DISTINCT covenant_id) FROM cells WHERE spent_block IS NULL) AS active, greatest(0, (SELECT count(*) FROM covenants) - (SELECT count(DISTINCT covenant_id) FROM cells WHERE spent_block IS NULL)) AS burned""", "covenants", "cells"))
def ledger_stats(spark, sf_dir):
    one = F.lit(1).alias("_one")
    ev = V.events(spark, sf_dir).agg(F.countDistinct("covenant_id").alias("covenants"), F.count(F.lit(1)).alias("events"), F.max("accepting_daa").alias("last_daa")).select("*", one)
    now = C.live(V.cells(spark, sf_dir)).agg(F.countDistinct("covenant_id").alias("active")).select("*", one)
    return ev.join(F.broadcast(now), "_one").drop("_one").withColumn("burned", F.greatest(F.lit(0), F.col("covenants") - F.col("active")))


@query(V.sql("""SELECT count(*) FILTER (kind = 'genesis') AS births, count(*) FILTER (kind = 'transition') AS moves, count(*) FILTER (kind = 'burn') AS burns, (SELECT CAST(coalesce(sum(v), 0) AS BIGINT) FROM born) AS value_born,
    (SELECT count(DISTINCT covenant_id) FROM cells WHERE spent_block IS NULL) AS active_now, (SELECT covenant_id FROM busy ORDER BY n DESC, covenant_id LIMIT 1) AS busiest, (SELECT n FROM busy ORDER BY n DESC, covenant_id LIMIT 1) AS busiest_n,
    (SELECT covenant_id FROM born ORDER BY v DESC, covenant_id LIMIT 1) AS biggest, (SELECT v FROM born ORDER BY v DESC, covenant_id LIMIT 1) AS biggest_value FROM recent""", "covenants", "cells",
    cut="SELECT greatest(0, max(accepting_daa) - 20000000) AS c FROM events_", recent="SELECT * FROM events_ WHERE accepting_daa >= (SELECT c FROM cut)", busy="SELECT covenant_id, count(*) AS n FROM recent GROUP BY 1",
    born="SELECT c.covenant_id, CAST(sum(u.value) AS BIGINT) AS v FROM covenants c JOIN cells u ON u.covenant_id = c.covenant_id AND u.created_daa = c.genesis_daa WHERE c.genesis_daa >= (SELECT c FROM cut) GROUP BY 1"))
def ledger_digest(spark, sf_dir):
    covenants, events, cells = (view(spark, sf_dir, "covenant_id") for view in (V.covenants, V.events, V.cells))
    return C.digest(covenants, events, cells, 20_000_000, ident=lambda key: V.ident("c", key))


@query(V.sql("SELECT covenant_id, CAST(sum(value) AS BIGINT) AS born_value FROM cells JOIN covenants USING (covenant_id) WHERE created_daa = genesis_daa GROUP BY 1", "covenants", "cells"))
def born_values(spark, sf_dir):
    return V.digested(C.born_values(V.covenants(spark, sf_dir, "covenant_id"), V.cells(spark, sf_dir, "covenant_id")), covenant_id="c")


@query(V.sql("SELECT accepting_daa // 144000 * 144000 AS daa, count(*) FILTER (kind = 'genesis') AS births, count(*) FILTER (kind = 'transition') AS moves, count(*) FILTER (kind = 'burn') AS burns FROM events_ WHERE accepting_daa >= 3600000 GROUP BY 1", "events_"))
def ledger_activity(spark, sf_dir):
    rows = V.events(spark, sf_dir).where("accepting_daa >= 3600000")
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("genesis", "births"), ("transition", "moves"), ("burn", "burns"))]
    return rows.groupBy((F.expr("accepting_daa div 144000") * 144000).alias("daa")).agg(*kinds)


@query(V.sql("SELECT min(accepting_daa) AS first_daa, max(accepting_daa) AS last_daa FROM events_", "events_"))
def event_bounds(spark, sf_dir):
    return V.events(spark, sf_dir).agg(F.min("accepting_daa").alias("first_daa"), F.max("accepting_daa").alias("last_daa"))


_LIVES = "SELECT e.covenant_id, accepting_daa - g AS life FROM events_ e JOIN (SELECT covenant_id, min(accepting_daa) AS g FROM events_ WHERE kind = 'genesis' GROUP BY 1) b USING (covenant_id) WHERE kind = 'burn' AND accepting_daa >= g"
_CLASS = "CASE WHEN life < 100 THEN 0 WHEN life < 600 THEN 1 WHEN life < 6000 THEN 2 WHEN life < 36000 THEN 3 WHEN life < 216000 THEN 4 ELSE 5 END"
_LABELS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, (x, _) in enumerate(C.LIFESPANS)) + ") v(class, label)"
_CLASSES = f"SELECT class, label, coalesce(n, 0) AS n FROM ({_LABELS}) LEFT JOIN (SELECT {_CLASS} AS class, count(*) AS n FROM lives GROUP BY 1) USING (class)"


@query(V.sql("SELECT * FROM classes", "events_", lives=_LIVES, classes=_CLASSES))
def lifespan_classes(spark, sf_dir):
    return C.lifespan_classes(C.lifespans(V.events(spark, sf_dir)))


@query(V.sql("SELECT life AS median FROM (SELECT life, row_number() OVER (ORDER BY life) - 1 AS i, count(*) OVER () AS n FROM lives) WHERE i = n // 2", "events_", lives=_LIVES))
def lifespan_upper_median(spark, sf_dir):
    from ..operators.ledger import upper_median

    return upper_median(C.lifespans(V.events(spark, sf_dir)), "life")


@query(V.sql("SELECT class, label, CAST(dead AS BIGINT) AS dead, round(1 - dead / total, 6) AS alive_share FROM (SELECT *, sum(n) OVER (ORDER BY class) AS dead, sum(n) OVER () AS total FROM classes)", "events_", lives=_LIVES, classes=_CLASSES))
def survival_curve(spark, sf_dir):
    return C.survival(C.lifespans(V.events(spark, sf_dir)))


@query(V.sql("SELECT coalesce(t, '') AS template, count(*) FILTER (spent_block IS NULL) AS live_states, CAST(coalesce(sum(value) FILTER (spent_block IS NULL), 0) AS BIGINT) AS live_value, count(*) AS ever_seen, count(DISTINCT covenant_id) AS covenants FROM cells LEFT JOIN r USING (covenant_id) GROUP BY 1",
    "cells", r=f"SELECT covenant_id, {_SEM} AS t FROM cells WHERE {_HAS} GROUP BY 1"))
def ledger_template_stats(spark, sf_dir):
    return C.template_stats(V.cells(spark, sf_dir))


@query(V.sql(f"SELECT covenant_id, {_SEM} AS template FROM cells WHERE {_HAS} GROUP BY 1", "cells"))
def template_effective(spark, sf_dir):
    return V.cells(spark, sf_dir).groupBy("covenant_id").agg(C.effective_template().alias("template")).where("template is not null")


@query(V.sql("SELECT revealed_template, count(*) AS n FROM cells WHERE revealed_template <> '' GROUP BY 1", "cells"))
def revealed_counts(spark, sf_dir):
    return C.revealed_counts(V.cells(spark, sf_dir))


@query(V.sql("SELECT covenant_id, bool_or(spent_block IS NULL) AS active FROM cells GROUP BY 1", "cells"))
def active_flags(spark, sf_dir):
    return C.active_flags(V.cells(spark, sf_dir))


@query(V.sql("SELECT covenant_id, txid, output_index, value, n AS live_count FROM (SELECT *, row_number() OVER (PARTITION BY covenant_id ORDER BY value DESC, txid, output_index) AS r, count(*) OVER (PARTITION BY covenant_id) AS n FROM cells WHERE spent_block IS NULL) WHERE r = 1", "cells"))
def live_market_cell(spark, sf_dir):
    return C.live_cell(V.cells(spark, sf_dir))


@query(V.sql("SELECT covenant_id, bool_or(spent_block IS NULL) AS active, count(*) AS states, min(created_daa) AS first_daa, max(created_daa) AS last_daa FROM cells WHERE spk_script = unhex('20' || sha256('k5') || 'ac') GROUP BY 1", "cells"))
def covenants_of_key(spark, sf_dir):
    import hashlib

    return C.controllers(V.cells(spark, sf_dir), hashlib.sha256(b"k5").hexdigest())


@query(V.sql("SELECT lower(substr(hex(spk_script), 3, 64)) AS key, count(*) AS states, CAST(sum(value) AS BIGINT) AS value FROM cells WHERE spent_block IS NULL AND covenant_id = sha256('c5') AND octet_length(spk_script) = 34 AND hex(spk_script) LIKE '20%AC' GROUP BY 1", "cells"))
def holders_of_covenant(spark, sf_dir):
    import hashlib

    return C.holders_of(V.cells(spark, sf_dir), hashlib.sha256(b"c5").hexdigest())


@query(V.sql("SELECT txid, output_index, covenant_id, value, created_daa FROM cells WHERE covenant_id = sha256('c9') AND spent_block IS NULL", "cells"))
def live_cells_of(spark, sf_dir):
    return C.live(V.cells(spark, sf_dir)).where(F.col("covenant_id") == F.sha2(F.lit("c9"), 256)).select("txid", "output_index", "covenant_id", "value", "created_daa")


@query(V.sql("SELECT output_index, covenant_id, nullif(template, '') AS template FROM cells WHERE txid = sha256('t42')", "cells"))
def cells_created_by(spark, sf_dir):
    return V.cells(spark, sf_dir).where(F.col("txid") == F.sha2(F.lit("t42"), 256)).select("output_index", "covenant_id", F.nullif("template", F.lit("")).alias("template"))


@query(V.sql("SELECT txid, output_index, revealed_template IS NOT NULL AS revealed, nullif(revealed_template, '') AS template FROM cells WHERE spent_txid = sha256('t42')", "cells"))
def cells_spent_by(spark, sf_dir):
    rows = V.cells(spark, sf_dir).where(F.col("spent_txid") == F.sha2(F.lit("t42"), 256))
    return rows.select("txid", "output_index", F.col("revealed_template").isNotNull().alias("revealed"), F.nullif("revealed_template", F.lit("")).alias("template"))


@query(V.sql("SELECT covenant_id, seq, kind, accepting_block FROM events_ WHERE txid = sha256('t100')", "events_"))
def events_of_tx(spark, sf_dir):
    return V.events(spark, sf_dir).where(F.col("txid") == F.sha2(F.lit("t100"), 256)).select("covenant_id", "seq", "kind", "accepting_block")


@query(V.sql("SELECT seq, kind, txid, accepting_daa, sum(CASE WHEN kind = 'transition' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS nth_move FROM events_ WHERE covenant_id = sha256('c11')", "events_").replace("sum(CASE", "CAST(sum(CASE").replace("(ORDER BY seq) AS nth", "(ORDER BY seq) AS BIGINT) AS nth"))
def timeline(spark, sf_dir):
    """One coin's events with the ordinal of each move; the window is over that coin's rows."""
    from pyspark.sql import Window as W

    rows = V.events(spark, sf_dir).where(F.col("covenant_id") == F.sha2(F.lit("c11"), 256))
    return rows.select("seq", "kind", "txid", "accepting_daa", F.sum(F.when(F.col("kind") == "transition", 1).otherwise(0)).over(W.partitionBy("covenant_id").orderBy("seq")).alias("nth_move"))


@query(V.sql("SELECT DISTINCT accepting_block, accepting_daa FROM events_ WHERE accepting_daa > 20000000", "events_"))
def blocks_above(spark, sf_dir):
    return V.events(spark, sf_dir).where("accepting_daa > 20000000").select("accepting_block", "accepting_daa").distinct()


@query(V.sql("SELECT DISTINCT accepting_block, accepting_daa FROM events_ ORDER BY 2 DESC LIMIT 16", "events_"))
def recent_blocks(spark, sf_dir):
    return D.recent_blocks(V.events(spark, sf_dir), 16)


@query(V.sql("SELECT i AS sample, (SELECT arg_max(accepting_block, accepting_daa) FROM events_ WHERE accepting_daa <= t) AS accepting_block, (SELECT max(accepting_daa) FROM events_ WHERE accepting_daa <= t) AS accepting_daa FROM target", "events_",
    target="SELECT CAST(i AS INTEGER) AS i, hi - (hi - lo) * i // 7 AS t FROM (SELECT min(accepting_daa) AS lo, max(accepting_daa) AS hi FROM events_), range(8) r(i)"))
def spread_blocks(spark, sf_dir):
    return D.spread_samples(V.events(spark, sf_dir), 8)


@query(V.sql("SELECT covenant_id FROM covenants WHERE covenant_id LIKE 'a%' ORDER BY 1 LIMIT 20", "covenants"))
def id_prefix_range(spark, sf_dir):
    return D.id_range(V.covenants(spark, sf_dir).select("covenant_id"), "covenant_id", "a", 20)


_TAG = "CASE WHEN octet_length(payload) < 4 THEN '' WHEN hex(payload) LIKE '7B22%' THEN 'json' WHEN hex(payload) LIKE '37623232%' THEN 'jsonhex' ELSE 'tag:' || lower(substr(hex(payload), 1, 8)) END"
_LANE = "CASE WHEN octet_length(payload) >= 20 AND substr(hex(payload), 9, 32) = repeat('0', 32) THEN lower(substr(hex(payload), 1, 8)) END"
_DOC = "CASE WHEN hex(payload) LIKE '7B22%' THEN decode(payload) WHEN hex(payload) LIKE '37623232%' THEN decode(unhex(decode(payload))) END"
_KIND = """CASE WHEN doc IS NULL THEN '' WHEN doc->>'p' IS NOT NULL THEN (doc->>'p') || coalesce(' · ' || (doc->>'op'), '') || coalesce(' · ' || (doc->>'tick'), '') WHEN doc->>'t' IS NOT NULL THEN doc->>'t'
    ELSE list_min(json_keys(doc)) END"""
_STAMPS = f"SELECT *, CASE WHEN payload IS NOT NULL THEN {_KIND} END AS inscription FROM (SELECT *, {_LANE} AS lane, {_TAG} AS tag, {_DOC} AS doc FROM events_)"


@query(V.sql("SELECT tag, count(*) AS n_events, count(DISTINCT covenant_id) AS n_coins FROM s WHERE lane IS NULL AND tag <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200", "events_", s=_STAMPS))
def ledger_payload_tags(spark, sf_dir):
    return C.breakdown(C.stamped(V.events(spark, sf_dir)), "tag", 200)


@query(V.sql("SELECT lane, count(*) AS n_events, count(DISTINCT covenant_id) AS n_coins FROM s WHERE lane IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200", "events_", s=_STAMPS))
def lane_breakdown(spark, sf_dir):
    return C.breakdown(C.stamped(V.events(spark, sf_dir)), "lane", 200)


@query(V.sql("SELECT inscription, count(*) AS n_events, count(DISTINCT covenant_id) AS n_coins FROM s WHERE inscription <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60", "events_", s=_STAMPS))
def inscription_breakdown(spark, sf_dir):
    return C.breakdown(C.stamped(V.events(spark, sf_dir)), "inscription", 60)


_LANE_ID = "substr(sha256('click'), 1, 8)"


@query(V.sql(f"SELECT accepting_daa // 360000 * 360000 AS daa, count(*) AS n, count(DISTINCT covenant_id) AS coins FROM s WHERE lane = {_LANE_ID} GROUP BY 1", "events_", s=_STAMPS))
def lane_activity(spark, sf_dir):
    import hashlib

    rows = C.lane_rows(C.stamped(V.events(spark, sf_dir)), hashlib.sha256(b"click").hexdigest()[:8])
    return rows.groupBy((F.expr("accepting_daa div 360000") * 360000).alias("daa")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("covenant_id").alias("coins"))


@query(V.sql(f"SELECT covenant_id, seq, kind, accepting_daa FROM s WHERE lane = {_LANE_ID} ORDER BY accepting_daa DESC, event_id DESC LIMIT 20", "events_", s=_STAMPS))
def lane_recent(spark, sf_dir):
    import hashlib

    rows = C.lane_rows(C.stamped(V.events(spark, sf_dir)), hashlib.sha256(b"click").hexdigest()[:8])
    return rows.orderBy(F.desc("accepting_daa"), F.desc("event_id")).limit(20).select("covenant_id", "seq", "kind", "accepting_daa")


_FEED = "SELECT covenant_id, seq, kind, txid, accepting_daa, tx_index FROM events_"
_ORDER = "accepting_daa, tx_index NULLS LAST, txid, covenant_id, seq"
_FEED_COLS = ("covenant_id", "seq", "kind", "txid", "accepting_daa", "tx_index")


@query(V.sql(f"{_FEED} ORDER BY {_ORDER} LIMIT 100", "events_"))
def ledger_feed(spark, sf_dir):
    return D.canonical(V.events(spark, sf_dir).select(*_FEED_COLS), None, 100)


@query(V.sql(f"SELECT * FROM ({_FEED} WHERE accepting_daa = 3600000 ORDER BY {_ORDER} OFFSET 4) UNION ALL {_FEED} WHERE accepting_daa > 3600000 ORDER BY {_ORDER} LIMIT 50", "events_"))
def ledger_feed_after(spark, sf_dir):
    return D.canonical(V.events(spark, sf_dir).select(*_FEED_COLS), (3_600_000, 4), 50)


@query(V.sql("SELECT covenant_id, seq, kind, accepting_daa FROM events_ ORDER BY accepting_daa DESC, event_id DESC LIMIT 50", "events_"))
def recent_events(spark, sf_dir):
    return V.events(spark, sf_dir).orderBy(F.desc("accepting_daa"), F.desc("event_id")).limit(50).select("covenant_id", "seq", "kind", "accepting_daa")


@query(V.sql("SELECT covenant_id, seq, kind, accepting_daa FROM (SELECT *, row_number() OVER (PARTITION BY covenant_id ORDER BY accepting_daa DESC, seq DESC) AS r FROM events_) WHERE r = 1", "events_"))
def first_per_key(spark, sf_dir):
    rows = V.events(spark, sf_dir).select("covenant_id", "seq", "kind", "accepting_daa")
    return D.first_per_key(rows, "covenant_id", [-F.col("accepting_daa"), -F.col("seq")])


_SUBS = "SELECT * FROM (VALUES (1, sha256('c3'), 'burn'), (2, sha256('c3'), NULL), (3, NULL, 'genesis'), (4, NULL, NULL), (5, sha256('zz'), 'burn')) v(subscription_id, c, k)"


@query(V.sql("SELECT covenant_id, kind, seq, subscription_id FROM events_ JOIN subs ON (c IS NULL OR c = covenant_id) AND (k IS NULL OR k = kind)", "events_", subs=_SUBS))
def subscriptions_match(spark, sf_dir):
    import hashlib

    h = lambda x: hashlib.sha256(x).hexdigest()
    subs = spark.createDataFrame([(1, h(b"c3"), "burn"), (2, h(b"c3"), None), (3, None, "genesis"), (4, None, None), (5, h(b"zz"), "burn")], "id int, covenant_id string, kind string")
    return D.matching_subscriptions(V.events(spark, sf_dir), subs)


_SUMS = {"s": _SUMMARY, "r": "SELECT *, live_states > 0 AS alive, greatest(0, event_count - CASE WHEN genesis_daa IS NULL THEN 0 ELSE 1 END - CASE WHEN live_states = 0 THEN 1 ELSE 0 END) AS moves, last_activity_daa - genesis_daa AS lived FROM s"}
_CROWNS = " UNION ALL ".join(
    f"(SELECT CAST({i} AS INTEGER) AS place, '{n}' AS label, covenant_id, CAST({v} AS BIGINT) AS figure FROM r WHERE {ok} ORDER BY {o}, covenant_id LIMIT 1)"
    for i, (n, ok, o, v) in enumerate([
        ("oldest alive", "alive AND genesis_daa IS NOT NULL", "genesis_daa", "genesis_daa"), ("most traveled", "moves > 1", "moves DESC", "moves"), ("richest", "alive AND live_value > 0", "live_value DESC", "live_value"),
        ("biggest birth", "born_value > 0", "born_value DESC", "born_value"), ("longest life", "NOT alive AND genesis_daa IS NOT NULL AND lived > 0", "lived DESC", "lived")])
)


@query(V.sql(f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY covenant_id ORDER BY place) AS k FROM ({_CROWNS})) WHERE k = 1", "covenants", "cells", **_SUMS))
def records_argmax(spark, sf_dir):
    return C.records(_summaries(spark, sf_dir))


def _names(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BYTE = "CAST('0x' || substr(covenant_id, {}, 4) AS BIGINT)"
_NAME = " || '-' || ".join(f"{_names(w)}[{_BYTE.format(at)} % {len(w)} + 1]" for at, w in ((1, O.ADJECTIVES), (5, O.COLORS), (9, O.ANIMALS)))


@query(V.sql("SELECT covenant_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || substr(covenant_id, 1, 4) ELSE base END AS name FROM n", "covenants", n=f"SELECT covenant_id, {_NAME} AS base FROM covenants"))
def friendly_names(spark, sf_dir):
    return C.named(V.covenants(spark, sf_dir).select("covenant_id"))


# Tokens and trades.

_ALLOWED = ", ".join(f"'{x}'" for x in V.MATCHED)
_GATED = f"SELECT tt.* FROM trades tt JOIN (SELECT DISTINCT token_id FROM tokens WHERE status = 'verified') USING (token_id) JOIN (SELECT DISTINCT covenant_id AS market_covenant_id FROM programs WHERE invariant_ok AND skeleton IN ({_ALLOWED}) AND exercised_trades >= 3) USING (market_covenant_id)"


def _gated(spark, sf_dir):
    return D.gated_trades(V.trades(spark, sf_dir), V.tokens(spark, sf_dir), V.programs(spark, sf_dir), V.MATCHED)


@query(V.sql("SELECT token_id, seq, txid, side, base_amount, quote_sompi, accepting_daa FROM g ORDER BY accepting_daa DESC, token_id DESC, seq DESC LIMIT 60", "trades", "tokens", "programs", g=_GATED))
def gated_trades_feed(spark, sf_dir):
    return D.trades_page(_gated(spark, sf_dir), None, 60).select("token_id", "seq", "txid", "side", "base_amount", "quote_sompi", "accepting_daa")


@query(V.sql("SELECT token_id, seq, txid, side FROM g WHERE side = 'buy' AND (accepting_daa < 500 OR (accepting_daa = 500 AND (token_id < '8' OR (token_id = '8' AND seq < 10)))) ORDER BY accepting_daa DESC, token_id DESC, seq DESC LIMIT 40", "trades", "tokens", "programs", g=_GATED))
def gated_trades_after(spark, sf_dir):
    return D.trades_page(_gated(spark, sf_dir), (500, "8", 10), 40, side="buy").select("token_id", "seq", "txid", "side")


@query(V.sql("SELECT token_id, count(*) AS n FROM g GROUP BY 1", "trades", "tokens", "programs", g=_GATED))
def gated_trades_count(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


@query(V.sql("SELECT token_id, seq, quote_sompi FROM trades WHERE counterparty IN ('00' || sha256('o7'), '03' || sha256('o7')) ORDER BY accepting_daa DESC, token_id DESC, seq DESC LIMIT 30", "trades"))
def trades_of_key(spark, sf_dir):
    key = F.sha2(F.lit("o7"), 256)
    mine = V.trades(spark, sf_dir).where(F.col("counterparty").isin(F.concat(F.lit("00"), key), F.concat(F.lit("03"), key)))
    return D.trades_page(mine, None, 30).select("token_id", "seq", "quote_sompi")


@query(V.sql("SELECT seq, delta_idx, kind, amount, owner_from, owner_to FROM token_events JOIN (SELECT DISTINCT seq FROM token_events WHERE token_id = sha256('n5') AND seq > 3 ORDER BY seq LIMIT 10) p USING (seq) WHERE token_id = sha256('n5')", "token_events"))
def token_event_page(spark, sf_dir):
    import hashlib

    return D.token_event_page(V.token_events(spark, sf_dir), hashlib.sha256(b"n5").hexdigest(), 3, 10).select("seq", "delta_idx", "kind", "amount", "owner_from", "owner_to")


@query(V.sql("SELECT seq, delta_idx, kind, amount FROM token_events JOIN (SELECT DISTINCT seq FROM token_events WHERE token_id = sha256('n5') AND seq < 30 ORDER BY seq DESC LIMIT 10) p USING (seq) WHERE token_id = sha256('n5')", "token_events"))
def token_event_page_before(spark, sf_dir):
    import hashlib

    return D.token_event_page(V.token_events(spark, sf_dir), hashlib.sha256(b"n5").hexdigest(), 30, 10, down=True).select("seq", "delta_idx", "kind", "amount")


@query(V.sql("SELECT token_id, count(DISTINCT seq) AS n_events FROM token_events GROUP BY 1", "token_events"))
def token_event_counts(spark, sf_dir):
    return V.token_events(spark, sf_dir).groupBy("token_id").agg(F.countDistinct("seq").alias("n_events"))


_SIDE = "FILTER (side = '{}')"
_TX = f"""SELECT token_id, txid, min(seq) AS seq, count(*) {_SIDE.format('in')} AS n_in, count(*) {_SIDE.format('out')} AS n_out, coalesce(sum(amount) {_SIDE.format('in')}, 0) AS isum, coalesce(sum(amount) {_SIDE.format('out')}, 0) AS osum,
    coalesce(bool_or(minter) {_SIDE.format('in')}, false) AS minter_in, coalesce(bool_or(minter) {_SIDE.format('out')}, false) AS minter_out, bool_and(proven) AS proven,
    CASE WHEN count(DISTINCT owner) {_SIDE.format('in')} = 1 THEN min(owner) {_SIDE.format('in')} END AS owner_in FROM states GROUP BY 1, 2"""
_EV = """SELECT *, CASE WHEN NOT proven OR (n_in = 0 AND seq % 3 <> 0) THEN 'unknown' WHEN n_in = 0 THEN 'genesis' WHEN n_out = 0 THEN 'burn' WHEN osum > isum THEN 'mint' WHEN osum < isum THEN 'burn' WHEN n_in > 1 THEN 'merge' WHEN n_out > 1 THEN 'split' ELSE 'transfer' END AS kind,
    CASE WHEN n_in > 0 AND n_out > 0 AND proven AND NOT minter_in THEN CASE WHEN minter_out THEN 'minter state created without a minter input' WHEN osum > isum THEN 'outputs exceed inputs without a minter' WHEN osum < isum THEN 'inputs exceed outputs without a minter' END END AS invalid,
    CASE WHEN NOT proven THEN 'state unproven' WHEN n_in = 0 AND seq % 3 <> 0 THEN 'outputs without inputs outside genesis' WHEN n_out = 0 AND NOT minter_in AND isum > 0 THEN 'terminal burn without a minter' END AS doubt FROM tx"""
_TOK = {"tx": _TX, "ev": _EV}


def _classified(spark, sf_dir, cells=False):
    """States and events by the driver's keys; ``V.digested`` makes the ids of what a query returns."""
    states = V.states(spark, sf_dir, "token_id", "txid")
    return states, T.classified(states, states.where("seq % 3 = 0").select("token_id", "txid"), cells=cells)


@query(V.sql("SELECT token_id, txid, seq, n_in, n_out, CAST(isum AS BIGINT) AS isum, CAST(osum AS BIGINT) AS osum, minter_in, minter_out, kind, invalid, doubt, owner_in FROM ev", "states", **_TOK))
def token_classified(spark, sf_dir):
    out = _classified(spark, sf_dir)[1]
    return V.digested(out.withColumns({c: F.col(c).cast("long") for c in ("isum", "osum")}), token_id="n", txid="t")


@query(V.sql("""SELECT token_id, seq, row_number() OVER (PARTITION BY token_id, seq ORDER BY idx, owner_to NULLS FIRST, owner_from NULLS FIRST, amount NULLS FIRST) - 1 AS delta_idx, kind, CAST(amount AS BIGINT) AS amount, owner_from, owner_to FROM (
    SELECT e.token_id, e.seq, idx, kind, CAST(amount AS HUGEINT) AS amount, owner_in AS owner_from, owner AS owner_to FROM states s JOIN ev e USING (token_id, txid) WHERE kind <> 'unknown' AND side = 'out'
    UNION ALL SELECT e.token_id, e.seq, idx, kind, amount, owner, NULL FROM states s JOIN ev e USING (token_id, txid) WHERE kind <> 'unknown' AND n_out = 0
    UNION ALL SELECT token_id, seq, 2147483647, kind, isum - osum, owner_in, NULL FROM ev WHERE kind <> 'unknown' AND n_out > 0 AND n_in > 0 AND osum < isum
    UNION ALL SELECT token_id, seq, 2147483647, kind, NULL, NULL, NULL FROM ev WHERE kind = 'unknown')""", "states", **_TOK))
def token_deltas(spark, sf_dir):
    states, events = _classified(spark, sf_dir, cells=True)
    return V.digested(T.deltas(states, events).withColumn("amount", F.col("amount").cast("long")), token_id="n")


_VERDICT = "SELECT token_id, CASE WHEN i IS NOT NULL THEN 'invalid' WHEN d IS NOT NULL THEN 'unvalidated' ELSE 'verified' END AS status, coalesce(i, d) AS reason FROM (SELECT token_id, arg_min(invalid, seq) FILTER (invalid IS NOT NULL) AS i, arg_min(doubt, seq) FILTER (doubt IS NOT NULL) AS d FROM ev GROUP BY 1)"


@query(V.sql(_VERDICT, "states", **_TOK))
def token_verdicts(spark, sf_dir):
    return V.digested(T.verdicts(_classified(spark, sf_dir)[1]), token_id="n")


@query(V.sql("SELECT token_id, owner, CAST(sum(amount) AS BIGINT) AS balance, count(*) AS cells FROM states WHERE side = 'out' AND proven GROUP BY 1, 2", "states"))
def token_balances(spark, sf_dir):
    return T.balances(V.states(spark, sf_dir).where("side = 'out'")).withColumn("balance", F.col("balance").cast("long"))


@query(V.sql("""SELECT v.token_id, CASE WHEN v.status = 'verified' AND NOT ok THEN 'unvalidated' ELSE v.status END AS status, CASE WHEN v.status = 'verified' AND NOT ok THEN 'live frontier differs from the history''s supply' ELSE v.reason END AS reason,
    CASE WHEN ok THEN CAST(supply AS BIGINT) END AS supply, CASE WHEN ok THEN CAST(minted AS BIGINT) END AS minted, CASE WHEN ok THEN CAST(burned AS BIGINT) END AS burned, coalesce(holders, 0) AS holders,
    CASE WHEN ok AND coalesce(hc + hw + hs, 0) = frontier THEN CAST(coalesce(hc, 0) AS BIGINT) END AS held_covenant, CASE WHEN ok AND coalesce(hc + hw + hs, 0) = frontier THEN CAST(coalesce(hw, 0) AS BIGINT) END AS held_wallet,
    CASE WHEN ok AND coalesce(hc + hw + hs, 0) = frontier THEN CAST(coalesce(hs, 0) AS BIGINT) END AS held_script, unresolved FROM (
    SELECT v.*, supply, minted, burned, holders, hc, hw, hs, coalesce(frontier, 0) AS frontier, coalesce(unresolved, 0) AS unresolved, v.status = 'verified' AND coalesce(frontier, 0) = supply AND coalesce(unresolved, 0) = 0 AND supply >= 0 AS ok
    FROM verdict v JOIN sums USING (token_id) LEFT JOIN front USING (token_id) LEFT JOIN open_ USING (token_id)) v""", "states", **_TOK, verdict=_VERDICT,
    sums="SELECT token_id, b + m - l AS supply, m AS minted, l AS burned FROM (SELECT token_id, coalesce(sum(osum) FILTER (kind = 'genesis'), 0) AS b, coalesce(sum(osum - isum) FILTER (kind = 'mint'), 0) AS m, coalesce(sum(isum - osum) FILTER (kind = 'burn'), 0) AS l FROM ev GROUP BY 1)",
    held="SELECT token_id, owner, sum(amount) AS b FROM states WHERE side = 'out' AND proven GROUP BY 1, 2",
    front="SELECT token_id, sum(b) AS frontier, count(*) AS holders, coalesce(sum(b) FILTER (owner LIKE '02%'), 0) AS hc, coalesce(sum(b) FILTER (owner LIKE '00%' OR owner LIKE '03%'), 0) AS hw, coalesce(sum(b) FILTER (owner LIKE '01%'), 0) AS hs FROM held GROUP BY 1",
    open_="SELECT token_id, count(*) AS unresolved FROM states WHERE side = 'out' AND NOT proven GROUP BY 1"))
def token_accounts(spark, sf_dir):
    states, events = _classified(spark, sf_dir)
    return V.digested(T.accounts(events, states.where("side = 'out'")), token_id="n")


_KAS = "SELECT DISTINCT txid, substr(owner, 3, 64) AS market, 1000000 + seq % 7 * 1000 AS k0, 1000000 + seq % 5 * 1000 AS k1 FROM states WHERE owner LIKE '02%'"
_COEV = "SELECT txid, sha256('c' || (seq % 3)) AS covenant_id FROM states"


@query(V.sql("""SELECT t.token_id, t.seq, t.txid, t.market AS market_covenant_id, CASE WHEN k1 > k0 THEN 'buy' ELSE 'sell' END AS side, CAST(abs(d) AS BIGINT) AS base_amount, abs(k1 - k0) AS quote_sompi, k0 AS kas_before_sompi, k1 AS kas_after_sompi,
    CAST(b0 AS BIGINT) AS base_before, CAST(b1 AS BIGINT) AS base_after, (SELECT count(DISTINCT covenant_id) FROM coev c WHERE c.txid = t.txid AND c.covenant_id NOT IN (t.token_id, t.market)) AS co_covenants,
    CASE WHEN d > 0 AND down = 1 THEN one_down WHEN d < 0 AND up = 1 THEN one_up END AS counterparty
    FROM (SELECT m.*, w.up, w.down, w.one_up, w.one_down FROM (SELECT token_id, txid, substr(owner, 3, 64) AS market, d, b0, b1, seq, count(*) OVER (PARTITION BY token_id, txid) AS n FROM own WHERE owner LIKE '02%' AND d <> 0) m
    LEFT JOIN (SELECT token_id, txid, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, max(owner) FILTER (d > 0) AS one_up, max(owner) FILTER (d < 0) AS one_down FROM own WHERE owner NOT LIKE '02%' AND d <> 0 GROUP BY 1, 2) w USING (token_id, txid) WHERE n = 1) t
    JOIN kas k ON k.txid = t.txid AND k.market = t.market WHERE k1 <> k0 AND (k1 > k0) <> (d > 0)""", "states", kas=_KAS, coev=_COEV,
    own="SELECT token_id, txid, owner, sum(CASE side WHEN 'out' THEN amount ELSE -amount END) AS d, coalesce(sum(amount) FILTER (side = 'in'), 0) AS b0, coalesce(sum(amount) FILTER (side = 'out'), 0) AS b1, min(seq) AS seq FROM states JOIN (SELECT token_id, txid FROM states GROUP BY 1, 2 HAVING bool_and(proven)) USING (token_id, txid) GROUP BY 1, 2, 3"))
def token_trades(spark, sf_dir):
    states = V.states(spark, sf_dir, "txid")  # tokens are compared with other covenants, so their ids are digests throughout
    seq = F.col("seq")
    reserves = states.where(F.col("owner").startswith("02")).select("txid", F.substring("owner", 3, 64).alias("market"), (1_000_000 + seq % 7 * 1000).alias("k0"), (1_000_000 + seq % 5 * 1000).alias("k1")).distinct()
    return V.digested(T.trades(states, reserves, states.select("txid", F.sha2(F.concat(F.lit("c"), (seq % 3).cast("string")), 256).alias("covenant_id"))), txid="t")


@query(V.sql(f"SELECT token_id, CASE WHEN count(*) = 1 THEN min(m) WHEN count(*) FILTER (m IN (SELECT covenant_id FROM matched)) = 1 THEN min(m) FILTER (m IN (SELECT covenant_id FROM matched)) END AS market FROM held GROUP BY 1 HAVING market IS NOT NULL", "states",
    held="SELECT DISTINCT token_id, substr(owner, 3, 64) AS m FROM states WHERE owner LIKE '02%' AND seq % 5 = 0", matched="SELECT sha256('o' || i) AS covenant_id FROM range(2) r(i)"))
def token_market_links(spark, sf_dir):
    matched = spark.range(2).select(F.sha2(F.concat(F.lit("o"), F.col("id").cast("string")), 256).alias("covenant_id"))
    return T.market_links(V.states(spark, sf_dir).where("seq % 5 = 0"), matched)


@query(V.sql("SELECT b.token_id, owner, CAST(balance AS BIGINT) AS balance, cells, coalesce(status, 'none') AS status FROM (SELECT token_id, owner, sum(amount) AS balance, count(*) AS cells FROM states WHERE side = 'out' AND proven GROUP BY 1, 2 HAVING sum(amount) > 0) b JOIN tokens USING (token_id) WHERE owner IN ('00' || sha256('o4'), '03' || sha256('o4'))", "states", "tokens"))
def holdings_of_key(spark, sf_dir):
    import hashlib

    held = T.balances(V.states(spark, sf_dir).where("side = 'out'"))
    return T.holdings_of(held, V.tokens(spark, sf_dir).select("token_id", "status"), hashlib.sha256(b"o4").hexdigest()).withColumn("balance", F.col("balance").cast("long"))


_TCELLS = "SELECT sha256('n' || l_suppkey) AS token_id, l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT) AS value FROM lineitem"
_DIR = "SELECT t.*, coalesce(n, 0) AS live_states, CAST(coalesce(v, 0) AS BIGINT) AS live_value, CASE WHEN e.token_id IS NOT NULL THEN 'token' ELSE 'minter pin' END AS label FROM tokens t LEFT JOIN (SELECT token_id, count(*) FILTER (l_linestatus = 'O') AS n, sum(value) FILTER (l_linestatus = 'O') AS v FROM tc GROUP BY 1) USING (token_id) LEFT JOIN (SELECT DISTINCT token_id FROM token_events WHERE kind = 'mint' AND seq < 3) e ON e.token_id = t.token_id"


@query(V.sql("SELECT * FROM d WHERE contains(lower(concat_ws(' ', name, token_id, status, label)), 'supplier') AND status = 'verified' ORDER BY live_value DESC, token_id LIMIT 30", "tokens", "token_events", tc=_TCELLS, d=_DIR))
def token_directory(spark, sf_dir):
    from ..session import table

    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.sha2(F.concat(F.lit("n"), F.col("l_suppkey").cast("string")), 256).alias("token_id"), F.when(F.col("l_linestatus") != "O", "x").alias("spent_block"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))
    seen = V.token_events(spark, sf_dir).where("kind = 'mint' and seq < 3")
    return T.select_directory(T.directory(V.tokens(spark, sf_dir), cells, seen), "Supplier", "verified", "value", 30)


@query(V.sql("SELECT token_id, a.status AS was, b.status AS now, CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM tokens WHERE name < 'Supplier#000000008') a FULL JOIN (SELECT token_id, CASE WHEN substr(token_id, 1, 1) < '4' THEN 'invalid' ELSE status END AS status FROM tokens WHERE name > 'Supplier#000000003') b USING (token_id) WHERE a.status IS DISTINCT FROM b.status", "tokens"))
def status_changes(spark, sf_dir):
    t = V.tokens(spark, sf_dir)
    after = t.where("name > 'Supplier#000000003'").withColumn("status", F.when(F.substring("token_id", 1, 1) < "4", "invalid").otherwise(F.col("status")))
    return T.status_changes(t.where("name < 'Supplier#000000008'"), after)


@query(V.sql("SELECT DISTINCT token_id FROM (SELECT token_id FROM tokens WHERE status = 'verified' UNION SELECT token_id FROM token_events WHERE kind = 'mint' AND seq < 5)", "tokens", "token_events"))
def token_candidates(spark, sf_dir):
    return T.candidates(V.tokens(spark, sf_dir).where("status = 'verified'"), V.token_events(spark, sf_dir).where("kind = 'mint' and seq < 5"))


# Markets.


@query(V.sql(f"SELECT count(*) AS examined, count(*) FILTER (skeleton IN ({_ALLOWED})) AS matched, count(*) FILTER (skeleton NOT IN ({_ALLOWED})) AS unmatched, count(*) FILTER (skeleton IS NULL) AS unrevealed, count(*) FILTER (skeleton IN ({_ALLOWED}) AND NOT invariant_ok) AS invariant_failed FROM (SELECT DISTINCT market_covenant_id AS c FROM tokens WHERE market_covenant_id IS NOT NULL) LEFT JOIN programs ON covenant_id = c", "tokens", "programs"))
def market_composition(spark, sf_dir):
    return M.composition(V.tokens(spark, sf_dir), V.programs(spark, sf_dir), V.MATCHED)


_SHAPE = "coalesce(program_len, -1), coalesce(program_pushes, -1), CASE WHEN program_len IS NULL THEN program_hash ELSE '' END"


@query(V.sql(f"SELECT count(*) AS families, CAST(coalesce(sum(n), 0) AS BIGINT) AS covenants FROM (SELECT count(*) AS n FROM programs WHERE skeleton LIKE 'unmatched%' GROUP BY {_SHAPE})", "programs"))
def unknown_build_totals(spark, sf_dir):
    return M.unknown_totals(V.programs(spark, sf_dir))


@query(V.sql(f"""SELECT coalesce(program_len, -1) AS len_key, coalesce(program_pushes, -1) AS pushes_key, CASE WHEN program_len IS NULL THEN program_hash ELSE '' END AS hash_key, min(program_hash) AS program_hash, count(DISTINCT p.covenant_id) AS covenants,
    CAST(coalesce(sum(t), 0) AS BIGINT) AS trades, CAST(coalesce(sum(v), 0) AS BIGINT) AS volume, coalesce(max(k), 0) AS tokens, min(nullif(c.genesis_daa, 0)) AS first_daa, nullif(max(greatest(coalesce(c.last_activity_daa, 0), coalesce(d, 0))), 0) AS last_daa, min(p.covenant_id) AS sample_covenant
    FROM programs p LEFT JOIN covenants c ON c.covenant_id = p.covenant_id LEFT JOIN (SELECT market_covenant_id AS m, count(*) AS t, sum(quote_sompi) AS v, count(DISTINCT token_id) AS k, max(accepting_daa) AS d FROM trades GROUP BY 1) x ON m = p.covenant_id
    WHERE skeleton LIKE 'unmatched%' GROUP BY 1, 2, 3 ORDER BY volume DESC, trades DESC, covenants DESC, program_hash LIMIT 20""", "programs", "covenants", "trades"))
def unknown_build_families(spark, sf_dir):
    return M.unknown_builds(V.programs(spark, sf_dir), V.covenants(spark, sf_dir), V.trades(spark, sf_dir), 20)


@query(V.sql("SELECT covenant_id, skeleton, (SELECT count(*) FROM programs) AS total FROM programs WHERE covenant_id < 'c' ORDER BY covenant_id DESC LIMIT 5", "programs"))
def market_directory_page(spark, sf_dir):
    return M.directory_page(V.programs(spark, sf_dir).select("covenant_id", "skeleton"), "c", 5)


# A made-up reserve that follows a curve up to rounding, with jumps in some histories.
_CURVE = """SELECT market_covenant_id, seq, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, co_covenants, 900000000000 + (seq % 50) * 1000000000 AS k0, 900000000000 + (seq % 50) * 1000000000 + CASE WHEN seq % 2 = 0 THEN 1000000000 ELSE -1000000000 END AS k1 FROM trades"""
_CURVED = "SELECT *, CAST((CAST(20000000000000000000 AS HUGEINT) + (CAST(100000000000 AS HUGEINT) + k0) - 1) // (CAST(100000000000 AS HUGEINT) + k0) AS BIGINT) AS b0, CAST((CAST(20000000000000000000 AS HUGEINT) + (CAST(100000000000 AS HUGEINT) + k1) - 1) // (CAST(100000000000 AS HUGEINT) + k1) AS BIGINT) + CASE WHEN substr(market_covenant_id, 1, 1) < '6' AND seq = 700 THEN 100000 ELSE 0 END AS b1 FROM curve"
_JUDGED = """SELECT *, co_covenants = 0 AND abs(b1 - b0) > 0 AND (CASE side WHEN 'buy' THEN 100000000000 + k0 - 1000000 ELSE 100000000000 + k1 - 1000000 END)::HUGEINT * abs(b1 - b0) <= abs(k1 - k0)::HUGEINT * (CASE side WHEN 'buy' THEN b0 ELSE b1 END)
    AND abs(k1 - k0)::HUGEINT * (CASE side WHEN 'buy' THEN b1 ELSE b0 END) <= (CASE side WHEN 'buy' THEN 100000000000 + k1 + 1000000 ELSE 100000000000 + k0 + 1000000 END)::HUGEINT * abs(b1 - b0) AS on_curve,
    (100000000000 + k1)::HUGEINT * b1 >= (100000000000 + k0)::HUGEINT * b0 AND ((100000000000 + k1)::HUGEINT * b1 - (100000000000 + k0)::HUGEINT * b0) * 1000000 <= (100000000000 + k0)::HUGEINT * b0 * 10 AS inv FROM curved"""


@query(V.sql("SELECT market_covenant_id, first_bad IS NULL AS invariant_ok, count(*) FILTER (on_curve AND inv AND (first_bad IS NULL OR seq < first_bad)) AS exercised, coalesce(max(first_bad), max(seq)) AS checked_through FROM judged LEFT JOIN (SELECT market_covenant_id, min(seq) AS first_bad FROM judged WHERE on_curve AND NOT inv GROUP BY 1) USING (market_covenant_id) GROUP BY 1, 2",
    "trades", curve=_CURVE, curved=_CURVED, judged=_JUDGED))
def bracket_invariant_replay(spark, sf_dir):
    t = V.trades(spark, sf_dir)
    k0 = F.lit(900_000_000_000) + (F.col("seq") % 50) * 1_000_000_000
    t = t.select("market_covenant_id", "seq", F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), "co_covenants", k0.alias("kas_before_sompi"), (k0 + F.when(F.col("seq") % 2 == 0, 1_000_000_000).otherwise(-1_000_000_000)).alias("kas_after_sompi"))
    at = lambda k: E.ceil_quotient(F.lit("20000000000000000000").cast("decimal(38,0)"), F.lit(100_000_000_000) + F.col(k))
    jump = F.when((F.substring("market_covenant_id", 1, 1) < "6") & (F.col("seq") == 700), 100_000).otherwise(0)
    t = t.withColumns({"base_before": at("kas_before_sompi"), "base_after": at("kas_after_sompi") + jump})
    t = t.withColumns({"base_amount": F.abs(F.col("base_after") - F.col("base_before")), "quote_sompi": F.abs(F.col("kas_after_sompi") - F.col("kas_before_sompi"))})
    return M.replay(t, F.lit(100_000_000_000), F.lit(0))


@query(V.sql("""SELECT token_id, l.quote_sompi AS last_quote_sompi, l.base_amount AS last_base_amount, l.side AS last_side, l.accepting_daa AS last_daa, CASE WHEN untimed = 0 AND n > 0 THEN CAST(vol AS BIGINT) END AS volume_24h_sompi, CASE WHEN untimed = 0 AND n > 0 THEN n END AS trades_24h,
    CASE WHEN untimed = 0 AND o IS NOT NULL THEN CAST((l.quote_sompi::HUGEINT * o.base_amount - o.quote_sompi::HUGEINT * l.base_amount) * 10000 // (o.quote_sompi::HUGEINT * l.base_amount) AS BIGINT) END AS change_24h_bps,
    CASE WHEN l IS NULL THEN 'no trade large enough to price' END AS unpriced_reason, CASE WHEN untimed > 0 THEN 'some trades have no time' END AS window_note FROM (
    SELECT token_id, arg_max(p, seq) FILTER (big) AS l, arg_max(p, seq) FILTER (big AND accepting_time_ms < 813600000) AS o, count(*) FILTER (accepting_time_ms IS NULL) AS untimed, sum(quote_sompi) FILTER (accepting_time_ms BETWEEN 813600000 AND 900000000) AS vol,
    count(*) FILTER (accepting_time_ms BETWEEN 813600000 AND 900000000) AS n FROM (SELECT *, quote_sompi >= 100000000 AS big, {'quote_sompi': quote_sompi, 'base_amount': base_amount, 'side': side, 'accepting_daa': accepting_daa} AS p FROM trades) GROUP BY 1)""", "trades"))
def market_summaries(spark, sf_dir):
    return M.summary(V.trades(spark, sf_dir), 900_000_000)


@query(V.sql("SELECT covenant_id, count(*) AS live_cells, CASE WHEN count(*) = 1 THEN CAST(sum(value) AS BIGINT) END AS reserve_sompi FROM cells WHERE spent_block IS NULL AND created_daa < 400000 GROUP BY 1", "cells"))
def market_reserves(spark, sf_dir):
    return M.reserves(V.cells(spark, sf_dir).where("created_daa < 400000"))


_WIDTH = "CASE WHEN span / 900000 <= 120 THEN 900000 WHEN span / 3600000 <= 120 THEN 3600000 WHEN span / 14400000 <= 120 THEN 14400000 ELSE 86400000 END"


@query(V.sql("""SELECT token_id, accepting_time_ms // width * width AS t0, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(quote_sompi) AS BIGINT) AS volume_sompi, arg_max(txid, seq) AS last_txid, width
    FROM (SELECT *, quote_sompi / base_amount AS price FROM ok JOIN w USING (token_id)) GROUP BY token_id, t0, width""", "trades", ok="SELECT * FROM trades WHERE co_covenants = 0 AND quote_sompi > 0 AND base_amount > 0",
    w=f"SELECT token_id, CAST({_WIDTH} AS BIGINT) AS width FROM (SELECT token_id, count(*) AS n, count(accepting_time_ms) AS m, max(accepting_time_ms) - min(accepting_time_ms) AS span FROM ok GROUP BY 1) WHERE n >= 3 AND n = m"))
def token_candles(spark, sf_dir):
    return V.digested(M.candles(V.trades(spark, sf_dir, "token_id", "txid")), token_id="n", last_txid="t")


@query("""SELECT p_partkey, CAST(q * 25 // 10000 AS BIGINT) AS creator, CAST(q * 90 // 10000 AS BIGINT) AS platform, greatest(CAST(q * 10 // 10000 AS BIGINT), 20000000) AS dev,
    CASE WHEN b0 - b1 > 0 THEN CAST(b0 - b1 AS BIGINT) END AS bought FROM (SELECT *, CAST(((v + k) * b0 + (v + k + q) - 1) // (v + k + q) AS BIGINT) AS b1 FROM (SELECT p_partkey, CAST(p_size AS HUGEINT) * 1000000000 AS q, CAST(6250000000000 AS HUGEINT) AS v,
    CAST(round(p_retailprice * 100) AS HUGEINT) * 1000000 AS k, 10000000 + p_partkey AS b0 FROM part))""")
def curve_quotes(spark, sf_dir):
    from ..session import table

    q, k, b0, v = F.col("p_size").cast("long") * 1_000_000_000, F.round(F.col("p_retailprice") * 100).cast("long") * 1_000_000, F.col("p_partkey") + 10_000_000, F.lit(6_250_000_000_000)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in E.fee_legs(q).items()], E.quote_buy(v, k, b0, q).alias("bought"))


_SCHED = "SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS total, o_orderkey * 10 AS start_score, CAST(100000 AS BIGINT) AS duration_score, CAST(round(o_totalprice) AS BIGINT) // 3 AS claimed FROM orders"


@query(f"SELECT *, CASE WHEN start_score > 80000 THEN 'not_started' WHEN start_score + duration_score > 80000 THEN 'vesting' ELSE 'vested' END AS status, v AS vested_at_tip, greatest(0, v - claimed) AS claimable FROM (SELECT *, CAST(CAST(total AS HUGEINT) * least(greatest(80000 - start_score, 0), duration_score) // duration_score AS BIGINT) AS v FROM ({_SCHED}))".replace("SELECT *, CASE", "SELECT * EXCLUDE v, CASE"))
def vesting_status(spark, sf_dir):
    from ..session import table

    total = F.round("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), total.alias("total"), (F.col("o_orderkey") * 10).alias("start_score"), F.lit(100_000).cast("long").alias("duration_score"), F.call_function("div", total, F.lit(3)).alias("claimed"))
    return M.vesting(rows, 80_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

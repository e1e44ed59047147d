"""Queries of preflight rules, declared facts, the audit report and holders' claims, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import declared as D
from ..operators import audit as A, claims as H, preflight as R, programs as P
from ..session import table
from . import chain as V, chain_queries as Q, proof_queries as PQ

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


def _div(a, n: int):
    return F.call_function("div", a, F.lit(n))


# Orders as transactions: lines of odd number are inputs, the others outputs; some lack a version, a budget, an amount, a lock or all lines.
_LIMITS = (500_000, 500_000, 500_000)
_PRE = {
    "tx": "SELECT o_orderkey AS txid, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 31 = 4 THEN 'memo, note' END AS unknown FROM orders",
    "i": """SELECT l_orderkey AS txid, l_linenumber AS idx, CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 70000 ELSE l_partkey % 50 + 1 END AS budget, CASE l_suppkey % 5 WHEN 0 THEN l_partkey % 400 WHEN 1 THEN 0 END AS ops,
        l_suppkey % 3 = 0 AS covenant, CASE WHEN l_partkey % 17 <> 0 THEN 1 END AS amount, CASE WHEN l_partkey % 3 = 1 THEN l_partkey * 977 % 400000 END AS units, CASE WHEN l_partkey % 3 = 1 THEN l_partkey % 10 <> 7 END AS passed FROM lineitem WHERE l_linenumber % 2 = 1""",
    "o": "SELECT l_orderkey AS txid, l_linenumber AS idx, CASE WHEN l_partkey % 40 = 3 THEN 0 WHEN l_partkey % 40 <> 4 THEN 5 END AS value, l_suppkey % 37 <> 5 AS locked FROM lineitem WHERE l_linenumber % 2 = 0",
    "mass": "SELECT o_orderkey AS txid, o_orderkey * 31 % 510000 AS compute, o_orderkey * 37 % 505000 AS transient, CASE WHEN o_orderkey % 23 <> 6 THEN o_orderkey * 41 % 520000 END AS storage FROM orders WHERE o_orderkey % 29 <> 7",
    "fi": """SELECT i.*, coalesce(version, 1) AS ver, coalesce(ops, 0) AS op, coalesce(passed, false) AS ok, CASE WHEN coalesce(passed, false) THEN CASE WHEN (greatest(units - 9999, 0) + 9999) // 10000 < 1 THEN 1 ELSE (greatest(units - 9999, 0) + 9999) // 10000 END END AS cover FROM i JOIN tx USING (txid)""",
    "bare": "SELECT * FROM fi WHERE ver = 1 AND coalesce(budget, 0) = 0 AND NOT (budget IS NULL AND op > 0) AND NOT (ok AND units <= 9999)",
    "fact": """SELECT *, ver IN (0, 1) AND n_in > 0 AND n_out > 0 AS whole, ver IN (0, 1) AND n_in > 0 AND n_out > 0 AND (ver = 0 OR nobudget = 0) AS buildable FROM (SELECT txid, version, unknown, coalesce(version, 1) AS ver, coalesce(n_in, 0) AS n_in, coalesce(nobudget, 0) AS nobudget, coalesce(noamount, 0) AS noamount, coalesce(n_out, 0) AS n_out, coalesce(broken, 0) AS broken FROM tx
        LEFT JOIN (SELECT txid, count(*) AS n_in, count(*) FILTER (budget IS NULL OR budget > 65535) AS nobudget, count(*) FILTER (amount IS NULL) AS noamount FROM i GROUP BY 1) USING (txid) LEFT JOIN (SELECT txid, count(*) AS n_out, count(*) FILTER (value IS NULL OR value = 0 OR NOT locked) AS broken FROM o GROUP BY 1) USING (txid)) LEFT JOIN mass USING (txid)""",
    "over": "SELECT txid, concat_ws(', ', CASE WHEN compute > 500000 THEN 'compute ' || compute || ' > 500000' END, CASE WHEN transient > 500000 THEN 'transient ' || transient || ' > 500000' END, CASE WHEN noamount = 0 AND broken = 0 AND storage > 500000 THEN 'storage ' || storage || ' > 500000' END) AS over FROM fact",
    "f": """SELECT txid, 'error' AS severity, 'budget_overflow' AS code, idx AS input_index, NULL AS output_index, NULL AS budget, NULL AS detail FROM fi WHERE ver = 1 AND budget > 65535
        UNION ALL SELECT txid, 'info', 'sigop_count_ignored', idx, NULL, NULL, NULL FROM fi WHERE ver = 1 AND budget <= 65535 AND op > 0 UNION ALL SELECT txid, 'error', 'sigop_count_on_v1', idx, NULL, 10, NULL FROM fi WHERE ver = 1 AND budget IS NULL AND op > 0
        UNION ALL SELECT txid, 'error', CASE WHEN covenant THEN 'budget_missing' ELSE 'fee_input_budget_missing' END, idx, NULL, CASE WHEN ok THEN cover WHEN covenant THEN 20 ELSE 10 END, NULL FROM bare
        UNION ALL SELECT txid, 'warn', 'budget_on_v0', idx, NULL, NULL, NULL FROM fi WHERE ver = 0 AND budget IS NOT NULL UNION ALL SELECT txid, 'error', 'sigop_overflow', idx, NULL, NULL, NULL FROM fi WHERE ver = 0 AND op > 255
        UNION ALL SELECT txid, 'error', 'input_script_failed', idx, NULL, CASE WHEN units > 9999 + budget * 10000 THEN (greatest(units - 9999, 0) + 9999) // 10000 END, NULL FROM fi WHERE NOT passed
        UNION ALL SELECT txid, 'error', 'output_value_zero', NULL, idx, NULL, NULL FROM o JOIN tx USING (txid) WHERE value IS NULL OR value = 0 UNION ALL SELECT txid, 'error', 'output_spk_missing', NULL, idx, NULL, NULL FROM o JOIN tx USING (txid) WHERE NOT locked
        UNION ALL SELECT txid, 'info', 'unknown_fields', NULL, NULL, NULL, unknown FROM fact WHERE unknown IS NOT NULL UNION ALL SELECT txid, 'warn', 'version_missing', NULL, NULL, NULL, NULL FROM fact WHERE version IS NULL
        UNION ALL SELECT txid, 'warn', 'version_unknown', NULL, NULL, NULL, CAST(version AS VARCHAR) FROM fact WHERE version NOT IN (0, 1) UNION ALL SELECT txid, 'error', 'no_inputs', NULL, NULL, NULL, NULL FROM fact WHERE n_in = 0 UNION ALL SELECT txid, 'error', 'no_outputs', NULL, NULL, NULL, NULL FROM fact WHERE n_out = 0
        UNION ALL SELECT txid, 'info', 'mass_skipped', NULL, NULL, NULL, NULL FROM fact WHERE whole AND NOT buildable UNION ALL SELECT txid, 'info', 'storage_mass_skipped', NULL, NULL, NULL, NULL FROM fact WHERE buildable AND broken = 0 AND noamount > 0
        UNION ALL SELECT txid, 'error', 'storage_mass_incomputable', NULL, NULL, NULL, NULL FROM fact WHERE buildable AND compute IS NOT NULL AND broken = 0 AND noamount = 0 AND storage IS NULL UNION ALL SELECT txid, 'error', 'mass_exceeds_limit', NULL, NULL, NULL, over FROM fact JOIN over USING (txid) WHERE buildable AND compute IS NOT NULL AND over <> ''""",
}


def _with(body: str, *views: str, **extra: str) -> str:
    return f"WITH {', '.join(f'{n} AS ({_PRE[n]})' for n in views)}{''.join(f', {n} AS ({x})' for n, x in extra.items())} {body}"


def preflight_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o, part, supp, line = (F.col(c) for c in ("o_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    version = F.when(o % 9 == 0, F.lit(None)).when(o % 9 <= 2, 0).when(o % 9 == 3, 2).otherwise(1)
    tx = orders.select(o.alias("txid"), version.alias("version"), F.when(o % 31 == 4, F.array(F.lit("memo"), F.lit("note"))).alias("unknown_fields"))
    budget = F.when(part % 8 == 0, F.lit(None)).when(part % 8 == 1, 0).when(part % 8 == 2, 70_000).otherwise(part % 50 + 1)
    lock = F.when(supp % 3 == 0, F.unhex(F.concat(F.lit("aa20"), F.sha2(supp.cast("string"), 256), F.lit("87")))).otherwise(F.unhex(F.concat(F.lit("20"), F.sha2(supp.cast("string"), 256), F.lit("ac"))))
    ins = lines.where(line % 2 == 1).select(
        F.col("l_orderkey").alias("txid"), line.alias("idx"), budget.alias("budget"), F.when(supp % 5 == 0, part % 400).when(supp % 5 == 1, 0).alias("sig_ops"), lock.alias("script"), F.when(part % 17 != 0, 1).alias("amount"),
        F.unhex(F.lit("41")).alias("witness"), F.when(part % 3 == 1, part * 977 % 400_000).alias("units"), F.when(part % 3 == 1, part % 10 != 7).alias("passed"),
    )
    value = F.when(part % 40 == 3, 0).when(part % 40 != 4, 5)
    outs = lines.where(line % 2 == 0).select(F.col("l_orderkey").alias("txid"), line.alias("idx"), value.alias("value"), F.when(supp % 37 != 5, F.unhex(F.lit("51"))).alias("script"))
    masses = orders.where(o % 29 != 7).select(o.alias("txid"), (o * 31 % 510_000).alias("compute"), (o * 37 % 505_000).alias("transient"), F.when(o % 23 != 6, o * 41 % 520_000).alias("storage"))
    return tx, ins, outs, masses


@query(_with("SELECT txid, severity, code, CAST(input_index AS BIGINT) AS input_index, CAST(output_index AS BIGINT) AS output_index, CAST(budget AS BIGINT) AS budget, detail FROM f", *_PRE))
def preflight_findings(spark, sf_dir):
    return R.findings(*preflight_tables(spark, sf_dir), _LIMITS)


@query(_with("""SELECT txid, CASE WHEN coalesce(e, 0) > 0 THEN 'will_fail' WHEN buildable AND compute IS NOT NULL THEN 'ready' ELSE 'incomplete' END AS verdict, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, CASE WHEN buildable AND compute IS NOT NULL THEN 100 * compute + 200000 END AS fee_estimate
    FROM fact LEFT JOIN (SELECT txid, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w FROM f GROUP BY 1) USING (txid)""", *_PRE))
def preflight_verdicts(spark, sf_dir):
    return R.verdicts(*preflight_tables(spark, sf_dir), _LIMITS)


# Declared facts.

_INSCRIBED = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN lower(hex(encode(j))) WHEN event_id % 4 = 1 THEN '  ' || j WHEN event_id % 9 = 5 THEN 'x' || j ELSE j END AS payload FROM (SELECT event_id,
    '{"p":"abc-20"' || CASE WHEN event_id % 7 <> 3 THEN ',"op":"' || event_type || '"' ELSE '' END || CASE WHEN event_id % 5 <> 2 THEN ',"tick":"t' || (user_id % 5) || '"' ELSE '' END || ',"amt":' || (event_id % 1000) || ',"lim":"' || user_id || '"}' AS j FROM events)"""


@query(f"""WITH s AS ({_INSCRIBED}) SELECT s.event_id, 'abc-20' AS proto, event_type AS op, CASE WHEN s.event_id % 5 <> 2 THEN 't' || (user_id % 5) ELSE '' END AS tick, CAST(s.event_id % 1000 AS VARCHAR) AS amt, '' AS max, CAST(user_id AS VARCHAR) AS lim, '' AS dec, '' AS "to",
    'ABC-20 · ' || event_type || CASE WHEN s.event_id % 5 <> 2 THEN ' · T' || (user_id % 5) ELSE '' END AS chip FROM s JOIN events USING (event_id) WHERE s.event_id % 7 <> 3 AND NOT (s.event_id % 4 > 1 AND s.event_id % 9 = 5)""")
def inscription_fields(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    either = lambda when, x: F.when(when, x).otherwise("")
    text = F.concat(
        F.lit('{"p":"abc-20"'), either(e % 7 != 3, F.concat(F.lit(',"op":"'), "event_type", F.lit('"'))), either(e % 5 != 2, F.concat(F.lit(',"tick":"t'), (F.col("user_id") % 5).cast("string"), F.lit('"'))),
        F.lit(',"amt":'), (e % 1000).cast("string"), F.lit(',"lim":"'), u, F.lit('"}'),
    )
    payload = F.when(e % 4 == 0, F.lower(F.hex(F.encode(text, "UTF-8")))).when(e % 4 == 1, F.concat(F.lit("  "), text)).when(e % 9 == 5, F.concat(F.lit("x"), text)).otherwise(text)
    rows = table(spark, sf_dir, "events").select("event_id", D.inscription(payload).alias("f")).where("f is not null")
    return rows.select("event_id", "f.*", D.chip(F.col("f")).alias("chip"))


_FACTS = """SELECT c_custkey, c_custkey % 6 <> 4 AS has_name, c_custkey % 5 AS t, c_custkey % 7 AS d, c_custkey % 4 AS l, c_custkey % 3 AS h, c_custkey % 11 = 8 AS large FROM customer"""


@query(f"""SELECT c_custkey, CASE WHEN has_name AND c_custkey % 10 <> 9 THEN 'Coin ' || c_custkey END AS name, CASE t WHEN 0 THEN 'T' || c_custkey % 90 WHEN 1 THEN 'S' || c_custkey % 90 END AS ticker, CASE l WHEN 0 THEN 'https://a.example/' || c_custkey WHEN 1 THEN 'IPFS://' || c_custkey END AS image,
    CASE h WHEN 0 THEN sha256('h' || c_custkey) END AS image_hash, CASE d WHEN 0 THEN 8 WHEN 1 THEN 18 WHEN 2 THEN 0 END AS decimals FROM ({_FACTS}) WHERE NOT large AND (has_name AND c_custkey % 10 <> 9 OR t < 2)""")
def token_facts_claimed(spark, sf_dir):
    k = F.col("c_custkey")
    said = lambda key, value: F.concat(F.lit(f',"{key}":'), value)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    no = F.lit("")
    ident = k.cast("string")
    name = F.when(k % 6 != 4, said("name", quoted(F.concat(F.lit(" Coin "), ident, F.when(k % 10 == 9, F.lit("\\n!")).otherwise(" "))))).otherwise(no)
    tick = (k % 90).cast("string")
    ticker = F.when(k % 5 == 0, said("ticker", quoted(F.concat(F.lit("T"), tick)))).when(k % 5 == 1, said("symbol", quoted(F.concat(F.lit("S"), tick)))).when(k % 5 == 2, F.concat(F.lit(',"ticker":"much too long a ticker","symbol":"S"'))).when(k % 5 == 3, F.lit(',"symbol":7')).otherwise(no)
    image = F.when(k % 4 == 0, said("image", quoted(F.concat(F.lit("https://a.example/"), ident)))).when(k % 4 == 1, said("image", quoted(F.concat(F.lit("IPFS://"), ident)))).when(k % 4 == 2, F.lit(',"image":"javascript:x"')).otherwise(no)
    digest = F.sha2(F.concat(F.lit("h"), ident), 256)
    hashed = F.when(k % 3 == 0, said("image_hash", quoted(F.upper(digest)))).when(k % 3 == 1, said("image_hash", quoted(F.substring(digest, 1, 60)))).otherwise(no)
    places = F.when(k % 7 == 0, F.lit(',"decimals":8')).when(k % 7 == 1, F.lit(',"decimals":" 18 "')).when(k % 7 == 2, F.lit(',"decimals":0')).when(k % 7 == 3, F.lit(',"decimals":256')).when(k % 7 == 4, F.lit(',"decimals":1.5')).when(k % 7 == 5, F.lit(',"decimals":"x"')).otherwise(no)
    padding = F.when(k % 11 == 8, F.lit(',"pad":"' + "x" * 4096 + '"')).otherwise(no)
    doc = F.concat(F.lit('{"v":1'), name, ticker, image, hashed, places, padding, F.lit("}"))
    payload = F.when((k % 13 == 5) & (k % 11 != 8), F.lower(F.hex(F.encode(doc, "UTF-8")))).otherwise(doc)
    # The table is a small file or two, and the texts are made and read by all tasks; each text is read once, not again by a filter.
    rows = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    return rows.select("c_custkey", F.inline(F.filter(F.array(D.token_facts(F.encode(payload, "UTF-8"))), lambda f: f.isNotNull())))


@query(V.sql("""SELECT token_id, seq, CASE WHEN base_amount > 0 AND quote_sompi > 0 THEN regexp_replace(regexp_replace(CASE WHEN p >= 1 THEN printf('%.4f', p) WHEN p >= 0.0001 THEN printf('%.6f', p) ELSE printf('%.8f', p) END, '0+$', ''), '\\.$', '') ELSE '—' END AS price
    FROM (SELECT *, CAST(quote_sompi AS DOUBLE) / base_amount / 1e8 AS p FROM trades)""", "trades"))
def shown_prices(spark, sf_dir):
    return V.trades(spark, sf_dir).select("token_id", "seq", D.price(F.col("quote_sompi"), F.col("base_amount")).alias("price"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 4 = 1 THEN 'TN10 traffic generator' END WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'TN10 traffic generator' END AS label,
    CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'bonding · ' || CAST(c_custkey % 100 AS VARCHAR) || '%' WHEN 3 THEN 'bonding' WHEN 4 THEN 'bonding complete' ELSE 'pool shares' END AS chip FROM customer""")
def coin_labels(spark, sf_dir):
    k = F.col("c_custkey")
    holders = F.when(k % 4 == 1, F.array(F.lit("00"), F.lit(D.GENERATOR_KEY.upper()))).when(k % 4 == 2, F.array(F.lit("00"))).when(k % 4 == 3, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    label = D.generator_label(holders, F.when(k % 3 == 0, "testnet-10").otherwise("mainnet"), F.when(k % 5 == 0, "p2pk state").otherwise("escrow"))
    phase = F.when(k % 7 == 1, "unknown").when(k % 7 <= 3, F.when(k % 7 > 0, "bonding")).when(k % 7 == 4, "graduated").otherwise("lp shares")
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), D.phase_chip(phase, F.when(k % 7 == 2, k % 100 * 100)).alias("chip"))


# The audit report over the made-up builds of the parts.

_LAID = """SELECT k, id, h, unhex(h) AS program, CASE WHEN right(h, 2) = 'ad' THEN 'b' ELSE 'a' END || CASE WHEN substr(h, 89, 2) = '77' THEN '7' ELSE '6' END AS fam FROM b"""
_UNITS = """SELECT id, fam, octet_length(program) AS length, place, v FROM laid, LATERAL (VALUES (0, substr(h, 5, 64)), (1, substr(h, 73, 16)), (2, substr(h, 93, 4)), (3, substr(h, 99, 64)), (4, substr(h, 165, 16)), (5, substr(h, 185, 64)), (6, substr(h, 251, 16))) p(place, v)"""


def _audited(spark, sf_dir):
    programs = PQ.build_programs(spark, sf_dir)
    return programs, A.laid(programs)


def _no_family(df: DataFrame, laid: DataFrame) -> DataFrame:
    """The family's digest isn't in SQL: its first member names it."""
    first = laid.groupBy("family").agg(F.min("id").alias("first_member"))
    return df.join(first, "family").drop("family")


_LE = "CASE WHEN v <> 'ffffffffffffffff' THEN ('0x' || substr(v, 7, 2) || substr(v, 5, 2) || substr(v, 3, 2) || substr(v, 1, 2))::BIGINT END"
_BUILDS = {
    "b": PQ._BUILD, "laid": _LAID, "units": _UNITS,
    "open": "SELECT fam, place, arg_min(v, id) AS v0 FROM units GROUP BY fam, place HAVING count(DISTINCT v) > 1",
}
_CAND = f"""SELECT id, fam, -1 AS place, 0::BIGINT AS v FROM laid UNION ALL SELECT id, fam, place, n * 1000000 FROM (SELECT *, bool_and(coalesce(n BETWEEN 1 AND 1000000000000, false)) OVER (PARTITION BY fam, place) AS small FROM (SELECT u.id, fam, place, CASE WHEN strlen(u.v) <= 16 THEN {_LE.replace('substr(v', 'substr(u.v').replace('WHEN v', 'WHEN u.v')} END AS n FROM units u SEMI JOIN open USING (fam, place))) WHERE small"""
_TRIED = {
    "curve": Q._CURVE, "curved": Q._CURVED, "tried": PQ._TRIED, "cand": _CAND,
    "grid": "SELECT id AS market_covenant_id, fam AS family, place, v, fee, br, gr FROM cand, (VALUES (0, 0, 0), (1, 0, 125), (2, 20, 20)) f(fee, br, gr)",
    "scored": PQ._SCORED, "counts": PQ._COUNTS,
    "best": "SELECT family AS fam, CASE WHEN place >= 0 THEN place END AS v_place, CASE fee WHEN 0 THEN 'no fee' WHEN 1 THEN 'curve 125bps growth' ELSE 'pool 20bps' END AS fee_model, clean AS trades_clean, off AS trades_off_curve FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY clean DESC, place, fee) AS n FROM counts WHERE bad = 0) WHERE n = 1",
}
_FAMILY = """SELECT fam, 7 AS push_count, [134] AS program_lens, count(*) AS instances, CAST(coalesce(sum(t), 0) AS BIGINT) AS trades, min(id) AS sample_covenant, arg_min(sha256(program), id) AS sample_program_hash, true AS pool_shaped, CASE WHEN count(*) < 2 THEN 'exact' ELSE 'skeleton' END AS reach
    FROM laid LEFT JOIN (SELECT market_covenant_id AS id, count(*) AS t FROM trades GROUP BY 1) USING (id) GROUP BY fam"""


@query(V.sql("""SELECT f.* EXCLUDE (fam, program_lens), array_to_string(program_lens, ',') AS program_lens, coalesce(n, 0) AS slots, coalesce(places, '') AS slot_indices, v_place, fee_model, trades_clean, trades_off_curve FROM family f
    LEFT JOIN (SELECT fam, count(*) AS n, string_agg(place, ',' ORDER BY place) AS places FROM open GROUP BY 1) USING (fam) LEFT JOIN best USING (fam)""", "trades", **_BUILDS, **_TRIED, family=_FAMILY))
def audit_families(spark, sf_dir):
    programs, laid = _audited(spark, sf_dir)
    best = P.best_trials(P.trials(PQ.tried(spark, sf_dir), P.v_candidates(programs)))
    found = A.families(laid, A.places(laid), V.trades(spark, sf_dir), best, PQ.sha).drop("family")
    listed = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("program_lens", "slot_indices")}
    return found.withColumns(listed | {"sample_program_hash": F.lower(F.hex("sample_program_hash"))})


# Four builds over the customers: a key and a number that each stand in two places, and the program's own length; one build breaks the
# key's agreement, one the number's, and one has numbers of two widths.
_N = "printf('%02x01', c_custkey % 200)"
_WIDE = "CASE WHEN c_custkey % 8 = 7 THEN '00' ELSE '' END"
_ROLES = {
    "units": f"""SELECT sha256('q' || c_custkey) AS id, c_custkey % 4 AS fam, CASE WHEN c_custkey % 8 = 7 THEN 81 ELSE 79 END AS length, place, v FROM customer, LATERAL (VALUES (0, sha256('k' || (c_custkey % 50))), (1, sha256('k' || (c_custkey % CASE WHEN c_custkey % 36 = 9 THEN 49 ELSE 50 END))),
        (2, {_N} || {_WIDE}), (3, CASE WHEN c_custkey % 28 = 10 THEN '0102' ELSE {_N} END || {_WIDE}), (4, CASE WHEN c_custkey % 8 = 7 THEN '5100' ELSE '4f00' END)) p(place, v)""",
    "open": _BUILDS["open"],
}


def _role_programs(spark, sf_dir):
    k = F.col("c_custkey")
    key = lambda n: F.sha2(F.concat(F.lit("k"), (k % n).cast("string")), 256)
    number = F.concat(F.lpad(F.lower(F.hex(k % 200)), 2, "0"), F.lit("01"))
    wide = k % 8 == 7
    push = lambda x: F.concat(F.when(wide, "03").otherwise("02"), x, F.when(wide, "00").otherwise(""))
    tail = F.lower(F.hex(k % 4 + 0xAC))
    digits = F.concat(
        F.lit("6b20"), key(50), F.lit("7520"), F.when(k % 36 == 9, key(49)).otherwise(key(50)), push(number), F.lit("76"), push(F.when(k % 28 == 10, F.lit("0102")).otherwise(number)),
        F.lit("02"), F.when(wide, "5100").otherwise("4f00"), tail,
    )
    return table(spark, sf_dir, "customer").select(F.sha2(F.concat(F.lit("q"), k.cast("string")), 256).alias("id"), F.unhex(digits).alias("program"))


@query(V.sql(f"""SELECT (SELECT min(id) FROM units l WHERE l.fam = g.fam) AS first_member, CASE WHEN keyed THEN 'key' ELSE 'number' END AS role, places, CASE WHEN NOT keyed THEN {_LE.replace('substr(v', 'substr(v0').replace('WHEN v', 'WHEN v0')} END AS sample_value FROM
    (SELECT fam, v0, max(n) AS n, bool_and(same) AS same, bool_and(keyed) AS keyed, bool_and(num) AS num FROM (SELECT fam, v0, id, count(*) AS n, min(v) = max(v) AS same, min(strlen(v)) = 64 AS keyed, bool_and(strlen(v) <= 16 AND v <> 'ffffffffffffffff') AS num FROM units JOIN open USING (fam, place) GROUP BY ALL) GROUP BY ALL) g
    JOIN (SELECT fam, v0, string_agg(place, ',' ORDER BY place) AS places FROM open GROUP BY ALL) USING (fam, v0) WHERE n >= 2 AND same AND (keyed OR num)
    UNION ALL SELECT min(id), 'self_length', CAST(place AS VARCHAR), NULL FROM units SEMI JOIN open USING (fam, place) GROUP BY fam, place HAVING bool_and(coalesce(CASE WHEN strlen(v) <= 16 THEN {_LE} END = length, false))""", **_ROLES))
def audit_role_guesses(spark, sf_dir):
    laid = A.laid(_role_programs(spark, sf_dir))
    found = A.role_guesses(laid, A.places(laid)).withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))
    return _no_family(found, laid)


@query(f"WITH b AS ({PQ._BUILD}), laid AS ({_LAID}), u AS (SELECT id FROM b WHERE k % 3 <> 1 UNION ALL SELECT sha256('gone' || p_partkey) FROM part WHERE p_partkey % 7 = 0) SELECT *, unmatched_covenants - recovered AS unrecoverable FROM (SELECT (SELECT count(*) FROM u) AS unmatched_covenants, (SELECT count(*) FROM laid SEMI JOIN u USING (id)) AS recovered, (SELECT count(DISTINCT fam) FROM laid SEMI JOIN u USING (id)) AS families)")
def audit_totals(spark, sf_dir):
    _, laid = _audited(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part")
    ident = lambda kind: F.sha2(F.concat(F.lit(kind), k), 256).alias("id")
    unmatched = parts.where("p_partkey % 3 <> 1").select(ident("m")).unionByName(parts.where("p_partkey % 7 = 0").select(ident("gone")))
    return A.totals(unmatched, laid)


_LEDGER = "SELECT p_brand AS skeleton, 'hand ' || CAST(min(p_partkey) AS VARCHAR) AS first_pinned_by FROM part WHERE p_size > 20 GROUP BY 1"


def _ledger(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 20").groupBy(F.col("p_brand").alias("skeleton")).agg(F.concat(F.lit("hand "), F.min("p_partkey").cast("string")).alias("first_pinned_by"))


@query(V.sql("SELECT l.*, coalesce(n, 0) AS instances FROM l LEFT JOIN (SELECT skeleton, count(*) AS n FROM programs GROUP BY 1) USING (skeleton)", "programs", l=_LEDGER))
def pins_in_use(spark, sf_dir):
    return A.pinned(_ledger(spark, sf_dir), V.programs(spark, sf_dir))


_WEEK = "SELECT r_name AS network, * EXCLUDE (r_name) FROM (SELECT n_regionkey, count(*) AS instances, sum(CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 > 0 THEN 1 END) AS trades, sha256('f' || (l_suppkey % 50)) AS sample_covenant FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL) JOIN region ON r_regionkey = n_regionkey"
_TOP = "SELECT network, place, coalesce(instances, 0) AS instances, CAST(coalesce(trades, 0) AS BIGINT) AS trades, sample_covenant FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY trades DESC NULLS LAST, instances DESC NULLS LAST, sample_covenant) AS place FROM week) WHERE place <= 3"


def _week(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 5 > 0), 1)
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("i"), F.sum(counted).alias("t"))
    rows = per.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("r_name").alias("network"), F.sha2(F.concat(F.lit("f"), (F.col("l_suppkey") % 50).cast("string")), 256).alias("sample_covenant")).agg(F.sum("i").alias("instances"), F.sum("t").alias("trades"))


@query(f"WITH week AS ({_WEEK}) {_TOP}")
def top_unknown_families(spark, sf_dir):
    return A.top_families(_week(spark, sf_dir))


@query(f"WITH week AS ({_WEEK}), top AS ({_TOP}) SELECT network, instances, trades, sample_covenant FROM top WHERE trades > 0 ORDER BY trades DESC, instances DESC, network, sample_covenant LIMIT 1")
def weekly_specimen(spark, sf_dir):
    return A.specimen(A.top_families(_week(spark, sf_dir)))


@query("""SELECT network, run_id, outcome, matched FROM (SELECT 'n' || (user_id % 40) AS network, event_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN user_id % 40 = 7 THEN 'degraded' ELSE 'ok' END AS outcome, event_id % 100 AS matched FROM events)
    QUALIFY row_number() OVER (PARTITION BY network ORDER BY outcome = 'ok' DESC, run_id DESC) = 1""")
def headline_runs(spark, sf_dir):
    u = F.col("user_id") % 40
    outcome = F.when(F.col("event_type") == "error", "failed").when(u == 7, "degraded").otherwise("ok")
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), u.cast("string")).alias("network"), F.col("event_id").alias("run_id"), outcome.alias("outcome"), (F.col("event_id") % 100).alias("matched"))
    return A.headline_runs(runs)


# Holders.

@query("""SELECT 'h' || u AS holder, ok, CASE WHEN NOT ok THEN CASE WHEN b IS NULL THEN 'unverified' ELSE 'below floor' END END AS reason FROM (SELECT u, b, coalesce(b >= 100, false) AS ok FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN (SELECT c_custkey AS k, CAST(greatest(floor(c_acctbal / 20), 0) AS BIGINT) AS b FROM customer WHERE c_custkey % 4 <> 1) ON k = u)""")
def vote_eligibility(spark, sf_dir):
    name = lambda c: F.concat(F.lit("h"), F.col(c).cast("string")).alias("holder")
    records = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(name("c_custkey"), F.greatest(F.floor(F.col("c_acctbal") / 20), F.lit(0)).alias("balance"))
    return H.eligibility(table(spark, sf_dir, "events").select(name("user_id")), records)


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 5 AS a, c_custkey % 7 AS b FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 8 <> 5)
    SELECT 'h' || k AS holder, 'phase' AS kind, 'n1' AS token_id, 'p' || a AS before, 'p' || b AS after FROM r WHERE k % 6 <> 2 AND a <> b
    UNION ALL SELECT 'h' || k, 'balance', NULL, CASE a WHEN 0 THEN 'dust' ELSE 'above' END, CASE b WHEN 0 THEN 'dust' ELSE 'above' END FROM r WHERE k % 10 <> 4 AND (a = 0) <> (b = 0)""")
def deliverable_alerts(spark, sf_dir):
    k = F.col("c_custkey")
    phase = lambda n: F.concat(F.lit("p"), (k % n).cast("string"))
    side = lambda n: F.when(k % n == 0, "dust").otherwise("above")
    rows = table(spark, sf_dir, "customer")
    holder = F.concat(F.lit("h"), k.cast("string")).alias("holder")
    known = F.when(k % 6 == 2, F.create_map(F.lit("n2"), F.lit("p0"))).otherwise(F.create_map(F.lit("n1"), phase(5)))
    records = rows.select(holder, F.when(k % 3 != 1, k % 3 >= 0).alias("alerts"), F.when(k % 8 == 5, True).alias("unreachable"), known.alias("phases"), F.when(k % 10 != 4, side(5)).alias("bucket"))
    return H.deliverable(records, rows.select(holder, F.create_map(F.lit("n1"), phase(7), F.lit("n3"), F.lit("p1")).alias("phases"), side(7).alias("bucket")))


@query("""SELECT row_number() OVER (ORDER BY claim) - 1 AS i, claim, sha256(claim) AS leaf FROM (SELECT '{"address":"a' || user_id || '","badge":"voted-' || (event_id % 12) || '","granted_ms":' || max(event_id) * 1000 || ',"source":"bot","v":1}' AS claim FROM events WHERE event_type = 'signup' GROUP BY user_id, event_id % 12)""")
def passport_claims(spark, sf_dir):
    e = F.col("event_id")
    rounds = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id", (e % 12).alias("round_id")).agg((F.max(e) * 1000).alias("closed_ms"))
    records = rounds.select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("holder"), F.array(F.struct("round_id", "closed_ms")).alias("participation"))
    return H.numbered(H.participation(records, "bot"))


@query("""SELECT id AS covenant_id, base, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || substr(id, 1, 4) ELSE base END AS name FROM (SELECT DISTINCT sha256('c' || user_id) AS id, 'name ' || (user_id * 7 % 900) AS base FROM events)""")
def index_appended(spark, sf_dir):
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.sha2(F.concat(F.lit("c"), u.cast("string")), 256).alias("covenant_id"), F.concat(F.lit("name "), (u * 7 % 900).cast("string")).alias("base"), u).distinct()
    index = rows.where(u % 3 == 0).select("covenant_id", "base", F.col("base").alias("name"))
    return H.appended(index, rows.select("covenant_id", "base"))


@query(V.sql("""SELECT b - lo AS place, b * 180000 AS daa, coalesce(births, 0) AS births, coalesce(moves, 0) AS moves, coalesce(burns, 0) AS burns, coalesce(births + moves + burns, 0) AS total FROM (SELECT lo, unnest(range(lo, hi + 1)) AS b FROM (SELECT greatest(min(accepting_daa) // 180000, 30000000 // 180000 - 119) AS lo, 30000000 // 180000 AS hi FROM events_))
    LEFT JOIN (SELECT accepting_daa // 180000 AS b, count(*) FILTER (kind = 'genesis') AS births, count(*) FILTER (kind = 'transition') AS moves, count(*) FILTER (kind = 'burn') AS burns FROM events_ GROUP BY 1) USING (b)""", "events_"))
def activity_columns(spark, sf_dir):
    return H.activity_columns(V.events(spark, sf_dir), 180_000, tip=30_000_000, most=120)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

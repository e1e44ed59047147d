"""Queries over raw scripts that are made from the driver's tables, each with the SQL that checks it.

Commitments are SHA-256 here, as that is what the checking SQL can compute; the operators take the digest as an argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scripts as S, typed
from ..operators import locks, programs as P, proofs
from ..session import landed, table
from . import chain as V, chain_queries as Q

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


def sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


# Chains of five orders each: a token's cell moves from order to order. The first cell is revealed; what follows must be recovered from
# witnesses, some of which belong to another coin, and some chains lack a value.
_MOVES = """SELECT o_orderkey AS o, o_orderkey // 5 AS run, o_orderkey % 5 AS j, sha256('k' || (o_orderkey % 97)) AS owner, o_orderkey % 4 AS kind, o_orderkey % 2 AS minter, o_orderkey % 200 AS amount,
    CASE WHEN o_orderkey // 5 % 3 = 0 THEN 'ac' ELSE 'ad51' END AS tail FROM orders"""
_PROGRAM = "unhex('20' || owner || printf('010%d08%02x00000000000000010%d', kind, amount, minter) || tail)"


def _owner(o: Column) -> Column:
    return F.sha2(F.concat(F.lit("k"), (o % 97).cast("string")), 256)


def moves(orders: DataFrame) -> DataFrame:
    o = F.col("o_orderkey")
    run = F.call_function("div", o, F.lit(5))
    rest = [c for c in orders.columns if c != "o_orderkey"]
    rows = orders.select(
        *rest, o.alias("o"), run.alias("run"), (o % 5).alias("j"), _owner(o).alias("owner"), (o % 4).alias("kind"), (o % 2).alias("minter"), (o % 200).alias("amount"),
        F.when(run % 3 == 0, "ac").otherwise("ad51").alias("tail"),
    )
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    digits = F.concat(F.lit("20"), "owner", F.lit("01"), two(F.col("kind")), F.lit("08"), two(F.col("amount")), F.lit("0" * 14 + "01"), two(F.col("minter")), "tail")
    return rows.withColumn("program", F.unhex(digits))


def _spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, next_j): orders with the place of the one that spends their cell. They meet by their keys; what is made of them is made
    after that."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    spends = orders.where(key % 5 > 0).select((key - 1).alias("o_orderkey"), (key % 5).alias("next_j"))
    return orders.join(spends, "o_orderkey", "left")


def _token(key: Column) -> Column:
    return F.sha2(F.concat(F.lit("n"), key.cast("string")), 256)


def _tx(key: Column) -> Column:
    return F.sha2(F.concat(F.lit("t"), key.cast("string")), 256)


def token_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, witnesses of other coins): the cell of order o is spent by order o + 1 of its chain."""
    cells, foreign = _keyed_cells(_spent(spark, sf_dir))
    named = {"token_id": _token(F.col("token_id")), "txid": _tx(F.col("txid")), "spent_txid": _tx(F.col("spent_txid"))}
    return cells.withColumns(named), foreign.withColumn("txid", named["txid"])


def _keyed_cells(spent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with orders' keys for transactions and numbers for tokens."""
    after, rows = F.col("o") + 1, moves(spent)
    then = lambda c: F.when(F.col("next_j").isNotNull(), c)
    rows = rows.withColumns({"next_owner": then(_owner(after)), "next_amount": then(after % 200)})
    push = lambda data: F.concat(F.unhex(F.lpad(F.hex(F.length(data).cast("long")), 2, "0")), data)
    owner, amount = push(F.unhex("next_owner")), F.when((F.col("run") % 13 != 5) | (F.col("j") != 2), push(F.unhex(F.lpad(F.hex("next_amount"), 2, "0")))).otherwise(F.lit(bytearray()))
    last = F.when(F.col("j") == 0, push(F.col("program"))).otherwise(F.lit(bytearray()))
    other = F.col("run") % 5 == 2
    spent = F.col("next_j").isNotNull()
    cells = rows.select(
        (F.col("run") % 40).alias("token_id"), F.col("o").alias("txid"), F.lit(0).alias("output_index"), F.concat(F.lit(bytearray(b"\xaa\x20")), sha(F.col("program")), F.lit(bytearray(b"\x87"))).alias("spk_script"),
        F.when(spent, after).alias("spent_txid"), F.when(spent & ~((F.col("run") % 11 == 4) & (F.col("j") == 0)), F.when(other, last).otherwise(F.concat(owner, amount, last))).alias("spent_sig"),
    )
    foreign = rows.where(spent & other).select(after.alias("txid"), F.concat(owner, amount).alias("sig"))
    return cells, foreign


_PROVEN = f"""SELECT o, run, j, tail FROM m WHERE j = 0 AND run % 11 <> 4
    UNION ALL SELECT n.o, n.run, n.j, n.tail FROM p JOIN m n ON n.o = p.o + 1 AND n.j > 0 JOIN m c ON c.o = p.o, range(4) a(kind), range(2) b(minter)
    WHERE NOT (c.run % 13 = 5 AND c.j = 2) AND sha256(unhex('20' || n.owner || printf('010%d08%02x00000000000000010%d', a.kind, n.amount, b.minter) || p.tail)) = n.want"""


@query(f"""WITH RECURSIVE m AS (SELECT *, sha256({_PROGRAM}) AS want FROM ({_MOVES})), p AS ({_PROVEN})
    SELECT sha256('n' || (run % 40)) AS token_id, sha256('t' || m.o) AS txid, CASE WHEN p.o IS NOT NULL THEN '0' || kind || owner END AS owner, CASE WHEN p.o IS NOT NULL THEN amount END AS amount, CASE WHEN p.o IS NOT NULL THEN minter = 1 END AS minter, p.o IS NOT NULL AS proven,
    CASE WHEN p.o IS NOT NULL THEN NULL WHEN m.j = 4 OR NOT EXISTS (SELECT 1 FROM m n WHERE n.o = m.o + 1 AND n.j > 0) THEN 'live state unproven for ' || sha256('t' || m.o) || ':0' WHEN m.run % 11 = 4 AND m.j = 0 THEN 'reveal missing for spent output ' || sha256('t' || m.o) || ':0'
    ELSE 'spend of ' || sha256('t' || m.o) || ':0 does not reveal its committed program' END AS why FROM m LEFT JOIN (SELECT o FROM p) p ON p.o = m.o""")
def token_state_proofs(spark, sf_dir):
    # Every step of the proof makes cells of these again; that takes less than to write them.
    cells, foreign = _keyed_cells(landed(_spent(spark, sf_dir)))
    known = proofs.recovered(proofs.direct(cells, sha), proofs.witnesses(cells).unionByName(foreign), sha)
    return proofs.judged(known, _tx).select(_token(F.col("token_id")).alias("token_id"), _tx(F.col("txid")).alias("txid"), "owner", "amount", "minter", "proven", "why")


# Programs of two builds over the parts, some with a byte, a repeated place, a length or a constant that is off.
_BUILD = """SELECT p_partkey AS k, sha256('m' || p_partkey) AS id, '6b20' || sha256('k' || (p_partkey % 5)) || '7508' || CASE WHEN p_partkey % 29 = 2 THEN 'ffffffffffffffff' ELSE printf('%02x%02x000000000000', (1000 + p_partkey % 7) % 256, (1000 + p_partkey % 7) // 256) END
    || CASE WHEN p_partkey % 17 = 3 THEN '77' ELSE '76' END || CASE WHEN p_partkey % 13 = 5 THEN '028700' ELSE '028600' END || '20' || sha256('t' || (p_partkey % 11)) || '08' || printf('%02x%02x000000000000', (5000 + p_partkey % 900) % 256, (5000 + p_partkey % 900) // 256)
    || '8720' || sha256(CASE WHEN p_partkey % 19 = 7 THEN 'x' ELSE 'k' || (p_partkey % 5) END) || CASE WHEN p_partkey % 23 = 1 THEN '0841420f0000000000' ELSE '0840420f0000000000' END || CASE WHEN p_partkey % 4 = 1 THEN 'ad' ELSE 'ac' END AS h FROM part"""


def build_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    hashed = lambda kind, c: F.sha2(F.concat(F.lit(kind), c.cast("string")), 256)
    le = lambda c: F.concat(F.lpad(F.lower(F.hex(c % 256)), 2, "0"), F.lpad(F.lower(F.hex(F.call_function("div", c, F.lit(256)))), 2, "0"), F.lit("0" * 12))
    either = lambda when, a, b: F.when(when, F.lit(a)).otherwise(F.lit(b))
    digits = F.concat(
        F.lit("6b20"), hashed("k", k % 5), F.lit("7508"), F.when(k % 29 == 2, "f" * 16).otherwise(le(1000 + k % 7)), either(k % 17 == 3, "77", "76"), either(k % 13 == 5, "028700", "028600"), F.lit("20"), hashed("t", k % 11), F.lit("08"), le(5000 + k % 900),
        F.lit("8720"), F.when(k % 19 == 7, F.sha2(F.lit("x"), 256)).otherwise(hashed("k", k % 5)), either(k % 23 == 1, "0841420f0000000000", "0840420f0000000000"), either(k % 4 == 1, "ad", "ac"),
    )
    return table(spark, sf_dir, "part").select(hashed("m", k).alias("id"), F.unhex(digits).alias("program"))


def _pin(tail: str) -> bytes:
    import hashlib

    key = hashlib.sha256(b"k0").hexdigest()
    return bytes.fromhex("6b20" + key + "7508" + "e803" + "0" * 12 + "76" + "028600" + "20" + hashlib.sha256(b"t0").hexdigest() + "08" + "8813" + "0" * 12 + "8720" + key + "0840420f0000000000" + tail)


def build_pins(spark: SparkSession) -> DataFrame:
    roles = ([0, 1, 2, 3, 4, 5], [1], [0, 5], [], [2], [0, 5], 3, 4, 6, True)
    return spark.createDataFrame([("build a", 1, bytearray(_pin("ac")), *roles), ("build b", 2, bytearray(_pin("ad")), *roles)], P.CURVE_PINS)


_CURVES = """SELECT id, CASE WHEN right(h, 2) = 'ac' THEN 'build a' ELSE 'build b' END AS skeleton, ('0x' || substr(h, 75, 2) || substr(h, 73, 2))::BIGINT AS v_units, substr(h, 5, 64) AS creator_key, substr(h, 99, 64) AS token_id, ('0x' || substr(h, 167, 2) || substr(h, 165, 2))::BIGINT AS token_reserve, CAST(1000000 AS BIGINT) AS graduation_units
    FROM b WHERE substr(h, 89, 2) = '76' AND substr(h, 91, 6) = '028600' AND substr(h, 5, 64) = substr(h, 185, 64) AND substr(h, 249, 18) = '0840420f0000000000' AND substr(h, 87, 2) < '80'"""


@query(f"WITH b AS ({_BUILD}) {_CURVES}")
def program_matches(spark, sf_dir):
    found = P.curves(build_programs(spark, sf_dir), build_pins(spark))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("creator_key", "token_id")})


@query(f"""WITH b AS ({_BUILD}), c AS ({_CURVES}) SELECT b.id, coalesce(skeleton, CASE WHEN b.k = 3 THEN 'one of a kind' END, 'unmatched:9') AS skeleton, CASE skeleton WHEN 'build a' THEN 'bonding' WHEN 'build b' THEN 'graduated' ELSE 'unknown' END AS phase,
    CASE skeleton WHEN 'build a' THEN 0 WHEN 'build b' THEN 20 END AS bracket_fee, CASE skeleton WHEN 'build a' THEN 125 WHEN 'build b' THEN 20 END AS growth_fee, sha256(unhex(h)) AS program_hash FROM b LEFT JOIN c USING (id)""")
def program_verdicts(spark, sf_dir):
    rows = build_programs(spark, sf_dir)
    exact = rows.where(F.col("id") == F.sha2(F.lit("m3"), 256)).select(sha(F.col("program")).alias("program_hash"), F.lit("one of a kind").alias("skeleton"))
    models = spark.createDataFrame([("build a", "bonding", 0, 125), ("build b", "graduated", 20, 20)], P.MODELS)
    out = P.verified(rows, [P.curves(rows, build_pins(spark))], exact, models, "9", sha)
    return out.withColumn("program_hash", F.lower(F.hex("program_hash")))


_TRIED = """SELECT *, abs(b1 - b0) AS base, abs(k1 - k0) AS quote FROM curved"""
_GRID = "SELECT market_covenant_id, substr(market_covenant_id, 1, 1) AS family, g.place, g.v, f.fee, f.br, f.gr FROM (SELECT DISTINCT market_covenant_id FROM trades), (VALUES (-1, 0::BIGINT), (0, 100000000000), (1, 90000000000)) g(place, v), (VALUES (0, 0, 0), (1, 0, 125), (2, 20, 20)) f(fee, br, gr)"
_SCORED = """SELECT family, place, fee, base > 0 AND quote > 0 AND b0 > 0 AND b1 > 0 AND (v + CASE side WHEN 'buy' THEN k0 ELSE k1 END - 1000000 - quote * br // 10000)::HUGEINT * base <= quote::HUGEINT * (CASE side WHEN 'buy' THEN b0 ELSE b1 END)
    AND quote::HUGEINT * (CASE side WHEN 'buy' THEN b1 ELSE b0 END) <= (v + CASE side WHEN 'buy' THEN k1 ELSE k0 END + 1000000 + quote * br // 10000)::HUGEINT * base AS on_curve,
    (v + k1)::HUGEINT * b1 >= (v + k0)::HUGEINT * b0 AND CASE WHEN gr = 0 THEN ((v + k1)::HUGEINT * b1 - (v + k0)::HUGEINT * b0) * 1000000 <= (v + k0)::HUGEINT * b0 * 10
    ELSE (v + k1)::HUGEINT * b1 - (v + k0)::HUGEINT * b0 <= (quote * gr // 10000 + 1000000)::HUGEINT * greatest(b0, b1) END AS inv FROM tried JOIN grid USING (market_covenant_id) WHERE co_covenants = 0"""
_COUNTS = "SELECT family, place, fee, count(*) FILTER (on_curve AND inv) AS clean, count(*) FILTER (NOT on_curve) AS off, count(*) FILTER (on_curve AND NOT inv) AS bad FROM scored GROUP BY ALL"


def tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with reserves that follow a curve up to rounding."""
    t = V.trades(spark, sf_dir)
    k0 = F.lit(900_000_000_000) + (F.col("seq") % 50) * 1_000_000_000
    t = t.select("market_covenant_id", "seq", F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), "co_covenants", k0.alias("kas_before_sompi"), (k0 + F.when(F.col("seq") % 2 == 0, 1_000_000_000).otherwise(-1_000_000_000)).alias("kas_after_sompi"))
    from ..functions import exact as E

    at = lambda k: E.ceil_quotient(F.lit("20000000000000000000").cast("decimal(38,0)"), F.lit(100_000_000_000) + F.col(k))
    jump = F.when((F.substring("market_covenant_id", 1, 1) < "6") & (F.col("seq") == 700), 100_000).otherwise(0)
    t = t.withColumns({"base_before": at("kas_before_sompi"), "base_after": at("kas_after_sompi") + jump})
    return t.withColumns({"base_amount": F.abs(F.col("base_after") - F.col("base_before")), "quote_sompi": F.abs(F.col("kas_after_sompi") - F.col("kas_before_sompi"))})


def _trials(spark, sf_dir):
    t = tried(spark, sf_dir)
    tries = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(v).cast("long").alias("v")) for p, v in ((-1, 0), (0, 100_000_000_000), (1, 90_000_000_000))])
    candidates = t.select("market_covenant_id").distinct().select("market_covenant_id", F.substring("market_covenant_id", 1, 1).alias("family"), F.inline(tries))
    return P.trials(t, candidates)


_TRIAL_VIEWS = {"curve": Q._CURVE, "curved": Q._CURVED, "tried": _TRIED, "grid": _GRID, "scored": _SCORED}


@query(V.sql(_COUNTS, "trades", **_TRIAL_VIEWS))
def constant_trials(spark, sf_dir):
    return _trials(spark, sf_dir)


@query(V.sql("""SELECT family, CASE WHEN place >= 0 THEN place END AS v_place, CASE fee WHEN 0 THEN 'no fee' WHEN 1 THEN 'curve 125bps growth' ELSE 'pool 20bps' END AS fee_model, clean AS trades_clean, off AS trades_off_curve
    FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY clean DESC, place, fee) AS n FROM counts WHERE bad = 0) WHERE n = 1""", "trades", **_TRIAL_VIEWS, counts=_COUNTS))
def best_constants(spark, sf_dir):
    return P.best_trials(_trials(spark, sf_dir))


# Vesting locks over chains of four orders: some witnesses lack the value that was claimed, some locks don't commit to their schedule.
_PREFIX, _SUFFIX = b"\x6b\x51", b"\x75\xac"
_LE = "printf('%02x%02x000000000000', {0} % 256, {0} // 256)"
_LOCK = f"""SELECT o, run, j, claimed, spent, sha256(unhex('6b5120' || sha256('v' || (run % 9)) || '08' || {_LE.format("total")} || '08' || {_LE.format("(run % 500)")} || '08' || {_LE.format("500")} || '08' || {_LE.format("claimed")} || '75ac')) AS want, total
    FROM (SELECT o_orderkey AS o, o_orderkey // 4 AS run, o_orderkey % 4 AS j, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 4) * 100 + o_orderkey // 4 % 7 END AS claimed, 1000 + o_orderkey // 4 % 50 AS total, o_orderkey % 4 < 3 AND o_orderkey < (SELECT max(o_orderkey) FROM orders) AS spent FROM orders)"""


def lock_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    run, last = F.call_function("div", o, F.lit(4)), table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    hashed = lambda kind, c: F.sha2(F.concat(F.lit(kind), c.cast("string")), 256)
    rows = table(spark, sf_dir, "orders").select(o.alias("o"), run.alias("run"), (o % 4).alias("j"), (1000 + run % 50).alias("total"), F.unhex(hashed("v", run % 9)).alias("creator"), (run % 500).alias("start_score"), ((o % 4 < 3) & (o < last)).alias("spent"))
    claimed = lambda j: F.when(j == 0, 0).otherwise(j * 100 + F.col("run") % 7)
    made = lambda c: locks.program(_PREFIX, _SUFFIX, F.col("creator"), F.col("total"), F.col("start_score"), F.lit(500).cast("long"), c)
    rows = rows.withColumn("program", made(claimed(F.col("j")))).withColumn("next", claimed(F.col("j") + 1))
    two = F.unhex(F.concat(F.lit("02"), F.lpad(F.hex(F.col("next") % 256), 2, "0"), F.lpad(F.hex(F.call_function("div", F.col("next"), F.lit(256))), 2, "0")))
    said = F.when((F.col("run") % 5 == 3) & (F.col("j") == 1), F.lit(bytearray(b"\x01\x07"))).otherwise(two)
    shown = F.concat(F.unhex(F.lpad(F.hex(F.length("program").cast("long")), 2, "0")), "program")
    cells = rows.select(
        hashed("l", F.col("run")).alias("covenant_id"), hashed("t", F.col("o")).alias("txid"), F.lit(0).alias("output_index"), (F.col("o") * 10).alias("created_daa"), F.concat(F.lit(bytearray(b"\xaa\x20")), sha(F.col("program")), F.lit(bytearray(b"\x87"))).alias("spk_script"),
        F.when(F.col("spent"), hashed("t", F.col("o") + 1)).alias("spent_txid"), F.when(F.col("spent"), F.when(F.col("j") == 2, F.concat(said, F.concat(F.lit(bytearray(b"\x4c")), shown))).otherwise(said)).alias("spent_sig"),
    )
    plan = rows.where("j = 0").select(
        hashed("n", F.col("run")).alias("token_id"), hashed("l", F.col("run")).alias("lock_id"), "creator", (F.col("total") + F.when(F.col("run") % 7 == 2, 1).otherwise(0)).alias("total"), "start_score", F.lit(500).cast("long").alias("duration_score"),
        hashed("t", F.col("o")).alias("genesis_txid"), F.lit(0).alias("genesis_index"),
    )
    return plan, cells


@query(f"""WITH RECURSIVE l AS ({_LOCK}), w AS (SELECT o, run, j, claimed, 0::BIGINT AS d, 'genesis' AS proof, spent FROM l WHERE j = 0 AND run % 7 <> 2
    UNION ALL SELECT n.o, n.run, n.j, n.claimed, n.claimed - w.claimed, CASE WHEN w.run % 5 = 3 AND w.j = 1 THEN 'reveal' ELSE 'continuation_witness' END, n.spent FROM w JOIN l n ON n.o = w.o + 1 AND n.run = w.run WHERE w.spent AND (NOT (w.run % 5 = 3 AND w.j = 1) OR n.spent))
    SELECT sha256('n' || run) AS token_id, sha256('t' || o) AS txid, o * 10 AS created_daa, CAST(claimed AS BIGINT) AS claimed, CAST(d AS BIGINT) AS claimed_delta, NOT spent AS live, proof FROM w""")
def vesting_states(spark, sf_dir):
    plan, cells = lock_tables(spark, sf_dir)
    return locks.states(plan, cells, _PREFIX, _SUFFIX, sha).drop("output_index")


# Typed states and scripts of variable length over the customers.
_STATE = f"""SELECT c_custkey, '20' || sha256('k' || c_custkey) || '08' || {_LE.format("(c_custkey % 60000)")} || CASE c_custkey % 6 WHEN 0 THEN '0102' WHEN 1 THEN '0100' WHEN 2 THEN '4c0101' ELSE '0101' END || CASE WHEN c_custkey % 10 = 4 THEN '00' ELSE '' END AS h FROM customer"""


@query(f"""SELECT c_custkey, ok, CASE WHEN ok THEN substr(h, 3, 64) END AS owner, CASE WHEN ok THEN CAST(c_custkey % 60000 AS BIGINT) END AS amount, CASE WHEN ok THEN c_custkey % 6 <> 1 END AS flag, CASE WHEN ok THEN h END AS again FROM (SELECT *, c_custkey % 6 NOT IN (0, 2) AND c_custkey % 10 <> 4 AS ok FROM ({_STATE}))""")
def typed_states(spark, sf_dir):
    k = F.col("c_custkey")
    le = F.concat(F.lpad(F.lower(F.hex(k % 60000 % 256)), 2, "0"), F.lpad(F.lower(F.hex(F.call_function("div", k % 60000, F.lit(256)))), 2, "0"), F.lit("0" * 12))
    flag = F.when(k % 6 == 0, "0102").when(k % 6 == 1, "0100").when(k % 6 == 2, "4c0101").otherwise("0101")
    digits = F.concat(F.lit("20"), F.sha2(F.concat(F.lit("k"), k.cast("string")), 256), F.lit("08"), le, flag, F.when(k % 10 == 4, "00").otherwise(""))
    fields = {"owner": "pubkey", "amount": "int", "flag": "bool"}
    rows = table(spark, sf_dir, "customer").select(k, typed.decoder(fields)(F.unhex(digits)).alias("s"))
    rows = rows.select("c_custkey", F.col("s.valid").alias("ok"), F.col("s.state").alias("s"))
    again = typed.encoder(fields)(F.col("s"))
    return rows.select("c_custkey", "ok", F.lower(F.hex("s.owner")).alias("owner"), "s.amount", "s.flag", F.lower(F.hex(F.when(F.col("ok"), again))).alias("again"))


_REPEATS = "SELECT c_custkey, '63' || repeat('20' || sha256('r' || c_custkey) || '75', CAST(c_custkey % 5 AS INTEGER)) || CASE WHEN c_custkey % 7 = 3 THEN '7568' ELSE '68' END AS h FROM customer"


@query(f"""SELECT c_custkey, CASE WHEN ok THEN 'list' END AS template, CASE WHEN ok THEN CAST(c_custkey % 5 AS INTEGER) END AS repeats, CASE WHEN ok THEN sha256('r' || c_custkey) END AS first_key FROM (SELECT c_custkey, regexp_full_match(h, '63(20[0-9a-f]{{64}}75)+68') AS ok FROM ({_REPEATS}))""")
def repeated_scripts(spark, sf_dir):
    k = F.col("c_custkey")
    key = F.sha2(F.concat(F.lit("r"), k.cast("string")), 256)
    digits = F.concat(F.lit("63"), F.repeat(F.concat(F.lit("20"), key, F.lit("75")), (k % 5).cast("int")), F.when(k % 7 == 3, "7568").otherwise("68"))
    match = S.repeated_matcher({"list": ([(0x63, None, None)], [(-1, None, "key"), (0x75, None, None)], [(0x68, None, None)], 1)})
    rows = table(spark, sf_dir, "customer").select("c_custkey", match(F.unhex(digits)).alias("m"))
    return rows.select("c_custkey", "m.template", F.size("m.fields").alias("n"), F.lower(F.hex(F.get("m.fields", F.lit(0))["value"])).alias("first_key")).select("c_custkey", "template", F.when(F.col("template").isNotNull(), F.col("n")).alias("repeats"), "first_key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

"""Preflight rules, declared facts, the audit report, posted orders and holders' claims: edges by value."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lineara.functions import declared as D, scripts as S
from lineara.operators import audit as A, claims as H, preflight as R, programs as P, upkeep
from test_proofs import A as KEY, D as OTHER, locked, order, witness

TX = "txid string, version long, unknown_fields array<string>"
INS = "txid string, idx int, budget long, sig_ops int, script binary, amount long, witness binary, units long, passed boolean"
OUTS = "txid string, idx int, value long, script binary"
MASSES = "txid string, compute long, transient long, storage long"
LIMITS = (500, 500, 500)
LOCK = bytearray(b"\xaa\x20" + b"\x01" * 32 + b"\x87")


def rules(spark, tx, ins, outs, masses=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((tx, TX), (ins, INS), (outs, OUTS), (masses, MASSES))]
    found = {(r.txid, r.code): r for r in R.findings(*frames, LIMITS).collect()}
    return found, {r.txid: r for r in R.verdicts(*frames, LIMITS).collect()}


def spend(txid, budget=20, ops=None, script=LOCK, amount=7, witness=None, units=None, passed=None):
    return (txid, 0, budget, ops, script, amount, witness, units, passed)


def paid(txid):
    return (txid, 0, 5, bytearray(b"\x51"))


def test_preflight_of_inputs(spark):
    ins = [
        spend("fine"), spend("over", 70_000), spend("both", 5, 1), spend("old", None, 1), spend("bare", None), spend("zero", 0), spend("plain", 0, script=bytearray(b"\x20" + b"\x01" * 32 + b"\xac")),
        spend("long", 0, script=None, witness=bytearray(151)), spend("free", 0, units=9_999, passed=True), spend("measured", 0, units=29_999, passed=True), spend("measured more", 0, units=30_000, passed=True),
        spend("failed", 1, units=25_000, passed=False), spend("wrong", 9, units=25_000, passed=False), spend("v0", 3), spend("ops", None, 256),
    ]
    names = [r[0] for r in ins]
    tx = [(n, 0 if n in ("v0", "ops") else 1, None) for n in names]
    found, verdicts = rules(spark, tx, ins, [paid(n) for n in names], [(n, 10, 10, 10) for n in names])
    mine = {n: sorted(c for t, c in found if t == n) for n in names}
    assert mine == {
        "fine": [], "over": ["budget_overflow", "mass_skipped"], "both": ["sigop_count_ignored"], "old": ["mass_skipped", "sigop_count_on_v1"], "bare": ["budget_missing", "mass_skipped"], "zero": ["budget_missing"],
        "plain": ["fee_input_budget_missing"], "long": ["budget_missing"], "free": [], "measured": ["budget_missing"], "measured more": ["budget_missing"], "failed": ["input_script_failed"], "wrong": ["input_script_failed"],
        "v0": ["budget_on_v0"], "ops": ["sigop_overflow"],
    }
    budget = lambda t, c: found[t, c].budget
    assert [budget("zero", "budget_missing"), budget("plain", "fee_input_budget_missing"), budget("measured", "budget_missing"), budget("measured more", "budget_missing")] == [20, 10, 2, 3]
    assert budget("failed", "input_script_failed") == 2 and budget("wrong", "input_script_failed") is None
    assert {n: v.verdict for n, v in verdicts.items() if v.verdict != "will_fail"} == {"fine": "ready", "both": "ready", "free": "ready", "v0": "ready"}
    assert verdicts["fine"].fee_estimate == 201_000


def test_preflight_of_transactions(spark):
    tx = [("none", None, None), ("new", 2, ["a", "b"]), ("empty", 1, []), ("heavy", 1, None), ("unknown amount", 1, None), ("overflow", 1, None), ("bad output", 1, None), ("many", 0, None), ("no mass", 1, None), (None, 1, None)]
    ins = [spend(n) for n in ("none", "new", "heavy", "overflow", "bad output", "no mass")] + [spend("unknown amount", amount=0), spend("orphan", 70_000)]
    ins += [("many", i, None, None, LOCK, 1, None, None, None) for i in range(1001)]
    outs = [paid(n) for n in ("none", "new", "heavy", "unknown amount", "overflow", "many", "no mass")] + [("bad output", 0, None, None), ("bad output", 1, 0, bytearray())]
    masses = [(n, 10, 10, 10) for n in ("none", "new", "many", "bad output")] + [("heavy", 501, 500, 900), ("unknown amount", 1, 1, 900), ("overflow", 1, 1, None)]
    found, verdicts = rules(spark, tx, ins, outs, masses)
    mine = {t: sorted(c for n, c in found if n == t) for t, *_ in tx}
    assert mine == {
        "none": ["version_missing"], "new": ["unknown_fields", "version_unknown"], "empty": ["no_inputs", "no_outputs"], "heavy": ["mass_exceeds_limit"], "unknown amount": ["storage_mass_skipped"],
        "overflow": ["storage_mass_incomputable"], "bad output": ["output_spk_missing", "output_value_zero"], "many": ["too_many_io"], "no mass": [], None: ["no_inputs", "no_outputs"],
    }
    assert found["heavy", "mass_exceeds_limit"].detail == "compute 501 > 500, storage 900 > 500" and found["new", "unknown_fields"].detail == "a, b"
    assert {n: v.verdict for n, v in verdicts.items() if v.errors == 0} == {"none": "ready", "new": "incomplete", "unknown amount": "ready", "no mass": "incomplete"}
    assert rules(spark, [], [], [])[0] == {}
    with pytest.raises(Exception, match="."):  # a table without its columns is an error, not an empty result
        R.findings(spark.createDataFrame([(1,)], "x int"), *[spark.createDataFrame([], s) for s in (INS, OUTS, MASSES)], LIMITS).collect()


def test_inscriptions(spark):
    texts = {
        "raw": '{"p":"krc-20","op":"Mint","tick":"abc","amt":12,"to":"x"}', "hex": b'{"p":"a","op":"b"}'.hex(), "upper hex": b'{"p":"a","op":"b"}'.hex().upper(), "spaces": ' {"p":"a","op":"b","dec":"8"} ',
        "no op": '{"p":"a"}', "empty op": '{"p":"a","op":""}', "null op": '{"p":"a","op":null}', "list": '[{"p":"a","op":"b"}]', "broken": '{"p":"a","op":"b"', "digits": "1234", "none": None, "blank": "", "number": '{"p":7,"op":true}',
    }
    rows = spark.createDataFrame(list(texts.items()), "k string, t string").select("k", D.inscription(F.col("t")).alias("f")).select("k", "f", D.chip(F.col("f")).alias("chip"))
    found = {r.k: r for r in rows.collect()}
    assert {k for k, r in found.items() if r.f} == {"raw", "hex", "upper hex", "spaces", "number"}
    assert tuple(found["raw"].f) == ("krc-20", "Mint", "abc", "12", "", "", "", "x") and found["raw"].chip == "KRC-20 · mint · ABC"
    assert (found["hex"].chip, found["none"].chip, found["spaces"].f["dec"], tuple(found["number"].f)[:2]) == ("A · b", "", "8", ("7", "true"))


def test_token_facts(spark):
    doc = lambda **x: json.dumps(x).encode()
    rows = {
        "all": doc(name=" Coin ", ticker="C", symbol="D", image="HTTPS://a/b", image_hash="AB" * 32, decimals=255), "symbol": doc(symbol="D"), "first stated": doc(name="n", ticker="x" * 13, symbol="D"), "null ticker": doc(name="n", ticker=None, symbol="D"),
        "script": doc(name="n", image="javascript:alert(1)"), "control": doc(name="a\u0085b", ticker="t"), "long": doc(name="é" * 48), "too long": doc(name="é" * 49), "hex": doc(name="n").hex().encode() + b"\n", "text": doc(name="n", decimals=" 07 "),
        "minus": doc(name="n", decimals=-1), "much": doc(name="n", decimals="256"), "float": doc(name="n", decimals=2.5), "short hash": doc(name="n", image_hash="ab" * 31), "number": doc(name=5), "bytes": b"\xff\xfe", "empty": b"",
        "large": doc(name="n", pad="x" * 4096), "list": b'["name"]', "null": None,
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows.items()], "k string, p binary").select("k", D.token_facts(F.col("p")).alias("f"))
    found = {r.k: tuple(r.f) for r in df.collect() if r.f}
    only = lambda decimals=None: ("n", None, None, None, decimals)
    assert found == {
        "all": ("Coin", "C", "HTTPS://a/b", "ab" * 32, 255), "symbol": (None, "D", None, None, None), "first stated": only(), "null ticker": only(), "script": only(), "control": (None, "t", None, None, None),
        "long": ("é" * 48, None, None, None, None), "hex": only(), "text": only(7), "minus": only(), "much": only(), "float": only(), "short hash": only(),
    }


def test_shown_figures(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(D.price(F.lit(q).cast("long"), F.lit(b).cast("long"))) for q, b in ((150_000_000, 1), (1, 1), (5, 0), (0, 4), (None, 4), (10**15, 1), (123_456, 1))] == ["1.5", "0.00000001", "—", "—", "—", "10000000", "0.001235"]
    assert [one(D.shown_bytes(F.lit(n))) for n in (0, 1023, 1024, 1 << 40, 1 << 51, None)] == ["0.0 B", "1023.0 B", "1.0 KiB", "1.0 TiB", "2048.0 TiB", None]
    assert [one(D.shown_latency(F.lit(x).cast("double"))) for x in (0.05, 1, 2.5, None)] == ["≤50ms", "≤1.0s", "≤2.5s", ">10s"]
    now = F.lit("2024-03-02 00:00:00").cast("timestamp")
    assert [str(one(D.since(F.lit(t), now).cast("string"))) for t in ("30m", "24H", "7d", "all", "2024-01-01T00:00:00Z", "junk", "5s")] == ["2024-03-01 23:30:00", "2024-03-01 00:00:00", "2024-02-24 00:00:00", "None", "2024-01-01 00:00:00", "None", "None"]
    assert [one(D.batch_family(F.array(*[F.lit(t) for t in x]))) for x in (["genesis0 list", "p2pk", ""], ["genesis0 list", "escrow"], ["p2sh"], [])] == [True, False, False, False]
    assert one(D.unit_price(F.lit(3), F.lit(2))) == 1.5 and one(D.unit_price(F.lit(3), F.lit(0))) == 0.0


def built(key, number, own, tail=b"\xac"):
    return b"\x6b\x20" + key + b"\x75\x20" + key + b"\x02" + number.to_bytes(2, "little") + b"\x76\x02" + number.to_bytes(2, "little") + b"\x02" + own.to_bytes(2, "little") + tail


def test_audit_of_unknown_builds(spark):
    n = len(built(KEY, 1, 1))
    wide = lambda key: b"\x6b\x20" + key + b"\x75\x20" + key + b"\x02\x01\x00\x76\x02\x01\x00\x03" + (n + 1).to_bytes(3, "little") + b"\xac"
    programs = [("a", built(KEY, 7, n)), ("b", built(OTHER, 9, n)), ("c", wide(KEY)), ("d", built(KEY, 3, 5, b"\xad")), ("e", None)]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in programs], "id string, program binary")
    laid = A.laid(df)
    opened = A.places(laid)
    trades = spark.createDataFrame([("b",), ("b",), ("zz",)], "market_covenant_id string")
    best = spark.createDataFrame([], "family string, v_place int, fee_model string, trades_clean long, trades_off_curve long")
    rows = A.families(laid, opened, trades, best).collect()
    assert [(r.instances, r.trades, list(r.program_lens), list(r.slot_indices), r.sample_covenant, r.pool_shaped, r.reach) for r in rows] == [(3, 2, [n, n + 1], [0, 1, 2, 3, 4], "a", True, "skeleton"), (1, 0, [n], [], "d", True, "exact")]
    assert bytes(rows[0].sample_program_hash) == S.blake2b(built(KEY, 7, n))
    guesses = sorted((r.role, list(r.places), r.sample_value) for r in A.role_guesses(laid, opened).collect())
    assert guesses == [("key", [0, 1], None), ("number", [2, 3], 7), ("self_length", [4], None)]
    assert tuple(A.totals(df.select("id"), laid).first()) == (5, 4, 2, 1)
    # Places that share a value in the first member but not in another aren't one constant.
    apart = spark.createDataFrame([("a", bytearray(b"\x01\x21\x75\x01\x21")), ("b", bytearray(b"\x01\x22\x75\x01\x23"))], "id string, program binary")
    assert A.role_guesses(A.laid(apart), A.places(A.laid(apart))).count() == 0


def test_weekly_summary(spark):
    runs = spark.createDataFrame([("m", 1, "ok"), ("m", 2, "failed"), ("t", 3, "failed"), ("t", 4, None)], "network string, run_id int, outcome string")
    assert sorted(tuple(r) for r in A.headline_runs(runs).collect()) == [("m", 1, "ok"), ("t", 4, None)]
    quiet = spark.createDataFrame([("m", 3, 0, "x"), ("m", 4, None, "y")], "network string, instances long, trades long, sample_covenant string")
    assert A.specimen(A.top_families(quiet)).count() == 0
    ledger = spark.createDataFrame([("v1",), ("v2",)], "skeleton string")
    used = spark.createDataFrame([("v1",), ("v1",), ("v9",)], "skeleton string")
    assert sorted(tuple(r) for r in A.pinned(ledger, used).collect()) == [("v1", 2), ("v2", 0)] and [r[0] for r in A.unstamped(ledger, used).collect()] == ["v9"]


def test_posted_orders(spark):
    pins = spark.createDataFrame([("order", 1, bytearray(order()), [0, 1, 2, 3, 4, 5], [0, 1], [3], [2], [4], 5)], P.ORDER_PINS)
    cell = lambda cov, daa, p, sig=None: (cov, f"t{daa}", 0, daa, bytearray(locked(p)), bytearray(sig or witness(b"s" * 64, p)))
    other = b"\x51\x75"
    rows = [cell("x", 5, other), cell("x", 6, order(11)), cell("x", 7, order(12)), cell("late", 99, order(13)), cell("lie", 1, order(14), witness(b"s", other))] + [cell("late", i, other) for i in range(8)]
    rows.append(("unspent", "t", 0, 1, bytearray(locked(order())), None))
    cells = spark.createDataFrame(rows, "covenant_id string, txid string, output_index int, created_daa long, spk_script binary, spent_sig binary")
    assert [(r.covenant_id, r.price_units, r.posted_daa) for r in P.posted_orders(cells, pins).collect()] == [("x", 11, 6)]


def test_passport(spark):
    claims = spark.createDataFrame([(1, f"a{i % 7}", f"b{i}", i) for i in range(9)] + [(1, None, "b", 0)], "v int, address string, badge string, granted_ms long")
    rows, root = H.passport(claims)
    found = sorted(rows.collect(), key=lambda r: r.i)
    assert [r.i for r in found] == list(range(10)) and [r.claim for r in found] == sorted(r.claim for r in found)
    assert json.loads(found[-1].claim)["address"] is None or json.loads(found[0].claim)["address"] is not None
    assert all(r.leaf == hashlib.sha256(r.claim.encode()).hexdigest() for r in found)
    top = root.first().h
    assert all(r.ok for r in rows.select(upkeep.proven(F.col("leaf"), F.col("proof"), F.lit(top)).alias("ok")).collect())
    shuffled, again = H.passport(claims.orderBy(F.desc("badge")))
    assert again.first().h == top and shuffled.count() == 10
    assert H.numbered(claims.limit(0)).count() == 0


def test_holders(spark):
    rec = "holder string, balance long, alerts boolean, unreachable boolean, participation array<struct<round_id:int,closed_ms:long>>, phases map<string,string>, bucket string"
    rows = [("a", 100, True, None, [(3, None)], {"t": "bonding"}, "dust"), ("b", 99, None, None, None, {"t": "bonding"}, "dust"), ("c", None, True, True, [], {"t": "bonding"}, "dust"), ("d", 5, True, False, None, None, None)]
    records = spark.createDataFrame(rows, rec)
    voters = spark.createDataFrame([(h,) for h in "abcza"], "holder string")
    assert {r.holder: (r.ok, r.reason) for r in H.eligibility(voters, records).collect()} == {"a": (True, None), "b": (False, "below floor"), "c": (False, "below floor"), "z": (False, "unverified")}
    latest = spark.createDataFrame([(h, {"t": "graduated", "u": "bonding"}, "above") for h in "abcd"], "holder string, phases map<string,string>, bucket string")
    assert sorted(map(str, (tuple(r) for r in H.deliverable(records, latest).collect()))) == sorted(map(str, [("a", "phase", "t", "bonding", "graduated"), ("a", "balance", None, "dust", "above")]))
    assert [tuple(r) for r in H.participation(records, "s").collect()] == [(1, "a", "voted-3", 0, "s")]


def test_index_and_columns(spark):
    index = spark.createDataFrame([("aaaa1", "red fox", "red fox"), ("bbbb2", "owl", "owl")], "covenant_id string, base string, name string")
    more = spark.createDataFrame([("cccc3", "red fox"), ("cccc3", "red fox"), ("bbbb2", "owl")], "covenant_id string, base string")
    assert sorted(r.name for r in H.appended(index, more).collect()) == ["owl", "red fox-aaaa", "red fox-cccc"]
    events = spark.createDataFrame([(5, "genesis"), (25, "burn"), (26, "transition"), (90, "burn")], "accepting_daa long, kind string")
    rows = sorted(tuple(r) for r in H.activity_columns(events, 10, tip=45).collect())
    assert rows == [(0, 0, 1, 0, 0, 1), (1, 10, 0, 0, 0, 0), (2, 20, 0, 1, 1, 2), (3, 30, 0, 0, 0, 0), (4, 40, 0, 0, 0, 0)]
    assert [r.daa for r in H.activity_columns(events, 10, most=2).orderBy("daa").collect()] == [80, 90] and H.activity_columns(events.limit(0), 10).count() == 0
    assert [r.total for r in H.activity_columns(events.limit(0), 10, tip=45).collect()] == [0]

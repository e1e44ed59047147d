"""Worked examples of the ledger, on small frames."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lineara.functions import exact as E, owners as O, payload as P, scripts as S
from identity import covenant_id
from lineara.operators import coins as C, feeds as D, lineage as L, market as M, tokens as T, traffic, upkeep as U
from lineara.sources import landing, snapshots

TX = "ord bigint, accepting_block string, accepting_daa bigint, accepting_time_ms bigint, tx_index int, txid string, inputs array<struct<prev_txid:string,prev_index:int,signature_script:binary,compute_budget:int>>, outputs array<struct<value:bigint,spk_version:int,spk_script:binary,covenant:struct<covenant_id:string,authorizing_input:int>>>, payload binary"
VALUE, SPK = 100_000_000, b"\xaa\xbb"


def coin(prev_txid, prev_index, outputs):
    """The id that the default rule gives."""
    text = ";".join(f"{i}:{VALUE}:0:{SPK.hex().upper()}" for i in outputs)
    return hashlib.sha256(f"{prev_txid}|{prev_index}|{text}".encode()).hexdigest()


def out(ident, auth=0):
    return (VALUE, 0, SPK, (ident, auth))


X = coin("01", 0, [0])


def tx(n, block, daa, txid, inputs, outputs, payload=b"\xde\xad"):
    return (n, block, daa, daa * 100, 0, txid, [(t, i, b"\x01\x99", 7) for t, i in inputs], outputs, payload)


BLOCKS = [tx(1, "b1", 100, "A0", [("01", 0)], [out(X)]), tx(2, "b2", 200, "B0", [("A0", 0)], [out(X)]), tx(3, "b3", 300, "D0", [("B0", 0)], [])]


def step(spark, ledger, txs):
    ledger = L.apply(ledger, *L.classify(spark.createDataFrame(txs, TX), ledger, covenant_id))
    # Lineage is cut so that plans of a chain of steps stay small.
    return L.Ledger(*(spark.createDataFrame(x.collect(), x.schema) for x in (ledger.covenants, ledger.events, ledger.cells, ledger.reorgs)))


def kinds(ledger):
    return [r.kind for r in ledger.events.orderBy("covenant_id", "seq").collect()]


def alive(ledger):
    return ledger.cells.where("spent_block is null").count()


def test_lineage_and_reorganisation(spark):
    one = step(spark, L.Ledger.empty(spark), BLOCKS[:2])
    assert kinds(one) == ["genesis", "transition"] and alive(one) == 1
    row = one.covenants.first()
    assert (row.genesis_txid, row.genesis_daa, row.lineage_complete, row.event_count, row.last_activity_daa) == ("A0", 100, True, 2, 200)
    burnt = step(spark, one, BLOCKS[2:])
    assert kinds(burnt) == ["genesis", "transition", "burn"] and alive(burnt) == 0
    cell = burnt.cells.where("txid = 'B0'").first()
    assert (bytes(cell.spent_sig), cell.spent_budget, cell.spent_txid) == (b"\x01\x99", 7, "D0")
    assert L.chain_of(burnt.cells, ("A0", 0)) == ["A0:0", "B0:0"]
    removed = spark.createDataFrame([("b3",)], "block string")
    assert {r.covenant_id for r in L.affected(burnt, removed).collect()} == {X}
    back = L.rollback(burnt, removed, 300)
    assert kinds(back) == ["genesis", "transition"] and alive(back) == 1
    assert back.cells.where("txid = 'B0'").first().spent_sig is None and [tuple(r) for r in back.reorgs.collect()] == [(300, 1)]
    again = step(spark, back, [tx(5, "b5", 310, "D0", [("B0", 0)], [])])
    assert kinds(again) == ["genesis", "transition", "burn"] and alive(again) == 0
    none = L.rollback(one, spark.createDataFrame([("b1",), ("b2",)], "block string"))
    assert none.covenants.count() == none.events.count() == none.cells.count() == 0


def test_truncated_lineage_and_chains_inside_a_block(spark):
    late = step(spark, L.Ledger.empty(spark), [tx(1, "b1", 100, "A0", [("01", 0)], [out("ff" * 32)])])
    assert kinds(late) == ["transition"] and late.covenants.first().lineage_complete is False
    inside = step(spark, L.Ledger.empty(spark), [tx(1, "b1", 100, "A0", [("01", 0)], [out(X)]), tx(2, "b1", 100, "B0", [("A0", 0)], [])])
    assert kinds(inside) == ["genesis", "burn"] and alive(inside) == 0
    two = step(spark, L.Ledger.empty(spark), [tx(1, "b1", 100, "A0", [("01", 0), ("02", 0)], [out(X, 0), out(X, 1)])])
    assert kinds(two) == ["transition"]  # two authorizing inputs prove nothing


def test_pending_transactions(spark):
    ledger = step(spark, L.Ledger.empty(spark), BLOCKS[:1])
    rows = [(9, None, 0, 0, 0, "P0", [("A0", 0, b"", 0)], [out(X)], b""), (10, None, 0, 0, 0, "P1", [("A0", 0, b"", 0)], [], b"")]
    assert {tuple(r) for r in L.pending(spark.createDataFrame(rows[:1], TX), ledger, covenant_id).collect()} == {("P0", X, "transition")}
    assert {tuple(r) for r in L.pending(spark.createDataFrame(rows[1:], TX), ledger, covenant_id).collect()} == {("P1", X, "burn")}


def test_gap_recovery_is_idempotent(spark):
    """Events below and above a hole; the hole's genesis and a burn after it are merged and renumbered."""
    ledger = step(spark, step(spark, L.Ledger.empty(spark), BLOCKS[:1]), [tx(9, "b9", 900, "Z0", [("77", 0)], [out(X)])])
    y_ = hashlib.sha256(f"02|0|1:{VALUE}:0:{SPK.hex().upper()}".encode()).hexdigest()
    hole = spark.createDataFrame([tx(3, "b3", 300, "C0", [("A0", 0), ("02", 0)], [out(X), (VALUE, 0, SPK, (y_, 1))])], TX)
    merged = L.recover(ledger, *L.classify(hole, ledger, covenant_id))
    merged = L.Ledger(*(spark.createDataFrame(f.collect(), f.schema) for f in (merged.covenants, merged.events, merged.cells, merged.reorgs)))
    events, spent = L.late_burns(spark.createDataFrame([tx(8, "b8", 800, "E0", [("C0", 1)], [])], TX), merged.cells)
    done = L.recover(merged, events, L._created(hole.limit(0)), spent)
    done = L.Ledger(*(spark.createDataFrame(f.collect(), f.schema) for f in (done.covenants, done.events, done.cells, done.reorgs)))
    seen = [(r.covenant_id == X, r.seq, r.kind, r.accepting_daa) for r in done.events.orderBy("accepting_daa", "covenant_id").collect()]
    assert sorted(s for s in seen if s[0]) == [(True, 0, "genesis", 100), (True, 1, "transition", 300), (True, 2, "transition", 900)]
    assert sorted(s for s in seen if not s[0]) == [(False, 0, "genesis", 300), (False, 1, "burn", 800)]
    row = done.covenants.where(F.col("covenant_id") == y_).first()
    assert (row.genesis_daa, row.lineage_complete, row.event_count) == (300, True, 2)
    twice = L.recover(done, *L.classify(hole, ledger, covenant_id))
    for a, b in ((twice.events, done.events), (twice.cells, done.cells), (twice.covenants, done.covenants)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


EVENTS = "covenant_id string, seq bigint, kind string, accepting_daa bigint"
CELLS = "covenant_id string, value bigint, created_daa bigint, spent_block string"


def digest_frames(spark):
    events = [("A1", 0, "genesis", 1000), ("A1", 1, "burn", 999_000), ("B2", 0, "genesis", 999_000), ("B2", 1, "transition", 999_000), ("B2", 2, "transition", 999_000)]
    cov = spark.createDataFrame([("A1", 1000), ("B2", 999_000)], "covenant_id string, genesis_daa bigint")
    cells = spark.createDataFrame([("B2", 5_000_000_000, 999_000, None), ("A1", 1, 1000, "x")], CELLS)
    return cov, spark.createDataFrame(events, EVENTS), cells


def test_digest(spark):
    cov, events, cells = digest_frames(spark)
    assert tuple(C.digest(cov, events, cells, 864_000, 1_000_000).first()) == (1, 2, 1, 5_000_000_000, 1, "B2", 3, "B2", 5_000_000_000)
    assert tuple(C.digest(cov, events, cells, 1000, 1_000_000).first())[:3] == (1, 2, 1)  # the bound itself is inside
    assert tuple(C.digest(cov.limit(0), events.limit(0), cells.limit(0), 864_000).first()) == (0, 0, 0, 0, 0, None, None, None, None)


def test_lifespans(spark):
    events = spark.createDataFrame([("A", 0, "genesis", 1000), ("A", 1, "burn", 1000), ("A", 2, "burn", 1100), ("B", 0, "burn", 5), ("B", 1, "genesis", 10), ("C", 0, "genesis", 0), ("C", 1, "burn", 216_000)], EVENTS)
    lives = C.lifespans(events)
    assert sorted(r.life for r in lives.collect()) == [0, 100, 216_000]
    assert [r.n for r in C.lifespan_classes(lives).orderBy("class").collect()] == [1, 1, 0, 0, 0, 1]
    assert [r.alive_share for r in C.survival(lives).orderBy("class").collect()] == [0.666667, 0.333333, 0.333333, 0.333333, 0.333333, 0.0]


def test_canonical_feed(spark):
    rows = [(100, 2, "20", "C"), (100, 5, "50", "A"), (100, 7, "70", "D"), (100, None, "60", "A"), (105, 0, "10", "B"), (105, 1, "40", "9"), (105, 1, "40", "A"), (105, None, "80", "F"), (110, 3, "30", "E"), (110, None, "90", "B")]
    events = spark.createDataFrame([(d, i, t, c, 0) for d, i, t, c in reversed(rows)], "accepting_daa int, tx_index int, txid string, covenant_id string, seq int")
    order = [t + c for _, _, t, c in rows]
    page = lambda after, n: [(r.accepting_daa, r.txid + r.covenant_id) for r in D.canonical(events, after, n).collect()]
    assert [x for _, x in page(None, 100)] == order
    assert [x for _, x in page((100, 2), 3)] == order[2:5]
    for size in (1, 3, 4):
        got, cursor = [], None
        while part := page(cursor, size):
            got += part
            daa = got[-1][0]
            cursor = (daa, sum(d == daa for d, _ in got))
        assert [x for _, x in got] == order


STATES = "token_id string, txid string, seq bigint, side string, idx int, owner string, amount bigint, minter boolean, proven boolean"


def owner(n, kind="00"):
    return kind + f"{n:02x}" * 32


def token(spark, rows, live, genesis=("t0",)):
    states = spark.createDataFrame([("K", t, s, side, i, o, a, m, p) for t, s, side, i, o, a, m, p in rows], STATES)
    cells = spark.createDataFrame([("K", "", 0, "out", 0, o, a, False, p) for o, a, p in live], STATES)
    events = T.classified(states, spark.createDataFrame([("K", t) for t in genesis], "token_id string, txid string"))
    return states, events, T.accounts(events, cells).first()


M0 = owner(1)
HAPPY = [
    ("t0", 0, "out", 0, M0, 0, True, True), ("t1", 1, "in", 0, M0, 0, True, True), ("t1", 1, "out", 0, M0, 0, True, True), ("t1", 1, "out", 1, owner(0x20), 100, False, True),
    ("t2", 2, "in", 0, owner(0x20), 100, False, True), ("t2", 2, "out", 0, owner(0x30), 60, False, True), ("t2", 2, "out", 1, owner(0x40), 40, False, True),
]


def test_token_happy_path(spark):
    states, events, row = token(spark, HAPPY, [(M0, 0, True), (owner(0x30), 60, True), (owner(0x40), 40, True)])
    assert (row.status, row.supply, row.minted, row.burned, row.holders, row.held_wallet) == ("verified", 100, 100, 0, 3, 100)
    assert [r.kind for r in events.orderBy("seq").collect()] == ["genesis", "mint", "split"]
    deltas = T.deltas(states, events)
    page = D.token_event_page(deltas, "K", 0, 1).orderBy("delta_idx").collect()
    assert [(r.seq, int(r.amount), r.owner_to) for r in page] == [(1, 0, M0), (1, 100, owner(0x20))]


def test_token_violations(spark):
    base = [("t0", 0, "out", 0, owner(1), 10, False, True)]
    live = [(owner(1), 20, True)]
    more = [*base, ("t1", 1, "in", 0, owner(1), 10, False, True), ("t1", 1, "out", 0, owner(1), 20, False, True)]
    assert token(spark, more, live)[2].status == "invalid"
    escal = [*base, ("t1", 1, "in", 0, owner(1), 10, False, True), ("t1", 1, "out", 0, owner(1), 10, True, True)]
    assert token(spark, escal, [(owner(1), 10, True)])[2].reason == "minter state created without a minter input"
    opaque = [*base, ("t1", 1, "in", 0, owner(1), 10, False, True), ("t1", 1, "out", 0, None, None, None, False)]
    row = token(spark, opaque, [(None, None, False)])[2]
    assert (row.status, row.supply, row.unresolved) == ("unvalidated", None, 1)
    burn = [*base, ("t1", 1, "in", 0, owner(1), 10, False, True)]
    assert token(spark, burn, [])[2].status == "unvalidated"
    assert token(spark, HAPPY, [(owner(0x30), 60, True)])[2].status == "unvalidated"  # the frontier lacks 40


def test_worked_supply(spark):
    rows = [("t0", 0, "out", 0, M0, 0, True, True)]
    for i in range(1, 6):
        rows += [(f"t{i}", i, "in", 0, M0, 0, True, True), (f"t{i}", i, "out", 0, M0, 0, True, True), (f"t{i}", i, "out", 1, owner(i + 10), 199_469_400, False, True)]
    row = token(spark, rows, [(owner(i + 10), 199_469_400, True) for i in range(1, 6)])[2]
    assert (row.status, row.supply) == ("verified", 997_347_000)


def test_trade_and_graduation(spark):
    market = owner(0xAB, "02")
    rows = [("K", "t5", 5, "in", 0, market, 700, False, True), ("K", "t5", 5, "out", 0, market, 500, False, True), ("K", "t5", 5, "out", 1, owner(9), 200, False, True)]
    reserves = spark.createDataFrame([("t5", "ab" * 32, 5000, 6000)], "txid string, market string, k0 bigint, k1 bigint")
    events = spark.createDataFrame([("t5", "K"), ("t5", "ab" * 32)], "txid string, covenant_id string")
    row = T.trades(spark.createDataFrame(rows, STATES), reserves, events).first()
    assert (row.side, row.base_amount, row.quote_sompi, row.kas_before_sompi, row.kas_after_sompi, row.base_before, row.base_after, row.co_covenants, row.counterparty) == ("buy", 200, 1000, 5000, 6000, 700, 500, 0, owner(9))
    moved = [("K", "t6", 6, "in", 0, market, 500, False, True), ("K", "t6", 6, "out", 0, owner(0xCD, "02"), 500, False, True)]
    assert T.trades(spark.createDataFrame(moved, STATES), reserves, events).count() == 0


def test_bracket_and_invariant(spark):
    v, k0, q, b0, b1 = 900_000_000_000, 100_000_000_000, 250_000_000_000, 10_000_000, 8_000_000
    cases = {"trade": (k0, k0 + q, b0, b1, 2_000_000), "donated": (k0, k0 + q, b0, b0 - 1, 1), "shrunk": (k0, k0 + q - 10_000_000_000, b0, b1, 2_000_000), "grown": (k0, (k0 + q) * 101 // 100, b0, b1, 2_000_000)}
    frame = spark.createDataFrame([(n, *x) for n, x in cases.items()], "n string, k0 long, k1 long, b0 long, b1 long, base long")
    c = {x: F.col(x) for x in frame.columns}
    args = [F.lit(v), c["k0"], c["k1"], c["b0"], c["b1"], F.lit(q)]
    got = {r.n: (r.b, r.i) for r in frame.select("n", E.bracket_holds(*args, c["base"], F.lit(True), F.lit(0)).alias("b"), E.invariant_holds(*args, F.lit(0)).alias("i")).collect()}
    assert got["trade"] == (True, True) and got["donated"][0] is False and got["shrunk"][1] is False and got["grown"][1] is False


def test_exact_arithmetic(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(E.change_bps(F.lit(3), F.lit(1), F.lit(2), F.lit(1))) == -3333  # cut toward zero, not down
    assert val(E.change_bps(F.lit(0), F.lit(1), F.lit(2), F.lit(1))) is None
    assert val(E.quotient(F.lit("99999999999999999999999999999999999999").cast("decimal(38,0)"), F.lit(1))) is None
    assert val(E.little_endian(F.unhex(F.lit("0100")))) == 1 and val(E.little_endian(F.unhex(F.lit("ffffffffffffffff")))) is None
    assert val(E.scaled(F.lit(12345), F.lit(3))) == "12.345" and val(E.scaled(F.lit(5), F.lit(3))) == "0.005" and val(E.scaled(F.lit(1000), F.lit(3))) == "1"
    assert [val(E.vested(F.lit(100), F.lit(10), 50, n)) for n in (0, 10, 35, 60, 99)] == [0, 0, 50, 100, 100]


def test_orders_and_vesting(spark):
    cells = spark.createDataFrame([("o1", None, None), ("o2", "b", 50), ("o3", "b", 51)], "covenant_id string, spent_block string, spent_daa bigint")
    orders = spark.createDataFrame([("o1", 50, 7, 2), ("o2", 50, 7, 2), ("o3", 50, 7, 2)], "covenant_id string, expiry_daa bigint, quote_sompi bigint, base_amount bigint")
    states = M.order_states(orders, cells)
    assert sorted((r.covenant_id, r.state, r.resolved_daa) for r in states.collect()) == [("o1", "open", None), ("o2", "filled", 50), ("o3", "cancelled", 51)]
    assert [r.covenant_id for r in M.best_first(states, 5).collect()] == ["o1"]
    plan = spark.createDataFrame([(100, 10, 50, 20)], "total bigint, start_score bigint, duration_score bigint, claimed bigint")
    got = [tuple(M.vesting(plan, t).select("status", "vested_at_tip", "claimable").first()) for t in (5, 35, 60)]
    assert got == [("not_started", 0, 0), ("vesting", 50, 30), ("vested", 100, 80)]
    assert M.vesting(plan, None).first().status == "unknown"


TRADES = "token_id string, seq bigint, txid string, quote_sompi bigint, base_amount bigint, co_covenants int, accepting_time_ms bigint"


def test_candles(spark):
    rows = [("K", i, f"x{i}", q, 10, 0, ms) for i, (q, ms) in enumerate([(100, 0), (300, 10), (200, 20), (50, 900_000)])]
    made = M.candles(spark.createDataFrame([*rows, ("K", 9, "co", 9999, 1, 1, 5), ("F", 0, "a", 1, 1, 0, 0), ("N", 0, "a", 1, 1, 0, 0), ("N", 1, "b", 1, 1, 0, None), ("N", 2, "c", 1, 1, 0, 1)], TRADES), 900_000)
    got = sorted((r.token_id, r.t0, r.open, r.high, r.low, r.close, r.volume_sompi, r.last_txid) for r in made.collect())
    assert got == [("K", 0, 10.0, 30.0, 10.0, 20.0, 600, "x2"), ("K", 900_000, 5.0, 5.0, 5.0, 5.0, 50, "x3")]


LOG = landing.ACCESS_LOG


def request(ts, ip, path, agent="Mozilla/5.0", status=200, **more):
    heads = {"User-Agent": [agent], **({"Cf-Connecting-Ip": [ip]} if ip else {}), **{k: [v] for k, v in more.items()}}
    return (float(ts), status, 10, 0.02, ("GET", path, heads, "r", None))


def test_traffic(spark):
    t = 1_700_000_000
    rows = [request(t, "a", "/"), request(t + 60, "a", "/tokens"), request(t + 1900, "a", "/"), request(t + 5, "b", "/explore"), request(t + 6, "b", "/data/x.json", **{"sec-fetch-site": "same-origin"}),
            request(t + 7, "c", "/data/y.json", "curl/8"), request(t + 8, "d", "/health", "uptime-probe"), request(t + 9, "e", "/wp-login.php"), request(t + 9, "f", "/.git/config"), request(t, "g", "/ops/traffic/x")]
    got = traffic.prepared(spark.createDataFrame(rows, LOG))
    r = traffic.totals(got).first()
    assert (r.unique_visitors, r.active_browsers, r.page_views, r.api_calls, r.first_party_api_calls, r.health_checks, r.bot_requests, r.requests) == (2, 2, 4, 2, 1, 1, 2, 9)
    assert traffic.page_sessions(got).agg(F.sum("sessions")).first()[0] == 3
    one = lambda p: spark.range(1).select(traffic.normalized(F.lit(p)).alias("x")).first().x
    assert one(f"/data/mainnet/c/{'a' * 64}.json") == "/data/mainnet/c/:id.json" and one("/data/mainnet/addr/k%3Aqq.json") == "/data/mainnet/addr/:address" and one("/x/12345/y") == "/x/:n/y"
    at = traffic.latency(spark.createDataFrame([(0.001,), (0.0011,), (11.0,)], "seconds double"), (33, 50, 99)).first()
    assert (at.total, at.p33, at.p50, at.p99) == (3, 0.001, 0.005, None)


def test_log_source(spark, tmp_path):
    good = '{"ts": 200.0, "status": 200, "size": 1, "duration": 0.1, "request": {"method": "GET", "uri": "/", "headers": {"A": ["b"]}}}'
    (tmp_path / "a.log").write_text("\n".join([good.replace("200.0", "50.0"), "{not json", good]) + "\n")
    rows, counts = landing.access_log(spark, str(tmp_path / "*.log"), 100.0)
    assert rows.count() == 1 and tuple(counts.first()) == (1, 1, 1)


def test_token_list_and_snapshots(spark, tmp_path):
    body = '{"network": "n", "tokens": [{"covenantId": " %s ", "name": "A", "symbol": "TOOLONGSYMBOL", "logoURI": "ftp://x", "decimals": 8}, {"covenantId": "zz"}]}' % ("AB" * 32)
    lists = spark.createDataFrame([(body,), (body.replace('"n"', '"other"'),), (None,)], "body string")
    assert [tuple(r)[:5] for r in landing.token_list(lists, "n").collect()] == [("ab" * 32, "A", None, None, 8)]
    path = "file://" + str(tmp_path / "kv")
    with pytest.raises(FileNotFoundError):
        snapshots.existing(spark, path)
    assert snapshots.get(spark, path, "a") is None
    snapshots.put(spark, path, {"a": "1", "b": "2"})
    snapshots.put(spark, path, {"a": "3"})
    assert (snapshots.get(spark, path, "a"), snapshots.get(spark, path, "b"), snapshots.versions(spark, path)) == ("3", "2", [0, 1])


def test_payload_labels(spark):
    rows = [b'{"p":"krc-20","op":"mint","tick":"ABC"}', b'{"p":"krc-20","op":"mint"}'.hex().encode() + b"zz", b"\x01\x02\x03\x04" + bytes(16) + b"x", b"ab", None, b'{"t":"note","a":1}', b'{"tick":"Q"}', b'{"b":1,"a":2} tail', b"{\"broken"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p binary")
    got = [tuple(r) for r in frame.orderBy("i").select(P.lane_namespace(F.col("p")), P.payload_tag(F.col("p")), P.inscription_kind(F.col("p"))).collect()]
    assert got == [(None, "json", "krc-20 · mint · ABC"), (None, "jsonhex", "krc-20 · mint"), ("01020304", "tag:01020304", ""), (None, "", ""), (None, None, None), (None, "json", "note"), (None, "json", "token · Q"), (None, "json", "a"), (None, "json", "")]


def test_scripts(spark):
    program = b"\x20" + b"\x07" * 32 + b"\x01\x00" + b"\x08" + S.state_int(500) + b"\x01\x00" + b"\x75"
    spk = b"\xaa\x20" + S.blake2b(program) + b"\x87"
    witness = b"\x02ab" + bytes([0x4C, len(program)]) + program
    row = spark.createDataFrame([(spk, witness, program, b"\x20" + b"\x09" * 32 + b"\xac")], "spk binary, sig binary, program binary, key binary")
    got = row.select(S.revealed("spk", "sig").alias("r"), S.disassemble("sig").alias("d"), S.token_state(F.col("program")).alias("s"), O.script_hash(F.col("spk")).alias("h"), O.pay_to_key(F.col("key")).alias("k"), S.revealed("spk", F.lit(b"\x01x")).alias("bad"))
    r = got.first()
    assert bytes(r.r) == program and bytes(r.h) == S.blake2b(program) and bytes(r.k) == b"\x09" * 32 and r.bad is None
    assert [o.name for o in r.d.ops] == ["OpData", "OpPushData1"] and r.d.truncated is False
    assert r.s.owner == "00" + "07" * 32 and S.read_state_int(bytes(r.s.amount)) == 500 and r.s.minter == 0
    other = S.spliced(program, b"\x08" * 32, 2, 7, False)
    assert S.proves(program, b"\xaa\x20" + S.blake2b(other) + b"\x87", b"\x08" * 32, 2, 7, False)
    assert S.walk(b"\x05ab") == ([(0, 5, None)], True) and S.opcodes(spark).count() == 256
    assert S.read_script_number(b"\x80") is None and S.script_number(-128) == b"\x80\x80" and S.read_state_int(b"\0" * 7 + b"\x80") is None
    bones = S.skeleton([b"\x02ab\x75\x01x", b"\x02cd\x75\x01x"])
    assert S.fits(b"\x03xyz\x75\x01x", bones) == [b"xyz"] and S.fits(b"\x03xyz\x76\x01x", bones) is None
    match = S.matcher({"pair": bones})
    assert row.select(match(F.lit(b"\x02zz\x75\x01x")).alias("m")).first().m.template == "pair"
    slots = S.build_slots(spark.createDataFrame([(1, b"\x02ab\x75\x01x"), (2, b"\x02cd\x75\x01x")], "id int, program binary"))
    assert [(r.place, r.n_values) for r in slots.collect()] == [(0, 2)]


def test_owner_display(spark):
    keys = ["00" + "a" * 64, "01" + "a" * 64, "02" + "a" * 64, "03" + "a" * 64, "09" + "a" * 64, "short"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(O.owner_display(F.col("k")).alias("d"))
    assert [r.d for r in rows.collect()] == ["a" * 64, "script:" + "a" * 64, "covenant:" + "a" * 64, "presence:" + "a" * 64, keys[4], "short"]


def test_merkle_and_ballots(spark):
    for n in (1, 2, 5, 8, 13):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        level = leaves
        while len(level) > 1:
            level = [hashlib.sha256(b"".join(bytes.fromhex(x) for x in sorted(level[i : i + 2]))).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        frame = spark.createDataFrame(list(enumerate(leaves)), "i bigint, h string")
        assert [r.h for r in U.merkle_root(frame).collect()] == level
        proofs = U.merkle_proofs(frame).join(frame, "i").select(U.proven(F.col("h"), F.col("proof"), F.lit(level[0])).alias("ok"), U.proven(F.sha2(F.lit("no"), 256), F.col("proof"), F.lit(level[0])).alias("bad"))
        assert all(r.ok and not r.bad for r in proofs.collect()) and proofs.count() == n
    assert U.merkle_root(spark.createDataFrame([], "i bigint, h string")).count() == 0


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, U.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, U.upsert(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    todo = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert U.pending(todo, "v", "k") and [r.v for r in U.backfilled(todo, "v", F.lit("n")).orderBy("k").collect()] == ["n", "x"]
    log = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0, "running")], "run long, added long, removed long, changed long, verified long, invalid long, unvalidated long, state string")
    st = lambda *r: spark.createDataFrame(list(r), "token_id string, status string")
    done = U.run_finished(log, 1, st(("a", "verified"), ("b", "invalid")), st(("a", "invalid"), ("c", "verified"))).first()
    assert (done.added, done.removed, done.changed, done.verified, done.invalid, done.state) == (1, 1, 1, 1, 1, "ok")
    assert [r.run for r in U.newest(spark.createDataFrame([(i,) for i in range(5)], "run int"), "run", 2).collect()] == [4, 3]

"""Token states from raw scripts, program matchers, locks and typed states: worked examples with BLAKE2b."""

import pytest
from pyspark.sql import functions as F

from lineara.functions import scripts as S, typed
from lineara.operators import locks, programs as P, proofs, tokens as T

CELLS = "token_id string, txid string, output_index int, spk_script binary, spent_txid string, spent_sig binary"


def program(owner, kind, amount, minter, tail=b"\x75\xac"):
    return b"\x20" + owner + b"\x01" + bytes([kind]) + b"\x08" + S.state_int(amount) + b"\x01" + bytes([minter]) + tail


def locked(p):
    return b"\xaa\x20" + S.blake2b(p) + b"\x87"


def witness(*data):
    return b"".join(typed.push(d) for d in data)


def frame(spark, rows):
    return spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], CELLS)


A, B, C, D = (bytes([i]) * 32 for i in range(1, 5))


def test_states_recovered_one_from_the_other(spark):
    """Two cells that depend on each other: the second's build is known only once the first is proven, by a witness of another coin."""
    p0, p1, p2, p3 = program(A, 0, 0, 1), program(B, 0, 500, 0), program(C, 3, 500, 0), program(D, 0, 7, 0)
    rows = [
        ("K", "t0", 0, locked(p0), "t1", witness(p0)),  # revealed
        ("K", "t1", 0, locked(p1), "t2", witness(C, b"\xf4\x01")),  # proven by t1's foreign witness; its own states t2's output
        ("K", "t2", 0, locked(p2), None, None),  # live: proven from the cell before it
        ("K", "t2", 1, locked(p3), None, None),  # nobody states its amount
        ("K", "t3", 0, p1, "t4", None),  # a bare state
        ("K", "t4", 0, locked(p1), "t5", witness(b"\x01")),  # no reveal, no base that fits its witness
        ("K", "t6", 0, locked(b"\x51"), "t7", witness(b"\x51")),  # another program
        ("K", "t8", 0, locked(p1), "t9", None),
    ]
    cells = frame(spark, rows)
    spends = proofs.witnesses(cells).unionByName(spark.createDataFrame([("t1", bytearray(witness(B, S.state_int(500))))], "txid string, sig binary"))
    found = {(r.txid, r.output_index): r for r in proofs.judged(proofs.recovered(proofs.direct(cells), spends)).collect()}
    assert {k: (r.proven, r.owner, r.amount, r.minter) for k, r in found.items() if r.proven} == {
        ("t0", 0): (True, "00" + A.hex(), 0, True), ("t1", 0): (True, "00" + B.hex(), 500, False), ("t2", 0): (True, "03" + C.hex(), 500, False), ("t3", 0): (True, "00" + B.hex(), 500, False),
    }
    assert {k[0]: r.why for k, r in found.items() if not r.proven} == {
        "t2": "live state unproven for t2:1", "t4": "spend of t4:0 does not reveal its committed program", "t6": "reveal of t6:0 is not a recognised build", "t8": "reveal missing for spent output t8:0",
    }
    alone = proofs.recovered(proofs.direct(cells), proofs.witnesses(cells))
    assert alone.where("txid = 't2' and program is not null").count() == 0  # without the foreign witness neither is proven


def test_all_values_of_a_witness_are_tried(spark, monkeypatch):
    p0, p1 = program(A, 0, 0, 1), program(C, 2, 500, 0)
    owners = [bytes([i]) * 31 + b"\xee" for i in range(70)] + [C]
    amounts = [bytes([1, i]) for i in range(70)] + [b"\xf4\x01"]
    cells = frame(spark, [("K", "t0", 0, locked(p0), "t1", witness(*owners, *amounts, p0)), ("K", "t1", 0, locked(p1), None, None)])
    for pairs in (proofs.PAIRS, 1 << 40):  # dealt over the tasks, and in one
        monkeypatch.setattr(proofs, "PAIRS", pairs)
        found = {r.txid: bytes(r.program) for r in proofs.recovered(proofs.direct(cells), proofs.witnesses(cells)).collect() if r.program is not None}
        assert found == {"t0": p0, "t1": p1}


def test_states_out_of_model(spark):
    bad = [program(A, 7, 1, 0), program(A, 0, -1, 0), program(A, 0, 1, 5)]
    cells = frame(spark, [("K", f"t{i}", 0, p, None, None) for i, p in enumerate(bad)])
    assert [r.why for r in proofs.judged(proofs.direct(cells)).orderBy("txid").collect()] == ["unknown identifier type 7 on t0:0", "amount out of range on t1:0", "non-boolean minter on t2:0"]


def launched(spark, mints=5, bare=False):
    """A genesis and mints of 199,469,400 each, from raw scripts."""
    minter = program(A, 0, 0, 1)
    rows = [("K", f"t{i}", 0, locked(minter), *((f"t{i + 1}", witness(A + bytes([i + 11]) * 32, S.state_int(0) + S.state_int(199_469_400), minter)) if i < mints else (None, None))) for i in range(mints + 1)]
    rows += [("K", f"t{i}", 1, locked(program(bytes([i + 10]) * 32, 0, 199_469_400, 0)), None, None) for i in range(1, mints + 1)]
    events = [("K", f"t{i}", i, "genesis" if i == 0 else "transition") for i in range(mints + 1)] + ([("K", "t99", mints + 1, "transition")] if bare else [])
    return frame(spark, rows), spark.createDataFrame(events, "token_id string, txid string, seq bigint, kind string")


def test_worked_example_from_scripts_to_supply(spark):
    cells, events = launched(spark)
    whole = spark.createDataFrame([("K", True)], "token_id string, lineage_complete boolean")
    out = proofs.derived(cells, proofs.witnesses(cells), events, whole)
    row = out["accounts"].first()
    assert (row.status, row.supply, row.minted, row.burned, row.holders, row.held_wallet, row.unresolved) == ("verified", 997_347_000, 997_347_000, 0, 6, 997_347_000, 0)
    assert [r.kind for r in out["events"].orderBy("seq").collect()] == ["genesis"] + ["mint"] * 5 and out["deltas"].count() == 11
    part = spark.createDataFrame([("K", False)], "token_id string, lineage_complete boolean")
    row = proofs.derived(cells, proofs.witnesses(cells), events, part)["accounts"].first()
    assert (row.status, row.supply) == ("unvalidated", None) and row.reason.startswith("incomplete lineage")


def test_event_without_cells_leaves_a_token_unvalidated(spark):
    cells, events = launched(spark, 1, bare=True)
    whole = spark.createDataFrame([("K", True)], "token_id string, lineage_complete boolean")
    out = proofs.derived(cells, proofs.witnesses(cells), events, whole)
    row = out["accounts"].first()
    assert (row.status, row.reason, row.supply) == ("unvalidated", "no state cells recorded", None)
    assert [(r.kind, r.amount) for r in out["deltas"].where("seq = 2").collect()] == [("unknown", None)]
    fewer = events.where("txid <> 't99' and txid <> 't1'")
    row = proofs.derived(cells, proofs.witnesses(cells), fewer, whole)["accounts"].first()
    assert (row.status, row.reason) == ("unvalidated", "no event row despite state cells")


def test_token_without_events_of_its_own(spark):
    states = spark.createDataFrame([("K", "t0", 0, "out", 0, "00" + A.hex(), 5, False, True)], "token_id string, txid string, seq bigint, side string, idx int, owner string, amount bigint, minter boolean, proven boolean")
    events = spark.createDataFrame([("K", "t0", 0), ("K", "t1", 1), ("L", "t1", 0)], "token_id string, txid string, seq bigint")
    rows = {(r.token_id, r.seq): (r.kind, r.doubt) for r in T.classified(states, events.where("seq = 0").select("token_id", "txid"), events).collect()}
    assert rows == {("K", 0): ("genesis", None), ("K", 1): ("unknown", "no state cells recorded"), ("L", 0): ("unknown", "no state cells recorded")}


def le(n, size=8):
    return n.to_bytes(size, "little")


def pool(creator, other=None, kas=5, tail=b"\xac"):
    state = b"\x6b" + b"\x08" + le(kas) + b"\x08" + le(9) + b"\x20" + B + b"\x08" + le(3) + b"\x20" + C
    return state + b"\x20" + creator + b"\x75\x02\x10\x27\x20" + (other or creator) + tail


def order(price=5, again=None, maker=A, size=7, expiry=90, op=b"\x76"):
    return b"\x08" + le(price) + b"\x75" + b"\x08" + le(price if again is None else again) + op + b"\x20" + maker + b"\x02" + le(expiry, 2) + b"\x20" + B + b"\x01" + bytes([size])


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_pools_and_orders(spark):
    one = lambda *rows: spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "id string, program binary")
    pins = spark.createDataFrame([("pool", 1, bytearray(pool(A)[P.POOL_STATE :]), [0, 2])], P.POOL_PINS)
    tried = [("good", pool(D)), ("two creators", pool(D, A)), ("other tail", pool(D, tail=b"\xad")), ("negative", pool(D, kas=1 << 63)), ("short", pool(D)[:90]), ("mark", b"\x6c" + pool(D)[1:])]
    found = P.pools(one(*tried), pins)
    assert ids(found) == ["good"]
    r = found.first()
    assert (r.skeleton, bytes(r.creator_key), bytes(r.token_id), r.kas_reserve_units, r.token_reserve, r.shares, bytes(r.lp_token_id)) == ("pool", D, B, 5, 9, 3, C)
    pins = spark.createDataFrame([("order", 1, bytearray(order()), [0, 1, 2, 3, 4, 5], [0, 1], [3], [2], [4], 5)], P.ORDER_PINS)
    tried = [("good", order(11, maker=D)), ("two prices", order(11, 12)), ("free", order(0)), ("no size", order(size=0)), ("operation", order(op=b"\x77")), ("wider", order(size=7) + b"\x01\x01")]
    found = P.orders(one(*tried), pins)
    assert ids(found) == ["good"] and (found.first().price_units, found.first().size_units, found.first().expiry_daa, bytes(found.first().maker_key)) == (11, 7, 90, D)


def test_gaps_must_match_each_by_itself(spark):
    """The same bytes around the pushes, dealt out otherwise, are another build."""
    a, b = b"\x75\x01\x05\x76\x77\x01\x06", b"\x75\x76\x01\x05\x77\x01\x06"
    pins = spark.createDataFrame([("p", 1, bytearray(a), [0, 1])], P.POOL_PINS)
    rows = spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b))], "id string, body binary")
    assert ids(P._lockstep(rows, pins)) == ["a"]


def test_newest_program_of_a_covenant(spark):
    p, q = b"\x51\x75", b"\x52\x75"
    rows = [("c", f"t{i}", 0, i, locked(p if i < 5 else q), witness(p if i < 5 else q) if i < 6 else witness(b"no")) for i in range(10)]
    rows += [("d", f"u{i}", 0, i, locked(p), witness(p) if i == 0 else witness(b"no")) for i in range(9)]
    cells = spark.createDataFrame([(*r[:4], *map(bytearray, r[4:])) for r in rows], "covenant_id string, txid string, output_index int, created_daa bigint, spk_script binary, spent_sig binary")
    assert {r.covenant_id: bytes(r.program) for r in P.recovered_programs(cells).collect()} == {"c": q}  # d's is the ninth


def test_candidates_for_the_virtual_reserve(spark):
    build = lambda v, w, tail=b"\x75": b"\x08" + le(v) + b"\x76\x08" + le(w) + tail
    rows = [("a", build(5, 1 << 50)), ("b", build(6, 7)), ("c", build(9, 9, b"\x77"))]
    found = P.v_candidates(spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "id string, program binary"))
    assert sorted((r.market_covenant_id, r.place, r.v) for r in found.collect()) == [("a", -1, 0), ("a", 0, 5_000_000), ("b", -1, 0), ("b", 0, 6_000_000), ("c", -1, 0)]


PRE, SUF = b"\x6b", b"\x75"
LOCKED = "covenant_id string, txid string, output_index int, created_daa bigint, spk_script binary, spent_txid string, spent_sig binary"
PLAN = "token_id string, lock_id string, creator binary, total bigint, start_score bigint, duration_score bigint, genesis_txid string, genesis_index int"


def vest(claimed, total=100, creator=A):
    return PRE + b"\x20" + creator + b"".join(b"\x08" + le(x) for x in (total, 10, 50, claimed)) + SUF


def test_vesting_chain(spark):
    def walk(cells, plan=("K", "L", A, 100, 10, 50, "t0", 0)):
        c = spark.createDataFrame([(*r[:4], bytearray(r[4]), r[5], None if r[6] is None else bytearray(r[6])) for r in cells], LOCKED)
        s = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in plan)], PLAN)
        rows = locks.states(s, c, PRE, SUF)
        return [(r.txid, r.claimed, r.claimed_delta, r.live, r.proof) for r in rows.orderBy("created_daa").collect()], rows

    start = ("L", "t0", 0, 1, locked(vest(0)), "t1", witness(b"\x1e", b"\x63"))
    middle = ("L", "t1", 0, 2, locked(vest(30)), "t2", witness(vest(30)))
    end = ("L", "t2", 0, 3, locked(vest(100)), None, None)
    got, rows = walk([start, middle, end, ("L", "t1", 1, 2, locked(b"\x51"), None, None)])
    assert got == [("t0", 0, 0, False, "genesis"), ("t1", 30, 30, False, "continuation_witness")]  # t2's amount is stated nowhere
    assert locks.claims(rows).count() == 1
    shown = ("L", "t2", 0, 3, locked(vest(100)), "t9", witness(vest(100)))
    assert walk([start, middle, shown])[0][-1] == ("t2", 100, 70, False, "reveal")
    two = ("L", "t1", 1, 2, locked(vest(99)), None, None)  # both 30 and 99 are in the witness: two cells could follow
    assert walk([start, middle, two])[0] == [("t0", 0, 0, False, "genesis")]
    falls = ("L", "t2", 0, 3, locked(vest(0)), None, None)
    assert len(walk([start, middle, falls])[0]) == 2
    assert walk([start], ("K", "L", A, 101, 10, 50, "t0", 0))[0] == [] and walk([start], ("K", "L", A, 100, 10, 0, "t0", 0))[0] == []


def test_vesting_state_of_a_revealed_program(spark):
    tried = {"good": vest(30), "over": vest(101), "suffix": vest(30)[:-1] + b"\x76", "mark": vest(30).replace(b"\x08" + le(50), b"\x07" + le(50)), "short": vest(30)[:-1]}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in tried.items()], "k string, p binary").select("k", locks.state(F.col("p"), PRE, SUF).alias("s")).collect()
    assert {r.k: (bytes(r.s.creator), r.s.total, r.s.claimed) for r in rows if r.s} == {"good": (A, 100, 30)}


FIELDS = {"key": "pubkey", "n": "int", "ok": "bool"}


def test_typed_states(spark):
    text = "20" + "07" * 32 + "08" + "0500000000000080" + "0101"
    value = {"key": b"\x07" * 32, "n": -5, "ok": True}
    assert typed.encode(FIELDS, value).hex() == text and typed.decode(FIELDS, bytes.fromhex(text)) == value
    bad = [text + "00", text[:-4], text[:-2] + "02", text.replace("0101", "51"), "4c" + text, text.replace("0500000000000080", "0000000000000080"), ""]
    assert [typed.decode(FIELDS, bytes.fromhex(b)) for b in bad] == [None] * len(bad)
    rows = spark.createDataFrame([(bytearray.fromhex(t),) for t in [text, *bad]] + [(None,)], "s binary").select(typed.decoder(FIELDS)("s").alias("d"))
    found = [(r.d.valid, r.d.state.n) for r in rows.collect()]
    assert found == [(True, -5)] + [(False, None)] * (len(bad) + 1)
    big = spark.createDataFrame([((bytearray(A), (1 << 62) + 1, None),), ((bytearray(A), (1 << 62) + 1, False),), (None,)], "v struct<key:binary,n:bigint,ok:boolean>").select(typed.encoder(FIELDS)("v").alias("e")).collect()
    assert big[0].e is None and big[2].e is None and typed.decode(FIELDS, bytes(big[1].e))["n"] == (1 << 62) + 1
    for kind, ok, wrong in (("byte[3]", b"abc", b"ab"), ("sig", b"s" * 65, b"s" * 64), ("string", "é", b"\xff"), ("bytes", b"x" * 300, None)):
        assert typed.decode({"f": kind}, typed.encode({"f": kind}, {"f": ok})) == {"f": ok}
        assert wrong is None or typed.decode({"f": kind}, typed.push(wrong)) is None
    assert typed.packed(FIELDS, value).hex() == "07" * 32 + "0500000000000080" + "01" and typed.packed({"s": "string"}, {"s": "a"}) is None


def test_invocations(spark):
    args, tag, body = [b"\x11", b"\1\2\3\4", b"\x01", b"\x01"], b"\x3a\x08\x8d\x13", b"\x51"
    text = bytes.fromhex("011104010203045151043a088d13")
    assert typed.invocation(text + b"\x01\x51", True) == (args, tag, body)
    assert typed.invocation(b"\x01\x51", False) == ([], None, body)
    for bad in (b"", b"\x00", b"\x4c\x01\x51", b"\x01\x05\x01\x51", b"\x75\x01\x51", b"\x05ab", b"\x01\x81\x01\x51"):
        assert typed.invocation(bad, False) is None, bad
    assert typed.invocation(b"\x03abc\x01\x51", True) is None and typed.invocation(b"\x01\x51", True) is None
    rows = [(locked(body), b"\x01\x51"), (locked(b"\x52"), b"\x01\x51"), (None, None)]
    out = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in rows], "s binary, w binary").select(typed.invocations(False)("s", "w").alias("i")).collect()
    assert [r.i and r.i.program and bytes(r.i.program) for r in out] == [body, None, None]


LIST = ([(0x63, None, None), (-1, None, "owner")], [(-1, None, "key"), (0x75, None, None), (-1, None, "key")], [(-1, None, "owner"), (0x68, None, None)])


def test_repeated_skeletons():
    def made(*groups, owner=A, last=A):
        return b"\x63" + typed.push(owner) + b"".join(typed.push(x) + b"\x75" + typed.push(y) for x, y in groups) + typed.push(last) + b"\x68"

    assert S.fits_repeated(made(), *LIST) == [("owner", -1, A)]
    assert S.fits_repeated(made((B, B), (C, C)), *LIST) == [("owner", -1, A), ("key", 0, B), ("key", 1, C)]
    assert S.fits_repeated(made((B, C)), *LIST) is None and S.fits_repeated(made(last=B), *LIST) is None and S.fits_repeated(made(), *LIST, 1) is None
    many = made(*[(bytes([i]) * 2, bytes([i]) * 2) for i in range(100)])
    assert len(S.fits_repeated(many, *LIST)) == 101 and S.fits_repeated(many[:-40], *LIST) is None and S.fits_repeated(many[:-1] + b"\x67", *LIST) is None


def test_template_digest(spark):
    a, b = program(A, 0, 5, 0), program(B, 2, 9, 1)
    rows = spark.createDataFrame([(bytearray(x),) for x in (a, b, a + b"\x00", b"\x51")], "p binary").select(S.template_digest(F.col("p")).alias("h")).collect()
    got = [r.h and bytes(r.h) for r in rows]
    assert got[0] == got[1] == S.template_hash(b"", b"\x75\xac") and got[2] not in (None, got[0]) and got[3] is None
    assert spark.range(1).select(S.opens(F.lit(bytearray(S.blake2b(b"x"))), F.lit(bytearray(b"x"))).alias("o"), S.opens(F.lit(None).cast("binary"), F.lit(bytearray(b"x"))).alias("n")).first() == (True, False)


@pytest.mark.parametrize("op", [0, 3, 5])
def test_one_broken_place_is_no_build(spark, op):
    from lineara.plans import proof_queries as PQ

    good = bytes(PQ._pin("ac"))
    at = {0: 35, 3: 45, 5: 125}[op]
    broken = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    rows = spark.createDataFrame([("good", bytearray(good)), ("broken", bytearray(broken))], "id string, program binary")
    assert ids(P.curves(rows, PQ.build_pins(spark))) == ["good"]

"""Stranded cursors, gaps, missing beginnings, versioned derivation, and the stateful models."""

import hashlib

import pytest
from pyspark.sql import functions as F

from identity import covenant_id
from lineara.operators import derivation as V, lineage as L, repair as R
from lineara.streaming import pending as P
from test_goldens import SPK, TX, VALUE, X, out, step, tx


def named(prev, index=0):
    return hashlib.sha256(f"{prev}|0|{index}:{VALUE}:0:{SPK.hex().upper()}".encode()).hexdigest()


def solid(spark, ledger):
    return L.Ledger(*(spark.createDataFrame(f.collect(), f.schema) for f in (ledger.covenants, ledger.events, ledger.cells, ledger.reorgs)))


def same(a, b):
    return all(sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect())) for x, y in ((a.covenants, b.covenants), (a.events, b.events), (a.cells, b.cells)))


def frame(spark, rows):
    return spark.createDataFrame(rows, TX)


def walk(n, first=1):
    """A coin that moves in every block."""
    rows = [tx(first, f"b{first}", first * 10, "A0", [("01", 0)], [out(X)])]
    return rows + [tx(i, f"b{i}", i * 10, f"A{i}", [("A0" if i == first + 1 else f"A{i - 1}", 0)], [out(X)]) for i in range(first + 1, first + n)]


def test_stranded_cursor(spark):
    ledger = solid(spark, L.apply(L.Ledger.empty(spark), *L.classify(frame(spark, walk(60)), L.Ledger.empty(spark), covenant_id)))
    blocks = lambda *names: spark.createDataFrame([(n,) for n in names], "block string")
    assert R.re_anchor(ledger, "b60", blocks("b60")).state == "healthy"
    lost = R.re_anchor(ledger, "b60", blocks("c1", "c2"))
    assert lost.state == "lost" and same(lost.ledger, ledger)
    near = R.re_anchor(ledger, "b60", blocks(*[f"b{i}" for i in range(1, 56)]))
    assert (near.state, near.block, near.daa) == ("anchored", "b55", 550) and near.ledger.events.agg(F.max("accepting_daa")).first()[0] == 550
    # The fork lies below all of the newest blocks: the spread samples find the newest of theirs on the chain.
    far = R.re_anchor(ledger, "b60", blocks(*[f"b{i}" for i in range(1, 31)]))
    assert far.state == "anchored" and 240 <= far.daa <= 300
    assert far.ledger.events.count() == far.daa // 10 and far.ledger.cells.where("spent_block is null").count() == 1
    assert [r.rolled_back for r in far.ledger.reorgs.collect()] == [60 - far.daa // 10]
    assert R.anchors(ledger.events).count() <= R.RECENT + R.SPREAD


def test_gap_with_a_genesis_inside(spark, tmp_path):
    """Y is born in the gap and moves after it; Z is born and burnt in it; a cell of Y is spent after it without the follower knowing."""
    y, z = named("02", 1), named("03")
    two = (VALUE, 0, SPK, (y, 1))
    before = [tx(1, "b1", 100, "A0", [("01", 0)], [out(X)])]
    hole = [tx(2, "b2", 200, "C0", [("A0", 0), ("02", 0)], [out(X), two]), tx(3, "b3", 300, "D0", [("03", 0)], [out(z)]), tx(4, "b4", 400, "D1", [("D0", 0)], [])]
    after = [tx(8, "b8", 800, "E0", [("C0", 1)], [(VALUE, 0, SPK, (y, 0))]), tx(9, "b9", 900, "F0", [("C0", 0)], [])]
    ledger = step(spark, step(spark, L.Ledger.empty(spark), before), after[:1])  # the follower missed the gap: Y looks truncated
    assert ledger.covenants.where(F.col("covenant_id") == y).first().lineage_complete is False
    txs = frame(spark, before + hole + after)
    done = solid(spark, R.recover_gap(ledger, txs, 150, 450, 1000, covenant_id))
    seen = {c: [(r.kind, r.accepting_daa) for r in done.events.where(F.col("covenant_id") == c).orderBy("seq").collect()] for c in (X, y, z)}
    assert seen[X] == [("genesis", 100), ("transition", 200), ("burn", 900)]
    assert seen[z] == [("genesis", 300), ("burn", 400)]
    assert seen[y] == [("genesis", 200), ("transition", 800)]
    rows = {r.covenant_id: (r.genesis_daa, r.lineage_complete, r.event_count) for r in done.covenants.collect()}
    assert rows == {X: (100, True, 3), y: (200, True, 2), z: (300, True, 2)}
    assert [r.txid for r in done.cells.where("spent_block is null").collect()] == ["E0"]
    assert same(R.recover_gap(done, txs, 150, 450, 1000, covenant_id), done)
    meta = "file://" + str(tmp_path / "meta")
    assert R.pending_gap(spark, meta) is None
    got, did = R.recover_once(spark, meta, ledger, txs, 150, 450, 1000, covenant_id)
    assert did and same(got, done) and R.pending_gap(spark, meta) == (150, 450)
    R.gap_done(spark, meta, 150, 450)
    assert R.pending_gap(spark, meta) is None and R.recover_once(spark, meta, ledger, txs, 200, 400, 1000, covenant_id)[1] is False


def test_missing_beginnings(spark):
    rows = walk(6)
    ledger = step(spark, L.Ledger.empty(spark), rows[3:])
    assert [r.kind for r in ledger.events.orderBy("seq").collect()] == ["transition"] * 3
    txs = frame(spark, rows)
    assert [(r.hop, r.txid) for r in R.backward_chains(ledger, txs).orderBy("hop").collect()] == [(1, "A3"), (2, "A2"), (3, "A0")]
    once = solid(spark, R.with_beginnings(ledger, txs, covenant_id))
    assert [(r.seq, r.kind, r.txid) for r in once.events.orderBy("seq").collect()] == [(0, "genesis", "A0"), (1, "transition", "A2"), (2, "transition", "A3"), (3, "transition", "A4"), (4, "transition", "A5"), (5, "transition", "A6")]
    row = once.covenants.first()
    assert (row.genesis_txid, row.genesis_daa, row.lineage_complete, row.event_count) == ("A0", 10, True, 6)
    assert {r.txid: r.spent_txid for r in once.cells.collect()} == {"A0": "A2", "A2": "A3", "A3": "A4", "A4": "A5", "A5": "A6", "A6": None}
    assert same(R.with_beginnings(once, txs, covenant_id), once)
    assert same(R.with_beginnings(ledger, frame(spark, rows[1:]), covenant_id), ledger)  # the root isn't landed: nothing is proven
    assert [(r.genesis_txid, r.ok) for r in R.audited(once, txs, covenant_id).collect()] == [("A0", True)]
    assert [r.ok for r in R.audited(once, frame(spark, rows[1:]), covenant_id).collect()] == [None]


def test_positions_are_filled_once(spark):
    events = spark.createDataFrame([("b", "t1", None), ("b", "t2", 7), ("b", "t9", None)], "accepting_block string, txid string, tx_index int")
    steps = spark.createDataFrame([("b", ["t0", "t1", "t2"])], "accepting_block string, accepted_tx_ids array<string>")
    assert [tuple(r) for r in R.positions(events, steps).orderBy("txid").collect()] == [("b", "t1", 1), ("b", "t2", 7), ("b", "t9", None)]


def test_versioned_derivation(spark, tmp_path):
    path, calls = "file://" + str(tmp_path), []

    def tables(*rows):
        def compute():
            calls.append(rows)
            return {"accounts": spark.createDataFrame(list(rows), "token_id string, status string")}

        return compute

    def broken():
        raise RuntimeError("no input")

    one, two = V.stamp(rules=1, input=7), V.stamp(input=7, rules=2)
    assert one == "input=7/rules=1"
    assert V.derive_if_stale(spark, path, one, tables(("a", "verified"), ("b", "invalid"))) and not V.derive_if_stale(spark, path, one, tables())
    assert len(calls) == 1
    with pytest.raises(RuntimeError):
        V.derive_if_stale(spark, path, two, broken)
    assert V.read(spark, path, "accounts").count() == 2 and V.current(spark, path)["stamp"] == one
    V.begin(spark, path, "full", two)  # a run that dies
    assert V.derive_if_stale(spark, path, two, tables(("a", "invalid"), ("c", "verified")))
    rows = V.log(spark, path).orderBy("run").collect()
    assert [(r.run, r.state, r.added, r.removed, r.changed) for r in rows] == [(1, "ok", 2, 0, 0), (2, "failed", None, None, None), (3, "interrupted", None, None, None), (4, "ok", 1, 1, 1)]
    assert rows[1].message == "no input" and (rows[3].verified, rows[3].invalid) == (1, 1) and {r.token_id for r in V.read(spark, path, "accounts").collect()} == {"a", "c"}


def test_restamp_touches_generic_stamps_only(spark):
    cells = spark.createDataFrame([("a", 0, "p2sh", "1"), ("b", 0, "lock", "1"), ("c", 0, "p2sh", "2"), ("d", 0, "p2sh", "1"), ("e", 0, None, None)], "txid string, output_index int, revealed_template string, stamp_version string")
    found = spark.createDataFrame([(x, 0) for x in "abce"], "txid string, output_index int")
    got = {r.txid: (r.revealed_template, r.stamp_version) for r in V.restamped(cells, ("p2sh",), "2", "token", found).collect()}
    assert got == {"a": ("token", "2"), "b": ("lock", "1"), "c": ("p2sh", "2"), "d": (None, "2"), "e": ("token", "2")}


def stream(spark, rows, schema, path, n, model):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/n={n}")
    source = spark.readStream.schema(schema).parquet(f"{path}/in/*")
    q = model(source).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(once=True).start()
    q.awaitTermination(120)


def test_pending_model_over_restarts(spark, tmp_path):
    path = "file://" + str(tmp_path)
    short = lambda rows: P.pending_model(rows, 1, 1, 3_600_000)
    stream(spark, [("a", "pending", "c1", "genesis", None, 1), ("a", "pending", "c2", None, None, 2), ("b", "resolve", None, None, "dropped", 3)], P.NEWS, path, 1, short)
    stream(spark, [("a", "resolve", None, None, "confirmed", 4), ("a", "pending", "c9", None, None, 2), ("b", "pending", "c3", None, None, 2)], P.NEWS, path, 2, short)
    stream(spark, [("x", "pending", "c1", None, None, 5)], P.NEWS, path, 3, short)  # another batch: the timer of a is over
    stream(spark, [("b", "pending", "c3", None, None, 6), ("a", "pending", "c1", None, None, 3)], P.NEWS, path, 4, short)
    rows = sorted((r.txid, r.version, r.state, r.covenants, r.resolution, r.generation) for r in spark.read.schema(P.VIEW).parquet(f"{path}/out").collect())
    assert [r for r in rows if r[0] == "a"] == [("a", 1, "pending", "c1", None, 1), ("a", 2, "pending", "c1,c2", None, 1), ("a", 4, "gone", "", "confirmed", 1), ("a", 4, "resolved", "c1,c2", "confirmed", 1)]
    assert [r for r in rows if r[0] == "b"] == [("b", 3, "tombstone", "", "dropped", 0), ("b", 6, "pending", "c3", None, 1)]


def test_adoption_takes_two_equal_checks(spark, tmp_path):
    path = "file://" + str(tmp_path)
    at = lambda i, sha, outcome="image", replaced=False, key="k": (key, i, outcome, sha, replaced)
    parts = [[at(1, "s1"), at(2, "s2"), at(1, None, "failed", key="n")], [at(3, "s1"), at(4, "s2"), at(5, "s3"), at(6, "s2")], [at(7, "s2"), at(8, None, "failed"), at(9, "s4", replaced=True), at(2, None, "not_an_image", key="n")]]
    for n, rows in enumerate(parts):
        stream(spark, rows, P.CHECKS, path, n, P.witness)
    got = spark.read.schema(P.RECORD).parquet(f"{path}/out")
    rows = [(r.at_ms, r.observed, r.pending, r.change_count, r.was, r.now) for r in got.where("covenant_id = 'k'").orderBy("at_ms").collect()]
    assert rows == [
        (1, "s1", None, 0, None, None), (2, "s1", "s2", 0, None, None), (3, "s1", None, 0, None, None), (4, "s1", "s2", 0, None, None), (5, "s1", "s3", 0, None, None), (6, "s1", "s2", 0, None, None),
        (7, "s2", None, 1, "s1", "s2"), (8, "s2", None, 1, None, None), (9, "s4", None, 2, "s2", "s4"),
    ]
    assert [(r.state, r.fail_count, r.next_check_ms) for r in got.where("covenant_id = 'n'").orderBy("at_ms").collect()] == [("unavailable", 1, 1 + P.BACKOFF_MS), ("not_an_image", 2, 2 + 2 * P.BACKOFF_MS)]
    whole = P.witnessed(spark.createDataFrame([r for p in parts for r in p], P.CHECKS))
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.select(*whole.columns).collect()))
    assert [(r.at_ms, r.now) for r in P.change_log(whole, 1).collect()] == [(9, "s4")]

"""Following a landed chain with a reorganisation, and the stateful watches."""

import hashlib

import pytest

from identity import covenant_id
from lineara.sources import landing, snapshots
from lineara.streaming import follow, windows

VALUE, SPK = 100_000_000, b"\xaa\xbb"
X = hashlib.sha256(f"01|0|0:{VALUE}:0:{SPK.hex().upper()}".encode()).hexdigest()


def block(name, daa, txs):
    body = [(t, 1, [(p, 0, b"\x01", 7)], [(VALUE, 0, SPK, (X, 0))] if alive else [], b"") for t, p, alive in txs]
    return (name, daa, daa, daa * 100, [], [], body)


def test_follow_applies_rolls_back_and_resumes(spark, tmp_path):
    root = "file://" + str(tmp_path)
    blocks = [block("b1", 100, [("A0", "01", True)]), block("b2", 200, [("B0", "A0", True)]), block("b3", 300, [("D0", "B0", False)]), block("b5", 310, [("D0", "B0", False)])]
    spark.createDataFrame(blocks, landing.BLOCK).write.parquet(f"{root}/blocks")
    n = 0

    def drop(*steps):
        nonlocal n
        n += 1
        spark.createDataFrame(list(steps), landing.STEP).coalesce(1).write.parquet(f"{root}/steps/s={n}")

    def run():
        q = follow.follow(spark, f"{root}/steps/*", f"{root}/blocks", f"{root}/ledger", f"{root}/ckpt", covenant_id, once=True)
        q.awaitTermination()
        return follow.load(spark, f"{root}/ledger")[0]

    drop((1, [], [("b1", ["A0"]), ("b2", ["B0"])]), (2, [], [("b3", ["D0"])]))
    ledger = run()
    assert [r.kind for r in ledger.events.orderBy("seq").collect()] == ["genesis", "transition", "burn"]
    drop((3, ["b3"], [("b5", ["D0"])]))
    ledger = run()
    assert [(r.kind, r.accepting_block) for r in ledger.events.orderBy("seq").collect()] == [("genesis", "b1"), ("transition", "b2"), ("burn", "b5")]
    assert ledger.cells.where("spent_block is null").count() == 0 and [r.rolled_back for r in ledger.reorgs.collect()] == [1]
    # A step whose body isn't there fails and leaves the ledger as it was.
    before = follow.load(spark, f"{root}/ledger")[1]
    drop((4, [], [("b9", ["ZZ"])]))
    with pytest.raises(Exception, match="no landed body"):
        run()
    assert follow.load(spark, f"{root}/ledger")[1] == before
    # The same batch again changes nothing.
    again = follow.load(spark, f"{root}/ledger")[0]
    assert again.events.count() == 3 and len(snapshots.versions(spark, f"{root}/ledger/events")) == 2


def test_a_batch_writes_the_buckets_of_its_covenants_only(spark, tmp_path):
    path = "file://" + str(tmp_path)
    ids = [hashlib.sha256(f"{i}|0|0:{VALUE}:0:{SPK.hex().upper()}".encode()).hexdigest() for i in range(40)]
    born = [(f"T{i}", 1, [(str(i), 0, b"", 0)], [(VALUE, 0, SPK, (c, 0))], b"") for i, c in enumerate(ids)]
    blocks = spark.createDataFrame([("b1", 10, 10, 1, [], [], born), ("b2", 20, 20, 2, [], [], [("M0", 1, [("T0", 0, b"", 0)], [(VALUE, 0, SPK, (ids[0], 0))], b"")])], landing.BLOCK)
    steps = [(1, [], [("b1", [f"T{i}" for i in range(40)])]), (2, [], [("b2", ["M0"])]), (3, ["b2"], [])]
    for n, s in enumerate(steps):
        ledger, done = follow.load(spark, f"{path}/ledger")
        assert done == n - 1
        wrote = follow.save(*follow.advance(ledger, spark.createDataFrame([s], landing.STEP), blocks, covenant_id), f"{path}/ledger", n)
        assert len(wrote) == 1 if n else len(wrote) > 20
    ledger, done = follow.load(spark, f"{path}/ledger")
    assert done == 2 and ledger.events.count() == ledger.covenants.count() == 40 and ledger.cells.where("spent_block is not null").count() == 0
    assert {r.kind for r in ledger.events.collect()} == {"genesis"} and [r.rolled_back for r in ledger.reorgs.collect()] == [1]


def test_sightings_and_mempool(spark):
    rows = spark.createDataFrame([block("b1", 100, [("A0", "01", True), ("N0", "09", False)])], landing.BLOCK)
    assert [tuple(r) for r in landing.sightings(rows).collect()] == [("b1", "A0", 0, X, VALUE, "01", 0)]
    pool = spark.createDataFrame([("A",), (landing.ZERO_TXID,), (None,)], "txid string")
    assert [r.txid for r in landing.mempool(pool).collect()] == ["A"]
    node = spark.createDataFrame([("b", ["x"], ["y"])], "hash string, mergeset_blues array<string>, mergeset_reds array<string>")
    assert landing.from_node(node).first().mergeset == ["x", "y"]


def test_wedge_watch(spark, tmp_path):
    path = "file://" + str(tmp_path)
    stuck = [(1, i, 5, 100_000) for i in range(12)]
    fine = [(2, i, i * 10, 100_000) for i in range(12)]
    near = [(3, i, 5, 100) for i in range(12)]
    spark.createDataFrame(stuck + fine + near, "key long, ts long, done long, tip long").coalesce(1).write.parquet(f"{path}/in")
    source = spark.readStream.schema("key long, ts long, done long, tip long").parquet(f"{path}/in")
    windows.wedges(source).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{path}/out").collect()] == [(1, 10, 99_995)]

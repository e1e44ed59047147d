"""Repair of a ledger: a stranded cursor, a gap in the middle, and a beginning that was never seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..session import landed
from ..sources import snapshots
from . import feeds as D, lineage as L
from .lineage import Ledger

#: Newest blocks tried one by one, and blocks spread over the whole range.
RECENT, SPREAD = 8, 16


@dataclass
class Anchor:
    """``state``: healthy, anchored or lost; the block and score that the ledger ends at now."""

    state: str
    ledger: Ledger
    block: str | None = None
    daa: int | None = None


def anchors(events: DataFrame) -> DataFrame:
    """(turn, accepting_block, accepting_daa): where a stranded cursor may go on, densest near the tip: newest first, then spread samples
    from the tip down. At most RECENT + SPREAD rows."""
    near = D.recent_blocks(events, RECENT).select(F.struct(F.lit(0).alias("g"), (-F.col("accepting_daa")).alias("n"), F.col("accepting_block").alias("b")).alias("turn"), "accepting_block", "accepting_daa")
    far = D.spread_samples(events, SPREAD).select(F.struct(F.lit(1).alias("g"), F.col("sample").cast("long").alias("n"), F.col("accepting_block").alias("b")).alias("turn"), "accepting_block", "accepting_daa")
    return near.unionByName(far)


def re_anchor(ledger: Ledger, cursor: str, chain: DataFrame) -> Anchor:
    """The ledger at the newest of its anchors that is still on the chain (column ``block``: blocks that can be walked from).

    If the cursor itself can be walked from nothing happens. What was indexed above the anchor lived on the side that was left, and is
    rolled back like any reorganisation. If no anchor is on the chain the ledger stays as it is and the state is ``lost``.
    """
    good = chain.select(F.col("block").alias("accepting_block")).distinct()
    if not good.where(F.col("accepting_block") == cursor).isEmpty():
        return Anchor("healthy", ledger, cursor)
    row = anchors(ledger.events).where(F.col("accepting_block") != cursor).join(good, "accepting_block", "left_semi").orderBy("turn").first()
    if row is None:
        return Anchor("lost", ledger)
    above = ledger.events.where(F.col("accepting_daa") > row["accepting_daa"]).select(F.col("accepting_block").alias("block")).distinct()
    return Anchor("anchored", L.rollback(ledger, above, row["accepting_daa"]), row["accepting_block"], row["accepting_daa"])


def rescued(events: DataFrame, txs: DataFrame, ledger: Ledger, identity: L.Identity) -> DataFrame:
    """Events of a gap, with a genesis restored where the ledger's later rows hid it: the id follows from the transaction, and neither the
    ledger nor the gap has an event of the covenant at or before it."""
    proven = L.genesis_proofs(txs, identity).withColumn("_proof", F.lit(True)).hint("merge")
    known = ledger.events.groupBy("covenant_id").agg(F.min("accepting_daa").alias("_known"))
    first = events.groupBy("covenant_id").agg(F.min("ord").alias("_first"))
    rows = events.join(proven, ["ord", "covenant_id"], "left").join(known, "covenant_id", "left").join(first, "covenant_id")
    born = F.coalesce("_proof", F.lit(False)) & (F.col("_first") == F.col("ord")) & (F.col("_known").isNull() | (F.col("_known") > F.col("accepting_daa")))
    return rows.select(*[F.when(born, "genesis").otherwise(F.col("kind")).alias("kind") if c == "kind" else F.col(c) for c in events.columns])


def recover_gap(ledger: Ledger, txs: DataFrame, lo: int, hi: int, stop: int, identity: L.Identity) -> Ledger:
    """The ledger with the history between the scores ``lo`` and ``hi`` filled in from accepted transactions.

    Three regions: before ``lo`` nothing is read; inside, transactions are classified as a live follower would have done, and a genesis
    that the ledger's later rows hid is rescued; after ``hi``, up to ``stop``, only what the follower could not see is added: spends of cells
    that the gap made, which it took for nothing. Merging the same rows again changes nothing.
    """
    inside = txs.where(F.col("accepting_daa").between(lo, hi))
    after = txs.where((F.col("accepting_daa") > hi) & (F.col("accepting_daa") <= stop))
    events, created, spent = L.classify(inside, ledger, identity, landed)
    merged = L.recover(ledger, rescued(landed(events), inside, ledger, identity), created, spent, landed)
    made = merged.cells.join(created.select("txid", "output_index").distinct(), ["txid", "output_index"], "left_semi")
    late, spends = L.late_burns(after, made, landed)
    return L.recover(merged, late, created.limit(0), spends, landed)


def recover_once(spark: SparkSession, meta: str, ledger: Ledger, txs: DataFrame, lo: int, hi: int, stop: int, identity: L.Identity) -> tuple[Ledger, bool]:
    """``recover_gap`` unless the window, or one around it, is on record; (ledger, whether anything was done).

    The window is noted before the work begins: a run that dies leaves a gap that looks smaller than it was, so the next run goes on with
    the window noted (``pending_gap``).
    """
    done = [tuple(map(int, w.split("-"))) for w in (snapshots.get(spark, meta, "gaps") or "").split(",") if w]
    if any(a <= lo and hi <= b for a, b in done):
        return ledger, False
    snapshots.put(spark, meta, {"gap_pending": f"{lo}-{hi}"})
    out = recover_gap(ledger, txs, lo, hi, stop, identity)
    out = Ledger(*(x.checkpoint() for x in (out.covenants, out.events, out.cells, out.reorgs)))
    return out, True


def gap_done(spark: SparkSession, meta: str, lo: int, hi: int) -> None:
    """Put a window on record once its ledger is stored."""
    old = snapshots.get(spark, meta, "gaps") or ""
    snapshots.put(spark, meta, {"gaps": ",".join(x for x in (old, f"{lo}-{hi}") if x), "gap_pending": ""})


def pending_gap(spark: SparkSession, meta: str) -> tuple[int, int] | None:
    found = snapshots.get(spark, meta, "gap_pending")
    return tuple(map(int, found.split("-"))) if found else None


def backward_chains(ledger: Ledger, txs: DataFrame) -> DataFrame:
    """(covenant_id, hop, txid, next_txid): transactions before the first event of each covenant whose beginning is unknown, hop 1 being
    the one just before it.

    All covenants take a step back together: the first input of a transaction that spends a cell bound to the covenant names the one
    before, which is looked up once for all steps. Each step is written.
    """
    first = ledger.events.groupBy("covenant_id").agg(F.min_by("txid", "seq").alias("txid"))
    open_ = ledger.covenants.where("not lineage_complete").select("covenant_id")
    front = first.join(open_, "covenant_id", "left_semi").select("covenant_id", "txid")
    front = landed(front)
    ins = txs.select("txid", F.posexplode("inputs").alias("place", "i")).select("txid", "place", F.col("i.prev_txid").alias("before"), F.col("i.prev_index").alias("index"))
    outs = txs.select(F.col("txid").alias("before"), F.posexplode("outputs").alias("index", "o")).where("o.covenant is not null").select("before", "index", F.col("o.covenant.covenant_id").alias("covenant_id"))
    outs = outs.join(front.select("covenant_id"), "covenant_id", "left_semi")
    steps = landed(ins.hint("merge").join(outs, ["before", "index"]).groupBy("covenant_id", "txid").agg(F.min_by("before", "place").alias("before")))
    out, hop = None, 0
    while True:
        hop += 1
        back = landed(front.join(steps, ["covenant_id", "txid"]).select("covenant_id", F.lit(hop).alias("hop"), F.col("before").alias("txid"), F.col("txid").alias("next_txid")))
        if back.isEmpty():
            break
        out = back if out is None else out.unionByName(back)
        front = back.select("covenant_id", "txid")
    return out if out is not None else front.select("covenant_id", F.lit(0).alias("hop"), "txid", F.col("txid").alias("next_txid")).limit(0)


def with_beginnings(ledger: Ledger, txs: DataFrame, identity: L.Identity) -> Ledger:
    """The ledger with the missing beginnings of its covenants put before their first events, from landed transactions.

    A covenant is repaired only if the walk back ends at a transaction that proves its genesis, and every cell on the way was spent by the
    next transaction. Its events move up by the length of the beginning; what was labelled its genesis becomes a move. A covenant that is
    whole isn't touched, so a second run changes nothing.
    """
    chain = backward_chains(ledger, txs)
    length = chain.groupBy("covenant_id").agg(F.max("hop").cast("long").alias("n"))
    proven = L.genesis_proofs(txs, identity, "txid").select("covenant_id", "txid")
    root = chain.join(length, "covenant_id").where("hop = n").join(proven.hint("merge"), ["covenant_id", "txid"], "left_semi").select("covenant_id", "n")
    rows = chain.join(root, "covenant_id")
    facts = txs.select("ord", "txid", "accepting_block", "accepting_daa", "accepting_time_ms", "tx_index").hint("merge")
    made = L._created(txs).drop("accepting_block", "accepting_daa").hint("merge").join(rows, ["covenant_id", "txid"])
    spend = txs.select(F.col("txid").alias("next_txid"), F.col("accepting_block").alias("spent_block"), F.explode("inputs").alias("i"))
    spend = spend.select("next_txid", "spent_block", F.col("i.prev_txid").alias("txid"), F.col("i.prev_index").alias("output_index"), F.col("i.signature_script").alias("spent_sig"), F.col("i.compute_budget").alias("spent_budget"), F.lit(True).alias("_spent"))
    made = made.join(spend.hint("merge"), ["next_txid", "txid", "output_index"], "left").join(facts.drop("ord", "tx_index", "accepting_time_ms"), "txid")
    made = landed(made)
    unspent = made.where("_spent is null").select("covenant_id").distinct()
    rows, made = (x.join(unspent, "covenant_id", "left_anti") for x in (rows, made))
    rows = landed(rows)
    ids = rows.select("covenant_id", "n").distinct()
    prefix = rows.join(facts, "txid").select("covenant_id", (F.col("n") - F.col("hop")).alias("seq"), F.when(F.col("hop") == F.col("n"), "genesis").otherwise("transition").alias("kind"), "txid", "accepting_block", "accepting_daa", "accepting_time_ms", "tx_index", F.lit(None).cast("binary").alias("payload"))
    moved = ledger.events.join(ids, "covenant_id", "left")
    first = F.col("n").isNotNull() & (F.col("seq") == 0) & (F.col("kind") == "genesis")
    moved = moved.select(*[(F.col("seq") + F.coalesce("n", F.lit(0))).alias(c) if c == "seq" else F.when(first, "transition").otherwise(F.col(c)).alias(c) if c == "kind" else F.col(c) for c in ledger.events.columns])
    events = moved.unionByName(prefix.select(*ledger.events.columns))
    cells = made.select("txid", F.col("output_index").cast("int").alias("output_index"), "covenant_id", "value", "spk_version", "spk_script", F.col("accepting_block").alias("created_block"), F.col("accepting_daa").alias("created_daa"), "spent_block", F.col("next_txid").alias("spent_txid"), "spent_sig", "spent_budget")
    kept = ledger.cells.join(cells.select("txid", "output_index"), ["txid", "output_index"], "left_anti").select(*ledger.cells.columns)
    return Ledger(L._refreshed(ledger.covenants, events, ids), events, kept.unionByName(cells.select(*ledger.cells.columns)), ledger.reorgs)


def audited(ledger: Ledger, txs: DataFrame, identity: L.Identity) -> DataFrame:
    """(covenant_id, genesis_txid, ok): whether each stored genesis proves its covenant; null where its transaction isn't landed."""
    proven = L.genesis_proofs(txs, identity).join(txs.select("ord", F.col("txid").alias("genesis_txid")), "ord").select("covenant_id", "genesis_txid", F.lit(True).alias("_ok"))
    landed = txs.select(F.col("txid").alias("genesis_txid"), F.lit(True).alias("_landed")).distinct()
    rows = ledger.covenants.where("genesis_txid is not null").select("covenant_id", "genesis_txid")
    rows = rows.join(proven, ["covenant_id", "genesis_txid"], "left").join(landed, "genesis_txid", "left")
    return rows.select("covenant_id", "genesis_txid", F.when(F.col("_landed"), F.coalesce("_ok", F.lit(False))).alias("ok"))


def positions(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events with the places that they lack: the position of their transaction in the accepting block's list (accepting_block,
    accepted_tx_ids). Places that are there stay, so a second run does nothing."""
    at = steps.select("accepting_block", F.posexplode("accepted_tx_ids").alias("_at", "txid"))
    at = at.withColumn("_n", F.row_number().over(W.partitionBy("accepting_block", "txid").orderBy("_at"))).where("_n = 1").drop("_n")
    rows = events.join(at, ["accepting_block", "txid"], "left")
    return rows.select(*[F.coalesce("tx_index", F.col("_at").cast("int")).alias(c) if c == "tx_index" else F.col(c) for c in events.columns])

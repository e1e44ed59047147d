"""Proof of token states from raw cells: what a script or a spend shows, and what witnesses of the creating transaction recover.

``cells``: token_id, txid, output_index, spk_script, spent_txid, spent_sig; extra columns stay. ``spends``: (txid, sig), the witnesses
of all inputs of transactions, whatever coin they spend. A hash-committed cell is proven only by a program whose digest is the one
committed to, so a wrong guess costs a digest and never proves anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import exact as E, owners as O, scripts as S
from ..session import landed, shared_dir
from . import tokens as T

KEY = ["token_id", "txid", "output_index"]
#: Owner types and minter bytes that a state may have.
KINDS, MINTERS = range(4), range(2)
#: Pairs of an owner and an amount of one cell beyond which its owners are dealt over the tasks; all pairs are tried either way.
PAIRS = 4096
STATE_BYTES = 46
Digest = Callable[[Column], Column]
#: The id of a transaction from the key that cells hold for it.
Name = Callable[[Column], Column]


def _as_is(txid: Column) -> Column:
    return txid


def witnesses(cells: DataFrame) -> DataFrame:
    """(txid, sig) of all spends of a table of cells; a witness that is there twice is tried twice, which changes nothing."""
    return cells.where("spent_txid is not null and spent_sig is not null").select(F.col("spent_txid").alias("txid"), F.col("spent_sig").alias("sig"))


def direct(cells: DataFrame, digest: Digest = S.h32) -> DataFrame:
    """Cells with ``program`` (null if unproven) and ``unproven`` (why a proof failed, with {} for the outpoint; null for live cells, which may be recovered).

    A script that holds a token state is its own proof; a spent cell's program is its witness's last push, if it has the committed
    digest and holds a state.
    """
    script = F.col("spk_script")
    rows = cells.withColumn("_last", S.pushed("spent_sig")["last"])
    rows = rows.withColumn("_shown", F.coalesce(O.script_hash(script) == digest(F.col("_last")), F.lit(False)))
    bare, stated = S.state_block(script).isNotNull(), F.col("_shown") & S.state_block(F.col("_last")).isNotNull()
    program = F.when(bare, script).when(F.col("spent_txid").isNotNull() & stated, F.col("_last"))
    why = (
        F.when(program.isNotNull() | F.col("spent_txid").isNull(), None).when(F.col("spent_sig").isNull(), "reveal missing for spent output {}")
        .when(~F.col("_shown"), "spend of {} does not reveal its committed program").otherwise("reveal of {} is not a recognised build")
    )
    return rows.select(*cells.columns, program.alias("program"), why.alias("unproven"))


def _bases(proven: DataFrame) -> DataFrame:
    """(token_id, txid, head, tail): programs without their states, for each transaction ``at`` which a proven cell was made or spent.

    Programs of one build are one base, however many states they had.
    """
    program = F.col("program")
    start = S.state_block(program)
    cut = proven.where(start.isNotNull()).select("token_id", "at", F.substring(program, F.lit(1), start).alias("head"), F.substring(program, start + STATE_BYTES + 1, F.length(program)).alias("tail"))
    return cut.select("token_id", F.explode("at").alias("txid"), "head", "tail").where("txid is not null").distinct()


def _arguments(cells: DataFrame, spends: DataFrame) -> DataFrame:
    """For each unproven cell and each witness of its transaction: the owners and amounts that the witness may state for it.

    A witness gives the values of all n outputs in one push (n times 32 or 8 bytes), or a push for each value; short amounts are filled
    with zeros on the right.
    """
    made = W.partitionBy("token_id", "txid")  # the outputs of one transaction
    # Cells and witnesses are dealt by transaction, once, as hashes and as they are; values are read where they meet.
    dealt = cells.select(*KEY, "spent_txid", F.when(F.col("program").isNull(), O.script_hash(F.col("spk_script"))).alias("want")).repartition("txid")
    todo = dealt.withColumn("_k", F.row_number().over(made.orderBy("output_index")) - 1).withColumn("_n", F.count(F.lit(1)).over(made)).where("want is not null")
    said = spends.repartition("txid").select("txid", S.pushed("sig")["values"].alias("v")).hint("merge")
    k, n, v = F.col("_k"), F.col("_n"), F.col("v")

    def values(width: int, flat: Callable[[Column], Column], filled: Callable[[Column], Column]) -> Column:
        whole = F.transform(F.filter(v, lambda x: F.length(x) == n * width), lambda x: F.substring(x, k * width + 1, F.lit(width)))
        # By their digits, as bytes would be compared pair by pair.
        return F.transform(F.array_distinct(F.transform(F.concat(whole, F.transform(F.filter(v, flat), filled)), F.hex)), F.unhex)

    rows = todo.join(said, "txid")
    zeros = F.lit(bytearray(8))
    owners = values(32, lambda x: F.length(x) == 32, lambda x: x)
    amounts = values(8, lambda x: F.length(x) <= 8, lambda x: F.substring(F.concat(x, zeros), 1, 8))
    return rows.select(*KEY, "spent_txid", "want", owners.alias("owners"), amounts.alias("amounts")).where((F.size("owners") > 0) & (F.size("amounts") > 0))


def recovered(cells: DataFrame, spends: DataFrame, digest: Digest = S.h32) -> DataFrame:
    """Cells with the programs that witnesses of their transactions prove, to a fixpoint.

    A candidate is a build known at the transaction (of a cell that it spends, or of another that it makes) with an owner, an amount, a
    type and a minter byte; all values that a witness states are tried. A round tries only bases that came up in the round before, and the loop ends when nothing new is proven;
    each round is written, as the next builds on it.
    """
    work = landed(_arguments(cells, spends))
    frontier = landed(_bases(cells.where("program is not null").withColumn("at", F.array("txid", "spent_txid"))))
    seen, got = frontier, None
    states = F.array(*[F.lit(bytearray([kind, minter])) for kind in KINDS for minter in MINTERS])
    byte = lambda b: F.lit(bytearray([b]))
    while not frontier.isEmpty():
        many = F.size("owners").cast("long") * F.size("amounts") > PAIRS
        one = lambda rows: rows.join(frontier, ["token_id", "txid"]).select(*KEY, "spent_txid", "want", "head", "tail", "amounts", F.explode("owners").alias("owner"))
        tries = one(work.where(~many)).unionByName(one(work.where(many)).repartition(*KEY, "owner"))
        tries = tries.select(*KEY, "spent_txid", "want", "head", "tail", "owner", F.explode("amounts").alias("amount")).withColumn("s", F.explode(states))
        state = F.concat(byte(0x20), F.col("owner"), byte(1), F.substring("s", 1, 1), byte(8), F.col("amount"), byte(1), F.substring("s", 2, 1))
        tries = tries.select(*KEY, "spent_txid", "want", F.concat("head", state, "tail").alias("program"))
        found = tries.where(digest(F.col("program")) == F.col("want")).groupBy(*KEY).agg(F.min("program").alias("program"), F.collect_set("spent_txid").alias("spent"))
        found = landed(found)
        if found.isEmpty():
            break
        got = found if got is None else got.unionByName(found)
        frontier = landed(_bases(found.withColumn("at", F.concat(F.array("txid"), "spent"))).join(seen, ["token_id", "txid", "head", "tail"], "left_anti"))
        seen = seen.unionByName(frontier)
    if got is None:
        return cells
    # A cell may be found again by a base that came later; its program is the same.
    rows = cells.join(got.groupBy(*KEY).agg(F.min("program").alias("_program")), KEY, "left")
    proven = F.coalesce("program", "_program")
    return rows.select(*[proven.alias(c) if c == "program" else F.when(proven.isNull(), F.col("unproven")).alias(c) if c == "unproven" else F.col(c) for c in cells.columns])


def judged(cells: DataFrame, name: Name = _as_is) -> DataFrame:
    """Cells with their states: owner, amount, minter, proven and, where it isn't, why, with the outpoint's transaction by ``name``."""
    point = F.col("_point")
    rows = cells.withColumns({"_s": S.token_state(F.col("program")), "_point": O.outpoint(name(F.col("txid")), F.col("output_index"))}).withColumn("_amount", E.little_endian(F.col("_s.amount")))
    out = T.judged_reason(F.col("_s.kind"), F.col("_amount"), F.col("_s.minter"))
    live = F.col("spent_txid").isNull()
    unknown = F.when(live, F.concat(F.lit("live state unproven for "), point)).otherwise(F.concat(F.lit("state unproven for spent output "), point))
    why = F.when(F.col("program").isNull(), F.coalesce(F.replace("unproven", F.lit("{}"), point), unknown)).otherwise(F.concat(out, F.lit(" on "), point))
    rows, why = rows.withColumn("_why", why), F.col("_why")  # a column, as four others ask for it
    ok = F.col("program").isNotNull() & why.isNull()
    return rows.select(*cells.columns, F.when(ok, F.col("_s.owner")).alias("owner"), F.when(ok, F.col("_amount")).alias("amount"), F.when(ok, F.col("_s.minter") == 1).alias("minter"), ok.alias("proven"), why.alias("why"))


def states(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Rows as ``tokens.classified`` takes them: each judged cell on the side of the transaction that made it and of the one that spent it.

    ``events``: (token_id, txid, seq). A transaction without an event has a null seq.
    """
    what = ["owner", "amount", "minter", "proven", "why"]
    out = cells.select("token_id", "txid", F.lit("out").alias("side"), F.col("output_index").alias("idx"), *what)
    spent = cells.where("spent_txid is not null").select("token_id", F.col("spent_txid").alias("txid"), F.lit("in").alias("side"), F.col("output_index").alias("idx"), *what)
    return out.unionByName(spent).join(events.select("token_id", "txid", "seq"), ["token_id", "txid"], "left")


def derived(cells: DataFrame, spends: DataFrame, events: DataFrame, covenants: DataFrame, digest: Digest = S.h32) -> dict[str, DataFrame]:
    """From raw cells to figures: ``cells`` with their states, ``events`` classified, ``deltas`` and ``accounts``.

    ``events``: (token_id, txid, seq, kind) of the ledger; ``covenants``: (token_id, lineage_complete). A token whose lineage is
    incomplete or unknown can't be verified, whatever its cells say.
    """
    shared_dir(cells.sparkSession)
    known = judged(recovered(direct(cells, digest).checkpoint(), spends, digest)).checkpoint()
    rows = states(known, events)
    made = T.classified(rows, events.where("kind = 'genesis'").select("token_id", "txid"), events.select("token_id", "txid", "seq")).checkpoint()
    live = known.where("spent_txid is null").select("token_id", "owner", "amount", "proven")
    gate = covenants.select("token_id", F.col("lineage_complete").alias("_whole"))
    account = T.accounts(made, live).join(gate, "token_id", "left")
    bad = ~F.coalesce("_whole", F.lit(False)) & (F.col("status") != "invalid")
    reason = F.when(F.col("_whole").isNull(), "covenant row missing").otherwise("incomplete lineage: the covenant's history began out of sight")
    figures = ("supply", "minted", "burned", "held_covenant", "held_wallet", "held_script")
    cols = [F.when(~bad, F.col(c)).alias(c) if c in figures else F.col(c) for c in account.columns if c not in ("_whole", "status", "reason")]
    account = account.select(*cols, F.when(bad, "unvalidated").otherwise(F.col("status")).alias("status"), F.when(bad, reason).otherwise(F.col("reason")).alias("reason"))
    return {"cells": known, "events": made, "deltas": T.deltas(rows, made), "accounts": account}

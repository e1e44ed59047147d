"""Vesting locks: a schedule counts only if it reproduces the commitment of its first cell, and each later state is proven from the
witness that made it or from its own reveal.

``schedules``: token_id, lock_id, creator (32 bytes), total, start_score, duration_score, genesis_txid, genesis_index.
``cells``: covenant_id, txid, output_index, created_daa, spk_script, spent_txid, spent_sig. A lock's program is a fixed prefix, a state
of 69 bytes and a fixed suffix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact as E, owners as O, scripts as S
from ..session import landed, shared_dir

STATE = 69
_PLAN = ["token_id", "lock_id", "creator", "total", "start_score", "duration_score"]
Digest = Callable[[Column], Column]


def program(prefix: bytes, suffix: bytes, creator: Column, *numbers: Column) -> Column:
    """The program of a state: creator, total, start, duration, claimed."""
    byte = lambda b: F.lit(bytearray(b))
    parts = [x for n in numbers for x in (byte([8]), S.le8(n))]
    return F.concat(byte(prefix), byte([0x20]), creator, *parts, byte(suffix))


def state(text: Column, prefix: bytes, suffix: bytes) -> Column:
    """creator, total, start_score, duration_score and claimed of a revealed program of exactly this template; else null."""
    cut = lambda a, n: F.substring(text, len(prefix) + a + 1, n)
    h = F.hex(text)
    mark = lambda a: F.substring(h, 2 * (len(prefix) + a) + 1, 2)
    numbers = {n: E.little_endian(cut(34 + 9 * i, 8)) for i, n in enumerate(("total", "start_score", "duration_score", "claimed"))}
    shaped = (
        (F.length(text) == len(prefix) + STATE + len(suffix)) & (F.substring(h, 1, 2 * len(prefix)) == prefix.hex().upper()) & (F.substring(h, 2 * (len(prefix) + STATE) + 1, 2 * len(suffix)) == suffix.hex().upper())
        & (mark(0) == "20") & (F.concat(*[mark(33 + 9 * i) for i in range(4)]) == "08080808") & (numbers["claimed"] <= numbers["total"]) & (numbers["duration_score"] > 0)
    )
    return F.when(shaped, F.struct(cut(1, 32).alias("creator"), *[v.alias(n) for n, v in numbers.items()]))


def proven(schedules: DataFrame, cells: DataFrame, prefix: bytes, suffix: bytes, digest: Digest = S.h32) -> DataFrame:
    """Schedules whose first cell commits to them with nothing claimed; false says that this candidate isn't proven, no more."""
    at = cells.select(F.col("covenant_id").alias("lock_id"), F.col("txid").alias("genesis_txid"), F.col("output_index").alias("genesis_index"), O.script_hash(F.col("spk_script")).alias("_want"))
    rows = schedules.where("duration_score > 0").join(at, ["lock_id", "genesis_txid", "genesis_index"])
    made = program(prefix, suffix, F.col("creator"), F.col("total"), F.col("start_score"), F.col("duration_score"), F.lit(0).cast("long"))
    return rows.where(digest(made) == F.col("_want")).select(*schedules.columns)


def states(schedules: DataFrame, cells: DataFrame, prefix: bytes, suffix: bytes, digest: Digest = S.h32) -> DataFrame:
    """(token_id, txid, output_index, created_daa, claimed, claimed_delta, live, proof) of proven schedules, along each lock's chain.

    All locks take a step together: the spend of a cell leads to the lock's cells that the spending transaction made; a cell follows if
    exactly one ``claimed`` among 0 and the witness's small values reproduces its commitment, or else if its own spend reveals the
    schedule's state; claimed never falls. Two cells that follow end the chain. The cells are dealt by lock and transaction once, and a
    step moves only the states that it goes on from; guesses are tried where their cell is, and each step is written.
    """
    shared_dir(cells.sparkSession)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lock = cells.select(F.col("covenant_id").alias("lock_id"), "txid", "output_index", "created_daa", "spk_script", "spent_txid", "spent_sig").repartition(parts, "lock_id", "txid").checkpoint()
    here = proven(schedules, cells, prefix, suffix, digest).select(*_PLAN, F.col("genesis_txid").alias("txid"), F.col("genesis_index").alias("output_index"))
    zero = F.lit(0).cast("long")
    # The planner sees the size of the file that schedules come from, not theirs.
    front = here.hint("merge").join(lock, ["lock_id", "txid", "output_index"])
    front = landed(front.select(*_PLAN, "txid", "output_index", "created_daa", zero.alias("claimed"), zero.alias("claimed_delta"), F.lit("genesis").alias("proof"), "spent_txid", "spent_sig"))
    out = front
    after = lock.select("lock_id", F.col("txid").alias("spent_txid"), F.col("output_index").alias("next_index"), F.col("created_daa").alias("next_daa"), F.col("spk_script").alias("next_script"), F.col("spent_txid").alias("next_spent"), F.col("spent_sig").alias("next_sig"))
    while not front.isEmpty():
        going = front.where((F.col("claimed") < F.col("total")) & F.col("spent_txid").isNotNull())
        rows = going.select(*_PLAN, "claimed", "spent_txid", S.pushed("spent_sig")["values"].alias("v")).hint("merge").join(after, ["lock_id", "spent_txid"])
        small = F.transform(F.filter(F.coalesce("v", F.array()), lambda x: F.length(x) <= 8), lambda x: E.little_endian(F.substring(F.concat(x, F.lit(bytearray(8))), 1, 8)))
        small = F.array_distinct(F.concat(F.array(zero), F.filter(small, lambda x: x.isNotNull() & (x <= F.col("total")))))
        want = O.script_hash(F.col("next_script"))
        keys = ["token_id", "lock_id", "spent_txid", "next_index"]
        guess = rows.select("*", F.posexplode(small).alias("place", "guess")).drop("v")
        made = program(prefix, suffix, F.col("creator"), F.col("total"), F.col("start_score"), F.col("duration_score"), F.col("guess"))
        hit = F.when(digest(made) == want, F.col("guess"))
        kept = [*_PLAN[2:], "claimed", "next_daa", "next_script", "next_spent", "next_sig"]
        tried = guess.withColumn("hit", hit).groupBy(*keys).agg(F.collect_set("hit").alias("hits"), F.count_if(F.col("place") == 0).alias("copies"), F.first(F.struct(*kept)).alias("r"))
        rows = tried.select(*keys, F.when(F.size("hits") == 1, F.get("hits", F.lit(0))).alias("one"), "copies", "r.*").withColumn("_shown", S.pushed("next_sig")["last"])
        told = state(F.col("_shown"), prefix, suffix)
        own = (want == digest(F.col("_shown"))) & (told["creator"] == F.col("creator")) & (told["total"] == F.col("total")) & (told["start_score"] == F.col("start_score")) & (told["duration_score"] == F.col("duration_score"))
        rows = rows.withColumn("now", F.coalesce("one", F.when(own, told["claimed"]))).withColumn("proof", F.when(F.col("one").isNotNull(), "continuation_witness").otherwise("reveal"))
        rows = rows.where(F.col("now") >= F.col("claimed"))
        next_ = F.struct(*_PLAN[2:], F.col("spent_txid").alias("txid"), F.col("next_index").alias("output_index"), F.col("next_daa").alias("created_daa"), F.col("now").alias("claimed"), (F.col("now") - F.col("claimed")).alias("claimed_delta"), "proof", F.col("next_spent").alias("spent_txid"), F.col("next_sig").alias("spent_sig"))
        alone = rows.groupBy("token_id", "lock_id").agg(F.sum("copies").alias("n"), F.first(next_).alias("r")).where("n = 1")
        front = landed(alone.select("token_id", "lock_id", "r.*"))
        out = out.unionByName(front)
    return out.select("token_id", "txid", "output_index", "created_daa", "claimed", "claimed_delta", F.col("spent_txid").isNull().alias("live"), "proof")


def claims(rows: DataFrame) -> DataFrame:
    """States in which something was claimed."""
    return rows.where("claimed_delta > 0")

"""Follows a landed chain: every file drop of steps is one batch, applied to a versioned ledger.

A step removes blocks and adds blocks. Structured Streaming has no retraction, so each batch rolls the ledger back and forward
inside ``foreachBatch``. Tables are cut into ``BUCKETS`` by covenant, and a batch writes only the buckets of covenants that it touched;
a list of which version holds each bucket makes them the current ones. The batch number is written with that list: a batch that is run
again after a failure finds it and does nothing, so every step takes effect once. A step whose bodies aren't landed yet fails the
batch instead of skipping data; the query retries it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lineage as L
from ..session import shared_dir
from ..sources import landing, snapshots

TABLES = {"covenants": L.COVENANTS, "events": L.EVENTS, "cells": L.CELLS}
LOG = "reorgs"
#: Parts of the tables that are written on their own.
BUCKETS = 64


def bucket(covenant: str = "covenant_id"):
    return F.pmod(F.xxhash64(covenant), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(snapshots.get(spark, f"{path}/meta", "manifest") or "{}")


def load(spark: SparkSession, path: str) -> tuple[L.Ledger, int]:
    """The newest complete ledger, and the batch that made it (-1 for none)."""
    batch, held = int(snapshots.get(spark, f"{path}/meta", "batch") or -1), _manifest(spark, path)

    def table(name: str, schema: str) -> DataFrame:
        paths = [f"{path}/{name}/v={v}/bucket={b}" for b, v in sorted(held.get(name, {}).items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    log = held.get(LOG)
    reorgs = snapshots.read(spark, f"{path}/{LOG}", L.REORGS, log) if log is not None else spark.createDataFrame([], L.REORGS)
    return L.Ledger(*(table(n, s) for n, s in TABLES.items()), reorgs), batch


def save(ledger: L.Ledger, touched: DataFrame, path: str, batch: int) -> list[int]:
    """Write the buckets of touched covenants, then the list of versions with the batch number; returns the buckets written."""
    spark = ledger.events.sparkSession
    held = _manifest(spark, path)
    changed = [r["b"] for r in touched.select(bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    version = max((max(snapshots.versions(spark, f"{path}/{n}"), default=-1) for n in (*TABLES, LOG)), default=-1) + 1
    for name, schema in TABLES.items():
        rows = getattr(ledger, name).withColumn("bucket", bucket()).where(F.col("bucket").isin(changed))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/v={version}")
        made = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}/v={version}").select("bucket").distinct().collect()
        kept = {b: v for b, v in held.get(name, {}).items() if int(b) not in changed}
        held[name] = kept | {str(r["bucket"]): version for r in made}
    ledger.reorgs.write.mode("overwrite").parquet(f"{path}/{LOG}/v={version}")
    held[LOG] = version
    snapshots.put(spark, f"{path}/meta", {"batch": str(batch), "manifest": json.dumps(held)})
    return sorted(changed)


def bodies(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Accepted transactions of steps with their order, as ``lineage.classify`` takes them; reading one whose body or block isn't landed
    fails."""
    rows = landing.resolved(landing.accepted(steps), blocks)
    facts = blocks.select(F.col("hash").alias("accepting_block"), F.col("daa_score").alias("accepting_daa"), F.col("timestamp_ms").alias("accepting_time_ms"))
    rows = rows.join(facts, "accepting_block", "left")
    missing = F.col("tx").isNull() | F.col("accepting_daa").isNull()
    order = F.when(missing, F.raise_error(F.concat(F.lit("no landed body yet for accepted transaction "), F.col("txid"))).cast("long")).otherwise(F.col("step") * (1 << 42) + F.col("order") * (1 << 22) + F.col("tx_index"))
    return rows.select(order.alias("ord"), "accepting_block", "accepting_daa", "accepting_time_ms", F.col("tx_index").cast("int").alias("tx_index"), "txid", "tx.inputs", "tx.outputs", "tx.payload")


def advance(ledger: L.Ledger, steps: DataFrame, blocks: DataFrame, identity: L.Identity) -> tuple[L.Ledger, DataFrame]:
    """(ledger after the steps of a batch, covenants touched): one after another where one of them removes blocks.

    What a group of steps adds is classified once and checkpointed, and so is the ledger between groups, so that plans don't nest.
    """
    shared_dir(steps.sparkSession)
    numbers = sorted((r["step"], r["n"]) for r in steps.select("step", F.size("removed").alias("n")).collect())  # a batch's steps are few
    groups: list[tuple[bool, list[int]]] = []
    for step, removed in numbers:
        if removed > 0 or not groups:
            groups.append((removed > 0, []))
        groups[-1][1].append(step)
    touched = [ledger.covenants.select("covenant_id").limit(0)]
    for k, (back, group) in enumerate(groups):
        part = steps.where(F.col("step").isin(group))
        if back:
            gone = part.select(F.explode("removed").alias("block")).distinct().checkpoint()
            progress = ledger.events.agg(F.max("accepting_daa")).first()[0] or 0
            touched.append(L.affected(ledger, gone).checkpoint())
            ledger = L.rollback(ledger, gone, progress)
        events, created, spent = (x.checkpoint() for x in L.classify(bodies(part, blocks).checkpoint(), ledger, identity))
        touched.append(events.select("covenant_id"))
        ledger = L.apply(ledger, events, created, spent)
        if k + 1 < len(groups):
            ledger = L.Ledger(*(x.checkpoint() for x in (ledger.covenants, ledger.events, ledger.cells, ledger.reorgs)))
    return ledger, reduce(DataFrame.unionByName, touched).distinct()


def follow(
    spark: SparkSession, steps_dir: str, blocks_dir: str, ledger_dir: str, checkpoint: str, identity: L.Identity, *, once: bool = False, every: str = "2 seconds", files: int = 16
) -> StreamingQuery:
    """Start following; ``once`` takes what is there and ends."""
    source = spark.readStream.schema(landing.STEP).option("maxFilesPerTrigger", files).parquet(steps_dir)

    def step(batch: DataFrame, number: int) -> None:
        ledger, done = load(spark, ledger_dir)
        if number > done and not batch.isEmpty():
            save(*advance(ledger, batch, landing.blocks(spark, blocks_dir), identity), ledger_dir, number)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

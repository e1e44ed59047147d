"""Versioned derivation: tables that are computed again only if the inputs or the rules moved, with a log of runs.

A run writes new versions of its tables and then, in one step, their versions and the stamp; a run that fails or dies leaves the old
ones current. The stamp joins everything that decides the result: versions of the inputs and of the rules.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import snapshots
from . import tokens, upkeep

LOG = (
    "run bigint, scope string, stamp string, state string, started_ms bigint, ended_ms bigint, message string, "
    "added bigint, removed bigint, changed bigint, verified bigint, invalid bigint, unvalidated bigint"
)
#: Runs that the log keeps.
KEPT_RUNS = 200
VERDICTS = ("verified", "invalid", "unvalidated")


def stamp(**parts: object) -> str:
    """One text for all that a derivation depends on, in the order of names."""
    return "/".join(f"{k}={parts[k]}" for k in sorted(parts))


def log(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read(spark, f"{path}/runs", LOG)


def begin(spark: SparkSession, path: str, scope: str, now: str) -> int:
    """Note a run as running; one that is still noted so has died and becomes interrupted."""
    old = log(spark, path)
    run = (old.agg(F.max("run")).first()[0] or 0) + 1
    old = old.withColumn("state", F.when(F.col("state") == "running", "interrupted").otherwise(F.col("state")))
    row = spark.createDataFrame([(run, scope, now, "running", int(time.time() * 1000)) + (None,) * 8], LOG)
    snapshots.write(upkeep.newest(old.unionByName(row), "run", KEPT_RUNS), f"{path}/runs")
    return run


def _close(spark: SparkSession, path: str, run: int, **values: object) -> None:
    row = log(spark, path).where(F.col("run") == run)
    row = row.withColumns({k: F.lit(v).cast("string" if k in ("state", "message") else "bigint") for k, v in (values | {"ended_ms": int(time.time() * 1000)}).items()})
    snapshots.write(upkeep.upsert(log(spark, path), row.select(*log(spark, path).columns), ["run"]), f"{path}/runs")


def finish(spark: SparkSession, path: str, run: int, before: DataFrame | None, after: DataFrame | None) -> None:
    """Close a run with its verdicts and with what it changed; frames have (token_id, status)."""
    said: dict[str, object] = {"state": "ok"}
    if before is not None and after is not None:
        diff = tokens.status_changes(before, after).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")]).first()
        tally = after.agg(*[F.count_if(F.col("status") == s).alias(s) for s in VERDICTS]).first()
        said |= diff.asDict() | tally.asDict()
    _close(spark, path, run, **said)


def fail(spark: SparkSession, path: str, run: int, message: str) -> None:
    _close(spark, path, run, state="failed", message=message[:500])


def current(spark: SparkSession, path: str) -> dict:
    return json.loads(snapshots.get(spark, f"{path}/meta", "current") or "{}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A derived table in its current version; null before the first derivation."""
    at = current(spark, path).get("tables", {}).get(name)
    return None if at is None else spark.read.parquet(f"{path}/{name}/v={at}")


def derive_if_stale(spark: SparkSession, path: str, now: str, compute: Callable[[], dict[str, DataFrame]], scope: str = "full", verdicts: str | None = "accounts") -> bool:
    """Derive all tables of ``compute`` if the stamp moved; returns whether there was anything to do.

    ``verdicts`` names the table with (token_id, status) whose changes the log counts.
    """
    if current(spark, path).get("stamp") == now:
        return False
    run = begin(spark, path, scope, now)
    before = read(spark, path, verdicts) if verdicts else None
    try:
        at = {name: snapshots.write(df, f"{path}/{name}") for name, df in compute().items()}
    except Exception as e:
        fail(spark, path, run, str(e))
        raise
    snapshots.put(spark, f"{path}/meta", {"current": json.dumps({"stamp": now, "tables": at})})
    after = read(spark, path, verdicts) if verdicts else None
    if after is not None and before is None:
        before = after.limit(0)
    finish(spark, path, run, before, after)
    return True


def restamped(cells: DataFrame, generic: tuple[str, ...], version: str, name: str, located: DataFrame) -> DataFrame:
    """Cells whose generic stamp of an older version is cleared and, where a state block was located in a proven program (``located``:
    txid, output_index), replaced by ``name``. Stamps that aren't generic stay, as does whatever this version stamped."""
    hit = located.select("txid", "output_index").distinct().withColumn("_hit", F.lit(True))
    rows = cells.join(hit, ["txid", "output_index"], "left")
    old = F.coalesce(F.col("stamp_version") != version, F.lit(True)) & (F.col("revealed_template").isNull() | F.col("revealed_template").isin(*generic))
    new = F.when(F.col("_hit"), F.lit(name))
    return rows.select(*[F.when(old, new).otherwise(F.col(c)).alias(c) if c == "revealed_template" else F.when(old, F.lit(version)).otherwise(F.col(c)).alias(c) if c == "stamp_version" else F.col(c) for c in cells.columns])

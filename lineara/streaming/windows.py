"""Windows and state over streams of events (event_id, ts, user_id, event_type, value); the same functions run on batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(events: DataFrame, width: str, late: str, kinds: list[str]) -> DataFrame:
    """Tumbling counts by kind; a window is final once the watermark ``late`` has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]).select(F.col("window.start").alias("start"), *[f"n_{k}" for k in kinds])


def trailing(events: DataFrame, span: str, slide: str, late: str) -> DataFrame:
    """Sliding counts and values of the last ``span``, every ``slide``."""
    w = F.window("ts", span, slide)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")).select(F.col("window.end").alias("end"), "n", "value")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Sessions of each key that a pause of at least ``gap`` ends."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


def once_each(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key inside the watermark, for guards such as once a week."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


CHANGES = "key long, ts timestamp, was string, now string"


def changes(events: DataFrame, key: str, value: str) -> DataFrame:
    """A row whenever a key's value differs from the one before, kept in state; the first is no change. Rows of one key are taken in
    order of time inside a batch."""

    def step(ident: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values(["ts", "v"], kind="stable")
        before = rows["v"].shift()
        if len(rows):
            before.iloc[0] = last
        moved = before.notna() & (before != rows["v"])
        state.update((str(rows["v"].iloc[-1]),))
        yield pd.DataFrame({"key": ident[0], "ts": rows["ts"], "was": before, "now": rows["v"]})[moved.to_numpy()]

    rows = events.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("string").alias("v")).where("key is not null and v is not null")
    return rows.groupBy("key").applyInPandasWithState(step, CHANGES, "last string", "append", GroupStateTimeout.NoTimeout)


WEDGES = "key long, stalled long, lag long"


def wedges(progress: DataFrame, passes: int = 10, behind: int = 18_000) -> DataFrame:
    """Watch of (key, ts, done, tip): a row once a key made no progress in ``passes`` passes in a row while more than ``behind`` the tip."""

    def step(ident: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, stalled = state.get if state.exists else (-1, 0)
        out = []
        for r in pd.concat(parts).sort_values("ts", kind="stable").itertuples():
            moved = r.done > done or r.tip - r.done <= behind
            stalled = 0 if moved else stalled + 1
            done = max(done, r.done)
            if stalled == passes:
                out.append((ident[0], stalled, r.tip - r.done))
        state.update((int(done), int(stalled)))
        yield pd.DataFrame(out, columns=["key", "stalled", "lag"])

    rows = progress.select(F.col("key").cast("long").alias("key"), "ts", F.col("done").cast("long").alias("done"), F.col("tip").cast("long").alias("tip"))
    return rows.groupBy("key").applyInPandasWithState(step, WEDGES, "done long, stalled long", "append", GroupStateTimeout.NoTimeout)

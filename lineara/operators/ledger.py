"""Operators over the event log and the cells of a ledger.

Every function takes and returns DataFrames. Totals, buckets and shares are partial aggregates before their shuffle; feeds and pages
are a filter on the keyset and a top-k, which keeps only the page on each task. Nulls: a null key is a group of its own, a null time is
in no window. Empty tables give no rows (or one row of zeros where one row is stated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

DAY, HOUR = 86400, 3600


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def money(x: Column) -> Column:
    """Exact cents, so that sums do not depend on the order of rows."""
    return x.cast("decimal(18,2)")


def total(x: Column) -> Column:
    return F.sum(money(x)).cast("double")


def activity(events: DataFrame, kinds: list[str], width: int, cutoff: Column | None = None) -> DataFrame:
    """Counts by kind in buckets of ``width`` seconds, from ``cutoff`` on."""
    s = seconds(F.col("ts"))
    rows = events if cutoff is None else events.where(s >= cutoff)
    return rows.groupBy((s - F.pmod(s, F.lit(width))).alias("bucket")).agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def digest(events: DataFrame, window: int) -> DataFrame:
    """One row: what happened since ``window`` seconds before the newest event (that second included), the value born, and the busiest
    and biggest newborn entity; ties go to the smaller id."""
    tip = events.agg(F.max(seconds(F.col("ts")))).first()[0] or 0
    rows = events.where(seconds(F.col("ts")) >= max(0, tip - window))
    born = F.col("event_type") == "signup"
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(born, money(F.col("value")))).alias("v"), *[F.count_if(F.col("event_type") == k).alias(c) for k, c in (("signup", "b"), ("click", "m"), ("error", "d"))])
    least = lambda c: F.min_by(F.struct("user_id", c), F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("user_id"))))
    one = per.agg(F.sum("b").alias("births"), F.sum("m").alias("moves"), F.sum("d").alias("burns"), F.count(F.lit(1)).alias("active"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("value_born"), least("n").alias("x"), least("v").alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return one.select(zero("births"), zero("moves"), zero("burns"), "active", "value_born", F.col("x.user_id").alias("busiest"), F.col("x.n").alias("busiest_n"), F.col("y.user_id").alias("biggest"), F.col("y.v").cast("double").alias("biggest_value"))


def busiest(events: DataFrame, k: int) -> DataFrame:
    """The ``k`` entities with most events; ties go to the smaller id."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.desc("n_events"), "user_id").limit(k)


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element at place n // 2 of the sorted values; found by running counts over the distinct values' buckets."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("v") / 1024))
    before = counts.groupBy("b").agg(F.sum("n").alias("bn")).select("b", (F.sum("bn").over(W.orderBy("b")) - F.col("bn")).alias("before"), F.sum("bn").over(W.partitionBy()).alias("all"))
    at = counts.join(before, "b").withColumn("to", F.col("before") + F.sum("n").over(W.partitionBy("b").orderBy("v")))
    half = F.floor(F.col("all") / 2)
    return at.where((F.col("to") > half) & (F.col("to") - F.col("n") <= half)).select(F.col("v").alias("median"))


def widest_gaps(events: DataFrame, k: int) -> DataFrame:
    """The ``k`` widest gaps between neighbouring seconds with events: inside days, and between the last and first second of days."""
    s = events.where("ts is not null").select(seconds(F.col("ts")).alias("s")).distinct().withColumn("d", F.floor(F.col("s") / DAY))
    inside = s.select(F.lag("s").over(W.partitionBy("d").orderBy("s")).alias("lo"), F.col("s").alias("hi"))
    days = s.groupBy("d").agg(F.min("s").alias("first"), F.max("s").alias("last"))  # one row a day
    between = days.select(F.lag("last").over(W.orderBy("d")).alias("lo"), F.col("first").alias("hi"))
    gaps = inside.unionAll(between).where("lo is not null").withColumn("gap", F.col("hi") - F.col("lo"))
    return gaps.orderBy(F.desc("gap"), "lo").limit(k)


def feed(events: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """A page of the canonical feed (second, event id) that starts after the cursor."""
    s = seconds(F.col("ts"))
    rows = events if after is None else events.where((s > after[0]) | ((s == after[0]) & (F.col("event_id") > after[1])))
    return rows.select(s.alias("second"), "event_id", "user_id", "event_type").orderBy("second", "event_id").limit(limit)


def resequence(events: DataFrame) -> DataFrame:
    """Sequence numbers from 0 in each entity's own order. Ranks inside the entity's days stand on the counts of its days before, so an
    entity with a third of all rows is a task a day; rows without a time come first."""
    day = F.coalesce(F.floor(seconds(F.col("ts")) / DAY), F.lit(-(1 << 40)))
    rows = events.select("user_id", "event_id", "ts", day.alias("_d"))
    counts = rows.groupBy("user_id", "_d").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("user_id", "_d", (F.sum("n").over(W.partitionBy("user_id").orderBy("_d")) - F.col("n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("user_id", "_d").orderBy("ts", "event_id")) - 1
    ranked = rows.withColumn("_r", rank)
    return ranked.join(before, ["user_id", "_d"]).select("user_id", "event_id", (F.col("_r") + F.col("_before")).cast("long").alias("seq"))


def rollback(events: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The log without the rows of removed blocks; ``removed`` holds their keys."""
    return events.join(removed.select(key).distinct(), key, "left_anti")


def gap_merge(have: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The log with recovered rows that it lacks; a second merge of the same rows changes nothing."""
    return have.unionByName(found.dropDuplicates(keys).join(have.select(*keys).distinct(), keys, "left_anti"))


def state_changes(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Rows whose value differs from the one before in the key's order; the first counts as a change."""
    w = W.partitionBy(key).orderBy(order)
    return rows.select(key, order, value.alias("value"), F.lag(value).over(w).alias("before"), F.row_number().over(w).alias("_n")).where(
        (F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("before"))
    ).drop("_n")


def as_of(events: DataFrame, at: Column) -> DataFrame:
    """Each entity's last value at or before ``at``."""
    return events.where(F.col("ts") <= at).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """Sessions of each entity, numbered from 0: a new one begins when more than ``gap`` seconds have passed.

    An entity's days are cut into sessions of their own, and these few rows are stitched where a day's first session goes on from the
    day before.
    """
    inside = W.partitionBy("user_id", "d").orderBy("s", "event_id")
    rows = events.where("ts is not null").select("user_id", "event_id", seconds(F.col("ts")).alias("s")).withColumn("d", F.floor(F.col("s") / DAY))
    rows = rows.withColumn("new", F.when(F.col("s") - F.lag("s").over(inside) > gap, 1).otherwise(0)).withColumn("k", F.sum("new").over(inside))
    parts = rows.groupBy("user_id", "d", "k").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("user_id").orderBy("a", "b")  # one row for each of the entity's sessions
    parts = parts.withColumn("new", F.when(F.col("a") - F.lag("b").over(order) > gap, 1).otherwise(0)).withColumn("session", F.sum("new").over(order))
    return parts.groupBy("user_id", "session").agg(F.min("a").alias("begins"), F.max("b").alias("ends"), F.sum("n").alias("n_events"))


def candles(trades: DataFrame, width: int) -> DataFrame:
    """Open, high, low, close, volume and last id of each bucket."""
    s, order = seconds(F.col("ts")), F.struct("ts", "event_id")
    return trades.groupBy((s - F.pmod(s, F.lit(width))).alias("bucket")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("n_trades"), total(F.col("value")).alias("volume"), F.max_by("event_id", order).alias("last_id"),
    )


def flow(events: DataFrame, plus: str, minus: str) -> DataFrame:
    """Daily births and deaths with running totals; days without either are filled with zeros."""
    day = F.to_date("ts")
    counts = events.groupBy(day.alias("day")).agg(F.count_if(F.col("event_type") == plus).alias("plus"), F.count_if(F.col("event_type") == minus).alias("minus"))
    span = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    filled = span.join(counts, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("plus", "minus")])
    w = W.orderBy("day")  # one row a day
    return filled.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "plus", "minus", F.sum(F.col("plus") - F.col("minus")).over(w).alias("alive"))

"""Operators over covenants, their events and their state cells.

Frames follow the ledger's schema: covenants (covenant_id, genesis_txid, genesis_daa, lineage_complete, event_count,
last_activity_daa), events (covenant_id, seq, kind, txid, accepting_daa, accepting_block, tx_index, payload, ...), cells (txid,
output_index, covenant_id, value, created_*, spent_*, template, revealed_template, spk_script). A cell is live while spent_block is
null. Every summary aggregates the cells once before its join; pages are a keyset filter and a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import owners, payload as P
from .views import moves


def live(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("spent_block").isNull())


def _named(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def effective_template() -> Column:
    """Aggregate over a coin's cells: the largest semantic name, revealed before stated, else the largest name of any kind."""
    shown, stated = F.col("revealed_template"), F.col("template")
    has = _named(shown) | _named(stated)
    semantic = F.when(_named(shown) & ~shown.startswith("p2"), shown).when(~stated.startswith("p2"), stated)
    return F.coalesce(F.max(F.when(has, semantic)), F.max(F.when(has, F.coalesce(F.nullif(shown, F.lit("")), stated))))


def summaries(covenants: DataFrame, cells: DataFrame) -> DataFrame:
    """Every coin with its live states and value, the value it was born with, and its effective template."""
    alive = F.col("spent_block").isNull()
    per = cells.groupBy("covenant_id", "created_daa").agg(F.sum("value").alias("v"), F.count_if(alive).alias("n"), F.sum(F.when(alive, F.col("value")).otherwise(0)).alias("lv"))
    born = per.select("covenant_id", F.col("created_daa").alias("genesis_daa"), F.col("v").alias("born_value"))
    now = per.groupBy("covenant_id").agg(F.sum("n").alias("live_states"), F.sum("lv").alias("live_value"))
    name = cells.groupBy("covenant_id").agg(effective_template().alias("template"))
    out = covenants.join(now, "covenant_id", "left").join(name, "covenant_id", "left").join(born, ["covenant_id", "genesis_daa"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("covenant_id", "genesis_txid", "genesis_daa", "lineage_complete", "event_count", "last_activity_daa", zero("live_states"), zero("live_value"), zero("born_value"), "template")


def recency_page(rows: DataFrame, after: tuple[int, str] | None, limit: int, daa: str = "last_activity_daa", key: str = "covenant_id") -> DataFrame:
    """Newest first, both keys descending, strictly after the cursor."""
    at, ident = F.col(daa), F.col(key)
    if after is not None:
        rows = rows.where((at < after[0]) | ((at == after[0]) & (ident < after[1])))
    return rows.orderBy(F.desc(daa), F.desc(key)).limit(limit)


def born_values(covenants: DataFrame, cells: DataFrame) -> DataFrame:
    """Value of the cells created at a coin's genesis, of coins that have any."""
    born = covenants.select("covenant_id", F.col("genesis_daa").alias("created_daa"))
    return cells.join(born, ["covenant_id", "created_daa"]).groupBy("covenant_id").agg(F.sum("value").alias("born_value"))


def digest(covenants: DataFrame, events: DataFrame, cells: DataFrame, window: int, tip: int | None = None, ident: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row: births, moves, burns and value born since ``window`` before the tip (that instant included), coins alive now, and
    the busiest and biggest coin; ties go to the smaller id. The tip is the newest event's unless it is given. ``ident`` makes a coin's id of what the tables name it by; it is
    asked once for each coin, after the tables are summed."""
    if tip is None:
        tip = events.agg(F.max("accepting_daa")).first()[0] or 0
    cutoff = max(0, tip - window)
    recent = events.where(F.col("accepting_daa") >= cutoff)
    counts = recent.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("genesis", "births"), ("transition", "moves"), ("burn", "burns"))])
    born = born_values(covenants.where(F.col("genesis_daa") >= cutoff), cells)
    rank = lambda n: F.min_by(F.struct("covenant_id", n), F.struct(-F.col(n), F.col("covenant_id")))
    named = lambda rows: rows.withColumn("covenant_id", ident(F.col("covenant_id")))
    busy = named(recent.groupBy("covenant_id").agg(F.count(F.lit(1)).alias("n"))).agg(rank("n").alias("b"))
    rich = named(born).agg(rank("born_value").alias("r"), F.coalesce(F.sum("born_value"), F.lit(0)).alias("value_born"))
    now = live(cells).agg(F.countDistinct("covenant_id").alias("active_now"))
    one = F.lit(1).alias("_one")
    out = counts.select("*", one)
    for part in (busy, rich, now):  # one row each
        out = out.join(F.broadcast(part.select("*", one)), "_one")
    return out.select("births", "moves", "burns", "value_born", "active_now", F.col("b.covenant_id").alias("busiest"), F.col("b.n").alias("busiest_n"), F.col("r.covenant_id").alias("biggest"), F.col("r.born_value").alias("biggest_value"))


#: Upper bounds of the lifespan classes, in units of a tenth of a second.
LIFESPANS = (("< 10 s", 100), ("10 s – 1 min", 600), ("1 – 10 min", 6000), ("10 min – 1 h", 36000), ("1 – 6 h", 216000), ("6 h +", None))


def lifespans(events: DataFrame) -> DataFrame:
    """(covenant_id, life) of every burn at or after its coin's first genesis; a coin burnt twice gives two rows."""
    born = events.where("kind = 'genesis'").groupBy("covenant_id").agg(F.min("accepting_daa").alias("g"))
    died = events.where("kind = 'burn'").select("covenant_id", F.col("accepting_daa").alias("b"))
    return died.join(born, "covenant_id").select("covenant_id", (F.col("b") - F.col("g")).alias("life")).where("life >= 0")


def lifespan_classes(lives: DataFrame) -> DataFrame:
    """All classes in order with their counts, and the upper median and total on every row."""
    place = F.lit(len(LIFESPANS) - 1)
    for i, (_, most) in reversed(list(enumerate(LIFESPANS[:-1]))):
        place = F.when(F.col("life") < most, i).otherwise(place)
    counts = lives.groupBy(place.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    labels = lives.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(LIFESPANS)], "class int, label string")
    return labels.join(counts, "class", "left").select("class", "label", F.coalesce("n", F.lit(0)).alias("n"))


def survival(lives: DataFrame) -> DataFrame:
    """Share of the sampled coins that outlive each class."""
    w = W.orderBy("class")  # six rows
    rows = lifespan_classes(lives).withColumn("dead", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy()))
    return rows.select("class", "label", "dead", F.when(F.col("total") > 0, F.round(1 - F.col("dead") / F.col("total"), 6)).alias("alive_share"))


def template_stats(cells: DataFrame) -> DataFrame:
    """By effective template of the coin ('' for none): live states and value, states ever seen, coins. Coins are aggregated first, so
    one shuffle of the cells serves both steps."""
    alive = F.col("spent_block").isNull()
    coin = cells.groupBy("covenant_id").agg(effective_template().alias("t"), F.count_if(alive).alias("n"), F.sum(F.when(alive, F.col("value")).otherwise(0)).alias("v"), F.count(F.lit(1)).alias("seen"))
    return coin.groupBy(F.coalesce("t", F.lit("")).alias("template")).agg(F.sum("n").alias("live_states"), F.sum("v").alias("live_value"), F.sum("seen").alias("ever_seen"), F.count(F.lit(1)).alias("covenants"))


def revealed_counts(cells: DataFrame) -> DataFrame:
    return cells.where(_named(F.col("revealed_template"))).groupBy("revealed_template").agg(F.count(F.lit(1)).alias("n"))


def active_flags(cells: DataFrame) -> DataFrame:
    return cells.groupBy("covenant_id").agg(F.bool_or(F.col("spent_block").isNull()).alias("active"))


def live_cell(cells: DataFrame) -> DataFrame:
    """The live cell of highest value of each coin (ties: smaller txid, index), and how many live cells it has."""
    best = F.min_by(F.struct("txid", "output_index", "value"), F.struct(-F.col("value"), F.col("txid"), F.col("output_index")))
    return live(cells).groupBy("covenant_id").agg(best.alias("c"), F.count(F.lit(1)).alias("live_count")).select("covenant_id", "c.*", "live_count")


def controllers(cells: DataFrame, key_hex: str) -> DataFrame:
    """Coins that ever paid to a key: cells, whether any is live, first and last creation."""
    script = F.unhex(F.lit(f"{len(key_hex) // 2:02x}{key_hex}ac"))
    return cells.where(F.col("spk_script") == script).groupBy("covenant_id").agg(
        F.bool_or(F.col("spent_block").isNull()).alias("active"), F.count(F.lit(1)).alias("states"), F.min("created_daa").alias("first_daa"), F.max("created_daa").alias("last_daa")
    )


def holders_of(cells: DataFrame, covenant_id: str) -> DataFrame:
    """Keys that hold live pay-to-key cells of a coin, by value; cells of other scripts have no holder."""
    key = owners.pay_to_key(F.col("spk_script"))
    rows = live(cells).where(F.col("covenant_id") == covenant_id).select(F.lower(F.hex(key)).alias("key"), "value").where("key is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("states"), F.sum("value").alias("value"))


def stamped(events: DataFrame) -> DataFrame:
    """Events with the labels of their payloads."""
    p = F.col("payload")
    return events.select("*", P.lane_namespace(p).alias("lane"), P.payload_tag(p).alias("tag"), P.inscription_kind(p).alias("inscription"))


def breakdown(stamps: DataFrame, label: str, limit: int) -> DataFrame:
    """Events and coins of the commonest labels; lanes and other tags are disjoint."""
    rows = stamps.where(_named(F.col(label)))
    if label == "tag":
        rows = rows.where("lane is null")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("covenant_id").alias("n_coins")).orderBy(F.desc("n_events"), label).limit(limit)


def lane_rows(stamps: DataFrame, namespace: str) -> DataFrame:
    """Rows of a lane: the strict lane if it exists, else those whose tag is the namespace; never both."""
    rows = stamps.where((F.col("lane") == namespace) | (F.col("lane").isNull() & (F.col("tag") == f"tag:{namespace}")))
    strict = rows.agg(F.coalesce(F.bool_or(F.col("lane") == namespace), F.lit(False)).alias("strict"))  # one row
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(strict.withColumn("_one", F.lit(1))), "_one").where(F.col("strict") == F.col("lane").isNotNull()).drop("_one", "strict")


def families_with_sizes(members: DataFrame) -> DataFrame:
    """(id, family) with the size of the family."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes, "family")


def records(sums: DataFrame) -> DataFrame:
    """Crowns over coins' summaries: oldest alive, most traveled, richest, biggest birth, longest life. Ties go to the smaller id, and
    a coin with several crowns keeps the first."""
    s = sums.select("*", (F.col("live_states") > 0).alias("alive"), moves().alias("moves"), (F.col("last_activity_daa") - F.col("genesis_daa")).alias("lived"))
    born = F.col("genesis_daa").isNotNull()
    crowns = [
        ("oldest alive", F.col("alive") & born, F.col("genesis_daa"), F.col("genesis_daa")), ("most traveled", F.col("moves") > 1, -F.col("moves"), F.col("moves")),
        ("richest", F.col("alive") & (F.col("live_value") > 0), -F.col("live_value"), F.col("live_value")), ("biggest birth", F.col("born_value") > 0, -F.col("born_value"), F.col("born_value")),
        ("longest life", ~F.col("alive") & born & (F.col("lived") > 0), -F.col("lived"), F.col("lived")),
    ]
    best = s.agg(*[F.min_by(F.when(ok, F.struct(F.lit(i).alias("place"), F.lit(n).alias("label"), F.col("covenant_id"), v.cast("long").alias("figure"))), F.when(ok, F.struct(order.alias("o"), F.col("covenant_id").alias("c")))).alias(f"r{i}") for i, (n, ok, order, v) in enumerate(crowns)])
    rows = best.select(F.explode(F.array(*[f"r{i}" for i in range(len(crowns))])).alias("r")).where("r is not null").select("r.*")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("covenant_id").orderBy("place"))).where("k = 1").drop("k")


def named(rows: DataFrame, key: str = "covenant_id") -> DataFrame:
    """Rows with a friendly name; names that several ids share end in four digits of the id."""
    base = owners.friendly_name(F.col(key))
    rows = rows.withColumn("_name", base)
    many = rows.groupBy("_name").agg((F.countDistinct(key) > 1).alias("_many"))
    return rows.join(many, "_name").withColumn("name", F.when(F.col("_many"), F.concat_ws("-", "_name", F.substring(key, 1, 4))).otherwise(F.col("_name"))).drop("_name", "_many")

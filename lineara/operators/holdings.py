"""Operators over balances, transfers and entity graphs.

Shares and bounds are computed in exact integers or decimals; a figure that can't be proven is null. Pairs are emitted inside one
transaction only, whose number of parts the ledger bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import landed
from .graph import components
from .ledger import money, total

#: Lines for each task that makes or counts pairs.
LINES = 200_000


def stats(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_holders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        total(F.col("o_totalprice")).alias("total_value"), F.max("o_totalprice").alias("max_value"),
    )


def balances(orders: DataFrame) -> DataFrame:
    """Exact balance of every holder."""
    return orders.groupBy("o_custkey").agg(F.sum(money(F.col("o_totalprice"))).alias("balance"), F.count(F.lit(1)).alias("n_orders"))


def holders_page(held: DataFrame, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """A page of holders, balance descending, key ascending, after the cursor (balance, key)."""
    b = F.col("balance")
    rows = held if after is None else held.where((b < F.lit(after[0]).cast("decimal(18,2)")) | ((b == F.lit(after[0]).cast("decimal(18,2)")) & (F.col("o_custkey") > after[1])))
    return rows.orderBy(F.desc("balance"), "o_custkey").limit(limit).select("o_custkey", b.cast("double").alias("balance"), "n_orders")


def shares_bps(held: DataFrame, k: int) -> DataFrame:
    """The largest holders with their share of the total in whole basis points."""
    whole = held.agg(F.sum("balance").alias("whole"))  # one row
    top = held.orderBy(F.desc("balance"), "o_custkey").limit(k)
    cents = lambda c: (F.col(c) * 100).cast("decimal(28,0)")
    return top.join(F.broadcast(whole)).select("o_custkey", F.floor(cents("balance") * 10000 / cents("whole")).cast("long").alias("bps"))


def split_audit(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Supply by segment; null unless the parts sum to the whole that the orders state."""
    held = balances(orders).withColumnRenamed("o_custkey", "c_custkey")
    parts = customers.join(held, "c_custkey").groupBy("c_mktsegment").agg(F.sum("balance").alias("supply"))
    whole = orders.agg(F.sum(money(F.col("o_totalprice"))).alias("whole"))
    proven = parts.agg(F.sum("supply").alias("sum")).join(F.broadcast(whole)).select((F.col("sum") == F.col("whole")).alias("proven"))
    return parts.join(F.broadcast(proven)).select("c_mktsegment", F.when(F.col("proven"), F.col("supply").cast("double")).alias("supply"))


def conservation(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """How an order's parts compare with its stated total: transfer (equal), mint (more) or burn (less), in whole cents; a difference
    without a minter among the parts (flag N) is a violation."""
    parts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money(F.col("l_extendedprice"))).alias("parts"), F.bool_or(F.col("l_returnflag") == "N").alias("minter"))
    rows = orders.select("o_orderkey", money(F.col("o_totalprice")).alias("stated")).join(parts, "o_orderkey", "left")
    kind = F.when(F.col("parts").isNull(), "opaque").when(F.col("parts") > F.col("stated"), "mint").when(F.col("parts") < F.col("stated"), "burn").otherwise("transfer")
    broken = kind.isin("mint", "burn") & ~F.col("minter")
    return rows.groupBy(kind.alias("kind"), F.coalesce(broken, F.lit(False)).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def multi_entity(lines: DataFrame, least: int) -> DataFrame:
    """Transactions that move several entities."""
    return lines.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_entities"), F.count(F.lit(1)).alias("n_cells")).where(F.col("n_entities") >= least)


def _tasks(lines: DataFrame) -> int:
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))


def co_moves(lines: DataFrame) -> DataFrame:
    """How often two entities move in one transaction.

    Rows are dealt over as many tasks as their number asks for, so that what a task holds doesn't grow with the table.
    """
    tasks = _tasks(lines)
    sets = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).select("p.a", "p.b").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def co_links(lines: DataFrame) -> DataFrame:
    """Links (a, b) that connect what ``co_moves`` connects: the smallest entity of a transaction with each of its others."""
    sets = lines.select("l_orderkey", "l_suppkey").repartition(_tasks(lines), "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("e"))
    least = F.array_min("e")
    return sets.select(least.alias("a"), F.explode(F.array_remove("e", least)).alias("b"))


def families(edges: DataFrame) -> DataFrame:
    """(id, family) of every id in the edges (a, b): the smallest id that can be reached, however long the way."""
    return components(landed(edges.select("a", "b"))).select("id", F.col("component").alias("family"))

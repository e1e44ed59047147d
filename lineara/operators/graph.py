"""Connected components of an edge list by label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Parts into which the rows of one label are dealt when labels are looked up.
SALTS = 16

#: Links, in both directions, for each task that compares them or looks up their labels.
LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id that can be reached, however long the way.

    Each round takes the smallest label among the neighbours and then the label of that label, so a chain shortens by half. Rows
    that hold one label (a third of all ids may) are dealt over ``SALTS`` tasks, and only labels that moved are looked up. Labels
    are cut from their lineage by a checkpoint in the shared folder. The links are counted first and dealt over as many tasks as
    their number asks for, so that what a task holds doesn't grow with them; rows that are costly to make should be written before.
    Links with a null end and loops connect nothing; repeated links count once; no links give no rows.
    """
    ok = links.select("a", "b").where("a is not null and b is not null")
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * ok.count() // LINKS))
    both = ok.union(ok.select("b", "a")).repartition(tasks, "a", "b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")).checkpoint()
    while True:
        seen = both.repartition(tasks, "b").join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        step = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        moved = labels.where("component < id").select(F.col("id").alias("c"), F.col("component").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        step = step.join(moved, ["c", "salt"], "left").select("id", "old", F.coalesce("up", "c").alias("component")).checkpoint()
        labels = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return labels

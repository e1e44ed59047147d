"""Families over all edges, however long their chains."""

from pyspark.sql import functions as F

from lineara.session import table


def test_families_of_light_edges_and_long_chains(spark):
    from lineara.operators import holdings
    from lineara.plans import registry as plans

    chain = spark.createDataFrame([(i, i + 1) for i in range(120)], "a long, b long")
    assert {tuple(r) for r in holdings.families(chain).collect()} == {(i, 0) for i in range(121)}
    sf = "/root/testdata/sf0.001"
    ids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where("size(s) > 1").select(F.explode("s").alias("id")).distinct()
    assert plans.queries()["families_components"](spark, sf).join(ids, "id").count() == ids.count()

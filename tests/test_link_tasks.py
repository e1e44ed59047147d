"""Links are dealt over as many tasks as their number asks for, and a transaction's star connects what its pairs do."""

from lineara.operators import graph, holdings
from lineara.session import table


def test_tasks_follow_the_links(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", 40, raising=False)
    links = spark.createDataFrame([(i % 97, i) for i in range(1000)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("links", "links")
    try:
        found = {tuple(r) for r in graph.components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(i, i % 97) for i in range(1000)}
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("links") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == 50  # 2 * 1000 links by 40


def test_stars_connect_like_pairs(spark):
    lines = table(spark, "/root/testdata/sf0.001", "lineitem").where("l_suppkey % 3 <> l_orderkey % 3 or l_linenumber < 3")
    more = spark.createDataFrame([(-1, 900), (-1, 901), (-2, 901), (-2, 902), (-3, 950), (-3, 950), (-4, None), (-4, 970)], "l_orderkey long, l_suppkey long")
    lines = lines.select("l_orderkey", "l_suppkey").union(more)
    star = {tuple(r) for r in holdings.families(holdings.co_links(lines)).collect()}
    assert star == {tuple(r) for r in holdings.families(holdings.co_moves(lines)).collect()}
    assert {(900, 900), (901, 900), (902, 900)} <= star and not {950, 970} & {r[0] for r in star}

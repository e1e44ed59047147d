"""Which side of the programs' joins is sent to every task: pins and models, never programs."""

from lineara.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return registry.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()


def test_pins_are_sent_not_programs(spark):
    found = plan(spark, "program_matches")
    assert "BuildRight" in found and "BuildLeft" not in found


def test_verdicts_meet_their_programs_by_a_merge(spark):
    found = plan(spark, "program_verdicts")
    assert "SortMergeJoin [id" in found and "BuildLeft" not in found

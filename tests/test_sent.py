"""What the queries' shuffles send: the driver's keys, not the digests made of them, and each row as seldom as can be."""

import re

import pytest

from lineara.plans import registry

SF = "/root/testdata/sf0.001"
SENDS = re.compile(r"^[ :+-]*(Join|Aggregate|Window|RepartitionByExpression|Distinct|Sort)\b")


def digests_sent(df, kinds: str) -> list[str]:
    """Steps at or below the first one that needs a shuffle which make ids of the given kinds, but for what an aggregate that comes
    last makes of its groups."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(lines) if SENDS.match(x))
    lines[first] = lines[first].split("], [")[0] if "Aggregate [" in lines[first] else lines[first]
    return [x[:200] for x in lines[first:] if re.search(rf"concat\(({kinds}), cast\(", x)]


def exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("name,kinds", [("token_deltas", "n|t"), ("token_accounts", "n|t"), ("token_trades", "t"), ("token_classified", "n|t"), ("token_verdicts", "n|t"), ("holder_links", "n"), ("balances_at_events", "c"), ("born_values", "c|t"), ("token_candles", "n|t|m")])
def test_digests_are_made_after_the_shuffles(spark, name, kinds):
    assert digests_sent(registry.queries()[name](spark, SF), kinds) == []


def test_deltas_send_states_once(spark):
    # states and geneses by transaction, rows by place
    assert exchanges(registry.queries()["token_deltas"](spark, SF)) <= 3


def test_a_digest_of_the_ledger_names_coins_after_they_are_summed(spark):
    plan = registry.queries()["ledger_digest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"concat\(c, cast\((user_id|l_suppkey)", plan)


def test_holders_are_read_once(spark):
    plan = registry.queries()["holder_links"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan


def test_histories_of_other_covenants_stay_where_they_are(spark):
    lines = registry.queries()["token_actions_of_tx"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, x in enumerate(lines) if "+- Window" in x or ":- Window" in x]
    for i in windows:
        below = " ".join(lines[i + 1 : i + 5])
        assert re.search(r"Filter .*(user_id|l_suppkey)#\d+L (IN|INSET|=) ?", below) or "LocalRelation <empty>" in below


def test_events_of_one_kind_are_no_single_task(spark):
    plan = registry.queries()["subscriptions_match"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(kind#", plan) and plan.count("Window [") == 2 and "rightHint=(strategy=broadcast)" in plan


def test_equal_trades_are_judged_once(spark):
    lines = registry.queries()["constant_trials"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grid = max(i for i, x in enumerate(lines) if "Generate inline" in x and "bracket" in x)
    assert any("Aggregate [market_covenant_id" in x and "kas_before_sompi" in x for x in lines[grid:])


def test_claimed_facts_are_read_once_by_all_tasks(spark):
    plan = registry.queries()["token_facts_claimed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and sum("try_variant_get" in x for x in plan.splitlines()) == 1


def test_pairs_are_counted_by_as_many_tasks_as_their_lines_ask_for(spark, monkeypatch):
    from lineara.operators import holdings

    monkeypatch.setattr(holdings, "LINES", 100, raising=False)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert holdings.co_moves(lines).rdd.getNumPartitions() >= lines.count() // 100


def test_orders_meet_by_their_keys_before_cells_are_made(spark):
    from lineara.plans import proof_queries

    cells, _ = proof_queries.token_cells(spark, SF)
    lines = cells._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert not any("sha2(" in x for x in lines[join:])


def test_rounds_of_a_proof_write_keys(spark, monkeypatch):
    from lineara.operators import proofs
    from lineara.plans import proof_queries

    written = []
    plain = proof_queries.landed
    for module in (proofs, proof_queries):
        monkeypatch.setattr(module, "landed", lambda rows: written.append([f.name for f in rows.schema if f.dataType.simpleString() == "string"]) or plain(rows), raising=False)
    kept = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda rows, *a: written.append(["checkpoint"]) or kept(rows, *a))
    registry.queries()["token_state_proofs"](spark, SF)
    assert len(written) > 5 and not any(written)

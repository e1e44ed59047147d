"""Every query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from lineara.plans import registry
from lineara.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    found = df.toPandas()
    assert len(set(found.columns)) == len(found.columns)
    if name in registry.oracle_sql():
        want = con.execute(registry.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
    else:
        assert len(found)


def test_families(spark):
    from lineara.operators import holdings

    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (9, 8), (8, 7), (7, 9)], "a long, b long")
    found = {r.id: r.family for r in holdings.families(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}


def test_sessions_rule_is_strict(spark):
    from pyspark.sql import functions as F

    from lineara.operators import ledger

    ev = spark.createDataFrame([(1, 0, 1), (2, 1800, 1), (3, 3601, 1), (4, 0, 2)], "event_id long, s long, user_id long").withColumn("ts", F.timestamp_seconds("s"))
    assert ledger.sessions(ev, 1800).count() == 3

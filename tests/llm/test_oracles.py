"""The operators that SQL can state, against DuckDB, by value."""

import duckdb
import pytest

from lineara.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    want = con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(want.column_names) == names
    assert found == sorted((tuple(r[n] for n in names) for r in want.to_pylist()), key=str)

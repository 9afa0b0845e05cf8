"""Every registered query against its DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spruce.plans import registry
from check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "value"] and len(df.collect()) == 3


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)


def test_every_query_has_oracle_or_is_rows_only():
    assert set(registry.Q) <= set(entry.oracle_sql())

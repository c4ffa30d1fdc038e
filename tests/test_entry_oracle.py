"""Driver contract: entry() on sf0.001 and Spark = DuckDB oracle for every check."""

import os

import pytest

import __spark_entry__ as entry
from kestrel.plans import registry
from scripts.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
#: Every check of the library's own operators that has an oracle; those of kestrel/llm have tests of their own.
NAMES = sorted(registry.oracles())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["category", "n_reviews", "avg_score"]


def test_every_oracle_has_a_builder():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_oracle_match(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    s_rows = [tuple(r) for r in sdf.collect()]
    o_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert digest(sdf.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]

"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# 21 fits, where the kernel sweep runs the same code; 90 networks, which tests/test_neural.py trains in small
SLOW = {"ml11_sweep", "ml11_network_sweep", "agg3_network_marginals", "agg4_network_best"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def as_rows(arrow):
    names = sorted(arrow.column_names)
    return sorted(repr(tuple(0.0 if row[n] == 0 and isinstance(row[n], float) else row[n] for n in names)) for row in arrow.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    want = duck.execute(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 9


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""T-oracle: every catalog query at sf0.01 against its independent DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01
from oracle_compare import compare, duck

SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n[0] == "q"]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_sql():
    assert {n for n in SQL if n[0] == "q"} == set(NAMES)
    assert len(NAMES) >= 29


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_duckdb(spark, con, name):
    ok, msg = compare(entry.queries()[name](spark, SF01), con, SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["client_key", "client_name", "ordered", "billed", "returned", "flow_diff", "net_billed"]
    assert df.count() > 0


def test_csv_round_trip_rows_small(spark):
    q = entry.queries()
    assert q["q26_csv_roundtrip"](spark, SF001).count() == q["q06_billing_unified"](spark, SF001).count()

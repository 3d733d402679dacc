"""Hot keys: a third of the movement rows moved onto one order (and one supplier), derived
from the given sf0.01 tables; the Spark plans must still equal DuckDB on the same data."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.plans.duckdb_sql import BODIES
from ledgerlens.sources import fixtures as X
from oracle_compare import VIEWS, compare

import duckdb


@pytest.fixture(scope="module")
def skewed(spark):
    t = dict(X.load_tables(spark, SF01))
    li = t["lineitem"]
    hot_order = t["orders"].agg(F.min("o_orderkey")).first()[0]
    hot = F.abs(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey")) % 3 == 0
    skew = li.withColumn("l_orderkey", F.when(hot, F.lit(hot_order)).otherwise(F.col("l_orderkey"))) \
             .withColumn("l_suppkey", F.when(hot, F.lit(7)).otherwise(F.col("l_suppkey")))
    path = tempfile.mkdtemp(prefix="ledgerlens-skew-") + "/lineitem"
    skew.write.mode("overwrite").parquet(path)
    t["lineitem"] = spark.read.parquet(path)
    con = duckdb.connect()
    for v in VIEWS:
        src = f"{path}/*.parquet" if v == "lineitem" else f"{SF01}/{v}.parquet"
        con.execute(f"create view {v} as select * from read_parquet('{src}')")
    assert t["lineitem"].where(F.col("l_orderkey") == hot_order).count() > t["lineitem"].count() / 4
    return t, con


def _with_deps(name):
    from ledgerlens.plans.duckdb_sql import oracle_sql
    return oracle_sql()[name]


def test_billing_lines_with_hot_order(spark, skewed):
    from ledgerlens.operators import billing as B
    t, con = skewed
    df = B.billing_lines(X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t), "R")
    ok, msg = compare(df, con, _with_deps("q03_billing_lines"))
    assert ok, msg


def test_demand_with_hot_supplier(spark, skewed):
    from ledgerlens.operators.demand import build_demand
    t, con = skewed
    df = build_demand(X.demand_orders(t), X.demand_suppliers(t), X.demand_clients(t))
    ok, msg = compare(df, con, BODIES["q07_demand"])
    assert ok, msg

"""Co-located tables: the same rows as from the files, and no exchange of fact rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.operators import billing as B
from ledgerlens.operators.demand import build_demand, colocate, orders_of_lines
from ledgerlens.plans import catalog as C
from ledgerlens.plans.layout import Layout, bucket_count
from ledgerlens.sources import fixtures as X


@pytest.fixture
def tables(spark):
    t = X.load_tables(spark, SF01)
    with Layout(spark, buckets=5) as layout:
        yield t, layout, B.colocate(X.billing_tables(t), layout), colocate(X.demand_lines(t), X.line_orders(t), layout)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    """What is dealt out by hash, in the final plan (the initial one is printed behind it)."""
    return re.findall(r"hashpartitioning\(([^)]*)", plan.split("Initial Plan")[0])


def test_billing_lines_without_an_exchange(spark, tables):
    t, _, b, _ = tables
    lines = lambda x: B.billing_lines(x.header, x.movements, x.clients, x.suppliers, "R")
    plan = executed(lines(b))
    # The suppliers' names are made distinct; neither orders nor movements are dealt out.
    assert len(exchanges(plan)) == 1 and "supplier_name" in exchanges(plan)[0] and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert sum("order_id" in x for x in exchanges(executed(lines(X.billing_tables(t))))) >= 2  # the same without the layout
    assert rows(lines(b)) == rows(lines(X.billing_tables(t)))


def test_demand_joins_without_an_exchange(spark, tables):
    t, _, _, (sums, orders) = tables
    pairs = orders_of_lines(sums, orders)
    assert exchanges(executed(pairs)) == []
    demand = build_demand(pairs, X.demand_suppliers(t), X.demand_clients(t))
    plan = executed(demand)
    dealt = exchanges(plan)
    assert dealt and all("order_id" not in x for x in dealt)  # only what is summed up by supplier and client
    assert rows(demand) == rows(build_demand(X.demand_orders(t), X.demand_suppliers(t), X.demand_clients(t)))


@pytest.mark.parametrize("build", ["window", "promo", "unified", "suppliers", "returns"])
def test_other_billing_operators_read_the_layout(spark, tables, build):
    t, _, b, _ = tables

    def run(x):
        if build == "window":
            return B.billing_window(x.header, x.movements, x.clients, x.suppliers, X.FIXTURE_RULES)
        if build == "promo":
            return B.billing_promo(x.header, x.movements, x.clients, x.suppliers, x.promo_codes, X.FIXTURE_RULES)
        if build == "unified":
            return B.build_billing(x, X.FIXTURE_RULES)
        return B.order_suppliers(x.movements, x.suppliers) if build == "suppliers" else B.returns_by_order(x.movements, "R")

    assert rows(run(b)) == rows(run(X.billing_tables(t)))


def test_a_hot_order_is_a_few_rows_of_its_bucket(spark):
    """A third of all movements on one order: summed up in tasks, the bucket holds a row for each supplier and operation."""
    t = X.load_tables(spark, SF01)
    m = X.movements(t)
    hot = m.where("order_id % 3 = 0").withColumn("order_id", F.lit(1).cast("long"))
    skewed = m.where("order_id % 3 <> 0").union(hot)
    with Layout(spark, buckets=8) as layout:
        kept = layout.write(B.movement_sums(skewed), "movements", "order_id")
        pairs = skewed.select("supplier_key", "op_code").distinct().count()
        assert kept.where("order_id = 1").count() <= pairs < hot.count()
        assert rows(B.returns_by_order(kept, "R")) == rows(B.returns_by_order(skewed, "R"))


def test_files_and_tables_go(spark):
    layout = Layout(spark, buckets=3)
    kept = layout.write(spark.range(100).withColumn("v", F.col("id") % 7), "numbers", "v")
    folder = layout.run.folder.removeprefix("file:")
    assert kept.count() == 100 and len([f for f in os.listdir(f"{folder}/numbers") if f.endswith(".parquet")]) <= 3
    name = layout.tables[0]
    layout.remove()
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name)


def test_bucket_count(spark):
    assert bucket_count(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("ledgerlens.layout.buckets", "77")
    try:
        assert bucket_count(spark) == 77
    finally:
        spark.conf.unset("ledgerlens.layout.buckets")


def test_the_catalog_writes_its_layout_once(spark):
    first, second = C.colocated(spark, SF01), C.colocated(spark, SF01)
    assert first[0] is second[0]
    assert rows(C.q28_demand_colocated(spark, SF01)) == rows(C.q07_demand(spark, SF01))

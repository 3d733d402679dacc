"""Shuffle partitions grow with the rows of a job; the demand without its last shuffle."""

import threading

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.operators.demand import build_demand
from ledgerlens.plans import catalog as C
from ledgerlens.plans.parts import enough_partitions, partitions_for
from ledgerlens.plans.stage import forget
from ledgerlens.sources import fixtures as X
from test_plans import plan

PARTITIONS, ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def few_rows_a_task(spark):
    spark.conf.set("ledgerlens.shuffle.rows", "5000")
    forget(spark), X.forget_tables(), C._layouts.clear()
    yield
    spark.conf.unset("ledgerlens.shuffle.rows")
    forget(spark), X.forget_tables(), C._layouts.clear()


def test_settings_come_back(spark):
    own = spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)
    assert partitions_for(spark, 0) == int(own[0]) and partitions_for(spark, 500_000 * 99 + 1) == 100
    with enough_partitions(spark, 0):
        assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)) == own
    with pytest.raises(ValueError), enough_partitions(spark, 50_000_000):
        assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)) == ("100", "16m")
        raise ValueError
    assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)) == own


def test_settings_come_back_after_threads(spark):
    own, wait = spark.conf.get(PARTITIONS), threading.Barrier(3)

    def job(rows):
        with enough_partitions(spark, rows):
            wait.wait(30)
            assert spark.conf.get(PARTITIONS) == "300"

    with enough_partitions(spark, 150_000_000):
        threads = [threading.Thread(target=job, args=(n * 500_000,)) for n in (20, 200)]
        [t.start() for t in threads]
        wait.wait(30)
        [t.join() for t in threads]
    assert spark.conf.get(PARTITIONS) == own


@pytest.mark.parametrize("name", ["q07_demand", "q28_demand_colocated", "q29_refreshed_reconciliation"])
def test_a_shuffle_of_more_rows_has_more_partitions(spark, few_rows_a_task, monkeypatch, name):
    """What is written is planned with the partitions that the rows ask for, and the session has its own number again."""
    from ledgerlens.plans.stage import Run
    seen, keep, own = {}, Run.keep, spark.conf.get(PARTITIONS)

    def kept(self, df, what):
        seen[what.split("-")[0]] = int(spark.conf.get(PARTITIONS))
        return keep(self, df, what)

    monkeypatch.setattr(Run, "keep", kept)
    assert C.QUERIES[name](spark, SF01).count() > 0
    last = {"q07_demand": "demand", "q28_demand_colocated": "demand_colocated", "q29_refreshed_reconciliation": "refreshed"}[name]
    assert seen[last] >= X.load_tables(spark, SF01)["lineitem"].count() // 5000
    assert spark.conf.get(PARTITIONS) == own


def test_buckets_follow_the_rows(spark, few_rows_a_task):
    layout, _, _ = C.colocated(spark, SF01)
    assert layout.buckets >= X.load_tables(spark, SF01)["lineitem"].count() // 5000


def _demand(spark, sup, cli):
    orders = spark.createDataFrame([(1, 1, 1, 10), (2, 1, 2, 20), (3, 2, 1, 30), (4, 2, 2, 40), (5, None, 1, 50)],
                                   "order_id long, supplier_id long, client_id long, value long").withColumn("value", F.col("value").cast("decimal(18,2)"))
    s = spark.createDataFrame(sup, "supplier_id long, supplier_key long, supplier_name string")
    c = spark.createDataFrame(cli, "client_id long, client_key long, client_name string, state string")
    df = build_demand(orders, s, c)
    return df, sorted(((*r[:5], float(r[5]), r[6]) for r in df.collect()), key=repr)


def test_demand_of_plain_dimensions_has_no_last_shuffle(spark):
    df, got = _demand(spark, [(1, 1, "a"), (2, 2, "b"), (None, 2, "b")], [(1, 5, "x", "CE"), (2, 5, "x", None)])
    assert got == sorted([("a", 1, "x", 5, "CE", 10.0, 1), ("a", 1, "x", 5, None, 20.0, 1),
                          ("b", 2, "x", 5, "CE", 30.0, 1), ("b", 2, "x", 5, None, 40.0, 1)], key=repr)
    assert "supplier_name" not in "".join(x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("sup, cli, want", [
    ([(1, 7, "a"), (2, 7, "a")], [(1, 5, "x", "CE"), (2, 6, "y", "CE")], [("a", 7, "x", 5, "CE", 40.0, 2), ("a", 7, "y", 6, "CE", 60.0, 2)]),
    ([(1, 1, "a"), (2, 2, None)], [(1, 5, None, None), (2, 5, None, None)], [("a", 1, None, 5, None, 30.0, 2), (None, 2, None, 5, None, 70.0, 2)]),
    ([(1, 1, "a"), (1, 1, "a")], [(1, 5, "x", "CE"), (2, 6, "y", "CE")], [("a", 1, "x", 5, "CE", 20.0, 2), ("a", 1, "y", 6, "CE", 40.0, 2)]),
])
def test_demand_of_dimensions_that_repeat(spark, sup, cli, want):
    assert _demand(spark, sup, cli)[1] == sorted(want, key=repr)

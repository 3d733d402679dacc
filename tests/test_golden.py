"""T-unit: the hand-made reconciliation golden set (FIXTURES section 4.3) - null, blank-key,
first-name, case and de-duplication rules."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.billing import DEDUP_KEYS, dedupe_keep_first
from ledgerlens.operators.reconcile import reconcile, totals
from ledgerlens.operators.reports import client_returns, top_clients
from ledgerlens.operators.scope import scope_billing, scope_demand

BILLING_SCHEMA = ("src string, branch_id string, order_id long, supplier_key string, supplier_name string, "
                  "client_key string, client_name string, state string, billed decimal(18,2), returned decimal(18,2)")
BILLING_ROWS = [
    ("W", "1", 10, "100", "Acme ", "1", "Ana", "CE", D("100.00"), None),
    ("W", "1", 10, "200", "Beta", "1", "Ana", "CE", D("100.00"), None),
    ("W", "2", 11, "100", "Acme ", "2", None, "ce", D("50.50"), D("50.50")),
    ("P", "1", 10, "100", "Acme ", "1", "Ana", "CE", D("999.00"), None),
    ("P", None, 12, None, None, None, None, None, D("7.25"), None),
]
DEMAND_SCHEMA = ("supplier_key string, supplier_name string, client_key string, client_name string, "
                 "state string, ordered decimal(18,2), order_count long")
DEMAND_ROWS = [
    ("100", "acme", "1", "Ana M", "PI", D("150.00"), 2),
    ("300", "Gama", "3", "Caio", "PI", D("30.00"), 1),
]


@pytest.fixture(scope="module")
def inputs(spark):
    raw = spark.createDataFrame(BILLING_ROWS, BILLING_SCHEMA)
    prio = raw.withColumn("src_priority", F.when(F.col("src") == "W", 0).otherwise(1))
    unified = dedupe_keep_first(prio, DEDUP_KEYS, [F.col("src_priority")]).drop("src", "src_priority")
    demand = spark.createDataFrame(DEMAND_ROWS, DEMAND_SCHEMA)
    return unified, demand


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_unified_keeps_window_row(inputs):
    unified, _ = inputs
    assert unified.count() == 4
    assert sorted(float(r.billed) for r in unified.collect()) == [7.25, 50.5, 100.0, 100.0]


def test_client_table(inputs):
    unified, demand = inputs
    got = _rows(reconcile(unified, demand).client,
                ["client_key", "client_name", "ordered", "billed", "returned", "flow_diff", "net_billed"])
    assert got == sorted([
        ("", None, 0.0, 7.25, 0.0, -7.25, 7.25),
        ("1", "Ana M", 150.0, 200.0, 0.0, -50.0, 200.0),
        ("2", None, 0.0, 50.5, 50.5, -50.5, 0.0),
        ("3", "Caio", 30.0, 0.0, 0.0, 30.0, 0.0),
    ], key=repr)


def test_supplier_table(inputs):
    unified, demand = inputs
    got = _rows(reconcile(unified, demand).supplier,
                ["supplier_key", "supplier_name", "ordered", "billed", "returned", "flow_diff"])
    assert got == sorted([
        ("", None, 0.0, 7.25, 0.0, -7.25),
        ("100", "ACME", 150.0, 150.5, 50.5, -0.5),
        ("200", "BETA", 0.0, 100.0, 0.0, -100.0),
        ("300", "GAMA", 30.0, 0.0, 0.0, 30.0),
    ], key=repr)


def test_branch_and_state(inputs):
    unified, demand = inputs
    rec = reconcile(unified, demand)
    assert _rows(rec.branch, ["branch_id", "billed", "returned", "net_billed", "ordered", "flow_diff"]) == [
        ("1", 200.0, 0.0, 200.0, 0.0, -200.0), ("2", 50.5, 50.5, 0.0, 0.0, -50.5)]
    assert _rows(rec.state, ["state", "billed", "returned", "net_billed"]) == [
        ("CE", 200.0, 0.0, 200.0), ("ce", 50.5, 50.5, 0.0)]


def test_totals(inputs):
    unified, demand = inputs
    r = totals(unified, demand).first()
    assert (r.ordered, r.billed, r.returned, r.flow_diff) == (180.0, 257.75, 50.5, -77.75)


def test_scope_ce(inputs):
    unified, demand = inputs
    b = scope_billing(unified, "CE")
    d = scope_demand(demand, b, "CE")
    assert b.count() == 3
    assert [r.client_key for r in d.collect()] == ["1"]
    r = totals(b, d).first()
    assert (r.ordered, r.billed, r.returned, r.flow_diff) == (150.0, 250.5, 50.5, -100.5)


def test_scope_all_is_unscoped(inputs):
    unified, demand = inputs
    for s in (None, "Todos", "todos", "DIRETORIA"):
        assert scope_billing(unified, s).count() == unified.count()
        assert scope_demand(demand, unified, s).count() == demand.count()


def test_top_and_returns(inputs):
    unified, demand = inputs
    client = reconcile(unified, demand).client
    assert [(r.client_key, r.net_billed) for r in top_clients(client).collect()] == [("1", 200.0), ("", 7.25)]
    assert [(r.client_name, r.returned) for r in client_returns(client).collect()] == [(None, 50.5)]


def test_count_each_order_once(inputs):
    unified, demand = inputs
    rec = reconcile(unified, demand, dedupe_orders=True)
    assert sum(r.billed for r in rec.client.collect()) == 157.75


def test_one_pass_summaries_drop_null_groups(inputs):
    from ledgerlens.operators.reconcile import branch_and_state, split_summaries
    unified, _ = inputs
    br, st = split_summaries(branch_and_state(unified))
    assert _rows(br, ["branch_id", "billed", "returned", "net_billed"]) == [
        ("1", 200.0, 0.0, 200.0), ("2", 50.5, 50.5, 0.0)]
    assert _rows(st, ["state", "billed", "returned", "net_billed"]) == [
        ("CE", 200.0, 0.0, 200.0), ("ce", 50.5, 50.5, 0.0)]


def test_permitted_state():
    from ledgerlens.operators.scope import permitted_state
    assert permitted_state("DIRETORIA") is None
    assert permitted_state("diretoria", "Todos") is None
    assert permitted_state("DIRETORIA", "CE") == "CE"
    assert permitted_state("PI", "CE") == "PI"  # a regional user cannot choose another state


def test_window_dates():
    import datetime as dt

    import pytest

    from ledgerlens.operators.billing import BillingRules, parse_moment
    assert parse_moment("21/04/2025") == parse_moment("2025-04-21") == dt.datetime(2025, 4, 21)
    assert parse_moment("2025-04-21 23:59:59") == parse_moment("21/04/2025 23:59:59") == dt.datetime(2025, 4, 21, 23, 59, 59)
    for bad in ("2025-04-21x", "21-04-2025", "2025-02-30", "", "2025-04-21 25:00:00"):
        with pytest.raises(ValueError):
            parse_moment(bad)
    assert BillingRules("2025-04-12", "2025-04-21").end_inclusive_day is False


def test_last_day_of_the_window(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from ledgerlens.operators.billing import BillingRules, window_predicate
    days = ["2025-04-12 00:00:00", "2025-04-21 00:00:00", "2025-04-21 09:00:00", "2025-04-21 23:59:59", "2025-04-22 00:00:00"]
    df = spark.createDataFrame([(d, "F", "OL", "F", 8888) for d in days], "d string, status string, sale_type string, origin string, issuer_id long")
    df = df.withColumn("order_date", F.col("d").cast("timestamp_ntz"))
    kept = lambda rules: sorted(r.d for r in df.where(window_predicate(rules)).collect())
    rules = BillingRules("12/04/2025", "21/04/2025")
    assert kept(rules) == days[:2]
    assert kept(replace(rules, end_inclusive_day=True)) == days[:4]
    assert kept(BillingRules("2025-04-12", "2025-04-21 23:59:59")) == days[:4]
    assert kept(BillingRules("2025-04-12", "2025-04-21 09:00:00", end_inclusive_day=True)) == days[:3]


def test_each_order_class_rule_drops_rows(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators.billing import CAMPAIGN_RULES, window_predicate
    rows = [("F", "OL", "F", 8888), ("L", "OL", "F", 8888), ("F", "XX", "F", 8888), ("F", "OL", "T", 8888), ("F", "OL", "F", 1),
            (None, "OL", "F", 8888), ("F", "OL", None, 8888), ("F", "OL", "F", None)]
    df = spark.createDataFrame(rows, "status string, sale_type string, origin string, issuer_id long")
    df = df.withColumn("order_date", F.lit("2025-04-15 00:00:00").cast("timestamp_ntz"))
    assert df.where(window_predicate(CAMPAIGN_RULES)).count() == 1

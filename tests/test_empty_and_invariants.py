"""T-empty and T-invariant."""

from pyspark.sql import functions as F

from conftest import SF001, SF01
from ledgerlens.operators.reconcile import reconcile, totals
from ledgerlens.operators.scope import scope_billing, scope_demand, state_list
from ledgerlens.operators.reports import clients_per_state, top_clients
from ledgerlens.plans import catalog as C
from ledgerlens.schemas import BILLING_FILE_SCHEMA, DEMAND_FILE_SCHEMA


def test_empty_inputs_give_empty_outputs(spark):
    b = spark.createDataFrame([], BILLING_FILE_SCHEMA)
    d = spark.createDataFrame([], DEMAND_FILE_SCHEMA)
    rec = reconcile(b, d)
    for df, cols in [(rec.client, 7), (rec.supplier, 6), (rec.branch, 6), (rec.state, 6)]:
        assert df.count() == 0 and len(df.columns) == cols
    assert top_clients(rec.client).count() == 0
    assert [tuple(r) for r in state_list(b).collect()] == [("Todos", 0)]
    t = totals(b, d).first()
    assert (t.ordered, t.billed, t.returned, t.flow_diff) == (0.0, 0.0, 0.0, 0.0)


def test_state_summary_without_state_column(spark):
    b = spark.createDataFrame([], BILLING_FILE_SCHEMA).drop("state")
    s = reconcile(b, spark.createDataFrame([], DEMAND_FILE_SCHEMA)).state
    assert s.columns == ["state", "billed", "returned", "net_billed", "ordered", "flow_diff"]


def test_invariants_on_test_tables(spark):
    unified = C.staged_billing(spark, SF01)
    demand = C.staged_demand(spark, SF01)
    rec = reconcile(unified, demand)
    # flow_diff = ordered - billed, net = billed - returned
    bad = rec.client.where(F.abs(F.col("flow_diff") - (F.col("ordered") - F.col("billed"))) > 1e-6).count()
    assert bad == 0
    total_billed = unified.agg(F.sum("billed")).first()[0]
    assert round(rec.client.agg(F.sum("billed")).first()[0], 2) == float(total_billed)
    assert round(rec.supplier.agg(F.sum("billed")).first()[0], 2) == float(total_billed)
    assert round(rec.branch.agg(F.sum("billed")).first()[0], 2) == float(total_billed)
    # unified is unique on its 4-key
    keys = ["branch_id", "order_id", "client_key", "supplier_key"]
    assert unified.groupBy(*keys).count().where("count > 1").count() == 0
    # totals equal the sums of the client table
    t = totals(unified, demand).first()
    c = rec.client.agg(F.sum("ordered").alias("o"), F.sum("billed").alias("b")).first()
    assert round(c.o, 2) == t.ordered and round(c.b, 2) == t.billed
    # scope(all) = unscoped; scoped demand only holds clients billed in the state
    assert scope_billing(unified, "Todos").count() == unified.count()
    sb = scope_billing(unified, "NATION_3")
    sd = scope_demand(demand, sb, "nation_3")
    assert sd.join(sb.select("client_key").distinct(), "client_key", "left_anti").count() == 0


def test_clients_per_state_total_is_distinct_overall(spark):
    unified = C.staged_billing(spark, SF01)
    rows = {r.state: r.clients for r in clients_per_state(unified).collect()}
    assert rows["Todos"] == unified.select("client_key").distinct().where("client_key is not null").count()
    assert rows["Todos"] <= sum(v for k, v in rows.items() if k != "Todos")


def test_one_pass_branch_and_state_equals_separate(spark):
    from ledgerlens.operators.reconcile import branch_and_state, branch_summary, split_summaries, state_summary
    unified = C.staged_billing(spark, SF01)
    br, st = split_summaries(branch_and_state(unified))
    for a, b in ((br, branch_summary(unified)), (st, state_summary(unified))):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_forget_removes_what_was_staged(spark):
    """Files of staged tables and of single builds' headers go with the registry."""
    import os

    from ledgerlens.plans import catalog as C
    from ledgerlens.plans.stage import app_run, forget
    C.staged_demand(spark, SF001), C.q04_billing_window(spark, SF001).count()
    folder = app_run(spark).folder.removeprefix("file:")
    assert len(os.listdir(folder)) >= 2
    forget(spark)
    assert not os.path.exists(folder) and C.staged_demand(spark, SF001).count() > 0

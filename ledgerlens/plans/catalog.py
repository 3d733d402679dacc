"""The query catalog: one callable (spark, sf_dir) -> DataFrame per user-level operator.

Each query reads the test tables through ``sources.fixtures`` (lazy Parquet scans) and runs
the library operators on them. The two shared intermediates - the unified billing (q06) and
the demand (q07) - are staged as Parquet under ``spark.checkpoint.dir`` (``plans.stage``), once per
session and state of the input files; every report after them reads the staged files. The client
and supplier reconciliation tables are staged the same way, since seven reports read them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_key
from ledgerlens.operators import billing as B
from ledgerlens.operators import reconcile as R
from ledgerlens.operators import reports as P
from ledgerlens.operators import scope as S
from ledgerlens.operators import state_reports as T
from ledgerlens.operators.demand import build_demand, orders_of_lines
from ledgerlens.operators.demand import colocate as colocate_lines
from ledgerlens.operators.refresh import refresh
from ledgerlens.operators.sinks import csv_roundtrip, write_billing_csv, write_demand_csv
from ledgerlens.plans.layout import Layout
from ledgerlens.plans.parts import enough_partitions
from ledgerlens.plans.scratch import scratch_path
from ledgerlens.plans.stage import app_run, stage, stage_key
from ledgerlens.sources import fixtures as X

_lock = threading.Lock()

SCOPE_STATE = "nation_3"  # the state a regional user is fixed to in q09/q10


def _t(spark: SparkSession, sf_dir: str):
    return X.load_tables(spark, sf_dir)


def q01_order_suppliers(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.order_suppliers(X.movements(t), X.suppliers(t))


def q02_returns_by_order(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.returns_by_order(X.movements(t), X.FIXTURE_RULES.return_op)


def q03_billing_lines(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.billing_lines(X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t),
                           X.FIXTURE_RULES.return_op)


def q04_billing_window(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.billing_window(X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t),
                            X.FIXTURE_RULES, app_run(spark).keep)


def q05_billing_promo(spark, sf_dir):
    t = _t(spark, sf_dir)
    return B.billing_promo(X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t),
                           X.promo_codes(t), X.FIXTURE_RULES, app_run(spark).keep)


def unified_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return B.billing_unified(X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t),
                             X.promo_codes(t), X.FIXTURE_RULES, keep=app_run(spark).keep)


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return build_demand(X.demand_orders(t), X.demand_suppliers(t), X.demand_clients(t))


def _key(spark: SparkSession, name: str, sf_dir: str) -> str:
    return stage_key(name, sf_dir, X.tables_signature(spark, sf_dir), X.FIXTURE, X.FIXTURE_RULES)


def _fact_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest tables (from the files' footers)."""
    t = _t(spark, sf_dir)
    return t["lineitem"].count() + t["orders"].count()


def staged_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _key(spark, "billing_unified", sf_dir)
    return stage(spark, key, lambda: unified_billing(spark, sf_dir), lambda: _fact_rows(spark, sf_dir))


def staged_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _key(spark, "demand", sf_dir)
    return stage(spark, key, lambda: demand(spark, sf_dir), lambda: _fact_rows(spark, sf_dir))


def q06_billing_unified(spark, sf_dir):
    return staged_billing(spark, sf_dir)


def q07_demand(spark, sf_dir):
    return staged_demand(spark, sf_dir)


def q08_clean_keys(spark, sf_dir):
    c = _t(spark, sf_dir)["customer"]
    return c.select(
        F.col("c_custkey").alias("client_id"),
        clean_key(F.concat(F.col("c_custkey").cast("string"), F.lit(",0"))).alias("from_code"),
        clean_key(F.expr("nullif(c_name, 'Customer#000000007')")).alias("from_name"))


def q09_scope_billing(spark, sf_dir):
    return S.scope_billing(staged_billing(spark, sf_dir), SCOPE_STATE)


def q10_scope_demand(spark, sf_dir):
    b = S.scope_billing(staged_billing(spark, sf_dir), SCOPE_STATE)
    return S.scope_demand(staged_demand(spark, sf_dir), b, SCOPE_STATE)


def _client(spark, sf_dir):
    """The client reconciliation, staged: it feeds q15-q16, q18, q20 and q25."""
    return stage(spark, _key(spark, "reconcile_client", sf_dir),
                 lambda: R.reconcile_client(staged_billing(spark, sf_dir), staged_demand(spark, sf_dir)),
                 lambda: _fact_rows(spark, sf_dir))


def _supplier(spark, sf_dir):
    """The supplier reconciliation, staged: it feeds q17, q19 and q21."""
    return stage(spark, _key(spark, "reconcile_supplier", sf_dir),
                 lambda: R.reconcile_supplier(staged_billing(spark, sf_dir), staged_demand(spark, sf_dir)),
                 lambda: _fact_rows(spark, sf_dir))


def q11_reconcile_client(spark, sf_dir):
    return _client(spark, sf_dir)


def q12_reconcile_supplier(spark, sf_dir):
    return _supplier(spark, sf_dir)


def q13_branch_summary(spark, sf_dir):
    return R.branch_summary(staged_billing(spark, sf_dir))


def q14_state_summary(spark, sf_dir):
    return R.state_summary(staged_billing(spark, sf_dir))


def q15_totals(spark, sf_dir):
    return R.totals(staged_billing(spark, sf_dir), staged_demand(spark, sf_dir))


def q16_top_clients(spark, sf_dir):
    return P.top_clients(_client(spark, sf_dir))


def q17_top_suppliers(spark, sf_dir):
    return P.top_suppliers(_supplier(spark, sf_dir))


def q18_client_detail(spark, sf_dir):
    return P.client_detail(_client(spark, sf_dir))


def q19_supplier_detail(spark, sf_dir):
    return P.supplier_detail(_supplier(spark, sf_dir))


def q20_client_returns(spark, sf_dir):
    return P.client_returns(_client(spark, sf_dir))


def q21_supplier_returns(spark, sf_dir):
    return P.supplier_returns(_supplier(spark, sf_dir))


def q22_state_list(spark, sf_dir):
    return S.state_list(staged_billing(spark, sf_dir))


def q23_clients_per_state(spark, sf_dir):
    return P.clients_per_state(staged_billing(spark, sf_dir))


def q24_client_roster(spark, sf_dir):
    return P.client_roster(X.roster(_t(spark, sf_dir)), None, X.FIXTURE_STATE_MAP)


def q25_currency_report(spark, sf_dir):
    return P.currency_report(_client(spark, sf_dir))


def q26_csv_roundtrip(spark, sf_dir):
    return csv_roundtrip(staged_billing(spark, sf_dir), _key(spark, "billing_csv", sf_dir))


_layouts: dict[tuple[str, str], tuple[Layout, B.BillingTables, tuple[DataFrame, DataFrame]]] = {}


def colocated(spark: SparkSession, sf_dir: str) -> tuple[Layout, B.BillingTables, tuple[DataFrame, DataFrame]]:
    """The fact tables in buckets of the order id, written once a session and state of the input files."""
    at, app = _key(spark, "layout", sf_dir), spark.conf.get("spark.app.id", "app")
    with _lock:
        if (app, at) not in _layouts:
            t = _t(spark, sf_dir)
            with enough_partitions(spark, _fact_rows(spark, sf_dir)):  # and as many buckets, if there is no setting for them
                layout = Layout(spark)
                _layouts[app, at] = layout, B.colocate(X.billing_tables(t), layout), colocate_lines(X.demand_lines(t), X.line_orders(t), layout)
        return _layouts[app, at]


def q27_billing_lines_colocated(spark, sf_dir):
    _, b, _ = colocated(spark, sf_dir)
    return B.billing_lines(b.header, b.movements, b.clients, b.suppliers, X.FIXTURE_RULES.return_op)


def q28_demand_colocated(spark, sf_dir):
    t, (_, _, (sums, orders)) = _t(spark, sf_dir), colocated(spark, sf_dir)
    return stage(spark, _key(spark, "demand_colocated", sf_dir),
                 lambda: build_demand(orders_of_lines(sums, orders), X.demand_suppliers(t), X.demand_clients(t)),
                 lambda: _fact_rows(spark, sf_dir))


def q29_refreshed_reconciliation(spark, sf_dir):
    """The client reconciliation from the shares of hand-off files, brought up to date."""
    root = scratch_path(spark, _key(spark, "refresh", sf_dir))
    write_billing_csv(staged_billing(spark, sf_dir), f"{root}/billing")
    write_demand_csv(staged_demand(spark, sf_dir), f"{root}/demand")
    now = refresh(spark, f"{root}/billing", f"{root}/demand", f"{root}/shares")
    with enough_partitions(spark, _fact_rows(spark, sf_dir)):
        return app_run(spark).keep(R.reconcile_client(now.billing, now.demand), "refreshed")


def q30_reconcile_all_states(spark, sf_dir):
    """The client reconciliation of every state's user, in one pass."""
    b, d = T.by_scope(staged_billing(spark, sf_dir), staged_demand(spark, sf_dir))
    return T.scoped_tables(b, d)["client"].withColumn("scope", F.expr("substring(scope, 2)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items())
    if name[:1] == "q" and name[1:3].isdigit() and callable(fn)
}

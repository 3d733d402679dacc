"""The two batch extracts, end to end: source tables -> canonical inputs -> unified billing
(or demand) -> Parquet (and optionally the ';' hand-off CSV).

``tables`` maps source table names to DataFrames - from ``sources.jdbc.read_tables`` on a
live database, or Parquet copies of the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from ledgerlens.operators.billing import CAMPAIGN_RULES, BillingRules, BillingTables, build_billing
from ledgerlens.operators.demand import build_demand
from ledgerlens.operators.sinks import export, write_billing_csv, write_demand_csv
from ledgerlens.plans.observe import counted
from ledgerlens.plans.stage import Run
from ledgerlens.sources import erp


def billing_tables(tables: dict[str, DataFrame], promo_codes: DataFrame, rules: BillingRules | None = None) -> BillingTables:
    return BillingTables(
        header=erp.order_header(tables["pcpedc"], rules),
        movements=erp.movements(tables["pcmov"]),
        clients=erp.clients(tables["pcclient"]),
        suppliers=erp.suppliers(tables["pcfornec"]),
        promo_codes=promo_codes)


def billing_extract(tables: dict[str, DataFrame], promo_codes: DataFrame, out_path: str,
                    rules: BillingRules = CAMPAIGN_RULES, csv_path: str | None = None) -> dict:
    """Write the unified billing as Parquet (+ CSV); return the observed row counts."""
    spark = promo_codes.sparkSession
    run, extracts, after = Run(spark), Observation("billing_extracts"), Observation("billing_unified")
    try:
        written = export(build_billing(billing_tables(tables, promo_codes, rules), rules, after, extracts, run.keep), out_path)
    finally:
        run.remove()
    counts = {**extracts.get, **after.get}
    if csv_path:
        write_billing_csv(spark.read.parquet(written), csv_path)
    return counts


def demand_extract(tables: dict[str, DataFrame], out_path: str, csv_path: str | None = None) -> dict:
    """Write the demand table as Parquet (+ the ';' hand-off CSV with upstream headers); return its row count."""
    demand, obs = counted(build_demand(erp.portal_orders(tables["pedido"]),
                                       erp.portal_suppliers(tables["fornecedor"]),
                                       erp.portal_clients(tables["cliente"])), "demand_extract")
    written = export(demand, out_path)
    counts = {"demand_rows": obs.get["rows"]}
    if csv_path:
        write_demand_csv(demand.sparkSession.read.parquet(written), csv_path)
    return counts

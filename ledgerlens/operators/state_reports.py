"""The reports of all regional users from one pass over the billing and the demand.

A user sees one state: its billing, and the demand of the clients billed in it. Scoping each user by itself reads both
inputs once for each user. Here every row is marked with the scopes that see it - a billing row with its state, a demand
row with each state that its client was billed in - and the tables behind the reports are grouped by the scope, too. They
are published as one version, partitioned by scope, so that a user's reports read that user's files only.

A scope is a state in upper case; rows without a state are in no scope. The mark of a scope begins with a letter, so
that neither a blank state nor one that looks like a number becomes another partition value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_key
from ledgerlens.operators.reconcile import branch_summary, reconcile_client, reconcile_supplier, state_summary, totals
from ledgerlens.operators.report_set import reports_of
from ledgerlens.operators.scope import is_unrestricted
from ledgerlens.plans.broadcast import broadcast_if_bounded
from ledgerlens.plans.publish import publish, resolve
from ledgerlens.plans.stage import Run

SCOPE = "scope"
_WITHIN = (SCOPE,)
_KINDS = {
    "client": "client_key string, client_name string, ordered double, billed double, returned double, flow_diff double, net_billed double",
    "supplier": "supplier_key string, supplier_name string, ordered double, billed double, returned double, flow_diff double",
    "branch": "branch_id string, billed double, returned double, net_billed double, ordered double, flow_diff double",
    "state": "state string, billed double, returned double, net_billed double, ordered double, flow_diff double",
    "totals": "ordered double, billed double, returned double, flow_diff double",
    "clients": "clients long",
}


def scope_mark(state: Column) -> Column:
    return F.concat(F.lit("s"), F.upper(state))


def by_scope(billing: DataFrame, demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both inputs with the scope that sees a row; a demand row once for each scope that does."""
    b = billing.where(F.col("state").isNotNull()).withColumn(SCOPE, scope_mark(F.col("state")))
    seen = broadcast_if_bounded(b.select(SCOPE, clean_key("client_key").alias("_k")).distinct())
    d = demand.withColumn("_k", clean_key("client_key")).join(seen, "_k").drop("_k")
    return b, d


def scoped_tables(billing: DataFrame, demand: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the reports, of every scope, from inputs that ``by_scope`` has marked."""
    return {
        "client": reconcile_client(billing, demand, _WITHIN),
        "supplier": reconcile_supplier(billing, demand, _WITHIN),
        "branch": branch_summary(billing, _WITHIN),
        "state": state_summary(billing, within=_WITHIN),
        "totals": totals(billing, demand, _WITHIN),
        "clients": billing.groupBy(SCOPE).agg(F.countDistinct(clean_key("client_key")).alias("clients")),
    }


def publish_state_reports(billing: DataFrame, demand: DataFrame, path: str) -> str:
    """Write the tables of all scopes as one version of ``path``; returns its folder.

    The marked inputs are staged once, partitioned by scope, and all tables are made of that."""
    run = Run(billing.sparkSession)
    try:
        b, d = (run.keep(x, name) for x, name in zip(by_scope(billing, demand), ("billing", "demand")))

        def write(folder: str) -> None:
            for name, table in scoped_tables(b, d).items():
                # Small files of one scope go together, a large scope is split.
                table.hint("rebalance", SCOPE).write.partitionBy(SCOPE).parquet(f"{folder}/{name}")

        return publish(billing.sparkSession, path, write)
    finally:
        run.remove()


def state_reports(spark: SparkSession, path: str, state: str, roster: DataFrame | None = None,
                  state_map: dict[str, str] | None = None, display: bool = False) -> dict[str, DataFrame]:
    """One state's reports out of the last version: those of ``report_set(billing, demand, state)``, from that state's files."""
    if is_unrestricted(state):
        raise ValueError("the reports of all states together are report_set's")
    folder, mark = resolve(spark, path), f"s{str(state).upper()}"

    def own(name: str) -> DataFrame:
        df = spark.read.schema(f"{_KINDS[name]}, {SCOPE} string").parquet(f"{folder}/{name}")
        return df.where(F.col(SCOPE) == mark).drop(SCOPE)

    zero = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in df.dtypes])
    clients = zero(own("clients"))
    tables = {name: own(name) for name in ("client", "supplier", "branch", "state")}
    tables |= {"totals": zero(own("totals")), "clients_in_scope": clients, "clients_per_state": clients.select(F.lit(str(state)).alias("state"), "clients")}
    offered = spark.range(1).select(F.lit(str(state)).alias("state"), F.lit(1).alias("pos"))
    return reports_of(tables, offered, state, roster, state_map, display)

"""Reports over the reconciliation tables: rankings, detail, returns, counts, roster, currency text.

Sorted reports always carry a unique tie-breaker (the key) so equal measures come out in a
stable order. Top-N uses ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own n best rows, only those reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions.money import format_brl
from ledgerlens.functions.text import clean_key, norm_text
from ledgerlens.operators.scope import ALL_STATES, is_unrestricted
from ledgerlens.schemas import ROSTER_HEADERS

TOP_N = 10  # fixed value: depth of both rankings


def top_clients(client: DataFrame, n: int = TOP_N) -> DataFrame:
    """q16: clients with positive net billed, largest first."""
    return (client.where(F.col("net_billed") > 0)
            .orderBy(F.col("net_billed").desc_nulls_last(), F.col("client_key").asc())
            .limit(n).select("client_name", "client_key", "net_billed"))


def top_suppliers(supplier: DataFrame, n: int = TOP_N) -> DataFrame:
    """q17: suppliers with positive billed, largest first."""
    return (supplier.where(F.col("billed") > 0)
            .orderBy(F.col("billed").desc_nulls_last(), F.col("supplier_key").asc())
            .limit(n).select("supplier_name", "supplier_key", "billed"))


def client_detail(client: DataFrame) -> DataFrame:
    """q18: every client by flow difference, largest first."""
    return (client.select("client_name", "client_key", "ordered", "billed", "returned",
                          "flow_diff", "net_billed")
            .orderBy(F.col("flow_diff").desc_nulls_last(), F.col("client_key").asc()))


def supplier_detail(supplier: DataFrame) -> DataFrame:
    """q19: every supplier by flow difference, largest first."""
    return (supplier.select("supplier_name", "supplier_key", "ordered", "billed", "returned", "flow_diff")
            .orderBy(F.col("flow_diff").desc_nulls_last(), F.col("supplier_key").asc()))


def client_returns(client: DataFrame) -> DataFrame:
    """q20: clients with returns, largest first."""
    return (client.where(F.col("returned") > 0)
            .orderBy(F.col("returned").desc_nulls_last(), F.col("client_name").asc_nulls_last(),
                     F.col("client_key").asc())
            .select("client_name", "returned"))


def supplier_returns(supplier: DataFrame) -> DataFrame:
    """q21: suppliers with returns, largest first."""
    return (supplier.where(F.col("returned") > 0)
            .orderBy(F.col("returned").desc_nulls_last(), F.col("supplier_name").asc_nulls_last(),
                     F.col("supplier_key").asc())
            .select("supplier_name", "returned"))


def branch_report(branch: DataFrame) -> DataFrame:
    """Branches by net billed, largest first."""
    return branch.orderBy(F.col("net_billed").desc_nulls_last(), F.col("branch_id").asc())


def state_report(state: DataFrame) -> DataFrame:
    """States by net billed, largest first."""
    return state.orderBy(F.col("net_billed").desc_nulls_last(), F.col("state").asc())


def clients_per_state(billing: DataFrame, override: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """q23: distinct clients (cleaned keys, as everywhere) per state, plus a 'Todos' row counting
    distinct clients overall.

    The overall count is its own distinct count (a client billed in two states counts
    once), so it can be below the sum of the state rows. Both are two-phase distinct
    aggregations: (state, client) pairs are de-duplicated map-side before any exchange.

    ``override`` (state, clients): a maintained table of client counts used instead of the
    computed ones; its 'Todos' row is then the sum of its states.

    ``state``: a restricted user's; there is one row then, for that state, counted over all its
    spellings, and no row that tells of others.
    """
    if not is_unrestricted(state):
        own = F.upper(F.col("state")) == F.lit(str(state).upper())
        counted = (override.where(own).agg(F.coalesce(F.sum("clients"), F.lit(0)).cast("long").alias("clients")) if override is not None
                   else clients_in_scope(billing.where(own)))
        return counted.select(F.lit(str(state)).alias("state"), "clients")
    if override is not None:
        o = override.select(F.col("state").cast("string"), F.col("clients").cast("long"))
        total = o.agg(F.coalesce(F.sum("clients"), F.lit(0)).alias("clients")).select(
            F.lit(ALL_STATES).alias("state"), "clients")
        return o.unionByName(total)
    key = F.countDistinct(clean_key("client_key")).alias("clients")
    per_state = billing.where(F.col("state").isNotNull()).groupBy("state").agg(key)
    overall = billing.agg(key).select(
        F.lit(ALL_STATES).alias("state"), "clients")
    return per_state.unionByName(overall)


def clients_shown(counts: DataFrame, state: str | None) -> DataFrame:
    """The client count shown for a scope, out of ``clients_per_state`` for that scope: the 'Todos' row
    when unrestricted, else the chosen state's row (any case), 0 when the state has none. One row:
    clients. (Rows of several spellings are added: right for a maintained table; for computed
    counts pass the state to ``clients_per_state``.)"""
    key = ALL_STATES if is_unrestricted(state) else str(state)
    hit = counts.where(F.upper(F.col("state")) == F.lit(key.upper()))
    return hit.agg(F.coalesce(F.sum("clients"), F.lit(0)).cast("long").alias("clients"))


def clients_in_scope(scoped_billing: DataFrame) -> DataFrame:
    """Distinct clients a scoped user sees (one row; 0 when the scope has no billing)."""
    return scoped_billing.agg(F.countDistinct(clean_key("client_key")).alias("clients"))


def clients_label(state: str | None) -> str:
    """The label of the client count (fixed values)."""
    return "Total Clientes (Brasil)" if is_unrestricted(state) else f"Clientes Únicos ({str(state).upper()})"


def client_roster(roster: DataFrame, state: str | None, state_map: dict[str, str]) -> DataFrame:
    """q24: the client roster - headers stripped and upper-cased, state normalised (strip, upper,
    alias map; unknown values pass, NULL stays NULL), scoped, projected to the wanted columns
    that exist, renamed to canonical names; money as double.
    """
    df = roster.toDF(*[str(c).strip().upper() for c in roster.columns])
    if "ESTADO" in df.columns:
        df = df.withColumn("ESTADO", norm_text("ESTADO"))
        if state_map:
            df = df.replace({k.strip().upper(): v for k, v in state_map.items()}, subset=["ESTADO"])
    if not is_unrestricted(state):
        df = df.where(F.col("ESTADO") == F.lit(str(state).strip().upper()))
    wanted = [c for c in ROSTER_HEADERS if c in df.columns]
    out = []
    for c in wanted:
        name = ROSTER_HEADERS[c]
        col = F.col(f"`{c}`")
        if c not in ("ESTADO", "COD", "RAZAO"):
            col = col.cast(DoubleType())
        out.append(col.alias(name))
    return df.select(*out)


def currency_report(client: DataFrame) -> DataFrame:
    """q25: the client flow difference as Brazilian currency text."""
    return client.select("client_key", format_brl(F.col("flow_diff")).alias("flow_diff_text"))


def for_display(df: DataFrame, labels: dict[str, str], money: list[str] = ()) -> DataFrame:
    """Presentation edge: money columns as currency text, columns renamed to display labels."""
    cols = []
    for c in df.columns:
        col = format_brl(F.col(c)) if c in money else F.col(c)
        cols.append(col.alias(labels.get(c, c)))
    return df.select(*cols)


# Display headers of the report tables.
CLIENT_LABELS = {"client_name": "Cliente", "client_key": "CNPJ", "ordered": "Valor Pedido",
                 "billed": "Valor Faturado", "returned": "Valor Devolvido", "flow_diff": "Diferença Fluxo",
                 "net_billed": "Receita Líquida"}
SUPPLIER_LABELS = {"supplier_name": "Fornecedor", "supplier_key": "CNPJ", "ordered": "Valor Pedido",
                   "billed": "Valor Faturado", "returned": "Valor Devolvido", "flow_diff": "Diferença Fluxo"}
BRANCH_LABELS = {"branch_id": "FILIAL", "billed": "VALOR_FATURADO", "returned": "VALOR_DEVOLVIDO",
                 "net_billed": "VALOR_LIQUIDO_FATURADO"}
ROSTER_LABELS = {name: header for header, name in ROSTER_HEADERS.items()}
STATE_LABELS = {"state": "ESTADO", "billed": "VALOR_FATURADO", "returned": "VALOR_DEVOLVIDO",
                "net_billed": "VALOR_LIQUIDO_FATURADO"}

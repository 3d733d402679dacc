"""Column mapping of the billing ERP and order portal tables onto the canonical inputs.

The functions take DataFrames (from ``sources.jdbc.read_tables``, or Parquet copies of the
same tables), filter the raw columns, then rename and cast: a filter above a cast of a NUMBER
column would not be pushed to the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import MONEY
from ledgerlens.operators.billing import BillingRules, date_window


def _is_one_of(column: str, values: tuple | None):
    return F.lit(True) if values is None else F.col(column).isin(list(values)) if len(values) > 1 else F.col(column) == values[0]


def order_header(pcpedc: DataFrame, rules: BillingRules | None = None) -> DataFrame:
    """``rules``: keep only orders that the window or the status of the promotion rule may let in."""
    if rules is not None:
        window = (date_window(rules, "data") & _is_one_of("posicao", rules.statuses) & _is_one_of("tipofv", rules.sale_types)
                  & _is_one_of("origemped", rules.origins) & _is_one_of("codemitente", rules.issuers))
        promo = _is_one_of("posicao", rules.promo_statuses) & F.col("codpromocaomed").isNotNull()
        pcpedc = pcpedc.where(window | promo)
    return pcpedc.select(
        F.col("codfilial").cast("string").alias("branch_id"),
        F.col("numped").cast("long").alias("order_id"),
        F.col("codcli").cast("long").alias("order_client_id"),
        F.col("vlatend").cast(MONEY).alias("billed"),
        F.col("data").alias("order_date"),
        F.col("posicao").alias("status"),
        F.col("tipofv").alias("sale_type"),
        F.col("origemped").alias("origin"),
        F.col("codemitente").cast("long").alias("issuer_id"),
        F.col("codpromocaomed").cast("long").alias("promo_code"))


def movements(pcmov: DataFrame) -> DataFrame:
    return pcmov.where((F.col("numped") != 0) & (F.col("codfornec") != 0)).select(
        F.col("numped").cast("long").alias("order_id"),
        F.col("codfornec").cast("long").alias("supplier_key"),
        F.col("codoper").alias("op_code"),
        (F.col("punit").cast("decimal(18,6)") * F.col("qt").cast("decimal(18,6)")).alias("value"))


def clients(pcclient: DataFrame) -> DataFrame:
    return pcclient.select(
        F.col("codcli").cast("long").alias("client_id"),
        F.col("codcliprinc").cast("string").alias("client_key"),
        F.col("cliente").alias("client_name"),
        F.col("estent").alias("state"))


def suppliers(pcfornec: DataFrame) -> DataFrame:
    return pcfornec.select(F.col("codfornec").cast("long").alias("supplier_key"),
                           F.col("fornecedor").alias("supplier_name"))


def promo_codes_from_list(spark, codes) -> DataFrame:
    """A promotion table from a list of codes (keep long lists in a table, not in code)."""
    return spark.createDataFrame([(int(c),) for c in codes], "promo_code long")


def portal_orders(pedido: DataFrame) -> DataFrame:
    return pedido.select(
        F.col("num_ped").cast("long").alias("order_id"),
        F.col("fornecedor_id").cast("long").alias("supplier_id"),
        F.col("cliente_id").cast("long").alias("client_id"),
        F.col("valor_total").cast(MONEY).alias("value"))


def portal_suppliers(fornecedor: DataFrame) -> DataFrame:
    return fornecedor.select(F.col("id").cast("long").alias("supplier_id"),
                             F.col("id").cast("string").alias("supplier_key"),
                             F.col("nome_fantasia").alias("supplier_name"))


def portal_clients(cliente: DataFrame) -> DataFrame:
    return cliente.select(F.col("id").cast("long").alias("client_id"),
                          F.col("cod_cli_princ").cast("string").alias("client_key"),
                          F.col("nome_fantasia").alias("client_name"),
                          F.col("estado").alias("state"))

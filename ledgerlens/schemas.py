"""Canonical column names and the explicit schemas used at the edges.

Canonical inputs (every source is mapped onto these; see ``ledgerlens.sources``):

billing side
  order header : branch_id, order_id, order_client_id, billed, order_date, status, sale_type,
                 promo_code [, origin, issuer_id]
  movement     : order_id, supplier_key, op_code, value          (value = unit price x quantity)
  client       : client_id, client_key, client_name, state       (client_key = principal code)
  supplier     : supplier_key, supplier_name
  promo codes  : promo_code
demand side
  demand order : order_id, supplier_id, client_id, value
  d. supplier  : supplier_id, supplier_key, supplier_name
  d. client    : client_id, client_key, client_name, state

Derived tables
  billing lines / unified billing : branch_id, order_id, supplier_key, supplier_name, client_key,
                                    client_name, client_id, state, billed, returned (+ status,
                                    sale_type, order_date, promo_code on billing lines)
  demand                          : supplier_name, supplier_key, client_name, client_key, state,
                                    ordered, order_count
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 2)

UNIFIED_COLUMNS = [
    "branch_id", "order_id", "supplier_key", "supplier_name", "client_key",
    "client_name", "client_id", "state", "billed", "returned",
]
LINE_COLUMNS = UNIFIED_COLUMNS + ["status", "sale_type", "order_date", "promo_code"]
DEMAND_COLUMNS = [
    "supplier_name", "supplier_key", "client_name", "client_key", "state", "ordered", "order_count",
]

# Hand-off files. Party keys are text, never numbers: a key read as a double prints as
# 1.234567800019E13 and is then corrupted by digit stripping.
BILLING_FILE_SCHEMA = StructType([
    StructField("branch_id", StringType()),
    StructField("order_id", LongType()),
    StructField("supplier_key", StringType()),
    StructField("supplier_name", StringType()),
    StructField("client_key", StringType()),
    StructField("client_name", StringType()),
    StructField("client_id", LongType()),
    StructField("state", StringType()),
    StructField("billed", MONEY),
    StructField("returned", MONEY),
])

DEMAND_FILE_SCHEMA = StructType([
    StructField("supplier_name", StringType()),
    StructField("supplier_key", StringType()),
    StructField("client_name", StringType()),
    StructField("client_key", StringType()),
    StructField("state", StringType()),
    StructField("ordered", MONEY),
    StructField("order_count", LongType()),
])

# Header names of the two hand-off files as the extracts write them
# (upper-cased on read), mapped to canonical names.
BILLING_FILE_HEADERS = {
    "CODFILIAL": "branch_id",
    "NUMPED": "order_id",
    "CNPJ_FORNECEDOR": "supplier_key",
    "FORNECEDOR": "supplier_name",
    "CNPJ_CLIENTE": "client_key",
    "CLIENTE": "client_name",
    "ESTADO": "state",
    "TOTAL_FATURADO": "billed",
    "VALOR_DEVOLVIDO": "returned",
}
DEMAND_FILE_HEADERS = {
    "FORNECEDOR_NOME": "supplier_name",
    "FORNECEDOR_CNPJ": "supplier_key",
    "CLIENTE_NOME": "client_name",
    "CLIENTE_CNPJ": "client_key",
    "ESTADO": "state",
    "TOTAL_VALOR_PEDIDO": "ordered",
    "TOTAL_PEDIDOS_QTD": "order_count",
}

# Roster (a spreadsheet upstream; CSV or Parquet here). The wanted headers.
ROSTER_HEADERS = {
    "ESTADO": "state",
    "COD": "code",
    "RAZAO": "legal_name",
    "TOTAL_GASTO": "total_spent",
    **{str(m): f"m{m}" for m in range(1, 10)},
}

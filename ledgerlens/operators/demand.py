"""Demand: ordered value and order count by supplier x client x state (q07).

The straightforward plan joins every order row to supplier and client and then groups by
five text columns. Here the order rows are first aggregated by (supplier id, client id) -
map-side partial aggregation, so a hot supplier or client shrinks before the shuffle - and
only the aggregated pairs meet the dimensions. Sum and count distribute over the inner joins
(each aggregated pair meets exactly the dimension rows its order rows would have met), so a
final group-by over the five output keys gives the same rows. Where the dimensions are measured to have one row for
each id, and one id for each of their keys, every pair is an output row already and that group-by, a shuffle of five
text columns, is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import to_money
from ledgerlens.plans.broadcast import broadcast_if_bounded
from ledgerlens.plans.layout import Layout

DEMAND_KEYS = ["supplier_name", "supplier_key", "client_name", "client_key", "state"]


def line_sums(lines: DataFrame) -> DataFrame:
    """Order lines (order_id, supplier_id, value) summed up by order and supplier, with their number in ``order_count``."""
    return lines.groupBy("order_id", "supplier_id").agg(F.sum("value").alias("value"), F.count("order_id").alias("order_count"))


def orders_of_lines(sums: DataFrame, orders: DataFrame) -> DataFrame:
    """The demand's order rows from line sums and orders (order_id, client_id): sum and count distribute over this join,
    so no raw line is shuffled; in buckets of the order id (``colocate``) nothing is."""
    return sums.join(orders, "order_id", "inner").select("order_id", "supplier_id", "client_id", "value", "order_count")


def colocate(lines: DataFrame, orders: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Line sums and orders in buckets of the order id, for ``orders_of_lines``."""
    return layout.write(line_sums(lines), "lines", "order_id"), layout.write(orders, "line_orders", "order_id")


def build_demand(orders: DataFrame, suppliers: DataFrame, clients: DataFrame) -> DataFrame:
    """orders(order_id, supplier_id, client_id, value) x suppliers x clients -> demand table.

    Order rows may come summed up already, with the number of rows in ``order_count``.
    """
    n = F.sum("order_count") if "order_count" in orders.columns else F.count("order_id")
    pairs = orders.groupBy("supplier_id", "client_id").agg(F.sum("value").alias("_v"), n.alias("_n"))
    sup = suppliers.select("supplier_id", "supplier_key", "supplier_name")
    cli = clients.select("client_id", "client_key", "client_name", "state")
    # Clients first: if they are too many for a broadcast, the pairs are shuffled without texts.
    joined = pairs.join(broadcast_if_bounded(cli), "client_id", "inner").join(broadcast_if_bounded(sup), "supplier_id", "inner")
    if _one_to_one(sup, "supplier_id") and _one_to_one(cli, "client_id"):
        return joined.select(*DEMAND_KEYS, to_money(F.col("_v")).alias("ordered"), F.col("_n").alias("order_count"))
    return (joined.groupBy(*DEMAND_KEYS)
            .agg(to_money(F.sum("_v")).alias("ordered"), F.sum("_n").alias("order_count")))


def _one_to_one(dimension: DataFrame, id_col: str) -> bool:
    """Whether each id has one row, and no other id has that row's values; rows without an id are never joined."""
    rows = dimension.where(F.col(id_col).isNotNull())
    values = [c for c in dimension.columns if c != id_col]
    again = [rows.groupBy(*keys).count().where("count > 1").select(F.lit(1)) for keys in ([id_col], values)]
    return again[0].union(again[1]).isEmpty()

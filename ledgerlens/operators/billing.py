"""Billing: order suppliers, returns, billing lines, campaign window, promotion, unified table.

Plan shape (what scales):

* Movements are reduced *before* any join: one (order, supplier) hash aggregate with a map-side
  partial phase carries the pair's return value, so an order or supplier holding a third of
  all movement rows collapses to a handful of rows before the exchange; the per-order return
  total is a window sum over the order partitioning that the header join then reuses. One
  scan of the movements feeds both.
* The order header is filtered first (window / status / sale type are pushed into the
  Parquet scan). The surviving campaign order ids filter the movements map-side before these
  are aggregated: a broadcast of few ids, of the ids' bits if they are many - never a raw-row
  shuffle by order.
* Dimensions (clients, suppliers, promotion codes) are broadcast only behind a checked row
  bound (``plans.broadcast``); above it they are shuffle-joined.
* The qualifying header of the unified table is built once: a read with the window rule pushed
  down, and one with the promotion rule for the rest, carry ``src_priority`` 0/1; then a keep-first
  ``row_number`` per 4-key (planned as a ``WindowGroupLimit`` on the order-id partitioning
  the join already provides - no extra exchange) removes the duplicates. This equals "union
  both extracts, keep the window row on duplicates" without computing the joins twice.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import to_money
from ledgerlens.plans.broadcast import broadcast_if_bounded
from ledgerlens.plans.layout import Layout
from ledgerlens.plans.runtime_filter import only
from ledgerlens.plans.stage import app_run
from ledgerlens.schemas import LINE_COLUMNS, UNIFIED_COLUMNS


@dataclass(frozen=True)
class BillingRules:
    """Which orders enter the billing extracts.

    A ``None`` rule is not applied. Dates are 'dd/mm/yyyy' or ISO 'yyyy-mm-dd', with a time of day
    ('hh:mm:ss') or without; anything else is an error. The window is closed. A last day without a
    time ends at its midnight (later times that day are out) unless ``end_inclusive_day`` is set:
    then the whole day is in.
    """

    window_start: str
    window_end: str
    statuses: tuple | None = ("F",)
    sale_types: tuple | None = ("OL",)
    origins: tuple | None = ("F",)
    issuers: tuple | None = (8888,)
    promo_statuses: tuple | None = ("F",)
    return_op: str = "ED"
    end_inclusive_day: bool = False


# The campaign rules of the original extract (10-day window, position 'F',
# sale type 'OL', origin 'F', issuer 8888, return operation 'ED').
CAMPAIGN_RULES = BillingRules(window_start="12/04/2025", window_end="21/04/2025")


_MOMENTS = [f"{day}{time}" for day in ("%d/%m/%Y", "%Y-%m-%d") for time in ("", " %H:%M", " %H:%M:%S", "T%H:%M:%S", " %H:%M:%S.%f")]


def parse_moment(text: str) -> _dt.datetime:
    """A day, or a day with a time of day; ValueError for anything else."""
    for form in _MOMENTS:
        try:
            return _dt.datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"neither 'dd/mm/yyyy' nor 'yyyy-mm-dd', with or without 'hh:mm:ss': {text!r}")


def _ts_literal(moment: str | _dt.datetime) -> Column:
    d = parse_moment(moment) if isinstance(moment, str) else moment
    # timestamp_ntz literal: compares with a timestamp_ntz column without a cast on the
    # column, so the range reaches the Parquet scan as a pushed filter.
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def date_window(rules: BillingRules, column: str = "order_date") -> Column:
    """The closed window; with ``end_inclusive_day`` a last day without a time of day counts whole."""
    end = parse_moment(rules.window_end)
    if rules.end_inclusive_day and end.time() == _dt.time():
        return (F.col(column) >= _ts_literal(rules.window_start)) & (F.col(column) < _ts_literal(end + _dt.timedelta(days=1)))
    return F.col(column).between(_ts_literal(rules.window_start), _ts_literal(end))


def _isin(col: str, values: tuple | None) -> Column | None:
    if values is None:
        return None
    return F.col(col) == F.lit(values[0]) if len(values) == 1 else F.col(col).isin(list(values))


def _all(preds: list[Column | None]) -> Column:
    out = F.lit(True)
    for p in preds:
        if p is not None:
            out = out & p
    return out


def window_predicate(rules: BillingRules) -> Column:
    """Window extract rule: closed date range + status, sale type, origin, issuer."""
    return _all([
        date_window(rules),
        _isin("status", rules.statuses),
        _isin("sale_type", rules.sale_types),
        _isin("origin", rules.origins),
        _isin("issuer_id", rules.issuers),
    ])


def promo_status_predicate(rules: BillingRules) -> Column:
    return _all([_isin("status", rules.promo_statuses)])


def valid_movements(movements: DataFrame) -> DataFrame:
    """Movements with a real order and supplier (0 is the 'none' sentinel; NULL fails too)."""
    return movements.where((F.col("order_id") != 0) & (F.col("supplier_key") != 0))


def order_suppliers(movements: DataFrame, suppliers: DataFrame) -> DataFrame:
    """q01: distinct (order, supplier) pairs of valid movements, with the supplier name.

    Pairs are made distinct first (partial + final aggregate), then the names are attached:
    the same rows as grouping the joined movement x supplier rows, at a fraction of the
    shuffle.
    """
    pairs = valid_movements(movements).select("order_id", "supplier_key").distinct()
    names = suppliers.select("supplier_key", "supplier_name").distinct()
    return (pairs.join(broadcast_if_bounded(names), "supplier_key", "left")
            .select("order_id", "supplier_key", "supplier_name"))


def returns_by_order(movements: DataFrame, return_op: str) -> DataFrame:
    """q02: returned value per order = sum(unit price x quantity) of return movements."""
    return (valid_movements(movements)
            .where(F.col("op_code") == F.lit(return_op))
            .groupBy("order_id")
            .agg(to_money(F.sum("value")).alias("returned")))


def billing_lines(header: DataFrame, movements: DataFrame, clients: DataFrame,
                  suppliers: DataFrame, return_op: str, campaign_slice: bool = False,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """q03: one row per (order, supplier of the order) with client, state, billed and returned.

    The order total is repeated on every supplier row of the order (the extract's fan-out);
    orders without movements keep one row with NULL supplier.

    ``campaign_slice``: the header was filtered to a campaign. Its order ids first filter the
    movements *map-side* (``plans.runtime_filter``: a range pushed into the scan, then a broadcast of
    the ids or of their bits), so that the aggregates read the campaign's movements only.
    ``carry``: extra header columns to keep.
    """
    if campaign_slice:
        movements = only(movements, header.select("order_id"), "order_id")
    party = broadcast_if_bounded(
        clients.select("client_id", "client_key", "client_name", "state"))
    with_client = (header
                   .join(party, header["order_client_id"] == party["client_id"], "left")
                   .drop("order_client_id"))
    return (with_client
            .join(order_supplier_lines(movements, suppliers, return_op), "order_id", "left")
            .select(*LINE_COLUMNS, *carry))


def order_supplier_lines(movements: DataFrame, suppliers: DataFrame, return_op: str) -> DataFrame:
    """One row per (order, supplier) of valid movements with the supplier name and the order's
    returned value - q01 and q02 from a single scan of the movements.

    The (order, supplier) aggregate (map-side partial, so a hot order or supplier is reduced
    before its exchange) carries the pair's return value; the order's total is a window sum
    over ``order_id``, whose partitioning the following join on ``order_id`` reuses.
    """
    pairs = (valid_movements(movements).groupBy("order_id", "supplier_key")
             .agg(F.sum(F.when(F.col("op_code") == F.lit(return_op), F.col("value"))).alias("_ret")))
    names = broadcast_if_bounded(suppliers.select("supplier_key", "supplier_name").distinct())
    per_order = Window.partitionBy("order_id")
    # the window runs before the name join: a key with two names must not count twice
    return (pairs.withColumn("returned", to_money(F.sum("_ret").over(per_order)))
            .join(names, "supplier_key", "left")
            .select("order_id", "supplier_key", "supplier_name", "returned"))


Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def billing_window(header, movements, clients, suppliers, rules: BillingRules, keep: Keep = _as_is) -> DataFrame:
    """q04: billing lines of orders inside the campaign window and order-class rules.

    ``keep`` (here and below) stages the qualifying header, which the bound check, the filter of
    the movements and the join read: ``plans.stage.Run.keep``. A live source is then read once.
    """
    hdr = keep(header.where(window_predicate(rules)), "header")
    return billing_lines(hdr, movements, clients, suppliers, rules.return_op, campaign_slice=True)


def _promo_keys(promo_codes: DataFrame) -> DataFrame:
    return broadcast_if_bounded(promo_codes.select("promo_code").where(F.col("promo_code").isNotNull())
                                .distinct())


def billing_promo(header, movements, clients, suppliers, promo_codes, rules: BillingRules, keep: Keep = _as_is) -> DataFrame:
    """q05: billing lines of orders whose promotion code is in the promotion table (status rule only)."""
    hdr = keep(header.where(promo_status_predicate(rules))
               .join(_promo_keys(promo_codes), "promo_code", "left_semi"), "header")
    return billing_lines(hdr, movements, clients, suppliers, rules.return_op, campaign_slice=True)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per ``keys`` (NULL equals NULL) under ``order``; ties must be broken by the caller."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


DEDUP_KEYS = ["branch_id", "order_id", "client_key", "supplier_key"]


def unify_extracts(window_lines: DataFrame, promo_lines: DataFrame) -> DataFrame:
    """Union two separately produced extracts by column name (missing columns become NULL) and
    keep, per 4-key, the window extract's row (NULL keys equal each other).

    Use this when the two extracts arrive as separate tables; ``billing_unified`` does the
    same from the base tables in one pass.
    """
    tagged = (window_lines.withColumn("src_priority", F.lit(0))
              .unionByName(promo_lines.withColumn("src_priority", F.lit(1)), allowMissingColumns=True))
    order = [F.col("src_priority").asc()]
    if "client_id" in tagged.columns:
        order.append(F.col("client_id").asc_nulls_last())
    cols = [c for c in UNIFIED_COLUMNS if c in tagged.columns]
    return dedupe_keep_first(tagged, DEDUP_KEYS, order).select(*cols)


def campaign_header(header: DataFrame, promo_codes: DataFrame, rules: BillingRules) -> DataFrame:
    """Orders that either rule lets in, once each, with ``in_window``, ``in_promo`` and ``src_priority``.

    Two filtered reads, so that each pushes its own conditions into the scan (the date range and
    the order class; the status): an OR of both rules would push the status only.
    """
    keys = _promo_keys(promo_codes)
    in_window = window_predicate(rules)
    flag = keys.withColumn("_promo", F.lit(True))
    by_window = (header.where(in_window).join(flag, "promo_code", "left")
                 .withColumn("in_promo", promo_status_predicate(rules) & F.col("_promo").isNotNull()).drop("_promo")
                 .withColumn("in_window", F.lit(True)).withColumn("src_priority", F.lit(0)))
    by_promo = (header.where(promo_status_predicate(rules)).where(~F.coalesce(in_window, F.lit(False)))
                .join(keys, "promo_code", "left_semi")
                .withColumn("in_promo", F.lit(True)).withColumn("in_window", F.lit(False)).withColumn("src_priority", F.lit(1)))
    return by_window.unionByName(by_promo)


def billing_unified(header, movements, clients, suppliers, promo_codes, rules: BillingRules,
                    observation=None, extract_observation=None, keep: Keep = _as_is) -> DataFrame:
    """q06: window extract + promotion extract, the window row kept when both hold a 4-key."""
    hdr = keep(campaign_header(header, promo_codes, rules), "header")
    lines = billing_lines(hdr, movements, clients, suppliers, rules.return_op,
                          campaign_slice=True, carry=("src_priority", "in_window", "in_promo"))
    count_if = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    if extract_observation is not None:
        lines = lines.observe(
            extract_observation, count_if("in_window").alias("window_rows"), count_if("in_promo").alias("promo_rows"),
            (count_if("in_window") + count_if("in_promo")).alias("union_rows"))
    unified = dedupe_keep_first(
        lines, DEDUP_KEYS,
        [F.col("src_priority").asc(), F.col("client_id").asc_nulls_last(), F.col("supplier_name").asc_nulls_last()])
    if observation is not None:
        unified = unified.observe(observation, F.count(F.lit(1)).alias("unified_rows"))
    return unified.select(*UNIFIED_COLUMNS)


@dataclass(frozen=True)
class BillingTables:
    """Canonical billing inputs (see ``ledgerlens.schemas``)."""

    header: DataFrame
    movements: DataFrame
    clients: DataFrame
    suppliers: DataFrame
    promo_codes: DataFrame


def movement_sums(movements: DataFrame) -> DataFrame:
    """Movements summed up by order, supplier and operation: all that the billing operators ask of them. A hot order, or
    supplier, is combined in tasks before the exchange and keeps a row for each of its suppliers and operations."""
    return movements.groupBy("order_id", "supplier_key", "op_code").agg(F.sum("value").alias("value"))


def colocate(tables: BillingTables, layout: Layout) -> BillingTables:
    """The same tables with the orders and the movement sums in buckets of the order id: q01 to q06 then aggregate and
    join them without an exchange."""
    return replace(tables, header=layout.write(tables.header, "orders", "order_id"),
                   movements=layout.write(movement_sums(tables.movements), "movements", "order_id"))


def build_billing(tables: BillingTables, rules: BillingRules = CAMPAIGN_RULES, observation=None,
                  extract_observation=None, keep: Keep | None = None) -> DataFrame:
    """The unified billing table from the base tables.

    With no extra job, ``extract_observation`` (a ``pyspark.sql.Observation``) receives the rows of
    the window extract, of the promotion extract and of both together, before de-duplication;
    ``observation`` the unified rows. The qualifying header is staged under the session's shared
    folder (``plans.stage.forget`` removes it), unless ``keep`` says otherwise.
    """
    keep = keep or app_run(tables.header.sparkSession).keep
    return billing_unified(tables.header, tables.movements, tables.clients, tables.suppliers,
                           tables.promo_codes, rules, observation, extract_observation, keep)

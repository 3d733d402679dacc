"""Reconciliation of demand (ordered) with billing (billed, returned): q11-q15.

Both sides are aggregated to one row per party key *before* the full outer join (map-side
partial aggregation first, so the blank key '' - every unidentified party - or any hot
client is reduced to one row per task before the exchange). The join then meets at most one
row per key on each side; the two aggregates are hash-partitioned on the same key, so the
join needs no further shuffle.

Money stays ``decimal(18,2)`` through the sums and differences and becomes ``double`` only in
the published columns, so totals are exact and do not depend on row order.

Null rules kept from upstream: blank keys form one party and join each other; a missing sum
is 0; "first" name = first non-null (lowest client id on the billing side, smallest name on
the demand and supplier sides); NULL branch / state groups are dropped from their reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StringType, StructField, StructType

from ledgerlens.functions.text import clean_key, norm_text

_MAX_ID = 9223372036854775807


def _zero() -> Column:
    return F.lit(0).cast(DecimalType(18, 2))


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), _zero())


def _dbl(c: Column) -> Column:
    return c.cast(DoubleType())


def _first_client_name(billing: DataFrame) -> Column:
    name = F.col("client_name")
    if "client_id" in billing.columns:
        # lowest client id first (rows without one last), then the smallest name: deterministic
        order = F.when(name.isNotNull(),
                       F.struct(F.coalesce(F.col("client_id").cast("long"), F.lit(_MAX_ID)), name))
        return F.min_by(name, order)
    return F.min(name)


def count_each_order_once(billing: DataFrame) -> DataFrame:
    """Decision D1 option: keep billed/returned on one row per order (lowest supplier key), 0 elsewhere.

    Upstream repeats the order total on every supplier row of the order; this variant makes
    totals count each order once. One window over order_id (a shuffle by order).
    """
    w = Window.partitionBy("order_id").orderBy(F.col("supplier_key").asc_nulls_last(),
                                              F.col("client_key").asc_nulls_last())
    first = F.row_number().over(w) == 1
    return (billing.withColumn("_first", first)
            .withColumn("billed", F.when(F.col("_first"), F.col("billed")).otherwise(_zero()))
            .withColumn("returned", F.when(F.col("_first"), F.col("returned")).otherwise(_zero()))
            .drop("_first"))


_SUM = DecimalType(28, 2)


def _by_party(df: DataFrame, key: str, names: list[str], sums: dict[str, str], first: Column | None = None,
              within: tuple[str, ...] = ()) -> DataFrame:
    """Sums per cleaned key, and a name. Raw rows meet a hash aggregate by (key, name columns), whose
    buffers are decimals only; the name is taken over its much smaller result.

    ``within`` (here and below): columns that every group also has; one pass then makes the table of each of their values."""
    per_name = df.groupBy(*within, clean_key(key).alias(key), *names).agg(*[F.sum(c).alias(alias) for alias, c in sums.items()])
    return per_name.groupBy(*within, key).agg((F.min(names[-1]) if first is None else first).alias("_name"),
                                     *[F.sum(alias).cast(_SUM).alias(alias) for alias in sums])


def client_measures(billing: DataFrame, demand: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Per cleaned client key: name and decimal ordered / billed / returned (0 when absent)."""
    names = [c for c in ("client_id", "client_name") if c in billing.columns]
    b = _by_party(billing, "client_key", names, {"_f": "billed", "_r": "returned"}, _first_client_name(billing), within)
    d = _by_party(demand, "client_key", ["client_name"], {"_v": "ordered"}, within=within)
    return d.withColumnRenamed("_name", "_dn").join(b.withColumnRenamed("_name", "_bn"), [*within, "client_key"], "full_outer").select(
        *within, "client_key",
        F.coalesce("_dn", "_bn").alias("client_name"),
        _z("_v").alias("ordered"), _z("_f").alias("billed"), _z("_r").alias("returned"))


def reconcile_client(billing: DataFrame, demand: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """q11: ordered vs billed vs returned by client, with flow difference and net billed."""
    m = client_measures(billing, demand, within)
    return m.select(
        *within, "client_key", "client_name",
        _dbl(F.col("ordered")).alias("ordered"),
        _dbl(F.col("billed")).alias("billed"),
        _dbl(F.col("returned")).alias("returned"),
        _dbl(F.col("ordered") - F.col("billed")).alias("flow_diff"),
        _dbl(F.col("billed") - F.col("returned")).alias("net_billed"))


def reconcile_supplier(billing: DataFrame, demand: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """q12: the same by supplier; the name is upper-cased and stripped, NULL when both sides lack it."""
    d = _by_party(demand, "supplier_key", ["supplier_name"], {"_v": "ordered"}, within=within).withColumnRenamed("_name", "_dn")
    b = _by_party(billing, "supplier_key", ["supplier_name"], {"_f": "billed", "_r": "returned"}, within=within).withColumnRenamed("_name", "_bn")
    j = d.join(b, [*within, "supplier_key"], "full_outer")
    return j.select(
        *within, "supplier_key",
        norm_text(F.coalesce("_dn", "_bn")).alias("supplier_name"),
        _dbl(_z("_v")).alias("ordered"),
        _dbl(_z("_f")).alias("billed"),
        _dbl(_z("_r")).alias("returned"),
        _dbl(_z("_v") - _z("_f")).alias("flow_diff"))


_SUMMARY_MEASURES = ["billed", "returned", "net_billed", "ordered", "flow_diff"]


def _summary(billing: DataFrame, key: str, within: tuple[str, ...] = ()) -> DataFrame:
    agg = (billing.where(F.col(key).isNotNull()).groupBy(*within, key)
           .agg(F.sum("billed").alias("_f"), F.sum("returned").alias("_r")))
    return agg.select(
        *within, key,
        _dbl(_z("_f")).alias("billed"),
        _dbl(_z("_r")).alias("returned"),
        _dbl(_z("_f") - _z("_r")).alias("net_billed"),
        F.lit(0.0).alias("ordered"),
        _dbl(-_z("_f")).alias("flow_diff"))


def branch_summary(billing: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """q13: billed / returned / net by branch (NULL branch dropped; ordered is 0 by definition)."""
    if "branch_id" not in billing.columns:
        billing = billing.withColumn("branch_id", F.lit("FILIAL_UNICA"))
    return _summary(billing, "branch_id", within)


def state_summary(billing: DataFrame, state_col: str = "state", within: tuple[str, ...] = ()) -> DataFrame:
    """q14: the same by state; an empty table with the fixed schema when there is no state column."""
    if state_col not in billing.columns:
        schema = StructType([StructField("state", StringType())] +
                            [StructField(m, DoubleType()) for m in _SUMMARY_MEASURES])
        return billing.sparkSession.createDataFrame([], schema)
    return _summary(billing.withColumnRenamed(state_col, "state") if state_col != "state" else billing, "state", within)


def branch_and_state(billing: DataFrame) -> DataFrame:
    """Branch and state summaries in ONE pass over the billing (grouping sets; the Expand
    doubles rows only inside the map-side partial aggregate). ``grouping_id`` tells the two
    apart, so a NULL branch or state is never confused with the rolled-up column. Split with
    ``split_summaries``; stage the (tiny) result when both halves are read.
    """
    g = billing.groupingSets([["branch_id"], ["state"]], "branch_id", "state").agg(
        F.sum("billed").alias("_f"), F.sum("returned").alias("_r"), F.grouping_id().alias("_gid"))
    return g.where(((F.col("_gid") == 1) & F.col("branch_id").isNotNull()) |
                   ((F.col("_gid") == 2) & F.col("state").isNotNull()))


def split_summaries(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    def measures(key: str, gid: int) -> DataFrame:
        return both.where(F.col("_gid") == gid).select(
            key,
            _dbl(_z("_f")).alias("billed"),
            _dbl(_z("_r")).alias("returned"),
            _dbl(_z("_f") - _z("_r")).alias("net_billed"),
            F.lit(0.0).alias("ordered"),
            _dbl(-_z("_f")).alias("flow_diff"))
    return measures("branch_id", 1), measures("state", 2)


def totals(billing: DataFrame, demand: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """q15: grand totals (ordered, billed, returned, flow_diff) of the client reconciliation.

    Every row of both inputs lands in exactly one client group (keys are never NULL), so the
    totals are plain global sums: one partial + final aggregate over a union, no join.
    """
    zero = _zero()
    u = (demand.select(*within, F.col("ordered").alias("o"), zero.alias("f"), zero.alias("r"))
         .unionByName(billing.select(*within, zero.alias("o"), F.col("billed").alias("f"),
                                     F.col("returned").alias("r"))))
    s = u.groupBy(*within).agg(F.sum("o").alias("o"), F.sum("f").alias("f"), F.sum("r").alias("r"))
    return s.select(*within, _dbl(_z("o")).alias("ordered"), _dbl(_z("f")).alias("billed"),
                    _dbl(_z("r")).alias("returned"), _dbl(_z("o") - _z("f")).alias("flow_diff"))


@dataclass
class Reconciliation:
    client: DataFrame
    supplier: DataFrame
    branch: DataFrame
    state: DataFrame


def reconcile(billing: DataFrame, demand: DataFrame, state_col: str = "state",
              dedupe_orders: bool = False) -> Reconciliation:
    """All four reconciliation tables for (already scoped) billing and demand."""
    if dedupe_orders:
        billing = count_each_order_once(billing)
    return Reconciliation(
        client=reconcile_client(billing, demand),
        supplier=reconcile_supplier(billing, demand),
        branch=branch_summary(billing),
        state=state_summary(billing, state_col))

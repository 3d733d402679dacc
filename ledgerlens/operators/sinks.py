"""Sinks: the billing hand-off CSV (';' separated, decimal comma) and generic export.

Spark writes a folder of part files and no byte-order mark; readers here accept both. Text is written
as it is: white space at its edges stays, quotes are doubled, line breaks are quoted.

A sink's path is published (``plans.publish``): every write is a new version, which readers get when it is
whole. The readers in ``sources.files`` resolve such paths; others read the folder that the sink returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerlens.plans.publish import publish
from ledgerlens.plans.scratch import scratch_path
from ledgerlens.schemas import BILLING_FILE_HEADERS, DEMAND_FILE_HEADERS
from ledgerlens.sources.files import read_billing_csv

_CANON_TO_HEADER = {v: k for k, v in BILLING_FILE_HEADERS.items()}
_DEMAND_TO_HEADER = {v: k.lower() for k, v in DEMAND_FILE_HEADERS.items()}


def _csv(df: DataFrame, sep: str):
    return (df.write.format("csv").mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", "UTF-8"))


def decimal_comma(df: DataFrame) -> DataFrame:
    """Decimal columns as text with ',' as the decimal mark (no grouping), others unchanged."""
    return df.select(*[
        F.translate(F.col(f.name).cast("string"), ".", ",").alias(f.name)
        if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields])


def write_billing_csv(billing: DataFrame, path: str) -> str:
    """Unified billing as the hand-off CSV: upstream header names, ';', decimal comma, UTF-8."""
    out = decimal_comma(billing)
    out = out.select(*[F.col(c).alias(_CANON_TO_HEADER.get(c, c.upper())) for c in out.columns])
    return publish(billing.sparkSession, path, _csv(out, ";").csv)


def write_demand_csv(demand: DataFrame, path: str) -> str:
    """Demand as its hand-off CSV: upstream header names, ';', decimal point, UTF-8."""
    out = demand.select(*[F.col(c).alias(_DEMAND_TO_HEADER.get(c, c)) for c in demand.columns])
    return publish(demand.sparkSession, path, _csv(out, ";").csv)


def export(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ";") -> str:
    """Publish a result table, as Parquet by default, or CSV with a header; returns the new version's folder."""
    if fmt == "csv":
        return publish(df.sparkSession, path, _csv(df, sep).csv)
    return publish(df.sparkSession, path, df.write.mode("overwrite").format(fmt).save)


def export_all(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", sep: str = ";") -> str:
    """Publish several tables as one version, each in a folder of its name: readers get all of them or none."""
    def write(folder: str) -> None:
        for name, df in tables.items():
            (_csv(df, sep) if fmt == "csv" else df.write.mode("overwrite").format(fmt)).save(f"{folder}/{name}")

    return publish(next(iter(tables.values())).sparkSession, path, write)


def csv_roundtrip(billing: DataFrame, name: str) -> DataFrame:
    """q26: write the unified billing CSV under the session's checkpoint folder and read it back."""
    path = scratch_path(billing.sparkSession, name)
    write_billing_csv(billing, path)
    return read_billing_csv(billing.sparkSession, path)

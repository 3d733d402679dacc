"""File sources: the two hand-off CSVs, the roster, Parquet - with explicit schemas.

Types are never inferred. The header line is read once to learn which columns exist and in
what order; the data is then read with an explicit StructType built from the canonical
schema (party keys as text, money as decimal(18,2)). Decimal-comma files are parsed with the
``pt-BR`` locale: without it ``1234,5`` would silently read as 12345.00.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.functions.money import MONEY
from ledgerlens.plans.publish import resolve
from ledgerlens.schemas import (
    BILLING_FILE_HEADERS,
    BILLING_FILE_SCHEMA,
    DEMAND_FILE_HEADERS,
    DEMAND_FILE_SCHEMA,
)
from ledgerlens.sources import csv_records
from ledgerlens.sources.csv_records import file_name

DEFAULT_BRANCH = "FILIAL_UNICA"  # fixed value: branch of a billing file without a branch column


def _header_name(raw: str) -> str:
    return raw.replace("﻿", "").strip().upper()


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv_typed(spark: SparkSession, path: str | list[str], schema: StructType, headers: dict[str, str], sep: str = ";",
                   locale: str | None = None, encoding: str = "UTF-8", file_column: str | None = None) -> DataFrame:
    """Read a headed CSV into canonical names and types; a missing path gives an empty table.

    ``file_column``: also the path of each row's file, under this name. Files of a list are read as they are; a path is
    resolved, if it is published."""
    path = resolve(spark, path) if isinstance(path, str) else path
    options = {"sep": sep, "encoding": encoding, **_QUOTING, **({"locale": locale} if locale else {})}
    raw_cols = header_of(spark, path, options)
    if raw_cols is None:
        return _empty(spark, schema)
    types = {f.name: f.dataType for f in schema.fields}
    names = [headers.get(_header_name(c), _header_name(c).lower()) for c in raw_cols]
    return read_records(spark, path, StructType([StructField(n, types.get(n, StringType())) for n in names]), options, file_column)


# RFC 4180 quoting (a quote inside a quoted field is doubled, a quoted field may hold line breaks), as spreadsheet
# tools and pandas write it; Spark's default would expect a backslash.
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def header_of(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[str] | None:
    """The header's cells as they are written; None if there is nothing at the path."""
    try:
        return spark.read.options(**options).option("header", True).option("multiLine", True).csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def read_records(spark: SparkSession, path: str | list[str], schema: StructType, options: dict[str, str],
                 file_column: str | None = None) -> DataFrame:
    """The records behind each file's header, with ``schema``, read in byte ranges also if fields hold line breaks
    (``sources.csv_records``); a file that can't be cut is read as a whole, by one task."""
    kind = csv_records.shape(spark, path, options["sep"]) if options["encoding"].upper() in ("UTF-8", "UTF8") else "whole"
    if kind == "records":
        rows = csv_records.records(spark, path, options["sep"])
        if rows is not None:
            return csv_records.parse(rows, schema, {**options, "mode": "FAILFAST"}, file_column)
        kind = "whole"
    rows = (spark.read.options(**options).option("header", True).option("multiLine", kind == "whole").schema(schema)
            .option("enforceSchema", True).option("mode", "FAILFAST").csv(path))
    return rows.select("*", file_name().alias(file_column)) if file_column else rows


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the schema's missing columns as typed NULLs, cast present ones, keep the schema order first."""
    present = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def conform_billing(df: DataFrame) -> DataFrame:
    """Billing hand-off: supplier key falls back to the supplier name column; a file without a
    branch column gets the single default branch."""
    if "supplier_key" not in df.columns:
        if "supplier_name" not in df.columns:
            raise ValueError("billing input has neither a supplier key nor a supplier name column")
        df = df.withColumn("supplier_key", F.col("supplier_name"))
    if "branch_id" not in df.columns:
        df = df.withColumn("branch_id", F.lit(DEFAULT_BRANCH))
    return conform(df, BILLING_FILE_SCHEMA)


def conform_demand(df: DataFrame) -> DataFrame:
    if "supplier_key" not in df.columns:
        if "supplier_name" not in df.columns:
            raise ValueError("demand input has neither a supplier key nor a supplier name column")
        df = df.withColumn("supplier_key", F.col("supplier_name"))
    return conform(df, DEMAND_FILE_SCHEMA)


def read_billing_csv(spark: SparkSession, path: str | list[str], file_column: str | None = None) -> DataFrame:
    """The unified billing hand-off: ';' separated, decimal comma, UTF-8 (a BOM is tolerated)."""
    df = read_csv_typed(spark, path, BILLING_FILE_SCHEMA, BILLING_FILE_HEADERS, sep=";", locale="pt-BR", file_column=file_column)
    return conform_billing(df)


def read_demand_csv(spark: SparkSession, path: str | list[str], file_column: str | None = None) -> DataFrame:
    """The demand hand-off: ';' separated, decimal point, UTF-8."""
    df = read_csv_typed(spark, path, DEMAND_FILE_SCHEMA, DEMAND_FILE_HEADERS, sep=";", file_column=file_column)
    return conform_demand(df)


def missing_paths(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths where there is nothing."""
    out = []
    for p in paths:
        try:
            spark.read.format("text").load(resolve(spark, p))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
            out.append(p)
    return out


def load_inputs(spark: SparkSession, billing_path: str, demand_path: str,
                fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Both analysis inputs in canonical form (CSV hand-offs, or Parquet written by ``export``).

    If either file is missing, both inputs are empty tables with the canonical schema, and an error
    is logged: a report of one side only would look like a real one.
    """
    missing = missing_paths(spark, billing_path, demand_path)
    if missing:
        logging.getLogger("ledgerlens").error("no input at %s: both inputs are empty", " and ".join(missing))
        return _empty(spark, BILLING_FILE_SCHEMA), _empty(spark, DEMAND_FILE_SCHEMA)
    billing_path, demand_path = resolve(spark, billing_path), resolve(spark, demand_path)
    if fmt == "csv":
        return read_billing_csv(spark, billing_path), read_demand_csv(spark, demand_path)
    return conform_billing(spark.read.parquet(billing_path)), conform_demand(spark.read.parquet(demand_path))


def read_roster(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ";",
                decimal_comma: bool = False) -> DataFrame:
    """The client roster (a spreadsheet upstream; export it as CSV or Parquet).

    Header names are kept as written (``operators.reports.client_roster`` normalises them);
    for CSV the money columns (TOTAL_GASTO, 1..9) and COD are typed at read time, parsing
    ``1.234,56`` when ``decimal_comma`` (a pt-BR export). Other columns stay text.
    """
    path = resolve(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    options = {"sep": sep, "encoding": "UTF-8", **_QUOTING, **({"locale": "pt-BR"} if decimal_comma else {})}
    raw_cols = header_of(spark, path, options)
    if raw_cols is None:
        raise FileNotFoundError(path)
    money = {"TOTAL_GASTO", *[str(m) for m in range(1, 10)]}

    def typ(h: str):
        n = _header_name(h)
        if n in money:
            return MONEY
        return LongType() if n == "COD" else StringType()
    return read_records(spark, path, StructType([StructField(c, typ(c)) for c in raw_cols]), options)

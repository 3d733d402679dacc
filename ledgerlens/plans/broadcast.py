"""Broadcast only behind a measured size; otherwise leave the join to a shuffle.

``broadcast_if_bounded(df)`` measures the side in one aggregate (a partial count and sum per task; no row moves) and
adds the broadcast hint only if both its rows and its bytes are within the bounds. Beyond them the DataFrame is
returned untouched, so Catalyst plans a sort-merge (or AQE a skew-split) join. Nothing is
remembered between calls: the inputs may have changed.

Bytes are what the rows take in a task's memory: 8 a column and row, and the real length of text, binary and nested
values (``octet_length``, of nested ones as text), whatever a type would let one expect. Settings:
``ledgerlens.broadcast.maxRows`` (default 2,000,000) and ``ledgerlens.broadcast.maxBytes`` (default 64 MB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, MapType, StringType, StructType

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024
_CONF_KEY = "ledgerlens.broadcast.maxRows"
_BYTES_KEY = "ledgerlens.broadcast.maxBytes"


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(_CONF_KEY, str(DEFAULT_MAX_ROWS)))


def max_broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(_BYTES_KEY, str(DEFAULT_MAX_BYTES)))


def _fixed_width(df: DataFrame) -> int:
    """Bytes of a row without its values of variable length: its header, and a word a column (a long decimal takes two more)."""
    return 8 + sum(24 if isinstance(f.dataType, DecimalType) and f.dataType.precision > 18 else 8 for f in df.schema.fields)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes, in one aggregate."""
    long = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            long.append(F.octet_length(c))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            long.append(F.octet_length(F.to_json(F.struct(c))))
    of_row = sum((F.coalesce(x, F.lit(0)).cast("long") for x in long), F.lit(0).cast("long"))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(of_row), F.lit(0)).alias("long")).first()
    return got.n, got.n * _fixed_width(df) + got.long


def is_bounded(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows (default: the setting), and no more bytes than the setting allows."""
    spark = df.sparkSession
    rows, size = measured_size(df)
    return rows <= (max_broadcast_rows(spark) if max_rows is None else max_rows) and size <= max_broadcast_bytes(spark)


def broadcast_if_bounded(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` when df is measured to be within the bounds (see ``is_bounded``), else df unchanged."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df

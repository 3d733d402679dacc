"""Money: exact decimals inside, doubles and text only at the report edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)


def to_money(c: Column) -> Column:
    """Round to cents as decimal(18,2) (half up), the counterpart of SQL round(x, 2) on NUMBER."""
    return c.cast(MONEY)


def format_brl(c: Column) -> Column:
    """Brazilian currency text: 1234567.891 -> 'R$ 1.234.567,89'. NULL stays NULL.

    format_number rounds the binary value half-even to two places with ',' grouping;
    translate then swaps the two separators.
    """
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))

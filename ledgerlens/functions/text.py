"""Text and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as white space (str.isspace),
# as one Java regex class. Spark's trim() removes only ' ', so tabs and no-break spaces
# would survive it.
_SPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c: Column | str) -> Column:
    """Remove leading and trailing white space (Unicode-aware). NULL stays NULL."""
    return F.regexp_replace(_col(c), f"^{_SPACE_CLASS}+|{_SPACE_CLASS}+$", "")


def norm_text(c: Column | str) -> Column:
    """strip + upper: the normalisation used for supplier names, roster states and scope values."""
    return F.upper(strip_text(c))


def clean_key(c: Column | str) -> Column:
    """Digit-only party key; missing becomes '' (never NULL), so blanks form one group and join.

    A trailing '.0' (or ',0' from a decimal-comma file read as text) is removed first, then
    every non-ASCII-digit character. Keys must arrive as text or integers, never doubles.
    """
    s = F.regexp_replace(_col(c).cast("string"), r"[.,]0$", "")
    return F.coalesce(F.regexp_replace(s, "[^0-9]", ""), F.lit(""))

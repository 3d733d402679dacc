"""Column expressions. All are built-in Spark functions (JVM side, whole-stage codegen); no Python UDF."""

from ledgerlens.functions.money import MONEY, format_brl, to_money
from ledgerlens.functions.text import clean_key, norm_text, strip_text

__all__ = ["MONEY", "clean_key", "format_brl", "norm_text", "strip_text", "to_money"]

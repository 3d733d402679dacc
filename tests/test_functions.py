"""T-unit: key cleaning, text normalisation and currency text (FIXTURES sections 4.1, 4.2)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import clean_key, format_brl, norm_text, strip_text, to_money

KEY_CASES = [
    (None, ""),
    ("123.0", "123"),
    ("123,0", "123"),
    ("12.345/0001-90", "12345000190"),
    ("0012", "0012"),
    ("abc", ""),
    (" 12 ", "12"),
    ("1.0.0", "10"),
    ("-5", "5"),
]


def test_clean_key_cases(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(KEY_CASES)], "i int, v string")
    got = dict(df.select("i", clean_key("v").alias("k")).collect())
    assert [got[i] for i in range(len(KEY_CASES))] == [e for _, e in KEY_CASES]


def test_clean_key_on_integers(spark):
    df = spark.createDataFrame([(5,), (None,), (120,)], "v long")
    assert [r.k for r in df.select(clean_key("v").alias("k")).collect()] == ["5", "", "120"]


MONEY_CASES = [
    (1234567.891, "R$ 1.234.567,89"),
    (-1234.5, "R$ -1.234,50"),
    (0.125, "R$ 0,12"),
    (0.135, "R$ 0,14"),
    (2.675, "R$ 2,67"),
    (1.005, "R$ 1,00"),
    (0.0, "R$ 0,00"),
    (None, None),
]


@pytest.mark.parametrize("value,expected", MONEY_CASES)
def test_format_brl(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(format_brl(F.col("v")).alias("t")).first().t == expected


def test_format_brl_matches_python_fallback(spark):
    """The specification is the manual fallback: f'R$ {x:,.2f}' with separators swapped."""
    values = [1234567.891, -1234.5, 0.125, 0.135, 2.675, 1.005, 0.0, 999.995, -0.005, 1e9 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(format_brl(F.col("v")).alias("t")).collect()]
    want = [f"R$ {v:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".") for v in values]
    assert got == want


def test_strip_and_norm_text_unicode_space(spark):
    rows = [("\t acme  ",), ("  Beta",), (None,), ("　gama ",)]
    df = spark.createDataFrame(rows, "v string")
    got = [(r.s, r.n) for r in df.select(strip_text("v").alias("s"), norm_text("v").alias("n")).collect()]
    assert got == [("acme", "ACME"), ("Beta", "BETA"), (None, None), ("gama", "GAMA")]
    # same as Python's str.strip().upper()
    for (raw,), (_, n) in zip(rows, got):
        assert n == (raw.strip().upper() if raw is not None else None)


def test_to_money_rounds_half_up(spark):
    df = spark.createDataFrame([(Decimal("1.005"),), (Decimal("2.675"),), (Decimal("-1.005"),)], "v decimal(20,4)")
    got = [r.m for r in df.select(to_money(F.col("v")).alias("m")).collect()]
    assert got == [Decimal("1.01"), Decimal("2.68"), Decimal("-1.01")]

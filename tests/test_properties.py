"""Property tests: the Spark expressions against plain-Python statements of the same rules."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import clean_key, format_brl, norm_text


def py_clean(s):
    if s is None:
        return ""
    return re.sub(r"[^0-9]", "", re.sub(r"[.,]0$", "", s), flags=re.ASCII)


def py_brl(x):
    return f"R$ {x:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".")


KEY_TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("0123456789.,-/ abc٣")), max_size=16))


@settings(max_examples=25, deadline=None)
@given(st.lists(KEY_TEXT, min_size=1, max_size=40))
def test_clean_key_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.k for r in df.orderBy("i").select(clean_key("v").alias("k")).collect()]
    assert got == [py_clean(v) for v in values]


MONEY = st.floats(min_value=-1e13, max_value=1e13, allow_nan=False, allow_infinity=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(MONEY, MONEY.map(lambda x: math.floor(x * 1000) / 1000)), min_size=1, max_size=40))
def test_format_brl_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.orderBy("i").select(format_brl(F.col("v")).alias("t")).collect()]
    assert got == [py_brl(v) for v in values]


NAME = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aBç ß\t  xY")), max_size=10))


@settings(max_examples=25, deadline=None)
@given(st.lists(NAME, min_size=1, max_size=40))
def test_norm_text_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.n for r in df.orderBy("i").select(norm_text("v").alias("n")).collect()]
    assert got == [None if v is None else v.strip().upper() for v in values]

"""The campaign's order ids as a range, as ids, as bits and as hashed bits: movements are dropped in the scan's task."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.operators import billing as B
from ledgerlens.plans import runtime_filter as R
from ledgerlens.plans.duckdb_sql import oracle_sql
from ledgerlens.plans.stage import forget
from ledgerlens.sources import fixtures as X
from oracle_compare import compare, duck


@pytest.fixture
def bounds(spark):
    """Sets the bounds on rows and bytes; both are unset afterwards."""
    def put(rows, size=None):
        spark.conf.set("ledgerlens.broadcast.maxRows", str(rows))
        if size:
            spark.conf.set("ledgerlens.broadcast.maxBytes", str(size))
    yield put
    spark.conf.unset("ledgerlens.broadcast.maxRows"), spark.conf.unset("ledgerlens.broadcast.maxBytes")
    forget(spark)


def numbers(df):
    return sorted(r[0] for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["bigint", "int", "smallint"])
def test_bits_are_exact(spark, bounds, kind):
    bounds(3)
    rng = random.Random(3)
    top = 32_000 if kind == "smallint" else 400_000
    keys = sorted(rng.sample(range(-top, top), 900))
    facts = [rng.randint(-top - 90, top + 90) for _ in range(3000)] + keys[::2] + [None, 0, -1, 32767, 32768 % top, -32768 % top]
    k = spark.createDataFrame([(x,) for x in [*keys, None, keys[0]]], f"id {kind}")
    f = spark.createDataFrame([(x,) for x in facts if x is None or abs(x) < 32768 or kind != "smallint"], f"id {kind}")
    kept = R.only(f, k, "id")
    assert "_block" in plan(kept) and kept.columns == ["id"] and kept.dtypes == f.dtypes
    assert numbers(kept) == numbers(f.join(k.distinct(), "id", "left_semi"))


def test_few_keys_no_keys(spark, bounds):
    f = spark.range(100)
    assert numbers(R.only(f, spark.range(5, 8), "id")) == [5, 6, 7]
    assert R.only(f, spark.range(0), "id").count() == 0
    assert R.only(f, spark.createDataFrame([(None,)], "id long"), "id").count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hashed_bits_lose_nothing(spark, bounds, kind):
    """Scattered ids in more blocks than the bound allows: a Bloom filter of one hash in ten blocks."""
    bounds(3, 10 * R.BLOCK_BYTES)
    k = spark.range(3000).select((F.col("id") * 1_000_003).cast(kind).alias("id"))
    f = spark.range(60_000).select((F.col("id") * 1_000_003).cast(kind).alias("id"))
    kept = R.only(f, k, "id")
    assert "_block" in plan(kept)
    got = {r.id for r in kept.collect()}
    want = {r.id for r in k.collect()}
    in_range = f.where(F.col("id").between(*k.agg(F.min("id"), F.max("id")).first())).count()
    assert want <= got and len(got) <= 3000 + 0.03 * in_range


def test_filters_too_full_are_left_out(spark, bounds):
    bounds(3, R.BLOCK_BYTES)
    k = spark.range(30_000).select((F.col("id") * 1_000_003).alias("id"))
    kept = R.only(spark.range(100), k, "id")
    assert "_block" not in plan(kept) and kept.count() == 100
    bounds(3, 10)
    assert "_block" not in plan(R.only(spark.range(100), spark.range(50), "id"))


def test_the_range_reaches_the_scan(spark, bounds, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "facts"))
    for rows in (3, 1000):
        bounds(rows)
        p = plan(R.only(spark.read.parquet(str(tmp_path / "facts")), spark.range(40, 60), "id"))
        assert "GreaterThanOrEqual(id,40)" in p and "LessThanOrEqual(id,59)" in p


@pytest.mark.parametrize("name,build", [("q04_billing_window", B.billing_window), ("q05_billing_promo", B.billing_promo), ("q06_billing_unified", B.billing_unified)])
def test_campaign_aggregates_read_candidates_only(spark, bounds, monkeypatch, name, build):
    """Beyond the bound: what the first aggregate reads is observed, and is the campaign's movements, no more."""
    bounds(10)
    t = X.load_tables(spark, SF01)
    seen, made = Observation("candidates"), []
    sums = B.order_supplier_lines

    def observed(movements, suppliers, return_op):
        return sums(movements.observe(seen, F.count(F.lit(1)).alias("n")), suppliers, return_op)

    def keep(df, stage):
        made.append(B.app_run(spark).keep(df, stage))
        return made[-1]

    monkeypatch.setattr(B, "order_supplier_lines", observed)
    args = [X.order_header(t), X.movements(t), X.clients(t), X.suppliers(t), *([] if name.startswith("q04") else [X.promo_codes(t)])]
    ok, why = compare(build(*args, X.FIXTURE_RULES, keep=keep), duck(SF01), oracle_sql()[name])
    assert ok, why
    candidates = X.movements(t).join(made[0], "order_id", "left_semi").count()
    assert made[0].count() > 10 and seen.get["n"] == candidates < X.movements(t).count() / 2

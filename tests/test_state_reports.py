"""All regional users' reports from one pass: each state's are those of a run for it alone, from its own files."""

import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.operators import state_reports as S
from ledgerlens.operators.report_set import report_set
from ledgerlens.plans import catalog as C
from ledgerlens.plans.publish import resolve
from ledgerlens.schemas import BILLING_FILE_SCHEMA, DEMAND_FILE_SCHEMA


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def inputs(spark):
    """Spellings, no state, a blank one, one that looks like a number, clients in two states, demand of nobody billed."""
    states = ["CE", "ce", "Pi", None, "", "07", "BA", "São Paulo", "a/b=c"]
    b = [("1" if i % 2 else None, i, "100", f"Acme {i % 3}", f"{i % 5},0" if i % 4 else None, f"Ana {i % 5}", i, states[i % 9], D(i), D(i % 3) if i % 2 else None)
         for i in range(60)]
    d = [(f"Acme {i % 4}", "100" if i % 2 else "200", f"Ana {i % 7}", f"{i % 7}", "XX", D(i), i) for i in range(30)]
    return spark.createDataFrame(b, BILLING_FILE_SCHEMA), spark.createDataFrame(d, DEMAND_FILE_SCHEMA)


@pytest.mark.parametrize("display", [False, True])
def test_each_state_is_a_run_for_it_alone(spark, tmp_path, display):
    b, d = inputs(spark)
    path = str(tmp_path / "reports")
    S.publish_state_reports(b, d, path)
    for state in ("ce", "PI", "07", "", "são paulo", "A/B=C", "nowhere"):
        got = S.state_reports(spark, path, state, display=display)
        with report_set(b, d, state, display=display) as want:
            assert list(got) == list(want)
            for name in want:
                assert got[name].columns == want[name].columns and rows(got[name]) == rows(want[name]), (state, name)


def test_test_tables(spark, tmp_path):
    b, d = C.staged_billing(spark, SF01), C.staged_demand(spark, SF01)
    path = str(tmp_path / "reports")
    S.publish_state_reports(b, d, path)
    for state in ("nation_3", "NATION_17"):
        got = S.state_reports(spark, path, state)
        with report_set(b, d, state) as want:
            for name in ("client_detail", "supplier_detail", "totals", "clients_shown", "branches"):
                assert rows(got[name]) == rows(want[name]), name
            assert want["client_detail"].count() > 0


def test_a_state_reads_its_own_files(spark, tmp_path):
    b, d = inputs(spark)
    path = str(tmp_path / "reports")
    folder = S.publish_state_reports(b, d, path)
    client = S.state_reports(spark, path, "ce")["client_detail"]
    plan = client._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope" in plan and "(scope#" in plan and "= sCE)" in plan
    # No file of a state names another one.
    for at, _, files in os.walk(folder):
        if os.path.basename(at).startswith("scope=") and os.path.basename(os.path.dirname(at)) == "state":
            named = {r.state.upper() for r in spark.read.parquet(*[os.path.join(at, f) for f in files if f.endswith(".parquet")]).collect()}
            assert len(named) == 1


def test_both_inputs_are_read_once(spark, tmp_path, monkeypatch):
    """Counted while they are marked: every row passes once, whatever the number of states."""
    from pyspark.sql import Observation
    b, d = inputs(spark)
    seen = Observation("demand")
    S.publish_state_reports(b, d.observe(seen, F.count(F.lit(1)).alias("n")), str(tmp_path / "reports"))
    assert seen.get["n"] == d.count()


def test_a_failed_run_leaves_the_last_version(spark, tmp_path):
    b, d = inputs(spark)
    path = str(tmp_path / "reports")
    first = S.publish_state_reports(b, d, path)
    with pytest.raises(Exception, match="broken"):
        S.publish_state_reports(b.withColumn("billed", F.raise_error(F.lit("broken")).cast("decimal(18,2)")), d, path)
    assert resolve(spark, path) == first and S.state_reports(spark, path, "CE")["client_detail"].count() > 0


def test_the_board_has_its_own_reports(spark, tmp_path):
    for state in (None, "Todos", " diretoria "):
        with pytest.raises(ValueError, match="report_set"):
            S.state_reports(spark, str(tmp_path), state)


def test_no_rows(spark, tmp_path):
    b, d = inputs(spark)
    S.publish_state_reports(b.limit(0), d, str(tmp_path / "r"))
    got = S.state_reports(spark, str(tmp_path / "r"), "CE")
    assert got["client_detail"].count() == 0 and tuple(got["totals"].first()) == (0.0,) * 4

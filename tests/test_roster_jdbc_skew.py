"""Roster normalisation (FIXTURES 4.5), JDBC option building, ERP column mapping, and a hot-key
case checked against a brute-force pandas computation."""

from decimal import Decimal as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import billing as B
from ledgerlens.operators.reconcile import reconcile_client
from ledgerlens.operators.reports import client_roster
from ledgerlens.sources import erp
from ledgerlens.sources.jdbc import JdbcTable, credentials, jdbc_options

# The roster's state aliases.
STATE_MAP = {"BAIA": "BA", "CEARA": "CE", "IMPERATRIZ": "MA", "PERNAB": "PE", "SAOLUIS": "MA", "TERESINA": "PI"}


def test_roster_state_normalisation_and_projection(spark):
    rows = [(" baia ", 1, "A", "10.5", "1"), ("CEARA", 2, "B", "20", "2"), ("Imperatriz\t", 3, "C", "1", "3"),
            ("SaoLuis", 4, "D", "2", "4"), ("XX", 5, "E", "3", "5"), (None, 6, "F", "4", "6")]
    df = spark.createDataFrame(rows, "` estado ` string, cod long, razao string, TOTAL_GASTO string, `1` string")
    out = client_roster(df, None, STATE_MAP)
    assert out.columns == ["state", "code", "legal_name", "total_spent", "m1"]
    assert [r.state for r in out.orderBy("code").collect()] == ["BA", "CE", "MA", "MA", "XX", None]
    assert client_roster(df, " Todos ", STATE_MAP).count() == 6
    scoped = client_roster(df, " ma ", STATE_MAP)
    assert sorted(r.code for r in scoped.collect()) == [3, 4]


def test_jdbc_options_and_credentials(spark, monkeypatch):
    monkeypatch.setenv("ERP_USER", "u")
    monkeypatch.setenv("ERP_PASSWORD", "p")
    user, pwd = credentials(spark, "erp")
    opts = jdbc_options("jdbc:oracle:thin:@//db/x", JdbcTable("pcmov", partition_column="numped", lower_bound=1,
                        upper_bound=1000, num_partitions=8), user, pwd)
    assert opts["user"] == "u" and opts["password"] == "p" and opts["dbtable"] == "pcmov"
    assert (opts["partitionColumn"], opts["numPartitions"]) == ("numped", "8")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", JdbcTable("t", partition_column="id"), None, None)
    by_month = JdbcTable("pcpedc", predicates=("data >= DATE '2025-04-01' AND data < DATE '2025-05-01'",))
    assert "partitionColumn" not in jdbc_options("jdbc:x", by_month, "u", "p")


def test_filters_on_number_columns_are_pushed(spark, tmp_path):
    """A Parquet stand-in for NUMBER columns: the conditions reach the scan."""
    import contextlib
    import io
    n = "decimal(38,10)"
    spark.createDataFrame([], f"numped {n}, codfornec {n}, codoper string, punit {n}, qt {n}").write.parquet(str(tmp_path / "pcmov"))
    spark.createDataFrame([], f"codfilial string, numped {n}, codcli {n}, vlatend {n}, data timestamp_ntz, posicao string, tipofv string, "
                              f"origemped string, codemitente {n}, codpromocaomed {n}").write.parquet(str(tmp_path / "pcpedc"))

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        return out.getvalue()

    p = plan(erp.movements(spark.read.parquet(str(tmp_path / "pcmov"))))
    assert "Not(EqualTo(numped,0" in p and "Not(EqualTo(codfornec,0" in p
    p = plan(erp.order_header(spark.read.parquet(str(tmp_path / "pcpedc")), B.CAMPAIGN_RULES))
    assert "EqualTo(codemitente,8888" in p and "EqualTo(posicao,F)" in p and "GreaterThanOrEqual(data," in p


def test_campaign_movements_and_partitioning():
    from dataclasses import replace

    from ledgerlens.sources import jdbc
    text = jdbc.campaign_movements(B.CAMPAIGN_RULES)
    assert text.startswith("(select m.numped") and text.endswith(") pcmov")
    for part in ("p.posicao in ('F')", "p.tipofv in ('OL')", "p.codemitente in (8888)", "p.data <= timestamp '2025-04-21 00:00:00'",
                 "m.codfornec <> 0", "p.codpromocaomed is not null"):
        assert part in text
    whole = jdbc.campaign_movements(replace(B.CAMPAIGN_RULES, end_inclusive_day=True, statuses=("O'x",)))
    assert "p.data < timestamp '2025-04-22 00:00:00'" in whole and "'O''x'" in whole
    specs = jdbc.parse_partitioning(["pcmov:numped:1:100:8", "pcpedc:numped:-5:100:4"])
    assert specs["pcmov"].num_partitions == 8 and specs["pcpedc"].lower_bound == -5
    for bad in ("pcmov", "pcmov:numped:a:1:2", "x:y:1:2:3:4"):
        with pytest.raises(ValueError):
            jdbc.parse_partitioning([bad])
    jdbc.require_partitioning(jdbc.ERP_TABLES, specs, False)
    jdbc.require_partitioning(jdbc.PORTAL_TABLES, {}, True)
    with pytest.raises(ValueError, match="pedido"):
        jdbc.require_partitioning(jdbc.PORTAL_TABLES, specs, False)


def test_erp_mapping_runs_the_billing_plan(spark):
    pcpedc = spark.createDataFrame(
        [("1", 10, 7, D("100.00"), "2025-04-15 10:00:00", "F", "OL", "F", 8888, 1),
         ("1", 11, 7, D("50.00"), "2025-04-21 00:00:00", "F", "OL", "F", 8888, 99),
         ("2", 12, 8, D("70.00"), "2025-04-21 09:00:00", "F", "OL", "F", 8888, 6),   # after midnight of the last day
         ("2", 13, 8, D("30.00"), "2025-03-01 00:00:00", "F", "OL", "F", 8888, 5)],  # promo only
        "codfilial string, numped long, codcli long, vlatend decimal(18,2), data string, posicao string, "
        "tipofv string, origemped string, codemitente long, codpromocaomed long"
    ).withColumn("data", F.col("data").cast("timestamp_ntz"))
    pcmov = spark.createDataFrame(
        [(10, 100, "S", D("1.5"), D("2")), (10, 200, "ED", D("2.25"), D("2")), (11, 0, "ED", D("9"), D("1")),
         (13, 100, "ED", D("1"), D("3"))],
        "numped long, codfornec long, codoper string, punit decimal(18,4), qt decimal(18,4)")
    pcclient = spark.createDataFrame([(7, 70, "Ana", "CE"), (8, 80, "Bia", "PI")],
                                     "codcli long, codcliprinc long, cliente string, estent string")
    pcfornec = spark.createDataFrame([(100, "Acme"), (200, "Beta")], "codfornec long, fornecedor string")
    promo = erp.promo_codes_from_list(spark, [5])
    rules = B.CAMPAIGN_RULES
    out = B.billing_unified(erp.order_header(pcpedc), erp.movements(pcmov), erp.clients(pcclient),
                            erp.suppliers(pcfornec), promo, rules)
    got = sorted((r.order_id, r.supplier_key, r.billed, r.returned) for r in out.collect())
    assert got == [(10, 100, D("100.00"), D("4.50")), (10, 200, D("100.00"), D("4.50")),
                   (11, None, D("50.00"), None), (13, 100, D("30.00"), D("3.00"))]


def test_hot_client_key_matches_brute_force(spark):
    """One blank client key holds a third of the rows; the result equals a pandas brute force."""
    rows = []
    for i in range(3000):
        key = None if i % 3 == 0 else str(i % 97)
        rows.append(("1", i, str(i % 13), f"S{i % 13}", key, f"C{key}" if key else None, i, "CE",
                     D(i % 50) + D("0.25"), D(i % 7)))
    billing = spark.createDataFrame(rows, "branch_id string, order_id long, supplier_key string, supplier_name string, "
                                          "client_key string, client_name string, client_id long, state string, "
                                          "billed decimal(18,2), returned decimal(18,2)")
    demand = spark.createDataFrame([("1", "S1", str(k), f"D{k}", "CE", D(k) + D("0.5"), 1) for k in range(0, 120, 3)],
                                   "supplier_key string, supplier_name string, client_key string, client_name string, "
                                   "state string, ordered decimal(18,2), order_count long")
    got = {r.client_key: (r.ordered, r.billed, r.returned) for r in reconcile_client(billing, demand).collect()}
    pb = pd.DataFrame(rows, columns=["b", "o", "sk", "sn", "ck", "cn", "ci", "st", "billed", "ret"])
    pb["k"] = pb["ck"].fillna("")
    fb = pb.groupby("k").agg(billed=("billed", "sum"), ret=("ret", "sum"))
    want = {}
    for k, r in fb.iterrows():
        want[k] = [0.0, float(r.billed), float(r.ret)]
    for k in range(0, 120, 3):
        want.setdefault(str(k), [0.0, 0.0, 0.0])[0] += float(D(k) + D("0.5"))
    assert {k: tuple(v) for k, v in want.items()} == got
    assert got[""][1] == float(sum(D(i % 50) + D("0.25") for i in range(0, 3000, 3)))


class _FakeConf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _FakeSession:
    def __init__(self, values):
        self.conf = _FakeConf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext")


def test_no_machine_local_folder_on_a_cluster():
    from ledgerlens.plans.scratch import scratch_root
    from ledgerlens.plans.stage import checkpoint_root
    with pytest.raises(RuntimeError):
        scratch_root(_FakeSession({"spark.master": "yarn", "spark.app.id": "a"}))
    shared = _FakeSession({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/ckpt/", "spark.app.id": "a"})
    assert scratch_root(shared) == "hdfs:///shared/ckpt"
    assert checkpoint_root(_FakeSession({"spark.master": "yarn"})) is None  # staging falls back to lineage

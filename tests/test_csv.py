"""T-roundtrip: the billing hand-off CSV keeps decimals; the wrong locale must be caught."""

import os
import tempfile
from decimal import Decimal as D

from pyspark.sql.types import DecimalType, StructField, StructType, StringType

from conftest import SF01
from ledgerlens.operators.sinks import write_billing_csv
from ledgerlens.plans import catalog as C
from ledgerlens.sources.files import load_inputs, read_billing_csv, read_demand_csv


def _write(text: str, bom: bool = True) -> str:
    d = tempfile.mkdtemp(prefix="ledgerlens-csv-")
    path = os.path.join(d, "billing.csv")
    with open(path, "wb") as f:
        f.write(("﻿" if bom else "").encode() + text.replace("\n", "\r\n").encode("utf-8"))
    return path


def test_decimal_comma_needs_locale(spark):
    path = _write("CNPJ;V;NOME\n12,0;1234,5;São\n;;x\n")
    schema = StructType([StructField("CNPJ", StringType()), StructField("V", DecimalType(18, 2)),
                         StructField("NOME", StringType())])
    def base():
        return spark.read.schema(schema).option("header", True).option("sep", ";")
    good = base().option("locale", "pt-BR").csv(path).collect()
    bad = base().csv(path).collect()
    assert good[0].V == D("1234.50") and good[0].NOME == "São" and good[0].CNPJ == "12,0"
    assert bad[0].V == D("12345.00")  # the silent error the locale option prevents
    assert good[1].V is None


def test_reference_headers_with_bom(spark):
    path = _write("CODFILIAL;NUMPED;CNPJ_FORNECEDOR;FORNECEDOR;CNPJ_CLIENTE;CLIENTE;ESTADO;TOTAL_FATURADO;VALOR_DEVOLVIDO\n"
                  "1;10;100.0;Acme;12.345/0001-90;Ana;CE;1234,56;\n")
    df = read_billing_csv(spark, path)
    r = df.first()
    assert (r.branch_id, r.order_id, r.supplier_key, r.client_key, r.billed, r.returned) == (
        "1", 10, "100.0", "12.345/0001-90", D("1234.56"), None)


def test_missing_columns_fall_back(spark):
    path = _write("NUMPED;FORNECEDOR;CNPJ_CLIENTE;TOTAL_FATURADO\n7;Zeta;5;10,00\n", bom=False)
    r = read_billing_csv(spark, path).first()
    assert r.supplier_key == "Zeta" and r.branch_id == "FILIAL_UNICA" and r.state is None


def test_missing_file_gives_empty_tables(spark, caplog):
    there = _write("NUMPED;FORNECEDOR;CNPJ_CLIENTE;TOTAL_FATURADO\n7;Zeta;5;10,00\n", bom=False)
    for paths in (("/nonexistent/billing.csv", "/nonexistent/demand.csv"), (there, "/nonexistent/demand.csv"), ("/nonexistent/b.csv", there)):
        b, d = load_inputs(spark, *paths)
        assert b.count() == 0 and d.count() == 0
        assert "/nonexistent/" in caplog.records[-1].getMessage() and there not in caplog.records[-1].getMessage()
    assert "billed" in b.columns and "ordered" in d.columns


def test_round_trip_of_unified_billing(spark):
    unified = C.staged_billing(spark, SF01)
    path = tempfile.mkdtemp(prefix="ledgerlens-rt-") + "/out"
    write_billing_csv(unified, path)
    back = read_billing_csv(spark, path)
    cols = ["branch_id", "order_id", "supplier_name", "client_name", "state", "billed", "returned"]
    a = sorted(map(tuple, unified.select(*cols).collect()), key=repr)
    b = sorted(map(tuple, back.select(*cols).collect()), key=repr)
    assert a == b


def test_demand_csv_decimal_point(spark):
    path = _write("fornecedor_nome;fornecedor_cnpj;cliente_nome;cliente_cnpj;estado;total_valor_pedido;total_pedidos_qtd\n"
                  "Acme;100;Ana;1;CE;150.25;2\n", bom=False)
    r = read_demand_csv(spark, path).first()
    assert (r.supplier_key, r.client_key, r.ordered, r.order_count) == ("100", "1", D("150.25"), 2)


def test_empty_round_trip(spark):
    from ledgerlens.schemas import BILLING_FILE_SCHEMA
    empty = spark.createDataFrame([], BILLING_FILE_SCHEMA)
    path = tempfile.mkdtemp(prefix="ledgerlens-empty-") + "/out"
    write_billing_csv(empty, path)
    back = read_billing_csv(spark, path)
    assert back.count() == 0
    assert back.columns[:len(BILLING_FILE_SCHEMA)] == [f.name for f in BILLING_FILE_SCHEMA.fields]


def test_roster_csv_with_decimal_comma(spark):
    from ledgerlens.operators.reports import client_roster
    from ledgerlens.sources.files import read_roster
    path = _write(" Estado ;COD;RAZAO;TOTAL_GASTO;1;EXTRA\n baia ;7;Loja A;1.234,56;10,5;x\nTeresina;8;Loja B;;0;y\n")
    roster = client_roster(read_roster(spark, path, decimal_comma=True), None,
                           {"BAIA": "BA", "TERESINA": "PI"})
    got = sorted(tuple(r) for r in roster.collect())
    assert got == [("BA", 7, "Loja A", 1234.56, 10.5), ("PI", 8, "Loja B", None, 0.0)]


def test_missing_parquet_inputs_give_empty_tables(spark):
    b, d = load_inputs(spark, "/nonexistent/billing", "/nonexistent/demand", fmt="parquet")
    assert b.count() == 0 and d.count() == 0 and "returned" in b.columns and "order_count" in d.columns


def test_round_trip_quotes_separator_and_accents(spark):
    from ledgerlens.schemas import BILLING_FILE_SCHEMA
    rows = [("1", 10, "100", 'Acme; "Ltda"', "1", "São João", 7, "CE", D("1234.56"), None),
            ("2", 11, None, None, None, None, None, None, D("-0.50"), D("0.01"))]
    df = spark.createDataFrame(rows, BILLING_FILE_SCHEMA)
    path = tempfile.mkdtemp(prefix="ledgerlens-q-") + "/out"
    write_billing_csv(df, path)
    back = read_billing_csv(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_rfc4180_doubled_quotes(spark):
    path = _write('CODFILIAL;NUMPED;CNPJ_FORNECEDOR;FORNECEDOR;CNPJ_CLIENTE;CLIENTE;ESTADO;TOTAL_FATURADO;VALOR_DEVOLVIDO\n'
                  '1;10;100;"Acme; ""Ltda""";1;Ana;CE;1,50;\n')
    r = read_billing_csv(spark, path).first()
    assert (r.supplier_name, r.client_name, r.billed) == ('Acme; "Ltda"', "Ana", D("1.50"))


def test_demand_csv_round_trip_with_upstream_headers(spark):
    from ledgerlens.operators.sinks import write_demand_csv
    demand = C.staged_demand(spark, SF01)
    path = tempfile.mkdtemp(prefix="ledgerlens-dm-") + "/out"
    folder = write_demand_csv(demand, path)
    header = spark.read.option("header", True).option("sep", ";").csv(folder).columns
    assert header[:2] == ["fornecedor_nome", "fornecedor_cnpj"]
    back = read_demand_csv(spark, path)
    cols = ["supplier_name", "client_name", "state", "ordered", "order_count"]
    assert sorted(map(tuple, back.select(*cols).collect()), key=repr) == \
        sorted(map(tuple, demand.select(*cols).collect()), key=repr)


def test_edge_white_space_and_line_breaks_survive(spark):
    from ledgerlens.operators.sinks import export, write_demand_csv
    from ledgerlens.schemas import BILLING_FILE_SCHEMA, DEMAND_FILE_SCHEMA
    rows = [("1", 10, "100", "Acme ", "1", " Ana", 7, "\tCE\t", D("1.00"), None),
            ("2", 11, "200", "two\nlines", "2", "three\r\nlines;", 8, " ", D("2.00"), D("0.01"))]
    df = spark.createDataFrame(rows, BILLING_FILE_SCHEMA)
    path = tempfile.mkdtemp(prefix="ledgerlens-ws-")
    write_billing_csv(df, f"{path}/b")
    got = sorted(map(tuple, read_billing_csv(spark, f"{path}/b").collect()), key=repr)
    assert [r[:3] + r[6:7] + r[8:] for r in got] == [r[:3] + r[6:7] + r[8:] for r in rows]
    assert [(r[3], r[5].replace("\r\n", "\n"), r[7]) for r in got] == [(r[3], r[5].replace("\r\n", "\n"), r[7]) for r in rows]
    demand = spark.createDataFrame([(" Acme ", "1", "Ana\nBia", "2", "CE", D("1.00"), 1)], DEMAND_FILE_SCHEMA)
    write_demand_csv(demand, f"{path}/d")
    assert read_demand_csv(spark, f"{path}/d").collect() == demand.collect()
    folder = export(demand, f"{path}/e", fmt="csv")
    back = spark.read.option("header", True).option("sep", ";").option("multiLine", True).option("escape", '"').csv(folder)
    assert back.first().supplier_name == " Acme "

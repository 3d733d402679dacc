"""Incremental refresh: one changed file of n is the only one that is opened, and the reports are those of a full run."""

import os
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from ledgerlens.operators import refresh as R
from ledgerlens.operators.reconcile import reconcile, totals
from ledgerlens.operators.report_set import report_set
from ledgerlens.plans import catalog as C
from ledgerlens.plans.publish import current

BILLING = "CODFILIAL;NUMPED;CNPJ_FORNECEDOR;FORNECEDOR;CNPJ_CLIENTE;CLIENTE;ESTADO;TOTAL_FATURADO;VALOR_DEVOLVIDO\n"
DEMAND = "fornecedor_nome;fornecedor_cnpj;cliente_nome;cliente_cnpj;estado;total_valor_pedido;total_pedidos_qtd\n"


def write(folder, name, seed, billing):
    rng = random.Random(seed)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(BILLING if billing else DEMAND)
        for n in range(40):
            c, s, state = rng.randint(0, 9), rng.randint(0, 4), rng.choice(["CE", "ce", "BA", ""])
            key = rng.choice([f"{c},0", f"{c}", ""])
            name = rng.choice([f"Ana {c}", f'"Bia\n{c}"', ""])
            money = lambda mark: rng.choice(["", f"{rng.randint(0, 99)}{mark}{rng.randint(10, 99)}"])
            if billing:
                f.write(f"{rng.randint(1, 2)};{n};{s};Acme {s};{key};{name};{state};{money(',')};{money(',')}\n")
            else:
                f.write(f"Acme {s};{s};{name};{key};{state};{money('.')};{rng.randint(1, 5)}\n")


@pytest.fixture
def folders(tmp_path):
    b, d = str(tmp_path / "billing files"), str(tmp_path / "demand+")
    for n in range(4):
        write(b, f"part {n}.csv", n, True)
        write(f"{d}/in{n % 2}", f"p{n}%.csv", 10 + n, False)
    return b, d, str(tmp_path / "shares")


def everything(billing, demand):
    rec = reconcile(billing, demand)
    return [sorted(map(tuple, df.collect()), key=repr) for df in (rec.client, rec.supplier, rec.branch, rec.state, totals(billing, demand))]


def full(spark, b, d):
    """A run over all files, each read by itself."""
    def files(folder):
        return [os.path.join(at, f) for at, _, fs in os.walk(folder) for f in sorted(fs) if f.endswith(".csv")]

    billing = reduce(DataFrame.unionByName, [R.read_billing_csv(spark, [f]) for f in files(b)])
    return everything(billing, reduce(DataFrame.unionByName, [R.read_demand_csv(spark, [f]) for f in files(d)]))


def names(scanned):
    return [os.path.basename(p) for p in scanned]


def test_only_changed_files_are_read(spark, folders):
    b, d, root = folders
    first = R.refresh(spark, b, d, root)
    assert len(first.scanned["billing"]) == len(first.scanned["demand"]) == 4
    assert everything(first.billing, first.demand) == full(spark, b, d)
    again = R.refresh(spark, b, d, root)
    assert again.scanned == {"billing": [], "demand": []}
    write(b, "part 2.csv", 99, True)
    want = full(spark, b, d)
    # The other files can't be read any more, with their length and time as before: whoever opened them would notice.
    for at, fs in ((b, ["part 0.csv", "part 1.csv", "part 3.csv"]), (f"{d}/in0", ["p0%.csv"]), (f"{d}/in1", ["p1%.csv"])):
        for f in fs:
            path = f"{at}/{f}"
            stat = os.stat(path)
            with open(path, "r+b") as out:
                out.write(b"\xff" * stat.st_size)
            os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    second = R.refresh(spark, b, d, root)
    assert names(second.scanned["billing"]) == ["part 2.csv"] and second.scanned["demand"] == []
    assert everything(second.billing, second.demand) == want


def test_files_come_and_go(spark, folders):
    b, d, root = folders
    R.refresh(spark, b, d, root)
    os.remove(f"{b}/part 1.csv"), os.remove(f"{d}/in1/p1%.csv")
    write(b, "part 9.csv", 9, True), write(f"{d}/in0", "p9.csv", 19, False)
    r = R.refresh(spark, b, d, root)
    assert names(r.scanned["billing"]) == ["part 9.csv"] and names(r.scanned["demand"]) == ["p9.csv"]
    assert everything(r.billing, r.demand) == full(spark, b, d)


def test_all_reports_of_a_scope(spark, folders):
    b, d, root = folders
    r = R.refresh(spark, b, d, root)
    all_files = lambda p: [f[0] for f in R.list_files(spark, p)]
    billing, demand = R.read_billing_csv(spark, all_files(b)), R.read_demand_csv(spark, all_files(d))
    for state in (None, "CE"):
        with report_set(r.billing, r.demand, state) as got, report_set(billing, demand, state) as want:
            assert sorted(got) == sorted(want)
            for name in want:
                assert sorted(map(tuple, got[name].collect()), key=repr) == sorted(map(tuple, want[name].collect()), key=repr), name


def test_a_failed_refresh_changes_nothing(spark, folders):
    b, d, root = folders
    first = R.refresh(spark, b, d, root)
    before, manifest = everything(first.billing, first.demand), current(spark, root)
    with open(f"{d}/in0/broken.csv", "w") as f:
        f.write(DEMAND + "Acme;1;Ana;1;CE;not a number;1\n")
    write(b, "part 0.csv", 77, True)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        R.refresh(spark, b, d, root)
    assert current(spark, root) == manifest and everything(first.billing, first.demand) == before
    os.remove(f"{d}/in0/broken.csv")
    r = R.refresh(spark, b, d, root)
    assert names(r.scanned["billing"]) == ["part 0.csv"] and everything(r.billing, r.demand) == full(spark, b, d)


def test_many_refreshes_are_written_together(spark, folders, monkeypatch):
    monkeypatch.setattr(R, "FOLDERS", 2)
    b, d, root = folders
    for n in range(4):
        write(b, f"more {n}.csv", 50 + n, True)
        r = R.refresh(spark, b, d, root)
    shares = current(spark, root)["shares"]
    assert len(set(shares["billing"].values())) <= 2 and len([x for x in os.listdir(root) if x.startswith("v-")]) <= 5
    assert everything(r.billing, r.demand) == full(spark, b, d)


def test_no_files(spark, tmp_path):
    (tmp_path / "b").mkdir(), (tmp_path / "d").mkdir()
    r = R.refresh(spark, str(tmp_path / "b"), str(tmp_path / "d"), str(tmp_path / "s"))
    assert r.billing.count() == 0 == r.demand.count() and reconcile(r.billing, r.demand).client.count() == 0


def test_parquet_files(spark, tmp_path):
    from conftest import SF01
    C.staged_billing(spark, SF01).repartition(3).write.parquet(str(tmp_path / "b"))
    C.staged_demand(spark, SF01).repartition(3).write.parquet(str(tmp_path / "d"))
    r = R.refresh(spark, str(tmp_path / "b"), str(tmp_path / "d"), str(tmp_path / "s"), fmt="parquet")
    got = sorted(map(tuple, reconcile(r.billing, r.demand).client.collect()))
    assert got == sorted(map(tuple, C.q11_reconcile_client(spark, SF01).collect()))
    assert len(r.scanned["billing"]) == 3

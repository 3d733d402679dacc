"""Snapshot reads: statement texts and options; the partitions' conditions against an in-process engine."""

import random

import duckdb
import pytest

from ledgerlens.operators.billing import CAMPAIGN_RULES
from ledgerlens.sources import jdbc
from ledgerlens.sources import snapshot as S


def asked(answers):
    """An ``ask`` that records its queries and answers in order."""
    seen, left = [], list(answers)

    def ask(sql):
        seen.append(sql)
        return left.pop(0)

    ask.seen = seen
    return ask


def engine(keys):
    db = duckdb.connect()
    db.execute("create table t (k bigint, v bigint)")
    if keys:
        db.executemany("insert into t values (?, ?)", [(k, i) for i, k in enumerate(keys)])
    return db


def spread(db, where):
    """Rows of each partition, and all rows that they give."""
    got = [[r[0] for r in db.execute(f"select v from t where {w}").fetchall()] for w in where]
    return [len(x) for x in got], sorted(v for x in got for v in x)


KEYS = {
    "dense": list(range(1, 5001)),
    "gaps": [10**9 * (i % 3) + i for i in range(5000)],
    "dense and far": [*range(4000), 10**12, 10**15, -(10**12)],
    "a hot key": [7] * 2500 + list(range(2500)),
    "two keys": [1] * 2000 + [2] * 2000,
    "one key": [42] * 3000,
    "without keys": [None] * 10,
    "some without": [None] * 700 + list(range(3000)),
    "few": [5],
    "none": [],
}


@pytest.mark.parametrize("name", list(KEYS))
@pytest.mark.parametrize("buckets", [5, 64])
def test_partitions_cover_all_rows_once(name, buckets):
    db, rows = engine(random.Random(1).sample(KEYS[name], len(KEYS[name]))), 300
    where = S.plan(lambda sql: db.execute(sql).fetchall(), "t", "k", rows, "(hash(rowid) % {n})", buckets)
    sizes, got = spread(db, where)
    assert got == list(range(len(KEYS[name])))
    if name != "without keys" and len(KEYS[name]) > 1000:
        keyed = [n for n, w in zip(sizes, where) if "null" not in w]
        assert max(keyed) <= 1.4 * rows and len(keyed) <= 3 * len(KEYS[name]) / rows + 2


def test_a_hot_key_of_a_query_stays_whole():
    """A query over tables has no row address: the key's rows are one partition, and still read once."""
    db = engine([7] * 900 + list(range(100)))
    where = S.plan(lambda sql: db.execute(sql).fetchall(), "(select * from t) q", "k", 100)
    assert spread(db, where)[1] == list(range(1000)) and any(w == "k >= 7 and k <= 7" for w in where)


def test_partitions_are_bounded(monkeypatch):
    monkeypatch.setattr(S, "MOST", 10)
    db = engine(range(5000))
    assert len(S.plan(lambda sql: db.execute(sql).fetchall(), "t", "k", 1)) <= 11


def test_oracle_names_one_state_everywhere(spark):
    ask = asked([[("4711",)], [(1, 100, 100, 100)], [(0, 60, 1, 60), (1, 40, 61, 100)]])
    with S.Snapshot(spark, "jdbc:oracle:thin:@//h/s", S.ORACLE, ask=ask) as state:
        opts = state.options("pcmov", ("numped", "qt"))
        assert opts["dbtable"] == "(select numped, qt from pcmov as of scn 4711) pcmov" and "sessionInitStatement" not in opts
        assert state.conditions("pcmov", "numped", 60) == ["numped >= 1 and numped <= 60", "numped >= 61 and numped <= 100"]
    assert "dbms_flashback" in ask.seen[0] and all(" from pcmov as of scn 4711" in q for q in ask.seen[1:])
    moved = jdbc.campaign_movements(CAMPAIGN_RULES, at=S.ORACLE.table("", "4711"))
    assert "from pcmov as of scn 4711 m " in moved and "from pcpedc as of scn 4711 p " in moved and moved.endswith(") pcmov")


def test_postgres_sessions_import_the_snapshot(spark):
    ask = asked([[("00000003-0000001B-1",)]])
    state = S.Snapshot(spark, "jdbc:postgresql://h/d", S.POSTGRES, ask=ask)
    opts = state.options("pedido", ("num_ped",))
    assert opts["sessionInitStatement"] == "set transaction isolation level repeatable read; set transaction snapshot '00000003-0000001B-1'"
    assert opts["dbtable"] == "(select num_ped from pedido) pedido" and ask.seen == ["select pg_export_snapshot()"]


def test_a_hot_key_is_split_by_row_address():
    assert S.conditions("k", [(0, 250, 7, 7)], 0, 100, S.ORACLE.part) == [f"k = 7 and ora_hash(rowid, 2) = {i}" for i in range(3)]
    assert S.conditions("k", [(0, 250, 7, 7)], 0, 100, S.POSTGRES.part)[1] == "k = 7 and ((hashtext(ctid::text) & 2147483647) % 3) = 1"


def test_what_isnt_a_snapshot_doesnt_get_into_a_statement():
    for token in ("1; drop table x", "1'", "", " "):
        with pytest.raises(ValueError, match="snapshot"):
            S.ORACLE.table("pcmov", token) if token else S._checked(token)


def test_all_tables_of_one_state(spark, monkeypatch):
    """Big tables by key, the campaign's movements as a query, small tables whole; one question for the state."""
    read = []
    monkeypatch.setattr(S.Snapshot, "read", lambda self, *a: read.append(a))
    ask = asked([[("5",)]])
    S.read_all(S.Snapshot(spark, "jdbc:x", S.ORACLE, ask=ask), jdbc.ERP_TABLES, {"pcmov": "(select 1) pcmov"}, 10)
    assert {a[0]: a[2] for a in read} == {"pcpedc": "numped", "pcmov": "numped", "pcclient": None, "pcfornec": None}
    assert [a[4] for a in read if a[0] == "pcmov"] == ["(select 1) pcmov"] and len(ask.seen) == 1

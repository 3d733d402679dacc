"""Hard negatives (12) against a comparison of all anchors with all rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001
from ledgerlens.llm import hard_negatives as H


def brute(rows, is_anchor, n_pos=5, n_neg=5):
    rows = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(float(np.dot(v, w)), j, q) for j, q, w in rows if j != i and len(w) == len(v)]
        positives = sorted(((s, j) for s, j, q in scored if q == label), key=lambda t: (-t[0], t[1]))[:n_pos]
        for top, p in positives:
            fits = sorted(((s, j) for s, j, q in scored if q != label and 80 * top <= 100 * s <= 100 * top), key=lambda t: (-t[0], t[1]))
            out += [(i, p, rank, j, top, s) for rank, (s, j) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def whole(rng, n, m, spread):
    centres = rng.normal(size=(7, m)) * 60
    return np.floor(centres[rng.integers(0, 7, n)] + rng.normal(size=(n, m)) * spread)


def rows_of(rng, n=700, m=16, spread=20.0, labels=4):
    v = whole(rng, n, m, spread)
    return [(i, v[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("m,spread,block", [(16, 20.0, 16 << 20), (16, 2.0, 4000), (3, 60.0, 1500), (1, 9.0, 800)])
def test_is_brute_force(spark, monkeypatch, m, spread, block):
    monkeypatch.setattr(H, "BLOCK_BYTES", block)
    monkeypatch.setattr(H, "CELLS", 9)
    rows = rows_of(np.random.default_rng(m), m=m, spread=spread)
    got = sorted(map(tuple, H.mine(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    want = brute(rows, lambda i: i % 20 == 0)
    assert got == want and len(want) > 100


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 600)
    rng = np.random.default_rng(5)
    rows = rows_of(rng, n=120, m=4, spread=3.0, labels=2)
    rows += rows[:40]  # rows that repeat
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0], i % 2) for i in range(60)]  # ties
    rows += [(300, [0.0] * 4, 0), (301, [0.0] * 4, 1), (302, [0.0] * 4, 0), (310, [], 0), (311, [], 1), (312, [], 0)]
    rows += [(320, [5.0, 1.0], 0), (321, [4.0, 1.0], 0), (322, [4.0, 0.0], 1), (330, [9.0] * 5, 0)]
    rows += [(340, None, 1), (350, [1.0, None, 2.0, 3.0], 1), (360, [1.0, float("nan"), 0.0, 0.0], 0), (370, [float("inf")] * 4, 0), (380, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    got = sorted(map(tuple, H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and {300, 310, 320} <= {r[0] for r in got}


def test_an_id_with_two_vectors(spark):
    rows = [(10, [9.0, 1.0], 0), (10, [1.0, 9.0], 1), (1, [8.0, 1.0], 0), (2, [1.0, 8.0], 1), (3, [7.0, 1.0], 1), (4, [1.0, 7.0], 0)]
    got = sorted(map(tuple, H.mine(frame(spark, rows), F.col("vec_id") == 10, 2, 2).collect()))
    assert got == brute(rows, lambda i: i == 10, 2, 2) and len(got) > 1


def test_few_rows(spark):
    assert H.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert H.mine(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0
    more = frame(spark, [(10, [2.0], 0), (1, [1.0], 0), (2, [0.9], 1)]).withColumns({c: F.lit("x") for c in ("k", "v", "id", "rank", "chunk")})
    assert [tuple(r) for r in H.mine(more, F.col("vec_id") % 10 == 0).collect()] == [(10, 1, 1, 2, 2.0, 1.8)]


def test_a_walk_stops_where_the_bound_certifies_it(monkeypatch):
    """Candidates behind the certified place score high here, against their stated norm: whoever walked on would find them."""
    monkeypatch.setattr(H, "STEP", 4)
    n = 40
    v = np.zeros((n, 2))
    v[:, 0] = np.where(np.arange(n) < 8, 100 - np.arange(n), 1000)
    unit = np.tile([1.0, 0.0], (n, 1))
    cands = {"v": v, "unit": unit, "norm": np.where(np.arange(n) < 8, v[:, 0], 1.0), "label": np.zeros(n), "id": np.arange(n) + 1, "k": np.arange(n)}
    asks = {"anchor_k": np.zeros(1, int), "anchor_id": np.zeros(1, int), "v": np.array([[1.0, 0.0]]), "low": np.array([-np.inf]), "top": np.array([np.inf]),
            "label": np.zeros(1), "partner_of": np.zeros(1, int), "partner_of_k": np.zeros(1, int)}
    out = []
    H._walk(cands, asks, True, 5, out)
    assert out[0][5].tolist() == [1, 2, 3, 4, 5]


def test_query_is_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    got = sorted(map(tuple, H.op12_hard_negatives(spark, SF001).collect()))
    assert got == sorted(db.execute(H.SQL).fetchall()) and len(got) > 50


def test_no_cross_join(spark):
    plan = H.op12_hard_negatives(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

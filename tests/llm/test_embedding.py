"""Embedding near-duplicates (3): brute force, recall, odd vectors."""

import numpy as np
import pyarrow as pa
import pytest

from conftest_paths import SF01
from ledgerlens.llm import embedding_dedup as E


def brute(rows, threshold=0.98):
    """(id, vector, label) to (links, component)."""
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    low, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ok = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label) for i, v, label in rows if usable(v, label)]
    for n, (a, x, p) in enumerate(ok):
        for b, y, q in ok[n + 1:]:
            if p == q and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                s, t = find(a), find(b)
                low[max(s, t)] = min(s, t)
    return {i: (links[i], find(i)) for i in low}


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label int{more}")


def clusters(rng, dim, groups=12, each=8, spread=0.08):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(each):
            v = centre + spread * rng.normal(size=dim) / np.sqrt(dim) * rng.choice([0, 1, 2])
            rows.append((len(rows), (v * rng.uniform(0.1, 10)).tolist(), g % 3 if g else None))
    return rows


@pytest.mark.parametrize("dim,block", [(64, 1024), (16, 3), (3, 1024), (2, 5), (1, 1024)])
def test_is_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = clusters(np.random.default_rng(dim), dim)
    got = {r.id: (r.n_links, r.component_id) for r in E.near_vectors(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and sum(n for n, _ in want.values()) > 0


def test_recall_at_the_threshold():
    rng, dim = np.random.default_rng(1), 64
    for n in (3000, 60_000):
        hit = 0
        for _ in range(200):
            x, z = rng.normal(size=(2, dim))
            x /= np.linalg.norm(x)
            z -= (z @ x) * x
            y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z)
            hit += any(len(np.intersect1d(E.list_directions(x @ r, b, t), E.list_directions(y @ r, b, t)))
                       for r, b, t in (E.code(dim, n, c) for c in range(E.CODES)))
        assert hit >= 194


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 63, 64, 300])
def test_sketches_lose_no_pair(dim):
    """Whoever reaches the threshold with another one passes; of random vectors in 64 dimensions hardly any does."""
    rng = np.random.default_rng(dim)
    x = E.unit(np.concatenate([rng.normal(size=(60, dim)), rng.laplace(size=(60, dim)) ** 3 + 1e-9]))
    x = E.unit(np.concatenate([x, x[::3] + rng.normal(size=(40, dim)) * 0.15 / np.sqrt(dim), x[:5]]))
    codes, step, off = zip(*(E.sketch(v) for v in x))
    got = E.may_reach(E.components_of(codes), np.array(step), np.array(off), 0.98)
    cos = x @ x.T
    np.fill_diagonal(cos, -1)
    assert got[cos.max(1) >= 0.98].all()
    if dim == 64:
        y = E.unit(rng.normal(size=(500, dim)))
        codes, step, off = zip(*(E.sketch(v) for v in y))
        assert E.may_reach(E.components_of(codes), np.array(step), np.array(off), 0.98).mean() < 0.05


def test_filters_over_the_block_pass_whole(monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(g, i, i, g, *E.sketch(E.unit(rng.normal(size=(1, 8)))[0])) for i, g in enumerate([1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 5, 5, 5])]
    cols = list(zip(*rows))
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.float32(), pa.float32()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["g", "h", "v", "filter", "code", "step", "off"])
    for size in (1, 4, 13):
        out = [r for b in E._prune(0.98)(whole.slice(k, size) for k in range(0, 13, size)) for r in b.column("h").to_pylist()]
        assert [h for h in out if 2 <= h <= 8] == list(range(2, 9)) and 9 not in out


def test_listing_is_exhaustive():
    """List decoding finds exactly the directions that a full product would."""
    rng = np.random.default_rng(2)
    for blocks in (1, 2, 3):
        books = [rng.normal(size=(7, 4)) for _ in range(blocks)]
        x = rng.normal(size=4 * blocks)
        scores = np.zeros(1)
        for i, b in enumerate(books):
            scores = (scores[:, None] + b @ x[4 * i:4 * i + 4]).ravel()
        for t in (-9.0, 0.0, 1.5, 99.0):
            assert (E.list_directions(x, books, t) == np.flatnonzero(scores >= t)).all()


def test_op3_on_its_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = E.op3_embedding(spark, SF01)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute(rows)


def test_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], 2, "x"), (4, [1.0, 0.0], None, "x"), (5, None, 1, "x"),
            (6, [], 1, "x"), (7, [0.0, 0.0], 1, "x"), (8, [nan, 1.0], 1, "x"), (9, [inf, 0.0], 1, "x"), (10, [1.0, None], 1, "x"),
            (11, [1.0, 0.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (12, [1e300, 0.0], 1, "x"), (13, [5e-324, 0.0], 1, "x"),
            (14, [0.0, 1.0], 2, "x"), (14, [0.0, 1.0], 2, "x"), (15, [-1.0, 0.0], 1, "x"), (15, [0.6, 0.8], 1, "x"), (16, [0.6, 0.8], 1, "x")]
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(frame(spark, rows, ", links string")).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    for i in (1, 2, 12, 13):
        assert by[i] == [(3, 1, i == 1)]
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by[i] == [(0, i, True)]
    assert by[None] == [(0, None, True)] and by[14] == [(1, 14, True)] * 2
    assert sorted(by[15]) == [(0, 15, True), (1, 15, True)] and by[16] == [(1, 15, False)]
    assert E.near_vectors(frame(spark, [])).collect() == []

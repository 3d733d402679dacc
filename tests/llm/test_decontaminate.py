"""Benchmark decontamination (10): lossless masks, brute force, odd cases, the join without a broadcast."""

import itertools
import random
import re

import pytest

from conftest_paths import SF001
from ledgerlens.llm import common, decontaminate as D
from llm_cases import empty_documents, odd_documents


@pytest.mark.parametrize("window", range(D.MIN_ITEM, D.WINDOW + 1))
def test_masks_are_lossless(window):
    """Wherever the allowed substitutions lie, some mask reads none of them."""
    for bad in map(set, itertools.combinations(range(window), D.tolerated(window))):
        assert any(all(o + p not in bad for p in m) for m in D.MASKS for o in range(window - m[-1]))


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def longest_run(same):
    best = now = 0
    for x in same:
        now = (now + 1) * x
        best = max(best, now)
    return best


def brute(docs, items):
    """All alignments of all items with all documents, by the three rules."""
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = tokens(text), tokens(item)
        if len(b) < D.SHORTEST:
            continue
        w, best = min(D.WINDOW, len(b)), 0
        for diag in range(1 - len(b), len(a)):
            low, high = max(0, -diag), min(len(b), len(a) - diag)
            same = [a[p + diag] == b[p] for p in range(low, high)]
            in_window = max([0, *(sum(same[s:s + w]) for s in range(len(same) - w + 1))])
            if len(b) >= D.MIN_ITEM and in_window >= w - D.tolerated(w):
                best = max(best, in_window)
            elif longest_run(same) >= min(D.MIN_ITEM, len(b)):
                best = max(best, longest_run(same))
        if best:
            out[d, i] = best
    return out


def test_short_items_and_excerpts(spark):
    """A short item counts whole and in a row; 13 tokens in a row of a longer one count, also at a text's edge; 12 don't."""
    words = [f"u{i}" for i in range(40)]
    items = [(1, " ".join(words[:12])), (2, " ".join(words[20:25])), (3, "u1 u2 u3 u4"), (4, " ".join(words)), (5, "same same same same same same")]
    docs = [(1, " ".join(["x", *words[:12], "y"])), (2, " ".join([*words[:6], "z", *words[7:12]])), (3, "q " + " ".join(words[20:25])), (4, " ".join(words[20:24])),
            (5, " ".join(words[10:25]) + " tail"), (6, " ".join(["head", *words[27:40]])), (7, " ".join(["head", *words[28:40], "tail"])),
            (8, " ".join([*words[5:18], "p"])), (9, "same " * 400), (10, " ".join(words[14:34]))]
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.id, r.item_id): r.matched for r in got.collect()}
    assert found == brute(docs, items)
    assert {(1, 1), (3, 2), (5, 2), (5, 4), (6, 4), (8, 4), (9, 5), (10, 2), (10, 4)} == set(found)


def test_seed_rows_carry_no_text(spark, monkeypatch):
    """Beyond the broadcast bound seeds are shuffled: no row of that exchange holds words."""
    made = []
    monkeypatch.setattr(D, "broadcast_if_small", lambda df: common.broadcast_if_small(df, 0))
    monkeypatch.setattr(D, "staged", lambda df, name: made.append(df) or common.staged(df, name))
    D.op10_decontaminate(spark, SF001).collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for line in plan.splitlines():
        if "Exchange hashpartitioning(seed" in line or "SortMergeJoin [seed" in line:
            assert "words" not in line
    assert "hashpartitioning(seed" in plan
    above = plan[:plan.index("hashpartitioning(seed")]
    assert "words" not in above


def test_substituted_passages_are_found(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([5, 12, 13, 14, 16, 19, 20, 25, 33, 60])]
    docs = []
    for d in range(120):
        passage = tokens(items[d % 10][1])
        part = passage[rng.randint(0, 3):]
        for at in rng.sample(range(len(part)), min(len(part), d % 9)):
            part[at] = rng.choice(words)
        docs.append((d, " ".join(rng.choices(words, k=rng.randint(0, 40)) + part + rng.choices(words, k=rng.randint(0, 40)))))
    got = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.id, r.item_id): r.matched for r in got.collect()}
    assert found == brute(docs, items) and len(found) > 40


def test_op10_is_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF001}/{t}.parquet").select(c, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = D.op10_decontaminate(spark, SF001).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want and len(got) == len(want) > 0


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    want = sorted(map(tuple, D.op10_decontaminate(spark, SF001).collect()))
    monkeypatch.setattr(D, "broadcast_if_small", lambda df: common.broadcast_if_small(df, 0))
    df = D.op10_decontaminate(spark, SF001)
    assert sorted(map(tuple, df.collect())) == want


def test_no_python_in_the_plan(spark):
    plan = D.op10_decontaminate(spark, SF001)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_odd_cases(spark):
    item = "shared0 " + " ".join(f"shared{i}" for i in range(1, 15))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "too short")], "item_id long, text string")
    got = D.find_overlaps(odd_documents(spark), items).collect()
    assert sorted((r.id, r.item_id) for r in got) == [(6, 1), (7, 1)]
    assert D.find_overlaps(empty_documents(spark), items).collect() == []
    assert D.find_overlaps(odd_documents(spark), items.limit(0)).collect() == []
    none = spark.createDataFrame([(None, f"x {item} y")], "doc_id long, text string")
    assert [(r.id, r.item_id) for r in D.find_overlaps(none, items).collect()] == [(None, 1)]

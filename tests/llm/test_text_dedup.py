"""Substring dedup (1), MinHash (2), line dedup (6): brute force on small tables, odd cases."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001, SF01
from ledgerlens.llm import common, line_dedup, minhash, substring_dedup
from llm_cases import LONG, empty_documents, odd_documents


def texts(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def brute_substring(rows, window):
    first, out = {}, {}
    for i, t in rows:  # by rising id
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first.setdefault(tuple(words[s:s + window]), i) < i:
                gone[s:s + window] = [True] * window
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_op1_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    want = brute_substring(texts(spark, SF001), 50)
    got = substring_dedup.op1_substring(spark, SF001).collect()
    assert len(got) == len(want) and sum(r.n_removed for r in got) > 0
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_substring_random_repeats(spark, monkeypatch):
    """Short windows over few words: many overlapping repeats, in shards of a few pieces."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 40)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    want = brute_substring(rows, 6)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=6).collect()
    assert all((r.n_words, r.n_removed, r.kept.encode()) == want[r.row.doc_id] for r in got) and len(got) == 120


def test_suffix_automaton_lowest_document():
    rng = random.Random(5)
    for _ in range(150):
        docs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for i, d in enumerate(docs):
            a.add(d, i)
        a.close()
        probe = [rng.randint(0, 2) for _ in range(30)]
        for d in [*docs, probe]:
            want = [min((i for i, e in enumerate(docs) if any(e[x:x + 4] == d[s:s + 4] for x in range(len(e) - 3))), default=float("inf"))
                    for s in range(len(d) - 3)]
            assert a.lowest(d, 4) == want


def test_substring_odd_cases(spark):
    rows = [(r.row.doc_id, r.row.text, r.n_words, r.n_removed, r.kept, r.row.n_removed) for r in
            substring_dedup.remove_repeats(odd_documents(spark)).collect()]
    assert len(rows) == 20 and {r[5] for r in rows} == {"x"}
    by = {r[0]: r for r in rows}
    assert by[6][3] == 0 and by[7][3] == 70 and by[7][4] == "start b halt b"
    assert by[8][2:4] == (60_000, 0) and by[8][4] == LONG
    assert by[2][2:5] == (0, 0, None) and by[3][2:5] == (0, 0, "") and by[4][4] == ""
    assert sum(r[0] is None for r in rows) == 2 and all(r[3] == 0 for r in rows if r[0] is None)
    assert substring_dedup.remove_repeats(empty_documents(spark)).collect() == []


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_near(rows, size, percent=80):
    sets, low = {i: shingle_set(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op2_is_brute_force(spark):
    want = brute_near(texts(spark, SF01), 4)
    got = minhash.op2_minhash(spark, SF01).collect()
    assert len(got) == len(want)
    wrong = [r.doc_id for r in got if (r.n_shingles, r.component_id) != want[r.doc_id] or r.kept != (r.doc_id == r.component_id)]
    assert wrong == []


@pytest.mark.parametrize("block", [512, 3])
def test_minhash_heavily_edited_copies(spark, monkeypatch, block):
    """Copies around the threshold: links that no key's smallest document has must be found across components."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "_COLUMNS", 64)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([0, 2, 3, 4, 5, 6])):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = brute_near(rows, 5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 1


def test_tables_that_spark_sizes_too_low_are_not_broadcast(spark, monkeypatch):
    """Neither the keys, 81 a class after the explode, nor the sets, though Spark takes both for small."""
    plans, write = {}, minhash.staged

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(minhash, "staged", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
        got = minhash.near_duplicates(docs, shingle=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.id, r.component_id) for r in got) == [(i, i // 2 * 2) for i in range(20)]
    assert "SortMergeJoin [key" in plans["minhash-keys"] and "Broadcast" not in plans["minhash-keys"]
    assert "SortMergeJoin [a#" in plans["minhash-links"] and "SortMergeJoin [b#" in plans["minhash-links"] and "SortMergeJoin [v#" in plans["minhash-more"]


def test_measured_or_exploded_tables_are_not_broadcast_by_estimate(spark):
    """A side beyond its bounds, and the exploded windows of lines, though Spark takes both for small; within bounds, the side is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        facts, side = spark.range(1000), spark.range(20)
        for how in ("inner", "left_semi"):
            assert "Broadcast" not in plan(facts.join(common.broadcast_if_small(side, 10), "id", how))
            assert "BroadcastHashJoin" in plan(facts.join(common.broadcast_if_small(side, 30), "id", how))
        docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc")], "doc_id long, text string")
        windows = line_dedup.dedup_lines(docs)
        assert "SortMergeJoin [key" in plan(windows)
        assert sorted((r.row.doc_id, r.kept) for r in windows.collect()) == [(1, "a\nb\nc\nd"), (2, "x")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_minhash_recall_by_keys():
    """Share of pairs at similarity 0.8 that share a key (documented: 0.997)."""
    import numpy as np

    rng, hit = np.random.default_rng(8), 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 900, np.uint64)
        a, b = minhash.sketch(minhash.mix(x[:810])), minhash.sketch(minhash.mix(x[90:]))  # 720 of 900
        same = a == b
        hit += same[:minhash.PARTS].any() and same[minhash.PARTS:].any()
    assert hit >= 392


def test_minhash_odd_cases(spark):
    rows = minhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 20
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert by[5][0].component_id == 1 and not by[5][0].kept
    assert [r.n_shingles for r in by[2] + by[3] + by[4]] == [0, 0, 0] and all(r.kept for r in by[2] + by[3] + by[4])
    assert {(r.component_id, r.kept) for r in by[9] + by[10]} == {(9, True), (10, True)}
    assert all(r.component_id is None and r.kept for r in by[None])
    docs = odd_documents(spark)
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(9) == 1 and ids.count(10) == 2 and 5 not in ids and ids.count(None) == 2 and {1, 2, 3, 4, 8} <= set(ids)
    assert minhash.near_duplicates(empty_documents(spark)).collect() == []
    assert minhash.one_of_each(empty_documents(spark)).collect() == []


def test_line_dedup_odd_cases(spark):
    rows = line_dedup.dedup_lines(odd_documents(spark)).collect()
    assert len(rows) == 20 and {r.row.kept for r in rows} == {"y"}
    by = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept) for r in rows}
    assert by[11] == (4, 0, "a\nb\nc\nd") and by[12] == (4, 3, "x")
    assert by[13] == (5, 4, "a")  # windows 1 and 2 repeat window 0
    assert by[14] == (5, 0, "\n\n\n\n") and by[2] == (0, 0, None) and by[3] == (1, 0, "")
    assert by[8] == (1, 0, LONG)
    assert line_dedup.dedup_lines(empty_documents(spark)).collect() == []


def test_line_dedup_ties(spark):
    """Equal ids: the smaller hash of the text comes first; repeated rows are one document."""
    rows = [(1, "p\nq\nr"), (1, "p\nq\nr"), (2, "p\nq\nr\ns"), (2, "t\np\nq\nr")]
    got = sorted((r.row.doc_id, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 3), (2, 3)]


def test_unrelated_texts_with_one_id_both_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b), (0, "c " + b), (None, a), (None, a), (7, "short text"), (7, "short text"), (8, None), (8, "")]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (0, "c " + b), (None, a), (None, a), (7, "short text"), (8, None), (8, "")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_texts_are_cut_once(spark):
    """Also below a filter on the results, as the pipeline has one."""
    df = line_dedup.dedup_lines(odd_documents(spark)).where("n_removed = 0 or n_removed < n_lines")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_many_pieces_of_one_anchor_in_few_texts(spark, monkeypatch):
    """Two texts that repeat one run of words in ever other surroundings: no automaton gets more than the bound of pieces."""
    monkeypatch.setattr(substring_dedup, "HOT", 60)
    runs = [" ".join(f"run{n}x{i}" for i in range(16)) for n in range(300)]
    run = min(runs, key=lambda r: substring_dedup.grams(minhash.WordHash().of(r.encode().split()), 16)[0])  # chosen as anchor wherever it is
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(d, " ".join(f"{run} " + " ".join(f"d{d}w{j}x{i}" for i in range(40)) for j in range(150)) + f" {shared} end{d}") for d in range(3)]
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        assert got[d] == ((0, text) if d == 0 else (60, text.replace(f"{shared} ", "")))
    each = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id id", "doc_id k", "cast(text as binary) text").mapInArrow(
        substring_dedup._anchor_rows(50), "id long, k long, n long, print binary, h array<long>, m array<int>")
    pieces = each.select(F.inline(F.arrays_zip("h", "m"))).groupBy("h").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("texts"))
    assert pieces.where("m > 60 and texts <= 3").count() > 0  # few texts, many pieces: counted as hot

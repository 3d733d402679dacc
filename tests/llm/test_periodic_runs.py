"""Periodic runs (11) against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest_paths import SF001
from ledgerlens.llm import periodic_runs as P
from llm_cases import empty_documents, odd_documents


def brute_runs(x):
    """Runs (start, length, smallest period) of a list, by comparing it with itself at every distance."""
    best, n = {}, len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def found(texts):
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    out = [[] for _ in texts]
    for t, s, n, q in zip(*P.find_runs(codes, np.array([len(t) for t in texts], np.int64))):
        out[t].append((int(s), int(n), int(q)))
    return out


def samples():
    rng = random.Random(11)
    out = ["", "a", "aaaaa", "aaaaaa", "ababab", "abababab", "a" * 400, ("a" * 9 + "b") * 30, ("ab" * 7 + "c") * 9, "aaabaaab" * 8]
    out += [("a" * 100 + "b") * 6, ("a" * 64 + "b" * 64) * 5, (("ab" * 5 + "c") * 5 + "d") * 6, "x" + "abcd" * 4 + "abc" + "y", "abcd" * 3 + "abc"]
    for k in range(300):
        letters = "abcdefgh"[:rng.choice([1, 2, 2, 3, 8])]
        parts = []
        for _ in range(rng.randint(1, 6)):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            parts.append(word * rng.choice([1, 1, 3, 4, 5, 9]) + word[:rng.randint(0, len(word))])
        text = "".join(parts)
        if k % 3 == 0:
            text = (text * 6)[:rng.randint(1, 900)]
        out.append(text)
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    morse = "a"
    while len(morse) < 1000:
        morse += morse.translate(str.maketrans("ab", "ba"))
    return [*out, fib[-1], fib[-1][:300] * 4, morse, morse[:96] * 5]


def test_is_a_plain_search():
    texts = samples()
    for t, got in zip(texts, found(texts)):
        assert got == brute_runs(t), t


@pytest.mark.parametrize("b", [1, 2, 8, 64, 1024])
def test_sums_are_exact(b):
    rng = np.random.default_rng(b)
    top = int(((P.PRIME - 1) // b) ** 0.5)
    x, y = rng.integers(0, top, (3, b)), rng.integers(0, top, (3, 2 * b - 1))
    want = [[int(((x[r] - y[r, k:k + b]) ** 2).sum()) for k in range(b)] for r in range(3)]
    assert P.squared_differences(x, y).tolist() == want


def test_work_grows_with_the_text_alone():
    """One word over and over, and a long period: no pair of blocks is compared by itself."""
    n = 300_000
    codes = np.concatenate([np.zeros(n, np.int64), np.tile(np.arange(1, 60_001), 5)])
    got = P.find_runs(codes, np.array([n, n]))
    assert [x.tolist() for x in got] == [[0, 1], [0, 0], [n, n], [1, 60_000]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digests(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    rows = P.op11_periodic_runs(spark, SF001).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 5
    texts = dict(docs)
    for r in rows:
        if len(texts[r.doc_id] or "") < 9000:
            got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
            assert got == digests(r.doc_id, texts[r.doc_id])


def test_odd_documents(spark):
    docs = odd_documents(spark)
    more = spark.createDataFrame([(20, "la " * 50_000), (20, "la " * 50_000), (21, "do re mi " * 4 + "fa")], "doc_id long, text string")
    rows = P.periodic_runs(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")
        assert r.n_words == len(words)
        if not r.runs:
            assert r.collapsed == " ".join(words)
    by = {r.row.doc_id: r for r in rows}
    assert [tuple(x) for x in by[20].runs] == [(0, 50_000, 1)] and by[20].collapsed == "la"
    assert [tuple(x) for x in by[21].runs] == [(0, 12, 3)] and by[21].collapsed == "do re mi fa"
    assert by[2].runs == [] and by[2].collapsed == ""
    assert P.periodic_runs(empty_documents(spark)).count() == 0


def test_nothing_is_shuffled(spark):
    plan = P.op11_periodic_runs(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan

"""Language identification (4), class-based scoring (8), quality (9): held-out figures, brute force, odd cases."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001, SF01
from ledgerlens.llm import class_lm, language, quality
from llm_cases import empty_documents, odd_documents


def rows_of(spark, table, *columns):
    return spark.read.parquet(f"{SF01}/{table}.parquet").select(*columns).collect()


def fold(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def test_op4_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in rows_of(spark, "documents", "doc_id", "lang")}
    got = language.op4_language(spark, SF01).collect()
    assert len(got) == len(lang) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_reads_text_only_and_learns_from_its_rows_only(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    learn = language.remainder("doc_id", 3) != 1
    lie = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("xx")))
    a, b = language.train(docs, learn), language.train(lie, learn)
    some = [r.text for r in docs.limit(50).collect()]
    assert b.langs == ["de", "en", "es", "fr"] and [a.predict(t) for t in some] == [b.predict(t) for t in some]


def test_training_holds_no_full_matrix():
    """300 short texts: their vectors as a matrix are 10 MB, and its copies more."""
    texts = [f"{a} wort {i} und noch {i * 7} {a}" for a in ("eins", "zwei", "drei") for i in range(100)]
    x = language.Vectors([(np.flatnonzero(v), v[v > 0]) for v in map(language.features, texts)])
    tracemalloc.start()
    try:
        model = language.Model(x, ["de"] * 100 + ["nl"] * 100 + ["fr"] * 100, language.FAMILIES)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5_000_000
    full = language.Model(np.array([language.features(t) for t in texts]), ["de"] * 100 + ["nl"] * 100 + ["fr"] * 100, language.FAMILIES)
    assert all((a == b).all() for a, b in zip(model.of_family, full.of_family)) and model.least_excess == full.least_excess


def test_language_odd_cases(spark):
    docs = odd_documents(spark)
    model = language.train(docs, F.lit(True))
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[2] == got[3] == got[4] == got[14] == got[15] == ("und", 0.0) and got[8][0] in model.langs
    nothing = language.train(empty_documents(spark), F.lit(True))
    assert nothing.predict("some text") == ("und", 0.0)
    assert language.identify(empty_documents(spark), model).collect() == []
    one = language.train(docs.where("lang = 'en'"), F.lit(True))
    assert one.predict("whatever") == ("en", 1.0)


def test_language_families_and_pairs():
    """Three languages in one family: votes of pairs; a language without a family is one by itself."""
    rng = np.random.default_rng(0)
    letters = {"en": "abcdefgh", "de": "efghijkl", "nl": "ijklmnop", "fr": "qrstuvw", "zz": "xyzéèü"}
    make = lambda a: " ".join("".join(rng.choice(list(letters[a]), 5)) for _ in range(30))
    langs = [a for a in letters for _ in range(40)]
    model = language.Model(np.array([language.features(make(a)) for a in langs]), langs, language.FAMILIES)
    assert model.families == ["germanic", "romance", "zz"] and len(model.of_pair) == 3
    tests = [(a, make(a)) for a in letters for _ in range(20)]
    assert np.mean([model.predict(t)[0] == a for a, t in tests]) > 0.95


def test_exchange_reaches_a_local_optimum():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        n, movable, classes = 20, 17, 5
        pairs = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.5)

        def likelihood(of):
            one = np.zeros((n, classes + n - movable))
            one[np.arange(n), of] = 1
            c = one.T @ pairs @ one
            f = lambda v: (v * np.log(np.maximum(v, 1))).sum()
            return f(c) - f(c.sum(0)) - f(c.sum(1))

        of = class_lm.exchange(pairs.astype(float), movable, classes, 100)
        assert all(likelihood(np.where(np.arange(n) == w, b, of)) <= likelihood(of) + 1e-6 for w in range(movable) for b in range(classes))


def brute_lm(rows, learn):
    """Class model by plain counting, with the operator's own classes: (tokens, known, base) by document."""
    count, end = Counter(), object()
    for i, t in rows:
        if learn(i):
            count.update([*(t or "").encode().lower().split(), end])
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), end]
        out[i] = (len(w), sum(x in count for x in w), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return n, out


def test_op8_is_brute_force_and_beats_the_base(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 5000)  # so that rarer words take the join
    n, want = brute_lm([(r.doc_id, r.text) for r in rows_of(spark, "documents", "doc_id", "text")], lambda i: fold(i, 10) != 0)
    got = class_lm.op8_class_lm(spark, SF01).collect()
    assert len(got) == len(want)
    for r in got:
        tokens, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, fold(r.doc_id, 10) == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def words_of(model):
    """Hash to (class, count) of the table of all words."""
    return {r.h: (r.cls, r.n) for r in model.words.collect()}


def brute_score(model, text):
    """The score from the table of words and the transitions, word by word."""
    known, den = words_of(model), model.den
    total, before = 0.0, class_lm.END
    for w in (text or "").encode().lower().split():
        cls, n = known.get(class_lm.word_hash(w), (class_lm.CLASSES + class_lm.group_of(w), 0))
        total += model.moves[before, cls] + math.log10(n + class_lm.DELTA) - den[cls]
        before = cls
    return total + model.moves[before, class_lm.END]


def test_class_probabilities_add_up(spark):
    """Transitions from each class, and emissions of each class (unseen words' place included), sum to one."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b c d", "a a e f g"] * 3)], "doc_id long, text string")
    model = class_lm.train(docs, F.lit(True))
    assert np.allclose((10 ** model.moves).sum(1), 1)
    total = Counter()
    for cls, n in words_of(model).values():
        total[cls] += 10 ** (math.log10(n + class_lm.DELTA) - model.den[cls])
    assert all(math.isclose(p, 1) for c, p in total.items() if c < class_lm.CLASSES)
    assert model.total == 3 * (13 + 3) and model.distinct == 8 and model.words.count() == 7


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_rarer_words_get_learned_classes(spark, monkeypatch, block):
    """Words behind the exchanged ones take the class of their contexts, not of their spelling; words seen once stay in a group."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[j % 2]}{rng.integers(450)}z" for j in range(20)) for _ in range(1200)]
    # x words stand where a words do, y words where b words do; x7q and y7q end alike
    texts += [f"a{i}z b{i}z x{i}q b{i + 5}z a{i + 9}z y{i}q a{i + 3}z b{i}z" for i in range(100) for _ in range(3)] + ["a1z b1z onceq b2z a2z b3z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd = "a1z b2z x3q unseen y4q Y5q x6q unseen2 onceq"
    new = spark.createDataFrame([(1, odd), (2, texts[-2]), (3, None)], "doc_id long, text string")
    scores = []
    for known in (200_000, 850):
        monkeypatch.setattr(class_lm, "KNOWN", known)
        model = class_lm.train(docs, F.lit(True))
        cls = {w: words_of(model)[class_lm.word_hash(w.encode())][0] for w in {w for t in texts for w in t.split()}}
        side = {k: {cls[f"{k}{i}q"] for i in range(100)} for k in "xy"}
        assert all(max(s) < class_lm.CLASSES for s in side.values()) and not side["x"] & side["y"]
        assert cls["onceq"] == class_lm.CLASSES + class_lm.group_of(b"onceq")
        # transitions are those of the final classes of all words
        cells = Counter()
        for t in texts:
            s = [class_lm.END, *[cls[w] for w in t.split()], class_lm.END]
            cells.update(zip(s, s[1:]))
        want = np.zeros((class_lm.SIZE, class_lm.SIZE))
        for (a, b), n in cells.items():
            want[a, b] = n
        assert np.allclose(model.moves, np.log10((want + 0.1) / (want.sum(1, keepdims=True) + 0.1 * class_lm.SIZE)))
        got = sorted((r.row.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score(new, model).collect())
        assert [r[4] for r in got] == [round(brute_score(model, t), 6) for t in (odd, texts[-2], None)]
        scores.append(got)
    assert len(model.top) < 900 and scores[0] == scores[1]


def test_class_lm_score_is_brute_force(spark):
    """All texts of the test table, of training and held out, by the table of words."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    scored, model = class_lm.train_and_score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    for r in scored.limit(40).collect():
        assert math.isclose(r.score, brute_score(model, r.row.text), rel_tol=1e-9)


def test_blocks_hold_all_words(spark, monkeypatch):
    """Texts of several batches and blocks: words, ends and groups as they are in the texts."""
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "A b", "x" * 70, "é É ß", "tab\tnew\nline\rreturn\x0bv\x0cf nbsp\xa0stays"] + [" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(30))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + len(t))), pa.array(t, pa.string()), pa.array([k % 3 > 0 for k in range(len(t))]),
                                           pa.array(range(len(t)))], names=["id", "text", "learn", "k"]) for i in range(0, len(texts), 9) for t in [texts[i:i + 9]]]
    monkeypatch.setattr(class_lm, "BLOCK_TEXT", 150)
    monkeypatch.setattr(class_lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    seen, blocks = [], list(class_lm._cut(iter(batches)))
    for b in blocks:
        for block, row in class_lm._each_block([b]):
            names = {class_lm.word_hash(w): w for t in texts for w in (t or "").encode().lower().split()}
            words = [names[int(h)] for h in block.hashes.view(np.int64)]
            assert [class_lm.group_of(w) for w in words] == block.groups.tolist() and len(set(words)) == len(words)
            flat, at = [words[c] for c in block.codes], 0
            for i, n, learn in zip(row.column("ids")[0].as_py(), block.sizes, block.train):
                assert flat[at:at + n] == (texts[i] or "").encode().lower().split() and learn == ((i % 9) % 3 > 0)
                seen.append(i)
                at += n
    assert seen == list(range(len(texts))) and len(blocks) > 5 and len({b.column("block")[0].as_py() for b in blocks}) == len(blocks)


def test_class_lm_odd_cases(spark):
    docs = odd_documents(spark)
    model = class_lm.train(docs, F.col("doc_id") < 8)
    got = class_lm.score(docs, model).collect()
    assert len(got) == 20 and {r.row.score for r in got} == {"s"}
    by = {}
    for r in got:
        by.setdefault(r.row.doc_id, []).append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert by[2] == by[3] == by[4] and by[2][0][0] == 1 and by[9][0] == by[9][1] and by[8][0][0] == 60_001
    none = class_lm.train(empty_documents(spark), F.lit(True))
    assert all(r.base_score == 0 for r in class_lm.score(docs, none).where("row.doc_id = 1").collect())
    assert class_lm.score(empty_documents(spark), none).collect() == []


def test_op9_held_out(spark):
    truth = {r.doc_id: r.quality for r in rows_of(spark, "labels", "doc_id", "quality")}
    got = quality.op9_quality(spark, SF01).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_gradients_and_attention():
    """A bag is bad if one passage is: attention must find it."""
    rng = np.random.default_rng(3)

    def bag(bad):
        x = np.zeros((rng.integers(3, 9), quality.N_FEATURES), np.float32)
        x[:, :8] = rng.normal(size=(len(x), 8)) * 0.1
        if bad:
            x[rng.integers(len(x)), 5] += 4
        return x

    y = np.array([i % 3 != 0 for i in range(300)], float)
    model = quality.Model().fit([bag(not v) for v in y], y, np.ones(300))
    test = [(v, model.score(bag(not v))) for v in (0, 1) for _ in range(60)]
    assert np.mean([(s >= 0.5) == v for v, s in test]) > 0.95


def test_quality_odd_cases(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 0), (6, 1), (7, 1), (99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    got = quality.classify(docs, model).collect()
    assert len(got) == 20 and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.row.doc_id in (2, 3, 4)]
    assert len(set(empty)) == 1
    assert quality.train(docs, labels.limit(0), F.lit(True)).score(quality.passages("x")) == 0.5
    assert quality.train(docs, labels.where("quality = 1"), F.lit(True)).score(quality.passages("x")) == 1.0
    assert quality.classify(empty_documents(spark), model).collect() == []


def test_copies_of_a_text_are_learned_once(spark, monkeypatch):
    """A third of a language's rows are one text: the driver's sample holds it once."""
    rows = [(f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(40)] + [("one and the same text over and over", "en")] * 20
    rows += [(f"der schnelle braune Fuchs Nummer {i} springt", "de") for i in range(60)]
    sizes = []
    monkeypatch.setattr(language, "Model", lambda x, langs, *a: sizes.append(langs))
    language.train(spark.createDataFrame(rows, "text string, lang string").repartition(6), F.lit(True))
    assert sizes[0].count("en") == 41 and sizes[0].count("de") == 60

"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: shares of adjacent
character kinds, repetition of words, word lengths; a learned layer makes an embedding ``h`` of it.
Gated attention gives passage k the weight ``softmax(w . (tanh(V h_k) * sigmoid(U h_k)))``; the
weighted mean of the embeddings is the document's representation, and a logistic layer scores it.
All layers learn from document labels only.

Training uses a bounded sample of labelled documents: about ``PER_LABEL`` of each label, chosen by a
hash of the id; their passage encodings are the only thing that the driver gathers. Gradient steps
are weighted so that the sample's labels count as often as they occur in all labelled rows.

Defined cases: a null or empty text is one passage without words; several labels of one document:
the largest counts; null labels and ids are not learned from; without any label the score is 0.5,
with one label only it is that label; very long texts have as many passages as they need and are scored whole;
a score at the threshold counts as 1; rows that repeat get the same score; an empty table gives an
empty result; all input columns come back inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pack, table
from ledgerlens.llm.language import remainder

PASSAGE = 64
PER_LABEL = 1500
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3
KINDS = 16
N_FEATURES = KINDS * KINDS + 6
#: Words of at most so many bytes differ by all of them in the word hash.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _kinds() -> np.ndarray:
    kind = np.full(256, 13, np.uint8)
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n",
                               b".", b",;:", b"!", b"?", b"|", b"#$%&*@", b"\"'`", b"()[]{}<>")):
        kind[list(chars)] = i
    kind[128:] = 14
    kind[:9] = kind[14:32] = 15
    return kind


KIND = _kinds()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage; at least one row."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    blank = SPACE[b]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.zeros((1, N_FEATURES), np.float32)
    n = (len(starts) + PASSAGE - 1) // PASSAGE
    word = np.cumsum(~blank & np.concatenate([[True], blank[:-1]])) - 1  # of each byte; a blank goes with the word before
    word[word < 0] = 0
    of = word // PASSAGE
    kind = KIND[b].astype(np.int64)
    pairs = np.bincount(of[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:], minlength=n * KINDS * KINDS).reshape(n, -1)
    size = np.bincount(of, minlength=n)[:, None]
    inside = np.arange(len(b)) - starts[word]
    hashed = np.add.reduceat(np.where(blank, 0, (b.astype(np.uint64) + 1) * _POWERS[np.clip(inside, 0, 63)]), starts)
    length = np.bincount(word, weights=~blank, minlength=len(starts))
    group = np.arange(len(starts)) // PASSAGE
    words = np.bincount(group, minlength=n)
    share = lambda x: np.bincount(group, weights=x, minlength=n) / words
    again = np.concatenate([[False], hashed[1:] == hashed[:-1]])
    order = np.lexsort((hashed, group))
    new = np.concatenate([[True], (hashed[order][1:] != hashed[order][:-1]) | (group[order][1:] != group[order][:-1])])
    distinct = np.bincount(group[order], weights=new, minlength=n) / words
    upper = (kind[starts] == 1) & (kind[np.minimum(starts + 1, len(b) - 1)] == 1)
    more = np.stack([share(again), distinct, share(np.minimum(length, 40)) / 10, share(length > 14), share(upper), np.log1p(words) / 4], 1)
    return np.hstack([np.sqrt(pairs / np.maximum(size, 1)), more]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and output layer as plain arrays, with the features' mean and scale."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.p = prior, None

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        a = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, g, a, z, bag, _sigmoid(z @ p["c"] + p["b"])

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3):
        rng, x = np.random.default_rng(3), np.vstack(bags)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        init = lambda *n: rng.normal(0, 1 / np.sqrt(n[0]), n)
        self.p = {"E": init(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE),
                  "w": init(GATE), "c": init(HIDDEN), "b": np.zeros(1)}
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        bags = [(b - self.mean) / self.scale for b in bags]
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                x = np.vstack([bags[i] for i in own])
                first = np.cumsum([0, *[len(bags[i]) for i in own[:-1]]])
                h, t, g, a, z, bag, out = self._forward(x, first)
                p = self.p
                dz = ((out - y[own]) * weight[own] / len(own))[:, None]  # of the logit
                dh = a[:, None] * (dz * p["c"])[bag]
                da = np.einsum("ij,ij->i", h, (dz * p["c"])[bag])
                ds = a * (da - np.add.reduceat(a * da, first)[bag])
                dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
                dh += dt @ p["V"].T + dg @ p["U"].T
                de = dh * (1 - h * h)
                grads = {"E": x.T @ de + 1e-4 * p["E"], "e": de.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds,
                         "c": z.T @ dz[:, 0] + 1e-4 * p["c"], "b": dz.sum(0)}
                step += 1
                for k, d in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> float:
        """Of one bag."""
        if self.p is None:
            return self.prior
        return float(self._forward((x - self.mean) / self.scale, np.array([0]))[-1][0])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """``learn``: a condition on the columns of ``labels`` (which names documents by ``id_col``, too)."""
    known = (labels.where(learn).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(float(next(iter(counts), 0.5)))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_label / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30) < share)

    def encoded(batches):
        for b in batches:
            bags = [passages(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.select(["id", "k", "y"]).columns, pa.array([len(x) for x in bags], pa.int32()),
                 pa.array([x.ravel() for x in bags], pa.list_(pa.float32()))], names=["id", "k", "y", "n", "x"])

    rows = pack(docs.select(id_col, text_col), id_col, text_col).select("id", "k", "text").join(F.broadcast(chosen), "id").select(
        F.col("id").cast("string").alias("id"), "k", "y", "text").mapInArrow(
        encoded, "id string, k long, y int, n int, x array<float>").toPandas().sort_values(["id", "k"])
    if rows["y"].nunique() < 2:
        return Model(float(rows["y"].iloc[0]) if len(rows) else 0.5)
    y = rows["y"].to_numpy(float)
    total, size = sum(counts.values()), len(rows)
    weight = np.array([counts[int(v)] / total / ((y == v).sum() / size) for v in y])
    bags = [np.asarray(x, np.float32).reshape(n, -1) for n, x in zip(rows["n"], rows["x"])]
    return Model().fit(bags, y, weight)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row``, ``score`` (0 to 1; higher: label 1 is likelier)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(passages(t)) for t in texts], dtype="float64")

    return pack(docs, id_col, text_col).select("row", score("text").alias("score"))


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels, remainder("doc_id", 5) != 0)
    return classify(docs, model).select(
        "row.doc_id", F.coalesce(remainder("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

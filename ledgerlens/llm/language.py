"""Language identification by hierarchical discrimination.

A text becomes the square roots of its hashed letter bigrams and trigrams (all else is one blank),
scaled to length one. Linear support vector machines, one against the rest, choose the language
family first; within it one machine for each pair of related languages votes, and summed margins
decide ties. The score is the product of the logistic margins of both steps, and of the text's fit.

Margins only compare the learned languages, so the fit tests whether the text is in any of them. Each
language has a profile, the mean frequencies of the hashed pairs and triples; a text's excess is its
mean log-likelihood under a profile, less what that profile expects, plus three standard errors
(short texts vary more); the best of all learned languages counts. Its letter share is that of its non-blank characters.
The learned sample gives the least of both: profiles of either half are held against the other half.
The fit is 1 down to there and falls steeply below. Fewer than ``LEAST_LEARNED`` texts give no such bound.

Training uses a bounded sample: about ``PER_LANGUAGE`` texts of each language, chosen by a hash of
the text over all labelled rows, each different text once; it is the only thing that the driver gathers. A language that
``FAMILIES`` doesn't list is a family by itself.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing could be learned (empty table, no labelled rows); with one language learned, that is the
answer; rows that repeat get the same answer; very long texts are counted whole, one at a time; equal margins
go to the language that comes first by name; all input columns come back inside ``row``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import pack, table

#: Language families (fixed values).
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}
PER_LANGUAGE = 500
#: Rows that a task passes on at a time.
AT_ONCE = 1000
BITS = 13
UNKNOWN = "und"
#: Texts that the bounds of the fit need; the share of learned texts that may lie below them; room left below.
LEAST_LEARNED, BELOW, ROOM = 30, 0.001, 2.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    return np.array([i if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def features(text: str) -> np.ndarray | None:
    """None without a letter."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # runs of blanks are one
    if len(c) < 3:
        return None
    two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(3266489917) + c[2:] * np.uint32(668265263)
    n = np.bincount(np.concatenate([two, three]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(n).astype(np.float32)
    return x / np.linalg.norm(x)


def letter_share(text: str) -> float:
    """Letters among the characters that are no blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return float((_letters()[c] != 32).sum() / max(1, (c > 32).sum()))


class Vectors:
    """Feature vectors by their entries that are not zero; made whole one at a time, as all of them at once would fill the
    driver's memory."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]]):
        self.entries = entries

    @classmethod
    def of(cls, x: np.ndarray) -> Vectors:
        return cls([(np.flatnonzero(v), v[v != 0]) for v in x])

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self):
        return (self.whole(i)[:-1] for i in range(len(self)))

    def where(self, chosen: np.ndarray) -> Vectors:
        return Vectors([self.entries[i] for i in np.flatnonzero(chosen)])

    def whole(self, i: int) -> np.ndarray:
        """Vector ``i`` with a one behind it, for the bias."""
        v = np.zeros((1 << BITS) + 1, np.float32)
        at, entries = self.entries[i]
        v[at], v[-1] = entries, 1
        return v


def _profile(x: Vectors) -> tuple[np.ndarray, float, float]:
    """Log-frequencies over texts, with their mean and variance by their own frequencies."""
    total = np.zeros(1 << BITS)
    for v in x:
        total += v.astype(np.float64) ** 2 * min(_size(v), 2000.0)
    log = np.log((total + 0.5) / (total + 0.5).sum())
    mean = float(np.exp(log) @ log)
    return log, mean, float(np.exp(log) @ (log - mean) ** 2)


def _size(x: np.ndarray) -> float:
    """Pairs and triples of a text, as often as its rarest one occurs: repeats add no evidence."""
    return float(1 / x[x > 0].min().astype(np.float64) ** 2)


def _excess(x: np.ndarray, profiles: list[tuple[np.ndarray, float, float]]) -> float:
    at = np.flatnonzero(x)
    f, size = x[at].astype(np.float64) ** 2, _size(x)
    return max(float(f @ log[at] - mean + 3 * np.sqrt(var / size)) for log, mean, var in profiles)


def _svm(x: Vectors, y: np.ndarray, epochs: int = 12, reg: float = 1e-4) -> np.ndarray:
    """Averaged stochastic subgradient of the hinge loss; y is +1 or -1, both sides weighted alike. Last weight: bias."""
    size = (1 << BITS) + 1
    w, mean, t, order = np.zeros(size, np.float32), np.zeros(size, np.float64), 0, np.random.default_rng(7)
    weight = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            t += 1
            rate = 1 / (reg * (t + 1 / reg))
            v = x.whole(i)
            hit = y[i] * (v @ w) < 1
            w *= 1 - rate * reg
            if hit:
                w += np.float32(rate * y[i] * weight[y[i]]) * v
            mean += w
    return (mean / max(1, t)).astype(np.float32)


def _sure(margin):
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


class Model:
    """Family machines and pair machines, as plain arrays."""

    def __init__(self, x: Vectors | np.ndarray, langs: list[str], families: dict[str, str], shares: list[float] = ()):
        """``shares``: the texts' letter shares; without them no share is too small."""
        x = x if isinstance(x, Vectors) else Vectors.of(x)
        lang, self.langs = np.array(langs), sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for a in self.langs:
            self.members.setdefault(families.get(a, a), []).append(a)
        family = np.array([families.get(a, a) for a in langs])
        self.families = sorted(self.members)
        self.of_family = [_svm(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.of_pair = {}
        for group in self.members.values():
            for a, b in combinations(group, 2):
                own = (lang == a) | (lang == b)
                self.of_pair[a, b] = _svm(x.where(own), np.where(lang[own] == a, 1, -1))
        self.profiles = [_profile(x.where(lang == a)) for a in self.langs]
        self.least_excess, self.least_share = -np.inf, 0.0
        if len(x) >= LEAST_LEARNED:
            half = np.zeros(len(x), int)
            for a in self.langs:
                half[np.flatnonzero(lang == a)[1::2]] = 1
            held = []
            for h in (0, 1):
                of_other = [_profile(x.where((half != h) & (lang == a))) for a in self.langs if ((half != h) & (lang == a)).any()]
                held += [_excess(v, of_other) for v in x.where(half == h)] if of_other else []
            self.least_excess = ROOM * min(0.0, float(np.quantile(held, BELOW)))
            if len(shares):
                self.least_share = float(np.quantile(shares, BELOW)) / ROOM

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or (x := features(text)) is None:
            return UNKNOWN, 0.0
        margin = lambda w: float(x @ w[:-1] + w[-1])
        family, score = self.families[0], 1.0  # of the margins
        fit = self._fit(text, x)
        if self.of_family:
            m = [margin(w) for w in self.of_family]
            best = int(np.argmax(m))
            family, score = self.families[best], float(_sure(m[best] - max(v for i, v in enumerate(m) if i != best)))
        group = self.members[family]
        if len(group) == 1:
            return group[0], score * fit
        votes, sums, least = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0), dict.fromkeys(group, 1.0)
        for a, b in combinations(group, 2):
            m = margin(self.of_pair[a, b])
            votes[a if m >= 0 else b] += 1
            for k, v in ((a, m), (b, -m)):
                sums[k] += v
                least[k] = min(least[k], float(_sure(v)))
        won = max(group, key=lambda k: (votes[k], sums[k]))
        return won, score * least[won] * fit

    def _fit(self, text: str, x: np.ndarray) -> float:
        below = min(0.0, _excess(x, self.profiles) - self.least_excess)
        share = min(1.0, letter_share(text) / self.least_share) if self.least_share else 1.0
        return float(np.exp(8 * below)) * share ** 8


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> Model:
    """``learn``: a condition on the rows of ``docs`` that may be learned from."""
    rows = docs.where(learn).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        "text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)

    def vectors(batches):
        seen = set()  # of the sample: copies of a text are learned once
        for b in batches:
            got = []
            for lang, k, text in zip(b.column("lang").to_pylist(), b.column("k").to_pylist(), b.column("text")):
                if (lang, k) not in seen and (x := features(text.as_py())) is not None:
                    got.append((lang, k, np.flatnonzero(x).astype(np.int16).tobytes(), x[x > 0].tobytes(), letter_share(text.as_py())))
                seen.add((lang, k))
            cols = list(zip(*got)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["lang", "k", "at", "x", "share"])

    sample = rows.where(spread < share).withColumn("k", F.xxhash64("text")).mapInArrow(
        vectors, "lang string, k long, at binary, x binary, share double").dropDuplicates(["lang", "k"]).toPandas().sort_values(["lang", "k"])
    x = Vectors([(np.frombuffer(at, np.int16), np.frombuffer(v, np.float32)) for at, v in zip(sample["at"], sample["x"])])
    return Model(x, list(sample["lang"]), families or FAMILIES, list(sample["share"]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row``, ``lang_pred``, ``score`` (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            row = b.column("row")
            found = [sent.value.predict(t.as_py()) for t in pc.struct_field(row, text_col)]  # texts one by one, not all at once
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # a worker lives on

    base = pack(docs, id_col, text_col).select("row")
    fields = [base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return base.mapInArrow(rows, T.StructType(fields))


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % by


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, remainder("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", F.coalesce(remainder("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

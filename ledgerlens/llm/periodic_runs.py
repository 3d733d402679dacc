"""Periodic runs: maximal stretches of a text that repeat one block of words at least four times.

A text's words become integers. At every dyadic scale B = 1, 2, 4, ... the text is cut into aligned blocks of
B words, and the sum of squared differences between a block and the B stretches that begin B to 2B - 1 words
behind it is computed for all of them at once, by number-theoretic transforms of length 2B. Where the sum is
zero the block occurs again; the distance is a possible period, which is extended to both sides.

Why that finds every run of period q and length >= 4q: at the scale with B <= q < 2B some aligned block begins
less than B words behind the run's start, and block and copy, at most 2B + q <= 3q words, lie in the run.

* Sums are exact: values are first positions of words in their text, taken in digits so small that no sum of
  B squares reaches the modulus; all digits must agree.
* A block is transformed only if every word of it occurs again within less than 2B words, which a block with a
  copy in reach must fulfil. In prose hardly any block does.
* Three or more copies in reach mean that the block has a period g itself, and that its copies stand g apart in
  one stretch of period g. The run's period is then the distance between the ends of the block's stretch and
  the copies' stretch (both ends lie in the run, for the block named above). So a block gives two distances at
  most, and a text of n words n log n work, also where it is one word over and over.
* Stretches are extended by bisection over prefix hashes (two moduli, 62 bits), as long as a stretch may be.

Texts are handled alone, in tasks, some at a time: nothing is shuffled, collected or broadcast, and a lost
executor costs its tasks.

Defined cases: null and empty texts, and texts without a word, have no runs, and their collapsed text is empty;
very long texts are one task's, in memory in proportion to the text; runs with equal bounds are one run, with
its smallest period; rows that repeat, null ids and clashing columns come back as they are, inside ``row``; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import pack, table

#: 15 * 2^27 + 1 is a prime with roots of unity of every order up to 2^27; 31 generates its group.
PRIME, GENERATOR = 15 * 2**27 + 1, 31
#: Moduli and bases of the prefix hashes.
HASHES = ((PRIME, 1_402_024_253), (2**31 - 1, 911_382_323))
#: A run is at least so long, and at least so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text that are handled at a time, and matrix cells that are transformed at a time.
AT_ONCE, CELLS = 4_000_000, 1 << 20
_FAR = np.int64(2**62)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _times(a, b, p: int):
    """a * b mod p, for numbers below p < 2^31."""
    x = a * b
    return x - x // np.uint64(p) * np.uint64(p)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out, done = np.ones(max(n, 1), np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = _times(out[:more], np.uint64(pow(base, done, p)), p)
        done += more
    return out


def _forward(a: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    p, n = np.uint64(PRIME), a.shape[1]
    h = n // 2
    while h:
        x = a.reshape(len(a), -1, 2, h)
        u, v = x[:, :, 0], x[:, :, 1]
        low, high = u + v, u - v
        roots = _powers(pow(GENERATOR, (PRIME - 1) // (2 * h), PRIME), h, PRIME)
        x[:, :, 0], x[:, :, 1] = np.minimum(low, low - p), _times(np.minimum(high, high + p), roots, PRIME)
        h //= 2
    return a


def _backward(a: np.ndarray) -> np.ndarray:
    p, n = np.uint64(PRIME), a.shape[1]
    h = 1
    while h < n:
        x = a.reshape(len(a), -1, 2, h)
        roots = _powers(pow(GENERATOR, PRIME - 1 - (PRIME - 1) // (2 * h), PRIME), h, PRIME)
        u, v = x[:, :, 0].copy(), _times(x[:, :, 1], roots, PRIME)
        low, high = u + v, u - v
        x[:, :, 0], x[:, :, 1] = np.minimum(low, low - p), np.minimum(high, high + p)
        h *= 2
    return _times(a, np.uint64(pow(n, PRIME - 2, PRIME)), PRIME)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row: the sums of squared differences of a block of B numbers and the B stretches of a window
    of 2B - 1 numbers. Exact as long as the sums are below PRIME. B is a power of two."""
    rows, b = blocks.shape
    x, y = np.zeros((rows, 2 * b), np.uint64), np.zeros((rows, 2 * b), np.uint64)
    x[:, :b], y[:, :2 * b - 1] = blocks[:, ::-1], windows
    # What wraps around falls outside of the B places that are read.
    cross = _backward(_times(_forward(x), _forward(y), PRIME))[:, b - 1:2 * b - 1]
    squares = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(windows.astype(np.uint64) ** 2, axis=1)], axis=1)
    own = (blocks.astype(np.uint64) ** 2).sum(1, keepdims=True)
    total = (own + squares[:, b:] - squares[:, :-b]) % np.uint64(PRIME) + np.uint64(2 * PRIME) - np.uint64(2) * cross
    return total % np.uint64(PRIME)


class _Words:
    """Some texts, one behind the other: ``code`` (first position of the word in its text), ``text`` (whose word it
    is), ``to_next`` (words to the next place of the same word in the text), first words and ends of texts."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n = len(words)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.lengths = lengths
        text = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(words, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        self.to_next = np.full(n, _FAR)
        same = np.flatnonzero(~new)
        self.to_next[order[same - 1]] = order[same] - order[same - 1]
        heads = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        self.code = np.empty(n, np.int64)
        self.code[order] = heads - self.starts[text[heads]]
        self.text = text
        self._hashes = None

    def _prefixes(self):
        if self._hashes is None:
            self._hashes = []
            for p, base in HASHES:
                powers = _powers(base, len(self.code) + 1, p)
                sums = np.cumsum(_times((self.code + 1).astype(np.uint64) % np.uint64(p), powers[:-1], p))
                self._hashes.append((p, powers, np.concatenate([np.zeros(1, np.uint64), sums]) % np.uint64(p)))
        return self._hashes

    def _same(self, i, j, length):
        """Whether the stretches of ``length`` words at i and at j >= i are equal."""
        out = np.ones(len(i), bool)
        for p, powers, sums in self._prefixes():
            q = np.uint64(p)
            left, right = sums[i + length] + q - sums[i], sums[j + length] + q - sums[j]
            out &= _times(left % q, powers[j - i], p) == right % q
        return out

    def agree(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i on (back: before i) equal those from j on (before j), at most ``room``."""
        out = np.zeros(len(i), np.int64)
        step = 1 << (int(room.max()).bit_length() if len(room) else 0)
        while step:
            wider = np.flatnonzero(out + step <= room)
            if len(wider):
                size = out[wider] + step
                shift = size if back else 0
                fits = self._same(i[wider] - shift, j[wider] - shift, size)
                out[wider[fits]] += step
            step //= 2
        return out


def _copies(w: _Words, at: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) that may be a run's period, for blocks of ``b`` words at ``at``."""
    found = []
    n = len(w.code)
    digit = int(((PRIME - 1) // b) ** 0.5)
    for k in range(0, len(at), max(1, CELLS // (2 * b))):
        pos = at[k:k + max(1, CELLS // (2 * b))]
        block = w.code[pos[:, None] + np.arange(b)]
        window = w.code[np.minimum(pos[:, None] + np.arange(b, 3 * b - 1), n - 1)]
        room = w.ends[w.text[pos]] - pos - 2 * b
        hit = np.arange(b) <= room[:, None]
        while True:
            hit &= squared_differences(block % digit, window % digit) == 0
            block, window = block // digit, window // digit
            if not block.any() and not window.any():
                break
        count = hit.sum(1)
        one, many = count > 0, count > 2
        first, last = hit.argmax(1) + b, 2 * b - 1 - hit[:, ::-1].argmax(1)
        found += [(pos[one & ~many], first[one & ~many]), (pos[count == 2], last[count == 2])]
        if many.any():
            pos, first, hit = pos[many], first[many], hit[many]
            hit[np.arange(len(pos)), first - b] = False
            g = hit.argmax(1) + b - first
            end = w.ends[w.text[pos]]
            mine = pos + w.agree(pos, pos + g, end - pos - g)
            theirs = pos + first
            theirs = theirs + w.agree(theirs, theirs + g, end - theirs - g)
            d = theirs - mine
            ok = (d >= b) & (d < 2 * b)
            found.append((pos[ok], d[ok]))
    return np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([d for _, d in found] or [np.zeros(0, np.int64)])


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """``words``: integers, the texts one behind the other, ``lengths`` words each. Returns four arrays, sorted: text,
    start (in the text), length and smallest period of every run."""
    w = _Words(words, np.asarray(lengths, np.int64))
    tops, blocks = w.to_next, w.lengths
    kept, b = [], 1
    while len(tops):
        first = np.cumsum(blocks) - blocks
        of = np.repeat(np.arange(len(blocks)), blocks)
        near = np.flatnonzero(tops < 2 * b)
        at = w.starts[of[near]] + (near - first[of[near]]) * b
        at = at[at + 2 * b <= w.ends[of[near]]]
        if len(at):
            pos, d = _copies(w, at, b)
            begin, end = w.starts[w.text[pos]], w.ends[w.text[pos]]
            s = pos - w.agree(pos, pos + d, pos - begin, back=True)
            e = pos + d + w.agree(pos, pos + d, end - pos - d)
            long = e - s >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * d)
            kept.append(np.unique(np.stack([s[long], e[long], d[long]]), axis=1))
        halves = blocks // 2
        halves = np.where(w.lengths >= LEAST_EXPONENT * 2 * b, halves, 0)
        pair = np.repeat(first - 2 * (np.cumsum(halves) - halves), halves) + 2 * np.arange(halves.sum())
        tops, blocks, b = np.maximum(tops[pair], tops[pair + 1]), halves, 2 * b
    s, e, d = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), np.int64)
    order = np.lexsort([d, e, s])
    s, e, d = s[order], e[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, d = s[new], e[new], d[new]
    order = np.lexsort([d, s])
    s, e, d = s[order], e[order], d[order]
    text = w.text[s] if len(s) else s
    return text, s - w.starts[text], e - s, d


def _part(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    coded = pa.array([x for t in texts for x in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text, start, length, period = find_runs(coded, lengths)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    collapsed = []
    for k, words in enumerate(texts):
        i, j = bounds[k], bounds[k + 1]
        if i < j:
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, start[i:j] + period[i:j], 1)
            np.add.at(gone, start[i:j] + length[i:j], -1)
            words = compress(words, (np.cumsum(gone[:-1]) == 0).tolist())
        collapsed.append(b" ".join(words))
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([part.column("row"), pa.array(lengths), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                      names=["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row``, ``n_words``, ``runs`` (array of start, length, period, by start, then period) and
    ``collapsed``: the text's words, one space between, without those behind a run's first period."""

    def rows(batches):
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:]):
                yield _part(b.slice(i, j - i))
            pa.default_memory_pool().release_unused()  # a worker lives on

    base = pack(docs, id_col, text_col)
    fields = [base.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return base.select("row", "text").mapInArrow(rows, T.StructType(fields))


def plant_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end in every tenth document, chosen by the checksum of its id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    d = d.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    planted = F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_a").cast("int")), F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), place))
    return d.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(plant_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "row.doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-best.start).alias("start"), best.length.alias("length"),
        (-best.period).alias("period"), F.floor(1000 * best.length / -best.period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

"""Substring dedup with suffix automata of reference shards.

A word that lies in a window of ``WINDOW`` words whose sequence also starts in a document with a
smaller id is removed; windows are judged on the input. Documents are streamed through suffix
automata that keep, for every state, the smallest document it occurs in; where the matching
statistics reach ``WINDOW``, the state of the last ``WINDOW`` words tells whether that document is
smaller, and removed windows are merged into maximal spans.

What a shard holds. An automaton of all documents has no size bound and can't be broadcast, and
streaming all documents through all shards would be quadratic. So text is routed to shards by
anchors. Each window chooses one of the ``GRAM``-word sequences in it (the one of the smallest hash):
equal windows choose the same. Successive windows with one anchor form a piece of text. Only pieces
whose anchor occurs in two different documents can match; they are shuffled by anchor, and each task
builds one automaton at a time over consecutive anchors' pieces, some ``SHARD_WORDS`` words, and
streams the pieces through it.

An anchor with more than ``HOT`` pieces, in many texts or often in a few, would be too large a group for one automaton
(a piece has fewer than ``2 * WINDOW`` words). Its windows go as 128-bit hashes, each different one of a text once, to an aggregate with a map-side
phase and come back by a join that AQE splits. Texts with equal word sequences form a class, which is streamed once.

Defined cases: null texts hold no words; texts of fewer than ``WINDOW`` words keep all; null ids are
no reference and lose nothing; equal ids aren't smaller than each other; repeated rows are treated
alike; very long texts are cut by anchors like any other; an empty table gives an empty result; all
input columns come back inside ``row``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, broadcast_if_small, pack, staged, table
from ledgerlens.llm.minhash import WordHash, mix

WINDOW = 50
#: Words of an anchor.
GRAM = 16
SHARD_WORDS, HOT = 60_000, 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all sequences of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, seed, np.uint64)
    for i in range(size if n else 0):
        h = mix(h + words[i:i + n]) * _STEP
    return mix(h)


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: its hash, the first window, the number of windows."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    gram = min(GRAM, window)
    h, width = grams(words, gram), window - gram + 1
    # Sliding minimum by doubling; of equal hashes the leftmost.
    best, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        span += step
    start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return h[best[start]], start.astype(np.int32), np.diff(np.append(start, n)).astype(np.int32)


class SuffixAutomaton:
    """Of several word sequences; ``low`` of a state is the smallest document that its sequences occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.low = [-1], [0], [float("inf")]

    def _state(self, size: int, moves: dict, link: int, low) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.low.append(low)
        return len(self.size) - 1

    def add(self, words: list, doc) -> None:
        nxt, link, size, low = self.next, self.link, self.size, self.low
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
            else:
                p, new = last, None
                if q is None:
                    new = self._state(size[last] + 1, {}, 0, float("inf"))
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = new
                        p = link[p]
                    q = nxt[p][c] if p >= 0 else None
                if q is not None and size[q] == size[p] + 1:
                    link[new] = q
                    last = new
                elif q is not None:
                    copy = self._state(size[p] + 1, dict(nxt[q]), link[q], low[q])
                    link[q] = copy
                    if new is not None:
                        link[new] = copy
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    last = copy if new is None else new
                else:
                    last = new
            if doc < low[last]:
                low[last] = doc

    def close(self) -> None:
        """Passes every state's smallest document on to the states of its suffixes."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.low[s] < self.low[self.link[s]]:
                self.low[self.link[s]] = self.low[s]

    def lowest(self, words: list, window: int) -> list:
        """For each window of ``words``: the smallest document that it occurs in (infinite: in none)."""
        nxt, link, size = self.next, self.link, self.size
        out, state, length = [], 0, 0
        for at, c in enumerate(words, 1):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            while size[link[state]] >= window if state else False:
                state = link[state]
            if length >= window:
                length = window
            if at >= window:
                out.append(self.low[state] if length >= window else float("inf"))
        return out


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word spans covered by the windows at ``starts`` (in order)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + window).tolist()))


def _anchor_rows(window: int):
    def run(batches):
        hashes = WordHash()
        for b in batches:
            out = []
            for t in b.column(2):
                words = (t.as_py() or b"").split()
                h, m = np.unique(anchors(hashes.of(words), window)[0], return_counts=True)
                out.append((len(words), xxhash.xxh3_128_digest(b" ".join(words)), h.view(np.int64), m.astype(np.int32)))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             names=["id", "k", "n", "print", "h", "m"])

    return run


def _pieces(window: int):
    """(v, print, text, found: anchors to follow, and whether they are hot) to a row for each different
    piece of a text, or for each different window of a hot anchor; ``at`` lists the first words."""

    def run(batches):
        hashes = WordHash()
        for b in batches:
            src, rows = [], []
            for i, (t, found) in enumerate(zip(b.column("text"), b.column("found"))):
                words, found = t.as_py().split(), {f["h"]: f["hot"] for f in found.as_py()}
                coded = hashes.of(words)
                if any(found.values()):
                    one, two = grams(coded, window, 1).view(np.int64).tolist(), grams(coded, window, 2).view(np.int64).tolist()
                places: dict[tuple, list[int]] = {}
                for h, first, m in zip(*[x.tolist() for x in _signed(*anchors(coded, window))]):
                    if h not in found:
                        continue
                    if found[h]:
                        for w in range(first, first + m):
                            places.setdefault((None, None, one[w], two[w]), []).append(w)
                    else:
                        places.setdefault((h, b" ".join(words[first:first + m + window - 1]), None, None), []).append(first)
                src += [i] * len(places)
                rows += [(*key, at) for key, at in places.items()]
            kept = b.select(["v", "print"]).take(pa.array(src, pa.int64()))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             names=["v", "print", "h", "piece", "w1", "w2", "at"])

    return run


def _signed(h: np.ndarray, start: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return h.view(np.int64), start, runs


def _match(window: int):
    """Pieces in the order of their anchors to removed spans; one automaton at a time."""

    def shard(rows: list[tuple]) -> list[tuple]:
        first: dict[bytes, object] = {}  # of equal pieces the smallest document
        for v, _, _, piece in rows:
            if piece not in first or v < first[piece]:
                first[piece] = v
        if len(rows) == 1:
            return []
        codes: dict[bytes, int] = {}
        coded = {p: [codes.setdefault(w, len(codes)) for w in p.split()] for p in first}
        automaton = SuffixAutomaton()
        for p, words in coded.items():
            automaton.add(words, first[p])
        automaton.close()
        low = {p: np.array(automaton.lowest(words, window), object) for p, words in coded.items()}
        out = []
        for v, name, at, piece in rows:
            found = _spans(np.flatnonzero(low[piece] < v), window)
            if found:
                out.append((name, [{"first": s + a, "end": s + z} for s in at for a, z in found]))
        return out

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            out = []
            cols = [b.column(c) for c in ("h", "v", "print", "at", "piece")]
            for h, v, name, at, piece in zip(*[c.to_pylist() for c in cols]):
                if h != last and size >= SHARD_WORDS:
                    out += shard(rows)
                    rows, size = [], 0
                rows.append((v, name, at, piece))
                size += piece.count(b" ") + 1
                last = h
            yield _batch(out, b.schema)
        if rows:
            yield _batch(shard(rows), b.schema)

    def _batch(out, schema):
        names, spans = list(zip(*out)) or ((), ())
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(spans, kind)], names=["print", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``row``, ``n_words``, ``n_removed``, ``kept`` (the remaining words, joined by blanks; null text: null)."""
    base = pack(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    id_type = dict(base.dtypes)["id"]
    rows = staged(base.select("id", "k", "text").mapInArrow(
        _anchor_rows(window), f"id {id_type}, k long, n long, print binary, h array<long>, m array<int>"), "substring-anchors")
    classes = staged(rows.where(f"id is not null and n >= {window}").groupBy("print").agg(F.min(F.struct("id", "k", "h", "m")).alias("c"))
                     .select("print", F.col("c.id").alias("v"), "c.k", "c.h", "c.m"), "substring-classes")
    each = classes.select("v", "k", "print", F.inline(F.arrays_zip("h", "m")))
    met = each.groupBy("h").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.sum("m").alias("m")).where("x < y").select(
        "h", (F.col("m") > HOT).alias("hot"))
    found = staged(each.drop("m").join(met, "h").groupBy("v", "k", "print").agg(F.collect_list(F.struct("h", "hot")).alias("found")), "substring-found")
    wanted = broadcast_if_small(found.select(F.col("v").alias("id"), "k"))
    texts = base.select("id", "k", "text").join(wanted, ["id", "k"], "left_semi").dropDuplicates(["id", "k"])
    pieces = staged(texts.withColumnRenamed("id", "v").join(found, ["v", "k"]).select("v", "print", "text", "found").mapInArrow(
        _pieces(window), f"v {id_type}, print binary, h long, piece binary, w1 long, w2 long, at array<int>"), "substring-pieces")
    spans = pieces.where("h is not null").select("h", "v", "print", "at", "piece").repartition("h").sortWithinPartitions("h").mapInArrow(
        _match(window), "print binary, spans array<struct<first:long,end:long>>")
    hot = pieces.where("h is null").select("v", "print", "at", "w1", "w2")
    lowest = hot.groupBy("w1", "w2").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").select("w1", "w2", "low")
    later = hot.join(lowest, ["w1", "w2"]).where("v > low").select("print", F.transform("at", lambda x: F.struct(
        x.cast("long").alias("first"), (x + window).cast("long").alias("end"))).alias("spans"))
    removed = spans.union(later).groupBy("print").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    of_row = (rows.where("id is not null").select("id", "k", "print").distinct().join(classes.select("print", "v"), "print")
              .join(removed, "print", "left").select("id", "k", (F.col("id") > F.col("v")).alias("whole"), "spans"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, whole: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, all_of_it, found in zip(texts, whole, spans):
            words = (text or b"").split()
            n = len(words)
            if all_of_it is True or all_of_it == True:  # noqa: E712  a numpy or Python boolean, or None
                words = []
            elif found is not None and len(found):
                edge = np.zeros(n + 1, np.int64)
                for s in found:
                    edge[s["first"]] += 1
                    edge[s["end"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            out.append((n, n - len(words), None if text is None else b" ".join(words).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return attach(base, of_row).select("row", cut("text", "whole", "spans").alias("cut")).select("row", "cut.*")


def op1_substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed",
                                       F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws from documents),
win as (select doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) h from w, unnest(generate_series(1, len(ws) - 49)) t(s) where len(ws) >= 50),
hit as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by h) lo from win) where lo < doc_id),
gone as (select distinct doc_id, s + k pos from hit, unnest(generate_series(0, 49)) t(k)),
word as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) pos from w),
kept as (select doc_id, count(*) n, string_agg(word, ' ' order by pos) kept from word anti join gone using (doc_id, pos) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from w left join kept using (doc_id)"""

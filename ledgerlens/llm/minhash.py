"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Two small collections of ``PARTS``
parts, each part made of ``WIDTH`` minhashes, are computed; a table key is a *pair* of one part of
either collection. So ``2 * PARTS * WIDTH`` minhashes (54) make ``PARTS ** 2`` keys (81) of
``2 * WIDTH`` minhashes each; plain banding would need 486. A pair at similarity 0.8 shares a key
with probability 0.997, at 0.85 with 0.9997.

Documents with equal sets form a class; only one of them goes on. Candidates are first each key's
smallest document against its others. Confirmed links make components; keys whose documents are
still in more than one component then give all their pairs across components that the shingles which
a document holds alone allow to be similar enough. So no candidate is left out that could join two
components, and a group of copies isn't expanded into its pairs. Every candidate is confirmed on the full sets: ``100 * |A & B| >= percent * |A | B|``.

Defined cases: null texts and texts without words have an empty set and link with nothing; fewer
words than a shingle: the whole sequence is the one shingle; null ids link with nothing, have a
null component and are kept; rows that share an id are one vertex, their links count together (``one_of_each``
compares texts: of two unrelated ones with one id both stay); very long texts are sketched in blocks of shingles; ties
don't arise, as components go by the smallest id; an empty table gives an empty result. ``near_duplicates`` returns ids
and marks only, so other columns can't clash; ``one_of_each`` returns the input's columns.

Scale: sketches (some 200 bytes a document) are written once; keys are shuffled as (hash, id). Full
sets are made only for documents that share a key. Text is read in the scans and is not shuffled
unless the candidates' ids are too many for a broadcast of checked size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, broadcast_if_small, pack, shuffled, staged, table
from ledgerlens.llm.graph import components

PARTS, WIDTH = 9, 3
SHINGLE, PERCENT = 5, 80
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, (2 * PARTS * WIDTH, 1), np.uint64)
_MUL = _RNG.integers(0, 1 << 63, (2 * PARTS * WIDTH, 1), np.uint64) | np.uint64(1)
_BLOCK = 1 << 14
#: Texts whose sets a task holds at a time.
AT_ONCE = 1000
#: Documents of a block when a key's documents are compared across components; columns of a matrix.
BLOCK, _COLUMNS = 512, 8192


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mix(h + words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(h))


def sketch(s: np.ndarray) -> np.ndarray:
    """The parts of both collections, as signed numbers."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _BLOCK):
        low = np.minimum(low, ((s[i:i + _BLOCK] ^ _XOR) * _MUL).min(1))
    parts = np.zeros(2 * PARTS, np.uint64)
    for column in low.reshape(2 * PARTS, WIDTH).T:
        parts = mix(parts + column) * np.uint64(0x9E3779B97F4A7C15)
    return parts.view(np.int64)


def _sets(size: int, want: str):
    """For mapInArrow over (id, k, text as bytes): the set, or what is kept of it."""

    def run(batches):
        hashes = WordHash()
        for b in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            sets = [shingles(hashes.of((t.as_py() or b"").lower().split()), size) for t in b.column(2)]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            cols = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary())]
            more = [(sketch(s) if want == "parts" else s.view(np.int64)) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(more, pa.list_(pa.int64()))], names=["id", "k", "n", "print", want])
        pa.default_memory_pool().release_unused()  # a worker lives on

    return run


def _across(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one key (columns key, v, c) that are in different components c.

    The documents of a key's largest component are its major side, all others the minor side. Either
    is cut into blocks; a group is a pair of blocks, one of them minor. Groups are compared in tasks
    that return links only, for each document the smallest of each component.
    """
    of_c = still.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    per_key = of_c.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all")).select(
        "key", F.col("top.c").alias("major"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("majors"),
        F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("minors"))
    minor = F.col("c") != F.col("major")
    block = F.when(minor, F.pmod(F.xxhash64("v", "key"), F.col("minors"))).otherwise(
        F.col("minors") + F.pmod(F.xxhash64("v", "key"), F.col("majors"))).cast("int")
    others = F.sequence(F.lit(0), F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1)
    rows = (still.join(per_key, "key").withColumn("block", block).withColumn("other", F.explode(others))
            .select("key", "v", "c", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
            .join(shuffled(sets.select(F.col("id").alias("v"), "shingles")), "v"))
    kind = dict(still.dtypes)["v"]
    group = ["key", "bi", "bj"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare_groups(percent), f"a {kind}, b {kind}")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    of, column = of[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    for low in range(0, (column[-1] + 1) if len(column) else 0, _COLUMNS):
        i, j = np.searchsorted(column, [low, low + _COLUMNS])
        m = np.zeros((len(sets), _COLUMNS), np.float32)
        m[of[i:j], column[i:j] - low] = 1
        total += m @ m.T
    return total


def _compare_groups(percent: int):
    def compare(v: list, c: list, block: list, cross: bool, sets: list[np.ndarray]) -> list[tuple]:
        code = {x: i for i, x in enumerate(set(c))}
        if len(code) < 2:
            return []
        comp, side, size = np.array([code[x] for x in c]), np.array(block), np.array([len(s) for s in sets])
        common = _overlaps(sets)
        linked = 100 * common >= percent * (size[:, None] + size - common)
        linked &= comp[:, None] != comp
        if cross:
            linked &= side[:, None] != side
        return list({(comp[i], comp[j]): (v[i], v[j]) for i, j in zip(*np.nonzero(np.triu(linked)))}.values())

    def run(batches):
        key, group = None, ([], [], [], [])
        for b in batches:
            out = []
            keys = list(zip(*[b.column(x).to_pylist() for x in ("key", "bi", "bj")]))
            values, ends = b.column("shingles").values.to_numpy(), b.column("shingles").offsets.to_numpy()
            for at, (k, *row) in enumerate(zip(keys, *[b.column(x).to_pylist() for x in ("v", "c", "block")])):
                if k != key:
                    if len(group[0]) > 1:
                        out += compare(*group[:3], key[1] != key[2], group[3])
                    key, group = k, ([], [], [], [])
                for have, x in zip(group, (*row, values[ends[at]:ends[at + 1]].copy())):
                    have.append(x)
            yield _links(out, b.schema)
        if len(group[0]) > 1:
            yield _links(compare(*group[:3], key[1] != key[2], group[3]), b.schema)
        pa.default_memory_pool().release_unused()

    def _links(out, schema):
        a, z = zip(*out) if out else ((), ())
        kind = schema.field("v").type
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(z, kind)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id``, ``k``, ``n_shingles``, ``component_id``, ``kept``."""
    base = pack(docs, id_col, text_col).select("id", "k", F.col("text").cast("binary").alias("text"))
    id_type = dict(base.dtypes)["id"]
    schema = f"id {id_type}, k long, n long, print binary"
    rows = staged(base.mapInArrow(_sets(shingle, "parts"), f"{schema}, parts array<long>"), "minhash-sketches")
    classes = staged(rows.where("id is not null and n > 0").groupBy("print").agg(
        F.min("id").alias("v"), F.first("n").alias("n"), F.first("parts").alias("parts")), "minhash-classes")
    i, j = F.posexplode(F.slice("parts", 1, PARTS)).alias("i", "x"), F.posexplode(F.slice("parts", PARTS + 1, PARTS)).alias("j", "y")
    keys = classes.select("v", "parts", i).select("v", "i", "x", j).select(F.xxhash64("i", "x", "j", "y").alias("key"), "v")
    shared = keys.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").select("key", "low")
    met = staged(shuffled(keys).join(shared, "key"), "minhash-keys")
    stars = staged(met.where("v > low").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct(), "minhash-stars")

    wanted = broadcast_if_small(met.select(F.col("v").alias("id")).distinct())
    sets = staged(base.join(wanted, "id", "left_semi").mapInArrow(_sets(shingle, "shingles"), f"{schema}, shingles array<long>")
                  .select("id", "print", "shingles").dropDuplicates(["id", "print"]), "minhash-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - F.col("common")
        fits = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
        return (pairs.join(shuffled(a), "a").join(shuffled(b), "b").where(fits).withColumn("common", common)
                .where(100 * F.col("common") >= percent * union).select("a", "b"))

    # An id that stands for several texts joins their classes.
    of_row = rows.where("id is not null and n > 0").select("id", "print").join(classes.select("print", "v"), "print").select("id", "v")
    several = of_row.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id")
    united = of_row.join(several, "id").select(F.col("id").alias("a"), F.col("v").alias("b"))
    links = staged(confirmed(stars).union(united).distinct(), "minhash-links")
    found = staged(components(links), "minhash-components")

    def labelled(c: DataFrame) -> DataFrame:
        return (met.select("key", "v").join(c.withColumnRenamed("id", "v"), "v", "left")
                .withColumn("c", F.coalesce("component", "v")).select("key", "v", "c"))

    now = labelled(found)
    open_keys = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    still = now.join(open_keys, "key")
    # Keys with the same documents ask the same question: one of them is enough.
    once = (still.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("v")).alias("x"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("y"))
            .groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"))
    still = staged(still.join(once, "key"), "minhash-open")
    more = staged(_across(still, sets, percent), "minhash-more")
    if not more.isEmpty():
        found = components(links.union(more))
    own = rows.join(classes.select("print", "v"), "print", "left").join(found.withColumnRenamed("id", "v"), "v", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "v", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return own.select("id", "k", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (null ids and empty texts: all).

    Texts are compared, not ids: of two unrelated texts with one id both stay; of equal rows, one does."""
    base = pack(docs, id_col, text_col)
    texts = base.select(F.when(F.col("id").isNotNull(), F.col("k")).alias("vertex"), "text")
    marks = near_duplicates(texts, "vertex", "text", **how).where("id is not null and n_shingles > 0").select(F.col("id").alias("vertex"), "component_id").distinct()
    ids = base.select(F.col("k").alias("vertex"), "id").where("id is not null").distinct()
    least = marks.join(ids, "vertex").groupBy("component_id").agg(F.min(F.struct("id", "vertex")).alias("least")).select("least.*")
    once = base.join(least.select(F.col("vertex").alias("k"), F.col("id").alias("_id")), "k").where(F.col("id") == F.col("_id")).dropDuplicates(["k", "id"])
    free = base.where(F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return once.select("row.*").union(free.select("row.*"))


def op2_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) ws from documents),
sh as (select distinct doc_id, md5(array_to_string(ws[s:s + 3], ' ')) h from w, unnest(generate_series(1, greatest(len(ws) - 3, 1))) t(s) where len(ws) > 0),
size as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) m from sh a join sh b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
low as (select a, min(b) lo from reach group by a)
select w.doc_id, coalesce(n, 0) n_shingles, least(w.doc_id, coalesce(lo, w.doc_id)) component_id, coalesce(lo, w.doc_id) >= w.doc_id kept
from w left join size using (doc_id) left join low on a = w.doc_id"""

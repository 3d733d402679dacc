"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to it if their inner product exceeds a threshold. The
directions are a random product code: after a random rotation the space is cut into blocks, each
block has its own small codebook of random unit vectors, and every combination of one codeword per
block is a direction. So a vector's scores against ``sum`` of the codebooks' sizes decide its
membership in their ``product`` of directions: all that exceed the threshold are listed, block by
block, dropping what can no longer reach it. Vectors of one label that share a filter are compared
by their cosine in double precision; nothing else is linked.

The number of directions grows with the number of vectors, so that filters keep their mean size
(``IN_FILTER``), and the threshold is set so that a random vector belongs to ``LISTED`` directions
in each of ``CODES`` independent codes. Recall at cosine 0.98 is measured in the tests.

What is shuffled for all directions is a sketch: four bits a component, with the sketch's exact distance from its vector.
A task bounds the cosine of two vectors by that of their sketches; of a filter only vectors go on that may reach the
threshold with another one there (all of them, if the filter is larger than a block). Their vectors then follow.

Equal vectors of a label form a class that is compared once; ``n_links`` counts all their copies.
Filters of more than ``BLOCK`` classes are cut into blocks, and each pair of blocks is a group of
its own, so that no task holds more than two blocks at a time. A pair that shares several filters
is counted in the first of them only. Pairs never leave a task: it returns, for each vector, its
links in the group and the smallest vector that it is connected with there.

Defined cases: null labels and ids, null, empty and zero vectors, and vectors with null or
non-finite components link with nothing (0 links, their own component; a null id has a null
component and is kept); vectors of different lengths don't link; rows that share an id are one
vertex; repeated rows are copies of each other; ties in a component go to the smaller id; columns other than the three
named aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_if_small, ship, staged, table
from ledgerlens.llm.graph import components

THRESHOLD = 0.98
CODES, LISTED, IN_FILTER, BLOCK = 3, 16, 16, 1024
#: Codewords of a block at most; beyond that one more block is cut.
CODEBOOK = 4096
#: Columns of the matrix that tells which vectors share an earlier filter.
COLUMNS = 4096


@lru_cache(maxsize=16)
def code(dim: int, n: int, which: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Rotation, codebooks and threshold of one product code for about ``n`` vectors of length ``dim``."""
    rng = np.random.default_rng([dim, which])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    wanted = max(64, LISTED * n / IN_FILTER)
    blocks = min(dim, max(2, math.ceil(math.log(wanted, CODEBOOK))))
    books = []
    for part in np.array_split(np.arange(dim), blocks):
        words = rng.normal(size=(math.ceil(wanted ** (1 / blocks)), len(part)))
        books.append(np.unique(words / np.linalg.norm(words, axis=1, keepdims=True), axis=0) / math.sqrt(blocks))
    probe = rng.normal(size=(200, dim))
    probe = probe / np.linalg.norm(probe, axis=1, keepdims=True) @ rotation
    low, high = -1.0, 1.0
    for _ in range(18):  # the lowest threshold that lists no more than LISTED directions on average
        mid = (low + high) / 2
        at_most = 64 * LISTED
        listed = [len(list_directions(x, books, mid, at_most)) for x in probe]
        low, high = (mid, high) if np.mean(listed) > LISTED else (low, mid)
    return rotation, books, high


def list_directions(x: np.ndarray, books: list[np.ndarray], threshold: float, at_most: int | None = None) -> np.ndarray:
    """Numbers of all directions whose inner product with the rotated vector ``x`` reaches the threshold
    (``at_most``: enough of them to know that there are more)."""
    at, scores = 0, []
    for b in books:
        scores.append(b @ x[at:at + b.shape[1]])
        at += b.shape[1]
    rest = np.cumsum([0.0, *[s.max() for s in scores[:0:-1]]])[::-1]  # the most that later blocks can add
    ids, sums = np.zeros(1, np.int64), np.zeros(1)
    for s, most in zip(scores, rest):
        order = np.argsort(-s)
        reach = np.searchsorted(-s[order], sums + (most - threshold), side="right")  # how many codewords keep it possible
        if at_most is not None and reach.sum() > 4096 * at_most:
            return np.zeros(at_most * 2, np.int64)
        which = np.repeat(np.arange(len(ids)), reach)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach)
        ids, sums = ids[which] * len(s) + order[rank], sums[which] + s[order[rank]]
    return np.sort(ids)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sketch(x: np.ndarray) -> tuple[bytes, float, float]:
    """A unit vector's components in steps of a seventh of the largest, two a byte; the step, and the distance from the vector."""
    step = float(np.abs(x).max()) / 7
    q = np.rint(x / step).astype(np.int8)
    nibbles = np.concatenate([q + 8, np.full(len(q) % 2, 8)]).astype(np.uint8)
    return (nibbles[::2] << 4 | nibbles[1::2]).tobytes(), step, float(np.linalg.norm(x - step * q)) + 1e-9


def components_of(codes: list[bytes]) -> np.ndarray:
    """Steps of each component, a row a sketch; shorter vectors have zeros behind."""
    width = max(map(len, codes), default=0)
    both = np.frombuffer(b"".join(x if len(x) == width else x.ljust(width, b"\x88") for x in codes), np.uint8).reshape(len(codes), width)
    q = np.empty((len(codes), 2 * width), np.int8)
    q[:, ::2], q[:, 1::2] = both >> 4, both & 15
    return q - np.int8(8)


def may_reach(q: np.ndarray, step: np.ndarray, off: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some vectors may reach the threshold with another one, by their sketches."""
    x = q * step[:, None].astype(np.float32)
    most = x @ x.T + off[:, None] + off + off[:, None] * off + 1e-4
    np.fill_diagonal(most, -2)
    return most.max(1) >= threshold


def _prune(threshold: float):
    """For mapInArrow over memberships sorted by ``g``, the filter: those whose vector may reach the threshold in the filter.
    Filters of more than ``BLOCK`` vectors are too large for one comparison: all of theirs go on."""

    def run(batches):
        carry, passed = None, None  # rows of the last filter, if it may go on; the last filter, if all of it goes on

        def kept(rows, complete):
            nonlocal carry, passed
            g = rows.column("g").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            ends = np.append(starts[1:], len(g))
            q = components_of(rows.column("code").to_pylist())
            step, off = rows.column("step").to_numpy(), rows.column("off").to_numpy()
            keep = np.zeros(len(g), bool)
            carry = None
            for i, j in zip(starts.tolist(), ends.tolist()):
                if g[i] == passed or j - i > BLOCK:
                    keep[i:j], passed = True, g[i]
                elif j == len(g) and not complete:
                    carry = rows.slice(i)
                elif j - i > 1:
                    keep[i:j] = may_reach(q[i:j], step[i:j], off[i:j], threshold)
            return rows.select(["h", "v", "filter"]).filter(pa.array(keep))

        for b in batches:
            if b.num_rows:
                rows = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
                yield kept(rows, False)
        if carry is not None:
            yield kept(carry, True)

    return run


def _list_filters(n: int):
    def run(batches):
        for b in batches:
            lists, sketches = [], []
            for v in b.column("vec"):
                x = unit(np.array([v.as_py()]))[0]
                sketches.append(sketch(x))
                found = []
                for which in range(CODES):
                    rotation, books, threshold = code(len(x), n, which)
                    found.append(list_directions(x @ rotation, books, threshold) * CODES + which)
                lists.append(np.concatenate(found))
            code_, step, off = zip(*sketches) if sketches else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.sort(x) for x in lists], pa.list_(pa.int64())), pa.array(code_, pa.binary()),
                                              pa.array(step, pa.float64()), pa.array(off, pa.float64())],
                                             names=[*b.schema.names, "filters", "code", "step", "off"])

    return run


def _connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest place that it is connected with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(rows: list[dict], threshold: float) -> dict | None:
    """One group: vectors of one filter, or of a pair of blocks of it."""
    i, j = rows[0]["bi"], rows[0]["bj"]
    rows.sort(key=lambda r: r["v"])
    x = unit(np.array([r["vec"] for r in rows]))
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if i != j:
        side = np.array([r["block"] for r in rows])
        near &= side[:, None] != side
    if not near.any():
        return None
    here = rows[0]["filter"]
    place = np.repeat(np.arange(len(rows)), [sum(f < here for f in r["filters"]) for r in rows])
    column = np.unique([f for r in rows for f in r["filters"] if f < here], return_inverse=True)[1]
    counted = near.copy()  # not yet in an earlier filter that both belong to
    order = np.argsort(column, kind="stable")
    place, column = place[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(rows), COLUMNS), np.float32)
        m[place[a:z], column[a:z] - c] = 1
        counted &= ~(m @ m.T > 0)
    links = counted @ np.array([r["copies"] for r in rows], np.int64)
    low = _connect(len(rows), *np.nonzero(near))
    on = near.any(1)
    return {"v": [r["v"] for p, r in enumerate(rows) if on[p]], "h": [r["h"] for p, r in enumerate(rows) if on[p]],
            "links": [int(x) for x in links[on]], "low": [rows[p]["v"] for p in low[on]]}


def _compare_groups(threshold: float):
    def run(batches):
        group, key = [], None
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 1024):
                for r in b.slice(at, 1024).to_pylist():
                    new = (r["label"], r["filter"], r["dim"], r["bi"], r["bj"])
                    if new != key and len(group) > 1:
                        out.append(_compare(group, threshold))
                    if new != key:
                        group, key = [], new
                    group.append(r)
            yield _batch(out, b.schema)
        if len(group) > 1:
            yield _batch([_compare(group, threshold)], b.schema)

    def _batch(found, schema):
        found = [f for f in found if f]
        kinds = {"v": schema.field("v").type, "h": pa.int64(), "links": pa.int64(), "low": schema.field("v").type}
        return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[c]], t) for c, t in kinds.items()], names=list(kinds))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id``, ``n_links``, ``component_id``, ``kept``."""
    ship(vectors.sparkSession)
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.col(f"`{label_col}`").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    base = base.withColumn("h", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vec")))
    classes = staged(base.where("h is not null").groupBy("label", "vec", "h").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("dim", F.size("vec")), "caps-classes")
    n, types = classes.count(), dict(classes.dtypes)
    listed = staged(classes.mapInArrow(_list_filters(n), ", ".join(f"{c} {t}" for c, t in types.items())
                                       + ", filters array<long>, code binary, step double, off double"), "caps-filters")
    g = F.xxhash64("label", "dim", "filter")  # two filters that meet by chance only let more vectors through
    sketches = listed.select("label", "dim", "v", "h", "code", F.col("step").cast("float").alias("step"), F.col("off").cast("float").alias("off"),
                             F.explode("filters").alias("filter")).select(g.alias("g"), "h", "v", "filter", "code", "step", "off")
    members = staged(sketches.repartition("g").sortWithinPartitions("g").mapInArrow(_prune(threshold), f"h long, v {types['v']}, filter long"), "caps-members")
    members = members.join(listed.drop("code", "step", "off"), ["h", "v"])
    sizes = members.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = sizes.select("label", "dim", "filter", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("h", "v"), F.col("blocks")).cast("int")
    rows = (members.join(blocks, ["label", "dim", "filter"])
            .withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other"))
    group = ["label", "dim", "filter", "bi", "bj"]
    found = staged(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        _compare_groups(threshold), f"v {types['v']}, h long, links long, low {types['v']}"), "caps-found")
    counted = found.groupBy("h", "v").agg(F.sum("links").alias("links"))
    # An id with several vectors joins their classes.
    of_row = base.where("h is not null").select("id", "h").join(classes.select("h", "v"), "h").select("id", "v").distinct()
    several = of_row.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id")
    united = of_row.join(several, "id").select(F.col("id").alias("a"), F.col("v").alias("b"))
    of = components(found.select(F.col("v").alias("a"), F.col("low").alias("b")).union(united))
    per_class = (classes.select("h", "v", "copies").join(counted, ["h", "v"], "left").join(of.withColumnRenamed("id", "v"), "v", "left")
                 .select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "v").alias("component_id")))
    return (base.select("id", "h").join(per_class, "h", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))


def op3_embedding(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: All pairs. (The query finds a pair at exactly the threshold with a probability of some 0.99; at more than that nearly always.)
SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
low as (select a, min(b) lo from reach group by a),
n as (select a, count(*) n from link group by a)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(lo, vec_id)) component_id, coalesce(lo, vec_id) >= vec_id kept
from embeddings left join low on low.a = vec_id left join n on n.a = vec_id"""

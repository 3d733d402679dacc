"""Hard negatives from shared lists: anchors that lie close together walk one list of candidates, sorted by bound.

For an anchor a and a cluster centre u, a candidate x scores at most |a| |x| cos(max(0, angle(x, u) - r)), where r is
the largest angle between u and an anchor of the cluster. So one sort of the candidates by that bound (for |a| = 1)
serves every anchor of the cluster: it walks the list from the top and stops, certified, where the bound falls below
the score that it still needs.

The list is spread over the cluster of machines. Vectors belong to cells (nearest of at most ``CELLS`` centres, fitted
to a bounded sample; the fit decides on speed, never on results), cells to blocks of a bounded size, by hash. A cell has
a bound, too: |a| times its largest norm times cos(max(0, angle(a, its centre) - its radius)). An anchor goes to the
blocks of those cells that it can't rule out; in a block, the anchors of one cell share one sorted list.

1. Positives: each anchor walks its own cell; the score of the last of its first positives so far rules out cells;
   then it walks the others.
2. Negatives: each anchor's positives give score ranges; the anchor walks the cells that reach the lowest of them.

Each walk passes on at most k candidates a block, anchor and range, and the best of those are taken by a window. A
group is a block of candidates with a chunk of the anchors, both bounded, however large a cell or label is.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; only
vectors of equal length meet; equal rows are one row; an id that is repeated with another label or vector is another
row, but no row is a partner of an anchor with its id; zero vectors score 0; ties go to the smaller id. Columns other
than the three named are not looked at. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, staged, table

#: Centres, and the rows they are fitted to, at most.
CELLS, FITTED = 64, 2048
#: Bytes of vectors in a block of candidates, and in a chunk of anchors.
BLOCK_BYTES = 16 << 20
#: Candidates that a walk looks at in one step; ranges that walk together.
STEP, TOGETHER = 512, 1024
#: Added to every bound for rounding: radians, and a share of the score.
SLACK, SHARE = 1e-6, 1e-9

_FOUND = "anchor_id long, anchor_k long, partner_of long, partner_of_k long, top double, id long, k long, score double"


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _reach(angle, radius):
    """The largest possible cosine, given the angle to a centre and the radius around it."""
    return np.cos(np.clip(angle - radius - SLACK, 0, math.pi))


def fit_centres(sample: list[list[float]], cells: int = CELLS) -> dict[int, np.ndarray]:
    """Vector length to centres (unit rows), by a few rounds of spherical k-means over each length's rows."""
    out: dict[int, np.ndarray] = {}
    for m in sorted({len(v) for v in sample} - {0}):
        x = np.unique(_units(np.array([v for v in sample if len(v) == m], float))[0], axis=0)
        x = x[np.random.default_rng(12).permutation(len(x))]
        centres = x[:max(1, cells * len(x) // max(len(sample), 1))][:cells]
        for _ in range(6):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            moved, norm = _units(sums)
            centres = np.where(norm[:, None] > 0, moved, centres)
        out[m] = centres
    return out


class _Best:
    """The first k candidates of each range so far: by score, then id, then k."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.need = k, least.copy()
        self.row, self.score, self.id, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, row, score, id_, key):
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        id_, key = np.concatenate([self.id, id_]), np.concatenate([self.key, key])
        order = np.lexsort([key, id_, -score, row])
        row, score, id_, key = row[order], score[order], id_[order], key[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.need[row[last]] = np.maximum(self.need[row[last]], score[last])
        first = rank < self.k
        self.row, self.score, self.id, self.key = row[first], score[first], id_[first], key[first]


def _walk(cands: dict, asks: dict, same_label: bool, k: int, out: list) -> None:
    """All ranges in ``asks`` (anchors of one cell) walk the candidates of a block."""
    x, norms, units = cands["v"], cands["norm"], cands["unit"]
    anchors, at, of = np.unique(asks["anchor_k"], return_index=True, return_inverse=True)
    v = asks["v"][at]
    unit, size = _units(v)
    centre = _units(unit.sum(0, keepdims=True))[0]
    bound = norms * _reach(_angles(units, centre)[:, 0], _angles(unit, centre).max())
    order = np.argsort(-bound, kind="stable")
    best = _Best(asks["low"], k)
    for i in range(0, len(order), STEP):
        reach = size[of] * bound[order[i]]
        walking = reach + np.abs(reach) * SHARE + SHARE >= best.need
        if not walking.any():
            break
        some = order[i:i + STEP]
        ask = np.flatnonzero(walking)
        there, back = np.unique(of[ask], return_inverse=True)
        score = (v[there] @ x[some].T)[back]
        fits = (cands["label"][some] == asks["label"][ask][:, None]) == same_label
        fits &= (cands["id"][some] != asks["anchor_id"][ask][:, None]) & (score >= best.need[ask][:, None]) & (score <= asks["top"][ask][:, None])
        r, c = np.nonzero(fits)
        if len(r):
            best.add(ask[r], score[r, c], cands["id"][some[c]], cands["k"][some[c]])
    out.append([*(asks[n][best.row] for n in ("anchor_id", "anchor_k", "partner_of", "partner_of_k", "top")), best.id, best.key, best.score])


def _walked(same_label: bool, k: int):
    def walk(candidates: pa.Table, asks: pa.Table) -> pa.Table:
        out: list = []
        if candidates.num_rows and asks.num_rows:
            c = {n: candidates[n].to_numpy() for n in ("id", "k", "label")} | {"v": _matrix(candidates["v"])}
            first = np.unique(np.stack([c["k"], c["id"]]), axis=1, return_index=True)[1]
            c = {n: a[first] for n, a in c.items()}
            c["unit"], c["norm"] = _units(c["v"])
            a = {n: asks[n].to_numpy() for n in ("anchor_id", "anchor_k", "label", "home", "partner_of", "partner_of_k", "top", "low")} | {"v": _matrix(asks["v"])}
            for home in np.unique(a["home"]):
                here = np.flatnonzero(a["home"] == home)
                here = here[np.argsort(a["anchor_k"][here], kind="stable")]
                for i in range(0, len(here), TOGETHER):
                    _walk(c, {n: x[here[i:i + TOGETHER]] for n, x in a.items()}, same_label, k, out)
        cols = [np.concatenate(x) for x in zip(*out)] if out else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2 + [pa.float64()]
        names = ["anchor_id", "anchor_k", "partner_of", "partner_of_k", "top", "id", "k", "score"]
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)

    return walk


class _Lists:
    """The vectors in cells and blocks, written once."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        ship(spark)
        sample = [r.v for r in rows.orderBy(F.xxhash64("k")).limit(FITTED).select("v").collect()]
        centres = self.centres = fit_centres(sample)

        def place(batches):
            for b in batches:
                size = np.array([len(v) for v in b.column("v")], np.int64)
                cell, angle, norm = np.full(len(size), -1), np.full(len(size), math.pi), np.zeros(len(size))
                for m in np.unique(size):
                    here = np.flatnonzero(size == m)
                    unit, norm[here] = _units(_matrix(b.column("v").take(pa.array(here))))
                    if m in centres:
                        far = _angles(unit, centres[m])
                        cell[here] = far.argmin(1)
                        angle[here] = far.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(cell, pa.int64()), pa.array(angle), pa.array(norm)],
                                                 names=[*b.schema.names, "m", "cell", "angle", "norm"])

        kind = "id long, label long, v array<double>, anchor boolean, k long, m long, cell long, angle double, norm double"
        self.rows = staged(rows.select("id", "label", "v", "anchor", "k").mapInArrow(place, kind), "negatives-cells")
        # A row for each cell: how many vectors, how long, how far from the centre.
        stats = self.rows.groupBy("m", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max("angle").alias("angle"),
                                                   F.sum(F.col("anchor").cast("long")).alias("anchors")).collect()
        self.cells = {(r.m, r.cell): (-(-r.n * 8 * max(r.m, 1) // BLOCK_BYTES), r.norm, r.angle) for r in stats}
        self.chunks = max(1, -(-sum(r.anchors for r in stats) * 8 * max([r.m for r in stats], default=1) // BLOCK_BYTES))
        number = F.col("m") * (CELLS + 1) + F.col("cell")
        parts = F.create_map(F.lit(-2).cast("long"), F.lit(1).cast("long"),
                             *[F.lit(x).cast("long") for (m, c), (n, _, _) in self.cells.items() for x in (m * (CELLS + 1) + c, n)])
        self.blocks = self.rows.select("id", "label", "v", "k", "m", "cell", F.pmod("k", F.coalesce(parts[number], F.lit(1))).alias("block"),
                                       F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"))

    def anchors(self) -> DataFrame:
        return self.rows.where("anchor").dropDuplicates(["id", "k"]).select(
            F.col("id").alias("anchor_id"), F.col("k").alias("anchor_k"), "label", "v", "m", F.col("cell").alias("home"),
            F.pmod(F.xxhash64("k"), F.lit(self.chunks)).cast("int").alias("chunk"))

    def walk(self, asks: DataFrame, same_label: bool, k: int, own: bool | None = None) -> DataFrame:
        """``asks``: anchors with ``partner_of``, ``partner_of_k``, ``top`` and ``low``: the first ``k`` candidates of each range, a block.
        ``own``: in the anchor's own cell only (True), in all but that (False), or everywhere (None)."""
        cells, centres = self.cells, self.centres

        def reached(batches):
            for b in batches:
                go: list[list[tuple[int, int]]] = []
                for m, home, v, low in zip(*(b.column(n).to_pylist() for n in ("m", "home", "v", "low"))):
                    unit, norm = _units(np.array([v], float))
                    here = []
                    for (size, cell), (n, longest, radius) in cells.items():
                        if size != m or (own is not None and (cell == home) != own):
                            continue
                        angle = _angles(unit, centres[m][cell:cell + 1])[0, 0] if cell >= 0 else 0.0
                        most = norm[0] * longest * _reach(angle, radius)
                        if most + abs(most) * SHARE + SHARE >= low:
                            here += [{"cell": cell, "block": i} for i in range(n)]
                    go.append(here)
                kind = pa.list_(pa.struct([("cell", pa.int64()), ("block", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(go, kind)], names=[*b.schema.names, "go"])

        kind = ", ".join(f"{n} {t}" for n, t in asks.dtypes) + ", go array<struct<cell:bigint,block:bigint>>"
        sent = asks.mapInArrow(reached, kind).select("*", F.inline("go")).drop("go")
        on = ["m", "cell", "block", "chunk"]
        return self.blocks.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(_walked(same_label, k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    of = Window.partitionBy("anchor_id", "anchor_k", "partner_of", "partner_of_k").orderBy(F.desc("score"), "id", "k")
    return found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100),
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each row where ``anchor`` holds: its first ``n_positives`` rows of the same label by inner product, and for each of these
    the first ``n_negatives`` rows of other labels that score no more than it, and no less than ``share`` of it.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score (double)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & ~bad).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    lists = _Lists(rows.withColumn("k", F.xxhash64("id", "label", "v")))
    nothing = [F.lit(0).cast("long").alias("partner_of"), F.lit(0).cast("long").alias("partner_of_k"), F.lit(math.inf).alias("top")]
    asks = staged(lists.anchors().select("*", *nothing, F.lit(-math.inf).alias("low")), "negatives-anchors")
    near = staged(_first(lists.walk(asks, True, n_positives, own=True), n_positives), "negatives-near")
    last = near.where(F.col("rank") == n_positives).select(F.col("anchor_k").alias("_k"), F.col("anchor_id").alias("_id"), F.col("score").alias("_low"))
    asks = asks.join(last, (F.col("anchor_k") == F.col("_k")) & (F.col("anchor_id") == F.col("_id")), "left")
    asks = asks.withColumn("low", F.coalesce("_low", "low")).drop("_k", "_id", "_low")
    far = lists.walk(asks, True, n_positives, own=False)
    positives = staged(_first(near.drop("rank").union(far), n_positives), "negatives-positives")
    p = positives.select(F.col("anchor_k").alias("_k"), F.col("anchor_id").alias("_id"), F.col("id").alias("partner_of"), F.col("k").alias("partner_of_k"),
                         F.col("score").alias("top"), (F.col("score") * share[0] / share[1]).alias("low"))
    ranges = lists.anchors().join(p, (F.col("anchor_k") == F.col("_k")) & (F.col("anchor_id") == F.col("_id"))).drop("_k", "_id")
    # The share is checked on whole numbers below; here a little room is left for the division.
    ranges = ranges.where("low <= top").withColumn("low", F.col("low") - F.abs("low") * SHARE)
    found = lists.walk(ranges, False, n_negatives).where(share[0] * F.col("top") <= share[1] * F.col("score"))
    return _first(found, n_negatives).select("anchor_id", F.col("partner_of").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                                             F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(256 * x).cast("double")))
    found = mine(rows.select("vec_id", whole.alias("embedding"), label.alias("label")), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""

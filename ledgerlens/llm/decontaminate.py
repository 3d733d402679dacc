"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Tokens are the lower-cased runs of letters, marks and digits. A mask reads six token positions and
ignores the others between them; the hash of what it reads at one position is a seed. Seeds of all
documents meet the seeds of all benchmark items in a join; every hit fixes an alignment (diagonal)
of item and document, and on that alignment the tokens themselves are compared. An item leaks if

* some window of ``min(20, item length)`` aligned tokens agrees in all but a fifth of its positions, or
* ``MIN_ITEM`` tokens in a row, or more, agree: the smallest excerpt of a longer item that counts, or
* the item has fewer than ``MIN_ITEM`` tokens and all of them stand in the document, in a row.

The three masks are lossless: wherever the ``tolerated(w)`` substitutions of a window of 13 to 20
tokens lie, some mask reads none of them somewhere in the window (a test enumerates all placements), and a run of 13
holds every mask. A fourth mask reads ``SHORTEST`` tokens in a row, for the first position of short items.

Defined cases: null and empty texts hold no token and no leak; items with fewer than ``SHORTEST`` tokens (a word
or two, which any text may hold), null items and null item texts are not searched; a repeated item id is searched under
each of its texts; rows that repeat id and text give their pairs once; of alignments that tie, the one with the smaller
start counts; very long texts give a seed a token and mask, like others; empty tables give no rows; other
input columns are not read.

Scale: seeds are made inside one generated stage over the scan and carry no text; the benchmark's seeds are broadcast
only after a measure of rows and bytes has shown them within bounds, otherwise both sides are shuffled by seed. Words
are fetched again for documents with hits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_if_small, pack, staged, table

#: Token offsets that each mask reads.
MASKS = ((0, 1, 3, 5, 7, 8), (0, 1, 2, 3, 5, 6), (0, 1, 2, 7, 8, 10))
WINDOW = 20
MIN_ITEM = 13
#: Tokens of the shortest item that is searched; the mask of short items reads so many.
SHORTEST = 5
SHORT_MASK = tuple(range(SHORTEST))


def tolerated(window: int) -> int:
    """Substitutions allowed in a window."""
    return window // 5


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def _seeds(df: DataFrame, keep: list[str], pos: str, of_items: bool = False) -> DataFrame:
    """One row per token position and mask: ``keep`` columns, ``pos``, ``seed``. Reads the column ``words`` (of items, ``length``)."""
    masks = (*MASKS, SHORT_MASK)
    offsets = sorted({o for m in masks for o in m})
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    shifted = F.arrays_zip(*[F.slice("_h", o + 1, F.greatest(F.size("_h") - o, F.lit(0))).alias(f"o{o}") for o in offsets])
    at = hashed.select(*keep, F.posexplode(shifted).alias(pos, "_at"))

    def wanted(i: int) -> Column:
        if not of_items:
            return F.lit(True)
        return F.col("length") >= MIN_ITEM if i < len(MASKS) else (F.col("length") < MIN_ITEM) & (F.col(pos) == 0)

    seeds = [F.when(wanted(i) & F.col("_at")[f"o{m[-1]}"].isNotNull(), F.xxhash64(F.lit(i), *[F.col("_at")[f"o{o}"] for o in m]))
             for i, m in enumerate(masks)]
    return at.select(*keep, pos, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return (a["k"] == b["_k"]) & a["id"].eqNullSafe(b["_id"])


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per (document, item) that overlap: ``id``, ``k``, ``item_id``, ``window``, ``matched``, ``start``."""
    bench = (items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("item_text"))
             .where("item_id is not null").select("item_id", F.xxhash64("item_text").alias("item_k"), tokens("item_text").alias("words"))
             .where(F.size("words") >= SHORTEST).dropDuplicates(["item_id", "item_k"])
             .withColumn("length", F.size("words")))
    wanted = broadcast_if_small(_seeds(bench, ["item_id", "item_k", "length"], "q", of_items=True))
    base = pack(docs, id_col, text_col).select("id", "k", "text")
    hits = staged(_seeds(base.select("id", "k", tokens("text").alias("words")), ["id", "k"], "p").join(wanted, "seed")
                  .select("id", "k", "item_id", "item_k", "length", (F.col("p") - F.col("q")).alias("diag")).distinct(), "decontaminate-hits")
    found = broadcast_if_small(hits.select(F.col("id").alias("_id"), F.col("k").alias("_k")).distinct())
    read = base.join(found, _same_document(base, found), "left_semi").dropDuplicates(["id", "k"])
    words = read.select(F.col("id").alias("_id"), F.col("k").alias("_k"), tokens("text").alias("words"))
    diag, length = F.col("diag"), F.col("length")
    there = F.slice("words", F.greatest(diag, F.lit(0)) + 1, length + F.least(diag, F.lit(0)))
    hits = hits.join(words, _same_document(hits, words)).select("id", "k", "item_id", "item_k", "length", "diag", there.alias("there"))
    texts = broadcast_if_small(bench.select("item_id", "item_k", F.col("words").alias("here")))
    same = F.zip_with("there", F.slice("here", F.greatest(-diag, F.lit(0)) + 1, F.size("there")), lambda a, b: (a == b).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("window") + 1),
                       lambda i: F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda s, x: s + x))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    run = F.aggregate("same", none, lambda r, x: F.struct(((r.now + 1) * x).alias("now"), F.greatest(r.best, (r.now + 1) * x).alias("best")), lambda r: r.best)
    in_window = F.when(F.size("same") >= F.col("window"), F.array_max(sums))
    compared = (hits.join(texts, ["item_id", "item_k"]).withColumn("window", F.least(F.lit(window), length)).withColumn("same", same)
                .withColumn("run", run).withColumn("matched", in_window))
    by_window = (length >= MIN_ITEM) & (F.col("matched") >= F.col("window") - F.floor(F.col("window") / 5))
    by_run = F.col("run") >= F.least(F.lit(MIN_ITEM), length)
    best = F.when(by_window, F.struct("matched", "window", (-diag).alias("at"))).when(
        by_run, F.struct(F.col("run").alias("matched"), F.col("run").alias("window"), (-diag).alias("at")))
    return (compared.withColumn("best", best).where("best is not null")
            .groupBy("id", "k", "item_id").agg(F.max("best").alias("best"))
            .select("id", "k", "item_id", "best.window", "best.matched", F.greatest(-F.col("best.at"), F.lit(0)).alias("start")))


def op10_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return (find_overlaps(docs, items).groupBy(F.col("id").alias("doc_id"), "item_id")
            .agg(F.max("window").alias("window"), F.max("matched").alias("matched")))


#: All alignments of all items with all documents that share five tokens, by the same three rules.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') ws from documents where text is not null),
i as (select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') ws from benchmark where item_id is not null and text is not null),
dt as (select doc_id, len(ws) size, unnest(ws) t, generate_subscripts(ws, 1) - 1 p from d),
it as (select item_id, ws, len(ws) n, unnest(ws) t, generate_subscripts(ws, 1) - 1 q from i where len(ws) >= 5),
m as (select doc_id, size, item_id, ws, n, p - q diag, q from dt join it using (t)),
a as (select doc_id, item_id, ws, diag, count(*) c from m group by all having count(*) >= 5),
r as (select m.*, c, count(*) over (partition by doc_id, item_id, ws, diag order by q range between 19 preceding and current row) in_window,
    q - row_number() over (partition by doc_id, item_id, ws, diag order by q) island from m join a using (doc_id, item_id, ws, diag)),
runs as (select doc_id, item_id, ws, diag, any_value(n) n, any_value(size) size, any_value(c) c, max(in_window) in_window, count(*) run
  from r group by doc_id, item_id, ws, diag, island),
best as (select doc_id, item_id, n, least(n, size - diag) - greatest(0, -diag) room, least(20, n) w, case when n < 20 then max(c) else max(in_window) end m, max(run) run
  from runs group by doc_id, item_id, ws, diag, n, size),
found as (select doc_id, item_id, case when n >= 13 and room >= w and m >= w - w // 5 then {'matched': m, 'window': w}
    when run >= least(13, n) then {'matched': run, 'window': run} end best from best)
select doc_id, item_id, cast(max(best)['window'] as integer) "window", cast(max(best)['matched'] as integer) matched
from found where best is not null group by doc_id, item_id"""

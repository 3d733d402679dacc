"""Line dedup by overlapping three-line windows.

Lines are what ``\\n`` separates. Every run of three consecutive lines of a document is a window,
named by the MD5 of its text. A window that occurs anywhere before - in a smaller id, or higher up
in the same document - is a later occurrence; all lines that later occurrences cover are removed
(covered positions are merged), the first occurrence stays. Windows of blank lines only don't count.

Defined cases: null text stays null with 0 lines; an empty text is one empty line; fewer than three
lines are never touched; very long texts have as many windows as lines; null ids rank after all others; equal ids rank by text hash; rows that
repeat id and text are one document and are treated alike; an empty table gives an empty result;
all input columns come back inside ``row``.

Scale: one row of about 40 bytes per line is shuffled by window hash. The first occurrence is a
``min`` with a map-side phase; the join that brings it back is a sort-merge join between two plain
exchanges, which AQE splits for a hot window. Removal is linear in the lines of a document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, pack, shuffled, table

WINDOW = 3


def _windows(base: DataFrame, window: int) -> DataFrame:
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(1), F.size("lines") - F.lit(window - 1))
    keys = F.transform(starts, lambda i: F.concat_ws("\n", F.slice("lines", i, window)))
    return (base.select("id", "k", lines.alias("lines")).where(F.size("lines") >= window)
            .select("id", "k", F.posexplode(keys).alias("pos", "body"))
            .where(F.col("body").rlike(r"\S"))
            .select(F.unhex(F.md5("body")).alias("key"), F.struct(F.col("id").isNull(), "id", "k", "pos").alias("at")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``row``, ``n_lines``, ``n_removed``, ``kept`` (the text without repeated windows)."""
    base = pack(docs, id_col, text_col)
    found = _windows(base, window)
    first = found.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    later = (shuffled(found).join(first.select("key", "first"), "key").where("at > first")
             .groupBy(F.col("at.id").alias("id"), F.col("at.k").alias("k"))
             .agg(F.collect_set("at.pos").alias("starts")))

    @F.pandas_udf("n_lines long, n_removed long, kept string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, starts):
            if text is None:
                out.append((0, 0, None))
            elif at is None:
                out.append((text.count("\n") + 1, 0, text))
            else:
                lines = text.split("\n")
                covered = {i for s in at for i in range(s, s + window)}
                out.append((len(lines), len(covered), "\n".join(x for i, x in enumerate(lines) if i not in covered)))
        return pd.DataFrame(out, columns=["n_lines", "n_removed", "kept"])

    # A filter on the results would be pushed below and cut all texts a second time, in workers of its own; not if the
    # function counts as nondeterministic.
    once = cut.asNondeterministic()
    return attach(base, later).select("row", once("text", "starts").alias("cut")).select("row", "cut.*")


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed",
                                    F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line,
    generate_subscripts(string_split(text, chr(10)), 1) pos from documents where text is not null),
w as (select doc_id, pos, line, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d body
  from l window d as (partition by doc_id order by pos)),
r as (select doc_id, pos, line, body is not null and regexp_matches(body, '\S')
    and row_number() over (partition by body order by doc_id, pos) > 1 later from w),
c as (select doc_id, pos, line, later or coalesce(lag(later, 1) over d, false) or coalesce(lag(later, 2) over d, false) gone
  from r window d as (partition by doc_id order by pos)),
k as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') kept from c group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from documents d left join k using (doc_id)"""

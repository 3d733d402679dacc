"""Connected components of a table of links, by alternating large-star and small-star steps.

Every round replaces links by links to the smallest neighbour; the number of rounds grows with the
logarithm of the largest component. All steps are joins and ``min`` aggregates with a map-side
phase, so a vertex with a great many links is no group that one task would have to hold. Every
round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b (any order, repeats and loops allowed). Returns (id, component) for every
    vertex that has a link to another one; the component is the smallest vertex. Null ends count as no link."""
    e = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = staged(small, "links")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())

"""Keep the rows whose key is in another table, map-side, before anything is aggregated or shuffled.

``only(facts, keys, column)`` is ``facts`` semi-joined to ``keys``, by the cheapest means that the size of ``keys`` allows:

1. The keys' smallest and largest value are a range condition, which reaches the Parquet scan and skips row groups.
2. Few keys are broadcast.
3. More keys become bits: blocks of 32,768 bits, made by ``bitmap_construct_agg`` in tasks. Integer keys that lie close
   together (order ids of a campaign do) take one bit each, so the same broadcast holds some hundred times as many.
4. Where even these blocks are beyond the byte bound, keys are hashed into as many bits as the bound allows: a Bloom
   filter of one hash. Some rows too many pass, none is lost, and the join behind drops them.
5. If the bits would be more than ``FULL`` filled, the range condition is all.

Case 4 and 5 keep more rows than the semi-join would, so ``only`` is for facts that meet ``keys`` in a join later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ledgerlens.plans.broadcast import is_bounded, max_broadcast_bytes

#: log2 of the bits in a block (fixed value: the bitmap functions' size), and bytes of a block as it is broadcast.
BLOCK_BITS, BLOCK_BYTES = 15, 8 * 1024 + 64
#: Share of bits set beyond which a hashed filter isn't worth its probes.
FULL = 0.5


def _bit(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def bit_blocks(numbers: DataFrame) -> DataFrame:
    """``numbers`` has the column ``_n`` (long). One row a block: ``_block``, ``_words`` (1,024 numbers of 32 bits)."""
    maps = numbers.groupBy(F.shiftright("_n", BLOCK_BITS).alias("_block")).agg(F.bitmap_construct_agg(_bit(F.col("_n"))).alias("_map"))
    word = lambda i: F.conv(F.hex(F.substring("_map", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    return maps.select("_block", F.transform(F.sequence(F.lit(0), F.lit(1023)), word).alias("_words"))


def is_set(words: Column, number: Column) -> Column:
    """Whether the bit of ``number`` is set in the words of its block: byte by byte, lowest bit first."""
    bit = _bit(number)
    byte = F.shiftright(bit, 3)
    at = (3 - byte % 4) * 8 + bit % 8
    return F.getbit(F.get(words, F.shiftright(byte, 2).cast("int")), at.cast("int")) == 1


def _probe(facts: DataFrame, number: Column, blocks: DataFrame) -> DataFrame:
    kept = facts.withColumn("_n", number).join(F.broadcast(blocks), F.shiftright("_n", BLOCK_BITS) == F.col("_block"))
    return kept.where(is_set(F.col("_words"), F.col("_n"))).drop("_n", "_block", "_words")


def only(facts: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``facts`` whose ``column`` is among ``keys`` (one column of that name), or some more; see the module."""
    spark, key = facts.sparkSession, F.col(column)
    keys = keys.select(column).where(key.isNotNull())
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).first()
    if not size.n:
        return facts.where(F.lit(False))
    kind = facts.schema[column].dataType
    facts = facts.where(key.between(F.lit(size.least).cast(kind), F.lit(size.most).cast(kind)))
    if is_bounded(keys):
        return facts.join(F.broadcast(keys), column, "left_semi")
    room = max_broadcast_bytes(spark) // BLOCK_BYTES
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        number = key.cast("long")
        blocks = bit_blocks(keys.select(number.alias("_n")))
        if blocks.select("_block").count() <= room:
            return _probe(facts, number, blocks)
    bits = room << BLOCK_BITS
    if not bits or size.n > FULL * bits:
        return facts
    number = F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))
    return _probe(facts, number, bit_blocks(keys.select(number.alias("_n"))))

"""Concatenate and cut: documents become one stream of token ids, cut into sequences of a fixed length.

The stream's order is that of the scan: by task, then by row. Every document ends with an end id. Pass one
encodes each text once, numbers its ids within its task and writes that (as bytes, four an id). The totals of
the tasks, one number each, are summed up into where each task's ids begin in the stream. Pass two adds the
two and cuts: a document lies in the windows from ``start // length`` to ``(end - 1) // length``, one piece, its
boundary record, in each. All windows are full but the last; its padding (up to the sequence length, or
none where its length is a power of two) is all the padding there is.

A tokenizer that drops white space never joins across it, so texts reach it as pieces without white space, and a
worker remembers the ids of a bounded number of them; any other tokenizer gets whole texts. No text or id is
shuffled; only the totals are.

Defined cases: null texts count as empty, a text without a token is its end id alone; very long texts have
as many pieces as windows (an id is copied once); rows that repeat are documents of their own; null ids and
clashing columns come back as they are, inside ``row``; an empty table gives no piece. The strings of special
tokens are found as the tokenizer itself finds them. Which document follows which is the scan's choice; the
order is fixed by what pass one has written, so a lost executor doesn't change it.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import broadcast_if_small, ship, staged, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE, END_ID = 2048, 1
#: Pieces of text whose ids a worker remembers (twice as many for a while); plain pieces that are encoded in one call.
REMEMBERED, TOGETHER = 300_000, 200
#: Bytes of text that are encoded at a time.
AT_ONCE = 12_000_000
#: Unicode's White_Space characters, as a splitter's \\s has them; Arrow and str.split() take four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(rf"[^{SPACE}]+")
_CONTROL = "[\x1c-\x1f]"
_BEYOND = re.compile("[^\x00-\xff]").search
_MARKS = re.compile("([.,;:!?]+)")


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one behind the other (some are empty), and where each text's pieces begin and end."""
    if pc.any(pc.match_substring_regex(texts, _CONTROL)).as_py():
        lists = pa.array([PIECE.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    marks = lists.offsets.to_numpy()
    return lists.values.slice(marks[0], marks[-1] - marks[0]), marks - marks[0]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"].get("end_of_word_suffix")
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.ends_word = np.array([bool(end) and x.endswith(end) for x in names])
        # Does the tokenizer drop white space, and are a word and the marks behind it two units? Else it gets whole texts.
        one, two, apart = (self.tok.encode(x, add_special_tokens=False).ids for x in ("Alpha,", "beta", " Alpha,\t beta\n"))
        self.by_piece = apart == one + two and [int(self.ends_word[x].sum()) for x in (one, two)] == [2, 1]
        # For words that are lower-case already, with white space before their marks, no more than the merges is needed.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.by_piece = self.by_piece and self.bare.encode("alpha , bêta", add_special_tokens=False).ids == self.tok.encode(
            "Alpha, BÊTA", add_special_tokens=False).ids
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Words, alone or with marks behind them, are encoded in groups and told apart by the ids that end a word: one a
        word, one more for its marks. All others are encoded one by one."""
        words = [x for x in pieces if x.isalpha()]
        marked = [x for x in pieces if not x.isalpha() and x.rstrip(".,;:!?").isalpha()]
        rest = [x for x in pieces if not x.rstrip(".,;:!?").isalpha()]
        for some, ends in ((words, 1), (marked, 2)):
            for i in range(0, len(some), TOGETHER):
                group = some[i:i + TOGETHER]
                text = " ".join(group)
                if not _BEYOND(text):
                    text = text.lower() if ends == 1 else _MARKS.sub(r" \1", text.lower())
                    data = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
                    cuts = (4 * np.flatnonzero(self.ends_word[np.frombuffer(data, "<u4")]) + 4)[ends - 1::ends].tolist()
                    if len(cuts) == len(group) and cuts[-1] == len(data):
                        self.new.update(zip(group, (data[a:b] for a, b in zip([0, *cuts], cuts))))
                        continue
                rest += group
        self.new.update(zip(rest, self._encode(rest)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self._encode(texts.to_pylist())
        flat, ends = split_pieces(texts)
        coded = flat.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        missing = [x for x in pieces if x not in self.new]
        again = [x for x in missing if x in self.old]
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        self._learn([x for x in missing if x not in self.new])
        got = pa.array(map(self.new.__getitem__, pieces), pa.binary(), size=len(pieces)).take(coded.indices)
        cuts = np.frombuffer(got.buffers()[1], np.int32)[ends].tolist() if len(got) else [0] * len(ends)
        data = memoryview(got.buffers()[2]) if len(got) else b""
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_stream(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID, text_col: str = "text") -> DataFrame:
    """Pass one, written: ``row`` without the text, ``part``, ``at`` (ids before it in its part), ``n_tokens`` and ``ids``."""
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    base = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    end = struct.pack("<I", end_id)

    def rows(batches):
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:]):
                some = b.slice(i, j - i)
                ids = pa.array([x + end for x in enc.encode(some.column("text"))], pa.binary())
                n = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                upto = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(np.full(len(n), part, np.int64)), pa.array(upto - n), pa.array(n), ids],
                                                 names=["row", "part", "at", "n_tokens", "ids"])
                at = int(upto[-1])
            pa.default_memory_pool().release_unused()  # a worker lives on

    fields = [base.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("part", "at", "n_tokens")] + [T.StructField("ids", T.BinaryType())]
    return staged(base.mapInArrow(rows, T.StructType(fields)), "packing")


def cut(stream: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pass two: one row per piece, with ``row``, ``start`` (its document's ids before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence) and ``ids`` (bytes)."""
    totals = stream.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per task of pass one
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_base"))
    placed = stream.join(broadcast_if_small(bases), F.col("part") == F.col("_part")).withColumn("_from", F.col("_base") + F.col("at"))
    size = F.lit(length).cast("long")
    window = F.expr(f"sequence(_from div {length}L, (_from + n_tokens - 1) div {length}L)")

    def piece(w, ids):
        start = F.greatest(w * size - F.col("_from"), F.lit(0).cast("long"))
        end = F.least((w + 1) * size - F.col("_from"), F.col("n_tokens"))
        return F.struct(start.alias("start"), (end - start).alias("length"), w.alias("sequence_id"),
                        F.greatest(F.col("_from") - w * size, F.lit(0).cast("long")).alias("offset"),
                        F.substring(ids, (4 * start + 1).cast("int"), (4 * (end - start)).cast("int")).alias("ids"))

    # Through an array of one element the bytes are bound once; as a column they'd be copied for each piece.
    cuts = F.transform(F.array("ids"), lambda ids: F.transform(window, lambda w: piece(w, ids)))[0]
    pieces = placed.select("row", F.col("n_tokens").alias("doc_tokens"), cuts.alias("_pieces"))
    return pieces.select("row", "doc_tokens", F.inline("_pieces"))


def pack_documents(docs: DataFrame, path: str = TOKENIZER, length: int = SEQUENCE, end_id: int = END_ID,
                   text_col: str = "text") -> DataFrame:
    """All pieces of all documents; see ``cut``."""
    return cut(token_stream(docs, path, end_id, text_col), length)


def sequences(pieces: DataFrame, length: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """The sequences to train on: ``sequence_id``, ``ids`` (array of int), ``segments`` (where documents begin or go on) and
    ``n_padding``. A sequence is a bounded group: ``length`` ids at most."""
    one = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    s = pieces.groupBy("sequence_id").agg(one.alias("_p"), F.sum("length").alias("_n"))

    hexed = F.hex(F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p.ids)))
    byte = lambda i, k: F.substring("_hex", 8 * i + 2 * k + 1, F.lit(2))
    value = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("int")
    power = F.expr("(_n & (_n - 1)) = 0")
    s = s.withColumn("_hex", hexed).withColumn("n_padding", F.when(power, 0).otherwise(length - F.col("_n")).cast("long"))
    ids = F.transform(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), value)
    return s.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), F.col("n_padding").cast("int"))).alias("ids"),
                    F.transform("_p", lambda p: p.offset).alias("segments"), "n_padding")


def op13_packing(spark, sf_dir):
    pieces = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

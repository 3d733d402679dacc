"""BPE encoding and decoding over a distinct-word table.

Spark splits every text into words - a run of white space with the run of other characters behind
it; white space at the end is a word by itself. The tokenizer's own pre-splitting never joins
characters across such a border, so a text's ids are its words' ids, one after the other. The words
of all texts are counted, the table of distinct words is encoded once, and ids come back to each
text by the position of its words. Decoding takes every id to its piece (bytes) and joins the pieces.

The table that is sent to all tasks holds the most frequent words, at most ``TABLE_WORDS`` of at most ``LONGEST`` bytes:
a fixed bound, whatever the corpus. A word that is rarer than that is encoded in the batch where it
stands, once per batch. No id and no text is shuffled; only word counts are.

Defined cases: null texts count as empty, empty texts have no ids and decode to ''; very long texts are encoded whole, by
themselves if need be; of words that are equally frequent, all or none are in the table; the texts of
special tokens are found as the tokenizer itself finds them; ids outside the vocabulary raise; rows
that repeat are encoded each; an empty table gives an empty result; all input columns come back
inside ``row``.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import pack, staged, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Most words in the table that is sent to every task.
TABLE_WORDS = 500_000
#: Most bytes of a word in that table; a longer run without white space is encoded where it stands.
LONGEST = 256
#: Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(rf"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")
#: Letters that are letters to any splitter, and marks that are neither letters, digits nor white space.
PLAIN = re.compile(r"[ \n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]*")
#: Words that a task gathers before it passes their counts on; characters that are split at a time.
GATHERED = 200_000
AT_ONCE = 6_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _merger(path: str) -> tiktoken.Encoding | None:
    """The same merges for plain words, without the library's offsets and token texts: byte pieces by
    rank. None if the tokenizer's merges aren't in the order of their ids, so that ids are no ranks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of, vocab = _byte_of_char(), model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or any(c not in of for x in vocab for c in x):
        return None
    ranks = {bytes(of[c] for c in x): i for x, i in vocab.items() if len(x) == 1 or i >= made[0]}
    ranks = {x: i for x, i in ranks.items() if len(x) == 1 or i <= made[-1]}
    return tiktoken.Encoding("merger", pat_str=r" ?\p{L}+|[.,;:!?]+|\n", mergeable_ranks=ranks, special_tokens={})


def _encode_words(path: str, words: list[str]) -> pa.ListArray:
    """The tokenizer's ids of each word. Plain words, which any splitter cuts alike, take the short way;
    others are encoded in slices, as the library keeps far more than the ids of all texts of a call."""
    tok, merger, kind = _tokenizer(path), _merger(path), pa.list_(pa.int32())
    parts = []
    for i in range(0, len(words), 4000):
        some = words[i:i + 4000]
        plain = [merger is not None and PLAIN.fullmatch(w) is not None for w in some]
        rest = iter(tok.encode_batch([w for w, p in zip(some, plain) if not p], add_special_tokens=False))
        parts.append(pa.array([merger.encode_ordinary(w) if p else next(rest).ids for w, p in zip(some, plain)], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.BinaryArray:
    """The id-to-piece table; its size is the vocabulary's."""
    tok, of = _tokenizer(path), _byte_of_char()
    names = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
    return pa.array([bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in names], pa.binary())


def _count_words(batches):
    seen: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0):
            seen.update(WORD.findall(text.as_py() or ""))
            if len(seen) > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def word_table(texts: DataFrame, path: str, max_words: int = TABLE_WORDS) -> pa.Table:
    """``texts`` has the one column text. The most frequent distinct words with their ids, at most ``max_words``."""
    counts = staged(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
                    .where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)), "bpe-words")
    # Counts in steps of an eighth of an octave, so that what the driver reads has a few hundred rows.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True)
    least, room = None, max_words
    for s, m in sizes:
        room -= m
        if room < 0:
            break
        least = s
    kept = counts.where(step >= least) if least is not None else counts.limit(0)

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _encode_words(path, b.column(0).to_pylist())], names=["word", "ids"])

    return kept.select("word").mapInArrow(encode, "word string, ids array<int>").toArrow().combine_chunks()


def _hashes(words: pa.Array) -> np.ndarray:
    slices = (words.slice(i, 20_000).to_pylist() for i in range(0, len(words), 20_000))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for some in slices for w in some), np.uint64, len(words))


@lru_cache(maxsize=1)
def _received(payload: bytes) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """The table's word hashes in order, and its words and ids in the same order."""
    t = pa.ipc.open_stream(payload).read_all()
    words, ids = t.column("word").cast(pa.string()).combine_chunks(), t.column("ids").cast(pa.list_(pa.int32())).combine_chunks()
    h = _hashes(words)
    order = np.argsort(h, kind="stable")
    return h[order], words.take(pa.array(order)), ids.take(pa.array(order))


def _pieces_of(path: str, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids, through the id-to-piece table: their pieces' bytes, one after the other."""
    lengths = pc.list_value_length(ids)
    ends = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))])
    got = _pieces(path).take(ids.flatten())
    marks = np.frombuffer(got.buffers()[1], np.int32)[got.offset:][ends]
    joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(marks)), got.buffers()[2]])
    try:
        out = joined.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
    return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.string()), out)


def _ids_of(path: str, payload: bytes, texts: list[str | None]) -> pa.ListArray:
    """Ids of some texts: each distinct word is looked up once, then ids follow words by position."""
    table_hashes, table_words, table_ids = _received(payload)
    words = [pa.array(WORD.findall(t or ""), pa.string()) for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    coded = pa.concat_arrays(words).dictionary_encode()
    rows = np.searchsorted(table_hashes, _hashes(coded.dictionary))
    rows[rows == len(table_words)] = 0
    there = np.zeros(len(rows), bool)
    if len(table_words):
        there = pc.equal(table_words.take(pa.array(rows)), coded.dictionary).to_numpy(zero_copy_only=False)
    rare = coded.dictionary.filter(pa.array(~there))
    rows[~there] = len(table_words) + np.arange(len(rare))
    both = pa.concat_arrays([table_ids, _encode_words(path, rare.to_pylist())])
    got = both.take(pa.array(rows[coded.indices.to_numpy(zero_copy_only=False)], pa.int64()))
    return pa.ListArray.from_arrays(pa.array(got.offsets.to_numpy()[ends], pa.int32()), got.values)


def encode(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
           max_words: int = TABLE_WORDS, decoded: bool = True) -> DataFrame:
    """One row per input row: ``row``, ``ids`` (array of int) and, if asked for, ``decoded``: the text
    that the ids decode to. (Decoding in the same pass spares a second one over the ids.)"""
    base = pack(docs, id_col, text_col)
    known = word_table(base.select("text"), path, max_words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def coded(batches):
        """Some texts at a time, so that a batch's ids and texts are never held together."""
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                ids = _ids_of(path, sent.value, part.column("text").to_pylist())
                cols = {"row": part.column("row"), "ids": ids, **({"decoded": _pieces_of(path, ids)} if decoded else {})}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
            pa.default_memory_pool().release_unused()  # a worker lives on

    fields = [base.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    return base.select("row", "text").mapInArrow(coded, T.StructType(fields))


def decode(tokens: DataFrame, path: str = TOKENIZER, ids_col: str = "ids"):
    """``tokens`` with a column ``decoded``: the text of ``ids_col``; what isn't UTF-8 becomes U+FFFD. Null ids: null."""

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        return _pieces_of(path, ids)

    return tokens.withColumn("decoded", text_of(ids_col))


def op7_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs).select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                       F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

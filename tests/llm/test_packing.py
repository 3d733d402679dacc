"""Packing (13) against concatenation in memory and the tokenizer itself."""

import struct
import sys
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest_paths import SF001
from ledgerlens.llm import packing as P
from llm_cases import empty_documents, odd_documents


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(P.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def packed(data):
    return struct.pack(f"<{len(data)}I", *data)


def check(rows, want, length=2048):
    """``rows``: (document, start, length, ids, doc_tokens, sequence_id, offset); ``want``: document to its ids."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for doc, start, n, ids, total, seq, offset in rows:
        assert n > 0 and len(ids) == 4 * n
        docs[doc].append((start, n, ids, total))
        seqs[seq].append((offset, n))
    assert docs.keys() == want.keys()
    for doc, pieces in docs.items():
        at = 0
        for start, n, _, total in sorted(pieces):
            assert start == at and total == len(want[doc])
            at += n
        assert b"".join(p[2] for p in sorted(pieces)) == packed(want[doc])
    sizes = []
    for seq in sorted(seqs):
        at = 0
        for offset, n in sorted(seqs[seq]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and all(x == length for x in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= length)


def test_query_is_the_tokenizer(spark, tok):
    docs = dict(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect())
    want = {i: ids_of(tok, t) for i, t in docs.items()}
    rows = P.op13_packing(spark, SF001).collect()
    pieces = []
    for r in rows:
        ids = packed(want[r.doc_id][r.start:r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(ids)
        pieces.append((r.doc_id, r.start, r.length, ids, r.doc_tokens, r.sequence_id, r.offset))
    check(pieces, want)


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_odd_documents(spark, tok, length):
    from pyspark.sql import functions as F

    odd = odd_documents(spark).repartition(5).withColumn("n", F.monotonically_increasing_id())
    docs = spark.createDataFrame(odd.collect(), odd.schema)
    rows = P.pack_documents(docs, length=length).collect()
    want = {r.n: ids_of(tok, r.text) for r in docs.select("n", "text").collect()}
    check([(r.row.n, r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in rows], want, length)
    assert "text" not in rows[0].row and rows[0].row.k is not None
    assert P.pack_documents(empty_documents(spark)).count() == 0


def test_pieces_of_text_are_the_tokenizers(tok):
    """Every character between, before and behind letters; texts with special tokens."""
    texts = []
    for first in range(0, sys.maxunicode + 1, 64):
        texts.append(" ".join(f"a{chr(c)}b {chr(c)}c d{chr(c)} {chr(c)}" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000))
    texts = texts[:1100] + texts[1100::40]
    texts += ["a <|endoftext|> b", "x<|startoftext|>y", "\x01", "a\x01 b \x01\x01", "İstanbul ΣΑΣ ΌΣ Σ", "é ́ ạ̈", "it's I'LL we've 12th ½ ²", "…!?-- <|endoftext|", "ﬁ Å K"]
    texts += ["".join(chr(c) for c in range(256)), "ÀÉÎ, ßß! ªº µ; \x1cx\x1d y", "A,B;C:D! ,a .b", "don't Don'T. x'll,"]
    enc = P.Encoder(P.TOKENIZER)
    got = enc.encode(pa.array(texts))
    for t, ids in zip(texts, got):
        assert ids == packed(tok.encode(t, add_special_tokens=False).ids), ascii(t)


def test_a_worker_forgets(tok, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 10)
    enc = P.Encoder(P.TOKENIZER)
    for k in range(30):
        text = " ".join(f"word{chr(97 + i % 26)}{i} Word{chr(97 + i % 26)}, été{chr(97 + i % 26)}!?" for i in range(k, k + 9)) + " the same THE SAME."
        assert enc.encode(pa.array([text, None, ""])) == [packed(tok.encode(text, add_special_tokens=False).ids), b"", b""]
        assert len(enc.new) <= 10 + 29 and len(enc.old) <= 10 + 29


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, other = P.Encoder(path), Tokenizer.from_file(path)
    texts = ["two  spaces\n\nand lines ", "", None]
    assert not enc.by_piece
    assert enc.encode(pa.array(texts)) == [packed(other.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_sequences(spark, tok):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "eight nine " * 30)], "doc_id long, text string").coalesce(1)
    pieces = P.pack_documents(docs, length=16)
    rows = sorted(P.sequences(pieces, 16, pad=49407).collect())
    stream = ids_of(tok, "one two three four five six seven") + [1] + ids_of(tok, "eight nine " * 30)
    left = len(stream) % 16
    assert [x for r in rows for x in r.ids][:len(stream)] == stream
    assert all(len(r.ids) == 16 or r.n_padding == 0 for r in rows)
    assert rows[-1].n_padding == (0 if left in (0, 1, 2, 4, 8) else 16 - left) and rows[0].segments[0] == 0


def test_no_text_is_shuffled(spark):
    plan = P.op13_packing(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "ids" not in line

"""Byte-level BPE against the tiktoken library and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lineagekit.llm import byte_bpe
from lineagekit.llm.byte_bpe import default_path, default_pattern, tokenizer


@pytest.fixture(scope="module")
def bpe():
    return tokenizer(default_path(), default_pattern())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_byte_bpe(docs, corpus, empty, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 2000)
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    rows = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = sorted((str(r[0]), packed(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in corpus)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert byte_bpe.decode(byte_bpe.encode(empty)).collect() == []


def test_both_trees_agree_with_the_library(bpe, library):
    r = random.Random(5)
    pieces = ["".join(r.choice(a) for _ in range(n)).encode() for n in [*range(1, 40)] * 6 + [1023, 1024, 1025, 1026, 3000] for a in ("ab", "aa", "étaoin", "日本語中文é", "x😀")]
    want = [packed(library._encode_single_piece(p)) for p in pieces]
    assert bpe.encode(pieces) == want
    assert [packed([bpe.ranks[p]]) if p in bpe.ranks else bpe.long(p) for p in pieces] == want


def test_small_groups_of_trees(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CELLS", 64)
    pieces = [f"unseenword{i}ly".encode() for i in range(30)]
    assert bpe.encode(pieces) == [packed(library._encode_single_piece(p)) for p in pieces]


def test_pieces_of_every_kind_of_character(bpe, library):
    some = [chr(c) for c in [*range(0x250), *range(0x250, 0x110000, 23)] if not 0xD800 <= c < 0xE000]
    newer = [chr(c) for c in (0x558, 0x88F, 0x10940, 0x11DE0, 0x3D000, 0x323B0)]
    for c in some + newer:
        text = f"x{c}1{c}!{c} {c}\n{c}"
        assert b"".join(bpe.encode([p.encode() for p in bpe.split(text)])) == packed(library.encode_ordinary(text)), hex(ord(c))


def test_query(spark, library):
    from lineagekit.llm import registry

    found = {r["doc_id"]: r for r in registry.QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(texts) == len(found)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        digest = [hashlib.sha256(b).hexdigest() for b in (packed(ids), text.encode())]
        assert [found[doc_id][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")] == [len(ids), *digest]

"""BPE encoding and decoding through a distinct-word table.

Texts are normalised and split into words once, in blocks (:mod:`blocks`). Spark's aggregate gives the
distinct words of the corpus; each is encoded once by the tokenizers library, and a join takes its ids
back to its positions. (Ids of up to ``FREQUENT`` words of a sample of rows go to every task instead,
which spares rows of frequent words.) Decoding joins ids to the pieces of the vocabulary file (a table of proven size,
which every task holds) and puts blanks between pieces, as a tokenizer without a decoder does.

The tokenizer file must have a BPE model, a Split pre-tokenizer whose matches are the words, and no
truncation, padding or decoder in use. Special tokens in a text are taken as such, as the library does.
Null texts count as empty: no ids, empty decoded text. Repeated rows give repeated results. An empty
table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, by_block, each_word_once, returned, word_rows
from .common import prepare, table

#: Words whose ids every task holds, the rows (and their characters) that they are looked for in, and characters of a block.
FREQUENT, ROWS, CHARS, BLOCK = 100_000, 2000, 20_000, 10 << 20
#: Words of the texts that go back to Spark in one batch, or one text.
PART = 100_000
ENCODED = "doc_id long, ids binary, decoded string"
#: Texts of these characters are normalised and split by Python's own functions, which agree with the library there.
PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ɏ‐-‧€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Normalisation, words and ids of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        self.quick = re.compile(pattern.replace(r"[\p{L}]+", r"[^\W\d_]+").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+"))
        self.single = Tokenizer.from_file(path)
        self.single.no_truncation()
        self.single.no_padding()
        self.single.normalizer = normalizers.Sequence([])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max(self.whole.get_vocab(True).values()) + 1
        self.width = "<u2" if size <= 65536 else "<u4"
        self.pieces = [self.whole.id_to_token(i) for i in range(size)]

    def words(self, text: str) -> list[str]:
        if self.cut is not None and "<" in text and self.cut.search(text):
            return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if PLAIN.search(text) is None:
            return self.quick.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.single.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def texts(block: Block, coded: list[bytes], width: str, pieces: list[str], most: int = PART) -> pa.Table:
    """doc_id, ids, decoded of a block's texts; ``coded``: its words' ids. A few texts make a batch, so that
    what a batch takes, here and in Spark, doesn't grow with the block."""
    flat, ends = np.frombuffer(b"".join(coded), dtype=width), np.cumsum([len(x) for x in coded]) // np.dtype(width).itemsize
    wide, numbers, name, ids, text, start = flat.astype("<u4").tobytes(), flat.tolist(), pieces.__getitem__, [], [], 0
    for end in ends.tolist():
        ids.append(wide[4 * start : 4 * end])
        text.append(" ".join(map(name, numbers[start:end])))
        start = end
    del wide, numbers
    stop = block.ends()
    begin = stop - block.lengths

    def some(first: int, last: int) -> pa.RecordBatch:
        own = [block.places[a:b].tolist() for a, b in zip(begin[first:last], stop[first:last])]
        coded, decoded = [b"".join(map(ids.__getitem__, x)) for x in own], [" ".join(map(text.__getitem__, x)) for x in own]
        return pa.RecordBatch.from_arrays([block.ids[first:last], pa.array(coded, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    bounds = [0, *(np.flatnonzero(np.diff(stop // most)) + 1).tolist(), len(stop)]
    return pa.Table.from_batches([some(a, b) for a, b in zip(bounds, bounds[1:])])


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded: one row per input row."""
    spark, path = prepare(docs.sparkSession), tokenizer_path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("held"))
    # words of a bounded sample of rows: encoded here, once, and known to every task; any choice gives the same result
    some = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS)
    head = rows.join(F.broadcast(some), "doc_id").where(F.length("text") <= CHARS).orderBy("doc_id", "text").limit(ROWS).select("text").collect()
    seen = Counter(w for r in head for w in tokenizer(path).words(r["text"]))
    chosen = sorted(w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT])
    known = spark.sparkContext.broadcast({w.encode(): np.array(x, dtype=tokenizer(path).width).tobytes() for w, x in zip(chosen, tokenizer(path).ids(chosen))})

    def encode(found: list[bytes]) -> list[bytes]:
        return [np.array(x, dtype=tokenizer(path).width).tobytes() for x in tokenizer(path).ids([w.decode() for w in found])]

    # one exchange of the blocks serves the words' rows and the way back
    dealt = by_block(blocks(rows, lambda text: tokenizer(path).words(text), BLOCK, lean=True))
    answers = each_word_once(word_rows(dealt, known), encode)
    pieces = spark.sparkContext.broadcast(tokenizer(path).pieces)  # the vocabulary: of the file's size

    def apply(block: Block, found: pa.Table) -> pa.Table:
        t, coded = tokenizer(path), list(map(known.value.get, block.words))
        for place, own in zip(found.column("place").to_pylist(), found.column("answer").to_pylist()):
            coded[place] = own
        return texts(block, coded, t.width, pieces.value)

    return returned(dealt, answers, apply, ENCODED)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}

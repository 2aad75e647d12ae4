"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with an end id) are cut into whole windows of ``capacity`` and a rest, which is
cut into pieces of at most ``piece`` ids. Pieces are dealt by a hash of their row's number into groups of
about ``group_windows`` windows. In a group, multiway differencing starts with one partial partition a
piece (its length in one of k bins), again and again merges the two partial partitions of largest
spread with their bins in opposite order, and ends with k near-equal windows, k being the least number
that could hold them. When a window exceeds the capacity, k rises by one and differencing starts anew.

Windows are padded to ``capacity``, except those whose length is a power of two.
Null and empty texts have the end id alone. Rows with a null id are packed like others. Repeated rows
are separate documents. Documents of any length: whole windows need no
differencing. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, partitions, prepare, table, written

CAPACITY, PIECE, GROUP_WINDOWS, END = 2048, 512, 48, 1
PIECES = "doc_id string, row long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, window_tokens long, window_size long"
#: Texts of these characters are split alike by both libraries (see the tests).
PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    Plain texts are encoded by tiktoken from the same vocabulary and merges, several times as fast;
    texts with other characters and such with special tokens by the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = max(self.whole.get_vocab(True).values()) + 1
        self.opens = np.array([(self.whole.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])
        letters = self._letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the byte-level pre-tokenizer's pattern
        self.quick = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letters() -> dict[str, int]:
        """Byte-level BPE writes each byte as a printable character; here, back to bytes."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.search(text) is None and not any(s in text for s in self.special):
            return np.array(self.quick.encode_ordinary(text), dtype="<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def cuts(length: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole = length // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    at, rest = whole * capacity, length - whole * capacity
    parts = -(-rest // piece)
    for i in range(parts):  # of near-equal length
        n = rest // parts + (i < rest % parts)
        out.append((at, n))
        at += n
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of positions in ``sizes`` with near-equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        # a partial partition: bins (sum, members) in rising order; bins that aren't listed are empty
        heapq.heappush(heap, (-size, i, [(size, (i,))]))
    if not heap:
        return [[] for _ in range(k)]
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the largest bins of one meet the smallest of the other
        if len(a) + len(b) <= k:
            bins = a + b
        else:
            a = [(0, ())] * (k - len(a)) + a
            b = [(0, ())] * (k - len(b)) + b
            bins = [(x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b))]
        bins = sorted((x for x in bins if x[0] or x[1]), key=lambda x: x[0])
        low = bins[0][0] if len(bins) == k else 0
        heapq.heappush(heap, (-(bins[-1][0] - low), n, bins))
        n += 1

    def members(tree) -> list[int]:
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            for x in t:
                stack.append(x) if isinstance(x, tuple) else out.append(x)
        return sorted(out)

    done = [members(tree) for _, tree in heap[0][2]]
    return done + [[] for _ in range(k - len(done))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing into the least number of windows that it can fill without exceeding the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        k += 1


def place(frame: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    """One group's pieces with their windows, numbered from ``first``."""
    frame = frame.sort_values(["row", "start"], ignore_index=True)
    lengths = frame["length"].to_numpy()
    sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
    whole = np.flatnonzero(lengths == capacity)
    sequence[whole] = first + np.arange(len(whole))
    rest = np.flatnonzero(lengths < capacity)
    for j, w in enumerate(windows(lengths[rest].tolist(), capacity)):
        at = rest[np.array(w, dtype=np.int64)]
        sequence[at] = first + len(whole) + j
        offset[at] = np.concatenate([[0], np.cumsum(lengths[at])[:-1]])
    total = pd.Series(lengths).groupby(sequence).transform("sum").to_numpy()
    power = (total & (total - 1)) == 0
    return frame.assign(sequence=sequence, offset=offset, window_tokens=total, window_size=np.where(power, total, capacity))


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, piece: int, path: str) -> DataFrame:
    def run(frames):
        t, row = tokenizer(path), TaskContext.get().partitionId() << 40
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(t.ids(text), np.uint32(END)).astype("<u4")
                out += [(doc_id, row, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)) for start, n in cuts(len(ids), capacity, piece)]
                row += 1
            yield pd.DataFrame(out, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(as_text(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_tokens, window_size."""
    spark = prepare(docs.sparkSession)
    made = written(pieces(docs, id_col, text_col, capacity, piece, tokenizer_path or default_path()), "pieces")
    rest = made.agg(F.sum(F.when(F.col("length") < capacity, F.col("length")))).first()[0] or 0
    groups = max(1, -(-rest // (capacity * group_windows)))
    shift = 40  # windows of one group

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return place(frame.drop(columns="group"), capacity, int(key[0]) << shift).drop(columns="row")

    dealt = made.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    dealt = dealt.repartition(min(groups, max(partitions(spark), groups // 16)), "group")
    return dealt.groupBy("group").applyInPandas(run, PLACED).withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("sequence", "sequence_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}

"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text falls into the matches of a pattern; each is encoded by itself. A piece that is in the rank file is
its id. Otherwise its bytes are leaves of a segment tree: leaf ``i`` holds the rank of the pair that begins
at byte ``i`` together with ``i``, an inner node the smaller of its two children, so the root names the
leftmost pair of least rank. A merge joins that pair and sets three leaves: that of the pair, that of the
part that went (nothing), and that of the live neighbour before, each with a logarithmic walk to the root.

Pieces of up to ``WIDE`` bytes go through their merges side by side, a numpy row each; longer ones one
after the other. A task keeps the ids of up to ``KEPT`` pieces and begins anew beyond: this changes no
result. There is no shuffle, and a task holds one slice of ``SLICE`` characters (a text at least).

The rank file must hold all 256 bytes, and an id is its rank; no special tokens are known, so their strings
are ordinary text. Null texts count as empty: no ids, no bytes. Repeated rows give repeated results; rows
with a null id are kept. An empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: Bytes of the pieces that are merged side by side, pieces that a task remembers, characters of a slice, tree cells of a group.
WIDE, KEPT, SLICE, CELLS = 1024, 400_000, 2 << 20, 1 << 20
NONE = np.int64(1) << 62
#: Low bits of a tree cell hold the position, the others the rank.
BITS = 12
#: Letters and numbers of ``regex`` that the tiktoken library doesn't know as such yet.
LATER = (
    "0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
UNKNOWN = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in LATER.split())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """The merges of one rank file. ``pieces[id]`` are the bytes of an id."""

    def __init__(self, path: str, pattern: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.usual, self.later = regex.compile(pattern).findall, re.compile(f"[{UNKNOWN}]").search
        self.strict = regex.compile(re.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{UNKNOWN}]]", pattern), regex.V1).findall
        ranks, size = self.ranks, len(self.pieces)
        self.size = size
        pairs = sorted((ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys, self.merged = np.array([k for k, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int64)
        self.pair = dict(pairs)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def split(self, text: str) -> list[str]:
        return self.usual(text) if text.isascii() or self.later(text) is None else self.strict(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian unsigned 32-bit."""
        out, groups = [b""] * len(pieces), {}
        for n, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[n] = known.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[n] = self.long(piece)
            elif piece:
                groups.setdefault(max(len(piece) - 2, 0).bit_length(), []).append(n)
        for bits, members in groups.items():
            step = max(1, CELLS >> (bits + 1))
            for start in range(0, len(members), step):
                some = members[start : start + step]
                for n, ids in zip(some, self.together([pieces[n] for n in some], 1 << bits)):
                    out[n] = ids
        return out

    def together(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids of pieces of at most ``leaves + 1`` bytes: their trees are rows of one array."""
        count, wide = len(pieces), leaves + 2  # a cell for the end after the last byte
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        column, row = np.arange(wide), np.arange(count)
        inside = column < lengths[:, None]
        ids = np.zeros((count, wide), dtype=np.int64)
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        tree = np.full((count, 2 * leaves), NONE, dtype=np.int64)
        paired = column[:leaves] + 1 < lengths[:, None]
        ranks = self.rank(ids[:, :leaves][paired], ids[:, 1 : leaves + 1][paired])
        tree[:, leaves:][paired] = np.where(ranks < NONE, (ranks << BITS) + np.broadcast_to(column[:leaves], paired.shape)[paired], NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        following, before = np.tile(column + 1, (count, 1)), np.tile(column - 1, (count, 1))
        cells, ids, following, before, alive = tree.ravel(), ids.ravel(), following.ravel(), before.ravel(), inside.copy().ravel()
        live = row
        while True:
            least = cells[live * (2 * leaves) + 1]
            some = least < NONE
            live, least = live[some], least[some]
            if not len(live):
                break
            base, root = live * wide, live * (2 * leaves)
            at, rank = least & ((1 << BITS) - 1), least >> BITS
            gone = following[base + at]
            after, prior = following[base + gone], before[base + at]
            ids[base + at] = rank
            alive[base + gone] = False
            following[base + at] = after
            before[base + after] = at
            last, first = after >= lengths[live], prior < 0
            new = self.rank(rank, ids[base + np.where(last, at, after)])
            cells[root + leaves + at] = np.where(last | (new >= NONE), NONE, (new << BITS) + at)
            # the pair that began at the part that went: no leaf for a piece's last byte, which begins none
            dead = np.where(gone < leaves, gone, at)
            cells[root[gone < leaves] + leaves + gone[gone < leaves]] = NONE
            near = np.where(first, at, prior)
            new = self.rank(ids[base + near], rank)
            cells[root[~first] + leaves + prior[~first]] = np.where(new >= NONE, NONE, (new << BITS) + prior)[~first]
            nodes = np.stack([at, dead, near]) + leaves
            for _ in range(leaves.bit_length() - 1):
                nodes >>= 1
                place = root + nodes
                twin = root + 2 * nodes
                cells[place] = np.minimum(cells[twin], cells[twin + 1])
        found = ids[alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(alive.reshape(count, wide).sum(axis=1))
        return [found[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def long(self, piece: bytes) -> bytes:
        """Ids of one long piece."""
        n, none, get, size = len(piece), (1 << 62), self.pair.get, self.size
        leaves, shift = 1 << (n - 1).bit_length(), n.bit_length()
        ids, following, before = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = get(ids[i] * size + ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank << shift | i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while (least := tree[1]) < none:
            at, rank = least & ((1 << shift) - 1), least >> shift
            gone = following[at]
            after, prior = following[gone], before[at]
            ids[at], ids[gone], following[at] = rank, -1, after
            put(gone, none)
            if after < n:
                before[after] = at
                new = get(rank * size + ids[after])
                put(at, none if new is None else new << shift | at)
            else:
                put(at, none)
            if prior >= 0:
                new = get(ids[prior] * size + rank)
                put(prior, none if new is None else new << shift | prior)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` characters together, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit): one row per input row."""
    prepare(docs.sparkSession)
    path, cut = ranks_path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kept = tokenizer(path, cut), {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices([len(t) for t in texts], SLICE):
                split = [bpe.split(t) for t in texts[start:end]]
                fresh = [p for p in set().union(*split) if p not in kept]
                if len(kept) + len(fresh) > KEPT:
                    kept.clear()
                    fresh = list(set().union(*split))
                kept.update(zip(fresh, bpe.encode([p.encode() for p in fresh])))
                found = [b"".join(map(kept.__getitem__, pieces)) for pieces in split]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """The rows (doc_id, ids) with ``decoded``, the bytes that the ids stand for; null ids give none."""
    prepare(rows.sparkSession)
    path, cut = ranks_path or default_path(), default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, cut)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            for start, end in slices([len(x) for x in ids], SLICE):
                found = pa.array(map(bpe.decode, ids[start:end]), pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in batch.columns] + [found], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLE_SQL: dict[str, str] = {}

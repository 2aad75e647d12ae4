"""A distinct-word table for whole corpora: words are split once and numbered in blocks.

A task lays its rows into blocks of about ``block_chars`` characters, as they come; a block is one row:
its distinct words, what is counted of each, and the texts as numbers of words, packed. From there on
Spark works on rows of (block, position, word), one for each distinct word of a block: an aggregate
gives the table of the corpus's distinct words, a join takes what is known of a word back to the
blocks, and a cogroup puts it beside the texts. All of that is in proportion to the data; a word that
is in every document has one row a block, and what is known of the words of the most blocks (a table of
bounded size) goes to every task instead, so no key is hot, and no shuffle deals out texts.

A block's number is the task's partition and a count in it. A text over ``block_chars`` is a block of
its own; a text is never cut. Null texts count as empty. An empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: ``ids``, ``held`` and ``lengths`` (words) by text; ``words`` and ``counts`` (in texts not held out) by word.
BLOCK = "block long, ids array<long>, held array<boolean>, lengths array<int>, words array<binary>, counts array<long>, places binary"
#: What needs neither folds nor counts: the words in one packed text, a line each.
LEAN = "block long, ids array<long>, lengths array<int>, places binary, lines binary"
BLOCK_CHARS = 12 << 20


def packed(values: np.ndarray) -> bytes:
    """Four-byte numbers, their first bytes first: small numbers take little then."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def listed(lines: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(lines)
    return data.split(b"\n") if data else []


class Numbers(dict):
    """Numbers of things in the order of their first sight."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


class Filling:
    """A block that is being laid: texts become numbers of words as they come."""

    def __init__(self, number: int):
        self.number, self.ids, self.held, self.places, self.numbers, self.chars = number, [], [], [], Numbers(), 0

    def add(self, doc_id, held: bool, words: list, chars: int) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), dtype="<u4", count=len(words)))
        self.chars += chars

    def row(self, lean: bool) -> pa.RecordBatch:
        flat, lengths = np.concatenate(self.places), np.array([len(p) for p in self.places], dtype=np.int32)
        # frequent words get small numbers
        order = np.argsort(-np.bincount(flat, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), dtype="<u4")
        rank[order] = np.arange(len(order))
        flat, words = rank[flat], list(self.numbers)
        counts = np.bincount(flat[np.repeat(~np.array(self.held, dtype=bool), lengths)], minlength=len(words))
        words = [w if isinstance(w, bytes) else w.encode() for w in map(words.__getitem__, order.tolist())]
        row = [pa.array([self.number], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32()))]
        if lean:
            lines = zstandard.ZstdCompressor(level=6).compress(b"\n".join(words))
            return pa.RecordBatch.from_arrays([*row[:2], row[3], pa.array([packed(flat)], pa.binary()), pa.array([lines], pa.binary())], ["block", "ids", "lengths", "places", "lines"])
        row += [pa.array([words], pa.list_(pa.binary())), pa.array([counts.astype(np.int64)], pa.list_(pa.int64())), pa.array([packed(flat)], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["block", "ids", "held", "lengths", "words", "counts", "places"])


def blocks(rows: DataFrame, split: Callable[[str], list], block_chars: int = BLOCK_CHARS, lean: bool = False, more: tuple[str, Callable[[pa.Array], list[pa.Array]]] | None = None) -> DataFrame:
    """BLOCK rows (LEAN ones) of ``rows`` (doc_id long, text string, held boolean); ``split`` gives a text's
    words, str or bytes, without line feeds. ``more``: the schema of further columns, and what makes them of a
    BLOCK row's words."""
    prepare(rows.sparkSession)
    schema = LEAN if lean else f"{BLOCK}, {more[0]}" if more else BLOCK

    def laid(block: Filling) -> pa.RecordBatch:
        row = block.row(lean)
        return pa.RecordBatch.from_arrays([*row.columns, *more[1](row.column("words").values)], [c.split()[0] for c in schema.split(", ")]) if more else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Filling(TaskContext.get().partitionId() << 32)
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
            for doc_id, text, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                size = len(text or "")
                if block.ids and block.chars + size > block_chars:
                    yield laid(block)
                    block = Filling(block.number + 1)
                block.add(doc_id, bool(held), split(text or ""), size)
        if block.ids:
            yield laid(block)

    return rows.select("doc_id", "text", "held").mapInArrow(run, schema)


def word_rows(table: DataFrame, known: Broadcast) -> DataFrame:
    """block, place, word: a row for each distinct word of a LEAN block that isn't among the ``known`` ones.

    It reads whole rows of ``table``, so that an exchange of them serves this and :func:`returned`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for block, lines in zip(batch.column(names.index("block")).to_pylist(), batch.column(names.index("lines")).to_pylist()):
                words = listed(lines)
                place = np.flatnonzero([w not in known.value for w in words]).astype(np.int32)
                columns = [pa.array(np.full(len(place), block, dtype=np.int64)), pa.array(place), pa.array([words[i] for i in place.tolist()], pa.binary())]
                yield from pa.Table.from_arrays(columns, ["block", "place", "word"]).to_batches(65536)

    return table.mapInArrow(run, "block long, place int, word binary")


def each_word_once(rows: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """block, place, answer of ``rows`` (block, place, word): rows of a word meet in a task, one after the
    other, and ``answer`` sees each word of the corpus once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, last = None, b""
        for batch in batches:
            found = batch.column(2).to_pylist()
            fresh = [w for w, before in zip(found, [word, *found]) if w != before]
            told, out = iter(answer(fresh) if fresh else ()), []
            for w in found:
                if w != word:
                    word, last = w, next(told)
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "place", "answer"])

    dealt = rows.select("block", "place", "word").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "block long, place int, answer binary")


@dataclass
class Block:
    """A block's texts as numbers of words."""

    number: int
    ids: pa.Array
    held: np.ndarray
    lengths: np.ndarray
    places: np.ndarray
    words: list[bytes]

    @classmethod
    def of(cls, table: pa.Table) -> "Block":
        """Of a table with one BLOCK or LEAN row; without words where they were left out."""
        one = {c: table.column(c).combine_chunks() for c in table.column_names if c in ("ids", "held", "lengths", "places", "words", "lines")}
        n = len(one["ids"].values)
        held = np.array(one["held"].values.to_pylist(), dtype=bool) if "held" in one else np.zeros(n, dtype=bool)
        words = one["words"].values.to_pylist() if "words" in one else listed(one["lines"][0].as_py()) if "lines" in one else []
        return cls(table.column("block")[0].as_py(), one["ids"].values, held, one["lengths"].values.to_numpy().astype(np.int64), unpacked(one["places"][0].as_py()), words)

    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths)


def returned(table: DataFrame, answers: DataFrame, apply: Callable[..., pa.Table], schema: str, whole: bool = False) -> DataFrame:
    """Rows of ``apply(block, answers of the block in the order of place)``; ``answers`` have block and place.
    ``whole``: the block's row as it is comes between the two."""

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        return apply(Block.of(rows), *([rows] if whole else []), found.sort_by("place"))

    named = answers.select(F.col("block").alias("_block"), *(c for c in answers.columns if c != "block"))
    return table.groupBy("block").cogroup(named.groupBy("_block")).applyInArrow(finish, schema)


def often(table: DataFrame, most: int) -> DataFrame:
    """The ``most`` words that are in the most blocks, of those in several. ``table`` has word and blocks."""
    return table.where("blocks > 1").orderBy(F.desc("blocks"), "word").limit(most)


def by_block(table: DataFrame) -> DataFrame:
    return table.repartition(F.col("block"))

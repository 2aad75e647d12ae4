"""Exact deduplication by a log-structured merge index over SHA-256 digests.

1. *Memtables.* Each scan task fills a memtable (digest -> first normalised text, best row, count),
   bounded in bytes and entries. A hit in the memtable is verified byte by byte. A full memtable is
   flushed as a *run*: member rows sorted by digest, the first of each digest carrying the text.
   Runs are written to the shared folder.
2. *Compaction.* Digest ranges of all runs meet in one task per range: sorted segments with Bloom
   filters are merged by size tiers; a merge keeps the best identifier of a digest. Each run has a
   digest once at most, so a group of copies reaches this step as one entry per run.
3. *Verification.* Digests that lie in more than one run are hits; their normalised texts are
   compared byte by byte with that of the first run. Entries that differ are grouped by their bytes.
4. Members take the outcome of their (run, digest).

Rows: of equal texts the longest original (code points), then the smallest id stays; null ids come
last. Null text counts as empty; all empty texts are equal. Repeated rows (same id and text) are
separate members of one group, and exactly one of them is kept. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, integers, partitions, prepare, table, written

WHITE = b" \t\n\x0b\x0c\r"
RUN = "run_id long, digest binary, variant int, seq long, doc_id long, n_points long, lead boolean, norm binary, best_points long, best_id long, best_seq long, members long"
INDEX = "run_id long, digest binary, variant int, runs long, anchor_run long, anchor_variant int, keep_id long, keep_run long, keep_seq long, group_size long"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def _rank(points: int, doc_id, seq: int) -> tuple:
    return (-points, doc_id is None, doc_id if doc_id is not None else 0, seq)


class Memtable:
    def __init__(self, run_id: int):
        self.run_id, self.size, self.entries, self.rows = run_id, 0, {}, []

    def add(self, digest: bytes, norm: bytes, doc_id, points: int, seq: int) -> None:
        variant = 0
        while (entry := self.entries.get((digest, variant))) is not None and entry["norm"] != norm:
            variant += 1
        rank = _rank(points, doc_id, seq)
        if entry is None:
            self.entries[digest, variant] = {"norm": norm, "rank": rank, "best": (points, doc_id, seq), "members": 1}
            self.size += len(norm) + 200
        else:
            entry["members"] += 1
            if rank < entry["rank"]:
                entry |= {"rank": rank, "best": (points, doc_id, seq)}
        self.rows.append((digest, variant, seq, doc_id, points))
        self.size += 150

    def flush(self) -> pd.DataFrame:
        out, seen = [], None
        for digest, variant, seq, doc_id, points in sorted(self.rows, key=lambda r: r[:3]):
            lead, seen = (digest, variant) != seen, (digest, variant)
            e = self.entries[seen]
            best = (*e["best"], e["members"]) if lead else (None,) * 4
            out.append((self.run_id, digest, variant, seq, doc_id, points, lead, e["norm"] if lead else None, best[0], best[1], best[2], best[3]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])
        ids = {c: integers([r[i] for r in out]) for c, i in (("doc_id", 4), ("best_id", 9))}
        return frame.assign(**ids).astype({c: "Int64" for c in ("best_points", "best_seq", "members")})


def _memtables(digest_bytes: int, table_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        mem, flushed, seq = Memtable(first), 0, 0
        for frame in frames:
            ids = integers(frame["doc_id"])
            for doc_id, text in zip(ids, frame["text"]):
                norm = normalised(text)
                mem.add(hashlib.sha256(norm).digest()[:digest_bytes], norm, None if doc_id is pd.NA else int(doc_id), len(text or ""), seq)
                seq += 1
                if mem.size >= table_bytes:
                    yield mem.flush()
                    flushed += 1
                    mem = Memtable(first + flushed)
        if mem.rows:
            yield mem.flush()

    return run


class Bloom:
    """Ten bits an entry, four probes taken from the digest itself."""

    def __init__(self, words: np.ndarray):
        self.mask = np.uint64((1 << max(6, int(10 * max(1, len(words))).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        for p in self._probes(words):
            self.bits[p] = True

    def _probes(self, words: np.ndarray):
        a, b = words, (words >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return [((a + np.uint64(i) * b) & self.mask).astype(np.int64) for i in range(4)]

    def may_have(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), dtype=bool)
        for p in self._probes(words):
            out &= self.bits[p]
        return out


class Segment:
    """Sorted digests, each with its best row and counts."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame
        self.keys = frame["key"].to_numpy()
        self.bloom = Bloom(frame["word"].to_numpy())

    def hits(self, other: "Segment") -> int:
        """Digests of ``other`` that this segment holds; the filter spares most searches."""
        maybe = other.keys[self.bloom.may_have(other.frame["word"].to_numpy())]
        at = np.searchsorted(self.keys, maybe)
        return int((self.keys[np.minimum(at, len(self.keys) - 1)] == maybe).sum()) if len(maybe) else 0


def merged(a: Segment, b: Segment) -> Segment:
    frame = pd.concat([a.frame, b.frame], ignore_index=True)
    if a.hits(b) == 0:
        return Segment(frame.sort_values("key", kind="stable", ignore_index=True))
    order = ["key", "neg_points", "no_id", "best_id", "run_id", "best_seq"]
    frame = frame.sort_values(order, kind="stable", ignore_index=True)
    sums = frame.groupby("key", sort=True)[["members", "runs"]].sum()
    low = frame.sort_values(["key", "anchor_run", "anchor_variant"], kind="stable").drop_duplicates("key")
    best = frame.drop_duplicates("key").reset_index(drop=True)
    best["members"], best["runs"] = sums["members"].to_numpy(), sums["runs"].to_numpy()
    best["anchor_run"], best["anchor_variant"] = low["anchor_run"].to_numpy(), low["anchor_variant"].to_numpy()
    return Segment(best)


def _compact(frame: pd.DataFrame) -> pd.DataFrame:
    """Size-tiered compaction of one digest range."""
    entries = pd.DataFrame({"key": [d.hex() for d in frame["digest"]], "run_id": frame["run_id"], "variant": frame["variant"]})
    entries["word"] = np.array([int(k[:16] or "0", 16) for k in entries["key"]], dtype=np.uint64)
    entries["neg_points"] = -frame["best_points"].to_numpy(dtype=np.int64)
    entries["no_id"] = frame["best_id"].isna().to_numpy()
    entries["best_id"] = integers(frame["best_id"]).fillna(0).to_numpy(dtype=np.int64)
    entries["best_seq"] = frame["best_seq"].to_numpy(dtype=np.int64)
    entries["members"] = frame["members"].to_numpy(dtype=np.int64)
    entries["runs"], entries["anchor_run"], entries["anchor_variant"] = 1, entries["run_id"], entries["variant"]
    levels: list[Segment] = []
    for _, run in entries.groupby(["run_id", "variant"], sort=True):
        levels.append(Segment(run.sort_values("key", ignore_index=True)))
        while len(levels) > 1 and len(levels[-2].keys) <= 2 * len(levels[-1].keys):
            top = levels.pop()
            levels.append(merged(levels.pop(), top))
    while len(levels) > 1:
        top = levels.pop()
        levels.append(merged(levels.pop(), top))
    last = levels[0].frame
    at = last.iloc[np.searchsorted(levels[0].keys, entries["key"].to_numpy())].reset_index(drop=True)
    return pd.DataFrame({
        "run_id": frame["run_id"], "digest": frame["digest"], "variant": frame["variant"], "runs": at["runs"],
        "anchor_run": at["anchor_run"], "anchor_variant": at["anchor_variant"],
        "keep_id": at["best_id"].astype("Int64").mask(at["no_id"]), "keep_run": at["run_id"], "keep_seq": at["best_seq"], "group_size": at["members"],
    })


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, table_bytes: int = 24 << 20, range_entries: int = 50_000, digest_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``table_bytes`` bounds a memtable, ``range_entries`` aims at entries per compaction task.
    ``digest_bytes`` below 32 makes collisions likely; it exists to test verification.
    ``text_sha256`` is the hex of the digest (so shorter then).
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(as_text(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = written(rows.mapInPandas(_memtables(digest_bytes, table_bytes), RUN), "runs")
    entry = ["run_id", "digest", "variant"]
    leads = runs.where("lead").select(*entry, "best_points", as_text(F.col("best_id")).alias("best_id"), "best_seq", "members")
    ranges = max(partitions(spark), -(-leads.count() // range_entries))
    index = written(
        leads.withColumn("range", F.pmod(F.xxhash64("digest"), F.lit(ranges))).groupBy("range").applyInPandas(lambda f: _compact(f.drop(columns="range")), INDEX),
        "index",
    )

    # bytes of every entry whose digest lies in several runs against those of the first run
    texts = runs.where("lead").select(*entry, "norm", "best_points", "best_id", "best_seq", "members")
    hits = written(texts.join(index.where("runs > 1").select(*entry, "anchor_run", "anchor_variant"), entry), "hits")
    first = hits.where("run_id = anchor_run and variant = anchor_variant").select("digest", F.col("norm").alias("first_norm"))
    wrong = written(hits.join(first, "digest").where("norm <> first_norm").drop("first_norm"), "collisions")
    outcome = index.select(*entry, "keep_id", "keep_run", "keep_seq", "group_size")
    if not wrong.isEmpty():
        outcome = _regrouped(outcome, hits, wrong.select("digest").distinct(), entry)

    members = runs.select(*entry, "seq", "doc_id", "n_points")
    return members.join(outcome, entry).select(
        "doc_id", "keep_id", "group_size", ((F.col("run_id") == F.col("keep_run")) & (F.col("seq") == F.col("keep_seq"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _regrouped(outcome: DataFrame, hits: DataFrame, colliding: DataFrame, entry: list[str]) -> DataFrame:
    """Outcome with the entries of colliding digests grouped by their bytes."""
    own = hits.join(colliding, "digest")
    order = F.struct(-F.col("best_points"), F.col("best_id").isNull(), "best_id", "run_id", "best_seq")
    groups = own.groupBy("digest", "norm").agg(F.min(order).alias("best"), F.sum("members").alias("group_size"))
    again = own.join(groups, ["digest", "norm"]).select(*entry, F.col("best.best_id").alias("keep_id"), F.col("best.run_id").alias("keep_run"), F.col("best.best_seq").alias("keep_seq"), "group_size")
    return outcome.join(colliding, "digest", "left_anti").select(*again.columns).union(again)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
}

"""Ranked lexical search by a threshold-seeded join.

Rows are searched for the items' terms in these steps:

1. *Postings.* One pass over the texts counts all terms and writes, a row a document, those that an item
   may have with their counts. A bitmap of fixed size over hashes of the items' terms says which; the join
   on the terms themselves comes next and is exact. Document frequencies, the number of documents and of
   all terms are aggregates of this table.
2. *Bounds.* An impact is what a term adds to a document's score. Of each term the ``k`` highest impacts are
   stored with their documents; the first bounds the term from above, the ``k``-th is a score that ``k``
   documents reach.
3. *Seed.* An item's ``k``-th score is at least the highest ``k``-th impact of its terms. The documents stored
   with its terms are scored exactly, and their ``k``-th score may raise that threshold.
4. *Prune.* An item's terms are ordered by their highest impact. The smallest ones, while their sum is below
   the threshold, can't lift a document to it by themselves: documents with no other term are left out.
   Equality stays, for it may win by its id.
5. *Candidates.* The postings of the other terms give (item, document) pairs with part of the score; pairs
   that the pruned terms' sum couldn't lift to the threshold go, and the rest is scored exactly.

Results are exact: no step leaves out a document that could be among the first ``k``. Scores are integers.

Items with the same id are one item with the terms of all; items without an id, a text or a term have no
rows. Null and empty texts hold no term and don't count as documents. Each row is a document of its own,
whatever its id; null ids come last among equal scores. Very long texts are one row of postings, as long as
the items have terms. Empty tables give no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import prepare, table, written

TOP = 10
#: Bits of the bitmap of terms, characters of a slice of rows, terms whose hashes a task keeps.
BITMAP, SLICE, KEPT = 1 << 22, 8 << 20, 1_000_000
#: ASCII bytes that are no letter or digit end a term; A-Z become small. Other bytes are parts of terms.
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text: runs of ASCII letters and digits and of all other characters, A-Z as a-z."""
    return text.encode().translate(_FOLD).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term: once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(set(terms(text)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n, terms, counts: a row for each text with a term; of its terms those that ``wanted`` may hold."""
    spark = docs.sparkSession
    places = wanted.select((F.crc32("term") % BITMAP).cast("int").alias("place")).distinct()  # BITMAP rows at most
    bits = np.zeros(BITMAP, dtype=bool)
    bits[[r[0] for r in places.collect()]] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, kept = np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).astype(bool), TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in slices([len(t) for t in texts], SLICE):
                out = []
                for i in range(start, end):
                    words = terms(texts[i])
                    if not words:
                        continue
                    counts = Counter(words)
                    if len(kept) > KEPT:
                        kept.clear()
                    for w in counts:
                        if w not in kept:
                            kept[w] = bool(held[zlib.crc32(w) % BITMAP])
                    own = [(w, c) for w, c in counts.items() if kept[w]]
                    out.append((number, ids[i].as_py(), len(words), [w for w, _ in own], [c for _, c in own]))
                    number += 1
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "row long, doc_id long, n long, terms array<binary>, counts array<long>")


def best(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The ``k`` first rows of each key with their ``rank``; tasks keep only ``k`` of a key before the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, of those above 0."""
    prepare(docs.sparkSession)
    asked = written(item_terms(items, item_id, item_text), "asked")
    wanted = written(asked.groupBy("term").agg(F.count("*").alias("n_items")).select("term"), "wanted")
    stored = written(postings(docs, wanted, doc_id, doc_text), "postings")
    count, total = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    frequency = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = written(wanted.join(frequency, "term").select("term", weight.alias("weight")), "weights")

    def impacts(rows: DataFrame) -> DataFrame:
        """row, term, impact of postings."""
        each = rows.select("row", F.expr(f"10 + (90 * n * {count}L) div {total}L").alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        each = each.select("row", "m", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf")).join(weights, "term")
        return each.select("row", "term", F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("impact")).where("impact > 0")

    def scored(pairs: DataFrame) -> DataFrame:
        """item_id, row, doc_id, score of the written pairs (item_id, row): impacts of the row's terms that the item has."""
        some = written(stored.join(pairs.select("row").distinct(), "row"), "some")
        sums = impacts(some).join(pairs, "row").join(asked, ["item_id", "term"]).groupBy("item_id", "row").agg(F.sum("impact").alias("score"))
        return sums.join(some.select("row", "doc_id"), "row")

    each = impacts(stored)
    tops = written(best(each, "term", k, F.desc("impact"), F.asc("row")), "tops")
    bounds = tops.groupBy("term").agg(F.max("impact").alias("high"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).alias("kth"))
    bounded = written(asked.join(bounds, "term"), "bounded")
    # exact scores of the stored documents of each item's terms
    seeds = written(asked.join(tops.select("term", "row"), "term").select("item_id", "row").distinct(), "seeds")
    seed = written(best(scored(seeds), "item_id", k, F.desc("score"), F.asc("row")), "seeds")
    floor = seed.where(F.col("rank") == k).select("item_id", F.col("score").alias("seeded"))
    least = bounded.groupBy("item_id").agg(F.max("kth").alias("kth")).join(floor, "item_id", "left")
    least = least.select("item_id", F.greatest("kth", F.coalesce("seeded", F.lit(0))).alias("least"))
    upwards = Window.partitionBy("item_id").orderBy("high", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = written(bounded.select("item_id", "term", "high", F.sum("high").over(upwards).alias("below")).join(least, "item_id"), "parted")
    rest = parted.groupBy("item_id").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(F.col("below") < F.col("least"), F.col("below"))), F.lit(0)).alias("rest"))
    needed = parted.where("below >= least").select("item_id", "term")

    part = each.join(needed, "term").groupBy("item_id", "row").agg(F.sum("impact").alias("part"))
    candidates = written(part.join(rest, "item_id").where("part + rest >= least").select("item_id", "row"), "candidates")
    found = best(scored(candidates), "item_id", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL = {
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM c) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
}

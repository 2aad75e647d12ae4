"""The corpus pipeline: documents that are not toxic, of good quality, each text once, packed.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but
the last return the columns of ``docs``. :func:`run` writes each stage's rows as Parquet and rereads
them as the next one's ``docs``. Labels of ``sf_dir`` train the two classifiers, outside their held-out
folds. Nulls: a null text counts as empty (kept by the first two stages' scores of empty texts if
these say so); rows with a null id pass like others. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagekit.llm import quality as quality_op
from lineagekit.llm import toxicity as toxicity_op
from lineagekit.llm.common import prepare, table, written
from lineagekit.llm.exact_dedup import exact_dedup
from lineagekit.llm.jaccard_join import jaccard_join
from lineagekit.llm.packing import pack

#: Near-duplicates share this many words a shingle and at least this share of shingles, in percent.
WORDS, PERCENT = 5, 80


def _kept(docs: DataFrame, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Rows whose text passes; all columns go through unchanged."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(keep(texts), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    prepare(spark)
    model = spark.sparkContext.broadcast(toxicity_op.model_of(docs, table(spark, sf_dir, "labels")))
    return _kept(docs, lambda texts: [model.value.document(t)[0] < toxicity_op.THRESHOLD for t in texts])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    prepare(spark)
    model = spark.sparkContext.broadcast(quality_op.model_of(docs, table(spark, sf_dir, "labels")))
    return _kept(docs, lambda texts: (model.value.scores(texts) >= quality_op.THRESHOLD).tolist())


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def _names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for helpers that no column of ``docs`` has."""
    lower = {c.lower() for c in docs.columns}
    return [next(n for n in (w + "_" * i for i in range(len(lower) + 1)) if n not in lower) for w in wanted]


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows (same id and text) one."""
    prepare(spark)
    own_id, own_text, keeper, digest = _names(docs, "own_id", "own_text", "keeper", "digest")
    white = " \t\n\x0b\x0c\r"
    keepers = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(keeper), F.unhex("text_sha256").alias(digest))
    rows = docs.withColumn(own_text, _digest(F.translate(F.coalesce("text", F.lit("")), white, "")))
    same = rows["doc_id"].eqNullSafe(keepers[keeper]) & (rows[own_text] == keepers[digest])
    return rows.join(keepers, same, "left_semi").dropDuplicates(["doc_id", own_text]).drop(own_text)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one: that with the smallest id (null ids last), and of several
    texts of this id that with the smallest digest. Rows that repeat an id and a text count as one."""
    prepare(spark)
    own_text, other, digest = _names(docs, "own_text", "other", "digest")
    joined = written(jaccard_join(docs, words=WORDS, percent=PERCENT, carry=_digest(F.col("text"))), "near")
    best = joined.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "carried")).alias("best"))
    others = joined.join(best, "group_id").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("carried") == F.col("best.carried"))))
    others = others.select(F.col("doc_id").alias(other), F.col("carried").alias(digest)).distinct()
    rows = docs.withColumn(own_text, _digest(F.col("text")))
    same = rows["doc_id"].eqNullSafe(others[other]) & (rows[own_text] == others[digest])
    return rows.join(others, same, "left_anti").drop(own_text)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of near-equal windows."""
    prepare(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact), ("jaccard_join", near), ("packing", packing)]
#: The classifiers and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

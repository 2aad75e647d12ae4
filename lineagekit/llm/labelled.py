"""A bounded, documented sample of labelled rows, and the fold that is held out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, fold: int, rows: int, chars: int) -> pd.DataFrame:
    """Columns text, label of at most ``rows`` labelled documents of at most ``chars`` characters.

    Half of the rows at most have label 1 and half label 0, where there are enough of both; weights
    of the labels among all labelled rows are in the column ``weight``. Rows are taken in the order
    of a hash of the id, also those that repeat an id. Only ids, bounded by ``rows``, are broadcast to
    find the texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = parts[0].union(parts[1])
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text") <= chars).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "label").toPandas()
    share = {y: n / max(1, sum(counts.values())) for y, n in counts.items()}
    have = found["label"].value_counts()
    found["weight"] = [share[y] / (have[y] / len(found)) for y in found["label"]]
    return found

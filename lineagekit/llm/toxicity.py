"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the words in it
(whole words and their first letters), and 0 without any word that tells; a document's is the noisy-or of its sentences. Only documents
have labels: weights are fitted by gradient steps on the bags' likelihood, and then the sentences'
probabilities say where a document offends.

Labels are learnt from a bounded sample (``ROWS`` rows of at most ``CHARS`` characters), outside the
held-out fold. Scores use the whole text and nothing else. Null and empty texts have no sentence and
score 0. No labels, or only one kind of them: every score is 0. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .labelled import held_out, sample

ROWS, CHARS, FEATURES, LEAST_BAGS = 6000, 20_000, 3000, 6
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
WORD = re.compile(r"[^\W\d_]+")


def parts_of(word: str) -> set[str]:
    """Features of a lower-case word."""
    return {word, *(f"{word[:n]}*" for n in (3, 4, 5, 6) if len(word) > n)}


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text."""
    return [m.span() for m in SENTENCE.finditer(text)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        value = self._words.get(word)
        if value is None:
            if len(self._words) > 400_000:
                self._words.clear()
            value = self._words[word] = sum(self.weights.get(f, 0.0) for f in parts_of(word))
        return value

    def sentence(self, words: set[str]) -> float:
        """Log odds of a sentence with such words; a sentence without a known feature has none."""
        known = [x for x in map(self.word, words) if x]
        return self.bias + sum(known) if known else -math.inf

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over sentences; the sentences at or over one half, as (start, end, probability)."""
        lower = text.lower()
        hits = {w for w in set(WORD.findall(lower)) if self.word(w)}
        if not hits:
            return 0.0, []
        spared, offending = 0.0, []
        for start, end in sentences(text):
            z = self.sentence(hits.intersection(WORD.findall(text[start:end].lower())))
            if z > -40:
                spared += z if z > 30 else math.log1p(math.exp(z))
            if z >= 0:
                offending.append((start, end, 1 / (1 + math.exp(-z))))
        return -math.expm1(-spared), offending


def _candidates(texts: list[str], labels: np.ndarray) -> list[str]:
    """Features whose share among bags of label 1 is clearly higher, the clearest first."""
    counts: list[Counter] = [Counter(), Counter()]
    for y in (1, 0):
        for text, label in zip(texts, labels):
            if label == y:
                found: set[str] = set()
                for word in set(WORD.findall(text.lower())):
                    found |= parts_of(word)
                counts[y].update(found if y else found & counts[1].keys())
        if y:
            counts[1] = Counter({f: n for f, n in counts[1].items() if n >= LEAST_BAGS})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    scored = []
    for f, b in counts[1].items():
        share = (counts[0][f] + b) / (n0 + n1)
        z = (b / n1 - counts[0][f] / n0) / math.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
        if z > 3.5:
            scored.append((-z, f))
    return [f for _, f in sorted(scored)[:FEATURES]]


def fit(rows: pd.DataFrame, steps: int = 250, ridge: float = 2e-4) -> ToxicityModel:
    """``rows``: text, label, weight."""
    rows = rows[rows["text"].fillna("").astype(str).str.len() > 0].reset_index(drop=True)
    y = rows["label"].to_numpy(float)
    if rows["label"].nunique() < 2:
        return ToxicityModel({}, -800.0)
    names = _candidates(rows["text"].tolist(), y)
    number = {f: i for i, f in enumerate(names)}
    known: dict[str, list[int]] = {}

    def numbers(word: str) -> list[int]:
        if (got := known.get(word)) is None:
            got = known[word] = [number[f] for f in parts_of(word) if f in number]
        return got

    doc_of, sent_of, feat_of, n = [], [], [], 0
    for d, text in enumerate(rows["text"]):
        for start, end in sentences(text):
            got = [i for w in set(WORD.findall(text[start:end].lower())) for i in numbers(w)]
            if got:
                sent_of += [n] * len(got)
                feat_of += got
                doc_of.append(d)
                n += 1
    doc_of, sent_of, feat_of = (np.array(v, dtype=np.int64) for v in (doc_of, sent_of, feat_of))
    weight = rows["weight"].to_numpy(float) / rows["weight"].sum()
    w, bias, m, v = np.full(len(names), 0.5), -5.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(sent_of, w[feat_of], n) if n else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        spared = np.bincount(doc_of, np.logaddexp(0, z), len(rows))
        # likelihood of a bag: label 0 costs ``spared``, label 1 costs -log(1 - exp(-spared))
        slope = np.where(y == 0, 1.0, -1 / np.expm1(np.clip(spared, 1e-9, 500))) * weight
        gz = slope[doc_of] * p
        grad = np.append(np.bincount(feat_of, gz[sent_of], len(names)) + ridge * w, gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], max(-14.0, bias - float(step[-1]))
    return ToxicityModel({f: float(x) for f, x in zip(names, w)}, bias)


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, offending (array of start, end, probability): one row per input row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            got = [shared.value.document(t) for t in batch.column(1).to_pylist()]
            offending = pa.array([[{"start": a, "end": b, "probability": p} for a, b, p in o] for _, o in got], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), offending], ["doc_id", "score", "offending"])

    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,probability:double>>")


def model_of(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(sample(docs, labels, "toxic", folds=FOLDS, fold=FOLD, rows=ROWS, chars=CHARS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}

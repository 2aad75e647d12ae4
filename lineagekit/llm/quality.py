"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on labelled good text and one on bad. A text is cut into
parts of ``PART`` bytes, all of which are compressed with either; the difference of the two sums over
the text's length is the only input of the score. A logistic fit over hinges of it, on the labelled
rows that made no dictionary, makes it a calibrated probability. (Parts are short so that a text that
repeats itself doesn't hide what the dictionaries know.)

Labels are learnt from a bounded sample outside the held-out fold: ``ROWS`` rows of at most ``CHARS``
characters. One half makes the dictionaries, of ``DICTIONARY`` bytes at most, from up to ``SLICES``
slices of ``SLICE`` bytes spread evenly over each text. The fit doesn't depend on the order of rows: it sorts them
by a hash of the text, halves its steps until the loss falls and raises if it doesn't converge.
Scores use the whole text and nothing else. Null and empty texts get the share of label 1. No labels,
or only one kind of them: every score is the share of label 1 (0.5 without any). Too little text to
train a dictionary: the slices themselves are the dictionary. Repeated rows get equal scores. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .labelled import held_out, sample

ROWS, CHARS, DICTIONARY = 8000, 20_000, 256 << 10
SLICE, SLICES, PART, LEVEL, HINGES = 1000, 6, 1024, 3, 16
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7


def coded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    knots: list[float]
    weights: list[float]
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)  # trained, or raw content where there was too little to train one
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        return made

    @staticmethod
    def difference(compressors: list[zstandard.ZstdCompressor], text: str) -> float:
        """Compressed size by the bad dictionary less that by the good one, over the length; 0 for an empty text."""
        data = coded(text)
        good, bad = (sum(len(c.compress(data[i : i + PART])) for i in range(0, len(data), PART)) for c in compressors)
        return (bad - good) / max(1, len(data))

    def design(self, difference: np.ndarray) -> np.ndarray:
        value = np.clip(difference, self.knots[0], self.knots[-1])
        scale = max(self.knots[-1] - self.knots[0], 1e-9)
        return np.stack([np.ones(len(value)), *(np.maximum(0, value - k) / scale for k in self.knots[:-1])], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        compressors = self.compressors()
        difference = np.array([self.difference(compressors, t or "") for t in texts])
        p = 1 / (1 + np.exp(-np.clip(self.design(difference) @ np.array(self.weights), -30, 30)))
        return np.where([bool(t) for t in texts], p, self.prior)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 200) -> np.ndarray:
    """Newton's method with a ridge, halving steps until the loss falls; the constant isn't shrunk.

    The loss is convex: where it converges, the result doesn't depend on the order of rows (but for rounding).
    """
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    loss = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (shrink * w * w).sum())
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-6)
        gradient = x.T @ (weight * (y - p)) - shrink * w
        step, size = np.linalg.solve((x * v[:, None]).T @ x + np.diag(shrink), gradient), 1.0
        while (then := loss(w + size * step)) > now and size > 1e-9:
            size /= 2
        if then > now or now - then <= 1e-10 * max(1.0, now):
            return w + size * step if then <= now else w
        w, now = w + size * step, then
    raise ArithmeticError("the calibration didn't converge")


def dictionary(texts: list[str]) -> bytes:
    """Of slices of each text, evenly spread."""
    slices = []
    for data in map(coded, texts):
        n = min(SLICES, -(-len(data) // SLICE))
        slices += [data[at : at + SLICE] for i in range(n) for at in [(max(0, len(data) - SLICE) * i) // max(1, n - 1)]]
    size = min(DICTIONARY, sum(map(len, slices)) // 4)
    try:
        return zstandard.train_dictionary(size, slices).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(slices)[:DICTIONARY]


def fit(rows: pd.DataFrame) -> QualityModel:
    """``rows``: text, label, weight."""
    rows = rows[rows["text"].fillna("").astype(str).str.len() > 0]
    if rows["label"].nunique() < 2:
        return QualityModel(b"", b"", [], [], float(rows["label"].mean()) if len(rows) else 0.5)
    rows = rows.assign(_order=[xxhash.xxh64_intdigest(coded(t)) for t in rows["text"]]).sort_values(["label", "_order", "text"], ignore_index=True)
    prior = float(np.average(rows["label"], weights=rows["weight"]))
    makes = (rows.groupby("label").cumcount() % 2 == 0).to_numpy()
    good, bad = (dictionary(rows["text"][makes & (rows["label"] == label).to_numpy()].tolist()) for label in (1, 0))
    rest = rows[~makes] if rows["label"][~makes].nunique() > 1 else rows
    model = QualityModel(good, bad, [], [], prior)
    compressors = model.compressors()
    difference = np.array([model.difference(compressors, t) for t in rest["text"]])
    model.knots = np.unique(np.quantile(difference, np.linspace(0, 1, HINGES + 1))).tolist()
    model.weights = logistic(model.design(difference), rest["label"].to_numpy(float), rest["weight"].to_numpy(float)).tolist()
    return model


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per input row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def model_of(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return fit(sample(docs, labels, "quality", folds=FOLDS, fold=FOLD, rows=ROWS, chars=CHARS))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}

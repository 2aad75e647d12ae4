"""LM scoring: a causal self-attention model on subword ids, beside a unigram base on words.

*Counts.* Every text is split once, in blocks (:mod:`blocks`), which keep their distinct words' subwords;
Spark counts the training rows' words over the corpus and each distinct word is cut into subwords once. From these words come the counts of
prefixes: how often a subword (or the word's end) follows the subwords before it in its word, for up to
``DEPTH`` subwords, and in how many ways the prefix goes on. A join takes them back to the words.
*Model.* One layer of causal self-attention with relative position biases, in numpy, predicts the class
of the next subword; in its class a subword has its share of the counts. Classes are the end, the most
frequent subwords, and clusters of the others. At a word's beginning that is the prediction. Inside a
word the prefix counts, less a discount, come first, and attention gets what they leave: all of it after
a prefix that the corpus doesn't have. Probabilities of all subwords add up to one.
*Training.* All that belongs to a subword is made of counts over every training row and its whole text:
its share, its prefixes, and how often each of the ``BEFORE`` most frequent subwords is shortly before
and after it, of which come its embedding (principal directions) and its cluster. A subword that no
training row holds has the embedding of no context, and the clusters of that. The weights that all
subwords share (queries, keys, values, positions, output: about 5,000 numbers) are fitted by Adam, with
gradients by hand, on every position of all training rows: each task goes over its blocks with a copy of
the weights, and Spark adds up their mean by positions. There are only as many tasks as have ``SHARE``
positions each; a corpus of less than one share is gone over up to ``PASSES`` times. Beyond one share the
weights, and so the scores, depend a little on how rows are dealt to tasks.
*Scoring.* Windows of ``STRIDE`` queries with keys from ``WINDOW - STRIDE`` positions before: contexts
overlap and each token is scored once. Windows of many documents go through one masked batch.

Base tokens: words after A-Z are lower-cased, then one end. The model scores the same text, its words
with a blank before each, as byte-level subwords (no text is unknown to it), then an end that is no
subword; log10. Null texts are empty: the end alone. A null id is not held out. Without training rows N
and V are 0, the base is log10(0.5 / 0.5) for each token, and the model is untrained. Repeated rows
count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_CHARS, Block, blocks, often, packed, returned, unpacked
from .common import partitions, prepare, table, written
from .labelled import held_out
from .packing import tokenizer

CLASSES, SINGLE, OPENING, WIDTH = 96, 32, 24, 20
WINDOW, STRIDE, BATCH = 24, 16, 256
#: Positions that a task learns from at least, and how often it goes over fewer.
SHARE, PASSES = 3_000_000, 4
#: Words whose answers every task holds.
FREQUENT = 60_000
#: Subwords of a prefix, and what is taken off its counts; frequent subwords that embeddings look for, and how far.
DEPTH, DISCOUNT, BEFORE, NEAR = 12, 0.65, 48, 2
LIMIT = np.float32(40)  # attention weights and logits are at most this, in place of subtracting maxima
LOG2E = np.float32(math.log2(math.e))
FOLDS, FOLD = 5, 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = -1
TEXTS = ("ids", "held", "lengths", "places", "words", "block")
CUT = "subwords binary, sizes binary"  # of a block's words, packed
FOLLOW = "<f2"  # prefix probabilities on their way to blocks
WORD = "word binary, count long, blocks long, subwords binary, first int, second int"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(text: str) -> list[bytes]:
    """Of A-Z lower-cased text; bytes are split at the six white characters of ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def subword_ids(path: str, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, each with a blank before it, end to end, and how many each has.

    Ids of a text are those of its words, one after the other, so many words are cut at once where each
    of them, and nothing else, begins with a blank.
    """
    t = tokenizer(path)
    texts = [" " + w.decode("utf-8", "replace") for w in found]
    flat = np.array(t.quick.encode_ordinary("".join(texts)), dtype=np.int32) if texts else np.zeros(0, np.int32)
    begins = np.flatnonzero(t.opens[flat])
    if len(begins) == len(texts):
        return flat, np.diff(np.append(begins, len(flat)))
    if len(texts) > 1:
        halves = [subword_ids(path, part) for part in (found[: len(found) // 2], found[len(found) // 2 :])]
        return tuple(np.concatenate(x) for x in zip(*halves))
    return flat, np.array([len(flat)])


def subwords_of(path: str, found: list[bytes] | pa.Array, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The same of any number of words, a list or a binary column."""
    if not len(found):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    column, t, parts = found.cast(pa.binary()) if isinstance(found, pa.Array) else pa.array(found, pa.binary()), tokenizer(path), []
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    text = np.insert(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at[:-1] - at[0], 32)  # a blank before each
    at = at - at[0] + np.arange(len(at))
    for i in range(0, len(column), most):
        stop = min(i + most, len(column))
        flat = np.array(t.quick.encode_ordinary(text[at[i] : at[stop]].tobytes().decode("utf-8", "replace")), dtype=np.int32)
        begins = np.flatnonzero(t.opens[flat])
        parts.append((flat, np.diff(np.append(begins, len(flat)))) if len(begins) == stop - i else subword_ids(path, column[i:stop].to_pylist()))
    return tuple(np.concatenate(x) for x in zip(*parts))


def kind_of(path: str) -> str:
    return "<u2" if tokenizer(path).size <= 65536 else "<u4"


@dataclass
class Attention:
    """Parameters, and tables by id; the end's id comes after all subwords."""

    class_of: np.ndarray
    within: np.ndarray  # log probability of an id in its class
    opens: np.ndarray  # whether an id begins a word; the end counts as such
    e: np.ndarray  # embeddings; after the end's, a row of zeros for padding
    p: dict[str, np.ndarray]
    end: int

    @classmethod
    def new(cls, counts: np.ndarray, opens: np.ndarray, near: np.ndarray, seed: int = 11) -> "Attention":
        """``counts`` by id, the end's last; ``near``: how often frequent ids are (before, after) each id."""
        rng, d, end = np.random.default_rng(seed), WIDTH, len(counts) - 1
        opens = np.append(opens, True)
        class_of = classes(counts, opens, near[0])
        share = counts + 0.05
        total = np.bincount(class_of, share, CLASSES)
        prior = np.log(np.maximum(total, 1e-3) / total.sum())
        p = {"r": np.zeros(WINDOW), "o": rng.normal(0, 0.1, (2 * d, CLASSES)), "b": prior}
        p |= {k: rng.normal(0, 1 / math.sqrt(d), (d, d)) for k in ("q", "k", "v")}
        return cls(class_of, np.log(share / total[class_of]).astype(np.float32), opens, np.pad(embeddings(counts, opens, near), ((0, 1), (0, 0))), {k: v.astype(np.float32) for k, v in p.items()}, end)

    def opening(self) -> np.ndarray:
        """By class, whether its ids begin words."""
        out = np.zeros(CLASSES, dtype=np.float32)
        out[self.class_of[self.opens]] = 1
        return out

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """What embeddings are multiplied with: queries' matrix for keys' embeddings, and the logits' matrix.

        Projections are linear, so attention works on embeddings, and values are projected with the
        logits. The last column of embeddings is 1: weights are added up there, and constants lie there.
        """
        p = self.p
        out = np.concatenate([p["v"] @ p["o"][:WIDTH], p["o"][WIDTH:]])
        out[-1] += p["b"]
        return p["q"] @ p["k"].T * np.float32(1 / math.sqrt(WIDTH)), out


def embeddings(counts: np.ndarray, opens: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Principal directions of what is shortly before and after an id, whether it begins words, and its frequency."""
    n, sides = max(1.0, counts.sum()), []
    for c in near:
        whole = c.sum(axis=0) + 1.0
        whole /= whole.sum()
        sides.append(np.sqrt((c + 20 * whole) / (c.sum(axis=1, keepdims=True) + 20)) - np.sqrt(whole))
    x = np.hstack(sides)
    weighted = x * np.sqrt(counts + 0.1)[:, None]
    directions = np.linalg.svd(weighted.T @ weighted)[0][:, : WIDTH - 3]
    z = x @ directions
    z /= np.maximum(np.sqrt((z**2 * counts[:, None]).sum(axis=0) / n), 1e-6)
    z = np.pad(np.clip(z, -4, 4) * 0.5, ((0, 0), (0, WIDTH - 3 - z.shape[1])))
    often = np.log(counts + 0.5)
    often = (often - (often * counts).sum() / n) / 3
    return np.column_stack([z, opens, often, np.ones(len(counts))]).astype(np.float32)


def classes(counts: np.ndarray, opens: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Class by id: the end, frequent ids, then clusters of those that begin words and of the others."""
    end = len(counts) - 1
    order = np.lexsort((np.arange(end), -counts[:end]))
    class_of = np.zeros(end + 1, dtype=np.int16)
    class_of[order[: SINGLE - 1]] = np.arange(1, SINGLE)
    rest, whole = order[SINGLE - 1 :], near.sum(axis=0) + 1.0
    whole /= whole.sum()
    for first, k, ids in ((SINGLE, OPENING, rest[opens[rest]]), (SINGLE + OPENING, CLASSES - SINGLE - OPENING, rest[~opens[rest]])):
        x = np.sqrt((near[ids] + 20 * whole) / (near[ids].sum(axis=1, keepdims=True) + 20)) / whole**0.25
        class_of[ids] = first + clusters(x / np.linalg.norm(x, axis=1, keepdims=True), np.sqrt(counts[ids] + 0.1), k)
    return class_of


def clusters(unit: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Spherical k-means of a vocabulary's rows."""
    k = min(k, len(unit))
    if not k:
        return np.zeros(0, dtype=np.int64)
    c = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        label, total = np.argmax(unit @ c.T, axis=1), np.zeros_like(c)
        np.add.at(total, label, unit * weight[:, None])
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return label


def steps(model: Attention, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of whole documents: ids end to end, each document's end after it and before its first."""
    targets = np.full(len(flat) + len(lengths), model.end, dtype=np.int32)
    inside = np.ones(len(targets), dtype=bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    targets[inside] = flat
    return np.concatenate([[model.end], targets[:-1]]).astype(np.int32), targets


def windows(model: Attention, inputs: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents' steps, by window the ids of its keys, the last of them its queries, and queries' classes.

    What lies before and behind a document is padding.
    """
    each = -(-lengths // STRIDE)
    ends = np.cumsum(each)
    slots = np.repeat((ends - each) * STRIDE - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(inputs))
    n, pad = int(each.sum()), model.end + 1
    queries, wanted = np.full(n * STRIDE, pad, dtype=np.int32), np.zeros(n * STRIDE, dtype=classes.dtype)
    queries[slots], wanted[slots] = inputs, classes
    ids, queries, before = np.empty((n, WINDOW), dtype=np.int32), queries.reshape(n, STRIDE), WINDOW - STRIDE
    ids[:, before:], ids[1:, :before] = queries, queries[:-1, STRIDE - before :]
    ids[ends - each, :before] = pad
    return ids, wanted.reshape(n, STRIDE)


@functools.lru_cache(1)
def _relative() -> tuple[np.ndarray, np.ndarray]:
    """Distance of each query to each key of a window, and whether it looks back."""
    distance = (np.arange(STRIDE) + WINDOW - STRIDE)[:, None] - np.arange(WINDOW)[None, :]
    return np.clip(distance, 0, WINDOW - 1), distance >= 0


def power(x: np.ndarray) -> np.ndarray:
    """2 to the power of ``x``, in place; ``x`` is at most ``LIMIT`` natural logarithms."""
    most = LIMIT * LOG2E
    if not x.max(initial=0) <= most:
        np.minimum(x, most, out=x)
    return np.exp2(x, out=x)


def attended(model: Attention, ids: np.ndarray, to_keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over windows, of embeddings: those of keys and queries, keys' turned round, weights, sums of weights,
    and by query the mean that attention gives, beside its own. Padding is zero, and so adds to no sum."""
    e = np.take(model.e, ids, axis=0)
    own, turned = np.ascontiguousarray(e[:, WINDOW - STRIDE :]), np.ascontiguousarray(e.transpose(0, 2, 1))
    distance, back = _relative()
    w = power((own.reshape(-1, WIDTH) @ (to_keys * LOG2E)).reshape(own.shape) @ turned)
    w *= np.where(back, np.exp(model.p["r"])[distance], np.float32(0))
    seen = w @ e
    joint = np.empty((*own.shape[:2], 2 * WIDTH), dtype=seen.dtype)
    # queries behind the end of a document are left out by callers; the floor keeps them finite
    total = np.maximum(seen[..., -1:], np.float32(1e-30))
    np.divide(seen, total, out=joint[..., :WIDTH])
    joint[..., WIDTH:] = own
    return e, own, turned, w, total, joint.reshape(-1, 2 * WIDTH)


def scores(model: Attention, flat: np.ndarray, lengths: np.ndarray, own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of each document's ids followed by the end.

    ``flat`` are the documents' ids end to end, ``lengths`` their numbers. For each id and each
    document's end, ``own`` is the probability that prefix counts give to it (to a word's end, where a
    word begins or the text ends) and ``left`` what they leave to attention; at a document's first
    position 1 and 0.
    """
    if not len(lengths):
        return np.zeros(0)
    inputs, targets = steps(model, flat, lengths)
    ids, wanted = windows(model, inputs, np.take(model.class_of, targets), lengths + 1)
    to_keys, out = model.folded()
    out = out * LOG2E
    chosen, opening = np.empty(wanted.shape, dtype=np.float32), np.empty(wanted.shape, dtype=np.float32)
    sums = np.stack([np.ones(CLASSES, dtype=np.float32), model.opening()], axis=1)
    for s in range(0, len(ids), BATCH):
        part = wanted[s : s + BATCH]
        logits = attended(model, ids[s : s + BATCH], to_keys)[-1] @ out
        at = np.arange(part.size) * CLASSES + part.ravel()
        both = np.log(np.concatenate([power(logits) @ sums, np.take(logits, at)[:, None]], axis=1))
        both -= both[:, :1]
        opening[s : s + BATCH], chosen[s : s + BATCH] = (both[:, i].reshape(part.shape) for i in (1, 2))
    # windows and their queries are in the order of the documents
    real = ids[:, WINDOW - STRIDE :] <= model.end
    chosen, opening = chosen[real], opening[real]
    log = chosen + np.take(model.within, targets)
    opens = np.take(model.opens, targets)
    # a word's end is left to attention as a whole, and then shared out among the ids that begin words
    part = np.where(opens, opening, log)
    log -= part
    np.exp(part, out=part)
    part *= left
    part += own
    log += np.log(part, out=part)
    return np.add.reduceat(log.astype(np.float64), np.cumsum(lengths + 1) - (lengths + 1)) / math.log(10)


def laid(model: Attention, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of whole documents that lie end to end."""
    inputs, targets = steps(model, flat, lengths)
    return windows(model, inputs, np.take(model.class_of, targets), lengths + 1)


def gradients(model: Attention, ids: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of the next class over windows."""
    p, d = model.p, WIDTH
    to_keys, out = model.folded()
    e, own, turned, w, total, joint = attended(model, ids, to_keys)
    real = ids[:, WINDOW - STRIDE :].ravel() <= model.end
    y = power(joint @ (out * LOG2E))
    whole = y @ np.ones((CLASSES, 1), np.float32)
    y.reshape(-1)[np.arange(len(y)) * CLASSES + wanted.ravel()] -= whole[:, 0]
    if not real.all():
        y[~real] = 0
    # neither weights nor probabilities are divided by their sums: what they are multiplied with is narrower
    part = np.float32(1 / np.count_nonzero(real)) / whole
    g_out = (joint * part).T @ y
    seen = y @ out[:d].T
    seen *= part
    # what a weight's share of the mean changes: the mean itself is taken off where embeddings are 1
    seen[:, -1] -= np.einsum("ij,ij->i", seen, joint[:, :d])
    ds = (seen.reshape(own.shape) / total) @ turned
    ds *= w
    g_keys = own.reshape(-1, d).T @ (ds @ e).reshape(-1, d) * np.float32(1 / math.sqrt(d))
    distance, back = _relative()
    return {
        "o": np.concatenate([p["v"].T @ g_out[:d], g_out[d:]]), "b": g_out[-1], "r": np.bincount(distance[back], ds.sum(axis=0)[back], WINDOW).astype(np.float32),
        "q": g_keys @ p["k"], "k": g_keys.T @ p["q"], "v": g_out[:d] @ p["o"][:d].T,
    }


class Fit:
    """Adam on a copy of a model's shared weights; about ``expected`` windows are to come, over which its rate declines."""

    def __init__(self, model: Attention, expected: float, rate: float = 0.03, seed: int = 2):
        flat = np.concatenate([v.ravel() for v in model.p.values()])
        cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
        # the model's weights are views of all of them, end to end
        self.model = replace(model, p={k: x.reshape(v.shape) for (k, v), x in zip(model.p.items(), np.split(flat, cuts))})
        self.flat, self.moment = flat, (np.zeros_like(flat), np.zeros_like(flat))
        self.expected, self.rate, self.rng = max(1.0, expected), rate, np.random.default_rng(seed)
        self.steps = self.windows = self.positions = 0

    def learn(self, flat: np.ndarray, lengths: np.ndarray, passes: int = 1, batch: int = 128) -> None:
        """From whole documents, each window once a pass in a random order."""
        rows, (m, v) = laid(self.model, flat, lengths), self.moment
        n = len(rows[0])
        self.positions += len(flat) + len(lengths)
        for _ in range(passes):
            for chosen in np.array_split(self.rng.permutation(n), -(-n // batch)):
                self.steps += 1
                self.windows += len(chosen)
                lr = self.rate * (1 - 0.9 * min(1.0, self.windows / self.expected))
                found = gradients(self.model, *(x[chosen] for x in rows))
                grad = np.concatenate([found[k].ravel() for k in self.model.p])
                m += 0.1 * (grad - m)
                v += 0.02 * (grad**2 - v)
                self.flat -= (lr * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.98**self.steps)) + 1e-8)).astype(np.float32)


def spread(cuts: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subwords of documents' words, end to end, and how many each document has.

    ``cuts``: where the subwords of each distinct word begin, and the end; ``lengths`` are in words.
    """
    size = np.diff(cuts)[places]
    ends = np.cumsum(size)
    at = np.repeat(cuts[places] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return at, np.diff(np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(lengths)]]))


def parts(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Runs of neighbouring documents of about ``most`` in all."""
    group = (np.cumsum(lengths) - lengths) // most
    return np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(group)) + 1) if len(lengths) else []


def word_table(rows: DataFrame, path: str) -> DataFrame:
    """word, count (in training rows), blocks, subwords, first, second (none: END): each distinct word once."""

    def cut(batches):
        for batch in batches:
            flat, sizes = subwords_of(path, batch.column(0))
            begins, columns = np.cumsum(sizes) - sizes, [*batch.columns, pa.array(keys(flat, sizes, kind_of(path)), pa.binary())]
            second = np.where(sizes > 1, np.append(flat, END)[np.minimum(begins + 1, len(flat))], END)
            columns += [pa.array(flat[begins], pa.int32()), pa.array(second, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "count", "blocks", "subwords", "first", "second"])

    return rows.groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("blocks")).mapInArrow(cut, WORD)


def followed(table: DataFrame, path: str, most_words: int = 100_000) -> DataFrame:
    """word, blocks, answer: the word's count (eight bytes), then by subword of it up to ``DEPTH`` what prefix
    counts give to what follows there (the next subword or the word's end), and what they leave.

    A prefix of one subword is counted over the corpus by Spark (a row a subword). Words that begin with
    the same two meet in a task, among buckets of about ``most_words``, and count their longer prefixes.
    """
    spark, size, kind = table.sparkSession, tokenizer(path).size, kind_of(path)
    pairs = table.where("count > 0").groupBy("first", "second").agg(F.sum("count").alias("n"))
    one = np.zeros((2, size))
    for r in pairs.groupBy("first").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # at most the vocabulary
        one[:, r["first"]] = r["n"], r["kinds"]
    shared = spark.sparkContext.broadcast(one)
    buckets = max(partitions(spark), -(-table.count() // most_words))

    def count(found: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, kind) for x in found.column("subwords").to_pylist()]
        sizes, n = np.array([min(len(x), DEPTH) for x in lists]), found.column("count").to_numpy().astype(float)
        grid = np.full((len(lists), DEPTH + 1), END, dtype=np.int32)
        for i, x in enumerate(lists):
            grid[i, : len(x)] = x[: DEPTH + 1]
        order = np.lexsort(grid.T[::-1])
        grid, n = grid[order], n[order]
        new = np.ones(grid.shape, dtype=bool)
        new[1:] = np.logical_or.accumulate(grid[1:] != grid[:-1], axis=1)
        follow = np.empty((len(lists), DEPTH, 2), dtype=FOLLOW)
        for d in range(1, DEPTH + 1):
            prefix, step = np.cumsum(new[:, d - 1]) - 1, np.cumsum(new[:, d]) - 1
            own = np.bincount(step, n)
            first = new[:, d]
            whole = np.bincount(prefix, n)[prefix] if d > 1 else shared.value[0][grid[:, 0]]
            kinds = np.bincount(prefix[first], own[step[first]] > 0, prefix[-1] + 1)[prefix] if d > 1 else shared.value[1][grid[:, 0]]
            some = whole > 0
            follow[order, d - 1, 0] = np.where(some, np.maximum(own[step] - DISCOUNT, 0) / np.maximum(whole, 1), 0)
            follow[order, d - 1, 1] = np.where(some, DISCOUNT * kinds / np.maximum(whole, 1), 1)
        counts = found.column("count").to_numpy().astype("<i8")
        out = [counts[i : i + 1].tobytes() + follow[i, :k].tobytes() for i, k in enumerate(sizes.tolist())]
        return pa.Table.from_arrays([found.column("word"), found.column("blocks"), pa.array(out, pa.binary())], ["word", "blocks", "answer"])

    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("first", "second"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(lambda t: count(t.drop(["bucket"])), "word binary, blocks long, answer binary")


def keys(flat: np.ndarray, sizes: np.ndarray, kind: str) -> list[bytes]:
    """The subwords of each word as bytes."""
    data, ends = flat.astype(kind).tobytes(), (np.cumsum(sizes) * np.dtype(kind).itemsize).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def joined(rows: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, and how many each row has."""
    return np.frombuffer(b"".join(rows), dtype=kind), np.array([len(r) for r in rows], dtype=np.int64) // np.dtype(kind).itemsize


def counts_of(table: DataFrame, path: str) -> np.ndarray:
    """By id, how often it is in training rows."""

    def count(batches):
        for batch in batches:
            flat, sizes = joined(batch.column(2).to_pylist(), kind_of(path))
            if len(flat):
                total = np.bincount(flat, np.repeat(batch.column(1).to_numpy(), sizes))
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.float64())})

    counts = np.zeros(tokenizer(path).size)
    for r in table.where("count > 0").select("word", "count", "subwords").mapInArrow(count, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    return counts


def cut(path: str) -> Callable[[pa.Array], list[pa.Array]]:
    """Columns CUT of a block's words."""
    return lambda found: [pa.array([packed(x)], pa.binary()) for x in subwords_of(path, found)]


def texts(split: DataFrame) -> DataFrame:
    """What training reads of blocks: their words only where they weren't cut before."""
    has = "subwords" in split.columns
    return split.select(*(c for c in TEXTS if not has or c != "words"), *(("subwords", "sizes") if has else ()))


def subwords_in(row: pa.Table, block: Block, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's words the subwords, end to end, and how many each has."""
    if "subwords" not in row.column_names:
        return subwords_of(path, block.words)
    return tuple(unpacked(row.column(c)[0].as_py()).astype(kind) for c, kind in (("subwords", np.int32), ("sizes", np.int64)))


def training(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each block the subwords of its training rows, end to end, and how many each row has."""
    for batch in batches:
        for row in map(lambda x: pa.Table.from_batches([x]), pa.Table.from_batches([batch]).to_batches(max_chunksize=1)):
            block = Block.of(row)
            ids, sizes = subwords_in(row, block, path)
            train = ~block.held
            at, lengths = spread(np.concatenate([[0], np.cumsum(sizes)]), block.places[np.repeat(train, block.lengths)], block.lengths[train])
            yield ids[at], lengths


def neighbours(split: DataFrame, frequent: np.ndarray, path: str) -> np.ndarray:
    """By id, how often each of ``frequent`` is at most ``NEAR`` subwords before it, and after it, in training rows."""
    k, size = len(frequent), tokenizer(path).size + 1
    number = np.full(size, -1, dtype=np.int32)
    number[frequent] = np.arange(k)
    shared = split.sparkSession.sparkContext.broadcast(number)

    def count(batches):
        total = np.zeros(2 * size * k, dtype=np.int64)
        for ids, lengths in training(batches, path):
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            top, found = shared.value[ids], []
            for gap in range(1, NEAR + 1):
                same = doc[gap:] == doc[:-gap]
                hit = np.flatnonzero(same & (top[:-gap] >= 0))
                found.append(ids[hit + gap] * k + top[hit])
                hit = np.flatnonzero(same & (top[gap:] >= 0))
                found.append((size + ids[hit]) * k + top[hit + gap])
            total += np.bincount(np.concatenate(found), minlength=2 * size * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = texts(split).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary times 2 BEFORE
    near = np.zeros(2 * size * k)
    near[found["at"].to_numpy(np.int64)] = found["n"].to_numpy()
    return near.reshape(2, size, k)


def together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of several blocks as one, in an order that the blocks don't matter to."""
    each = [x for flat, lengths in held for x in np.split(flat, np.cumsum(lengths)[:-1])]
    each.sort(key=lambda x: (zlib.crc32(x.tobytes()), len(x)))
    return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)


def fitted(split: DataFrame, model: Attention, path: str, n_ids: float, n_docs: int, share: int = SHARE) -> dict[str, np.ndarray]:
    """Shared weights learned from every training row: the mean of tasks' weights, by the positions they come from."""
    n = n_ids + n_docs
    tasks, passes = max(1, int(n // share)), int(min(PASSES, max(1, -(-share // max(1, n)))))
    shared = split.sparkSession.sparkContext.broadcast(model)
    # a document's last window is half empty on average
    expected = passes * (n / STRIDE + n_docs / 2) / tasks

    def run(batches):
        fit, held, size = Fit(shared.value, expected), [], 0
        for flat, lengths in training(batches, path):
            if len(lengths):
                held.append((flat, lengths))
                size += len(flat) + len(lengths)
            if size >= share:
                fit.learn(*together(held), passes)
                held, size = [], 0
        if held:
            fit.learn(*together(held), passes)
        if fit.positions:
            flat = np.concatenate([x.ravel() for x in fit.model.p.values()]).astype(float)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(flat)), pa.int32()), "total": pa.array(flat * fit.positions), "n": pa.array(np.full(len(flat), fit.positions), pa.int64())})

    found = texts(split).coalesce(tasks).mapInArrow(run, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).toPandas()  # the weights
    if not len(found):
        return model.p
    values = found.sort_values("at")["mean"].to_numpy().astype(np.float32)
    ends = np.cumsum([x.size for x in model.p.values()])
    return {k: part.reshape(x.shape) for (k, x), part in zip(model.p.items(), np.split(values, ends[:-1]))}


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    spark = prepare(docs.sparkSession)
    path = tokenizer_path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held", held_out(F.col("doc_id"), FOLDS, FOLD))

    split = written(blocks(rows, words, block_chars, more=(CUT, cut(path))), "blocks")
    each = split.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    each = each.select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    distinct = written(word_table(each, path), "words")

    n_docs = split.select(F.sum(F.expr("size(filter(held, h -> not h))"))).first()[0] or 0
    n_words, n_kinds = distinct.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    n_total, n_distinct = n_words + n_docs, n_kinds + (n_docs > 0)
    counts = np.append(counts_of(distinct, path), n_docs)
    frequent = np.lexsort((np.arange(len(counts) - 1), -counts[:-1]))[:BEFORE]
    model = Attention.new(counts, tokenizer(path).opens, neighbours(split, frequent, path))
    model.p = fitted(split, model, path, counts[:-1].sum(), n_docs)
    shared = spark.sparkContext.broadcast(model)

    # words of the most blocks go to every task (a bounded table), the others' answers by a join to their blocks
    known_words = written(followed(distinct, path), "followed")
    frequent_words = often(known_words, FREQUENT).select("word", "answer")
    kind, some = kind_of(path), frequent_words.collect()
    often_ids, often_sizes = subwords_of(path, [bytes(r["word"]) for r in some])
    often_words = spark.sparkContext.broadcast(dict(zip(keys(often_ids, often_sizes, kind), (bytes(r["answer"]) for r in some))))
    rare = each.select("block", "place", "word").join(F.broadcast(frequent_words.select("word")), "word", "left_anti")
    answers = rare.join(known_words.select("word", "answer"), "word").select("block", "place", "answer")

    def finish(block: Block, row: pa.Table, found: pa.Table) -> pa.Table:
        flat, sizes = subwords_in(row, block, path)
        # words are known by their subwords, which tell them apart
        answer = list(map(often_words.value.get, keys(flat, sizes, kind)))
        for place, own in zip(found.column("place").to_pylist(), found.column("answer").to_pylist()):
            answer[place] = own
        of_word = np.frombuffer(b"".join([x[:8] for x in answer]), "<i8")
        steps, depths = joined([x[8:] for x in answer], FOLLOW)
        cuts, depths = np.concatenate([[0], np.cumsum(sizes)]), depths // 2
        follow = np.tile(np.array([0, 1], dtype=np.float32), (len(flat), 1))  # beyond DEPTH nothing is known
        follow[np.repeat(cuts[:-1] - (np.cumsum(depths) - depths), depths) + np.arange(depths.sum())] = steps.reshape(-1, 2)
        at, lengths = spread(cuts, block.places, block.lengths)
        stop, start = np.concatenate([[0], np.cumsum(block.lengths)]), np.concatenate([[0], np.cumsum(lengths)])
        log = np.log10(np.append(of_word, n_docs) + 0.5) - math.log10(n_total + 0.5 * (n_distinct + 1))
        known = np.concatenate([[0], np.cumsum(of_word[block.places] > 0)])
        # each document's words and its end, one after the other
        flat_log = np.insert(log[block.places], stop[1:], log[-1])
        base = np.add.reduceat(flat_log, stop[:-1] + np.arange(len(block.lengths)))
        score = np.empty(len(lengths))
        for part in parts(lengths, 500_000):
            a, b = start[part[0]], start[part[-1] + 1]
            # what follows a subword is at the next position; a document's first has none before it
            own, left = (np.insert(follow[at[a:b], i], start[part] - a, 1 - i) for i in (0, 1))
            score[part] = scores(shared.value, flat[at[a:b]], lengths[part], own, left)
        columns = [block.ids, pa.array(block.held), pa.array(block.lengths + 1), pa.array(known[stop[1:]] - known[stop[:-1]] + (n_docs > 0)), pa.array(base, pa.float64()), pa.array(score)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = returned(split.drop("counts", "words"), answers, finish, RESULT, whole=True)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE_SQL: dict[str, str] = {}

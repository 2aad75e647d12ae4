"""The ten operators and the pipeline against brute force, exact round trips and held-out accuracy."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineagekit.llm import blocks, bpe, common, embedding_dedup, exact_dedup, jaccard_join, labelled, lm_scoring, packing, quality, registry, toxicity, url_filter, warc

from .conftest import SCHEMA, crc, prose

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, ids):
        self.p = {i: i for i in ids}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


# -- 1 ---------------------------------------------------------------------------------------------
def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate(LOW), tail[:end]


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://xexample.com/en/a", "https://a.b.net/fr/1", "x://net/es/?/", "http://com", "http://com/", "http://a.com?x/en/", "http://a.net/de/#y", "http://free-win-casino-99.example.org/x?id=8f3a9c&sid=aa&u=http%3A%2F%2Fz", "http://a://b.com/en/", "http://www.example.com/EN/", "http://h.org/\n/en", "http://h.org/" + "a" * 50_000]
    df = spark.createDataFrame([(i, u, "z", 1.0) for i, u in enumerate(urls)] + [(None, "http://a.com/", "z", 1.0), (4, urls[4], "z", 1.0)], "page_id long, url string, host string, label double")
    model = url_filter.UrlModel(url_filter.labelled_urls(spark, 600), trees=4, depth=3)
    out = url_filter.url_filter(df, model)
    rows = out.collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: r for r in rows}
    for i, u in enumerate(urls):
        host, path = plain_host(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0]), u
        assert got[i].verdict == (rule[1] if rule else got[i].model_verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.url_filter(df.limit(0), model).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_model_held_out(spark):
    """Trees fitted on part of the labelled URLs decide the rest; labels of one kind decide all."""
    both = url_filter.labelled_urls(spark, 3000)
    train, test = both.where("pmod(xxhash64(url), 4) > 0"), both.where("pmod(xxhash64(url), 4) = 0")
    model = url_filter.UrlModel(train)
    judged = model.verdict(test, "url")
    right = judged.select(F.avg(((F.col("model_verdict") == "block") == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    # URLs of another make than the training ones
    other = [("https://en.wikipedia.org/wiki/Apache_Spark", 0), ("https://docs.python.org/3/library/json.html", 0), ("http://news.bbc.co.uk/2/hi/science/default.stm", 0), ("https://www.gutenberg.org/ebooks/1342", 0), ("https://stackoverflow.com/questions/tagged/python", 0), ("http://185.23.11.9/click?id=99a8f7d6e5c4b3a2&sid=1f2e3d4c&aff=3311&to=http%3A%2F%2Fx9f8e7%2F", 1), ("http://a8f9e7d6c5.xyz/9f8e7d6c5b/4a3b2c1d0e9f8a7b/go?id=77aa88bb99cc00dd&sid=aa11bb22&aff=9", 1), ("http://cheap-pills-42.biz/offer?id=1a2b3c4d5e6f7a8b9c&sid=0f0f0f&aff=88&to=http%3A%2F%2Fq%2F", 1)]
    seen = model.verdict(spark.createDataFrame(other, "url string, label int"), "url").collect()
    assert sum((r.model_verdict == "block") == (r.label == 1) for r in seen) >= len(other) - 1
    one = url_filter.UrlModel(train.where("label = 1"))
    assert {r[0] for r in one.verdict(test, "url").select("model_verdict").distinct().collect()} == {"block"}


# -- 2 ---------------------------------------------------------------------------------------------
def dedup_expected(corpus):
    groups = defaultdict(list)
    for row in corpus:
        groups["".join(WHITE.findall(row[1] or ""))].append((-len(row[1] or ""), row[0] is None, row[0] or 0))
    return {k: (sorted(v)[0], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest_bytes,table_bytes", [(32, 1 << 24), (32, 3000), (1, 2500), (0, 3000)])
def test_exact_dedup(docs, corpus, digest_bytes, table_bytes):
    """Short digests collide, small memtables give many runs: verification must keep groups exact."""
    want = dedup_expected(corpus)
    rows = exact_dedup.exact_dedup(docs, digest_bytes=digest_bytes, table_bytes=table_bytes, range_entries=20).collect()
    assert len(rows) == len(corpus)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for row in corpus:
        if row[0] is None:
            continue
        best, size = want["".join(WHITE.findall(row[1] or ""))]
        assert (by_id[row[0]].keep_id, by_id[row[0]].group_size) == (None if best[1] else best[2], size)
        if digest_bytes == 32:
            assert by_id[row[0]].text_sha256 == hashlib.sha256("".join(WHITE.findall(row[1] or "")).encode()).hexdigest()
    assert sum(r.kept for r in rows) == len(want)


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# -- 3, 9 ------------------------------------------------------------------------------------------
def labelled_docs(n=500):
    r, docs, labels = random.Random(5), [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        parts = [prose(r, r.randrange(5, 14)).capitalize() + "." for _ in range(r.randrange(3, 9))]
        if toxic:
            parts[r.randrange(len(parts))] = f"You {prose(r, 3)} {r.choice(['scoundrel', 'nitwit'])} there."
        text = " ".join(parts)
        if not good:
            text = " | ".join(text.upper().split()) + "!!" * 20
        docs.append((i, text))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def graded(spark):
    d, lab = labelled_docs()
    return spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, threshold):
    x = scored.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"), 4, 2)).toPandas()
    return ((x["score"] >= threshold).astype(int) == x[column]).mean()


def test_toxicity(graded, docs, empty):
    d, lab = graded
    model = toxicity.model_of(d, lab)
    out = toxicity.toxicity(d, model)
    assert accuracy(out, lab, "toxic", toxicity.THRESHOLD) > 0.95
    found = [(r.text, s) for r in d.join(out, "doc_id").collect() for s in r.offending]
    assert found and sum(bool(re.search("scoundrel|nitwit", t[s.start : s.end].lower())) for t, s in found) / len(found) > 0.9
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (200, 201, 202)} == {0.0}
    assert toxicity.toxicity(empty, model).count() == 0
    assert toxicity.fit(pd.DataFrame({"text": [], "label": [], "weight": []})).document("a. b.")[0] == 0.0


def test_sentences_cover_texts():
    for t in ("", "a", "a. b! c\n\nd", "..", "no end", "x.\n", "\n\n"):
        spans = toxicity.sentences(t)
        assert "".join(t[a:b] for a, b in spans) == t


def test_quality(graded, docs, empty):
    d, lab = graded
    model = quality.model_of(d, lab)
    assert accuracy(quality.quality(d, model), lab, "quality", quality.THRESHOLD) > 0.93
    rows = quality.quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (200, 201)} == {model.prior}
    assert quality.quality(empty, model).count() == 0
    one = quality.fit(pd.DataFrame({"text": ["a", "b"], "label": [1, 1], "weight": [1.0, 1.0]}))
    assert one.scores(["x", ""]).tolist() == [1.0, 1.0]


def test_quality_fit_does_not_depend_on_the_order_of_rows(graded):
    d, lab = graded
    rows = labelled.sample(d, lab, "quality", folds=4, fold=2, rows=10_000, chars=10**6)
    texts = [prose(random.Random(i), 40) + (" | " * (i % 9)) for i in range(40)]
    want = quality.fit(rows).scores(texts)
    for seed in range(20):
        assert np.allclose(quality.fit(rows.sample(frac=1, random_state=seed)).scores(texts), want, atol=1e-9)


def test_logistic_converges_where_full_steps_do_not():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(4000), np.maximum(0, rng.normal(size=(4000, 12)) * rng.choice([0.01, 1, 30], 12))])
    y = (rng.random(4000) < 1 / (1 + np.exp(-np.clip(x @ rng.normal(size=13), -30, 30)))).astype(float)
    w = quality.logistic(x, y, np.ones(4000))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    assert np.abs(x.T @ (y - p) - 0.01 * np.append(0, w[1:])).max() < 1 and ((p > 0.5) == y).mean() > max(y.mean(), 1 - y.mean())


@pytest.mark.parametrize("name,column", [("op9_quality", "quality"), ("op3_toxicity", "toxic")])
def test_classifier_queries_on_held_out_rows(spark, name, column):
    """The queries themselves: fold, prediction, and at least the majority's share on the smallest fold."""
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert (out.held_out == [crc(i) % 4 == 2 for i in out.doc_id]).all() and (out.predicted == (out.score >= (0.7 if column == "quality" else 0.3))).all()
    lab = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    both = out[out.held_out].merge(lab[lab[column].isin([0, 1])], on="doc_id")
    assert (both.predicted == both[column]).mean() > max(both[column].mean(), 1 - both[column].mean())


def test_labels_outside_the_fold_only(spark, graded):
    d, lab = graded
    texts = set(labelled.sample(d, lab, "toxic", folds=4, fold=2, rows=10_000, chars=10**6)["text"])
    allowed = {r.text for r in d.collect() if crc(r.doc_id) % 4 != 2}
    assert texts <= allowed


# -- 4 ---------------------------------------------------------------------------------------------
def vectors(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 0.6], (n, 1))
    x[10:25] = x[9]
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("cap,shard", [(1500, 800), (60, 100)])
def test_embedding_dedup(spark, monkeypatch, cap, shard):
    """Small caps split shards into pairs of parts; links must be the same."""
    monkeypatch.setattr(embedding_dedup, "CAP", cap)
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    x = vectors()
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1), (None, rows[0][1], 1), (9, rows[9][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, vertex long")
    out = embedding_dedup.embedding_dedup(df).collect()
    assert len(out) == len(rows) + len(odd)
    ids = [*range(len(x)), 9]
    x = np.vstack([x, x[9]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    s = Sets(ids)
    for a, b in zip(*np.nonzero(hit)):
        s.join(ids[a], ids[b])
    got = {r.vec_id: r for r in out if r.vec_id is not None}
    true, found = hit.sum(), sum(got[ids[i]].n_links for i in range(len(ids)))
    assert found == true and all(got[i].n_links == hit[i].sum() for i in range(len(rows)) if i != 9)
    assert all(got[i].component_id == s.find(i) for i in range(len(rows)))
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (900, 901, 902, 903, 904, 905)] == [(0, i, True) for i in (900, 901, 902, 903, 904, 905)]
    assert (got[906].n_links, got[907].component_id) == (1, 906)
    null = [r for r in out if r.vec_id is None]
    assert [(r.n_links, r.component_id, r.kept) for r in null] == [(0, None, False)]


def test_embedding_dedup_of_any_magnitude(spark):
    rows = [(1, [1e160, 0.0]), (2, [2e160, 1e150]), (3, [1e-170, 0.0]), (4, [5e-324, 0.0]), (5, [1.7e308, 1.7e308]), (6, [3.0, 3.0]), (7, [-1e300, 0.0]), (8, [float("inf"), 0.0]), (9, [0.0, 0.0]), (10, [1.0, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 10: (4, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_embedding_dedup_empty(spark):
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------
def test_lm_scoring(docs, corpus, empty):
    rows = lm_scoring.lm_scoring(docs).collect()
    assert len(rows) == len(corpus)
    words = [(row[0], WHITE.findall((row[1] or "").translate(LOW)) + [None]) for row in corpus]
    held = lambda i: i is not None and crc(i) % 5 == 1
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, ws in words:
        if i is None:
            continue
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held(i))
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score < 0
    assert lm_scoring.lm_scoring(empty).count() == 0


def test_lm_scoring_learns_from_every_training_row(spark):
    """Words that only texts beyond the sample's rows and lengths hold are learned; texts seen tell from others."""
    r = random.Random(3)
    # the ids of other texts fill the sample, and what has the words is over CHARS besides
    rows = [(i, prose(r, 20)) for i in range(1500)] + [(i, " ".join(["zorblatt", "quuxelbar"] * 2000)) for i in range(2000, 2040)]
    held = [i for i in range(3000, 3200) if crc(i) % 5 == 1][:2]
    rows += [(held[0], " ".join(["zorblatt", "quuxelbar"] * 150)), (held[1], " ".join(["zorblett", "quuxolbar"] * 150))]
    got = {x.doc_id: x.score for x in lm_scoring.lm_scoring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]] > got[held[1]] + 300


def test_lm_attention_learns_from_every_training_row(spark):
    """Only texts of over 6000 characters, behind 1500 others, say which word follows which."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["river", "stone"]) for _ in range(20))) for i in range(1500)] + [(i, " ".join(["river", "stone"] * 700)) for i in range(2000, 2060)]
    held = [i for i in range(3000, 3200) if crc(i) % 5 == 1][:2]
    rows += [(held[0], " ".join(["river", "stone"] * 60)), (held[1], " ".join(["river"] * 60 + ["stone"] * 60))]
    got = {x.doc_id: x.score for x in lm_scoring.lm_scoring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]] > got[held[1]] + 30


def test_lm_weights_are_the_mean_of_tasks(spark, monkeypatch):
    """Several tasks learn from all rows, once each, and their weights are averaged by positions."""
    r = random.Random(6)
    rows = [(i, prose(r, 5 + i % 40), False) for i in range(120)]
    split = blocks.blocks(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartitionByRange(2, "doc_id"), lm_scoring.words, 4000)
    path = lm_scoring.default_path()
    parts = [list(lm_scoring.training(split.where(f"block >> 32 = {i}").select(*lm_scoring.TEXTS).toArrow().to_batches(), path)) for i in (0, 1)]
    n = [sum(len(f) + len(x) for f, x in part) for part in parts]
    counts = np.append(np.bincount(np.concatenate([f for part in parts for f, _ in part]), minlength=packing.tokenizer(path).size), 120).astype(float)
    frequent = np.lexsort((np.arange(len(counts) - 1), -counts[:-1]))[: lm_scoring.BEFORE]
    model = lm_scoring.Attention.new(counts, packing.tokenizer(path).opens, lm_scoring.neighbours(split, frequent, path))
    got = lm_scoring.fitted(split, model, path, counts[:-1].sum(), 120, share=sum(n) // 2)
    each = []
    for part in parts:
        fit, held = lm_scoring.Fit(model, (sum(n) / lm_scoring.STRIDE + 60) / 2), []
        for flat, lengths in part:
            held.append((flat, lengths))
            if sum(len(f) + len(x) for f, x in held) >= sum(n) // 2:
                fit.learn(*lm_scoring.together(held))
                held = []
        if held:
            fit.learn(*lm_scoring.together(held))
        each.append(fit.model.p)
    for k in got:
        assert np.allclose(got[k], (each[0][k] * n[0] + each[1][k] * n[1]) / sum(n), atol=1e-4), k


def test_lm_training_cuts_no_word_that_its_block_keeps_cut(spark, monkeypatch):
    """Blocks keep their words' subwords; training reads them alone, and learns from what it would cut itself."""
    r = random.Random(7)
    rows = spark.createDataFrame([(i, prose(r, i % 40) + " naïve 数字", i % 5 == 1) for i in range(90)] + [(90, "", False)], "doc_id long, text string, held boolean").coalesce(1)
    path = lm_scoring.default_path()
    plain = blocks.blocks(rows, lm_scoring.words, 4000).select(*lm_scoring.TEXTS).toArrow()
    kept = lm_scoring.texts(blocks.blocks(rows, lm_scoring.words, 4000, more=(lm_scoring.CUT, lm_scoring.cut(path)))).toArrow()
    assert "words" not in kept.column_names and len(kept) == len(plain) > 1
    want = list(lm_scoring.training(plain.to_batches(), path))
    monkeypatch.setattr(lm_scoring, "subwords_of", None)
    got = list(lm_scoring.training(kept.to_batches(), path))
    assert [(x.tolist(), n.tolist()) for x, n in got] == [(x.tolist(), n.tolist()) for x, n in want]


def test_lm_scoring_of_blocks(spark, docs):
    """Many small blocks give what one gives, but for the neighbours' order of addition."""
    key = lambda df: {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)): r.score for r in df.collect() if r.doc_id is not None}
    one, many = key(lm_scoring.lm_scoring(docs)), key(lm_scoring.lm_scoring(docs, block_chars=3000))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 0.01 * max(1, -one[k]) for k in one)


def test_lm_beats_its_base_on_held_out_rows(spark):
    out = registry.QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()
    assert len(out) == 2 and all(r.score > r.base for r in out)


def _small(monkeypatch, n=40):
    rng = np.random.default_rng(0)
    for name, value in (("CLASSES", 16), ("SINGLE", 8), ("OPENING", 4)):
        monkeypatch.setattr(lm_scoring, name, value)
    near = rng.integers(0, 9, (2, n + 1, 6)).astype(float)
    return rng, lm_scoring.Attention.new(rng.integers(0, 50, n + 1).astype(float), np.arange(n) % 2 == 0, near)


def test_attention_is_causal_and_normalised(monkeypatch):
    """With prefix counts, probabilities of all that can follow a text add up to that of the text."""
    rng, m = _small(monkeypatch)
    head = rng.integers(0, 40, 50)
    n = len(head)
    own, left = rng.random(n + 2) * 0.5, rng.random(n + 2)
    own[0], left[0] = 1, 0
    # what follows the last: prefix counts give 0.3 to id 7 (no opening), 0.2 to a word's end, and leave 0.5
    step = lambda ids, o, w: lm_scoring.scores(m, np.array(ids), np.array([len(ids)]), np.array(o), np.array(w))[0]
    after = {i: (0.2 if i % 2 == 0 else 0.3 if i == 7 else 0.0) for i in range(40)}
    end = step(head, np.append(own[:n], 0.2), np.append(left[:n], 0.5))
    total = 10**end
    for i, o in after.items():
        # the end after it is scored too; taken off by the same id with nothing but attention there
        whole = step(np.append(head, i), [*own[:n], o, 0.0], [*left[:n], 0.5, 1.0])
        alone = step(np.append(head, i), [*own[:n], 1.0 if i % 2 == 0 else 0.0, 0.0], [*left[:n], 0.0 if i % 2 == 0 else 1.0, 1.0])
        part = _attention(m, head, i)
        total += 10 ** (whole - alone) * 10 ** (_before(step, head, own, left)) * part
    assert total == pytest.approx(10 ** _before(step, head, own, left), rel=2e-3)
    both = lm_scoring.scores(m, np.concatenate([head, head[:9]]), np.array([n, 9]), np.concatenate([own[: n + 1], own[:10]]), np.concatenate([left[: n + 1], left[:10]]))
    assert both.tolist() == pytest.approx([step(head, own[: n + 1], left[: n + 1]), step(head[:9], own[:10], left[:10])], rel=1e-5)


def _before(step, head, own, left):
    """log10 of the text without what follows it: the end there is made certain but for attention's own share."""
    n = len(head)
    return step(head, [*own[:n], 1.0], [*left[:n], 0.0]) - math.log10(_END[0])


_END = [1.0]


def _attention(m, head, i):
    """Probability of id ``i`` after ``head`` (of a continuation; of an opening one given that a word begins), by plain attention."""
    x = np.append(m.end, head)
    at = len(x) - 1
    start = max(0, at // lm_scoring.STRIDE * lm_scoring.STRIDE - (lm_scoring.WINDOW - lm_scoring.STRIDE))
    e = m.e[x[start:]].astype(float)
    q, k, v = e[-1] @ m.p["q"], e @ m.p["k"], e @ m.p["v"]
    w = np.exp(k @ q / math.sqrt(lm_scoring.WIDTH) + m.p["r"][np.arange(len(e))[::-1]])
    logits = np.concatenate([(w[:, None] * v).sum(0) / w.sum(), e[-1]]) @ m.p["o"] + m.p["b"]
    p = np.exp(logits - logits.max())
    p /= p.sum()
    each = p[m.class_of] * np.exp(m.within)
    _END[0] = each[m.end] / each[m.opens].sum()
    return each[i] / (each[m.opens].sum() if m.opens[i] else 1.0)


def test_gradients_by_differences(monkeypatch):
    rng, m = _small(monkeypatch)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    flat, lengths = rng.integers(0, 40, 60), np.array([25, 0, 35])
    rows = lm_scoring.laid(m, flat, lengths)

    def loss():
        total = 0.0
        own, left = np.zeros(len(flat) + 3), np.ones(len(flat) + 3)
        opens = m.opens[np.concatenate([[*flat[:25], m.end], [m.end], [*flat[25:], m.end]])]
        both = lm_scoring.scores(m, flat, lengths, own, left).sum() * math.log(10)
        within = sum(m.within[t] for t in [*flat, m.end, m.end, m.end])
        return -(both - within) / (len(flat) + 3) + total * opens.sum()

    grads = lm_scoring.gradients(m, *rows)
    for name in m.p:
        at = tuple(s // 2 for s in m.p[name].shape)
        kept, h = m.p[name][at], 1e-2
        m.p[name][at] = kept + h
        up = loss()
        m.p[name][at] = kept - h
        down = loss()
        m.p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), rel=0.1, abs=2e-3), name


def test_subwords_of_words_are_those_of_the_text():
    path = lm_scoring.default_path()
    t = packing.tokenizer(path)
    found = ["a", "it's", "naïve", "x" * 300, "数字", "½", "a\xa0b", "\x85", "end."] * 30
    flat, sizes = lm_scoring.subwords_of(path, [w.encode() for w in found])
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [t.quick.encode_ordinary(" " + w) for w in found]


def test_places_are_packed_and_read_back():
    for values in (np.zeros(0, "<u4"), np.arange(70_000, dtype="<u4"), np.array([2**32 - 1, 0], "<u4")):
        assert (blocks.unpacked(blocks.packed(values)) == values).all()


# -- 6 ---------------------------------------------------------------------------------------------
def shingles(text, n):
    w = WHITE.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def expected_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    s = Sets([i for i, _ in sets])
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                s.join(a, b)
    return {i: (len(x), s.find(i)) for i, x in sets}


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, corpus, words, percent):
    want = expected_components([(r[0], r[1]) for r in corpus], words, percent)
    rows = jaccard_join.jaccard_join(docs, words=words, percent=percent).collect()
    assert len(rows) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want


def test_jaccard_join_small_sets(spark):
    """Short texts that differ by a word, joined by subsets and by lists."""
    r, rows = random.Random(2), []
    for i in range(300):
        base = [f"w{j}" for j in range((i % 20) + 4)]
        for _ in range(r.randrange(3)):
            base.insert(r.randrange(len(base)), r.choice(["p", "q"]))
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((1, 80), (2, 70)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_join(df, words=words, percent=percent).collect()}
        assert got == expected_components(rows, words, percent)


def test_jaccard_join_loose_group(spark):
    """Near copies of one text at similarities around the threshold, chains among them, on long lists."""
    r, words, percent = random.Random(5), 2, 70
    base, rows = prose(r, 60).split(), []
    for i in range(70):
        text = list(base)
        for at in r.sample(range(60), r.randrange(1, 7)):
            text[at] = f"new{i}x{at}"
        rows.append((i, " ".join(text)))
    long = prose(r, 140).split()
    rows += [(100 + i, " ".join(long[2 * i : 2 * i + 60])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_join(df, words=words, percent=percent).collect()}
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)}
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {i: new if c == old else c for i, c in want.items()}
    assert got == want
    assert 2 < len(set(want.values())) < 70


def test_jaccard_join_empty(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    s = Sets(range(500))
    for a, b in edges:
        s.join(a, b)
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {v: s.find(v) for e in edges for v in e if e[0] != e[1]} | {v: got[v] for v in got if v not in {x for e in edges for x in e if e[0] != e[1]}}
    assert all(got[v] == s.find(v) for v in got)


# -- 7 ---------------------------------------------------------------------------------------------
def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    rows = packing.pack(docs).toPandas()
    ids = {r[0]: np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in corpus if r[0] is not None and r[0] != 205}
    for i, want in ids.items():
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() == len(want) and (own.doc_tokens == len(want)).all()
        assert [crc32(want[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() <= 2048
    assert packing.pack(empty).count() == 0


def test_differencing():
    r = random.Random(9)
    for _ in range(60):
        sizes = [r.randrange(1, 500) for _ in range(r.randrange(1, 60))]
        k = r.randrange(1, 12)
        got = packing.differencing(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(len(sizes))) and len(got) == k
    sums = [sum(s) for s in ([8, 7], [6, 5, 4])]
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16] and sums == [15, 15]
    assert packing.windows([2000, 2000, 100], 2048) and len(packing.windows([1500, 1500, 1000], 2048)) == 3


# -- 8 ---------------------------------------------------------------------------------------------
def test_bpe_of_a_block_comes_back_in_batches():
    """Batches of few words or one text, whatever a block holds; together they are the library's ids and texts."""
    t, r = bpe.tokenizer(bpe.default_path()), random.Random(4)
    found = [prose(r, n) for n in (3, 0, 90, 400, 7, 7, 7, 60)] + ["Ünï çödé 数字"]
    block = blocks.Filling(0)
    for i, text in enumerate(found):
        block.add(i, False, t.words(text), len(text))
    block = blocks.Block.of(pa.Table.from_batches([block.row(True)]))
    coded = [np.array(x, dtype=t.width).tobytes() for x in t.ids([w.decode() for w in block.words])]
    got = bpe.texts(block, coded, t.width, t.pieces, 50).to_batches()
    words = lambda batch: sum(len(t.words(found[i])) for i in batch.column(0).to_pylist())
    assert len(got) > 3 and all(len(b) == 1 or words(b) <= 50 + max(len(t.words(found[i])) for i in b.column(0).to_pylist()) for b in got)
    rows = [x for b in got for x in b.to_pylist()]
    assert [x["doc_id"] for x in rows] == list(range(len(found)))
    for x, text in zip(rows, found):
        ids = t.whole.encode(text, add_special_tokens=False).ids
        assert x["ids"] == np.array(ids, dtype="<u4").tobytes() and x["decoded"] == t.whole.decode(ids, skip_special_tokens=False)


def test_bpe(docs, corpus, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == len(corpus)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    for row in corpus:
        if row[0] is not None:
            ids = t.encode(row[1] or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(got[row[0]].ids), dtype="<u4").tolist() == ids
            assert got[row[0]].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty).count() == 0


def test_plain_characters_split_alike():
    t = bpe.tokenizer(bpe.default_path())
    b = packing.tokenizer(packing.default_path())
    for c in map(chr, range(0x2100)):
        for s in (c, f"a{c}B", f"e{c}'s 1 {c}{c}"):
            if bpe.PLAIN.search(s) is None:
                assert t.words(s) == [w for w, _ in t.split.pre_tokenize_str(t.whole.normalizer.normalize_str(s))], hex(ord(c))
            if packing.PLAIN.search(s) is None:
                assert b.quick.encode_ordinary(s) == b.whole.encode(s, add_special_tokens=False).ids, hex(ord(c))


# -- 10 --------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    long = "<p>" + "x" * 300 + "</p>"
    pages = [(1, "http://a/ b", long), (2, None, long), (0, "http://c/", "short"), (5, "http://c/", "short"), (3, "u", None), (4, "u", ""), (None, "n", long), (6, "v", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (7, "é", "é" * 200_000), (1, "http://a/ b", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for version in (1, 2):
        records = warc.read_arc(warc.pack_arc(df.repartition(2), version=version, archive_bytes=2000))
        assert Counter(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in records.collect()) == Counter((h or "").encode() for _, _, h in pages)
    parts = warc.arc_to_warc(warc.read_arc(warc.pack_arc(df)))
    path = common.new_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(parts), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(pages) and all(r.intact is None if r.record_type == "revisit" else r.intact for r in got)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[2, "revisit", 1] == 1 and kinds[1, "response", None] == 2 and kinds[None, "revisit", 1] == 1 and kinds[5, "response", None] == 1
    first = {r.record_id for r in got if r.page_id == 1}
    assert all(r.refers_to_id in first for r in got if r.record_type == "revisit")
    for f in (path + "/" + n for n in os.listdir(path) if n.startswith("part-")):
        whole, n = gzip.open(f).read(), 0
        data = open(f, "rb").read()
        while data:
            z = zlib.decompressobj(31)
            assert z.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = z.unused_data, n + 1
        assert n == whole.count(b"WARC-Record-ID") and (n == 0 or b"warcinfo" in whole[:60])
    assert warc.read_warc(spark, path).where("record_type = 'warcinfo'").count() == 0
    empty = common.new_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(parts.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got if r.page_id is not None} == {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in pages if i is not None}


def test_arc_versions_and_faults():
    start = warc.arc_start(1, "x", "20010203040506")
    one = warc.arc_record(1, 0, "http://u/", "1.2.3.4", "20010203", "text/html", "-", "-", b"HTTP/1.0 200 OK\r\n\r\nbody\n\n")
    records = list(warc.parse_arc(start + one + one[:-3]))
    assert [r["truncated"] for r in records] == [False, True] and records[0]["block"].endswith(b"body\n\n")
    made = warc.convert(records[0])
    assert made["payload"] == b"body\n\n" and "WARC-Date: 2001-02-03T00:00:00Z" in made["head"] and made["warc_type"] == "response" and made["source_id"] is None
    assert list(warc.parse_arc(b"")) == [] and list(warc.parse_arc(start)) == []
    for bad in (b"http://u/ 1 2\n", start + b"\nbad line\n", start + b"\nno end"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


# -- pipeline --------------------------------------------------------------------------------------
def test_pipeline_stages(spark, docs, corpus, graded, tmp_path):
    import corpus_pipeline

    lab = graded[1]
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    texts = spark.createDataFrame(corpus, SCHEMA)
    known = graded[0].select((F.col("doc_id")).alias("doc_id"), "text")
    both = known.select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields[2:]]).union(texts.where("doc_id >= 200 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 1000))
    for name, stage in corpus_pipeline.STAGES:
        both = common.written(both, "before")
        out = common.written(stage(spark, both, str(tmp_path)), name)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == both.select("doc_id").distinct().count()
            break
        assert out.columns == both.columns and 0 < out.count() <= both.count()
        before, after = both.toPandas(), out.toPandas()
        if name == "toxicity":
            bad = {r.doc_id for r in lab.where("toxic = 1").collect()}
            assert len(bad & set(after.doc_id)) < 0.1 * len(bad) and len(set(before.doc_id) - set(after.doc_id) - bad) < 0.02 * len(before)
        if name == "quality":
            good = {r.doc_id for r in lab.where("quality = 1").collect()} & set(before.doc_id)
            assert len(good - set(after.doc_id)) < 0.05 * len(good)
        if name == "exact_dedup":
            want = dedup_expected([(None if pd.isna(i) else int(i), t) for i, t in zip(before.doc_id, before.text)])
            assert len(after) == len(want)
        if name == "jaccard_join":
            want = expected_components([(None if pd.isna(i) else int(i), t) for i, t in zip(before.doc_id, before.text)], 5, 80)
            assert sorted(i for i in after.doc_id if not pd.isna(i)) == sorted(i for i, (_, c) in want.items() if i == c)
        both = out
    assert corpus_pipeline.toxicity(spark, texts.limit(0), str(tmp_path)).count() == 0


# -- 4: recall --------------------------------------------------------------------------------------
def test_embedding_audit_is_by_vertex_and_the_rest_is_exact(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    middle = rng.normal(size=16)
    rows += [middle + rng.normal(size=16) * 0.05 for _ in range(100)]
    for _ in range(100):
        x = rng.normal(size=16)
        rows += [x, x + rng.normal(size=16) * 0.02]
    unit = np.stack(rows) / np.linalg.norm(rows, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    vertices = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(rows)], "vertex long, rows long, vector array<double>")
    # all links of the group are found, none of the pairs
    some = spark.createDataFrame([(i, int(true[i])) for i in range(100)], "vertex long, links long")
    assert embedding_dedup.audit(vertices, some, 0.9, queries=300) < 0.7
    # a search that finds nothing does not pass, also where there is a single shard
    monkeypatch.setattr(embedding_dedup, "_search_shard", lambda t: lambda f: pd.DataFrame({"vertex": f["vertex"], "links": 0, "root": f["vertex"], "missed": 0, "pairs": 0}))
    found = embedding_dedup.embedding_dedup(vertices, "vertex", "vector").collect()
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(true.tolist()))


# -- ids --------------------------------------------------------------------------------------------
def test_large_ids_beside_nulls(spark, graded):
    """Ids beyond 2^53 keep their digits in batches with null ids."""
    r, big = random.Random(8), 2**60
    rows = [(big + 2 * i + 1, prose(r, 30)) for i in range(12)] + [(None, prose(r, 30)), (None, None)]
    rows += [(big + 101, rows[0][1]), (big + 103, rows[1][1] + " changed")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(i for i, _ in rows if i is not None)
    ids = lambda out, c="doc_id": sorted(x for x in {q[c] for q in out.select(c).collect()} if x is not None)
    d, lab = graded
    for out in (exact_dedup.exact_dedup(df), toxicity.toxicity(df, toxicity.model_of(d, lab)), quality.quality(df, quality.model_of(d, lab)), lm_scoring.lm_scoring(df), jaccard_join.jaccard_join(df), packing.pack(df), bpe.encode_decode(df)):
        assert ids(out) == want
    assert {x.doc_id: x.keep_id for x in exact_dedup.exact_dedup(df).where("group_size > 1").collect() if x.doc_id} == {big + 1: big + 1, big + 101: big + 1}
    assert {x.component_id for x in jaccard_join.jaccard_join(df, words=2, percent=60).where(f"doc_id in ({big + 3}, {big + 103})").collect()} == {big + 3}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://u/").alias("url"), F.col("text").alias("html"))
    path = common.new_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(warc.arc_to_warc(warc.read_arc(warc.pack_arc(pages)))), path)
    assert ids(warc.read_warc(spark, path), "page_id") == want


def test_null_ids_link_and_ids_of_two_texts(spark, tmp_path, graded):
    import corpus_pipeline

    text = prose(random.Random(1), 60)
    near = text + " more"
    rows = [(5, text, "x"), (None, near, "x"), (7, near + " still", "x"), (7, prose(random.Random(2), 60), "x"), (9, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string").withColumn("own_text", F.lit(1)).withColumn("_id", F.lit(2))
    got = {(r.doc_id, r.n_shingles > 1): r.component_id for r in jaccard_join.jaccard_join(df.where("_sha = 'x'"), words=5, percent=90).collect()}
    assert got[None, True] == 5
    kept = corpus_pipeline.near(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, text), (7, rows[3][1]), (9, "short")])
    assert corpus_pipeline.exact(spark, df, "").columns == df.columns and corpus_pipeline.exact(spark, df, "").count() == 5

"""Ranked search against brute force over all documents, and against SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lineagekit.llm import lexical_search, registry

from .conftest import SCHEMA, prose
from .test_llm import LOW

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DATA = "/root/testdata/sf0.001"


def brute(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None and t is not None:
            asked[i] |= set(TERM.findall(t.translate(LOW)))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def items_of(corpus):
    r = random.Random(2)
    texts = [x[1] for x in corpus if x[1] and len(x[1]) < 5000]
    items = [(i, r.choice(texts)[: r.randrange(5, 300)]) for i in range(25)]
    return items + [(3, "more for THREE river river"), (30, None), (31, ""), (32, "the"), (33, "unheardof"), (None, "the river"), (34, "数字 Ünï x"), (35, prose(r, 3000)), (1 << 60, "x")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search(spark, docs, corpus, monkeypatch, k):
    monkeypatch.setattr(lexical_search, "KEPT", 20)
    monkeypatch.setattr(lexical_search, "SLICE", 3000)
    monkeypatch.setattr(lexical_search, "BITMAP", 8 if k == 3 else 1 << 22)  # a full bitmap lets all terms through
    items = items_of(corpus)
    asked = spark.createDataFrame([(*x, "r", 2, 3) for x in items], "item_id long, text string, row string, n long, weight long")
    found = lexical_search.search(docs, asked, k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(x) for x in found), key=str) == brute([x[:2] for x in corpus], items, k)


def test_ties_and_words_of_all(spark):
    # ties at the threshold, a term of every document, fewer documents than asked for
    docs = [(i, "common words here" if i % 2 else f"common words here rare{i % 3}") for i in range(40, 0, -1)] + [(7, "lonely"), (6, "lonely")]
    items = [(1, "common words"), (2, "rare0 rare1 common"), (3, "lonely common"), (4, "lonely")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(x) for x in found), key=str) == brute(docs, items, 10)


def test_empty(spark, docs, empty):
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def test_query_against_sql(spark):
    df = registry.QUERIES["op12_lexical_search"](spark, DATA)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as from '{DATA}/{name}.parquet'")
    want = con.sql(registry.ORACLE_SQL["op12_lexical_search"])
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))

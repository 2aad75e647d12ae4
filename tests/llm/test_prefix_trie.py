"""The trie of conversations against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lineagekit.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, name string, at long, depth long"
DATA = "/root/testdata/sf0.001"


def brute(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(talks.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(int)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for key, convs in nodes.items():
        own = (len(convs) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0)
        for d in range(len(key) + 1):
            saved[key[:d]] += own
            leaves[key[:d]] += key not in children
    out = []
    for key, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if made[c] == key)
        out.append((min(convs), len(key), min(nodes[key[:-1]]) if key else None, len(convs), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=3):
    r, rows = random.Random(seed), []
    said = ["hello  there", "", None, "a\tb c", "Ünï x", "same words again", "long " * 500]
    for c in [*range(-25, 70), 1 << 55, (1 << 55) + 1, 10**15, 10**15 + 19]:
        n = r.choice([1, 2, 3, 4, 5, 8]) if c % 9 else 17
        common = r.random() < 0.4
        for t in range(n):
            rows.append((c, t if r.random() > 0.05 else None, r.choice(["user", "assistant", None]) if not common else "user", r.choice(said) if not common else "the common turn"))
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(150)] + [(201, t, "user", f"turn {t % 3}") for t in range(149)]
    rows += [(None, 1, "user", "no conversation"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "system", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("share", "packed"), [(64, 1 << 16), (4, 8)])
def test_prefix_trie(spark, monkeypatch, share, packed):
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", share)
    monkeypatch.setattr(prefix_trie, "PACKED", packed)
    rows = fixture()
    talks = spark.createDataFrame([(*x, "n", 1, 2) for x in rows], SCHEMA).repartition(4)
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(talks).collect()), key=str) == brute(rows)


def test_turnless_and_empty(spark):
    # the first turns of a base that isn't there replace all of a short conversation
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    talks = spark.createDataFrame([(*x, "n", 1, 2) for x in rows], SCHEMA)
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(talks).collect()), key=str) == brute(rows)
    assert prefix_trie.prefix_trie(talks.limit(0)).collect() == []


def test_positions_of_groups_over_many_ranges(spark):
    r = random.Random(1)
    rows = [(g, n, r.randrange(9)) for g, size in ((1, 3), (2, 900), (3, 1), (4, 50)) for n in range(size)]
    df = prefix_trie.written(spark.createDataFrame(rows, "g long, n long, v long").repartition(5), "test")
    found = prefix_trie.running(df, "g", [df["n"].desc()], ["v"]).collect()
    want = [(g, n, sum(1 for h, m, _ in rows if h == g and m > n), sum(v for h, m, v in rows if h == g and m >= n)) for g, n, _ in rows]
    assert sorted((x["g"], x["n"], x["at"], x["sum_v"]) for x in found) == sorted(want)


def test_query_against_sql(spark):
    df = registry.QUERIES["op13_prefix_trie"](spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{DATA}/conversations.parquet'")
    want = con.sql(registry.ORACLE_SQL["op13_prefix_trie"])
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))

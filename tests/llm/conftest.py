import random
import zlib

import pytest

WORDS = "the of and river stone glass cloud paper green little quiet yellow garden window market bridge winter summer silver copper".split()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, group_size long, vertex long, block long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and clashing extra columns."""
    r, rows = random.Random(7), []
    base = [prose(r, r.randrange(1, 120)) for _ in range(60)]
    for i in range(150):
        text = base[i % 60] if i % 3 else prose(r, r.randrange(1, 200))
        if i % 5 == 1:
            w = text.split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 11 == 0:
            text = text.replace(" ", "  \n").upper() if i % 2 else f" {text}\t"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, " \n\t", "en", "s", 3), (203, prose(r, 30_000), "en", "s", 1), (204, "x", "en", "s", 1), (205, "x", "en", "s", 1), (205, "x", "en", "s", 1), (None, "no id here at all", "en", "s", 1), (None, None, None, None, None), (206, "Ünï çödé – naïve “quotes” 数字 ½ İ Σς <|endoftext|> it's 42", "fr", "s", 9), (207, "y" * 70_000, "en", "s", 1)]
    return [(*row, "d", 0.5, 3, 4, 5) for row in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

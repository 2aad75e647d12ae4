"""Strict JSON against Python's reader on random texts, each fault, and limits that are kept while rows are read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lineagekit.sources import strict_json as J

FAULTS = [
    ('{"a":1,"a":2}', J.REPEATED), ('{"a":1,"\\u0061":2}', J.REPEATED), ('{"a":{"b":1},"b":{"a":1}}', None), ('[{"a":1},{"a":2}]', None), ('{"a":1,}', J.SYNTAX), ("[1,]", J.SYNTAX), ("[,1]", J.SYNTAX), ("{}", None), (" [ ] ", None), ("01", J.SYNTAX), ("-", J.SYNTAX), ("1.", J.SYNTAX), ("1e5", None),
    ("NaN", J.SYNTAX), ("", J.SYNTAX), (" ", J.SYNTAX), ("1 2", J.SYNTAX), ('"a\tb"', J.SYNTAX), ('"\\x"', J.SYNTAX), ('"\\u12g4"', J.SYNTAX), ('"open', J.SYNTAX), ("[" * 7 + "]" * 7, None), ("[" * 8 + "]" * 8, J.DEEP), ('{"a":' * 8, J.DEEP), ("[1}", J.SYNTAX), ('{"a" 1}', J.SYNTAX), ('{1:2}', J.SYNTAX), ("]", J.SYNTAX),
    ("﻿1", J.SYNTAX), (" 1", J.SYNTAX), ("truex", J.SYNTAX), ('{"a":1,"a":', J.REPEATED), ('{"日":"本","\\u65e5":1}', J.REPEATED),
]


@pytest.mark.parametrize(("text", "want"), FAULTS)
def test_faults(text, want):
    assert J.fault(text) == want


def test_like_pythons_reader_on_random_texts():
    r, seen = random.Random(4), {True: 0, False: 0}
    for _ in range(20_000):
        text = "".join(r.choice(['{', '}', '[', ']', '"a"', '"b"', ':', ',', '1', '-0.5e3', 'true', 'null', ' ']) for _ in range(r.randrange(1, 9)))
        try:
            json.loads(text)
            good = True
        except ValueError:
            good = False
        found = J.fault(text, depth=100)
        seen[good] += 1
        assert (found in (None, J.REPEATED)) == good, text
    assert min(seen.values()) > 100


def test_rows_keep_their_faults(spark):
    rows = [(1, '{"k": 5}', "x"), (2, None, "x"), (3, '{"k": 5, "k": 6}', None), (4, '"' + "é" * 20 + '"', "x"), (5, "[1, 2", "x")]
    got = J.checked(spark.createDataFrame(rows, "id int, t string, json_fault string"), "t", most_bytes=30).select("id", "json_fault", F.try_variant_get("json", "$.k", "int").alias("k")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None, 5), (2, J.SYNTAX, None), (3, J.REPEATED, None), (4, J.LARGE, None), (5, J.SYNTAX, None)]
    assert J.checked(spark.createDataFrame([], "t string"), "t").collect() == []


def test_limits_are_kept_without_another_pass(spark):
    rows = spark.createDataFrame([("ab",), ("cde",), (None,)], "t string")
    df, limits = J.limited(rows, {"characters": 4, "rows": 3}, {"characters": F.length("t")})
    df.collect()
    with pytest.raises(ValueError, match="characters: 5 > 4"):
        limits.check()
    df, limits = J.limited(rows, J.PAGE_LIMITS, {"characters": F.length("t")})
    df.write.format("noop").mode("overwrite").save()
    assert limits.check() == {"characters": 5, "rows": 3}

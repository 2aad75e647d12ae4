"""Lines by anchor, texts of side B by clause, eligibility, limits and substring counts on golden cases."""

import pytest
from pyspark.sql import functions as F

from lineagekit.functions import intervals as I
from lineagekit.operators import comparison, matcher, records, semantics


def test_lines_keep_their_first_height(spark):
    items = [("p", 1, 0.0, 100.0, "A"), ("p", 2, 9.0, 98.0, "B"), ("p", 3, 0.0, 96.0, "C"), ("p", 4, 9.0, 94.0, "D"), ("p", 5, 0.0, 50.0, " ")]
    df = spark.createDataFrame([(p, n, x, y, 5.0, 5.0, s) for p, n, x, y, s in items], "page string, n int, x double, y double, w double, h double, str string")
    assert [tuple(r) for r in records.lines_of(df, "page", "n").orderBy("line").select("line", "y", "text", "segments").collect()] == [(1, 100.0, "AB", 1), (2, 96.0, "CD", 1)]
    # the order of the items decides: begun in the middle, one line takes all four
    back = df.withColumn("n", F.when(F.col("str") == "B", 0).otherwise(F.col("n"))).where("str <> 'D'")
    assert [r["text"] for r in records.lines_of(back, "page", "n").collect()] == ["ACB"]


def test_line_boxes_gaps_and_missing_heights(spark):
    items = [(1, 0.0, 10.0, 5.0, None, "a"), (2, 40.0, 11.0, 5.0, 0.0, " b "), (3, 46.0, 9.0, 5.0, 20.0, "c")]
    df = spark.createDataFrame([("p", *i) for i in items], "page string, n int, x double, y double, w double, h double, str string")
    (row,) = records.lines_of(df, "page", "n").collect()
    assert tuple(row) == ("p", 1, 10.0, "a b c", 2, 0.0, 51.0, 4.0, 29.0)


def test_actual_texts_are_read_in_their_clause(spark):
    point = I.interval(F.lit(12.0), F.lit(12.0))
    row = spark.createDataFrame([("検査の結果、12Hz、公称50Hz", "12Hz")], "t string, q string")
    whole, own = (semantics.interval_semantics(F.lit("B"), F.col("t"), point, clause=c) for c in (None, ("t", "q", "0")))
    a_side, condition = semantics.interval_semantics(F.lit("A"), F.col("t"), point, clause=("t", "q", "0")), semantics.interval_semantics(F.lit("B"), F.col("t"), point, clause=("t", "q", "0"), is_condition=F.lit(True))
    plain = semantics.interval_semantics(F.lit("A"), F.col("t"), point)
    got = row.select(whole[0].alias("w"), own[0].alias("o"), (a_side == plain).alias("a"), condition[0]["value"].alias("c")).first()
    assert (got["w"]["value"], round(got["w"]["confidence"], 6)) == ("achieved_point", 0.3)
    assert (got["o"]["value"], round(got["o"]["confidence"], 6), got["a"]) == ("achieved_point", 0.7, True)


def test_eligibility_reasons(spark):
    ok = {"engine": True, "has_a": True, "has_b": True, "a_id": "x", "b_id": "y", "a_kind": "string", "b_kind": "string", "a_count": 1, "b_count": 1}
    cases = [
        ({}, None), ({"engine": None}, "NOT_MATCHING_ENGINE"), ({"has_b": False, "a_kind": "number"}, "MISSING_SIDE"), ({"a_id": "", "b_kind": "number"}, "NO_TRACE_ID"), ({"a_id": None, "a_kind": "null"}, "NO_TRACE_ID"),
        ({"a_kind": "number"}, "NON_STRING_TRACE_ID"), ({"b_id": " y"}, "NO_TRACE_ID"), ({"b_count": 2}, "DUPLICATE_TRACE_ID"), ({"a_count": None}, "DUPLICATE_TRACE_ID"), ({"a_id": "p"}, "DUPLICATE_PAIR"), ({"a_id": "p"}, "DUPLICATE_PAIR"),
    ]
    schema = "i int, engine boolean, has_a boolean, has_b boolean, a_id string, b_id string, a_kind string, b_kind string, a_count int, b_count int"
    df = spark.createDataFrame([(i, *(ok | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r["reason"] for r in records.eligibility(df).orderBy("i").collect()] == [want for _, want in cases]


def test_alternatives_up_to_64(spark):
    none = F.lit(None).cast("struct<value:double>")
    assert comparison.MOST_OPTIONS == 64
    quantity = lambda n: F.struct(F.lit("alternatives").alias("kind"), I.interval(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("interval"), F.array(*(F.lit(float(i)) for i in range(n))).alias("options"))
    got = spark.range(1).select(*(comparison.quantity_reason(quantity(n)).alias(f"r{n}") for n in (17, 64, 65)), none.alias("n")).first()
    assert (got["r17"], got["r64"], got["r65"]) == (None, None, "quantity_value_limit_exceeded")


def test_segments_inside_other_segments_count(spark):
    rows = spark.createDataFrame([(1, "総合定格値", ["総合定格値"]), (2, "定格値の表", ["定格値の表"]), (3, "x", ["x"])], "id int, value string, segments array<string>")
    asked = spark.createDataFrame([("定格値",), ("定格",), ("x",), ("総合定格値",), ("none",), ("",), ("の",)], "segment string")
    got = {r["segment"]: tuple(r)[1:] for r in matcher.discrimination(asked, rows).collect()}
    assert got == {"定格値": (0, 2, False, True), "定格": (0, 2, False, True), "x": (1, 1, False, False), "総合定格値": (1, 1, False, False), "none": (0, 0, False, False), "の": (0, 1, False, False)}
    two = rows.where("id < 3").withColumn("segments", F.array(F.lit("定格値"))).union(rows.where("id = 3").withColumn("segments", F.array(F.lit("定格値"))))
    assert matcher.discrimination(asked.where("segment = '定格値'"), two).first()["is_boilerplate"]


def test_caps_over_all_groups(spark):
    side = lambda rows: spark.createDataFrame(rows, "k string, quantity_id int, concept string")
    r = side([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z"), ("only r", 1, "x")])
    a = side([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 9, None), ("c", 1, "z"), ("c", 2, "w"), ("only a", 1, "x")])
    found = lambda **caps: sorted(((x["k"] or "", x["concept"] or "", x["reason"] or "pair", x["pairs"]) for x in comparison.candidate_pairs(r, a, ["k"], **caps).collect()), key=str)
    noted = [("a", "", "property_unresolved", None), ("b", "", "property_unresolved", None), ("b", "y", "concept_mismatch", None), ("c", "w", "concept_mismatch", None)]
    pairs = [("a", "x", "pair", None)] * 4 + [("b", "x", "pair", None), ("c", "z", "pair", None)]
    assert found() == sorted(noted + pairs, key=str)
    assert found(per_group=3) == sorted(noted + pairs[1:] + [("a", "x", "candidate_limit_exceeded", 1)], key=str)
    # the third group is one too many; what comes before it in order is reported, its own bucket's open ids too
    stopped = comparison.candidate_pairs(r, a, ["k"], per_group=3, total=4).collect()
    assert sorted(((x["k"] or "", x["concept"] or "", x["reason"], x["pairs"]) for x in stopped), key=str) == sorted([*noted[:3], ("a", "x", "candidate_limit_would_exceed", 4), ("c", "w", "concept_mismatch", None), ("", "", "total_candidate_limit_exceeded", 6)], key=str)
    (total,) = [x for x in stopped if x["reason"] == "total_candidate_limit_exceeded"]
    assert (total["limit_kinds"], total["materialized"], total["buckets"], total["unscanned"]) == ("materialized", 5, 3, 0)
    (early,) = [x for x in comparison.candidate_pairs(r, a, ["k"], potential=3).collect() if x["reason"] == "total_candidate_limit_exceeded"]
    assert (early["limit_kinds"], early["pairs"], early["buckets"], early["unscanned"]) == ("potential", 4, 1, 2)
    for bad in (0, True, 1.5, "3"):
        with pytest.raises(ValueError):
            comparison.candidate_pairs(r, a, ["k"], total=bad)

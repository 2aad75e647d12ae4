"""Quantities in text: the sentences of the survey's sample and one case for each rule, worked out by hand."""

import pytest

from lineagekit.operators import quantities as Q

CASES = [
    ("空調ユニットは、周囲温度0 °Cから50 °Cの環境で正常に運転できること。", [("0 °Cから50 °C", (0, True), (50, True), "degC", 0.95, None)]),
    ("周囲温度50 °Cにおいて、冷房能力12 kW以上を確保すること。", [("12 kW", (12, True), None, "kW", 0.95, "50 °C")]),
    ("定格電源は三相AC 220 V、50 Hzとすること。", [("220 V", (220, True), (220, True), "V", 0.95, None), ("50 Hz", (50, True), (50, True), "Hz", 0.95, None)]),
    ("定格運転時の装置正面1 mにおける騒音値は60 dB(A)以下とすること。", [("60 dB(A)", None, (60, True), "dB(A)", 0.95, None)]),
    ("0 °C～40 °C", [("0 °C～40 °C", (0, True), (40, True), "degC", 0.95, None)]),
    ("0 °C～50 °Cで使用可能", [("0 °C～50 °C", (0, True), (50, True), "degC", 0.95, None)]),
    ("周囲温度40 °Cで10 kW", [("10 kW", (10, True), (10, True), "kW", 0.95, "40 °C")]),
    ("周囲温度50 °Cで12.5 kW", [("12.5 kW", (12.5, True), (12.5, True), "kW", 0.95, "50 °C")]),
    ("三相AC 200 V、50/60 Hz", [("200 V", (200, True), (200, True), "V", 0.95, None), ("50/60 Hz", None, None, "Hz", 0.6, None)]),
    ("三相AC 220 V、50 Hzに対応", [("220 V", (220, True), (220, True), "V", 0.95, None), ("50 Hz", (50, True), (50, True), "Hz", 0.95, None)]),
    ("装置正面1 mで65 dB(A)", [("65 dB(A)", (65, True), (65, True), "dB(A)", 0.95, None)]),
    ("前面600 mm", [("600 mm", (600, True), (600, True), "mm", 0.95, None)]),
    ("前面600 mmを確保", [("600 mm", (600, True), (600, True), "mm", 0.95, None)]),
    ("約1,200.5 mm程度", [("約1,200.5 mm程度", (1200.5, True), (1200.5, True), "mm", 0.6, None)]),
    ("最高１０V未満", [("最高１０V", None, (10, False), "V", 0.6, None)]),
    ("５Ｖを超え10V以下", [("５Ｖを超え10V", (5, False), (10, True), "V", 0.95, None)]),
    ("-5V以上10kPa以下", [("-5V", (-5, True), None, "V", 0.95, None), ("10kPa", None, (10, True), "kPa", 0.95, None)]),
    ("200±0.5 V", [("200±0.5 V", (199.5, True), (200.5, True), "V", 0.6, None)]),
    ("20~10V", [("20~10V", (20, True), (10, True), "V", 0.6, None)]),
    ("3.5mm.次 5V", [("3.5mm", (3.5, True), (3.5, True), "mm", 0.95, None), ("5V", (5, True), (5, True), "V", 0.95, None)]),
    ("1V以上2V以下3V以上4V以下", [("1V以上2V", (1, True), (2, True), "V", 0.95, None), ("3V以上4V", (3, True), (4, True), "V", 0.95, None)]),
    ("1Vで2Vで3V", [("3V", (3, True), (3, True), "V", 0.95, "2V")]),
    ("50Hzで", [("50Hz", (50, True), (50, True), "Hz", 0.95, None)]),
    ("1/2~3V", [("2~3V", (2, True), (3, True), "V", 0.95, None)]),
    ("1234V 12,34V v1.2.3V", [("1234V", (1234, True), (1234, True), "V", 0.95, None), ("34V", (34, True), (34, True), "V", 0.95, None)]),
    ("", []), (None, []), ("数なし。", []), ("5", []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    out = {}
    for r in Q.extract(df, "i", "t").orderBy("id", "start").collect():
        out.setdefault(r["id"], []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sentence(found, i):
    text, want = CASES[i]
    got = found.get(i, [])
    end = lambda e: None if e is None else tuple(e)
    assert [(r["source_text"], end(r["lower"]), end(r["upper"]), r["unit"]["canonical"], r["confidence"], r["condition"] and r["condition"]["source_text"]) for r in got] == want
    assert all(text[r["start"] : r["end"]] == r["source_text"] for r in got)


def test_details(found):
    by_text = {CASES[i][0]: rows for i, rows in found.items()}
    slash = by_text["三相AC 200 V、50/60 Hz"][1]
    assert (slash["kind"], slash["options"], slash["warnings"], slash["tokens"]) == ("alternatives", [50.0, 60.0], [Q.W_SLASH], ["三相", "AC"])
    about = by_text["約1,200.5 mm程度"][0]
    assert ([tuple(q) for q in about["qualifiers"]], about["warnings"], about["normalized_text"]) == ([("approximate", "約")], [Q.W_ABOUT], "約1,200.5 mm程度")
    most = by_text["最高１０V未満"][0]
    assert ([tuple(q) for q in most["qualifiers"]], most["warnings"]) == ([("maximum", "最高")], ["「最高」を片側境界候補として抽出。文脈による確定が必要"])
    assert by_text["200±0.5 V"][0]["warnings"] == ["公差表記(中心値200, 公差±0.5)から区間を算出"]
    assert by_text["20~10V"][0]["warnings"] == [Q.W_REVERSED]
    assert by_text["周囲温度40 °Cで10 kW"][0]["condition"]["confidence"] == 0.7


def test_passes_are_not_written_into_one_filter(spark):
    """Every pass reads a sentence once, and a table of one file is read by several tasks."""
    df = Q.extract(spark.range(1).selectExpr("id", "concat(id, ' V') as text").coalesce(1), "id", "text")
    assert df.rdd.getNumPartitions() > 1
    plan = df._jdf.queryExecution().optimizedPlan()
    filters = [str(line) for line in plan.toString().splitlines() if "Filter " in line]
    assert max(map(len, filters)) < 3000

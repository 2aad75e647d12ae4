"""Quantities in text, by ordered passes over sentences, all in Spark's own expressions.

Each pass marks what its pattern matches in the sentence and blanks it out for the passes after it: ranges with a
wave, ranges in words, tolerances, alternatives with a slash, single values with the words around them. A lower and
an upper bound of one unit that follow each other are one interval; a quantity that is followed by a word for "at"
is the condition of the next one. What is read is kept as it is: a reversed range is reported, not turned.

Places are characters of the original text from 0. Null and empty texts have no quantities. The characters U+0001 to
U+0003 count as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Units with what they are called and measure, words of a context, patterns, confidences and warnings.
UNITS = (
    ("°C", "degC", "temperature"), ("℃", "degC", "temperature"), ("kW", "kW", "power"), ("V", "V", "voltage"), ("Hz", "Hz", "frequency"), ("dB(A)", "dB(A)", "sound_pressure_level"),
    ("mm", "mm", "length"), ("MPa", "MPa", "pressure"), ("kPa", "kPa", "pressure"), ("Pa", "Pa", "pressure"), ("kVA", "kVA", "apparent_power"),
)
UNIT = r"°C|℃|kW|kVA|V|Hz|dB\(A\)|mm|MPa|kPa|Pa"
CONTEXT = ("三相", "単相", "AC", "DC", "交流", "直流", "定格")
NUMBER = r"-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?"
GAP = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*"
FIRST = rf"(?<![\d.])({NUMBER})"
PASSES = {
    "range": rf"{FIRST}{GAP}({UNIT})?{GAP}~{GAP}({NUMBER}){GAP}({UNIT})",
    "words": rf"{FIRST}{GAP}({UNIT}){GAP}から{GAP}({NUMBER}){GAP}({UNIT}){GAP}(?:まで)?",
    "tolerance": rf"{FIRST}{GAP}±{GAP}({NUMBER}){GAP}({UNIT})",
    "alternatives": rf"{FIRST}{GAP}/{GAP}({NUMBER}){GAP}({UNIT})",
    "single": rf"{FIRST}{GAP}({UNIT})",
}
SENTENCE = r"((?<!\d)\.(?!\d)|[。!?！？])"
AFTER = (("以上", "lower", True), ("以下", "upper", True), ("未満", "upper", False), ("を?超え", "lower", False))
SURE, DOUBTFUL, CONDITION = 0.95, 0.6, 0.7
W_UNITS, W_REVERSED, W_SLASH = "範囲前後で単位が食い違う", "下限が上限を超えている(逆転範囲)", "スラッシュの意味(択一/両対応/比率等)は文脈判定が必要"
W_ABOUT, W_NOMINAL = "概数表記のため、境界値は厳密値として扱わない", "「公称」表記のため、実測値・保証値との混同に注意"
W_TOLERANCE, W_ONE_SIDED = ("公差表記(中心値", ", 公差±", ")から区間を算出"), ("「", "」を片側境界候補として抽出。文脈による確定が必要")


def normalized(text: Column) -> Column:
    """Full-width ASCII, minus signs and waves to their plain forms, one character for one."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "−〜\x01\x02\x03"
    return F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94)) + "-~   ")


def marked(text: Column, pattern: str) -> Column:
    """Array of what is outside and inside of the matches of a pattern, in turn."""
    return F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01")


def places(parts: Column) -> Column:
    """Array of struct(s, e, match): the matches among the parts of :func:`marked` and where they are."""
    at = F.transform(parts, lambda x, i: F.struct(F.length(F.array_join(F.slice(parts, 1, i), "")).alias("s"), x.alias("match"), i.alias("i")))
    return F.transform(F.filter(at, lambda x: x["i"] % 2 == 1), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["match"])).alias("e"), x["match"].alias("match")))


def sentences(text: Column) -> Column:
    """Array of struct(sentence, offset); an end mark belongs to its sentence, a point between digits is none."""
    parts = F.filter(F.split(F.regexp_replace(text, SENTENCE, "$1\x01"), "\x01"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(x.alias("sentence"), F.length(F.array_join(F.slice(parts, 1, i), "")).alias("offset")))


def _canonical(source: Column) -> Column:
    """The name by which units are compared."""
    for written, canonical, _ in UNITS:
        if written != canonical:
            source = F.when(source == written, canonical).otherwise(source)
    return source


def unit(source: Column) -> Column:
    """struct(source, canonical, dimension) of a unit as it is written."""
    kinds = F.create_map(*(F.lit(v) for u, _, kind in UNITS for v in (u, kind)))
    return F.struct(source.alias("source"), _canonical(source).alias("canonical"), F.coalesce(kinds[source], F.lit("unknown")).alias("dimension"))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def _plain(value: Column) -> Column:
    """A number as it is written: whole numbers without a fraction."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


FOUND = "array<struct<s:int,e:int,kind:string,low:double,low_in:boolean,high:double,high_in:boolean,options:array<double>,unit:string,warnings:array<string>,qualifiers:array<struct<type:string,source_text:string>>,bound:string>>"


def _found(m: Column, kind: str, unit: Column, warnings: Column, *, low: Column | None = None, low_in: Column | None = None, high: Column | None = None, high_in: Column | None = None, options: Column | None = None, qualifiers: Column | None = None, bound: Column | None = None) -> Column:
    none, yes = F.lit(None), F.lit(True)
    given = {"low": low, "low_in": yes if low_in is None else low_in, "high": high, "high_in": yes if high_in is None else high_in, "options": options}
    return F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(kind).alias("kind"), *((none if v is None else v).alias(n) for n, v in given.items()), unit.alias("unit"), F.array_compact(warnings).alias("warnings"), (F.array() if qualifiers is None else qualifiers).alias("qualifiers"), (none if bound is None else bound).alias("bound"))


def _groups(m: Column, name: str, numbers: tuple[int, ...], texts: tuple[int, ...]) -> Column:
    """struct(s, e, and what the groups of the pass's pattern hold: numbers as a, b, texts as u, v)."""
    group = lambda n: F.regexp_extract(m["match"], f"^{PASSES[name]}$", n)
    return F.struct(m["s"].alias("s"), m["e"].alias("e"), *(_number(group(n)).alias(x) for n, x in zip(numbers, "ab")), *(group(n).alias(x) for n, x in zip(texts, "uv")))


def _around(m: Column) -> Column:
    """The fields of ``m`` with the words before and after a single value, and the span that these take in."""
    norm, words = F.col("norm"), "約|およそ|最大|最小|最高|最低|公称"
    after, before = F.substring(norm, m["e"] + 1, F.lit(8)), F.substring(norm, F.greatest(m["s"] - 8, F.lit(0)) + 1, F.least(m["s"], F.lit(8)))
    lead, tail = F.regexp_extract(before, rf"(?:{words}){GAP}$", 0), F.regexp_extract(after, rf"^{GAP}程度", 0)
    return F.struct((m["s"] - F.length(lead)).alias("s"), (m["e"] + F.length(tail)).alias("e"), m["a"].alias("a"), m["u"].alias("u"), F.regexp_extract(lead, words, 0).alias("word"), (tail != "").alias("about"), F.regexp_extract(after, rf"^{GAP}({'|'.join(p for p, _, _ in AFTER)})", 1).alias("after"))


def _bounded(m: Column) -> Column:
    """The fields with the side that a value bounds (null: none) and whether it belongs to the interval."""
    side, inclusive = F.when(m["word"].isin("最大", "最高"), "upper").when(m["word"].isin("最小", "最低"), "lower"), F.lit(True)
    for pattern, end, closed in AFTER:
        hit = F.endswith(m["after"], F.lit(pattern.rpartition("?")[2]))
        side, inclusive = F.when(hit, end).otherwise(side), F.when(hit, closed).otherwise(inclusive)
    about = m["word"].isin("約", "およそ") | m["about"]
    return F.struct(*(m[n].alias(n) for n in ("s", "e", "a", "u", "word")), about.alias("about"), side.alias("side"), inclusive.alias("closed"))


def _single(m: Column) -> Column:
    word, side = m["word"], m["side"]
    most, least, nominal = word.isin("最大", "最高"), word.isin("最小", "最低"), word == "公称"
    own = lambda end, v: F.when(side.isNull() | (side == end), v)
    qualifier = lambda hit, kind: F.when(hit, F.struct(F.lit(kind).alias("type"), F.coalesce(F.nullif(word, F.lit("")), F.lit("程度")).alias("source_text")))
    qualifiers = F.array_compact(F.array(qualifier(m["about"], "approximate"), qualifier(most, "maximum"), qualifier(least, "minimum"), qualifier(nominal, "nominal")))
    warnings = F.array(F.when(m["about"], W_ABOUT), F.when(most | least, F.concat(F.lit(W_ONE_SIDED[0]), word, F.lit(W_ONE_SIDED[1]))), F.when(nominal, W_NOMINAL))
    return _found(m, "interval", m["u"], warnings, low=own("lower", m["a"]), low_in=m["closed"], high=own("upper", m["a"]), high_in=m["closed"], qualifiers=qualifiers, bound=side)


def _range(m: Column) -> Column:
    differ = F.when((m["u"] != "") & (_canonical(m["u"]) != _canonical(m["v"])), W_UNITS)
    return _found(m, "interval", m["v"], F.array(differ, F.when(m["a"] > m["b"], W_REVERSED)), low=m["a"], high=m["b"])


def _tolerance(m: Column) -> Column:
    a, b, c = map(F.lit, W_TOLERANCE)
    return _found(m, "interval", m["u"], F.array(F.concat(a, _plain(m["a"]), b, _plain(m["b"]), c)), low=m["a"] - m["b"], high=m["a"] + m["b"])


def _read(name: str, matches: Column) -> Column:
    """The quantities of a pass's matches. Each step binds what the next one uses more than once."""
    groups = {"range": ((1, 3), (2, 4)), "words": ((1, 3), (2, 4)), "tolerance": ((1, 2), (3,)), "alternatives": ((1, 2), (3,)), "single": ((1,), (2,))}[name]
    found = F.transform(matches, lambda m: _groups(m, name, *groups))
    if name == "single":
        return F.transform(F.transform(F.transform(found, _around), _bounded), _single)
    if name == "alternatives":
        return F.transform(found, lambda m: _found(m, "alternatives", m["u"], F.array(F.lit(W_SLASH)), options=F.array(m["a"], m["b"])))
    return F.transform(found, _tolerance if name == "tolerance" else _range)


def extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, nth and a row a quantity: start, end, source_text, normalized_text, kind, lower, upper, options, unit,
    qualifiers, tokens (of the context before it), confidence, warnings, condition (null, or the quantity at which it holds)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    # a small file of many rows would be one task: rows are dealt by id, in a number that isn't lowered by their size
    session = df.sparkSession
    rows = rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), "id")
    # the outer forms of explode: of the others Spark makes a filter on the array's size, which it moves below all
    # passes, and so writes them into one expression that grows by a power of their number
    each = rows.select("id", "text", F.posexplode_outer(sentences(F.col("text"))).alias("sentence_no", "x")).select("id", "text", "sentence_no", F.col("x.offset").alias("offset"), normalized(F.col("x.sentence")).alias("norm"))
    each = each.where(F.rlike("norm", F.lit(rf"\d{GAP}(?:{UNIT})"))).withColumn("left", F.col("norm")).withColumn("found", F.array().cast(FOUND))
    for name, pattern in PASSES.items():
        each = each.withColumn("parts", marked(F.col("left"), pattern))
        each = each.withColumn("found", F.concat("found", _read(name, places(F.col("parts"))).cast(FOUND)))
        each = each.withColumn("left", F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit("\x03"), F.length(x))).otherwise(x)), ""))
    # a lower bound takes the upper bound of its unit that follows; neither can be part of two such pairs
    each = each.select("id", "text", "sentence_no", "offset", "norm", F.array_sort("found").alias("q"))
    pairs = "q_.bound = 'lower' and next_.bound = 'upper' and replace(q_.unit, '℃', '°C') = replace(next_.unit, '℃', '°C')"
    at = lambda shift: f"get(q, i_ {shift})"
    whole = f"""transform(q, (x_, i_) -> case
      when coalesce({pairs.replace('q_', at('- 1')).replace('next_', 'x_')}, false) then null
      when coalesce({pairs.replace('q_', 'x_').replace('next_', at('+ 1'))}, false) then named_struct('s', x_.s, 'e', {at('+ 1')}.e, 'kind', x_.kind, 'low', x_.low, 'low_in', x_.low_in, 'high', {at('+ 1')}.high, 'high_in', {at('+ 1')}.high_in, 'options', x_.options, 'unit', x_.unit,
        'warnings', concat(x_.warnings, {at('+ 1')}.warnings), 'qualifiers', concat(x_.qualifiers, {at('+ 1')}.qualifiers), 'bound', cast(null as string))
      else x_ end)"""
    each = each.withColumn("q", F.array_compact(F.expr(whole)))
    # what a word for "at" follows is the condition of the next one
    marks = rf"^{GAP}(?:において|で)"
    each = each.withColumn("at", F.transform("q", lambda x: F.rlike(F.substring(F.col("norm"), x["e"] + 1, F.lit(6)), F.lit(marks))))
    each = each.select("*", F.posexplode_outer("q").alias("i", "x")).where("i is not null")
    is_condition, last = F.get("at", F.col("i")), F.col("i") == F.size("q") - 1
    before = F.when(F.coalesce(F.get("at", F.col("i") - 1), F.lit(False)), F.get("q", F.col("i") - 1))
    kept = each.withColumn("before", before).where(~is_condition | last)
    cut = lambda x: F.substring("text", F.col("offset") + x["s"] + 1, x["e"] - x["s"])
    x, c = F.col("x"), F.col("before")
    end = lambda q, n: F.when(q[n].isNotNull(), F.struct(q[n].alias("value"), q[f"{n}_in"].alias("inclusive")))
    quantity = lambda q: [q["kind"].alias("kind"), end(q, "low").alias("lower"), end(q, "high").alias("upper"), q["options"].alias("options"), unit(q["unit"]).alias("unit")]
    condition = F.when(c.isNotNull(), F.struct((F.col("offset") + c["s"]).alias("start"), (F.col("offset") + c["e"]).alias("end"), cut(c).alias("source_text"), *quantity(c), F.lit(CONDITION).alias("confidence")))
    window = F.substring("norm", F.greatest(x["s"] - 12, F.lit(0)) + 1, F.least(x["s"], F.lit(12)))
    tokens = F.filter(F.array(*map(F.lit, CONTEXT)), lambda t: F.contains(window, t))
    out = kept.select("id", "sentence_no", "i", (F.col("offset") + x["s"]).alias("start"), (F.col("offset") + x["e"]).alias("end"), cut(x).alias("source_text"), F.substring("norm", x["s"] + 1, x["e"] - x["s"]).alias("normalized_text"), *quantity(x), x["qualifiers"].alias("qualifiers"), tokens.alias("tokens"), F.when(F.size(x["warnings"]) > 0, DOUBTFUL).otherwise(SURE).alias("confidence"), x["warnings"].alias("warnings"), condition.alias("condition"))
    return out.drop("sentence_no", "i")

"""What a quantity's text says: concepts, interval semantics, comparison modes. Column expressions.

Rules are data. A candidate is struct(value, confidence, opposed); arrays of candidates are ordered by
confidence, the highest first, then by the order of rules. Null texts count as empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I

# fixed values: concepts with their dimension, keywords and tags
CONCEPTS = (
    ("environment.ambient_operating_temperature", "temperature", ("周囲温度", "使用温度", "運転温度"), ("使用温度",)),
    ("performance.cooling_capacity", "power", ("冷房能力", "冷却能力"), ("冷房能力",)),
    ("power_supply.voltage", "voltage", ("電源電圧", "定格電圧", "電源"), ("電源電圧",)),
    ("power_supply.frequency", "frequency", ("周波数",), ("周波数",)),
    ("acoustics.operating_noise", "sound_pressure_level", ("騒音値", "運転騒音", "騒音"), ("騒音",)),
    ("maintenance.access_space", "length", ("保守作業スペース", "保守スペース", "保守"), ("保守性",)),
)
# fixed values: what a concept gets for its dimension, a keyword and a tag; thresholds
WEIGHTS = {"dimension": 0.4, "keyword": 0.35, "tag": 0.25}
MODE_CONFIDENCE, MARGIN, PROPERTY_CONFIDENCE, UNKNOWN, CEILING, FLOOR = 0.4, 0.2, 0.7, 0.15, 0.99, 0.02
# fixed values: rules (value, weight, keywords, shape); a keyword that begins with "!" must not be negated after it
REQUIREMENT_RULES = (
    ("required_capability_domain", 0.5, "運転できること|使用できること|動作できること|対応できること", None),
    ("required_capability_domain", 0.15, None, "range"),
    ("acceptable_region", 0.45, "確保する(?:こと)?|以下とする(?:こと)?|以上とする(?:こと)?", None),
    ("acceptable_region", 0.3, "とする(?:こと)?|なければならない", "unless_stated"),
    ("acceptable_region", 0.15, None, "end_or_point"),
)
STATED = "確保する|以下とする|以上とする|運転できること|使用できること|動作できること|対応できること"
ACTUAL_RULES = (
    ("achieved_point", 0.3, None, "plain_point"),
    ("achieved_point", 0.05, None, "point_in_result_column"),
    ("achieved_point", 0.4, "!実測|達成値|検討(?:の)?結果|測定した結果|試験(?:の)?結果|検査(?:の)?結果|実績値|成績値", "point"),
    ("capability_domain", 0.55, "!使用可能|対応可能|運転可能", "range"),
    ("capability_domain", 0.1, None, "range"),
    ("capability_domain", 0.4, "!使用可能|対応可能|運転可能", "point"),
    ("outcome_range", 0.6, "±", None),
    ("outcome_range", 0.5, "変動|ばらつき|測定結果|測定値", None),
    ("guaranteed_minimum", 0.55, None, "minimum"),
    ("guaranteed_minimum", 0.1, None, "lower_only"),
    ("guaranteed_maximum", 0.55, None, "maximum"),
    ("guaranteed_maximum", 0.1, None, "upper_only"),
    ("aggregated_representative_value", 0.6, "!代表値|平均値|中央値|最頻値", "point"),
)
CONDITION_RULES = (("test_condition", 0.5, "試験|測定", None),)
NEGATED = "(?:ではな(?:い|く)|ではありません|ではございません|とは言えない)"
OPPOSING, OPPOSING_WEIGHT = "参考値|目安|概算|設定|公称|試験(?!(?:の)?結果)|規格値|基準値|目標値|設計値", 0.4
RESULT_COLUMN, STANDARD_COLUMN = "検討結果", "標準機種情報"
# fixed values: requirement and actual semantics that can be compared, and how
MODES = (
    ("acceptable_region", "achieved_point", "point_in_region"),
    ("required_capability_domain", "capability_domain", "actual_covers_requirement"),
    ("acceptable_region", "outcome_range", "requirement_covers_actual"),
    ("acceptable_region", "guaranteed_minimum", "requirement_covers_actual"),
    ("acceptable_region", "guaranteed_maximum", "requirement_covers_actual"),
)
KNOWN = frozenset(r[0] for r in (*REQUIREMENT_RULES, *ACTUAL_RULES, *CONDITION_RULES)) | {"unknown"}


def _ordered(made: list[Column]) -> Column:
    """Candidates of struct(order, rank, value, confidence, opposed) without nulls, in order."""
    best = F.array_sort(F.array_compact(F.array(*made)))
    return F.transform(best, lambda c: F.struct(c["value"].alias("value"), c["confidence"].alias("confidence"), c["opposed"].alias("opposed")))


def _candidate(rank: int, value: str, confidence: Column, opposed: Column) -> Column:
    return F.struct((-confidence).alias("order"), F.lit(rank).alias("rank"), F.lit(value).alias("value"), confidence.alias("confidence"), opposed.alias("opposed"))


def property_candidates(dimension: Column, text: Column, tags: Column) -> Column:
    """Concepts with a score: of the dimension, a keyword in the text and a tag, in all at most 0.99."""
    text, tags = F.coalesce(text, F.lit("")), F.coalesce(tags, F.array().cast("array<string>"))
    made = []
    for rank, (concept, own, keywords, own_tags) in enumerate(CONCEPTS):
        hits = (F.coalesce(dimension == own, F.lit(False)), functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in keywords)), F.arrays_overlap(tags, F.array(*map(F.lit, own_tags))))
        score = functools.reduce(lambda a, b: a + b, (F.when(F.coalesce(hit, F.lit(False)), w).otherwise(0.0) for hit, w in zip(hits, WEIGHTS.values())))
        made.append(F.when(score > 0, _candidate(rank, concept, F.least(score, F.lit(CEILING)), F.lit(False))))
    return _ordered(made)


def margin(candidates: Column) -> Column:
    """Lead of the first over the second; alone: its own confidence; none: 0."""
    return F.when(F.size(candidates) > 1, F.get(candidates, F.lit(0))["confidence"] - F.get(candidates, F.lit(1))["confidence"]).when(F.size(candidates) == 1, F.get(candidates, F.lit(0))["confidence"]).otherwise(0.0)


def status(candidates: Column, least: float) -> Column:
    """resolved (first is sure enough and leads), ambiguous, unavailable (no candidate)."""
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, "unavailable").when((F.get(candidates, F.lit(0))["confidence"] >= least) & (margin(candidates) >= MARGIN), "resolved").otherwise("ambiguous")


def property_status(candidates: Column) -> Column:
    return status(candidates, PROPERTY_CONFIDENCE)


def condition_status(candidates: Column) -> Column:
    """As :func:`status`; an unknown value at the top resolves nothing."""
    top = F.coalesce(F.get(candidates, F.lit(0))["value"] == "unknown", F.lit(False))
    return F.when((status(candidates, MODE_CONFIDENCE) == "resolved") & top, "ambiguous").otherwise(status(candidates, MODE_CONFIDENCE))


def unnegated(text: Column, keywords: str) -> Column:
    """Whether one of the keywords (alternatives of a pattern) occurs without a negation right after it."""
    return F.rlike(text, F.lit(f"(?:{keywords})(?!{NEGATED})"))


def shapes(x: Column) -> dict[str, Column]:
    """Of an interval column whether it is a point, a two-sided range, or has one end only."""
    low, high = x["lower"].isNotNull(), x["upper"].isNotNull()
    point = I.is_point(x)
    return {"point": point, "range": low & high & ~point & ~I.is_empty(x), "lower_only": low & ~high, "upper_only": ~low & high}


def scored(rules: tuple, text: Column, conditions: dict[str, Column], opposed: Column) -> Column:
    """Candidates of rules whose keywords and shape hold; ``opposed`` texts take 0.4 off each; unknown has 0.15."""
    made, order = [], list(dict.fromkeys(r[0] for r in rules))
    for value in order:
        score, some = F.lit(0.0), F.lit(False)
        for name, weight, keywords, shape in rules:
            if name == value:
                hit = F.lit(True) if keywords is None else unnegated(text, keywords[1:]) if keywords.startswith("!") else F.rlike(text, F.lit(keywords))
                hit = F.coalesce(hit & (F.lit(True) if shape is None else conditions[shape]), F.lit(False))
                score, some = score + F.when(hit, weight).otherwise(0.0), some | hit
        score = F.greatest(F.lit(0.0), F.least(F.lit(CEILING), score - F.when(opposed, OPPOSING_WEIGHT).otherwise(0.0)))
        made.append(F.when(some & (score > FLOOR), _candidate(order.index(value), value, score, opposed)))
    made.append(_candidate(len(order), "unknown", F.lit(UNKNOWN), F.lit(False)))
    return _ordered(made)


def interval_semantics(side: Column, text: Column, x: Column, *, clause: tuple[str, str, str] | None = None, column: Column | None = None, qualifiers: Column | None = None, is_condition: Column | None = None) -> Column:
    """Candidates by side: A is the requirement's, B the actual one's; conditions have rules of their own.

    A text of side B that is no condition is read only as far as the clause of its quantity: ``clause`` names the
    column of the text, that of the quantity's own text and which occurrence of it is meant (SQL). A requirement is
    read whole, for its quantities share a predicate. ``column``: the source column of a B text; ``qualifiers``:
    words such as minimum and maximum.
    """
    qualified = lambda q: F.lit(False) if qualifiers is None else F.coalesce(F.array_contains(qualifiers, q), F.lit(False))
    kind = shapes(x)
    condition = F.lit(False) if is_condition is None else F.coalesce(is_condition, F.lit(False))
    whole = F.coalesce(text, F.lit(""))
    read = whole if clause is None else F.when((side == "B") & ~condition, local_clause(*clause)).otherwise(whole)

    def candidates(text: Column) -> Column:
        more = kind | {
            "end_or_point": kind["lower_only"] | kind["upper_only"] | kind["point"], "unless_stated": ~F.rlike(text, F.lit(STATED)), "plain_point": kind["point"] & ~F.contains(text, F.lit("±")),
            "point_in_result_column": kind["point"] & (F.lit(False) if column is None else F.coalesce(column == RESULT_COLUMN, F.lit(False))), "minimum": qualified("minimum"), "maximum": qualified("maximum"),
        }
        never, opposed = F.lit(False), F.rlike(text, F.lit(OPPOSING))
        return F.when(condition, scored(CONDITION_RULES, text, more, never)).when(side == "A", scored(REQUIREMENT_RULES, text, more, never)).when(side == "B", scored(ACTUAL_RULES, text, more, opposed)).otherwise(scored((), text, more, never))

    # a lambda's variable, so that the clause is cut once
    return F.get(F.transform(F.array(read), candidates), F.lit(0))


def nth_position(text: str, part: str, n: str) -> str:
    """SQL: where the n-th (from 0) occurrence of a text begins, from 1; 0 without one. Occurrences may overlap."""
    return f"aggregate(sequence(0, {n}), 0, (at_, i_) -> if(at_ < 0, -1, coalesce(nullif(locate({part}, {text}, at_ + 1), 0), -1)), at_ -> greatest(at_, 0))"


def local_clause(text: str, part: str, n: str = "0") -> Column:
    """The clause of column ``text`` in which the n-th occurrence of column ``part`` begins.

    Clauses end at 、 。 ， and at commas that aren't between digits. Clauses before it without any digit
    belong to it. Without an occurrence (or a part) the whole text. (Names of lambda variables end with
    an underscore: they would hide columns of their name.)
    """
    clauses = f"split(regexp_replace({text}, '(、|。|，|(?<![0-9]),(?![0-9]))', '$1\u0000'), '\u0000')"
    at = nth_position(text, part, n)
    ends = "transform(c_, (x_, j_) -> aggregate(slice(c_, 1, j_ + 1), 0, (s_, y_) -> s_ + length(y_)))"
    own = f"(array_position(transform({ends}, e_ -> e_ >= {at}), true) - 1)"
    first = f"coalesce(array_max(transform(filter(sequence(0, length({text})), k_ -> k_ < o_ and k_ < size(c_)), k_ -> if(c_[k_] rlike '[0-9]', k_ + 1, 0))), 0)"
    inner = "array_join(slice(c_, cast(f_ as int) + 1, cast(o_ - f_ as int) + 1), '')"
    steps = f"element_at(transform(array({clauses}), c_ -> element_at(transform(array({own}), o_ -> element_at(transform(array({first}), f_ -> {inner}), 1)), 1)), 1)"
    return F.expr(f"case when {text} is null or {part} is null or {part} = '' or {at} = 0 then coalesce({text}, '') else {steps} end")


def mode_candidate(requirement: Column, actual: Column) -> Column:
    """struct(mode, confidence) that the first candidates of both sides allow, else null."""
    r, a = F.get(requirement, F.lit(0)), F.get(actual, F.lit(0))
    mode = functools.reduce(lambda found, rule: found.when((r["value"] == rule[0]) & (a["value"] == rule[1]), rule[2]), MODES[1:], F.when((r["value"] == MODES[0][0]) & (a["value"] == MODES[0][1]), MODES[0][2]))
    return F.when(mode.isNotNull(), F.struct(mode.alias("mode"), F.least(r["confidence"], a["confidence"]).alias("confidence")))


def opposing(candidates: Column) -> Column:
    return F.coalesce(F.get(candidates, F.lit(0))["opposed"], F.lit(False))


def failed_gates(mode: Column, requirement: Column, actual: Column, property_confidence: Column, warnings: Column) -> Column:
    """Which of the six gates of automatic use fail, in order; none: applicable."""
    checks = {
        "mode_confidence": F.coalesce(mode["confidence"] >= MODE_CONFIDENCE, F.lit(False)), "requirement_margin": margin(requirement) >= MARGIN, "actual_margin": margin(actual) >= MARGIN,
        "opposing_evidence": ~opposing(requirement) & ~opposing(actual), "extraction_warnings": F.coalesce(warnings == 0, F.lit(False)), "property_confidence": F.coalesce(property_confidence >= PROPERTY_CONFIDENCE, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def role(side: Column, column: Column, is_condition: Column) -> Column:
    """struct(role, confidence) by side and source column."""
    cases = ((F.coalesce(is_condition, F.lit(False)), "condition", 0.75), (side == "A", "requirement", 0.7), ((side == "B") & (column == STANDARD_COLUMN), "baseline_design", 0.85), ((side == "B") & (column == RESULT_COLUMN), "resolved_design", 0.85), (side == "B", "unknown", 0.3))
    made = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("confidence"))
    return functools.reduce(lambda found, case: found.when(case[0], made(*case[1:])), cases[1:], F.when(cases[0][0], made(*cases[0][1:]))).otherwise(made("unknown", 0.2))


def candidate_problems(candidates: Column, most: int = 64) -> Column:
    """What is wrong with given candidates: too many, repeated or unknown values, confidences out of 0..1."""
    value = F.transform(candidates, lambda c: c["value"])
    checks = (
        ("too_many", F.size(candidates) > most), ("duplicate_value", F.size(F.array_distinct(value)) < F.size(value)),
        ("unknown_value", F.exists(value, lambda v: v.isNull() | ~v.isin(*sorted(KNOWN)))), ("confidence_out_of_range", F.exists(candidates, lambda c: ~F.coalesce(c["confidence"].between(0.0, 1.0), F.lit(False)))),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def top_concept_groups(df: DataFrame, key: str, candidates: str, least: float = 0.5) -> DataFrame:
    """key, concept: rows whose first concept is sure enough, for comparison by group."""
    return df.where(F.get(F.col(candidates), F.lit(0))["confidence"] >= least).select(key, F.get(F.col(candidates), F.lit(0))["value"].alias("concept"))


def occurrence_index(df: DataFrame, record: list[str], text: str, start: str) -> DataFrame:
    """Numbers equal texts of a record from 0 in the order of their position."""
    return df.withColumn("occurrence_index", F.row_number().over(Window.partitionBy(*record, text).orderBy(start)) - 1)

"""Queries on the meaning of quantities: concepts, interval semantics, comparisons, and reviews of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import comparison as C
from ..operators import review as R
from ..operators import semantics as S
from ..session import read, rounded

# texts of both sides by the key of a part; # stands for its size
REQUIREMENTS = ("冷房能力は#kW以上とする。", "周囲温度0〜#℃で運転できること。", "騒音は#dB以下とすること。", "電源電圧#Vとする。", "保守スペースを#mm確保すること。", "周波数は#Hzでなければならない。", "外観は良好であること。")
ACTUALS = ("試験結果#kW", "使用可能温度、0〜#℃", "実測ではない#dB", "参考値、#V", "最小#mm", "検査の結果、#Hz、公称50Hz", "平均値#", "測定値 #±2", "設定#kPa、実測#kPa")
DIMENSIONS = ("power", "temperature", "sound_pressure_level", "voltage", "length", "frequency", "none")


def _pick(items, shift):
    return F.element_at(F.array(*map(F.lit, items)), ((F.col("p_partkey") + shift) % len(items) + 1).cast("int"))


def _sides(spark, sf_dir):
    """p_partkey, r_text, a_text, dimension, requirement, actual: intervals by the key."""
    size, k = F.col("p_size").cast("double"), F.col("p_partkey")
    requirement = I.interval(F.when(k % 7 != 2, F.when(k % 7 == 1, 0.0).otherwise(size)), F.when(k % 7 != 0, size))
    actual = I.interval(F.when(k % 9 != 5, F.when(k % 9 == 1, 0.0).otherwise(size + k % 3 - 1)), F.when(k % 9 != 4, size + k % 3))
    point = I.interval(size + k % 5 - 2, size + k % 5 - 2)
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.replace(_pick(REQUIREMENTS, 0), F.lit("#"), F.col("p_size").cast("string")).alias("r_text"), F.replace(_pick(ACTUALS, 3), F.lit("#"), F.col("p_size").cast("string")).alias("a_text"), F.col("p_size").cast("string").alias("number"),
        _pick(DIMENSIONS, 0).alias("dimension"), requirement.alias("requirement"), F.when(k % 2 == 0, point).otherwise(actual).alias("actual"), F.when(k % 4 == 0, S.RESULT_COLUMN).otherwise(S.STANDARD_COLUMN).alias("column"),
        F.when(k % 5 == 0, F.array(F.lit("minimum"))).when(k % 5 == 1, F.array(F.lit("maximum"))).alias("qualifiers"),
    )


def interval_semantics(spark, sf_dir):
    both = _sides(spark, sf_dir)
    r = S.interval_semantics(F.lit("A"), F.col("r_text"), F.col("requirement"))
    a = S.interval_semantics(F.lit("B"), F.col("a_text"), F.col("actual"), clause=("a_text", "number", "0"), column=F.col("column"), qualifiers=F.col("qualifiers"))
    each = both.select("p_partkey", F.explode(F.array(F.struct(F.lit("A").alias("side"), r.alias("c")), F.struct(F.lit("B").alias("side"), a.alias("c")))).alias("e"))
    c = F.col("e.c")
    return each.select("p_partkey", "e.side", F.get(c, F.lit(0))["value"].alias("top_value"), rounded(F.get(c, F.lit(0))["confidence"]).alias("top_confidence"), F.size(c).alias("candidates"), rounded(S.margin(c)).alias("margin"), S.condition_status(c).alias("status"), S.opposing(c).alias("opposed"))


def local_clause(spark, sf_dir):
    return _sides(spark, sf_dir).select("p_partkey", F.length("a_text").alias("n_text"), S.local_clause("a_text", "number", "cast(p_partkey % 2 as int)").alias("clause"))


def property_concepts(spark, sf_dir):
    both = _sides(spark, sf_dir).withColumn("c", S.property_candidates(F.col("dimension"), F.col("r_text"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("騒音"), F.lit("電源電圧")))))
    c = F.col("c")
    return both.select("p_partkey", F.get(c, F.lit(0))["value"].alias("concept"), rounded(F.get(c, F.lit(0))["confidence"]).alias("confidence"), F.size("c").alias("candidates"), rounded(S.margin(c)).alias("margin"), S.property_status(c).alias("status"))


def _quantity(kind, interval, options):
    return F.struct(kind.alias("kind"), interval.alias("interval"), options.alias("options"))


def _views(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    none = F.lit(None).cast("array<double>")
    requirement = _quantity(F.lit("interval"), I.interval(F.when(n != 3, F.col("l_discount") * 100), F.when(n != 4, F.col("l_tax") * 100 + n), n % 2 == 0, F.lit(True)), none)
    alternatives = F.array(F.col("l_quantity"), F.col("l_tax"))
    actual = _quantity(F.when(n == 7, "alternatives").otherwise("interval"), I.interval(F.col("l_quantity") / 10, F.when(k % 3 == 0, F.col("l_quantity") / 10).otherwise(F.col("l_quantity") / 5)), F.when(n == 7, alternatives).otherwise(none))
    mode = F.element_at(F.array(*map(F.lit, C.MODES)), (k % 3 + 1).cast("int"))
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", requirement.alias("requirement"), actual.alias("actual"), mode.alias("mode"), F.when(n == 6, 0.0).otherwise(F.when(n == 5, 10.0).otherwise(1.0)).alias("factor"), (k % 7 == 0).cast("int").alias("warnings"))
    return C.numeric_comparisons(C.normalized_views(pairs, F.col("factor")))


def numeric_comparison(spark, sf_dir):
    out = _views(spark, sf_dir)
    return out.select("l_orderkey", "l_linenumber", "mode", F.coalesce("reason", F.lit("")).alias("reason"), F.col("comparison.holds").alias("holds"), F.col("comparison.lower.boundary_mismatch").alias("lower_mismatch"), F.col("comparison.upper.boundary_mismatch").alias("upper_mismatch"), rounded(F.col("comparison.lower_delta")).alias("lower_delta"), rounded(F.col("comparison.upper_delta")).alias("upper_delta"))


def automatic_judgements(spark, sf_dir):
    compared = C.auto_applicability(_views(spark, sf_dir), F.col("warnings"), F.lit(0), {"known_mode": F.col("mode").isin(*C.MODES)})
    state, satisfied = I.judgement(F.col("auto_applicable"), F.col("comparison.holds"))
    fine = compared.where("reason is null").select("mode", state.alias("state"), satisfied.alias("satisfied"), F.size("violations").alias("violations"))
    return fine.groupBy("mode", "state", "satisfied").agg(F.count("*").alias("n"), F.sum("violations").alias("violations"))


def comparison_records(spark, sf_dir):
    judged = _views(spark, sf_dir).where("reason is null").select(
        F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("requirement_trace_id"), F.concat(F.lit("A"), F.col("l_returnflag")).alias("actual_trace_id"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("requirement_quantity_id"),
        F.concat(F.lit("量"), (F.col("l_linenumber") % 3).cast("string")).alias("actual_quantity_id"), F.lit("a").alias("matcher_a_id"), F.when(F.col("l_linenumber") == 2, "").otherwise("b").alias("matcher_b_id"),
    )
    out = C.record_set(judged)
    return out.select("comparison_id", "quantity_pair_id", "matcher_b_id", F.array_join("problems", ",").alias("problems"), "satisfaction_review")


def coverage_gap(spark, sf_dir):
    both = _sides(spark, sf_dir)
    none = F.lit(None).cast("array<double>")
    quantity = lambda c: _quantity(F.lit("interval"), F.col(c), none)
    mode = F.when(F.col("p_partkey") % 4 == 1, "actual_covers_requirement").when(F.col("p_partkey") % 4 == 2, "requirement_covers_actual")
    gap = C.coverage_gap(quantity("requirement"), quantity("actual"), F.lit("mm"), F.when(F.col("p_partkey") % 11 == 0, "cm").otherwise("mm"), mode)
    return both.select("p_partkey", gap.alias("g")).select("p_partkey", "g.comparable", F.coalesce("g.reason", F.lit("")).alias("reason"), "g.satisfied", rounded(F.col("g.low_gap")).alias("low_gap"), rounded(F.col("g.high_gap")).alias("high_gap"))


def concept_pairs(spark, sf_dir):
    """Quantities of an order's lines: those of even lines against those of odd ones, by return flag."""
    line = read(spark, sf_dir, "lineitem")
    side = lambda rest: line.where(F.col("l_linenumber") % 2 == rest).select("l_orderkey", F.col("l_linenumber").alias("quantity_id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("concept"))
    out = C.concept_pairs(side(1), side(0), ["l_orderkey"])
    return out.groupBy("l_orderkey", F.coalesce("concept", F.lit("")).alias("concept"), F.coalesce("reason", F.lit("pair")).alias("reason")).agg(F.count("*").alias("n"), F.sum("requirement_quantity_id").alias("requirement_ids"), F.sum("actual_quantity_id").alias("actual_ids"))


def _lines_by_flag(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return [line.where(F.col("l_linenumber") % 2 == rest).select("l_orderkey", F.col("l_linenumber").alias("quantity_id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("concept")) for rest in (1, 0)]


def _counted(out):
    return out.groupBy("l_orderkey", "concept", "side", "reason", "result_complete", "limit_kinds").agg(F.count("*").alias("n"), F.sum("requirement_quantity_id").alias("requirement_ids"), F.sum("actual_quantity_id").alias("actual_ids"), F.sum("pairs").alias("pairs"), F.sum("materialized").alias("materialized"), F.sum("buckets").alias("buckets"), F.sum("unscanned").alias("unscanned"))


def candidate_caps_stop(spark, sf_dir):
    """Candidates of an order's lines under low caps: beyond 200 the scan ends and there are none."""
    return _counted(C.candidate_pairs(*_lines_by_flag(spark, sf_dir), ["l_orderkey"], per_group=2, total=200))


def candidate_caps_open(spark, sf_dir):
    """The same with caps over all that aren't reached: pairs, and groups cut at two of them."""
    return _counted(C.candidate_pairs(*_lines_by_flag(spark, sf_dir), ["l_orderkey"], per_group=2, total=1_000_000_000, potential=1_000_000_000))


def relationship_metadata(spark, sf_dir):
    k = F.col("o_orderkey")
    method = F.element_at(F.array(F.lit("exact"), F.lit("title_candidate"), F.lit(""), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "manual").when(k % 3 == 1, "matching_engine").otherwise("other").alias("source"), method.alias("method"), F.when(k % 5 != 0, F.col("o_totalprice") / 300_000).alias("confidence"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("category"))
    problems = C.relationship_problems(F.col("source"), F.col("method"), F.col("confidence"), F.col("category"), F.lit(None).cast("string"))
    return rows.groupBy("source", F.coalesce("method", F.lit("-")).alias("method"), F.array_join(problems, ",").alias("problems")).agg(F.count("*").alias("n"))


def _review_events(spark, sf_dir):
    e = F.col("event_id")
    action = F.when(e % 997 == 0, "discard_review_session").when(e % 499 == 0, "invalidate_review_session").when(e % 11 < 7, "accept_review_target").when(e % 11 == 7, "reset_review_target").when(e % 11 < 10, "review_satisfaction").otherwise("reset_review_target")
    target = F.when(e % 11 < 8, F.element_at(F.array(*map(F.lit, R.UPSTREAM)), (F.floor(e / 11) % 4 + 1).cast("int"))).when(e % 11 == 10, "satisfaction")
    verdict = F.when(e % 11 < 7, "accept").when(e % 11 == 8, "override_satisfied").when(e % 11 == 9, "override_unsatisfied")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), e.alias("seq"), action.alias("action"), F.concat(F.lit("cmp-v1:"), (F.floor(e / 44) % 2).cast("string")).alias("comparison_id"), target.alias("target"), verdict.alias("verdict"))


def review_state_fold(spark, sf_dir):
    events = _review_events(spark, sf_dir)
    return R.fold(events, events.select("session_id", "comparison_id")).select("session_id", "comparison_id", "target", "status", "verdict", "session_status")


def review_progress(spark, sf_dir):
    events = _review_events(spark, sf_dir)
    return R.review_progress(R.fold(events, events.select("session_id", "comparison_id")))


def stale_reviews(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "unreviewed").otherwise("reviewed").alias("status"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("reviewed_hash"), F.lit("O").alias("current_hash"))
    return R.stale_reviews(rows).groupBy("status", "stale").agg(F.count("*").alias("n"))


def semantic_judgement(spark, sf_dir):
    """From the texts of both sides to a judgement: concept, semantics, mode, comparison, gates."""
    both = _sides(spark, sf_dir)
    r = S.interval_semantics(F.lit("A"), F.col("r_text"), F.col("requirement"))
    a = S.interval_semantics(F.lit("B"), F.col("a_text"), F.col("actual"), clause=("a_text", "number", "0"), column=F.col("column"), qualifiers=F.col("qualifiers"))
    named = both.withColumn("r", r).withColumn("a", a).withColumn("p", S.property_candidates(F.col("dimension"), F.col("r_text"), F.lit(None).cast("array<string>"))).withColumn("m", S.mode_candidate(F.col("r"), F.col("a")))
    none = F.lit(None).cast("array<double>")
    pairs = named.select("p_partkey", _quantity(F.lit("interval"), F.col("requirement"), none).alias("requirement"), _quantity(F.lit("interval"), F.col("actual"), none).alias("actual"), F.col("m.mode").alias("mode"), S.failed_gates(F.col("m"), F.col("r"), F.col("a"), F.get(F.col("p"), F.lit(0))["confidence"], F.lit(0)).alias("failed"))
    out = C.numeric_comparisons(C.normalized_views(pairs, F.lit(1.0)))
    state, satisfied = I.judgement(F.size("failed") == 0, F.col("comparison.holds"))
    return out.select("p_partkey", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("reason", F.lit("")).alias("reason"), F.array_join("failed", ",").alias("failed"), state.alias("state"), satisfied.alias("satisfied"))


QUERIES = {f.__name__: f for f in (interval_semantics, local_clause, property_concepts, numeric_comparison, automatic_judgements, comparison_records, coverage_gap, concept_pairs, candidate_caps_stop, candidate_caps_open, relationship_metadata, review_state_fold, review_progress, stale_reviews, semantic_judgement)}

_LISTS = {name: "[" + ", ".join(f"'{x}'" for x in items) + "]" for name, items in (("r", REQUIREMENTS), ("a", ACTUALS), ("d", DIMENSIONS))}
_SIDES = f"""
s AS (SELECT *, CASE WHEN rl = ru THEN 'point' WHEN rl IS NOT NULL AND ru IS NOT NULL AND rl < ru THEN 'range' WHEN rl IS NOT NULL AND ru IS NULL THEN 'lower' WHEN ru IS NOT NULL AND rl IS NULL THEN 'upper' ELSE '' END AS rk,
             CASE WHEN al = au THEN 'point' WHEN al IS NOT NULL AND au IS NOT NULL AND al < au THEN 'range' WHEN al IS NOT NULL AND au IS NULL THEN 'lower' WHEN au IS NOT NULL AND al IS NULL THEN 'upper' ELSE '' END AS ak
      FROM (SELECT p_partkey AS k, p_size AS n, replace({_LISTS['r']}[(p_partkey % 7 + 1)::INT], '#', p_size::VARCHAR) AS rt, replace({_LISTS['a']}[((p_partkey + 3) % 9 + 1)::INT], '#', p_size::VARCHAR) AS atx,
                   {_LISTS['d']}[(p_partkey % 7 + 1)::INT] AS dim, CASE WHEN p_partkey % 7 = 2 THEN NULL WHEN p_partkey % 7 = 1 THEN 0e0 ELSE p_size::DOUBLE END AS rl, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS ru,
                   CASE WHEN p_partkey % 2 = 0 THEN (p_size + p_partkey % 5 - 2)::DOUBLE WHEN p_partkey % 9 = 5 THEN NULL WHEN p_partkey % 9 = 1 THEN 0e0 ELSE (p_size + p_partkey % 3 - 1)::DOUBLE END AS al,
                   CASE WHEN p_partkey % 2 = 0 THEN (p_size + p_partkey % 5 - 2)::DOUBLE WHEN p_partkey % 9 = 4 THEN NULL ELSE (p_size + p_partkey % 3)::DOUBLE END AS au FROM part))"""
_NEGATED = "(ではな(い|く)|ではありません|ではございません|とは言えない)"
_POSITIVE = "実測|達成値|検討(の)?結果|測定した結果|試験(の)?結果|検査(の)?結果|実績値|成績値"
_RULES = f"""
hit AS (
  SELECT k, 'A' AS side, 1 AS ord, 'required_capability_domain' AS value, 0.5 AS w FROM s WHERE regexp_matches(rt, '運転できること|使用できること|動作できること|対応できること')
  UNION ALL SELECT k, 'A', 1, 'required_capability_domain', 0.15 FROM s WHERE rk = 'range'
  UNION ALL SELECT k, 'A', 2, 'acceptable_region', 0.45 FROM s WHERE regexp_matches(rt, '確保する|以下とする|以上とする')
  UNION ALL SELECT k, 'A', 2, 'acceptable_region', 0.3 FROM s WHERE regexp_matches(rt, 'とする|なければならない') AND NOT regexp_matches(rt, '確保する|以下とする|以上とする|運転できること|使用できること|動作できること|対応できること')
  UNION ALL SELECT k, 'A', 2, 'acceptable_region', 0.15 FROM s WHERE rk IN ('point', 'lower', 'upper')
  UNION ALL SELECT k, 'B', 1, 'achieved_point', 0.3 FROM s WHERE ak = 'point' AND NOT contains(atx, '±')
  UNION ALL SELECT k, 'B', 1, 'achieved_point', 0.05 FROM s WHERE ak = 'point' AND k % 4 = 0
  UNION ALL SELECT k, 'B', 1, 'achieved_point', 0.4 FROM s WHERE ak = 'point' AND regexp_matches(regexp_replace(atx, '({_POSITIVE}){_NEGATED}', '', 'g'), '{_POSITIVE}')
  UNION ALL SELECT k, 'B', 2, 'capability_domain', CASE ak WHEN 'range' THEN 0.55 ELSE 0.4 END FROM s WHERE ak IN ('range', 'point') AND regexp_matches(atx, '使用可能|対応可能|運転可能')
  UNION ALL SELECT k, 'B', 2, 'capability_domain', 0.1 FROM s WHERE ak = 'range'
  UNION ALL SELECT k, 'B', 3, 'outcome_range', 0.6 FROM s WHERE contains(atx, '±')
  UNION ALL SELECT k, 'B', 3, 'outcome_range', 0.5 FROM s WHERE regexp_matches(atx, '変動|ばらつき|測定結果|測定値')
  UNION ALL SELECT k, 'B', 4, 'guaranteed_minimum', 0.55 FROM s WHERE k % 5 = 0
  UNION ALL SELECT k, 'B', 4, 'guaranteed_minimum', 0.1 FROM s WHERE ak = 'lower'
  UNION ALL SELECT k, 'B', 5, 'guaranteed_maximum', 0.55 FROM s WHERE k % 5 = 1
  UNION ALL SELECT k, 'B', 5, 'guaranteed_maximum', 0.1 FROM s WHERE ak = 'upper'
  UNION ALL SELECT k, 'B', 6, 'aggregated_representative_value', 0.6 FROM s WHERE ak = 'point' AND contains(atx, '平均値')),
opp AS (SELECT k, regexp_matches(replace(replace(atx, '試験結果', ''), '試験の結果', ''), '参考値|目安|概算|設定|公称|試験|規格値|基準値|目標値|設計値') AS o FROM s),
cand AS (
  SELECT * FROM (SELECT k, side, ord, value, greatest(0e0, least(0.99e0, sum(w::DOUBLE) - CASE WHEN side = 'B' AND any_value(o) THEN 0.4e0 ELSE 0e0 END)) AS c, side = 'B' AND any_value(o) AS opposed FROM hit JOIN opp USING (k) GROUP BY k, side, ord, value) WHERE c > 0.02
  UNION ALL SELECT k, side, 99, 'unknown', 0.15::DOUBLE, false FROM s, (VALUES ('A'), ('B')) v(side)),
top AS (SELECT k, side, list(value ORDER BY c DESC, ord) AS v, list(c ORDER BY c DESC, ord) AS c, list(opposed ORDER BY c DESC, ord) AS o FROM cand GROUP BY k, side)"""
_PROPERTY = """
words(concept, ord, dim, keyword) AS (VALUES ('environment.ambient_operating_temperature', 1, 'temperature', '周囲温度|使用温度|運転温度'), ('performance.cooling_capacity', 2, 'power', '冷房能力|冷却能力'), ('power_supply.voltage', 3, 'voltage', '電源電圧|定格電圧|電源'),
  ('power_supply.frequency', 4, 'frequency', '周波数'), ('acoustics.operating_noise', 5, 'sound_pressure_level', '騒音値|運転騒音|騒音'), ('maintenance.access_space', 6, 'length', '保守作業スペース|保守スペース|保守')),
prop AS (SELECT k, ord, concept, least(0.99e0, CASE WHEN s.dim = w.dim THEN 0.4e0 ELSE 0e0 END + CASE WHEN regexp_matches(rt, keyword) THEN 0.35e0 ELSE 0e0 END + CASE WHEN {tags} THEN 0.25e0 ELSE 0e0 END) AS c FROM s, words w),
ptop AS (SELECT k, list(concept ORDER BY c DESC, ord) AS v, list(c ORDER BY c DESC, ord) AS c FROM prop WHERE c > 0 GROUP BY k)"""
# the rules of side B see the clause of the quantity only
_CLAUSED = _SIDES.replace("s AS (", "s0 AS (", 1) + """,
c1 AS (SELECT k, atx, string_split(regexp_replace(atx, '(、|。)', '\\1|', 'g'), '|') AS cl, instr(atx, n::VARCHAR) AS pos FROM s0),
c2 AS (SELECT *, list_filter(range(1, len(cl) + 1), lambda i: list_sum(list_transform(cl[1:i], lambda y: length(y))) >= pos)[1] AS own FROM c1),
c3 AS (SELECT k AS ck, CASE WHEN pos = 0 THEN atx ELSE list_aggregate(cl[coalesce(list_max(list_filter(range(1, own), lambda i: regexp_matches(cl[i], '[0-9]'))), 0) + 1:own], 'string_agg', '') END AS clause FROM c2),
s AS (SELECT s0.* REPLACE (clause AS atx) FROM s0 JOIN c3 ON ck = k)"""
_R = "floor({} * 1e6 + 0.5) / 1e6"
_LINES = """
v AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, ['point_in_region', 'actual_covers_requirement', 'requirement_covers_actual'][(l_orderkey % 3 + 1)::INT] AS mode,
             CASE WHEN l_linenumber <> 3 THEN l_discount * 100 END AS rl, CASE WHEN l_linenumber <> 4 THEN l_tax * 100 + l_linenumber END AS ru, l_linenumber % 2 = 0 AS rli,
             l_quantity / 10 * f AS al, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity / 10 ELSE l_quantity / 5 END * f AS au, f, l_orderkey % 7 = 0 AS warned
      FROM (SELECT *, CASE l_linenumber WHEN 6 THEN 0e0 WHEN 5 THEN 10e0 ELSE 1e0 END AS f FROM lineitem)),
r AS (SELECT *, CASE WHEN rl > ru OR (rl = ru AND NOT rli) THEN 'quantity_value_empty' WHEN f <= 0 THEN 'quantity_conversion_plan_invalid' WHEN n = 7 THEN 'quantity_comparison_kind_unsupported' WHEN mode = 'point_in_region' AND al <> au THEN 'point_in_region_actual_not_point' ELSE '' END AS reason FROM v),
c AS (SELECT *, CASE WHEN mode = 'actual_covers_requirement' THEN rl IS NOT NULL AND al <= rl ELSE rl IS NULL OR al > rl OR (al = rl AND rli) END AS low,
             CASE WHEN mode = 'actual_covers_requirement' THEN ru IS NOT NULL AND au >= ru ELSE ru IS NULL OR au <= ru END AS high,
             mode <> 'actual_covers_requirement' AND rl IS NOT NULL AND al = rl AND NOT rli AS lm FROM r)"""
_EVENTS = """
e AS (SELECT user_id AS s, event_id AS i, 'cmp-v1:' || ((event_id // 44) % 2)::VARCHAR AS c, event_id % 11 AS m, ['quantity_extraction', 'property_mapping', 'interval_semantics', 'comparison_mode'][((event_id // 11) % 4 + 1)::INT] AS t,
             event_id % 997 = 0 AS discard, event_id % 997 <> 0 AND event_id % 499 = 0 AS stale FROM events WHERE user_id IS NOT NULL),
ss AS (SELECT s, bool_or(discard) AS ended, min(CASE WHEN stale THEN i END) AS cut FROM e GROUP BY s),
live AS (SELECT e.*, ss.cut FROM e JOIN ss USING (s) WHERE NOT ended AND NOT discard AND NOT stale AND (cut IS NULL OR i < cut)),
sc AS (SELECT DISTINCT e.s, e.c, ss.cut FROM e JOIN ss USING (s) WHERE NOT ended),
tt(t) AS (VALUES ('quantity_extraction'), ('property_mapping'), ('interval_semantics'), ('comparison_mode')),
lastreset AS (SELECT s, c, t, max(i) AS r FROM live WHERE m = 7 GROUP BY s, c, t),
up AS (SELECT sc.s, sc.c, tt.t, min(l.i) AS since FROM sc CROSS JOIN tt LEFT JOIN lastreset x ON x.s = sc.s AND x.c = sc.c AND x.t = tt.t LEFT JOIN live l ON l.s = sc.s AND l.c = sc.c AND l.t = tt.t AND l.m < 7 AND l.i > coalesce(x.r, -1) GROUP BY sc.s, sc.c, tt.t),
el AS (SELECT s, c, count(since) = 4 AS eligible, max(since) AS since FROM up GROUP BY s, c),
sr AS (SELECT el.s, el.c, eligible, since, max(l.i) AS r FROM el LEFT JOIN live l ON l.s = el.s AND l.c = el.c AND l.m = 10 AND l.i > since GROUP BY el.s, el.c, eligible, since),
sat AS (SELECT sr.s, sr.c, any_value(eligible) AS eligible, arg_min(l.m, l.i) AS m FROM sr LEFT JOIN live l ON l.s = sr.s AND l.c = sr.c AND l.m IN (8, 9) AND l.i > greatest(since, coalesce(r, since)) GROUP BY sr.s, sr.c),
f AS (SELECT s, c, t AS target, CASE WHEN since IS NULL THEN 'unreviewed' ELSE 'reviewed' END AS status, CASE WHEN since IS NOT NULL THEN 'accept' END AS verdict FROM up
      UNION ALL SELECT s, c, 'satisfaction', CASE WHEN NOT eligible THEN 'not_eligible' WHEN m IS NULL THEN 'unreviewed' ELSE 'reviewed' END, CASE WHEN eligible THEN CASE m WHEN 8 THEN 'override_satisfied' WHEN 9 THEN 'override_unsatisfied' END END FROM sat)"""
_CAPS = """
WITH o AS (SELECT l_orderkey AS k, l_linenumber AS q, nullif(l_returnflag, 'R') AS c FROM lineitem WHERE l_linenumber % 2 = 1),
e AS (SELECT l_orderkey AS k, l_linenumber AS q, nullif(l_returnflag, 'R') AS c FROM lineitem WHERE l_linenumber % 2 = 0),
b AS (SELECT DISTINCT k FROM o WHERE k IN (SELECT k FROM e)),
g AS (SELECT k, c, r.n * a.n AS pairs FROM (SELECT k, c, count(*) AS n FROM o WHERE c IS NOT NULL GROUP BY 1, 2) r JOIN (SELECT k, c, count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY 1, 2) a USING (k, c)),
t AS (SELECT *, sum(least(pairs, 2)) OVER w AS m, sum(pairs) OVER w AS p FROM g WINDOW w AS (ORDER BY k, c)),
stop AS (SELECT coalesce(min((k, c)), (9223372036854775807, 'z')) AS s FROM t WHERE m > {0} OR p > {1}),
side AS (SELECT *, 'requirement' AS side FROM o UNION ALL SELECT *, 'actual' FROM e),
x AS (SELECT k, NULL AS c, side, CASE side WHEN 'requirement' THEN q END AS rq, CASE side WHEN 'actual' THEN q END AS aq, 'property_unresolved' AS reason, NULL::BIGINT AS pairs FROM side, stop WHERE c IS NULL AND k IN (SELECT k FROM b) AND k <= s[1]
  UNION ALL SELECT k, c, side, CASE side WHEN 'requirement' THEN q END, CASE side WHEN 'actual' THEN q END, 'concept_mismatch', NULL FROM side, stop WHERE c IS NOT NULL AND k IN (SELECT k FROM b) AND (k, c) < s AND NOT EXISTS (SELECT 1 FROM g WHERE g.k = side.k AND g.c = side.c)"""
ORACLE_SQL = {
    "candidate_caps_stop": _CAPS.format(200, 2_000_000) + """
  UNION ALL SELECT k, c, NULL, NULL, NULL, 'candidate_limit_would_exceed', pairs FROM g, stop WHERE pairs > 2 AND (k, c) <= s)
SELECT k AS l_orderkey, c AS concept, side, reason, false AS result_complete, NULL::VARCHAR AS limit_kinds, count(*) AS n, sum(rq)::BIGINT AS requirement_ids, sum(aq)::BIGINT AS actual_ids, sum(pairs)::BIGINT AS pairs, NULL::BIGINT AS materialized, NULL::BIGINT AS buckets, NULL::BIGINT AS unscanned FROM x GROUP BY 1, 2, 3, 4
UNION ALL SELECT NULL, NULL, NULL, 'total_candidate_limit_exceeded', false, CASE WHEN p > 2000000 THEN 'materialized,potential' ELSE 'materialized' END, 1, NULL, NULL, p::BIGINT, m::BIGINT, (SELECT count(*) FROM b WHERE k <= s[1]), (SELECT count(*) FROM b WHERE k > s[1]) FROM t, stop WHERE (k, c) = s""",
    "candidate_caps_open": _CAPS.format(10**9, 10**9) + """
  UNION ALL SELECT k, c, NULL, NULL, NULL, 'candidate_limit_exceeded', pairs - 2 FROM g WHERE pairs > 2
  UNION ALL SELECT k, c, NULL, rq, aq, NULL, NULL FROM (SELECT o.k, o.c, o.q AS rq, e.q AS aq, row_number() OVER (PARTITION BY o.k, o.c ORDER BY o.q, e.q) AS n FROM o JOIN e ON o.k = e.k AND o.c = e.c) WHERE n <= 2)
SELECT k AS l_orderkey, c AS concept, side, reason, (SELECT count(*) FROM g WHERE pairs > 2) = 0 AS result_complete, NULL::VARCHAR AS limit_kinds, count(*) AS n, sum(rq)::BIGINT AS requirement_ids, sum(aq)::BIGINT AS actual_ids, sum(pairs)::BIGINT AS pairs, NULL::BIGINT AS materialized, NULL::BIGINT AS buckets, NULL::BIGINT AS unscanned FROM x GROUP BY 1, 2, 3, 4""",
    "interval_semantics": f"""
WITH {_CLAUSED}, {_RULES}
SELECT k AS p_partkey, side, v[1] AS top_value, {_R.format('c[1]')} AS top_confidence, len(v)::INT AS candidates, {_R.format('CASE WHEN len(c) > 1 THEN c[1] - c[2] ELSE c[1] END')} AS margin,
       CASE WHEN c[1] >= 0.4e0 AND (CASE WHEN len(c) > 1 THEN c[1] - c[2] ELSE c[1] END) >= 0.2e0 AND v[1] <> 'unknown' THEN 'resolved' ELSE 'ambiguous' END AS status, o[1] AS opposed FROM top""",
    "local_clause": f"""
WITH {_SIDES},
p AS (SELECT k, atx, n::VARCHAR AS x, string_split(regexp_replace(atx, '(、|。)', '\\1|', 'g'), '|') AS cl, CASE k % 2 WHEN 0 THEN instr(atx, n::VARCHAR) ELSE CASE WHEN instr(substr(atx, instr(atx, n::VARCHAR) + 1), n::VARCHAR) > 0 THEN instr(atx, n::VARCHAR) + instr(substr(atx, instr(atx, n::VARCHAR) + 1), n::VARCHAR) ELSE 0 END END AS pos FROM s),
q AS (SELECT *, list_filter(range(1, len(cl) + 1), lambda i: list_sum(list_transform(cl[1:i], lambda y: length(y))) >= pos)[1] AS own FROM p),
z AS (SELECT *, coalesce(list_max(list_filter(range(1, own), lambda i: regexp_matches(cl[i], '[0-9]'))), 0) AS before FROM q)
SELECT k AS p_partkey, length(atx)::INT AS n_text, CASE WHEN pos = 0 THEN atx ELSE list_aggregate(cl[before + 1:own], 'string_agg', '') END AS clause FROM z""",
    "property_concepts": f"""
WITH {_SIDES}, {_PROPERTY.replace('{tags}', "k % 3 = 0 AND concept IN ('power_supply.voltage', 'acoustics.operating_noise')")}
SELECT s.k AS p_partkey, v[1] AS concept, {_R.format('c[1]')} AS confidence, coalesce(len(v), 0)::INT AS candidates, {_R.format('coalesce(CASE WHEN len(c) > 1 THEN c[1] - c[2] ELSE c[1] END, 0)')} AS margin,
       CASE WHEN v IS NULL THEN 'unavailable' WHEN c[1] >= 0.7e0 AND (CASE WHEN len(c) > 1 THEN c[1] - c[2] ELSE c[1] END) >= 0.2e0 THEN 'resolved' ELSE 'ambiguous' END AS status FROM s LEFT JOIN ptop USING (k)""",
    "numeric_comparison": f"""
WITH {_LINES}
SELECT k AS l_orderkey, n AS l_linenumber, mode, reason, CASE WHEN reason = '' THEN low AND high END AS holds, CASE WHEN reason = '' THEN lm END AS lower_mismatch, CASE WHEN reason = '' THEN false END AS upper_mismatch,
       CASE WHEN reason = '' THEN {_R.format('(al - rl)')} END AS lower_delta, CASE WHEN reason = '' THEN {_R.format('(ru - au)')} END AS upper_delta FROM c""",
    "automatic_judgements": f"""
WITH {_LINES}
SELECT mode, CASE WHEN warned THEN 'needs_confirmation' WHEN low AND high THEN 'satisfied' ELSE 'not_satisfied' END AS state, CASE WHEN NOT warned THEN low AND high END AS satisfied, count(*) AS n, 0::BIGINT AS violations FROM c WHERE reason = '' GROUP BY 1, 2, 3""",
    "comparison_records": f"""
WITH {_LINES},
x AS (SELECT 'R' || k::VARCHAR AS rt, 'A' || flag AS atx, 'q' || k::VARCHAR || '::量' || (n % 3)::VARCHAR AS pair, CASE WHEN n = 2 THEN '' ELSE 'b' END AS b FROM c WHERE reason = ''),
y AS (SELECT *, 'cmp-v1:' || strlen(rt)::VARCHAR || ':' || rt || ',' || strlen(atx)::VARCHAR || ':' || atx || ',' || strlen(pair)::VARCHAR || ':' || pair || ',' AS id FROM x)
SELECT id AS comparison_id, pair AS quantity_pair_id, b AS matcher_b_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY pair) > 1 THEN 'quantity_pair_id_duplicate' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'comparison_id_duplicate' END, CASE WHEN b = '' THEN 'matcher_b_id_missing' END) AS problems, 'not_eligible' AS satisfaction_review FROM y""",
    "coverage_gap": f"""
WITH {_SIDES},
g AS (SELECT *, CASE WHEN k % 4 = 1 THEN 'a' WHEN k % 4 = 2 THEN 'r' WHEN ak = 'point' THEN 'p' END AS m FROM s),
h AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'unit_mismatch' WHEN rl > ru OR al > au THEN 'empty_interval' WHEN m IS NULL THEN 'mode_unknown' ELSE '' END AS reason,
             CASE m WHEN 'a' THEN (al IS NULL OR (rl IS NOT NULL AND al <= rl)) AND (au IS NULL OR (ru IS NOT NULL AND au >= ru)) ELSE (rl IS NULL OR (al IS NOT NULL AND al >= rl)) AND (ru IS NULL OR (au IS NOT NULL AND au <= ru)) END AS ok FROM g)
SELECT k AS p_partkey, reason = '' AS comparable, reason, CASE WHEN reason = '' THEN ok END AS satisfied, CASE WHEN reason = '' THEN {_R.format('(al - rl)')} END AS low_gap, CASE WHEN reason = '' THEN {_R.format('(ru - au)')} END AS high_gap FROM h""",
    "concept_pairs": """
WITH o AS (SELECT l_orderkey AS k, l_linenumber AS q, nullif(l_returnflag, 'R') AS c FROM lineitem WHERE l_linenumber % 2 = 1),
e AS (SELECT l_orderkey AS k, l_linenumber AS q, nullif(l_returnflag, 'R') AS c FROM lineitem WHERE l_linenumber % 2 = 0),
b AS (SELECT coalesce(o.k, e.k) AS k, coalesce(o.c, e.c) AS c, o.q AS x, e.q AS y, CASE WHEN o.q IS NULL OR e.q IS NULL THEN 'concept_mismatch' ELSE 'pair' END AS reason FROM (SELECT * FROM o WHERE c IS NOT NULL) o FULL JOIN (SELECT * FROM e WHERE c IS NOT NULL) e ON o.k = e.k AND o.c = e.c
      UNION ALL SELECT k, '', q, NULL, 'property_unresolved' FROM o WHERE c IS NULL UNION ALL SELECT k, '', NULL, q, 'property_unresolved' FROM e WHERE c IS NULL),
r AS (SELECT k, c, x, y, CASE WHEN reason = 'pair' AND row_number() OVER (PARTITION BY k, c, reason ORDER BY x, y) > 50 THEN 'candidate_limit_exceeded' ELSE reason END AS reason FROM b)
SELECT k AS l_orderkey, c AS concept, reason, count(*) AS n, sum(x)::BIGINT AS requirement_ids, sum(y)::BIGINT AS actual_ids FROM r GROUP BY 1, 2, 3""",
    "relationship_metadata": """
WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'matching_engine' ELSE 'other' END AS source, ['exact', 'title_candidate', '', NULL][(o_orderkey % 4 + 1)::INT] AS method, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 300000 END AS confidence, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS category FROM orders)
SELECT source, coalesce(method, '-') AS method, concat_ws(',', CASE WHEN source = 'other' THEN 'source_invalid' END, CASE WHEN method = '' THEN 'match_method_invalid' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'match_confidence_invalid' END,
       CASE WHEN source = 'matching_engine' AND method IS NULL THEN 'match_method_missing' END, CASE WHEN source = 'matching_engine' AND method = 'title_candidate' AND confidence IS NOT NULL THEN 'match_confidence_must_be_null_for_title_candidate' END,
       CASE WHEN source = 'matching_engine' AND coalesce(method, '') <> 'title_candidate' AND confidence IS NULL THEN 'match_confidence_missing' END, CASE WHEN source = 'matching_engine' AND category IS NULL THEN 'review_category_missing' END) AS problems, count(*) AS n FROM t GROUP BY 1, 2, 3""",
    "review_state_fold": f"""
WITH {_EVENTS}
SELECT f.s AS session_id, f.c AS comparison_id, target, status, verdict, CASE WHEN sc.cut IS NULL THEN 'active' ELSE 'stale' END AS session_status FROM f JOIN sc ON f.s = sc.s AND f.c = sc.c""",
    "review_progress": f"""
WITH {_EVENTS}
SELECT f.s AS session_id, f.c AS comparison_id, any_value(sc.cut) IS NULL AND count(*) FILTER (target <> 'satisfaction' AND status = 'reviewed') = 4 AS eligible, bool_and(status = 'reviewed') AS all_reviewed FROM f JOIN sc ON f.s = sc.s AND f.c = sc.c GROUP BY 1, 2""",
    "stale_reviews": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unreviewed' ELSE 'reviewed' END AS status, o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderstatus <> 'O') AS stale, count(*) AS n FROM orders GROUP BY 1, 2""",
    "semantic_judgement": f"""
WITH {_CLAUSED}, {_RULES}, {_PROPERTY.replace('{tags}', 'false')},
j AS (SELECT s.*, a.v AS av, a.c AS ac, a.o AS ao, r.v AS rv, r.c AS rc, p.c AS pc,
             CASE WHEN r.v[1] = 'acceptable_region' AND a.v[1] = 'achieved_point' THEN 'point_in_region' WHEN r.v[1] = 'required_capability_domain' AND a.v[1] = 'capability_domain' THEN 'actual_covers_requirement' WHEN r.v[1] = 'acceptable_region' AND a.v[1] IN ('outcome_range', 'guaranteed_minimum', 'guaranteed_maximum') THEN 'requirement_covers_actual' END AS mode
      FROM s JOIN top r ON r.k = s.k AND r.side = 'A' JOIN top a ON a.k = s.k AND a.side = 'B' LEFT JOIN ptop p ON p.k = s.k),
m AS (SELECT *, CASE WHEN (rl IS NULL AND ru IS NULL) OR rl > ru OR (al IS NULL AND au IS NULL) OR al > au THEN 'quantity_value_empty' WHEN mode IS NULL THEN 'numeric_comparison_mode_unsupported' WHEN mode = 'point_in_region' AND ak <> 'point' THEN 'point_in_region_actual_not_point' ELSE '' END AS reason,
             CASE WHEN mode = 'actual_covers_requirement' THEN (al IS NULL OR (rl IS NOT NULL AND al <= rl)) AND (au IS NULL OR (ru IS NOT NULL AND au >= ru)) ELSE (rl IS NULL OR (al IS NOT NULL AND al >= rl)) AND (ru IS NULL OR (au IS NOT NULL AND au <= ru)) END AS ok,
             concat_ws(',', CASE WHEN mode IS NULL OR least(rc[1], ac[1]) < 0.4e0 THEN 'mode_confidence' END, CASE WHEN (CASE WHEN len(rc) > 1 THEN rc[1] - rc[2] ELSE rc[1] END) < 0.2e0 THEN 'requirement_margin' END, CASE WHEN (CASE WHEN len(ac) > 1 THEN ac[1] - ac[2] ELSE ac[1] END) < 0.2e0 THEN 'actual_margin' END,
                       CASE WHEN ao[1] THEN 'opposing_evidence' END, CASE WHEN coalesce(pc[1], 0) < 0.7e0 THEN 'property_confidence' END) AS failed FROM j)
SELECT k AS p_partkey, coalesce(mode, '') AS mode, reason, failed, CASE WHEN failed <> '' OR reason <> '' THEN 'needs_confirmation' WHEN ok THEN 'satisfied' ELSE 'not_satisfied' END AS state, CASE WHEN failed = '' AND reason = '' THEN ok END AS satisfied FROM m""",
}

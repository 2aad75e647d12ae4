"""Queries on quantities: intervals, units, comparison candidates and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import judge
from ..session import read, rounded, values

# fixed values: units with their dimension and, for pressure, their scale
UNITS = [("Pa", "pressure", 1.0), ("kPa", "pressure", 1e3), ("MPa", "pressure", 1e6), ("V", "voltage", None)]
# fixed values: requirement and actual semantics with the comparison mode they allow
MODES = [("A", "F", "requirement_covers_actual"), ("N", "O", "requirement_covers_actual"), ("R", "F", "actual_covers_requirement"), ("N", "P", "point_in_region"), ("A", "P", "point_in_region")]
CONCEPTS = [("length", "large", 0.4), ("length", "long", 0.35), ("finish", "polished", 0.4), ("finish", "burnished", 0.35), ("material", "steel", 0.75), ("material", "brass", 0.4)]


def interval_coverage_judgement(spark, sf_dir):
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    shipped = line.groupBy("l_partkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    both = part.join(shipped, part["p_partkey"] == shipped["l_partkey"], "left").select(
        "p_partkey", I.interval(F.col("p_size"), F.lit(None)).alias("requirement"), I.interval(F.col("lo"), F.col("hi")).alias("actual"), F.col("lo").isNotNull().alias("known")
    )
    out = judge.judged(both, "requirement", "actual", F.col("known"))
    return out.select("p_partkey", F.col("requirement.lower").alias("required"), F.col("actual.lower").alias("lowest"), F.col("actual.upper").alias("highest"), "relation_holds", "lower_mismatch", rounded(F.col("lower_delta")).alias("lower_delta"), "state", "satisfied")


def point_in_region(spark, sf_dir):
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    price = line.where("l_quantity > 0").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("point"))
    band = I.interval(F.col("p_retailprice") * 0.75, F.col("p_retailprice") * 1.25, True, False)
    joined = part.join(price, part["p_partkey"] == price["l_partkey"]).select("p_partkey", band.alias("region"), "point")
    return joined.select("p_partkey", rounded(F.col("point"), 3).alias("point"), I.contains_point(F.col("region"), rounded(F.col("point"), 3)).alias("inside"))


def unit_conversion_plan(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    units = values(spark, UNITS, "unit string, dimension string, scale double")
    unit = lambda shift: F.element_at(F.array(*[F.lit(u[0]) for u in UNITS]), ((F.col("p_partkey") + shift) % 4 + 1).cast("int"))
    named = part.select("p_partkey", F.col("p_size").cast("double").alias("size"), unit(0).alias("r_unit"), unit(F.floor(F.col("p_partkey") / 4)).alias("a_unit"))
    side = lambda p: F.broadcast(units.select(F.col("unit").alias(f"{p}_unit"), F.col("dimension").alias(f"{p}_dim"), F.col("scale").alias(f"{p}_scale")))
    wide = named.join(side("r"), "r_unit").join(side("a"), "a_unit")
    kind = I.conversion_kind(F.col("r_dim"), F.col("a_dim"), F.col("r_unit"), F.col("a_unit"), F.col("r_scale"), F.col("a_scale"))
    factor = F.when(kind == "identity", 1.0).when(kind == "linear", F.col("a_scale") / F.col("r_scale"))
    return wide.select("p_partkey", "r_unit", "a_unit", kind.alias("kind"), factor.alias("factor"), rounded(I.converted(F.col("size"), factor)["value"]).alias("converted"))


def quantity_structure_reasons(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    x = I.interval(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") % 2 == 0, F.lit(True))
    reason = I.structure_reason(F.lit("interval"), x)
    return line.groupBy("l_returnflag", F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count(F.when(I.is_point(x), 1)).alias("points"))


def dimension_buckets(spark, sf_dir):
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    relations = orders.select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderkey").alias("actual_id"))
    actual = line.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("dimension"), F.col("l_linenumber").alias("quantity_id"))
    customer = read(spark, sf_dir, "customer")
    requirement = customer.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("dimension"), F.lit(1).alias("quantity_id"))
    return judge.dimension_buckets(relations, requirement, actual)


def comparison_pairs_capped(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    pairs = line.select("l_returnflag", "l_linestatus", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return judge.capped_pairs(pairs, ["l_suppkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_quantity"], 50)


def comparison_mode_lookup(spark, sf_dir):
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    modes = values(spark, MODES, "requirement_semantics string, actual_semantics string, mode string")
    pairs = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_returnflag", "o_orderstatus")
    out = judge.with_mode(pairs, modes, "l_returnflag", "o_orderstatus")
    return out.groupBy("l_returnflag", "o_orderstatus", F.coalesce("mode", F.lit("unavailable")).alias("mode")).agg(F.count("*").alias("n"))


def property_candidates_topmargin(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    concepts = values(spark, CONCEPTS, "concept string, keyword string, weight double")
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    hits = part.select("p_partkey", text.alias("text")).join(F.broadcast(concepts), F.expr("contains(text, keyword)"))
    scores = hits.groupBy("p_partkey", "concept").agg(F.least(F.sum("weight"), F.lit(0.99)).alias("score"))
    out = judge.resolved(judge.top_and_margin(scores, ["p_partkey"], "concept", "score"), 0.7, 0.2)
    return out.select("p_partkey", "top_value", rounded(F.col("top_score")).alias("top_score"), rounded(F.col("margin")).alias("margin"), "status")


QUERIES = {f.__name__: f for f in (interval_coverage_judgement, point_in_region, unit_conversion_plan, quantity_structure_reasons, dimension_buckets, comparison_pairs_capped, comparison_mode_lookup, property_candidates_topmargin)}
ORACLE_SQL = {
    "interval_coverage_judgement": """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS required, lo AS lowest, hi AS highest, lo >= p_size AS relation_holds,
       CASE WHEN lo IS NOT NULL THEN false END AS lower_mismatch, floor((lo - p_size) * 1e6 + 0.5) / 1e6 AS lower_delta,
       CASE WHEN lo IS NULL THEN 'needs_confirmation' WHEN lo >= p_size THEN 'satisfied' ELSE 'not_satisfied' END AS state,
       lo >= p_size AS satisfied
FROM part LEFT JOIN (SELECT l_partkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
    "point_in_region": """
WITH t AS (SELECT l_partkey, floor(avg(l_extendedprice / l_quantity) * 1000 + 0.5) / 1000 AS point FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
SELECT p_partkey, point, point >= p_retailprice * 0.75 AND point < p_retailprice * 1.25 AS inside FROM part JOIN t ON p_partkey = l_partkey""",
    "unit_conversion_plan": """
WITH u(i, unit, dim, scale) AS (VALUES (0, 'Pa', 'pressure', 1e0), (1, 'kPa', 'pressure', 1e3), (2, 'MPa', 'pressure', 1e6), (3, 'V', 'voltage', NULL)),
t AS (SELECT p_partkey, p_size, r.unit AS r_unit, a.unit AS a_unit, r.dim AS rd, a.dim AS ad, r.scale AS rs, a.scale AS sa
      FROM part JOIN u r ON r.i = p_partkey % 4 JOIN u a ON a.i = (p_partkey + p_partkey // 4) % 4),
k AS (SELECT *, CASE WHEN rd <> ad THEN 'inconsistent' WHEN r_unit = a_unit THEN 'identity' WHEN rs IS NOT NULL AND sa IS NOT NULL THEN 'linear' ELSE 'unsupported' END AS kind FROM t)
SELECT p_partkey, r_unit, a_unit, kind, f AS factor, floor(p_size * f * 1e6 + 0.5) / 1e6 AS converted
FROM (SELECT *, CASE kind WHEN 'identity' THEN 1e0 WHEN 'linear' THEN sa / rs END AS f FROM k)""",
    "quantity_structure_reasons": """
SELECT l_returnflag, CASE WHEN l_discount > l_tax OR (l_discount = l_tax AND l_linenumber % 2 <> 0) THEN 'empty_interval' ELSE 'ok' END AS reason,
       count(*) AS n, count(*) FILTER (l_discount = l_tax AND l_linenumber % 2 = 0) AS points
FROM lineitem GROUP BY 1, 2""",
    "dimension_buckets": """
WITH once AS (SELECT o_custkey, o_orderkey FROM orders GROUP BY ALL HAVING count(*) = 1)
SELECT o_custkey AS requirement_id, o_orderkey AS actual_id, l_returnflag AS dimension, CAST(1 AS BIGINT) AS requirement_quantities, count(*) AS actual_quantities
FROM once JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2, 3""",
    "comparison_pairs_capped": """
SELECT l_returnflag, l_linestatus, l_suppkey, l_orderkey, l_linenumber, l_quantity, CAST(rn AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn <= 50""",
    "comparison_mode_lookup": """
WITH m(r, a, mode) AS (VALUES ('A','F','requirement_covers_actual'), ('N','O','requirement_covers_actual'), ('R','F','actual_covers_requirement'), ('N','P','point_in_region'), ('A','P','point_in_region'))
SELECT l_returnflag, o_orderstatus, coalesce(mode, 'unavailable') AS mode, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN m ON r = l_returnflag AND a = o_orderstatus GROUP BY 1, 2, 3""",
    "property_candidates_topmargin": """
WITH c(concept, keyword, weight) AS (VALUES ('length','large',0.4::DOUBLE), ('length','long',0.35::DOUBLE), ('finish','polished',0.4::DOUBLE), ('finish','burnished',0.35::DOUBLE), ('material','steel',0.75::DOUBLE), ('material','brass',0.4::DOUBLE)),
s AS (SELECT p_partkey, concept, least(sum(weight), 0.99::DOUBLE) AS score FROM part JOIN c ON contains(lower(p_name || ' ' || p_type), keyword) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, concept)),
t AS (SELECT p_partkey, concept, score, coalesce(score - nxt, score) AS margin FROM r WHERE rn = 1)
SELECT p_partkey, concept AS top_value, floor(score * 1e6 + 0.5) / 1e6 AS top_score, floor(margin * 1e6 + 0.5) / 1e6 AS margin,
       CASE WHEN score >= 0.7 AND margin >= 0.2 THEN 'resolved' ELSE 'needs_review' END AS status FROM t""",
}

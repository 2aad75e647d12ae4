"""Queries on pages and records: headings, lines, paragraphs, nearby text, eligibility, saved entries and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..session import read, values
from ..sources import strict_json as J

HEADINGS = ("第#章 概要", "#.2 surface", "第二節", "# note", "plain #", "#．１　全角", "3.")
RULES = [("chapter", 1, 10, "^[A-Z][a-z]+ed ", 80), ("section", 2, 20, "^large ", 40), ("note", 3, 20, "steel$", 25), ("any", 9, 1, ".", 200)]


def heading_lines(spark, sf_dir):
    """Lines made of parts' names under one of several markers."""
    k = F.col("p_partkey")
    marker = F.replace(F.element_at(F.array(*map(F.lit, HEADINGS)), (k % 7 + 1).cast("int")), F.lit("#"), (k % 20).cast("string"))
    line = F.concat(marker, F.when(k % 5 == 0, F.repeat(F.col("p_name"), 3)).when(k % 5 == 1, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.lit("")))
    out = read(spark, sf_dir, "part").select("p_partkey", R.heading(line).alias("h"))
    return out.select("p_partkey", F.col("h.confidence").alias("confidence"), F.col("h.title").alias("title"))


def profile_headings(spark, sf_dir):
    lines = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.ruled_heading(lines, values(spark, RULES, "kind string, level int, priority int, pattern string, max_title_length int"), "p_partkey", "p_name")


def layout_lines(spark, sf_dir):
    """An order's lines as text items on a page: places by number, heights by return flag."""
    n = F.col("l_linenumber")
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_suppkey").alias("s")).select(
        F.col("l_orderkey").alias("page"), ((n * 5) % 8).alias("n"), ((n % 3) * 30 + F.col("s") % 7).cast("double").alias("x"), (100 - F.floor(n / 2) * 4 - F.col("s") % 3).cast("double").alias("y"), F.lit(9.0).alias("w"), F.when(F.col("f") == "R", 10.0).otherwise(4.0).alias("h"), F.concat("f", n.cast("string"), F.lit(" ")).alias("str")
    )
    return R.lines_of(items, "page", "n").select("page", "line", "y", "text", "segments", "left", "right", "bottom", "top")


def paragraph_merge(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")).select(k.alias("page"), n, (F.when(F.col("s") % 5 == 0, 0.2).otherwise(0.1)).alias("left"), (n * 0.05).alias("top"), (n * 0.05 + F.when(F.col("s") % 3 == 0, 0.02).otherwise(0.04)).alias("bottom"), n.cast("string").alias("text"))
    return R.paragraphs(lines, ["page"], "l_linenumber")


def nearby_texts(spark, sf_dir):
    k = F.col("p_partkey")
    record = F.create_map(F.lit("name"), F.col("p_name"), F.lit("part_id"), k.cast("string"), F.lit("No"), F.lit("1"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), F.lit("tags"), F.lit("t"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, F.col("p_type")).alias("raw"), record.alias("record"))
    return rows.select("p_partkey", R.nearby_text(F.col("raw"), F.col("record"), F.array(F.lit("size"))).alias("nearby"), R.labelled_text(F.col("record")).alias("labelled"))


def canonical_projections(spark, sf_dir):
    """Customers' fields with roles: name and segment both may be the title, the balance has none."""
    k = F.col("c_custkey")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("field"), v.cast("string").alias("value"), r.cast("string").alias("role"), c.alias("classification")) for i, (f, v, r, c) in enumerate((
        ("c_mktsegment", F.col("c_mktsegment"), F.when(k % 3 != 0, "title"), F.when(k % 3 == 0, "UNCLASSIFIED").otherwise("MATCH_ELIGIBLE")), ("c_name", F.col("c_name"), F.lit("title"), F.lit("MATCH_ELIGIBLE_WITH_CAUTION")),
        ("c_nationkey", F.col("c_nationkey"), F.lit("code"), F.when(k % 2 == 0, "TECHNICAL").otherwise("MATCH_ELIGIBLE")), ("_hidden", F.lit("x"), F.lit("code"), F.lit("MATCH_ELIGIBLE")), ("c_acctbal", F.lit("b"), F.lit(None), F.lit("UNCLASSIFIED")),
    ))])).alias("f")
    out = R.canonical_projection(read(spark, sf_dir, "customer").select(k.alias("id"), each).select("id", "f.*"))
    return out.select("id", F.col("roles")["title"].alias("title"), F.col("sources")["title"].alias("title_field"), F.col("roles")["code"].alias("code"), F.array_join("unclassified", ",").alias("unclassified"))


def role_hints(spark, sf_dir):
    """Values of a supplier's lines by flag: a role is ambiguous where they differ."""
    fields = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("identity"), F.concat(F.lit("role"), "l_returnflag").alias("role"), F.when(F.col("l_linenumber") == 1, " ").otherwise(F.concat(F.col("l_linestatus"), (F.col("l_linenumber") % 2).cast("string"))).alias("value"))
    return R.role_hints(fields, 2).select("identity", "role", F.array_join("values", ",").alias("values"), "status")


def evaluation_eligibility(spark, sf_dir):
    k = F.col("l_orderkey")
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("b_count"))
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, "").otherwise((k % 50).cast("string")).alias("a_id"), (F.col("l_partkey") % 100).alias("c"), (F.col("l_linenumber") != 6).alias("engine"), F.when(k % 9 == 0, 2).otherwise(1).alias("a_count"), (F.col("l_linenumber") != 5).alias("has_a"), (k % 31 != 0).alias("has_b"), F.when(k % 23 == 0, "number").otherwise("string").alias("a_kind"), F.lit("string").alias("b_kind"))
    both = pairs.join(counts, F.col("c") == F.col("o_custkey"), "left").withColumn("b_id", F.col("c").cast("string"))
    return R.eligibility(both).groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def strict_json(spark, sf_dir):
    """Properties of events as JSON texts, some of them spoilt, by their fault and with what good ones hold."""
    n, p = F.col("event_id") % 11, F.col("props")
    spoilt = (
        F.when(n == 0, F.replace(p, F.lit("{"), F.lit('{"k": 1, '))).when(n == 1, F.replace(p, F.lit("{"), F.lit('{"\\u006b": 1, '))).when(n == 2, F.replace(p, F.lit("}"), F.lit(",}"))).when(n == 3, F.concat(F.repeat(F.lit("["), 8), p, F.repeat(F.lit("]"), 8)))
        .when(n == 4, F.concat(F.lit("[[[[[["), p, F.lit("]]]]]]"))).when(n == 5, F.replace(p, F.lit("k"), F.lit("a\tb"))).when(n == 6, F.concat(p, F.lit(" x"))).when(n == 7, F.replace(p, F.lit(": "), F.lit(": 0"))).when(n == 8, F.concat(F.lit(" \n"), p, F.lit("\t")))
        .when(n == 9, F.concat(p, F.repeat(F.lit(" "), 600))).otherwise(p)
    )
    found = J.checked(read(spark, sf_dir, "events").select("event_id", spoilt.alias("text")), "text", most_bytes=500)
    value = F.coalesce(F.try_variant_get("json", "$.k", "long"), F.try_variant_get("json", "$[0][0][0][0][0][0].k", "long"))
    return found.groupBy((F.col("event_id") % 11).alias("kind"), F.coalesce("json_fault", F.lit("")).alias("fault")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def saved_entry_status(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = read(spark, sf_dir, "orders").select(k.alias("pair_id"), F.col("o_orderstatus").alias("identity"), F.lit("r").alias("requirement"), F.lit("a").alias("actual"))
    current = read(spark, sf_dir, "orders").where(k % 4 != 0).select(k.alias("pair_id"), F.when(k % 3 == 0, "new").otherwise(F.col("o_orderstatus")).alias("identity"), F.lit("r").alias("requirement"), F.when(k % 5 == 0, "b").otherwise("a").alias("actual"))
    return R.entry_statuses(entries, current.union(current.where("pair_id % 10 = 1")))


def bound_sides(spark, sf_dir):
    side = F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("side")
    c = read(spark, sf_dir, "customer")
    annotations = c.where("c_custkey % 7 <> 0").select(side, F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("hash"))
    records = c.where("c_custkey % 11 <> 0").select(side, F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 13 == 0, "other").otherwise(F.col("c_mktsegment")).alias("hash"))
    out = R.bound_sides(annotations, records.union(records.where("id = 3")))
    return out.groupBy("side", "status", "ready").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def candidate_view(spark, sf_dir):
    """Parts as candidates: those with a word in name or alias and a rule, by exposure."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("term"), F.array("p_type").alias("aliases"), F.array(F.lit("R1"), F.when(k % 2 == 0, "R2").otherwise("R3")).alias("rules"), F.when(k % 5 == 0, "REJECT").alias("decision"), F.col("p_size").cast("long").alias("exposure"), (k % 3).alias("documents"), (k % 4).alias("conflicts"))
    return R.selected(rows, decision="UNREVIEWED", rule="R2", flag="CONFLICT", query="Large", sort="exposure").select("id", "term", "exposure", "position")


def satisfaction_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    return R.satisfaction_counts(read(spark, sf_dir, "orders").select((k % 4 == 0).alias("all_reviewed"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("satisfied")))


QUERIES = {f.__name__: f for f in (heading_lines, profile_headings, layout_lines, paragraph_merge, nearby_texts, canonical_projections, role_hints, evaluation_eligibility, strict_json, saved_entry_status, bound_sides, candidate_view, satisfaction_summary)}
ORACLE_SQL = {
    "heading_lines": """
WITH t AS (SELECT p_partkey AS k, replace(['第#章 概要', '#.2 surface', '第二節', '# note', 'plain #', '#．１　全角', '3.'][(p_partkey % 7 + 1)::INT], '#', (p_partkey % 20)::VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN p_name || p_name || p_name WHEN 1 THEN ' ' || p_name ELSE '' END AS s FROM part),
m AS (SELECT k, trim(s) AS s, CASE WHEN regexp_matches(s, '^第[0-9０-９一二三四五六七八九十百]+[章編節]') THEN regexp_extract(s, '^第[0-9０-９一二三四五六七八九十百]+[章編節][\\s　]*(.*)$', 1) ELSE regexp_extract(s, '^([0-9０-９]+([.．][0-9０-９]+)*[.．]?)[\\s　]+(.+)$', 3) END AS title FROM t)
SELECT k AS p_partkey, CASE WHEN trim(title) = '' THEN NULL WHEN length(trim(title)) > 60 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN trim(title) <> '' THEN s END AS title FROM m""",
    "profile_headings": """
WITH r(kind, level, priority, pattern, most) AS (VALUES ('chapter', 1, 10, '^[A-Z][a-z]+ed ', 80), ('section', 2, 20, '^large ', 40), ('note', 3, 20, 'steel$', 25), ('any', 9, 1, '.', 200)),
h AS (SELECT p_partkey, kind, level, row_number() OVER (PARTITION BY p_partkey ORDER BY priority DESC, level, kind DESC) AS n FROM part JOIN r ON regexp_matches(p_name, pattern) AND length(p_name) <= most)
SELECT p_partkey, kind, level::INT AS level FROM h WHERE n = 1""",
    "layout_lines": """
WITH RECURSIVE i AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_returnflag) AS f, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
t AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY n * 5 % 8) AS o, ((n % 3) * 30 + s % 7)::DOUBLE AS x, (100 - n // 2 * 4 - s % 3)::DOUBLE AS y, CASE f WHEN 'R' THEN 10e0 ELSE 4e0 END AS h, f || n || ' ' AS str FROM i),
a AS (SELECT DISTINCT page, 0::BIGINT AS o, []::DOUBLE[] AS begun, 0 AS anchor FROM t
  UNION ALL SELECT page, o, CASE WHEN hit IS NULL THEN list_append(begun, y) ELSE begun END, coalesce(hit, len(begun) + 1) FROM
    (SELECT t.page, t.o, t.y, a.begun, list_filter(range(1, len(a.begun) + 1), lambda j: abs(a.begun[j] - t.y) <= greatest(0.6 * t.h, 3))[1] AS hit FROM a JOIN t ON t.page = a.page AND t.o = a.o + 1)),
b AS (SELECT t.*, a.anchor FROM t JOIN a USING (page, o)),
g AS (SELECT *, CASE WHEN x - (lag(x) OVER v + 9) > greatest(1.6 * lag(h) OVER v, 12) THEN 1 ELSE 0 END AS cut FROM b WINDOW v AS (PARTITION BY page, anchor ORDER BY x, o)),
e AS (SELECT *, sum(cut) OVER (PARTITION BY page, anchor ORDER BY x, o) AS seg FROM g),
c AS (SELECT page, anchor, seg, trim(string_agg(str, '' ORDER BY x, o)) AS piece, min(x) AS lft, max(x + 9) AS rgt, min(y - h * 0.25) AS btm, max(y + h) AS tp, arg_min(y, o) AS y, min(o) AS o FROM e GROUP BY 1, 2, 3),
l AS (SELECT page, anchor, string_agg(piece, ' ' ORDER BY seg) AS text, count(*)::INT AS segments, min(lft) AS "left", max(rgt) AS "right", min(btm) AS bottom, max(tp) AS top, arg_min(y, o) AS y FROM c GROUP BY 1, 2)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY y DESC, anchor)::INT AS line, y, text, segments, "left", "right", bottom, top FROM l""",
    "paragraph_merge": """
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN min(l_suppkey) % 5 = 0 THEN 0.2e0 ELSE 0.1e0 END AS lft, l_linenumber * 0.05e0 AS top, l_linenumber * 0.05e0 + CASE WHEN min(l_suppkey) % 3 = 0 THEN 0.02e0 ELSE 0.04e0 END AS bottom FROM lineitem GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN top - lag(bottom) OVER w BETWEEN -0.001e0 AND greatest(bottom - top, lag(bottom - top) OVER w, 0.001e0) * 0.6e0 AND abs(lft - lag(lft) OVER w) <= 0.03e0 THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY page ORDER BY n)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY n) AS paragraph FROM j)
SELECT page, paragraph::BIGINT AS paragraph, string_agg(n::VARCHAR, ' ' ORDER BY n) AS text, count(*)::INT AS lines FROM p GROUP BY 1, 2""",
    "nearby_texts": """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE concat_ws(' / ', p_name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END) END AS nearby,
       concat_ws(' / ', 'name: ' || p_name, 'part_id: ' || p_partkey, 'No: 1', 'size: ' || p_size, CASE WHEN p_partkey % 3 <> 0 THEN 'brand: ' || p_brand END, 'tags: t') AS labelled FROM part""",
    "canonical_projections": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE c_name END AS title, CASE WHEN c_custkey % 3 <> 0 THEN 'c_mktsegment' ELSE 'c_name' END AS title_field, CASE WHEN c_custkey % 2 <> 0 THEN c_nationkey::VARCHAR END AS code,
       CASE WHEN c_custkey % 3 = 0 THEN 'c_mktsegment,c_acctbal' ELSE 'c_acctbal' END AS unclassified FROM customer""",
    "role_hints": """
WITH v AS (SELECT DISTINCT l_partkey AS identity, 'role' || l_returnflag AS role, l_linestatus || (l_linenumber % 2) AS value FROM lineitem WHERE l_linenumber <> 1)
SELECT identity, role, array_to_string(list(value ORDER BY value)[1:2], ',') AS "values", CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unique' END AS status FROM v GROUP BY 1, 2""",
    "evaluation_eligibility": """
WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT l_linenumber AS l, CASE WHEN l_linenumber = 7 THEN '' ELSE (l_orderkey % 50)::VARCHAR END AS a, l_partkey % 100 AS c, l_linenumber <> 6 AS e, l_orderkey % 9 = 0 AS two, l_linenumber <> 5 AND l_orderkey % 31 <> 0 AS sides, l_orderkey % 23 = 0 AS number, coalesce(b.n, 0) AS n FROM lineitem LEFT JOIN b ON o_custkey = l_partkey % 100),
r AS (SELECT *, CASE WHEN NOT e THEN 'NOT_MATCHING_ENGINE' WHEN NOT sides THEN 'MISSING_SIDE' WHEN number THEN 'NON_STRING_TRACE_ID' WHEN a = '' THEN 'NO_TRACE_ID' WHEN two OR n <> 1 THEN 'DUPLICATE_TRACE_ID' ELSE '' END AS reason FROM p),
q AS (SELECT *, CASE WHEN reason = '' AND sum(CASE WHEN reason = '' THEN 1 ELSE 0 END) OVER (PARTITION BY a, c) > 1 THEN 'DUPLICATE_PAIR' ELSE reason END AS final FROM r)
SELECT final AS reason, count(*) AS n, sum(l)::BIGINT AS lines FROM q GROUP BY 1""",
    "strict_json": """
WITH e AS (SELECT event_id % 11 AS kind, CAST(props->>'k' AS BIGINT) AS k FROM events)
SELECT kind, CASE WHEN kind IN (0, 1) THEN 'DICTIONARY_JSON_DUPLICATE_KEY' WHEN kind IN (2, 5, 6) OR (kind = 7) THEN 'DICTIONARY_JSON_SYNTAX_INVALID' WHEN kind = 3 THEN 'DICTIONARY_MAX_NESTING_DEPTH_EXCEEDED' WHEN kind = 9 THEN 'DICTIONARY_JSON_TOO_LARGE' ELSE '' END AS fault, count(*) AS n,
       CAST(sum(CASE WHEN kind IN (4, 8, 10) THEN k END) AS BIGINT) AS total FROM e GROUP BY 1, 2""",
    "saved_entry_status": """
SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 10 = 1 THEN 'ORPHANED' WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'STALE' ELSE 'CURRENT' END AS status FROM orders""",
    "bound_sides": """
WITH t AS (SELECT CASE c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS side, c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN 'blocked' WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'unparsed' WHEN c_custkey % 13 = 0 THEN 'stale' ELSE 'bound' END AS status
           FROM customer WHERE c_custkey % 77 <> 0 UNION ALL SELECT 'B', 3, 'blocked' FROM customer WHERE c_custkey = 3)
SELECT side, status, false AS ready, count(*) AS n, sum(id)::BIGINT AS ids FROM t GROUP BY 1, 2""",
    "candidate_view": """
SELECT p_partkey AS id, p_name AS term, p_size::BIGINT AS exposure, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS position FROM part
WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 4 > 0 AND contains(lower(p_name || ' ' || p_type), 'large')""",
    "satisfaction_summary": """
WITH t AS (SELECT o_orderkey % 4 = 0 AS r, o_orderkey % 3 AS s FROM orders)
SELECT 'length' AS key, count(*) AS value FROM t UNION ALL SELECT 'all_reviewed', count(*) FILTER (r) FROM t UNION ALL SELECT 'satisfied_true', count(*) FILTER (s = 0) FROM t UNION ALL SELECT 'satisfied_false', count(*) FILTER (s = 1) FROM t UNION ALL SELECT 'satisfied_null', count(*) FILTER (s = 2) FROM t""",
}

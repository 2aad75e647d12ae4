"""Queries on profiles, terminology, reviews, documents' structure and identity."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import linkage as L
from ..operators import profile as P
from ..operators import quantities as Q
from ..operators import review as R
from ..operators import structure as S
from ..session import read, rounded, values
from . import linking, quantity

TERMS = [("anodized", "surface", "STANDARD", "ACTIVE"), ("polished", "surface", "STANDARD", "ACTIVE"), ("steel", "metal", "PROJECT", "ACTIVE"), ("brass", "alloy", "PROJECT", "ACTIVE"), ("brass", "metal", "DOMAIN", "ACTIVE"), ("small", "metal", "DOMAIN", "RETIRED")]
RULES = [("urgent", "urgent"), ("priority", "1-URGENT"), ("priority", "2-HIGH"), ("relaxed", "5-LOW"), ("odd", "SPECIFIED")]


def field_information_profile(spark, sf_dir):
    c = P.information(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment", "c_name"])
    p = P.information(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"])
    out = c.union(p)
    return out.select("field", "n", "distinct_values", rounded(F.col("near_constant_ratio")).alias("near_constant_ratio"), rounded(F.col("unique_ratio")).alias("unique_ratio"), (F.col("near_constant_ratio") < 0.8).alias("auto_eligible"))


COLUMNS = {"part": "p_partkey p_name p_brand p_type p_size p_retailprice", "customer": "c_custkey c_name c_acctbal c_mktsegment", "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "orders": "o_orderkey o_orderstatus o_orderdate"}
REGISTERED = [("part", "p_partkey", "IDENTITY_ONLY", None), ("part", "p_type", "MATCH_ELIGIBLE", "TERM"), ("documents", "lang", "DISPLAY_ONLY", None), ("orders", "source", "DISPLAY_ONLY", None)]
PAIRED = {"part": (("p_brand", "equipment_code"), ("p_name", "title"), ("p_type", "text"), ("p_size", "title")), "customer": (("c_mktsegment", "text"), ("c_name", "title"), ("c_nationkey", "category"), ("c_custkey", "title"))}


def _observed(spark, sf_dir):
    """schema_kind, field, n and ratios of the columns of several tables, by their values."""
    sides = [P.information(read(spark, sf_dir, t), c.split()).withColumn("schema_kind", F.lit(t)) for t, c in COLUMNS.items()]
    return functools.reduce(DataFrame.unionByName, sides)


def field_classification(spark, sf_dir):
    """What the columns of several tables are, and whether they may be paired by machine."""
    seen = _observed(spark, sf_dir)
    kinds = P.classified(seen, values(spark, REGISTERED, "schema_kind string, field string, classification string, role string"))
    return kinds.join(seen, ["schema_kind", "field"]).select("schema_kind", "field", "classification", "role", "source", "n", P.auto_eligible(F.col("classification"), F.col("n"), F.col("near_constant_ratio")).alias("auto_eligible"))


def safe_field_pairing(spark, sf_dir):
    """Fields of parts and customers paired by role, of those whose values tell rows apart."""
    def side(table):
        roles = values(spark, [(f, r, i) for i, (f, r) in enumerate(PAIRED[table])], "field string, role string, position int")
        seen = P.information(read(spark, sf_dir, table), [f for f, _ in PAIRED[table]])
        return roles.join(seen, "field").select("field", "role", "position", P.auto_eligible(F.lit("MATCH_ELIGIBLE"), F.col("n"), F.col("unique_ratio"), 0.5).alias("eligible"))

    return P.auto_pairing(side("part"), side("customer"))


def learning_summary(spark, sf_dir):
    """A dictionary's entries by state and the totals of what is counted of them, without any term."""
    k = F.col("p_partkey")
    utility = F.create_map(F.lit("exposure_count"), F.col("p_size").cast("long"), F.lit("match_opportunity_count"), k % 7, F.lit("document_support_count"), F.when(k % 3 == 0, 2).otherwise(1).cast("long"))
    entries = read(spark, sf_dir, "part").select(F.col("p_brand").alias("dictionary_id"), F.element_at(F.array(*map(F.lit, D.STATES)), (k % 5 + 1).cast("int")).alias("status"), utility.alias("utility"))
    out = D.learning_summary(entries)
    return out.select("dictionary_id", "entry_count", *(F.col("status_counts")[s].alias(s.lower()) for s in D.STATES), *(F.col("utility_totals")[f].alias(f) for f in D.UTILITY), "error")


def shareable_summary(spark, sf_dir):
    """Counts of an extraction by rule: what may be shared, since it holds no content."""
    k = F.col("p_partkey")
    rules = F.when(k % 3 == 0, F.array(F.lit("TERM_HEADING"), F.lit("TERM_REPEATED_VALUE"))).when(k % 3 == 1, F.array(F.lit("TERM_KEY"))).otherwise(F.array(F.lit("TERM_HEADING")))
    part = read(spark, sf_dir, "part")
    candidates = part.where(k % 4 != 0).select(k.alias("id"), rules.alias("rules"))
    return D.shareable_summary(candidates, part.where(k % 5 == 0).select(k.alias("id")), part.where(k % 50 == 0).select(k.alias("id")), part.where(k % 4 == 0).select(k.alias("id")))


def profile_projection_tags(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    rows = P.projected(orders, "o_orderkey", ["o_orderpriority"], ["o_orderpriority", "o_orderstatus"])
    return P.tagged(rows.select("id", "text"), values(spark, RULES, "tag string, keyword string"), ["priority", "relaxed", "urgent"]).groupBy("tags", "unregistered").agg(F.count("*").alias("n"))


def dictionary_layer_merge(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    scope = F.element_at(F.array(*[F.lit(s) for s in D.SCOPES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    entries = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("canonical"), F.array("p_name").alias("aliases"), scope.alias("scope"), F.lit("ACTIVE").alias("status"))
    return D.merged_layers(D.lookup_keys(entries)).select("key", "canonical", "scope", "rivals")


def dictionary_conflicts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    entries = part.select(F.col("p_type").alias("canonical"), F.array("p_name").alias("aliases"), F.col("p_brand").alias("scope"), F.lit("ACTIVE").alias("status"))
    return D.conflicts(D.lookup_keys(entries))


def dictionary_resolve(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    terms = values(spark, TERMS, "alias string, canonical string, scope string, status string")
    keys = D.lookup_keys(terms.select("canonical", F.array("alias").alias("aliases"), "scope", "status"))
    words = part.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"))
    return D.resolve(words, keys).groupBy("term", "canonical", "status").agg(F.count("*").alias("n"))


_TERM = {"QUOTED": '"([A-Za-z][^"\\n]{1,40})"', "PARENTHETICAL": r"\(([A-Za-z][^()\n]{1,40})\)", "CAPITAL_PAIR": r"(?:^|[ .,;:!?])([A-Z][a-z]+ [A-Z][a-z]+)(?:[ .,;:!?]|$)"}


def term_candidates(spark, sf_dir):
    units = S.lines(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc", F.col("line_no").alias("unit"), F.col("line").alias("text"))
    return D.term_candidates(units, _TERM).select("term", "exposure", "documents", "rules")


def alias_conflicts(spark, sf_dir):
    text = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return D.alias_conflicts(D.alias_pairs(read(spark, sf_dir, "part").select(text.alias("text")), r"([A-Za-z ]+) \(([A-Za-z0-9#]+)\)"))


def promotion_eligibility(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    pick = F.when(F.col("quality") == 1, "ACCEPT").when(F.col("toxic") == 1, "REJECT").otherwise("UNCERTAIN")
    decisions = labels.select(F.col("doc_id").alias("id"), pick.alias("decision"), F.lit(1).alias("seq"))
    return D.promotion(docs.select(F.col("doc_id").alias("id")), decisions)


def bind_status(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    hashed = docs.select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    side = labels.select((F.col("doc_id") * 2).alias("id")).join(hashed, "id", "left").select("id", F.when(F.col("id") % 7 == 0, F.lit("changed")).otherwise(F.col("hash")).alias("hash"))
    return R.bound(side, hashed)


def stale_edges(spark, sf_dir):
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    nodes = orders.select(F.col("o_orderkey").alias("id"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("hash"))
    seen = F.when(F.col("l_linenumber") % 5 == 0, F.lit("old")).otherwise(F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    edges = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("edge_id"), F.col("l_orderkey").alias("source"), (F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("target"), seen.alias("source_hash"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("target_hash"))
    return R.stale_edges(edges, nodes).groupBy("stale").agg(F.count("*").alias("n"))


def ref_integrity(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    shifted = line.select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)).alias("l_partkey"), "l_orderkey", "l_linenumber")
    return R.dangling(shifted, "l_partkey", part, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


def lifecycle_last_write(spark, sf_dir):
    return R.last_write(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def op_log_sequence_check(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    log = events.select("user_id", (F.col("event_id") % 97 + 1).alias("seq"))
    return R.sequence_problems(log, "user_id", "seq")


def effective_satisfaction(spark, sf_dir):
    automatic = quantity.interval_coverage_judgement(spark, sf_dir).select(F.col("p_partkey").alias("id"), "state", "satisfied")
    latest = lifecycle_last_write(spark, sf_dir)
    verdict = F.when(F.col("event_type") == "signup", "override_satisfied").when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "override_unsatisfied")
    reviewed = latest.select(F.col("user_id").alias("id"), F.when(verdict.isNotNull(), "reviewed").otherwise("unreviewed").alias("status"), verdict.alias("verdict"))
    return R.effective_satisfaction(automatic, reviewed)


def entry_status(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    saved = labels.select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).cast("string").alias("hash"))
    current = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), (F.length("lang") - 1).cast("string").alias("hash"))
    return R.entry_status(saved, current)


def stratified_sample(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return R.stratified_sample(orders, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 200)


def precision_recall(spark, sf_dir):
    found, (a, _), (b, _) = linking.tag_kinds(spark, sf_dir)
    weights = linking.rows_of(a, "a_id"), linking.rows_of(b, "b_id")
    weighted = lambda pairs: pairs.join(weights[0], "a_id").join(weights[1], "b_id").select("a_id", "b_id", (F.col("a_id_n") * F.col("b_id_n")).alias("n"))
    truth = a.select(F.col("id").alias("a_id"), "p_brand", "p_size").join(b.select(F.col("id").alias("b_id"), "p_brand", "p_size"), ["p_brand", "p_size"])
    out = R.precision_recall(weighted(found), weighted(truth), ["a_id", "b_id"])
    return out.select("true_positives", "false_positives", "false_negatives", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


def trace_matrix(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    links = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a_id"), F.col("o_orderkey").alias("b_id"))
    return R.coverage_matrix(customer.select(F.col("c_custkey").alias("id")), orders.select(F.col("o_orderkey").alias("id")), links)


def reverse_view(spark, sf_dir):
    """Per target of links: how many, and the highest defined confidence."""
    links, (a, _), (_, members) = linking.best_kinds(spark, sf_dir)
    masked = links.withColumn("confidence", F.when(F.col("method") != "partial", F.col("confidence"))).join(linking.rows_of(a, "a_id"), "a_id")
    seen = masked.groupBy("b_id").agg(F.sum("a_id_n").alias("links"), F.max("confidence").alias("most"), F.max_by("method", F.struct(F.col("confidence"), F.col("method"))).alias("method"))
    return L.of_members(seen, members, "b_id").select("b_id", "links", "most", "method")


def netstring_ids(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    key = F.concat(T.netstring(F.col("p_name")), T.netstring(F.col("p_brand")), T.netstring(F.col("p_partkey").cast("string")))
    return part.select("p_partkey", key.alias("key"), T.identity("node", F.col("p_name"), F.col("p_partkey")).alias("node_id"))


def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(F.concat_ws("|", T.comparison_key(F.col("lang")), "source", "text"), "UTF-8"), 256).alias("content_hash"))


def dataset_signature(spark, sf_dir):
    """An order-insensitive signature: rows are hashed; hashes that begin alike are sorted and hashed together, by
    six characters, then by four, then by two, then all. A bucket is a 16,777,216th of the rows, then 256 hashes."""
    rows = read(spark, sf_dir, "part").select(F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand"), 256).alias("h"))
    level = rows.select(F.col("h").alias("k"), "h")
    for width in (6, 4, 2):
        level = level.groupBy(F.substring("k", 1, width).alias("k")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("h"))
    return level.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("signature"), F.count("*").alias("buckets"))


def heading_sections(spark, sf_dir):
    rows = S.lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return S.sections(rows, (F.length("line") <= 40) & F.col("line").rlike(r"^[^a-z]*[A-Z][^|]*\.$")).select("doc", "section", "heading", "lines", "characters")


def excel_unpivot_header_detect(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    cols = ["p_partkey", "p_name", "p_brand", "p_type"]
    head = values(spark, [(1, i + 1, c) for i, c in enumerate(cols)], "r int, c int, v string")
    kinds = part.select(F.col("p_type").alias("sheet")).distinct()
    body = part.select(F.col("p_type").alias("sheet"), (F.col("p_partkey") + 2).cast("int").alias("r"), F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("c", "v")).withColumn("c", F.col("c") + 1)
    cells = kinds.crossJoin(F.broadcast(head)).select("sheet", "r", "c", "v").union(body.select("sheet", "r", "c", "v"))
    return S.header_rows(cells).join(S.meaningful_range(cells), "sheet")


def long_text_chunks(spark, sf_dir):
    out = S.chunks(read(spark, sf_dir, "documents"), "doc_id", "text")
    return out.groupBy("doc").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("characters"))


TEXTS = ("全長は# mm以上、幅5~9 kPa", "#kPa以下", "電圧200±# V", "10 mm以上 6# mm未満", "周囲温度# °Cにおいて、最大12.5 kW程度", "三相AC 200 V、50/# Hz。公称#°C", "# °Cから1,000 °Cまで", "約#V")


def quantity_extraction(spark, sf_dir):
    """Quantities of texts about parts; # stands for a part's size."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.replace(F.element_at(F.array(*map(F.lit, TEXTS)), (k % len(TEXTS) + 1).cast("int")), F.lit("#"), size)
    found = Q.extract(read(spark, sf_dir, "part").select("p_partkey", F.when(k % 97 != 0, text).alias("text")), "p_partkey", "text")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("start"))
    return found.select(
        F.col("id").alias("p_partkey"), nth.alias("nth"), "start", "source_text", "kind", F.col("lower.value").alias("lower"), F.col("lower.inclusive").alias("lower_inclusive"), F.col("upper.value").alias("upper"), F.col("upper.inclusive").alias("upper_inclusive"),
        F.get("options", F.lit(1)).alias("second"), F.col("unit.canonical").alias("unit"), "confidence", F.size("warnings").alias("warnings"), F.array_join(F.transform("qualifiers", lambda q: q["type"]), ",").alias("qualifiers"), F.array_join("tokens", ",").alias("tokens"), F.col("condition.source_text").alias("condition"),
    )


def document_versions(spark, sf_dir):
    """Two versions of the documents: added, removed, changed and same by stable key."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("id"), "h")
    new = docs.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 5, F.lit("new")).otherwise(F.col("h")).alias("h"))
    both = old.toDF("id", "o").join(new.toDF("id", "n"), "id", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "same").otherwise("changed")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


_ALL = (field_information_profile, field_classification, safe_field_pairing, learning_summary, shareable_summary, profile_projection_tags, dictionary_layer_merge, dictionary_conflicts, dictionary_resolve, term_candidates, alias_conflicts, promotion_eligibility, bind_status, stale_edges, ref_integrity, lifecycle_last_write, op_log_sequence_check, effective_satisfaction, entry_status, stratified_sample, precision_recall, trace_matrix, reverse_view, netstring_ids, content_hash, dataset_signature, heading_sections, excel_unpivot_header_detect, long_text_chunks, quantity_extraction, document_versions)
QUERIES = {f.__name__: f for f in _ALL}
_R = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
#: What each text says, worked out by hand: text, number, begin, source, kind, lower (constant and share of the size), upper, second option, unit, confidence, warnings, qualifiers, tokens, condition.
_SAID = """VALUES (0, 1, 3, '# mm', 'interval', 0, 1, true, NULL, NULL, NULL, NULL, 'mm', 0.95, 0, '', '', NULL), (0, 2, 11, '5~9 kPa', 'interval', 5, 0, true, 9, 0, true, NULL, 'kPa', 0.95, 0, '', '', NULL),
  (1, 1, 0, '#kPa', 'interval', NULL, NULL, NULL, 0, 1, true, NULL, 'kPa', 0.95, 0, '', '', NULL), (2, 1, 2, '200±# V', 'interval', 200, -1, true, 200, 1, true, NULL, 'V', 0.6, 1, '', '', NULL),
  (3, 1, 0, '10 mm以上 6# mm', 'interval', 10, 0, true, NULL, NULL, false, NULL, 'mm', 0.95, 0, '', '', NULL), (4, 1, 12, '最大12.5 kW程度', 'interval', NULL, NULL, NULL, 12.5, 0, true, NULL, 'kW', 0.6, 2, 'approximate,maximum', '', '# °C'),
  (5, 1, 5, '200 V', 'interval', 200, 0, true, 200, 0, true, NULL, 'V', 0.95, 0, '', '三相,AC', NULL), (5, 2, 11, '50/# Hz', 'alternatives', NULL, NULL, NULL, NULL, NULL, NULL, 1, 'Hz', 0.6, 1, '', '三相,AC', NULL), (5, 3, 19, '公称#°C', 'interval', 0, 1, true, 0, 1, true, NULL, 'degC', 0.6, 1, 'nominal', '', NULL),
  (6, 1, 0, '# °Cから1,000 °Cまで', 'interval', 0, 1, true, 1000, 0, true, NULL, 'degC', 0.95, 0, '', '', NULL), (7, 1, 0, '約#V', 'interval', 0, 1, true, 0, 1, true, NULL, 'V', 0.6, 1, 'approximate', '', NULL)"""
ORACLE_SQL = {
    "quantity_extraction": f"""
WITH v(t, nth, s, src, kind, lc, lk, li, uc, uk, ui, oc, unit, conf, warned, quals, tokens, cond) AS ({_SAID})
SELECT p_partkey, nth::INT AS nth, (s + CASE WHEN t = 0 AND nth = 2 OR t = 4 THEN length(p_size::VARCHAR) - CASE t WHEN 4 THEN 0 ELSE 1 END WHEN t = 5 AND nth = 3 THEN length(p_size::VARCHAR) - 1 ELSE 0 END)::INT AS start,
       replace(src, '#', p_size::VARCHAR) AS source_text, kind, (lc + lk * p_size)::DOUBLE AS lower, li AS lower_inclusive, CASE WHEN t = 3 THEN ('6' || p_size)::DOUBLE ELSE (uc + uk * p_size)::DOUBLE END AS upper, ui AS upper_inclusive,
       CASE WHEN oc = 1 THEN p_size::DOUBLE END AS second, unit, conf::DOUBLE AS confidence, warned::INT AS warnings, quals AS qualifiers, tokens, replace(cond, '#', p_size::VARCHAR) AS condition
FROM part JOIN v ON t = p_partkey % 8 WHERE p_partkey % 97 <> 0""",
    "field_information_profile": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in (("customer", ["c_nationkey", "c_mktsegment", "c_name"]), ("part", ["p_name", "p_brand", "p_type", "p_size"])) for c in cs) + f"""), k AS (SELECT field, v, count(*) AS n FROM v WHERE v <> '' GROUP BY 1, 2)
SELECT field, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_values, {_R('max(n) / sum(n)')} AS near_constant_ratio, {_R('count(*) / sum(n)')} AS unique_ratio, max(n) / sum(n) < 0.8 AS auto_eligible FROM k GROUP BY 1""",
    "field_classification": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{t}' AS schema_kind, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in COLUMNS.items() for c in cs.split()) + """),
i AS (SELECT schema_kind, field, sum(n)::BIGINT AS n, max(n) / sum(n) AS most FROM (SELECT schema_kind, field, value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
-- by hand: what each column is
k(field, classification, role, source) AS (VALUES ('p_partkey', 'IDENTITY_ONLY', NULL, 'registered_schema:part'), ('p_type', 'MATCH_ELIGIBLE', 'TERM', 'registered_schema:part'), ('p_name', 'MATCH_ELIGIBLE', 'SUBJECT_ENTITY_NAME', 'generic_pattern'), ('c_name', 'MATCH_ELIGIBLE', 'SUBJECT_ENTITY_NAME', 'generic_pattern'),
  ('doc_id', 'TECHNICAL_METADATA', NULL, 'generic_pattern'), ('text', 'MATCH_ELIGIBLE', 'DESCRIPTION', 'generic_pattern'), ('lang', 'DISPLAY_ONLY', NULL, 'registered_schema:documents'), ('source', 'UNSUPPORTED_COMPLEX', NULL, 'trace_envelope'), ('page_id', 'TECHNICAL_METADATA', NULL, 'generic_pattern'))
SELECT schema_kind, field, coalesce(classification, 'UNCLASSIFIED') AS classification, role, coalesce(source, 'unclassified') AS source, n, coalesce(classification = 'MATCH_ELIGIBLE' AND most < 0.8, false) AS auto_eligible FROM i LEFT JOIN k USING (field)""",
    "safe_field_pairing": """
WITH v AS (SELECT * FROM (SELECT unnest(['p_brand', 'p_name', 'p_type', 'p_size']) AS field, unnest([p_brand, p_name, p_type, p_size::VARCHAR]) AS value FROM part) UNION ALL SELECT * FROM (SELECT unnest(['c_mktsegment', 'c_name', 'c_nationkey', 'c_custkey']), unnest([c_mktsegment, c_name, c_nationkey::VARCHAR, c_custkey::VARCHAR]) FROM customer)),
i AS (SELECT field, count(DISTINCT value) / count(*) < 0.5 AS ok FROM v WHERE value <> '' GROUP BY 1),
r(side, field, role, position, priority, method) AS (VALUES ('a', 'p_brand', 'equipment_code', 0, 1, 'code'), ('a', 'p_name', 'title', 1, 4, 'auto'), ('a', 'p_type', 'text', 2, 6, 'contains'), ('a', 'p_size', 'title', 3, 4, 'auto'),
  ('b', 'c_mktsegment', 'text', 0, 6, 'contains'), ('b', 'c_name', 'title', 1, 4, 'auto'), ('b', 'c_nationkey', 'category', 2, 7, 'auto'), ('b', 'c_custkey', 'title', 3, 4, 'auto')),
n AS (SELECT r.*, row_number() OVER (PARTITION BY side, role ORDER BY position) AS nth FROM r JOIN i USING (field) WHERE ok)
SELECT coalesce(x.role, y.role) AS role, coalesce(x.nth, y.nth)::INT AS nth, x.field AS a_field, y.field AS b_field, CASE WHEN x.field IS NOT NULL AND y.field IS NOT NULL THEN x.method END AS method, coalesce(x.priority, y.priority)::INT AS priority, CASE WHEN x.field IS NULL THEN 'no_requirement_field' WHEN y.field IS NULL THEN 'no_actual_field' END AS reason
FROM (SELECT * FROM n WHERE side = 'a') x FULL JOIN (SELECT * FROM n WHERE side = 'b') y ON x.role = y.role AND x.nth = y.nth""",
    "learning_summary": """
SELECT p_brand AS dictionary_id, count(*) AS entry_count, count(*) FILTER (p_partkey % 5 = 0) AS probation, count(*) FILTER (p_partkey % 5 = 1) AS active, count(*) FILTER (p_partkey % 5 = 2) AS observing, count(*) FILTER (p_partkey % 5 = 3) AS quarantined, count(*) FILTER (p_partkey % 5 = 4) AS retired,
       sum(p_size)::BIGINT AS exposure_count, sum(p_partkey % 7)::BIGINT AS match_opportunity_count, 0::BIGINT AS candidate_gain, 0::BIGINT AS ranking_gain, 0::BIGINT AS candidate_noise_increase, 0::BIGINT AS alias_conflict_count, sum(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS document_support_count, NULL::VARCHAR AS error FROM part GROUP BY 1""",
    "shareable_summary": """
WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ['TERM_HEADING', 'TERM_REPEATED_VALUE'] WHEN 1 THEN ['TERM_KEY'] ELSE ['TERM_HEADING'] END AS rules FROM part WHERE p_partkey % 4 <> 0)
SELECT 'candidate_count' AS key, count(*) AS value FROM c UNION ALL SELECT 'alias_candidate_count', count(*) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'conflict_count', count(*) FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT 'rejected_count', count(*) FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'counts_by_rule.' || r, count(*) FROM (SELECT unnest(rules) AS r FROM c) GROUP BY 1 UNION ALL SELECT 'content_included', 0""",
    "profile_projection_tags": """
SELECT list_aggregate(list_sort(list_filter([CASE WHEN contains(t, 'urgent') THEN 'urgent' END, CASE WHEN contains(t, '1-urgent') OR contains(t, '2-high') THEN 'priority' END, CASE WHEN contains(t, '5-low') THEN 'relaxed' END], lambda x: x IS NOT NULL)), 'string_agg', ',') AS tags0,
  CASE WHEN contains(t, 'specified') THEN 'odd' ELSE '' END AS unregistered, t FROM (SELECT lower(o_orderpriority || ' / ' || o_orderstatus) AS t FROM orders)""",
    "dictionary_layer_merge": """
WITH e AS (SELECT p_type || ' ' || p_brand AS canonical, p_name AS alias, (['SESSION','PROJECT','DOMAIN','STANDARD'])[CAST(p_partkey % 4 + 1 AS INT)] AS scope, p_partkey % 4 AS p FROM part),
k AS (SELECT lower(trim(canonical)) AS key, canonical, scope, p FROM e UNION ALL SELECT lower(trim(alias)), canonical, scope, p FROM e),
ok AS (SELECT * FROM k WHERE key <> '' AND (SELECT count(DISTINCT canonical) FROM k c WHERE c.key = k.key AND c.scope = k.scope) = 1)
SELECT key, arg_min(canonical, (p, canonical)) AS canonical, arg_min(scope, (p, canonical)) AS scope, count(DISTINCT canonical) AS rivals FROM ok GROUP BY 1""",
    "dictionary_conflicts": """
WITH k AS (SELECT p_brand AS scope, lower(trim(p_type)) AS key, p_type AS canonical FROM part UNION ALL SELECT p_brand, lower(trim(p_name)), p_type FROM part)
SELECT scope, key, count(DISTINCT canonical) AS canonicals FROM k GROUP BY 1, 2 HAVING count(DISTINCT canonical) > 1""",
    "dictionary_resolve": "WITH d(alias, canonical) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c, _, s in TERMS if s == "ACTIVE") + """),
w AS (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS term FROM part),
c AS (SELECT DISTINCT canonical FROM d), a AS (SELECT alias, min(canonical) AS canonical, count(DISTINCT canonical) AS n FROM d GROUP BY 1)
SELECT term, coalesce(c.canonical, CASE WHEN a.n = 1 THEN a.canonical END) AS canonical,
  CASE WHEN c.canonical IS NOT NULL THEN 'canonical' WHEN a.n = 1 THEN 'alias' WHEN a.n > 1 THEN 'conflict' ELSE 'unknown' END AS status, count(*) AS n
FROM w LEFT JOIN c ON c.canonical = lower(trim(term)) LEFT JOIN a ON a.alias = lower(trim(term)) GROUP BY 1, 2, 3""",
    "term_candidates": """
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM documents),
m AS (SELECT doc_id, unit, 'QUOTED' AS rule, unnest(regexp_extract_all(line, '"([A-Za-z][^"\\n]{1,40})"', 1)) AS t FROM u
 UNION ALL SELECT doc_id, unit, 'PARENTHETICAL', unnest(regexp_extract_all(line, '\\(([A-Za-z][^()\\n]{1,40})\\)', 1)) FROM u
 UNION ALL SELECT doc_id, unit, 'CAPITAL_PAIR', unnest(regexp_extract_all(line, '(?:^|[ .,;:!?])([A-Z][a-z]+ [A-Z][a-z]+)(?:[ .,;:!?]|$)', 1)) FROM u),
k AS (SELECT *, translate(trim(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM m)
SELECT term, count(DISTINCT (doc_id, unit)) AS exposure, count(DISTINCT doc_id) AS documents, list_aggregate(list_sort(list(DISTINCT rule)), 'string_agg', ',') AS rules FROM k WHERE term <> '' GROUP BY 1""",
    "alias_conflicts": """
SELECT lower(p_brand) AS alias, count(DISTINCT lower(p_type)) AS canonicals, min(lower(p_type)) AS first, max(lower(p_type)) AS last FROM part GROUP BY 1 HAVING count(DISTINCT lower(p_type)) > 1""",
    "promotion_eligibility": """
SELECT d.doc_id AS id, CASE WHEN quality = 1 THEN 'ACCEPT' WHEN toxic = 1 THEN 'REJECT' WHEN l.doc_id IS NOT NULL THEN 'UNCERTAIN' ELSE 'UNREVIEWED' END AS decision, coalesce(quality = 1, false) AS eligible
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "bind_status": """
WITH l AS (SELECT doc_id * 2 AS id FROM labels)
SELECT coalesce(l.id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.id IS NULL THEN 'unparsed' WHEN l.id % 7 = 0 THEN 'stale' ELSE 'bound' END AS status FROM l FULL JOIN documents d ON d.doc_id = l.id""",
    "stale_edges": """
WITH n AS (SELECT o_orderkey AS id, o_orderstatus || '/' || o_orderpriority AS h FROM orders)
SELECT NOT (l_linenumber % 5 <> 0 AND coalesce(t.h = s.h, false)) AS stale, count(*) AS n
FROM lineitem JOIN n s ON s.id = l_orderkey LEFT JOIN n t ON t.id = l_orderkey + l_linenumber - 1 GROUP BY 1""",
    "ref_integrity": "SELECT l_orderkey, l_linenumber, l_partkey + 100000000 AS l_partkey FROM lineitem WHERE l_linenumber = 7",
    "lifecycle_last_write": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS writes FROM events GROUP BY 1",
    "op_log_sequence_check": """
SELECT user_id, count(*) AS n, count(DISTINCT event_id % 97 + 1) AS distinct_seq, min(event_id % 97 + 1) AS first, max(event_id % 97 + 1) AS last FROM events GROUP BY 1
HAVING min(event_id % 97 + 1) <> 1 OR max(event_id % 97 + 1) <> count(*) OR count(DISTINCT event_id % 97 + 1) <> count(*)""",
    "effective_satisfaction": """
WITH a AS (SELECT p_partkey AS id, lo >= p_size AS s FROM part LEFT JOIN (SELECT l_partkey, min(l_quantity) AS lo FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
r AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY 1)
SELECT a.id, CASE WHEN e IN ('signup', 'purchase', 'error') THEN 'human' ELSE 'automatic' END AS source, CASE e WHEN 'signup' THEN true WHEN 'error' THEN false ELSE s END AS satisfied FROM a LEFT JOIN r ON r.id = a.id""",
    "entry_status": """
SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'NO_ENTRY' WHEN d.doc_id IS NULL THEN 'ORPHANED' WHEN l.quality + l.toxic = length(lang) - 1 THEN 'CURRENT' ELSE 'STALE' END AS status
FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) d ON d.doc_id = l.doc_id""",
    "stratified_sample": """
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT 200 - coalesce(sum(n) FILTER (n <= 10), 0) AS rest, sum(n) FILTER (n > 10) AS large FROM c),
q AS (SELECT c.*, CASE WHEN n > 10 THEN rest::DOUBLE * n / large END AS share, rest FROM c, t),
b AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY coalesce(share - floor(share), -1) DESC, o_orderpriority, o_orderstatus) AS x FROM q),
z AS (SELECT *, CASE WHEN n <= 10 THEN n ELSE least(n, base + CASE WHEN x <= rest - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END) END AS quota FROM b),
o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders),
k AS (SELECT o_orderpriority, o_orderstatus, floor((k + 0.5::DOUBLE) * n / quota) AS i FROM z, unnest(range(CAST(quota AS BIGINT))) r(k))
SELECT o_orderkey, o.o_orderpriority, o.o_orderstatus FROM o JOIN k ON k.o_orderpriority = o.o_orderpriority AND k.o_orderstatus = o.o_orderstatus AND k.i = o.i""",
    "precision_recall": f"""
WITH {linking._TAGS}, f AS (SELECT a_id, b_id FROM tags WHERE s >= 0.6),
t AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id FROM part a JOIN part b USING (p_brand, p_size) WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1),
n AS (SELECT (SELECT count(*) FROM f SEMI JOIN t USING (a_id, b_id)) AS tp, (SELECT count(*) FROM f ANTI JOIN t USING (a_id, b_id)) AS fp, (SELECT count(*) FROM t ANTI JOIN f USING (a_id, b_id)) AS fn)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, {_R('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END')} AS precision, {_R('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS recall FROM n""",
    "trace_matrix": """
SELECT 'a' AS side, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'linked' ELSE 'unlinked' END AS coverage, count(*) AS n FROM customer GROUP BY 1, 2
UNION ALL SELECT 'b', CASE WHEN o_orderstatus = 'P' AND o_custkey IS NOT NULL THEN 'linked' ELSE 'unlinked' END, count(*) FROM orders GROUP BY 1, 2""",
    "reverse_view": f"""
WITH {linking._METHODS}, {linking._BEST}
SELECT b_id, count(*) AS links, max(CASE WHEN method <> 'partial' THEN confidence END) AS most, arg_max(method, (coalesce(CASE WHEN method <> 'partial' THEN confidence END, -1), method)) AS method FROM best GROUP BY 1""",
    "netstring_ids": """
SELECT p_partkey, strlen(p_name) || ':' || p_name || ',' || strlen(p_brand) || ':' || p_brand || ',' || length(CAST(p_partkey AS VARCHAR)) || ':' || p_partkey || ',' AS key,
  'node-' || substring(sha256('node' || chr(0) || p_name || chr(0) || p_partkey), 1, 32) AS node_id FROM part""",
    "content_hash": "SELECT doc_id, sha256(concat_ws('|', lower(trim(lang)), source, text)) AS content_hash FROM documents",
    "dataset_signature": """
WITH r AS (SELECT sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand)) AS h FROM part),
x AS (SELECT substring(h, 1, 6) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1),
y AS (SELECT substring(k, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM x GROUP BY 1),
b AS (SELECT substring(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM y GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY k)) AS signature, count(*) AS buckets FROM b""",
    "heading_sections": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, length(line) <= 40 AND regexp_matches(line, '^[^a-z]*[A-Z][^|]*\\.$') AS h FROM l WHERE trim(line) <> ''),
s AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id AS doc, CAST(section AS BIGINT) AS section, min(CASE WHEN h THEN line END) AS heading, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM s GROUP BY 1, 2""",
    "excel_unpivot_header_detect": """
SELECT p_type AS sheet, CAST(1 AS INT) AS header_row, 'high' AS confidence, CAST(min(p_partkey) + 2 AS INT) AS data_row, CAST(1 AS INT) AS top, CAST(max(p_partkey) + 2 AS INT) AS bottom, CAST(1 AS INT) AS "left", CAST(4 AS INT) AS "right", 4 * count(*) + 4 AS cells FROM part GROUP BY 1""",
    "long_text_chunks": """
WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?。\\n]+\\s*')) AS c FROM documents)
SELECT doc_id AS doc, count(*) AS chunks, max(length(c)) AS longest, CAST(sum(length(c)) AS BIGINT) AS characters FROM c WHERE trim(c) <> '' GROUP BY 1""",
    "document_versions": """
SELECT CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 4 THEN 'removed' WHEN doc_id % 10 = 5 THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM documents GROUP BY 1""",
}
ORACLE_SQL["profile_projection_tags"] = f"SELECT coalesce(tags0, '') AS tags, unregistered, count(*) AS n FROM ({ORACLE_SQL['profile_projection_tags']}) GROUP BY 1, 2"

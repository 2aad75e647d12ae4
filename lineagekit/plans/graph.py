"""Queries on the knowledge graph, guards of matches, and the dictionary's life."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dictionary as D
from ..operators import graph as G
from ..operators import guards as U
from ..operators import review as R
from ..session import read, values

TYPES = ("related_to", "contains", "satisfied_by", "belongs_to", "unknown")
STATES = (*D.STATES, "DRAFT")
SEGMENTS = ("anodized", "polished", "brushed", "small", "large", "steel")
VOCABULARY = [("metal", ["steel", "brass", "copper", "tin", "nickel"]), ("polished", ["burnished"]), ("small", []), ("STANDARD", ["standard"])]


def _nodes(spark, sf_dir):
    """Customers: their nation is the parent, every 50th is there twice, every 70th has no source."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    parent = F.when(k % 13 == 0, F.concat(F.lit("n"), (k + 1_000_000).cast("string"))).when(k % 3 == 0, F.concat(F.lit("n"), F.ceil(k / 2).cast("string")))
    nodes = c.select(F.concat(F.lit("n"), k.cast("string")).alias("node_id"), parent.alias("parent_node_id"), F.when(k % 70 == 0, "none").otherwise("doc").alias("source_document_id"), F.array("c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("tags"))
    return nodes.union(nodes.where(F.expr("cast(substring(node_id, 2) as bigint) % 50 = 0")))


def _edges(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("e"), F.floor(k / F.when(k % 100 == 1, 2).otherwise(1)).cast("string")).alias("edge_id"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("source_node_id"),
        F.concat(F.lit("n"), (F.col("o_custkey") + F.when(k % 17 == 0, 5_000_000).otherwise(0)).cast("string")).alias("target_node_id"), F.when(k % 5 % 2 == 1, "structural").otherwise("semantic").alias("relation_category"), kind.alias("relation_type"),
        F.when(k % 4 == 0, "candidate").otherwise("active").alias("lifecycle"), F.when(k % 3 == 0, 0.5).otherwise(1.0).alias("confidence"), (k % 6).cast("int").alias("n_features"),
    )


def _log(spark, sf_dir):
    i = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, ("ADD_TAG", "REMOVE_TAG", "UPDATE_NODE_TEXT", "CHANGE_NODE_TYPE", "REVIEW_HUMAN", "RESET_REVIEW"))), (i % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        (i + F.when(i % 1000 == 7, 1).otherwise(0) + 1).alias("sequence"), command.alias("command_type"), F.lit("node").alias("target_kind"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("target_id"),
        F.lit("h").alias("before_hash"), F.when(i % 97 == 0, "g").otherwise("h").alias("after_hash"), F.concat(F.lit("t"), (i % 9).cast("string")).alias("value"),
    )


def graph_diagnostics(spark, sf_dir):
    sources = spark.range(1).select(F.lit("doc").alias("source_document_id"))
    allowed = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("tag")).union(values(spark, [("BUILDING",), ("MACHINERY",)], "tag string"))
    return G.diagnostics(_nodes(spark, sf_dir), _edges(spark, sf_dir), sources, _log(spark, sf_dir), allowed).groupBy("code", "severity").agg(F.count("*").alias("n"), F.min("target_id").alias("least_target"))


def node_edit_fold(spark, sf_dir):
    nodes = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("text"), F.lit("statement").alias("node_type"), F.array(F.lit("t1"), F.lit("t3"), F.lit("x")).alias("tags"))
    out = G.folded_nodes(nodes, _log(spark, sf_dir))
    return out.select("node_id", "text", "node_type", F.array_join("tags", ",").alias("tags"), "edits")


def ingest_log(spark, sf_dir):
    """Orders of a customer as new edges after a log of the nations."""
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("sequence"), F.lit("CREATE_NODE").alias("command_type"), F.lit("node").alias("target_kind"), F.col("n_name").alias("target_id"), F.lit(None).cast("string").alias("before_hash"), F.lit("h").alias("after_hash"))
    nodes = read(spark, sf_dir, "supplier").select(F.format_string("s%09d", "s_suppkey").alias("node_id"), F.lit("a").alias("knowledge_hash"))
    edges = read(spark, sf_dir, "orders").select(F.format_string("o%09d", "o_orderkey").alias("edge_id"), F.lit("b").alias("knowledge_hash"))
    return G.ingested(nation, nodes, edges)


def relation_digests(spark, sf_dir):
    return G.canonical_relations(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey", "o_custkey", "o_orderpriority"])


def guard_flags(spark, sf_dir):
    """Neighbouring parts' names: alike by their beginning, or by frequent words only; and a heading of one word."""
    part = read(spark, sf_dir, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("a"), (F.col("p_partkey") + 1).alias("next")).join(part.select(F.col("p_partkey").alias("next"), F.col("p_name").alias("b")), "next")
    pairs = pairs.withColumn("segments", F.array(*map(F.lit, SEGMENTS))).withColumn("heading", F.element_at(F.split("a", " "), 1)).withColumn("keyword", F.substring("a", 1, 3)).withColumn("ta", F.split("a", " ")).withColumn("tb", F.split("b", " "))
    return pairs.select(
        "p_partkey", U.common_prefix("a", "b").cast("int").alias("prefix"), U.prefix_dominates("a", "b").alias("by_prefix"), U.boilerplate_dominates("a", "b", "segments").alias("by_boilerplate"),
        U.only_in_heading("keyword", "b", "heading").alias("in_heading"), U.code_hit_is_boilerplate("ta", "tb", "segments").alias("hit_is_boilerplate"),
    )


def keyword_extraction(spark, sf_dir):
    entry = F.concat(F.col("p_name"), F.lit("、"), F.col("p_brand"), F.lit("/PX-"), F.col("p_partkey").cast("string"))
    out = read(spark, sf_dir, "part").select("p_partkey", entry.alias("entry")).withColumn("keywords", U.keywords("entry", 4))
    return out.select("p_partkey", F.size("keywords").alias("n"), F.array_join("keywords", "|").alias("keywords"))


def state_transitions(spark, sf_dir):
    """Changes of state that follow each other in a user's events, and which of them are allowed."""
    n = (F.col("event_id") * 7 % len(STATES) + 1).cast("int")
    rows = read(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, STATES)), n).alias("to"))
    both = rows.withColumn("state", F.lag("to").over(Window.partitionBy("user_id").orderBy("event_id"))).where("state is not null")
    return both.groupBy("state", "to").agg(F.count("*").alias("n")).select("state", "to", "n", D.allowed_transition("state", "to").alias("allowed"))


def trace_judgements(spark, sf_dir):
    """What the lines of an order say of it, by methods that are dealt out by their numbers."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    method = F.when(n % 7 == 0, "exact").when(n % 7 == 1, "code").when(n % 7 == 2, "title_candidate").when(n % 7 == 3, "partial").when(n % 7 == 4, "none").when(n % 7 == 5, "")
    links = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("a_id"), method.alias("method"), F.when(n % 3 != 0, F.col("l_discount")).alias("confidence"))
    return R.judgement_summary(links)


def _entries(spark, sf_dir):
    k = F.col("p_partkey")
    aliases = F.array(F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2), F.when(k % 6 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), F.when(k % 4 == 0, 1).otherwise(-1).cast("int"))))
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dictionary_id"), F.concat(F.lit("x"), (k - F.when(k % 40 == 0, 1).otherwise(0)).cast("string")).alias("entry_id"), F.col("p_name").alias("canonical_term"), aliases.alias("aliases"),
        F.element_at(F.array(*map(F.lit, STATES)), (k % 6 + 1).cast("int")).alias("status"), F.element_at(F.array(*map(F.lit, D.SCOPES)), (k % 4 + 1).cast("int")).alias("scope"), "p_partkey",
    )


def dictionary_entry_problems(spark, sf_dir):
    return D.entry_problems(_entries(spark, sf_dir)).select("dictionary_id", "entry_id", F.array_join("problems", ",").alias("problems"))


def dictionary_layer_views(spark, sf_dir):
    return D.layer_view(_entries(spark, sf_dir)).groupBy("scope", "lookup").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"))


def snapshot_checks(spark, sf_dir):
    """Orders as snapshots: every ninth payload and every eleventh wrapper was changed afterwards."""
    k = F.col("o_orderkey")
    base = read(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k.cast("string")).alias("snapshot_id"), k.alias("version"), F.col("o_orderstatus").alias("scope"), F.when(k % 9 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("payload"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("payload_sha256"), (k % 11 == 0).alias("broken"))
    wrapper = F.sha2(F.concat(*[T.netstring(c) for c in (F.col("snapshot_id"), F.col("version").cast("string"), F.col("scope"), F.col("payload_sha256"))]).cast("binary"), 256)
    return D.snapshot_problems(base.withColumn("wrapper_sha256", F.when(F.col("broken"), "?").otherwise(wrapper)))


def snapshot_pins(spark, sf_dir):
    pins = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("project"), F.concat(F.lit("s"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 6, 9_000_000).otherwise(0)).cast("string")).alias("snapshot_id"), F.when(F.col("l_linenumber") == 5, "old").otherwise("new").alias("payload_sha256"))
    snapshots = read(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("snapshot_id"), F.lit("new").alias("payload_sha256"))
    return D.pin_problems(pins, snapshots)


def snapshot_activation(spark, sf_dir):
    i = F.col("event_id")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), (i % 3).alias("snapshot_id"), F.element_at(F.array(F.lit("ACTIVE"), F.lit("SUPERSEDED"), F.lit("ROLLED_BACK")), (F.floor(i / 3) % 3 + 1).cast("int")).alias("state"), i.alias("seq"))
    return D.activation(events)


def vocabulary_tags(spark, sf_dir):
    records = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.split("p_type", " ")).alias("values"))
    vocabulary = values(spark, VOCABULARY, "tag string, aliases array<string>")
    one = lambda folded, name: D.initial_tags(records, vocabulary, folded).select("id", F.lit(name).alias("form"), F.array_join("tags", ",").alias("tags"))
    return one(True, "folded").union(one(False, "exact"))


def review_decisions(spark, sf_dir):
    """Latest decisions over parts: of the lines, and one bulk rejection of large sizes."""
    candidates = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    decisions = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "A", "ACCEPT").when(F.col("l_returnflag") == "R", "UNCERTAIN").otherwise("UNREVIEWED").alias("decision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return D.review_counts(decisions.union(D.bulk_decisions(candidates, F.col("p_size") > 40, "REJECT", 10**12)), candidates)


def identity_differences(spark, sf_dir):
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    out = D.identity_differences(orders.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("id")), line.where("l_orderkey % 70 <> 0").select(F.col("l_orderkey").alias("id")))
    return out.groupBy("missing_in").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def term_evaluation(spark, sf_dir):
    """Words of part names as candidates, without such as only repeat under one brand; counted by rule."""
    word = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"), "p_brand", "p_size")
    rules = F.array_compact(F.array(F.when(F.max("p_size") > 45, "TERM_LARGE"), F.lit("TERM_REPEATED_VALUE")))
    found = word.groupBy(F.concat("term", F.lit(" "), F.col("p_size").cast("string")).alias("term")).agg(rules.alias("rules"), F.countDistinct("p_brand").alias("parents"), F.count("*").alias("exposure"))
    return D.evaluation_summary(D.repeated_values(found))


QUERIES = {f.__name__: f for f in (graph_diagnostics, node_edit_fold, ingest_log, relation_digests, guard_flags, keyword_extraction, state_transitions, trace_judgements, dictionary_entry_problems, dictionary_layer_views, snapshot_checks, snapshot_pins, snapshot_activation, vocabulary_tags, review_decisions, identity_differences, term_evaluation)}

_NODES = """
b AS (SELECT 'n' || c_custkey AS id, c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'n' || (c_custkey + 1000000) WHEN c_custkey % 3 = 0 THEN 'n' || ceil(c_custkey / 2)::BIGINT END AS parent, CASE WHEN c_custkey % 70 = 0 THEN 'none' ELSE 'doc' END AS doc, [c_mktsegment, 'N' || c_nationkey] AS tags FROM customer),
n AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE k % 50 = 0),
e AS (SELECT 'e' || CASE WHEN o_orderkey % 100 = 1 THEN o_orderkey // 2 ELSE o_orderkey END AS id, 'n' || o_custkey AS s, 'n' || (o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 5000000 ELSE 0 END) AS t, CASE WHEN o_orderkey % 5 % 2 = 1 THEN 'structural' ELSE 'semantic' END AS cat,
             ['related_to', 'contains', 'satisfied_by', 'belongs_to', 'unknown'][(o_orderkey % 5 + 1)::INT] AS kind, o_orderkey % 4 = 0 AS candidate, o_orderkey % 3 = 0 AS half, o_orderkey % 6 = 0 AS empty FROM orders),
l AS (SELECT event_id + CASE WHEN event_id % 1000 = 7 THEN 1 ELSE 0 END + 1 AS seq, ['ADD_TAG', 'REMOVE_TAG', 'UPDATE_NODE_TEXT', 'CHANGE_NODE_TYPE', 'REVIEW_HUMAN', 'RESET_REVIEW'][(event_id % 6 + 1)::INT] AS cmd, 'n' || user_id AS id, event_id % 97 = 0 AS changed, 't' || event_id % 9 AS value FROM events)"""
_GRAMS = "CASE WHEN length({0}) < 2 THEN CASE WHEN length({0}) = 0 THEN []::VARCHAR[] ELSE [{0}] END ELSE list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) END"
_STRIP = "replace(replace(replace(replace(replace(replace({0}, 'anodized', ''), 'polished', ''), 'brushed', ''), 'large', ''), 'small', ''), 'steel', '')"
_ENTRIES = """
x AS (SELECT p_brand AS dictionary_id, 'x' || (p_partkey - CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END) AS entry_id, p_name AS term, string_split(p_name, ' ') AS w, p_partkey AS k FROM part),
t AS (SELECT *, [w[1], w[2], CASE WHEN k % 6 = 0 THEN term WHEN k % 4 = 0 THEN w[1] ELSE w[len(w)] END] AS aliases, ['PROBATION', 'ACTIVE', 'OBSERVING', 'QUARANTINED', 'RETIRED', 'DRAFT'][(k % 6 + 1)::INT] AS status, ['SESSION', 'PROJECT', 'DOMAIN', 'STANDARD'][(k % 4 + 1)::INT] AS scope FROM x)"""
ORACLE_SQL = {
    "graph_diagnostics": f"""
WITH {_NODES},
d AS (
  SELECT 'duplicate_node_id' AS code, id FROM n GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'parent_node_not_found', id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'source_document_not_found', id FROM n WHERE doc = 'none'
  UNION ALL SELECT 'duplicate_edge_id', id FROM (SELECT id, row_number() OVER (PARTITION BY id) AS i FROM e) WHERE i > 1
  UNION ALL SELECT 'edge_source_not_found', id FROM e WHERE s NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'edge_target_not_found', id FROM e WHERE t NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'relation_category_mismatch', id FROM e WHERE cat IS DISTINCT FROM CASE kind WHEN 'related_to' THEN 'semantic' WHEN 'satisfied_by' THEN 'semantic' WHEN 'contains' THEN 'structural' WHEN 'belongs_to' THEN 'structural' END
  UNION ALL SELECT 'structural_lifecycle_invalid', id FROM e WHERE cat = 'structural' AND candidate
  UNION ALL SELECT 'structural_confidence_invalid', id FROM e WHERE cat = 'structural' AND half
  UNION ALL SELECT 'evidence_empty', id FROM e WHERE cat = 'semantic' AND empty
  UNION ALL SELECT 'operation_sequence_invalid', seq::VARCHAR FROM (SELECT seq, row_number() OVER (ORDER BY seq, id, cmd) AS i FROM l) WHERE seq <> i
  UNION ALL SELECT 'review_changed_hash', id FROM l WHERE cmd IN ('REVIEW_HUMAN', 'RESET_REVIEW') AND changed
  UNION ALL SELECT 'tag_not_in_vocabulary', id FROM (SELECT id, unnest(tags) AS tag FROM n) WHERE tag NOT IN ('BUILDING', 'MACHINERY') AND tag NOT IN (SELECT 'N' || n_nationkey FROM nation))
SELECT code, CASE WHEN code = 'tag_not_in_vocabulary' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n, min(id) AS least_target FROM d GROUP BY code""",
    "node_edit_fold": f"""
WITH {_NODES},
start AS (SELECT 'n' || c_custkey AS id, tag, true AS there, 0 AS seq FROM customer, (VALUES ('t1'), ('t3'), ('x')) v(tag)),
m AS (SELECT * FROM start UNION ALL SELECT id, value, cmd = 'ADD_TAG', seq FROM l WHERE cmd IN ('ADD_TAG', 'REMOVE_TAG')),
ch AS (SELECT *, seq > 0 AND there <> coalesce(lag(there) OVER (PARTITION BY id, tag ORDER BY seq), false) AS changed FROM m),
tg AS (SELECT id, tag, arg_max(there, seq) AS there, count(*) FILTER (changed) AS n FROM ch GROUP BY id, tag),
ta AS (SELECT id, string_agg(tag, ',' ORDER BY tag) FILTER (there) AS tags, sum(n) AS n FROM tg GROUP BY id),
p AS (SELECT id, arg_max(value, seq) FILTER (cmd = 'UPDATE_NODE_TEXT') AS text, arg_max(value, seq) FILTER (cmd = 'CHANGE_NODE_TYPE') AS type, count(*) FILTER (cmd IN ('UPDATE_NODE_TEXT', 'CHANGE_NODE_TYPE')) AS n FROM l GROUP BY id)
SELECT 'n' || c_custkey AS node_id, coalesce(p.text, c_name) AS text, coalesce(p.type, 'statement') AS node_type, coalesce(ta.tags, '') AS tags, (coalesce(p.n, 0) + coalesce(ta.n, 0))::BIGINT AS edits FROM customer LEFT JOIN p ON p.id = 'n' || c_custkey LEFT JOIN ta ON ta.id = 'n' || c_custkey""",
    "ingest_log": """
WITH r AS (SELECT 0 AS rank, printf('s%09d', s_suppkey) AS id FROM supplier UNION ALL SELECT 1, printf('o%09d', o_orderkey) FROM orders)
SELECT n_nationkey::BIGINT + 1 AS sequence, 'CREATE_NODE' AS command_type, 'node' AS target_kind, n_name AS target_id, NULL::VARCHAR AS before_hash, 'h' AS after_hash FROM nation
UNION ALL SELECT row_number() OVER (ORDER BY rank, id) + (SELECT max(n_nationkey) + 1 FROM nation), CASE rank WHEN 0 THEN 'CREATE_NODE' ELSE 'CREATE_EDGE' END, CASE rank WHEN 0 THEN 'node' ELSE 'edge' END, id, NULL, CASE rank WHEN 0 THEN 'a' ELSE 'b' END FROM r""",
    "relation_digests": """
SELECT o_orderkey, o_custkey, o_orderpriority, sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || ',' || length(o_custkey::VARCHAR) || ':' || o_custkey || ',' || length(o_orderpriority) || ':' || o_orderpriority || ',') AS relation_hash FROM orders""",
    "guard_flags": f"""
WITH p AS (SELECT x.p_partkey AS k, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(least(length(a), length(b)), 1) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1, least(length(a), length(b))) AS n, string_split(a, ' ')[1] AS h, ['anodized', 'polished', 'brushed', 'small', 'large', 'steel'] AS seg FROM p),
r AS (SELECT *, substr(a, n + 1) AS ra, substr(b, n + 1) AS rb, {_STRIP.format('a')} AS sa, {_STRIP.format('b')} AS sb, CASE WHEN starts_with(b, h) THEN substr(b, length(h) + 1) ELSE b END AS rest,
             list_filter(flatten(list_transform(string_split(a, ' '), lambda x: list_transform(string_split(b, ' '), lambda y: CASE WHEN contains(y, x) THEN x WHEN contains(x, y) THEN y END))), lambda t: t IS NOT NULL) AS hits FROM q)
SELECT k AS p_partkey, n::INT AS prefix, n >= 2 AND NOT list_has_any({_GRAMS.format('ra')}, {_GRAMS.format('rb')}) AS by_prefix,
       len(list_filter(seg, lambda s: contains(a, s) AND contains(b, s))) > 0 AND NOT list_has_any({_GRAMS.format('sa')}, {_GRAMS.format('sb')}) AS by_boilerplate,
       starts_with(b, h) AND (rest = '' OR rest[1] = ' ') AND contains(h, substr(a, 1, 3)) AND NOT contains(rest, substr(a, 1, 3)) AS in_heading,
       len(hits) > 0 AND len(list_filter(hits, lambda t: NOT list_contains(seg, t))) = 0 AS hit_is_boilerplate FROM r""",
    "keyword_extraction": """
WITH t AS (SELECT p_partkey AS k, p_name || '、' || p_brand || '/PX-' || p_partkey AS e FROM part),
m AS (SELECT *, list_distinct(list_concat([trim(e)], regexp_extract_all(e, '([A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*)', 1))) AS must0, list_concat(regexp_split_to_array(e, '[、。,，;；/／|]'), regexp_split_to_array(e, '[^\\p{L}\\p{N}_-]+')) AS opt FROM t),
o AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(list_filter(list_concat([trim(e)], regexp_extract_all(e, '([A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*)', 1)), lambda s: length(trim(s)) >= 2), lambda s: (list_position(list_concat([trim(e)], regexp_extract_all(e, '([A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*)', 1)), s), trim(s))))), lambda s: s[2]) AS must FROM m),
z AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(list_filter(opt, lambda s: length(trim(s)) >= 2 AND NOT list_contains(must, trim(s))), lambda s: (list_position(opt, s), trim(s))))), lambda s: s[2]) AS rest FROM o),
f AS (SELECT k, list_concat(must, rest[1:greatest(4 - len(must), 0)]) AS w FROM z)
SELECT k AS p_partkey, len(w)::INT AS n, array_to_string(w, '|') AS keywords FROM f""",
    "state_transitions": """
WITH a(f, t) AS (VALUES ('PROBATION', 'ACTIVE'), ('PROBATION', 'QUARANTINED'), ('PROBATION', 'RETIRED'), ('ACTIVE', 'OBSERVING'), ('ACTIVE', 'QUARANTINED'), ('ACTIVE', 'RETIRED'), ('OBSERVING', 'ACTIVE'), ('OBSERVING', 'QUARANTINED'), ('OBSERVING', 'RETIRED'), ('QUARANTINED', 'ACTIVE'), ('QUARANTINED', 'OBSERVING'), ('QUARANTINED', 'RETIRED')),
e AS (SELECT user_id, event_id, ([{STATES_SQL}])[(event_id * 7 % 6 + 1)::INT] AS s FROM events WHERE user_id IS NOT NULL),
l AS (SELECT lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS state, s AS "to" FROM e)
SELECT state, "to", count(*) AS n, any_value(a.f IS NOT NULL) AS allowed FROM l LEFT JOIN a ON a.f = l.state AND a.t = l."to" WHERE state IS NOT NULL GROUP BY 1, 2""".replace("{STATES_SQL}", ", ".join(f"'{x}'" for x in STATES)),
    "trace_judgements": """
WITH l AS (SELECT l_orderkey AS a_id, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'code' WHEN 2 THEN 'title_candidate' WHEN 3 THEN 'partial' WHEN 4 THEN 'none' WHEN 5 THEN '' END AS m, CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_discount END AS c FROM lineitem WHERE l_linenumber <= 2)
SELECT a_id, CASE WHEN bool_or(coalesce(m IN ('exact', 'code'), false)) THEN '対応あり' WHEN bool_or(coalesce(m IN ('title_candidate', 'partial'), false)) THEN '要確認' ELSE '未対応' END AS judgement,
       max(CASE WHEN m IS NOT NULL AND m <> 'title_candidate' THEN coalesce(c, 0) END) AS confidence, count(m) AS links FROM l GROUP BY 1""",
    "dictionary_entry_problems": f"""
WITH {_ENTRIES},
p AS (SELECT dictionary_id, entry_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY dictionary_id, entry_id) > 1 THEN 'entry_id_duplicate' END, CASE WHEN status = 'DRAFT' THEN 'status_unknown' END, CASE WHEN count(*) OVER (PARTITION BY dictionary_id, term) > 1 THEN 'canonical_term_duplicate' END,
             CASE WHEN len(list_distinct(aliases)) < 3 THEN 'alias_duplicate' END, CASE WHEN list_contains(aliases, term) THEN 'alias_is_canonical' END) AS problems FROM t)
SELECT * FROM p WHERE problems <> ''""",
    "dictionary_layer_views": f"""
WITH {_ENTRIES},
u AS (SELECT scope, term, unnest(list_distinct(list_concat([term], aliases))) AS lookup FROM t WHERE status = 'ACTIVE')
SELECT scope, lower(lookup) AS lookup, count(*) AS n, min(term) AS canonical FROM u GROUP BY 1, 2""",
    "snapshot_checks": """
SELECT 's' || o_orderkey AS snapshot_id, CASE WHEN o_orderkey % 9 = 0 THEN 'payload_hash' ELSE 'wrapper_hash' END AS problem FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 11 = 0""",
    "snapshot_pins": """
SELECT l_orderkey || '-' || l_linenumber AS project, CASE WHEN o_orderkey IS NULL THEN 'snapshot_missing' ELSE 'payload_changed' END AS problem
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + CASE WHEN l_linenumber = 6 THEN 9000000 ELSE 0 END WHERE o_orderkey IS NULL OR l_linenumber = 5""",
    "snapshot_activation": """
WITH t AS (SELECT user_id AS scope, event_id % 3 AS snapshot_id, arg_max(['ACTIVE', 'SUPERSEDED', 'ROLLED_BACK'][((event_id // 3) % 3 + 1)::INT], event_id) AS state FROM events GROUP BY 1, 2)
SELECT *, count(*) FILTER (state = 'ACTIVE') OVER (PARTITION BY scope) = 1 AS sound FROM t""",
    "vocabulary_tags": """
WITH v(tag, name) AS (VALUES ('metal', 'metal'), ('metal', 'steel'), ('metal', 'brass'), ('metal', 'copper'), ('metal', 'tin'), ('metal', 'nickel'), ('polished', 'polished'), ('polished', 'burnished'), ('small', 'small'), ('STANDARD', 'STANDARD'), ('STANDARD', 'standard')),
w AS (SELECT p_partkey AS id, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part),
b AS (SELECT DISTINCT id, 'folded' AS form, tag FROM w JOIN v ON lower(word) = lower(name) UNION SELECT DISTINCT id, 'exact', tag FROM w JOIN v ON word = name)
SELECT id, form, string_agg(tag, ',' ORDER BY tag) AS tags FROM b GROUP BY 1, 2""",
    "review_decisions": """
WITH d AS (SELECT l_partkey AS id, arg_max(CASE l_returnflag WHEN 'A' THEN 'ACCEPT' WHEN 'R' THEN 'UNCERTAIN' ELSE 'UNREVIEWED' END, l_orderkey * 10 + l_linenumber) AS decision FROM lineitem GROUP BY 1)
SELECT CASE WHEN p_size > 40 THEN 'REJECT' ELSE coalesce(decision, 'UNREVIEWED') END AS decision, count(*) AS n FROM part LEFT JOIN d ON id = p_partkey GROUP BY 1""",
    "identity_differences": """
WITH r AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 50 <> 0), e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 70 <> 0)
SELECT CASE WHEN e.id IS NULL THEN 'evaluated' ELSE 'reviewed' END AS missing_in, count(*) AS n, sum(coalesce(r.id, e.id))::BIGINT AS ids FROM r FULL JOIN e ON r.id = e.id WHERE r.id IS NULL OR e.id IS NULL GROUP BY 1""",
    "term_evaluation": """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) || ' ' || p_size AS term, p_brand, p_size FROM part),
c AS (SELECT term, max(p_size) > 45 AS large, count(DISTINCT p_brand) AS parents, count(*) AS exposure FROM w GROUP BY 1),
k AS (SELECT * FROM c WHERE large OR parents >= 2)
SELECT 'TERM_LARGE' AS rule, count(*) AS candidates, sum(exposure)::BIGINT AS exposure FROM k WHERE large HAVING count(*) > 0 UNION ALL SELECT 'TERM_REPEATED_VALUE', count(*), sum(exposure)::BIGINT FROM k UNION ALL SELECT NULL, count(*), sum(exposure)::BIGINT FROM k""",
}

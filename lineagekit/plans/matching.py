"""Queries on the matcher as a whole: keywords, guards, best of each pair, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matcher as M
from ..session import read, rounded


def _links(found):
    return found.select("a_id", "b_id", "method", rounded(F.col("confidence")).alias("confidence"), "keyword", F.col("pair").cast("int").alias("pair"))


def matched_passages(spark, sf_dir):
    """Benchmark items linked with documents that hold a phrase of theirs which tells rows apart."""
    side = lambda name, key: read(spark, sf_dir, name).select(F.col(key).cast("string").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("fields"))
    return _links(M.match(side("benchmark", "item_id"), side("documents", "doc_id"), [M.KeyPair("text", "text", "contains")]))


def matched_parts(spark, sf_dir):
    """Parts of either parity by their reference codes, labels and sizes: an identity takes a row's generic links away."""
    part = read(spark, sf_dir, "part")
    ref = lambda lead, n: F.when(F.col("p_partkey") % n != 0, F.concat(F.lit(lead), F.floor(F.col("p_partkey") / 2).cast("string")))

    def side(parity, lead, n):
        label = F.concat_ws("/", "p_name", F.regexp_replace("p_brand", "#", "-"), F.col("p_size").cast("string"))
        fields = F.create_map(F.lit("ref"), ref(lead, n), F.lit("label"), label, F.lit("kind"), F.concat_ws(" ", "p_type", "p_name"))
        return part.where(F.col("p_partkey") % 2 == parity).select(F.col("p_partkey").cast("string").alias("id"), fields.alias("fields"))

    pairs = [M.KeyPair("ref", "ref", "code"), M.KeyPair("label", "label", "contains"), M.KeyPair("kind", "kind", "exact"), M.KeyPair("kind", "label", "contains", False)]
    return _links(M.match(side(0, "for P-", 6), side(1, "item no. P-", 5), pairs))


def segment_discrimination(spark, sf_dir):
    """Sentences of the benchmark's items by how many documents hold them as a line and anywhere in the text."""
    asked = read(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.split("text", r"[.\n]"), lambda x: F.trim(x))).alias("segment"))
    rows = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("value"), F.split("text", "\n").alias("segments"))
    return M.discrimination(asked, rows, ratio=0.01)


QUERIES = {f.__name__: f for f in (matched_passages, matched_parts, segment_discrimination)}

_NORM = "regexp_replace(lower(translate({0}, '‐‑‒–—―−〜～', '-------~~')), '\\s+', '', 'g')"
_CODES = "regexp_extract_all({0}, '[A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*')"


def _sql(av: str, bv: str, modes: str) -> str:
    """Brute force over all keywords and values of the exact, contains and code methods; ``av``, ``bv``: pair, id, raw."""
    norm = _NORM.format
    return f"""
WITH modes(pair, mode) AS (VALUES {modes}), av0 AS ({av}), bv0 AS ({bv}),
av AS (SELECT pair, id, raw, {norm('raw')} AS v FROM av0 WHERE trim(raw) <> '' AND {norm('raw')} <> ''),
bv AS (SELECT pair, id, raw, {norm('raw')} AS v FROM bv0 WHERE trim(raw) <> '' AND {norm('raw')} <> ''),
k0 AS (SELECT pair, id, 0 AS grp, 0 AS kind, 0::BIGINT AS i, raw AS t FROM av
  UNION ALL SELECT pair, id, 0, 1, unnest(range(len({_CODES.format('raw')}))), unnest({_CODES.format('raw')}) FROM av
  UNION ALL SELECT pair, id, 1, 2, unnest(range(len(regexp_split_to_array(raw, '[、。,，;；/／|\\n]')))), unnest(regexp_split_to_array(raw, '[、。,，;；/／|\\n]')) FROM av
  UNION ALL SELECT pair, id, 1, 3, unnest(range(len(regexp_split_to_array(raw, '[^\\p{{L}}\\p{{N}}_-]+')))), unnest(regexp_split_to_array(raw, '[^\\p{{L}}\\p{{N}}_-]+')) FROM av),
k1 AS (SELECT pair, id, grp, kind, trim(t) AS t, min(i) AS i FROM k0 WHERE length(trim(t)) >= 2 GROUP BY pair, id, grp, kind, trim(t)),
k2 AS (SELECT * FROM k1 x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k1 y WHERE y.kind = 2 AND y.pair = x.pair AND y.id = x.id AND y.t = x.t)),
k3 AS (SELECT *, row_number() OVER (PARTITION BY pair, id, grp ORDER BY kind, i) AS rn, count(*) FILTER (grp = 0) OVER (PARTITION BY pair, id) AS must FROM k2),
k4 AS (SELECT pair, id, kind, t, {norm('t')} AS k, rn + CASE WHEN grp = 1 THEN must ELSE 0 END - 1 AS entry FROM k3 WHERE grp = 0 OR rn <= greatest(20 - must, 0)),
k AS (SELECT k4.*, av.v AS parent, av.raw AS parent_raw, k4.k = av.v AS whole FROM k4 JOIN av USING (pair, id) WHERE k4.k <> ''),
-- how many rows of a side contain a text or hold it as their value
u AS (SELECT DISTINCT pair, k FROM k WHERE length(k) >= 2),
low AS (SELECT pair, k FROM u WHERE (SELECT count(*) FROM bv WHERE bv.pair = u.pair AND contains(bv.v, u.k)) > 1 UNION SELECT pair, k FROM u WHERE (SELECT count(*) FROM av WHERE av.pair = u.pair AND contains(av.v, u.k)) > 1),
shared AS (SELECT pair, v FROM av GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT pair, v FROM bv GROUP BY 1, 2 HAVING count(*) > 1),
kt AS (SELECT *, list_transform({_CODES.format('t')}, lambda x: {norm('x')}) AS ta FROM k),
bt AS (SELECT *, list_transform({_CODES.format('raw')}, lambda x: {norm('x')}) AS tb FROM bv),
h AS (SELECT mode, a.*, b.id AS b_id, b.v AS bv, b.raw AS b_raw, a.k = b.v AS equal,
    a.k = b.v OR (length(a.k) >= 2 AND contains(b.v, a.k)) OR (length(b.v) >= 2 AND contains(a.k, b.v)) AS held,
    mode = 'code' AND len(list_filter(a.ta, lambda x: contains(b.v, x) OR len(list_filter(b.tb, lambda y: contains(y, x) OR contains(x, y))) > 0)) > 0 AS code
  FROM kt a JOIN bt b ON b.pair = a.pair JOIN modes m ON m.pair = a.pair),
j AS (SELECT *, kind = 1 OR (kind = 0 AND list_contains(ta, k)) AS structured, NOT whole AND kind > 0 AND EXISTS (SELECT 1 FROM low WHERE low.pair = h.pair AND low.k = h.k) AS generic,
    CASE WHEN kind >= 2 AND NOT whole AND left(parent, 2) = left(bv, 2) THEN len(list_filter(range(1, least(length(parent), length(bv)) + 1), lambda i: left(parent, i::INT) = left(bv, i::INT))) ELSE 0 END AS n FROM h WHERE held OR code),
r AS (SELECT *, CASE WHEN equal AND NOT EXISTS (SELECT 1 FROM shared s WHERE s.pair = j.pair AND s.v = j.k) THEN 1.0
    WHEN mode = 'code' AND structured THEN 0.9
    WHEN mode = 'contains' AND kind > 0 AND NOT equal AND NOT generic AND NOT (n >= 2 AND contains(parent, k) AND length(parent) - instr(reverse(parent), reverse(k)) + 1 <= n
      AND length(parent) > n AND length(bv) > n AND NOT list_has_any(list_transform(range(n + 1, greatest(n + 2, length(parent))), lambda i: substr(parent, i::INT, 2)), list_transform(range(n + 1, greatest(n + 2, length(bv))), lambda i: substr(bv, i::INT, 2)))
      AND regexp_matches(regexp_extract(parent_raw, '^(?:\\s*\\S){{' || greatest(n - 1, 0) || '}}\\s*(\\S.?)', 1), '[\\s:：|/／・、。,，;；()（）\\-－_]') AND regexp_matches(regexp_extract(b_raw, '^(?:\\s*\\S){{' || greatest(n - 1, 0) || '}}\\s*(\\S.?)', 1), '[\\s:：|/／・、。,，;；()（）\\-－_]')) THEN 0.7 END AS score FROM j),
best AS (SELECT id AS a_id, b_id, max(score) AS confidence, max(score) FILTER (structured) AS structured_score, arg_max({{'m': CASE WHEN score = 1 THEN 'exact' WHEN score = 0.9 THEN 'code' ELSE 'partial' END, 't': t, 'k': k, 'p': pair, 's': structured}}, (score, -pair, -entry)) AS w FROM r WHERE score IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, w.m <> 'partial' AS strong, w.m <> 'partial' OR w.s OR coalesce(structured_score, 0) >= 0.7 AS identity FROM best)
SELECT a_id, b_id, w.m AS method, confidence::DOUBLE AS confidence, w.t AS keyword, w.p::INT AS pair FROM f
WHERE strong OR (NOT EXISTS (SELECT 1 FROM f o WHERE o.a_id = f.a_id AND o.strong AND o.w.k = f.w.k) AND (identity OR NOT EXISTS (SELECT 1 FROM f o WHERE o.a_id = f.a_id AND o.identity)))"""


_PART = """SELECT 0 AS pair, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % {1} <> 0 THEN '{2}' || (p_partkey // 2) END AS raw FROM part WHERE p_partkey % 2 = {0}
  UNION ALL SELECT 1, p_partkey::VARCHAR, concat_ws('/', p_name, replace(p_brand, '#', '-'), p_size::VARCHAR) FROM part WHERE p_partkey % 2 = {0}
  UNION ALL SELECT 2, p_partkey::VARCHAR, concat_ws(' ', p_type, p_name) FROM part WHERE p_partkey % 2 = {0}"""
ORACLE_SQL = {
    "segment_discrimination": """
WITH q AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(text, '[.\\n]'))) AS segment FROM benchmark), t AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT segment, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment FROM documents) GROUP BY 1),
c AS (SELECT segment, (SELECT count(*) FROM documents d WHERE contains(d.text, q.segment)) AS n FROM q WHERE segment <> '')
SELECT c.segment, coalesce(l.n, 0) AS extracted, c.n AS containing, t.n >= 3 AND coalesce(l.n, 0) / t.n >= 0.01 AS is_boilerplate, (t.n >= 3 AND coalesce(l.n, 0) / t.n >= 0.01) OR (t.n >= 2 AND c.n > 1) AS low_discrimination
FROM c LEFT JOIN l ON l.segment = c.segment, t""",
    "matched_passages": _sql("SELECT 0 AS pair, item_id::VARCHAR AS id, text AS raw FROM benchmark", "SELECT 0 AS pair, doc_id::VARCHAR AS id, text AS raw FROM documents", "(0, 'contains')"),
    "matched_parts": _sql(_PART.format(0, 6, "for P-"), _PART.format(1, 5, "item no. P-"), "(0, 'code'), (1, 'contains'), (2, 'exact')"),
}

"""Operators on small fixtures."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from lineagekit.functions import intervals as I
from lineagekit.functions import text as T
from lineagekit.operators import dictionary as D
from lineagekit.operators import linkage as L
from lineagekit.operators import profile as P
from lineagekit.operators import review as R
from lineagekit.operators import structure as S
from lineagekit.sources import trace_json


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    row = one(
        spark, T.set_dice(T.grams(F.lit("aaaa")), T.grams(F.lit("aaa"))), T.netstring(F.lit("é")), T.column_letter(F.lit(1)), T.column_letter(F.lit(28)), T.column_letter(F.lit(703)),
        T.identity("n", F.lit("a"), F.lit(1)), T.narrowed(F.lit("Ａ－１〜2")), T.comparison_key(F.lit(" ÉAb ")), T.nfkc(F.lit("ﾃ㍉")), T.canonical_timestamp(F.lit("2024-02-30T00:00:00.000Z")), T.grams(F.lit("x")),
    )
    assert row[0] == 1.0 and row[1] == "2:é," and tuple(row[2:5]) == ("A", "AB", "AAA")
    assert row[5] == "n-" + hashlib.sha256(b"n\x00a\x001").hexdigest()[:32]
    assert row[6] == "A－1~2".replace("－", "-") and row[7] == "Éab" and row[8] == "テミリ" and row[9] is False and row[10] == ["x"]


def test_excel_dates(spark):
    days = [1.0, 59.0, 60.0, 61.0, 45000.5]
    got = [one(spark, T.excel_date(F.lit(d)).cast("string"))[0] for d in days]
    assert got == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", None, "1900-03-01 00:00:00", "2023-03-15 12:00:00"]


ENDS = [(None, True), (1.0, True), (1.0, False), (2.0, True), (2.0, False)]


def test_interval_coverage_truth_table(spark):
    cases = [(a, ai, b, bi) for (a, ai), (b, bi) in itertools.product(ENDS, ENDS)]
    df = spark.createDataFrame(cases, "ol double, oi boolean, il double, ii boolean")
    o, i = I.interval(F.col("ol"), F.lit(None), F.col("oi")), I.interval(F.col("il"), F.lit(None), F.col("ii"))
    up_o, up_i = I.interval(F.lit(None), -F.col("ol"), True, F.col("oi")), I.interval(F.lit(None), -F.col("il"), True, F.col("ii"))
    out = df.select("*", o.alias("o"), i.alias("i"), up_o.alias("p"), up_i.alias("q")).select("ol", "oi", "il", "ii", I.coverage(F.col("o"), F.col("i"))["holds"].alias("h"), I.coverage(F.col("p"), F.col("q"))["holds"].alias("g"))
    for ol, oi, il, ii, h, g in map(tuple, out.collect()):
        want = ol is None or (il is not None and (ol < il or (ol == il and (oi or not ii))))
        assert (h, g) == (want, want), (ol, oi, il, ii)


def test_structure_and_conversion(spark):
    x = lambda lo, hi, a=True, b=True: I.interval(F.lit(lo), F.lit(hi), a, b)
    reason = lambda v: one(spark, I.structure_reason(F.lit("interval"), v))[0]
    assert [reason(x(1.0, 2.0)), reason(x(2.0, 1.0)), reason(x(1.0, 1.0, True, False)), reason(x(None, None)), reason(x(float("inf"), None))] == [None, "empty_interval", "empty_interval", "no_bounds", "non_finite"]
    bad = I.structure_reason(F.lit("alternatives"), x(1.0, 1.0), F.array(F.lit(1.0), F.lit(1.0)))
    assert one(spark, bad)[0] == "repeated_options"
    got = one(spark, I.converted(F.lit(2.0), F.lit(1000.0)), I.converted(F.lit(1e308), F.lit(1e10)))
    assert got[0]["value"] == 2000.0 and got[1]["problem"] == "non_finite"


def test_exact_suppresses_common_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None), (5, "")], "id long, value string")
    b = spark.createDataFrame([(10, "x"), (11, "y"), (12, None), (13, "")], "id long, value string")
    assert [tuple(r) for r in L.exact_unique(a, b).collect()] == [(1, 10, "exact", 1.0)]
    title = L.exact_unique(a, b, method="title_candidate").first()
    assert title["confidence"] is None


def test_contained_with_cut_words(spark):
    a = spark.createDataFrame([(1, "re middle wor"), (2, "zz"), (3, "q")], "id long, value string")
    b = spark.createDataFrame([(7, "more middle words"), (8, "a zzz b"), (9, None)], "id long, value string")
    assert sorted((r.a_id, r.b_id) for r in L.contained(a, b).collect()) == [(1, 7), (2, 8)]


def test_similar_sets_against_brute_force(spark):
    words = ["abcdef", "abcdeg", "abcxyz", "zzzz", "bcdefg", "abcdefg", "aa", "aab", ""]
    rows = spark.createDataFrame([(w,) for w in words], "id string").select("id", T.grams(F.col("id")).alias("grams"))
    grams = lambda w: {w[i : i + 2] for i in range(max(1, len(w) - 1))} if w else set()
    want = sorted((a, b) for a in words for b in words if a < b and grams(a) and grams(b) and 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))) >= 0.75)
    assert sorted((r.x, r.y) for r in L.similar_sets(rows).collect()) == want


def test_hierarchy_scope_and_decisions(spark):
    matches = spark.createDataFrame([(1, 5, "exact", 1.0), (1, 50, "partial", 0.7), (2, 50, "partial", 0.7)], "a_id long, b_id long, method string, confidence double")
    parents = spark.createDataFrame([(5, 50)], "child_id long, parent_id long")
    assert sorted(map(tuple, L.hierarchy_gate(matches, parents).collect())) == [(1, 5, "exact", 1.0), (1, 50, "hier", 0.72), (2, 50, "partial", 0.7)]
    kept = L.structured_dominance(matches).collect()
    assert sorted((r.a_id, r.b_id) for r in kept) == [(1, 5), (2, 50)]
    ag, bg = spark.createDataFrame([(1, "g"), (2, "g")], "id long, g string"), spark.createDataFrame([(5, "x"), (50, "x")], "id long, g string")
    scope = spark.createDataFrame([("g", "x", "excluded")], "a_group string, b_group string, state string")
    assert [(r.a_id, r.exception) for r in L.scoped(matches, ag, bg, scope).collect()] == [(1, True)]
    decided = spark.createDataFrame([(1, 5, "exclude", 1), (9, 9, "link", 1), (2, 50, "exclude", 1), (2, 50, "keep", 2)], "a_id long, b_id long, decision string, seq long")
    assert sorted((r.a_id, r.b_id, r.method) for r in L.effective(matches, decided).collect()) == [(1, 50, "partial"), (2, 50, "partial"), (9, 9, "manual")]


def test_near_ties(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.88), (1, 3, 0.76), (2, 1, 0.9)], "a_id long, b_id long, similarity double")
    got = {(r.a_id, r.b_id): r.ambiguous for r in L.near_ties(pairs).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (2, 1): False}


def test_dictionary(spark):
    entries = spark.createDataFrame([("Pump", ["p", "unit"], "PROJECT", "ACTIVE"), ("Valve", ["unit"], "PROJECT", "ACTIVE"), ("Tank", ["p"], "STANDARD", "ACTIVE"), ("Old", ["x"], "PROJECT", "RETIRED")], "canonical string, aliases array<string>, scope string, status string")
    keys = D.lookup_keys(entries)
    assert [(r.key, r.canonicals) for r in D.conflicts(keys).collect()] == [("unit", 2)]
    merged = {r.key: (r.canonical, r.scope) for r in D.merged_layers(keys).collect()}
    assert merged["p"] == ("Pump", "PROJECT") and "unit" not in merged and "x" not in merged
    terms = spark.createDataFrame([(1, "PUMP "), (2, "unit"), (3, "x")], "id long, term string")
    assert {r.id: r.status for r in D.resolve(terms, keys).collect()} == {1: "canonical", 2: "conflict", 3: "unknown"}
    up = D.materialized(entries.select("canonical", "aliases"), spark.createDataFrame([("pump", ["z"]), ("New", ["n"])], "canonical string, aliases array<string>"))
    assert {r.canonical: (r.aliases, r.change) for r in up.collect()}["Pump"] == (["p", "unit", "z"], "merged")
    snaps = spark.createDataFrame([("a", 1, None), ("b", 2, "a"), ("c", 2, "b"), ("d", 3, "zz")], "snapshot_id string, version long, supersedes string")
    assert {r.snapshot_id: r.problem for r in D.history_problems(snaps).collect()} == {"c": "not_lower", "d": "missing"}
    pairs = list(itertools.product([*D.STATES, None], repeat=2))
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(D.allowed_transition("a", "b")).collect()]
    want = {f"{a}>{b}" for a, bs in (("PROBATION", ("ACTIVE", "QUARANTINED", "RETIRED")), ("ACTIVE", ("OBSERVING", "QUARANTINED", "RETIRED")), ("OBSERVING", ("ACTIVE", "QUARANTINED", "RETIRED")), ("QUARANTINED", ("ACTIVE", "OBSERVING", "RETIRED"))) for b in bs}
    assert {f"{a}>{b}" for (a, b), ok in zip(pairs, got) if ok} == want and len(want) == 12
    assert one(spark, D.next_version(F.lit("99999999999999999999")))[0] == "100000000000000000000"


UP = ["quantity_extraction", "property_mapping", "interval_semantics", "comparison_mode"]


def after(*actions, comparisons=("c1", "c2")):
    """A session after actions (action, comparison, target, verdict)."""
    session = R.Session(list(comparisons))
    for a in actions:
        session.apply(*a, *[None] * (4 - len(a)))
    return session


def test_review_session():
    accept = [("accept_review_target", "c1", t, "accept") for t in UP]
    s = after()
    assert s.comparisons["c1"]["satisfaction"] == ("not_eligible", None) and (s.revision, s.status) == (0, "active")
    s = after(*accept)
    assert s.comparisons["c1"]["satisfaction"] == ("unreviewed", None) and s.revision == 4 and s.comparisons["c2"] == R.Session.initial()
    # an accept of what is accepted, an unknown target or comparison, another verdict: refused
    assert after(accept[0], accept[0]).refused == 1 and after(("accept_review_target", "c9", UP[0], "accept"), ("accept_review_target", "c1", "x", "accept"), ("accept_review_target", "c1", UP[0], "override_satisfied")).refused == 3
    review = ("review_satisfaction", "c1", None, "override_satisfied")
    assert after(*accept[:3], review).refused == 1
    s = after(*accept, review)
    assert s.comparisons["c1"]["satisfaction"] == ("reviewed", "override_satisfied") and after(*accept, review, review).refused == 1
    # a reset above takes satisfaction back; resets of what isn't set change nothing and aren't refused
    s = after(*accept, review, ("reset_review_target", "c1", UP[2]))
    assert s.comparisons["c1"]["satisfaction"] == ("not_eligible", None) and s.comparisons["c1"][UP[2]] == ("unreviewed", None) and s.revision == 6
    s = after(*accept, review, ("reset_review_target", "c1", "satisfaction"), ("reset_review_target", "c1", "satisfaction"))
    assert s.comparisons["c1"]["satisfaction"] == ("unreviewed", None) and (s.revision, s.refused) == (6, 0)
    s = after(accept[0], ("invalidate_review_session",), ("invalidate_review_session",), accept[1])
    assert (s.status, s.revision, s.refused) == ("stale", 2, 1) and s.comparisons["c1"][UP[0]] == ("reviewed", "accept")
    s = after(accept[0], ("invalidate_review_session",), ("discard_review_session",), accept[1])
    assert s.status == "ended" and s.rows(1) == [] and s.refused == 1


def test_review_fold_and_stream(spark, tmp_path):
    import random

    from lineagekit.streaming import reviews

    r, rows = random.Random(3), []
    for s in range(6):
        rows += [(s, reviews.START, c, None, None) for c in ("c1", "c2")]
    for i in range(400):
        action = r.choice(["accept_review_target"] * 6 + ["reset_review_target", "review_satisfaction"] + ["invalidate_review_session"] * (i > 300) + ["discard_review_session"] * (i > 380))
        target = r.choice([*UP, "satisfaction"]) if action.startswith("reset") else r.choice(UP)
        rows.append((r.randrange(6), action, r.choice(["c1", "c2", "c2", "c3"]), target, "accept"))
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "session_id long, action string, comparison_id string, target string, verdict string, event_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    started = df.where(F.col("action") == reviews.START)
    got = {(x.session_id, x.comparison_id, x.target): tuple(x)[3:] for x in R.fold(df.where(F.col("action") != reviews.START).withColumn("seq", F.col("event_id")), started.select("session_id", "comparison_id")).collect()}
    want = {}
    for s in range(6):
        session = after(*[x[1:] for x in rows if x[0] == s and x[1] != reviews.START])
        want |= {row[:3]: row[3:] for row in session.rows(s)}
    assert got == want and want
    for k in range(2):
        df.where(f"event_id >= {k * 200} and event_id < {k * 200 + 300}" if k else "event_id < 200").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = reviews.folded(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    seen = {}

    def keep(batch, _):
        for x in batch.collect():
            seen[x.session_id, x.comparison_id, x.target] = tuple(x)[3:]

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {k: seen[k] for k in got} == got


def test_comparison_edges(spark):
    from lineagekit.operators import comparison as C

    none, inf = F.lit(None).cast("array<double>"), float("inf")
    rows = [(1, "interval", 1.0, 2.0, None, 2.0, 0.0), (2, "interval", 1.0, float("nan"), None, 1.0, 0.0), (3, "interval", None, None, None, 1.0, 0.0), (4, "alternatives", None, None, [1.0, 2.0], 3.0, 1.0), (5, "alternatives", None, None, [], 1.0, 0.0), (6, "other", 1.0, 2.0, None, 1.0, 0.0), (7, "interval", 1.0, 2.0, None, inf, 0.0), (8, "interval", 1e308, 1.5e308, None, 10.0, 0.0), (9, "interval", 1.0, 1.0 + 1e-15, None, 1.0, 1e17), (10, "alternatives", None, None, [float(i) for i in range(65)], 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, kind string, lo double, hi double, options array<double>, f double, o double").withColumn("q", F.struct("kind", I.interval(F.col("lo"), F.col("hi")).alias("interval"), "options"))
    out = {r.id: r.m for r in df.select("id", C.linear(F.col("q"), F.col("f"), F.col("o")).alias("m")).collect()}
    assert {i: m.reason for i, m in out.items()} == {1: None, 2: "quantity_value_invalid", 3: "quantity_value_empty", 4: None, 5: "quantity_value_empty", 6: "quantity_value_kind_unsupported", 7: "quantity_conversion_plan_invalid", 8: "quantity_conversion_non_finite", 9: "quantity_conversion_precision_loss", 10: "quantity_value_limit_exceeded"}
    assert (out[1].value.interval.lower, out[1].value.interval.upper, out[4].value.options) == (2.0, 4.0, [4.0, 7.0])
    records = spark.createDataFrame([("r", "a", "q1", "q2", "m", "n", 1.0, 2.0, 3.0, True, True), ("r", "a", "q1", "q3", "m", "n", 1.0, 2.0, 9.0, False, None)], "requirement_trace_id string, actual_trace_id string, requirement_quantity_id string, actual_quantity_id string, matcher_a_id string, matcher_b_id string, lo double, al double, delta double, applicable boolean, satisfied boolean")
    x = lambda c: F.struct(F.struct(F.col(c).alias("lower"), F.lit(None).cast("double").alias("upper")).alias("interval"))
    made = C.record_set(records.withColumn("requirement", x("lo")).withColumn("normalized", x("al")).withColumn("auto_applicable", F.col("applicable")).withColumn("state", F.when(F.col("applicable"), "satisfied").otherwise("needs_confirmation")).withColumn("comparison", F.struct(F.lit(True).alias("holds"), F.when(F.col("delta") == 3.0, 1.0).otherwise(F.col("delta")).alias("lower_delta"), F.lit(None).cast("double").alias("upper_delta"))))
    assert [r.problems for r in made.collect()] == [[], []] and {r.quantity_pair_id: r.differences for r in C.recomputed(made).collect()} == {"q1::q3": ["lower_delta"]}
    assert C.ready(made, F.size("problems") > 0).first()["ready"] and none is not None


def test_semantics_edges(spark):
    from lineagekit.operators import semantics as M

    point, empty = I.interval(F.lit(5.0), F.lit(5.0)), I.interval(F.lit(None), F.lit(None))
    row = one(
        spark, M.interval_semantics(F.lit("B"), F.lit("実測25℃"), point), M.interval_semantics(F.lit("B"), F.lit("実測ではない25℃"), point), M.interval_semantics(F.lit("A"), F.lit(None).cast("string"), empty), M.interval_semantics(F.lit("C"), F.lit("x"), point),
        M.interval_semantics(F.lit("B"), F.lit("試験"), point, is_condition=F.lit(True)), M.role(F.lit("B"), F.lit(M.RESULT_COLUMN), F.lit(False)), M.role(F.lit("A"), F.lit(None), F.lit(True)),
    )
    assert [(c.value, round(c.confidence, 6)) for c in row[0]] == [("achieved_point", 0.7), ("unknown", 0.15)]
    assert [(c.value, round(c.confidence, 6)) for c in row[1]] == [("achieved_point", 0.3), ("unknown", 0.15)]
    assert [c.value for c in row[2]] == ["unknown"] and [c.value for c in row[3]] == ["unknown"] and row[4][0].value == "test_condition"
    assert (row[5].role, row[6].role) == ("resolved_design", "condition")
    bad = spark.createDataFrame([([("achieved_point", 1.5, False), ("achieved_point", 0.1, False), ("made_up", 0.2, False)],)], "c array<struct<value string, confidence double, opposed boolean>>")
    assert bad.select(M.candidate_problems(F.col("c"))).first()[0] == ["duplicate_value", "unknown_value", "confidence_out_of_range"]
    texts = spark.createDataFrame([("規格値12kW、試験の結果、12.5kW", "12.5kW"), ("電圧1,000V、2,000V", "2,000V"), ("x", ""), (None, "y")], "t string, p string")
    assert [r[0] for r in texts.select(M.local_clause("t", "p")).collect()] == ["試験の結果、12.5kW", "2,000V", "x", ""]
    numbered = M.occurrence_index(spark.createDataFrame([(1, "a", 0), (1, "a", 9), (1, "b", 3)], "r long, t string, s long"), ["r"], "t", "s")
    assert sorted((r.s, r.occurrence_index) for r in numbered.collect()) == [(0, 0), (3, 0), (9, 1)]


def test_graph_helpers(spark):
    from lineagekit.operators import graph as G

    got = G.numbered(spark.range(1000).repartition(7).select((F.col("id") * 7919 % 1000).alias("k")), ["k"]).collect()
    assert all(r.number == r.k + 1 for r in got) and len(got) == 1000
    flat = G.flattened(spark.createDataFrame([((1, (2, [3])), {"a": 1})], "x struct<y long, z struct<w long, v array<long>>>, m map<string,long>"))
    assert flat.columns == ["x.y", "x.z.w", "x.z.v", "m"] and tuple(flat.first()) == (1, 2, "[3]", '{"a":1}')
    a, b = spark.range(3).toDF("id"), spark.range(1, 4).toDF("id")
    assert sorted((r.id, r.side) for r in G.set_differences(a, b).collect()) == [(0, "a"), (3, "b")]
    assert G.all_diagnostics([a, b.withColumn("z", F.lit(1))]).count() == 6
    assert {r.id: r.n for r in G.repeated(a.union(b), "id").collect()} == {1: 2, 2: 2}


def test_binding_sampling_and_gates(spark):
    a, r = spark.createDataFrame([(1, "h"), (2, "x"), (4, "h")], "id long, hash string"), spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "id long, hash string")
    assert {x.id: x.status for x in R.bound(a, r).collect()} == {1: "bound", 2: "stale", 3: "unparsed", 4: "missing"}
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).alias("s"), F.when(F.col("id") < 5, "tiny").otherwise("big").alias("t"))
    assert R.stratified_sample(df, ["t", "s"], ["id"], 100).count() == 100
    assert one(spark, R.gates({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}))[0] == ["b", "c"]
    assert R.sequence_problems(spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "k long, s long"), "k", "s").count() == 1


def test_sheets(spark):
    cells = spark.createDataFrame([("s", 1, 1, "Report"), ("s", 3, 1, "id"), ("s", 3, 2, "name"), ("s", 3, 3, "name"), ("s", 3, 4, None), ("s", 5, 1, "1"), ("s", 5, 2, "a"), ("s", 5, 3, "b"), ("s", 5, 4, "c")], "sheet string, r int, c int, v string")
    head = S.header_rows(cells)
    assert tuple(head.first()) == ("s", 3, "high", 5)
    assert S.records(cells, head).first()["record"] == {"id": "1", "name": "a", "name(C)": "b", "D": "c"}
    box = S.meaningful_range(cells).first()
    assert (box["top"], box["bottom"], box["left"], box["right"], box["cells"]) == (1, 5, 1, 4, 8)


def test_trace_json(spark, tmp_path):
    envelope = {"schema_version": "1", "_trace_records": [{"trace_id": "T1", "trace_title": "a", "trace_content": ["x", "y"], "source_section_id": "s1", "source_section_title": "One", "source_raw_text": "r", "tags": ["k"], "unknown": 5}, {"trace_id": "T2", "trace_text": "b", "source_section_id": "s1", "source_raw_text": "q"}]}
    (tmp_path / "a.json").write_text(json.dumps(envelope))
    (tmp_path / "b.json").write_text(json.dumps([{"trace_id": "U1", "source_record": {"col": "v"}}]))
    rows = trace_json.read_trace_json(spark, str(tmp_path))
    assert sorted((r.trace_id, r.schema_version, r.ordinal) for r in rows.collect()) == [("T1", "1", 0), ("T2", "1", 1), ("U1", None, 0)]
    nodes = trace_json.nodes(rows)
    got = sorted((r.node_type, r.text or "", r.producer) for r in nodes.collect())
    assert got == [("content", "", "excel"), ("content", "b", "pdf"), ("content", "x\ny", "pdf"), ("section", "", "excel"), ("section", "", "pdf")]
    assert trace_json.contains_edges(nodes).count() == 3
    found = {r.file.rsplit("/", 1)[1]: (r.producer, r.records, r.sections, len(r.digest)) for r in trace_json.documents(rows).collect()}
    assert found == {"a.json": ("pdf", 2, 1, 64), "b.json": ("excel", 1, 0, 64)}
    odd = rows.withColumn("source_record", F.lit(None).cast("map<string,string>")).withColumn("trace_id", F.when(F.col("trace_id") != "T2", F.col("trace_id")))
    files = spark.createDataFrame([("nothing.json",)], "file string")
    assert sorted((r.code, r.file.rsplit("/", 1)[-1], r.ordinal) for r in trace_json.diagnostics(odd, files).collect()) == [("no_records", "nothing.json", None), ("producer_unknown", "b.json", 0), ("trace_id_missing", "a.json", 1)]
    assert trace_json.schema_kind(rows) == "pdf_trace" and trace_json.schema_kind(rows.limit(0)) == "empty"


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "t", "hot pump", "z"), (2, None, None, None)], "id long, title string, text string, extra string")
    out = {r.id: r for r in P.projected(rows, "id", ["title"], ["text"]).collect()}
    assert out[1]["other"] == {"extra": "z"} and out[2]["text"] == ""
    rules = spark.createDataFrame([("warm", "HOT"), ("odd", "pump")], "tag string, keyword string")
    tags = {r.id: (r.tags, r.unregistered) for r in P.tagged(rows.select("id", "text"), rules, ["warm"]).collect()}
    assert tags == {1: ("warm", "odd"), 2: ("", "")}
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], ["c"])], "x array<string>, y array<string>, r array<string>")
    assert df.select(P.composed_tags(["x", "y"], "r")).first()[0] == ["a", "b"]


def test_pairing_models_synonyms_and_chunks(spark):
    schema = "field string, role string, position int, eligible boolean"
    a = spark.createDataFrame([("t1", "title", 1, True), ("t2", "title", 2, True), ("c", "part_code", 0, True), ("x", "text", 3, False), ("q", "odd", 4, True)], schema)
    b = spark.createDataFrame([("u", "title", 5, True), ("d", "part_code", 1, True), ("m", "model", 2, True)], schema)
    got = sorted((r.priority, r.role, r.a_field, r.b_field, r.method, r.reason) for r in P.auto_pairing(a, b).collect())
    assert [g for g in got if g[5] is None] == [(2, "part_code", "c", "d", "code", None), (4, "title", "t1", "u", "auto", None)]
    assert [(g[1], g[5]) for g in got if g[5]] == [("title", "no_actual_field"), ("model", "no_requirement_field")]
    assert [one(spark, P.auto_eligible(F.lit(c), F.lit(n), F.lit(r)))[0] for c, n, r in (("MATCH_ELIGIBLE", 3, 0.5), ("MATCH_ELIGIBLE", 0, 0.5), ("MATCH_ELIGIBLE", 3, 0.8), ("TECHNICAL", 3, 0.1))] == [True, False, False, False]
    x = spark.createDataFrame([(1, "AC-100"), (2, "unit ZX-9 outdoor"), (3, "pump"), (4, "Z")], "id long, value string")
    y = spark.createDataFrame([(1, "model AC-100 type B"), (2, "ZX-9"), (3, "pump A"), (4, "pump B")], "id long, value string")
    assert sorted((r.a_id, r.b_id, r.method) for r in L.either_contains(x, y, "model", 0.8).collect()) == [(1, 1, "model"), (2, 2, "model")]
    syn = L.auto_synonyms(spark.createDataFrame([("ac", "air")], "term string, base string"), spark.createDataFrame([("AC-1",), ("ac 1",), ("ac",), ("fan",)], "term string"))
    assert sorted(tuple(r) for r in syn.collect()) == [("AC-1", "ac1", True), ("ac", "air", False), ("ac 1", "ac1", True)]
    m = spark.createDataFrame([(1, 0, 7, 0.5), (1, 2, 7, 0.9), (1, 1, 7, 0.9), (1, 3, 8, 0.1)], "a_id long, chunk_no int, b_id long, confidence double")
    assert sorted((r.b_id, r.confidence, r.chunk, r.chunks) for r in L.best_chunks(m, 2).collect()) == [(7, 0.9, 1, [1, 2]), (8, 0.1, 3, [3])]


def test_import_without_llm(tmp_path):
    """The rest works where the folder llm and the pipeline are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lineagekit", tmp_path / "lineagekit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), sorted(set(s) - set(q)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 80 and done.stdout.split(maxsplit=1)[1].strip() == "False False []"

"""Records and pages: headings, lines, paragraphs, nearby text, eligibility, views and saved entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: headings, longest title, fields that only manage a record, distances of layout
CHAPTER = r"^第[0-9０-９一二三四五六七八九十百]+[章編節][\s　]*(.*)$"
NUMBERED = r"^([0-9０-９]+(?:[.．][0-9０-９]+)*[.．]?)[\s　]+(.+)$"
MOST_TITLE = 60
MANAGEMENT = ("tags", "unregistered_tags", "review_status", "review_method", "reviewed_at", "review_comment", "exclusion_reason", "trace_id", "content_hash", "stable_uid", "stable_key")
LINE_SHARE, LEAST_LINE, GAP_SHARE, LEAST_GAP, PARAGRAPH_GAP, LEFT_EDGE = 0.6, 3.0, 1.6, 12.0, 0.6, 0.03
DECISION_ORDER = ("UNREVIEWED", "UNCERTAIN", "REJECT", "ACCEPT")


def heading(text: Column) -> Column:
    """struct(confidence, title) of a line that is a heading by its form, else null. A marker alone is none."""
    line = F.trim(F.coalesce(text, F.lit("")))
    title = F.when(F.rlike(line, F.lit(CHAPTER)), F.trim(F.regexp_extract(line, CHAPTER, 1))).when(F.rlike(line, F.lit(NUMBERED)), F.trim(F.regexp_extract(line, NUMBERED, 2)))
    return F.when(F.coalesce(title, F.lit("")) != "", F.struct(F.when(F.length(title) > MOST_TITLE, "low").otherwise("high").alias("confidence"), line.alias("title")))


def ruled_heading(lines: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, level: of the rules (kind, level, priority, pattern, max_title_length) that a line fits that of
    the highest priority; ties go to the lower level, then the kind."""
    hits = lines.join(rules, F.expr(f"{text} rlike pattern and length({text}) <= max_title_length"))
    best = F.max_by(F.struct("kind", "level"), F.struct("priority", -F.col("level"), F.col("kind"))).alias("rule")
    return hits.groupBy(key).agg(best).select(key, "rule.kind", "rule.level")


def anchored(items: DataFrame, page: str, order: str) -> DataFrame:
    """``items`` with anchor: the number on its page of the line that an item belongs to, in the order of creation.

    Items come in their given order. An item joins the first line whose first item's y is within 0.6 of the
    item's height (3 at least), else it begins a line. Pages are sorted by Spark and read as a stream; a task
    holds the heights at which the lines of one page began.
    """
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "anchor int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, anchors = object(), []
        for batch in batches:
            own, y, h = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (page, "y", "h"))
            out = []
            for p, at, height in zip(own, y, h):
                if p != begun:
                    begun, anchors = p, []
                near = max(height * LINE_SHARE, LEAST_LINE)
                n = next((i for i, a in enumerate(anchors) if abs(a - at) <= near), len(anchors))
                if n == len(anchors):
                    anchors.append(at)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "anchor"])

    return items.repartition(page).sortWithinPartitions(page, order).mapInArrow(run, spec)


def lines_of(items: DataFrame, page: str, order: str) -> DataFrame:
    """page, line, y, text, segments, left, right, bottom, top: text items (x, y, w, h, str) of a page put together.

    Blank items are left out; a height that is missing or 0 is 10. Lines are numbered from the top. In a line a gap
    of 1.6 heights (12 at least) separates segments, which are trimmed and joined by a blank. The box reaches a
    quarter of an item's height (1 at least) below its y and its height above it.
    """
    solid = items.where(F.trim(F.coalesce("str", F.lit(""))) != "").withColumn("h", F.when(F.col("h") != 0, F.abs("h")).otherwise(10.0)).withColumn("w", F.coalesce("w", F.lit(0.0)))
    found = anchored(solid, page, order)
    lines = found.groupBy(page, "anchor").agg(F.min_by("y", order).alias("_y"))
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("_y"), "anchor")))
    along = Window.partitionBy(page, "anchor").orderBy("x", order)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(along)
    cut = found.withColumn("_cut", F.coalesce(gap > F.greatest(F.lag("h").over(along) * GAP_SHARE, F.lit(LEAST_GAP)), F.lit(False)).cast("int")).withColumn("_segment", F.sum("_cut").over(along))
    tall = F.greatest(F.col("h"), F.lit(1.0))
    box = [F.min("x").alias("left"), F.max(F.col("x") + F.greatest(F.col("w"), F.lit(0.0))).alias("right"), F.min(F.col("y") - tall * 0.25).alias("bottom"), F.max(F.col("y") + tall).alias("top")]
    pieces = cut.groupBy(page, "anchor", "_segment").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", order, "str"))), lambda s: s["str"]), "")).alias("piece"), *box)
    whole = pieces.groupBy(page, "anchor").agg(F.array_sort(F.collect_list(F.struct("_segment", "piece"))).alias("s"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"))
    return whole.join(numbered, [page, "anchor"]).select(page, "line", F.col("_y").alias("y"), F.array_join(F.transform("s", lambda s: s["piece"]), " ").alias("text"), F.size("s").alias("segments"), "left", "right", "bottom", "top")


def paragraphs(lines: DataFrame, page: list[str], order: str) -> DataFrame:
    """*page, paragraph, text, lines: lines (left, top, bottom, text) that follow closely, with one left edge.

    Tops grow downwards. Never across pages; overlapping lines begin a paragraph.
    """
    w = Window.partitionBy(*page).orderBy(order)
    gap, height = F.col("top") - F.lag("bottom").over(w), F.greatest(F.col("bottom") - F.col("top"), F.lag(F.col("bottom") - F.col("top")).over(w), F.lit(0.001))
    joins = (gap >= -0.001) & (gap <= height * PARAGRAPH_GAP) & (F.abs(F.col("left") - F.lag("left").over(w)) <= LEFT_EDGE)
    numbered = lines.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("paragraph", F.sum("_new").over(w))
    out = numbered.groupBy(*page, "paragraph").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))).alias("l"))
    return out.select(*page, "paragraph", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), F.size("l").alias("lines"))


def is_management(field: Column) -> Column:
    return field.isin(*MANAGEMENT) | F.rlike(field, F.lit("(?i)^(no|id|行番号)$")) | F.rlike(field, F.lit("(?i)_(id|hash)$"))


def nearby_text(raw: Column, record: Column, quantity_fields: Column) -> Column:
    """A record's raw text, or its values (a map) but for management and quantity fields, joined by `` / ``."""
    kept = F.filter(F.map_entries(record), lambda e: ~is_management(e["key"]) & ~F.array_contains(quantity_fields, e["key"]) & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.coalesce(raw, F.array_join(F.transform(kept, lambda e: e["value"]), " / "), F.lit(""))


def labelled_text(record: Column) -> Column:
    """``header: value`` of a record's non-empty cells (a map), joined by `` / ``."""
    kept = F.filter(F.map_entries(record), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " / ")


def canonical_projection(fields: DataFrame) -> DataFrame:
    """id, roles (map of role to value), sources (role to field), unclassified: of a record's fields
    (id, ordinal, field, value, role, classification) the first of each role that may match."""
    usable = F.col("role").isNotNull() & F.col("classification").isin("MATCH_ELIGIBLE", "MATCH_ELIGIBLE_WITH_CAUTION") & ~F.startswith("field", F.lit("_"))
    first = fields.where(usable).groupBy("id", "role").agg(F.min(F.struct("ordinal", "field", "value")).alias("f"))
    pairs = F.array_sort(F.collect_list(F.struct("role", "f.value", "f.field")))
    roles = first.groupBy("id").agg(pairs.alias("p"))
    open_ = fields.where((F.col("classification") == "UNCLASSIFIED") & ~F.startswith("field", F.lit("_"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "field"))).alias("u"))
    both = fields.select("id").distinct().join(roles, "id", "left").join(open_, "id", "left")
    as_map = lambda name: F.map_from_entries(F.transform(F.coalesce("p", F.array().cast("array<struct<role:string,value:string,field:string>>")), lambda s: F.struct(s["role"], s[name])))
    return both.select("id", as_map("value").alias("roles"), as_map("field").alias("sources"), F.coalesce(F.transform("u", lambda s: s["field"]), F.array().cast("array<string>")).alias("unclassified"))


def role_hints(fields: DataFrame, most: int = 8) -> DataFrame:
    """identity, role, values, status: of fields (identity, role, value) the different values of a role.

    ``unique`` or ``ambiguous``; blank values don't count, and at most ``most`` values are listed.
    """
    kept = fields.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("identity", "role").agg(F.array_sort(F.collect_set(F.trim("value"))).alias("v"))
    return kept.select("identity", "role", F.slice("v", 1, most).alias("values"), F.when(F.size("v") > 1, "ambiguous").otherwise("unique").alias("status"))


def valid_id(column: str) -> Column:
    """Whether a text can be an id: not null, not blank and without blanks around it."""
    return F.coalesce((F.col(column) != "") & (F.col(column) == F.trim(column)), F.lit(False))


def eligibility(pairs: DataFrame) -> DataFrame:
    """Adds reason (null: eligible) to compared pairs: the first rule that fails of engine made, both sides there, ids
    that are texts and no blanks (side a first), each id once on its side, pair once.

    ``pairs``: engine, has_a, has_b, a_id, b_id, a_kind and b_kind (the JSON type of the id: string, null or another),
    a_count and b_count (records of a side that bear the id).
    """
    reason = F.when(~F.coalesce("engine", F.lit(False)), "NOT_MATCHING_ENGINE").when(~F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False)), "MISSING_SIDE")
    for p in ("a", "b"):
        reason = reason.when(~F.coalesce(f"{p}_kind", F.lit("null")).isin("string", "null"), "NON_STRING_TRACE_ID").when(~valid_id(f"{p}_id"), "NO_TRACE_ID")
    reason = reason.when((F.coalesce("a_count", F.lit(0)) != 1) | (F.coalesce("b_count", F.lit(0)) != 1), "DUPLICATE_TRACE_ID")
    first = pairs.withColumn("reason", reason)
    again = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(Window.partitionBy("a_id", "b_id")) > 1
    return first.withColumn("reason", F.when(F.col("reason").isNull() & again, "DUPLICATE_PAIR").otherwise(F.col("reason")))


def entry_statuses(entries: DataFrame, current: DataFrame, available: bool = True) -> DataFrame:
    """pair_id, status of saved entries (pair_id, identity, requirement, actual) against the current eligible
    results (the same columns): CURRENT, STALE, ORPHANED (none, or several), NO_CURRENT_RESULT."""
    if not available:
        return entries.select("pair_id", F.lit("NO_CURRENT_RESULT").alias("status"))
    one = current.groupBy("pair_id").agg(F.count("*").alias("_n"), F.first(F.struct("identity", "requirement", "actual")).alias("_c"))
    same = F.col("_c").eqNullSafe(F.struct("identity", "requirement", "actual"))
    return entries.join(one, "pair_id", "left").select("pair_id", F.when(~F.coalesce(F.col("_n") == 1, F.lit(False)), "ORPHANED").when(same, "CURRENT").otherwise("STALE").alias("status"))


def bound_sides(annotations: DataFrame, records: DataFrame, signature_ok: bool = True) -> DataFrame:
    """side, id, status, ready: annotations and records (side, id, hash) of both sides bound by id.

    bound, stale (another hash), unparsed (no annotation), missing (no record). A side is blocked, and no
    pair of sides ready, where an id occurs twice or the data set isn't the one that was annotated.
    """
    a, r = annotations.select("side", "id", F.col("hash").alias("a_hash"), F.lit(True).alias("a")), records.select("side", "id", F.col("hash").alias("r_hash"), F.lit(True).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("a").isNull(), "unparsed").when(F.col("a_hash").eqNullSafe(F.col("r_hash")), "bound").otherwise("stale")
    repeated = lambda df: df.groupBy("side", "id").agg(F.count("*").alias("n")).where("n > 1").select("side").distinct()
    blocked = repeated(a).union(repeated(r)).distinct().withColumn("_blocked", F.lit(True))
    any_blocked = blocked.agg((F.count("*") > 0).alias("_any"))
    both = a.join(r, ["side", "id"], "full_outer").join(blocked, "side", "left").crossJoin(F.broadcast(any_blocked))  # one row
    return both.select("side", "id", F.when(F.col("_blocked"), "blocked").otherwise(status).alias("status"), (F.lit(signature_ok) & ~F.col("_any")).alias("ready"))


def selected(candidates: DataFrame, decision: str = "ALL", rule: str = "ALL", flag: str = "ALL", query: str = "", sort: str = "keyword") -> DataFrame:
    """Candidates (id, term, aliases, rules, decision, exposure, documents, conflicts) of a view, in its order, with
    position from 1. Paging is a filter on position."""
    keep = F.lit(True)
    if decision != "ALL":
        keep = keep & (F.coalesce("decision", F.lit("UNREVIEWED")) == decision)
    if rule != "ALL":
        keep = keep & F.array_contains("rules", rule)
    if flag != "ALL":
        keep = keep & ((F.size("aliases") > 0) if flag == "ALIAS" else (F.col("conflicts") > 0))
    if query.strip():
        keep = keep & F.contains(F.lower(F.concat_ws(" ", F.col("term"), F.array_join("aliases", " "))), F.lit(query.strip().lower()))
    rank = F.array_position(F.array(*map(F.lit, DECISION_ORDER)), F.coalesce("decision", F.lit("UNREVIEWED")))
    first = {"keyword": [], "exposure": [F.desc("exposure")], "documents": [F.desc("documents")], "conflict": [F.desc("conflicts")], "rule": [F.get("rules", F.lit(0))], "decision": [rank]}[sort]
    from .graph import numbered

    named = candidates.where(keep)
    if not first:
        return numbered(named, ["term", "id"]).withColumnRenamed("number", "position")
    key = first[0]
    keyed = named.withColumn("_k", -F.col({"exposure": "exposure", "documents": "documents", "conflict": "conflicts"}[sort]) if sort in ("exposure", "documents", "conflict") else key)
    return numbered(keyed, ["_k", "term", "id"]).drop("_k").withColumnRenamed("number", "position")


def satisfaction_counts(results: DataFrame) -> DataFrame:
    """key, value: how many comparisons there are, are reviewed, and are satisfied, not so, or open."""
    counts = {"length": F.count("*"), "all_reviewed": F.count_if("all_reviewed"), "satisfied_true": F.count_if("satisfied"), "satisfied_false": F.count_if(~F.col("satisfied")), "satisfied_null": F.count_if(F.col("satisfied").isNull())}
    one = results.agg(*[c.alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*counts))).alias("key", "value"))

"""Field profiles, classification, pairing and rule-driven projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def information(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, distinct_values, near_constant_ratio, unique_ratio; nulls and '' are no values."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select(entries.alias("e")).select("e.field", "e.value").where("value is not null and value <> ''")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("field").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"), (F.max("n") / F.sum("n")).alias("near_constant_ratio"), (F.count("*") / F.sum("n")).alias("unique_ratio"))


# fixed values: fields of a trace's envelope, and names of fields by what they are
ENVELOPE = {
    "file_name": "PROVENANCE_ONLY", "chapter_number": "IDENTITY_ONLY", "chapter_title": "DISPLAY_ONLY", "trace_format": "TECHNICAL_METADATA", "schema_version": "TECHNICAL_METADATA", "id_scheme": "TECHNICAL_METADATA",
    "id_scheme_version": "TECHNICAL_METADATA", "generated_at": "TECHNICAL_METADATA", "generator": "UNSUPPORTED_COMPLEX", "source": "UNSUPPORTED_COMPLEX", "options": "UNSUPPORTED_COMPLEX", "statistics": "UNSUPPORTED_COMPLEX",
    "warnings": "UNSUPPORTED_COMPLEX", "tag_policy": "UNSUPPORTED_COMPLEX", "tag_vocabulary": "UNSUPPORTED_COMPLEX", "_trace_adapter": "UNSUPPORTED_COMPLEX", "_trace_records": "UNSUPPORTED_COMPLEX",
}
TECHNICAL = r"(?i)(^|_)(id|uid|guid|hash|sha[0-9]*|version|scheme|schema|timestamp|at|date|time|status|state|path|file|sheet|row|page|bbox|ref|refs)$|^(review_|ai_review|source_|stable_)"
BUSINESS = (
    ("term", "TERM", "MATCH_ELIGIBLE"), ("name|title|subject|entity", "SUBJECT_ENTITY_NAME", "MATCH_ELIGIBLE"), ("code", "CODE", "MATCH_ELIGIBLE"), ("description|desc|text|content", "DESCRIPTION", "MATCH_ELIGIBLE"),
    ("property|prop", "PROPERTY", "MATCH_ELIGIBLE_WITH_CAUTION"), ("value|val", "VALUE", "MATCH_ELIGIBLE_WITH_CAUTION"), ("unit", "UNIT", "MATCH_ELIGIBLE_WITH_CAUTION"), ("condition|relation", "RELATION_CONDITION", "MATCH_ELIGIBLE_WITH_CAUTION"),
)


def classified(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """schema_kind, field, classification, role, source of each (schema_kind, field).

    The registry (schema_kind, field, classification, role) goes first, then the envelope's fields, names that are
    technical, names of business fields; what fits none is UNCLASSIFIED and has no role.
    """
    hit = fields.select("schema_kind", "field").distinct().join(registry.withColumn("_known", F.lit(True)), ["schema_kind", "field"], "left")
    known, f = F.coalesce("_known", F.lit(False)), F.col("field")
    envelope = F.create_map(*(F.lit(x) for kv in ENVELOPE.items() for x in kv))[f]
    technical = F.rlike(f, F.lit(TECHNICAL))
    kind = F.when(known, F.col("classification")).when(envelope.isNotNull(), envelope).when(technical, "TECHNICAL_METADATA")
    role = F.when(known, F.col("role")).when(envelope.isNotNull() | technical, None)
    source = F.when(known, F.concat(F.lit("registered_schema:"), "schema_kind")).when(envelope.isNotNull(), "trace_envelope").when(technical, "generic_pattern")
    for names, own_role, own_kind in BUSINESS:
        fits = F.rlike(f, F.lit(f"(?i)(^|_)({names})$"))
        kind, role, source = kind.when(fits, own_kind), role.when(fits, own_role), source.when(fits, "generic_pattern")
    return hit.select("schema_kind", "field", kind.otherwise("UNCLASSIFIED").alias("classification"), role.alias("role"), source.otherwise("unclassified").alias("source"))


def safe_pairing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-to-one field pairs of each role (field, role, position), in order of first appearance."""
    nth = lambda s, p: s.select(F.col("field").alias(f"{p}_field"), "role", F.row_number().over(Window.partitionBy("role").orderBy("position")).alias("nth"))
    return nth(a, "a").join(nth(b, "b"), ["role", "nth"])


# fixed values: roles in the order in which they are paired, and how the fields of each are compared
ROLES = ("equipment_code", "part_code", "section_number", "title", "name", "text", "category", "model", "key_text")
METHODS = {"equipment_code": "code", "part_code": "code", "section_number": "code", "model": "contains", "text": "contains", "key_text": "contains"}
ELIGIBLE = ("MATCH_ELIGIBLE", "MATCH_ELIGIBLE_WITH_CAUTION")


def auto_eligible(classification: Column, n: Column, near_constant_ratio: Column, most: float = 0.8) -> Column:
    """Whether a field may be paired by machine: an eligible class, values seen, and no value in most rows."""
    return F.coalesce(classification.isin(*ELIGIBLE) & (n > 0) & (near_constant_ratio < most), F.lit(False))


def auto_pairing(a: DataFrame, b: DataFrame) -> DataFrame:
    """role, nth, a_field, b_field, method, priority, reason of eligible fields (field, role, position, eligible) of both sides.

    Roles are paired in the order of ROLES, their fields in the order of first appearance. A role of one side
    only gives a row with a reason and no pair; without any pair there is nothing to fall back to.
    """
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    kept = lambda s: s.where(F.coalesce("eligible", F.lit(False)) & (rank > 0))
    pairs = safe_pairing(kept(a), kept(b))
    nth = lambda s, p: kept(s).select("role", F.row_number().over(Window.partitionBy("role").orderBy("position")).alias("nth"), F.col("field").alias(f"{p}_field"))
    both = nth(a, "a").join(nth(b, "b"), ["role", "nth"], "full_outer").join(pairs.select("role", "nth", F.lit(True).alias("_p")), ["role", "nth"], "left")
    method = F.coalesce(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])[F.col("role")], F.lit("auto"))
    reason = F.when(F.col("a_field").isNull(), "no_requirement_field").when(F.col("b_field").isNull(), "no_actual_field")
    return both.select("role", "nth", "a_field", "b_field", F.when(F.col("_p"), method).alias("method"), rank.cast("int").alias("priority"), reason.alias("reason"))


def projected(df: DataFrame, id_column: str, title: list[str], text: list[str], keep_rest: bool = True) -> DataFrame:
    """id, title and text of a profile, columns joined by `` / ``, and a map of the others."""
    used = {id_column, *title, *text}
    rest = [c for c in df.columns if c not in used]
    other = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])) if rest and keep_rest else F.lit(None).cast("map<string,string>")
    joined = lambda cols: F.concat_ws(" / ", *[F.col(c).cast("string") for c in cols])
    return df.select(F.col(id_column).alias("id"), joined(title).alias("title"), joined(text).alias("text"), other.alias("other"))


def tagged(rows: DataFrame, rules: DataFrame, vocabulary: list[str]) -> DataFrame:
    """id, tags, unregistered of rows (id, text) under rules (tag, keyword): any keyword gives its tag."""
    hits = rows.join(rules, F.expr("contains(lower(text), lower(keyword))"), "left")
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("all"))
    known = F.array(*[F.lit(t) for t in vocabulary])
    return found.select("id", F.array_join(F.array_intersect("all", known), ",").alias("tags"), F.array_join(F.array_except("all", known), ",").alias("unregistered"))


def composed_tags(sources: list[str], removed: str, most: int = 16) -> Column:
    """Tags of ordered array columns without the removed ones, each once, at most ``most``."""
    return F.slice(F.array_except(F.array_distinct(F.concat(*[F.coalesce(F.col(s), F.array().cast("array<string>")) for s in sources])), F.coalesce(F.col(removed), F.array().cast("array<string>"))), 1, most)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Rows of one page (from 1, clamped below). Paging is the operator's feature."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)

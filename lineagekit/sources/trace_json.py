"""Trace JSON: envelopes with ``_trace_records`` arrays, or bare arrays, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = (
    "trace_id string, parent_id string, trace_title string, trace_text string, trace_content array<string>, trace_category string, trace_key_text string, equipment_code string, "
    "section_number string, section_title string, block_type string, source_file string, source_path string, source_sheet string, source_row int, source_page int, source_section_id string, "
    "source_section_title string, source_raw_text string, content_hash string, review_status string, tags array<string>, source_record map<string,string>"
)
ENVELOPE = f"file_name string, trace_format string, schema_version string, source struct<document_number:string,revision:string,issue_date:string>, _trace_records array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECORD.split(', '))}>>"


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a record with its file and position; files that are bare arrays have no envelope fields.

    Malformed files fail the read. Fields that are not registered are left out.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    bare = F.ltrim("value").startswith("[")
    options = {"mode": "FAILFAST"}
    envelopes = text.where(~bare).select("file", F.from_json(F.when(~bare, F.col("value")), ENVELOPE, options).alias("e")).select("file", F.col("e.schema_version").alias("schema_version"), F.posexplode("e._trace_records").alias("ordinal", "r"))
    arrays = text.where(bare).select("file", F.from_json(F.when(bare, F.col("value")), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECORD.split(', '))}>>", options).alias("r")).select("file", F.lit(None).cast("string").alias("schema_version"), F.posexplode("r").alias("ordinal", "r"))
    return envelopes.union(arrays).select("file", "schema_version", "ordinal", "r.*")


def producer(record: DataFrame) -> Column:
    """``pdf`` or ``excel`` by the fields that only one of them writes; null: neither."""
    return F.when(record["source_raw_text"].isNotNull(), "pdf").when(record["source_record"].isNotNull(), "excel")


def documents(records: DataFrame) -> DataFrame:
    """One row a file: its producer (that of the first record), how many records and sections it has, and a digest of
    its records in order: of digests of them, in groups of 1000 that are hashed in turn."""
    r = records.withColumn("_producer", producer(records))
    own = F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != "file"])), 256)
    groups = r.select("file", F.floor(F.col("ordinal") / 1000).alias("g"), "ordinal", own.alias("h")).groupBy("file", "g").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda s: s["h"]), ""), 256).alias("h"))
    digest = groups.groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda s: s["h"]), ""), 256).alias("digest"))
    facts = r.groupBy("file").agg(F.min_by("_producer", "ordinal").alias("producer"), F.count("*").alias("records"), F.countDistinct("source_section_id").alias("sections"))
    return facts.join(digest, "file").withColumn("document_id", T.identity("document", F.col("file"), F.col("digest")))


def diagnostics(records: DataFrame, files: DataFrame) -> DataFrame:
    """code, file, ordinal: records of no known producer, records without an id, and files (file) without a record."""
    found = lambda df, code, at: df.select(F.lit(code).alias("code"), "file", at.cast("int").alias("ordinal"))
    unknown = found(records.where(producer(records).isNull()), "producer_unknown", F.col("ordinal"))
    nameless = found(records.where(F.trim(F.coalesce("trace_id", F.lit(""))) == ""), "trace_id_missing", F.col("ordinal"))
    return unknown.union(nameless).union(found(files.select("file").join(records.select("file"), "file", "left_anti"), "no_records", F.lit(None)))


def nodes(records: DataFrame) -> DataFrame:
    """Knowledge nodes: one a section (on first sight) and one a record, with stable ids."""
    r = records.withColumn("_producer", producer(records))
    section = F.coalesce("source_section_id", F.lit("-"))
    own = r.select(
        T.identity("node", F.col("file"), F.col("trace_id")).alias("node_id"), F.lit("content").alias("node_type"), F.col("trace_title").alias("title"),
        F.coalesce("trace_text", F.array_join("trace_content", "\n")).alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        T.identity("section", F.col("file"), section).alias("parent_node_id"), "trace_id", F.col("_producer").alias("producer"),
    )
    parents = r.groupBy("file", section.alias("s")).agg(F.min_by("source_section_title", "ordinal").alias("title"), F.min_by("_producer", "ordinal").alias("producer"))
    none = F.lit(None).cast("string")
    top = parents.select(T.identity("section", F.col("file"), F.col("s")).alias("node_id"), F.lit("section").alias("node_type"), "title", none.alias("text"), F.array().cast("array<string>").alias("tags"), none.alias("parent_node_id"), none.alias("trace_id"), "producer")
    return top.union(own)


def contains_edges(node: DataFrame) -> DataFrame:
    e = node.where("parent_node_id is not null")
    return e.select(T.identity("edge", F.col("parent_node_id"), F.lit("contains"), F.col("node_id")).alias("edge_id"), F.col("parent_node_id").alias("source_node_id"), F.col("node_id").alias("target_node_id"), F.lit("contains").alias("relation_type"))


def schema_kind(df: DataFrame, sample: int = 20) -> str:
    """Family of rows by the fields of the first few: empty, excel_trace, pdf_trace, generic_trace_like or unknown.

    Only the first ``sample`` rows are looked at: that is the rule's definition.
    """
    has = lambda c: F.count(F.when(F.col(c).isNotNull(), 1)) if c in df.columns else F.lit(0)
    got = df.limit(sample).agg(F.count("*").alias("n"), has("source_record").alias("excel"), has("source_raw_text").alias("pdf"), has("trace_id").alias("trace")).first()
    if not got["n"]:
        return "empty"
    if got["excel"] or got["pdf"]:
        return "excel_trace" if got["excel"] >= got["pdf"] else "pdf_trace"
    return "generic_trace_like" if got["trace"] else "unknown"


def write_trace_json(records: DataFrame, path: str) -> None:
    """One JSON object a line."""
    records.write.json(path)

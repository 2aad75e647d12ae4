"""The knowledge graph as tables: nodes, edges, an operation log, and the rules that hold between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

# fixed values: the category of each type of relation, and commands that leave a hash as it is
CATEGORIES = {"related_to": "semantic", "satisfied_by": "semantic", "implemented_by": "semantic", "verified_by": "semantic", "contains": "structural", "belongs_to": "structural"}
REVIEWS = ("REVIEW_HUMAN", "REVIEW_AI", "RESET_REVIEW")
EDITS = ("UPDATE_NODE_TEXT", "CHANGE_NODE_TYPE", "ADD_TAG", "REMOVE_TAG")


def ingested(log: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The log (sequence, command_type, target_kind, target_id, before_hash, after_hash) with a CREATE row for
    each new node (node_id, knowledge_hash), then for each new edge (edge_id, knowledge_hash).

    Numbers go on after the log's last; they are given by range partitions and offsets, not in one task.
    """
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last")).first()["last"]
    made = lambda df, kind, key, rank: df.select(F.lit(rank).alias("_rank"), F.lit(f"CREATE_{kind.upper()}").alias("command_type"), F.lit(kind).alias("target_kind"), F.col(key).alias("target_id"), F.lit(None).cast("string").alias("before_hash"), F.col("knowledge_hash").alias("after_hash"))
    new = numbered(made(nodes, "node", "node_id", 0).union(made(edges, "edge", "edge_id", 1)), ["_rank", "target_id"])
    rows = new.select((F.col("number") + last).alias("sequence"), "command_type", "target_kind", "target_id", "before_hash", "after_hash")
    return log.select(*rows.columns).union(rows)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds number, from 1, in an order of all rows: partitions by range, their sizes, and positions in them.

    Rows that tie in ``order`` are numbered in any order among themselves; tie-free orders give one result.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # settled, for ranges are drawn anew each time they are computed
    local = settled(dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    offsets = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return local.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_part", "_n", "_size", "_before")


def folded_nodes(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Nodes (node_id, text, node_type, tags) after edits (sequence, command_type, target_id, value).

    The last text and type count; a tag is there if its last edit added it, or without an edit if it was.
    ``edits`` counts those that changed something. Adding a tag twice or removing a missing one changes nothing.
    """
    edits = log.where(F.col("command_type").isin(*EDITS)).select(F.col("target_id").alias("node_id"), "sequence", "command_type", "value")
    last = lambda kind, name: F.max_by(F.when(F.col("command_type") == kind, F.col("value")), F.when(F.col("command_type") == kind, F.col("sequence"))).alias(name)
    plain = edits.groupBy("node_id").agg(last("UPDATE_NODE_TEXT", "new_text"), last("CHANGE_NODE_TYPE", "new_type"), F.count_if(F.col("command_type").isin("UPDATE_NODE_TEXT", "CHANGE_NODE_TYPE")).alias("plain"))
    start = nodes.select("node_id", F.explode("tags").alias("tag")).distinct().withColumn("there", F.lit(True)).withColumn("sequence", F.lit(0).cast("long"))
    moves = edits.where(F.col("command_type").isin("ADD_TAG", "REMOVE_TAG")).select("node_id", F.col("value").alias("tag"), (F.col("command_type") == "ADD_TAG").alias("there"), F.col("sequence").cast("long"))
    w = Window.partitionBy("node_id", "tag").orderBy("sequence")
    changes = start.union(moves).withColumn("changed", (F.col("sequence") > 0) & (F.col("there") != F.coalesce(F.lag("there").over(w), F.lit(False))))
    each = changes.groupBy("node_id", "tag").agg(F.max_by("there", "sequence").alias("there"), F.count_if("changed").alias("changes"))
    tags = each.groupBy("node_id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.col("tag")))).alias("new_tags"), F.sum("changes").alias("tag_changes"))
    none = F.array().cast("array<string>")
    both = nodes.join(plain, "node_id", "left").join(tags, "node_id", "left")
    return both.select(
        "node_id", F.coalesce("new_text", "text").alias("text"), F.coalesce("new_type", "node_type").alias("node_type"), F.coalesce("new_tags", none).alias("tags"), (F.coalesce("plain", F.lit(0)) + F.coalesce("tag_changes", F.lit(0))).alias("edits")
    )


def repeated(df: DataFrame, key: str) -> DataFrame:
    """key, n of ids that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _found(df: DataFrame, code: str, kind: str, target: str, severity: str = "error") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(kind).alias("target_kind"), F.col(target).cast("string").alias("target_id"))


def _missing(df: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias("_t")).distinct(), F.col(column) == F.col("_t"), "left_anti")


def diagnostics(nodes: DataFrame, edges: DataFrame, sources: DataFrame, log: DataFrame, allowed_tags: DataFrame | None = None) -> DataFrame:
    """code, severity, target_kind, target_id: each breach of the twelve rules of a dataset, and tags out of vocabulary.

    nodes: node_id, parent_node_id, source_document_id, tags; edges: edge_id, source_node_id, target_node_id,
    relation_category, relation_type, lifecycle, confidence, n_features; sources: source_document_id; log:
    sequence, command_type, target_kind, target_id, before_hash, after_hash; allowed_tags: tag.
    """
    again = lambda df, key: df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where("_i > 1")
    expected = F.coalesce(*[F.when(F.col("relation_type") == t, c) for t, c in CATEGORIES.items()])
    structural, semantic = F.col("relation_category") == "structural", F.col("relation_category") == "semantic"
    gaps = numbered(log.select("sequence", "target_id", "command_type"), ["sequence", "target_id", "command_type"]).where("sequence <> number")
    found = [
        _found(again(nodes, "node_id"), "duplicate_node_id", "node", "node_id"), _found(_missing(nodes, "parent_node_id", nodes, "node_id"), "parent_node_not_found", "node", "node_id"),
        _found(nodes.join(sources.select("source_document_id").distinct(), "source_document_id", "left_anti"), "source_document_not_found", "node", "node_id"),
        _found(again(edges, "edge_id"), "duplicate_edge_id", "edge", "edge_id"),
        _found(edges.join(nodes.select(F.col("node_id").alias("source_node_id")).distinct(), "source_node_id", "left_anti"), "edge_source_not_found", "edge", "edge_id"),
        _found(edges.join(nodes.select(F.col("node_id").alias("target_node_id")).distinct(), "target_node_id", "left_anti"), "edge_target_not_found", "edge", "edge_id"),
        _found(edges.where(~expected.eqNullSafe(F.col("relation_category"))), "relation_category_mismatch", "edge", "edge_id"),
        _found(edges.where(structural & ~F.col("lifecycle").eqNullSafe(F.lit("active"))), "structural_lifecycle_invalid", "edge", "edge_id"),
        _found(edges.where(structural & ~F.col("confidence").eqNullSafe(F.lit(1.0))), "structural_confidence_invalid", "edge", "edge_id"),
        _found(edges.where(semantic & (F.coalesce("n_features", F.lit(0)) == 0)), "evidence_empty", "edge", "edge_id"),
        _found(gaps, "operation_sequence_invalid", "dataset", "sequence"),
        _found(log.where(F.col("command_type").isin(*REVIEWS) & ~F.col("before_hash").eqNullSafe(F.col("after_hash"))), "review_changed_hash", "operation", "target_id"),
    ]
    if allowed_tags is not None:
        each = nodes.select("node_id", F.explode("tags").alias("tag"))
        found.append(_found(each.join(allowed_tags.select("tag").distinct(), "tag", "left_anti"), "tag_not_in_vocabulary", "node", "node_id", "warning"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def canonical_relations(relations: DataFrame, columns: list[str]) -> DataFrame:
    """Adds relation_hash: SHA-256 of a relation's columns as netstrings, null and empty apart."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(F.col(c).cast("string").cast("binary")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(",")))
    return relations.withColumn("relation_hash", F.sha2(F.concat(*map(part, columns)).cast("binary"), 256))


def flattened(records: DataFrame, separator: str = ".") -> DataFrame:
    """Every leaf of nested structs as a column of its own, named by its path; arrays and maps as JSON."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def leaves(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, here)
            else:
                out.append((F.to_json(column) if isinstance(f.dataType, (ArrayType, MapType)) else column).alias(separator.join(here)))
        return out

    return records.select(*leaves(records.schema, ()))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of one side only, with ``side``; equal sets give none."""
    return a.subtract(b).withColumn("side", F.lit("a")).union(b.subtract(a).withColumn("side", F.lit("b")))


def all_diagnostics(frames: list[DataFrame]) -> DataFrame:
    """Diagnostics of several steps one after the other, whatever columns each has."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

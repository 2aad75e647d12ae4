"""From requirement and actual quantities to comparisons: buckets, pairs, modes and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I


def judged(df: DataFrame, requirement: str, actual: str, applicable: Column) -> DataFrame:
    """Adds coverage, signed deltas, state and satisfied of two interval columns."""
    cover = I.coverage(F.col(requirement), F.col(actual))
    low, high = I.deltas(F.col(requirement), F.col(actual))
    with_cover = df.withColumn("_c", F.when(applicable, cover))
    state, satisfied = I.judgement(applicable, F.col("_c.holds"))
    return with_cover.select(*df.columns, F.col("_c.holds").alias("relation_holds"), F.col("_c.lower_mismatch").alias("lower_mismatch"), F.col("_c.upper_mismatch").alias("upper_mismatch"), low.alias("lower_delta"), high.alias("upper_delta"), state.alias("state"), satisfied.alias("satisfied"))


def dimension_buckets(relations: DataFrame, requirement: DataFrame, actual: DataFrame) -> DataFrame:
    """Relation pairs with the number of quantities on both sides of each shared dimension.

    ``relations``: requirement_id, actual_id; both sides: id, dimension, quantity_id. Pairs that occur
    more than once are left out, as they have no single relation.
    """
    once = relations.groupBy("requirement_id", "actual_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    side = lambda df, name: df.groupBy(F.col("id").alias(f"{name}_id"), "dimension").agg(F.count("*").alias(f"{name}_quantities"))
    return once.join(side(requirement, "requirement"), "requirement_id").join(side(actual, "actual"), ["actual_id", "dimension"]).select("requirement_id", "actual_id", "dimension", "requirement_quantities", "actual_quantities")


def capped_pairs(pairs: DataFrame, group: list[str], order: list[str], per_group: int) -> DataFrame:
    """At most ``per_group`` comparison candidates a group, in order. The cap is the operator's feature."""
    w = Window.partitionBy(*group).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_group)


def with_mode(df: DataFrame, modes: DataFrame, requirement: str, actual: str) -> DataFrame:
    """Joins the derivation table (requirement_semantics, actual_semantics, mode); null: no mode."""
    table = modes.select(F.col("requirement_semantics").alias(requirement), F.col("actual_semantics").alias(actual), "mode")
    return df.join(table, [requirement, actual], "left")


def top_and_margin(scores: DataFrame, key: list[str], value: str, score: str) -> DataFrame:
    """The best value of each key, its score and its lead over the next (itself if it is alone)."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), F.asc(value))
    ranked = scores.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where("_rank = 1").select(*key, F.col(value).alias("top_value"), F.col(score).alias("top_score"), F.when(F.col("_next").isNull(), F.col(score)).otherwise(F.col(score) - F.col("_next")).alias("margin"))


def resolved(top: DataFrame, least: float, margin: float) -> DataFrame:
    return top.withColumn("status", F.when((F.col("top_score") >= least) & (F.col("margin") >= margin), "resolved").otherwise("needs_review"))

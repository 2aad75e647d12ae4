"""Numeric comparison of requirement and actual quantities, from units to a record set.

A quantity is struct(kind, interval, options): kind is interval or alternatives; the interval is that of
:mod:`..functions.intervals`. Rows that can't go on keep a ``reason``; nothing is dropped, so what is
compared and what isn't are two filters of one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import text as T
from ..session import settled

# fixed values: modes, how many alternatives a quantity may have, sources of a relation
MODES = ("point_in_region", "actual_covers_requirement", "requirement_covers_actual")
MOST_OPTIONS = 64
SOURCES = ("matching_engine", "manual")
SORT = ("requirement_trace_id", "actual_trace_id", "requirement_quantity_id", "actual_quantity_id", "matcher_a_id", "matcher_b_id")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def quantity_reason(q: Column) -> Column:
    """Why a quantity has no sound structure; null: it has."""
    x, options = q["interval"], q["options"]
    bad = lambda end: x[end].isNotNull() & ~finite(x[end])
    interval = F.when(x.isNull() | bad("lower") | bad("upper"), "quantity_value_invalid").when((x["lower"].isNull() & x["upper"].isNull()) | F.coalesce(I.is_empty(x), F.lit(False)), "quantity_value_empty")
    alternatives = F.when(options.isNull(), "quantity_value_invalid").when(F.size(options) == 0, "quantity_value_empty").when(F.size(options) > MOST_OPTIONS, "quantity_value_limit_exceeded").when(F.exists(options, lambda v: ~finite(v)), "quantity_value_invalid")
    return F.when(q.isNull(), "quantity_value_invalid").when(q["kind"] == "interval", interval).when(q["kind"] == "alternatives", alternatives).otherwise("quantity_value_kind_unsupported")


def linear(q: Column, factor: Column, offset: Column) -> Column:
    """struct(value, reason): a quantity under value * factor + offset; a reason is one that its structure has,
    a bad plan, a result that isn't finite, or ends or options that run together."""
    x = q["interval"]
    f = lambda v: v * factor + offset
    low, high = f(x["lower"]), f(x["upper"])
    lost = ((x["lower"] < x["upper"]) & (low >= high)) | (low > high)
    moved = F.transform(q["options"], f)
    interval = F.when((x["lower"].isNotNull() & ~finite(low)) | (x["upper"].isNotNull() & ~finite(high)), "quantity_conversion_non_finite").when(F.coalesce(lost, F.lit(False)), "quantity_conversion_precision_loss")
    options = F.when(F.exists(moved, lambda v: ~finite(v)), "quantity_conversion_non_finite").when(F.size(F.array_distinct(moved)) < F.size(F.array_distinct(q["options"])), "quantity_conversion_precision_loss")
    reason = F.coalesce(F.when(~finite(factor) | ~finite(offset) | (factor <= 0), "quantity_conversion_plan_invalid"), quantity_reason(q), F.when(q["kind"] == "interval", interval).otherwise(options))
    value = F.struct(
        q["kind"].alias("kind"), F.when(x.isNotNull(), F.struct(low.alias("lower"), x["lower_inclusive"].alias("lower_inclusive"), high.alias("upper"), x["upper_inclusive"].alias("upper_inclusive"))).alias("interval"), moved.alias("options")
    )
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def normalized_views(pairs: DataFrame, factor: Column, offset: Column | None = None) -> DataFrame:
    """Adds normalized (the actual quantity in the requirement's unit), reason and side of the first problem."""
    moved = pairs.withColumn("_r", quantity_reason(F.col("requirement"))).withColumn("_m", linear(F.col("actual"), factor, F.lit(0.0) if offset is None else offset))
    # columns of their own, so that what follows uses values and not the expressions once more
    plain = moved.select(*pairs.columns, "_r", F.col("_m.value").alias("_value"), F.col("_m.reason").alias("_a"))
    side = F.when(F.col("_r").isNotNull(), "requirement").when(F.col("_a").isNotNull(), "actual")
    return plain.select(*pairs.columns, F.when(F.col("_r").isNull(), F.col("_value")).alias("normalized"), F.coalesce("_r", "_a").alias("reason"), side.alias("reason_side"))


def _ends(holds: Column, same: Column, outer_open: Column, inner_closed: Column | None) -> Column:
    mismatch = same & outer_open if inner_closed is None else same & outer_open & inner_closed
    return F.struct(holds.alias("holds"), F.coalesce(mismatch, F.lit(False)).alias("boundary_mismatch"))


def covers(outer: Column, inner: Column) -> Column:
    """struct(holds, lower, upper) of whether an interval covers another; an end is struct(holds, boundary_mismatch)."""
    low, high = I.covers_lower(outer, inner), I.covers_upper(outer, inner)
    end = lambda e, holds: _ends(holds, inner[e] == outer[e], ~outer[f"{e}_inclusive"], inner[f"{e}_inclusive"])
    return F.struct((low & high).alias("holds"), end("lower", low).alias("lower"), end("upper", high).alias("upper"))


def holds_point(region: Column, point: Column) -> Column:
    """As :func:`covers`, of a value."""
    low = region["lower"].isNull() | (point > region["lower"]) | ((point == region["lower"]) & region["lower_inclusive"])
    high = region["upper"].isNull() | (point < region["upper"]) | ((point == region["upper"]) & region["upper_inclusive"])
    end = lambda e, holds: _ends(holds, point == region[e], ~region[f"{e}_inclusive"], None)
    return F.struct((low & high).alias("holds"), end("lower", low).alias("lower"), end("upper", high).alias("upper"))


def numeric_comparisons(views: DataFrame, mode: str = "mode") -> DataFrame:
    """Adds comparison (relation_type, outer, inner, holds, lower, upper, lower_delta, upper_delta) to views, by mode.

    Deltas are actual - requirement below and requirement - actual above, whatever the mode; null where an
    end is missing. Alternatives, a point mode without a point, unknown modes and deltas that aren't finite
    are reasons, and have no comparison.
    """
    ends = {f"_{side}_{end}": F.col(f"{name}.interval.{end}") for side, name in (("r", "requirement"), ("a", "normalized")) for end in ("lower", "lower_inclusive", "upper", "upper_inclusive")}
    plain = views.withColumns({**ends, "_kinds": F.coalesce((F.col("requirement.kind") == "alternatives") | (F.col("normalized.kind") == "alternatives"), F.lit(False)), "_mode": F.col(mode)})
    side = lambda p: {e: F.col(f"_{p}_{e}") for e in ("lower", "lower_inclusive", "upper", "upper_inclusive")}
    r, a, m = side("r"), side("a"), F.col("_mode")
    point, wrong = I.is_point(a), lambda d: d.isNotNull() & ~finite(d)
    plain = plain.withColumns({"_low": a["lower"] - r["lower"], "_high": r["upper"] - a["upper"], "_point": point})
    reason = F.when(m.isNull() | ~m.isin(*MODES), "numeric_comparison_mode_unsupported").when(F.col("_kinds"), "quantity_comparison_kind_unsupported").when((m == MODES[0]) & ~F.col("_point"), "point_in_region_actual_not_point").when(wrong(F.col("_low")) | wrong(F.col("_high")), "numeric_comparison_delta_non_finite")
    # the outer interval is the actual one in one mode only; a point is an interval with both ends closed
    swap = m == MODES[1]
    outer_inner = {f"_{name}_{e}": F.when(swap, x[e]).otherwise(y[e]) for name, x, y in (("o", a, r), ("i", r, a)) for e in r}
    plain = plain.withColumn("reason", F.coalesce("reason", reason)).withColumns(outer_inner)
    o, i = side("o"), side("i")
    plain = plain.withColumns({"_holds_lower": I.covers_lower(o, i), "_holds_upper": I.covers_upper(o, i)})
    end = lambda e: _ends(F.col(f"_holds_{e}"), i[e] == o[e], ~o[f"{e}_inclusive"], i[f"{e}_inclusive"])
    inner_outer = lambda one, two: F.when(m == MODES[1], one).when(m == MODES[2], two)
    comparison = F.struct(
        F.when(m == MODES[0], MODES[0]).otherwise("outer_covers_inner").alias("relation_type"), inner_outer("actual", "requirement").alias("outer"), inner_outer("requirement", "actual").alias("inner"),
        (F.col("_holds_lower") & F.col("_holds_upper")).alias("holds"), end("lower").alias("lower"), end("upper").alias("upper"), F.col("_low").alias("lower_delta"), F.col("_high").alias("upper_delta"),
    )
    kept = [c for c in views.columns if c != "reason"]
    return plain.select(*kept, "reason", F.when(F.col("reason").isNull(), comparison).alias("comparison"))


def coverage_gap(requirement: Column, actual: Column, requirement_unit: Column, actual_unit: Column, mode: Column) -> Column:
    """struct(comparable, reason, satisfied, low_gap, high_gap) of two quantities in the same unit.

    Without a mode only a point can be compared (with the region); ranges need to be told what they mean.
    """
    r, a = requirement["interval"], actual["interval"]
    kinds = (requirement["kind"] == "interval") & (actual["kind"] == "interval")
    point = F.coalesce(mode, F.when(I.is_point(a), F.lit(MODES[0])))
    reason = (
        F.when(~requirement_unit.eqNullSafe(actual_unit), "unit_mismatch").when(~kinds, "not_an_interval").when(F.coalesce(I.is_empty(r) | I.is_empty(a), F.lit(False)), "empty_interval")
        .when((point == MODES[0]) & ~I.is_point(a), "not_a_point").when(point.isNull() | ~point.isin(*MODES), "mode_unknown")
    )
    satisfied = F.when(point == MODES[0], holds_point(r, a["lower"])["holds"]).when(point == MODES[1], covers(a, r)["holds"]).otherwise(covers(r, a)["holds"])
    fine = reason.isNull()
    return F.struct(fine.alias("comparable"), reason.alias("reason"), F.when(fine, satisfied).alias("satisfied"), F.when(fine, a["lower"] - r["lower"]).alias("low_gap"), F.when(fine, r["upper"] - a["upper"]).alias("high_gap"))


def auto_applicability(compared: DataFrame, requirement_warnings: Column, actual_warnings: Column, gates: dict[str, Column]) -> DataFrame:
    """Adds violations (gates that earlier steps should have seen to) and auto_applicable: no warning on either side.

    Where ``violations`` isn't empty on any row, the whole result is to be refused: see :func:`ready`.
    """
    counts = {"requirement_warnings": requirement_warnings, "actual_warnings": actual_warnings}
    checks = {name: ok for name, ok in gates.items()} | {name: c.isNotNull() & (c >= 0) for name, c in counts.items()}
    violations = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    fine = F.col("reason").isNull()
    return compared.withColumn("violations", F.when(fine, violations).otherwise(F.array().cast("array<string>"))).withColumn("auto_applicable", F.when(fine, (requirement_warnings + actual_warnings) == 0))


def ready(df: DataFrame, problems: Column) -> DataFrame:
    """One row: ready (no row has problems) and how many have."""
    return df.agg(F.count_if(problems).alias("problems")).select((F.col("problems") == 0).alias("ready"), "problems")


def record_set(judged: DataFrame) -> DataFrame:
    """Adds quantity_pair_id, comparison_id, initial review states and problems of identity to judged rows.

    ``judged`` has the columns SORT. A quantity pair or comparison id that occurs more than once is a
    problem on all of its rows. Rows are compared with :func:`in_order`.
    """
    pair = F.concat("requirement_quantity_id", F.lit("::"), "actual_quantity_id")
    ident = F.concat(F.lit("cmp-v1:"), T.netstring(F.col("requirement_trace_id")), T.netstring(F.col("actual_trace_id")), T.netstring(pair))
    named = judged.withColumn("quantity_pair_id", pair).withColumn("comparison_id", ident)
    # only ids that occur more than once are joined back, to rows that are worked out once
    named = settled(named)
    repeated = lambda c, name: named.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1").select(c, F.lit(True).alias(name))
    both = named.join(repeated("quantity_pair_id", "_p"), "quantity_pair_id", "left").join(repeated("comparison_id", "_c"), "comparison_id", "left")
    problems = F.array_compact(F.array(F.when(F.col("_p"), "quantity_pair_id_duplicate"), F.when(F.col("_c"), "comparison_id_duplicate"), *[F.when(F.coalesce(F.col(c), F.lit("")) == "", f"{c}_missing") for c in SORT]))
    return both.withColumn("problems", problems).withColumn("satisfaction_review", F.lit("not_eligible")).drop("_p", "_c")


def in_order(records: DataFrame) -> DataFrame:
    """The records by their six keys, as bytes."""
    return records.orderBy(*SORT)


def recomputed(records: DataFrame) -> DataFrame:
    """Records whose ids, deltas or judgement differ from what their own fields give; ``differences`` names them."""
    r, a = F.col("requirement.interval"), F.col("normalized.interval")
    state, satisfied = I.judgement(F.col("auto_applicable"), F.col("comparison.holds"))
    checks = {
        "quantity_pair_id": F.concat("requirement_quantity_id", F.lit("::"), "actual_quantity_id").eqNullSafe(F.col("quantity_pair_id")), "lower_delta": (a["lower"] - r["lower"]).eqNullSafe(F.col("comparison.lower_delta")),
        "upper_delta": (r["upper"] - a["upper"]).eqNullSafe(F.col("comparison.upper_delta")), "state": state.eqNullSafe(F.col("state")), "satisfied": satisfied.eqNullSafe(F.col("satisfied")),
    }
    differences = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return records.withColumn("differences", differences).where(F.size("differences") > 0)


def relationship_problems(source: Column, method: Column, confidence: Column, category: Column, linked_at: Column) -> Column:
    """What is wrong with a relation's metadata, in order."""
    engine = F.coalesce(source == "matching_engine", F.lit(False))
    title = F.coalesce(method == "title_candidate", F.lit(False))
    checks = (
        ("source_invalid", ~F.coalesce(source.isin(*SOURCES), F.lit(False))), ("match_method_invalid", method == ""), ("match_confidence_invalid", confidence.isNotNull() & ~(finite(confidence) & confidence.between(0.0, 1.0))),
        ("review_category_invalid", category == ""), ("linked_at_invalid", linked_at.isNotNull() & ~F.coalesce(T.canonical_timestamp(linked_at), F.lit(False))), ("match_method_missing", engine & method.isNull()),
        ("match_confidence_must_be_null_for_title_candidate", engine & title & confidence.isNotNull()), ("match_confidence_missing", engine & ~title & confidence.isNull()), ("review_category_missing", engine & category.isNull()),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))


def concept_pairs(requirement: DataFrame, actual: DataFrame, key: list[str], per_concept: int = 50) -> DataFrame:
    """Within each key, quantities of both sides that resolved to one concept, and those that didn't meet.

    Sides: *key, quantity_id, concept (null: unresolved). Rows: *key, concept, requirement_quantity_id,
    actual_quantity_id, reason: null for pairs, concept_mismatch for a concept of one side, property_unresolved,
    candidate_limit_exceeded for pairs beyond ``per_concept`` of a key and concept (the limit is the feature).
    """
    side = lambda df, name: df.select(*key, "concept", F.col("quantity_id").alias(f"{name}_quantity_id"))
    r, a = side(requirement, "requirement"), side(actual, "actual")
    both = r.where("concept is not null").join(a.where("concept is not null"), [*key, "concept"], "full_outer")
    one = F.col("requirement_quantity_id").isNull() | F.col("actual_quantity_id").isNull()
    rank = F.row_number().over(Window.partitionBy(*key, "concept").orderBy("requirement_quantity_id", "actual_quantity_id"))
    met = both.withColumn("_n", rank).withColumn("reason", F.when(one, "concept_mismatch").when(F.col("_n") > per_concept, "candidate_limit_exceeded")).drop("_n")
    open_ = r.where("concept is null").unionByName(a.where("concept is null"), allowMissingColumns=True).withColumn("reason", F.lit("property_unresolved"))
    return met.unionByName(open_)


def candidate_pairs(requirement: DataFrame, actual: DataFrame, key: list[str], per_group: int = 50, total: int = 2000, potential: int = 2_000_000) -> DataFrame:
    """Comparison candidates under caps a group and over all, which are the feature.

    Sides: *key (the bucket), quantity_id, concept (null: unresolved). Buckets that both sides have are gone through in
    the order of the key, their concepts in order: each group of a concept adds its pairs, and at most ``per_group``
    of them as candidates, to two running totals. Where one of these exceeds its limit the scan ends and there are no
    candidates at all, only what was seen so far: reason total_candidate_limit_exceeded (one row with the totals
    at that group), candidate_limit_would_exceed (groups beyond ``per_group``), and concept_mismatch and
    property_unresolved up to there. Else: pairs (reason null), candidate_limit_exceeded (a row a group with the number
    of pairs left out), and the two others. ``result_complete`` says whether nothing was left out.

    Each group adds one candidate at least, so ``total`` + 1 groups in order tell where the scan ends; where the sums
    over all groups stay within the limits, not even their order is needed.
    """
    for name, limit in (("per_group", per_group), ("total", total), ("potential", potential)):
        if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
            raise ValueError(f"{name} must be a whole number from 1 on")
    order, named = [*key, "concept"], lambda df, side: df.where("concept is not null").groupBy(*key, "concept").agg(F.count("*").alias(f"n_{side}"))
    buckets = requirement.select(*key).distinct().join(actual.select(*key).distinct(), key)
    groups = named(requirement, "r").join(named(actual, "a"), order, "full_outer").join(buckets, key, "left_semi").withColumn("pairs", F.col("n_r") * F.col("n_a"))
    both = groups.where("pairs is not null")
    n, most, every = both.agg(F.count("*"), F.coalesce(F.sum(F.least("pairs", F.lit(per_group))), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    stop = None
    if most > total or every > potential:
        first = both.orderBy(*order).limit(min(total, n) + 1)
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the first total + 1 groups at most
        first = first.withColumns({"materialized": F.sum(F.least("pairs", F.lit(per_group))).over(running), "potential": F.sum("pairs").over(running)})
        stop = first.where((F.col("materialized") > total) | (F.col("potential") > potential)).orderBy(*order).first()

    kinds = dict(groups.dtypes)
    at = lambda names: F.struct(*(F.lit(stop[k]).cast(kinds[k]).alias(k) for k in names))
    here = F.lit(True) if stop is None else F.struct(*key) <= at(key)
    seen = F.lit(True) if stop is None else F.struct(*order) < at(order)
    columns = [*key, "concept", "side", "requirement_quantity_id", "actual_quantity_id", "reason", "pairs", "result_complete"]
    side = lambda df, s: df.join(buckets, key, "left_semi").select(*key, "concept", F.lit(s).alias("side"), F.col("quantity_id").alias(f"{s}_quantity_id"))
    r, a = side(requirement, "requirement"), side(actual, "actual")
    each = r.unionByName(a, allowMissingColumns=True)
    unresolved = each.where(F.col("concept").isNull() & here).withColumn("reason", F.lit("property_unresolved"))
    alone = groups.where("pairs is null").select(*order)
    mismatch = each.where(seen).join(alone, order).withColumn("reason", F.lit("concept_mismatch"))
    noted = unresolved.unionByName(mismatch)
    large = groups.where((F.col("pairs") > per_group) & (seen if stop is None else F.struct(*order) <= at(order)))
    if stop is not None:
        scanned, every = buckets.where(here).count(), buckets.count()
        over = [k for k, hit in (("materialized", stop["materialized"] > total), ("potential", stop["potential"] > potential)) if hit]
        ended = requirement.sparkSession.range(1).select(F.lit("total_candidate_limit_exceeded").alias("reason"), F.lit(stop["potential"]).alias("pairs"), F.lit(",".join(over)).alias("limit_kinds"), F.lit(stop["materialized"]).alias("materialized"), F.lit(scanned).cast("long").alias("buckets"), F.lit(every - scanned).cast("long").alias("unscanned"))
        would = large.select(*order, "pairs", F.lit("candidate_limit_would_exceed").alias("reason"))
        out = noted.unionByName(would, allowMissingColumns=True).unionByName(ended, allowMissingColumns=True).withColumn("result_complete", F.lit(False))
        return out.select(*columns, "limit_kinds", "materialized", "buckets", "unscanned")
    rank = F.row_number().over(Window.partitionBy(*order).orderBy("requirement_quantity_id", "actual_quantity_id"))
    met = r.drop("side").join(a.drop("side"), order).withColumn("_n", rank).where(F.col("_n") <= per_group).drop("_n")
    left = large.select(*order, (F.col("pairs") - per_group).alias("pairs"), F.lit("candidate_limit_exceeded").alias("reason"))
    whole = large.isEmpty()
    out = noted.unionByName(met, allowMissingColumns=True).unionByName(left, allowMissingColumns=True).withColumn("result_complete", F.lit(whole))
    none = [F.lit(None).cast(kind).alias(n) for n, kind in (("limit_kinds", "string"), ("materialized", "long"), ("buckets", "long"), ("unscanned", "long"))]
    return out.select(*columns, *none)

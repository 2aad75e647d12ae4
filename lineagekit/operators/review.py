"""Reviews: event folds, staleness, effective satisfaction, sampling and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered

# fixed values: what is reviewed of a comparison; satisfaction can be reviewed once the four before it are accepted
UPSTREAM = ("quantity_extraction", "property_mapping", "interval_semantics", "comparison_mode")
TARGETS = (*UPSTREAM, "satisfaction")
VERDICTS = ("accept", "override_satisfied", "override_unsatisfied")
FOLDED = "session_id long, comparison_id string, target string, status string, verdict string, session_status string, revision long, refused long"


class Session:
    """One review session: for each comparison {target: (status, verdict)}.

    ``active`` until an invalidation makes it ``stale`` (then only discard is possible), ``ended`` by discard.
    """

    def __init__(self, comparisons: list[str]):
        self.comparisons = {c: self.initial() for c in comparisons}
        self.status, self.revision, self.refused = "active", 0, 0

    @staticmethod
    def initial() -> dict:
        return dict.fromkeys(UPSTREAM, ("unreviewed", None)) | {"satisfaction": ("not_eligible", None)}

    @staticmethod
    def eligible(comparison: dict) -> bool:
        return all(comparison[t] == ("reviewed", "accept") for t in UPSTREAM)

    def apply(self, action: str, comparison_id: str | None, target: str | None, verdict: str | None) -> None:
        """An action that isn't allowed is refused; one that changes nothing is neither refused nor a revision."""
        outcome = self._outcome(action, self.comparisons.get(comparison_id), target, verdict)
        self.revision += outcome is True
        self.refused += outcome is False

    def _outcome(self, action: str, comparison: dict | None, target: str | None, verdict: str | None) -> bool | None:
        if self.status == "ended":
            return False
        if action == "discard_review_session":
            self.status = "ended"
            return True
        if action == "invalidate_review_session":
            changed = self.status == "active"
            self.status = "stale"
            return changed or None
        if self.status == "stale" or comparison is None:
            return False
        if action == "accept_review_target":
            if target not in UPSTREAM or verdict != "accept" or comparison[target][0] != "unreviewed":
                return False
            comparison[target] = ("reviewed", "accept")
            if self.eligible(comparison) and comparison["satisfaction"][0] == "not_eligible":
                comparison["satisfaction"] = ("unreviewed", None)
            return True
        if action == "review_satisfaction":
            if verdict not in VERDICTS or comparison["satisfaction"][0] != "unreviewed":
                return False
            comparison["satisfaction"] = ("reviewed", verdict)
            return True
        if action != "reset_review_target" or target not in TARGETS:
            return False
        if target == "satisfaction":
            wanted = ("unreviewed" if self.eligible(comparison) else "not_eligible", None)
            changed = comparison[target] != wanted
            comparison[target] = wanted
            return changed or None
        if comparison[target][0] == "unreviewed":
            return None
        comparison[target], comparison["satisfaction"] = ("unreviewed", None), ("not_eligible", None)
        return True

    def rows(self, session_id) -> list[tuple]:
        return [(session_id, c, t, *state[t], self.status, self.revision, self.refused) for c, state in self.comparisons.items() for t in TARGETS] if self.status != "ended" else []


def fold(events: DataFrame, comparisons: DataFrame) -> DataFrame:
    """FOLDED: states of sessions that weren't discarded, under ordered events.

    ``events``: session_id, seq, action, comparison_id, target, verdict; ``comparisons``: session_id,
    comparison_id. The fold is order dependent. Spark deals and sorts sessions, which are read as a stream:
    a session's comparisons first (a bounded set, as one reviewer's work is), then its events, of any number.
    """
    columns = [c.split()[0] for c in FOLDED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, names, state = None, [], None
        for frame in frames:
            out = []
            for session_id, first, action, comparison, target, verdict in zip(frame["session_id"], frame["first"], frame["action"], frame["comparison_id"], frame["target"], frame["verdict"]):
                if session_id != current:
                    out += (state or Session(names)).rows(current) if current is not None else []
                    current, names, state = session_id, [], None
                if first:
                    names.append(comparison)
                else:
                    state = state or Session(names)
                    state.apply(action, comparison, target, verdict)
            yield pd.DataFrame(out, columns=columns)
        if current is not None:
            yield pd.DataFrame((state or Session(names)).rows(current), columns=columns)

    nothing = F.lit(None).cast("string")
    start = comparisons.distinct().select("session_id", F.lit(True).alias("first"), F.lit(0).cast("long").alias("seq"), nothing.alias("action"), "comparison_id", nothing.alias("target"), nothing.alias("verdict"))
    all_events = start.union(events.select("session_id", F.lit(False), F.col("seq").cast("long"), "action", "comparison_id", "target", "verdict")).where("session_id is not null")
    ordered = all_events.repartition("session_id").sortWithinPartitions("session_id", F.desc("first"), "seq", "comparison_id")
    return ordered.select("session_id", "first", "action", "comparison_id", "target", "verdict").mapInPandas(run, FOLDED)


def human_satisfaction(verdict: Column, automatic: Column) -> Column:
    """What a reviewed satisfaction says: an override, or for accept the automatic judgement."""
    return F.when(verdict == "override_satisfied", True).when(verdict == "override_unsatisfied", False).when(verdict == "accept", automatic)


def review_progress(folded: DataFrame) -> DataFrame:
    """session_id, comparison_id, eligible (all but satisfaction accepted in an active session), all_reviewed."""
    done = F.col("status") == "reviewed"
    upstream = F.col("target") != "satisfaction"
    got = folded.groupBy("session_id", "comparison_id").agg((F.min((F.col("session_status") == "active")) & F.min(F.when(upstream, done & F.col("verdict").eqNullSafe(F.lit("accept"))))).alias("eligible"), F.min(done).alias("all_reviewed"))
    return got


def stale_reviews(targets: DataFrame) -> DataFrame:
    """Adds stale: a review (status reviewed) of another content than the current one (reviewed_hash, current_hash)."""
    return targets.withColumn("stale", (F.col("status") == "reviewed") & ~F.col("reviewed_hash").eqNullSafe(F.col("current_hash")))


def last_write(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("writes"))


def sequence_problems(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys whose sequence is not 1..n without gaps or repeats."""
    got = log.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(seq).alias("distinct_seq"), F.min(seq).alias("first"), F.max(seq).alias("last"))
    return got.where("first <> 1 or last <> n or distinct_seq <> n")


def bound(annotations: DataFrame, records: DataFrame) -> DataFrame:
    """id, status: bound, stale (hash differs), unparsed (record without annotation), missing (annotation
    without record). ``annotations`` and ``records``: id, hash."""
    a, r = annotations.toDF("id", "a_hash"), records.toDF("id", "r_hash")
    both = a.withColumn("a", F.lit(True)).join(r.withColumn("r", F.lit(True)), "id", "full_outer")
    return both.select("id", F.when(F.col("r").isNull(), "missing").when(F.col("a").isNull(), "unparsed").when(F.col("a_hash").eqNullSafe(F.col("r_hash")), "bound").otherwise("stale").alias("status"))


def stale_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_id, source, target, source_hash, target_hash) with ``stale`` against nodes (id, hash)."""
    s, t = nodes.toDF("source", "s_hash"), nodes.toDF("target", "t_hash")
    both = edges.join(s, "source", "left").join(t, "target", "left")
    return both.select("edge_id", (~(F.col("source_hash").eqNullSafe(F.col("s_hash")) & F.col("target_hash").eqNullSafe(F.col("t_hash")))).alias("stale"))


def dangling(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def effective_satisfaction(automatic: DataFrame, reviewed: DataFrame) -> DataFrame:
    """automatic (id, state, satisfied) overlaid by reviews of the satisfaction as the fold gives them (id, status,
    verdict): a reviewed one counts, an override as it says and an acceptance as the automatic judgement."""
    both = automatic.join(reviewed, "id", "left")
    human = F.coalesce(F.col("status") == "reviewed", F.lit(False)) & F.col("verdict").isin("accept", "override_satisfied", "override_unsatisfied")
    human = F.coalesce(human, F.lit(False))
    return both.select("id", F.when(human, "human").otherwise("automatic").alias("source"), F.when(human, human_satisfaction(F.col("verdict"), F.col("satisfied"))).otherwise(F.col("satisfied")).alias("satisfied"))


def entry_status(saved: DataFrame, current: DataFrame) -> DataFrame:
    """saved (id, hash) against current (id, hash): CURRENT, STALE, ORPHANED; without any: NO_ENTRY."""
    s, c = saved.toDF("id", "s").withColumn("a", F.lit(1)), current.toDF("id", "c").withColumn("b", F.lit(1))
    return s.join(c, "id", "full_outer").select("id", F.when(F.col("a").isNull(), "NO_ENTRY").when(F.col("b").isNull(), "ORPHANED").when(F.col("s").eqNullSafe(F.col("c")), "CURRENT").otherwise("STALE").alias("status"))


def stratified_sample(df: DataFrame, strata: list[str], order: list[str], size: int, whole: int = 10) -> DataFrame:
    """A deterministic sample: strata of up to ``whole`` rows are taken whole, the rest of ``size`` goes to
    the others in proportion by largest remainders, evenly spaced in ``order``. Sampling is the feature."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    taken = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= whole, F.col("n"))), F.lit(0)).alias("small"), F.coalesce(F.sum(F.when(F.col("n") > whole, F.col("n"))), F.lit(0)).alias("large"))
    q = counts.crossJoin(F.broadcast(taken)).withColumn("share", F.when(F.col("n") > whole, F.greatest(F.lit(size) - F.col("small"), F.lit(0)) * F.col("n") / F.col("large")))
    q = q.withColumn("base", F.floor("share"))
    left = q.agg((F.first(F.greatest(F.lit(size) - F.col("small"), F.lit(0))) - F.sum("base")).alias("left"))
    extra = F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.col("share") - F.col("base"), F.lit(-1.0))), *strata))  # one row a stratum
    quota = q.crossJoin(F.broadcast(left)).withColumn("x", extra).withColumn("quota", F.when(F.col("n") <= whole, F.col("n")).otherwise(F.least("n", F.col("base") + F.when(F.col("x") <= F.col("left"), 1).otherwise(0)))).select(*strata, "n", "quota")
    # positions in a stratum: numbers over all rows, less those of the strata before it (one row a stratum)
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = numbered(df, [*strata, *order]).join(before, strata).withColumn("_i", (F.col("number") - F.col("_before") - 1).cast("int")).drop("number", "_before")
    picks = quota.where("quota > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    wanted = picks.select(*strata, F.floor((F.col("_k") + 0.5) * F.col("n") / F.col("quota")).cast("int").alias("_i"))
    return ranked.join(wanted, [*strata, "_i"]).drop("_i")


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of pairs and their ratios. A row may stand for n pairs on both sides (column n)."""
    n = lambda side: F.max("n") if "n" in side.columns else F.lit(1).cast("long")
    both = found.groupBy(*keys).agg(n(found).alias("f")).join(truth.groupBy(*keys).agg(n(truth).alias("t")), keys, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.coalesce("f", "t"))), F.lit(0))
    out = both.agg(count(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("true_positives"), count(F.col("t").isNull()).alias("false_positives"), count(F.col("f").isNull()).alias("false_negatives"))
    tp = F.col("true_positives")
    ratio = lambda other: F.when(tp + F.col(other) > 0, tp / (tp + F.col(other)))
    return out.withColumn("precision", ratio("false_positives")).withColumn("recall", ratio("false_negatives"))


def coverage_matrix(a: DataFrame, b: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of a and b rows by what links say of them: linked, a without any, b without any."""
    la, lb = links.select(F.col("a_id").alias("id")).distinct(), links.select(F.col("b_id").alias("id")).distinct()
    part = lambda df, l, side: df.join(l.withColumn("_l", F.lit(True)), "id", "left").groupBy(F.lit(side).alias("side"), F.when(F.col("_l"), "linked").otherwise("unlinked").alias("coverage")).agg(F.count("*").alias("n"))
    return part(a, la, "a").union(part(b, lb, "b"))


def gates(checks: dict[str, Column]) -> Column:
    """Names of the failed gates of a row, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


# fixed values: what a link says of the correspondence, by its method
CONFIRMED, OPEN, NONE = "対応あり", "要確認", "未対応"


def trace_judgement(method: Column) -> Column:
    """An identity is confirmed; no link is none; all else, title candidates too, is to be confirmed by a person."""
    return F.when(method.isin("exact", "code"), CONFIRMED).when(method.isNull() | method.isin("", "none"), NONE).otherwise(OPEN)


def public_confidence(method: Column, confidence: Column) -> Column:
    """The confidence that is shown: none for title candidates, whose strength isn't measured; 0 where it is missing."""
    return F.when(method.isNotNull() & (method != "title_candidate"), F.coalesce(confidence, F.lit(0.0)))


def judgement_summary(links: DataFrame) -> DataFrame:
    """a_id, judgement, confidence, links: the best judgement of a row's links (a_id, method, confidence; a row
    without a link has one of a null method) and the highest confidence that is shown."""
    rank = F.when(trace_judgement(F.col("method")) == CONFIRMED, 2).when(trace_judgement(F.col("method")) == OPEN, 1).otherwise(0)
    out = links.groupBy("a_id").agg(F.max(rank).alias("r"), F.max(public_confidence(F.col("method"), F.col("confidence"))).alias("confidence"), F.count("method").alias("links"))
    return out.select("a_id", F.when(F.col("r") == 2, CONFIRMED).when(F.col("r") == 1, OPEN).otherwise(NONE).alias("judgement"), "confidence", "links")

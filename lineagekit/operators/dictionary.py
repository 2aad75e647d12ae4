"""Terminology: candidates mined from text, conflicts, layers, resolution, promotion, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: the order of scopes, states and the changes of state that are allowed, review decisions
SCOPES = ["SESSION", "PROJECT", "DOMAIN", "STANDARD"]
STATES = ("PROBATION", "ACTIVE", "OBSERVING", "QUARANTINED", "RETIRED")
TRANSITIONS = {
    "PROBATION": ("ACTIVE", "QUARANTINED", "RETIRED"), "ACTIVE": ("OBSERVING", "QUARANTINED", "RETIRED"),
    "OBSERVING": ("ACTIVE", "QUARANTINED", "RETIRED"), "QUARANTINED": ("ACTIVE", "OBSERVING", "RETIRED"),
}
DECISIONS = ("ACCEPT", "REJECT", "UNCERTAIN", "UNREVIEWED")


def term_candidates(units: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """term, exposure, documents, rules of terms that patterns (name -> regex with one group) find.

    ``units``: doc, unit, text. Terms are compared by their folded form.
    """
    branches = [units.select("doc", "unit", F.lit(rule).alias("rule"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("display")) for rule, p in patterns.items()]
    found = branches[0]
    for b in branches[1:]:
        found = found.union(b)
    found = found.withColumn("term", T.comparison_key(F.col("display"))).where("term <> ''")
    return found.groupBy("term").agg(F.countDistinct("doc", "unit").alias("exposure"), F.countDistinct("doc").alias("documents"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.min("display").alias("display"))


def alias_pairs(units: DataFrame, pattern: str) -> DataFrame:
    """(canonical, alias) of ``canonical (alias)`` in text; the regex has both as groups."""
    each = units.select(F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("m"))
    return each.select(T.comparison_key(F.regexp_extract("m", pattern, 1)).alias("canonical"), T.comparison_key(F.regexp_extract("m", pattern, 2)).alias("alias")).where("canonical <> '' and alias <> '' and canonical <> alias").distinct()


def alias_conflicts(pairs: DataFrame) -> DataFrame:
    """Aliases of more than one canonical term."""
    return pairs.groupBy("alias").agg(F.countDistinct("canonical").alias("canonicals"), F.min("canonical").alias("first"), F.max("canonical").alias("last")).where("canonicals > 1")


def lookup_keys(entries: DataFrame) -> DataFrame:
    """(key, canonical, scope, kind) of entries (canonical, aliases, scope, status) that are active."""
    active = entries.where("status = 'ACTIVE'")
    own = active.select(T.comparison_key(F.col("canonical")).alias("key"), "canonical", "scope", F.lit("canonical").alias("kind"))
    each = active.select(F.explode("aliases").alias("alias"), "canonical", "scope")
    other = each.select(T.comparison_key(F.col("alias")).alias("key"), "canonical", "scope", F.lit("alias").alias("kind"))
    return own.union(other).where("key <> ''")


def conflicts(keys: DataFrame) -> DataFrame:
    """Keys that lead to more than one canonical term within a scope."""
    return keys.groupBy("scope", "key").agg(F.countDistinct("canonical").alias("canonicals")).where("canonicals > 1")


def merged_layers(keys: DataFrame) -> DataFrame:
    """One canonical term a key: of the nearest scope without a conflict there, then by spelling."""
    clear = keys.join(conflicts(keys).select("scope", "key"), ["scope", "key"], "left_anti")
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(SCOPES) for x in (s, i)])
    return clear.groupBy("key").agg(F.min_by(F.struct("canonical", "scope"), F.struct(F.coalesce(rank[F.col("scope")], F.lit(99)).alias("p"), F.col("canonical").alias("c"), F.col("kind").alias("k"))).alias("w"), F.countDistinct("canonical").alias("rivals")).select("key", "w.canonical", "w.scope", "rivals")


def resolve(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """terms (id, term) with canonical and status: canonical, alias, conflict or unknown."""
    canonical = keys.where("kind = 'canonical'").select("key", F.col("canonical").alias("c1")).distinct()
    alias = keys.where("kind = 'alias'").groupBy("key").agg(F.min("canonical").alias("c2"), F.countDistinct("canonical").alias("n"))
    looked = terms.withColumn("key", T.comparison_key(F.col("term"))).join(canonical, "key", "left").join(alias, "key", "left")
    status = F.when(F.col("c1").isNotNull(), "canonical").when(F.col("n") == 1, "alias").when(F.col("n") > 1, "conflict").otherwise("unknown")
    return looked.select("id", "term", F.coalesce("c1", F.when(F.col("n") == 1, F.col("c2"))).alias("canonical"), status.alias("status"))


def promotion(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (id) with the latest decision (id, decision, seq) and whether they may be promoted."""
    latest = decisions.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"))
    return candidates.join(latest, "id", "left").select("id", F.coalesce("decision", F.lit("UNREVIEWED")).alias("decision"), (F.coalesce("decision", F.lit("")) == "ACCEPT").alias("eligible"))


def materialized(dictionary: DataFrame, promoted: DataFrame) -> DataFrame:
    """Upsert of (canonical, aliases): aliases are united; the key is the folded canonical term."""
    key = lambda df: df.withColumn("key", T.comparison_key(F.col("canonical")))
    d, p = key(dictionary), key(promoted).withColumnsRenamed({"canonical": "p_canonical", "aliases": "p_aliases"})
    none = F.array().cast("array<string>")
    return d.join(p, "key", "full_outer").select(F.coalesce("canonical", "p_canonical").alias("canonical"), F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("p_aliases", none))).alias("aliases"), F.when(F.col("canonical").isNull(), "added").when(F.col("p_canonical").isNull(), "kept").otherwise("merged").alias("change"))


def allowed_transition(state: str, to: str):
    """Whether a change of state between two columns is allowed; no state changes to itself, null ones are not."""
    pairs = [F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs]
    return F.coalesce(F.array_contains(F.array(*pairs), F.concat(F.col(state), F.lit(">"), F.col(to))), F.lit(False))


def history_problems(snapshots: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, version, supersedes) whose predecessor is missing or not of a lower version."""
    older = snapshots.select(F.col("snapshot_id").alias("supersedes"), F.col("version").alias("older"))
    return snapshots.where("supersedes is not null").join(older, "supersedes", "left").where("older is null or older >= version").select("snapshot_id", F.when(F.col("older").isNull(), "missing").otherwise("not_lower").alias("problem"))


def next_version(version):
    """A decimal version string of any length up to 38 digits, plus one."""
    return (version.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")


def repeated_values(candidates: DataFrame, rule: str = "TERM_REPEATED_VALUE", least: int = 2) -> DataFrame:
    """Candidates (rules: array, parents) without those that only the rule of repeated values found under fewer
    than ``least`` different parents."""
    return candidates.where(~((F.size("rules") == 1) & F.array_contains("rules", rule) & (F.col("parents") < least)))


def evaluation_summary(candidates: DataFrame) -> DataFrame:
    """rule, candidates, exposure: one row a rule, and one for all with the rule null."""
    by_rule = candidates.select(F.explode("rules").alias("rule"), "exposure").groupBy("rule").agg(F.count("*").alias("candidates"), F.sum("exposure").alias("exposure"))
    return by_rule.union(candidates.agg(F.lit(None).cast("string").alias("rule"), F.count("*").alias("candidates"), F.coalesce(F.sum("exposure"), F.lit(0)).alias("exposure")))


def review_counts(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """decision, n: how many candidates (id) have which latest decision (id, decision, seq); those without are UNREVIEWED."""
    latest = decisions.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"))
    known = candidates.select("id").join(latest, "id", "left").select(F.coalesce("decision", F.lit("UNREVIEWED")).alias("decision"))
    return known.groupBy("decision").agg(F.count("*").alias("n"))


def bulk_decisions(candidates: DataFrame, chosen: Column, decision: str, seq: int) -> DataFrame:
    """One decision (id, decision, seq) for every candidate that ``chosen`` holds for."""
    if decision not in DECISIONS:
        raise ValueError(f"no decision {decision}")
    return candidates.where(chosen).select("id", F.lit(decision).alias("decision"), F.lit(seq).cast("long").alias("seq"))


def identity_differences(reviewed: DataFrame, evaluated: DataFrame) -> DataFrame:
    """id, missing_in of ids that are on one side only; promotion needs both sets to be equal."""
    r, e = reviewed.select("id").distinct(), evaluated.select("id").distinct()
    return r.join(e, "id", "left_anti").withColumn("missing_in", F.lit("evaluated")).union(e.join(r, "id", "left_anti").withColumn("missing_in", F.lit("reviewed")))


def entry_problems(entries: DataFrame, most_aliases: int = 64) -> DataFrame:
    """dictionary_id, entry_id, problems of entries that have any: ids, statuses, terms and aliases."""
    w = Window.partitionBy("dictionary_id", "entry_id")
    t = Window.partitionBy("dictionary_id", T.comparison_key(F.col("canonical_term")))
    checks = (
        ("entry_id_missing", F.coalesce("entry_id", F.lit("")) == ""), ("entry_id_duplicate", F.count("*").over(w) > 1), ("status_unknown", ~F.coalesce(F.col("status").isin(*STATES), F.lit(False))),
        ("canonical_term_missing", F.coalesce(F.trim("canonical_term"), F.lit("")) == ""), ("canonical_term_duplicate", F.count("*").over(t) > 1), ("too_many_aliases", F.size("aliases") > most_aliases),
        ("alias_duplicate", F.size(F.array_distinct("aliases")) < F.size("aliases")), ("alias_is_canonical", F.array_contains("aliases", F.col("canonical_term"))),
    )
    named = entries.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks])))
    return named.where(F.size("problems") > 0).select("dictionary_id", "entry_id", "problems")


def layer_view(entries: DataFrame) -> DataFrame:
    """scope, lookup, canonical, status: a row for the canonical term of each active entry and for each alias."""
    active = entries.where("status = 'ACTIVE'")
    terms = F.explode(F.array_union(F.array("canonical_term"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return active.select("scope", terms.alias("term"), F.col("canonical_term").alias("canonical"), "status").select("scope", T.comparison_key(F.col("term")).alias("lookup"), "canonical", "status")


def snapshot_problems(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, problem: payload and wrapper hashes that aren't those of the content.

    ``snapshots``: snapshot_id, version, scope, payload, payload_sha256, wrapper_sha256. A wrapper's hash is
    that of its netstrings.
    """
    payload = F.sha2(F.col("payload").cast("binary"), 256)
    parts = [F.col("snapshot_id"), F.col("version").cast("string"), F.col("scope"), F.col("payload_sha256")]
    wrapper = F.sha2(F.concat(*[T.netstring(F.coalesce(p, F.lit(""))) for p in parts]).cast("binary"), 256)
    problem = F.when(~payload.eqNullSafe(F.col("payload_sha256")), "payload_hash").when(~wrapper.eqNullSafe(F.col("wrapper_sha256")), "wrapper_hash")
    return snapshots.select("snapshot_id", problem.alias("problem")).where("problem is not null")


def activation(events: DataFrame) -> DataFrame:
    """scope, snapshot_id, state of snapshots by their latest event (scope, snapshot_id, state, seq), and whether
    the scope has one active snapshot exactly."""
    latest = events.groupBy("scope", "snapshot_id").agg(F.max_by("state", "seq").alias("state"))
    return latest.withColumn("sound", F.count_if(F.col("state") == "ACTIVE").over(Window.partitionBy("scope")) == 1)


def pin_problems(pins: DataFrame, snapshots: DataFrame) -> DataFrame:
    """project, problem of pins (project, snapshot_id, payload_sha256) without their snapshot or of another content."""
    s = snapshots.select("snapshot_id", F.col("payload_sha256").alias("_sha"))
    problem = F.when(F.col("_sha").isNull(), "snapshot_missing").when(~F.col("_sha").eqNullSafe(F.col("payload_sha256")), "payload_changed")
    return pins.join(s, "snapshot_id", "left").select("project", problem.alias("problem")).where("problem is not null")


def initial_tags(records: DataFrame, vocabulary: DataFrame, folded: bool) -> DataFrame:
    """id, tags: vocabulary tags (tag, aliases) that a record's values (id, values) name exactly or by an alias.

    ``folded`` compares folded forms, as for running text; else as written, as for cells.
    """
    form = (lambda c: T.comparison_key(c)) if folded else (lambda c: c)
    names = vocabulary.select("tag", F.explode(F.array_union(F.array("tag"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("tag", form(F.col("name")).alias("name"))
    each = records.select("id", F.explode("values").alias("value")).select("id", form(F.col("value")).alias("name"))
    return each.join(names, "name").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


# fixed values: what is counted of an entry, the largest total that is exact in every reader
UTILITY = ("exposure_count", "match_opportunity_count", "candidate_gain", "ranking_gain", "candidate_noise_increase", "alias_conflict_count", "document_support_count")
MOST_EXACT = 2**53 - 1


def learning_summary(entries: DataFrame) -> DataFrame:
    """dictionary_id, entry_count, status_counts, utility_totals (maps with every state and field) and error of entries
    (dictionary_id, status, utility map): nothing of an entry's terms. A count that is missing is 0; a total beyond
    2^53 - 1 makes the error DICTIONARY_UTILITY_TOTAL_OVERFLOW."""
    totals = [F.sum(F.coalesce(F.col("utility")[f], F.lit(0)).cast("decimal(38,0)")).alias(f) for f in UTILITY]
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATES]
    got = entries.groupBy("dictionary_id").agg(F.count("*").alias("entry_count"), *counts, *totals)
    pairs = lambda names, kind: F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast(kind))))
    over = F.greatest(*UTILITY) > F.lit(MOST_EXACT)
    return got.select("dictionary_id", "entry_count", pairs(STATES, "long").alias("status_counts"), pairs(UTILITY, "long").alias("utility_totals"), F.when(over, "DICTIONARY_UTILITY_TOTAL_OVERFLOW").alias("error"))


def shareable_summary(candidates: DataFrame, aliases: DataFrame, conflicts: DataFrame, rejected: DataFrame) -> DataFrame:
    """key, value: the counts of an extraction that may be shared. ``candidates`` have an array of rules each."""
    one = lambda df, key: df.agg(F.count("*").alias("value")).select(F.lit(key).alias("key"), "value")
    by_rule = candidates.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("value")).select(F.concat(F.lit("counts_by_rule."), "rule").alias("key"), "value")
    held = candidates.sparkSession.range(1).select(F.lit("content_included").alias("key"), F.lit(0).cast("long").alias("value"))
    return one(candidates, "candidate_count").union(one(aliases, "alias_candidate_count")).union(one(conflicts, "conflict_count")).union(one(rejected, "rejected_count")).union(by_rule).union(held)

"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame work: features are built-in functions, trees are fitted by Spark ML on
labelled URLs and scored on the JVM. No Python runs on executors.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to
``?``, ``#`` or the end. Null URLs and such without ``://`` have both empty. A rule fits its host and
all subdomains of it if the URL's path starts with the rule's; the longest rule wins.
URLs that no rule fits get the model's verdict, null and empty ones included (all features 0 or null
safe). Rules and labelled URLs are small tables of a checked size. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

# fixed values: the rules of the query, (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_RULES, MAX_LABELLED, MAX_SUFFIXES = 200, 200_000, 10_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "host_hyphens", "parameters", "parameter_length", "entropy", "host_entropy", "escapes", "suffix_odds", "suffix_share")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def rule_column(host: Column, path: Column, rules: tuple[tuple[str, str], ...], value: int) -> Column:
    """Of the longest fitting rule: itself (value 0) or its verdict (1); else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are turned into one expression")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first, so it is put on last
        rule_host, slash, rest = rule[0].partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[value])).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character; 0 for empty texts."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), F.lit(0.0))


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with a struct column ``_f`` of lexical features and ``_suffix``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = url_parts(F.col(url_col))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.length(url).cast("double")
    values = {
        "url_length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, r"[^.]+"), "digit_ratio": F.when(length > 0, count(url, "[0-9]") / length).otherwise(0.0),
        "hyphens": count(url, "-"), "host_hyphens": count(host, "-"), "parameters": count(query, "[^&;]+"), "parameter_length": F.length(query).cast("double"),
        "entropy": _entropy(url), "host_entropy": _entropy(host), "escapes": count(url, "%[0-9A-Fa-f]{2}"),
    }
    return df.withColumn("_f", F.struct(*[v.alias(k) for k, v in values.items()])).withColumn("_suffix", F.regexp_extract(host, r"([^.]*)$", 1))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """_suffix, suffix_odds, suffix_share over labelled URLs; the most frequent of MAX_SUFFIXES."""
    total = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    n, rate = total["n"], total["rate"] if total["rate"] is not None else 0.5
    got = labelled.groupBy("_suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("seen"))
    odds = F.log((F.col("bad") + 4 * rate + 0.1) / (F.col("seen") - F.col("bad") + 4 * (1 - rate) + 0.1))
    return got.orderBy(F.desc("seen"), "_suffix").limit(MAX_SUFFIXES).select("_suffix", odds.alias("suffix_odds"), (F.col("seen") / max(n, 1)).alias("suffix_share"))


def labelled_urls(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled URLs (url, label) made by rule; label 1 for what filters commonly block.

    Wanted: one to three plain words as host, short paths of words, at times a date, a number or one
    parameter. Unwanted, each with some of: numeric or random hosts, bait words joined by hyphens, many
    parameters, escaped redirects, deep paths of tokens.
    """
    h = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words.split()]), (h(salt, len(words.split())) + 1).cast("int"))
    token = lambda salt, length: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256), 1, length)
    some = lambda salt, most, value: F.when(h(salt, most) == 0, value).otherwise(F.lit(""))
    words = "garden river history city music school museum science forum kitchen house walk notes guide times press market library travel weather"
    suffix = pick("com org net edu info de fr es co.uk io gov eu", "s")
    host = F.concat(some("w", 2, F.concat(pick("www blog docs news shop", "p"), F.lit("."))), pick(words, "a"), some("b", 2, pick(words, "c")), some("d", 5, F.concat(F.lit("-"), pick(words, "e"))), F.lit("."), suffix)
    path = F.concat(F.lit("/"), some("f", 2, F.concat(pick(words, "g"), F.lit("/"))), some("h", 3, F.concat(pick("2009 2014 2018 2021", "i"), F.lit("/"))), pick(words, "j"), some("k", 3, F.concat(F.lit("-"), pick(words, "l"))), pick("/ .html .php .pdf /index", "m"), some("n", 6, F.concat(F.lit("?"), pick("page id lang section", "o"), F.lit("="), (h("q", 90) + 1).cast("string"))))
    wanted = F.concat(pick("https:// https:// http://", "r"), host, path)
    bait = F.concat_ws("-", pick("free cheap best hot easy instant secret lucky", "t"), pick("pills loans bets prizes money deals followers slots casino", "u"), some("v", 2, h("x", 999).cast("string")))
    number = F.concat_ws(".", *[(h(f"y{i}", 254) + 1).cast("string") for i in range(4)])
    rough = F.concat(token("z", 14), F.lit("."), pick("top xyz click info biz ru", "A"))
    bad_host = F.when(h("B", 3) == 0, F.concat(bait, F.lit("."), pick("com net top biz info", "C"))).when(h("B", 3) == 1, rough).otherwise(F.when(h("D", 2) == 0, number).otherwise(F.concat(token("E", 8), F.lit("."), bait, F.lit(".com"))))
    query = F.concat(F.lit("?id="), token("F", 20), F.lit("&sid="), token("G", 12), F.lit("&aff="), h("H", 99999).cast("string"), some("I", 2, F.concat(F.lit("&to=http%3A%2F%2F"), token("J", 10), F.lit("%2F"))))
    bad_path = F.concat(F.lit("/"), some("K", 2, F.concat(token("L", 10), F.lit("/"), token("M", 16), F.lit("/"))), pick("go click out win offer login", "N"), F.when(h("O", 3) > 0, query).otherwise(F.concat(F.lit("-"), bait)))
    unwanted = F.concat(pick("http:// http:// https://", "P"), bad_host, bad_path)
    label = h("Q", 3) == 0
    return spark.range(n).select(F.when(label, unwanted).otherwise(wanted).alias("url"), F.when(label, 1.0).otherwise(0.0).alias("label"))


def features(df: DataFrame, url_col: str, suffixes: DataFrame) -> DataFrame:
    """Adds the columns FEATURES and drops the helpers."""
    wide = lexical(df, url_col).join(F.broadcast(suffixes), "_suffix", "left")
    lex = [F.col(f"_f.{k}").alias(f"_{k}") for k in FEATURES if not k.startswith("suffix_")]
    return wide.select(*[c for c in df.columns], *lex, F.coalesce("suffix_odds", F.lit(0.0)).alias("_suffix_odds"), F.coalesce("suffix_share", F.lit(0.0)).alias("_suffix_share"))


class UrlModel:
    """Trees fitted on labelled URLs (url, label 0/1), of which at most MAX_LABELLED are given."""

    def __init__(self, labelled: DataFrame, trees: int = 12, depth: int = 4, seed: int = 7):
        rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")).where("label is not null")
        if (n := rows.count()) > MAX_LABELLED:
            raise ValueError(f"{n} labelled urls; at most {MAX_LABELLED}")
        self.suffixes = suffix_statistics(lexical(rows, "url"))
        self.assembler = VectorAssembler(inputCols=[f"_{k}" for k in FEATURES], outputCol="_features")
        train = self.assembler.transform(features(rows, "url", self.suffixes)).select("_features", "label")
        self.kinds = [r["label"] for r in train.select("label").distinct().collect()]
        if len(self.kinds) > 1:
            self.model = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_p", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed).setRawPredictionCol("_r").setProbabilityCol("_q").fit(train)

    def verdict(self, df: DataFrame, url_col: str) -> DataFrame:
        """``df`` with the column ``model_verdict``. One class only in the labels: always that one."""
        if len(self.kinds) < 2:
            return df.withColumn("model_verdict", F.lit("block" if self.kinds == [1.0] else "allow"))
        scored = self.model.transform(self.assembler.transform(features(df, url_col, self.suffixes)))
        return scored.select(*df.columns, F.when(F.col("_p") == 1.0, "block").otherwise("allow").alias("model_verdict"))


def url_filter(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, model_verdict: one row per input row."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    judged = model.verdict(rows, "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = (rule_column(F.col("host"), F.col("path"), rules, k) for k in (0, 1))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "model_verdict").alias("verdict"), "model_verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, UrlModel(labelled_urls(spark)))


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL: dict[str, str] = {}

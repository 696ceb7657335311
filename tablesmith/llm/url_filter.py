"""URL filter: rules first, gradient-boosted trees on lexical features for the rest (DataFrame functions and Spark ML only).

A rule names a host and the start of a path (``example.org/en/1``). It fits its host and all subdomains if the URL's path starts with
its path; of several the longest wins. URLs that a rule decides are the labelled URLs. The trees are fitted to a bounded sample
of them (``sample_rows`` rows with the smallest hash of the URL, the documented bound) on length, depth, digit ratio, entropy, parameter
counts and suffix statistics, and judge the URLs that no rule fits. Suffix statistics are smoothed block rates of the last label of the host,
the last two labels and the first path segment, counted on the sample, so the table that is broadcast has at most three rows
per sampled URL.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by its features like any other.
Without labelled URLs, or with one verdict among them, there is nothing to learn and that verdict (``allow`` if none) holds
for the rest. Rows that repeat are judged alike. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import hash_sample, only

# The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLE_ROWS = 4000
PRIOR = 5.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)  # the first, as the search goes from the left
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for word, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        on, slash, start = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    size = F.greatest(F.size(chars), F.lit(1))
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    return -F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def features(df: DataFrame) -> DataFrame:
    """Adds the lexical features f_* and the suffixes s_* to (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    f = {
        "f_length": F.length(url).cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_digits": digits / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": _entropy(url),
        "f_host_entropy": _entropy(F.col("host")),
        "f_params": F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("="), F.lit("")))).cast("double")),
        "f_fragment": url.contains("#").cast("double"),
        "f_ending": F.col("path").rlike(r"\.[a-z0-9]{1,5}$").cast("double"),
        "f_secure": url.startswith("https").cast("double"),
    }
    s = {"s_last": F.substring_index("host", ".", -1), "s_two": F.substring_index("host", ".", -2), "s_path": F.get(F.split("path", "/", 3), F.lit(1))}
    return df.withColumns(f | {k: F.coalesce(v, F.lit("")) for k, v in s.items()})


SUFFIXES = ("s_last", "s_two", "s_path")
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_host_entropy", "f_params", "f_fragment", "f_ending", "f_secure"]


def suffix_rates(sample: DataFrame) -> DataFrame:
    """(kind, value, rate): smoothed share of blocked URLs by suffix, with a row for values never seen."""
    mean = sample.agg(F.avg("label")).first()[0]
    rows = sample.select("label", F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("value")) for s in SUFFIXES])).alias("s"))
    return rows.groupBy("s.kind", "s.value").agg(((F.sum("label") + PRIOR * mean) / (F.count("label") + PRIOR)).alias("rate"))


def with_rates(df: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    for s in SUFFIXES:
        table = rates.where(F.col("kind") == s).select(F.col("value").alias(s), F.col("rate").alias(f"r_{s}"))
        df = df.join(F.broadcast(table), s, "left").withColumn(f"r_{s}", F.coalesce(f"r_{s}", F.lit(mean)))  # bounded by the sample
    return VectorAssembler(inputCols=[*FEATURES, *[f"r_{s}" for s in SUFFIXES]], outputCol="features").transform(df)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[GBTClassificationModel, DataFrame, float] | str:
    """Trees, suffix rates and block rate of a bounded sample; or the only verdict there is."""
    sample = hash_sample(labelled, sample_rows, "url", "host", "path", "verdict")
    sample = cut_lineage(features(sample).withColumn("label", (F.col("verdict") == "block").cast("double")))
    n, blocked = sample.agg(F.count("label"), F.sum("label")).first()
    if not n or blocked in (0, n):
        return "block" if n and blocked else "allow"
    rates = cut_lineage(suffix_rates(sample))
    table = cut_lineage(with_rates(sample, rates, blocked / n).select("features", "label").repartition(2))
    model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=5, maxBins=64).fit(table)
    return model, rates, blocked / n


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the trees' chance of a block (for all URLs)."""
    rows = only(pages, page_id="page_id", url="url")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    fitted = fit(rows.where("rule IS NOT NULL"), sample_rows)
    if isinstance(fitted, str):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(fitted)).alias("verdict"), F.lit(float(fitted == "block")).alias("block_chance"))
    model, rates, mean = fitted
    judged = model.transform(with_rates(features(rows), rates, mean))
    chance = vector_to_array("probability")[1]
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round(chance, 6).alias("block_chance"))

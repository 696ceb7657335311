"""Class imbalance: synthetic minority rows, undersampling, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.knn import knn_join
from ..functions.numbers import hash_uniform
from ..functions.order import rank_by_hash
from ..functions.schema import col, numeric_columns
from ..session import cut_lineage
from ..plans.step import Fitted, look_up, mapping_tables, register

COPIES_PER_BLOCK = 100_000


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.filter(col(target).isNotNull()).groupBy(col(target).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    counts = class_counts(df, target)
    return counts.agg(
        F.max("n").alias("max_count"),
        F.min("n").alias("min_count"),
        (F.max("n").cast("double") / F.min("n").cast("double")).alias("ratio"),
    )


def _features(df: DataFrame, target: str, key: str, given=None) -> list[str]:
    feats = list(given or [c for c in numeric_columns(df) if c not in (target, key)])
    if not feats:
        raise ValueError("no numeric feature columns for class balancing")
    return feats


def _spread(base: DataFrame, key: str, quota: str, most: int) -> DataFrame:
    """One row per synthetic point: copy number 1..quota of each base row.

    ``most`` bounds the quota. A row with many copies is cut into blocks that go to different
    tasks, so no task makes more than COPIES_PER_BLOCK copies of a row at once.
    """
    base = base.filter(F.col(quota) > 0)
    one, step = F.lit(1).cast("long"), F.lit(COPIES_PER_BLOCK).cast("long")
    if most <= COPIES_PER_BLOCK:
        return base.withColumn("_copy", F.explode(F.sequence(one, F.col(quota))))
    blocks = base.withColumn("_block", F.explode(F.sequence(one, F.ceil(F.col(quota) / step).cast("long"))))
    parts = max(base.sparkSession.sparkContext.defaultParallelism, 200)
    blocks = blocks.repartition(parts, col(key), F.col("_block"))
    first = (F.col("_block") - 1) * step + 1
    return blocks.withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("_block") * step, F.col(quota))))).drop("_block")


def _interpolated(points: DataFrame, near: DataFrame, feats: list[str], target: str, key: str, seed: int) -> DataFrame:
    """base + u * (neighbour - base), neighbour and u drawn by hash of (key, copy).

    ``near`` holds the neighbours of a row as an array, so that a row has one partner row in the join.
    """
    lists = near.groupBy(F.col(key).alias("_nk")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *[col(f).cast("double").alias(f"_n{i}") for i, f in enumerate(feats)]))).alias("_near")
    )
    joined = points.join(lists, col(key) == F.col("_nk"), "left")
    ident = F.concat(col(key).cast("string"), F.lit("/"), F.col("_copy").cast("string"))
    pick = F.try_element_at("_near", (F.floor(hash_uniform(ident, seed) * F.size("_near")) + 1).cast("int"))
    u = hash_uniform(ident, seed + 1)
    joined = joined.withColumns({"_pick": pick, "_u": u})
    out = [
        (col(f).cast("double") + F.col("_u") * F.coalesce(F.col("_pick")[f"_n{i}"] - col(f).cast("double"), F.lit(0.0))).alias(f)
        for i, f in enumerate(feats)
    ]
    return joined.select(F.lit(None).cast("bigint").alias(key), *out, col(target), F.lit(True).alias("synthetic"))


def _short_classes(df: DataFrame, target: str, key: str, feats: list[str]) -> tuple[DataFrame, dict, dict]:
    """Rows that points can be made from; what each smaller class lacks of the largest one, and its complete rows."""
    known = df.filter(col(target).isNotNull()).select(col(key).cast("long").alias(key), *feats, target)
    whole = F.lit(True)
    for f in feats:
        whole = whole & col(f).isNotNull()
    counts = {r[0]: (r["n"], r["whole"]) for r in known.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole")).collect()}
    largest = max((n for n, _ in counts.values()), default=0)
    missing = {c: largest - n for c, (n, w) in counts.items() if n < largest and w}
    return known.filter(whole), missing, {c: w for c, (_, w) in counts.items()}


def smote(
    df: DataFrame, target: str, key: str, features: list[str] | None = None, k: int = 5, seed: int = 42
) -> DataFrame:
    """Raises every class to the size of the largest by points between same-class neighbours.

    Rows with a missing feature count as rows of their class, but no point is made from them: a complete row gets floor(missing / complete rows)
    points, and the first (missing mod complete rows) by hash one more. Class totals are therefore exact. Rows without a class stay
    as they are; a class without any complete row stays short.
    """
    feats = _features(df, target, key, features)
    data, missing, complete = _short_classes(df, target, key, feats)
    # every row stays, those with a missing feature or class too; they only take no part in the new points
    original = df.select(col(key).cast("long").alias(key), *[col(f).cast("double").alias(f) for f in feats], target, F.lit(False).alias("synthetic"))
    if not missing:
        return original
    small = data.filter(col(target).isin(list(missing)))
    near = knn_join(small, small, feats, k, key, key, payload=feats, exclude_self=True, by=target)
    ranked = rank_by_hash(small, key, seed, [target], sum(complete[c] for c in missing))
    quota = F.lit(None).cast("long")
    for c, short in missing.items():
        each, rest = divmod(short, complete[c])
        quota = F.when(col(target) == F.lit(c), F.lit(each) + F.when(F.col("_rank") <= rest, 1).otherwise(0)).otherwise(quota)
    points = _spread(ranked.withColumn("_quota", quota.cast("long")), key, "_quota", max(short // complete[c] + 1 for c, short in missing.items()))
    return original.unionByName(_interpolated(points, near, feats, target, key, seed))


def adasyn(
    df: DataFrame, target: str, key: str, features: list[str] | None = None, k: int = 5, seed: int = 42
) -> DataFrame:
    """As smote, with more points where neighbours of other classes prevail.

    Row quota = round(missing * share / sum of shares), share = other-class part of the k neighbours.
    """
    feats = _features(df, target, key, features)
    data, missing, complete = _short_classes(df, target, key, feats)
    # every row stays, those with a missing feature or class too; they only take no part in the new points
    original = df.select(col(key).cast("long").alias(key), *[col(f).cast("double").alias(f) for f in feats], target, F.lit(False).alias("synthetic"))
    if not missing:
        return original
    small = data.filter(col(target).isin(list(missing)))
    around = knn_join(small, data.withColumn("_cls", col(target)), feats, k, key, key, payload=["_cls"], exclude_self=True)
    share = (
        around.join(small.select(col(key).alias("_sk"), col(target).alias("_own")), col(key) == F.col("_sk"))
        .groupBy(key)
        .agg(F.max("_own").alias("_own"), F.avg(F.when(F.col("_cls") != F.col("_own"), 1.0).otherwise(0.0)).alias("_share"))
    )
    share = cut_lineage(share)
    sums = {r["_own"]: r["s"] for r in share.groupBy("_own").agg(F.sum("_share").alias("s")).collect()}
    quota = F.lit(0).cast("long")
    for c, short in missing.items():
        if sums.get(c):
            quota = F.when(F.col("_own") == F.lit(c), F.round(F.col("_share") * F.lit(short / sums[c])).cast("long")).otherwise(quota)
    quotas = share.select(F.col(key).alias("_qk"), quota.alias("_quota"))
    points = _spread(small.join(quotas, col(key) == F.col("_qk")).drop("_qk"), key, "_quota", max(missing.values()))
    near = knn_join(small, small, feats, k, key, key, payload=feats, exclude_self=True, by=target)
    return original.unionByName(_interpolated(points, near, feats, target, key, seed))


def undersample(df: DataFrame, target: str, key: str, seed: int = 42, rows_per_range: int | None = None) -> DataFrame:
    """Every class down to the size of the smallest, choosing by seeded hash of the key."""
    counts = class_counts(df, target).collect()
    smallest = min(r["n"] for r in counts)
    known = df.filter(col(target).isNotNull())
    ranked = rank_by_hash(known, key, seed, [target], sum(r["n"] for r in counts), rows_per_range)
    return ranked.filter(F.col("_rank") <= smallest).drop("_rank")


def _weights_fit(df, s, found):
    counts = class_counts(df, s.column)
    top = counts.agg(F.max("n")).first()[0]
    return Fitted({"largest": top}, mapping_tables("weights", counts.select("cls", (F.lit(float(top or 0)) / F.col("n")).alias("_w")), df, col(s.column), "cls"))


def _weights_apply(df, s, f):
    out = look_up(df, f.tables, "weights", s.column, "cls")
    return out.withColumn(f"{s.column}_weight", F.col("_w")).drop("_w")


def _resampler(fn):
    def apply(df, s, f):
        if not s.key:
            raise ValueError("resampling needs a unique key column")
        extra = {k: v for k, v in s.params.items() if k in ("features", "k", "seed")}
        return fn(df, s.column, s.key, **extra)

    return apply


register("handle_imbalance", "smote", apply=_resampler(smote), changes_rows=True)
register("handle_imbalance", "adasyn", apply=_resampler(adasyn), changes_rows=True)
register(
    "handle_imbalance",
    "random_undersampling",
    apply=lambda df, s, f: undersample(df, s.column, s.key, int(s.params.get("seed", 42))),
    changes_rows=True,
)
register("handle_imbalance", "class_weights", fit=_weights_fit, apply=_weights_apply)

"""Correlations: pairs, matrices, and steps that act on them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import correlations
from ..functions.order import Ranges, running_totals
from ..functions.quantiles import value_cells
from ..functions.schema import col, numeric_columns, require_numeric
from ..plans.step import Fitted, register


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col1, col2, r)`` for every unordered pair; r over rows where both are present.

    Two passes over the table for all pairs together; columns**2 numbers result.
    """
    require_numeric(df, *columns)
    rows = [(a, b, r) for (a, b), r in correlations(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, r double")


def full_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Both triangles and the diagonal, long form."""
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col1 string, col2 string, r double")
    both = F.array(F.struct("col1", "col2", "r"), F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r"))
    return pairs.select(F.inline(both)).unionByName(diagonal)


def matrix_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    return full_matrix(pair_correlations(df, columns), columns)


def with_average_ranks(df: DataFrame, columns: list[str], rows_per_range=None) -> DataFrame:
    """Replaces each column by its average rank (ties share the mean of their positions)."""
    ranges = Ranges.fit_each(df, [[c] for c in columns], rows_per_range, distinct=True)
    for c, fitted in zip(columns, ranges):
        cells = value_cells(df, c, ranges=fitted)
        ranks = cells.select(F.col("v").alias("_lk"), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("_rk"))
        df = df.join(ranks, col(c) == F.col("_lk"), "left").withColumn(c, F.col("_rk")).drop("_lk", "_rk")
    return df


def pair_spearman(df: DataFrame, a: str, b: str, rows_per_range=None) -> DataFrame:
    both = df.select(a, b).filter(col(a).isNotNull() & col(b).isNotNull())
    # equal pairs first: the rank joins then run on distinct pairs with weights
    cells = both.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("w"))
    for c in (a, b):
        ranks = value_cells(both, c, rows_per_range=rows_per_range)
        ranks = ranks.select(F.col("v").alias("_lk"), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(f"rk_{c}"))
        cells = cells.join(ranks, col(c) == F.col("_lk")).drop("_lk")
    x, y, w = F.col(f"rk_{a}"), F.col(f"rk_{b}"), F.col("w")
    # the mean of average ranks is (n + 1) / 2; centre first so that the sums stay small
    half = both.agg(((F.count(F.lit(1)) + 1) / F.lit(2.0)).alias("h")).scalar()
    cells = cells.select(w.alias("w"), (x - half).alias("x"), (y - half).alias("y"))
    sums = cells.agg(
        F.sum(F.expr("w * x * y")).alias("sxy"), F.sum(F.expr("w * x * x")).alias("sxx"), F.sum(F.expr("w * y * y")).alias("syy")
    )
    return sums.select(
        F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")).alias("r")
    )


def pair_kendall(df: DataFrame, a: str, b: str, rows_per_range=None) -> DataFrame:
    """Kendall tau-b in n log n work.

    Rows are compressed to cells (x, y, count). Concordant pairs are counted bit by bit over the
    rank of y: two values first differ at exactly one bit (below a common prefix), the smaller has a
    0 there. Inside each (bit, prefix) group a running sum of zeros along x gives, for each one,
    the cells with smaller x and smaller y; zeros and ones swapped give the discordant pairs.
    """
    both = df.select(col(a).alias("x"), col(b).alias("y")).filter(col(a).isNotNull() & col(b).isNotNull())
    cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ys = value_cells(both, "y", rows_per_range=rows_per_range)
    ranks = ys.select(F.col("v").alias("y"), F.col("dense").alias("rk"))
    total = both.count()
    bits = max(1, int(ranks.agg(F.max("rk")).first()[0] or 0).bit_length())
    cells = cells.join(ranks, "y")
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")
    spread = cells.select("x", "n", "rk", level).select(
        "x",
        "bit",
        F.expr("shiftright(rk, bit + 1)").alias("prefix"),
        F.expr("if((shiftright(rk, bit) & 1) = 0, n, 0L)").alias("zero"),
        F.expr("if((shiftright(rk, bit) & 1) = 1, n, 0L)").alias("one"),
    )
    spread = spread.groupBy("bit", "prefix", "x").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    ranges = Ranges.fit(both, ["x"], rows_per_range, distinct=True)
    if not ranges.single:
        spread = ranges.add(spread)
    run = running_totals(spread, ["bit", "prefix"], ["x"], {"zero": "zero", "one": "one"}, not ranges.single)
    wide = "decimal(38,0)"
    pairs = run.agg(
        F.sum(F.col("one").cast("decimal(19,0)") * F.col("zero_before").cast("decimal(19,0)")).cast(wide).alias("con"),
        F.sum(F.col("zero").cast("decimal(19,0)") * F.col("one_before").cast("decimal(19,0)")).cast(wide).alias("dis"),
    )

    def ties(c):
        n = F.col("n").cast("decimal(19,0)")
        return both.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2).cast("double").alias("t"))

    n0 = F.lit(float(total)) * F.lit(float(total - 1)) / 2
    out = pairs.select((F.col("con") - F.col("dis")).cast("double").alias("s"), ties("x").scalar().alias("tx"), ties("y").scalar().alias("ty"))
    return out.select(
        F.lit(a).alias("col1"),
        F.lit(b).alias("col2"),
        F.try_divide(F.col("s"), F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty"))).alias("r"),
    )


def matrix_by_pairs(df: DataFrame, columns: list[str], one_pair, rows_per_range=None) -> DataFrame:
    out = None
    for a, b in combinations(columns, 2):
        r = one_pair(df, a, b, rows_per_range)
        out = r if out is None else out.unionByName(r)
    return full_matrix(out, columns)


def matrix_spearman(df, columns, rows_per_range=None):
    """Complete columns are ranked once each and correlated in one pass; a pair with NULLs is ranked by itself."""
    row = df.agg(*[F.count_if(col(c).isNull()) for c in columns]).first()
    complete = [c for c, n in zip(columns, row) if not n]
    pairs = None
    if len(complete) > 1:
        pairs = pair_correlations(with_average_ranks(df.select(*complete), complete, rows_per_range), complete)
    for a, b in combinations(columns, 2):
        if not (a in complete and b in complete):
            one = pair_spearman(df, a, b, rows_per_range)
            pairs = one if pairs is None else pairs.unionByName(one)
    return full_matrix(pairs, columns)


def matrix_kendall(df, columns, rows_per_range=None):
    return matrix_by_pairs(df, columns, pair_kendall, rows_per_range)


def pairs_over(df: DataFrame, columns: list[str], threshold: float, strict: bool = True) -> DataFrame:
    """Pairs whose absolute correlation is above (or at) the threshold, reported as absolute value."""
    r = F.abs("r")
    cond = r > threshold if strict else r >= threshold
    return pair_correlations(df, columns).filter(cond).select("col1", "col2", r.alias("correlation"))


def top_pairs(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    return pair_correlations(df, columns).filter("r is not null").orderBy(F.desc("r"), "col1", "col2").limit(top)


# ---- steps

register(
    "handle_correlation", "drop_one", apply=lambda df, s, f: df.drop(s.columns[1]), affected=lambda df, s, f: F.lit(1)
)


def _cov_aggs(df, s):
    require_numeric(df, *s.columns)
    a, b = (col(c).cast("double") for c in s.columns[:2])
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return {
        "mean_a": F.avg(a),
        "mean_b": F.avg(b),
        "aa": F.var_samp(a),
        "bb": F.var_samp(b),
        "ab": F.covar_samp(a, b),
    }


def _pca_pair_fit(df, s, found):
    v = found.values
    values, vectors = np.linalg.eigh(np.array([[v["aa"], v["ab"]], [v["ab"], v["bb"]]]))
    w = vectors[:, int(np.argmax(values))]
    w = w * np.sign(w[int(np.argmax(np.abs(w)))])
    return Fitted({"mean_a": v["mean_a"], "mean_b": v["mean_b"], "wa": float(w[0]), "wb": float(w[1])})


def _pca_pair_apply(df, s, f):
    a, b = s.columns[:2]
    p = f.params
    first = (col(a) - F.lit(p["mean_a"])) * F.lit(p["wa"]) + (col(b) - F.lit(p["mean_b"])) * F.lit(p["wb"])
    return df.withColumn(f"{a}_{b}_pca", first).drop(a, b)


register("handle_correlation", "pca", aggs=_cov_aggs, fit=_pca_pair_fit, apply=_pca_pair_apply)


def _matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    m = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for r in pair_correlations(df, columns).collect():
        m[at[r["col1"]], at[r["col2"]]] = m[at[r["col2"]], at[r["col1"]]] = r["r"] or 0.0
    return m


def _factors(m: np.ndarray) -> list[float]:
    """Diagonal of the inverse; infinite for a column that the others explain exactly."""
    if np.linalg.matrix_rank(m) == len(m):
        return [float(x) for x in np.diag(np.linalg.inv(m))]
    out = []
    for i in range(len(m)):
        rest = [j for j in range(len(m)) if j != i]
        others = m[np.ix_(rest, rest)]
        share = float(m[i, rest] @ np.linalg.pinv(others) @ m[rest, i])
        out.append(float("inf") if share > 1 - 1e-12 else 1 / (1 - share))
    return out


def vif_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Variance inflation factors from the correlation matrix (columns**2 numbers on the driver)."""
    columns = columns or numeric_columns(df)
    values = _factors(_matrix(df, columns))
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "column string, vif double")


def _vif_fit(df, s, found):
    """Drops the column with the highest factor until all are at or below the limit; one pass over the data."""
    columns, limit = list(s.columns), float(s.params.get("max_vif", 10))
    m, left, dropped = _matrix(df, columns), list(range(len(columns))), []
    while len(left) > 1:
        values = _factors(m[np.ix_(left, left)])
        worst = int(np.argmax(values))
        if values[worst] <= limit:
            break
        dropped.append(columns[left.pop(worst)])
    return Fitted({"dropped": dropped})


register("handle_correlation", "vif", fit=_vif_fit, apply=lambda df, s, f: df.drop(*f.params["dropped"]))

"""Chart data. Each function returns the numbers a chart shows, small whatever the table size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_corr, sample_kurtosis, sample_skew
from ..functions.quantiles import exact_quantiles, grouped_quantiles
from ..functions.schema import categorical_columns, col, columns_of, numeric_columns, require_numeric
from ..session import small_or_cut
from ..sources.readers import sample_n
from .clean import fences
from .correlate import matrix_pearson
from .profile import TableProfile, value_counts


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin, lo, hi, n)`` with equal-width left-closed bins (the last closed), empty ones included."""
    require_numeric(df, column)
    c = col(column).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(c.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(i, lo + i * width, lo + (i + 1) * width) for i in range(bins)], "bin int, lo double, hi double")
    return table.join(counts, "bin", "left").na.fill(0, ["n"])


def histogram_stats(df: DataFrame, column: str) -> DataFrame:
    c = col(column).cast("double")
    median = exact_quantiles(df, {column: [0.5]})[column][0.5]
    return df.agg(
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        sample_skew(c).alias("skew"),
        sample_kurtosis(c).alias("kurtosis"),
        F.count_if(c.isNull()).alias("missing"),
    ).withColumn("median", F.lit(median).cast("double"))


def box(df: DataFrame, column: str, group_by: str | None = None) -> DataFrame:
    """``(group, mean, median, q1, q3, iqr, outliers, low_whisker, high_whisker)``."""
    require_numeric(df, column)
    c = col(column).cast("double")
    group = col(group_by).cast("string") if group_by else F.lit("all")
    if group_by:
        q = grouped_quantiles(df, column, [group_by], {"q1": 0.25, "median": 0.5, "q3": 0.75})
        q = small_or_cut(q.select(col(group_by).cast("string").alias("_g"), "q1", "median", "q3"))
    else:
        v = exact_quantiles(df, {column: [0.25, 0.5, 0.75]})[column]
        q = df.sparkSession.createDataFrame([("all", v[0.25], v[0.5], v[0.75])], "_g string, q1 double, median double, q3 double")
        q = F.broadcast(q)  # one row
    lo, hi = fences(F.col("q1"), F.col("q3"))
    inside = c.between(lo, hi)
    joined = df.filter(c.isNotNull()).select(group.alias("group"), c.alias(column)).join(q, F.col("group").eqNullSafe(F.col("_g")))
    return joined.groupBy("group", "q1", "median", "q3").agg(
        F.avg(c).alias("mean"),
        F.count_if(~inside).alias("outliers"),
        F.min(F.when(inside, c)).alias("low_whisker"),
        F.max(F.when(inside, c)).alias("high_whisker"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def scatter_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    cx, cy = col(x).cast("double"), col(y).cast("double")
    return df.agg(
        safe_corr(cx, cy).alias("correlation"),
        F.avg(cx).alias("x_mean"),
        F.avg(cy).alias("y_mean"),
        F.stddev_samp(cx).alias("x_std"),
        F.stddev_samp(cy).alias("y_std"),
    )


def scatter_points(df: DataFrame, x: str, y: str, key: str, color_by=None, size_by=None, n: int = 1000) -> DataFrame:
    names = [key, x, y, *[c for c in (color_by, size_by) if c]]
    return sample_n(df.select(*dict.fromkeys(names)), key, n)


def trendline(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line ``(slope, intercept, r2)``."""
    cx, cy = col(x).cast("double"), col(y).cast("double")
    return df.agg(F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"), F.regr_r2(cy, cx).alias("r2"))


def bar(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """``(value, count, unique_count, missing)`` for the most frequent values (ties by value)."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    unique = counts.agg(F.count(F.lit(1))).scalar()
    missing = df.agg(F.count_if(col(column).isNull())).scalar()
    return counts.orderBy(F.desc("count"), "value").limit(top_n).withColumns({"unique_count": unique, "missing": missing})


def pie(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """``(value, count, share)``: the top values, the rest added to "Other" (and to a real "Other")."""
    counts = value_counts(df.withColumn(column, col(column).cast("string")), column)
    top = [r["value"] for r in counts.orderBy(F.desc("count"), "value").limit(top_n).select("value").collect()]
    label = F.when(F.col("value").isin(top), F.col("value")).otherwise(F.lit("Other")) if top else F.col("value")
    return counts.groupBy(label.alias("value")).agg(F.sum("count").alias("count"), F.sum("share").alias("share"))


def line_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Extent of x (numbers, or seconds for times) and y, mean of y, and the sign of their correlation."""
    cx, cy = _number(df, x), col(y).cast("double")
    trend = F.when(F.col("_r") > 0, "increasing").when(F.col("_r") < 0, "decreasing").otherwise("flat")
    return df.agg(
        F.min(cx).alias("x_min"),
        F.max(cx).alias("x_max"),
        F.min(cy).alias("y_min"),
        F.max(cy).alias("y_max"),
        F.avg(cy).alias("y_mean"),
        safe_corr(cx, cy).alias("_r"),
    ).withColumn("trend", trend).drop("_r")


def _number(df: DataFrame, column: str) -> Column:
    if column in columns_of(df, "datetime"):
        return F.unix_micros(col(column).cast("timestamp")) / F.lit(1e6)
    return col(column).cast("double")


def line_series(df: DataFrame, x: str, y: str, unit: str = "day", group_by: str | None = None) -> DataFrame:
    """``(group, bucket, y_mean, n)`` per time unit: a line of bounded length from any number of rows."""
    group = col(group_by).cast("string") if group_by else F.lit("all")
    bucket = F.date_format(F.date_trunc(unit, col(x)), "yyyy-MM-dd HH:mm:ss")
    return df.groupBy(group.alias("group"), bucket.alias("bucket")).agg(F.avg(col(y).cast("double")).alias("y_mean"), F.count(F.lit(1)).alias("n"))


def line_points(df: DataFrame, x: str, y: str, group_by: str | None = None, columns: int = 500) -> DataFrame:
    """``(group, column, n, x_first, y_first, x_last, y_last, x_low, y_low, x_high, y_high)``: the line over a number or a time, as wide as a chart.

    Of the points in a pixel column a drawn line shows the first, the last, the lowest and the highest (M4 aggregation), so these four
    draw the same line as all points. Points at the same x are taken by y, points of the same y by x. One aggregate, at most ``columns`` rows a group.
    """
    cx, cy = _number(df, x), col(y).cast("double")
    known = df.filter(cx.isNotNull() & cy.isNotNull())
    lo, hi = known.agg(F.min(cx), F.max(cx)).first()
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / columns or 1.0
    at = F.least(F.floor((cx - F.lit(lo)) / F.lit(width)), F.lit(columns - 1)).cast("int")
    group = col(group_by).cast("string") if group_by else F.lit("all")
    along, across = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")), F.struct(F.col("_y").alias("y"), F.col("_x").alias("x"))
    ends = {"first": F.min(along), "last": F.max(along), "low": F.min(across), "high": F.max(across)}
    points = known.select(group.alias("group"), at.alias("column"), cx.alias("_x"), cy.alias("_y"))
    cells = points.groupBy("group", "column").agg(F.count(F.lit(1)).alias("n"), *[e.alias(name) for name, e in ends.items()])
    return cells.select("group", "column", "n", *[F.col(name)[c].alias(f"{c}_{name}") for name in ends for c in ("x", "y")])


def pair_plot(df: DataFrame, columns: list[str], key: str, hue: str | None = None, n: int = 1000):
    """Correlations of the columns over all rows, and a sample of points."""
    points = sample_n(df.select(*dict.fromkeys([key, *columns, *([hue] if hue else [])])), key, n)
    return matrix_pearson(df, columns), points


def count_chart(df: DataFrame, column: str, hue: str | None = None) -> DataFrame:
    keys = [col(column).cast("string").alias("value"), *([col(hue).cast("string").alias("hue")] if hue else [])]
    return df.filter(col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def violin(df: DataFrame, column: str, group_by: str | None = None) -> DataFrame:
    """``(group, mean, median, std, skew, kurtosis)``; the group "all" is the whole column."""
    c = col(column).cast("double")
    parts = [(F.avg(c), "mean"), (F.stddev_samp(c), "std"), (sample_skew(c), "skew"), (sample_kurtosis(c), "kurtosis")]
    aggs = [a.alias(n) for a, n in parts]
    median = exact_quantiles(df, {column: [0.5]})[column][0.5]
    whole = df.agg(*aggs).select(F.lit("all").alias("group"), "*", F.lit(median).cast("double").alias("median"))
    if not group_by:
        return whole
    g = col(group_by).cast("string")
    medians = grouped_quantiles(df, column, [group_by], {"median": 0.5}).select(g.alias("_g"), "median")
    groups = df.groupBy(g.alias("group")).agg(*aggs).join(medians, F.col("group").eqNullSafe(F.col("_g")), "left").drop("_g")
    return whole.unionByName(groups)


#: terms kept of each kernel's expansion; cells are half a kernel's width, so what is left out is below 1e-11 of a kernel
TERMS = 12
#: kernel widths beyond which a kernel is below the last digit of a double
REACH = 9.0


def density(df: DataFrame, column: str, points: int = 1000, bins: int = 20) -> DataFrame:
    """``(point, x, density, scaled)``: Gaussian kernel density (Scott's width) on an even grid, by the fast Gauss transform.

    Values are summed into cells as moments about the cell's centre, which add up over tasks; a cell's kernels are then their Hermite expansion. Work
    is linear in the rows, and a cell meets only the grid points within reach. Tasks send at most ``points`` numbers on.
    """
    c = col(column).cast("double")
    n, lo, hi, std = df.agg(F.count(c), F.min(c), F.max(c), F.stddev_samp(c)).first()
    spark = df.sparkSession
    if not n or not std:
        return spark.createDataFrame([], "point int, x double, density double, scaled double")
    width = std * n ** (-1 / 5)
    grid = np.linspace(lo, hi, points)
    # distances in units of sqrt(2) widths; cells from lo on
    cell = F.floor((c - F.lit(lo)) / F.lit(width / 2)).cast("long")
    t = (c - F.lit(lo) - (F.col("cell") + F.lit(0.5)) * F.lit(width / 2)) / F.lit(width * math.sqrt(2))
    placed = df.filter(c.isNotNull()).withColumn("cell", cell).select("cell", t.alias("t"))
    power, moments = F.lit(1.0), []
    for k in range(TERMS):
        moments.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("t")
    cells = placed.groupBy("cell").agg(*moments)

    def add_up(batches):
        total = np.zeros(points)
        for pdf in batches:
            centres = lo + (pdf["cell"].to_numpy() + 0.5) * (width / 2)
            m = pdf[[f"m{k}" for k in range(TERMS)]].to_numpy(dtype=float)
            m /= np.array([math.factorial(k) for k in range(TERMS)], float)
            first = np.searchsorted(grid, centres - REACH * width)
            last = np.searchsorted(grid, centres + REACH * width, "right")
            for i in range(len(centres)):
                z = (grid[first[i] : last[i]] - centres[i]) / (width * math.sqrt(2))
                before, term = np.zeros_like(z), np.exp(-z * z)
                for k in range(TERMS):  # Hermite functions by their recurrence
                    total[first[i] : last[i]] += m[i, k] * term
                    before, term = term, 2 * z * term - 2 * k * before
        yield pd.DataFrame({"point": np.arange(points, dtype=np.int32), "k": total})

    sums = cells.mapInPandas(add_up, "point int, k double").groupBy("point").agg(F.sum("k").alias("k"))
    peak = histogram(df, column, bins).agg(F.max("n").cast("double")).scalar()
    density = F.col("k") / F.lit(n * width * math.sqrt(2 * math.pi))
    out = sums.select("point", (F.lit(lo) + F.col("point") * F.lit((hi - lo) / (points - 1))).alias("x"), density.alias("density"))
    top = out.agg(F.max("density")).scalar()
    return out.withColumn("scaled", F.col("density") * peak / top)


def group_compare(df: DataFrame, category: str, number: str) -> DataFrame:
    x = col(number).cast("double")
    return df.groupBy(col(category).cast("string").alias("group")).agg(
        F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.count(x).alias("count")
    )


def insight_facts(df: DataFrame, column: str) -> DataFrame:
    """``(mean, median, skew_direction)``."""
    median = exact_quantiles(df, {column: [0.5]})[column][0.5]
    one = df.agg(F.avg(col(column).cast("double")).alias("mean")).withColumn("median", F.lit(median).cast("double"))
    return one.withColumn(
        "skew_direction", F.when(F.col("mean") > F.col("median"), "right").when(F.col("mean") < F.col("median"), "left").otherwise("none")
    )


def recommend_charts(df: DataFrame, top: int = 8) -> DataFrame:
    """``(rank, chart, columns, setting)`` from rules over the profile.

    Ranked by kind (scatter and heat map, box, histogram, bar and pie, others), then by the order
    of the rules. Outlier and correlation rules use the issue tables.
    """
    from .issues import high_correlation, outliers

    p = TableProfile(df)
    num, cat = numeric_columns(df), categorical_columns(df)
    unique = {c: p.unique[c] for c in cat}
    found: list[tuple[int, str, str, str]] = []

    def first(low: int, high: int):
        return next((c for c in cat if low <= unique[c] <= high), None)

    skewed = [c for c in num if p.skew[c] is not None and abs(p.skew[c]) > 1]
    for c in skewed:
        found.append((3, "histogram", c, "log" if p.skew[c] > 2 else "linear"))
    if num:
        for r in outliers(df, num).filter("percent > 0.5").collect():
            found.append((2, "box", r["column"], first(0, 8) or ""))
        strongest = high_correlation(df, num).orderBy(F.desc(F.abs("r")), "col1", "col2") if len(num) > 1 else None
        for r in strongest.limit(3).collect() if strongest is not None else []:
            found.append((1, "scatter", f"{r['col1']},{r['col2']}", first(0, 6) or ""))
    for c in cat:
        if unique[c] <= 15:
            found.append((4, "bar", c, f"top={min(unique[c], 12)}"))
    for c in num:
        if c not in skewed:
            found.append((3, "histogram", c, "linear"))
    if len(num) > 3:
        found.append((1, "heat_map", "", "pearson"))
    for c in columns_of(df, "datetime"):
        if num:
            found.append((5, "line", f"{c},{num[0]}", ""))
    grouping = first(2, 6)
    if grouping and num:
        for c in num[:2]:
            found.append((4, "group_bar", f"{grouping},{c}", f"top={unique[grouping]}"))
    for c in cat:
        if 2 <= unique[c] <= 6:
            found.append((4, "pie", c, ""))
    if len(num) >= 3:
        found.append((5, "pair", ",".join(num[:4]), first(0, 5) or ""))
    ordered = sorted(enumerate(found), key=lambda x: (x[1][0], x[0]))[:top]
    rows = [(i, chart, columns, setting) for i, (_, (_, chart, columns, setting)) in enumerate(ordered, start=1)]
    return df.sparkSession.createDataFrame(rows, "rank int, chart string, columns string, setting string")

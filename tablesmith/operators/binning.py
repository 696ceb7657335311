"""Binning: right-closed bins with the lowest edge included, labelled "Bin 1".."Bin n"."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import col, require_numeric
from ..plans.step import Fitted, Found, Step, register


def bin_index(c: Column, edges: list[float]) -> Column:
    """1-based bin of (edge, edge] intervals; the first also holds its lower edge, outside is NULL."""
    out = F.when(c < F.lit(float(edges[0])), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:], start=1):
        out = out.when(c <= F.lit(float(edge)), F.lit(i))
    return out


def _labelled(df: DataFrame, column: str, index: Column) -> DataFrame:
    return df.withColumns(
        {
            f"{column}_bin_index": index.cast("int"),
            f"{column}_binned": F.when(index.isNotNull(), F.concat(F.lit("Bin "), index.cast("int").cast("string"))),
        }
    )


def _width_aggs(df, s):
    require_numeric(df, s.column)
    return {"min": F.min(col(s.column)).cast("double"), "max": F.max(col(s.column)).cast("double")}


def _width_fit(df, s, found):
    lo, hi, n = found.values["min"], found.values["max"], int(s.params.get("n_bins", 5))
    if lo is None:
        return Fitted({"edges": None})
    return Fitted({"edges": [lo + (hi - lo) * i / n for i in range(n)] + [hi]})


def _width_apply(df, s, f):
    edges = f.params["edges"]
    if edges is None:
        return _labelled(df, s.column, F.lit(None).cast("int"))
    n, lo, hi = len(edges) - 1, edges[0], edges[-1]
    c = col(s.column).cast("double")
    if hi == lo:
        index = F.when(c == lo, F.lit(1))
    else:
        at = F.ceil((c - F.lit(lo)) / F.lit((hi - lo) / n))
        index = F.when(c.between(lo, hi), F.least(F.greatest(at, F.lit(1)), F.lit(n)))
    return _labelled(df, s.column, index)


def _edges_apply(df, s, f):
    edges = f.params["edges"]
    if not edges or len(edges) < 2:
        index = F.when(col(s.column).cast("double") == F.lit(edges[0]), 1) if edges else F.lit(None).cast("int")
        return _labelled(df, s.column, index)
    return _labelled(df, s.column, bin_index(col(s.column).cast("double"), edges))


def _freq_probs(s: Step) -> list[float]:
    n = int(s.params.get("n_bins", 5))
    return [i / n for i in range(n + 1)]


def _freq_needs(df, s):
    require_numeric(df, s.column)
    return {s.column: _freq_probs(s)}


def _freq_fit(df, s, found: Found):
    q = found.quantiles[s.column]
    # repeated quantiles collapse: fewer bins than asked for
    return Fitted({"edges": sorted({q[p] for p in _freq_probs(s) if q[p] is not None})})


def _kmeans_fit(df, s, found):
    require_numeric(df, s.column)
    cells = (
        df.filter(col(s.column).isNotNull())
        .groupBy(col(s.column).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # one weighted point per distinct value: the same centres as on all rows, on fewer points
    vec = VectorAssembler(inputCols=["v"], outputCol="x").transform(cells)
    k = int(s.params.get("n_bins", 5))
    centres = sorted(float(c[0]) for c in KMeans(k=k, seed=42, featuresCol="x", weightCol="n").fit(vec).clusterCenters())
    lo, hi = df.agg(F.min(col(s.column)).cast("double"), F.max(col(s.column)).cast("double")).first()
    middles = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return Fitted({"edges": [lo, *middles, hi], "centres": centres})


def _custom_fit(df, s, found):
    require_numeric(df, s.column)
    edges = sorted(float(e) for e in s.params["bin_edges"])
    if len(edges) < 2:
        raise ValueError("custom bins need at least two edges")
    return Fitted({"edges": edges})


def _counted(df, s, f):
    return F.count(col(s.column))


register("binning", "equal_width", aggs=_width_aggs, fit=_width_fit, apply=_width_apply, affected=_counted)
register("binning", "equal_frequency", quantiles=_freq_needs, fit=_freq_fit, apply=_edges_apply, affected=_counted)
register("binning", "kmeans", fit=_kmeans_fit, apply=_edges_apply, affected=_counted)
register("binning", "custom", fit=_custom_fit, apply=_edges_apply, affected=_counted)


def bin_ranges(df: DataFrame, step: Step, fitted: Fitted, binned: DataFrame) -> DataFrame:
    """``(bin, lo, hi, n)`` per bin, empty ones included."""
    edges = fitted.params["edges"]
    table = df.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]), start=1)], "bin int, lo double, hi double"
    )
    counts = binned.groupBy(F.col(f"{step.column}_bin_index").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return table.join(counts, "bin", "left").na.fill(0, ["n"])

"""Feature selection: a score table per method, and steps that keep the best columns."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import chi2_pvalue, safe_corr
from ..functions.schema import col, is_numeric, require_numeric
from ..models.validate import problem_type
from ..plans.step import Fitted, register


def correlation_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``(feature, score)``: absolute correlation with the target."""
    require_numeric(df, *columns, target)
    one = df.agg(*[F.abs(safe_corr(col(c), col(target))).alias(f"s{i}") for i, c in enumerate(columns)])
    items = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("score")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*items)))


def chi2_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``(feature, chi2, dof, p_value)`` of independence between each category column and the target.

    From contingency counts only; a category with no row of a class still adds its expected count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("x")) for c in columns])
    known = df.filter(col(target).isNotNull()).select(F.inline(pairs), col(target).cast("string").alias("y")).where("x IS NOT NULL")
    cells = known.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    xs = cells.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ys = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    sides = xs.groupBy("feature").agg(F.sum("nx").alias("total"), F.count("x").alias("kx")).join(ys.groupBy("feature").agg(F.count("y").alias("ky")), "feature")
    # sum((n - e)^2 / e) over all cells = total * sum(n^2 / (nx ny)) - total: empty cells need no row
    part = cells.join(xs, ["feature", "x"]).join(ys, ["feature", "y"]).groupBy("feature").agg(F.sum(F.expr("n * n / (nx * ny)")).alias("q"))
    out = part.join(sides, "feature").select("feature", F.expr("total * q - total").alias("chi2"), F.expr("(kx - 1) * (ky - 1)").alias("dof"))
    return out.withColumn("p_value", chi2_pvalue(F.col("chi2"), F.col("dof")))


def vectors(df: DataFrame, columns: list[str], target: str, standardise: bool = True) -> DataFrame:
    """``(features, label)``: complete rows; a text target becomes its index."""
    data = df.select(*[col(c).cast("double") for c in columns], col(target)).dropna()
    if is_numeric(df, target):
        data = data.withColumn("label", col(target).cast("double"))
    else:
        data = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(data).transform(data)
    out = VectorAssembler(inputCols=columns, outputCol="_raw" if standardise else "features").transform(data)
    if standardise:
        out = StandardScaler(withMean=True, inputCol="_raw", outputCol="features").fit(out).transform(out)
    return out.select("features", "label")


def forest_scores(df: DataFrame, columns: list[str], target: str, trees: int = 20) -> dict[str, float]:
    from ..models.train import fit_model  # which needs the operators' steps

    problem = problem_type(df, target)
    data = vectors(df, columns, target, standardise=False).persist()
    try:
        classes = int(data.agg(F.max("label")).first()[0]) + 1 if problem == "classification" else 0
        model = fit_model("random_forest", problem, data, classes, numTrees=trees, maxDepth=5)
    finally:
        data.unpersist()
    return dict(zip(columns, [float(v) for v in model.featureImportances.toArray()]))


def lasso_scores(df: DataFrame, columns: list[str], target: str, alpha: float = 0.1) -> dict[str, float]:
    data = vectors(df, columns, target)
    model = LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False).fit(data)
    return dict(zip(columns, [float(v) for v in model.coefficients.toArray()]))


def rfe_ranking(df: DataFrame, columns: list[str], target: str, keep: int) -> dict[str, int]:
    """Rank 1 for the kept columns; the column dropped last has rank 2, and so on."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors(df, columns, target).persist()
    try:
        classify = problem_type(df, target) == "classification"
        left, dropped = list(range(len(columns))), []
        while len(left) > keep:
            part = data.select(
                array_to_vector(F.transform(F.array(*[F.lit(i) for i in left]), lambda i: vector_to_array("features")[i])).alias(
                    "features"
                ),
                "label",
            )
            if classify:
                weights = abs(LogisticRegression(maxIter=20).fit(part).coefficientMatrix.toArray()).sum(axis=0)
            else:
                weights = abs(LinearRegression(maxIter=20, regParam=1e-6).fit(part).coefficients.toArray())
            dropped.append(left.pop(int(weights.argmin())))
        ranks = {columns[i]: 1 for i in left}
        ranks.update({columns[i]: r for r, i in enumerate(reversed(dropped), start=2)})
        return ranks
    finally:
        data.unpersist()


def _keeper(choose):
    def fit(df, s, found):
        return Fitted({"kept": choose(df, s)})

    return fit


def _best(scores: dict[str, float], s) -> list[str]:
    order = sorted(scores, key=lambda c: (-(scores[c] if scores[c] is not None else -1.0), c))
    if "threshold" in s.params:
        order = [c for c in order if scores[c] is not None and scores[c] > s.params["threshold"]]
    return order[: int(s.params.get("top", 10))]


def _by_corr(df, s):
    rows = correlation_scores(df, list(s.columns), s.params["target_column"]).collect()
    return _best({r["feature"]: r["score"] for r in rows}, s)


def _by_chi2(df, s):
    rows = chi2_scores(df, list(s.columns), s.params["target_column"]).collect()
    return _best({r["feature"]: r["chi2"] for r in rows}, s)


def _by_rfe(df, s):
    ranks = rfe_ranking(df, list(s.columns), s.params["target_column"], int(s.params.get("top", 10)))
    return [c for c in s.columns if ranks[c] == 1]


def _by_lasso(df, s):
    scores = lasso_scores(df, list(s.columns), s.params["target_column"], s.params.get("alpha", 0.1))
    return [c for c in s.columns if abs(scores[c]) > 1e-12]


def _by_forest(df, s):
    return _best(forest_scores(df, list(s.columns), s.params["target_column"]), s)


def _apply(df, s, f):
    """Keeps the chosen columns and every column that was not up for selection."""
    gone = [c for c in s.columns if c not in f.params["kept"]]
    return df.drop(*gone)


for _name, _choose in (
    ("correlation", _by_corr),
    ("chi2", _by_chi2),
    ("rfe", _by_rfe),
    ("lasso", _by_lasso),
    ("random_forest", _by_forest),
):
    register("feature_selection", _name, fit=_keeper(_choose), apply=_apply)

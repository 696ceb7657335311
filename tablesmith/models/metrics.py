"""Evaluation tables over predictions ``(key, label, prediction[, score])``: ordinary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import RANGE, Ranges, running_totals
from ..functions.quantiles import exact_quantiles
from ..functions.schema import col
from ..operators.charts import histogram


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """``(label, prediction, count, row_pct)``."""
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))
    rows = cells.groupBy(F.col("label").alias("_l")).agg(F.sum("count").alias("_n"))
    joined = cells.join(rows, F.col("label").eqNullSafe(F.col("_l")))
    return joined.select("label", "prediction", "count", (F.col("count") * 100.0 / F.col("_n")).alias("row_pct"))


def _per_class(pred: DataFrame) -> DataFrame:
    """``(cls, tp, support, predicted)`` from one count of (label, prediction)."""
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").cast("string").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    return (
        cells.select(F.inline(sides))
        .groupBy("cls")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def _scores() -> dict[str, Column]:
    tp, support, predicted = (F.col(c).cast("double") for c in ("tp", "support", "predicted"))
    precision = F.coalesce(F.try_divide(tp, predicted), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, support), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, predicted + support), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def class_report(pred: DataFrame) -> DataFrame:
    """``(cls, precision, recall, f1, support)``."""
    s = _scores()
    return _per_class(pred).select("cls", *[c.alias(n) for n, c in s.items()], "support")


def metrics_classification(pred: DataFrame) -> DataFrame:
    """``(metric, value)``; precision, recall and F1 weighted by support."""
    s = _scores()
    t, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    sums = _per_class(pred).agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum("support").cast("double").alias("n"),
        *[F.sum(v * t).alias(f"w_{name}") for name, v in s.items()],
        F.avg(F.when(t > 0, s["recall"])).alias("balanced"),
        F.sum(p * t).alias("pt"),
        F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"),
    )
    n = F.col("n")
    mcc = F.try_divide(F.col("c") * n - F.col("pt"), F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt")))
    table = {
        "accuracy": F.try_divide(F.col("c"), n),
        **{name: F.try_divide(F.col(f"w_{name}"), n) for name in s},
        "balanced_accuracy": F.col("balanced"),
        "matthews": F.coalesce(mcc, F.lit(0.0)),
    }
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in table.items()])))


def _score_cells(pred: DataFrame, positive: Column, score: str, by: list[str], rows_per_range=None) -> DataFrame:
    """One row per distinct score (and group) with positives and negatives here and below."""
    data = pred.filter(col(score).isNotNull()).select(
        *by, col(score).cast("double").alias("score"), F.when(positive, 1).otherwise(0).cast("long").alias("pos")
    )
    ranges = Ranges.fit(data, ["score"], rows_per_range, distinct=True)
    cells = data.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    if not ranges.single:
        cells = ranges.add(cells)
    return running_totals(cells, by, ["score"], {"pos": "pos", "neg": "neg"}, not ranges.single).drop(RANGE)


def roc_auc(pred: DataFrame, positive=1, score: str = "score", rows_per_range=None) -> DataFrame:
    """``(auc)``: share of (positive, negative) pairs in the right order, ties one half."""
    cells = _score_cells(pred, F.col("label") == F.lit(positive), score, [], rows_per_range)
    return cells.agg(_auc().alias("auc"))


def _auc() -> Column:
    won = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    return F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def roc_auc_multiclass(pred: DataFrame, scores: dict[str, str], rows_per_range=None) -> DataFrame:
    """``(auc)`` one against the rest per class, weighted by class size. ``scores``: class -> score column."""
    items = F.array(*[F.struct(F.lit(c).alias("cls"), col(s).cast("double").alias("score")) for c, s in scores.items()])
    long = pred.select(F.col("label").cast("string").alias("label"), F.inline(items))
    cells = _score_cells(long, F.col("label") == F.col("cls"), "score", ["cls"], rows_per_range)
    per = cells.groupBy("cls").agg(_auc().alias("auc"), F.sum("pos").cast("double").alias("n"))
    return per.agg(F.try_divide(F.sum(F.col("auc") * F.col("n")), F.sum("n")).alias("auc"))


def roc_auc_of_chances(pred: DataFrame, classes: list, chances: str = "chances", rows_per_range=None) -> DataFrame:
    """``(auc)`` from an array of scores, one per class of ``classes`` in their order: the second one's of two, else as ``roc_auc_multiclass``."""
    if len(classes) == 2:
        scored = pred.withColumn("_score", F.get(chances, F.lit(1)))
        return roc_auc(scored, classes[1], "_score", rows_per_range)
    names = {str(c): f"_score{i}" for i, c in enumerate(classes)}
    scored = pred.withColumns({n: F.get(chances, F.lit(i)) for i, n in enumerate(names.values())})
    return roc_auc_multiclass(scored, names, rows_per_range)


def _curve(pred, positive, score, rows_per_range):
    cells = _score_cells(pred, F.col("label") == F.lit(positive), score, [], rows_per_range)
    totals = pred.filter(col(score).isNotNull()).agg(
        F.count_if(F.col("label") == F.lit(positive)).alias("p"), F.count_if(F.col("label") != F.lit(positive)).alias("n")
    )
    # one row, fetched now: two literals instead of a join
    p, n = totals.first()
    return cells.withColumns({"tp": F.lit(p) - F.col("pos_before"), "fp": F.lit(n) - F.col("neg_before")}), p, n


def roc_curve(pred: DataFrame, positive=1, score: str = "score", rows_per_range=None) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score: predictions at or above it count as positive. Without threshold, the start (0, 0)."""
    cells, p, n = _curve(pred, positive, score, rows_per_range)
    points = cells.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(n))).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(p))).alias("tpr"),
    )
    return points.unionByName(_end(pred, fpr=0.0, tpr=0.0))


def pr_curve(pred: DataFrame, positive=1, score: str = "score", rows_per_range=None) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score. Without threshold, the end (precision 1, recall 0)."""
    cells, p, _ = _curve(pred, positive, score, rows_per_range)
    tp = F.col("tp").cast("double")
    points = cells.select(
        F.col("score").alias("threshold"),
        F.try_divide(tp, tp + F.col("fp")).alias("precision"),
        F.try_divide(tp, F.lit(float(p))).alias("recall"),
    )
    return points.unionByName(_end(pred, precision=1.0, recall=0.0))


def _end(pred: DataFrame, **point: float) -> DataFrame:
    return pred.sparkSession.createDataFrame([(None, *point.values())], "threshold double, " + ", ".join(f"{n} double" for n in point))


def average_precision(pred: DataFrame, positive=1, score: str = "score", rows_per_range=None) -> DataFrame:
    cells, p, _ = _curve(pred, positive, score, rows_per_range)
    tp = F.col("tp").cast("double")
    step = F.try_divide(F.col("pos").cast("double"), F.lit(float(p))) * F.try_divide(tp, tp + F.col("fp"))
    return cells.agg(F.sum(step).alias("average_precision"))


def class_distribution(pred: DataFrame) -> DataFrame:
    """``(label, count, percent)``."""
    n = pred.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = pred.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percent", F.col("count") * 100.0 / n)


# ---- regression


def metrics_regression(pred: DataFrame) -> DataFrame:
    """``(metric, value)``: mse, rmse, mae, r2, explained variance, max error, median absolute error."""
    data = pred.select(F.col("label").cast("double").alias("y"), (F.col("label") - F.col("prediction")).cast("double").alias("e"))
    data = data.withColumn("ae", F.abs("e"))
    median = exact_quantiles(data, {"ae": [0.5]})["ae"][0.5]
    sums = data.agg(
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.avg("ae").alias("mae"),
        F.max("ae").alias("max"),
        F.var_pop("y").alias("vy"),
        F.var_pop("e").alias("ve"),
    )
    table = {
        "mse": F.col("mse"),
        "rmse": F.sqrt("mse"),
        "mae": F.col("mae"),
        "r2": 1 - F.try_divide("mse", "vy"),
        "explained_variance": 1 - F.try_divide("ve", "vy"),
        "max_error": F.col("max"),
        "median_absolute_error": F.lit(median).cast("double"),
    }
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in table.items()])))


def residuals(pred: DataFrame) -> DataFrame:
    return pred.withColumn("residual", (F.col("label") - F.col("prediction")).cast("double"))


def residual_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(residuals(pred), "residual", bins)


def prediction_range(pred: DataFrame) -> DataFrame:
    """Common extent of actual and predicted values, for the diagonal of a scatter chart."""
    return pred.agg(
        F.least(F.min("label"), F.min("prediction")).cast("double").alias("low"),
        F.greatest(F.max("label"), F.max("prediction")).cast("double").alias("high"),
    )


# Coefficients of Acklam's rational approximation of the inverse normal distribution.
PPF_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
PPF_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572]
PPF_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
PPF_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416]
PPF_LOW = 0.02425


def _poly(x: Column, coefficients: list[float], last: float | None = None) -> Column:
    out = F.lit(0.0)
    for k in coefficients + ([last] if last is not None else []):
        out = out * x + F.lit(k)
    return out


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution (relative error about 1e-9)."""
    tail = F.sqrt(-2 * F.ln(F.when(p < 0.5, p).otherwise(1 - p)))
    outer = _poly(tail, PPF_C) / _poly(tail, PPF_D, 1.0)
    q = p - 0.5
    inner = _poly(q * q, PPF_A) * q / _poly(q * q, PPF_B, 1.0)
    return F.when(p < PPF_LOW, outer).when(p > 1 - PPF_LOW, -outer).otherwise(inner)


def qq_points(pred: DataFrame, key: str, rows_per_range=None) -> DataFrame:
    """``(key, position, theoretical, residual)``: ordered residuals against normal quantiles at Filliben's positions."""
    data = residuals(pred).select(key, "residual").withColumn("_one", F.lit(1).cast("long"))
    ranges = Ranges.fit(data, ["residual", key], rows_per_range)
    n = float(ranges.rows)
    if not ranges.single:
        data = ranges.add(data)
    out = running_totals(data, [], ["residual", key], {"rank": "_one"}, not ranges.single)
    i = F.col("rank_before") + 1
    end = 0.5 ** (1 / n) if n else 0.5
    at = F.when(i == 1, F.lit(1 - end)).when(i == F.lit(n), F.lit(end)).otherwise((i - F.lit(0.3175)) / F.lit(n + 0.365))
    return out.select(key, i.alias("position"), normal_ppf(at).alias("theoretical"), "residual")


def qq_line(points: DataFrame) -> DataFrame:
    return points.agg(
        F.regr_slope("residual", "theoretical").alias("slope"),
        F.regr_intercept("residual", "theoretical").alias("intercept"),
        F.sqrt(F.regr_r2("residual", "theoretical")).alias("r"),
    )


# ---- comparing runs

GRADES = {"classification": (0.9, 0.8, 0.7), "regression": (0.9, 0.7, 0.5)}


def best_model(metrics: DataFrame, problem: str) -> DataFrame:
    """``(model, metric, value, grade)`` from ``(model, metric, value, error)`` of all runs.

    Runs with an error are left out. The first measure of the list that any run has decides.
    """
    if problem == "classification":
        order = [("balanced_accuracy", 1), ("f1", 1), ("accuracy", 1)]
        graded = "accuracy"
    else:
        order = [("r2", 1), ("rmse", -1), ("mse", -1)]
        graded = "r2"
    place = F.array_position(F.array(*[F.lit(m) for m, _ in order]), F.col("metric"))
    sign = F.when(F.col("metric").isin([m for m, s in order if s < 0]), -1.0).otherwise(1.0)
    failed = metrics.filter("error is not null").select(F.col("model").alias("_f")).distinct()
    good = metrics.join(failed, F.col("model") == F.col("_f"), "left_anti").filter(F.col("value").isNotNull())
    ranked = good.filter(place > 0).agg(
        F.min(F.struct(place.alias("p"), (-sign * F.col("value")).alias("v"), F.col("model").alias("model"), F.col("metric").alias("metric"), F.col("value").alias("value"))).alias("b")
    )
    best = ranked.select("b.model", "b.metric", "b.value")
    grade_of = good.filter(F.col("metric") == graded).select(F.col("model").alias("_m"), F.col("value").alias("_g"))
    a, b, c = GRADES[problem]
    g = F.col("_g")
    grade = F.when(g > a, "excellent").when(g > b, "good").when(g > c, "moderate").when(g.isNotNull(), "poor")
    return best.join(grade_of, F.col("model") == F.col("_m"), "left").select("model", "metric", "value", grade.alias("grade"))

"""Category encodings. Mappings are fitted as small aggregates and joined, never collected rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import Ranges, running_totals
from ..functions.schema import col
from ..plans.step import Fitted, look_up, mapping_tables, register

MAX_ONEHOT = 1000


def _numbered(cats: DataFrame, order_by: list[str], rows_per_range=None) -> DataFrame:
    """Adds ``code`` 0.. along the order, for any number of categories."""
    ranges = Ranges.fit(cats, order_by, rows_per_range)
    cats = cats.withColumn("_one", F.lit(1).cast("long"))
    if not ranges.single:
        cats = ranges.add(cats)
    out = running_totals(cats, [], [col(c) for c in order_by], {"code": "_one"}, not ranges.single)
    return out.withColumn("code", F.col("code_before").cast("int")).select("v", "code")


def first_seen_codes(df: DataFrame, value: Column, order_by: list[str], rows_per_range=None) -> DataFrame:
    """``(v, code)``: categories in the order of their first row."""
    names = [f"_o{i}" for i in range(len(order_by))]
    first = F.min(F.struct(*[col(c).alias(n) for c, n in zip(order_by, names)])).alias("_first")
    cats = df.select(value.alias("v"), *[col(c) for c in order_by]).groupBy("v").agg(first).select("v", "_first.*")
    return _numbered(cats, names, rows_per_range)


def _need_order(s):
    if not s.order_by:
        raise ValueError("codes by first appearance need order_by")


def _label_value(s):
    return F.coalesce(col(s.column).cast("string"), F.lit("nan"))


def _label_fit(df, s, found):
    _need_order(s)
    codes = first_seen_codes(df, _label_value(s), list(s.order_by), s.params.get("rows_per_range"))
    return Fitted({}, mapping_tables("codes", codes, df, _label_value(s)))


def _label_apply(df, s, f):
    out = look_up(df.withColumn(s.column, _label_value(s)), f.tables, "codes", s.column)
    return out.withColumn(s.column, F.col("code")).drop("code")


register("encode", "label", fit=_label_fit, apply=_label_apply)


def _onehot_fit(df, s, found):
    cap = int(s.params.get("max_values", MAX_ONEHOT))
    rows = df.filter(col(s.column).isNotNull()).select(col(s.column).cast("string").alias("v")).distinct().limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"'{s.column}' has more than {cap} values; use another encoding or raise max_values")
    return Fitted({"values": sorted(r[0] for r in rows)})


def _onehot_apply(df, s, f):
    c = col(s.column).cast("string")
    flags = [F.coalesce(c == F.lit(v), F.lit(False)).alias(f"{s.column}_{v}") for v in f.params["values"]]
    return df.select(*[col(x) for x in df.columns if x != s.column], *flags)


register("encode", "onehot", fit=_onehot_fit, apply=_onehot_apply)


def _sparse_fit(df, s, found):
    """Index of each value in alphabetical order, for any number of values; nothing is collected."""
    value = col(s.column).cast("string")
    values = df.filter(value.isNotNull()).select(value.alias("v")).distinct()
    tables = mapping_tables("codes", _numbered(values, ["v"], s.params.get("rows_per_range")), df, value)
    return Fitted({"size": int(tables["codes"].count())}, tables)


def _sparse_apply(df, s, f):
    """``{c}_index`` and ``{c}_onehot``, a sparse vector with a 1 at the index; NULL and unseen values have no index and all zeros."""
    size, index, vector = f.params["size"], f"{s.column}_index", f"{s.column}_onehot"
    out = look_up(df.withColumn(s.column, col(s.column).cast("string")), f.tables, "codes", s.column).withColumnRenamed("code", index)
    # the encoder only needs to know the largest index; its last slot, for rows without one, is left out
    known = df.sparkSession.createDataFrame([(float(max(size - 1, 0)),)], "_i double")
    encoder = OneHotEncoder(inputCol="_i", outputCol=vector, handleInvalid="keep", dropLast=True).fit(known)
    return _drop_if(encoder.transform(out.withColumn("_i", F.coalesce(col(index), F.lit(size)).cast("double"))).drop("_i"), s, default=True)


register("encode", "onehot_sparse", fit=_sparse_fit, apply=_sparse_apply)


def _drop_if(df, s, default=False):
    return df.drop(s.column) if s.params.get("drop_original", default) else df


def _target_fit(df, s, found):
    y = s.params["target_column"]
    means = (
        df.filter(col(s.column).isNotNull()).groupBy(col(s.column).alias("v")).agg(F.avg(col(y).cast("double")).alias("_m"))
    )
    return Fitted({"global_mean": found.values["mean"]}, mapping_tables("means", means, df, col(s.column)))


def _target_apply(df, s, f):
    out = look_up(df, f.tables, "means", s.column)
    out = out.withColumn(f"{s.column}_target_encoded", F.coalesce(F.col("_m"), F.lit(f.params["global_mean"]))).drop("_m")
    return _drop_if(out, s)


register(
    "encode",
    "target",
    aggs=lambda df, s: {"mean": F.avg(col(s.params["target_column"]).cast("double"))},
    fit=_target_fit,
    apply=_target_apply,
)


def _counts_fit(df, s, found):
    counts = df.filter(col(s.column).isNotNull()).groupBy(col(s.column).alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    return Fitted({"rows": int(found.values["n"])}, mapping_tables("counts", counts, df, col(s.column)))


def _counts_apply(share: bool):
    def apply(df, s, f):
        out = look_up(df, f.tables, "counts", s.column)
        if share:
            out = out.withColumn(f"{s.column}_freq_encoded", F.try_divide(F.col("_n").cast("double"), F.lit(float(f.params["rows"]))))
        else:
            out = out.withColumn(f"{s.column}_count_encoded", F.col("_n"))
        return _drop_if(out.drop("_n"), s)

    return apply


_present = {"aggs": lambda df, s: {"n": F.count(col(s.column))}}
register("encode", "frequency", fit=_counts_fit, apply=_counts_apply(True), **_present)
register("encode", "count", fit=_counts_fit, apply=_counts_apply(False), **_present)


def _binary_fit(df, s, found):
    _need_order(s)
    known = df.filter(col(s.column).isNotNull())
    codes = first_seen_codes(known, col(s.column).cast("string"), list(s.order_by), s.params.get("rows_per_range"))
    tables = mapping_tables("codes", codes.withColumn("code", F.col("code") + 1), known, col(s.column).cast("string"))
    k = int(tables["codes"].agg(F.max("code")).first()[0] or 0)
    return Fitted({"digits": max(1, math.ceil(math.log2(k + 1)))}, tables)


def _binary_apply(df, s, f):
    """Code 1.. in base 2, high digit first; NULL and unseen values are all zero."""
    out = look_up(df, f.tables, "codes", s.column)
    n = f.params["digits"]
    code = F.coalesce(F.col("code"), F.lit(0))
    out = out.withColumns(
        {f"{s.column}_bin_{i}": F.shiftright(code, n - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(n)}
    )
    return _drop_if(out.drop("code"), s, default=True)


register("encode", "binary", fit=_binary_fit, apply=_binary_apply)


def _ordinal_fit(df, s, found):
    order = s.params.get("order")
    values = df.filter(col(s.column).isNotNull()).select(col(s.column).cast("string").alias("v")).distinct()
    if order is None:
        codes = _numbered(values, ["v"], s.params.get("rows_per_range"))
        return Fitted({}, mapping_tables("codes", codes, df, col(s.column).cast("string")))
    given = df.sparkSession.createDataFrame([(str(v), i) for i, v in enumerate(order)], "v string, code int")
    unseen = _numbered(values.join(given, "v", "left_anti"), ["v"], s.params.get("rows_per_range"))
    unseen = unseen.withColumn("code", F.col("code") + F.lit(len(order)))
    return Fitted({"given": len(order)}, mapping_tables("codes", given.unionByName(unseen), df, col(s.column).cast("string")))


def _ordinal_apply(df, s, f):
    out = look_up(df, f.tables, "codes", s.column)
    return _drop_if(out.withColumn(f"{s.column}_ordinal", F.col("code")).drop("code"), s)


register("encode", "ordinal", fit=_ordinal_fit, apply=_ordinal_apply)


def _helmert_apply(df, s, f):
    """Contrast j compares category j+1 (value j+1) with all earlier ones (value -1 each)."""
    values = f.params["values"]
    c = col(s.column).cast("string")
    code = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(values):
        code = code.when(c == F.lit(v), F.lit(i))
    out = df.withColumn("_code", code)
    contrasts = {
        f"{s.column}_helmert_{j}": F.when(F.col("_code") <= j, F.lit(-1))
        .when(F.col("_code") == j + 1, F.lit(j + 1))
        .when(F.col("_code") > j + 1, F.lit(0))
        .cast("int")
        for j in range(len(values) - 1)
    }
    return _drop_if(out.withColumns(contrasts).drop("_code"), s, default=True)


register("encode", "helmert", fit=_onehot_fit, apply=_helmert_apply)

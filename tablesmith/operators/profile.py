"""Table profiles. Every result has one row per column (or per top value), whatever the table size."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import basic_stats, central_moments
from ..functions.numbers import parse_double
from ..functions.quantiles import exact_quantiles
from ..functions.schema import (
    categorical_columns,
    col,
    column_class,
    columns_of,
    distinct_key,
    numeric_columns,
    require_numeric,
    type_of,
)

# Fixed value: name parts that hint at a date or time column.
TIME_HINTS = ("date", "time", "day", "month", "year")


def has_time_hint(name: str) -> bool:
    return any(h in name.lower() for h in TIME_HINTS)


def long_form(one_row: DataFrame, items: list[Column], schema: str) -> DataFrame:
    """One struct per column of a one-row aggregate, as rows."""
    if not items:
        return one_row.sparkSession.createDataFrame([], schema)
    return one_row.select(F.inline(F.array(*items)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def missing_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, class, null_count, missing_pct)``."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    items = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(column_class(f.dataType)).alias("class"),
            F.col(f"m{i}").alias("null_count"),
            F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n").cast("double")), F.lit(0.0)).alias("missing_pct"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return long_form(one, items, "column string, dtype string, class string, null_count bigint, missing_pct double")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, count, mean, std, min, max, q25, q50, q75)``."""
    columns = columns or numeric_columns(df)
    require_numeric(df, *columns)
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    s = basic_stats(df, columns, {"std": F.stddev_samp})
    rows = [
        (c, s[c]["n"], *(s[c][k] for k in ("mean", "std", "min", "max")), *(q[c][p] for p in (0.25, 0.5, 0.75))) for c in columns
    ]
    schema = "column string, count bigint, mean double, std double, min double, max double, q25 double, q50 double, q75 double"
    return df.sparkSession.createDataFrame(rows, schema)


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, median, integrality, zeros and negatives per numeric column."""
    columns = columns or numeric_columns(df)
    require_numeric(df, *columns)
    median = exact_quantiles(df, {c: [0.5] for c in columns})
    more = {
        "is_integer": lambda c: F.bool_and(c == F.floor(c)),
        "zeros": lambda c: F.count_if(c == 0),
        "negatives": lambda c: F.count_if(c < 0),
    }
    s = central_moments(df, columns, more)
    names = ("min", "max", "mean", "std", "skew", "kurtosis", "is_integer", "zeros", "negatives")
    rows = [(c, median[c][0.5], *(s[c][k] for k in names)) for c in columns]
    schema = (
        "column string, median double, min double, max double, mean double, std double, skew double, kurtosis double, "
        "is_integer boolean, zeros bigint, negatives bigint"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` over the given columns, NULLs left out."""
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*items))).filter("value is not null")


def value_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return unpivoted(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def categorical_profile(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """``(column, unique_count, is_binary, rank, value, count)`` for the top values (ties by value)."""
    columns = columns or categorical_columns(df)
    counts = value_table(df, columns)
    unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    # the rank bound is pruned per task before the shuffle, so a column with many values is no hot group
    spec = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    best = counts.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= top)
    return best.join(unique, "column").select(
        "column", "unique_count", (F.col("unique_count") == 2).alias("is_binary"), "rank", "value", "count"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, count, share)``, share of the non-null rows."""
    known = df.filter(col(column).isNotNull())
    total = known.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = known.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / total)


def dataset_summary(df: DataFrame) -> DataFrame:
    """``(item, value)``: rows, columns, columns per class, and the missing share of columns with gaps."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit("rows").alias("item"), F.col("n").cast("double").alias("value"))]
    items.append(F.struct(F.lit("columns").alias("item"), F.lit(float(len(df.columns))).alias("value")))
    for cls in ("numeric", "categorical", "datetime"):
        items.append(F.struct(F.lit(f"{cls}_columns").alias("item"), F.lit(float(len(columns_of(df, cls)))).alias("value")))
    for i, c in enumerate(df.columns):
        pct = F.try_divide(F.col(f"m{i}") * 100.0, F.col("n").cast("double"))
        items.append(F.when(F.col(f"m{i}") > 0, F.struct(F.lit(f"missing_pct:{c}").alias("item"), pct.alias("value"))))
    return counts.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def text_length_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, mean_length, is_text)``; a missing text counts three characters."""
    columns = columns or categorical_columns(df)
    one = df.agg(*[F.avg(F.length(F.coalesce(col(c), F.lit("nan")))).alias(f"l{i}") for i, c in enumerate(columns)])
    items = [
        F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("mean_length"), (F.col(f"l{i}") > 20).alias("is_text"))
        for i, c in enumerate(columns)
    ]
    return long_form(one, items, "column string, mean_length double, is_text boolean")


def range_ratio(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(max_range, min_range, ratio, needs_scaling)``; constant columns are left out of the smallest range."""
    columns = columns or numeric_columns(df)
    spans = [(F.max(col(c)) - F.min(col(c))).cast("double") for c in columns]
    one = df.agg(*[s.alias(f"r{i}") for i, s in enumerate(spans)]).select(F.array(*[f"r{i}" for i in range(len(columns))]).alias("r"))
    out = one.select(
        F.array_max("r").alias("max_range"), F.array_min(F.filter("r", lambda x: x > 0)).alias("min_range")
    ).withColumn("ratio", F.try_divide("max_range", "min_range"))
    return out.withColumn("needs_scaling", F.coalesce(F.col("ratio") > 10, F.lit(False)))


def datetime_candidates(df: DataFrame) -> DataFrame:
    """``(column, by)``: typed columns, and columns named like a time of which every value parses."""
    typed = columns_of(df, "datetime")
    rows = [F.struct(F.lit(c).alias("column"), F.lit("type").alias("by")) for c in typed]
    hinted = [c for c in df.columns if c not in typed and has_time_hint(c)]
    texts = [c for c in hinted if column_class(type_of(df, c)) == "categorical"]
    numbers = [c for c in hinted if column_class(type_of(df, c)) == "numeric"]
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bool_and(F.try_to_timestamp(col(c)).isNotNull() | col(c).isNull()).alias(f"p{i}") for i, c in enumerate(texts)],
    )
    rows += [F.struct(F.lit(c).alias("column"), F.lit("name").alias("by")) for c in numbers]
    rows += [F.when(F.col(f"p{i}"), F.struct(F.lit(c).alias("column"), F.lit("name").alias("by"))) for i, c in enumerate(texts)]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, by string")
    return one.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """``(column, unique_count)`` without NULLs; exact unless asked otherwise."""
    keys = [distinct_key(col(c), column_class(type_of(df, c)) == "categorical") for c in columns]
    if approximate:
        one = df.agg(*[F.approx_count_distinct(k).alias(f"u{i}") for i, k in enumerate(keys)])
        items = [F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_count")) for i, c in enumerate(columns)]
        return long_form(one, items, "column string, unique_count bigint")
    # one aggregate per column, side by side in one job: several exact counts in one aggregate would repeat every row per column
    parts = [df.agg(F.count_distinct(k).alias("unique_count")).select(F.lit(c).alias("column"), "unique_count") for c, k in zip(columns, keys)]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, unique_count bigint")
    return reduce(DataFrame.unionByName, parts)


def target_candidates(df: DataFrame, max_classes: int = 10) -> DataFrame:
    """``(column, class_count, rank)``: text columns with 2..max classes, fewest first, then table order."""
    columns = categorical_columns(df)
    counts = distinct_counts(df, columns).filter(F.col("unique_count").between(2, max_classes))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    spec = Window.partitionBy(F.lit(0)).orderBy("unique_count", place)  # at most one row per column
    return counts.select("column", F.col("unique_count").alias("class_count"), F.row_number().over(spec).alias("rank"))


def profile_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: shapes before and after, added and removed columns, row delta."""
    added = ",".join(sorted(set(after.columns) - set(before.columns)))
    removed = ",".join(sorted(set(before.columns) - set(after.columns)))
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    after_rows = after.agg(F.count(F.lit(1))).scalar()
    return b.select(
        "rows_before",
        after_rows.alias("rows_after"),
        (after_rows - F.col("rows_before")).alias("row_delta"),
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        F.lit(added).alias("added"),
        F.lit(removed).alias("removed"),
    )


class TableProfile:
    """Profile parts for the rules, each computed once when a rule first asks for it.

    Everything kept has one row per column or column pair; the table itself is never collected.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession
        self.numeric = numeric_columns(df)
        self.categorical = categorical_columns(df)
        self.position = {c: i for i, c in enumerate(df.columns)}

    def frame(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def base(self) -> dict[str, dict]:
        """Fused aggregate: nulls, ranges, mean text length, numeric-looking texts."""
        df, aggs = self.df, [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(df.columns):
            aggs.append(F.count_if(col(c).isNull()).alias(f"m{i}"))
            if c in self.numeric:
                x = col(c).cast("double")
                aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            elif c in self.categorical:
                aggs += [
                    F.avg(F.length(F.coalesce(col(c), F.lit("nan")))).alias(f"len{i}"),
                    F.count(parse_double(col(c))).alias(f"num{i}"),
                ]
        row = df.agg(*aggs).first().asDict()
        n = row["n"]
        return {
            c: {
                "rows": n,
                "nulls": row[f"m{i}"],
                "range": None if row.get(f"lo{i}") is None else row[f"hi{i}"] - row[f"lo{i}"],
                "mean_length": row.get(f"len{i}"),
                "numeric_texts": row.get(f"num{i}"),
            }
            for i, c in enumerate(df.columns)
        }

    @cached_property
    def skew(self) -> dict[str, float | None]:
        return {c: s["skew"] for c, s in central_moments(self.df, self.numeric).items()} if self.numeric else {}

    @cached_property
    def rows(self) -> int:
        return next(iter(self.base.values()))["rows"]

    @cached_property
    def unique(self) -> dict[str, int]:
        return {r["column"]: r["unique_count"] for r in distinct_counts(self.df, self.df.columns).collect()}

    @cached_property
    def columns(self) -> DataFrame:
        """``(pos, column, class, rows, nulls, missing_pct, range, mean_length, numeric_texts, time_hint)``."""
        rows = []
        for c, b in self.base.items():
            cls = column_class(type_of(self.df, c))
            pct = b["nulls"] * 100.0 / b["rows"] if b["rows"] else 0.0
            rows.append(
                (self.position[c], c, cls, b["rows"], b["nulls"], pct, b["range"], b["mean_length"], b["numeric_texts"], has_time_hint(c))
            )
        schema = (
            "pos int, column string, class string, rows bigint, nulls bigint, missing_pct double, range double, "
            "mean_length double, numeric_texts bigint, time_hint boolean"
        )
        return self.frame(rows, schema)

    @cached_property
    def with_unique(self) -> DataFrame:
        return self.columns.join(self.frame(list(self.unique.items()), "column string, unique_count bigint"), "column")

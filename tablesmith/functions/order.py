"""Order-sensitive work without a single-task window.

A window over a whole table, or over one hot partition, runs in one task. Here an
ordered table is cut into value ranges first: the ranges get their edges from a
quantile sketch, so each holds about the same number of rows. A window then runs
inside each (partition, range), and a small table with one row per range carries
sums or last values from range to range. The edges only shape the work; results are
exact whatever they are. A table known (by count) to fit in one range skips all that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import NUMERIC, col, type_of

ROWS_PER_RANGE = 1_000_000
SKETCH_K, SKETCH_K_LIMIT = 800, 65_535  # the latter is the sketch's own limit
MERGE_GROUPS = 64
RANGE = "_range"


def common_prefix(df: DataFrame, column: str) -> int:
    """Characters that all values of a text column share: those its minimum and maximum share."""
    low, high = df.agg(F.min(col(column)), F.max(col(column))).first()
    n = 0
    while low is not None and n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return n


def as_position(df: DataFrame, column: str, skip: int = 0) -> Column | None:
    """Order-preserving double for a numeric, time or text column (equal doubles are allowed).

    Text is read as a number made of the six bytes behind the common prefix.
    """
    dtype = type_of(df, column)
    c = col(column)
    if isinstance(dtype, NUMERIC):
        return c.cast("double")
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.StringType):
        tail = F.substring(c, skip + 1, 6).cast("binary")
        return F.conv(F.rpad(F.hex(F.substring(tail, 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


def sketch_quantiles(df: DataFrame, columns: dict[str, Column], ranks: list[float], k: int = SKETCH_K):
    """Row count and approximate quantiles per column in one job.

    Sketches are merged in two levels, so that the last task reads MERGE_GROUPS sketches
    and not one per input partition.
    """
    level1 = df.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.kll_sketch_agg_double(c, k).alias(f"s{i}") for i, c in enumerate(columns.values())],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns.values())],
    )
    # An empty sketch has no quantiles: columns without values are answered below.
    probe = F.array(*[F.lit(float(r)) for r in ranks])
    row = (
        level1.agg(
            F.sum("_n").alias("_n"),
            *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(columns))],
            *[F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}"))).alias(f"s{i}") for i in range(len(columns))],
        )
        .select(
            "_n",
            *[f"n{i}" for i in range(len(columns))],
            *[
                F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", probe)).alias(f"q{i}")
                for i in range(len(columns))
            ],
        )
        .first()
    )
    total = int(row["_n"] or 0)
    return total, {
        name: (int(row[f"n{i}"] or 0), list(row[f"q{i}"] or [])) for i, name in enumerate(columns)
    }


@dataclass(frozen=True)
class Ranges:
    """Fitted value ranges over one or two order columns."""

    order_by: tuple[str, ...]
    edges: dict[str, tuple[float, ...]] = field(default_factory=dict)
    rows: int = 0
    skip: dict[str, int] = field(default_factory=dict)

    @property
    def single(self) -> bool:
        return not any(self.edges.values())

    @staticmethod
    def fit(
        df: DataFrame, order_by: list[str], rows_per_range: int | None = None, distinct: bool = False
    ) -> "Ranges":
        """``distinct``: the table will be reduced to one row per value first, so count values."""
        return Ranges.fit_each(df, [order_by], rows_per_range, distinct)[0]

    @staticmethod
    def fit_each(
        df: DataFrame, orders: list[list[str]], rows_per_range: int | None = None, distinct: bool = False
    ) -> "list[Ranges]":
        """Ranges for several orders of one table: a count, and one job for all sketches if it is large."""
        rows_per_range = rows_per_range or ROWS_PER_RANGE
        rows = df.count()
        if rows <= rows_per_range:
            return [Ranges(tuple(o), {}, rows) for o in orders]
        names = list(dict.fromkeys(c for o in orders for c in o[:2]))
        skip = {c: common_prefix(df, c) for c in names if isinstance(type_of(df, c), T.StringType)}
        usable = {c: p for c in names if (p := as_position(df, c, skip.get(c, 0))) is not None}
        size = {o[0]: rows for o in orders}
        if distinct:
            # 1.3: far outside the error of the distinct sketch
            row = df.agg(*[F.approx_count_distinct(col(c)) for c in size]).first()
            size = {c: min(rows, int(1.3 * n)) for c, n in zip(size, row)}
        # at least two ranks for each range wanted, and a sketch that can tell them apart
        most = -(-max(size.values()) // rows_per_range)
        steps = max(512 if rows_per_range >= 10_000 else 32, 2 * most)
        ranks = [i / steps for i in range(1, steps)]
        _, found = sketch_quantiles(df, usable, ranks, min(SKETCH_K_LIMIT, max(SKETCH_K, 4 * most)))
        out = []
        for o in orders:
            wanted = -(-size[o[0]] // rows_per_range)
            edges: dict[str, tuple[float, ...]] = {}
            for c in o[:2]:
                if c in found:
                    qs = found[c][1]
                    step = max(1, len(qs) // max(wanted, 1))
                    edges[c] = tuple(sorted(set(qs[::step]))) if wanted > 1 else ()
            out.append(Ranges(tuple(o), edges, rows, skip))
        return out

    def add(self, df: DataFrame) -> DataFrame:
        """Adds the range number; it never decreases along the order.

        Every edge value gets a range of its own. Only there can one value hold many
        rows, and only there the second order column cuts further.
        """
        if self.single:
            return df.withColumn(RANGE, F.lit(0).cast("long"))
        first, *rest = [c for c in self.order_by if self.edges.get(c)]
        out = self._locate(df, first, "_r1")
        second = F.lit(0).cast("long")
        if rest and first == self.order_by[0]:
            out = self._locate(out, rest[0], "_r2")
            second = F.when(F.col("_r1") % 2 == 1, F.col("_r2")).otherwise(F.lit(0).cast("long"))
        out = out.withColumn(RANGE, F.col("_r1") * F.lit(1 << 32) + second)
        return out.drop("_r1", "_r2")

    def _locate(self, df: DataFrame, column: str, out: str) -> DataFrame:
        edges = self.edges[column]
        splits = [float("-inf"), *edges, float("inf")]
        position = as_position(df, column, self.skip.get(column, 0))
        binned = Bucketizer(splits=splits, inputCol="_p", outputCol="_b", handleInvalid="keep").transform(
            df.withColumn("_p", position)
        )
        at = F.col("_b").cast("long")
        table = F.array(*[F.lit(e) for e in edges])
        on_edge = F.when(at > 0, F.element_at(table, at.cast("int")) == F.col("_p")).otherwise(F.lit(False))
        number = F.when(F.col("_p").isNull(), F.lit(-2).cast("long")).otherwise(
            2 * at - F.when(on_edge, 1).otherwise(0)
        )
        return binned.withColumn(out, number + 2).drop("_p", "_b")


def _group_keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds never-null copies of the group columns.

    Windows, sums and the join back all use these, so they share one partitioning and the large
    side is shuffled once; a null-safe join would hash other expressions and shuffle it again.
    """
    names = [f"_g{i}" for i in range(len(by))]
    copies = {n: F.coalesce(col(b).cast("string"), F.lit("\u0000")) for n, b in zip(names, by)}
    return (df.withColumns(copies) if copies else df), names


def running_totals(
    cells: DataFrame,
    by: list[str],
    order_by: list[Column | str],
    weights: dict[str, str],
    ranged: bool,
) -> DataFrame:
    """Adds ``{out}_before`` (sum over earlier rows of the group) per weight ``out -> column``.

    ``ranged`` says that the cells carry a RANGE column; otherwise one window per group is used.
    """
    groups: list[str] = []
    if ranged:
        cells, groups = _group_keys(cells, by)
    keys = [*groups, RANGE] if ranged else by
    spec = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    inner = spec.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"{o}_before": F.coalesce(F.sum(col(w)).over(inner), F.lit(0)) for o, w in weights.items()}
    if not ranged:
        return cells.withColumns(inside)
    sums = cells.groupBy(*[col(k) for k in keys]).agg(*[F.sum(col(w)).alias(f"_s_{o}") for o, w in weights.items()])
    # one row per group and range, so a window per group is small
    outer = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(RANGE)
    offsets = sums.select(
        *[col(k) for k in keys],
        *[
            F.coalesce(F.sum(f"_s_{o}").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{o}")
            for o in weights
        ],
    )
    out = cells.withColumns(inside).join(offsets, keys)
    return out.withColumns({f"{o}_before": F.col(f"{o}_before") + F.col(f"_o_{o}") for o in weights}).drop(
        *[f"_o_{o}" for o in weights], *groups
    )


def _nearest(df: DataFrame, value: str, part: list[Column]) -> DataFrame:
    """Last and next non-null value by ``_pos``.

    The next one is the last one in reverse order: a frame that runs to the end of the partition
    would be evaluated anew for every row.
    """
    item = F.when(col(value).isNotNull(), F.struct(col(value).alias("v"), F.col("_pos").alias("p")))
    ahead = Window.partitionBy(*part).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*part).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"_prev": F.last(item, ignorenulls=True).over(ahead), "_next": F.last(item, ignorenulls=True).over(back)})


def with_neighbours(
    df: DataFrame, value: str, order_by: list[str], partition_by: list[str], rows_per_range: int | None = None
) -> DataFrame:
    """Adds ``_pos`` (1-based position), ``_prev`` and ``_next``: nearest non-null value at or
    before / at or after the row, as struct(v, p). All inside the partition, in the given order."""
    ranges = Ranges.fit(df, order_by, rows_per_range)
    order = [col(c) for c in order_by]
    part = [col(c) for c in partition_by] or [F.lit(0)]
    if ranges.single:
        spec = Window.partitionBy(*part).orderBy(*order)
        out = df.withColumn("_pos", F.row_number().over(spec).cast("long"))
        return _nearest(out, value, part)
    ranged, groups = _group_keys(ranges.add(df), partition_by)
    keys = [*groups, RANGE]
    part = groups or [F.lit(0)]
    spec = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    local = ranged.withColumn("_pos", F.row_number().over(spec).cast("long"))
    local = _nearest(local, value, [col(k) for k in keys])
    item = F.when(col(value).isNotNull(), F.struct(col(value).alias("v"), F.col("_pos").alias("p")))
    summary = local.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.max_by(item, F.when(col(value).isNotNull(), F.col("_pos"))).alias("_lastv"),
        F.min_by(item, F.when(col(value).isNotNull(), F.col("_pos"))).alias("_firstv"),
    )
    over = Window.partitionBy(*part).orderBy(RANGE)
    back = Window.partitionBy(*part).orderBy(F.desc(RANGE))
    summary = summary.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )

    def shifted(name: str) -> Column:
        s = F.col(name)
        return F.when(s.isNotNull(), F.struct(s["v"].alias("v"), (s["p"] + F.col("_off")).alias("p")))

    summary = summary.withColumns({"_lastv": shifted("_lastv"), "_firstv": shifted("_firstv")})
    summary = summary.select(
        *[col(k) for k in keys],
        "_off",
        F.last("_lastv", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_prev"),
        F.last("_firstv", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_next"),
    )
    out = local.join(summary, keys)
    out = out.withColumns(
        {
            "_pos": F.col("_pos") + F.col("_off"),
            "_prev": F.coalesce(shifted("_prev"), F.col("_carry_prev")),
            "_next": F.coalesce(shifted("_next"), F.col("_carry_next")),
        }
    )
    return out.drop(RANGE, "_off", "_carry_prev", "_carry_next", *groups)


def with_lags(
    df: DataFrame,
    value: str,
    order_by: list[str],
    partition_by: list[str],
    lags: list[int],
    rows_per_range: int | None = None,
) -> DataFrame:
    """Adds ``{value}_lag_{k}`` for every k: the value k rows earlier in the partition."""
    ranges = Ranges.fit(df, order_by, rows_per_range)
    order = [col(c) for c in order_by]
    part = [col(c) for c in partition_by] or [F.lit(0)]
    if ranges.single:
        spec = Window.partitionBy(*part).orderBy(*order)
        return df.withColumns({f"{value}_lag_{k}": F.lag(col(value), k).over(spec) for k in lags})
    deepest = max(lags)
    ranged, groups = _group_keys(ranges.add(df), partition_by)
    keys = [*groups, RANGE]
    part = groups or [F.lit(0)]
    whole = Window.partitionBy(*[col(k) for k in keys])
    spec = whole.orderBy(*order)
    local = ranged.withColumns(
        {
            "_pos": F.row_number().over(spec),
            "_cnt": F.count(F.lit(1)).over(whole),
            **{f"_lag{k}": F.lag(col(value), k).over(spec) for k in lags},
        }
    )
    # The last rows of every range, at most `deepest` of them; collect_list would drop NULLs, hence the struct.
    tails = (
        local.filter(F.col("_pos") > F.col("_cnt") - deepest)
        .groupBy(*[col(k) for k in keys])
        .agg(F.array_sort(F.collect_list(F.struct("_pos", col(value).alias("v")))).alias("_tail"))
    )
    over = Window.partitionBy(*part).orderBy(RANGE).rowsBetween(-deepest, -1)
    # Each range holds at least one row, so the `deepest` ranges before this one always suffice.
    tails = tails.select(*[col(k) for k in keys], F.flatten(F.collect_list("_tail").over(over)).alias("_before"))
    out = local.join(tails, keys)

    def lagged(k: int) -> Column:
        back = F.size("_before") - (F.lit(k) - F.col("_pos"))
        return F.when(F.col("_pos") > k, F.col(f"_lag{k}")).when(back >= 1, F.try_element_at("_before", back)["v"])

    out = out.withColumns({f"{value}_lag_{k}": lagged(k) for k in lags})
    return out.drop(RANGE, "_pos", "_cnt", "_before", *[f"_lag{k}" for k in lags], *groups)


def rank_by_hash(
    df: DataFrame, key: str, seed: int, by: list[str], rows: int, rows_per_range: int | None = None
) -> DataFrame:
    """Adds ``_rank``: 1-based position inside the group by the seeded hash of the key.

    The hash is uniform, so its leading digits are the ranges; no group is ever one task.
    """
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    digits = 0
    while rows / (16**digits) > rows_per_range and digits < 5:
        digits += 1
    h = F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))
    out = df.withColumns({"_h": h, "_one": F.lit(1).cast("long")})
    if digits:
        out = out.withColumn(RANGE, F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"))
    out = running_totals(out, by, ["_h", col(key)], {"_rank": "_one"}, bool(digits))
    return out.withColumn("_rank", F.col("_rank_before") + 1).drop("_h", "_one", "_rank_before", RANGE)

"""Exact quantiles (linear between order statistics) for columns of any size.

``percentile`` keeps a map of all distinct values of a column in one task. That is
fine for a table of known small size and used there. Beyond it the wanted order
statistics are bracketed with a quantile sketch, the bracket is checked by counting
(and narrowed again while too many values are inside), and only the few values inside
are ordered. Every pass is an aggregate with map-side combining. Counting and ordering read each
column on its own, which costs a stored table nothing; persist an expensive derived one first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import MERGE_GROUPS, RANGE, Ranges, running_totals
from ..session import small_or_cut
from .schema import col

DIRECT_ROWS = 1_000_000
BRACKET_ROWS = 1_000_000
SLACK = 0.002
BRACKET_K = 4096


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    direct_rows: int | None = None,
    bracket_rows: int | None = None,
) -> dict[str, dict[float, float | None]]:
    """Quantiles per column, ``{column: {p: value}}``; NULL and NaN are left out."""
    if not wanted:
        return {}
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    bracket_rows = BRACKET_ROWS if bracket_rows is None else bracket_rows
    names = list(wanted)
    values = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in names}
    data = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values.values())])
    rows = data.count()
    if rows <= direct_rows:
        # at most direct_rows map entries per column, one column per task
        parts = [
            data.agg(F.percentile(f"c{i}", F.array(*[F.lit(float(p)) for p in wanted[c]])).alias("q")).select(F.lit(i).alias("i"), "q")
            for i, c in enumerate(names)
        ]
        found = {r["i"]: r["q"] for r in reduce(DataFrame.unionAll, parts).collect()}
        return {c: dict(zip(wanted[c], found[i] or [None] * len(wanted[c]))) for i, c in enumerate(names)}
    return _select(data, {f"c{i}": (c, wanted[c]) for i, c in enumerate(names)}, bracket_rows)


@dataclass
class _Target:
    """One wanted quantile: ranks k0 and k1 of the column, and the bracket believed to hold them."""

    column: str
    name: str
    p: float
    n: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    inside: int = 0
    v0: float = 0.0
    v1: float = 0.0

    @property
    def h(self) -> float:
        return (self.n - 1) * self.p

    @property
    def k0(self) -> int:
        return math.floor(self.h)

    @property
    def k1(self) -> int:
        return math.ceil(self.h)

    @property
    def bracket(self):
        return (self.column, self.lo, self.hi)


def _clip(x: float) -> float:
    return min(1.0, max(0.0, x))


def _select(data: DataFrame, wanted: dict[str, tuple[str, list[float]]], bracket_rows: int):
    probs = sorted({p for _, ps in wanted.values() for p in ps})
    ranks = sorted({_clip(p + s) for p in probs for s in (-SLACK, SLACK)})
    found = _sketches(data, {c: (c, F.col(c)) for c in wanted}, ranks)
    targets = []
    for c, (name, ps) in wanted.items():
        n, qs = found[c]
        at = dict(zip(ranks, qs))
        for p in ps:
            t = _Target(c, name, p, n)
            if n:
                t.lo = at[_clip(p - SLACK)] if p > SLACK else None
                t.hi = at[_clip(p + SLACK)] if p < 1 - SLACK else None
            targets.append(t)
    live = [t for t in targets if t.n]
    _count(data, live, {})
    for _ in range(6):
        wide = [t for t in live if t.inside > bracket_rows and t.lo != t.hi]
        if not wide:
            break
        # narrow again with sketches of what is inside
        shares = [(_clip((t.k0 - t.below) / t.inside - SLACK), _clip((t.k1 - t.below) / t.inside + SLACK)) for t in wide]
        ranks = sorted({x for pair in shares for x in pair})
        exprs = {f"t{i}": (t.column, F.when(_within(*t.bracket), F.col(t.column))) for i, t in enumerate(wide)}
        found = _sketches(data, exprs, ranks)
        old = {id(t): (t.lo, t.hi, t.inside) for t in wide}
        for i, (t, (low, high)) in enumerate(zip(wide, shares)):
            at = dict(zip(ranks, found[f"t{i}"][1]))
            t.lo = at[low] if low > 0 else t.lo
            t.hi = at[high] if high < 1 else t.hi
        _count(data, wide, old)
        if all(t.inside >= old[id(t)][2] for t in wide):
            break
    _pick(data, live)
    out: dict[str, dict[float, float | None]] = {name: {} for name, _ in wanted.values()}
    for t in targets:
        out[t.name][t.p] = t.v0 + (t.v1 - t.v0) * (t.h - t.k0) if t.n else None
    return out


def _sketches(data: DataFrame, exprs: dict[str, tuple[str, Column]], ranks: list[float]) -> dict[str, tuple[int, list[float]]]:
    """Row count and approximate quantiles per expression, in one job that reads each column on its own."""
    names = list(exprs)
    parts = [data.select(F.lit(i).alias("i"), expr.alias("v")).filter("v is not null") for i, (_, expr) in enumerate(exprs.values())]
    level1 = (
        reduce(DataFrame.unionAll, parts)
        .groupBy("i", (F.spark_partition_id() % MERGE_GROUPS).alias("p"))
        .agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", BRACKET_K).alias("s"))
    )
    probe = F.array(*[F.lit(float(r)) for r in ranks])
    merged = level1.groupBy("i").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("s").alias("s"))
    rows = merged.select("i", "n", F.kll_sketch_get_quantile_double("s", probe).alias("q")).collect()
    found = {names[r["i"]]: (int(r["n"]), list(r["q"])) for r in rows}
    return {name: found.get(name, (0, [])) for name in names}


def _by_column(brackets: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for b in brackets:
        out.setdefault(b[0], []).append(b)
    return out


def _within(column: str, lo: float | None, hi: float | None) -> Column:
    c = F.col(column)
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def _count(data: DataFrame, targets: list[_Target], safe: dict) -> None:
    """Counts below and inside each bracket; a side that cut off a wanted rank goes back to its last safe edge."""
    brackets = list(dict.fromkeys(t.bracket for t in targets))
    if not brackets:
        return
    counts = {}
    for part in _by_column(brackets).values():
        aggs = []
        for c, lo, hi in part:
            below = F.lit(False) if lo is None else F.col(c) < F.lit(lo)
            aggs += [F.sum(below.cast("long")), F.sum(_within(c, lo, hi).cast("long"))]
        counts[tuple(part)] = data.agg(F.array(*aggs).alias("n"))
    # one job; each part reads its one column
    rows = reduce(DataFrame.unionAll, [f.select(F.lit(i).alias("i"), "n") for i, f in enumerate(counts.values())]).collect()
    found = {r["i"]: r["n"] for r in rows}
    counts = {
        b: (int(found[i][2 * j] or 0), int(found[i][2 * j + 1] or 0)) for i, part in enumerate(counts) for j, b in enumerate(part)
    }
    missed = []
    for t in targets:
        t.below, t.inside = counts[t.bracket]
        old = safe.get(id(t), (None, None, 0))
        if t.below > t.k0 or t.below + t.inside <= t.k1:
            if t.below > t.k0:
                t.lo = old[0]
            if t.below + t.inside <= t.k1:
                t.hi = old[1]
            missed.append(t)
    if missed:
        _count(data, missed, safe)


def _pick(data: DataFrame, targets: list[_Target]) -> None:
    """Orders the values inside the brackets and reads the wanted ranks off."""
    for t in targets:
        # the counts have shown that both ranks fall on this one value
        if t.lo is not None and t.lo == t.hi:
            t.v0 = t.v1 = t.lo
    targets = [t for t in targets if t.lo is None or t.lo != t.hi]
    if not targets:
        return
    # brackets of a column that overlap become one interval, so that a value belongs to one at most
    intervals: list[tuple[str, float, float, int]] = []
    place: dict[int, int] = {}
    inf = float("inf")
    for t in sorted(targets, key=lambda t: (t.column, -inf if t.lo is None else t.lo, inf if t.hi is None else t.hi)):
        lo, hi = (-inf if t.lo is None else t.lo), (inf if t.hi is None else t.hi)
        if intervals and intervals[-1][0] == t.column and lo <= intervals[-1][2]:
            c, first, last, below = intervals[-1]
            intervals[-1] = (c, first, max(last, hi), below)
        else:
            intervals.append((t.column, lo, hi, t.below))
        place[id(t)] = len(intervals) - 1
    labels: dict[str, Column] = {}
    for i, (c, lo, hi, _) in enumerate(intervals):
        here = _within(c, None if lo == -inf else lo, None if hi == inf else hi)
        labels[c] = labels[c].when(here, F.lit(i)) if c in labels else F.when(here, F.lit(i))
    near = [data.select(label.alias("t"), F.col(c).alias("v")).filter("t is not null") for c, label in labels.items()]
    cells = reduce(DataFrame.unionAll, near).groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    spec = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(spec), F.lit(0)))
    upto = F.col("before") + F.col("n")
    aggs = []
    for j, t in enumerate(targets):
        i = place[id(t)]
        for side, k in (("a", t.k0), ("b", t.k1)):
            at = F.lit(k - intervals[i][3]).cast("long")
            aggs.append(F.max(F.when((F.col("t") == i) & (F.col("before") <= at) & (at < upto), F.col("v"))).alias(f"{side}{j}"))
    row = cells.agg(*aggs).first()
    for j, t in enumerate(targets):
        t.v0, t.v1 = row[f"a{j}"], row[f"b{j}"]


def value_cells(
    df: DataFrame,
    column: str,
    by: list[str] | None = None,
    rows_per_range: int | None = None,
    ranges: Ranges | None = None,
) -> DataFrame:
    """One row per distinct value (and group): ``(by.., v, n, before, dense)``.

    ``before`` counts the rows and ``dense`` the distinct values that are smaller.
    """
    by = by or []
    ranges = ranges or Ranges.fit(df.filter(col(column).isNotNull()), [column], rows_per_range, distinct=True)
    cells = (
        df.filter(col(column).isNotNull())
        .groupBy(*[col(b) for b in by], col(column).alias(column))
        .agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("_one"))
    )
    if not ranges.single:
        cells = ranges.add(cells)
    cells = running_totals(cells, by, [col(column)], {"n": "n", "one": "_one"}, not ranges.single)
    return cells.withColumnsRenamed({column: "v", "n_before": "before", "one_before": "dense"}).drop(RANGE, "_one")


def grouped_quantiles(
    df: DataFrame, column: str, by: list[str], probs: dict[str, float], rows_per_range: int | None = None
) -> DataFrame:
    """Exact quantiles per group: ``(by.., n, {name: quantile})``.

    No group is ordered as a whole in one task, so a group may hold any share of the rows.
    """
    cells = value_cells(df.withColumn("_q", col(column).cast("double")), "_q", by, rows_per_range)
    totals = df.filter(col(column).isNotNull()).groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("_total"))
    # fixed first: a small table is broadcast, so that the cells need no shuffle by group
    totals = small_or_cut(totals.withColumnsRenamed({b: f"_g{i}" for i, b in enumerate(by)}))
    cond = reduce(lambda a, b: a & b, [col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)])
    joined = cells.join(totals, cond).drop(*[f"_g{i}" for i in range(len(by))])
    upto = F.col("before") + F.col("n")
    aggs = [F.max("_total").alias("n")]
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        for side, k in (("0", F.floor(h)), ("1", F.ceil(h))):
            aggs.append(F.max(F.when((F.col("before") <= k) & (k < upto), F.col("v"))).alias(f"_{name}{side}"))
    out = joined.groupBy(*[col(b) for b in by]).agg(*aggs)
    h = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    return out.select(
        *[col(b) for b in by],
        "n",
        *[
            (F.col(f"_{q}0") + (F.col(f"_{q}1") - F.col(f"_{q}0")) * (h[q] - F.floor(h[q]))).alias(q)
            for q in probs
        ],
    )

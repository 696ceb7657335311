"""Moments and co-moments of many columns.

Spark's moment aggregates carry several buffers each; with many of them in one aggregate the
generated code outgrows what the JVM compiles. Plain sums of centred products stay small, and
centring on the means (a first pass) keeps them accurate.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import col

SUMS_PER_JOB = 90


def sums_in_parts(df: DataFrame, aggs: dict, per_job: int = SUMS_PER_JOB) -> dict:
    """Results of many aggregates, at most ``per_job`` in one pass over the table."""
    names, out = list(aggs), {}
    for start in range(0, len(names), per_job):
        part = names[start : start + per_job]
        row = df.agg(*[aggs[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out


def basic_stats(df: DataFrame, columns: list[str], more: dict | None = None) -> dict[str, dict]:
    """Per column ``n``, ``mean``, ``min``, ``max`` and the further aggregates ``{name: fn(column)}``."""
    stats = {"n": F.count, "mean": F.avg, "min": F.min, "max": F.max, **(more or {})}
    found = sums_in_parts(df, {(c, k): fn(col(c).cast("double")) for c in columns for k, fn in stats.items()})
    return {c: {k: found[(c, k)] for k in stats} for c in columns}


def central_moments(df: DataFrame, columns: list[str], more: dict | None = None) -> dict[str, dict]:
    """``basic_stats`` with ``std``, ``skew`` and ``kurtosis`` (sample forms, as tables of moments show them)."""
    stats = basic_stats(df, columns, more)
    known = [c for c in columns if stats[c]["n"]]
    dev: dict[str, Column] = {c: col(c).cast("double") - F.lit(stats[c]["mean"]) for c in known}
    centred = df.select(*[d.alias(f"d{i}") for i, d in enumerate(dev.values())])
    powers = {}
    for i, c in enumerate(known):
        d = F.col(f"d{i}")
        powers.update({(c, 2): F.sum(d * d), (c, 3): F.sum(d * d * d), (c, 4): F.sum(d * d * d * d)})
    found = sums_in_parts(centred, powers) if known else {}
    for c in columns:
        n = stats[c]["n"]
        s = stats[c]
        s.update(std=None, skew=None, kurtosis=None)
        if not n:
            continue
        m2, m3, m4 = (found[(c, k)] / n for k in (2, 3, 4))
        if n > 1:
            s["std"] = math.sqrt(m2 * n / (n - 1))
        if n > 2 and m2 > 0:
            s["skew"] = m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
        if n > 3 and m2 > 0:
            s["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)
    return stats


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every unordered pair over rows where both are present; None for a constant side.

    Columns without NULLs need one sum per pair; a pair with NULLs needs six over its complete rows.
    """
    stats = basic_stats(df, columns, {"nulls": lambda c: F.count_if(c.isNull())})
    full = {c for c in columns if not stats[c]["nulls"]}
    names = {c: f"d{i}" for i, c in enumerate(columns)}
    centred = df.select(*[(col(c).cast("double") - F.lit(stats[c]["mean"])).alias(names[c]) for c in columns])
    sums = {}
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2)]
    for a, b in pairs:
        x, y = F.col(names[a]), F.col(names[b])
        if a in full and b in full:
            sums[(a, b)] = F.sum(x * y)
        elif a != b:
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            for k, e in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y)):
                sums[(a, b, k)] = F.sum(e)
            sums[(a, b, "n")] = F.count(x)
    found = sums_in_parts(centred, sums)
    constant = {c for c in columns if stats[c]["min"] == stats[c]["max"]}
    out: dict[tuple[str, str], float | None] = {}
    for a, b in pairs:
        if a == b:
            continue
        if a in constant or b in constant:
            out[(a, b)] = None
            continue
        if (a, b) in found:
            xy, xx, yy = found[(a, b)], found[(a, a)], found[(b, b)]
        else:
            n = found[(a, b, "n")]
            if not n:
                out[(a, b)] = None
                continue
            x, y = found[(a, b, "x")], found[(a, b, "y")]
            xy = found[(a, b, "xy")] - x * y / n
            xx = found[(a, b, "xx")] - x * x / n
            yy = found[(a, b, "yy")] - y * y / n
            # left-over rounding of a side that is constant on the complete rows
            if xx <= 1e-14 * (stats[a]["max"] - stats[a]["min"]) ** 2 * n or yy <= 1e-14 * (stats[b]["max"] - stats[b]["min"]) ** 2 * n:
                out[(a, b)] = None
                continue
        out[(a, b)] = xy / (math.sqrt(xx) * math.sqrt(yy)) if xx > 0 and yy > 0 else None
    return out

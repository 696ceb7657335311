"""Numeric expressions whose definition differs between Spark and the tool users compare with."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: texts that count as a number (no Java suffixes, no digit separators, no NaN/inf words).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_double(c: Column) -> Column:
    """Text to double, NULL when the text is no plain number."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def sample_skew(c: Column) -> Column:
    """Bias-corrected skew as one aggregate; NULL below three values. For many columns see ``moments``."""
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis as one aggregate; NULL below four values."""
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side (``corr`` raises there)."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def hash_key(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random text per key, the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_uniform(key: Column, seed: int) -> Column:
    """Reproducible uniform number in [0, 1) per key (32 bits)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: its series below 2, its continued fraction from there on."""
    steps = F.sequence(F.lit(1), F.lit(80))
    # z * (1 + 2 z^2 / 3 + (2 z^2)^2 / (3 * 5) + ...), terms of one sign
    series = F.aggregate(
        steps,
        F.struct(z.alias("term"), z.alias("sum")),
        lambda s, k: F.struct((s["term"] * 2 * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * z * z / (2 * k + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    root = F.lit(math.sqrt(math.pi))
    fraction = F.aggregate(F.reverse(steps), F.lit(1.0), lambda f, k: F.lit(1.0) + k / (F.lit(2.0) * z * z) / f)
    return F.when(z < 2, F.lit(1.0) - F.lit(2.0) / root * F.exp(-z * z) * series).otherwise(F.exp(-z * z) / (z * root) / fraction)


def chi2_pvalue(chi2: Column, dof: Column) -> Column:
    """Chance of a larger chi-square value: the regularised upper incomplete gamma function Q(dof / 2, chi2 / 2) for whole degrees of freedom.

    Q(a + 1, x) = Q(a, x) + x^a e^-x / gamma(a + 1), from Q(0, x) = 0 or Q(1/2, x) = erfc(sqrt(x)); terms are added as logarithms, so large values do not overflow.
    """
    x = F.greatest(chi2.cast("double"), F.lit(0.0)) / F.lit(2.0)
    odd = dof % 2 == 1
    half = F.when(odd, 0.5).otherwise(0.0)
    start = F.when(odd, F.lit(math.log(2 / math.sqrt(math.pi))) + F.lit(0.5) * F.ln(x)).otherwise(F.lit(0.0)) - x
    # one term for each whole step of a below dof / 2
    steps = F.floor(dof / F.lit(2)).cast("int")
    terms = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(start.alias("log"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct((s["log"] + F.ln(x) - F.ln(k + half)).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
        lambda s: s["sum"],
    )
    base = F.when(odd, erfc(F.sqrt(x))).otherwise(F.lit(0.0))
    return F.when(dof <= 0, F.lit(None).cast("double")).when(x == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), base + terms))

"""Mixing sources to target weights: iterative proportional fitting of token weights to several marginals, then sampling.

Documents are counted once into cells (source, language, topic) with their tokens. The cells' weights are raked: in turn each
dimension's weights are scaled to its target shares, ``sweeps`` times over and on until every value's share is within ``TOLERANCE``
of its target, relative to it. Targets that no weights of these cells meet (sources in one language each, say) end after ``MAX_SWEEPS``
with the weights of the last sweep and a warning that gives the error left. The budget of tokens is then filled with the
raked mix: each document's chance is ``min(1, rate * weight / tokens of the cell)``, and the rate is raised until the expected tokens
equal the budget although some cells are exhausted. A document is kept if a hash of its identifier, read as a number in
[0, 1), is below its chance, so results repeat exactly and rows that repeat an identifier share its draw.

Everything runs on the cells, which are aggregated before the shuffle. Up to ``LOCAL_CELLS`` counted cells are raked on the driver. Beyond, a dimension's factors are broadcast only up to a counted
number of values; beyond it a value has few cells each and is joined by shuffle. Documents find their cell by a salted look-up, so one
cell may hold any share of the rows.

A missing source or language is the value ``(none)``. Null and empty texts count as one token, topic ``short``. Targets default to
token shares to the power ``alpha``. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only, salted_lookup, text_hash

NONE = "(none)"
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.5
#: sweeps at least
SWEEPS = 10
MAX_SWEEPS = 1000
TOLERANCE = 1e-6
LOCAL_CELLS = 50_000
RATE_STEPS = 12
BROADCAST_VALUES = 10_000


def topic_of(text: Column, words: Column) -> Column:
    """Form of a text as a stand-in for topic: what it mostly consists of."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(words < 40, "short")
        .when(bars * 20 > words, "table")
        .when(text.rlike("[lL]icen[cs]e"), "notice")
        .when(text.rlike("[0-9@=_#]"), "data")
        .otherwise("prose")
    )


def tagged(docs: DataFrame) -> DataFrame:
    """Narrow rows with the three dimensions and the tokens, fixed in the shared folder."""
    rows = only(docs, doc_id="doc_id", text="text", source="source", lang="lang").withColumn("raw", text_hash(F.col("text")))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = rows.withColumn("words", words)
    return cut_lineage(
        rows.select(
            "doc_id",
            "raw",
            *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")],
            topic_of(F.col("text"), F.col("words")).alias("topic"),
            F.greatest("words", F.lit(1)).alias("tokens"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )


def smoothed(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Default target of a dimension: (value, share) with shares of tokens ** alpha."""
    part = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), alpha).alias("p"))
    total = part.agg(F.sum("p").alias("all")).first()["all"] or 1.0
    return part.select(dim, (F.col("p") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``weight`` to cells (one row per combination, with tokens): each target (dim, share) names a column of the cells.

    Cells whose value has no target get weight 0; targets without cells are left unserved.
    """
    dims = list(targets)
    fixed = {d: cut_lineage(t.select(d, F.col("share").alias(f"_t_{d}"))) for d, t in targets.items()}
    few = {d: t.count() <= BROADCAST_VALUES for d, t in fixed.items()}

    def look(left, right, d):
        if few[d]:
            return left.join(F.broadcast(right), d, "left")
        return salted_lookup(left, right, [d], F.xxhash64(*[c for c in dims if c != d]))

    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in dims:
        out = look(out, fixed[d], d)
    out = cut_lineage(out)
    if out.count() <= LOCAL_CELLS:
        return _rake_here(out, dims, sweeps).drop(*[f"_t_{d}" for d in dims])
    for n in range(1, max(sweeps, MAX_SWEEPS) + 1):
        for d in dims:
            sums = out.groupBy(d).agg(F.sum("weight").alias("_sum"))
            out = look(out, sums, d)
            scaled = F.when(F.col("_sum") > 0, F.col("weight") * F.coalesce(F.col(f"_t_{d}"), F.lit(0.0)) / F.col("_sum")).otherwise(0.0)
            out = out.withColumn("weight", scaled).drop("_sum")
        out = cut_lineage(out)
        if n >= sweeps and (error := max((_error(out, d) for d in dims), default=0.0)) <= TOLERANCE:
            break
    else:
        _not_met(n, error)
    return out.drop(*[f"_t_{d}" for d in dims])


def _error(cells: DataFrame, d: str) -> float:
    """Largest relative error of a dimension's shares, among the values that have cells and a target."""
    sums = cells.where(f"_t_{d} > 0").groupBy(d).agg(F.sum("weight").alias("s"), F.first(f"_t_{d}").alias("t"))
    s, t = sums.agg(F.sum("s"), F.sum("t")).first()
    if not s:
        return 0.0
    return sums.agg(F.max(F.abs(F.col("s") / F.lit(s) / (F.col("t") / F.lit(t)) - 1))).first()[0]


def _not_met(sweeps: int, error: float) -> None:
    warnings.warn(f"targets not met after {sweeps} sweeps: largest relative error {error:.2g}", stacklevel=3)


def _rake_here(cells: DataFrame, dims: list[str], sweeps: int) -> DataFrame:
    """The same sweeps over few cells in numpy."""
    rows = cells.collect()  # bounded by LOCAL_CELLS
    weight = np.array([r["weight"] for r in rows], float)
    sides = []
    for d in dims:
        code: dict = {}
        at = np.array([code.setdefault(r[d], len(code)) for r in rows], int)
        target = np.zeros(len(code))
        target[at] = [r[f"_t_{d}"] or 0.0 for r in rows]
        sides.append((at, target))
    for n in range(1, max(sweeps, MAX_SWEEPS) + 1):
        for at, target in sides:
            sums = np.bincount(at, weight, len(target))
            weight = np.where(sums[at] > 0, weight * target[at] / np.where(sums[at] > 0, sums[at], 1.0), 0.0)
        error = 0.0
        for at, target in sides:
            served = target > 0
            sums = np.bincount(at, weight, len(target))[served]
            if sums.sum() > 0:
                error = max(error, float(np.abs(sums / sums.sum() / (target[served] / target[served].sum()) - 1).max()))
        if n >= sweeps and error <= TOLERANCE:
            break
    else:
        _not_met(n, error)
    keep = [c for c in cells.columns if c != "weight"]
    schema = cells.select(*keep, "weight").schema
    return cells.sparkSession.createDataFrame([(*[r[c] for c in keep], float(w)) for r, w in zip(rows, weight)], schema)


def fill_rate(cells: DataFrame, budget: float) -> float:
    """The rate at which the expected tokens, sum of min(tokens, rate * weight), equal the budget."""
    rate = None
    for _ in range(RATE_STEPS):
        full = F.lit(False) if rate is None else F.col("weight") * rate >= F.col("tokens")
        spent, open_ = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        new = (budget - (spent or 0)) / open_
        if new == rate:
            break
        rate = new
    return rate or 0.0


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) by hash of the identifier."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """One row per document: doc_id, raw, source, lang, topic, tokens, chance, kept; ``budget`` is a share of all tokens."""
    rows = tagged(docs)
    dims = list(ALPHA)
    cells = cut_lineage(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    targets = targets or {d: smoothed(cells, d, a) for d, a in ALPHA.items()}
    raked = rake(cells, targets, sweeps)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rate = fill_rate(raked, budget * total)
    chances = raked.select(*dims, F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens")).alias("chance"))
    out = salted_lookup(rows, chances, dims, F.xxhash64("uid")).drop("uid")
    return out.withColumn("kept", draw(F.col("doc_id")) < F.col("chance"))


def oracle() -> str:
    """The same in SQL: sweeps as a recursive query with the same tolerance and end, the rate steps written out."""
    dims = list(ALPHA)
    ctes = [
        r"""t AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents)""",
        r"""r AS (SELECT doc_id, source, lang, CASE WHEN words < 40 THEN 'short' WHEN (length(text) - length(replace(text, '|', ''))) * 20 > words
        THEN 'table' WHEN regexp_matches(text, '[lL]icen[cs]e') THEN 'notice' WHEN regexp_matches(text, '[0-9@=_#]') THEN 'data'
        ELSE 'prose' END AS topic, greatest(words, 1) AS tokens FROM t)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)",
        *[f"q_{d} AS (SELECT {d}, pow(sum(tokens), {a}) / sum(pow(sum(tokens), {a})) OVER () AS share FROM c GROUP BY {d})" for d, a in ALPHA.items()],
    ]
    cells = "SELECT n, source, lang, topic, tokens, weight FROM w WHERE NOT done"
    for d in dims:
        cells = f"SELECT n, source, lang, topic, tokens, weight * share / sum(weight) OVER (PARTITION BY {d}) AS weight FROM ({cells}) JOIN q_{d} USING ({d})"
    errors = [f"abs(sum(weight) OVER (PARTITION BY {d}) / sum(weight) OVER () / (SELECT share FROM q_{d} q WHERE q.{d} = x.{d}) - 1)" for d in dims]
    ctes += [
        f"""w AS (SELECT 0 AS n, source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS weight, FALSE AS done FROM c
        UNION ALL SELECT n + 1, source, lang, topic, tokens, weight, (n + 1 >= {SWEEPS} AND max(error) OVER () <= {TOLERANCE}) OR n + 1 >= {MAX_SWEEPS}
        FROM (SELECT *, greatest({', '.join(errors)}) AS error FROM ({cells}) x))""",
        "z AS MATERIALIZED (SELECT source, lang, topic, tokens, weight FROM w WHERE n = (SELECT max(n) FROM w))",
    ]
    ctes.append(f"f0 AS MATERIALIZED (SELECT {BUDGET} * sum(tokens) / sum(weight) AS rate FROM z)")
    for i in range(1, RATE_STEPS):
        ctes.append(
            f"f{i} AS MATERIALIZED (SELECT coalesce(({BUDGET} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * rate >= tokens), 0)) / nullif(sum(weight) FILTER (weight * rate < tokens), 0), any_value(rate)) AS rate FROM z, f{i - 1})"
        )
    number = "CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT)"
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f"""
    SELECT doc_id, source, lang, topic, tokens, round(chance, 9) AS chance, CAST({number} AS DOUBLE) / 4294967296.0 < chance AS kept
    FROM (SELECT r.doc_id, source, lang, topic, r.tokens, least(1.0, rate * weight / z.tokens) AS chance
          FROM r JOIN z USING (source, lang, topic), f{RATE_STEPS - 1})"""
    )

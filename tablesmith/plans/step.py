"""Steps and workflows: fit on one table (aggregates only), apply lazily to any table.

A method registers up to four functions:

* ``aggs(df, step)``       named aggregate columns it needs,
* ``quantiles(df, step)``  exact quantiles it needs, ``{column: [p, ..]}``,
* ``fit(df, step, found)`` turns those into a ``Fitted`` (or runs jobs of its own),
* ``apply(df, step, fitted)`` the lazy transformation.

Workflow.fit runs the aggregates of consecutive steps as one job where no step changes
what a later one reads.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.lookup import look_up, mapping_tables  # noqa: F401  (part of the step toolbox)
from ..functions.quantiles import exact_quantiles
from ..functions.schema import col
from ..session import small_or_cut  # noqa: F401  (part of the step toolbox)


@dataclass(frozen=True)
class Step:
    step: str
    columns: tuple[str, ...] = ()
    method: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    key: str | None = None
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    reason: str = ""

    def __post_init__(self):
        for name in ("columns", "order_by", "partition_by"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @property
    def column(self) -> str:
        return self.columns[0]

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @staticmethod
    def from_dict(d: dict) -> "Step":
        return Step(**d)


@dataclass
class Found:
    """Results of the shared fit job."""

    values: dict[str, Any]
    quantiles: dict[str, dict[float, float | None]]


@dataclass
class Fitted:
    """Fitted state of a step: scalars, and mapping tables where the state grows with the data."""

    params: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Method:
    step: str
    method: str
    apply: Callable[[DataFrame, Step, Fitted], DataFrame]
    aggs: Callable[[DataFrame, Step], dict[str, Column]] | None = None
    quantiles: Callable[[DataFrame, Step], dict[str, list[float]]] | None = None
    fit: Callable[[DataFrame, Step, Found], Fitted] | None = None
    changes_rows: bool = False
    affected: Callable[[DataFrame, Step, Fitted], Column] | None = None


METHODS: dict[tuple[str, str], Method] = {}


def register(step: str, *methods: str, **kwargs) -> None:
    for m in methods:
        METHODS[(step, m)] = Method(step, m, **kwargs)


def method_of(step: Step) -> Method:
    from .. import operators  # noqa: F401  (fills METHODS)

    found = METHODS.get((step.step, step.method))
    if found is None:
        known = sorted(m for s, m in METHODS if s == step.step)
        raise ValueError(
            f"unknown method '{step.method}' of step '{step.step}'; known: {known}" if known else f"unknown step '{step.step}'"
        )
    return found


def _names(value) -> set[str]:
    """All strings in a parameter, lists and mappings included: any of them may name a column."""
    if isinstance(value, str):
        return {value}
    if isinstance(value, dict):
        return set().union(*map(_names, [*value, *value.values()])) if value else set()
    return set().union(*map(_names, value)) if isinstance(value, (list, tuple, set)) else set()


def _columns(step: Step) -> set[str]:
    return {*step.columns, *step.order_by, *step.partition_by, *([step.key] if step.key else [])}


def _touched(step: Step) -> set[str]:
    """Columns that a step may read or write, from its fields and its parameters."""
    return _columns(step) | _names(step.params)


def _fuses(batch: list[Step], written: set[str], step: Step, columns: list[str]) -> bool:
    """Whether a step can be fitted in the same job as the steps before it, as if they had been applied first."""
    last = method_of(batch[-1])
    own = method_of(step)
    if last.changes_rows or not batch[-1].columns or not step.columns:
        return False  # rows change, or a step without columns reads whatever there is
    if own.fit and not own.aggs and not own.quantiles:
        return False  # it runs jobs of its own, over columns that it need not name
    return not _touched(step) & written and _columns(step) <= set(columns)


def _fit_batch(df: DataFrame, steps: list[Step]) -> list[Fitted]:
    aggs: list[Column] = []
    names: list[tuple[int, str]] = []
    wanted: dict[str, set[float]] = {}
    for i, s in enumerate(steps):
        m = method_of(s)
        if m.aggs:
            for name, c in m.aggs(df, s).items():
                aggs.append(c.alias(f"a{len(aggs)}"))
                names.append((i, name))
        if m.quantiles:
            for c, ps in m.quantiles(df, s).items():
                wanted.setdefault(c, set()).update(ps)
    values: list[dict[str, Any]] = [{} for _ in steps]
    if aggs:
        row = df.agg(*aggs).first()
        for j, (i, name) in enumerate(names):
            values[i][name] = row[j]
    quantiles = exact_quantiles(df, {c: sorted(ps) for c, ps in wanted.items()})
    out = []
    for s, v in zip(steps, values):
        m = method_of(s)
        found = Found(v, quantiles)
        out.append(m.fit(df, s, found) if m.fit else Fitted(params=v))
    return out


def fit_step(df: DataFrame, step: Step) -> Fitted:
    return _fit_batch(df, [step])[0]


def apply_step(df: DataFrame, step: Step, fitted: Fitted | None = None) -> DataFrame:
    """Fits where needed and applies one step."""
    m = method_of(step)
    if fitted is None:
        fitted = fit_step(df, step)
    return m.apply(df, step, fitted)


@dataclass
class FittedWorkflow:
    steps: list[Step]
    fitted: list[Fitted]
    skipped: list[tuple[Step, str]] = field(default_factory=list)

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Applies the steps in order. Steps that add or drop rows shape the training table; others keep their rows unless ``training``."""
        for s, f in zip(self.steps, self.fitted):
            if training or not method_of(s).changes_rows:
                df = method_of(s).apply(df, s, f)
        return df

    def audit(self, df: DataFrame) -> DataFrame:
        """One row per step: how many rows (or values) it affects, and its fitted scalars.

        Counts are observed on the way through the steps, as they run on a training table, in one job for all of them.
        """
        seen: list[Observation] = []
        for s, f in zip(self.steps, self.fitted):
            m = method_of(s)
            counts = [F.count(F.lit(1)).alias("rows")]
            if m.affected:
                counts.append(m.affected(df, s, f).cast("long").alias("affected"))
            seen.append(Observation())
            df = m.apply(df.observe(seen[-1], *counts), s, f)
        last = Observation()
        df.observe(last, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        found = [o.get for o in [*seen, last]]
        rows = []
        for i, (s, f) in enumerate(zip(self.steps, self.fitted)):
            m = method_of(s)
            affected = found[i]["affected"] if m.affected else found[i]["rows"] - found[i + 1]["rows"] if m.changes_rows else None
            rows.append((i + 1, s.step, ",".join(s.columns), s.method, affected, json.dumps(f.params, sort_keys=True, default=str)))
        for s, message in self.skipped:
            rows.append((None, s.step, ",".join(s.columns), s.method, None, "skipped: " + message))
        schema = "step_no int, step string, column string, method string, affected bigint, fitted string"
        return df.sparkSession.createDataFrame(rows, schema)

    def save(self, df_or_spark, path: str) -> None:
        """Steps and scalars as one JSON line, mapping tables as parquet beside it."""
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        doc = [{"step": s.to_dict(), "params": f.params, "tables": sorted(f.tables)} for s, f in zip(self.steps, self.fitted)]
        spark.createDataFrame([(json.dumps(doc, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/workflow"
        )
        for i, f in enumerate(self.fitted):
            for name, table in f.tables.items():
                table.write.mode("overwrite").parquet(f"{path}/tables/{i}/{name}")

    @staticmethod
    def load(spark, path: str) -> "FittedWorkflow":
        doc = json.loads(spark.read.text(f"{path}/workflow").first()[0])
        steps = [Step.from_dict(d["step"]) for d in doc]
        fitted = [
            Fitted(d["params"], {t: spark.read.parquet(f"{path}/tables/{i}/{t}") for t in d["tables"]})
            for i, d in enumerate(doc)
        ]
        return FittedWorkflow(steps, fitted)


@dataclass
class Workflow:
    steps: list[Step]

    def to_json(self, **context) -> str:
        return json.dumps({"steps": [s.to_dict() for s in self.steps], **context}, default=str)

    @staticmethod
    def from_json(text: str) -> "Workflow":
        return Workflow([Step.from_dict(d) for d in json.loads(text)["steps"]])

    def describe(self, df: DataFrame, dataset: str) -> DataFrame:
        """One row per step as JSON with the data set's name, shape and columns."""
        rows = df.count()
        records = [
            (i, dataset, rows, len(df.columns), ",".join(df.columns), json.dumps(s.to_dict(), sort_keys=True))
            for i, s in enumerate(self.steps, start=1)
        ]
        schema = "step_no int, dataset string, row_count bigint, column_count int, columns string, step string"
        return df.sparkSession.createDataFrame(records, schema)

    def expanded(self) -> list[Step]:
        """Steps over several columns that act on each alone become one step per column."""
        out = []
        for s in self.steps:
            if len(s.columns) > 1 and s.params.get("apply_same_method"):
                rest = {k: v for k, v in s.params.items() if k != "apply_same_method"}
                out += [replace(s, columns=(c,), params=rest) for c in s.columns]
            else:
                out.append(s)
        return out

    def fit(self, df: DataFrame, on_error: str = "fail") -> FittedWorkflow:
        if on_error not in ("fail", "skip"):
            raise ValueError("on_error is 'fail' or 'skip'")
        done: list[Step] = []
        fitted: list[Fitted] = []
        skipped: list[tuple[Step, str]] = []
        batch: list[Step] = []
        written: set[str] = set()

        def flush(df):
            try:
                got = _fit_batch(df, batch)
                out = df
                for s, f in zip(batch, got):
                    out = method_of(s).apply(out, s, f)
            except Exception:
                if on_error == "fail":
                    raise
                out, got, kept = df, [], []
                for s in batch:
                    try:
                        f = fit_step(out, s)
                        out = method_of(s).apply(out, s, f)
                        got.append(f)
                        kept.append(s)
                    except Exception as e:  # reported in the audit
                        skipped.append((s, f"{type(e).__name__}: {e}".splitlines()[0]))
                batch[:] = kept
            done.extend(batch)
            fitted.extend(got)
            batch.clear()
            written.clear()
            return out

        for s in self.expanded():
            if batch and not _fuses(batch, written, s, df.columns):
                df = flush(df)
            batch.append(s)
            written |= _touched(s)
        flush(df)
        return FittedWorkflow(done, fitted, skipped)

"""A fitted workflow of expression steps also runs on a stream, as it holds no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.step import FittedWorkflow

COMPARES_ROWS = {"knn", "tfidf", "word_embeddings"}


def transform_stream(stream: DataFrame, fitted: FittedWorkflow) -> DataFrame:
    """Applies the workflow to a streaming table; steps that compare rows are refused."""
    for s in fitted.steps:
        ordered = s.order_by and s.step in ("impute_missing", "time_features")
        if s.step in ("remove_duplicates", "handle_imbalance") or ordered or s.method in COMPARES_ROWS:
            raise ValueError(f"step '{s.step}' ({s.method}) compares rows and does not run on a stream")
    return fitted.transform(stream)

"""Fitted transformers on streams: they are projections with literals, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import apply


def score(stream: DataFrame, fitted: dict) -> DataFrame:
    """fitted: what ``FeatureEngineer.fitted()`` gives."""
    for one in [*fitted["encoders"].values(), *fitted["scalers"].values()]:
        stream = apply(stream, one)
    return stream

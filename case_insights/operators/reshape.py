"""Long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(
    df: DataFrame, key: str, category: str, value: str, values: Sequence[str] | None = None
) -> DataFrame:
    """One row per key and one column per category that occurs, in order of name. ``values`` saves the
    job that looks the categories up; it must name all of them, and the query fails on any other. Each
    cell holds one long row, so the first value is the value."""
    if values:
        name = F.col(category)
        stray = F.raise_error(F.concat(F.lit("category not listed: "), name))
        df = df.withColumn(category, F.when(name.isNull() | name.isin(list(values)), name).otherwise(stray))
    pivot = df.groupBy(key).pivot(category, list(values) if values else None)
    return pivot.agg(F.first(value)).orderBy(key)

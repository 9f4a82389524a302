"""Writers of results for reporting tools."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_complaints(complaints: DataFrame, path: str) -> None:
    """Write the fact table once as flat Parquet, so that later queries are plain column scans."""
    complaints.write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record per row."""
    df.write.mode("overwrite").json(path)


def write_marts(
    results: Mapping[str, DataFrame],
    path: str,
    partition_by: Mapping[str, list[str]] | None = None,
) -> None:
    """One Parquet folder per result. ``partition_by`` names folder columns for results that are
    later read by slice, for example the year of a trend."""
    for name, df in results.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}")

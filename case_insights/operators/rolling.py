"""Trailing means over a daily series, and the zero-filling that a category series needs first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_mean(
    df: DataFrame,
    value: str,
    name: str,
    order_by: str,
    window: int,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Mean of this and the ``window - 1`` rows before it; null until that many rows exist. Rows, not
    days. Without ``partition_by`` all rows meet in one task, so give it aggregated rows only."""
    w = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(1 - window, 0)
    mean = F.when(F.count(F.lit(1)).over(w) >= window, F.avg(value).over(w))
    return df.withColumn(name, mean)


def fill_gaps(cells: DataFrame, date: str, category: str, value: str) -> DataFrame:
    """One row per category and date present anywhere in ``cells``, 0 where a category has none.

    Dates are numbered once. Each category row then stands for itself and for the missing date
    numbers up to the category's next row, and its first row also for those before it. The work is
    in proportion to the rows written, and no category meets another's rows.
    """
    n = F.col(value)
    # Summing the value keeps this side on the very same aggregate as `cells`, so that Spark reuses
    # its shuffle in place of a second read of the raw table. The dates are bounded by the calendar.
    dates = (
        cells.groupBy(date)
        .agg(F.sum(value).alias("_total"))
        .filter("_total > 0")
        .select(
            F.col(date).alias("_date"),
            F.row_number().over(Window.orderBy(date)).alias("_day"),
            F.count(F.lit(1)).over(Window.partitionBy()).alias("_days"),
        )
    )
    by_day = Window.partitionBy(category).orderBy("_day")
    until = F.coalesce(F.lead("_day").over(by_day) - 1, F.col("_days"))
    since = F.when(F.row_number().over(by_day) == 1, 1).otherwise(F.col("_day"))
    spans = (
        cells.join(dates, F.col(date) == F.col("_date"))
        .select(category, n, "_day", since.cast("int").alias("_from"), until.cast("int").alias("_to"))
        .select(category, n, "_day", F.explode(F.sequence("_from", "_to")).alias("_at"))
    )
    filled = F.when(F.col("_at") == F.col("_span_day"), n).otherwise(0)
    return (
        spans.withColumnRenamed("_day", "_span_day")
        .join(dates, F.col("_at") == F.col("_day"))
        .select(F.col("_date").alias(date), category, filled.cast("bigint").alias(value))
    )

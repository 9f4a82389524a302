"""Companies of any span of days from small sketches kept by day, beside the exact counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 14  # 2^14 registers: a relative standard error of about 0.65 %
STANDARD_ERROR = 0.83 / (1 << PRECISION // 2)


def company_sketches(c: DataFrame, day: str = "date_received") -> DataFrame:
    """(date_received, cases, companies): for each day a sketch of its different companies. Sketches are combined in
    each task before the shuffle, so a day with very many cases costs a sketch for each task."""
    return c.groupBy(F.col(day).alias("date_received")).agg(
        F.count(F.lit(1)).alias("cases"), F.hll_sketch_agg("company_name", PRECISION).alias("companies")
    )


def refresh_company_sketches(c: DataFrame, path: str) -> None:
    """Store the sketches of the days of ``c``, a folder for each. A day that is stored already is replaced, so ``c``
    must hold whole days."""
    spread = company_sketches(c).repartition("date_received")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_received").parquet(path)


def read_company_sketches(spark: SparkSession, path: str) -> DataFrame:
    """What ``refresh_company_sketches`` stored."""
    return spark.read.schema("cases long, companies binary, date_received date").parquet(path)


def companies_between(sketches: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """One row (cases, companies): cases and about how many different companies there are on the days from ``first``
    to ``last``, both included; without bounds, on all dated and undated days. Only these days' sketches are read."""
    day = F.col("date_received")
    span = sketches
    if first is not None:
        span = span.filter(day >= F.lit(first))
    if last is not None:
        span = span.filter(day <= F.lit(last))
    return span.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"), _companies())


def companies_by_year(sketches: DataFrame) -> DataFrame:
    """(year, cases, companies), from the same sketches."""
    return sketches.groupBy(F.year("date_received").alias("year")).agg(F.sum("cases").alias("cases"), _companies())


def _companies():
    merged = F.hll_sketch_estimate(F.hll_union_agg("companies"))
    return F.coalesce(merged, F.lit(0).cast("long")).alias("companies")

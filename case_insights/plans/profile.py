"""Missing values, preview rows, companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.functions.columns import n_cases
from case_insights.operators.ranking import top_rows
from case_insights.sources.lookups import PROFILE_COLUMNS


def missing_profile(c: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """One row with the number of nulls in each column."""
    return c.agg(*(n_cases(c, F.col(x).isNull()).alias(f"{x}_missing_count") for x in columns))


def sample_rows(c: DataFrame, n: int = 5, ordered: bool = True) -> DataFrame:
    """A preview. Ordered by all columns it is the same rows each time, at the cost of reading the
    whole table; unordered it stops after the first files."""
    return (c.orderBy(*c.columns) if ordered else c).limit(n)


def company_count(c: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of different companies, exact or within about 5 %."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return c.agg(count("company_name").alias("total_companies"))


def top_companies(c: DataFrame, n: int = 10) -> DataFrame:
    """Companies by number of cases. ``total_companies`` counts names within the company's own group,
    so it is 1, or 0 for the group without a name; ``company_count`` has the overall number."""
    cases = c.groupBy("company_name").agg(n_cases(c).alias("total_complaints"))
    named = F.col("company_name").isNotNull().cast("bigint").alias("total_companies")
    return top_rows(
        cases.select(named, "company_name", "total_complaints"), "total_complaints", n, ["company_name"]
    )

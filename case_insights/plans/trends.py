"""Daily series with their 30-row mean, and yearly outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from case_insights.functions.columns import UNKNOWN, n_cases
from case_insights.operators.ranking import first_per_group, rank_at_most
from case_insights.operators.reshape import to_wide
from case_insights.operators.rolling import fill_gaps, trailing_mean
from case_insights.sources.schema import RESPONSE

# The two responses that count as relief.
MONETARY = "Closed with monetary relief"
NON_MONETARY = "Closed with non-monetary relief"


def _day() -> Column:
    return F.col("date_received").cast("date").alias("date_received")



def daily_trend(c: DataFrame, window: int = 30, since_year: int = 2012) -> DataFrame:
    """Cases per day with the trailing mean. Days without cases are not filled in. The mean is taken
    over all days and the years cut off after it, so the first means still see the days before."""
    days = c.groupBy(_day()).agg(n_cases(c).alias("cnt"))
    trend = trailing_mean(days, "cnt", "monthly_mva", "date_received", window)
    return trend.filter(F.year("date_received") >= since_year).orderBy("date_received")


def trend_years(trend: DataFrame) -> DataFrame:
    """One row: first year, last year, and all years present."""
    year = F.year("date_received")
    return trend.agg(
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
        F.array_sort(F.collect_set(year)).alias("years"),
    )


def trend_year_slice(trend: DataFrame, year: int) -> DataFrame:
    return trend.filter(F.year("date_received") == year)


def category_trend(c: DataFrame, category: str, window: int = 30) -> DataFrame:
    """(date_received, category, cnt, mva): cases per day and category with the trailing mean. A
    category counts 0 on the days on which only others occur. Null categories and dates are out."""
    cells = (
        c.filter(F.col(category).isNotNull() & F.col("date_received").isNotNull())
        .groupBy(_day(), F.col(category).alias("category"))
        .agg(n_cases(c).alias("cnt"))
    )
    full = fill_gaps(cells, "date_received", "category", "cnt")
    return trailing_mean(full, "cnt", "mva", "date_received", window, ["category"])


def category_trend_wide(trend: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """The means with one column per category."""
    return to_wide(trend, "date_received", "category", "mva", values)


def category_trend_slice(trend: DataFrame, value: str) -> DataFrame:
    """One category of a stored trend."""
    return trend.filter(F.col("category") == value).select("date_received", "mva")


def one_category_trend(c: DataFrame, category: str, value: str, window: int = 30) -> DataFrame:
    """The same from the table itself: a conditional count per day replaces the zero-filling."""
    days = (
        c.filter(F.col(category).isNotNull() & F.col("date_received").isNotNull())
        .groupBy(_day())
        .agg(n_cases(c, F.col(category) == value).alias("cnt"))
    )
    trend = trailing_mean(days, "cnt", "mva", "date_received", window)
    return trend.select("date_received", "mva").orderBy("date_received")


def _outcomes(c: DataFrame) -> list[Column]:
    return [
        n_cases(c).alias("total"),
        n_cases(c, F.col(RESPONSE) == MONETARY).alias("monetary"),
        n_cases(c, F.col(RESPONSE) == NON_MONETARY).alias("non_monetary"),
    ]


def _proportions() -> list[Column]:
    return [
        F.try_divide("monetary", "total").alias("proportion_monetary"),
        F.try_divide("non_monetary", "total").alias("proportion_non_monetary"),
    ]


def _year() -> Column:
    return F.trunc("date_received", "year").alias("year")


def _has_both() -> Column:
    # One test of the counts: as a plain filter, the year's part would be moved into the scan, and
    # uses of the same counts could no longer share them.
    return F.when(F.col("year").isNotNull(), F.least("monetary", "non_monetary")) > 0


def relief_proportion_by_year(c: DataFrame) -> DataFrame:
    """Share of cases closed with each kind of relief, per year, for years that have both kinds. One
    scan with conditional counts does what joining three yearly tables would."""
    return (
        c.groupBy(_year()).agg(*_outcomes(c)).filter(_has_both()).select("year", *_proportions()).orderBy("year")
    )


def relief_proportion_by_company(c: DataFrame, top: int = 5) -> DataFrame:
    """The same per year and company, for the companies of rank ``top`` or better by cases.

    Cases without a company take part in the ranking but are not shown. Ranking also looks at which
    companies have anything to show: it then reads the same columns of the same yearly counts, and
    Spark reuses their shuffle in place of a second read of the table.
    """
    yearly = c.groupBy(_year(), "company_name").agg(*_outcomes(c))
    companies = yearly.groupBy("company_name").agg(
        F.sum("total").alias("company_total"), F.max(_has_both()).alias("shown")
    )
    shown = (
        rank_at_most(companies, "company_total", top)
        .filter("shown and company_name is not null")
        .select(F.col("company_name").alias("_company"))
    )
    return (
        yearly.filter(_has_both())
        .join(shown, F.col("company_name").eqNullSafe(F.col("_company")), "left_semi")
        .select("year", "company_name", *_proportions())
        .orderBy("year", "company_name")
    )


def top_issue_by_year(c: DataFrame) -> DataFrame:
    """The issue with most cases of each year, null issues counted and shown as 'Unknown'. Names are
    filled in after counting, so a literal 'Unknown' stays a group of its own."""
    counts = (
        c.filter(F.col("date_received").isNotNull())
        .groupBy(F.year("date_received").alias("year"), "issue")
        .agg(n_cases(c).alias("cnt"))
    )
    order = [F.desc("cnt"), F.asc_nulls_last("issue")]
    return first_per_group(counts, ["year"], order).na.fill(UNKNOWN, ["issue"]).orderBy("year")

"""Every table a report shows, by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from case_insights.functions.columns import CASES, n_cases
from case_insights.operators.chi2 import chi2
from case_insights.operators.contingency import pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.plans import distribution, outcomes, profile, trends
from case_insights.sources.schema import RESPONSE
from case_insights.sources.sinks import write_marts


# What each family of report tables is counted by, and how finely the date is kept for it.
FAMILIES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "cases_by_state": (("product", "subproduct", "state"), None),
    "cases_by_issue": (("issue", "subissue"), None),
    "cases_by_channel": (("submitted_via", RESPONSE, "consumer_disputed"), None),
    "cases_by_day_response": ((RESPONSE,), "day"),
    "cases_by_day_product": (("product",), "day"),
    "cases_by_year_issue": (("issue",), "year"),
    "cases_by_year_company": (("company_name", RESPONSE), "year"),
}
DAY = "date_received"
COLUMNS = list(dict.fromkeys(c for columns, _ in FAMILIES.values() for c in columns))


def _of_family(grain: Mapping[str, Column], name: Column) -> Column:
    """The date as finely as the family asks; null for a family without one."""
    date = F.lit(None).cast("date")
    for family, (_, kept) in FAMILIES.items():
        if kept:
            date = F.when(name == family, grain[kept]).otherwise(date)
    return date


def base_table(c: DataFrame, by_day: bool = False) -> DataFrame:
    """(family, date_received, the columns counted by, _cases): the counts of every family, from one scan. Columns that
    a family isn't counted by are null in its rows. With ``by_day`` all families are counted day by day.

    The scan repeats a case once for each family, without its other columns, and counts are combined before the
    shuffle."""
    rows = c.select(DAY, F.trunc(DAY, "year").alias("_year"), *COLUMNS, *([CASES] if CASES in c.columns else []))
    date = {None: [], "day": [DAY], "year": ["_year"]}
    sets = {name: [*columns, *(date["day"] if by_day else date[kept])] for name, (columns, kept) in FAMILIES.items()}
    keys = [k for k in (DAY, "_year", *COLUMNS) if any(k in s for s in sets.values())]
    counts = rows.groupingSets([[F.col(k) for k in s] for s in sets.values()], *keys).agg(
        F.grouping_id().alias("_set"), n_cases(rows).alias(CASES)
    )
    # a bit for each key that a set leaves out, the first key's the highest
    bits = {sum(1 << i for i, k in enumerate(reversed(keys)) if k not in s): name for name, s in sets.items()}
    family = F.element_at(F.create_map(*(F.lit(x) for pair in bits.items() for x in pair)), F.col("_set").cast("int"))
    counts = counts.withColumn("family", family)
    if not by_day:
        counts = counts.withColumn(DAY, F.coalesce(DAY, "_year"))
    return counts.select("family", DAY, *COLUMNS, CASES)


def family_counts(base: DataFrame) -> dict[str, DataFrame]:
    """Each family of a base table with the columns it has, in place of the cases."""
    return {
        name: base.filter(F.col("family") == name).select(*columns, *([DAY] if kept else []), CASES)
        for name, (columns, kept) in FAMILIES.items()
    }


def refresh_days(c: DataFrame, path: str) -> None:
    """Count the cases of ``c`` day by day into the stored counts at ``path``, a folder for each day.

    Every day that ``c`` has replaces what is stored for it, and other days stay, so ``c`` must hold whole days: new
    ones, or days counted before that have changed. Counting a day twice changes nothing. Cases without a date
    are a day of their own. Only the days of ``c`` are read and written."""
    days = base_table(c, by_day=True)
    spread = days.repartition(DAY).sortWithinPartitions("family")  # a file for each day, families apart in it
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, c_schema: StructType) -> DataFrame:
    """The base table of the days stored at ``path``, each family's date as finely as it asks."""
    types = {f.name: f for f in c_schema}
    fields = [StructField("family", StringType()), types[DAY], *(types[k] for k in COLUMNS), StructField(CASES, LongType())]
    days = spark.read.schema(StructType(fields)).parquet(path)
    grain = {"day": F.col(DAY), "year": F.trunc(DAY, "year")}
    day = _of_family(grain, F.col("family"))
    return days.groupBy("family", day.alias(DAY), *COLUMNS).agg(F.sum(CASES).alias(CASES))


def report_tables(
    c: DataFrame,
    product_lookup: DataFrame,
    issue_lookup: DataFrame,
    counts: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Lazy results, for ``write_marts``, each over the cases themselves or, with ``counts``, over the family of
    ``family_counts`` that has its columns. When ``c`` is itself a join, write it once with
    ``write_complaints`` and pass the flat table, so that each result scans only its few columns."""

    def of(name: str) -> DataFrame:
        return counts[name] if counts else c

    states, issues, channel = of("cases_by_state"), of("cases_by_issue"), of("cases_by_channel")
    days, products = of("cases_by_day_response"), of("cases_by_day_product")
    issue_years, companies = of("cases_by_year_issue"), of("cases_by_year_company")
    pss = distribution.product_subproduct_state(states)
    disputes = outcomes.dispute_by_response(channel)
    return {
        "missing_profile": profile.missing_profile(c),
        "sample_rows": profile.sample_rows(c, ordered=False),
        "product_top10": distribution.product_top10(states, product_lookup),
        "product_subproduct_state": pss,
        "product_children": distribution.product_children(pss),
        "issue_counts_known": distribution.issue_counts(issues, known_only=True),
        "issue_subissue_known": distribution.issue_subissue_counts(issues, known_only=True),
        "issue_children": distribution.issue_children(issues),
        "top_issue_subissue": distribution.top_issue_subissue(issues, issue_lookup),
        "submission_response": distribution.submission_response(channel),
        "submission_share": distribution.submission_share(channel),
        "chi2_presence": chi2(pair_cells(channel, "submitted_via", RESPONSE, presence=True)),
        "chi2_weighted": chi2(pair_cells(channel, "submitted_via", RESPONSE)),
        "daily_trend": trends.daily_trend(days),
        "relief_proportion_by_year": trends.relief_proportion_by_year(days),
        "relief_proportion_by_company": trends.relief_proportion_by_company(companies),
        "response_trend": trends.category_trend(days, RESPONSE),
        "product_trend": trends.category_trend(products, "product"),
        "top_issue_by_year": trends.top_issue_by_year(issue_years),
        "response_share": outcomes.response_share(channel),
        "dispute_rate": outcomes.dispute_rate(disputes),
        "dispute_percentage": outcomes.dispute_percentage(disputes),
        "fisher_exact": fisher_exact(outcomes.relief_dispute_table(disputes)),
        "company_count": profile.company_count(companies),
        "top_companies": profile.top_companies(companies),
    }


def write_report(
    c: DataFrame,
    product_lookup: DataFrame,
    issue_lookup: DataFrame,
    path: str,
    partition_by: Mapping[str, list[str]] | None = None,
    days: str | None = None,
) -> None:
    """All tables as Parquet folders under ``path``. The base counts are written first, from one scan of the cases,
    and all results but the profile and the preview read those. With ``days``, the folder of ``refresh_days``, they
    come from the counts stored there, and the cases are scanned for the profile only."""
    base = read_days(c.sparkSession, days, c.schema) if days else base_table(c)
    write_marts({"base_counts": base}, path, {"base_counts": ["family"]})
    stored = c.sparkSession.read.schema(base.schema).parquet(f"{path}/base_counts")
    write_marts(report_tables(c, product_lookup, issue_lookup, family_counts(stored)), path, partition_by)

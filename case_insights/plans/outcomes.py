"""Company responses and consumer disputes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.functions.columns import bool_text, n_cases
from case_insights.sources.lookups import DISPUTE_RESPONSES, RELIEF_CLASSES, mapped
from case_insights.sources.schema import RESPONSE


def response_share(c: DataFrame) -> DataFrame:
    """Cases by known response, with the share of all of them."""
    counts = (
        c.filter(F.col(RESPONSE).isNotNull()).groupBy(RESPONSE).agg(n_cases(c).alias("cnt"))
    )
    total = F.sum("cnt").over(Window.partitionBy())
    return counts.withColumn("share", F.try_divide("cnt", total))


def dispute_by_response(c: DataFrame, responses: Sequence[str] = DISPUTE_RESPONSES) -> DataFrame:
    """(response, dispute 'True' or 'False', count_response), for the listed responses and cases
    where it is known whether the consumer disputed."""
    return (
        c.filter(F.col(RESPONSE).isin(list(responses)) & F.col("consumer_disputed").isNotNull())
        .groupBy(F.col(RESPONSE).alias("response"), "consumer_disputed")
        .agg(n_cases(c).alias("count_response"))
        .select("response", bool_text(F.col("consumer_disputed")).alias("dispute"), "count_response")
    )


def dispute_rate(d: DataFrame) -> DataFrame:
    """Share of each dispute value within its response."""
    total = F.sum("count_response").over(Window.partitionBy("response"))
    return d.select("response", "dispute", F.try_divide("count_response", total).alias("share"))


def dispute_percentage(d: DataFrame) -> DataFrame:
    """Percent disputed of each response."""
    disputed = F.sum(F.when(F.col("dispute") == "True", F.col("count_response")).otherwise(0))
    percentage = F.try_divide(disputed, F.sum("count_response")) * 100
    return d.groupBy("response").agg(percentage.alias("dispute_percentage"))


def relief_dispute_table(
    d: DataFrame, relief_classes: Mapping[str, str] = RELIEF_CLASSES
) -> DataFrame:
    """(relief, false_n, true_n): cases by relief class and dispute, responses without a class out."""
    relief = d.withColumn("relief", mapped(F.col("response"), relief_classes))

    def count(value):
        return F.sum(F.when(F.col("dispute") == value, F.col("count_response")).otherwise(0))

    return (
        relief.filter(F.col("relief").isNotNull())
        .groupBy("relief")
        .agg(count("False").alias("false_n"), count("True").alias("true_n"))
        .orderBy("relief")
    )

"""Column expressions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
CASES = "_cases"


def counted(c: DataFrame, *columns: Column | str) -> DataFrame:
    """Cases by some columns, as a small stand-in for the cases themselves: every analysis that needs no
    other column gives the same over it."""
    return c.groupBy(*columns).agg(n_cases(c).alias(CASES))


def n_cases(c: DataFrame, condition: Column | None = None) -> Column:
    """An aggregate over ``c``, or rows of it: the number of cases, or of those that meet a condition."""
    if CASES not in c.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    n = F.col(CASES) if condition is None else F.when(condition, F.col(CASES))
    return F.coalesce(F.sum(n), F.lit(0).cast("bigint"))


def or_unknown(column: Column) -> Column:
    """The value, or 'Unknown' for null. Group by this as a new column: a null group and a literal
    'Unknown' group then become one."""
    return F.coalesce(column, F.lit(UNKNOWN))


def is_known(column: Column) -> Column:
    return column != UNKNOWN


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(part, total) * 100


def two_decimals(value: Column, suffix: str = "") -> Column:
    """Text with two decimals and no thousands separators."""
    return F.format_string("%.2f" + suffix.replace("%", "%%"), value)


def bool_text(flag: Column) -> Column:
    """'True' or 'False'; null stays null."""
    return F.when(flag, "True").when(~flag, "False")


def verdict(p_value: Column, alpha: float) -> Column:
    return F.when(p_value < alpha, "reject the null hypothesis").otherwise(
        "fail to reject the null hypothesis"
    )

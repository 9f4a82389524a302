"""Chi-square test of independence from the occurring cells alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from case_insights.functions.chi2_tail import chi2_tail
from case_insights.functions.columns import verdict
from case_insights.operators.contingency import with_expected


def _keys(cells: DataFrame, key: str) -> Column:
    """The number of keys; it reads the margin that the test has anyway."""
    return cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.count("n")).scalar()


def chi2(cells: DataFrame, yates: bool = True, alpha: float = 0.05) -> DataFrame:
    """One row: statistic, dof, p_value, reject, verdict.

    ``cells`` is (row, col, n); zero cells may be there or not. A cell that does not occur adds its
    expected count to the statistic, and all of those together are the total less the expected
    counts of the occurring cells, so the dense grid is never built. With one degree of freedom and
    ``yates``, each deviation is first drawn 0.5 towards zero; in a 2 x 2 table all four deviations
    are equal in size, which leaves a product of the margins.
    """
    n, e = F.col("n"), F.col("expected")
    rows, cols = F.col("row_total"), F.col("col_total")
    cells = cells.filter("n > 0")
    whole = T.DecimalType(19, 0)
    sums = with_expected(cells).agg(
        F.sum((n - e) * (n - e) / e).alias("occurring"),
        F.sum((rows.cast(whole) * cols.cast(whole)).cast("decimal(38,0)")).alias("products"),
        F.sum("n").cast(whole).alias("total"),
        F.count(F.lit(1)).alias("cells"),
        _keys(cells, "row").alias("n_rows"),
        _keys(cells, "col").alias("n_cols"),
        F.sum(n / rows / rows).alias("inv_rows"),
        F.sum(n / cols / cols).alias("inv_cols"),
        F.max(F.abs(n - e)).alias("deviation"),
    )
    # The total less the covered counts, over one denominator: exact where the two are nearly equal.
    total = F.col("total")
    empty = ((total * total).cast("decimal(38,0)") - F.col("products")).cast("double") / total.cast("double")
    plain = F.col("occurring") + F.coalesce(empty, F.lit(0.0))
    drawn = F.greatest(F.col("deviation") - 0.5, F.lit(0.0))
    corrected = drawn * drawn * F.col("total") * F.col("inv_rows") * F.col("inv_cols")
    dof = ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof")
    statistic = F.when((dof == 1) & F.lit(yates), corrected).otherwise(plain)
    tested = sums.select(F.when(dof > 0, statistic).otherwise(0.0).alias("statistic"), dof)
    p = F.col("p_value")
    return tested.withColumn("p_value", chi2_tail(F.col("statistic"), F.col("dof"))).select(
        "statistic", "dof", "p_value", (p < alpha).alias("reject"), verdict(p, alpha).alias("verdict")
    )

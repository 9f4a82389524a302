"""Contingency tables in sparse form, with margins, and their dense display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.functions.columns import n_cases


def pair_cells(
    df: DataFrame, row: str, col: str, weight: str | None = None, presence: bool = False
) -> DataFrame:
    """(row, col, n) for the pairs that occur; rows with a null key are left out.

    ``n`` counts rows, or sums ``weight``, or is 1 for every pair when ``presence`` is set.
    """
    kept = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    keyed = kept.groupBy(F.col(row).alias("row"), F.col(col).alias("col"))
    count = n_cases(df) if weight is None else F.sum(weight)
    cells = keyed.agg(count.cast("bigint").alias("n"))
    return cells.withColumn("n", F.least("n", F.lit(1).cast("bigint"))) if presence else cells


def with_expected(cells: DataFrame) -> DataFrame:
    """Adds both margins and the count expected under independence to each occurring cell.

    A row key may occur with very many column keys, so its cells are not brought together: margins
    are partial sums joined back, and Spark broadcasts them or splits a hot key by their size. The
    margins and the grand total read the same cells, whose shuffle is reused, not computed again.
    """
    rows = cells.groupBy("row").agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy("col").agg(F.sum("n").alias("col_total"))
    total = cells.agg(F.sum("n").cast("double")).scalar()
    value = F.col("row_total").cast("double") * F.col("col_total") / total
    return cells.join(rows, "row").join(cols, "col").withColumn("expected", value)


def contingency(cells: DataFrame, dense: bool = False) -> DataFrame:
    """(row, col, n, row_total, col_total) for the cells that occur. ``dense`` is for display: (row, col, n)
    for every row key with every column key, 0 where none."""
    if not dense:
        return with_expected(cells).select("row", "col", "n", "row_total", "col_total")
    return (
        _all_pairs(cells)
        .join(cells, ["row", "col"], "left")
        .select("row", "col", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        .orderBy("row", "col")
    )


def expected(cells: DataFrame, dense: bool = False) -> DataFrame:
    """(row, col, expected) for the cells that occur, or with ``dense`` for every row key with every column
    key."""
    if not dense:
        return with_expected(cells).select("row", "col", "expected")
    total = cells.agg(F.sum("n").cast("double")).scalar()
    value = F.col("row_total").cast("double") * F.col("col_total") / total
    return _all_pairs(cells).select("row", "col", value.alias("expected")).orderBy("row", "col")


def _all_pairs(cells: DataFrame) -> DataFrame:
    """Every row key with every column key and their totals: an all-pairs result, as large as its answer, for
    tables small enough to look at. Column keys are numbered in one task, each row key lists the numbers,
    and an equi-join brings the keys back."""
    rows = cells.groupBy("row").agg(F.sum("n").alias("row_total")).filter("row_total > 0")
    cols = (
        cells.groupBy("col")
        .agg(F.sum("n").alias("col_total"))
        .filter("col_total > 0")
        .withColumn("_j", F.row_number().over(Window.orderBy("col")))
    )
    width = cols.agg(F.max("_j")).scalar()
    return (
        rows.withColumn("_j", F.explode(F.sequence(F.lit(1), width)))
        .join(cols, "_j")
        .drop("_j")
    )

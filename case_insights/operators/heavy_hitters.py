"""The most frequent values of a column with very many values, without a shuffle of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.operators.ranking import top_rows

TRACKED = 10_000  # values that a sketch keeps


def sketch_error(tracked: int) -> float:
    """Share of all rows by which a sketch of ``tracked`` values may be wrong on one of them. It keeps its values in a
    map of a power of two, three quarters full, and is off by 3.5 over that map's size at most."""
    return 3.5 / (1 << (-(-tracked * 4 // 3) - 1).bit_length())


def top_values(df: DataFrame, column: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """(``column``, cnt): the ``n`` most frequent values, null being one, ties to the smaller value. Exact.

    Each task sketches the values it reads, and the sketches, of fixed size, are merged: that gives at most
    ``tracked`` candidates. A second scan counts those alone. Values that are no candidates have at most as many rows
    as the sketch may be wrong by; if the last of the top values doesn't beat that, all values are counted, as a
    plain aggregate does. Two or three jobs run at once."""
    spark = df.sparkSession
    bound, rows = _sketched(df, column, tracked)
    candidates = spark.createDataFrame([(v,) for v in rows], df.select(column).schema)
    counts = count_of(df, column, candidates)
    best = top_rows(counts, "cnt", n, [column]).collect()
    if len(best) == n and best[-1].cnt > bound:
        return spark.createDataFrame(best, counts.schema)
    return top_rows(df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")), "cnt", n, [column])


def count_of(df: DataFrame, column: str, candidates: DataFrame) -> DataFrame:
    """(``column``, cnt) for the values in ``candidates``, and null; other rows don't reach the shuffle."""
    wanted = F.broadcast(candidates.withColumn("wanted", F.lit(True)))  # at most as many as a sketch keeps
    known = df.select(column).join(wanted, column, "left").filter(F.col("wanted") | F.col(column).isNull())
    return known.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def _sketched(df: DataFrame, column: str, tracked: int) -> tuple[float, list]:
    """Rows that a value missing from the candidates has at most, and the candidates."""
    value = f"`{column}`"
    row = df.filter(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({value}, {tracked}, {tracked})").alias("top")
    ).first()
    top = row.top or []
    # a value is returned if it has more than the error to spare; its estimate is no less than its count
    bound = 2 * sketch_error(tracked) * row.n
    if len(top) == tracked:
        bound = max(bound, top[-1]["count"])
    return bound, [t["item"] for t in top]

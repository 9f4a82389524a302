"""Top-k, arg-max and ordered lists. Ties are broken by the keys given, so results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the largest ``by``: a bounded heap per task, no full sort."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group. Spark keeps one candidate per task and group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rank_at_most(df: DataFrame, by: str, k: int) -> DataFrame:
    """Rows whose rank by ``by`` descending is at most ``k``; equal values share a rank, so more than
    ``k`` rows may stay. Each task sends on only its own rows of rank ``k`` or better."""
    w = Window.orderBy(F.desc(by))
    return df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def ordered_children(df: DataFrame, parent: str, child: str, weight: str) -> DataFrame:
    """(parent, children): distinct children by their largest weight descending, then by name."""
    best = df.groupBy(parent, child).agg(F.max(weight).alias("_w"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("o"), F.col(child).alias("c"))))
    return best.groupBy(F.col(parent).alias("parent")).agg(
        F.transform(listed, lambda x: x["c"]).alias("children")
    )

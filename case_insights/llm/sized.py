"""Tables whose size decides how they are joined, and vectors fit for exact work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose counted number of rows is given, marked for broadcast up to a fixed number of short rows;
    beyond it the planner joins by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def usable(vector: str) -> Column:
    """The vector is there, and so are all of its components, as finite numbers."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )


def scaled(vector: str, scale: int = 256) -> Column:
    """Components as whole numbers: floor(scale * component), in double precision."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))

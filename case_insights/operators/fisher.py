"""Fisher's exact test of a 2 x 2 table, two-sided."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from case_insights.functions.columns import verdict

_BLOCK = 4096
_TASKS = 32


# ln m! - (m ln m - m) for m = 0 .. 15.
_SMALL = ", ".join(
    f"{math.lgamma(m + 1) - (m * math.log(m) - m if m else 0):.17g}D" for m in range(16)
)


def _log_factorial_rest(m: str) -> str:
    """ln m! - (m ln m - m): from the list for m < 16, beyond by Stirling's series (error < 1e-13)."""
    series = f"(1/12D - (1/360D - (1/1260D - 1/1680D/{m}/{m})/{m}/{m})/{m}/{m})/{m}"
    return f"CASE WHEN {m} < 16 THEN get(array({_SMALL}), int({m})) ELSE ln(2*pi()*{m})/2 + {series} END"


def _deviance(o: str, e: str) -> str:
    """o ln(o / e) - (o - e), without the cancellation of its large terms."""
    return f"CASE WHEN {o} = 0 THEN {e} ELSE {o}*log1p(({o} - {e})/{e}) - ({o} - {e}) END"


def _log_mass(k: str) -> Column:
    """Log-probability of the table whose first cell is ``k``, under the margins r1, r2, c1, c2. Their
    own part of it is the column ``fixed``."""
    cells = [
        (f"{k}", "(r1*c1/n)"),
        (f"(r1 - {k})", "(r1*c2/n)"),
        (f"(c1 - {k})", "(r2*c1/n)"),
        (f"(r2 - c1 + {k})", "(r2*c2/n)"),
    ]
    parts = [f(*x) for o, e in cells for f, x in ((_deviance, (o, e)), (_log_factorial_rest, (o,)))]
    return F.expr("fixed - " + " - ".join(f"({p})" for p in parts))


def _fixed() -> Column:
    margins = " + ".join(f"({_log_factorial_rest(m)})" for m in ("r1", "r2", "c1", "c2"))
    return F.expr(f"{margins} - ({_log_factorial_rest('n')})")


def fisher_exact(
    table: DataFrame,
    row: str = "relief",
    first: str = "false_n",
    second: str = "true_n",
    rows: tuple[str, str] = ("Monetary", "Non-Monetary"),
    alpha: float = 0.05,
) -> DataFrame:
    """One row: odds_ratio, p_value, reject, verdict, for the table [[a, b], [c, d]] whose rows are
    ``rows`` and whose columns are ``first`` and ``second``.

    The odds ratio is (a d) / (b c), infinite when b c is 0, and undefined with p = 1 when a margin
    is 0. p is the probability of all tables with these margins that are no likelier than this one.
    Every table's probability has a closed form, so tables are spread over tasks in blocks and added
    up, with no order between them. Tables further from the mean than ``reach`` have, by Bernstein's
    inequality, together less than exp(-745) of probability, which a double cannot hold.
    """
    def cell(name, value):
        picked = F.sum(F.when(F.col(row) == name, F.col(value)))
        return F.coalesce(picked, F.lit(0)).cast("double")

    a, b, c, d = (F.col(x) for x in "abcd")
    r1, c1, n = F.col("r1"), F.col("c1"), F.col("n")
    one = (
        table.agg(
            cell(rows[0], first).alias("a"),
            cell(rows[0], second).alias("b"),
            cell(rows[1], first).alias("c"),
            cell(rows[1], second).alias("d"),
        )
        .select(
            "*",
            (a + b).alias("r1"),
            (c + d).alias("r2"),
            (a + c).alias("c1"),
            (b + d).alias("c2"),
            (a + b + c + d).alias("n"),
        )
        .withColumn("proper", F.least("r1", "r2", "c1", "c2") > 0)
    )
    # An improper table keeps one block and one point, so that its row is not lost.
    mean = F.try_divide(r1 * c1, n)
    spread = mean * F.try_divide(n - c1, n)
    reach = 249 + F.sqrt(62000 + 1490 * spread)
    low = F.ceil(F.greatest(F.lit(0.0), r1 - F.col("c2"), mean - reach))
    high = F.floor(F.least(r1, c1, mean + reach))
    proper = F.col("proper")
    blocks = one.withColumn("fixed", F.when(proper, _fixed())).select(
        "*",
        F.when(proper, _log_mass("a")).alias("observed"),
        F.when(proper, low).otherwise(0).alias("low"),
        F.when(proper, high).otherwise(0).alias("high"),
    ).withColumn("block", F.explode(F.sequence("low", "high", F.lit(_BLOCK).cast("bigint"))))
    last = F.least(F.col("block") + (_BLOCK - 1), F.col("high"))
    points = blocks.repartition(_TASKS, "block").withColumn("k", F.explode(F.sequence("block", last)))
    log_p = F.when(proper, _log_mass("double(k)"))
    counted = F.sum(F.when(log_p <= F.col("observed") + 1e-7, F.exp(log_p)))
    p_value = F.when(F.first("proper"), F.least(F.coalesce(counted, F.lit(0.0)), F.lit(1.0)))
    result = points.agg(
        *(F.first(x).alias(x) for x in ("a", "b", "c", "d", "proper")),
        F.coalesce(p_value, F.lit(1.0)).alias("p_value"),
    )
    odds = (
        F.when(~proper, float("nan"))
        .when(b * c > 0, F.try_divide(a * d, b * c))
        .otherwise(float("inf"))
    )
    p = F.col("p_value")
    return result.select(
        odds.alias("odds_ratio"), "p_value", (p < alpha).alias("reject"), verdict(p, alpha).alias("verdict")
    )

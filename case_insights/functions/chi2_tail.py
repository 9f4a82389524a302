"""Upper tail of the chi-square distribution. Spark SQL has no gamma function, so this is the one
small Python helper; it runs on result rows only, never on data rows."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors get this module's code with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if a < 16:
        scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    else:
        # The same by Stirling's series, without the cancellation of large logarithms.
        off = (x - a) / a
        r = 1 / (a * a)
        rest = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / a
        scale = math.sqrt(a / (2 * math.pi)) * math.exp(-a * (off - math.log1p(off)) - rest)
    if x < a + 1:
        # Power series of the lower function P = scale * sum x^n / (a (a+1) ... (a+n)).
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    # Continued fraction of Q, evaluated forwards; b grows by 2 a step, so it always converges.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    i = 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            return min(1.0, scale * value)


@F.pandas_udf(DoubleType())
def _tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if math.isnan(s) else 1.0 if k == 0 else upper_gamma(k / 2, s / 2)
            for s, k in zip(statistic, dof)
        ],
        dtype="float64",
    )


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for a chi-square variable; 1 when there are no degrees of freedom."""
    return _tail(statistic, dof)

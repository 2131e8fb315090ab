"""Guarded numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """TRUE only for a present, non-NaN, non-infinite value."""
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def to_number(c) -> Column:
    """Text to a finite double, anything else to NULL."""
    value = _col(c).try_cast("double")
    return F.when(finite(value), value)


def clip(c, low=None, high=None) -> Column:
    c = _col(c)
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def pearson(x, y) -> Column:
    """Aggregate Pearson correlation; NULL for fewer than two rows or a constant side."""
    x, y = _col(x), _col(y)
    ok = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def sign3(c) -> Column:
    """-1, 0, 1; NULL stays NULL."""
    return F.signum(_col(c)).cast("int")


def sign2(c) -> Column:
    """Two-valued sign: zero counts as positive."""
    return F.when(_col(c) >= 0, F.lit(1)).otherwise(F.lit(-1))


def log_sigmoid(c) -> Column:
    """log(1 / (1 + exp(-x))) without overflow on either side."""
    c = _col(c)
    return F.least(c, F.lit(0.0)) - F.log1p(F.exp(-F.abs(c)))


def linspace(start: float, stop: float, points: int) -> list[float]:
    step = (stop - start) / (points - 1)
    return [start + step * k for k in range(points)]

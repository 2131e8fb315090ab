"""Dense vector columns (``ARRAY<DOUBLE>`` / ``ARRAY<FLOAT>``); arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MAX_OBJECTS = 4096


def few(items: Column, what: str = "objects", most: int = MAX_OBJECTS) -> Column:
    """A collected array, or an error when it has more than ``most`` entries.

    For lists of datasets, tasks or experiment keys, which are joined to every row.
    """
    too_many = F.raise_error(F.lit(f"more than {most} {what}: they cannot be held in one row"))
    return F.when(F.size(items) <= most, items).otherwise(too_many)


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def square_norm(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(square_norm(v))


def axpy(scale, x, y) -> Column:
    """scale * x + y"""
    return F.zip_with(x, y, lambda a, b: scale * a + b)


def cosine(a, b) -> Column:
    """Cosine clipped to [-1, 1]; NULL when either norm is zero."""
    raw = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def mean_pool(vectors, mask) -> Column:
    """Masked mean of an array of vectors: sum of the kept vectors over the number kept."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda s: s["m"] == 1)
    width = F.size(F.element_at(vectors, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(kept, zero, lambda acc, s: F.zip_with(acc, s["v"], lambda a, b: a + b))
    return F.transform(summed, lambda x: x / F.greatest(F.size(kept), F.lit(1)))

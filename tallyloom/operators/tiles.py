"""All pairs of dataset-level objects, tile by tile.

Objects are cut by hash into parts of about 512; two parts meet in one task, which multiplies them, and every unordered
pair is formed once. What a task holds does not grow with the number of objects, and there is no limit on it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 512
OWN, LOW, HIGH = "__part", "__low", "__high"


def _in_parts(objects: DataFrame, keys: Sequence[str], part: int) -> DataFrame:
    """Objects with the part of their keys and ``__last``, the number of the last part."""
    n = F.ceil(F.approx_count_distinct(F.struct(*keys)) / part)
    parts = objects.agg((F.greatest(n, F.lit(1)) - 1).cast("int").alias("__last"))
    rows = objects.withColumn("__k", F.lit(1)).join(F.broadcast(parts.withColumn("__k", F.lit(1))), "__k").drop("__k")
    return rows.withColumn(OWN, F.pmod(F.xxhash64(*keys), F.col("__last") + 1).cast("int"))


def name_pairs(objects: DataFrame, obj: str, part: int = PART) -> DataFrame:
    """(a, b), a <= b, of the distinct objects; NULL is none."""
    rows = _in_parts(objects.select(obj).where(F.col(obj).isNotNull()).distinct(), [obj], part)
    left = rows.select(F.col(obj).alias("x"), F.col(OWN).alias(LOW), F.explode(F.sequence(OWN, "__last")).alias(HIGH))
    right = rows.select(F.col(obj).alias("y"), F.col(OWN).alias(HIGH), F.explode(F.sequence(F.lit(0), OWN)).alias(LOW))
    pairs = left.join(right, [LOW, HIGH]).where(f"{LOW} < {HIGH} OR x <= y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _parts_of(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Matrix and places of the vectors of each length; NULL vectors have none, a NULL component is NaN."""
    whole = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(whole), -1).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == size)
        values = whole.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[size] = values.astype(np.float64).reshape(len(at), size), at
    return out


def vector_pairs(objects: DataFrame, group: Sequence[str], obj: str, vector: str, part: int = PART) -> DataFrame:
    """(group, a, b, same_size, norm_a, norm_b, dot) with a <= b for all pairs of objects of a group, each with itself too.

    ``dot`` is NULL for vectors of different lengths, and norms and ``dot`` are where a vector is. An object that
    occurs twice in a group is two objects.
    """
    cast = objects.select(*group, F.col(obj).alias("__obj"), F.col(vector).cast("array<double>").alias("__v"))
    rows = _in_parts(cast, [*group, "__obj"], part)
    met = F.transform(
        F.sequence(F.lit(0), "__last"), lambda q: F.struct(F.least(q, F.col(OWN)).alias(LOW), F.greatest(q, F.col(OWN)).alias(HIGH))
    )
    rows = rows.select(*group, "__obj", "__v", OWN, F.explode(met).alias("t")).select(*group, "__obj", "__v", OWN, "t.*")
    schema = T.StructType(
        [
            *[rows.schema[c] for c in group],
            T.StructField("x", rows.schema["__obj"].dataType),
            T.StructField("y", rows.schema["__obj"].dataType),
            T.StructField("same_size", T.BooleanType()),
            *[T.StructField(c, T.DoubleType()) for c in ("norm_x", "norm_y", "dot")],
        ]
    )

    def product(tile: pa.Table) -> pa.Table:
        low, high = tile[LOW][0].as_py(), tile[HIGH][0].as_py()
        left = tile.filter(pc.equal(tile[OWN], low))
        right = left if low == high else tile.filter(pc.equal(tile[OWN], high))
        n, m = left.num_rows, right.num_rows
        dots, same = np.full((n, m), np.nan), np.zeros((n, m), bool)
        norms = [np.full(n, np.nan), np.full(m, np.nan)]
        sides = [_parts_of(left["__v"]), _parts_of(right["__v"])]
        for own, norm in zip(sides, norms):
            for matrix, at in own.values():
                norm[at] = np.sqrt((matrix * matrix).sum(1))
        for size in sides[0].keys() & sides[1].keys():
            (u, i), (v, j) = sides[0][size], sides[1][size]
            dots[np.ix_(i, j)], same[np.ix_(i, j)] = u @ v.T, True
        i, j = (k.ravel() for k in np.indices((n, m)))
        if low == high:
            i, j = i[i <= j], j[i <= j]
        known = lambda x: pa.array(x, from_pandas=True)
        head = [tile[c].combine_chunks().take(pa.array(np.zeros(len(i), np.int64))) for c in group]
        names = [s["__obj"].combine_chunks().take(pa.array(k)) for s, k in ((left, i), (right, j))]
        return pa.Table.from_arrays(
            [*head, *names, pa.array(same[i, j]), known(norms[0][i]), known(norms[1][j]), known(dots[i, j])], names=schema.names
        )

    pairs = rows.groupBy(*group, LOW, HIGH).applyInArrow(product, schema)
    turned = F.col("x") > F.col("y")
    first = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        *group,
        first("x", "y").alias("a"),
        first("y", "x").alias("b"),
        "same_size",
        first("norm_x", "norm_y").alias("norm_a"),
        first("norm_y", "norm_x").alias("norm_b"),
        "dot",
    )

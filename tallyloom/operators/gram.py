"""Gram matrices as partial + final aggregates over partitions of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: width of the column blocks of a product, and bytes of partial sums a task holds before it sends them
BLOCK, BUDGET = 2048, 256 << 20


def dense(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch as rows of a matrix, and which rows of the batch they are; NULL vectors are left out.

    Vectors of different lengths are an error, a NULL component is NaN.
    """
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    kept = vectors.take(pa.array(at))
    lengths = pc.list_value_length(kept).to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError(f"vectors of {lengths.min()} and {lengths.max()} components cannot be summed")
    width = int(lengths[0]) if len(lengths) else 0
    return kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width), at


def gram_sums(df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """Sum of w * x x' per key as rows ``(keys, i, j, v)`` with i <= j.

    Each task folds its own rows into one triangle per key and emits that, so the shuffle carries
    D(D+1)/2 rows per task and key, never the vectors. Triangles are held in column blocks and sent whenever they
    reach a memory budget: partial sums add up however often they are sent. NULL vectors count nothing, vectors of
    different lengths are an error. One weighted vector sum, linear in D, is
    :func:`tallyloom.operators.influence.vector_sums`.
    """
    keys = list(keys)
    columns = [*keys, vector] + ([weight] if weight else [])
    source = df.select(*columns)
    key_fields = [source.schema[k] for k in keys]
    out_schema = T.StructType(
        key_fields
        + [
            T.StructField("i", T.IntegerType()),
            T.StructField("j", T.IntegerType()),
            T.StructField("v", T.DoubleType()),
        ]
    )

    def sent(sums: dict[tuple, np.ndarray], key_types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for (name, left, right), part in sums.items():
            i, j = np.triu_indices(len(part)) if left == right else np.indices(part.shape).reshape(2, -1)
            arrays = [pa.array([value] * len(i), type=t) for value, t in zip(name, key_types)]
            arrays += [pa.array((i + left).astype(np.int32)), pa.array((j + right).astype(np.int32)), pa.array(part[i, j])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "i", "j", "v"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        key_types, held = [], 0
        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            x, at = dense(batch.column(vector))
            w = batch.column(weight).to_numpy(zero_copy_only=False)[at] if weight else None
            names = list(zip(*[batch.column(k).take(pa.array(at)).to_pylist() for k in keys])) if keys else [()] * len(at)
            code: dict[tuple, int] = {}
            which = np.fromiter((code.setdefault(n, len(code)) for n in names), dtype=np.int64, count=len(names))
            for name, c in code.items():
                rows = x if len(code) == 1 else x[which == c]
                weighted = rows if w is None else rows * (w if len(code) == 1 else w[which == c])[:, None]
                for left in range(0, x.shape[1], BLOCK):
                    for right in range(left, x.shape[1], BLOCK):
                        part = rows[:, left : left + BLOCK].T @ weighted[:, right : right + BLOCK]
                        if (old := sums.get((name, left, right))) is None:
                            held += part.nbytes
                            sums[name, left, right] = part
                        else:
                            old += part
                if held > BUDGET:
                    yield from sent(sums, key_types)
                    sums, held = {}, 0
        yield from sent(sums, key_types)

    return source.mapInArrow(fold, out_schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def mirror(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full square from the i <= j triangle, without a second scan of its source."""
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    others = [c for c in cells.columns if c not in ("i", "j")]
    return cells.select(*others, F.explode(both).alias("__cell")).select(
        *keys, F.col("__cell.i").alias("i"), F.col("__cell.j").alias("j"), *[c for c in others if c not in keys]
    )

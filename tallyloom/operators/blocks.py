"""Symmetric matrices as tables of square blocks: products with vectors and solutions of linear systems.

A matrix is rows ``(keys, bi, bj, high, block)`` with bi <= bj, ``high`` rows of a block in row-major order; a vector
is rows ``(keys, bi, part)``. A task holds a few blocks of SIZE x SIZE at a time, whatever the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import cut_lineage

#: rows and columns of a block
SIZE = 256


def _schema(source: DataFrame, keys: Sequence[str], columns: str) -> T.StructType:
    return T.StructType([source.schema[k] for k in keys] + T.StructType.fromDDL(columns).fields)


def numbers(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def each_row(df: DataFrame, schema: T.StructType, name: str, result: Callable[[dict], np.ndarray]) -> DataFrame:
    """Rows with an array column ``name`` made by numpy from the row's other values, row after row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                made = pa.array([result(row)], pa.list_(pa.float64()))
                one = batch.slice(at, 1)
                arrays = [made if f.name == name else one.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def from_cells(cells: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys, bi, bj, high, block) of cells ``(keys, i, j, v)`` with i <= j; cells that are not there are zero."""
    keys = list(keys)
    schema = _schema(cells, keys, "bi int, bj int, high int, block array<double>")
    placed = cells.select(
        *keys,
        F.floor(F.col("i") / size).cast("int").alias("bi"),
        F.floor(F.col("j") / size).cast("int").alias("bj"),
        (F.col("i") % size).cast("int").alias("i"),
        (F.col("j") % size).cast("int").alias("j"),
        "v",
    )

    def dense(table: pa.Table) -> pa.Table:
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        diagonal = table["bi"][0].as_py() == table["bj"][0].as_py()
        wide = int(j.max()) + 1
        block = np.zeros((wide if diagonal else int(i.max()) + 1, wide))
        block[i, j] = v
        if diagonal:
            block[j, i] = v
        head = table.slice(0, 1)
        arrays = [head[c].combine_chunks() for c in [*keys, "bi", "bj"]]
        arrays += [pa.array([len(block)], pa.int32()), pa.array([block.ravel()], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(arrays, names=[f.name for f in schema.fields])

    return placed.groupBy(*keys, "bi", "bj").applyInArrow(dense, schema)


def cut(vectors: DataFrame, keys: Sequence[str], column: str, size: int = SIZE) -> DataFrame:
    """(keys, bi, part) of one array per key; an empty array is no part."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(column) / size).cast("int") - 1)
    pieces = F.when(F.size(column) > 0, F.transform(starts, lambda b: F.slice(column, b * size + 1, size)))
    return vectors.select(*keys, F.posexplode(pieces).alias("bi", "part"))


def joined(parts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One array per key of its parts, the inverse of :func:`cut`."""
    pairs = F.array_sort(F.collect_list(F.struct("bi", "part")))  # a vector of a key, as many parts as it has blocks
    return parts.groupBy(*keys).agg(F.flatten(F.transform(pairs, lambda p: p["part"])).alias(name))


def plus_diagonal(matrix: DataFrame, shift: Column) -> DataFrame:
    """``shift`` added on the diagonal."""
    on = F.col("bi") == F.col("bj")
    scaled = F.transform(
        "block",
        lambda x, at: x + F.when(on & (at % (F.col("high") + 1) == 0), shift).otherwise(0.0),
    )
    return matrix.withColumn("block", scaled)


def times(matrix: DataFrame, vector: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bi, part): the symmetric matrix times the vector; a block above the diagonal is used on both sides of it."""
    keys = list(keys)
    sides = F.when(F.col("bi") == F.col("bj"), F.array(F.struct("bi", "bj", F.lit(False).alias("flip")))).otherwise(
        F.array(
            F.struct("bi", "bj", F.lit(False).alias("flip")),
            F.struct(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.lit(True).alias("flip")),
        )
    )
    both = matrix.select(*keys, "high", "block", F.explode(sides).alias("s")).select(*keys, "high", "block", "s.*")
    met = both.join(vector.select(*keys, F.col("bi").alias("bj"), F.col("part").alias("x")), [*keys, "bj"])

    def product(row):
        block = numbers(row["block"]).reshape(row["high"].as_py(), -1)
        return (block.T if row["flip"].as_py() else block) @ numbers(row["x"])

    return summed(each_row(met, _schema(matrix, keys, "bi int, part array<double>"), "part", product), keys)


def summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of one place added up, number by number."""
    cells = parts.select(*keys, "bi", F.posexplode("part").alias("pos", "x"))
    cells = cells.groupBy(*keys, "bi", "pos").agg(F.sum("x").alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "x")))  # SIZE numbers
    return cells.groupBy(*keys, "bi").agg(F.transform(pairs, lambda p: p["x"]).alias("part"))


def solve(matrix: DataFrame, vector: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """(keys, bi, part): the solution of a positive definite system of at most ``count`` blocks a side.

    Block elimination from the first diagonal block on: step k divides block row k by its diagonal block and takes its
    products off the blocks below; the solution is put together from the last block row upwards. A step is two joins
    on (keys, place) and one table, so a key with one block needs no table at all; keys may have different numbers of
    blocks. A singular diagonal block gives NaN. Keys without a vector or a matrix are left out.
    """
    keys = list(keys)
    with_side = _schema(matrix, keys, "bj int, high int, block array<double>, quotient array<double>")
    whole = _schema(matrix, keys, "bi int, bj int, high int, block array<double>")

    def divide(row):
        block, pivot = numbers(row["block"]), numbers(row["pivot"])
        high = row["high"].as_py()
        try:
            return np.linalg.solve(pivot.reshape(high, high), block.reshape(high, -1)).ravel()
        except np.linalg.LinAlgError:
            return np.full(len(block), np.nan)

    def update(row):
        high = row["__high"].as_py()
        left, right = numbers(row["__left"]).reshape(high, -1), numbers(row["__right"]).reshape(high, -1)
        return numbers(row["block"]) - (left.T @ right).ravel()

    right_side = vector.select(*keys, "bi", F.lit(count).alias("bj"), F.size("part").alias("high"), F.col("part").alias("block"))
    state = matrix.select(*keys, "bi", "bj", "high", "block").unionByName(right_side)
    panels = []
    for k in range(count):
        pivot = state.where(f"bi = {k} AND bj = {k}").select(*keys, F.col("block").alias("pivot"))
        panel = each_row(state.where(f"bi = {k} AND bj > {k}").join(pivot, keys), with_side, "quotient", divide)
        panel = panel if count == 1 else cut_lineage(panel)
        panels.append(panel)
        if k + 1 < count:
            left = panel.select(*keys, F.col("bj").alias("bi"), F.col("high").alias("__high"), F.col("block").alias("__left"))
            right = panel.select(*keys, "bj", F.col("quotient").alias("__right"))
            rest = state.where(f"bi > {k}").join(left, [*keys, "bi"]).join(right, [*keys, "bj"])
            state = cut_lineage(each_row(rest, whole, "block", update))

    def known(row):
        block = numbers(row["quotient"]).reshape(row["high"].as_py(), -1)
        return block @ numbers(row["x"])

    out = panels[-1].where(f"bj = {count}").select(*keys, F.lit(count - 1).alias("bi"), F.col("quotient").alias("part"))
    for k in reversed(range(count - 1)):
        own = panels[k].where(f"bj = {count}").select(*keys, F.lit(k).alias("bi"), F.col("quotient").alias("own"))
        met = panels[k].where(f"bj < {count}").join(out.select(*keys, F.col("bi").alias("bj"), F.col("part").alias("x")), [*keys, "bj"])
        met = met.withColumn("bi", F.lit(k))
        minus = summed(each_row(met, _schema(matrix, keys, "bi int, part array<double>"), "part", known), keys)
        rest = own.join(minus, [*keys, "bi"], "left")
        part = F.when(F.col("part").isNull(), F.col("own")).otherwise(F.zip_with("own", "part", lambda a, b: a - b))
        out = cut_lineage(out.unionByName(rest.select(*keys, "bi", part.alias("part"))))
    return out


def block_count(vectors: DataFrame, column: str, width: int | None, size: int = SIZE) -> int:
    """Blocks a side for vectors of ``width`` components; without a width the widest vector is looked up by a job."""
    if width is None:
        width = vectors.agg(F.max(F.size(column))).first()[0] or 1
    return max(1, -(-width // size))

"""Exponential smoothing of series of any length, spread over tasks.

A row maps the state s to w s + (1 - w) x, so a run of rows maps it to a s + b. The maps of blocks of rows are sums,
combined before the shuffle; composing them gives the state in which every block starts, and then all blocks
are smoothed at once. No part of the history is left out, whatever the weight.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

BLOCK, UPPER = "__block", "__upper"
ROWS = 4096  # rows of a block, and blocks of an upper block
STRIDE = 256


def smoothed_from(last: float, values: np.ndarray, weight: float) -> np.ndarray:
    """The states after every value, starting from ``last``; part by part as one product with a triangle."""
    powers = weight ** np.arange(STRIDE + 1)
    steps = np.subtract.outer(np.arange(STRIDE), np.arange(STRIDE))
    triangle = (1.0 - weight) * np.where(steps >= 0, powers[np.maximum(steps, 0)], 0.0)
    out = np.empty(len(values))
    for k in range(0, len(values), STRIDE):
        part = values[k : k + STRIDE]
        n = len(part)
        out[k : k + n] = triangle[:n, :n] @ part + powers[1 : n + 1] * last
        last = out[k + n - 1]
    return out


def _composed(maps: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """The maps (a, b) of a group in order, each replaced by its composition with all before it."""
    schema = StructType([*[maps.schema[c] for c in [*groups, order]], StructField("a", DoubleType()), StructField("b", DoubleType())])

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        a, b, out = 1.0, 0.0, []
        for x, y in zip(rows["a"], rows["b"]):
            a, b = a * x, b * x + y
            out.append((a, b))
        return rows.assign(a=[p for p, _ in out], b=[q for _, q in out])

    return maps.select(*groups, order, "a", "b").groupBy(*groups).applyInPandas(compose, schema)


def block_starts(maps: DataFrame, series: Sequence[str], start: str) -> DataFrame:
    """(series, block, start): the state in which each block begins.

    ``maps`` has (series, block, a, b) with blocks numbered from 0 in every series and in ``start`` the state before
    the first one. Blocks are composed inside upper blocks of 4096, and these per series: one row for each 16 million
    rows of a series.
    """
    first = F.col(BLOCK) == 0  # knows its start, so its map is a constant
    known = maps.withColumn("b", F.when(first, F.col("a") * F.col(start) + F.col("b")).otherwise(F.col("b")))
    known = known.withColumn("a", F.when(first, 0.0).otherwise(F.col("a")))
    known = known.withColumn(UPPER, F.floor(F.col(BLOCK) / ROWS))
    inner = _composed(known, [*series, UPPER], BLOCK)
    whole = inner.groupBy(*series, UPPER).agg(F.max_by(F.struct("a", "b"), BLOCK).alias("m")).select(*series, UPPER, "m.*")
    upper = _composed(whole, series, UPPER).select(
        *[F.col(c).alias(f"__u{k}") for k, c in enumerate(series)], (F.col(UPPER) + 1).alias("__next"), F.col("b").alias("__state")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__u{k}")) for k, c in enumerate(series)]
    ends = inner.join(upper, [*same, F.col(UPPER) == F.col("__next")], "left")
    state = F.col("b") + F.col("a") * F.coalesce("__state", F.lit(0.0))
    following = ends.select(*series, (F.col(BLOCK) + 1).alias(BLOCK), state.alias(start))
    return maps.where(first).select(*series, F.col(BLOCK).cast(LongType()).alias(BLOCK), start).unionByName(following)


def smoothed(placed: DataFrame, series: Sequence[str], pos: str, value: str, weight: str, total: str, name: str) -> DataFrame:
    """(series, pos, value, name): s = w s_prev + (1 - w) x, starting from the first value.

    ``pos`` numbers the rows of a series from 0, ``total`` is their number and ``weight`` is constant in a series.
    """
    rows = placed.select(*series, pos, F.col(value).cast("double").alias(value), weight, total)
    rows = rows.withColumn(BLOCK, F.floor(F.col(pos) / ROWS))
    after = F.least(F.lit(ROWS), F.col(total) - F.col(BLOCK) * ROWS) - 1 - F.col(pos) % ROWS
    maps = rows.groupBy(*series, BLOCK).agg(
        F.pow(F.max(weight), F.count(F.lit(1))).alias("a"),
        F.sum((1 - F.col(weight)) * F.pow(F.col(weight), after) * F.col(value)).alias("b"),
        F.max(F.when(F.col(pos) == 0, F.col(value))).alias("__start"),
    )
    starts = block_starts(maps, series, "__start")
    renamed = starts.select(*[F.col(c).alias(f"__s{k}") for k, c in enumerate(series)], F.col(BLOCK).alias("__sb"), "__start")
    same = [F.col(c).eqNullSafe(F.col(f"__s{k}")) for k, c in enumerate(series)]
    begun = rows.join(renamed, [*same, F.col(BLOCK) == F.col("__sb")]).select(*series, BLOCK, pos, value, weight, "__start")
    schema = StructType([*[begun.schema[c] for c in [*series, pos, value]], StructField(name, DoubleType())])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos)
        states = smoothed_from(float(part["__start"].iloc[0]), part[value].to_numpy(float), float(part[weight].iloc[0]))
        return part[[*series, pos, value]].assign(**{name: states})

    return begun.groupBy(*series, BLOCK).applyInPandas(fold, schema)

"""Sinks: every writer is a distributed write; nothing is gathered to the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; an absent column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_rows(frames: Sequence[DataFrame], path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = union_of_columns(frames).write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_predictions(predictions: DataFrame, path: str, columns: Sequence[str] = ("label", "predict")) -> None:
    """JSON lines of (label, predict) or (chosen, rejected)."""
    predictions.select(*columns).write.mode("overwrite").json(path)


def write_statistics(stats: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Columnar copy laid out by experiment key, so readers prune folders.

    Rows are rebalanced by key first: adaptive execution splits a combination holding a large share of the rows
    among many tasks by its measured size and joins small ones.
    """
    stats.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def submission(instructions: DataFrame, predictions: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, instruction, output): record i with prediction i, the shorter side decides the length."""
    return instructions.select(ordinal, "instruction").join(
        predictions.select(ordinal, F.col("predict").alias("output")), ordinal
    )


def with_status(rows: DataFrame, checks: Sequence[tuple], ok: str = "ok") -> DataFrame:
    """Adds (status, reason): the first failing (condition, status, reason) decides, otherwise ``ok``."""
    status, reason = F.lit(ok), F.lit(None).cast("string")
    for condition, name, why in reversed(list(checks)):
        status = F.when(condition, F.lit(name)).otherwise(status)
        reason = F.when(condition, F.lit(why)).otherwise(reason)
    return rows.withColumn("status", status).withColumn("reason", reason)


def matrix_bundles(cells: DataFrame, size: int) -> DataFrame:
    """(tag, n, t, c): row-major T and C per tag, only square matrices of ``size`` objects.

    A bundle holds one dataset-level matrix, size x size numbers.
    """
    shapes = cells.groupBy("tag").agg(
        F.count_if(F.col("i") == F.col("j")).alias("n"), F.count(F.lit(1)).alias("filled")
    )
    kept = shapes.where((F.col("n") == size) & (F.col("filled") == size * size)).select("tag", "n")
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "t", "c")))
    return (
        cells.join(kept, "tag")
        .groupBy("tag", "n")
        .agg(ordered.alias("cells"))
        .select("tag", "n", F.col("cells.t").alias("t"), F.col("cells.c").alias("c"))
    )

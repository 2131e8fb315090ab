"""Running a stream over what is available and keeping its result as a table.

Results go to files in the shared folder, one set per micro-batch and named by it, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import scratch_path

BATCH = "batch"


def parquet_stream(spark: SparkSession, folder: str, file: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Rows of the files of a folder that have this name or pattern; a table of that name may be a folder of files.

    A stream reads a path without a pattern as a folder, so the name stands in braces, a pattern of one.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{{{file}}}")
    )


def json_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Records from JSON-line files as they arrive; malformed lines are dropped."""
    return (
        spark.readStream.schema(schema)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", prepare=None) -> None:
    """Processes everything available; ``prepare`` reshapes a micro-batch before it is written."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()


def appended(stream: DataFrame, name: str, prepare=None) -> DataFrame:
    """Rows an append-mode stream has produced."""
    spark = stream.sparkSession
    target, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    run_available(stream, target, checkpoint, "append", prepare)
    return spark.read.parquet(target)


def latest(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The current row per key of an update-mode stream: the one of the newest batch."""
    spark = stream.sparkSession
    target, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    run_available(stream, target, checkpoint, "update")
    rows = spark.read.parquet(target)
    others = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*others), F.col(BATCH)).alias("__row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__row.*")

"""Session helpers: a local session for tests and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyloom") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: paths handed out inside each open scope, the innermost last
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, below one folder for each application, which may go when that has ended.

    Inside a ``scratch_scope`` the path goes with the scope, unless it is to be kept.
    """
    path = f"{shared_folder(spark)}/tallyloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; one that was never written is no error."""
    if f"/tallyloom-{spark.sparkContext.applicationId}/" not in path:
        raise ValueError(f"not a scratch table of this application: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables written inside on leaving: for work whose result is written before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back when it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, keep: bool = False, codec: str = "") -> DataFrame:
    """The rows written once as a table in the shared folder and read from there.

    Used where one result is read twice and both readers must see the same rows (slices of a
    range partitioning) and between the rounds of an iteration. A lost executor costs no more than
    reading a file again, and readers take only the columns they need. Inside a ``scratch_scope`` the table goes with
    the scope, unless it is to be kept.
    """
    path = scratch_path(df.sparkSession, "table", keep)
    df.write.parquet(path, compression=codec or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_small(df: DataFrame) -> DataFrame:
    """A side of a few rows, written once, so that the join with it is planned knowing its size.

    For facts of a column of few values (layers, combinations, datasets): the large side would otherwise be shuffled
    by that column before the small side is known to be small. Beyond the broadcast threshold Spark plans the
    shuffle as ever.
    """
    return cut_lineage(df)

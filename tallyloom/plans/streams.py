"""Structured Streaming queries over files of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.fixtures import sql_hash, table, tokens, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.registry import query
from tallyloom.session import scratch_path
from tallyloom.streaming import runs
from tallyloom.streaming import statistics as ST


def table_stream(spark, sf_dir, name, files_per_batch=1):
    return runs.parquet_stream(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema, files_per_batch)


ALL_FILES = 2**31 - 1
LATE_FILES = 8


def event_files(spark, sf_dir, late: bool = False) -> str:
    """Events as JSON-line log files: in time order and as many as their size asks for, or dealt out by hash."""
    path = scratch_path(spark, "log")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.log(1 + F.col("value")).alias("loss"), "user_id"
    )
    ranged = rows.repartition(LATE_FILES, "step") if late else rows.repartitionByRange("step").sortWithinPartitions("step")
    ranged.write.json(path)
    return path


LOG_SCHEMA = "run string, step bigint, loss double, user_id bigint"


@query("streamed_records", "STR1", "SELECT event_type AS run, event_id AS step, user_id, round(ln(1 + value), 9) AS loss FROM events")
def streamed_records(spark, sf_dir):
    stream = runs.json_stream(spark, event_files(spark, sf_dir), LOG_SCHEMA)
    return rounded(runs.appended(stream, "records").drop(runs.BATCH), "loss", digits=9)


@query(
    "resumable_collection",
    "STR2",
    with_ctes(
        "smp", "SELECT combo, sample_idx, ti, round(li, 8) AS li, round(li / ti, 8) AS lbar FROM smp WHERE combo <> 'N_O'"
    ),
)
def resumable_collection(spark, sf_dir):
    """Two runs over the same checkpoint: the second starts where the first ended and adds nothing."""
    source, target, state = (scratch_path(spark, n) for n in ("tokens", "collected", "collected-state"))
    rows = tokens(spark, sf_dir).select("combo", "sample_idx", "u")
    rows.repartition("sample_idx").write.parquet(source)
    finished = rows.select("combo").distinct().where("combo = 'N_O'")
    for _ in range(2):
        stream = runs.parquet_stream(spark, source, "*.parquet", rows.schema)
        ST.collect_resumably(stream, target, state, ["combo"], "sample_idx", "u", finished)
    out = ST.collected_samples(spark.read.parquet(target), ["combo"], "sample_idx")
    return rounded(out, "li", "lbar", digits=8)


@query(
    "streamed_moments",
    "STR3",
    "SELECT event_type, count(*) AS n, round(avg(ln(1 + value)), 8) AS mean, round(var_pop(ln(1 + value)), 8) AS variance FROM events GROUP BY event_type",
)
def streamed_moments(spark, sf_dir):
    stream = table_stream(spark, sf_dir, "events").select("event_type", F.log(1 + F.col("value")).alias("x"))
    out = runs.latest(ST.running_moments(stream, ["event_type"], "x"), ["event_type"], "moments")
    return rounded(out, "mean", "variance", digits=8)


WEIGHT = 0.9


@query(
    "streamed_training_log",
    "STR4 WIN6",
    f"""WITH s AS (SELECT event_type AS run, event_id AS step, ln(1 + value) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p FROM events)
SELECT a.run, any_value(a.step) AS step, round(any_value(a.step) / 1e4 * 100, 2) AS progress, round(sum((1 - {WEIGHT}) * pow({WEIGHT}, a.p - b.p) * b.x) + max(CASE WHEN b.p = 0 THEN b.x * pow({WEIGHT}, a.p + 1) END), 7) AS smoothed
FROM s a JOIN s b ON a.run = b.run AND b.p <= a.p GROUP BY a.run, a.p""",
)
def streamed_training_log(spark, sf_dir):
    """Four micro-batches of lines in no order: nearly every line but those of the first batch is late."""
    stream = runs.json_stream(spark, event_files(spark, sf_dir, late=True), LOG_SCHEMA, files_per_batch=LATE_FILES // 4)
    parts = runs.latest(ST.log_blocks(stream, WEIGHT), ["run", "part"], "training-log")
    out = ST.smoothed_blocks(parts, WEIGHT, 10_000)
    return rounded(out.select("run", "step", "progress", "smoothed"), "smoothed", digits=7)


@query(
    "shuffled_stream",
    "STR5",
    f"""SELECT event_id, user_id, row_number() OVER (ORDER BY {sql_hash("event_id::VARCHAR", "buffer")}, event_id) - 1 AS place FROM events""",
)
def shuffled_stream(spark, sf_dir):
    # the buffer is the whole table, however many files it has
    stream = table_stream(spark, sf_dir, "events", ALL_FILES).select("event_id", "user_id")
    return runs.appended(stream, "shuffled", ST.shuffled_batch(["event_id"])).drop(runs.BATCH)


@query(
    "streamed_vector_moments",
    "STR6",
    with_ctes(
        "lay0",
        "SELECT label, pos, count(*) AS n, round(sum(x), 7) AS total, round(sum(x * x), 7) AS square_total FROM lay0 GROUP BY label, pos",
    ),
)
def streamed_vector_moments(spark, sf_dir):
    stream = table_stream(spark, sf_dir, "embeddings").select("label", "embedding")
    out = runs.latest(ST.vector_moments(stream, ["label"], "embedding"), ["label", "pos"], "vector-moments")
    return rounded(out, "total", "square_total", digits=7)

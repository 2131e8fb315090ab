"""Incremental statistics: running moments, vector moments, resumable collection, smoothed training logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions import sampling
from tallyloom.operators import ordering as O
from tallyloom.operators.lossstats import sample_rollup
from tallyloom.operators.smoothing import BLOCK, block_starts, smoothed_from
from tallyloom.streaming import runs


def running_moments(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, variance), updated with every batch; the merge is the usual pairwise one."""
    return stream.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")
    )


def vector_moments(stream: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, pos, n, total, square_total): sums a mean vector and a trace covariance follow from."""
    return (
        stream.select(*keys, F.posexplode(vector).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("x").cast("double")).alias("total"),
            F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("square_total"),
        )
    )


def collect_resumably(
    stream: DataFrame, target: str, checkpoint: str, combo: Sequence[str], sample: str, loss: str, finished: DataFrame | None = None
) -> None:
    """Per-batch sample statistics of token losses, resumable from the checkpoint.

    A batch is written under its own number, so running it again replaces it; combinations in
    ``finished`` are left out. Partial sums of a sample that spans batches are joined by
    :func:`collected_samples`.
    """

    def partial(batch: DataFrame) -> DataFrame:
        rows = batch if finished is None else batch.join(finished, list(combo), "left_anti")
        return sample_rollup(rows, [*combo, sample], loss).drop("lbar")

    runs.run_available(stream, target, checkpoint, "append", partial)


def collected_samples(parts: DataFrame, combo: Sequence[str], sample: str) -> DataFrame:
    """(combo, sample, ti, li, lbar) from the partial sums of all batches."""
    return parts.groupBy(*combo, sample).agg(
        F.sum("ti").cast("bigint").alias("ti"), F.sum("li").alias("li"), (F.sum("li") / F.sum("ti")).alias("lbar")
    )


def shuffled_batch(ids: Sequence[str], seed: str = "buffer"):
    """Puts a micro-batch in seeded hash order: the batch is the shuffle buffer, ``place`` the position in it."""

    def reorder(batch: DataFrame) -> DataFrame:
        hashed = batch.withColumn("__h", sampling.hash_int(*ids, seed=seed))
        return O.positions(hashed, [], ["__h", *ids], "place").orderBy("place").drop("__h")

    return reorder


LOG_OUTPUT = "run string, step bigint, loss double, smoothed double, progress double"
LOG_STATE = "smoothed double, count bigint"


def smoothed_log(stream: DataFrame, weight: float, total_steps: int) -> DataFrame:
    """(run, step, loss, smoothed, progress) of a stream of (run, step, loss); lines without a loss are skipped.

    State per run is the last smoothed value and the number of lines. The batch form takes the weight from
    the final length of the series, which a stream does not know, so it is a parameter here. Files have to
    arrive in step order; inside a micro-batch, which is a few files, lines are sorted.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(parts)).sort_values("step")
        last, count = state.get if state.exists else (float(batch["loss"].iloc[0]), 0)
        smoothed = smoothed_from(last, batch["loss"].to_numpy(float), weight)
        state.update((float(smoothed[-1]), int(count + len(batch))))
        progress = (batch["step"] / total_steps * 100).round(2) if total_steps else 100.0
        yield pd.DataFrame(
            {"run": key[0], "step": batch["step"], "loss": batch["loss"], "smoothed": smoothed, "progress": progress}
        )

    lines = stream.where(F.col("loss").isNotNull() & (F.col("loss") != 0)).select("run", "step", "loss")
    return lines.groupBy("run").applyInPandasWithState(
        fold, LOG_OUTPUT, LOG_STATE, "append", GroupStateTimeout.NoTimeout
    )


LOG_STEPS = 1024
BLOCK_STATE = "step array<bigint>, loss array<double>"
BLOCK_OUTPUT = f"run string, part bigint, {BLOCK_STATE}, response array<double>"


def log_blocks(stream: DataFrame, weight: float) -> DataFrame:
    """(run, part, step, loss, response) of a stream of (run, step, loss) that may arrive in any order.

    A part is the lines of a run within 1024 steps. Its state is these lines, so a late line changes its own part
    alone, however late it is, and a run is spread over tasks. A part is put out again whenever lines reach it;
    ``response`` is its smoothing from 0. A step that is logged again counts once, with its larger loss; lines
    without a step or a loss are skipped.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        for lines in parts:
            for step, loss in zip(lines["step"].tolist(), lines["loss"].tolist()):
                known[step] = max(loss, known.get(step, loss))
        steps = sorted(known)
        losses = [known[s] for s in steps]
        state.update((steps, losses))
        response = smoothed_from(0.0, np.array(losses), weight).tolist()
        yield pd.DataFrame({"run": [key[0]], "part": [key[1]], "step": [steps], "loss": [losses], "response": [response]})

    lines = stream.where("step IS NOT NULL AND loss IS NOT NULL AND loss <> 0 AND NOT isnan(loss)")
    lines = lines.select("run", "step", "loss", F.floor(F.col("step") / LOG_STEPS).alias("part"))
    return lines.groupBy("run", "part").applyInPandasWithState(
        fold, BLOCK_OUTPUT, BLOCK_STATE, "update", GroupStateTimeout.NoTimeout
    )


def smoothed_blocks(parts: DataFrame, weight: float, total_steps: int) -> DataFrame:
    """(run, step, loss, smoothed, progress) from the current state of all parts of :func:`log_blocks`."""
    lines = F.size("step")
    maps = parts.select(
        "run",
        "part",
        F.pow(F.lit(float(weight)), lines).alias("a"),
        F.element_at("response", -1).alias("b"),
        F.get("loss", F.lit(0)).alias("__start"),
    )
    numbered = O.positions(maps, ["run"], ["part"], BLOCK)
    starts = block_starts(numbered, ["run"], "__start")
    starts = numbered.select("run", "part", BLOCK).join(starts, ["run", BLOCK]).select("run", "part", "__start")
    rows = parts.join(starts, ["run", "part"]).select(
        "run", "__start", F.posexplode(F.arrays_zip("step", "loss", "response")).alias("k", "z")
    )
    progress = F.round(F.col("z.step") / total_steps * 100, 2) if total_steps else F.lit(100.0)
    state = F.col("z.response") + F.pow(F.lit(float(weight)), F.col("k") + 1) * F.col("__start")
    return rows.select("run", "z.step", "z.loss", state.alias("smoothed"), progress.alias("progress"))

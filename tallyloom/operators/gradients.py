"""Gradient statistics and dataset-level score tables built on :mod:`tallyloom.operators.influence`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import influence as I
from tallyloom.operators import tiles


def gradient_moments(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, n, norm_mean, norm_var, mean_vector_norm, trace_cov, mean): one pass over the rows.

    Rows holding a NaN component are skipped. Variances are E x^2 - (E x)^2 floored at zero.
    """
    whole = df.where(~F.exists(vector, lambda x: F.isnan(x)))
    per_pos = (
        whole.select(*keys, V.norm(vector).alias("__norm"), F.posexplode(vector).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("x").alias("m"),
            F.avg(F.col("x") * F.col("x")).alias("q"),
            F.avg("__norm").alias("norm_mean"),
            F.avg(F.col("__norm") * F.col("__norm")).alias("norm_sq"),
        )
    )
    return per_pos.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("norm_mean").alias("norm_mean"),
        F.greatest(F.max("norm_sq") - F.max("norm_mean") * F.max("norm_mean"), F.lit(0.0)).alias("norm_var"),
        F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_vector_norm"),
        F.greatest(F.sum(F.col("q") - F.col("m") * F.col("m")), F.lit(0.0)).alias("trace_cov"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"),
    )


def merge_partial_gradients(parts: DataFrame, keys: Sequence[str], steps: str) -> DataFrame:
    """(keys, merged_norm, trace_cov, total_steps, mean) from partial means weighted by processed steps.

    A part without a step count weighs 1. The trace covariance is the weighted mean of the parts'.
    """
    weighted = parts.withColumn("w", F.when(F.col(steps) > 0, F.col(steps)).otherwise(F.lit(1)).cast("bigint"))
    mean = I.assemble(I.mean_vectors(weighted, keys, "mean", "w"), keys, "mean", "mean")
    scalar = weighted.groupBy(*keys).agg(
        (F.sum(F.col("trace_cov") * F.col("w")) / F.sum("w")).alias("trace_cov"), F.sum("w").alias("total_steps")
    )
    return mean.join(scalar, list(keys)).withColumn("merged_norm", V.norm("mean"))


def mirror_pairs(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) with a <= b to both orders."""
    same = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    both = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    others = [c for c in cells.columns if c not in (a, b)]
    return cells.select(
        *others, F.explode(F.when(F.col(a) == F.col(b), same).otherwise(both)).alias("__p")
    ).select(F.col("__p.x").alias(a), F.col("__p.y").alias(b), *others)


def every_group(objects: DataFrame, obj: str, vector: str, group: str) -> DataFrame:
    """The object list repeated for every dataset; datasets are the objects themselves."""
    packed = objects.agg(V.few(F.array_sort(F.collect_list(F.struct(F.col(obj), F.col(vector))))).alias("objs"))
    return (
        packed.select(F.explode(F.transform("objs", lambda o: o[obj])).alias(group), "objs")
        .select(group, F.explode("objs").alias("o"))
        .select(group, f"o.{obj}", f"o.{vector}")
    )


def cosine_jobs(objects: DataFrame, obj: str, vector: str) -> DataFrame:
    """(base, target, status, cosine) for every ordered pair of dataset-level vectors, clipped to [-1, 1]."""
    status = (
        F.when(~F.col("same_size"), "shape_mismatch")
        .when((F.col("norm_a") == 0) | (F.col("norm_b") == 0), "zero_norm")
        .otherwise("success")
    )
    raw = F.try_divide("dot", F.col("norm_a") * F.col("norm_b"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    pairs = tiles.vector_pairs(objects, [], obj, vector).withColumn("status", status)
    cells = pairs.select("a", "b", "status", F.when(F.col("status") == "success", cosine).alias("cosine"))
    return mirror_pairs(cells).select(F.col("a").alias("base"), F.col("b").alias("target"), "status", "cosine")


def quadratic_forms(rows: DataFrame, directions: DataFrame, keys: Sequence[str], vector: str, direction: str) -> DataFrame:
    """(keys, q, n): mean over rows of (direction . g)^2; rows without a gradient are skipped."""
    projected = rows.where(F.col(vector).isNotNull()).join(directions.select(*keys, direction), list(keys))
    p = V.dot(vector, direction)
    return projected.groupBy(*keys).agg(F.avg(p * p).alias("q"), F.count(F.lit(1)).alias("n"))


def trajectory(
    ends: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str], vector: str
) -> DataFrame:
    """Curvature and alignment along theta_end - theta_start, from gradients before and after training."""
    delta = ends.select(*keys, F.zip_with("theta_end", "theta_start", lambda e, s: e - s).alias("delta"))
    rows = before.select(*keys, F.lit(0).alias("__after"), vector).unionByName(
        after.select(*keys, F.lit(1).alias("__after"), vector)
    )
    p = V.dot(vector, "delta")
    late = F.col("__after") == 1
    # the mean gradient's projection is the mean of the projections, so one pass gives everything
    return (
        rows.join(delta, list(keys))
        .select(*keys, "__after", p.alias("p"), V.norm("delta").alias("delta_norm"))
        .groupBy(*keys)
        .agg(
            F.max("delta_norm").alias("delta_norm"),
            F.avg(F.when(late, F.col("p"))).alias("dot_after"),
            F.avg(F.when(~late, F.col("p"))).alias("dot_before"),
            (-F.avg(F.when(late, F.col("p")))).alias("v_align"),
            (0.5 * F.avg(F.when(~late, F.col("p") * F.col("p")))).alias("c_start"),
            (0.5 * F.avg(F.when(late, F.col("p") * F.col("p")))).alias("c_end"),
            F.count_if(late).alias("n"),
        )
    )


def rectangular_scores(scores: DataFrame, own_diagonal: DataFrame) -> DataFrame:
    """(train, test, t, c): score of train set A against test object B under H_A, and its correlation form.

    B's self score comes from its own oracle when ``own_diagonal`` (test, own) has it, otherwise from
    the self pair under H_A. The correlation is NULL when a self score is not positive.
    """
    cells = mirror_pairs(scores).where("a = ds").select(F.col("ds").alias("train"), F.col("b").alias("test"), "score")
    selfs = scores.where("a = b").select(F.col("ds").alias("train"), F.col("a").alias("test"), F.col("score").alias("s"))
    s_train = selfs.where("train = test").select("train", F.col("s").alias("s_train"))
    joined = (
        cells.join(selfs, ["train", "test"], "left")
        .join(s_train, "train", "left")
        .join(own_diagonal, "test", "left")
        .withColumn("s_test", F.coalesce("own", "s"))
    )
    ok = (F.col("s_train") > 0) & (F.col("s_test") > 0)
    return joined.select(
        "train",
        "test",
        F.col("score").alias("t"),
        F.when(ok, F.col("score") / F.sqrt(F.col("s_train") * F.col("s_test"))).alias("c"),
    )


def h_mode_scores(rows: DataFrame, objects: DataFrame, method: str, obj: str, damping: float) -> DataFrame:
    """(target, h_mode, a, b, n, score): which rows define the oracle is one more grouping key.

    own = rows of the target method, cross = rows of the other one, mixed = both.
    """
    other = F.when(F.col(method) == "sft", "sdft").otherwise("sft")

    def mode(target, name):
        return F.struct(target.alias("target"), F.lit(name).alias("h_mode"))

    modes = F.array(
        mode(F.col(method), "own"), mode(other, "cross"), mode(F.col(method), "mixed"), mode(other, "mixed")
    )
    expanded = rows.select("g", F.explode(modes).alias("m")).select("m.target", "m.h_mode", "g")
    names = F.explode(F.array(*[F.lit(n) for n in ("own", "cross", "mixed")])).alias("h_mode")
    per_mode = objects.select(F.col(method).alias("target"), names, obj, "a")
    counts = expanded.groupBy("target", "h_mode").agg(F.count(F.lit(1)).alias("n"))
    scores = I.pair_scores(expanded, per_mode, ["target", "h_mode"], obj, "a", damping, counted=counts)
    return scores.join(counts, ["target", "h_mode"]).select("target", "h_mode", "a", "b", "n", "score")


def object_pairs(objects: DataFrame, obj: str) -> DataFrame:
    """(a, b), a <= b, over dataset-level objects."""
    return tiles.name_pairs(objects, obj)


def pending_pairs(expected: DataFrame, scored: DataFrame) -> DataFrame:
    return expected.join(scored, ["a", "b"], "left_anti")


def completeness(expected: DataFrame, scored: DataFrame) -> DataFrame:
    """(total_pairs, available_pairs, pending_pairs) in one row."""
    marked = expected.join(scored.withColumn("__done", F.lit(1)), ["a", "b"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count("__done").alias("available_pairs"),
        F.count_if(F.col("__done").isNull()).alias("pending_pairs"),
    )

"""Influence values and dataset-pair scores from gradient tables.

Inputs are rows ``(sample id, layer, g ARRAY<DOUBLE>)``. The per-sample outer products of the textbook
formulas are never formed row by row: one weighted vector sum (linear in D) or one weighted Gram
partial (D x D per layer) carries everything the formulas need.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import vectors as V
from tallyloom.operators import blocks, tiles
from tallyloom.operators.gram import dense, gram_sums, mirror
from tallyloom.session import cut_lineage, known_small

DEFAULT_DAMPING_DIVISOR = 10.0  # fixed value: layer damping is mean squared gradient over this


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """(keys, pos, total, weight): component-wise weighted sums, folded map-side to keys x D rows."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return (
        df.select(*keys, w.alias("__w"), F.posexplode(vector).alias("pos", "x"))
        .groupBy(*keys, "pos")
        .agg(F.sum(F.col("x").cast("double") * F.col("__w")).alias("total"), F.sum("__w").alias("weight"))
    )


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """(keys, pos, mean): weighted mean vector in long form."""
    return vector_sums(df, keys, vector, weight).select(
        *keys, "pos", F.try_divide("total", "weight").alias("mean")
    )


def assemble(long: DataFrame, keys: Sequence[str], value: str, name: str, pos: str = "pos") -> DataFrame:
    """Long (keys, pos, value) back to one array per key; an array holds one vector, D values."""
    pairs = F.array_sort(F.collect_list(F.struct(pos, value)))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(name))


def layer_damping(train: DataFrame, layer: str = "layer", divisor: float = DEFAULT_DAMPING_DIVISOR) -> DataFrame:
    """(layer, lam, n): mean over samples of the mean squared component, over ``divisor``."""
    return train.groupBy(layer).agg(
        (F.avg(V.square_norm("g") / F.size("g")) / F.lit(divisor)).alias("lam"),
        F.count(F.lit(1)).alias("n"),
    )


def hvp_closed_form(train: DataFrame, target: DataFrame, damping: DataFrame) -> DataFrame:
    """(layer, hvp): sum_i (v - c_i g_i) / (n lam), c_i = v.g_i / (lam + |g_i|^2).

    ``target`` is (layer, v); the small side has one row per layer and is written first, so that the join with the
    training rows is planned by its size. One pass, one weighted vector sum.
    """
    per_layer = known_small(target.join(damping, "layer"))
    weighted = train.join(per_layer, "layer").withColumn(
        "c", V.dot("v", "g") / (F.col("lam") + V.square_norm("g"))
    )
    pulled = assemble(vector_sums(weighted, ["layer"], "g", "c"), ["layer"], "total", "pulled")
    return per_layer.join(pulled, "layer").select(
        "layer",
        F.zip_with("v", "pulled", lambda v, p: (F.col("n") * v - p) / (F.col("n") * F.col("lam"))).alias("hvp"),
    )


def second_moments(train: DataFrame, damping: DataFrame) -> DataFrame:
    """(layer, bi, bj, high, block, lam): (1/n) sum g g' per layer in blocks; no row holds more than one of them."""
    matrix = blocks.from_cells(gram_sums(train, ["layer"], "g"), ["layer"], blocks.SIZE).join(known_small(damping), "layer")
    return matrix.withColumn("block", F.transform("block", lambda x: x / F.col("n"))).drop("n")


def matrix_rows(triangle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, m): a D x D matrix per key as an array of rows."""
    rows = assemble(mirror(triangle, keys), [*keys, "i"], "v", "row", pos="j")
    return assemble(rows, keys, "row", "m", pos="i")


def hvp_lissa(
    train: DataFrame,
    target: DataFrame,
    damping: DataFrame,
    iterations: int = 10,
    alpha: float = 1.0,
    width: int | None = None,
) -> DataFrame:
    """(layer, hvp): r <- v + r - alpha (C r - lam r) with C = (1/n) sum g g', ``iterations`` times.

    C is built once, in blocks. Layers of one block (``width`` components, looked up where not given) are iterated
    where the block is; wider ones by a product of blocks and parts an iteration, whose small result is written.
    """
    moments = second_moments(train, damping)
    if blocks.block_count(target, "v", width, blocks.SIZE) == 1:

        def fold(row):
            r = v = blocks.numbers(row["v"])
            c = blocks.numbers(row["block"]).reshape(len(v), len(v))
            for _ in range(iterations):
                r = v + r - alpha * (c @ r - row["lam"].as_py() * r)
            return r

        schema = T.StructType([train.schema["layer"], T.StructField("hvp", T.ArrayType(T.DoubleType()))])
        return blocks.each_row(moments.join(target.select("layer", V.doubles("v").alias("v")), "layer"), schema, "hvp", fold)
    parts = blocks.cut(target.select("layer", V.doubles("v").alias("v")), ["layer"], "v", blocks.SIZE)
    v = cut_lineage(parts.join(damping.select("layer", "lam"), "layer").withColumnRenamed("part", "v"))
    matrix = cut_lineage(moments.drop("lam"))
    r = v.select("layer", "bi", F.col("v").alias("part"))
    for _ in range(iterations):
        met = r.join(blocks.times(matrix, r, ["layer"]).withColumnRenamed("part", "c"), ["layer", "bi"]).join(v, ["layer", "bi"])
        shifted = F.zip_with("c", "part", lambda c, x: x - F.lit(alpha) * (c - F.col("lam") * x))
        r = cut_lineage(met.select("layer", "bi", F.zip_with("v", shifted, lambda a, b: a + b).alias("part")))
    return blocks.joined(r, ["layer"], "hvp")


def hvp_exact(train: DataFrame, target: DataFrame, damping: DataFrame, width: int | None = None) -> DataFrame:
    """(layer, hvp): (lam I + (1/n) sum g g')^-1 v by block elimination; ``width`` as in :func:`hvp_lissa`."""
    count = blocks.block_count(target, "v", width, blocks.SIZE)
    moments = second_moments(train, damping)
    matrix = blocks.plus_diagonal(moments, F.col("lam")).drop("lam")
    parts = blocks.cut(target.select("layer", V.doubles("v").alias("v")), ["layer"], "v", blocks.SIZE)
    return blocks.joined(blocks.solve(matrix if count == 1 else cut_lineage(matrix), parts, ["layer"], count), ["layer"], "hvp")


def influence_values(train: DataFrame, hvp: DataFrame, sample: str = "vec_id") -> DataFrame:
    """(sample, influence): -sum over layers of hvp . g."""
    return (
        train.join(known_small(hvp), "layer")
        .groupBy(sample)
        .agg((-F.sum(V.dot("hvp", "g"))).alias("influence"))
    )


def hvp_many(train: DataFrame, targets: DataFrame, damping: DataFrame, target_id: str) -> DataFrame:
    """(target, layer, hvp) for many targets at once: (n v - M v) / (n lam), M = sum g g' / (lam + |g|^2).

    M is one weighted Gram per layer and does not depend on the target, so the training rows are read
    once however many targets there are.
    """
    damping = known_small(damping)
    weighted = train.join(damping, "layer").withColumn("w", 1 / (F.col("lam") + V.square_norm("g")))
    m = matrix_rows(gram_sums(weighted, ["layer"], "g", "w"), ["layer"])
    both = targets.join(damping.join(m, "layer"), "layer")
    product = F.transform("m", lambda row: V.dot(row, F.col("g")))
    return both.select(
        target_id,
        "layer",
        F.zip_with("g", product, lambda v, p: (F.col("n") * v - p) / (F.col("n") * F.col("lam"))).alias("hvp"),
    )


SLICE_ROWS, BLOCK_ROWS = 2048, 512


def influence_matrix(train: DataFrame, hvps: DataFrame, train_id: str, target_id: str) -> DataFrame:
    """(train, target, influence) for every training row and target, as a blocked matrix product.

    Targets are few: the mean gradients of validation classes or datasets, so the result is linear in training rows.

    Layers are laid end to end so no sum over layers is shuffled. Training rows are cut in slices of about
    2048 and targets in blocks of about 512; a slice and a block meet in one task, which multiplies them.
    What a task holds does not grow with either table.
    """

    def laid_out(rows, key, vector, name):
        layers = F.array_sort(F.collect_list(F.struct("layer", F.col(vector).alias("g"))))
        return rows.groupBy(key).agg(F.flatten(F.transform(layers, lambda s: s["g"])).alias(name))

    def parts(rows, key, size, name):
        """Number of parts that distinct keys are cut in, as one row."""
        n = F.ceil(F.approx_count_distinct(key) / size)
        return rows.agg(F.greatest(n, F.lit(1)).cast("int").alias(name)).withColumn("__k", F.lit(1))

    cut = parts(train, train_id, SLICE_ROWS, "slices").join(parts(hvps, target_id, BLOCK_ROWS, "blocks"), "__k")

    def placed(rows, key, own, part, other, others):
        """Every row in the part of its key, once for each part of the other side."""
        rows = rows.withColumn("__k", F.lit(1)).join(cut, "__k")
        rows = rows.withColumn(part, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("__k", "slices", "blocks")

    left = placed(laid_out(train, train_id, "g", "g"), train_id, "slices", "slice", "block", "blocks")
    right = placed(laid_out(hvps, target_id, "hvp", "h"), target_id, "blocks", "block", "slice", "slices")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = a.num_rows, b.num_rows
        if x and y:
            scores = -(dense(a["g"].combine_chunks())[0] @ dense(b["h"].combine_chunks())[0].T).ravel()
        else:
            scores = np.zeros(0)
        return pa.table(
            {
                train_id: a[train_id].combine_chunks().take(pa.array(np.repeat(np.arange(x), y))),
                target_id: b[target_id].combine_chunks().take(pa.array(np.tile(np.arange(y), x))),
                "influence": pa.array(scores),
            }
        )

    out = T.StructType(
        [train.schema[train_id], hvps.schema[target_id], T.StructField("influence", T.DoubleType())]
    )
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(product, out)


def objects_row(objects: DataFrame, group: Sequence[str], obj: str, vector: str) -> DataFrame:
    """(group, objs): all objects of a group in one sorted array; objects are datasets or tasks, a handful."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(obj).alias("obj"), F.col(vector).alias("a"))))
    return objects.groupBy(*group).agg(V.few(packed).alias("objs"))


def pair_scores(
    train: DataFrame,
    objects: DataFrame,
    group: Sequence[str],
    obj: str,
    vector: str,
    damping: float,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(group, a, b, score) with a <= b: one pass over ``train`` scores every pair of objects.

    Damped: (n A A' - P' W P) / (n lam), P = projections of g on the objects, W = 1 / (lam + |g|^2);
    without damping (0) the sum is divided by n only. ``n`` counts all records, also those without a
    gradient; ``counted`` is (group, n) when the caller knows them, NULL gradients are skipped otherwise.
    """
    rows = known_small(objects_row(objects, group, obj, vector))
    counts = counted if counted is not None else train.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    used = train.where(F.col("g").isNotNull())
    effective = used.groupBy(*group).agg(F.count(F.lit(1)).alias("n_eff"))
    projected = used.join(rows, list(group)).select(
        *group,
        F.transform("objs", lambda o: V.dot(o["a"], F.col("g"))).alias("p"),
        (1 / (F.lit(float(damping)) + V.square_norm("g"))).alias("w"),
    )
    pulled = gram_sums(projected, group, "p", "w")
    head = rows.join(counts, list(group)).join(effective, list(group))
    scale = F.col("n") * F.lit(float(damping)) if damping > 0 else F.col("n").cast("double")
    left, right = F.col("objs")[F.col("i")], F.col("objs")[F.col("j")]
    return pulled.join(head, list(group)).select(
        *group,
        left["obj"].alias("a"),
        right["obj"].alias("b"),
        ((F.col("n_eff") * V.dot(left["a"], right["a"]) - F.col("v")) / scale).alias("score"),
    )


def hessian_scores(train: DataFrame, objects: DataFrame, group: Sequence[str], obj: str, vector: str) -> DataFrame:
    """(group, a, b, score): (1/n) sum_i (a.g_i)(b.g_i), the undamped empirical-Hessian form."""
    rows = known_small(objects_row(objects, group, obj, vector))
    projected = train.join(rows, list(group)).select(
        *group, F.transform("objs", lambda o: V.dot(o["a"], F.col("g"))).alias("p")
    )
    counts = train.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return (
        gram_sums(projected, group, "p")
        .join(rows.join(counts, list(group)), list(group))
        .select(
            *group,
            F.col("objs")[F.col("i")]["obj"].alias("a"),
            F.col("objs")[F.col("j")]["obj"].alias("b"),
            (F.col("v") / F.col("n")).alias("score"),
        )
    )


def object_gram(objects: DataFrame, group: Sequence[str], obj: str, vector: str) -> DataFrame:
    """(group, a, b, dot, cos) with a <= b over dataset-level objects; a zero norm counts as 1."""

    def unit(n):
        return F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col(n))

    cells = tiles.vector_pairs(objects, group, obj, vector)
    return cells.select(*group, "a", "b", "dot", (F.col("dot") / (unit("norm_a") * unit("norm_b"))).alias("cos"))

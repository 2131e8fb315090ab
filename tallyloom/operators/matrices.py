"""Operators on matrices in long form: rows (keys..., i, j, v), NULL = missing cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import finite

#: widest dataset-level matrix that one task solves
MAX_DIMENSION = 4096


def with_diagonal(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the diagonal entries d_i and d_j; a window spans one row or column of one matrix."""
    on_diagonal = F.when(F.col("i") == F.col("j"), F.col("v"))
    return cells.withColumn("d_i", F.max(on_diagonal).over(Window.partitionBy(*keys, "i"))).withColumn(
        "d_j", F.max(on_diagonal).over(Window.partitionBy(*keys, "j"))
    )


def correlation(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds c = v / sqrt(d_i d_j), NULL where not finite, 1 on a non-zero diagonal."""
    product = F.col("d_i") * F.col("d_j")
    raw = F.when(product > 0, F.col("v") / F.sqrt(product))
    c = F.when((F.col("i") == F.col("j")) & finite("d_i") & (F.col("d_i") != 0), F.lit(1.0)).when(finite(raw), raw)
    return with_diagonal(cells, keys).withColumn("c", c).drop("d_i", "d_j")


def missing_as_zero(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", F.when(finite("v"), F.col("v")).otherwise(F.lit(0.0)))


def off_diagonal_summary(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean_offdiag, fro_offdiag, trace): missing cells leave the off-diagonal, count 0 in the trace."""
    off = (F.col("i") != F.col("j")) & finite("v")
    return cells.groupBy(*keys).agg(
        (F.max("i") - F.min("i") + 1).cast("bigint").alias("n"),
        F.avg(F.when(off, F.col("v"))).alias("mean_offdiag"),
        F.sqrt(F.sum(F.when(off, F.col("v") * F.col("v")))).alias("fro_offdiag"),
        F.sum(F.when((F.col("i") == F.col("j")) & finite("v"), F.col("v")).otherwise(0.0)).alias("trace"),
    )


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]))
    if len(names) > MAX_DIMENSION:
        raise ValueError(f"a spectrum is taken of dataset-level matrices, at most {MAX_DIMENSION} wide")
    m = np.zeros((len(names), len(names)))
    m[np.searchsorted(names, pdf["i"]), np.searchsorted(names, pdf["j"])] = pdf["v"].fillna(0.0)
    return names, m


def spectra(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k, eig_re, eig_im, symmetric, condition, vec) with eigenvalues in descending real part.

    One small matrix per key, many keys in parallel. Symmetric within 1e-8 uses the symmetric solver;
    an eigenvector's largest entry by absolute value is made positive.
    """
    keys = list(keys)
    fields = [cells.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", k int, eig_re double, eig_im double, symmetric boolean, condition double, vec array<double>"

    def solve(key, pdf):
        _, m = _dense(pdf)
        symmetric = bool(np.allclose(m, m.T, atol=1e-8, rtol=0.0))
        values, basis = np.linalg.eigh(m) if symmetric else np.linalg.eig(m)
        order = np.argsort(-np.real(values), kind="stable")
        values, basis = values[order], np.real(basis[:, order])
        top = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
        basis = basis * np.where(top < 0, -1.0, 1.0)
        singular = np.linalg.svd(m, compute_uv=False)
        condition = float(singular[0] / singular[-1]) if singular[-1] > 0 else None
        out = pd.DataFrame(
            {
                "k": np.arange(1, len(values) + 1, dtype=np.int32),
                "eig_re": np.real(values),
                "eig_im": np.imag(values),
                "symmetric": symmetric,
                "condition": condition,
                "vec": list(basis.T),
            }
        )
        for position, name in enumerate(keys):
            out.insert(position, name, key[position])
        return out

    return cells.select(*keys, "i", "j", "v").groupBy(*keys).applyInPandas(solve, schema)


def spectral_diagnostics(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spectrum.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and("symmetric").alias("is_symmetric"),
        F.min("eig_re").alias("eig_min"),
        F.max("eig_re").alias("eig_max"),
        F.count_if(F.col("eig_re") < 0).alias("negative_count"),
        F.count_if(F.abs("eig_re") < 1e-12).alias("near_zero_count"),
        F.max("condition").alias("condition"),
    )


def shared_mode_suite(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leading eigenvalue, gap to the second and the off-diagonal summary of a correlation matrix."""
    top = (
        spectra(missing_as_zero(cells), keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("k") == 1, F.col("eig_re"))).alias("lambda1"),
            F.max(F.when(F.col("k") == 2, F.col("eig_re"))).alias("lambda2"),
        )
        .select(*keys, "lambda1", (F.col("lambda1") - F.col("lambda2")).alias("gap"))
    )
    return off_diagonal_summary(cells, keys).join(top, list(keys))


def coordinates(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k, obj, re, im): sqrt(eigenvalue) times eigenvector; a negative eigenvalue gives an imaginary row."""
    root = F.sqrt(F.abs("eig_re"))
    return spectrum.select(*keys, "k", "eig_re", F.posexplode("vec").alias("obj", "x")).select(
        *keys,
        "k",
        "obj",
        F.when(F.col("eig_re") >= 0, root * F.col("x")).otherwise(0.0).alias("re"),
        F.when(F.col("eig_re") < 0, root * F.col("x")).otherwise(0.0).alias("im"),
    )


def double_center(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H K H with H = I - 11'/n, from row, column and grand means of each dataset-level matrix."""

    def mean(*by):
        return F.avg("v").over(Window.partitionBy(*keys, *by))

    means = cells.withColumns({"__r": mean("i"), "__c": mean("j"), "__g": mean()})
    centred = F.col("v") - F.col("__r") - F.col("__c") + F.col("__g")
    return means.withColumn("v", centred).drop("__r", "__c", "__g")


def common_block(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both matrices cropped to the leading block they share."""
    shape = [m.groupBy(*keys).agg((F.max("i") + 1).alias(n)) for m, n in ((x, "nx"), (y, "ny"))]
    limit = shape[0].join(shape[1], list(keys)).select(*keys, F.least("nx", "ny").alias("__n"))
    crop = [
        m.join(limit, list(keys)).where((F.col("i") < F.col("__n")) & (F.col("j") < F.col("__n"))).drop("__n")
        for m in (x, y)
    ]
    return crop[0], crop[1]


def hsic_cka(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, hsic, cka) of two matrices over the same objects."""
    nothing = F.lit(None).cast("double")
    left = double_center(x, keys).select(
        *keys, "i", "j", F.col("v").alias("v"), nothing.alias("s"), nothing.alias("w")
    )
    # tr(Kx Ky) pairs (i, j) with (j, i), the norms pair (i, j) with itself
    turned = F.array(
        F.struct("i", "j", nothing.alias("v"), F.col("v").alias("s"), nothing.alias("w")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), nothing.alias("v"), nothing.alias("s"), F.col("v").alias("w")),
    )
    right = double_center(y, keys).select(*keys, F.explode(turned).alias("c")).select(*keys, "c.*")
    both = left.unionByName(right).groupBy(*keys, "i", "j").agg(*[F.max(c).alias(c) for c in ("v", "s", "w")])
    both = both.where(F.col("v").isNotNull() & F.col("s").isNotNull())
    sums = both.groupBy(*keys).agg(
        F.sqrt(F.count(F.lit(1))).cast("bigint").alias("n"),
        F.sum(F.col("v") * F.col("w")).alias("tr"),
        F.sum(F.col("v") * F.col("s")).alias("xy"),
        F.sum(F.col("v") * F.col("v")).alias("xx"),
        F.sum(F.col("s") * F.col("s")).alias("yy"),
    )
    return sums.select(
        *keys,
        "n",
        (F.col("tr") / F.greatest(F.lit(1.0), F.pow(F.col("n") - 1, 2))).alias("hsic"),
        F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cka"),
    )


def squared_distances(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, v): d_i + d_j - 2 k_ij."""
    return with_diagonal(cells, keys).withColumn("v", F.col("d_i") + F.col("d_j") - 2 * F.col("v")).drop("d_i", "d_j")


def gaussian_kernel(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, v, sigma): exp(-D / 2 sigma^2), sigma = sqrt(median positive upper-triangle distance), else 1."""
    distance = squared_distances(cells, keys)
    upper = (F.col("i") < F.col("j")) & finite("v") & (F.col("v") > 0)
    # the median is over the cells of one dataset-level matrix
    sigma = distance.groupBy(*keys).agg(
        F.coalesce(F.sqrt(F.median(F.when(upper, F.col("v")))), F.lit(1.0)).alias("sigma")
    )
    return distance.join(sigma, list(keys)).withColumn(
        "v", F.exp(-F.col("v") / (2 * F.col("sigma") * F.col("sigma")))
    )


def kernel_matrix(cells: DataFrame, keys: Sequence[str], kind: str, sigma: float | None, width: int) -> DataFrame:
    """Right-centred kernel K H from dot products: gaussian (2 sigma^2 width, or the median rule), linear or imq.

    The median rule is the median squared distance below the diagonal over the objects taken twice,
    the mean where it is not positive, at least 1e-2.
    """
    distance = squared_distances(cells, keys).withColumn("v", F.abs("v"))
    if kind == "linear":
        kernel = cells
    elif kind == "imq":
        kernel = distance.withColumn("v", 1 / F.sqrt(F.col("v") + 1))
    elif sigma:
        kernel = distance.withColumn("v", F.exp(-F.col("v") / F.lit(2.0 * sigma * sigma * width)))
    else:
        # below the diagonal of [X; X]: every ordered pair once plus every unordered pair twice
        stacked = distance.withColumn(
            "v", F.explode(F.when(F.col("i") > F.col("j"), F.array_repeat("v", 3)).otherwise(F.array("v")))
        )
        rule = stacked.groupBy(*keys).agg(F.median("v").alias("med"), F.avg("v").alias("mean"))
        rule = rule.select(
            *keys,
            F.greatest(F.when(F.col("med") <= 0, F.col("mean")).otherwise(F.col("med")), F.lit(1e-2)).alias("__s"),
        )
        kernel = (
            distance.join(rule, list(keys))
            .withColumn("v", F.exp(-F.col("v") / (2 * F.col("__s") * F.col("__s"))))
            .drop("__s")
        )
    means = kernel.groupBy(*keys, "i").agg(F.avg("v").alias("__r"))
    return kernel.join(means, [*keys, "i"]).withColumn("v", F.col("v") - F.col("__r")).drop("__r")


def difference(x: DataFrame, y: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """(keys, i, j, v): scale * (x - y) over the cells both have."""
    other = y.select(*keys, "i", "j", F.col("v").alias("__w"))
    return x.join(other, [*keys, "i", "j"]).select(
        *keys, "i", "j", (F.lit(scale) * (F.col("v") - F.col("__w"))).alias("v")
    )


def rectangular_summary(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    kept = F.when(finite(value), F.col(value))
    return cells.groupBy(*keys).agg(
        F.avg(kept).alias("mean"),
        F.stddev_pop(kept).alias("std"),
        F.count(kept).alias("n_finite"),
        F.count_if(~finite(value)).alias("n_missing"),
    )


def pair_features(t: DataFrame, c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, task, cent, load, self): mean off-diagonal row of C, squared top-eigenvector entry, diagonal of T."""
    cent = (
        c.where("i <> j").groupBy(*keys, F.col("i").alias("task")).agg(F.avg("v").alias("cent"))
    )
    load = (
        spectra(missing_as_zero(c), keys)
        .where("k = 1")
        .select(*keys, F.posexplode("vec").alias("task", "x"))
        .select(*keys, "task", (F.col("x") * F.col("x")).alias("load"))
    )
    diagonal = t.where("i = j").select(*keys, F.col("i").alias("task"), F.col("v").alias("self"))
    return cent.join(load, [*keys, "task"]).join(diagonal, [*keys, "task"])

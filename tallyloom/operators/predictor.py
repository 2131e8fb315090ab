"""Sign predictors over matrix features, and weight searches over experiment tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import sign2, sign3
from tallyloom.operators import evalmetrics as E
from tallyloom.operators import joins as J

FEATURES = ("delta_cent", "delta_load", "delta_self")
GRID = (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)  # fixed values


def linear_score(weights: Sequence[Column], features: Sequence[str] = FEATURES) -> Column:
    out = weights[0] * F.col(features[0])
    for w, f in zip(weights[1:], features[1:]):
        out = out + w * F.col(f)
    return out


def sign_accuracy(rows: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """(keys, n, sign_accuracy) over rows with both values; zero is a sign of its own."""
    both = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    hit = (sign3(score) == sign3(truth)).cast("int")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("sign_accuracy"))


def feature_evaluation(rows: DataFrame, features: Sequence[str], truth: str) -> DataFrame:
    """(feature, n, sign_accuracy, pearson, spearman, reason) of every feature on its own."""
    long = rows.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("f"), F.col(truth).alias("y")
    ).select("f.*", "y")
    return sign_accuracy(long, ["feature"], "x", "y").join(
        E.correlations(long, ["feature"], "x", "y").drop("n"), "feature"
    )


def _sums(rows: DataFrame, fold: str, truth: str, grid: Sequence[float]) -> DataFrame:
    """(fold, g, a, b, c, sums) for every weight triple but zero; sums are additive over folds.

    Products are summed around the means of all rows, which leaves correlations as they are and does not cancel.
    """
    triples = [t for t in product(grid, repeat=3) if any(t)]
    items = F.array(
        *[F.struct(F.lit(k).alias("g"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for k, (a, b, c) in enumerate(triples)]
    )
    valid = rows.where(" and ".join(f"{f} is not null" for f in (*FEATURES, truth))).withColumn("__k", F.lit(1))
    means = valid.groupBy("__k").agg(*[F.avg(f).alias(f"__m_{f}") for f in (*FEATURES, truth)])
    weights = [F.col("w.a"), F.col("w.b"), F.col("w.c")]
    scored = (
        valid.join(means, "__k")
        .withColumn("w", F.explode(items))
        .select(
            fold,
            "w.*",
            F.col(truth).alias("y"),
            linear_score(weights).alias("x"),
            linear_score(weights, [f"__m_{f}" for f in FEATURES]).alias("mx"),
            F.col(f"__m_{truth}").alias("my"),
        )
    )
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return scored.groupBy(fold, "g", "a", "b", "c").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((sign3("x") == sign3("y")).cast("int")).alias("hits"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )


def _best(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, a, b, c, accuracy, pearson): best accuracy, then correlation, then smallest L1 norm, then grid order."""
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((n >= 2) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    scored = sums.withColumn("accuracy", F.col("hits") / n).withColumn("pearson", F.round(corr, 10))
    rank = F.struct(
        F.col("accuracy"),
        F.coalesce("pearson", F.lit(-2.0)),
        -(F.abs("a") + F.abs("b") + F.abs("c")),
        -F.col("g"),
    )
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("n", "a", "b", "c", "accuracy", "pearson"), rank).alias("best"))
    return best.select(*keys, "best.*")


def grid_fit(rows: DataFrame, group: str, truth: str, grid: Sequence[float] = GRID) -> DataFrame:
    """(group, n, a, b, c, accuracy, pearson): weights fitted per group on a grid of triples."""
    return _best(_sums(rows, group, truth, grid), [group])


def leave_one_out_fit(
    rows: DataFrame, dataset: str, truth: str, grid: Sequence[float] = GRID, manual: Sequence[float] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """(dataset, n, a, b, c, accuracy, pearson, fallback): weights fitted on all other datasets.

    The sums of a fold are the totals minus the dataset's own, so rows are scored once for all folds.
    With fewer than two training rows the manual weights are used.
    """
    own = _sums(rows, dataset, truth, grid)
    names = ["n", "hits", "sx", "sy", "sxx", "syy", "sxy"]
    total = own.groupBy("g", "a", "b", "c").agg(*[F.sum(c).alias(f"__t_{c}") for c in names])
    datasets = rows.select(dataset).distinct()
    grid_rows = total.withColumn("__k", F.lit(1)).join(datasets.withColumn("__k", F.lit(1)), "__k").drop("__k")
    folds = grid_rows.join(own, [dataset, "g", "a", "b", "c"], "left").select(
        dataset, "g", "a", "b", "c", *[(F.col(f"__t_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in names]
    )
    fitted = _best(folds.where("n >= 2"), [dataset])
    out = datasets.join(fitted, dataset, "left").withColumn("fallback", F.col("n").isNull())
    for name, value in zip("abc", manual):
        out = out.withColumn(name, F.coalesce(name, F.lit(float(value))))
    return out


def predict(rows: DataFrame, weights: DataFrame, key: str, truth: str) -> DataFrame:
    """Rows with pred_score, pred_sign and correct under the weights of their key."""
    scored = rows.join(weights.select(key, "a", "b", "c"), key).withColumn(
        "pred_score", linear_score([F.col("a"), F.col("b"), F.col("c")])
    )
    return scored.withColumn("pred_sign", sign3("pred_score")).withColumn(
        "correct", (sign3("pred_score") == sign3(truth)).cast("int")
    )


def top_k_metrics(rows: DataFrame, ids: Sequence[str], score: str, truth: str, ks: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """(k, overlap, positive_precision) of the k rows predicted best against the k truly best, k at most the row count.

    Only the max(ks) best rows of either order leave their tasks.
    """
    both = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull())

    def best(column, name):
        rank = F.row_number().over(Window.orderBy(F.col(column).desc(), *ids))
        return both.orderBy(F.col(column).desc(), *ids).limit(max(ks)).select(*ids, truth, rank.alias(name))

    chosen = best(score, "__p").join(best(truth, "__t").drop(truth), list(ids), "left")
    size = both.limit(max(ks)).agg(F.count(F.lit(1)).alias("__n"))
    wanted = size.select(F.explode(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: F.least(k, F.col("__n").cast("int"))))).alias("k"))
    spread = chosen.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, max(ks) + 1)]))).where(F.col("__p") <= F.col("k"))
    hit = F.coalesce(F.col("__t") <= F.col("k"), F.lit(False)).cast("int")
    return (
        spread.join(wanted, "k")
        .groupBy("k")
        .agg((F.sum(hit) / F.col("k")).alias("overlap"), (F.sum((F.col(truth) > 0).cast("int")) / F.col("k")).alias("positive_precision"))
    )


# --- experiment tables -----------------------------------------------------------------------------

# fixed values: metric names and default weights
METRICS = ("dot_before", "dot_after", "c_start", "c_end", "v_align")
DEFAULT_WEIGHT_START, DEFAULT_WEIGHT_DOT = 100.0, 100.0


def weighted_total(w_dot, w_start) -> Column:
    """w_dot dot_before - dot_after + w_start C_start + C_end, missing parts 0."""
    part = {m: F.coalesce(m, F.lit(0.0)) for m in METRICS}
    return w_dot * part["dot_before"] - part["dot_after"] + w_start * part["c_start"] + part["c_end"]


def aligned_total(w_start) -> Column:
    """The earlier form: V_align + w_start C_start + C_end; NULL when all three are missing."""
    part = {m: F.coalesce(m, F.lit(0.0)) for m in METRICS}
    known = F.coalesce("v_align", "c_start", "c_end").isNotNull()
    return F.when(known, part["v_align"] + w_start * part["c_start"] + part["c_end"])


def total_differences(metrics: DataFrame, keys: Sequence[str], ckpt: str, total: Column) -> DataFrame:
    """(keys, diff, sign): total under sft minus total under sdft, one missing side 0, sign two-valued."""
    rows = metrics.select(*keys, ckpt, total.alias("__total"))
    out = J.outer_difference(
        rows.where(F.col(ckpt) == "sft"), rows.where(F.col(ckpt) == "sdft"), keys, "__total", "diff"
    )
    return out.withColumn("sign", F.when(sign2("diff") > 0, "+").otherwise("-"))


def wide_table(rows: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).agg(F.first(value, ignorenulls=True))


def search_weights(points: DataFrame, max_exp: float = 3.0, step: float = 1e-4, ratio: float = 10.0) -> DataFrame:
    """(w_dot, w_start, accuracy, margin): best point of a logarithmic grid with w_start >= ratio w_dot.

    ``points`` is (x_dot, x_start, bias, label), the labelled cells of one experiment table; all of them are scored.
    The grid's first axis is a range of rows that Spark splits; a row runs along the second axis, cell after cell,
    and returns its best point. Best sign accuracy wins, then the largest smallest score, then the first point.
    """
    steps = round(max_exp / step)
    log_ratio = math.log10(ratio)
    cells = points.agg(F.collect_list(F.struct("x_dot", "x_start", "bias", "label")).alias("cells"))
    axis = points.sparkSession.range(steps + 1).where(F.col("id") * step + log_ratio <= max_exp)
    rows = axis.select(F.col("id").alias("i"), F.lit(1).alias("__k")).join(cells.withColumn("__k", F.lit(1)), "__k").select("i", "cells")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, own in zip(batch.column("i").to_pylist(), batch.column("cells")):
                first = math.ceil((i * step + log_ratio) / step)
                w_dot, w_start = 10.0 ** (i * step), np.power(10.0, np.arange(first, steps + 1) * step)
                hits, margin = np.zeros(len(w_start), np.int64), np.full(len(w_start), np.inf)
                for cell in own.as_py():
                    score = w_dot * cell["x_dot"] + w_start * cell["x_start"] + cell["bias"]
                    hits += (score >= 0) == (cell["label"] > 0)
                    np.minimum(margin, np.abs(score), out=margin)
                if len(w_start):
                    j = int(np.argmax(np.where(hits == hits.max(), margin, -1.0)))
                    found.append((i, first + j, w_dot, float(w_start[j]), int(hits[j]), float(margin[j]), len(own)))
            names = ("i", "j", "w_dot", "w_start", "hits", "margin", "n")
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=_BEST)

    scored = rows.mapInArrow(best, "i bigint, j bigint, w_dot double, w_start double, hits bigint, margin double, n bigint")
    chosen = F.max_by(
        F.struct("w_dot", "w_start", F.try_divide("hits", "n").alias("accuracy"), "margin"),
        F.struct("hits", "margin", -F.col("i"), -F.col("j")),
    )
    return scored.agg(chosen.alias("b")).select("b.*")


_BEST = pa.schema(
    [(n, pa.int64()) for n in ("i", "j")]
    + [(n, pa.float64()) for n in ("w_dot", "w_start")]
    + [("hits", pa.int64()), ("margin", pa.float64()), ("n", pa.int64())]
)


def difference_points(metrics: DataFrame, labels: Mapping[tuple[str, str], int]) -> DataFrame:
    """(x_dot, x_start, bias, label): sft - sdft components of the labelled (domain, test) cells."""
    both = metrics.groupBy("domain", "test").pivot("ckpt", ["sft", "sdft"]).agg(
        *[F.first(m, ignorenulls=True).alias(m) for m in METRICS]
    )

    def gap(m):
        return F.coalesce(f"sft_{m}", F.lit(0.0)) - F.coalesce(f"sdft_{m}", F.lit(0.0))

    label = F.lit(None).cast("int")
    for (domain, test), value in labels.items():
        label = F.when((F.col("domain") == domain) & (F.col("test") == test), F.lit(value)).otherwise(label)
    return both.select(
        gap("dot_before").alias("x_dot"), gap("c_start").alias("x_start"), (gap("c_end") - gap("dot_after")).alias("bias"), label.alias("label")
    ).where("label is not null")

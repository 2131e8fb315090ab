"""Loss-distribution diagnostics: tails, robust means, concentration, dependence.

Order statistics come from :mod:`tallyloom.operators.ordering`, so a group may hold any share of the rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tallyloom.functions import sampling
from tallyloom.functions.numeric import clip, finite, linspace
from tallyloom.operators import ordering as O
from tallyloom.session import cut_lineage, known_small


# --- rollups -----------------------------------------------------------------------------------


def sample_rollup(tokens: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """(keys, ti, li, lbar): token count, sum and mean of the token losses."""
    return tokens.groupBy(*keys).agg(
        F.count(loss).alias("ti"), F.sum(loss).alias("li"), (F.sum(loss) / F.count(loss)).alias("lbar")
    )


def weighted_mean_loss(batches: DataFrame, keys: Sequence[str], loss: str, tokens: str) -> DataFrame:
    """Token-weighted mean over finite batches, with counters of used and skipped batches."""
    ok = finite(loss) & (F.col(tokens) > 0)
    return batches.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(ok, F.col(loss) * F.col(tokens))), F.sum(F.when(ok, F.col(tokens)))).alias(
            "mean_loss"
        ),
        F.coalesce(F.sum(F.when(ok, F.col(tokens))), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.count_if(ok).alias("n_used"),
        F.count_if(~ok).alias("n_skipped"),
    )


def loss_variance(
    tokens: DataFrame, group: Sequence[str], sample: str, loss: str, order: Sequence[str], shift: bool
) -> DataFrame:
    """(group, n, mean, variance): population variance of per-sample mean losses.

    ``shift`` leaves each sample's first token out, as a causal label shift does.
    """
    first = F.min_by(loss, F.struct(*order))
    per_sample = tokens.groupBy(*group, sample).agg(
        F.count(loss).alias("c"), F.sum(loss).alias("s"), first.alias("f")
    )
    if shift:
        per_sample = per_sample.where("c > 1").select(
            *group, sample, (F.col("c") - 1).alias("c"), (F.col("s") - F.col("f")).alias("s")
        )
    mean = F.col("s") / F.col("c")
    return per_sample.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(mean).alias("mean"), F.var_pop(mean).alias("variance")
    )


def moments_and_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """(keys, n, mean, std, var, quantiles), all from one table of ranked distinct values, so rows are read once.

    The group's count and sum come with every ranked value, and squares are summed around the mean.
    """
    keys = list(keys)
    counted = O.value_counts(df, keys, value).withColumn("__wv", F.col(value) * F.col("cnt"))
    ranked = O.running_totals(counted, keys, [value], {"before": "cnt"}, {"total": "cnt", "__wsum": "__wv"})
    ranked = ranked.withColumn("__mean", F.col("__wsum") / F.col("total"))
    gap = F.col(value) - F.col("__mean")
    spread = ranked.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.max("__mean").alias("mean"),
        F.sum(F.col("cnt") * gap * gap).alias("__ss"),
        *O.quantile_aggregates(value, qs),
    )
    return spread.select(
        *keys,
        "n",
        "mean",
        F.sqrt(F.col("__ss") / F.col("n")).alias("std"),
        F.coalesce(F.try_divide("__ss", F.col("n") - 1), F.lit(0.0)).alias("var"),
        *[O.interpolated(n).alias(n) for n in qs],
    )


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str) -> DataFrame:
    """1-based quantile bin per row; equal edges collapse, the lowest value belongs to the first bin."""
    qs = {f"e{k}": k / bins for k in range(bins + 1)}
    edges = O.exact_quantiles(df, keys, value, qs).select(
        *keys, F.array_distinct(F.array(*qs)).alias("__edges")
    )
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return df.join(edges, list(keys)).withColumn(name, F.greatest(below, F.lit(1))).drop("__edges")


def conditional_summary(rows: DataFrame, groups: Mapping[str, Column], value: str) -> DataFrame:
    """(group_col, group_value, n, mean, std, var, q90, q95, q99) for every named grouping at once."""
    labels = [F.struct(F.lit(n).alias("group_col"), c.cast("string").alias("group_value")) for n, c in groups.items()]
    spread = rows.select(F.explode(F.array(*labels)).alias("g"), value).select("g.*", value)
    return moments_and_quantiles(
        spread, ["group_col", "group_value"], value, {"q90": 0.90, "q95": 0.95, "q99": 0.99}
    )


def variance_ratios(summary: DataFrame, pooled: str = "pooled") -> DataFrame:
    """(group_col, mean_var, ratio): mean conditional variance over the pooled one."""
    per = summary.groupBy("group_col").agg(F.avg("var").alias("mean_var"))
    whole = per.where(F.col("group_col") == pooled).select(F.col("mean_var").alias("pooled_var"), F.lit(1).alias("__k"))
    return (
        per.where(F.col("group_col") != pooled)
        .withColumn("__k", F.lit(1))
        .join(whole, "__k")
        .select("group_col", "mean_var", "pooled_var", F.try_divide("mean_var", "pooled_var").alias("ratio"))
    )


# --- robust means ------------------------------------------------------------------------------


def median_of_means(rows: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], blocks: int, seed: str, name: str) -> DataFrame:
    """Median of the means of near-equal blocks of a seeded shuffle."""
    shuffled = O.positions(
        rows.where(finite(value)).withColumn("__h", sampling.hash_int(*ids, seed=seed)),
        keys,
        ["__h", *ids],
        "__pos",
        total="__n",
    )
    k = F.greatest(F.lit(2), F.least(F.col("__n"), F.lit(blocks)))
    means = (
        shuffled.withColumn("__b", O.near_equal_block(F.col("__pos"), F.col("__n"), k))
        .groupBy(*keys, "__b")
        .agg(F.avg(value).alias("__m"))
    )
    return means.groupBy(*keys).agg(F.median("__m").alias(name))


#: candidates of a pass of the M-estimator, and passes that narrow its bracket
CANDIDATES, NARROWINGS = 33, 3
#: standard deviations on each side of the mean between which its root lies: where t = 1.5 and z has mean 0 and variance
#: 1/4, tanh(z - t) is at most 0.28 z^2 - 0.6, whose mean is below zero
REACH = 3.0


def catoni_means(
    rows: DataFrame, keys: Sequence[str], value: str, name: str, candidates: int = CANDIDATES, narrowings: int = NARROWINGS
) -> DataFrame:
    """M-estimator with tanh influence, in five passes over the rows for all groups together.

    The mean influence falls as the centre grows, so a pass that takes it at many equally spaced centres of a bracket tells
    between which two of them the root lies. After one pass for the bracket and three that narrow it to less than a
    thousandth of a standard deviation, one Newton step from the interpolated root is exact to double precision. The
    state is one row per group and no job runs while the plan is built.
    """
    kept = rows.where(finite(value)).select(*keys, F.col(value).alias("__x"))
    around = F.lit(REACH) * F.stddev_pop("__x")
    state = kept.groupBy(*keys).agg(
        (F.avg("__x") - around).alias("__low"),
        (F.avg("__x") + around).alias("__high"),
        (1 / (2 * (F.stddev_pop("__x") + 1e-12))).alias("__alpha"),
    )
    wide = (F.col("__high") - F.col("__low")) / (candidates - 1)

    def at(k) -> Column:
        return F.col("__low") + k * wide

    for _ in range(narrowings):
        influence = [F.avg(F.tanh(F.col("__alpha") * (F.col("__x") - at(k)))) for k in range(candidates)]
        seen = kept.join(state, list(keys)).groupBy(*keys, "__low", "__high", "__alpha").agg(F.array(*influence).alias("__psi"))
        # the root lies before the first candidate whose influence is not above zero
        below = F.size(F.filter("__psi", lambda p: p > 0))
        after = F.greatest(F.lit(1), F.least(F.lit(candidates - 1), below))
        state = seen.withColumn("__k", after).select(
            *keys,
            at(F.col("__k") - 1).alias("__low"),
            at(F.col("__k")).alias("__high"),
            "__alpha",
            F.get("__psi", F.col("__k") - 1).alias("__first"),
            F.get("__psi", F.col("__k")).alias("__second"),
        )
    share = F.coalesce(F.try_divide(F.col("__first"), F.col("__first") - F.col("__second")), F.lit(0.5))
    state = state.select(*keys, "__alpha", (F.col("__low") + share * (F.col("__high") - F.col("__low"))).alias("__m"))
    t = F.tanh(F.col("__alpha") * (F.col("__x") - F.col("__m")))
    last = kept.join(state, list(keys)).groupBy(*keys, "__m", "__alpha").agg(F.avg(t).alias("__psi"), F.avg(1 - t * t).alias("__slope"))
    return last.select(*keys, (F.col("__m") + F.col("__psi") / (F.col("__alpha") * F.col("__slope") + 1e-12)).alias(name))


def array_mean(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_trimmed_mean(a, alpha: float) -> Column:
    """Trimmed mean of a sorted array of bounded length."""
    n = F.size(a)
    k = F.greatest(F.lit(0), F.least(F.floor(n / 2).cast("int") - 1, F.floor(n * F.lit(alpha)).cast("int")))
    return array_mean(F.slice(a, k + 1, n - 2 * k))


def array_median_of_means(shuffled, blocks: int) -> Column:
    """Median of block means of an already shuffled array."""
    n = F.size(shuffled)
    k = F.greatest(F.lit(2), F.least(n, F.lit(blocks)))
    size = F.floor(n / k).cast("int")
    larger = n - size * k
    means = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda b: array_mean(F.slice(shuffled, b * size + F.least(b, larger) + 1, size + F.when(b < larger, 1).otherwise(0))),
    )
    ordered = F.array_sort(means)
    return (F.get(ordered, F.floor((k - 1) / 2).cast("int")) + F.get(ordered, F.floor(k / 2).cast("int"))) / 2


def array_catoni(a, max_iter: int = 200, tol: float = 1e-8) -> Column:
    """The tanh M-estimator of short arrays of one length; a batch of arrays takes its Newton steps together."""

    @F.pandas_udf("double")
    def estimate(batch: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=batch.index)
        for _, same in batch.groupby(batch.map(len)):
            y = np.stack(same.to_numpy())
            m = y.mean(axis=1)
            alpha = 1.0 / (2.0 * (y.std(axis=1) + 1e-12))
            moving = np.ones(len(m), dtype=bool)
            for _ in range(max_iter):
                t = np.tanh(alpha[moving, None] * (y[moving] - m[moving, None]))
                slope = -alpha[moving] * (1.0 - t * t).mean(axis=1)
                step = t.mean(axis=1) / (slope - 1e-12)
                m[moving] -= step
                moving[moving] = np.abs(step) > tol
                if not moving.any():
                    break
            out[same.index] = m
        return out

    return estimate(a)


#: rounds of the scattering: a key for the repeat and two odd factors, all of 31 bits, so that products fit 64 bits
SCATTER_ROUNDS = (
    (1140071481, 1540483477, 739982445),
    (1597334677, 1664525017, 1812433253),
    (1082269761, 1289706101, 2024237689),
    (1759714724, 1181783497, 1476692641),
)
SCATTER_BITS, SCATTER_SHIFTS = 31, (15, 13)


def seed_number(seed: str) -> int:
    """The seed as a number of 31 bits."""
    return zlib.crc32(seed.encode()) >> 1


def scattered(x: np.ndarray, rep: np.ndarray, u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one map of the numbers below u * v (both powers of two) for each repeat: two halves mixed in turn."""
    mask = (1 << SCATTER_BITS) - 1
    halves, widths = [x // v, x % v], (u, v)
    for k, (key, first, second) in enumerate(SCATTER_ROUNDS):
        mixed = (((halves[1 - k % 2] + (rep + 1) * key + seed) & mask) * first) & mask
        mixed = ((mixed ^ (mixed >> SCATTER_SHIFTS[0])) * second) & mask
        mixed ^= mixed >> SCATTER_SHIFTS[1]
        halves[k % 2] = halves[k % 2] ^ (mixed & (widths[k % 2] - 1))
    return halves[0] * v + halves[1]


def _row_number(seed: int):
    """Row number of a draw: the draw's own number scattered until it is below the number of rows."""

    @F.pandas_udf("bigint")
    def walk(draw: pd.Series, rep: pd.Series, rows: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        x, *others = (c.to_numpy(np.int64) for c in (draw, rep, u, v))
        limit, x = rows.to_numpy(np.int64), scattered(x, *others, seed)
        while len(out := np.flatnonzero(x >= limit)):
            x[out] = scattered(x[out], *(c[out] for c in others), seed)
        return pd.Series(x)

    return walk


def subsamples(rows: DataFrame, ids: Sequence[str], n, repeats: int, seed: str) -> DataFrame:
    """(rep, pos, row columns): ``repeats`` samples of exactly ``n`` rows without replacement, each drawn on its own.

    Rows are numbered once, in the order of ``ids``. A repeat scatters the numbers below the next power of two one to one,
    again where the result is no row number; that maps row numbers one to one, so the draws 0 to n - 1 are n different
    rows and no more than repeats x n rows are ever joined, whatever the size of the table. ``n`` is a number or a
    function of the number of rows; a table of fewer rows is taken whole.
    """
    size = rows.agg(F.count(F.lit(1)).alias("__rows"))
    wanted = n(F.col("__rows")) if callable(n) else F.lit(n)
    # bits of the largest row number, dealt to two halves
    bits = F.length(F.bin(F.col("__rows") - 1))
    halves = size.select(
        F.lit(1).alias("__k"), "__rows", F.least(wanted.cast("bigint"), F.col("__rows")).alias("__n"), bits.alias("__bits")
    ).where("__n > 0")
    halves = halves.withColumn("__u", F.expr("shiftleft(1L, __bits div 2)")).withColumn(
        "__v", F.expr("shiftleft(1L, __bits - __bits div 2)")
    )
    drawn = (
        rows.sparkSession.range(repeats)
        .select(F.col("id").cast("int").alias("rep"), F.lit(1).alias("__k"))
        .join(halves, "__k")
        .withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    )
    number = _row_number(seed_number(seed))("pos", "rep", "__rows", "__u", "__v")
    places = drawn.select("rep", "pos", number.alias("__row"))
    return places.join(O.positions(rows, [], ids, "__row"), "__row").drop("__row")


ESTIMATORS = ("mean", "trimmed_mean", "median_of_means", "catoni")


def robust_mean_experiment(
    rows: DataFrame,
    ids: Sequence[str],
    value: str,
    n: int = 512,
    repeats: int = 400,
    trim_alpha: float = 0.1,
    blocks: int = 8,
    estimators: Sequence[str] = ESTIMATORS,
    seed: str = "robust",
) -> DataFrame:
    """(estimator, mean_abs_dev, p95_abs_dev, max_abs_dev, mean_inj_shift, mean_remove_shift).

    A repeat is one array of ``n`` numbers; it is estimated as drawn, with its last element replaced by
    the 99.9% quantile of all rows, and without its largest element.
    """
    kept = rows.where(finite(value))
    whole = kept.withColumn("__k", F.lit(1))
    top = O.exact_quantiles(whole, ["__k"], value, {"top": 0.999})
    overall = whole.groupBy("__k").agg(F.avg(value).alias("mu")).join(top, "__k")
    drawn = (
        subsamples(kept, ids, n, repeats, seed)
        .groupBy("rep")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("a"))
        .withColumn("__k", F.lit(1))
        .join(overall, "__k")
    )
    kinds = F.array(
        F.struct(F.lit("asis").alias("kind"), F.col("a").alias("x")),
        F.struct(F.lit("inj").alias("kind"), F.concat(F.slice("a", 1, n - 1), F.array("top")).alias("x")),
        F.struct(F.lit("rm").alias("kind"), F.slice(F.array_sort("a"), 1, n - 1).alias("x")),
    )
    forms = {
        "mean": array_mean(F.col("x")),
        "trimmed_mean": array_trimmed_mean(F.array_sort("x"), trim_alpha),
        "median_of_means": array_median_of_means(F.col("x"), blocks),
        "catoni": array_catoni(F.col("x")),
    }
    each = drawn.select("rep", "mu", F.explode(kinds).alias("s")).select("rep", "mu", "s.kind", "s.x")
    # a few thousand short arrays, each worth much arithmetic: small enough to be merged into one task otherwise
    each = each.repartition(rows.sparkSession.sparkContext.defaultParallelism, "rep", "kind")
    estimated = each.select(
        "rep",
        "mu",
        "kind",
        F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), forms[e].alias("est")) for e in estimators])).alias("e"),
    ).select("rep", "mu", "kind", "e.*")

    def pick(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("est")))

    per_rep = estimated.groupBy("estimator", "rep").agg(
        F.abs(pick("asis") - F.max("mu")).alias("dev"),
        F.abs(pick("inj") - pick("asis")).alias("inj"),
        F.abs(pick("rm") - pick("asis")).alias("rm"),
    )
    return per_rep.groupBy("estimator").agg(
        F.avg("dev").alias("mean_abs_dev"),
        F.percentile("dev", 0.95).alias("p95_abs_dev"),
        F.max("dev").alias("max_abs_dev"),
        F.avg("inj").alias("mean_inj_shift"),
        F.avg("rm").alias("mean_remove_shift"),
    )


# --- moment generating function ----------------------------------------------------------------


def log_mgf_curve(rows: DataFrame, keys: Sequence[str], value: str, lambdas: Sequence[float]) -> DataFrame:
    """(keys, k, lam, mgf, stable): log mean exp(lam (x - mean)) by log-sum-exp, all lambdas in one pass.

    The shift is the maximum of lam x, which is lam times the maximum (or minimum) of x.
    """
    kept = rows.where(finite(value)).select(*keys, value)
    base = kept.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.max(value).alias("__hi"), F.min(value).alias("__lo"))
    base = known_small(base)
    joined = kept.join(base, list(keys))
    sums = []
    for k, lam in enumerate(lambdas):
        edge = F.col("__hi") if lam >= 0 else F.col("__lo")
        sums.append(F.avg(F.exp(F.lit(lam) * (F.col(value) - edge))).alias(f"__e{k}"))
    wide = joined.groupBy(*keys).agg(
        F.first("__mu").alias("__mu"), F.first("__hi").alias("__hi"), F.first("__lo").alias("__lo"), *sums
    )
    points = []
    for k, lam in enumerate(lambdas):
        edge = F.col("__hi") if lam >= 0 else F.col("__lo")
        mgf = F.lit(lam) * (edge - F.col("__mu")) + F.log(F.col(f"__e{k}"))
        points.append(F.struct(F.lit(k).alias("k"), F.lit(lam).alias("lam"), mgf.alias("mgf")))
    long = wide.select(*keys, F.explode(F.array(*points)).alias("p")).select(*keys, "p.*")
    return long.withColumn("stable", finite("mgf"))


def stable_max_lambda(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stable_max): the lambda before the first unstable one, from one pass over the curve."""
    points = F.array_sort(F.collect_list(F.struct("k", "lam", "stable")))
    packed = curve.groupBy(*keys).agg(points.alias("__p"), F.bool_or("stable").alias("__any")).where("__any")
    first_bad = F.array_position(F.transform("__p", lambda p: p["stable"]), F.lit(False)).cast("int")
    at = F.when(first_bad == 0, F.size("__p")).otherwise(F.greatest(first_bad - 1, F.lit(1)))
    return packed.select(*keys, F.element_at("__p", at)["lam"].alias("stable_max"))


def mgf_fits(curve: DataFrame, keys: Sequence[str], points: int, c_points: int = 100) -> DataFrame:
    """(keys, interval, n_points, quadratic_a, quadratic_mse, subgamma_v, subgamma_c, subgamma_mse).

    Least squares of a lam^2 and of v lam^2 / (2 (1 - c lam)) with c on a grid up to 0.95 / max lam, on
    the whole curve, its first half and its first quarter (at least 3 points).
    """
    spans = [("full", 1.0), ("half", 0.5), ("quarter", 0.25)]
    sizes = F.array(
        *[F.struct(F.lit(n).alias("interval"), F.lit(max(3, int(points * f))).alias("size")) for n, f in spans]
    )
    part = (
        curve.where("stable")
        .withColumn("s", F.explode(sizes))
        .where(F.col("k") < F.col("s.size"))
        .select(*keys, "s.interval", "lam", "mgf")
    )
    by = [*keys, "interval"]
    lam2 = F.col("lam") * F.col("lam")
    quad = part.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max("lam").alias("lam_max"),
        (F.sum(lam2 * F.col("mgf")) / F.sum(lam2 * lam2)).alias("quadratic_a"),
    )
    quad = quad.where("n_points >= 3")
    grid = part.join(quad, by).withColumn("ci", F.explode(F.sequence(F.lit(0), F.lit(c_points - 1))))
    c_max = F.greatest(F.lit(1e-6), F.lit(0.95) / F.col("lam_max"))
    grid = grid.withColumn("c", F.col("ci") * (c_max / F.lit(float(c_points - 1))))
    grid = grid.withColumn("basis", lam2 / F.greatest(2 * (1 - F.col("c") * F.col("lam")), F.lit(1e-12)))
    # mean (v b - y)^2 with v = sum(by)/sum(bb), kept as residuals to avoid cancellation
    fits = grid.groupBy(*by, "ci", "c").agg(
        (F.sum(F.col("basis") * F.col("mgf")) / F.sum(F.col("basis") * F.col("basis"))).alias("v")
    )
    residual = F.col("v") * F.col("basis") - F.col("mgf")
    scored = (
        grid.select(*by, "ci", "basis", "mgf")
        .join(fits, [*by, "ci"])
        .groupBy(*by, "ci", "c", "v")
        .agg(F.avg(residual * residual).alias("mse"))
    )
    best = scored.groupBy(*by).agg(F.min_by(F.struct("v", "c", "mse"), F.struct("mse", "ci")).alias("b"))
    gap = F.col("quadratic_a") * lam2 - F.col("mgf")
    quad_mse = part.join(quad, by).groupBy(*by).agg(F.avg(gap * gap).alias("quadratic_mse"))
    return (
        quad.join(quad_mse, by)
        .join(best, by)
        .select(
            *by,
            "n_points",
            "quadratic_a",
            "quadratic_mse",
            F.col("b.v").alias("subgamma_v"),
            F.col("b.c").alias("subgamma_c"),
            F.col("b.mse").alias("subgamma_mse"),
        )
    )


# --- concentration -----------------------------------------------------------------------------


def bernstein_radius(variance, n, delta, scale_b) -> Column:
    """sqrt(2 var ln(3/delta) / n) + 3 b ln(3/delta) / n"""
    logt = F.log(F.lit(3.0) / delta)
    return F.sqrt(2.0 * F.greatest(variance, F.lit(0.0)) * logt / n) + 3.0 * scale_b * logt / n


SAMPLE_SIZES = (64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192)  # fixed values


def bernstein_coverage(
    rows: DataFrame,
    ids: Sequence[str],
    value: str,
    deltas: Sequence[float] = (0.1, 0.05, 0.01),
    repeats: int = 300,
    sizes: Sequence[int] = SAMPLE_SIZES,
    seed: str = "bernstein",
) -> DataFrame:
    """(n, delta, coverage_rate, mean_abs_dev, mean_radius, mu_full, scale_b) over subsamples.

    Subsamples are nested in n within a repeat. Only sizes below the number of rows are drawn, a quarter of the rows
    (8 at least) where there is none.
    """
    kept = rows.where(finite(value)).select(*ids, value)
    whole = kept.withColumn("__k", F.lit(1))
    mu = whole.groupBy("__k").agg(F.avg(value).alias("mu_full"), F.count(F.lit(1)).alias("__total"))

    def grid(total):
        below = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n < total)
        quarter = F.greatest(F.lit(8), F.floor(total / 4).cast("int"))
        return F.when(F.size(below) > 0, below).otherwise(F.array(quarter))

    centred = whole.join(mu, "__k").withColumn("__abs", F.abs(F.col(value) - F.col("mu_full")))
    facts = mu.join(O.exact_quantiles(centred, ["__k"], "__abs", {"scale_b": 0.99}), "__k")
    drawn = subsamples(kept, ids, lambda total: F.array_max(grid(total)), repeats, seed).withColumn("__k", F.lit(1))
    # a row counts once, for the first size it belongs to; the sizes' sums are running sums over those
    gap = F.col(value) - F.col("mu_full")
    parts = (
        drawn.join(facts, "__k")
        .withColumn("__size", F.size(F.filter(grid(F.col("__total")), lambda n: n <= F.col("pos"))))
        .groupBy("rep", "__size", "__total", "mu_full", "scale_b")
        .agg(F.sum(gap).alias("__s1"), F.sum(gap * gap).alias("__s2"))
    )
    smaller = Window.partitionBy("rep").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    per = parts.select(
        "rep",
        "mu_full",
        "scale_b",
        F.get(grid(F.col("__total")), F.col("__size")).alias("n"),
        F.sum("__s1").over(smaller).alias("__s1"),
        F.sum("__s2").over(smaller).alias("__s2"),
    )
    square = (F.col("__s2") - F.col("__s1") * F.col("__s1") / F.col("n")) / (F.col("n") - 1)
    per = (
        per.withColumn("mu_hat", F.col("mu_full") + F.col("__s1") / F.col("n"))
        .withColumn("var_hat", F.greatest(square, F.lit(0.0)))
        .withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    )
    radius = bernstein_radius(F.col("var_hat"), F.col("n"), F.col("delta"), F.col("scale_b"))
    per = per.withColumn("radius", radius).withColumn("dev", F.abs(F.col("mu_hat") - F.col("mu_full")))
    return per.groupBy("n", "delta").agg(
        F.avg((F.col("dev") <= F.col("radius")).cast("int")).alias("coverage_rate"),
        F.avg("dev").alias("mean_abs_dev"),
        F.percentile("dev", 0.95).alias("p95_abs_dev"),
        F.avg("radius").alias("mean_radius"),
        F.percentile("radius", 0.95).alias("p95_radius"),
        F.first("mu_full").alias("mu_full"),
        F.first("scale_b").alias("scale_b"),
    )


# --- tails -------------------------------------------------------------------------------------


def positive_tail(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ranked distinct positive parts of the centred values: (keys, x, cnt, before, total)."""
    kept = rows.where(finite(value)).select(*keys, value)
    mu = known_small(kept.groupBy(*keys).agg(F.avg(value).alias("__mu")))
    centred = kept.join(mu, list(keys)).select(*keys, (F.col(value) - F.col("__mu")).alias("x")).where("x > 0")
    return O.ranked_values(centred, keys, "x")


def quantile_slice(tail: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Rows of a ranked tail between two of its quantiles, ranked anew without another sort."""
    # a row per group each: a group's tail is never dealt out by its key
    bounds = known_small(O.quantiles_of_ranked(tail, keys, "x", {"__lo": low, "__hi": high}))
    kept = tail.join(bounds, list(keys)).where((F.col("x") >= F.col("__lo")) & (F.col("x") <= F.col("__hi")))
    first = kept.groupBy(*keys).agg(
        F.min("before").alias("__first"), (F.max(F.col("before") + F.col("cnt")) - F.min("before")).alias("__total")
    )
    return kept.join(known_small(first), list(keys)).select(
        *keys, "x", "cnt", (F.col("before") - F.col("__first")).alias("before"), F.col("__total").alias("total")
    )


def survival_grid(tail: DataFrame, keys: Sequence[str], max_points: int) -> DataFrame:
    """(keys, idx, x, s): S = (n - idx) / n at ``max_points`` evenly spaced positions, the resolution of the curve.

    Positions that coincide count once, so a short tail shows all of its points. A distinct value works out by
    itself which grid positions fall on it, so no join with the grid is needed.
    """
    n, before, after = F.col("total"), F.col("before"), F.col("before") + F.col("cnt")
    step = F.greatest((n - 1) / F.lit(float(max_points - 1)), F.lit(1e-9))
    low = F.greatest(F.lit(0), (F.floor(before / step) - 1).cast("int"))
    high = F.least(F.lit(max_points - 1), (F.ceil(after / step) + 1).cast("int"))

    def place(k):
        return F.when(k == max_points - 1, n - 1).otherwise(F.floor(k * step))

    near = F.array_distinct(F.transform(F.sequence(low, high), place))
    spaced = F.when(low > high, F.array().cast("array<bigint>")).otherwise(
        F.filter(near, lambda p: (p >= before) & (p < after))
    )
    points = tail.select(*keys, "x", "total", F.explode(spaced).alias("idx"))
    return points.select(*keys, "idx", "x", ((n - F.col("idx")) / n).alias("s"))


POINTS = 65536  # positions of one value that are listed at a time


def survival_points(tail: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, x, s): S = (n - idx) / n at every position of the tail, those of a tied value in pieces."""
    end = F.col("before") + F.col("cnt") - 1
    starts = F.explode(F.sequence(F.col("before"), end, F.lit(POINTS).cast("bigint"))).alias("start")
    pieces = tail.select(*keys, "x", "total", starts, end.alias("end"))
    places = F.explode(F.sequence(F.col("start"), F.least(F.col("end"), F.col("start") + POINTS - 1))).alias("idx")
    points = pieces.select(*keys, "x", "total", places)
    return points.select(*keys, "idx", "x", ((F.col("total") - F.col("idx")) / F.col("total")).alias("s"))


def _line(x: Column, y: Column, name: str, least: int = 3) -> list[Column]:
    """Slope and R^2 of a least-squares line; NULL below ``least`` points, R^2 NULL for a constant y."""
    enough = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= least
    r2 = F.when(F.var_pop(y) > 0, F.regr_r2(y, x))
    return [
        F.when(enough, F.regr_slope(y, x)).alias(f"{name}_slope"),
        F.when(enough, r2).alias(f"{name}_r2"),
    ]


def tail_fits(grid: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Slopes and R^2 of log S on x, log S on log x and log(-log S) on log x.

    ``strict`` uses only 0 < S < 1 and x > 0; a group of fewer than 8 such points keeps its row without fits.
    Otherwise values are clipped at 1e-12.
    """
    if strict:
        inside = (F.col("x") > 0) & (F.col("s") > 0) & (F.col("s") < 1)
        grid = grid.select(*keys, F.when(inside, F.col("x")).alias("x"), F.when(inside, F.col("s")).alias("s"))
        lx, ls = F.log("x"), F.log("s")
        lls = F.log(-ls)
    else:
        lx, ls = F.log(clip("x", 1e-12)), F.log(clip("s", 1e-12, 1.0))
        lls = F.log(clip(-ls, 1e-12))
    table = grid.select(*keys, "x", lx.alias("lx"), ls.alias("ls"), lls.alias("lls"))
    least = 8 if strict else 3
    return table.groupBy(*keys).agg(
        F.count("ls").alias("n_points"),
        *_line(F.col("x"), F.col("ls"), "semilog", least),
        *_line(F.col("lx"), F.col("ls"), "loglog", least),
        *_line(F.col("lx"), F.col("lls"), "weibull", least),
    )


def tail_class(semilog_r2="semilog_r2", loglog_r2="loglog_r2", weibull_r2="weibull_r2", weibull_slope="weibull_slope") -> Column:
    """Label from R^2 >= 0.97 and the Weibull slope."""
    good = 0.97  # fixed values: this threshold, the slope bounds 1.8 and 0.9, and the labels
    exponential = F.lit("sub_exponential_or_sub_gamma_like")
    return (
        F.when(F.col(loglog_r2) >= good, "power_law_like_heavy_tail")
        .when((F.col(weibull_r2) >= good) & (F.col(weibull_slope) >= 1.8), "sub_gaussian_like")
        .when((F.col(weibull_r2) >= good) & (F.col(weibull_slope) >= 0.9), exponential)
        .when((F.col(weibull_r2) >= good) & F.col(weibull_slope).isNotNull(), "sub_weibull_like")
        .when(F.col(semilog_r2) >= good, exponential)
        .otherwise("mixed_or_unclear")
    )


TAIL_CODES = {  # fixed values
    "power_law_like_heavy_tail": 1.0,
    "sub_weibull_like": 2.0,
    "sub_exponential_or_sub_gamma_like": 3.0,
    "sub_gaussian_like": 4.0,
    "mixed_or_unclear": 5.0,
}


def tail_code(label: str) -> Column:
    code = F.lit(None).cast("double")
    for name, number in TAIL_CODES.items():
        code = F.when(F.col(label) == name, F.lit(number)).otherwise(code)
    return code


LEAST_TAIL = 12  # fixed value: points that a tail needs


def tail_or_whole(tail: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """The tail between two of its quantiles, or the whole of it where that has fewer than 12 points."""
    part = quantile_slice(tail, keys, low, high)
    long = known_small(part.groupBy(*keys).agg(F.first("total").alias("__points")).where(F.col("__points") >= LEAST_TAIL))
    return part.join(long, list(keys), "left_semi").unionByName(tail.join(long, list(keys), "left_anti"))


def tail_shape(rows: DataFrame, keys: Sequence[str], value: str, low: float = 0.90, high: float = 0.999) -> DataFrame:
    """Fits and label of the upper tail between two quantiles of the positive centred values, over all its points."""
    tail = quantile_slice(positive_tail(rows, keys, value), keys, low, high)
    return tail_fits(survival_points(tail, keys), keys).withColumn("label", tail_class())


def tail_shape_strict(rows: DataFrame, keys: Sequence[str], value: str, low: float = 0.90, high: float = 0.999) -> DataFrame:
    """One row per group, with strict fits, label and label code; NULL where a group has too few points.

    The whole positive tail stands in for a slice of fewer than 12 points, and 12 of them are needed.
    """
    tail = cut_lineage(positive_tail(rows, keys, value))
    enough = known_small(tail.groupBy(*keys).agg(F.first("total").alias("__points")).where(F.col("__points") >= LEAST_TAIL))
    used = tail_or_whole(tail.join(enough.drop("__points"), list(keys), "left_semi"), keys, low, high)
    fits = tail_fits(survival_points(used, keys), keys, strict=True)
    fits = fits.withColumn("label", F.when(F.col("n_points") >= 8, tail_class()))
    fits = fits.withColumn("label_code", tail_code("label"))
    return rows.select(*keys).distinct().join(fits, list(keys), "left")


def length_ablation(rows: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """(target, n, mean, std, label, fits, mgf_mse): the same diagnostics on each target column."""
    stacked = rows.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(c).alias("y")) for n, c in targets.items()])).alias("t")
    ).select("t.*")
    basic = stacked.where(finite("y")).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")
    )
    fits = tail_fits(survival_points(positive_tail(stacked, ["target"], "y"), ["target"]), ["target"])
    fits = fits.withColumn(
        "label", F.when(F.col("n_points") < 6, "insufficient_data").otherwise(tail_class())
    )
    curve = log_mgf_curve(stacked, ["target"], "y", linspace(0.01, 0.30, 30))
    quad = mgf_fits(curve, ["target"], 30).where("interval = 'full'").select("target", F.col("quadratic_mse").alias("mgf_mse"))
    return (
        basic.join(fits.select("target", "label", "semilog_r2", "loglog_r2", "weibull_r2"), "target", "left")
        .join(quad, "target", "left")
    )


# --- dependence --------------------------------------------------------------------------------


SEQUENCE_SLICE = 4096  # positions of a sequence in one window


def autocorrelation(
    rows: DataFrame, sequence: Sequence[str], pos: str, value: str, lags: Sequence[int], total: str
) -> DataFrame:
    """(sequence, lag, acf): correlation of x[:-lag] and x[lag:]; NULL if too short or constant.

    A sequence is cut into slices of positions, each with the first rows of the next one as far as the largest lag
    reaches; all lags are looked up inside a slice and folded there, so a value is shuffled once whatever the number
    of lags. Pairs with a NULL or a missing position count nothing.
    """
    length = max(SEQUENCE_SLICE, 4 * max(lags))
    own = F.floor(F.col(pos) / length)
    reached = (own > 0) & (F.col(pos) % length < max(lags))
    homes = F.when(reached, F.array(own, own - 1)).otherwise(F.array(own))
    sliced = rows.select(
        *sequence, F.col(pos).cast("bigint").alias("__p"), F.col(value).alias("__a"), F.col(total).alias("__n"), F.explode(homes).alias("__slice")
    )
    ahead = Window.partitionBy(*sequence, "__slice").orderBy("__p")
    found = F.array(*[F.struct(F.lit(k).alias("lag"), F.first("__a").over(ahead.rangeBetween(k, k)).alias("__b")) for k in lags])
    pairs = sliced.withColumn("__found", found).where(F.floor(F.col("__p") / length) == F.col("__slice"))
    pairs = pairs.select(*sequence, "__a", "__n", F.inline("__found")).where(F.col("__n") > F.col("lag") + 1)
    paired = pairs.where("__a IS NOT NULL AND __b IS NOT NULL")
    ok = (F.var_pop("__a") > 0) & (F.var_pop("__b") > 0)
    corr = F.when(ok, F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")))
    return paired.groupBy(*sequence, "lag").agg(corr.alias("acf"))


def block_mean_variance(
    rows: DataFrame, sequence: Sequence[str], pos: str, value: str, sizes: Sequence[int], total: str
) -> DataFrame:
    """(sequence, block_size, variance) of the means of full blocks; needs two of them."""
    sized = rows.withColumn("block_size", F.explode(F.array(*[F.lit(b) for b in sizes])))
    blocks = F.floor(F.col(total) / F.col("block_size"))
    sized = sized.withColumn("__b", F.floor(F.col(pos) / F.col("block_size")))
    kept = sized.where((blocks >= 2) & (F.col("__b") < blocks))
    means = kept.groupBy(*sequence, "block_size", "__b").agg(F.avg(value).alias("__m"))
    return means.groupBy(*sequence, "block_size").agg(F.var_samp("__m").alias("variance"))


def poisson_bounds() -> list[float]:
    """Where a uniform number passes from a Poisson(1) count to the next; they end where 32 bits do."""
    cumulative, term = math.exp(-1.0), math.exp(-1.0)
    bounds = []
    for k in range(1, 13):
        bounds.append(cumulative)
        term /= k
        cumulative += term
    return bounds


def poisson_weight(u) -> Column:
    """Poisson(1) count by inversion of a uniform number of 32 bits."""
    bounds = poisson_bounds()
    count = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        count = F.when(u < F.lit(bounds[k]), F.lit(k)).otherwise(count)
    return count


def _poisson_counts():
    """Function from uniform numbers of 32 bits, as integers, to their Poisson(1) counts, by inversion."""
    bounds = np.array(poisson_bounds()) * 2.0**32
    edges = np.arange(65537, dtype=np.float64) * 65536
    table = np.searchsorted(bounds, edges[:-1], side="right").astype(np.uint8)
    table[table != np.searchsorted(bounds, edges[1:] - 1, side="right")] = 255  # a bound lies in between

    def counts(u: np.ndarray) -> np.ndarray:
        out = table[u >> np.uint32(16)]
        between = np.flatnonzero(out == 255)
        out[between] = np.searchsorted(bounds, u[between].astype(np.float64), side="right")
        return out

    return counts


BOOT_ROWS = 1 << 17  # rows whose repeats a task draws at a time


def _repeat_sums(keys: int, repeats: int):
    """Batches of (keys, value, h, s) to (keys, rep, sum of value * weight, sum of weights) of runs of BOOT_ROWS rows."""

    def summed(table: pa.Table, counts) -> pa.RecordBatch:
        group = np.zeros(len(table), np.int64)
        for k in range(keys):
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group = pd.factorize(group * (int(codes.max()) + 1) + codes)[0]
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        value, h, s = (table.column(keys + k).to_numpy()[order] for k in range(3))
        u, s = h.astype(np.uint32), s.astype(np.uint32)
        sums, weights = np.empty((repeats, len(starts))), np.empty((repeats, len(starts)), np.int64)
        for rep in range(repeats):
            w = counts(u)
            sums[rep] = np.add.reduceat(w * value, starts)
            weights[rep] = np.add.reduceat(w, starts, dtype=np.int64)
            u = u + s  # modulo 2^32
        first = pa.array(np.tile(order[starts], repeats))
        columns = [table.column(k).combine_chunks().take(first) for k in range(keys)]
        columns += [pa.array(np.repeat(np.arange(repeats, dtype=np.int32), len(starts))), pa.array(sums.ravel()), pa.array(weights.ravel())]
        return pa.RecordBatch.from_arrays(columns, [*table.column_names[:keys], "rep", "__wx", "__w"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, rows = _poisson_counts(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BOOT_ROWS:
                yield summed(pa.Table.from_batches(held), counts)
                held, rows = [], 0
        if held:
            yield summed(pa.Table.from_batches(held), counts)

    return fold


def bootstrap_width(
    rows: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], repeats: int, seed: str, name: str
) -> DataFrame:
    """95% interval width of the bootstrap mean.

    A row enters a repeat Poisson(1) times, the large-sample form of drawing n of n with replacement;
    the weighted sums are folded per (group, repeat) where the rows are. Two numbers h, s of one md5 per
    row give the uniforms of all repeats, (h + repeat * s) mod 2^32: pairwise independent between
    repeats, independent between rows.
    """
    digest = rows.where(finite(value)).select(*keys, value, sampling.hash_text(*ids, seed=seed).alias("__md5"))

    def word(start):
        return F.conv(F.substring("__md5", start, 8), 16, 10).cast("bigint")

    seeded = digest.select(*keys, F.col(value).cast("double"), word(1).alias("__h"), word(9).alias("__s"))
    sums = [StructField("rep", IntegerType()), StructField("__wx", DoubleType()), StructField("__w", LongType())]
    schema = StructType([*seeded.schema.fields[: len(keys)], *sums])
    summed = seeded.mapInArrow(_repeat_sums(len(keys), repeats), schema)
    means = summed.groupBy(*keys, "rep").agg((F.sum("__wx") / F.sum("__w")).alias("m"))
    return means.groupBy(*keys).agg((F.percentile("m", 0.975) - F.percentile("m", 0.025)).alias(name))


DRAWS = 4096  # draws of a repeat that a task makes at a time


def block_bootstrap_width(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str],
    blocks: DataFrame,
    repeats: int,
    seed: str,
    name: str,
) -> DataFrame:
    """95% interval width of the block-bootstrap mean; rows are blocked in ``order``, groups without a block size have none.

    ``blocks`` is (keys, block), as :func:`bootstrap_blocks` gives it. A repeat draws ceil(n / size) block numbers, cuts
    the concatenated blocks at n and divides their sum by n. Only the last block is shorter, by ``short`` rows, so
    the draws exceed n only where it was not drawn, by ``short`` rows of the last draw: numbers of draws per block, the
    last draw and two sums per block say everything. Draws are made in pieces of DRAWS, spread over tasks.
    """
    kept = rows.where(finite(value))
    heads = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(blocks.select(*keys, F.col("block").alias("size")), list(keys))
    heads = known_small(heads.withColumn("blocks", F.ceil(F.col("n") / F.col("size"))))
    at = O.positions(kept, keys, order).join(heads, list(keys))
    short = F.col("blocks") * F.col("size") - F.col("n")
    whole = F.col("pos") % F.col("size") < F.col("size") - short
    sums = at.groupBy(*keys, F.floor(F.col("pos") / F.col("size")).alias("block")).agg(
        F.sum(value).alias("__sum"), F.sum(F.when(whole, F.col(value)).otherwise(0.0)).alias("__kept")
    )
    last = F.col("blocks") - 1
    pieces = heads.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / DRAWS))))
    numbers = F.sequence(F.col("piece") * DRAWS, F.least(last, F.col("piece") * DRAWS + DRAWS - 1))
    # the pieces are few and short, the draws made of them are not: without a number of tasks they would share one
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = pieces.repartition(tasks, *keys, "rep", "piece").withColumn("draw", F.explode(numbers))
    draws = draws.withColumn("block", sampling.hash_int(*keys, "rep", "draw", seed=seed) % F.col("blocks"))
    draws = draws.select(*keys, "rep", "block", (F.col("draw") == last).alias("__final"), (F.col("block") == last).alias("__last"))
    # a task holds its share of the blocks, the draws pass by
    repeated = draws.join(sums.hint("shuffle_hash"), [*keys, "block"]).groupBy(*keys, "rep")
    cut = F.sum(F.when(F.col("__final"), F.col("__sum") - F.col("__kept")))
    means = repeated.agg((F.sum("__sum") - F.when(F.bool_or("__last"), 0.0).otherwise(cut)).alias("__total"))
    means = means.join(heads, list(keys)).select(*keys, (F.col("__total") / F.col("n")).alias("m"))
    return means.groupBy(*keys).agg((F.percentile("m", 0.975) - F.percentile("m", 0.025)).alias(name))


LEAST_ROWS = 30  # fixed value: rows a group needs for a bootstrap


def bootstrap_blocks(rows: DataFrame, keys: Sequence[str], value: str, source: str | None = None) -> DataFrame:
    """(keys, rows, block): block size of each group of at least 30 rows, 2 at least.

    The median number of rows of a source where any row names one, else the rounded root of the rows.
    """
    kept = rows.where(finite(value))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LEAST_ROWS)
    root = F.bround(F.sqrt("rows"), 0)
    if source is None:
        return sizes.withColumn("block", F.greatest(F.lit(2), root).cast("bigint"))
    named = F.trim(F.coalesce(F.col(source).cast("string"), F.lit("")))
    per = kept.withColumn("__s", named).groupBy(*keys, "__s").agg(F.count(F.lit(1)).cast("double").alias("__c"))
    ranked = O.exact_quantiles(per, keys, "__c", {"__median": 0.5})
    any_named = per.groupBy(*keys).agg(F.bool_or(F.col("__s") != "").alias("__any"))
    wanted = F.when(F.col("__any"), F.floor("__median")).otherwise(root)
    return sizes.join(ranked, list(keys)).join(any_named, list(keys)).select(
        *keys, "rows", F.greatest(F.lit(2), wanted).cast("bigint").alias("block")
    )


# --- sampling of tokens ------------------------------------------------------------------------


def token_subsample(
    tokens: DataFrame, sample: Sequence[str], pos: Sequence[str], rate: float, cap: int, seed: str = "token"
) -> DataFrame:
    """Tokens whose hash is at most ``rate``, the first ``cap`` of them per sample."""
    kept = tokens.where(sampling.uniform(*sample, *pos, seed=seed) <= rate)
    return first_per_key(kept, sample, pos, cap)


def sequence_probe(
    tokens: DataFrame, sample: Sequence[str], pos: Sequence[str], rate: float, first: int, seed: str = "probe"
) -> DataFrame:
    """The first tokens of the samples whose hash is at most ``rate``."""
    return first_per_key(tokens.where(sampling.uniform(*sample, seed=seed) <= rate), sample, pos, first)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """First ``count`` rows per key; a rank bound lets every task drop the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= count).drop("__rank")


# --- tables ------------------------------------------------------------------------------------


def full_grid(dimensions: Mapping[str, Sequence[str]], spark) -> DataFrame:
    """Every combination of the named experiment keys, as rows."""
    grid = spark.range(1)
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


def observed_grid(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every combination of the observed values of each key; keys are experiment dimensions, the grid is the result."""
    grid = None
    for n in names:
        values = rows.select(n).where(F.col(n).isNotNull()).distinct().withColumn("__k", F.lit(1))
        grid = values if grid is None else grid.join(values, "__k")
    return grid.drop("__k")


def on_grid(grid: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metrics on the full grid, NULL where a combination is missing."""
    return grid.join(metrics, list(names), "left")


def wide_losses(rows: DataFrame, keys: Sequence[str], task: str, tasks: Sequence[str], loss: str) -> DataFrame:
    """One row per key with a loss column per task; only rows with status ok count."""
    return (
        rows.where("status = 'ok'").groupBy(*keys).pivot(task, list(tasks)).agg(F.first(loss, ignorenulls=True))
    )


def first_wins(rows: DataFrame, keys: Sequence[str], source_rank: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of the earliest source per key, as an aggregate."""
    return O.first_by(rows, keys, [F.col(c) for c in source_rank], columns)


def hypothesis_report(
    tail_label: Column, coverage: Column, best_mse: Column, p95_mean: Column, p95_catoni: Column, p95_mom: Column,
    pooled_var: Column, domain_ratio: Column, length_ratio: Column, dependence_ratio: Column, dependence_p90: Column,
) -> Column:
    """Array of (hypothesis, evidence) that the summaries support; ``mixed`` without evidence when none does.

    A rule needs all of its numbers: a missing one leaves the hypothesis out.
    """

    def known(*numbers):
        out = finite(numbers[0])
        for n in numbers[1:]:
            out = out & finite(n)
        return out

    rules = [
        ("sub-gamma/Bernstein",
         tail_label.isin("sub_exponential_or_sub_gamma_like", "sub_gaussian_like") & known(coverage) & (coverage >= 0.75),
         {"mean_empirical_coverage": coverage, "best_subgamma_mse": best_mse}),
        ("heavy_finite_variance_robust_mean",
         known(p95_mean, p95_catoni, p95_mom) & (p95_mean > 1.15 * F.least(p95_catoni, p95_mom)),
         {"p95_mean": p95_mean, "p95_catoni": p95_catoni, "p95_mom": p95_mom}),
        ("conditional_bernstein_subgamma",
         known(domain_ratio, length_ratio) & ((domain_ratio < 0.9) | (length_ratio < 0.9)),
         {"pooled_var": pooled_var, "domain_variance_ratio": domain_ratio, "length_variance_ratio": length_ratio}),
        ("dependence_present",
         known(dependence_ratio) & (dependence_ratio >= 1.2),
         {"mean_ordered_vs_naive_ratio": dependence_ratio, "p90_ordered_vs_naive_ratio": dependence_p90}),
    ]

    def item(name, evidence):
        pairs = [x for n, c in evidence.items() for x in (F.lit(n), c.cast("double"))]
        numbers = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return F.struct(F.lit(name).alias("hypothesis"), numbers.alias("evidence"))

    found = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), item(n, e)) for n, c, e in rules]), lambda x: x.isNotNull()
    )
    return F.when(F.size(found) == 0, F.array(item("mixed", {}))).otherwise(found)

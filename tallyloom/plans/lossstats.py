"""Loss-distribution diagnostics over token losses derived from ``lineitem`` and sequences from ``events``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyloom.functions import sampling
from tallyloom.functions.numeric import linspace
from tallyloom.operators import lossstats as L
from tallyloom.operators import ordering as O
from tallyloom.plans.fixtures import CTE, NEEDS, sql_hash, sql_uniform, table, tokens, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.registry import query
from tallyloom.session import cut_lineage

TOKEN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]
Q = {"q90": 0.90, "q95": 0.95, "q99": 0.99}


def samples(spark, sf_dir):
    """(combo, sample_idx, ti, li, lbar)"""
    rolled = L.sample_rollup(tokens(spark, sf_dir), ["combo", "sample_idx"], "u")
    return rolled.withColumn("lbar", F.round("lbar", 9))


def stored_samples(spark, sf_dir):
    """The sample statistics as a collection run leaves them: a written table, read as often as needed."""
    return cut_lineage(samples(spark, sf_dir))


@query(
    "sample_rollup",
    "ST1",
    with_ctes("smp", "SELECT combo, sample_idx, ti, round(li, 9) AS li, lbar FROM smp"),
)
def sample_rollup(spark, sf_dir):
    return rounded(samples(spark, sf_dir), "li", digits=9)


@query(
    "dataset_mean_loss",
    "ST2 PRJ11",
    with_ctes(
        "tok",
        """, b AS (SELECT combo, sample_idx, count(*) AS tok, avg(u) AS loss, bool_or(l_linenumber = 7) AS bad FROM tok GROUP BY ALL)
SELECT combo, round(sum(loss * tok) FILTER (NOT bad) / sum(tok) FILTER (NOT bad), 9) AS mean_loss,
  (sum(tok) FILTER (NOT bad))::BIGINT AS n_tokens, count(*) FILTER (NOT bad) AS n_used, count(*) FILTER (bad) AS n_skipped
FROM b GROUP BY combo""",
    ),
)
def dataset_mean_loss(spark, sf_dir):
    batches = (
        tokens(spark, sf_dir)
        .groupBy("combo", "sample_idx")
        .agg(
            F.count(F.lit(1)).alias("tok"),
            F.avg(F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("u"))).alias("loss"),
        )
    )
    return rounded(L.weighted_mean_loss(batches, ["combo"], "loss", "tok"), "mean_loss", digits=9)


for _name, _shift in (("loss_variance_shifted", True), ("loss_variance_plain", False)):
    _sql = with_ctes(
        "tok",
        f""", s AS (SELECT combo, sample_idx, u, row_number() OVER (PARTITION BY combo, sample_idx
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM tok),
m AS (SELECT combo, sample_idx, avg(u) AS m FROM s {"WHERE p > 1" if _shift else ""} GROUP BY ALL)
SELECT combo, count(*) AS n, round(avg(m), 9) AS mean, round(var_pop(m), 9) AS variance FROM m GROUP BY combo""",
    )

    def _build(spark, sf_dir, shift=_shift):
        out = L.loss_variance(tokens(spark, sf_dir), ["combo"], "sample_idx", "u", TOKEN_ORDER, shift)
        return rounded(out, "mean", "variance", digits=9)

    query(_name, "ST3", _sql)(_build)


CTE["binned"] = """
SELECT smp.*, greatest(1, len(list_filter(e.edges, lambda x: x < ti))) AS len_bin
FROM smp CROSS JOIN (SELECT list_distinct([quantile_cont(ti::DOUBLE, 0.0), quantile_cont(ti::DOUBLE, 0.25),
  quantile_cont(ti::DOUBLE, 0.5), quantile_cont(ti::DOUBLE, 0.75), quantile_cont(ti::DOUBLE, 1.0)]) AS edges FROM smp) e"""
CTE["cond"] = """
SELECT group_col, group_value, count(*) AS n, avg(lbar) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE var_samp(lbar) END AS var,
  quantile_cont(lbar, 0.90) AS q90, quantile_cont(lbar, 0.95) AS q95, quantile_cont(lbar, 0.99) AS q99
FROM (SELECT 'pooled' AS group_col, 'all' AS group_value, lbar FROM binned
  UNION ALL SELECT 'length_bin', len_bin::VARCHAR, lbar FROM binned
  UNION ALL SELECT 'domain', combo, lbar FROM binned
  UNION ALL SELECT 'difficulty', CASE WHEN sample_idx % 2 = 0 THEN '1' ELSE '0' END || '_code_' ||
     CASE WHEN sample_idx % 3 = 0 THEN '1' ELSE '0' END || '_math', lbar FROM binned) GROUP BY ALL"""
NEEDS.update({"binned": ("smp",), "cond": ("binned",)})


def conditional(spark, sf_dir):
    binned = L.quantile_bins(
        samples(spark, sf_dir).withColumn("k", F.lit(0)).withColumn("tid", F.col("ti").cast("double")), ["k"], "tid", 4, "len_bin"
    )

    def flag(divisor):
        return F.when(F.col("sample_idx") % divisor == 0, "1").otherwise("0")

    groups = {
        "pooled": F.lit("all"),
        "length_bin": F.col("len_bin"),
        "domain": F.col("combo"),
        "difficulty": F.concat(flag(2), F.lit("_code_"), flag(3), F.lit("_math")),
    }
    return L.conditional_summary(binned, groups, "lbar")


@query(
    "conditional_summary",
    "ST4 WIN5",
    with_ctes(
        "cond",
        """SELECT group_col, group_value, n, round(mean, 8) AS mean, round(var, 8) AS var, round(q90, 8) AS q90,
  round(q95, 8) AS q95, round(q99, 8) AS q99 FROM cond""",
    ),
)
def conditional_summary(spark, sf_dir):
    return rounded(conditional(spark, sf_dir).drop("std"), "mean", "var", "q90", "q95", "q99", digits=8)


@query(
    "variance_ratios",
    "ST5",
    with_ctes(
        "cond",
        """SELECT group_col, round(avg(var), 8) AS mean_var, round(any_value(p.pv), 8) AS pooled_var, round(avg(var) / any_value(p.pv), 8) AS ratio
FROM cond CROSS JOIN (SELECT var AS pv FROM cond WHERE group_col = 'pooled') p WHERE group_col <> 'pooled' GROUP BY group_col""",
    ),
)
def variance_ratios(spark, sf_dir):
    return rounded(L.variance_ratios(conditional(spark, sf_dir)), "mean_var", "pooled_var", "ratio", digits=8)


@query(
    "combo_metrics",
    "ST6",
    with_ctes(
        "smp",
        """, a AS (SELECT combo, sample_idx, count(*) AS n, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS acf
 FROM (SELECT combo, sample_idx, u AS x, lead(u) OVER (PARTITION BY combo, sample_idx ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM tok)
 WHERE y IS NOT NULL GROUP BY ALL),
s AS (SELECT combo, count(*) AS n, avg(lbar) AS mean, stddev_pop(lbar) AS std, quantile_cont(lbar, 0.90) AS q90, quantile_cont(lbar, 0.95) AS q95,
  quantile_cont(lbar, 0.99) AS q99 FROM smp GROUP BY combo),
t AS (SELECT combo, avg(u) AS token_mean, stddev_pop(u) AS token_std, quantile_cont(u, 0.95) AS token_q95, quantile_cont(u, 0.99) AS token_q99 FROM tok GROUP BY combo),
c AS (SELECT combo, avg(acf) AS acf_lag1_mean FROM a GROUP BY combo)
SELECT combo, n, round(mean, 8) AS mean, round(std, 8) AS std, round(q90, 8) AS q90, round(q95, 8) AS q95, round(q99, 8) AS q99,
 round(token_mean, 8) AS token_mean, round(token_std, 8) AS token_std, round(token_q95, 8) AS token_q95, round(token_q99, 8) AS token_q99,
 round(acf_lag1_mean, 6) AS acf_lag1_mean FROM s JOIN t USING (combo) JOIN c USING (combo)""",
    ),
)
def combo_metrics(spark, sf_dir):
    toks = tokens(spark, sf_dir)
    sample = L.moments_and_quantiles(samples(spark, sf_dir), ["combo"], "lbar", Q).drop("var")
    token = L.moments_and_quantiles(toks, ["combo"], "u", {"token_q95": 0.95, "token_q99": 0.99}).select(
        "combo", F.col("mean").alias("token_mean"), F.col("std").alias("token_std"), "token_q95", "token_q99"
    )
    numbered = O.positions(toks, ["combo", "sample_idx"], TOKEN_ORDER, total="t")
    # lag 1 needs two tokens more than none: the two-token floor of the general rule is lifted by one
    acf = L.autocorrelation(numbered.withColumn("t", F.col("t") + 1), ["combo", "sample_idx"], "pos", "u", [1], "t")
    mean_acf = acf.groupBy("combo").agg(F.avg("acf").alias("acf_lag1_mean"))
    out = sample.join(token, "combo").join(mean_acf, "combo")
    out = rounded(out, "mean", "std", "q90", "q95", "q99", "token_mean", "token_std", "token_q95", "token_q99", digits=8)
    return rounded(out, "acf_lag1_mean")


@query(
    "trimmed_mean",
    "ST7",
    with_ctes(
        "smp",
        """, r AS (SELECT combo, lbar, row_number() OVER (PARTITION BY combo ORDER BY lbar) - 1 AS p, count(*) OVER (PARTITION BY combo) AS n FROM smp),
k AS (SELECT *, greatest(0, least(n // 2 - 1, floor(0.1::DOUBLE * n))) AS k FROM r)
SELECT combo, round(avg(lbar), 8) AS trimmed FROM k WHERE p >= k AND p < n - k GROUP BY combo""",
    ),
)
def trimmed_mean(spark, sf_dir):
    ranked = O.ranked_values(samples(spark, sf_dir), ["combo"], "lbar")
    return rounded(O.trimmed_means(ranked, ["combo"], "lbar", 0.1, "trimmed"), "trimmed", digits=8)


@query(
    "median_of_means",
    "ST8",
    with_ctes(
        "smp",
        f""", r AS (SELECT combo, lbar, ntile(8) OVER (PARTITION BY combo ORDER BY {sql_hash("combo || ':' || sample_idx", "mom")}, combo, sample_idx) AS b FROM smp),
m AS (SELECT combo, b, avg(lbar) AS m FROM r GROUP BY ALL)
SELECT combo, round(median(m), 8) AS mom FROM m GROUP BY combo""",
    ),
)
def median_of_means(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = L.median_of_means(rows, ["combo"], "lbar", ["combo", "sample_idx"], 8, "mom", "mom")
    return rounded(out, "mom", digits=8)


@query(
    "catoni_mean",
    "ST9",
    "WITH RECURSIVE "
    + with_ctes("smp", "")[5:].rstrip()
    + """, d AS (SELECT combo, list(lbar) AS x, avg(lbar) AS m, 1 / (2 * (stddev_pop(lbar) + 1e-12)) AS a FROM smp GROUP BY combo),
it AS (SELECT combo, 0 AS k, m FROM d UNION ALL
  SELECT it.combo, k + 1, it.m - list_avg(list_transform(x, lambda v: (exp(2 * a * (v - it.m)) - 1) / (exp(2 * a * (v - it.m)) + 1)))
    / (-a * list_avg(list_transform(x, lambda v: 1 - ((exp(2 * a * (v - it.m)) - 1) / (exp(2 * a * (v - it.m)) + 1)) ** 2)) - 1e-12)
  FROM it JOIN d USING (combo) WHERE k < 12)
SELECT combo, round(m, 7) AS catoni FROM it WHERE k = 12""",
)
def catoni_mean(spark, sf_dir):
    return rounded(L.catoni_means(stored_samples(spark, sf_dir), ["combo"], "lbar", "catoni"), "catoni", digits=7)


def scatter_sql(x: str, seed: str) -> str:
    """Columns that scatter ``x`` as the operator does, the result being ``y``."""
    bits, (first, second) = 1 << L.SCATTER_BITS, L.SCATTER_SHIFTS
    names, columns = [f"{x} // v", f"{x} % v"], []
    for k, (key, one, two) in enumerate(L.SCATTER_ROUNDS):
        own, other, width = names[k % 2], names[1 - k % 2], "uv"[k % 2]
        columns += [
            f"((({other} + (rep + 1) * {key} + {L.seed_number(seed)}) % {bits}) * {one}) % {bits} AS a{k}",
            f"(xor(a{k}, a{k} >> {first}) * {two}) % {bits} AS b{k}",
            f"xor({own}, xor(b{k}, b{k} >> {second}) % {width}) AS h{k}",
        ]
        names[k % 2] = f"h{k}"
    return ", ".join([*columns, f"{names[0]} * v + {names[1]} AS y"])


def subsample_sql(n: str, repeats: int, seed: str) -> str:
    """Table expressions halves and sub (rep, pos, combo, sample_idx, lbar) as the operator draws them (recursive)."""
    return f"""halves AS (SELECT count(*) AS big, least({n}, count(*)) AS n, 1::BIGINT << (length(bin(count(*) - 1)) // 2) AS u,
  1::BIGINT << (length(bin(count(*) - 1)) - length(bin(count(*) - 1)) // 2) AS v FROM smp),
draws AS (SELECT rep, big, u, v, unnest(range(n)) AS t FROM halves CROSS JOIN generate_series(0, {repeats - 1}) a(rep)),
walk AS (SELECT rep, big, u, v, t, y FROM (SELECT *, {scatter_sql("t", seed)} FROM draws)
  UNION ALL SELECT rep, big, u, v, t, y FROM (SELECT * EXCLUDE (y0), {scatter_sql("y0", seed)} FROM (SELECT * RENAME (y AS y0) FROM walk WHERE y >= big))),
sub AS (SELECT rep::INTEGER AS rep, t AS pos, s.* EXCLUDE (p) FROM walk JOIN
  (SELECT *, row_number() OVER (ORDER BY combo, sample_idx) - 1 AS p FROM smp) s ON p = y WHERE y < big)"""


ROBUST_N, ROBUST_REPEATS = 512, 400


def robust_sql(estimators: str, tail: str) -> str:
    """Robust-mean experiment over the drawn samples; the M-estimator takes its Newton steps over lists."""
    return (
        "WITH RECURSIVE "
        + with_ctes("smp", ", " + subsample_sql(str(ROBUST_N), ROBUST_REPEATS, "robust"))[5:]
        + f""", f AS (SELECT avg(lbar) AS mu, quantile_cont(lbar, 0.999) AS top FROM smp),
v AS (SELECT 'asis' AS kind, rep, pos, lbar FROM sub
  UNION ALL SELECT 'inj', rep, pos, CASE WHEN pos = {ROBUST_N - 1} THEN top ELSE lbar END FROM sub CROSS JOIN f
  UNION ALL SELECT 'rm', rep, row_number() OVER (PARTITION BY rep ORDER BY lbar) - 1, lbar FROM sub
     QUALIFY row_number() OVER (PARTITION BY rep ORDER BY lbar) < {ROBUST_N}),
w AS (SELECT *, row_number() OVER (PARTITION BY kind, rep ORDER BY lbar) - 1 AS r, count(*) OVER (PARTITION BY kind, rep) AS n,
  ntile(8) OVER (PARTITION BY kind, rep ORDER BY pos) AS b FROM v),
cd AS (SELECT kind, rep, list(lbar) AS x, avg(lbar) AS m, 1 / (2 * (stddev_pop(lbar) + 1e-12)) AS a FROM v GROUP BY ALL),
ct AS (SELECT kind, rep, 0 AS k, m FROM cd UNION ALL
  SELECT ct.kind, ct.rep, k + 1, ct.m - list_avg(list_transform(x, lambda q: (exp(2 * a * (q - ct.m)) - 1) / (exp(2 * a * (q - ct.m)) + 1)))
    / (-a * list_avg(list_transform(x, lambda q: 1 - ((exp(2 * a * (q - ct.m)) - 1) / (exp(2 * a * (q - ct.m)) + 1)) ** 2)) - 1e-12)
  FROM ct JOIN cd USING (kind, rep) WHERE k < 8),
e AS (SELECT 'mean' AS estimator, kind, rep, avg(lbar) AS est FROM w GROUP BY ALL
  UNION ALL SELECT 'trimmed_mean', kind, rep, avg(lbar) FROM w WHERE r >= floor(0.1::DOUBLE * n) AND r < n - floor(0.1::DOUBLE * n) GROUP BY ALL
  UNION ALL SELECT 'median_of_means', kind, rep, median(m) FROM (SELECT kind, rep, b, avg(lbar) AS m FROM w GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 'catoni', kind, rep, m FROM ct WHERE k = 8),
d AS (SELECT estimator, rep, abs(max(est) FILTER (kind = 'asis') - any_value(mu)) AS dev,
  abs(max(est) FILTER (kind = 'inj') - max(est) FILTER (kind = 'asis')) AS inj,
  abs(max(est) FILTER (kind = 'rm') - max(est) FILTER (kind = 'asis')) AS rm FROM e CROSS JOIN f WHERE estimator IN ({estimators}) GROUP BY ALL)
SELECT estimator, round(avg(dev), 7) AS mean_abs_dev, round(quantile_cont(dev, 0.95), 7) AS p95_abs_dev, round(max(dev), 7) AS max_abs_dev,
  round(avg(inj), 7) AS mean_inj_shift, round(avg(rm), 7) AS mean_remove_shift FROM d GROUP BY estimator{tail}"""
    )


def robust_rows(spark, sf_dir, estimators=L.ESTIMATORS):
    out = L.robust_mean_experiment(
        stored_samples(spark, sf_dir), ["combo", "sample_idx"], "lbar", ROBUST_N, ROBUST_REPEATS, estimators=estimators
    )
    return rounded(
        out, "mean_abs_dev", "p95_abs_dev", "max_abs_dev", "mean_inj_shift", "mean_remove_shift", digits=7
    )


ROBUST_SQL = robust_sql("'mean', 'trimmed_mean', 'median_of_means', 'catoni'", "")


@query("robust_mean_experiment", "ST10 ST9", ROBUST_SQL)
def robust_mean_experiment(spark, sf_dir):
    return robust_rows(spark, sf_dir)


@query("robust_mean_catoni", "ST10 ST9", robust_sql("'catoni'", ""))
def robust_mean_catoni(spark, sf_dir):
    return robust_rows(spark, sf_dir, ("catoni",))


LAMBDAS = linspace(0.01, 0.40, 40)
CTE["lams"] = "SELECT i::INTEGER AS k, 0.01::DOUBLE + (0.39::DOUBLE / 39) * i AS lam FROM generate_series(0, 39) t(i)"
CTE["curve"] = """
SELECT combo, k, lam, any_value(lam * (hi - mu)) + ln(avg(exp(lam * (lbar - hi)))) AS mgf
FROM smp JOIN (SELECT combo, avg(lbar) AS mu, max(lbar) AS hi FROM smp GROUP BY combo) b USING (combo) CROSS JOIN lams GROUP BY ALL"""
NEEDS["curve"] = ("smp", "lams")


@query(
    "log_mgf_curve",
    "ST11",
    with_ctes("curve", "SELECT combo, k, round(lam, 9) AS lam, round(mgf, 9) AS mgf, true AS stable, 0.4::DOUBLE AS stable_max FROM curve"),
)
def log_mgf_curve(spark, sf_dir):
    curve = L.log_mgf_curve(samples(spark, sf_dir), ["combo"], "lbar", LAMBDAS)
    out = curve.join(L.stable_max_lambda(curve, ["combo"]), "combo")
    return rounded(out, "lam", "mgf", "stable_max", digits=9)


@query(
    "mgf_fits",
    "ST12",
    with_ctes(
        "curve",
        """, part AS (SELECT s.interval, combo, k, lam, mgf FROM curve JOIN (VALUES ('full', 40), ('half', 20), ('quarter', 10)) s(interval, size) ON k < size),
q AS (SELECT combo, interval, count(*) AS n_points, max(lam) AS lmax, sum(lam * lam * mgf) / sum(lam * lam * lam * lam) AS a FROM part GROUP BY ALL),
qm AS (SELECT combo, interval, avg((a * lam * lam - mgf) ** 2) AS mse FROM part JOIN q USING (combo, interval) GROUP BY ALL),
g AS (SELECT part.*, ci, ci * (greatest(1e-6, 0.95 / lmax) / 99.0) AS c FROM part JOIN q USING (combo, interval) CROSS JOIN generate_series(0, 99) t(ci)),
bs AS (SELECT *, lam * lam / greatest(2 * (1 - c * lam), 1e-12) AS b FROM g),
v AS (SELECT combo, interval, ci, c, sum(b * mgf) / sum(b * b) AS v FROM bs GROUP BY ALL),
m AS (SELECT combo, interval, ci, any_value(v.v) AS v, any_value(v.c) AS c, avg((v.v * b - mgf) ** 2) AS mse FROM bs JOIN v USING (combo, interval, ci) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY combo, interval ORDER BY mse, ci) AS r FROM m)
SELECT combo, interval, n_points, round(a, 8) AS quadratic_a, round(qm.mse * 1e9, 3) AS quadratic_mse_e9, round(v, 6) AS subgamma_v, round(c, 6) AS subgamma_c
FROM q JOIN qm USING (combo, interval) JOIN best USING (combo, interval) WHERE r = 1""",
    ),
)
def mgf_fits(spark, sf_dir):
    curve = L.log_mgf_curve(samples(spark, sf_dir), ["combo"], "lbar", LAMBDAS)
    out = L.mgf_fits(curve, ["combo"], len(LAMBDAS))
    return out.select(
        "combo",
        "interval",
        "n_points",
        F.round("quadratic_a", 8).alias("quadratic_a"),
        F.round(F.col("quadratic_mse") * 1e9, 3).alias("quadratic_mse_e9"),
        F.round("subgamma_v", 6).alias("subgamma_v"),
        F.round("subgamma_c", 6).alias("subgamma_c"),
    )


BERNSTEIN_REPEATS = 300
SIZES_SQL = f"(SELECT unnest([{', '.join(map(str, L.SAMPLE_SIZES))}])::INTEGER AS n)"
# only sizes below the number of samples are drawn
USED_SIZES = f"(SELECT n FROM {SIZES_SQL} WHERE n < (SELECT count(*) FROM smp))"
BERNSTEIN_MAX = f"(SELECT max(n) FROM {USED_SIZES})"


BERNSTEIN_SQL = (
    "WITH RECURSIVE "
    + with_ctes("smp", ", " + subsample_sql(BERNSTEIN_MAX, BERNSTEIN_REPEATS, "bernstein"))[5:]
    + f""", f AS (SELECT avg(lbar) AS mu FROM smp), b AS (SELECT any_value(mu) AS mu, quantile_cont(abs(lbar - mu), 0.99) AS b FROM smp CROSS JOIN f),
h AS (SELECT rep, n, avg(lbar) AS m, var_samp(lbar) AS v FROM sub JOIN {USED_SIZES} s ON pos < n GROUP BY ALL),
r AS (SELECT rep, n, delta, abs(m - mu) AS dev, sqrt(2 * greatest(v, 0) * ln(3 / delta) / n) + 3 * b * ln(3 / delta) / n AS radius, mu, b
  FROM h CROSS JOIN b CROSS JOIN (SELECT unnest([0.1, 0.05, 0.01])::DOUBLE AS delta) d)
SELECT n, delta, round(avg(CASE WHEN dev <= radius THEN 1 ELSE 0 END), 7) AS coverage_rate, round(avg(dev), 7) AS mean_abs_dev,
  round(quantile_cont(dev, 0.95), 7) AS p95_abs_dev, round(avg(radius), 7) AS mean_radius, round(quantile_cont(radius, 0.95), 7) AS p95_radius,
  round(any_value(mu), 7) AS mu_full, round(any_value(b), 7) AS scale_b FROM r GROUP BY n, delta"""
)


@query("bernstein_coverage", "ST13", BERNSTEIN_SQL)
def bernstein_coverage(spark, sf_dir):
    out = L.bernstein_coverage(stored_samples(spark, sf_dir), ["combo", "sample_idx"], "lbar", repeats=BERNSTEIN_REPEATS)
    return rounded(
        out, "coverage_rate", "mean_abs_dev", "p95_abs_dev", "mean_radius", "p95_radius", "mu_full", "scale_b", digits=7
    )


CTE["tail"] = """
SELECT combo, x, row_number() OVER (PARTITION BY combo ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY combo) AS n
FROM (SELECT combo, lbar - avg(lbar) OVER (PARTITION BY combo) AS x FROM smp) WHERE x > 0"""
CTE["cut"] = """
SELECT combo, x, row_number() OVER (PARTITION BY combo ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY combo) AS n
FROM tail JOIN (SELECT combo, quantile_cont(x, 0.9) AS lo, quantile_cont(x, 0.999) AS hi FROM tail GROUP BY combo) b USING (combo)
WHERE x >= lo AND x <= hi"""


def grid_join_sql(source: str, points: int, key: str = "combo") -> str:
    return f"""SELECT t.{key}, t.p AS idx, t.x, (t.n - t.p) / t.n::DOUBLE AS s FROM {source} t
SEMI JOIN (SELECT {key}, CASE WHEN n <= {points} THEN k WHEN k = {points - 1} THEN n - 1 ELSE floor(k * ((n - 1) / {points - 1}.0::DOUBLE))::BIGINT END AS p
  FROM (SELECT DISTINCT {key}, n FROM {source}) CROSS JOIN generate_series(0, {points - 1}) g(k)) w ON w.{key} = t.{key} AND w.p = t.p"""


CTE["grid"] = "SELECT combo, p AS idx, x, (n - p) / n::DOUBLE AS s FROM cut"
NEEDS.update({"tail": ("smp",), "cut": ("tail",), "grid": ("cut",)})

FITS = """SELECT {k}, count(*) AS n_points, regr_slope(ls, x) AS semilog_slope, regr_r2(ls, x) AS semilog_r2, regr_slope(ls, lx) AS loglog_slope,
  regr_r2(ls, lx) AS loglog_r2, regr_slope(lls, lx) AS weibull_slope, regr_r2(lls, lx) AS weibull_r2
FROM (SELECT {k}, x, ln(greatest(x, 1e-12)) AS lx, ln(greatest(s, 1e-12)) AS ls, ln(greatest(-ln(greatest(s, 1e-12)), 1e-12)) AS lls FROM {t}) GROUP BY {k}"""
LABEL = """CASE WHEN loglog_r2 >= 0.97 THEN 'power_law_like_heavy_tail'
 WHEN weibull_r2 >= 0.97 AND weibull_slope >= 1.8 THEN 'sub_gaussian_like' WHEN weibull_r2 >= 0.97 AND weibull_slope >= 0.9 THEN 'sub_exponential_or_sub_gamma_like'
 WHEN weibull_r2 >= 0.97 THEN 'sub_weibull_like' WHEN semilog_r2 >= 0.97 THEN 'sub_exponential_or_sub_gamma_like' ELSE 'mixed_or_unclear' END"""


@query(
    "survival_curve",
    "ST14",
    with_ctes("tail", ", g AS (" + grid_join_sql("tail", 512) + ") SELECT combo, idx, round(x, 9) AS x, round(s, 9) AS s FROM g"),
)
def survival_curve(spark, sf_dir):
    tail = L.positive_tail(samples(spark, sf_dir), ["combo"], "lbar")
    return rounded(L.survival_grid(tail, ["combo"], 512), "x", "s", digits=9)


@query(
    "tail_shape",
    "ST15 ST16 FN5",
    with_ctes(
        "grid",
        ", f AS ("
        + FITS.format(k="combo", t="grid")
        + f""") SELECT combo, n_points, round(semilog_slope, 6) AS semilog_slope, round(semilog_r2, 6) AS semilog_r2, round(loglog_slope, 6) AS loglog_slope,
 round(loglog_r2, 6) AS loglog_r2, round(weibull_slope, 6) AS weibull_slope, round(weibull_r2, 6) AS weibull_r2, {LABEL} AS label FROM f""",
    ),
)
def tail_shape(spark, sf_dir):
    return rounded(
        L.tail_shape(samples(spark, sf_dir), ["combo"], "lbar"),
        "semilog_slope", "semilog_r2", "loglog_slope", "loglog_r2", "weibull_slope", "weibull_r2",
    )


def strict_sql(source: str) -> str:
    """Strict fits of the tails in ``source`` (combo, x, p, n), of the groups with 12 points."""
    return with_ctes(
        "tail cut",
        f""", src AS ({source}), used AS (SELECT combo, x, (n - p) / n::DOUBLE AS s FROM src),
w AS (SELECT * FROM used WHERE x > 0 AND s > 0 AND s < 1), f AS ("""
        + FITS.format(k="combo", t="w")
        + f"""), l AS (SELECT combo, n_points, CASE WHEN n_points >= 8 THEN weibull_slope END AS weibull_slope, CASE WHEN n_points >= 8 THEN weibull_r2 END AS weibull_r2,
  CASE WHEN n_points >= 8 THEN {LABEL} END AS label FROM f)
SELECT combo, n_points, round(weibull_slope, 6) AS weibull_slope, round(weibull_r2, 6) AS weibull_r2,
 CASE label WHEN 'power_law_like_heavy_tail' THEN 1.0::DOUBLE WHEN 'sub_weibull_like' THEN 2.0::DOUBLE WHEN 'sub_exponential_or_sub_gamma_like' THEN 3.0::DOUBLE
   WHEN 'sub_gaussian_like' THEN 4.0::DOUBLE WHEN 'mixed_or_unclear' THEN 5.0::DOUBLE END AS label_code
FROM (SELECT DISTINCT combo FROM smp) LEFT JOIN l USING (combo)""",
    )


def strict_rows(rows, low=0.90):
    out = L.tail_shape_strict(rows, ["combo"], "lbar", low)
    return rounded(out.select("combo", "n_points", "weibull_slope", "weibull_r2", "label_code"), "weibull_slope", "weibull_r2")


@query(
    "tail_shape_strict",
    "ST15 ST16",
    strict_sql("""SELECT * FROM cut WHERE n >= 12
  UNION ALL SELECT * FROM tail WHERE n >= 12 AND combo NOT IN (SELECT combo FROM cut WHERE n >= 12)"""),
)
def tail_shape_strict(spark, sf_dir):
    return strict_rows(samples(spark, sf_dir))


@query(
    "tail_shape_fallback",
    "ST15 ST16",
    strict_sql("SELECT * FROM tail WHERE n >= 12"),
)
def tail_shape_fallback(spark, sf_dir):
    """A slice so thin that it has fewer than 12 points in every group: the whole positive tail is fitted."""
    return strict_rows(samples(spark, sf_dir), low=0.999)


@query(
    "length_ablation",
    "ST17",
    with_ctes(
        "smp",
        """, st AS (SELECT 'Li_raw_total' AS target, round(li, 9) AS y FROM smp UNION ALL SELECT 'Lbar_i_normalized', lbar FROM smp),
tl AS (SELECT target, x, row_number() OVER (PARTITION BY target ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY target) AS n
  FROM (SELECT target, y - avg(y) OVER (PARTITION BY target) AS x FROM st) WHERE x > 0),
g AS ("""
        + "SELECT target, p AS idx, x, (n - p) / n::DOUBLE AS s FROM tl"
        + "), f AS ("
        + FITS.format(k="target", t="g")
        + f"""), cv AS (SELECT target, 0.01::DOUBLE + (0.29::DOUBLE / 29) * i AS lam, any_value((0.01::DOUBLE + (0.29::DOUBLE / 29) * i) * (hi - mu)) + ln(avg(exp((0.01::DOUBLE + (0.29::DOUBLE / 29) * i) * (y - hi)))) AS mgf
  FROM st JOIN (SELECT target, avg(y) AS mu, max(y) AS hi FROM st GROUP BY target) USING (target) CROSS JOIN generate_series(0, 29) t(i) GROUP BY target, i),
qa AS (SELECT target, sum(lam * lam * mgf) / sum(lam ** 4) AS a FROM cv GROUP BY target),
qm AS (SELECT target, avg((a * lam * lam - mgf) ** 2) AS mse FROM cv JOIN qa USING (target) GROUP BY target),
b AS (SELECT target, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM st GROUP BY target)
SELECT target, n, round(mean, 7) AS mean, round(std, 7) AS std, {LABEL} AS label, round(semilog_r2, 6) AS semilog_r2, round(loglog_r2, 6) AS loglog_r2,
  round(weibull_r2, 6) AS weibull_r2, round(mse, 7) AS mgf_mse FROM b JOIN f USING (target) JOIN qm USING (target)""",
    ),
)
def length_ablation(spark, sf_dir):
    rows = rounded(samples(spark, sf_dir), "li", digits=9)
    out = L.length_ablation(rows, {"Li_raw_total": "li", "Lbar_i_normalized": "lbar"})
    out = rounded(out, "mean", "std", "mgf_mse", digits=7)
    return rounded(out, "semilog_r2", "loglog_r2", "weibull_r2")


BOOT = 300
_CUTS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k)) for k in range(1, 13)]
POISSON_SQL = "CASE " + " ".join(f"WHEN u < {cut!r} THEN {k}" for k, cut in enumerate(_CUTS)) + " ELSE 12 END"


def blocks_sql(size: str) -> str:
    """Table expression bk (combo, n, size, blocks) of the groups with 30 rows."""
    return f"bk AS (SELECT *, (n + size - 1) // size AS blocks FROM (SELECT combo, count(*) AS n, greatest(2, {size})::BIGINT AS size FROM smp GROUP BY combo HAVING count(*) >= 30))"


def block_width_sql(order: str, name: str) -> str:
    """Table expressions o_, dr_, ln_, tk_, bm_ and {name} (combo, width) of the block bootstrap in an order."""
    x = name
    return f"""o_{x} AS (SELECT combo, lbar, row_number() OVER (PARTITION BY combo ORDER BY {order}) - 1 AS p FROM smp),
pf_{x} AS (SELECT combo, p + 1 AS p, sum(lbar) OVER (PARTITION BY combo ORDER BY p) AS s FROM o_{x} UNION ALL SELECT combo, 0, 0 FROM bk),
dr_{x} AS (SELECT * REPLACE ((('0x' || substr(md5('blocks:' || combo || ':' || rep || ':' || draw), 1, 8))::BIGINT) % blocks AS block)
  FROM (SELECT combo, n, size, blocks, rep, unnest(range(blocks)) AS draw, 0 AS block FROM bk CROSS JOIN generate_series(0, {BOOT - 1}) r(rep))),
ln_{x} AS (SELECT *, CASE WHEN block = blocks - 1 THEN n - (blocks - 1) * size ELSE size END AS len FROM dr_{x}),
tk_{x} AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY combo, rep ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM ln_{x}),
bm_{x} AS (SELECT t.combo, rep, sum(b.s - a.s) / any_value(n) AS m FROM tk_{x} t JOIN pf_{x} a ON a.combo = t.combo AND a.p = block * size
  JOIN pf_{x} b ON b.combo = t.combo AND b.p = block * size + greatest(0, least(len, n - taken)) GROUP BY ALL),
{x} AS (SELECT combo, quantile_cont(m, 0.975) - quantile_cont(m, 0.025) AS width FROM bm_{x} GROUP BY combo)"""


NAIVE_SQL = f"""hq AS (SELECT combo, lbar, md5('boot:' || combo || ':' || sample_idx) AS h FROM smp),
hs AS (SELECT combo, lbar, ('0x' || substr(h, 1, 8))::BIGINT AS h, ('0x' || substr(h, 9, 8))::BIGINT AS s FROM hq),
hu AS (SELECT combo, rep, lbar, ((h + rep * s) % 4294967296) / 4294967296.0::DOUBLE AS u FROM hs CROSS JOIN generate_series(0, {BOOT - 1}) r(rep)),
wt AS (SELECT combo, rep, lbar, {POISSON_SQL} AS w FROM hu),
nm AS (SELECT combo, rep, sum(lbar * w) / sum(w) AS m FROM wt GROUP BY ALL),
nv AS (SELECT combo, quantile_cont(m, 0.975) - quantile_cont(m, 0.025) AS naive FROM nm GROUP BY combo)"""
ROOT_SQL = "round_even(sqrt(count(*)), 0)"
DEPENDENCE_SQL = with_ctes(
    "smp",
    f", {NAIVE_SQL}, {blocks_sql(ROOT_SQL)}, {block_width_sql('sample_idx', 'ordered')}"
    """ SELECT combo, size AS block, round(naive, 7) AS naive, round(width, 7) AS ordered, round(width / naive, 5) AS ratio
FROM nv JOIN ordered USING (combo) JOIN bk USING (combo)""",
)
SHUFFLED = sql_hash("combo || ':' || sample_idx", "shuffle") + ", sample_idx"


def block_widths(rows, order, blocks, name):
    return L.block_bootstrap_width(rows, ["combo"], "lbar", order, blocks, BOOT, "blocks", name)


@query("bootstrap_dependence", "ST18", DEPENDENCE_SQL)
def bootstrap_dependence(spark, sf_dir):
    rows = stored_samples(spark, sf_dir)
    blocks = L.bootstrap_blocks(rows, ["combo"], "lbar")
    naive = L.bootstrap_width(rows, ["combo"], "lbar", ["combo", "sample_idx"], BOOT, "boot", "naive")
    out = naive.join(block_widths(rows, ["sample_idx"], blocks, "ordered"), "combo").join(blocks.drop("rows"), "combo")
    out = out.withColumn("ratio", F.try_divide("ordered", "naive"))
    return rounded(rounded(out, "naive", "ordered", digits=7), "ratio", digits=5)


@query(
    "bootstrap_shuffled",
    "ST18",
    with_ctes(
        "smp",
        f", {blocks_sql(ROOT_SQL)}, {block_width_sql(SHUFFLED, 'shuffled')} SELECT combo, round(width, 7) AS shuffled FROM shuffled",
    ),
)
def bootstrap_shuffled(spark, sf_dir):
    rows = stored_samples(spark, sf_dir).withColumn("h", sampling.hash_int("combo", "sample_idx", seed="shuffle"))
    blocks = L.bootstrap_blocks(rows, ["combo"], "lbar")
    return rounded(block_widths(rows, ["h", "sample_idx"], blocks, "shuffled"), "shuffled", digits=7)


@query(
    "bootstrap_source_blocks",
    "ST18",
    with_ctes(
        "smp",
        f""", src AS (SELECT combo, (sample_idx // 64)::VARCHAR AS source FROM smp), per AS (SELECT combo, source, count(*) AS c FROM src GROUP BY ALL),
med AS (SELECT combo, floor(median(c)) AS m FROM per GROUP BY combo),
{blocks_sql("(SELECT any_value(m) FROM med WHERE med.combo = smp.combo)")}, {block_width_sql("sample_idx", "ordered")}
SELECT combo, size AS block, round(width, 7) AS ordered FROM ordered JOIN bk USING (combo)""",
    ),
)
def bootstrap_source_blocks(spark, sf_dir):
    """Blocks as long as the median source; 64 order numbers in a row are a source."""
    rows = stored_samples(spark, sf_dir).withColumn("source", F.floor(F.col("sample_idx") / 64).cast("string"))
    blocks = L.bootstrap_blocks(rows, ["combo"], "lbar", "source")
    out = block_widths(rows, ["sample_idx"], blocks, "ordered").join(blocks.drop("rows"), "combo")
    return rounded(out, "ordered", digits=7)


CTE["seq"] = """
SELECT user_id, ln(1 + value) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events"""


def sequences(spark, sf_dir):
    """(user_id, u, pos, n): log event values in time order per user."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.log(1 + F.col("value")).alias("u"))
    return O.positions(events, ["user_id"], ["ts", "event_id"], total="n").select("user_id", "u", "pos", "n")


@query(
    "autocorrelation",
    "WIN1 WIN8",
    with_ctes(
        "seq",
        """SELECT a.user_id, lag::INTEGER AS lag, round(CASE WHEN var_pop(a.u) > 0 AND var_pop(b.u) > 0 THEN corr(a.u, b.u) END, 6) AS acf
FROM seq a CROSS JOIN generate_series(1, 10) l(lag) JOIN seq b ON b.user_id = a.user_id AND b.p = a.p + lag
WHERE a.n > lag + 1 AND a.n >= 6 GROUP BY a.user_id, lag""",
    ),
)
def autocorrelation(spark, sf_dir):
    rows = sequences(spark, sf_dir).where("n >= 6")
    return rounded(L.autocorrelation(rows, ["user_id"], "pos", "u", range(1, 11), "n"), "acf")


@query(
    "block_mean_variance",
    "ST19",
    with_ctes(
        "seq",
        """SELECT user_id, b::INTEGER AS block_size, round(var_samp(m), 8) AS variance FROM (
  SELECT user_id, b, p // b AS k, avg(u) AS m FROM seq CROSS JOIN (SELECT unnest([2, 4, 8, 16, 32]) AS b) s
  WHERE n >= 6 AND n // b >= 2 AND p // b < n // b GROUP BY ALL) GROUP BY user_id, b""",
    ),
)
def block_mean_variance(spark, sf_dir):
    rows = sequences(spark, sf_dir).where("n >= 6")
    return rounded(L.block_mean_variance(rows, ["user_id"], "pos", "u", [2, 4, 8, 16, 32], "n"), "variance", digits=8)


CTE["fits0"] = """
SELECT combo, interval, mse FROM (SELECT combo, interval, mse, row_number() OVER (PARTITION BY combo, interval ORDER BY mse, ci) AS r FROM mgfm) WHERE r = 1"""
CTE["mgfm"] = """
SELECT combo, interval, ci, avg((v * b - mgf) ** 2) AS mse FROM (
  SELECT *, sum(b * mgf) OVER (PARTITION BY combo, interval, ci) / sum(b * b) OVER (PARTITION BY combo, interval, ci) AS v FROM (
    SELECT *, lam * lam / greatest(2 * (1 - ci * (greatest(1e-6, 0.95 / lmax) / 99.0) * lam), 1e-12) AS b FROM (
      SELECT interval, combo, lam, mgf, max(lam) OVER (PARTITION BY combo, interval) AS lmax
      FROM curve JOIN (VALUES ('full', 40), ('half', 20), ('quarter', 10)) s(interval, size) ON k < size) CROSS JOIN generate_series(0, 99) t(ci)))
GROUP BY ALL"""
NEEDS.update({"fits0": ("mgfm",), "mgfm": ("curve",)})

_RULES = {
    "sub-gamma/Bernstein": (
        "label IN ('sub_exponential_or_sub_gamma_like', 'sub_gaussian_like') AND coverage >= 0.75",
        {"mean_empirical_coverage": "coverage", "best_subgamma_mse": "best_mse"},
    ),
    "heavy_finite_variance_robust_mean": (
        "p95_mean > 1.15 * least(p95_catoni, p95_mom)",
        {"p95_mean": "p95_mean", "p95_catoni": "p95_catoni", "p95_mom": "p95_mom"},
    ),
    "conditional_bernstein_subgamma": (
        "domain_ratio IS NOT NULL AND length_ratio IS NOT NULL AND (domain_ratio < 0.9 OR length_ratio < 0.9)",
        {"pooled_var": "pooled_var", "domain_variance_ratio": "domain_ratio", "length_variance_ratio": "length_ratio"},
    ),
    "dependence_present": (
        "dependence >= 1.2",
        {"mean_ordered_vs_naive_ratio": "dependence", "p90_ordered_vs_naive_ratio": "dependence_p90"},
    ),
}
_FOUND = " UNION ALL ".join(
    f"SELECT '{name}' AS hypothesis, '{measure}' AS measure, {column} AS value FROM facts WHERE {rule}"
    for name, (rule, measures) in _RULES.items()
    for measure, column in measures.items()
)


@query(
    "hypothesis_report",
    "ST20",
    with_ctes(
        "cond fits0",
        f""", one AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS p, count(*) OVER () AS n FROM (SELECT lbar - avg(lbar) OVER () AS x FROM smp) WHERE x > 0),
ocut AS (SELECT 1 AS one, x, row_number() OVER (ORDER BY x) - 1 AS p, count(*) OVER () AS n FROM one
  WHERE x >= (SELECT quantile_cont(x, 0.9) FROM one) AND x <= (SELECT quantile_cont(x, 0.999) FROM one)),
og AS (SELECT one, x, (n - p) / n::DOUBLE AS s FROM ocut), tl AS (SELECT {LABEL} AS label FROM ({FITS.format(k="one", t="og")})),
cv AS (SELECT avg(coverage_rate) AS coverage FROM ({BERNSTEIN_SQL})), bm AS (SELECT min(mse) AS best_mse FROM fits0),
rb AS (SELECT max(p95_abs_dev) FILTER (estimator = 'mean') AS p95_mean, max(p95_abs_dev) FILTER (estimator = 'catoni') AS p95_catoni,
  max(p95_abs_dev) FILTER (estimator = 'median_of_means') AS p95_mom FROM ({ROBUST_SQL})),
vr AS (SELECT group_col, avg(var) AS v FROM cond GROUP BY group_col),
cr AS (SELECT max(v) FILTER (group_col = 'pooled') AS pooled_var, max(v) FILTER (group_col = 'domain') / max(v) FILTER (group_col = 'pooled') AS domain_ratio,
  max(v) FILTER (group_col = 'length_bin') / max(v) FILTER (group_col = 'pooled') AS length_ratio FROM vr),
dp AS (SELECT avg(ratio) AS dependence, quantile_cont(ratio, 0.9) AS dependence_p90 FROM ({DEPENDENCE_SQL})),
facts AS (SELECT * FROM tl CROSS JOIN cv CROSS JOIN bm CROSS JOIN rb CROSS JOIN cr CROSS JOIN dp),
found AS ({_FOUND})
SELECT hypothesis, measure, round(value, 6) AS value FROM found
UNION ALL SELECT 'mixed', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM found)""",
    ),
)
def hypothesis_report(spark, sf_dir):
    """The hypotheses the summaries support, a row for each number of their evidence."""
    rows = stored_samples(spark, sf_dir).withColumn("one", F.lit(1))
    tail = L.tail_shape(rows, ["one"], "lbar").select("one", "label")
    cover = bernstein_coverage(spark, sf_dir).agg(F.avg("coverage_rate").alias("coverage"))
    fits = L.mgf_fits(L.log_mgf_curve(rows, ["combo"], "lbar", LAMBDAS), ["combo"], len(LAMBDAS))
    fits = fits.agg(F.min("subgamma_mse").alias("best_mse"))
    robust = robust_rows(spark, sf_dir).agg(
        *[F.max(F.when(F.col("estimator") == e, F.col("p95_abs_dev"))).alias(e) for e in ("mean", "catoni", "median_of_means")]
    )
    ratios = L.variance_ratios(conditional(spark, sf_dir)).agg(
        F.max("pooled_var").alias("pooled_var"),
        *[F.max(F.when(F.col("group_col") == g, F.col("ratio"))).alias(g) for g in ("domain", "length_bin")],
    )
    dependence = bootstrap_dependence(spark, sf_dir).agg(
        F.avg("ratio").alias("dependence"), F.percentile("ratio", 0.9).alias("dependence_p90")
    )
    facts = tail
    for part in (cover, fits, robust, ratios, dependence):
        facts = facts.join(part.withColumn("one", F.lit(1)), "one")
    report = L.hypothesis_report(
        F.col("label"), F.col("coverage"), F.col("best_mse"), F.col("mean"), F.col("catoni"), F.col("median_of_means"),
        F.col("pooled_var"), F.col("domain"), F.col("length_bin"), F.col("dependence"), F.col("dependence_p90"),
    )
    each = facts.select(F.explode(report).alias("h")).select(
        "h.hypothesis", F.explode_outer(F.map_entries("h.evidence")).alias("e")
    )
    return each.select("hypothesis", F.col("e.key").alias("measure"), F.round("e.value", 6).alias("value"))


@query(
    "token_subsample",
    "ST21 WIN4 FN9",
    with_ctes(
        "tok",
        f"""SELECT combo, sample_idx, l_linenumber, l_partkey, l_suppkey, round(u, 9) AS u FROM tok
WHERE {sql_uniform("combo || ':' || sample_idx || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey", "token")} <= 0.5
QUALIFY row_number() OVER (PARTITION BY combo, sample_idx ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2""",
    ),
)
def token_subsample(spark, sf_dir):
    out = L.token_subsample(tokens(spark, sf_dir), ["combo", "sample_idx"], TOKEN_ORDER, 0.5, 2)
    return rounded(out.drop("l_quantity"), "u", digits=9)


@query(
    "sequence_probe",
    "ST21 WIN4",
    with_ctes(
        "tok",
        f"""SELECT combo, sample_idx, l_linenumber, l_partkey, l_suppkey, round(u, 9) AS u FROM tok
WHERE {sql_uniform("combo || ':' || sample_idx", "probe")} <= 0.2
QUALIFY row_number() OVER (PARTITION BY combo, sample_idx ORDER BY l_linenumber, l_partkey, l_suppkey) <= 3""",
    ),
)
def sequence_probe(spark, sf_dir):
    out = L.sequence_probe(tokens(spark, sf_dir), ["combo", "sample_idx"], TOKEN_ORDER, 0.2, 3)
    return rounded(out.drop("l_quantity"), "u", digits=9)


CTE["lossrow"] = f"""
SELECT o_orderpriority AS dataset, CASE WHEN {sql_uniform("o_custkey::VARCHAR", "method")} < 0.5 THEN 'sft' ELSE 'sdft' END AS method,
  year(o_orderdate)::INTEGER AS epoch, o_orderstatus AS task, ln(1 + o_totalprice / 1e5) AS loss,
  CASE WHEN o_totalprice < 50000 THEN 'partial' ELSE 'ok' END AS status, o_orderkey FROM orders"""


def loss_rows(spark, sf_dir):
    """Loss rows per (dataset, method, epoch, task), many shards per key, some not ok."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"),
        F.when(sampling.uniform("o_custkey", seed="method") < 0.5, "sft").otherwise("sdft").alias("method"),
        F.year("o_orderdate").alias("epoch"),
        F.col("o_orderstatus").alias("task"),
        F.log(1 + F.col("o_totalprice") / 1e5).alias("loss"),
        F.when(F.col("o_totalprice") < 50000, "partial").otherwise("ok").alias("status"),
        "o_orderkey",
    )


@query(
    "loss_wide_table",
    "ST22 SET3",
    with_ctes(
        "lossrow",
        """, fw AS (SELECT dataset, method, epoch, task, arg_min(loss, o_orderkey) AS loss, arg_min(status, o_orderkey) AS status FROM lossrow GROUP BY ALL)
SELECT dataset, method, epoch, round(max(loss) FILTER (task = 'F'), 9) AS F, round(max(loss) FILTER (task = 'O'), 9) AS O,
  round(max(loss) FILTER (task = 'P'), 9) AS P FROM fw WHERE status = 'ok' GROUP BY ALL""",
    ),
)
def loss_wide_table(spark, sf_dir):
    keys = ["dataset", "method", "epoch", "task"]
    first = L.first_wins(loss_rows(spark, sf_dir), keys, ["o_orderkey"], ["loss", "status"])
    wide = L.wide_losses(first, keys[:3], "task", ["F", "O", "P"], "loss")
    return rounded(wide, "F", "O", "P", digits=9)


@query(
    "expected_grid",
    "JOIN5",
    with_ctes(
        "lossrow",
        """, m AS (SELECT dataset, method, epoch, task, avg(CASE WHEN loss > 1.7 THEN loss END) AS mean_loss, count(CASE WHEN loss > 1.7 THEN loss END) AS n FROM lossrow WHERE status = 'ok' GROUP BY ALL)
SELECT d.dataset, me.method, e.epoch, t.task, round(mean_loss, 9) AS mean_loss, n FROM (SELECT DISTINCT dataset FROM lossrow) d
CROSS JOIN (SELECT DISTINCT method FROM lossrow) me CROSS JOIN (SELECT DISTINCT epoch FROM lossrow) e CROSS JOIN (SELECT DISTINCT task FROM lossrow) t
LEFT JOIN m USING (dataset, method, epoch, task)""",
    ),
)
def expected_grid(spark, sf_dir):
    rows, names = loss_rows(spark, sf_dir), ["dataset", "method", "epoch", "task"]
    large = F.when(F.col("loss") > 1.7, F.col("loss"))
    metrics = rows.where("status = 'ok'").groupBy(*names).agg(F.avg(large).alias("mean_loss"), F.count(large).alias("n"))
    return rounded(L.on_grid(L.observed_grid(rows, names), metrics, names), "mean_loss", digits=9)

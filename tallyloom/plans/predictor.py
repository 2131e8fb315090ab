"""Sign predictors and weight searches over feature tables derived from ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import sampling
from tallyloom.operators import predictor as P
from tallyloom.plans.fixtures import CTE, NEEDS, sql_uniform, table, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.registry import query

CTE["pf"] = """
SELECT l_returnflag || l_linestatus AS dataset, l_suppkey AS task, avg(l_discount) - 0.05 AS delta_cent, avg(l_tax) - 0.04 AS delta_load,
  avg(l_quantity) / 50 - 0.5 AS delta_self, avg(ln(l_extendedprice)) - 10.3 AS truth FROM lineitem GROUP BY ALL"""


def feature_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.col("l_suppkey").alias("task"))
        .agg(
            (F.avg("l_discount") - 0.05).alias("delta_cent"),
            (F.avg("l_tax") - 0.04).alias("delta_load"),
            (F.avg("l_quantity") / 50 - 0.5).alias("delta_self"),
            (F.avg(F.log("l_extendedprice")) - 10.3).alias("truth"),
        )
    )


CTE["grid3"] = f"""
SELECT a, b, c, ia * 49 + ib * 7 + ic AS g FROM (SELECT i AS ia, ({list(P.GRID)})[i + 1]::DOUBLE AS a FROM generate_series(0, 6) t(i)),
 (SELECT i AS ib, ({list(P.GRID)})[i + 1]::DOUBLE AS b FROM generate_series(0, 6) t(i)), (SELECT i AS ic, ({list(P.GRID)})[i + 1]::DOUBLE AS c FROM generate_series(0, 6) t(i))
WHERE NOT (a = 0 AND b = 0 AND c = 0)"""
_SCORED = "a * delta_cent + b * delta_load + c * delta_self"


def _fit_sql(fold_join: str, tail: str) -> str:
    return with_ctes(
        "pf grid3",
        f""", s AS (SELECT {fold_join}, sign({_SCORED}) = sign(truth) AS hit, {_SCORED} AS x, truth AS y, a, b, c, g FROM pf CROSS JOIN grid3 {tail}),
m AS (SELECT dataset, g, a, b, c, count(*) AS n, avg(hit::INTEGER) AS accuracy, round((count(*) * sum(x * y) - sum(x) * sum(y)) / sqrt((count(*) * sum(x * x) - sum(x) ** 2) * (count(*) * sum(y * y) - sum(y) ** 2)), 10) AS pearson FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, pearson DESC, abs(a) + abs(b) + abs(c), g) AS r FROM m)""",
    )


@query(
    "weight_grid_fit",
    "EV25 EV24",
    _fit_sql("dataset", "") + " SELECT dataset, n, a, b, c, round(accuracy, 9) AS accuracy, round(pearson, 8) AS pearson FROM r WHERE r = 1",
)
def weight_grid_fit(spark, sf_dir):
    return rounded(rounded(P.grid_fit(feature_rows(spark, sf_dir), "dataset", "truth"), "accuracy", digits=9), "pearson", digits=8)


@query(
    "leave_one_out_fit",
    "EV25",
    _fit_sql("h.dataset", "JOIN (SELECT DISTINCT dataset FROM pf) h ON h.dataset <> pf.dataset")
    + " SELECT dataset, n, a, b, c, round(accuracy, 9) AS accuracy, round(pearson, 7) AS pearson, false AS fallback FROM r WHERE r = 1",
)
def leave_one_out_fit(spark, sf_dir):
    out = P.leave_one_out_fit(feature_rows(spark, sf_dir), "dataset", "truth")
    return rounded(rounded(out, "accuracy", digits=9), "pearson", digits=7)


@query(
    "sign_predictions",
    "EV24 FN6",
    with_ctes(
        "pf",
        """, s AS (SELECT dataset, delta_cent - 0.5 * delta_load + 2 * delta_self AS x, truth FROM pf)
SELECT dataset, count(*) AS n, round(avg((sign(x) = sign(truth))::INTEGER), 9) AS sign_accuracy FROM s GROUP BY dataset""",
    ),
)
def sign_predictions(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    weights = rows.select("dataset").distinct().select(
        "dataset", F.lit(1.0).alias("a"), F.lit(-0.5).alias("b"), F.lit(2.0).alias("c")
    )
    out = P.sign_accuracy(P.predict(rows, weights, "dataset", "truth"), ["dataset"], "pred_score", "truth")
    return rounded(out, "sign_accuracy", digits=9)


@query(
    "top_k_metrics",
    "EV26 ORD2",
    with_ctes(
        "pf",
        """, s AS (SELECT dataset, task, delta_cent + delta_load + delta_self AS x, truth FROM pf),
r AS (SELECT *, row_number() OVER (ORDER BY x DESC, dataset, task) AS p, row_number() OVER (ORDER BY truth DESC, dataset, task) AS t FROM s)
SELECT k, round(count(*) FILTER (t <= k) / k::DOUBLE, 9) AS overlap, round(count(*) FILTER (truth > 0) / k::DOUBLE, 9) AS positive_precision
FROM r CROSS JOIN (SELECT unnest([3, 5, 10])::INTEGER AS k) WHERE p <= k GROUP BY k""",
    ),
)
def top_k_metrics(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).withColumn("x", F.col("delta_cent") + F.col("delta_load") + F.col("delta_self"))
    return rounded(P.top_k_metrics(rows, ["dataset", "task"], "x", "truth"), "overlap", "positive_precision", digits=9)


_FEAT = " UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, 12) AS x, round(truth, 12) AS y FROM pf" for f in P.FEATURES)


@query(
    "feature_evaluation",
    "EV27 EV22",
    with_ctes(
        "pf",
        f""", l AS ({_FEAT}), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)
SELECT feature, count(*) AS n, round(avg((sign(x) = sign(y))::INTEGER), 9) AS sign_accuracy, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, NULL::VARCHAR AS reason FROM r GROUP BY feature""",
    ),
)
def feature_evaluation(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).select(*[F.round(c, 12).alias(c) for c in (*P.FEATURES, "truth")])
    out = P.feature_evaluation(rows, P.FEATURES, "truth")
    return rounded(rounded(out, "sign_accuracy", digits=9), "pearson", "spearman")


DOMAINS = ["gsm8k", "openfunction", "magicoder", "alpaca", "dolly"]
TESTS = ["gsm8k", "openfunction", "humaneval"]
#: the experiment of which no metric is known
NO_METRICS = "o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AND ckpt = 'sft'"
METRICS = ("dot_before", "dot_after", "c_start", "c_end", "v_align")
CTE["expm"] = f"""
SELECT domain, test, ckpt, {", ".join(f"CASE WHEN NOT unknown THEN {c} END AS {c}" for c in METRICS)} FROM (
SELECT {NO_METRICS} AS unknown, CASE o_orderpriority WHEN '1-URGENT' THEN 'gsm8k' WHEN '2-HIGH' THEN 'openfunction' WHEN '3-MEDIUM' THEN 'magicoder' WHEN '4-NOT SPECIFIED' THEN 'alpaca' ELSE 'dolly' END AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'gsm8k' WHEN 'O' THEN 'openfunction' ELSE 'humaneval' END AS test, CASE WHEN {sql_uniform('o_custkey::VARCHAR', 'method')} < 0.5 THEN 'sft' ELSE 'sdft' END AS ckpt,
  avg(o_totalprice) / 1e7 AS dot_before, avg(sqrt(o_totalprice)) / 1e4 AS dot_after, CASE WHEN o_orderpriority <> '2-HIGH' THEN avg(ln(o_totalprice)) / 1e3 END AS c_start,
  stddev_pop(o_totalprice) / 1e6 AS c_end, CASE WHEN o_orderstatus <> 'P' THEN avg(1e5 / (o_totalprice + 1e4)) END AS v_align
FROM orders GROUP BY o_orderpriority, o_orderstatus, ckpt)"""


def experiment_metrics(spark, sf_dir):
    """(domain, test, ckpt, metrics) with some metrics, and all those of one experiment, NULL."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "ckpt", F.when(sampling.uniform("o_custkey", seed="method") < 0.5, "sft").otherwise("sdft")
    )
    priority = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    domain = F.lit(DOMAINS[-1])
    for name, value in zip(reversed(priority), reversed(DOMAINS[:-1])):
        domain = F.when(F.col("o_orderpriority") == name, value).otherwise(domain)
    price = F.col("o_totalprice")
    return (
        orders.groupBy("o_orderpriority", "o_orderstatus", "ckpt")
        .agg(
            (F.avg(price) / 1e7).alias("dot_before"),
            (F.avg(F.sqrt(price)) / 1e4).alias("dot_after"),
            (F.avg(F.log(price)) / 1e3).alias("c_start"),
            (F.stddev_pop(price) / 1e6).alias("c_end"),
            F.avg(1e5 / (price + 1e4)).alias("v_align"),
        )
        .withColumns({c: F.when(~F.expr(NO_METRICS), F.col(c)) for c in METRICS})
        .select(
            domain.alias("domain"),
            F.when(F.col("o_orderstatus") == "F", "gsm8k").when(F.col("o_orderstatus") == "O", "openfunction").otherwise("humaneval").alias("test"),
            "ckpt",
            "dot_before",
            "dot_after",
            F.when(F.col("o_orderpriority") != "2-HIGH", F.col("c_start")).alias("c_start"),
            "c_end",
            F.when(F.col("o_orderstatus") != "P", F.col("v_align")).alias("v_align"),
        )
    )


_TOTAL = "100 * coalesce(dot_before, 0) - coalesce(dot_after, 0) + 100 * coalesce(c_start, 0) + coalesce(c_end, 0)"


def _diff_sql(total: str) -> str:
    return with_ctes(
        "expm",
        f""", t AS (SELECT domain, test, ckpt, {total} AS total FROM expm)
SELECT domain, test, round(coalesce(a.total, 0) - coalesce(b.total, 0), 8) AS diff, CASE WHEN coalesce(a.total, 0) - coalesce(b.total, 0) >= 0 THEN '+' ELSE '-' END AS sign
FROM (SELECT * FROM t WHERE ckpt = 'sft') a FULL JOIN (SELECT * FROM t WHERE ckpt = 'sdft') b USING (domain, test)""",
    )


@query("weighted_total_differences", "EV28 JOIN8", _diff_sql(_TOTAL))
def weighted_total_differences(spark, sf_dir):
    total = P.weighted_total(F.lit(P.DEFAULT_WEIGHT_DOT), F.lit(P.DEFAULT_WEIGHT_START))
    return rounded(P.total_differences(experiment_metrics(spark, sf_dir), ["domain", "test"], "ckpt", total), "diff", digits=8)


@query(
    "aligned_total_differences",
    "EV28",
    _diff_sql("coalesce(v_align, 0) + 1000 * coalesce(c_start, 0) + coalesce(c_end, 0)"),
)
def aligned_total_differences(spark, sf_dir):
    total = P.aligned_total(F.lit(1000.0))
    return rounded(P.total_differences(experiment_metrics(spark, sf_dir), ["domain", "test"], "ckpt", total), "diff", digits=8)


@query(
    "weighted_total_table",
    "EV28 ST22",
    with_ctes(
        "expm",
        f"""SELECT test, {", ".join(f"round(max({_TOTAL}) FILTER (domain = '{d}'), 8) AS {d}" for d in DOMAINS)} FROM expm WHERE ckpt = 'sdft' GROUP BY test""",
    ),
)
def weighted_total_table(spark, sf_dir):
    total = P.weighted_total(F.lit(P.DEFAULT_WEIGHT_DOT), F.lit(P.DEFAULT_WEIGHT_START))
    rows = experiment_metrics(spark, sf_dir).where("ckpt = 'sdft'").withColumn("total", total)
    return rounded(P.wide_table(rows, "test", "domain", DOMAINS, "total"), *DOMAINS, digits=8)


LABELS = {(d, t): (1 if (i + j) % 3 else -1) for i, d in enumerate(DOMAINS) for j, t in enumerate(TESTS)}
STEP = 0.0001
STEPS = round(3 / STEP)


def _weight_search_sql() -> str:
    """Cells as columns, so that the grid is one streamed scan: a missing cell neither hits nor bounds the margin."""
    cells = ", ".join(
        f"max({c}) FILTER (domain = '{d}' AND test = '{t}') AS {c}_{k}" for k, (d, t) in enumerate(LABELS) for c in ("x1", "x2", "bias")
    )
    scores = [f"(w1 * x1_{k} + w2 * x2_{k} + bias_{k})" for k in range(len(LABELS))]
    hits = " + ".join(
        f"coalesce((({s} >= 0) = {str(v > 0).lower()})::INTEGER, 0)" for s, v in zip(scores, LABELS.values())
    )
    margin = ", ".join(f"coalesce(abs({s}), 'inf'::DOUBLE)" for s in scores)
    n = " + ".join(f"(x1_{k} IS NOT NULL)::INTEGER" for k in range(len(LABELS)))
    return with_ctes(
        "expm",
        f""", d AS (SELECT domain, test, sum(CASE WHEN ckpt = 'sft' THEN 1 ELSE -1 END * coalesce(dot_before, 0)) AS x1, sum(CASE WHEN ckpt = 'sft' THEN 1 ELSE -1 END * coalesce(c_start, 0)) AS x2,
  sum(CASE WHEN ckpt = 'sft' THEN 1 ELSE -1 END * (coalesce(c_end, 0) - coalesce(dot_after, 0))) AS bias FROM expm GROUP BY ALL),
p AS (SELECT {cells} FROM d),
g AS (SELECT i, j, pow(10, i * {STEP}::DOUBLE) AS w1, pow(10, j * {STEP}::DOUBLE) AS w2
  FROM (SELECT i, unnest(range(ceil((i * {STEP}::DOUBLE + 1) / {STEP}::DOUBLE)::BIGINT, {STEPS + 1})) AS j
        FROM generate_series(0, {STEPS}) a(i) WHERE i * {STEP}::DOUBLE + 1 <= 3)),
s AS (SELECT i, j, w1, w2, {hits} AS hits, least({margin}) AS margin, {n} AS n FROM g CROSS JOIN p)
SELECT round(w1, 6) AS w_dot, round(w2, 6) AS w_start, round(hits / n::DOUBLE, 9) AS accuracy, round(margin, 8) AS margin FROM s ORDER BY hits DESC, margin DESC, i, j LIMIT 1""",
    )


@query("weight_search", "EV29", _weight_search_sql())
def weight_search(spark, sf_dir):
    points = P.difference_points(experiment_metrics(spark, sf_dir), LABELS)
    out = P.search_weights(points, step=STEP)
    return rounded(rounded(rounded(out, "w_dot", "w_start"), "accuracy", digits=9), "margin", digits=8)

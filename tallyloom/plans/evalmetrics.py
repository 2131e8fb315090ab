"""Evaluation metrics over prediction, result and preference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import checks, sampling
from tallyloom.functions import text as X
from tallyloom.operators import evalmetrics as E
from tallyloom.operators import ordering as O
from tallyloom.operators import records as R
from tallyloom.plans.fixtures import (
    CTE,
    NEEDS,
    function_calls,
    number_answers,
    predictions,
    sql_hash,
    sql_uniform,
    table,
    vectors,
    with_ctes,
)
from tallyloom.plans.influence import identity_matrix_rows, rounded, split, target
from tallyloom.plans.records import SQL_CALL, SQL_MATH, SQL_SHAPE, SQL_STRIP, SQL_WORDS, code_answers, q
from tallyloom.plans.registry import query


def acc_sql(cte: str, key: str, ok: str) -> str:
    return with_ctes(
        cte,
        f"""SELECT {key}, count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 9) AS accuracy
FROM (SELECT {key}, coalesce({ok}, false) AS ok FROM {cte}) GROUP BY {key}""",
    )


@query("math_accuracy", "EV1 FN3", acc_sql("answers", "dataset", SQL_MATH))
def math_accuracy(spark, sf_dir):
    out = E.accuracy(number_answers(spark, sf_dir), ["dataset"], checks.math_match("label", "predict"))
    return rounded(out, "accuracy", digits=9)


@query("function_call_accuracy", "EV2", acc_sql("calls", "p_brand", SQL_CALL))
def function_call_accuracy(spark, sf_dir):
    out = E.accuracy(function_calls(spark, sf_dir), ["p_brand"], checks.call_match("label", "predict"))
    return rounded(out, "accuracy", digits=9)


@query("code_answer_accuracy", "EV3", acc_sql("codeans", "source", SQL_SHAPE))
def code_answer_accuracy(spark, sf_dir):
    out = E.accuracy(code_answers(spark, sf_dir), ["source"], checks.code_answer_shape("label", "predict"))
    return rounded(out, "accuracy", digits=9)


_SAFE = " OR ".join(f"contains(answer, {q(k)})" for k in checks.SAFE_KEYWORDS)
CTE["refuse"] = """
SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'I cannot help with ' || props WHEN 1 THEN 'That is ILLEGAL ' || event_id WHEN 2 THEN 'it is not legal: ' || props
  WHEN 3 THEN 'sorry ' || event_id ELSE 'Sure, ' || props END AS answer FROM events"""


@query("refusal_rate", "EV4", acc_sql("refuse", "event_type", _SAFE))
def refusal_rate(spark, sf_dir):
    case = F.col("event_id") % 5
    answer = (
        F.when(case == 0, F.concat(F.lit("I cannot help with "), "props"))
        .when(case == 1, F.concat(F.lit("That is ILLEGAL "), "event_id"))
        .when(case == 2, F.concat(F.lit("it is not legal: "), "props"))
        .when(case == 3, F.concat(F.lit("sorry "), "event_id"))
        .otherwise(F.concat(F.lit("Sure, "), "props"))
    )
    rows = table(spark, sf_dir, "events").select("event_type", answer.alias("answer"))
    return rounded(E.accuracy(rows, ["event_type"], checks.refuses("answer")), "accuracy", digits=9)


@query(
    "exact_match_by_language",
    "EV6",
    f"""WITH l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang),
m AS (SELECT lang, count(*) AS n, avg(CASE WHEN {SQL_STRIP.format("g")} = {SQL_STRIP.format("text")} THEN 1 ELSE 0 END) AS em
  FROM (SELECT lang, text, CASE WHEN doc_id % 3 = 0 THEN text || ' x' ELSE '  ' || text || chr(10) END AS g FROM documents) GROUP BY lang)
SELECT lang, coalesce(n, 0) AS n, round(coalesce(em, 0), 9) AS exact_match FROM l LEFT JOIN m USING (lang)""",
)
def exact_match_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn(
        "g",
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" x"))).otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))),
    )
    out = E.exact_match_by_language(rows, "lang", ["de", "en", "es", "fr", "it"], "g", "text")
    return rounded(out, "exact_match", digits=9)


@query(
    "category_accuracy",
    "EV7 EV38 JOIN14",
    """WITH p AS (SELECT s_nationkey, [l_discount, l_tax, l_quantity / 500, l_extendedprice / 1e6] AS pr, l_linenumber % 4 AS gold
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
a AS (SELECT r_name AS category, list_position(pr, list_max(pr)) - 1 = gold AS ok FROM p JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN grouping(category) = 1 THEN 'Average' ELSE category END AS category, count(*) AS n, round(100 * avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy
FROM a GROUP BY ROLLUP (category)""",
)
def category_accuracy(spark, sf_dir):
    subjects = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("category"))
    )
    probabilities = F.array("l_discount", "l_tax", F.col("l_quantity") / 500, F.col("l_extendedprice") / 1e6)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (E.choice_letter(probabilities) == F.char(F.lit(65) + F.col("l_linenumber") % 4)).alias("correct"),
    )
    return rounded(E.category_accuracy(rows.join(subjects, "l_suppkey"), "category", "correct"), "accuracy")


CTE["code"] = "SELECT l_partkey AS task, l_returnflag AS grp, l_orderkey, l_linenumber, l_suppkey, l_discount < 0.05 AS passed FROM lineitem"


def code_results(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("task"),
        F.col("l_returnflag").alias("grp"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        (F.col("l_discount") < 0.05).alias("passed"),
    )


@query(
    "pass_at_k",
    "EV8",
    with_ctes(
        "code",
        """, t AS (SELECT grp, task, count(*) AS n, count(*) FILTER (passed) AS c FROM code GROUP BY ALL),
ks AS (SELECT unnest([1, 2, 5, 100])::INTEGER AS k),
e AS (SELECT grp, task, k, n, CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(generate_series(n - c + 1, n), lambda i: 1 - k / i::DOUBLE)), 1) END AS p FROM t CROSS JOIN ks)
SELECT grp, k, count(*) AS tasks, round(avg(p), 9) AS pass_at_k FROM e GROUP BY grp, k HAVING min(n) >= k""",
    ),
)
def pass_at_k(spark, sf_dir):
    out = E.pass_at_k(code_results(spark, sf_dir), ["grp"], "task", "passed", [1, 2, 5, 100])
    return rounded(out, "pass_at_k", digits=9)


@query(
    "robust_pass",
    "EV9",
    """WITH r AS (SELECT l_returnflag AS pert, l_partkey % 50 AS task, l_linenumber AS seed, l_suppkey % 10 AS sample, bool_and(l_discount < 0.08) AS passed FROM lineitem GROUP BY ALL),
s AS (SELECT pert, task, seed, avg(passed::INTEGER) AS share, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT pert, task, product(share) AS alt, count(*) AS seeds, arg_min(n, seed) AS n FROM s GROUP BY ALL),
a AS (SELECT pert, task, sample, min(passed::INTEGER) AS ok, count(*) AS have FROM r GROUP BY ALL),
g AS (SELECT a.pert, a.task, coalesce(sum(CASE WHEN have = seeds THEN ok END), 0) AS good, any_value(n) AS n, any_value(alt) AS alt FROM a JOIN t ON a.pert = t.pert AND a.task = t.task GROUP BY ALL)
SELECT pert, round(avg(good / n::DOUBLE), 9) AS robust_pass, round(avg(alt), 9) AS alt_robust_pass FROM g GROUP BY pert""",
)
def robust_pass(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("pert"),
        (F.col("l_partkey") % 50).alias("task"),
        F.col("l_linenumber").alias("seed"),
        (F.col("l_suppkey") % 10).alias("sample"),
        (F.col("l_discount") < 0.08).alias("passed"),
    )
    rows = rows.groupBy("pert", "task", "seed", "sample").agg(F.bool_and("passed").alias("passed"))
    return rounded(E.robust_pass(rows, "pert", "task", "seed", "sample", "passed"), "robust_pass", "alt_robust_pass", digits=9)


@query(
    "pass_table",
    "EV10",
    with_ctes(
        "code",
        """, t AS (SELECT l_linenumber::VARCHAR AS bugs, count(*) AS n, count(*) FILTER (passed) AS c FROM code GROUP BY ALL),
p AS (SELECT bugs, n, c / n::DOUBLE AS pass_1, CASE WHEN n - c < 10 THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(generate_series(n - c + 1, n), lambda i: 1 - 10 / i::DOUBLE)), 1) END AS pass_10 FROM t)
SELECT bugs, n, round(pass_1, 9) AS pass_1, round(pass_10, 6) AS pass_10, NULL::DOUBLE AS num_correct FROM p
UNION ALL SELECT 'all', sum(n)::BIGINT, round(avg(pass_1), 9), round(avg(pass_10), 6), round(avg(pass_1) * count(*), 6) FROM p""",
    ),
)
def pass_table(spark, sf_dir):
    rows = code_results(spark, sf_dir).withColumnRenamed("l_linenumber", "bugs")
    out = E.pass_table(rows, "bugs", "passed", [1, 10])
    return rounded(rounded(out, "pass_1", digits=9), "pass_10", "num_correct")


CTE["runs"] = """
SELECT l_partkey AS task, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_suppkey % 3 = 0 THEN 'failed: timeout' WHEN l_suppkey % 7 = 0 THEN 'abc'
  ELSE (l_quantity % 4)::BIGINT::VARCHAR || '.0' END AS answer FROM lineitem"""


@query(
    "majority_vote",
    "EV11",
    with_ctes(
        "runs",
        """, v AS (SELECT task, answer, count(*) AS n, min(place) AS first FROM runs WHERE NOT starts_with(answer, 'failed:') GROUP BY ALL),
b AS (SELECT task, answer, row_number() OVER (PARTITION BY task ORDER BY n DESC, first) AS r FROM v),
a AS (SELECT t.task, coalesce(b.answer, '') AS answer, (t.task % 4)::VARCHAR AS ref FROM (SELECT DISTINCT task FROM runs) t LEFT JOIN b ON b.task = t.task AND r = 1)
SELECT count(*) AS n, round(avg(CASE WHEN abs(try_cast(answer AS DOUBLE) - ref::DOUBLE) < 1e-3 THEN 1 ELSE 0 END), 9) AS accuracy,
  count(*) FILTER (try_cast(answer AS DOUBLE) IS NULL) AS errors FROM a""",
    ),
)
def majority_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("task"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.when(F.col("l_suppkey") % 3 == 0, "failed: timeout")
        .when(F.col("l_suppkey") % 7 == 0, "abc")
        .otherwise(F.concat((F.col("l_quantity") % 4).cast("bigint").cast("string"), F.lit(".0")))
        .alias("answer"),
    )
    answers = E.majority_answers(rows, "task", "place", "answer").withColumn("ref", (F.col("task") % 4).cast("string"))
    return rounded(E.numeric_score(answers, [], "answer", "ref"), "accuracy", digits=9)


@query(
    "gold_numbers",
    "EV12",
    with_ctes(
        "answers",
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(split_part(label, '#### ', 2), ',', '') AS gold_text,
  replace(split_part(label, '#### ', 2), ',', '')::DOUBLE AS gold FROM answers""",
    ),
)
def gold_numbers(spark, sf_dir):
    text, number = E.gold_number("label")
    return number_answers(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("gold_text"), number.alias("gold")
    )


@query(
    "embedding_similarity",
    "EV17",
    """WITH s AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, count(*) AS n, round(avg(sim), 9) AS mean_similarity FROM s GROUP BY label""",
)
def embedding_similarity(spark, sf_dir):
    out = similarities(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean_similarity")
    )
    return rounded(out, "mean_similarity", digits=9)


def similarities(spark, sf_dir):
    vecs = vectors(spark, sf_dir).select("vec_id", "label", "g")
    other = vecs.select((F.col("vec_id") - 1).alias("vec_id"), "g")
    return E.aligned_similarity(vecs, other, ["vec_id"], "g").join(vecs.select("vec_id", "label"), "vec_id")


@query(
    "similarity_histogram",
    "EV17",
    """WITH s AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
e AS (SELECT min(sim) AS lo, max(sim) AS hi FROM s)
SELECT 'all' AS run, least(29, floor((sim - lo) / ((hi - lo) / 30)))::INTEGER AS bin, count(*) AS count FROM s CROSS JOIN e GROUP BY bin""",
)
def similarity_histogram(spark, sf_dir):
    return E.histogram(similarities(spark, sf_dir).withColumn("run", F.lit("all")), ["run"], "similarity")


CTE["noise"] = f"""
SELECT vec_id, label, p < floor(0.2::DOUBLE * n) AS is_noisy FROM (SELECT vec_id, label, row_number() OVER (ORDER BY {sql_hash("vec_id::VARCHAR", "noise")}, vec_id) - 1 AS p,
  count(*) OVER () AS n FROM embeddings)"""
CTE["infl"] = """SELECT vec_id, -sum(x * v) AS influence FROM lay JOIN vm USING (layer, pos) WHERE NOT is_val GROUP BY vec_id"""
NEEDS["infl"] = ("lay", "vm")


@query(
    "detection_curve",
    "EV18 WIN3 SET2",
    with_ctes(
        "noise infl",
        """, s AS (SELECT vec_id, round(influence, 9) AS score, is_noisy FROM infl JOIN noise USING (vec_id))
SELECT vec_id, row_number() OVER w AS inspected, round(100.0::DOUBLE * (row_number() OVER w - 1) / count(*) OVER (), 6) AS inspected_pct,
  round(100.0::DOUBLE * sum(is_noisy::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) / sum(is_noisy::INTEGER) OVER (), 6) AS detection_rate
FROM s WINDOW w AS (ORDER BY score DESC, vec_id DESC)""",
    ),
)
def detection_curve(spark, sf_dir):
    from tallyloom.operators import influence as I

    train, val = split(spark, sf_dir)
    scores = rounded(I.influence_values(train, target(val).withColumnRenamed("v", "hvp")), "influence", digits=9)
    noisy = R.flip_noisy_labels(
        vectors(spark, sf_dir).select("vec_id", (F.col("label") % 2).alias("y")), ["vec_id"], "y", 0.2
    ).select("vec_id", "is_noisy")
    out = E.detection_curve(scores.join(noisy, "vec_id"), ["vec_id"], "influence", "is_noisy")
    return rounded(out, "inspected_pct", "detection_rate")


def class_scores(spark, sf_dir):
    rows = identity_matrix_rows(spark, sf_dir)
    return rounded(rows, "influence", digits=9).withColumn("same", F.col("train_label") == F.col("val_label"))


@query(
    "influence_auc",
    "EV19 WIN2",
    with_ctes(
        "imat",
        """, r AS (SELECT val_label, train_label = val_label AS same, rank() OVER w + (count(*) OVER (PARTITION BY val_label, round(influence, 9)) - 1) / 2.0 AS rk
  FROM imat WINDOW w AS (PARTITION BY val_label ORDER BY -round(influence, 9)))
SELECT val_label, round((sum(rk) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 9) AS auc
FROM r GROUP BY val_label""",
    ),
)
def influence_auc(spark, sf_dir):
    return rounded(E.class_auc(class_scores(spark, sf_dir), "val_label", "influence", "same"), "auc", digits=9)


@query(
    "influence_recall",
    "EV20",
    with_ctes(
        "imat",
        """, r AS (SELECT val_label, train_label = val_label AS same, row_number() OVER (PARTITION BY val_label ORDER BY round(influence, 9), train_id) AS rk,
  sum((train_label = val_label)::INTEGER) OVER (PARTITION BY val_label) AS m FROM imat)
SELECT val_label, round(count(*) FILTER (same) / any_value(m)::DOUBLE, 9) AS recall FROM r WHERE rk <= m GROUP BY val_label""",
    ),
)
def influence_recall(spark, sf_dir):
    out = E.class_recall(class_scores(spark, sf_dir), "val_label", ["train_id"], "influence", "same")
    return rounded(out, "recall", digits=9)


@query(
    "influence_recall_by_target_class",
    "EV20",
    with_ctes(
        "imat",
        """, c AS (SELECT label, count(*) AS m FROM vec WHERE is_val GROUP BY label),
r AS (SELECT val_label, train_label = val_label AS same, row_number() OVER (PARTITION BY val_label ORDER BY round(influence, 9), train_id) AS rk, m FROM imat JOIN c ON c.label = val_label)
SELECT val_label, round(count(*) FILTER (same) / any_value(m)::DOUBLE, 9) AS recall FROM r WHERE rk <= m GROUP BY val_label""",
    ),
)
def influence_recall_by_target_class(spark, sf_dir):
    sizes = vectors(spark, sf_dir).where("is_val").groupBy(F.col("label").alias("val_label")).agg(F.count(F.lit(1)).alias("size"))
    scores = class_scores(spark, sf_dir).join(sizes, "val_label")
    out = E.class_recall(scores, "val_label", ["train_id"], "influence", "same", size="size")
    return rounded(out, "recall", digits=9)


@query(
    "influence_extremes",
    "EV21",
    with_ctes(
        "imat",
        """SELECT val_label, arg_max(train_id, row(abs(round(influence, 9)), -train_id)) AS most, arg_min(train_id, row(abs(round(influence, 9)), train_id)) AS least FROM imat GROUP BY val_label""",
    ),
)
def influence_extremes(spark, sf_dir):
    return E.extremes(class_scores(spark, sf_dir), "val_label", "train_id", "influence")


_RANKS = """SELECT {k}, {x}, {y}, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry FROM {t}"""


@query(
    "pearson_spearman",
    "EV22 WIN2",
    f"""WITH b AS (SELECT l_returnflag, l_quantity AS x, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE l_discount + l_quantity / 100 END AS y FROM lineitem),
r AS ({_RANKS.format(k="l_returnflag", x="x", y="y", t="b")})
SELECT l_returnflag, count(*) AS n, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson,
  CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(corr(rx, ry), 6) END AS spearman,
  CASE WHEN var_pop(x) <= 0 OR var_pop(y) <= 0 THEN 'constant_series' END AS reason FROM r GROUP BY l_returnflag""",
)
def pearson_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_quantity").alias("x"),
        F.when(F.col("l_returnflag") == "N", 1.0).otherwise(F.col("l_discount") + F.col("l_quantity") / 100).alias("y"),
    )
    return rounded(E.correlations(rows, ["l_returnflag"], "x", "y"), "pearson", "spearman")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrices",
    "EV23",
    "WITH l AS ("
    + " UNION ALL ".join(f"SELECT '{a}|{b}' AS k, {a} AS x, {b} AS y FROM lineitem" for a in _COLS for b in _COLS)
    + f"), r AS ({_RANKS.format(k='k', x='x', y='y', t='l')}) "
    "SELECT split_part(k, '|', 1) AS a, split_part(k, '|', 2) AS b, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY k",
)
def correlation_matrices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_COLS)
    return rounded(E.correlation_matrices(rows, _COLS), "pearson", "spearman")


CTE["prefs"] = """
SELECT a.o_orderkey, a.o_orderpriority, a.o_totalprice / 1e5 AS chosen, b.o_totalprice / 1e5 AS rejected FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) a JOIN
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) b ON a.o_custkey = b.o_custkey AND b.p = a.p + 1"""


def preferences(spark, sf_dir):
    """(o_orderkey, o_orderpriority, chosen, rejected): an order against the customer's next one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    placed = O.positions(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p")
    following = placed.select("o_custkey", (F.col("p") - 1).alias("p"), (F.col("o_totalprice") / 1e5).alias("rejected"))
    return placed.join(following, ["o_custkey", "p"]).select(
        "o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1e5).alias("chosen"), "rejected"
    )


@query(
    "preference_metrics",
    "EV30",
    with_ctes(
        "prefs",
        """SELECT o_orderpriority, round(avg(chosen), 8) AS chosen, round(avg(rejected), 8) AS rejected, round(avg((chosen > rejected)::INTEGER), 8) AS accuracy,
  round(avg(chosen - rejected), 8) AS margin FROM prefs GROUP BY o_orderpriority""",
    ),
)
def preference_metrics(spark, sf_dir):
    out = E.preference_metrics(preferences(spark, sf_dir), ["o_orderpriority"], "chosen", "rejected")
    return rounded(out, "chosen", "rejected", "accuracy", "margin", digits=8)


@query(
    "odds_ratio_loss",
    "EV31",
    with_ctes(
        "prefs",
        """, l AS (SELECT o_orderpriority, -(0.05 + chosen) AS c, -(0.05 + rejected) AS r FROM prefs),
z AS (SELECT *, (c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))) AS lo FROM l), y AS (SELECT *, ln(1 + exp(-lo)) AS odds FROM z)
SELECT o_orderpriority, round(avg(odds), 8) AS odds_ratio_loss, round(avg(-c + 0.1 * odds), 8) AS loss, round(avg((c > r)::INTEGER), 8) AS accuracy FROM y GROUP BY o_orderpriority""",
    ),
)
def odds_ratio_loss(spark, sf_dir):
    rows = preferences(spark, sf_dir).select(
        "o_orderpriority", (-(0.05 + F.col("chosen"))).alias("c"), (-(0.05 + F.col("rejected"))).alias("r")
    )
    return rounded(E.odds_ratio_metrics(rows, ["o_orderpriority"], "c", "r"), "odds_ratio_loss", "loss", "accuracy", digits=8)


CTE["ltok"] = """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS p, l_partkey % 3 AS tok, l_discount * 10 AS reward FROM lineitem"""


@query(
    "pairwise_reward_loss",
    "EV32",
    with_ctes(
        "ltok",
        """, c AS (SELECT l_orderkey AS pair, p, tok, reward FROM ltok WHERE l_orderkey + 1 IN (SELECT l_orderkey FROM ltok)),
r AS (SELECT l_orderkey - 1 AS pair, p, tok, reward FROM ltok WHERE l_orderkey - 1 IN (SELECT l_orderkey FROM ltok)),
j AS (SELECT pair, p, c.tok AS ct, r.tok AS rt, coalesce(c.reward, 0) - coalesce(r.reward, 0) AS gap FROM c FULL JOIN r USING (pair, p)),
b AS (SELECT pair, min(p) FILTER (ct IS DISTINCT FROM rt) AS f, max(p) FILTER (ct IS NOT NULL) AS l FROM j GROUP BY pair)
SELECT pair, round(avg(ln(1 + exp(-gap))), 8) AS loss FROM j JOIN b USING (pair) WHERE p >= coalesce(f, l) AND (f IS NOT NULL OR p <= l) GROUP BY pair""",
    ),
)
def pairwise_reward_loss(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    tokens = O.positions(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "pos").select(
        "l_orderkey", "pos", (F.col("l_partkey") % 3).alias("tok"), (F.col("l_discount") * 10).alias("reward")
    )
    keys = tokens.select("l_orderkey").distinct()

    def side(shift, name):
        partner = keys.select((F.col("l_orderkey") - shift).alias("l_orderkey"))
        return tokens.join(partner, "l_orderkey", "left_semi").select(
            (F.col("l_orderkey") - (0 if shift == 1 else 1)).alias("pair"),
            "pos",
            F.col("tok").alias(f"{name}_token"),
            F.col("reward").alias(f"{name}_reward"),
        )

    rows = side(1, "chosen").join(side(-1, "rejected"), ["pair", "pos"], "full_outer")
    return rounded(E.pairwise_reward_loss(rows, "pair", "pos"), "loss", digits=8)


@query(
    "top_tokens",
    "EV33 ORD2",
    f"""SELECT token, count(*) AS count FROM (SELECT unnest({SQL_WORDS.format("text")}) AS token FROM documents) GROUP BY token ORDER BY count DESC, token LIMIT 50""",
)
def top_tokens(spark, sf_dir):
    return E.top_tokens(E.token_counts(table(spark, sf_dir, "documents"), [], X.words("text")), 50)


@query(
    "token_totals",
    "EV33",
    f"""SELECT lang, count(*) AS texts, sum(len({SQL_WORDS.format("text")}))::BIGINT AS tokens, round(avg(len({SQL_WORDS.format("text")})), 6) AS tokens_per_text FROM documents GROUP BY lang""",
)
def token_totals(spark, sf_dir):
    return rounded(E.token_totals(table(spark, sf_dir, "documents"), ["lang"], X.words("text")), "tokens_per_text")


@query(
    "length_distribution",
    "EV34 WIN3",
    """WITH b AS (SELECT n_chars // 500 * 500 AS length, count(*) AS count FROM documents GROUP BY 1)
SELECT length, count, (sum(count) OVER (ORDER BY length))::BIGINT AS below, round(100.0::DOUBLE * sum(count) OVER (ORDER BY length) / sum(count) OVER (), 6) AS below_pct FROM b""",
)
def length_distribution(spark, sf_dir):
    out = E.length_distribution(table(spark, sf_dir, "documents"), "n_chars", 500)
    return rounded(out, "below_pct")


@query(
    "learning_rate",
    "EV35",
    with_ctes(
        "pred",
        """, t AS (SELECT conv_id % 4 AS run, length(label) AS valid, length(label) + length(prompt) AS total FROM pred)
SELECT run, round(sum(valid) / sum(total), 9) AS valid_ratio, round(3e-4 * sqrt(1024.0 * 16 * sum(valid) / sum(total) / 4e6) * 1e6, 6) AS rate_e6 FROM t GROUP BY run""",
    ),
)
def learning_rate(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        (F.col("conv_id") % 4).alias("run"), F.length("label").alias("valid"), (F.length("label") + F.length("prompt")).alias("total")
    )
    out = E.learning_rate(rows, ["run"], "valid", "total", 1024, 16)
    return out.select("run", F.round("valid_ratio", 9).alias("valid_ratio"), F.round(F.col("learning_rate") * 1e6, 6).alias("rate_e6"))


@query(
    "running_average",
    "EV36 WIN3",
    """SELECT event_id, event_type, round(sum(ln(1 + value) * (event_id % 3 + 1)) OVER w / sum(event_id % 3 + 1) OVER w, 7) AS running_avg FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", F.log(1 + F.col("value")).alias("v"), (F.col("event_id") % 3 + 1).alias("n")
    )
    out = E.running_average(rows, ["event_type"], ["ts", "event_id"], "v", "n")
    return out.select("event_id", "event_type", F.round("running_avg", 7).alias("running_avg"))


@query(
    "mean_pass_accuracy",
    "EV37",
    with_ctes("code", "SELECT grp, count(*) AS total, count(*) FILTER (passed) AS correct, round(avg(passed::INTEGER), 9) AS accuracy FROM code GROUP BY grp"),
)
def mean_pass_accuracy(spark, sf_dir):
    return rounded(E.accuracy(code_results(spark, sf_dir), ["grp"], F.col("passed")), "accuracy", digits=9)


@query(
    "exponential_smoothing",
    "WIN6",
    """WITH s AS (SELECT event_type, ln(1 + value) AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM s)
SELECT a.event_type, a.p AS pos, round(sum((1 - a.w) * pow(a.w, a.p - b.p) * b.x) + max(CASE WHEN b.p = 0 THEN b.x * pow(a.w, a.p + 1) END), 7) AS smoothed
FROM w a JOIN w b ON a.event_type = b.event_type AND b.p <= a.p GROUP BY a.event_type, a.p""",
)
def exponential_smoothing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.log(1 + F.col("value")).alias("x"))
    out = E.exponential_smoothing(rows, ["event_type"], ["ts", "event_id"], "x")
    return out.select("event_type", "pos", F.round("smoothed", 7).alias("smoothed"))

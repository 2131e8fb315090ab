"""Joins, orderings and set operations between derived experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import sampling
from tallyloom.operators import joins as J
from tallyloom.operators import ordering as O
from tallyloom.plans.fixtures import CTE, NEEDS, predictions, sql_hash, sql_uniform, table, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.registry import query

CTE["rawrec"] = "SELECT o_orderkey AS k, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders"
CTE["rwrec"] = "SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders"


def record_sides(spark, sf_dir, keyed: bool):
    """All orders on both sides; on the rewritten one the records of status F have no key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    key = F.lit("question_id") if keyed else F.lit("note")

    def with_fields(value):
        first = F.when(F.col("o_orderkey") < 3, F.col("o_orderkey").cast("string"))
        return orders.withColumn("fields", F.create_map(F.lit("id"), first, key, value.cast("string")))

    raw = O.positions(with_fields(F.col("o_custkey")), [], ["o_orderkey"], "ordinal")
    kept = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey"))
    return raw, O.positions(with_fields(kept), [], ["o_totalprice", "o_orderkey"], "ordinal")


@query(
    "keyed_record_pairs",
    "JOIN2",
    with_ctes(
        "rawrec rwrec",
        """SELECT a.ordinal AS raw, b.ordinal AS rewritten, 'id_mapping' AS mode, 'question_id' AS key
FROM (SELECT o_custkey, max(ordinal) AS ordinal FROM rawrec GROUP BY 1) a JOIN (SELECT o_custkey, max(ordinal) AS ordinal FROM rwrec GROUP BY 1) b USING (o_custkey)""",
    ),
)
def keyed_record_pairs(spark, sf_dir):
    return J.pair_records(*record_sides(spark, sf_dir, True))


@query(
    "positional_record_pairs",
    "JOIN2 JOIN1",
    with_ctes(
        "rawrec rwrec",
        "SELECT a.ordinal AS raw, b.ordinal AS rewritten, 'same_index' AS mode, NULL::VARCHAR AS key FROM rawrec a JOIN rwrec b USING (ordinal)",
    ),
)
def positional_record_pairs(spark, sf_dir):
    return J.pair_records(*record_sides(spark, sf_dir, False))


_METHOD = f"CASE WHEN {sql_uniform('o_custkey::VARCHAR', 'method')} < 0.5 THEN 'sft' ELSE 'sdft' END"
CTE["perf"] = f"""
SELECT o_orderpriority AS dataset, 'epoch_' || (year(o_orderdate) - 1995) AS epoch, {_METHOD} AS method, avg(ln(o_totalprice)) AS metric
FROM orders GROUP BY ALL"""
CTE["feat"] = """
SELECT o_orderpriority AS dataset, 'epoch_' || (year(o_orderdate) - 1995) AS epoch, o_orderstatus AS task, avg(ln(o_totalprice + 1)) AS cent FROM orders GROUP BY ALL"""


def order_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("epoch_"), (F.year("o_orderdate") - 1995).cast("string")).alias("epoch"),
        F.when(sampling.uniform("o_custkey", seed="method") < 0.5, "sft").otherwise("sdft").alias("method"),
        F.col("o_orderstatus").alias("task"),
        "o_totalprice",
    )


def performance(spark, sf_dir):
    rows = order_keys(spark, sf_dir)
    return rows.groupBy("dataset", "epoch", "method").agg(F.avg(F.log("o_totalprice")).alias("metric"))


def features(spark, sf_dir):
    return order_keys(spark, sf_dir).groupBy("dataset", "epoch", "task").agg(F.avg(F.log(F.col("o_totalprice") + 1)).alias("cent"))


_PERF = "(SELECT dataset, epoch AS label_epoch, max(metric) FILTER (method = 'sft') AS perf_sft, max(metric) FILTER (method = 'sdft') AS perf_sdft FROM perf GROUP BY ALL HAVING count(DISTINCT method) = 2)"
# no order is of the last one
LABEL_EPOCHS = ["epoch_0", "epoch_1", "epoch_99"]
_LABELS = f"(SELECT unnest({LABEL_EPOCHS}) AS label_epoch)"


@query(
    "performance_pairs",
    "JOIN3",
    with_ctes(
        "perf feat",
        f"""SELECT f.dataset, f.epoch, f.task, l.label_epoch, round(cent, 8) AS cent, round(perf_sft, 8) AS perf_sft, round(perf_sdft, 8) AS perf_sdft,
  round(perf_sdft - perf_sft, 8) AS perf_diff FROM feat f CROSS JOIN {_LABELS} l JOIN {_PERF} p ON p.dataset = f.dataset AND p.label_epoch = l.label_epoch""",
    ),
)
def performance_pairs(spark, sf_dir):
    rows, _ = J.performance_pairs(
        features(spark, sf_dir), performance(spark, sf_dir), "dataset", "epoch", LABEL_EPOCHS, "metric"
    )
    return rounded(rows, "cent", "perf_sft", "perf_sdft", "perf_diff", digits=8)


@query(
    "performance_rejects",
    "JOIN3 SNK6",
    with_ctes(
        "perf feat",
        f"""SELECT DISTINCT f.dataset, f.epoch, l.label_epoch, 'missing performance row for sft/sdft' AS reason FROM feat f CROSS JOIN {_LABELS} l
  ANTI JOIN {_PERF} p ON p.dataset = f.dataset AND p.label_epoch = l.label_epoch""",
    ),
)
def performance_rejects(spark, sf_dir):
    return J.performance_pairs(
        features(spark, sf_dir), performance(spark, sf_dir), "dataset", "epoch", LABEL_EPOCHS, "metric"
    )[1]


_HMODE = "CASE o_orderstatus WHEN 'F' THEN 'own' WHEN 'O' THEN 'mixed' ELSE 'cross_oracle_sft' END"
CTE["base"] = f"""
SELECT o_orderpriority AS dataset, 'epoch_' || (year(o_orderdate) - 1995) AS epoch, {_METHOD} AS method, {_HMODE} AS h_mode, avg(CASE WHEN o_totalprice > 300000 THEN sqrt(o_totalprice) END) / 1e3 AS lambda1
FROM orders GROUP BY ALL"""
CTE["rr"] = f"""
SELECT o_orderpriority AS dataset, 'epoch_' || (year(o_orderdate) - 1995) AS epoch, {_METHOD} AS method, min(o_totalprice) / 1e5 AS a_leak FROM orders GROUP BY ALL"""
CTE["sc"] = f"""
SELECT o_orderpriority AS dataset, 'epoch_' || (year(o_orderdate) - 1995) AS epoch, {_HMODE} AS h_mode, max(o_totalprice) / 1e6 AS cka FROM orders GROUP BY ALL"""
CTE["summ"] = """
SELECT dataset, epoch, method, h_mode, lambda1, a_leak, cka, metric FROM base FULL JOIN (SELECT rr.*, unnest(['own', 'mixed', 'cross_oracle_sft', 'cross_oracle_sdft']) AS h_mode FROM rr) r USING (dataset, epoch, method, h_mode)
LEFT JOIN sc USING (dataset, epoch, h_mode) LEFT JOIN perf USING (dataset, epoch, method)"""
NEEDS["summ"] = ("base", "rr", "sc", "perf")


def summary(spark, sf_dir):
    rows = order_keys(spark, sf_dir).withColumn(
        "h_mode", F.when(F.col("task") == "F", "own").when(F.col("task") == "O", "mixed").otherwise("cross_oracle_sft")
    )
    keys = ["dataset", "epoch", "method"]
    # metrics are missing where no order is large
    large = F.when(F.col("o_totalprice") > 300000, F.sqrt("o_totalprice"))
    base = rows.groupBy(*keys, "h_mode").agg((F.avg(large) / 1e3).alias("lambda1"))
    rr = rows.groupBy(*keys).agg((F.min("o_totalprice") / 1e5).alias("a_leak"))
    scores = rows.groupBy("dataset", "epoch", "h_mode").agg((F.max("o_totalprice") / 1e6).alias("cka"))
    return J.summary_table(
        base, rr, scores, performance(spark, sf_dir),
        ["own", "mixed", "cross_oracle_sft", "cross_oracle_sdft"],
    )


@query(
    "experiment_summary",
    "JOIN4 ORD1",
    with_ctes("summ", "SELECT dataset, epoch, method, h_mode, round(lambda1, 8) AS lambda1, round(a_leak, 8) AS a_leak, round(cka, 8) AS cka, round(metric, 8) AS metric FROM summ"),
)
def experiment_summary(spark, sf_dir):
    out = rounded(summary(spark, sf_dir), "lambda1", "a_leak", "cka", "metric", digits=8)
    return J.sort_for_output(out, ["dataset", "epoch", "h_mode", "method"])


@query(
    "method_deltas",
    "JOIN12",
    with_ctes(
        "summ",
        """SELECT dataset, epoch, h_mode, round(max(lambda1) FILTER (method = 'sft') - max(lambda1) FILTER (method = 'sdft'), 8) AS delta_lambda1,
  round(max(a_leak) FILTER (method = 'sft') - max(a_leak) FILTER (method = 'sdft'), 8) AS delta_a_leak,
  round(max(metric) FILTER (method = 'sft') - max(metric) FILTER (method = 'sdft'), 8) AS delta_metric FROM summ GROUP BY ALL HAVING count(DISTINCT method) = 2""",
    ),
)
def method_deltas(spark, sf_dir):
    out = J.method_deltas(summary(spark, sf_dir), ["dataset", "epoch", "h_mode"], "method", ["lambda1", "a_leak", "metric"])
    return rounded(out, "delta_lambda1", "delta_a_leak", "delta_metric", digits=8)


@query(
    "outer_difference",
    "JOIN8",
    with_ctes(
        "summ",
        """SELECT dataset, epoch, h_mode, round(CASE WHEN a.lambda1 IS NOT NULL OR b.lambda1 IS NOT NULL THEN coalesce(a.lambda1, 0) - coalesce(b.lambda1, 0) END, 8) AS diff
FROM (SELECT * FROM summ WHERE method = 'sft') a FULL JOIN (SELECT * FROM summ WHERE method = 'sdft') b USING (dataset, epoch, h_mode)""",
    ),
)
def outer_difference(spark, sf_dir):
    rows = summary(spark, sf_dir)
    out = J.outer_difference(
        rows.where("method = 'sft'"), rows.where("method = 'sdft'"), ["dataset", "epoch", "h_mode"], "lambda1", "diff"
    )
    return rounded(out, "diff", digits=8)


@query(
    "pending_work",
    "JOIN9 SET4",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def pending_work(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.not_yet_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    "aligned_submission",
    "SNK4 JOIN1",
    with_ctes(
        "pred",
        """, b AS (SELECT text AS instruction, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark),
p AS (SELECT predict AS output, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM pred)
SELECT ordinal, instruction, output FROM b JOIN p USING (ordinal)""",
    ),
)
def aligned_submission(spark, sf_dir):
    from tallyloom.sources.writers import submission

    instructions = O.positions(
        table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("instruction")), [], ["item_id"], "ordinal"
    )
    preds = O.positions(predictions(spark, sf_dir).select("conv_id", "turn", "predict"), [], ["conv_id", "turn"], "ordinal")
    return submission(instructions, preds, "ordinal")


@query(
    "sampled_pairs",
    "ORD3",
    f"SELECT vec_id FROM embeddings ORDER BY {sql_hash('vec_id::VARCHAR', 'pairs')}, vec_id LIMIT 60",
)
def sampled_pairs(spark, sf_dir):
    return J.sampled_in_order(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 60, "pairs")


@query(
    "work_shard",
    "ORD4",
    with_ctes(
        "summ",
        """, k AS (SELECT DISTINCT dataset, epoch, method, h_mode FROM summ)
SELECT dataset, epoch, method, h_mode FROM (SELECT *, row_number() OVER (ORDER BY dataset, epoch, method, h_mode) - 1 AS p FROM k) WHERE p % 4 = 1""",
    ),
)
def work_shard(spark, sf_dir):
    keys = ["dataset", "epoch", "method", "h_mode"]
    return J.shard(summary(spark, sf_dir).select(*keys), keys, 4, 1)


@query(
    "mixed_record_sets",
    "SET1",
    """WITH r AS (SELECT lang AS kind, 1 AS a, 0 AS b FROM documents UNION ALL SELECT role, 0, 1 FROM conversations
  UNION ALL SELECT regexp_extract(html, 'lang="([a-z]*)"', 1), 0, 1 FROM pages)
SELECT kind, count(*) AS records, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN 'ok' WHEN sum(a) > 0 THEN 'missing second' ELSE 'missing first' END AS status FROM r GROUP BY kind""",
)
def mixed_record_sets(spark, sf_dir):
    """Documents by language against pages by language and turns by role, which no document has."""
    documents = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "doc_id")
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("kind"), "page_id")
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), "conv_id")
    rows, status = J.mixed_records(documents, pages.unionByName(turns, allowMissingColumns=True), "kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("records")).join(status, "kind")


@query(
    "top_set_overlap",
    "SET2",
    """WITH a AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 100), b AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100)
SELECT l_partkey FROM a INTERSECT SELECT l_partkey FROM b""",
)
def top_set_overlap(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))

    def top(c):
        return per.orderBy(F.col(c).desc(), "l_partkey").limit(100).select("l_partkey")

    return top("q").intersect(top("n"))

"""Readers and writers, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ordering as O
from tallyloom.plans.fixtures import CTE, predictions, sql_uniform, table, tokens, vectors, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.predictor import DOMAINS, TESTS, experiment_metrics
from tallyloom.plans.records import SQL_STRIP, records
from tallyloom.plans.registry import query
from tallyloom.session import scratch_path
from tallyloom.sources import readers as S
from tallyloom.sources import writers as W


def record_lines(spark, sf_dir):
    """(lang, doc_id, value): one JSON record per document; every 13th line broken, every 17th blank."""
    docs = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("answer"), F.col("lang").alias("topic")))
    value = F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("{"), F.lit('"id": '))).when(F.col("doc_id") % 17 == 3, "").otherwise(body)
    return docs.select("lang", "doc_id", value.alias("value"))


@query(
    "jsonl_records",
    "SRC2 SRC4",
    "SELECT doc_id::VARCHAR AS id, md5(text) AS answer_md5, lang AS topic FROM documents WHERE doc_id % 13 <> 5 AND doc_id % 17 <> 3",
)
def jsonl_records(spark, sf_dir):
    path = scratch_path(spark, "records") + ".jsonl"
    record_lines(spark, sf_dir).select("value").write.text(path)
    rows = S.read_records(spark, path)
    return rows.select(F.col("fields.id").alias("id"), F.md5(F.col("fields.answer")).alias("answer_md5"), F.col("fields.topic").alias("topic"))


FILE_RECORDS = 500


@query(
    "json_array_records",
    "SRC1",
    f"""SELECT lang, doc_id::VARCHAR AS id, md5(text) AS text_md5, p % {FILE_RECORDS} AS ordinal
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p FROM documents)""",
)
def json_array_records(spark, sf_dir):
    """JSON files of up to 500 records each: bare arrays, or arrays under a wrapper key, by language."""
    path = scratch_path(spark, "arrays")
    docs = O.positions(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], ["doc_id"], "p")
    docs = docs.withColumn("file", F.floor(F.col("p") / FILE_RECORDS))
    item = F.struct("p", F.col("doc_id").cast("string").alias("id"), "lang", "text")
    records_of = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["id"].alias("id"), s["lang"].alias("lang"), s["text"].alias("text")))
    listed = docs.groupBy("lang", "file").agg(F.to_json(records_of).alias("j"))
    wrapped = (
        F.when(F.col("lang") == "en", F.col("j"))
        .when(F.col("lang") == "fr", F.concat(F.lit('{"data": '), "j", F.lit("}")))
        .when(F.col("lang") == "de", F.concat(F.lit(' {"meta": 1, "records": '), "j", F.lit("}")))
        .otherwise(F.concat(F.lit('{"items": '), "j", F.lit("}")))
    )
    listed.select("lang", "file", wrapped.alias("value")).write.partitionBy("lang", "file").text(path)
    rows = S.read_json_records(spark, path + "/*/*")
    return rows.select(
        F.col("fields.lang").alias("lang"), F.col("fields.id").alias("id"), F.md5(F.col("fields.text")).alias("text_md5"), "ordinal"
    )


@query(
    "strict_predictions",
    "SRC3 SNK2",
    with_ctes("pred", "SELECT md5(label) AS label_md5, md5(predict) AS predict_md5 FROM pred"),
)
def strict_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    W.write_predictions(predictions(spark, sf_dir), path)
    rows = S.read_jsonl_strict(spark, path, "label string, predict string", ["predict"])
    return rows.select(F.md5("label").alias("label_md5"), F.md5("predict").alias("predict_md5"))


@query(
    "delimited_records",
    "SRC4 SNK1",
    """SELECT s_suppkey::VARCHAR AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey::VARCHAR, c_name, c_mktsegment FROM customer""",
)
def delimited_records(spark, sf_dir):
    path = scratch_path(spark, "rows") + ".csv"
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    W.write_rows([suppliers, customers], path)
    rows = S.read_records(spark, path)
    return rows.select(*[F.col(f"fields.{n}").alias(n) for n in ("key", "name", "segment")])


@query(
    "text_line_records",
    "SRC5",
    f"SELECT md5({SQL_STRIP.format('line')}) AS text_md5 FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE {SQL_STRIP.format('line')} <> ''",
)
def text_line_records(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".txt"
    table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return S.read_records(spark, path).select(F.md5(F.col("fields.text")).alias("text_md5"))


@query(
    "combo_statistics",
    "SRC6",
    """SELECT l_returnflag AS train_dataset, l_linestatus AS method, 'epoch_' || (l_linenumber % 3) AS epoch, 'task' || (l_suppkey % 2) AS task, count(*) AS n,
  round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY ALL""",
)
def combo_statistics(spark, sf_dir):
    root = scratch_path(spark, "tree")
    keys = ["train_dataset", "method", "epoch", "task"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("train_dataset"),
        F.col("l_linestatus").alias("method"),
        F.concat(F.lit("epoch_"), F.col("l_linenumber") % 3).alias("epoch"),
        F.concat(F.lit("task"), F.col("l_suppkey") % 2).alias("task"),
        "l_orderkey",
        "l_quantity",
    )
    rows.write.partitionBy(*keys).option("header", True).csv(f"{root}/by_combo")
    stats = S.read_combo_statistics(spark, root, "*.csv", "l_orderkey bigint, l_quantity double")
    out = stats.groupBy("train_dataset", "method", "epoch", "task").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")
    )
    return rounded(out, "total", digits=4)


@query(
    "partitioned_statistics",
    "SNK3 SRC6",
    with_ctes("tok", "SELECT combo, count(*) AS n, round(sum(u), 6) AS total FROM tok GROUP BY combo"),
)
def partitioned_statistics(spark, sf_dir):
    path = scratch_path(spark, "stats")
    W.write_statistics(tokens(spark, sf_dir), path, ["combo"])
    out = spark.read.parquet(path).groupBy("combo").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))
    return rounded(out, "total")


@query(
    "experiment_files",
    "SRC7 SRC8",
    with_ctes(
        "expm",
        """SELECT domain, ckpt, test, round(v_align, 8) AS v_align, round(c_start, 8) AS c_start, round(c_end, 8) AS c_end, round(dot_before, 8) AS dot_before,
  round(dot_after, 8) AS dot_after FROM expm WHERE domain <> 'dolly'""",
    ),
)
def experiment_files(spark, sf_dir):
    path = scratch_path(spark, "results")
    body = F.to_json(F.struct(*[F.col(c).alias(name) for c, name in S.RESULT_FIELDS.items()]))
    rows = experiment_metrics(spark, sf_dir).select(
        F.concat("domain", F.lit("_"), F.upper("ckpt"), F.lit("__"), "test", F.lit(".json")).alias("file"), body.alias("value")
    )
    rows.write.partitionBy("file").text(path)
    # a folder per experiment stands for the file of that name
    files = spark.read.option("wholetext", True).text(path)
    keyed = files.withColumn("k", S.result_keys("file", DOMAINS[:-1], TESTS)).where("k is not null")
    out = keyed.select("k.*", *[S.nested_metric("value", f).alias(c) for c, f in S.RESULT_FIELDS.items()])
    return rounded(out, *S.RESULT_FIELDS, digits=8)


@query(
    "nested_metrics",
    "SRC8 FN8",
    """SELECT o_orderkey, round(o_totalprice / 1e6, 8) AS acc, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice / 1e5, 8) END AS pass_1 FROM orders""",
)
def nested_metrics(spark, sf_dir):
    price = F.col("o_totalprice")
    text = F.concat(
        F.lit('{"results": {"mmlu": {"acc,none": '), (price / 1e6).cast("string"), F.lit('}}, "humanevalsynthesize-python": {'),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('"pass@1": '), (price / 1e5).cast("string"))).otherwise(""), F.lit("}}"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(S.nested_metric(text, "results", "mmlu", "acc,none"), 8).alias("acc"),
        F.round(S.nested_metric(text, "humanevalsynthesize-python", "pass@1"), 8).alias("pass_1"),
    )


CTE["loglines"] = """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line, CASE event_type
  WHEN 'signup' THEN 'Evaluation on ' || (['GSM8K test', 'MultiArith:', 'openfunction', 'HumanEval', 'the Alpaca set', 'something else'])[event_id % 6 + 1]
  WHEN 'view' THEN 'Accuracy for run 7: ' || value WHEN 'purchase' THEN 'pass@1 = ' || value WHEN 'error' THEN '   ' ELSE 'step ' || (event_id % 100) || ' done' END AS text, event_type, event_id, value FROM events"""


def log_lines(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("GSM8K test", "MultiArith:", "openfunction", "HumanEval", "the Alpaca set", "something else")])
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = (
        F.when(kind == "signup", F.concat(F.lit("Evaluation on "), F.get(names, (F.col("event_id") % 6).cast("int"))))
        .when(kind == "view", F.concat(F.lit("Accuracy for run 7: "), value))
        .when(kind == "purchase", F.concat(F.lit("pass@1 = "), value))
        .when(kind == "error", "   ")
        .otherwise(F.concat(F.lit("step "), (F.col("event_id") % 100).cast("string"), F.lit(" done")))
    )
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", text.alias("text"))
    return O.positions(rows, ["user_id"], ["ts", "event_id"], "line").select("user_id", "line", "text")


@query(
    "mined_log_metrics",
    "SRC9 WIN7",
    with_ctes(
        "loglines",
        """, m AS (SELECT *, CASE WHEN event_type = 'signup' THEN (['gsm8k', 'multiarith', 'openfunction', 'humaneval', 'alpaca_eval', ''])[event_id % 6 + 1] END AS mk FROM loglines),
c AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS ctx FROM m),
v AS (SELECT user_id, line, ctx, event_type, CASE WHEN event_type IN ('view', 'purchase') THEN value ELSE (event_id % 100)::DOUBLE END AS v FROM c WHERE event_type NOT IN ('signup', 'error')),
l AS (SELECT user_id, line, v, 'metric_' || ctx AS metric FROM v WHERE ctx <> '' UNION ALL SELECT user_id, line, v, 'metric_accuracy_generic' FROM v WHERE event_type = 'view'
  UNION ALL SELECT user_id, line, v, 'metric_humaneval_passk' FROM v WHERE event_type = 'purchase')
SELECT user_id, metric, arg_max(v, line) AS value FROM l GROUP BY ALL""",
    ),
)
def mined_log_metrics(spark, sf_dir):
    return S.mined_metrics(log_lines(spark, sf_dir), "user_id", "line", "text")


@query(
    "checked_vectors",
    "SRC10",
    "SELECT vec_id, label, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
)
def checked_vectors(spark, sf_dir):
    from tallyloom.functions import vectors as V

    rows = S.read_vectors(spark, f"{sf_dir}/embeddings.parquet", "embedding")
    return rows.select("vec_id", "label", F.round(V.norm("embedding"), 6).alias("norm"))


@query(
    "pair_score_table",
    "SRC11",
    """WITH e AS (SELECT l_suppkey % 7 AS i, l_partkey % 7 AS j, l_linenumber % 2 AS named, l_extendedprice AS score FROM lineitem),
f AS (SELECT i, j, named, min(score) AS score FROM e GROUP BY ALL)
SELECT least(i, j)::INTEGER AS a, greatest(i, j)::INTEGER AS b, arg_min(score, row(CASE WHEN named = 1 THEN 0 ELSE 2 END + CASE WHEN i > j THEN 1 ELSE 0 END)) AS score FROM f GROUP BY 1, 2""",
)
def pair_score_table(spark, sf_dir):
    names = [f"n{k}" for k in range(7)]

    def key(c):
        number = (F.col(c) % 7).cast("string")
        return F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("n"), number)).otherwise(number)

    rows = table(spark, sf_dir, "lineitem").select(key("l_suppkey").alias("x"), key("l_partkey").alias("y"), F.col("l_extendedprice").alias("score"))
    return S.pair_scores(rows, names)


@query(
    "answer_text_columns",
    "SRC12",
    with_ctes(
        "rec",
        """SELECT conv_id, turn, CASE layout WHEN 0 THEN label WHEN 1 THEN label WHEN 2 THEN label WHEN 7 THEN label WHEN 8 THEN label END AS truthy,
  CASE layout WHEN 0 THEN label WHEN 1 THEN label WHEN 2 THEN label WHEN 7 THEN label WHEN 8 THEN label END AS present FROM rec""",
    ),
)
def answer_text_columns(spark, sf_dir):
    return records(spark, sf_dir).select(
        "conv_id", "turn", S.answer_text("fields").alias("truthy"), S.answer_text("fields", "present").alias("present")
    )


@query(
    "row_statuses",
    "SNK6 PRJ11",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'unavailable' WHEN {sql_uniform("o_orderkey::VARCHAR", "status")} < 0.1 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN o_totalprice < 20000 THEN 'price too low' WHEN {sql_uniform("o_orderkey::VARCHAR", "status")} < 0.1 THEN 'sampled out' END AS reason FROM orders""",
)
def row_statuses(spark, sf_dir):
    from tallyloom.functions import sampling

    checks = [
        (F.col("o_totalprice") < 20000, "unavailable", "price too low"),
        (sampling.uniform("o_orderkey", seed="status") < 0.1, "partial", "sampled out"),
    ]
    return W.with_status(table(spark, sf_dir, "orders"), checks).select("o_orderkey", "status", "reason")

"""Readers for record, score, statistics and log files.

Records come back as (source, ordinal, fields MAP<STRING, STRING>). The ordinal is the place of the record
in its file, taken while the file is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import joins as J
from tallyloom.operators import ordering as O
from tallyloom.sources.arrays import read_json_records

def _source() -> Column:
    return F.col("_metadata.file_path").alias("source")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, value, and the line's place as two columns); lines keep file order by block and place in the block."""
    return spark.read.text(path).select(
        _source(),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
        "value",
    )


def _with_ordinals(lines: DataFrame) -> DataFrame:
    return O.positions(lines, ["source"], ["__block", "__line"], "ordinal").drop("__block", "__line")


def read_jsonl_records(spark: SparkSession, path: str, ordinals: bool = True) -> DataFrame:
    """JSON lines; blank and malformed lines and lines that are no object are skipped."""
    lines = _lines(spark, path).withColumn("fields", F.from_json("value", "map<string,string>"))
    kept = lines.where(F.col("fields").isNotNull() & F.ltrim("value").startswith("{")).drop("value")
    return _with_ordinals(kept) if ordinals else kept.drop("__block", "__line")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """JSON lines with a declared schema; a malformed line or a missing required key is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for key in required:
        rows = rows.withColumn(
            key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"missing key {key}")).cast(rows.schema[key].dataType))
        )
    return rows


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    names = rows.columns
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    return rows.select(_source(), fields.alias("fields"))


def read_text_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per non-blank line under the key ``text``."""
    lines = _lines(spark, path).where(~X.blank("value"))
    rows = lines.withColumn("fields", F.create_map(F.lit("text"), X.strip("value"))).drop("value")
    return _with_ordinals(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix: .json, .csv, .tsv, .txt; .jsonl, .ndjson and anything else as JSON lines."""
    name = path.lower().rstrip("/")
    if name.endswith(".json"):
        return read_json_records(spark, path)
    if name.endswith(".csv"):
        return read_delimited(spark, path)
    if name.endswith(".tsv"):
        return read_delimited(spark, path, "\t")
    if name.endswith(".txt"):
        return read_text_records(spark, path)
    return read_jsonl_records(spark, path)


def read_combo_statistics(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """CSV statistics under by_combo/<train_dataset>/<method>/<epoch>/<task>/; unreadable files are skipped.

    A folder may be a plain value or ``name=value``.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .csv(f"{root}/by_combo/*/*/*/*/{file}")
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    keys = ["train_dataset", "method", "epoch", "task"]
    # the folders stand right after the by_combo folder
    first = F.array_position(parts, "by_combo").cast("int")
    values = [F.regexp_replace(F.element_at(parts, first + 1 + k), "^[^=]*=", "") for k in range(len(keys))]
    return rows.select(*[v.alias(n) for v, n in zip(values, keys)], "*")


RESULT_NAME = r"^([^_]+)_([^_]+)__(.+)\.json$"  # fixed value: domain, checkpoint and test in a result file's name


def result_keys(file_path, domains: Sequence[str], tests: Sequence[str]) -> Column:
    """STRUCT(domain, ckpt, test) from a file name, NULL when it does not fit or names an unknown key."""
    name = F.element_at(F.split(X.col(file_path), "/"), -1)
    part = [F.lower(F.regexp_extract(name, RESULT_NAME, k)) for k in (1, 2, 3)]
    known = part[0].isin(*domains) & part[2].isin(*tests)
    return F.when(known, F.struct(part[0].alias("domain"), part[1].alias("ckpt"), part[2].alias("test")))


RESULT_FIELDS = {  # fixed values: column and its name in a result file
    "v_align": "V_align",
    "c_start": "C_start",
    "c_end": "C_end",
    "dot_before": "dot_avggrad_delta_before",
    "dot_after": "dot_avggrad_delta",
}


def read_experiment_results(spark: SparkSession, path: str, domains: Sequence[str], tests: Sequence[str]) -> DataFrame:
    """(domain, ckpt, test, metrics) from one small JSON file per experiment; unknown names and bad files are skipped."""
    files = spark.read.option("wholetext", True).text(path).select("value", _source())
    keyed = files.withColumn("k", result_keys("source", domains, tests)).where("k is not null")
    values = [X.col(F.get_json_object("value", f"$.{f}")).try_cast("double").alias(n) for n, f in RESULT_FIELDS.items()]
    return keyed.where(F.from_json("value", "map<string,string>").isNotNull()).select("k.*", *values)


def nested_metric(json_text, *keys: str) -> Column:
    """A number deep in a result JSON, keys taken literally."""
    path = "$" + "".join(f"['{k}']" for k in keys)
    return F.get_json_object(X.col(json_text), path).try_cast("double")


def read_vectors(spark: SparkSession, path: str, vector: str) -> DataFrame:
    return checked_vectors(spark.read.parquet(path), vector)


def checked_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """The rows, with an error when their vectors are not all of one length."""
    sizes = rows.agg(F.min(F.size(vector)).alias("__lo"), F.max(F.size(vector)).alias("__hi"), F.lit(1).alias("__k"))
    checked = rows.withColumn("__k", F.lit(1)).join(sizes, "__k")
    same = F.when(F.col("__lo") == F.col("__hi"), F.col(vector)).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast(rows.schema[vector].dataType)
    )
    return checked.withColumn(vector, same).drop("__k", "__lo", "__hi")


PAIR_NAME = r"sim_(.+?)_([^_]+)\.json$"


def pair_scores_from_files(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(a, b, score), a and b 0-based places in ``names``: see :func:`pair_scores`."""
    files = spark.read.option("wholetext", True).text(path).select("value", _source())
    name = F.element_at(F.split("source", "/"), -1)
    rows = files.select(
        F.regexp_extract(name, PAIR_NAME, 1).alias("x"),
        F.regexp_extract(name, PAIR_NAME, 2).alias("y"),
        F.get_json_object("value", "$.score").try_cast("double").alias("score"),
    )
    return pair_scores(rows, names)


def pair_scores(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, score) with a <= b from pairs given by name or by number, in either order.

    Of several entries for a pair the first readable one counts: by name before by number, (a, b) before (b, a).
    """
    places = F.create_map(*[v for k, n in enumerate(names) for v in (F.lit(n), F.lit(k))])

    def place(c):
        return F.coalesce(F.try_element_at(places, F.col(c)), F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int")))

    by_number = F.when(F.try_element_at(places, F.col("x")).isNull(), 2).otherwise(0)
    known = rows.select(place("x").alias("i"), place("y").alias("j"), by_number.alias("r"), "score")
    known = known.where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("score").isNotNull())
    return known.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.min_by("score", F.struct(F.col("r") + F.when(F.col("i") > F.col("j"), 1).otherwise(0), F.col("score"))).alias("score")
    )


def answer_text(fields, first: str = "truthy") -> Column:
    """answer, output or predict: the first non-empty one, or (``present``) the first of answer and output that exists."""
    fields = X.col(fields)

    def get(k):
        return F.try_element_at(fields, F.lit(k))

    if first == "truthy":
        return X.first_truthy(get("answer"), get("output"), get("predict"))
    return F.when(F.map_contains_key(fields, F.lit("answer")), get("answer")).when(
        F.map_contains_key(fields, F.lit("output")), get("output")
    )


# fixed values: words that name an evaluation after "evaluation on", in order of preference
CONTEXTS = {
    "gsm8k": "gsm8k",
    "multiarith": "multiarith",
    "openfunction": "openfunction",
    "humaneval": "humaneval",
    "alpaca": "alpaca_eval",
    "safety": "safety",
}
NO_CONTEXT = ""


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line, text) of log files."""
    return _with_ordinals(_lines(spark, path)).select("source", F.col("ordinal").alias("line"), F.col("value").alias("text"))


def mined_metrics(lines: DataFrame, log: str, line: str, text: str) -> DataFrame:
    """(log, metric, value) from evaluation logs.

    A line with "evaluation on" names the context of the lines after it, an unknown name ends it. The last
    number of any other line is a value of the context, of the generic accuracy when the line speaks of
    accuracy, and of pass@k when it says so. Later lines overwrite earlier ones.
    """
    low = F.lower(F.col(text))
    heading = low.contains("evaluation on")
    context = F.lit(NO_CONTEXT)
    for word, metric in reversed(list(CONTEXTS.items())):
        context = F.when(low.contains(word), F.lit(metric)).otherwise(context)
    marked = lines.where(~X.blank(text)).withColumn("__marker", F.when(heading, context))
    carried = J.carry_forward(marked, [log], [line], "__marker", "__ctx")
    values = carried.where("__marker is null").withColumn("__v", X.last_float(text)).where("__v is not null")
    metrics = F.filter(
        F.array(
            F.when(F.col("__ctx") != NO_CONTEXT, F.concat(F.lit("metric_"), "__ctx")),
            F.when(low.contains("accuracy"), F.lit("metric_accuracy_generic")),
            F.when(low.contains("pass@"), F.lit("metric_humaneval_passk")),
        ),
        lambda m: m.isNotNull(),
    )
    long = values.select(log, line, "__v", F.explode(metrics).alias("metric"))
    return long.groupBy(log, "metric").agg(F.max_by("__v", F.col(line)).alias("value"))

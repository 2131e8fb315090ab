"""Inputs of the registered queries, derived from the given tables, with the same derivation in SQL.

Every derivation keeps all rows of its table; train/validation membership is a seeded hash column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import sampling

LAYER_WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash(expr: str, seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {expr}),1,8))::BIGINT)"


def sql_uniform(expr: str, seed: str) -> str:
    return f"({sql_hash(expr, seed)} / 4294967295.0::DOUBLE)"


CTE: dict[str, str] = {}


def with_ctes(names: str, body: str) -> str:
    """Prefix ``body`` with the named table expressions after what each of them needs."""
    ordered: list[str] = []

    def need(name):
        if name not in ordered:
            for other in NEEDS.get(name, ()):
                need(other)
            ordered.append(name)

    for n in names.split():
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered) + "\n" + body


NEEDS = {
    "lay": ("vec",),
    "objs": ("lay0",),
    "lay0": ("vec",),
    "smp": ("tok",),
}


# --- vectors -----------------------------------------------------------------------------------

CTE["vec"] = f"""
SELECT vec_id, label, embedding::DOUBLE[] AS g,
       {sql_uniform("vec_id::VARCHAR", "split")} < 0.2 AS is_val,
       ({sql_hash("vec_id::VARCHAR", "batch")} % 8 + 1)::BIGINT AS batch
FROM embeddings"""

CTE["lay0"] = """
SELECT vec_id, label, is_val, batch, (p - 1)::INTEGER AS pos, g[p] AS x
FROM vec, generate_series(1, 64) t(p)"""

CTE["lay"] = f"""
SELECT vec_id, label, is_val, batch, ((p - 1) // {LAYER_WIDTH})::INTEGER AS layer,
       ((p - 1) % {LAYER_WIDTH})::INTEGER AS pos, g[p] AS x
FROM vec, generate_series(1, 64) t(p)"""

CTE["objs"] = "SELECT label AS obj, pos, avg(x) AS a FROM lay0 GROUP BY label, pos"


def vectors(spark, sf_dir) -> DataFrame:
    """vec_id, label, g ARRAY<DOUBLE>, is_val, batch"""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("g"),
        (sampling.uniform("vec_id", seed="split") < 0.2).alias("is_val"),
        (sampling.hash_int("vec_id", seed="batch") % 8 + 1).alias("batch"),
    )


def layered(vecs: DataFrame, width: int = LAYER_WIDTH) -> DataFrame:
    """One row per (vector, layer); a layer is a fixed-width slice of the vector."""
    layers = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("g") - 1) / F.lit(width)).cast("int")),
        lambda k: F.struct(k.alias("layer"), F.slice("g", k * width + 1, width).alias("g")),
    )
    others = [c for c in vecs.columns if c != "g"]
    return vecs.select(*others, F.explode(layers).alias("s")).select(*others, "s.layer", "s.g")


# --- losses ------------------------------------------------------------------------------------

CTE["tok"] = """
SELECT l_returnflag || '_' || l_linestatus AS combo, l_orderkey AS sample_idx, l_partkey, l_suppkey, l_linenumber,
       ln(1 + l_extendedprice / 1e4) AS u, l_quantity
FROM lineitem"""

CTE["smp"] = """
SELECT combo, sample_idx, count(*)::BIGINT AS ti, sum(u) AS li, round(sum(u) / count(*), 9) AS lbar
FROM tok GROUP BY combo, sample_idx"""


def tokens(spark, sf_dir) -> DataFrame:
    """Token losses: combo, sample_idx, u, and a row key (l_partkey, l_suppkey, l_linenumber)."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("combo"),
        F.col("l_orderkey").alias("sample_idx"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.log(1 + F.col("l_extendedprice") / 1e4).alias("u"),
        "l_quantity",
    )


# --- text --------------------------------------------------------------------------------------

CTE["pred"] = f"""
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS label,
       CASE WHEN {sql_uniform("u.conv_id::VARCHAR || ':' || u.turn::VARCHAR", "alter")} < 0.3
            THEN regexp_replace(a.text, '[.]', ',', 'g') || ' my response' ELSE a.text END AS predict
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def answered_turns(spark, sf_dir) -> DataFrame:
    """conv_id, turn, prompt, label: a user turn and its answer."""
    turns = table(spark, sf_dir, "conversations")
    answer = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("label")
    )
    return (
        turns.where("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("prompt"))
        .join(answer, ["conv_id", "turn"])
    )


def altered_answer() -> Column:
    """The prediction of an answered turn: its label, sometimes altered."""
    altered = F.concat(F.regexp_replace("label", "[.]", ","), F.lit(" my response"))
    return F.when(sampling.uniform("conv_id", "turn", seed="alter") < 0.3, altered).otherwise(F.col("label"))


def predictions(spark, sf_dir) -> DataFrame:
    """conv_id, turn, prompt, label, predict: a user turn, its answer and a sometimes altered answer."""
    return answered_turns(spark, sf_dir).withColumn("predict", altered_answer())


CTE["answers"] = f"""
SELECT l_returnflag AS dataset, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       'Step ' || l_linenumber || ' gives #### ' || (CASE WHEN l_partkey % 2 = 0 THEN '1,' ELSE '' END)
         || lpad((l_quantity * 10)::BIGINT::VARCHAR, 3, '0') AS label,
       CASE WHEN l_suppkey % 10 = 0 THEN 'I do not know'
            WHEN l_suppkey % 10 < 4 THEN ' The answer is ' || l_linenumber || ' or ' || (l_quantity * 10)::BIGINT || '.5'
            ELSE ' The answer is ' || (CASE WHEN l_partkey % 2 = 0 THEN '1,' ELSE '' END)
                 || lpad((l_quantity * 10)::BIGINT::VARCHAR, 3, '0') || '.00 ' END AS predict
FROM lineitem"""


def number_texts() -> tuple[Column, Column]:
    """label and predict of a line item."""
    amount = (F.col("l_quantity") * 10).cast("bigint").cast("string")
    head = F.when(F.col("l_partkey") % 2 == 0, "1,").otherwise("")
    exact = F.concat(head, F.lpad(amount, 3, "0"))
    label = F.concat(F.lit("Step "), "l_linenumber", F.lit(" gives #### "), exact)
    predict = (
        F.when(F.col("l_suppkey") % 10 == 0, F.lit("I do not know"))
        .when(
            F.col("l_suppkey") % 10 < 4,
            F.concat(F.lit(" The answer is "), "l_linenumber", F.lit(" or "), amount, F.lit(".5")),
        )
        .otherwise(F.concat(F.lit(" The answer is "), exact, F.lit(".00 ")))
    )
    return label, predict


def number_answers(spark, sf_dir) -> DataFrame:
    """dataset, row key, label and predict texts that end in numbers (thousands commas, fractions, none)."""
    label, predict = number_texts()
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        label.alias("label"),
        predict.alias("predict"),
    )


CTE["calls"] = """
SELECT p_partkey, p_brand,
       'shop.price( size=' || p_size || ', type=''' || p_type || ''')' AS label,
       CASE WHEN p_partkey % 5 = 0 THEN 'call workshop.price( size=' || p_size || ', type="' || p_type || '") now'
            WHEN p_partkey % 5 = 1 THEN 'use myshop.price( size=' || p_size || ',type="' || p_type || '")'
            WHEN p_partkey % 5 = 2 THEN 'shop.price( size=' || (p_size + 1) || ', type="' || p_type || '")'
            ELSE 'Sure:  shop.price( size=' || p_size || ',   type="' || p_type || '") done' END AS predict
FROM part"""


def call_texts() -> tuple[Column, Column]:
    """label (a function call) and predict (an answer that may contain it) of a part."""
    size, kind = F.col("p_size").cast("string"), F.col("p_type")

    def call(head, gap, tail, n=size):
        return F.concat(F.lit(head + "shop.price( size="), n, F.lit(gap + 'type="'), kind, F.lit('")' + tail))

    case = F.col("p_partkey") % 5
    label = F.concat(F.lit("shop.price( size="), size, F.lit(", type='"), kind, F.lit("')"))
    predict = (
        F.when(case == 0, call("call work", ", ", " now"))
        .when(case == 1, call("use my", ",", ""))
        .when(case == 2, call("", ", ", "", (F.col("p_size") + 1).cast("string")))
        .otherwise(call("Sure:  ", ",   ", " done"))
    )
    return label, predict


def function_calls(spark, sf_dir) -> DataFrame:
    """p_partkey, p_brand, label (a function call) and predict (an answer that may contain it)."""
    label, predict = call_texts()
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", label.alias("label"), predict.alias("predict"))

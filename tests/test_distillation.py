"""Distilled datasets over tables with equal keys, missing values and long texts, and what they leave on disk."""

import hashlib
import os

import duckdb
import pytest

from tallyloom.plans import load_all
from tallyloom.plans.records import prediction_table
from tallyloom.session import cut_lineage, scratch_scope, shared_folder, shuffles_freed

QUERIES = ("distilled_dataset", "answer_differences", "answer_difference_rate")


def hashes(i):
    """Words that do not compress, more of them in later documents."""
    return " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(i * 40))


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("own"))
    rows = {
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string",
            # every line twice with other amounts, so that texts decide between equal keys
            [(i % 50, i % 3, i % 7, i % 11, float(q), "A") for i in range(100) for q in (i % 40 + 1, i % 9 + 1)],
        ),
        "part": ("p_partkey long, p_size int, p_type string, p_brand string", [(i, i % 9, f"kind '{i}'", "b") for i in range(40)]),
        "documents": ("doc_id long, text string, source string", [(i, f"  body {i} " + hashes(i) + "\n", "s") for i in range(30)]),
        "conversations": (
            "conv_id long, turn long, role string, text string",
            [(c, t, "assistant" if t % 2 else "user", f" turn. {c} {t} my answer. ") for c in range(40) for t in range(4)],
        ),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_own_tables_match_their_sql(spark, own, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{own}/{t}.parquet/*.parquet'")
    q = load_all()[name]
    cursor = con.execute(q.sql)
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(r[c] for c in names) for r in q.build(spark, own).collect())
    assert got and got == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_texts_are_shuffled_once(spark, own, name):
    limits = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        out = load_all()[name].build(spark, own)
        out.collect()
    finally:
        for key in limits:
            spark.conf.unset(key)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "ordinal" in line]
    assert "SortMergeJoin" in plan
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1


def kept(spark):
    top = shared_folder(spark).removeprefix("file:")
    return {d for d, _, names in os.walk(top) if "_SUCCESS" in names}


def shuffled(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_one_table_and_no_shuffle_stay_after_numbering(spark, own):
    tables, shuffles = kept(spark), shuffled(spark)
    out = prediction_table(spark, own)
    assert len(kept(spark) - tables) == 1
    assert shuffled(spark) <= shuffles
    assert out.count() == 200 + 40 + 30 + 80


def test_a_kept_table_outlives_its_scope_and_settings_come_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_freed(spark), scratch_scope(spark):
        kept_rows = cut_lineage(spark.range(9).repartition(2), keep=True, codec="zstd")
        gone = cut_lineage(spark.range(9).repartition(2))
    assert kept_rows.count() == 9
    assert spark.conf.get(name, None) == before
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))

"""Readers on hand-made files, writers, and streams that arrive in several batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import joins as J
from tallyloom.operators import smoothing as SM
from tallyloom.sources import arrays as A
from tallyloom.sources import readers as S
from tallyloom.sources import writers as W
from tallyloom.streaming import runs
from tallyloom.streaming import statistics as ST


def fields(df):
    return [(r["ordinal"], dict(r["fields"])) for r in df.orderBy("source", "ordinal").collect()]


@pytest.mark.parametrize(
    "content",
    [
        '[{"a": "1"}, {"b": "2"}]',
        '\n {"data": [{"a": "1"}, {"b": "2"}], "n": 2}',
        '{"items": [{"a": "1"}, {"b": "2"}]}',
        '{"records": [{"a": "1"}, {"b": "2"}]}',
    ],
)
def test_json_layouts(spark, tmp_path, content):
    (tmp_path / "x.json").write_text(content)
    assert fields(S.read_records(spark, str(tmp_path / "x.json"))) == [(0, {"a": "1"}), (1, {"b": "2"})]


def test_single_json_object(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": "1"}')
    assert fields(S.read_records(spark, str(tmp_path / "x.json"))) == [(0, {"a": "1"})]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("[]", []),
        ("", []),
        ("not json", []),
        ('{"a": {"b": 1}, "c": "}"}\n', [(0, {"a": '{"b":1}', "c": "}"})]),
        ('[null, {"a": "1"}, 3, {"a": "2"}]', [(0, {"a": "1"}), (1, {"a": "2"})]),
        ('{"note": "a}b{[", "items": [{"a": "1"}], "records": [{"a": "2"}], "x": {"data": [{"a": "3"}]}}', [(0, {"a": "2"})]),
        ('{"note": "\\"data\\": [", "items": [{"a": "\\\\"}, {"a": "\\"}{"}]}', [(0, {"a": "\\"}), (1, {"a": '"}{'})]),
        ('{"data": [], "items": [{"a": "1"}]}', []),
    ],
)
def test_awkward_json_files(spark, tmp_path, content, expected):
    (tmp_path / "x.json").write_text(content)
    assert fields(S.read_records(spark, str(tmp_path / "x.json"))) == expected


@pytest.mark.parametrize("wrapper", [None, "examples"])
def test_json_array_is_cut_into_byte_ranges(spark, tmp_path, wrapper):
    """Blocks of 2 KB begin anywhere: in strings with braces and quotes, in nested objects, between records."""
    rng = np.random.default_rng(6)
    alphabet = list('{}[]",:\\ ab\n\u00e9\u4e2d')
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 90))) for _ in range(600)] + ["{}" * 4000]
    records = [{"k": str(i), "t": t, "n": {"m": {"t": t}}} for i, t in enumerate(texts)]
    whole = records if wrapper is None else {"meta": {"items": ["}"]}, wrapper: records, "z": [{"k": "no"}]}
    (tmp_path / "x.json").write_text(json.dumps(whole, ensure_ascii=False, indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = S.read_records(spark, str(tmp_path / "x.json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r["ordinal"]: r["fields"] for r in rows}
    assert len(rows) == len(records) == len(got)
    for i, r in enumerate(records):
        assert (got[i]["k"], got[i]["t"], json.loads(got[i]["n"])) == (r["k"], r["t"], r["n"])


def test_windows_over_chunks_of_a_json_array_carry_no_text(spark, tmp_path, monkeypatch):
    """Chunks are placed by their counts; records are one chunk or, with braces in their strings, several."""
    records = [{"k": str(i), "t": ["plain", "a}b{", '"}', "\\"][i % 4] * 50} for i in range(40)]
    (tmp_path / "x.json").write_text(json.dumps({"data": records}))
    plans, cut = [], A.cut_lineage

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan())
        return cut(df)

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    monkeypatch.setattr(A, "cut_lineage", written)
    assert fields(S.read_records(spark, str(tmp_path / "x.json"))) == list(enumerate(records))
    windows = [n for plan in plans for n in nodes(plan) if n.nodeName() == "Window"]
    carried = {n.output().apply(i).name() for n in windows for i in range(n.output().size())}
    assert "__line" in carried and not carried & {"value", "__text", "__parts"}


def test_jsonl_skips_bad_lines_and_keeps_order(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n\nnot json\n[1]\n{"a": "2"}\n')
    assert fields(S.read_records(spark, str(tmp_path / "x.jsonl"))) == [(0, {"a": "1"}), (1, {"a": "2"})]


def test_jsonl_order_over_many_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"k": str(i), "pad": "x" * 200}) + "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = S.read_records(spark, str(tmp_path / "x.jsonl")).select("ordinal", F.col("fields.k").cast("long").alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r["ordinal"] == r["k"] for r in rows)


def test_strict_reader(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"predict": "a"}\n{"label": "b"}\n')
    with pytest.raises(Exception, match="missing key predict"):
        S.read_jsonl_strict(spark, str(tmp_path / "x.jsonl"), "label string, predict string", ["predict"]).collect()


def test_delimited_and_text(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n1\t2,3\n")
    assert S.read_records(spark, str(tmp_path / "x.tsv")).first()["fields"] == {"a": "1", "b": "2,3"}
    (tmp_path / "x.txt").write_text("one\n\n  two \n")
    assert fields(S.read_records(spark, str(tmp_path / "x.txt"))) == [(0, {"text": "one"}), (1, {"text": "two"})]


def test_experiment_files(spark, tmp_path):
    (tmp_path / "gsm8k_SFT__humaneval.json").write_text('{"V_align": 1.5, "C_end": null}')
    (tmp_path / "other_sft__humaneval.json").write_text('{"V_align": 1}')
    (tmp_path / "gsm8k_sdft__humaneval.json").write_text("broken")
    rows = S.read_experiment_results(spark, str(tmp_path), ["gsm8k"], ["humaneval"]).collect()
    assert [(r["ckpt"], r["v_align"], r["c_end"]) for r in rows] == [("sft", 1.5, None)]


def test_pair_files(spark, tmp_path):
    (tmp_path / "sim_x_y.json").write_text('{"score": 1.0}')
    (tmp_path / "sim_1_0.json").write_text('{"score": 9.0}')
    (tmp_path / "sim_2_0.json").write_text('{"score": 3.0}')
    (tmp_path / "sim_y_z.json").write_text('{"score": null}')
    rows = S.pair_scores_from_files(spark, str(tmp_path), ["x", "y", "z"]).collect()
    assert {(r["a"], r["b"]): r["score"] for r in rows} == {(0, 1): 1.0, (0, 2): 3.0}


def test_log_mining(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "loss 3\nEvaluation on GSM8K\nAccuracy for math: 1 / 4 = 25.00%\n\nEvaluation on unknown\nvalue 9\nEvaluation on HumanEval\npass@1: 0.5\n"
    )
    lines = S.read_log_lines(spark, str(tmp_path / "run.log"))
    found = {r["metric"]: r["value"] for r in S.mined_metrics(lines, "source", "line", "text").collect()}
    assert found == {"metric_gsm8k": 25.0, "metric_accuracy_generic": 25.0, "metric_humaneval": 0.5, "metric_humaneval_passk": 0.5}


def test_unequal_vectors_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        S.checked_vectors(rows, "v").collect()


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    b = spark.createDataFrame([(2, "y")], "k long, b string")
    W.write_rows([a, b], str(tmp_path / "rows"), "json")
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "rows")).select("k", "a", "b").collect()} == {(1, "x", None), (2, None, "y")}
    W.write_statistics(a.withColumn("combo", F.lit("c")), str(tmp_path / "stats"), ["combo"])
    assert spark.read.parquet(str(tmp_path / "stats")).first()["combo"] == "c"


def test_unequal_zip_is_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        J.checked_zip_join(spark.range(3).withColumnRenamed("id", "o"), spark.range(2).withColumnRenamed("id", "o"), "o").collect()


def test_pairing_prefers_the_first_usable_key(spark):
    rows = [(i, {"id": str(i) if i < 3 else None, "uuid": str(i % 5)}) for i in range(10)]
    df = spark.createDataFrame(rows, "ordinal long, fields map<string,string>")
    out = J.pair_records(df, df).collect()
    assert {r["key"] for r in out} == {"uuid"} and {r["raw"] for r in out} == {5, 6, 7, 8, 9}


def test_smoothed_log_keeps_state_between_batches(spark, tmp_path):
    source, target, state = tmp_path / "log", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    losses = np.random.default_rng(0).random(12) + 0.1
    seen, last = [], None
    for part in range(3):
        lines = [{"run": "r", "step": int(4 * part + k), "loss": float(losses[4 * part + k])} for k in range(4)]
        (source / f"{part}.json").write_text("".join(json.dumps(x) + "\n" for x in lines) + "oops\n")
        stream = runs.json_stream(spark, str(source), "run string, step bigint, loss double")
        runs.run_available(ST.smoothed_log(stream, 0.6, 24), str(target), str(state))
    for x in losses:
        last = x * 0.4 + 0.6 * (x if last is None else last)
        seen.append(last)
    rows = spark.read.parquet(str(target)).orderBy("step").collect()
    assert np.allclose([r["smoothed"] for r in rows], seen)
    assert rows[-1]["progress"] == round(11 / 24 * 100, 2)


def test_late_lines_change_their_own_part(spark, tmp_path, monkeypatch):
    """Lines in no order over five batches, repeated and empty ones among them, against one fold in step order."""
    monkeypatch.setattr(ST, "LOG_STEPS", 16)
    monkeypatch.setattr(SM, "ROWS", 3)  # several upper blocks
    source = tmp_path / "log"
    source.mkdir()
    rng = np.random.default_rng(2)
    lines = [{"run": r, "step": int(s), "loss": float(rng.random() + 0.1)} for r, n in (("a", 300), ("b", 5)) for s in rng.permutation(4 * n)[:n]]
    again = [{**x, "loss": x["loss"] - 0.05} for x in lines[::20]]
    empty = [{"run": "a", "step": 7, "loss": None}, {"run": "c", "step": None, "loss": 1.0}, {"run": "c", "step": 1, "loss": 0.0}]
    every = [(lines + again + empty)[k] for k in rng.permutation(len(lines) + len(again) + 3)]
    for part in range(5):
        (source / f"{part}.json").write_text("".join(json.dumps(x) + "\n" for x in every[part::5]) + "oops\n")
    stream = runs.json_stream(spark, str(source), "run string, step bigint, loss double")
    parts = runs.latest(ST.log_blocks(stream, 0.95), ["run", "part"], "late-log")
    rows = ST.smoothed_blocks(parts, 0.95, 1200).orderBy("run", "step").collect()
    expected = []
    for run in ("a", "b"):
        last = None
        for x in sorted((x for x in lines if x["run"] == run), key=lambda x: x["step"]):
            last = 0.05 * x["loss"] + 0.95 * (x["loss"] if last is None else last)
            expected.append((run, x["step"], last))
    assert [(r["run"], r["step"]) for r in rows] == [e[:2] for e in expected]
    assert np.allclose([r["smoothed"] for r in rows], [e[2] for e in expected], rtol=1e-12)


def test_running_moments_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    values = np.random.default_rng(1).normal(size=30)
    for part in range(3):
        (source / f"{part}.json").write_text("".join(json.dumps({"k": "a", "x": float(v)}) + "\n" for v in values[part::3]))
    stream = runs.json_stream(spark, str(source), "k string, x double")
    row = runs.latest(ST.running_moments(stream, ["k"], "x"), ["k"], "test-moments").first()
    assert row["n"] == 30 and np.isclose(row["variance"], values.var())


def test_streamed_table_of_several_files(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 3 AS label", "array(double(id), 1.0D) AS v", "id")
    rows.repartition(4, "id").write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "single.parquet")
    found = []
    for name in ("many", "single"):
        stream = runs.parquet_stream(spark, str(tmp_path), f"{name}.parquet", rows.schema)
        out = runs.latest(ST.vector_moments(stream.select("label", "v"), ["label"], "v"), ["label", "pos"], "moments")
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and [r[2] for r in found[0]] == [14, 14, 13, 13, 13, 13]

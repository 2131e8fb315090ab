"""Text functions and text metrics against small direct implementations."""

import json
import time
from collections import Counter
from math import exp, log

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import checks, prompts
from tallyloom.functions import text as X
from tallyloom.operators import lossstats as L
from tallyloom.operators import records as R
from tallyloom.operators import textmetrics as T

QUIET = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("the answer is 1,234", "1234"),
        ("42 7", "427"),
        ("12.00", "12"),
        ("12.50", X.NO_NUMBER),
        ("none", X.NO_NUMBER),
        ("-5", "-5"),
        ("a 3 b 4", "4"),
    ],
)
def test_last_integer(spark, text, expected):
    assert one(spark, "t string", (text,), X.last_integer("t")) == (expected,)


@pytest.mark.parametrize(
    "label, predict, same",
    [("#### 7", "it is 007", True), ("no", "none", True), ("no", "-999999999", True), ("1.5", "2", False), ("-0", "0", True)],
)
def test_math_match(spark, label, predict, same):
    assert one(spark, "l string, p string", (label, predict), checks.math_match("l", "p")) == (same,)


@pytest.mark.parametrize(
    "label, predict, same",
    [
        ("f(a=1, b='x')", 'ok  f(a=1,b="x") done', True),
        ("f(a=1)", "gf(a=1)", False),
        ("m.f(a=1)", "use m.f(a=1)", True),
        ("f(a[0]=1)", "f(a0=1)", False),
    ],
)
def test_call_match(spark, label, predict, same):
    assert one(spark, "l string, p string", (label, predict), checks.call_match("l", "p")) == (same,)


def test_malformed_call_is_an_error(spark):
    with pytest.raises(Exception, match="malformed"):
        one(spark, "l string, p string", ("not a call", "x"), checks.call_match("l", "p"))


def test_code_and_refusal(spark):
    ok = "Here is it\n```python\nx\n```"
    assert one(spark, "p string", (ok,), checks.code_answer_shape("p", "p")) == (True,)
    assert one(spark, "p string", ("x " + ok,), checks.code_answer_shape("p", "p")) == (False,)
    assert one(spark, "p string", ("this is Illegal",), checks.refuses("p")) == (False,)
    assert one(spark, "p string", ("this is illegal",), checks.refuses("p")) == (True,)
    assert one(spark, "p string", ("Your turn now",), checks.acceptable("p")) == (False,)
    assert one(spark, "p string", ("see MY Response",), checks.acceptable("p")) == (False,)


def test_slots_are_not_searched_again(spark):
    out = one(spark, "a string, b string", ("{{resp}}", "B"), prompts.chat_prompt(F.lit("gsm8k_distill"), "a", "b"))[0]
    assert "[INST] {{resp}}\n\nB [/INST]" in out


def test_prompt_families(spark):
    row = ("p", "b", "c")
    schema = "i string, b string, c string"
    assert one(spark, schema, row, prompts.instruction_prompt(F.lit("instruct"), "i", "b", "c")) == ("c\np\n\nb",)
    assert one(spark, schema, row, prompts.instruction_prompt(F.lit("octocoder"), "i", "b", "c")) == ("Question: p\nc\n\nAnswer:\nb",)
    assert one(spark, schema, row, prompts.instruction_prompt(F.lit("unknown"), "i", "b", "c")) == (None,)


def test_cuts(spark):
    assert one(spark, "t string", ("abXcdY",), X.before_first("t", ["Y", "X"]), X.after_first("t", "X"), X.after_last("t", "Z")) == (
        "ab",
        "cdY",
        "abXcdY",
    )
    text = "### Response: x\n```python\nprint(1)\n```\nbye"
    assert one(spark, "t string", (text,), R.unfenced("t")) == ("print(1)",)
    assert one(spark, "t string", ("Here's code\na\nb",), R.unfenced("t")) == ("a\nb",)
    assert one(spark, "t string", ("x = 1\n# Example usage\nx",), R.unfenced("t")) == ("x = 1",)


def test_answer_texts(spark):
    cases = {
        '{"output": " a "}': ["a"],
        '{"choices": [{"message": {"content": "b"}}, {"text": "c"}, "d"]}': ["b", "c", "d"],
        '{"messages": [{"content": "e"}, {"role": "x", "content": "f"}]}': ["e", "f"],
        '{"answer": {"text": "g"}}': ["g", "g"],
        '{"note": "this is a remark of more than twenty"}': ["this is a remark of more than twenty"],
        '{"note": "short"}': [],
        '["h", {"text": "i"}]': ["h", "i"],
        "{broken": [],
    }
    # nested deep, by a path that lists once, by two paths each level, and by names that no path knows
    once, twice, other = '"k"', '"k"', '"a remark that is longer than that"'
    for _ in range(200):
        once, other = f'{{"messages": [{once}]}}', f'{{"x": {other}, "messages": {{"note": 1}}}}'
    for _ in range(18):
        twice = f'{{"answer": {twice}}}'
    cases |= {once: ["k"], other: [], twice: ["k"] * 4181, '{"output": ' * 100_000: []}
    start = time.perf_counter()
    for text in (once, other):
        R._listed(json.loads(text))
    assert time.perf_counter() - start < 1
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", R.answer_texts("j").alias("t")).collect()
    assert {r["j"]: r["t"] for r in rows} == cases


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


@QUIET
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_overlap_and_lcs(spark, a, b):
    o, length = one(spark, "a array<string>, b array<string>", (a, b), T.overlap("a", "b", 4), T.longest_common_subsequence("a", "b"))
    assert length == lcs(a, b)
    for n in range(1, 5):
        ga = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        gb = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        assert o["matches"][n - 1] == sum((ga & gb).values())
        assert o["shared"][n - 1] == len(set(ga) & set(gb))
        assert (o["kinds_a"][n - 1], o["kinds_b"][n - 1]) == (len(ga), len(gb))


def bleu4(h, r):
    if not h or not set(h) & set(r):
        return 0.0
    total, zeros = 0.0, 0
    for n in range(1, 5):
        gh = Counter(h[i : i + n] for i in range(len(h) - n + 1))
        gr = Counter(r[i : i + n] for i in range(len(r) - n + 1))
        hits, size = sum((gh & gr).values()), max(1, sum(gh.values()))
        if hits:
            p = hits / size
        else:
            zeros += 1
            p = 1 / (2**zeros * size)
        total += log(p) / 4
    return exp(total) * (1.0 if len(h) >= len(r) else exp(1 - len(r) / len(h)))


@QUIET
@given(st.text("abcé ", max_size=25), st.text("abcé ", max_size=25))
def test_character_bleu(spark, h, r):
    out = one(spark, "h string, r string", (h, r), T.smoothed_bleu4(T.overlap("h", "r", 4)))[0]
    assert np.isclose(out, bleu4(h, r))


def test_rouge_l_whole_long_texts(spark):
    rng = np.random.default_rng(0)
    a, b = rng.choice(list("abcdefgh"), 700).tolist(), rng.choice(list("abcdefgh"), 900).tolist()
    assert one(spark, "a array<string>, b array<string>", (a, b), T.longest_common_subsequence("a", "b")) == (lcs(a, b),)


def catoni(y):
    m, alpha = y.mean(), 1 / (2 * (y.std() + 1e-12))
    for _ in range(200):
        t = np.tanh(alpha * (y - m))
        new = m - t.mean() / (-alpha * (1 - t**2).mean() - 1e-12)
        if abs(new - m) <= 1e-8:
            return new
        m = new
    return m


def test_catoni_both_forms(spark):
    y = np.random.default_rng(1).lognormal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": y}))
    grouped = L.catoni_means(df, ["g"], "v", "m").first()["m"]
    arrays = df.groupBy("g").agg(F.collect_list("v").alias("a")).select(L.array_catoni(F.col("a")).alias("m")).first()["m"]
    assert np.isclose(grouped, catoni(y), rtol=1e-10) and np.isclose(arrays, catoni(y))


def test_catoni_of_many_groups_and_without_a_job(spark):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(5, 2, 300), "heavy": rng.standard_cauchy(400), "one": np.array([3.5]), "same": np.full(9, -2.0),
        "two": np.array([0.0, 1e6]), "outlier": np.append(rng.normal(0, 1, 99), 1e9), "skewed": rng.pareto(1.1, 500) * 1e3,
    }
    rows = [(g, float(x)) for g, y in groups.items() for x in y] + [("normal", float("nan")), ("heavy", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("catoni", "plan")
    plan = L.catoni_means(df, ["g"], "v", "m")
    assert not tracker.getJobIdsForGroup("catoni")
    got = {r["g"]: r["m"] for r in plan.collect()}
    for g, y in groups.items():
        m, alpha = got[g], 1 / (2 * (y.std() + 1e-12))
        assert abs(np.tanh(alpha * (y - m)).mean()) < 1e-9, g
        assert abs(m - y.mean()) <= 3 * y.std() + 1e-9
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_poisson_weights_have_mean_one(spark):
    u = spark.range(100000).select(L.poisson_weight((F.col("id") + 0.5) / 100000).alias("w"))
    row = u.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(row["m"] - 1) < 1e-3 and abs(row["v"] - 1) < 1e-2


def test_subsamples_are_distinct_within_a_repeat(spark):
    rows = spark.range(100).withColumn("v", F.col("id") * 1.0)
    out = L.subsamples(rows, ["id"], 30, 10, "s").groupBy("rep").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    assert [(r["n"], r["d"]) for r in out.collect()] == [(30, 30)] * 10


def test_repeats_are_drawn_on_their_own(spark):
    """Rows of two repeats overlap as two independent draws do, at any table size; a small table is taken whole."""
    rows = spark.range(1000).withColumn("v", F.col("id") * 1.0)
    drawn = L.subsamples(rows, ["id"], 200, 40, "s").select("rep", "pos", "id").collect()
    sets = {}
    for r in drawn:
        sets.setdefault(r["rep"], set()).add(r["id"])
    shared = [len(sets[a] & sets[b]) for a in sets for b in sets if a < b]
    assert all(len(s) == 200 for s in sets.values()) and abs(np.mean(shared) - 40) < 2 and max(shared) < 75
    whole = L.subsamples(spark.range(5), ["id"], 30, 3, "s").groupBy("rep").agg(F.countDistinct("id").alias("n")).collect()
    assert [r["n"] for r in whole] == [5] * 3


def test_overlap_of_a_batch_is_that_of_its_rows(spark):
    rng = np.random.default_rng(2)
    pairs = [(list(rng.choice(list("abc"), rng.integers(0, 9))), list(rng.choice(list("abcd"), rng.integers(0, 9)))) for _ in range(60)]
    whole = T.batch_overlap([a for a, _ in pairs], [b for _, b in pairs], 4)
    for k, (a, b) in enumerate(pairs):
        alone = T.batch_overlap([a], [b], 4).iloc[0]
        grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
        clipped = [(grams(a, n) & grams(b, n)).total() for n in range(1, 5)]
        assert whole.iloc[k].tolist() == alone.tolist() and whole.iloc[k]["matches"] == clipped


def test_strip_leaves_what_its_pattern_leaves(spark):
    rng = np.random.default_rng(4)
    marks = list(" \t\n\r\f\x0b\x1c\x85\u00a0\u2028\u2029aé")
    rows = [("".join(rng.choice(marks, rng.integers(0, 9))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select("t", X.strip("t").alias("s"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("r"))
    assert df.where("NOT (s <=> r)").collect() == []


def test_repeat_weights_are_those_of_the_column(spark, monkeypatch):
    """Groups in several runs of rows, weights of every repeat against the column expression."""
    monkeypatch.setattr(L, "BOOT_ROWS", 64)
    rng = np.random.default_rng(6)
    rows = [(None if k % 3 == 0 else f"g{k % 3}", k % 2, float(rng.normal()), int(rng.integers(2**32)), int(rng.integers(2**32))) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, j int, v double, h long, s long").repartition(3)
    schema = "g string, j int, rep int, wx double, w long"
    got = df.mapInArrow(L._repeat_sums(2, 40), schema.replace("wx", "__wx").replace("w long", "__w long"))
    got = got.groupBy("g", "j", "rep").agg(F.sum("__wx").alias("x"), F.sum("__w").alias("w"))
    u = ((F.col("h") + F.col("rep") * F.col("s")) % 4294967296) / F.lit(4294967296.0)
    drawn = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("p", L.poisson_weight(u))
    wanted = drawn.groupBy("g", "j", "rep").agg(F.sum(F.col("v") * F.col("p")).alias("x"), F.sum("p").alias("w"))
    have, want = ({(r["g"], r["j"], r["rep"]): (r["x"], r["w"]) for r in t.collect()} for t in (got, wanted))
    assert have.keys() == want.keys() and len(have) == 6 * 40
    assert all(np.allclose(have[k], want[k]) and have[k][1] == want[k][1] for k in want)


def test_draws_are_spread_over_tasks(spark, monkeypatch):
    """Pieces of few bytes are not merged into one task before their draws are made."""
    seen = []
    monkeypatch.setattr(L, "DRAWS", 5)
    real = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: seen.append(a) or real(self, *a))
    df = spark.range(60).selectExpr("'a' AS g", "id AS k", "double(id) AS v")
    blocks = spark.createDataFrame([("a", 2)], "g string, block long")
    assert L.block_bootstrap_width(df, ["g"], "v", ["k"], blocks, 9, "s", "w").count() == 1
    assert any(a and a[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) for a in seen)


def test_hits_of_golds_are_clipped_and_placed(spark):
    golds = [("a", "x y x y"), ("a", "X Y"), ("a", "x x"), ("b", "q"), ("c", "z")]
    predictions = spark.createDataFrame([("a", "x y x"), ("b", "w"), ("d", "x")], "k string, p string")
    found = spark.createDataFrame([(["x", "y", "x"], ["x", "y", "x", "y"])], "a array<string>, b array<string>")
    hits = {(h["n"], h["place"]): h["hits"] for h in found.select(T.gram_hits("a", "b", 3).alias("h")).first()["h"]}
    assert hits == {(1, 0): 2, (1, 1): 1, (2, 0): 1, (2, 1): 1, (3, 0): 1}
    out = dict(map(tuple, T.reference_bleu(predictions, spark.createDataFrame(golds, "k string, g string"), "k", "p", "g").collect()))
    assert out.keys() == {"a", "b"} and out["b"] < 1e-60
    assert np.isclose(out["a"], 100.0)


def test_a_batch_of_long_texts_is_counted_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab é"), rng.integers(0, 90))) for _ in range(81)]
    a, b = texts[:40] + [None], texts[41:] + ["a"]
    whole, sizes, counted = T.batch_overlap(a, b, 3), [], T._counted
    monkeypatch.setattr(T, "UNITS", 200)
    monkeypatch.setattr(T, "_counted", lambda x, y, units, order: sizes.append(len(units)) or counted(x, y, units, order))
    assert T.batch_overlap(a, b, 3).equals(whole)
    assert len(sizes) > 10 and max(sizes) < 200 + 180


def test_hypotheses_need_all_their_numbers(spark):
    names = ("label", "coverage", "mse", "mean", "catoni", "mom", "pooled", "domain", "length", "ratio", "p90")

    def found(**facts):
        row = tuple(facts.get(n) for n in names)
        df = spark.createDataFrame([row], ", ".join(f"{n} {'string' if n == 'label' else 'double'}" for n in names))
        return {h["hypothesis"]: h["evidence"] for h in df.select(L.hypothesis_report(*[F.col(n) for n in names]).alias("h")).first()["h"]}

    assert found() == {"mixed": {}}
    assert set(found(domain=0.5)) == {"mixed"} and set(found(domain=0.5, length=1.0)) == {"conditional_bernstein_subgamma"}
    assert set(found(mean=2.0, mom=1.0)) == {"mixed"}
    assert found(ratio=1.5, p90=2.0)["dependence_present"] == {"mean_ordered_vs_naive_ratio": 1.5, "p90_ordered_vs_naive_ratio": 2.0}
    assert set(found(label="sub_gaussian_like", coverage=float("nan"))) == {"mixed"}


def test_interleave_and_pack(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 80, "a").otherwise("b").alias("s"))
    under = R.interleave(rows, "s", ["id"], {"a": 0.5, "b": 0.5}, "under", "x").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in under} == {"a": 20, "b": 20}
    over = R.interleave(rows, "s", ["id"], {"a": 0.5, "b": 0.5}, "over", "x").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in over} == {"a": 80, "b": 80}
    sized = rows.withColumn("n", (F.col("id") % 7 + 1))
    bins = R.pack_bins(sized, ["id"], "n", 10, 2, "p").groupBy("shard", "bin").agg(F.sum("n").alias("t"), F.max("n").alias("m"))
    assert all(r["t"] <= 10 + r["m"] + 7 for r in bins.collect())


def test_support_sets_take_distinct_rows(spark):
    targets = spark.range(20).select(F.col("id").alias("t"), F.lit("s").alias("g"))
    support = spark.range(4).select(F.col("id").alias("d"), F.lit("s").alias("g"))
    out = R.support_sets(targets, support, "g", "t", "d", 3, "x").groupBy("t").agg(F.countDistinct("d").alias("n"))
    assert {r["n"] for r in out.collect()} == {3}
    few = R.support_sets(targets, support.limit(2), "g", "t", "d", 3, "x").groupBy("t").agg(F.count("*").alias("n"))
    assert {r["n"] for r in few.collect()} == {2}

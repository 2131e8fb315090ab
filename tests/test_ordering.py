"""Distributed order statistics against pandas and NumPy, with heavy ties and one hot group."""

import hashlib

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import evalmetrics as E
from tallyloom.operators import lossstats as L
from tallyloom.operators import ordering as O

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def skewed(n=400, seed=0):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcde"), n))
    return pd.DataFrame({"g": group, "v": rng.integers(0, 12, n).astype(float), "id": np.arange(n), "w": rng.integers(1, 5, n)})


def test_running_totals_match_cumsum(spark):
    pdf = skewed()
    out = O.running_totals(
        spark.createDataFrame(pdf), ["g"], ["v", "id"], {"pos": None, "before": "w"}, {"n": None, "all": "w"}
    ).toPandas().sort_values("id")
    expected = pdf.sort_values(["g", "v", "id"])
    expected["pos"] = expected.groupby("g").cumcount()
    expected["before"] = expected.groupby("g")["w"].cumsum() - expected["w"]
    expected["n"] = expected.groupby("g")["w"].transform("size")
    expected["all"] = expected.groupby("g")["w"].transform("sum")
    expected = expected.sort_values("id")
    for c in ("pos", "before", "n", "all"):
        assert out[c].tolist() == expected[c].tolist()


def test_running_total_without_group_descending(spark):
    pdf = skewed(seed=1)
    out = O.positions(spark.createDataFrame(pdf), [], ["v", "id"], descending=True).toPandas()
    expected = pdf.sort_values(["v", "id"], ascending=False)["id"].tolist()
    assert out.sort_values("pos")["id"].tolist() == expected


def test_row_numbers_with_ties_nulls_and_computed_order(spark):
    rng = np.random.default_rng(7)
    values = [None if v == 0 else int(v) for v in rng.integers(0, 9, 500)]
    rows = spark.createDataFrame(list(zip(values, range(500))), "v int, id int").repartition(7)
    up = [i for _, i in sorted(zip(values, range(500)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    down = [i for _, i in sorted(zip(values, range(500)), key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))]
    for order, descending, expected in (
        (["v", "id"], False, up),
        (["v", "id"], True, down),
        (["v", F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 3, "0"))], False, up),
    ):
        out = O.positions(rows, [], order, "p", descending=descending)
        assert out.columns == ["v", "id", "p"] and dict(out.dtypes)["p"] == "bigint"
        got = sorted((r["p"], r["id"]) for r in out.collect())
        assert got == list(enumerate(expected))
    assert O.positions(rows.where("id < 0"), [], ["id"], "p").collect() == []


def test_numbered_rows_are_dealt_out_once(spark):
    """After the slices are written the rows are neither shuffled nor sorted again."""
    out = O.positions(spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("text")), [], ["text"], "p")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Sort [" in line]
    assert plan.count("FileScan") == 2 and not [line for line in dealt if "text" in line or "id#" in line.replace("plan_id", "")]
    assert "SortMergeJoin" not in plan


@QUIET
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.floats(0, 1))
def test_quantiles_match_numpy(spark, values, q):
    df = spark.createDataFrame([("x", float(v)) for v in values], "g string, v double")
    out = O.exact_quantiles(df, ["g"], "v", {"q": q}).first()["q"]
    assert np.isclose(out, np.quantile(values, q))


@QUIET
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.25, 0.49]))
def test_trimmed_mean(spark, values, alpha):
    df = spark.createDataFrame([("x", float(v)) for v in values], "g string, v double")
    out = O.trimmed_means(O.ranked_values(df, ["g"], "v"), ["g"], "v", alpha, "t").first()["t"]
    y, n = np.sort(values), len(values)
    k = int(max(0, min(n // 2 - 1, np.floor(alpha * n))))
    assert np.isclose(out, y[k : n - k].mean())


def test_average_ranks_and_spearman(spark):
    pdf = skewed(seed=2)
    out = O.average_ranks(spark.createDataFrame(pdf), ["g"], "v", "r").toPandas().sort_values("id")
    assert np.allclose(out["r"], pdf.groupby("g")["v"].rank().to_numpy())
    rho = E.spearman(spark.createDataFrame(pdf), ["g"], "v", "w").toPandas().set_index("g")["spearman"]
    for g, sub in pdf.groupby("g"):
        expected = np.corrcoef(sub["v"].rank(), sub["w"].rank())[0, 1]
        assert np.isclose(rho[g], expected)


def test_correlation_matrices_with_missing_values(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: rng.integers(0, 9, 300).astype(float) for c in ("a", "b")})
    pdf["b"] += pdf["a"] / 2 + 1e6
    pdf["flat"], pdf["none"] = 0.1, np.nan
    pdf["rare"] = np.where(np.arange(300) == 7, 1.0, np.nan)
    pdf.loc[rng.random(300) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(300) < 0.2, "b"] = np.nan
    pdf = pd.concat([pdf, pdf.iloc[:40]])  # repeated rows
    columns = list(pdf.columns)
    rows = [tuple(None if x != x else float(x) for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    out = {(r["a"], r["b"]): (r["pearson"], r["spearman"]) for r in E.correlation_matrices(df, columns).collect()}
    assert not [p for p in out if "none" in p]
    for x in ("a", "b"):
        for y in ("a", "b"):
            u, v = (pdf.loc[pdf[x].notna() & pdf[y].notna(), c] for c in (x, y))
            assert np.allclose(out[x, y], (np.corrcoef(u, v)[0, 1], np.corrcoef(u.rank(), v.rank())[0, 1]))
    assert all(v == (None, None) for p, v in out.items() if set(p) & {"flat", "rare"})
    assert E.correlation_matrices(df.where("false"), columns).count() == 0


def test_autocorrelation_over_slices(spark, monkeypatch):
    monkeypatch.setattr(L, "SEQUENCE_SLICE", 16)
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for g, n in ((1, 137), (2, 6), (3, 40)):
        x = np.cumsum(rng.normal(size=n)) if g != 3 else np.ones(n)
        rows += [(g, k, float(v), n) for k, v in enumerate(x)]
        for lag in (1, 2, 5):
            if n > lag + 1:
                expected[g, lag] = np.corrcoef(x[:-lag], x[lag:])[0, 1] if g != 3 else None
    df = spark.createDataFrame(rows, "g int, pos long, v double, n long").repartition(4)
    out = {(r["g"], r["lag"]): r["acf"] for r in L.autocorrelation(df, ["g"], "pos", "v", [1, 2, 5], "n").collect()}
    assert out.keys() == expected.keys()
    assert all(out[k] is None if v is None else np.isclose(out[k], v) for k, v in expected.items())
    gaps = df.where("g = 1 AND pos <> 15 AND pos <> 16")
    x = np.array([np.nan if k in (15, 16) else v for g, k, v, n in rows if g == 1])
    ok = ~np.isnan(x[:-2]) & ~np.isnan(x[2:])
    got = L.autocorrelation(gaps, ["g"], "pos", "v", [2], "n").first()["acf"]
    assert np.isclose(got, np.corrcoef(x[:-2][ok], x[2:][ok])[0, 1])


def test_block_bootstrap_equals_concatenated_draws(spark, monkeypatch):
    """Draws in small pieces, a shorter last block, against the blocks laid one after another and cut at n."""
    monkeypatch.setattr(L, "DRAWS", 5)
    values = {"a": np.random.default_rng(5).normal(size=47).round(3), "b": np.arange(40.0)}
    size = {"a": 2, "b": 7}
    rows = [(g, k, float(v)) for g, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    blocks = spark.createDataFrame(list(size.items()), "g string, block long")
    out = {r["g"]: r["w"] for r in L.block_bootstrap_width(df, ["g"], "v", ["k"], blocks, 30, "s", "w").collect()}
    for g, vs in values.items():
        count, means = -(-len(vs) // size[g]), []
        for rep in range(30):
            draws = [int(hashlib.md5(f"s:{g}:{rep}:{d}".encode()).hexdigest()[:8], 16) % count for d in range(count)]
            taken = np.concatenate([vs[b * size[g] : (b + 1) * size[g]] for b in draws])[: len(vs)]
            means.append(taken.sum() / len(vs))
        assert np.isclose(out[g], np.quantile(means, 0.975) - np.quantile(means, 0.025))


def test_survival_points_of_ties_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "POINTS", 4)
    tail = spark.createDataFrame([("a", 1.0, 0, 9, 10), ("a", 2.0, 9, 1, 10)], "g string, x double, before long, cnt long, total long")
    out = sorted((r["idx"], r["x"], r["s"]) for r in L.survival_points(tail, ["g"]).collect())
    assert out == [(k, 1.0 if k < 9 else 2.0, (10 - k) / 10) for k in range(10)]


def test_last_before_over_slices(spark):
    """One marker for thousands of rows, markers of their own group only, nothing before the first."""
    rows = [("a", k, f"m{k}" if k in (3, 700) else None) for k in range(3000)] + [("b", k, None) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, m string").repartition(4)
    out = {(r["g"], r["k"]): r["c"] for r in O.last_before(df, ["g"], ["k"], "m", "c").collect()}
    expected = {("a", k): None if k <= 3 else "m3" if k <= 700 else "m700" for k in range(3000)}
    assert out == expected | {("b", k): None for k in range(50)}


def test_near_equal_blocks_match_array_split(spark):
    for n, k in ((10, 3), (7, 7), (23, 8), (8, 8)):
        rows = spark.range(n).select("id", O.near_equal_block(F.col("id"), F.lit(n), F.lit(k)).alias("b")).collect()
        expected = [b for b, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
        assert [r["b"] for r in sorted(rows, key=lambda r: r["id"])] == expected


def test_exponential_smoothing_across_blocks(spark):
    n = 3 * E.smoothing.ROWS + 17
    x = np.random.default_rng(3).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"s": "run", "t": np.arange(n), "x": x}))
    out = E.exponential_smoothing(df, ["s"], ["t"], "x").toPandas().sort_values("pos")
    w = 1.8 * (1 / (1 + np.exp(-0.05 * n)) - 0.5)
    last, expected = x[0], []
    for v in x:
        last = last * w + (1 - w) * v
        expected.append(last)
    assert np.allclose(out["smoothed"], expected, rtol=1e-12)


def test_smoothing_keeps_the_whole_history(spark, monkeypatch):
    """A weight near 1, blocks of 4 rows and upper blocks of 4 blocks; a series without a name and one of one row."""
    monkeypatch.setattr(E.smoothing, "ROWS", 4)
    rng = np.random.default_rng(8)
    rows, expected = [], {}
    for s, n in (("a", 150), (None, 33), ("one", 1)):
        x = rng.normal(size=n) + 5
        last = x[0]
        for k, v in enumerate(x):
            rows.append((s, k, float(v), 0.999, n))
            last = last * 0.999 + 0.001 * v
            expected[s, k] = last
    df = spark.createDataFrame(rows, "s string, p long, x double, w double, n long").repartition(5)
    out = {(r["s"], r["p"]): r["y"] for r in E.smoothing.smoothed(df, ["s"], "p", "x", "w", "n", "y").collect()}
    assert out.keys() == expected.keys()
    assert all(np.isclose(out[k], v, rtol=1e-12) for k, v in expected.items())
    assert E.smoothing.smoothed(df.where("false"), ["s"], "p", "x", "w", "n", "y").count() == 0


def test_survival_grid(spark):
    rng = np.random.default_rng(4)
    for n in (5, 40, 41, 300):
        x = np.round(rng.exponential(size=n), 2) + 0.01
        df = spark.createDataFrame([("g", float(v)) for v in x], "g string, x double")
        out = L.survival_grid(O.ranked_values(df, ["g"], "x"), ["g"], 40).toPandas().sort_values("idx")
        idx = np.arange(n) if n <= 40 else np.unique(np.linspace(0, n - 1, 40).astype(int))
        assert out["idx"].tolist() == idx.tolist()
        assert np.allclose(out["x"], np.sort(x)[idx])
        assert np.allclose(out["s"], (n - idx) / n)


def test_moments_and_quantiles_from_ranked_values(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([1e8 + np.round(rng.normal(size=300), 1), [np.nan]])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)], "g string, x double")
    got = {r["g"]: r for r in L.moments_and_quantiles(df, ["g"], "x", {"q": 0.9}).collect()}
    own = x[:-1]
    a = got["a"]
    assert a["n"] == 300 and np.isclose(a["mean"], own.mean(), rtol=1e-14) and np.isclose(a["q"], np.quantile(own, 0.9))
    assert np.isclose(a["std"], own.std(), rtol=1e-6) and np.isclose(a["var"], own.var(ddof=1), rtol=1e-6)
    assert (got["b"]["n"], got["b"]["std"], got["b"]["var"], got["b"]["q"]) == (1, 0.0, 0.0, 2.0)


def test_short_tails_keep_their_group(spark):
    """Too few points give a row without fits; a thin slice falls back on the whole positive tail."""
    rng = np.random.default_rng(9)
    rows = [("short", float(v)) for v in rng.normal(size=12)] + [("thin", float(v)) for v in rng.normal(size=60)]
    rows += [("constant", 1.0)] * 20 + [("long", float(v)) for v in rng.exponential(size=2000)]
    out = L.tail_shape_strict(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()
    got = {r["g"]: r for r in out}
    assert set(got) == {"short", "thin", "constant", "long"}
    assert got["short"]["weibull_slope"] is None and got["constant"]["label_code"] is None
    positive = [v - np.mean([x for g, x in rows if g == "thin"]) for g, v in rows if g == "thin"]
    assert got["thin"]["n_points"] == sum(v > 0 for v in positive) - 1 and got["thin"]["weibull_r2"] is not None
    assert got["long"]["label"] is not None


def test_a_tail_is_not_dealt_out_by_its_group(spark):
    """Slicing a tail joins facts of a row per group, which are small when the join is planned."""
    rows = [(g, float(x)) for g in "ab" for x in np.random.default_rng(8).exponential(size=400).round(4)]
    df = spark.createDataFrame(rows, "g string, x double")
    sliced = L.quantile_slice(L.positive_tail(df, ["g"], "x"), ["g"], 0.5, 0.99)
    plan = sliced._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_correlations_join_only_columns_of_many_values(spark):
    """Ranks of a column of few values are broadcast, and columns without a value give no pair."""
    df = spark.range(500).selectExpr("double(id % 3) AS few", "double(id * 7 % 499) AS many", "cast(NULL AS double) AS none")
    pdf = df.toPandas()
    out = {(r["a"], r["b"]): r["spearman"] for r in E.correlation_matrices(df, df.columns).collect()}
    assert out.keys() == {(a, b) for a in ("few", "many") for b in ("few", "many")}
    assert np.isclose(out["few", "many"], np.corrcoef(pdf["few"].rank(), pdf["many"].rank())[0, 1])

"""Matrix and influence operators against the row-by-row formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tiles
from tallyloom.operators import gradients as GR
from tallyloom.operators import gram, moments
from tallyloom.operators import influence as I
from tallyloom.operators import matrices as M

RNG = np.random.default_rng(7)
G = RNG.normal(size=(60, 6))
V = RNG.normal(size=6)


def frame(spark, rows, name="g", **extra):
    pdf = pd.DataFrame({"vec_id": np.arange(len(rows)), "layer": 0, name: [r.tolist() for r in rows], **extra})
    schema = f"vec_id long, layer int, {name} array<double>" + "".join(f", {k} long" for k in extra)
    return spark.createDataFrame(pdf, schema)


def cells(spark, m, key="m"):
    rows = [(key, i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "matrix_id string, i int, j int, v double")


@pytest.fixture(scope="module")
def parts(spark):
    train = frame(spark, G)
    target = spark.createDataFrame([(0, V.tolist())], "layer int, v array<double>")
    return train, target, I.layer_damping(train)


def loop_closed(v, g, lam):
    return sum((v - (v @ x) / (lam + x @ x) * x) / (len(g) * lam) for x in g)


LAM = float(np.mean(G**2)) / 10


def test_damping(parts):
    row = parts[2].first()
    assert np.isclose(row["lam"], LAM) and row["n"] == len(G)


def test_closed_form(parts):
    assert np.allclose(I.hvp_closed_form(*parts).first()["hvp"], loop_closed(V, G, LAM))


def test_lissa(parts):
    r = V.copy()
    for _ in range(10):
        r = V + r - sum(((x @ r) * x - LAM * r) / len(G) for x in G)
    assert np.allclose(I.hvp_lissa(*parts).first()["hvp"], r)


def test_exact(parts):
    expected = np.linalg.solve(LAM * np.eye(6) + G.T @ G / len(G), V)
    assert np.allclose(I.hvp_exact(*parts).first()["hvp"], expected)


def test_blocked_products_and_systems(spark, monkeypatch):
    """Layers of 3 and 1 blocks, the last block narrower, against the dense forms; equal training rows count each."""
    monkeypatch.setattr(I.blocks, "SIZE", 3)
    wide, narrow = np.concatenate([RNG.normal(size=(30, 7)), np.ones((12, 7))]), RNG.normal(size=(9, 2))
    rows = [(0, x.tolist()) for x in wide] + [(1, x.tolist()) for x in narrow]
    train = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "vec_id long, layer int, g array<double>")
    v = [RNG.normal(size=7), RNG.normal(size=2)]
    target = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "layer int, v array<double>")
    damping = I.layer_damping(train)
    exact = {r["layer"]: r["hvp"] for r in I.hvp_exact(train, target, damping).collect()}
    lissa = {r["layer"]: r["hvp"] for r in I.hvp_lissa(train, target, damping, iterations=4).collect()}
    for layer, g in enumerate((wide, narrow)):
        lam, c = np.mean(g**2) / 10, g.T @ g / len(g)
        assert np.allclose(exact[layer], np.linalg.solve(c + lam * np.eye(len(c)), v[layer]))
        r = v[layer]
        for _ in range(4):
            r = v[layer] + r - (c @ r - lam * r)
        assert np.allclose(lissa[layer], r)
    assert I.hvp_exact(train.where("false"), target, damping).count() == 0
    assert I.hvp_lissa(train.where("false"), target, damping, iterations=2).count() == 0


def test_closed_form_is_exact_for_one_sample(spark):
    one = frame(spark, G[:1])
    damping = I.layer_damping(one)
    target = spark.createDataFrame([(0, V.tolist())], "layer int, v array<double>")
    assert np.allclose(I.hvp_closed_form(one, target, damping).first()["hvp"], I.hvp_exact(one, target, damping).first()["hvp"])


def test_many_targets_and_blocked_product(spark, parts, monkeypatch):
    monkeypatch.setattr(I, "SLICE_ROWS", 16)
    monkeypatch.setattr(I, "BLOCK_ROWS", 4)
    train, _, damping = parts
    val = RNG.normal(size=(9, 6))
    hvps = I.hvp_many(train, frame(spark, val).withColumnRenamed("vec_id", "val_id"), damping, "val_id")
    out = I.influence_matrix(train, hvps, "vec_id", "val_id").toPandas()
    assert len(out) == len(G) * len(val)
    got = out.pivot(index="vec_id", columns="val_id", values="influence").to_numpy()
    expected = -np.stack([G @ loop_closed(v, G, LAM) for v in val], axis=1)
    assert np.allclose(got, expected)


@pytest.mark.parametrize("damping", [0.3, 0.0])
def test_pair_scores_equal_loop_and_count_skipped(spark, damping):
    a = RNG.normal(size=(3, 6))
    rows = frame(spark, G).select("vec_id", F.lit("s").alias("suite"), "g")
    skipped = spark.createDataFrame([(1000 + k, "s", None) for k in range(5)], "vec_id long, suite string, g array<double>")
    objects = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(a)], "suite string, o int, a array<double>")
    out = I.pair_scores(rows.unionByName(skipped), objects, ["suite"], "o", "a", damping).collect()
    n = len(G) + 5
    for r in out:
        v1, v2 = a[r["a"]], a[r["b"]]
        total = sum(v1 - (v1 @ x) / (damping + x @ x) * x for x in G)
        expected = total @ v2 / (n * damping if damping else n)
        assert np.isclose(r["score"], expected)
    assert len(out) == 6


def test_gram_sums_and_mirror(spark):
    out = gram.mirror(gram.gram_sums(frame(spark, G), ["layer"], "g"), ["layer"]).toPandas()
    assert np.allclose(out.pivot(index="i", columns="j", values="v"), G.T @ G)


def triangle(out, width):
    m = np.zeros((width, width))
    m[out["i"], out["j"]] = out["v"]
    return np.triu(m) + np.triu(m, 1).T


@pytest.mark.parametrize("block,budget", [(4, 1 << 30), (2, 1), (6, 1), (100, 1 << 30)])
def test_gram_blocks_and_budget_change_nothing(spark, monkeypatch, block, budget):
    monkeypatch.setattr(gram, "BLOCK", block)
    monkeypatch.setattr(gram, "BUDGET", budget)
    rows = frame(spark, G).withColumn("k", F.col("vec_id") % 3).withColumn("w", F.col("vec_id") * 0.5).repartition(4)
    out = gram.gram_sums(rows, ["k"], "g", "w").toPandas()
    for k in range(3):
        own = G[k::3]
        assert np.allclose(triangle(out[out["k"] == k], 6), own.T @ (own * (np.arange(60)[k::3] * 0.5)[:, None]))


def test_gram_refuses_ragged_vectors_and_skips_missing_ones(spark):
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0])], "vec_id long, g array<double>").coalesce(1)
    with pytest.raises(Exception, match="components cannot be summed"):
        gram.gram_sums(ragged, [], "g").collect()
    missing = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "vec_id long, g array<double>").coalesce(1)
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert np.allclose(triangle(gram.gram_sums(missing, [], "g").toPandas(), 2), x.T @ x)


def test_moments_skip_nan_rows(spark):
    bad = np.full((1, 6), np.nan)
    row = GR.gradient_moments(frame(spark, np.vstack([G, bad])), ["layer"], "g").first()
    assert row["n"] == len(G) and np.isclose(row["trace_cov"], G.var(axis=0).sum())


def test_spectra_and_coordinates(spark):
    k = G[:5] @ G[:5].T
    spectrum = M.spectra(cells(spark, k), ["matrix_id"])
    values = [r["eig_re"] for r in spectrum.orderBy("k").collect()]
    assert np.allclose(values, np.linalg.eigvalsh(k)[::-1]) and np.isclose(sum(values), np.trace(k))
    row = M.spectral_diagnostics(spectrum, ["matrix_id"]).first()
    assert row["is_symmetric"] and np.isclose(row["condition"], np.linalg.cond(k))
    lopsided = M.spectra(cells(spark, np.triu(k)), ["matrix_id"]).first()
    assert not lopsided["symmetric"]
    indefinite = np.array([[1.0, 2.0], [2.0, 1.0]])
    z = M.coordinates(M.spectra(cells(spark, indefinite), ["matrix_id"]), ["matrix_id"]).toPandas()
    re = z.pivot(index="k", columns="obj", values="re").to_numpy()
    im = z.pivot(index="k", columns="obj", values="im").to_numpy()
    assert np.allclose(re.T @ re - im.T @ im, indefinite)


def test_hsic_cka_of_non_symmetric_matrices(spark):
    x, y = RNG.normal(size=(6, 6)), RNG.normal(size=(6, 6))
    h = np.eye(6) - 1 / 6
    xc, yc = h @ x @ h, h @ y @ h
    row = M.hsic_cka(cells(spark, x), cells(spark, y), ["matrix_id"]).first()
    assert np.isclose(row["hsic"], np.trace(xc @ yc) / 25)
    assert np.isclose(row["cka"], (xc * yc).sum() / np.sqrt((xc**2).sum() * (yc**2).sum()))
    assert np.isclose(M.hsic_cka(cells(spark, x), cells(spark, x), ["matrix_id"]).first()["cka"], 1.0)


def test_common_block(spark):
    a, b = M.common_block(cells(spark, np.eye(4)), cells(spark, np.eye(3)), ["matrix_id"])
    assert a.count() == b.count() == 9


def brute_cca(x, y, sigma):
    def centred(z):
        n = len(z)
        h = np.eye(n) - 1 / n
        d = ((z[:, None] - z[None]) ** 2).sum(-1)
        k = z @ z.T if sigma is None else np.exp(-d / (2 * sigma**2 * z.shape[1]))
        return k @ h

    n = len(x)
    kx, ky = centred(x), centred(y)
    rx = kx @ np.linalg.inv(kx + 1e-5 * n * np.eye(n))
    ry = ky @ np.linalg.inv(ky + 1e-5 * n * np.eye(n))
    return (rx * ry.T).sum()


@pytest.mark.parametrize("sigma", [None, 50.0, 1.0, 0.3])
def test_normalized_cca_equals_brute_force(spark, sigma):
    x, y = RNG.normal(size=(60, 4)) / 2, RNG.normal(size=(60, 3)) / 2
    y[:, 0] += x[:, 0]
    x[40:], y[40:] = x[0], y[0]  # a third of all rows are equal
    pdf = pd.DataFrame({"k": [None] * 60, "x": x.tolist(), "y": y.tolist()})
    df = spark.createDataFrame(pdf, "k int, x array<double>, y array<double>").repartition(3)
    row = moments.normalized_cca(df, ["k"], "x", "y", 4, 3, sigma).first()
    assert row["status"] == "success" and row["n"] == 60 and row["error"] < 1e-6
    assert np.isclose(row["value"], brute_cca(x, y, sigma), rtol=1e-9, atol=1e-6)


def test_normalized_cca_of_many_rows(spark, monkeypatch):
    """Wide kernels need few pivots; slices of a group add up; a rank that is too small widens the error, not the status of others."""
    monkeypatch.setattr("tallyloom.operators.kernels.SLICE", 200)
    x, y = RNG.normal(size=(1500, 3)), RNG.normal(size=(1500, 2))
    y[:, 0] += x[:, 0]
    pdf = pd.DataFrame({"k": 0, "x": x.tolist(), "y": y.tolist()})
    df = spark.createDataFrame(pdf, "k int, x array<double>, y array<double>").repartition(5)
    expected = brute_cca(x, y, 2.0)
    row = moments.normalized_cca(df, ["k"], "x", "y", 3, 2, 2.0).first()
    assert row["status"] == "success" and abs(row["value"] - expected) < 1e-6
    loose = moments.normalized_cca(df, ["k"], "x", "y", 3, 2, 2.0, most_rank=12).first()
    assert loose["status"] == "loose" and abs(loose["value"] - expected) < loose["error"]


def test_normalized_cca_of_unusable_rows(spark):
    nan = float("nan")
    rows = [(1, [0.1, 0.2], [1.0]), (2, None, [1.0]), (2, [0.1, nan], [1.0]), (2, [0.3, 0.1], [None]), (3, [0.0, 0.0], [2.0])] + [
        (3, [0.0, 0.0], [2.0])
    ]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    out = {r["k"]: (r["n"], r["status"], r["value"]) for r in moments.normalized_cca(df, ["k"], "x", "y", 2, 1).collect()}
    assert out == {1: (1, "failed", None), 3: (2, "success", 0.0)}
    assert moments.normalized_cca(df.where("false"), ["k"], "x", "y", 2, 1).count() == 0


def brute_entropy(x, scale):
    z = x / scale
    n, d = z.shape
    cov = np.cov(z, rowvar=False).reshape(d, d) * n ** (-2.0 / (d + 4))
    gap = z[:, None] - z[None]
    near = np.exp(-np.einsum("ijk,kl,ijl->ij", gap, np.linalg.inv(cov), gap) / 2)
    p = near.mean(1) / np.sqrt(np.linalg.det(2 * np.pi * cov))
    return -np.mean(np.log(p + 1e-12))


def test_density_entropies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.operators.kernels.SLICE", 100)
    p, q = RNG.normal(size=(400, 2)) * [3.0, 0.01], RNG.exponential(size=(150, 2))
    q[100:] = q[0]  # a third of all rows are equal
    flat = np.stack([np.arange(9.0), np.ones(9)], 1)
    rows = [(1, part, r.tolist()) for part, m in (("p", p), ("q", q), ("flat", flat)) for r in m]
    rows += [(1, "p", None), (1, "p", [float("nan"), 1.0]), (2, "q", [1.0, 2.0]), (2, "q", [2.0, 0.0]), (2, "q", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, part string, x array<double>").repartition(4)
    out = {(r["k"], r["part"]): r for r in moments.density_entropies(df, ["k"], "part", "x", "p").collect()}
    for part, m in (("p", p), ("q", q)):
        row = out[1, part]
        assert row["status"] == "success" and row["n"] == len(m) and row["error"] < 1e-6
        assert abs(row["entropy"] - brute_entropy(m, p.std(0))) < 1e-6
    assert out[1, "flat"]["status"] == out[2, "q"]["status"] == "failed" and out[2, "q"]["entropy"] is None
    loose = moments.density_entropies(df, ["k"], "part", "x", "p", most_rank=20).where("k = 1 AND part = 'p'").first()
    assert loose["status"] == "loose" and abs(loose["entropy"] - brute_entropy(p, p.std(0))) < loose["error"]
    assert moments.density_entropies(df.where("false"), ["k"], "part", "x", "p").count() == 0


def test_content_style(spark):
    raw, rew = G[:4], G[4:8]
    pdf = pd.DataFrame({"k": 0, "raw": raw.tolist(), "rew": rew.tolist()})
    split = moments.content_style(spark.createDataFrame(pdf, "k int, raw array<double>, rew array<double>"), "raw", "rew")
    m, d = ((raw + rew) / 2).T, ((raw - rew) / 2).T
    row = moments.leakage(split, ["k"], 6).first()
    assert np.isclose(row["a_leak"], np.linalg.norm(m.T @ d) / (np.linalg.norm(m) * np.linalg.norm(d)))
    qm, qd = np.linalg.qr(m)[0], np.linalg.qr(d)[0]
    cosines = np.clip(np.linalg.svd(qm.T @ qd, compute_uv=False), -1, 1)
    angles = moments.principal_angles(split, ["k"], 6).first()
    assert np.allclose(angles["angles"], np.degrees(np.arccos(cosines)), atol=1e-4)
    assert np.isclose(angles["content_top"], np.linalg.eigvalsh(m @ m.T / 4)[-1])


def test_kernel_matrices(spark):
    k = G[:5] @ G[:5].T
    d = np.abs(np.diag(k)[:, None] + np.diag(k)[None] - 2 * k)
    stacked = np.abs(np.block([[d, d], [d, d]]))[np.tril_indices(10, -1)]
    s = max(np.median(stacked), 1e-2)
    h = np.eye(5) - 1 / 5
    expected = np.exp(-d / (2 * s * s)) @ h
    out = M.kernel_matrix(cells(spark, k), ["matrix_id"], "gaussian", None, 6).toPandas()
    assert np.allclose(out.pivot(index="i", columns="j", values="v"), expected)
    out = M.kernel_matrix(cells(spark, k), ["matrix_id"], "gaussian", 50.0, 6).toPandas()
    assert np.allclose(out.pivot(index="i", columns="j", values="v"), np.exp(-d / (2 * 2500 * 6)) @ h)


def test_pairs_of_objects_by_tiles(spark):
    """More objects than a part, several lengths, a zero and a NULL vector, a group of one, a repeated object."""
    rng = np.random.default_rng(11)
    rows = [("g", f"o{k}", rng.normal(size=3 + (k % 9 == 0)).tolist()) for k in range(40)]
    rows += [("g", "zero", [0.0, 0.0, 0.0]), ("g", "none", None), ("g", "o1", rows[1][2]), ("h", "o1", [1.0]), (None, "o1", [])]
    df = spark.createDataFrame(rows, "s string, o string, v array<double>").repartition(3)
    got = tiles.vector_pairs(df, ["s"], "o", "v", part=7).collect()
    expected = []
    for k, (s, o, v) in enumerate(rows):
        for t, p, w in rows[k:]:
            if s == t:
                same = v is not None and w is not None and len(v) == len(w)
                norms = {n: None if x is None else round(float(np.linalg.norm(x)), 9) for n, x in ((o, v), (p, w))}
                a, b = sorted((o, p))
                expected.append((str(s), a, b, same, norms[a], norms[b], round(float(np.dot(v, w)), 9) if same else None))
    places = lambda x: None if x is None else round(x, 9) + 0.0
    found = [(str(r["s"]), r["a"], r["b"], r["same_size"], places(r["norm_a"]), places(r["norm_b"]), places(r["dot"])) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)
    names = tiles.name_pairs(df, "o", part=5).collect()
    every = sorted({o for _, o, _ in rows})
    assert sorted(map(tuple, names)) == [(a, b) for k, a in enumerate(every) for b in every[k:]]
    assert tiles.vector_pairs(df.where("false"), ["s"], "o", "v").count() == tiles.name_pairs(df.where("false"), "o").count() == 0

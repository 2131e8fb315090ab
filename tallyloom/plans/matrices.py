"""Matrix, kernel and information measures over Gram matrices of the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import gradients
from tallyloom.operators import influence as I
from tallyloom.operators import matrices as M
from tallyloom.operators import moments
from tallyloom.plans.fixtures import CTE, NEEDS, layered, vectors, with_ctes
from tallyloom.plans.influence import label_objects, rounded
from tallyloom.plans.registry import query

CTE["lm"] = """
SELECT layer, CASE WHEN is_val THEN 'sdft' ELSE 'sft' END AS method, label AS obj, pos, avg(x) AS a
FROM lay GROUP BY ALL"""
CTE["gm"] = """
SELECT x.layer, x.method, x.obj AS i, y.obj AS j, sum(x.a * y.a) AS v
FROM lm x JOIN lm y ON x.layer = y.layer AND x.method = y.method AND x.pos = y.pos GROUP BY ALL"""
CTE["cm"] = """
SELECT g.layer, g.method, g.i, g.j, g.v, CASE WHEN g.i = g.j THEN 1.0::DOUBLE ELSE g.v / sqrt(di.v * dj.v) END AS c
FROM gm g JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j"""
NEEDS.update({"lm": ("lay",), "gm": ("lm",), "cm": ("gm",)})

# double centering of a CTE (layer, method, i, j, v)
CENTERED = """
SELECT k.layer, k.method, k.i, k.j, k.v - r.m - c.m + g.m AS v FROM {0} k
JOIN (SELECT layer, method, i, avg(v) AS m FROM {0} GROUP BY ALL) r ON r.layer = k.layer AND r.method = k.method AND r.i = k.i
JOIN (SELECT layer, method, j, avg(v) AS m FROM {0} GROUP BY ALL) c ON c.layer = k.layer AND c.method = k.method AND c.j = k.j
JOIN (SELECT layer, method, avg(v) AS m FROM {0} GROUP BY ALL) g ON g.layer = k.layer AND g.method = k.method"""
CTE["ctr"] = CENTERED.format("gm")
CTE["gk"] = """
SELECT d.layer, d.method, d.i, d.j, exp(-d.v / (2 * s.q)) AS v FROM (
  SELECT g.layer, g.method, g.i, g.j, di.v + dj.v - 2 * g.v AS v FROM gm g
  JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
  JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j) d
JOIN (SELECT g.layer, g.method, median(di.v + dj.v - 2 * g.v) AS q FROM gm g
  JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
  JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j
  WHERE g.i < g.j GROUP BY ALL) s ON s.layer = d.layer AND s.method = d.method"""
CTE["gkc"] = CENTERED.format("gk")
NEEDS.update({"ctr": ("gm",), "gk": ("gm",), "gkc": ("gk",)})


def gram_cells(spark, sf_dir):
    """(layer, method, i, j, v): Gram matrices between label means, full squares."""
    rows = layered(vectors(spark, sf_dir)).withColumn("method", F.when(F.col("is_val"), "sdft").otherwise("sft"))
    objects = label_objects(rows, "layer", "method")
    cells = I.object_gram(objects, ["layer", "method"], "label", "a")
    full = gradients.mirror_pairs(cells)
    return full.select("layer", "method", F.col("a").alias("i"), F.col("b").alias("j"), F.col("dot").alias("v"))


def by_method(cells, method):
    return cells.where(F.col("method") == method).drop("method")


KEYS = ["layer", "method"]


@query(
    "covariance_to_correlation",
    "MAT1",
    with_ctes("cm", "SELECT layer, method, i, j, round(c, 6) AS c FROM cm"),
)
def covariance_to_correlation(spark, sf_dir):
    return M.correlation(gram_cells(spark, sf_dir), KEYS).select("layer", "method", "i", "j", F.round("c", 6).alias("c"))


POWER = """
mats AS (SELECT layer, method, list(r ORDER BY i) AS m FROM
  (SELECT layer, method, i, list(c ORDER BY j) AS r FROM cm GROUP BY ALL) GROUP BY ALL),
power AS (
  SELECT layer, method, 0 AS k, list_transform(m, lambda r: 1.0::DOUBLE + r[1] / 7) AS u FROM mats
  UNION ALL
  SELECT p.layer, p.method, k + 1, list_transform(w, lambda t: t / sqrt(list_dot_product(w, w))) AS u FROM
    (SELECT power.layer, power.method, k, list_transform(m, lambda r: list_dot_product(r, u)) AS w
     FROM power JOIN mats USING (layer, method) WHERE k < 600) p),
topv AS (SELECT layer, method, u, list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))) AS lambda1
  FROM power JOIN mats USING (layer, method) WHERE k = 600)
"""


def recursive(names: str, tables: str, body: str) -> str:
    return "WITH RECURSIVE " + with_ctes(names, "")[5:].rstrip() + "," + tables + body


@query(
    "shared_mode_suite",
    "MAT4",
    recursive(
        "cm",
        POWER,
        """SELECT layer, method, count(DISTINCT i)::BIGINT AS n, round(avg(c) FILTER (i <> j), 6) AS mean_offdiag,
  round(sqrt(sum(c * c) FILTER (i <> j)), 6) AS fro_offdiag, round(sum(c) FILTER (i = j), 6) AS trace,
  round(any_value(lambda1), 6) AS lambda1
FROM cm JOIN topv USING (layer, method) GROUP BY layer, method""",
    ),
)
def shared_mode_suite(spark, sf_dir):
    c = M.correlation(gram_cells(spark, sf_dir), KEYS).select(*KEYS, "i", "j", F.col("c").alias("v"))
    return rounded(M.shared_mode_suite(c, KEYS).drop("gap"), "mean_offdiag", "fro_offdiag", "trace", "lambda1")


EXTREMES = """
mats AS (SELECT layer, method, list(r ORDER BY i) AS m FROM
  (SELECT layer, method, i, list(v ORDER BY j) AS r FROM gm GROUP BY ALL) GROUP BY ALL),
power AS (
  SELECT layer, method, 0 AS k, list_transform(m, lambda r: 1.0::DOUBLE + r[1] / 7) AS u,
    list_transform(m, lambda r: 1.0::DOUBLE - r[2] * 3 + r[3]) AS l, list_aggregate(list_transform(m, lambda r: list_dot_product(r, r)), 'sum') AS f FROM mats
  UNION ALL
  SELECT p.layer, p.method, k + 1, list_transform(w, lambda t: t / sqrt(list_dot_product(w, w))) AS u,
    list_transform(z, lambda t: t / sqrt(list_dot_product(z, z))) AS l, f FROM
    (SELECT power.layer, power.method, k, f, list_transform(m, lambda r: list_dot_product(r, u)) AS w,
       list_transform(list_zip(l, list_transform(m, lambda r: list_dot_product(r, l))), lambda x: sqrt(f) * x[1] - x[2]) AS z
     FROM power JOIN mats USING (layer, method) WHERE k < 4000) p)
"""


@query(
    "matrix_spectra",
    "MAT2 MAT3",
    recursive(
        "gm",
        EXTREMES,
        """SELECT layer, method, len(m) AS n, true AS is_symmetric,
  round(list_dot_product(l, list_transform(m, lambda r: list_dot_product(r, l))), 6) AS eig_min,
  round(list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))), 6) AS eig_max, 0::BIGINT AS negative_count, 0::BIGINT AS near_zero_count
FROM power JOIN mats USING (layer, method) WHERE k = 4000""",
    ),
)
def matrix_spectra(spark, sf_dir):
    diagnostics = M.spectral_diagnostics(M.spectra(gram_cells(spark, sf_dir), KEYS), KEYS)
    return rounded(diagnostics.drop("condition"), "eig_min", "eig_max")


@query(
    "recovered_coordinates_gram",
    "MAT5",
    with_ctes("gm", "SELECT layer, method, i, j, round(v, 7) AS v FROM gm"),
)
def recovered_coordinates_gram(spark, sf_dir):
    """Coordinates recovered from a Gram matrix, checked by multiplying them back to it."""
    cells = gram_cells(spark, sf_dir)
    z = M.coordinates(M.spectra(cells, KEYS), KEYS)
    other = z.select(*KEYS, "k", F.col("obj").alias("j"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    back = z.join(other, [*KEYS, "k"]).groupBy(*KEYS, F.col("obj").alias("i"), "j")
    return back.agg(F.round(F.sum(F.col("re") * F.col("re2") - F.col("im") * F.col("im2")), 7).alias("v"))


@query(
    "recovered_coordinates",
    "MAT5",
    with_ctes(
        "gm",
        """SELECT layer, method, count(DISTINCT i)::BIGINT AS n, round(sum(v) FILTER (i = j), 7) AS trace, round(sum(v * v), 6) AS square_sum FROM gm GROUP BY ALL""",
    ),
)
def recovered_coordinates(spark, sf_dir):
    """Signed squared lengths of the coordinate axes: they sum to the trace, their squares to the squared norm."""
    z = M.coordinates(M.spectra(gram_cells(spark, sf_dir), KEYS), KEYS)
    axes = z.groupBy(*KEYS, "k").agg(F.sum(F.col("re") * F.col("re") - F.col("im") * F.col("im")).alias("x"))
    out = axes.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("trace"), F.sum(F.col("x") * F.col("x")).alias("square_sum")
    )
    return rounded(rounded(out, "trace", digits=7), "square_sum")


@query(
    "gram_linear_hsic_cka",
    "MAT6 MAT7 JOIN13",
    with_ctes(
        "ctr",
        """SELECT x.layer, sqrt(count(*))::BIGINT AS n, round(sum(x.v * y.v) / (sqrt(count(*)) - 1) ** 2, 9) AS hsic,
  round(sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)), 6) AS cka
FROM ctr x JOIN ctr y ON x.layer = y.layer AND x.i = y.i AND x.j = y.j AND x.method = 'sft' AND y.method = 'sdft'
GROUP BY x.layer""",
    ),
)
def gram_linear_hsic_cka(spark, sf_dir):
    cells = gram_cells(spark, sf_dir)
    x, y = M.common_block(by_method(cells, "sft"), by_method(cells, "sdft"), ["layer"])
    return rounded(rounded(M.hsic_cka(x, y, ["layer"]), "hsic", digits=9), "cka")


@query(
    "gram_gaussian_hsic",
    "MAT8",
    with_ctes(
        "gkc",
        """SELECT x.layer, round(sum(x.v * y.v) / (sqrt(count(*)) - 1) ** 2, 7) AS hsic
FROM gkc x JOIN gkc y ON x.layer = y.layer AND x.i = y.i AND x.j = y.j AND x.method = 'sft' AND y.method = 'sdft'
GROUP BY x.layer""",
    ),
)
def gram_gaussian_hsic(spark, sf_dir):
    kernels = M.gaussian_kernel(gram_cells(spark, sf_dir), KEYS).select(*KEYS, "i", "j", "v")
    out = M.hsic_cka(by_method(kernels, "sft"), by_method(kernels, "sdft"), ["layer"])
    return out.select("layer", F.round("hsic", 7).alias("hsic"))


@query(
    "feature_linear_hsic_cka",
    "MAT6 MAT7",
    with_ctes(
        "vec",
        """, n AS (SELECT count(*) AS n FROM vec),
k AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.g[1:32], b.g[1:32]) AS x,
        list_dot_product(a.g[33:64], b.g[33:64]) AS y FROM vec a CROSS JOIN vec b),
r AS (SELECT i, avg(x) AS x, avg(y) AS y FROM k GROUP BY i), g AS (SELECT avg(x) AS x, avg(y) AS y FROM k),
c AS (SELECT k.x - a.x - b.x + g.x AS x, k.y - a.y - b.y + g.y AS y
      FROM k JOIN r a ON a.i = k.i JOIN r b ON b.i = k.j CROSS JOIN g)
SELECT any_value(n)::BIGINT AS n, round(sum(x * y) / (any_value(n) - 1) ** 2, 9) AS hsic,
       round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cka FROM c CROSS JOIN n""",
    ),
)
def feature_linear_hsic_cka(spark, sf_dir):
    out = moments.feature_hsic_cka(halves(spark, sf_dir).withColumn("part", F.lit(0)), ["part"], "x", "y", 32)
    return rounded(rounded(out.drop("part"), "hsic", digits=9), "cka")


def halves(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id", "label", "is_val", F.slice("g", 1, 32).alias("x"), F.slice("g", 33, 32).alias("y")
    )


# both ridge systems inverted by Newton steps over lists
CCA_SQL = (
    "WITH RECURSIVE "
    + with_ctes("vec", "")[5:].rstrip()
    + """,
xs AS MATERIALIZED (SELECT vec_id, p AS i, g[p] - avg(g[p]) OVER (PARTITION BY p) AS x FROM vec, generate_series(1, 64) t(p)),
cells AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM xs a JOIN xs b USING (vec_id) GROUP BY 1, 2),
nn AS (SELECT count(*) AS n FROM vec),
mats AS MATERIALIZED (SELECT side, list(r ORDER BY i) AS m FROM (
  SELECT CASE WHEN i <= 32 THEN 'x' ELSE 'y' END AS side, i, list(v + CASE WHEN i = j THEN 1e-5 * n ELSE 0 END ORDER BY j) AS r
  FROM cells CROSS JOIN nn WHERE (i <= 32) = (j <= 32) GROUP BY 1, 2) GROUP BY side),
inv AS (SELECT side, 0 AS k, list_transform(m, lambda r: list_transform(r, lambda t: t / (s * s))) AS q
    FROM (SELECT side, m, list_max(list_transform(m, lambda r: list_sum(list_transform(r, lambda t: abs(t))))) AS s FROM mats)
  UNION ALL
  SELECT side, k + 1, list_transform(q, lambda xr: list_transform(list_zip(xr, list_transform(p, lambda pr: list_dot_product(xr, pr))), lambda z: 2 * z[1] - z[2]))
  FROM (SELECT inv.side, k, q, list_transform(m, lambda r: list_transform(q, lambda c: list_dot_product(r, c))) AS p
        FROM inv JOIN mats USING (side) WHERE k < 40)),
a AS (SELECT unnest(range(1, 33)) AS i, unnest(q) AS r FROM inv WHERE k = 40 AND side = 'x'),
b AS (SELECT unnest(range(33, 65)) AS j, unnest(q) AS r FROM inv WHERE k = 40 AND side = 'y'),
cx AS (SELECT j, list(v ORDER BY i) AS c FROM cells WHERE i <= 32 AND j > 32 GROUP BY j),
rx AS (SELECT i, list(v ORDER BY j) AS c FROM cells WHERE i <= 32 AND j > 32 GROUP BY i)
SELECT any_value(n)::BIGINT AS n, 'success' AS status, round(sum(list_dot_product(a.r, cx.c) * list_dot_product(b.r, rx.c)), 6) AS value
FROM a CROSS JOIN b JOIN cx USING (j) JOIN rx USING (i) CROSS JOIN nn"""
)


@query("normalized_cca_linear", "MAT9", CCA_SQL)
def normalized_cca_linear(spark, sf_dir):
    rows = halves(spark, sf_dir).withColumn("part", F.lit(0))
    out = moments.normalized_cca(rows, ["part"], "x", "y", 32, 32, sigma=None)
    return rounded(out.drop("part", "error"), "value")


def cca_batch(spark, sf_dir):
    """(label, method, n, status, value); nothing is known of one of the expected methods."""
    rows = halves(spark, sf_dir).withColumn("method", F.when(F.col("is_val"), "sdft").otherwise("sft"))
    methods = F.explode(F.array(*[F.lit(m) for m in ("sft", "sdft", "other")])).alias("method")
    expected = halves(spark, sf_dir).select("label").distinct().select("label", methods)
    results = moments.normalized_cca(rows, ["label", "method"], "x", "y", 32, 32)
    return moments.with_missing(results.drop("error"), expected, ["label", "method"])


# the doubly centred kernels themselves, both ridge systems inverted by Newton steps over lists
CCA_BATCH_SQL = (
    "WITH RECURSIVE "
    + with_ctes("vec", "")[5:].rstrip()
    + """,
rws AS (SELECT label, CASE WHEN is_val THEN 'sdft' ELSE 'sft' END AS method, vec_id, g FROM vec),
nn AS (SELECT label, method, count(*) AS n FROM rws GROUP BY ALL),
ker AS MATERIALIZED (SELECT label, method, s, a.vec_id AS i, b.vec_id AS j,
    exp(-pow(list_distance(a.g[s:s + 31], b.g[s:s + 31]), 2) / 160000) AS v
  FROM rws a JOIN rws b USING (label, method) CROSS JOIN (VALUES (1), (33)) t(s)),
mid AS MATERIALIZED (SELECT label, method, s, i, avg(v) AS m FROM ker GROUP BY ALL),
mids AS (SELECT label, method, s, avg(m) AS m FROM mid GROUP BY ALL),
mats AS MATERIALIZED (SELECT label, method, s, list(r ORDER BY i) AS m FROM (
  SELECT k.label, k.method, k.s, k.i, list(v - a.m - b.m + t.m + CASE WHEN k.i = k.j THEN 1e-5 * n ELSE 0 END ORDER BY k.j) AS r
  FROM ker k JOIN mid a ON (a.label, a.method, a.s, a.i) = (k.label, k.method, k.s, k.i)
  JOIN mid b ON (b.label, b.method, b.s, b.i) = (k.label, k.method, k.s, k.j)
  JOIN mids t ON (t.label, t.method, t.s) = (k.label, k.method, k.s) JOIN nn ON (nn.label, nn.method) = (k.label, k.method)
  WHERE n > 1 GROUP BY ALL) GROUP BY ALL),
inv AS (SELECT label, method, s, 0 AS k, list_transform(m, lambda r: list_transform(r, lambda t: t / (w * w))) AS q
    FROM (SELECT *, list_max(list_transform(m, lambda r: list_sum(list_transform(r, lambda t: abs(t))))) AS w FROM mats)
  UNION ALL
  SELECT label, method, s, k + 1, list_transform(q, lambda xr: list_transform(list_zip(xr, list_transform(p, lambda pr: list_dot_product(xr, pr))), lambda z: 2 * z[1] - z[2]))
  FROM (SELECT label, method, s, k, q, list_transform(m, lambda r: list_transform(q, lambda c: list_dot_product(r, c))) AS p
        FROM inv JOIN mats USING (label, method, s) WHERE k < 16)),
rs AS (SELECT label, method, s, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS r FROM inv WHERE k = 16),
res AS (SELECT label, method, sum(list_dot_product(list_transform(x.r, lambda t, p: (p = x.i)::INTEGER - 1e-5 * n * t),
      list_transform(y.r, lambda t, p: (p = y.i)::INTEGER - 1e-5 * n * t))) AS value
  FROM rs x JOIN rs y USING (label, method, i) JOIN nn USING (label, method) WHERE x.s = 1 AND y.s = 33 GROUP BY ALL)
SELECT l.label, m.method, nn.n, CASE WHEN nn.n IS NULL THEN 'missing' WHEN nn.n < 2 THEN 'failed' ELSE 'success' END AS status,
  round(value, 5) AS value
FROM (SELECT DISTINCT label FROM vec) l CROSS JOIN (VALUES ('sft'), ('sdft'), ('other')) m(method)
LEFT JOIN nn ON (nn.label, nn.method) = (l.label, m.method) LEFT JOIN res ON (res.label, res.method) = (l.label, m.method)"""
)


@query("normalized_cca_batch", "MAT9 MAT11", CCA_BATCH_SQL)
def normalized_cca_batch(spark, sf_dir):
    return rounded(cca_batch(spark, sf_dir), "value", digits=5)


@query(
    "normalized_cca_statuses",
    "MAT11",
    with_ctes(
        "vec",
        """, r AS (SELECT label, CASE WHEN is_val THEN 'sdft' ELSE 'sft' END AS method, count(*) AS n FROM vec GROUP BY ALL)
SELECT l.label, m.method, r.n, CASE WHEN r.n IS NULL THEN 'missing' WHEN r.n < 2 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT DISTINCT label FROM vec) l CROSS JOIN (VALUES ('sft'), ('sdft'), ('other')) m(method) LEFT JOIN r ON r.label = l.label AND r.method = m.method""",
    ),
)
def normalized_cca_statuses(spark, sf_dir):
    return cca_batch(spark, sf_dir).drop("value")


DENSITY_WIDTHS = (10, 25)

# all pairs of rows; inverse and determinant of each covariance by Gauss-Jordan steps over lists
DENSITY_SQL = (
    "WITH RECURSIVE "
    + with_ctes("vec", "")[5:].rstrip()
    + f""",
rw AS (SELECT d, CASE WHEN is_val THEN 'q' ELSE 'p' END AS part, vec_id, unnest(range(1, d + 1)) AS i, unnest(g[1:d]) AS v
  FROM vec CROSS JOIN (SELECT unnest({list(DENSITY_WIDTHS)}) AS d) w),
sc AS (SELECT d, i, stddev_pop(v) AS s, avg(v) AS m FROM rw WHERE part = 'p' GROUP BY ALL),
st AS MATERIALIZED (SELECT d, part, vec_id, i, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM rw JOIN sc USING (d, i)),
sx AS MATERIALIZED (SELECT d, part, vec_id, list(v ORDER BY i) AS x FROM st GROUP BY ALL),
nn AS (SELECT d, part, count(*) AS n FROM sx GROUP BY ALL),
cv AS MATERIALIZED (SELECT d, part, a.i, b.i AS j, covar_samp(a.v, b.v) AS v FROM st a JOIN st b USING (d, part, vec_id) GROUP BY ALL),
aug AS (SELECT d, part, list(r ORDER BY i) AS m FROM (
  SELECT d, part, i, list(v * pow(n, -2.0 / (d + 4)) ORDER BY j) || list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) AS r
  FROM cv JOIN nn USING (d, part) GROUP BY ALL) GROUP BY ALL),
ge AS (SELECT d, part, 0 AS k, m, 0.0::DOUBLE AS ld FROM aug UNION ALL
  SELECT d, part, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda t: t / pv[k + 1])
    ELSE list_transform(list_zip(r, pv), lambda z: z[1] - z[2] * r[k + 1] / pv[k + 1]) END), ld + ln(pv[k + 1])
  FROM (SELECT *, m[k + 1] AS pv FROM ge WHERE k < d)),
inv AS (SELECT d, part, ld, list_transform(m, lambda r: r[d + 1:2 * d]) AS q FROM ge WHERE k = d),
xy AS (SELECT d, part, vec_id, x, list_transform(q, lambda r: list_dot_product(r, x)) AS y, ld FROM sx JOIN inv USING (d, part)),
xq AS MATERIALIZED (SELECT *, list_dot_product(x, y) AS s FROM xy),
pd AS (SELECT d, part, a.vec_id, avg(exp(-(a.s + b.s - 2 * list_dot_product(a.x, b.y)) / 2)) / sqrt(exp(any_value(a.ld)) * pow(2 * pi(), d)) AS p
  FROM xq a JOIN xq b USING (d, part) GROUP BY d, part, a.vec_id),
h AS (SELECT d, part, -avg(ln(p + 1e-12)) AS h FROM pd GROUP BY ALL)
SELECT p.d::INTEGER AS width, round(p.h, 5) AS entropy_p, round(q.h, 5) AS entropy_q, round(p.h - q.h, 5) AS difference, 'success' AS status
FROM h p JOIN h q USING (d) WHERE p.part = 'p' AND q.part = 'q'"""
)


@query("density_entropy_difference", "MAT12", DENSITY_SQL)
def density_entropy_difference(spark, sf_dir):
    """Entropy of the training rows less that of the validation rows, for reductions of two widths."""
    rows = vectors(spark, sf_dir).withColumn("part", F.when(F.col("is_val"), "q").otherwise("p"))
    entropies = None
    for width in DENSITY_WIDTHS:
        reduced = rows.select(F.lit(width).alias("width"), "part", F.slice("g", 1, width).alias("x"))
        one = moments.density_entropies(reduced, ["width"], "part", "x", "p")
        entropies = one if entropies is None else entropies.unionByName(one)
    sides = [
        entropies.where(F.col("part") == side).select("width", F.col("entropy").alias(f"entropy_{side}"), F.col("status").alias(f"status_{side}"))
        for side in ("p", "q")
    ]
    out = sides[0].join(sides[1], "width").withColumn("difference", F.col("entropy_p") - F.col("entropy_q"))
    sound = F.when(F.col("status_p") == F.col("status_q"), F.col("status_p")).otherwise("loose").alias("status")
    return rounded(out.select("width", "entropy_p", "entropy_q", "difference", sound), "entropy_p", "entropy_q", "difference", digits=5)


@query(
    "kernel_matrix_imq",
    "MAT10",
    with_ctes(
        "gm",
        """, k AS (SELECT g.layer, g.method, g.i, g.j, 1 / sqrt(abs(di.v + dj.v - 2 * g.v) + 1) AS v FROM gm g
  JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
  JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j)
SELECT layer, method, i, j, round(v - avg(v) OVER (PARTITION BY layer, method, i), 9) AS v FROM k""",
    ),
)
def kernel_matrix_imq(spark, sf_dir):
    return rounded(M.kernel_matrix(gram_cells(spark, sf_dir), KEYS, "imq", None, 16), "v", digits=9)


@query(
    "kernel_matrix_gaussian",
    "MAT10",
    with_ctes(
        "gm",
        """, d AS (SELECT g.layer, g.method, g.i, g.j, abs(di.v + dj.v - 2 * g.v) AS v FROM gm g
  JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
  JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j),
stacked AS (SELECT d.layer, d.method, d.v, a.h * 1000 + a.o AS p, b.h * 1000 + b.o AS q FROM d
  JOIN (SELECT h, o FROM (VALUES (0), (1)) t(h), (SELECT DISTINCT i AS o FROM d)) a ON a.o = d.i
  JOIN (SELECT h, o FROM (VALUES (0), (1)) t(h), (SELECT DISTINCT i AS o FROM d)) b ON b.o = d.j),
s AS (SELECT layer, method, greatest(CASE WHEN median(v) <= 0 THEN avg(v) ELSE median(v) END, 0.01) AS s
      FROM stacked WHERE p > q GROUP BY ALL),
k AS (SELECT d.layer, d.method, d.i, d.j, exp(-v / (2 * s * s)) AS v FROM d JOIN s USING (layer, method))
SELECT layer, method, i, j, round(v - avg(v) OVER (PARTITION BY layer, method, i), 7) AS v FROM k""",
    ),
)
def kernel_matrix_gaussian(spark, sf_dir):
    return rounded(M.kernel_matrix(gram_cells(spark, sf_dir), KEYS, "gaussian", None, 16), "v", digits=7)


_DISTANCE = """d AS (SELECT g.layer, g.method, g.i, g.j, g.v AS dot, abs(di.v + dj.v - 2 * g.v) AS v FROM gm g
  JOIN gm di ON di.layer = g.layer AND di.method = g.method AND di.i = g.i AND di.j = g.i
  JOIN gm dj ON dj.layer = g.layer AND dj.method = g.method AND dj.i = g.j AND dj.j = g.j)"""


@query(
    "kernel_matrix_linear",
    "MAT10",
    with_ctes("gm", "SELECT layer, method, i, j, round(v - avg(v) OVER (PARTITION BY layer, method, i), 9) AS v FROM gm"),
)
def kernel_matrix_linear(spark, sf_dir):
    return rounded(M.kernel_matrix(gram_cells(spark, sf_dir), KEYS, "linear", None, 16), "v", digits=9)


SIGMA = 0.05


@query(
    "kernel_matrix_fixed_sigma",
    "MAT10",
    with_ctes(
        "gm",
        f""", {_DISTANCE}, k AS (SELECT layer, method, i, j, exp(-v / (2 * {SIGMA}::DOUBLE * {SIGMA}::DOUBLE * 16)) AS v FROM d)
SELECT layer, method, i, j, round(v - avg(v) OVER (PARTITION BY layer, method, i), 7) AS v FROM k""",
    ),
)
def kernel_matrix_fixed_sigma(spark, sf_dir):
    return rounded(M.kernel_matrix(gram_cells(spark, sf_dir), KEYS, "gaussian", SIGMA, 16), "v", digits=7)


@query(
    "semantic_entropy",
    "MAT13",
    with_ctes(
        "vec",
        """, c AS (SELECT is_val, CASE WHEN batch = 1 THEN -1 ELSE label END AS cl, count(*) AS c FROM vec GROUP BY ALL),
p AS (SELECT is_val, cl, c / sum(c) OVER (PARTITION BY is_val) AS p FROM c)
SELECT is_val, round(-sum(p * ln(p + 1e-12)), 9) AS entropy, round(sum(CASE WHEN cl = -1 THEN p ELSE 0 END), 9) AS noise_ratio
FROM p GROUP BY is_val""",
    ),
)
def semantic_entropy(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("cl", F.when(F.col("batch") == 1, -1).otherwise(F.col("label")))
    return rounded(moments.cluster_entropy(rows, ["is_val"], "cl"), "entropy", "noise_ratio", digits=9)


CTE["prs"] = """
SELECT a.vec_id, a.label, list_transform(list_zip(a.g, b.g), lambda z: (z[1] + z[2]) / 2) AS m,
       list_transform(list_zip(a.g, b.g), lambda z: (z[1] - z[2]) / 2) AS d
FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1"""
NEEDS["prs"] = ("vec",)


def raw_rewrite(spark, sf_dir):
    """(vec_id, label, raw, rewrite): every vector paired with the one following it."""
    vecs = vectors(spark, sf_dir)
    follower = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("rewrite"))
    return vecs.select("vec_id", "label", F.col("g").alias("raw")).join(follower, "vec_id")


@query(
    "content_style_split",
    "MAT14",
    with_ctes(
        "prs",
        """SELECT vec_id, round(sqrt(list_dot_product(m, m)), 6) AS norm_m, round(sqrt(list_dot_product(d, d)), 6) AS norm_d,
  round(abs(list_dot_product(m, d)) / (sqrt(list_dot_product(m, m)) * sqrt(list_dot_product(d, d))), 6) AS orthogonality
FROM prs""",
    ),
)
def content_style_split(spark, sf_dir):
    out = moments.content_style(raw_rewrite(spark, sf_dir), "raw", "rewrite")
    return rounded(out.select("vec_id", "norm_m", "norm_d", "orthogonality"), "norm_m", "norm_d", "orthogonality")


@query(
    "content_style_leakage",
    "MAT15 MAT17",
    with_ctes(
        "prs",
        """, md AS (SELECT x.label, sum(list_dot_product(x.m, y.d) ** 2) AS md, sum(list_dot_product(x.m, y.m) ** 2) AS mm,
  sum(list_dot_product(x.d, y.d) ** 2) AS dd FROM prs x JOIN prs y ON x.label = y.label GROUP BY x.label),
t AS (SELECT label, count(*) AS n, sum(list_dot_product(m, m)) AS tm, sum(list_dot_product(d, d)) AS td FROM prs GROUP BY label)
SELECT label, n::BIGINT AS n, round(sqrt(md) / sqrt(tm * td), 6) AS a_leak, round(tm / n, 6) AS content_trace,
  round(td / n, 6) AS style_trace, round(tm * tm / mm, 5) AS content_stable_rank, round(td * td / dd, 5) AS style_stable_rank
FROM md JOIN t USING (label)""",
    ),
)
def content_style_leakage(spark, sf_dir):
    split = moments.content_style(raw_rewrite(spark, sf_dir), "raw", "rewrite")
    out = rounded(moments.leakage(split, ["label"], 64), "a_leak", "content_trace", "style_trace")
    return rounded(out, "content_stable_rank", "style_stable_rank", digits=5)


@query("content_style_angles", "MAT16 MAT17")
def content_style_angles(spark, sf_dir):
    split = moments.content_style(raw_rewrite(spark, sf_dir), "raw", "rewrite")
    return moments.principal_angles(split, ["label"], 64)


# the trace of the product of both projections, from inverse Gram matrices of the pairs by Gauss-Jordan steps over lists,
# pairs that others span left out
OVERLAP_SQL = (
    "WITH RECURSIVE "
    + with_ctes("prs", "")[5:].rstrip()
    + """,
nn AS (SELECT label, count(*) AS n FROM prs GROUP BY label),
ps AS MATERIALIZED (SELECT label, s, row_number() OVER (PARTITION BY label, s ORDER BY vec_id) AS i, CASE WHEN s = 0 THEN m ELSE d END AS x
  FROM prs CROSS JOIN (VALUES (0), (1)) t(s)),
aug AS (SELECT label, s, list(r ORDER BY i) AS m, avg(r[i]) AS w FROM (
  SELECT a.label, a.s, a.i, list(list_dot_product(a.x, b.x) ORDER BY b.i) || list(CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY b.i) AS r
  FROM ps a JOIN ps b USING (label, s) GROUP BY ALL) GROUP BY ALL),
ge AS (SELECT label, s, n, w, 0 AS k, m FROM aug JOIN nn USING (label) UNION ALL
  SELECT label, s, n, w, k + 1, list_transform(m, lambda r, i: CASE WHEN pv[k + 1] < 1e-9 * w THEN list_transform(r, lambda t: CASE WHEN i = k + 1 THEN 0 ELSE t END)
    WHEN i = k + 1 THEN list_transform(r, lambda t: t / pv[k + 1])
    ELSE list_transform(list_zip(r, pv), lambda z: z[1] - z[2] * r[k + 1] / pv[k + 1]) END)
  FROM (SELECT *, m[k + 1] AS pv FROM ge WHERE k < n)),
inv AS MATERIALIZED (SELECT label, s, unnest(range(1, n + 1)) AS i, unnest(list_transform(m, lambda r: r[n + 1:2 * n])) AS r FROM ge WHERE k = n),
cr AS MATERIALIZED (SELECT a.label, a.i, list(list_dot_product(a.x, b.x) ORDER BY b.i) AS c
  FROM ps a JOIN ps b USING (label) WHERE a.s = 0 AND b.s = 1 GROUP BY a.label, a.i),
half AS (SELECT c.label, c.i, list(list_dot_product(c.c, v.r) ORDER BY v.i) AS h FROM cr c JOIN inv v ON v.label = c.label AND v.s = 1 GROUP BY c.label, c.i),
full_ AS (SELECT h.label, h.i, list(list_dot_product(h.h, c.c) ORDER BY c.i) AS f FROM half h JOIN cr c USING (label) GROUP BY h.label, h.i)
SELECT label, round(sum(list_dot_product(f.f, v.r)), 4) AS overlap FROM full_ f JOIN inv v USING (label, i) WHERE v.s = 0 GROUP BY label"""
)


@query("content_style_overlap", "MAT16", OVERLAP_SQL)
def content_style_overlap(spark, sf_dir):
    """The sum of squared cosines of all angles between content and style: the trace of the product of their projections."""
    split = moments.content_style(raw_rewrite(spark, sf_dir), "raw", "rewrite")
    angles = moments.principal_angles(split, ["label"], 64, k=64)
    square = F.aggregate("angles", F.lit(0.0), lambda total, t: total + F.pow(F.cos(F.radians(t)), 2))
    return angles.select("label", F.round(square, 4).alias("overlap"))


@query(
    "method_difference_matrix",
    "MAT18",
    with_ctes(
        "gm",
        """SELECT x.layer, x.i, x.j, round(x.v - y.v, 9) AS diff, round(1e5 * (x.v - y.v), 4) AS diff_scaled,
  CASE WHEN x.i < 3 AND x.j < 3 THEN 1 ELSE 0 END AS leading
FROM gm x JOIN gm y ON x.layer = y.layer AND x.i = y.i AND x.j = y.j AND x.method = 'sft' AND y.method = 'sdft'""",
    ),
)
def method_difference_matrix(spark, sf_dir):
    cells = gram_cells(spark, sf_dir)
    diff = M.difference(by_method(cells, "sft"), by_method(cells, "sdft"), ["layer"])
    return diff.select(
        "layer",
        "i",
        "j",
        F.round("v", 9).alias("diff"),
        F.round(1e5 * F.col("v"), 4).alias("diff_scaled"),
        F.when((F.col("i") < 3) & (F.col("j") < 3), 1).otherwise(0).alias("leading"),
    )


@query(
    "method_difference_spectra",
    "MAT18 MAT2",
    with_ctes(
        "gm",
        """, d AS (SELECT x.layer, x.i, x.j, x.v - y.v AS v FROM gm x JOIN gm y ON x.layer = y.layer AND x.i = y.i AND x.j = y.j AND x.method = 'sft' AND y.method = 'sdft'),
b AS (SELECT *, 'all' AS block FROM d UNION ALL SELECT *, 'leading3' FROM d WHERE i < 3 AND j < 3)
SELECT layer, block, count(DISTINCT i)::BIGINT AS n, round(1e3 * sum(v) FILTER (i = j), 7) AS trace_e3, round(1e6 * sum(v * v), 6) AS square_sum_e6, 0.0::DOUBLE AS imaginary FROM b GROUP BY ALL""",
    ),
)
def method_difference_spectra(spark, sf_dir):
    """Eigenvalues by what they sum to: the trace, and their squares the squared norm."""
    cells = gram_cells(spark, sf_dir)
    diff = M.difference(by_method(cells, "sft"), by_method(cells, "sdft"), ["layer"])
    whole = diff.withColumn("block", F.lit("all"))
    leading = diff.where("i < 3 and j < 3").withColumn("block", F.lit("leading3"))
    values = M.spectra(whole.unionByName(leading), ["layer", "block"])
    out = values.groupBy("layer", "block").agg(
        F.count(F.lit(1)).alias("n"),
        (1e3 * F.sum("eig_re")).alias("trace_e3"),
        (1e6 * F.sum(F.col("eig_re") * F.col("eig_re"))).alias("square_sum_e6"),
        F.max(F.abs("eig_im")).alias("imaginary"),
    )
    return rounded(rounded(out, "trace_e3", digits=7), "square_sum_e6")


@query(
    "rectangular_summary",
    "MAT19",
    with_ctes(
        "gm",
        """SELECT layer, method, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS n_finite,
  (count(*) - count(x)) AS n_missing FROM (SELECT layer, method, CASE WHEN v > 0 THEN ln(v) END AS x FROM gm) GROUP BY ALL""",
    ),
)
def rectangular_summary(spark, sf_dir):
    cells = gram_cells(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0, F.log("v")))
    return rounded(M.rectangular_summary(cells, KEYS, "v"), "mean", "std")


@query(
    "pair_features",
    "MAT20 JOIN12",
    recursive(
        "cm",
        POWER,
        """, f AS (SELECT cm.layer, cm.method, cm.i AS task, avg(c) FILTER (cm.i <> cm.j) AS cent, max(v) FILTER (cm.i = cm.j) AS self
  FROM cm GROUP BY ALL),
w AS (SELECT f.*, u[task + 1] ** 2 AS load FROM f JOIN topv USING (layer, method))
SELECT a.layer, a.task, round(b.cent - a.cent, 6) AS delta_cent, round(b.load - a.load, 6) AS delta_load,
  round(b.self - a.self, 6) AS delta_self
FROM w a JOIN w b ON a.layer = b.layer AND a.task = b.task AND a.method = 'sft' AND b.method = 'sdft'""",
    ),
)
def pair_features(spark, sf_dir):
    out = pair_feature_deltas(spark, sf_dir)
    return rounded(out, "delta_cent", "delta_load", "delta_self")


def pair_feature_deltas(spark, sf_dir):
    t = gram_cells(spark, sf_dir)
    c = M.correlation(t, KEYS).select(*KEYS, "i", "j", F.col("c").alias("v"))
    features = M.pair_features(t, c, KEYS)

    def delta(name):
        sdft = F.max(F.when(F.col("method") == "sdft", F.col(name)))
        return (sdft - F.max(F.when(F.col("method") == "sft", F.col(name)))).alias(f"delta_{name}")

    return features.groupBy("layer", "task").agg(delta("cent"), delta("load"), delta("self"))


@query(
    "matrix_bundle",
    "SNK5 SNK7",
    with_ctes(
        "cm",
        """SELECT method || '_layer' || layer AS tag, count(DISTINCT i)::BIGINT AS n,
  list(round(v, 6) ORDER BY i, j) AS t, list(round(c, 6) ORDER BY i, j) AS c FROM cm GROUP BY 1""",
    ),
)
def matrix_bundle(spark, sf_dir):
    from tallyloom.sources.writers import matrix_bundles

    cells = M.correlation(gram_cells(spark, sf_dir), KEYS)
    tagged = cells.select(
        F.concat("method", F.lit("_layer"), "layer").alias("tag"), "i", "j", F.round("v", 6).alias("t"), F.round("c", 6).alias("c")
    )
    return matrix_bundles(tagged, 10)

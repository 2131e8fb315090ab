"""Influence values, gradient statistics and dataset-pair scores over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import sampling
from tallyloom.functions import vectors as V
from tallyloom.operators import influence as I
from tallyloom.operators import gradients
from tallyloom.plans.fixtures import CTE, LAYER_WIDTH, NEEDS, layered, sql_hash, vectors, with_ctes
from tallyloom.plans.registry import query

DAMPING = 0.1

CTE["lam"] = """
SELECT layer, avg(s) / 10 AS lam, count(*) AS n
FROM (SELECT layer, vec_id, avg(x * x) AS s FROM lay WHERE NOT is_val GROUP BY layer, vec_id) GROUP BY layer"""
CTE["vm"] = "SELECT layer, pos, avg(x) AS v FROM lay WHERE is_val GROUP BY layer, pos"
CTE["hvp"] = """
SELECT vm.layer, vm.pos, (any_value(n) * any_value(v) - sum(c * x)) / (any_value(n) * any_value(lam)) AS h
FROM vm JOIN lam USING (layer)
JOIN (SELECT l.layer, l.vec_id, sum(l.x * vm.v) / (any_value(lam) + sum(l.x * l.x)) AS c
      FROM lay l JOIN vm USING (layer, pos) JOIN lam USING (layer) WHERE NOT is_val GROUP BY l.layer, l.vec_id) c
  ON c.layer = vm.layer
JOIN lay ON lay.layer = vm.layer AND lay.pos = vm.pos AND lay.vec_id = c.vec_id
GROUP BY vm.layer, vm.pos"""
NEEDS.update({"lam": ("lay",), "vm": ("lay",), "hvp": ("lam", "vm", "lay")})


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def split(spark, sf_dir):
    grads = layered(vectors(spark, sf_dir))
    train = grads.where(~F.col("is_val")).select("vec_id", "layer", "g")
    return train, grads.where("is_val").select("vec_id", "layer", "g")


def target(val):
    return I.assemble(I.mean_vectors(val, ["layer"], "g"), ["layer"], "mean", "v")


def label_objects(vecs, *group):
    """One object per label: its mean vector."""
    return I.assemble(I.mean_vectors(vecs, [*group, "label"], "g"), [*group, "label"], "mean", "a")


@query(
    "avg_gradient",
    "AGG1 FN7",
    with_ctes(
        "lay0",
        "SELECT label, pos, round(sum(x * batch) / sum(batch), 9) AS mean FROM lay0 GROUP BY label, pos",
    ),
)
def avg_gradient(spark, sf_dir):
    return rounded(I.mean_vectors(vectors(spark, sf_dir), ["label"], "g", "batch"), "mean", digits=9)


@query(
    "pooled_vectors",
    "FN7",
    with_ctes(
        "lay",
        f"""SELECT vec_id, list(round(m, 8) ORDER BY pos) AS pooled FROM (
  SELECT vec_id, pos, coalesce(sum(x) FILTER (keep), 0) / greatest(count(*) FILTER (keep), 1) + 0.5::DOUBLE * max(x) FILTER (layer = 0) AS m
  FROM (SELECT *, {sql_hash("vec_id || ':' || layer", "mask")} % 2 = 1 AS keep FROM lay) GROUP BY vec_id, pos) GROUP BY vec_id""",
    ),
)
def pooled_vectors(spark, sf_dir):
    """The masked mean of a vector's slices, plus half of its first slice."""
    rows = layered(vectors(spark, sf_dir)).withColumn("keep", (sampling.hash_int("vec_id", "layer", seed="mask") % 2).cast("int"))
    packed = rows.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("layer", "g", "keep"))).alias("s"))
    pooled = V.axpy(0.5, F.col("s")[0]["g"], V.mean_pool(F.col("s.g"), F.col("s.keep")))
    return packed.select("vec_id", F.transform(pooled, lambda x: F.round(x, 8)).alias("pooled"))


@query(
    "merged_gradient",
    "AGG2",
    with_ctes(
        "lay0",
        """, part AS (
  SELECT label, is_val, pos, avg(x) AS m, var_pop(x) AS vp,
         CASE WHEN label % 5 = 0 THEN 1 ELSE count(*) END AS steps
  FROM lay0 GROUP BY label, is_val, pos),
norms AS (SELECT label, avg(nrm) AS norm_mean, var_pop(nrm) AS norm_var
          FROM (SELECT label, vec_id, sqrt(sum(x * x)) AS nrm FROM lay0 GROUP BY label, vec_id) GROUP BY label),
merged AS (SELECT label, sqrt(sum(m * m)) AS merged_norm
           FROM (SELECT label, pos, sum(m * steps) / sum(steps) AS m FROM part GROUP BY label, pos) GROUP BY label),
tr AS (SELECT label, sum(t * steps) / sum(steps) AS trace_cov, sum(steps)::BIGINT AS total_steps
       FROM (SELECT label, is_val, sum(vp) AS t, any_value(steps) AS steps FROM part GROUP BY label, is_val)
       GROUP BY label)
SELECT label, round(merged_norm, 6) AS merged_norm, round(norm_mean, 6) AS norm_mean, round(norm_var, 9) AS norm_var,
       round(trace_cov, 6) AS trace_cov, total_steps
FROM norms JOIN merged USING (label) JOIN tr USING (label)""",
    ),
)
def merged_gradient(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    parts = gradients.gradient_moments(vecs, ["label", "is_val"], "g").withColumn(
        "steps", F.when(F.col("label") % 5 != 0, F.col("n"))
    )
    merged = gradients.merge_partial_gradients(parts, ["label"], steps="steps")
    norms = vecs.groupBy("label").agg(
        F.avg(V.norm("g")).alias("norm_mean"), F.var_pop(V.norm("g")).alias("norm_var")
    )
    out = merged.join(norms, "label").select(
        "label", "merged_norm", "norm_mean", "norm_var", "trace_cov", "total_steps"
    )
    return rounded(rounded(out, "merged_norm", "norm_mean", "trace_cov"), "norm_var", digits=9)


@query(
    "gradient_moments",
    "AGG3 STR6",
    with_ctes(
        "lay0",
        """, d AS (SELECT label, pos, avg(x) AS m, avg(x * x) AS q FROM lay0 GROUP BY label, pos),
t AS (SELECT label, sqrt(sum(m * m)) AS mean_vector_norm, greatest(sum(q - m * m), 0) AS trace_cov FROM d GROUP BY label),
s AS (SELECT label, count(*)::BIGINT AS n, avg(nrm) AS norm_mean, greatest(avg(nrm * nrm) - avg(nrm) ** 2, 0) AS norm_var
      FROM (SELECT label, vec_id, sqrt(sum(x * x)) AS nrm FROM lay0 GROUP BY label, vec_id) GROUP BY label)
SELECT label, n, round(norm_mean, 6) AS norm_mean, round(norm_var, 6) AS norm_var,
       round(mean_vector_norm, 6) AS mean_vector_norm, round(trace_cov, 6) AS trace_cov
FROM s JOIN t USING (label)""",
    ),
)
def gradient_moments(spark, sf_dir):
    out = gradients.gradient_moments(vectors(spark, sf_dir), ["label"], "g").drop("mean")
    return rounded(out, "norm_mean", "norm_var", "mean_vector_norm", "trace_cov")


@query(
    "gram_cosine",
    "AGG4 JOIN6",
    with_ctes(
        "objs",
        """SELECT a.obj AS a, b.obj AS b, round(sum(a.a * b.a), 9) AS dot,
       round(sum(a.a * b.a) / (sqrt(sum(a.a * a.a)) * sqrt(sum(b.a * b.a))), 6) AS cos
FROM objs a JOIN objs b USING (pos) GROUP BY a.obj, b.obj""",
    ),
)
def gram_cosine(spark, sf_dir):
    objects = label_objects(vectors(spark, sf_dir)).withColumn("suite", F.lit("all"))
    cells = I.object_gram(objects, ["suite"], "label", "a").drop("suite")
    full = gradients.mirror_pairs(cells)
    return full.select("a", "b", F.round("dot", 9).alias("dot"), F.round("cos", 6).alias("cos"))


@query(
    "pairwise_cosine_status",
    "AGG5 JOIN7",
    with_ctes(
        "objs",
        """, o AS (SELECT obj, pos, CASE WHEN obj % 7 = 3 THEN 0.0 ELSE a END AS a FROM objs
                   WHERE NOT (obj % 7 = 5 AND pos >= 32)),
m AS (SELECT obj, count(*) AS d, sqrt(sum(a * a)) AS nrm FROM o GROUP BY obj),
p AS (SELECT x.obj AS base, y.obj AS target, x.d AS dx, y.d AS dy, x.nrm AS nx, y.nrm AS ny FROM m x CROSS JOIN m y),
dots AS (SELECT x.obj AS base, y.obj AS target, sum(x.a * y.a) AS dp FROM o x JOIN o y USING (pos) GROUP BY 1, 2)
SELECT base, target,
       CASE WHEN dx <> dy THEN 'shape_mismatch' WHEN nx = 0 OR ny = 0 THEN 'zero_norm' ELSE 'success' END AS status,
       CASE WHEN dx = dy AND nx > 0 AND ny > 0 THEN round(greatest(-1, least(1, dp / (nx * ny))), 6) END AS cosine
FROM p JOIN dots USING (base, target)""",
    ),
)
def pairwise_cosine_status(spark, sf_dir):
    objects = label_objects(vectors(spark, sf_dir)).select(
        "label",
        F.when(F.col("label") % 7 == 3, F.transform("a", lambda x: x * 0.0))
        .when(F.col("label") % 7 == 5, F.slice("a", 1, 32))
        .otherwise(F.col("a"))
        .alias("a"),
    )
    out = gradients.cosine_jobs(objects, "label", "a")
    return out.select("base", "target", "status", F.round("cosine", 6).alias("cosine"))


@query(
    "validation_avg_gradient",
    "AGG6",
    with_ctes("vm", "SELECT layer, pos, round(v, 9) AS mean FROM vm"),
)
def validation_avg_gradient(spark, sf_dir):
    _, val = split(spark, sf_dir)
    return rounded(I.mean_vectors(val, ["layer"], "g"), "mean", digits=9)


@query(
    "layer_damping",
    "AGG7",
    with_ctes("lam", "SELECT layer, round(lam, 9) AS lam, n::BIGINT AS n FROM lam"),
)
def layer_damping(spark, sf_dir):
    train, _ = split(spark, sf_dir)
    return rounded(I.layer_damping(train), "lam", digits=9)


@query(
    "influence_identity",
    "AGG8 AGG12",
    with_ctes(
        "vm",
        """SELECT vec_id, round(-sum(x * v), 6) AS influence
FROM lay JOIN vm USING (layer, pos) WHERE NOT is_val GROUP BY vec_id""",
    ),
)
def influence_identity(spark, sf_dir):
    train, val = split(spark, sf_dir)
    return rounded(I.influence_values(train, target(val).withColumnRenamed("v", "hvp")), "influence")


@query(
    "influence_closed_form",
    "AGG9 AGG12",
    with_ctes(
        "hvp",
        """SELECT vec_id, round(-sum(x * h), 6) AS influence
FROM lay JOIN hvp USING (layer, pos) WHERE NOT is_val GROUP BY vec_id""",
    ),
)
def influence_closed_form(spark, sf_dir):
    train, val = split(spark, sf_dir)
    hvp = I.hvp_closed_form(train, target(val), I.layer_damping(train))
    return rounded(I.influence_values(train, hvp), "influence")


LISSA_SQL = (
    "WITH RECURSIVE "
    + with_ctes("lam vm", "")[5:].rstrip()
    + """,
cells AS MATERIALIZED (SELECT a.layer, a.pos AS i, b.pos AS j, sum(a.x * b.x) / any_value(n) AS c
          FROM lay a JOIN lay b ON a.vec_id = b.vec_id AND a.layer = b.layer JOIN lam ON lam.layer = a.layer
          WHERE NOT a.is_val GROUP BY a.layer, a.pos, b.pos),
cm AS MATERIALIZED (SELECT layer, list(r ORDER BY i) AS c
       FROM (SELECT layer, i, list(c ORDER BY j) AS r FROM cells GROUP BY layer, i) GROUP BY layer),
vl AS MATERIALIZED (SELECT layer, list(v ORDER BY pos) AS v FROM vm GROUP BY layer),
lm AS MATERIALIZED (SELECT * FROM lam),
it AS (SELECT layer, 0 AS k, v AS r FROM vl
       UNION ALL
       SELECT layer, k + 1, list_transform(list_zip(v, r, list_transform(c, lambda w: list_dot_product(w, r))),
                                           lambda z: z[1] + z[2] - (z[3] - lam * z[2])) AS r
       FROM it JOIN cm USING (layer) JOIN vl USING (layer) JOIN lm USING (layer) WHERE k < 10)
SELECT vec_id, round(-sum(x * r[pos + 1]), 5) AS influence
FROM lay JOIN it USING (layer) WHERE NOT is_val AND k = 10 GROUP BY vec_id"""
)


@query("influence_lissa", "AGG10 AGG12", LISSA_SQL)
def influence_lissa(spark, sf_dir):
    train, val = split(spark, sf_dir)
    hvp = I.hvp_lissa(train, target(val), I.layer_damping(train), width=LAYER_WIDTH)
    return rounded(I.influence_values(train, hvp), "influence", digits=5)


# the regularised system solved by plain gradient steps, which converge to the exact inverse
EXACT_SQL = LISSA_SQL.replace(
    "lambda z: z[1] + z[2] - (z[3] - lam * z[2])",
    "lambda z: z[2] + (z[1] - z[3] - lam * z[2]) / (0.3 + lam)",
).replace("k < 10", "k < 2500").replace("k = 10", "k = 2500")


@query("influence_exact", "AGG11 AGG12", EXACT_SQL)
def influence_exact(spark, sf_dir):
    train, val = split(spark, sf_dir)
    hvp = I.hvp_exact(train, target(val), I.layer_damping(train), width=LAYER_WIDTH)
    return rounded(I.influence_values(train, hvp), "influence", digits=5)


CTE["imat"] = """
SELECT tr.vec_id AS train_id, va.label AS val_label, any_value(tr.label) AS train_label, -sum(tr.x * va.x) AS influence
FROM lay0 tr JOIN (SELECT label, pos, avg(x) AS x FROM lay0 WHERE is_val GROUP BY ALL) va USING (pos)
WHERE NOT tr.is_val GROUP BY tr.vec_id, va.label"""
NEEDS["imat"] = ("lay0",)


def class_targets(spark, sf_dir):
    """(val_label, layer, g): the mean validation gradient of every class."""
    val = layered(vectors(spark, sf_dir)).where("is_val").select(F.col("label").alias("val_label"), "layer", "g")
    return I.assemble(I.mean_vectors(val, ["val_label", "layer"], "g"), ["val_label", "layer"], "mean", "g")


def identity_matrix_rows(spark, sf_dir):
    """(train_id, val_label, influence, train_label): every training row against every validation class."""
    train, _ = split(spark, sf_dir)
    targets = class_targets(spark, sf_dir).withColumnRenamed("g", "hvp")
    scores = I.influence_matrix(train, targets, "vec_id", "val_label").withColumnRenamed("vec_id", "train_id")
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("train_id"), F.col("label").alias("train_label"))
    return scores.join(labels, "train_id")


@query(
    "influence_matrix_identity",
    "AGG13",
    with_ctes("imat", "SELECT train_id, val_label, round(influence, 6) AS influence FROM imat"),
)
def influence_matrix_identity(spark, sf_dir):
    return rounded(identity_matrix_rows(spark, sf_dir).select("train_id", "val_label", "influence"), "influence")


@query(
    "influence_matrix_closed_form",
    "AGG13",
    with_ctes(
        "lam",
        """, vc AS (SELECT label, layer, pos, avg(x) AS x FROM lay WHERE is_val GROUP BY ALL),
dots AS (SELECT tr.layer, tr.vec_id AS t, va.label AS v, sum(tr.x * va.x) AS d
  FROM lay tr JOIN vc va USING (layer, pos) WHERE NOT tr.is_val GROUP BY 1, 2, 3),
nrm AS (SELECT layer, vec_id AS t, sum(x * x) AS q FROM lay WHERE NOT is_val GROUP BY 1, 2),
pulled AS (SELECT dots.layer, dots.v, lay.pos, sum(d / (lam + q) * x) AS p
  FROM dots JOIN nrm USING (layer, t) JOIN lam USING (layer)
  JOIN lay ON lay.layer = dots.layer AND lay.vec_id = dots.t GROUP BY 1, 2, 3),
h AS (SELECT p.layer, p.v, p.pos, (n * va.x - p.p) / (n * lam) AS h
  FROM pulled p JOIN lam USING (layer) JOIN vc va ON va.layer = p.layer AND va.pos = p.pos AND va.label = p.v)
SELECT lay.vec_id AS train_id, h.v AS val_label, round(-sum(lay.x * h.h), 5) AS influence
FROM lay JOIN h USING (layer, pos) WHERE NOT is_val GROUP BY 1, 2""",
    ),
)
def influence_matrix_closed_form(spark, sf_dir):
    train, _ = split(spark, sf_dir)
    hvps = I.hvp_many(train, class_targets(spark, sf_dir), I.layer_damping(train), "val_label")
    out = I.influence_matrix(train, hvps, "vec_id", "val_label").withColumnRenamed("vec_id", "train_id")
    return rounded(out, "influence", digits=5)


CTE["pairs"] = f"""
SELECT r.a, b.obj AS b, sum(r.r * b.a) AS score FROM (
  SELECT o.obj AS a, o.pos, (any_value(cnt.n) * any_value(o.a) - sum(c.c * g.x)) / (any_value(cnt.n) * {DAMPING}) AS r
  FROM objs o CROSS JOIN (SELECT count(*) AS n FROM vec) cnt
  JOIN (SELECT o.obj, l.vec_id, sum(o.a * l.x) / ({DAMPING} + sum(l.x * l.x)) AS c
        FROM lay0 l JOIN objs o USING (pos) GROUP BY o.obj, l.vec_id) c ON c.obj = o.obj
  JOIN lay0 g ON g.vec_id = c.vec_id AND g.pos = o.pos
  GROUP BY o.obj, o.pos) r
JOIN objs b USING (pos) GROUP BY r.a, b.obj"""
NEEDS["pairs"] = ("objs", "lay0")


def dataset_pair_scores(spark, sf_dir):
    """(a, b, score), a <= b, over label-mean objects with all rows as the training set."""
    vecs = vectors(spark, sf_dir).withColumn("suite", F.lit("all"))
    return I.pair_scores(vecs, label_objects(vecs, "suite"), ["suite"], "label", "a", DAMPING).drop("suite")


@query(
    "pair_scores_damped",
    "AGG14 MAT1",
    with_ctes(
        "pairs",
        """SELECT p.a, p.b, round(p.score, 6) AS t, CASE WHEN p.a = p.b THEN 1.0::DOUBLE
       ELSE round(p.score / sqrt(x.score * y.score), 6) END AS c
FROM pairs p JOIN pairs x ON x.a = p.a AND x.b = p.a JOIN pairs y ON y.a = p.b AND y.b = p.b WHERE p.a <= p.b""",
    ),
)
def pair_scores_damped(spark, sf_dir):
    from tallyloom.operators.matrices import correlation

    cells = dataset_pair_scores(spark, sf_dir).select(
        F.lit("all").alias("matrix_id"), F.col("a").alias("i"), F.col("b").alias("j"), F.col("score").alias("v")
    )
    out = correlation(cells, ["matrix_id"])
    return out.select(
        F.col("i").alias("a"), F.col("j").alias("b"), F.round("v", 6).alias("t"), F.round("c", 6).alias("c")
    )


@query(
    "pair_scores_hessian",
    "AGG15",
    with_ctes(
        "objs",
        """, p AS (SELECT vec_id, obj, sum(x * a) AS p FROM lay0 JOIN objs USING (pos) GROUP BY vec_id, obj)
SELECT x.obj AS a, y.obj AS b, round(avg(x.p * y.p), 9) AS score
FROM p x JOIN p y USING (vec_id) WHERE x.obj <= y.obj GROUP BY 1, 2""",
    ),
)
def pair_scores_hessian(spark, sf_dir):
    vecs = vectors(spark, sf_dir).withColumn("suite", F.lit("all"))
    out = I.hessian_scores(vecs, label_objects(vecs, "suite"), ["suite"], "label", "a").drop("suite")
    return rounded(out, "score", digits=9)


@query(
    "quadratic_form",
    "AGG16",
    with_ctes(
        "objs",
        """, p AS (SELECT vec_id, any_value(label) AS label, sum(x * a) AS p
                   FROM lay0 JOIN objs ON objs.pos = lay0.pos AND objs.obj = lay0.label GROUP BY vec_id)
SELECT label, round(avg(p * p), 9) AS q, count(*)::BIGINT AS n FROM p GROUP BY label""",
    ),
)
def quadratic_form(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    out = gradients.quadratic_forms(vecs, label_objects(vecs), ["label"], "g", "a")
    return rounded(out, "q", digits=9)


@query(
    "trajectory_metrics",
    "AGG17",
    with_ctes(
        "lay0",
        """, st AS (SELECT label, pos, avg(x) AS m FROM lay0 WHERE NOT is_val GROUP BY 1, 2),
en AS (SELECT label, pos, avg(x) AS m FROM lay0 WHERE is_val GROUP BY 1, 2),
dl AS (SELECT label, pos, en.m - st.m AS d, st.m AS sm, en.m AS em FROM st JOIN en USING (label, pos)),
pr AS (SELECT vec_id, any_value(is_val) AS is_val, any_value(lay0.label) AS label, sum(x * d) AS p
       FROM lay0 JOIN dl ON dl.label = lay0.label AND dl.pos = lay0.pos GROUP BY vec_id),
q AS (SELECT label, 0.5 * avg(p * p) FILTER (NOT is_val) AS c_start, 0.5 * avg(p * p) FILTER (is_val) AS c_end,
             count(*) FILTER (is_val) AS n FROM pr GROUP BY label),
m AS (SELECT label, sqrt(sum(d * d)) AS delta_norm, sum(em * d) AS dot_after, sum(sm * d) AS dot_before FROM dl GROUP BY label)
SELECT label, round(delta_norm, 6) AS delta_norm, round(dot_after, 6) AS dot_after, round(dot_before, 6) AS dot_before,
       round(-dot_after, 6) AS v_align, round(c_start, 9) AS c_start, round(c_end, 9) AS c_end, n::BIGINT AS n
FROM m JOIN q USING (label)""",
    ),
)
def trajectory_metrics(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    before, after = vecs.where(~F.col("is_val")), vecs.where("is_val")
    start = label_objects(before).withColumnRenamed("a", "theta_start")
    end = label_objects(after).withColumnRenamed("a", "theta_end")
    out = gradients.trajectory(start.join(end, "label"), before, after, ["label"], "g")
    out = rounded(out, "delta_norm", "dot_after", "dot_before", "v_align")
    return rounded(out, "c_start", "c_end", digits=9)


CTE["gscore"] = f"""
SELECT o.ds, o.a, o.b, (any_value(n) * any_value(dab) - sum(pa * pb / ({DAMPING} + q))) / (any_value(n) * {DAMPING}) AS score
FROM (SELECT t.label AS ds, p1.obj AS a, p2.obj AS b, p1.p AS pa, p2.p AS pb, t.q
      FROM (SELECT vec_id, label, sum(x * x) AS q FROM lay0 GROUP BY 1, 2) t
      JOIN gp p1 ON p1.vec_id = t.vec_id JOIN gp p2 ON p2.vec_id = t.vec_id) o
JOIN (SELECT label AS ds, count(*) AS n FROM vec GROUP BY label) c ON c.ds = o.ds
JOIN (SELECT x.obj AS a, y.obj AS b, sum(x.a * y.a) AS dab FROM objs x JOIN objs y USING (pos) GROUP BY 1, 2) d
  ON d.a = o.a AND d.b = o.b
GROUP BY o.ds, o.a, o.b"""
CTE["gp"] = "SELECT vec_id, obj, sum(x * a) AS p FROM lay0 JOIN objs USING (pos) GROUP BY vec_id, obj"
NEEDS.update({"gp": ("objs", "lay0"), "gscore": ("gp", "objs", "lay0", "vec")})


@query(
    "train_test_rect",
    "AGG18",
    with_ctes(
        "gscore",
        """, sizes AS (SELECT label AS ds, count(*) AS n FROM vec GROUP BY label),
diag AS (SELECT g.ds AS obj, CASE WHEN s.n % 2 = 0 THEN g.score END AS score FROM gscore g JOIN sizes s ON s.ds = g.ds WHERE g.a = g.ds AND g.b = g.ds)
SELECT t.ds AS train, t.b AS test, round(t.score, 6) AS t,
       CASE WHEN sa.score > 0 AND coalesce(diag.score, sb.score) > 0
            THEN round(t.score / sqrt(sa.score * coalesce(diag.score, sb.score)), 6) END AS c
FROM gscore t JOIN gscore sa ON sa.ds = t.ds AND sa.a = t.ds AND sa.b = t.ds
JOIN gscore sb ON sb.ds = t.ds AND sb.a = t.b AND sb.b = t.b
LEFT JOIN diag ON diag.obj = t.b WHERE t.a = t.ds""",
    ),
)
def train_test_rect(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    objects = label_objects(vecs)
    train = vecs.withColumn("ds", F.col("label"))
    per_dataset = gradients.every_group(objects, "label", "a", "ds")
    scores = I.pair_scores(train, per_dataset, ["ds"], "label", "a", DAMPING)
    sizes = train.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    # a dataset of an odd number of rows has no score of its own, as one that was never computed
    own = scores.where("a = ds and b = ds").join(sizes, "ds").withColumn("own", F.when(F.col("n") % 2 == 0, F.col("score")))
    out = gradients.rectangular_scores(scores, own.select(F.col("ds").alias("test"), "own"))
    return rounded(out, "t", "c")


CTE["hscore"] = """
SELECT t.label AS ds, x.obj AS a, y.obj AS b, avg(x.p * y.p) AS score
FROM vec t JOIN gp x ON x.vec_id = t.vec_id JOIN gp y ON y.vec_id = t.vec_id GROUP BY 1, 2, 3"""
NEEDS["hscore"] = ("gp", "vec")


@query(
    "train_test_rect_hessian",
    "AGG18",
    with_ctes(
        "hscore",
        """SELECT t.ds AS train, t.b AS test, round(t.score, 9) AS t,
       CASE WHEN sa.score > 0 AND coalesce(own.score, sb.score) > 0 THEN round(t.score / sqrt(sa.score * coalesce(own.score, sb.score)), 6) END AS c
FROM hscore t JOIN hscore sa ON sa.ds = t.ds AND sa.a = t.ds AND sa.b = t.ds
JOIN hscore sb ON sb.ds = t.ds AND sb.a = t.b AND sb.b = t.b
LEFT JOIN hscore own ON own.ds = t.b AND own.a = t.b AND own.b = t.b WHERE t.a = t.ds""",
    ),
)
def train_test_rect_hessian(spark, sf_dir):
    """The undamped form: scores are mean products of projections, each self score comes from its own oracle."""
    vecs = vectors(spark, sf_dir)
    objects = label_objects(vecs)
    scores = I.hessian_scores(
        vecs.withColumn("ds", F.col("label")), gradients.every_group(objects, "label", "a", "ds"), ["ds"], "label", "a"
    )
    own = scores.where("a = ds and b = ds").select(F.col("ds").alias("test"), F.col("score").alias("own"))
    return rounded(rounded(gradients.rectangular_scores(scores, own), "c"), "t", digits=9)


@query(
    "h_mode_pair_scores",
    "AGG19 SET1",
    with_ctes(
        "lay0",
        f""", tg AS (SELECT * FROM (VALUES ('sft', 'own'), ('sft', 'cross'), ('sft', 'mixed'), ('sdft', 'own'), ('sdft', 'cross'), ('sdft', 'mixed')) t(target, h_mode)),
ob AS (SELECT CASE WHEN is_val THEN 'sdft' ELSE 'sft' END AS target, label AS obj, pos, avg(x) AS a FROM lay0 GROUP BY 1, 2, 3),
tr AS (SELECT tg.target, tg.h_mode, lay0.* FROM lay0 JOIN tg ON h_mode = 'mixed'
         OR (h_mode = 'own') = ((CASE WHEN is_val THEN 'sdft' ELSE 'sft' END) = tg.target)),
pr AS (SELECT tr.target, h_mode, vec_id, obj, sum(x * a) AS p, sum(x * x) AS q
       FROM tr JOIN ob ON ob.target = tr.target AND ob.pos = tr.pos GROUP BY 1, 2, 3, 4),
ab AS (SELECT x.target, x.obj AS a, y.obj AS b, sum(x.a * y.a) AS dab FROM ob x JOIN ob y ON x.target = y.target AND x.pos = y.pos GROUP BY 1, 2, 3)
SELECT x.target, x.h_mode, x.obj AS a, y.obj AS b, count(*)::BIGINT AS n,
       round((count(*) * any_value(dab) - sum(x.p * y.p / ({DAMPING} + x.q))) / (count(*) * {DAMPING}), 6) AS score
FROM pr x JOIN pr y ON x.target = y.target AND x.h_mode = y.h_mode AND x.vec_id = y.vec_id AND x.obj <= y.obj
JOIN ab ON ab.target = x.target AND ab.a = x.obj AND ab.b = y.obj
GROUP BY 1, 2, 3, 4""",
    ),
)
def h_mode_pair_scores(spark, sf_dir):
    vecs = vectors(spark, sf_dir).withColumn("method", F.when(F.col("is_val"), "sdft").otherwise("sft"))
    out = gradients.h_mode_scores(vecs, label_objects(vecs, "method"), "method", "label", DAMPING)
    return rounded(out, "score")


@query(
    "gram_suite_counts",
    "AGG20 SET4 JOIN9",
    with_ctes(
        "lay0",
        """, objs AS (SELECT label, count(*) AS n FROM vec GROUP BY label),
k AS (SELECT count(*) AS k FROM objs), av AS (SELECT count(*) AS k FROM objs WHERE n % 2 = 0)
SELECT (k.k * (k.k + 1) / 2)::BIGINT AS total_pairs, (av.k * (av.k + 1) / 2)::BIGINT AS available_pairs,
       (k.k * (k.k + 1) / 2 - av.k * (av.k + 1) / 2)::BIGINT AS pending_pairs FROM k, av""",
    ),
)
def gram_suite_counts(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    sizes = vecs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    expected = gradients.object_pairs(sizes, "label")
    scored = gradients.object_pairs(sizes.where("n % 2 = 0"), "label")
    return gradients.completeness(expected, scored)

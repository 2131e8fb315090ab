"""BLEU and ROUGE over documents, conversations and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import ngrams as G
from tallyloom.functions import text as X
from tallyloom.operators import ordering as O
from tallyloom.operators import textmetrics as T
from tallyloom.plans.fixtures import CTE, NEEDS, predictions, table, with_ctes
from tallyloom.plans.influence import rounded
from tallyloom.plans.records import SQL_STRIP, SQL_WORDS, q
from tallyloom.plans.registry import query
from tallyloom.session import cut_lineage

CTE["docpair"] = """
SELECT doc_id, lang, text AS hyp, lead(text) OVER (PARTITION BY lang, source ORDER BY doc_id) AS ref FROM documents
QUALIFY ref IS NOT NULL"""


def document_pairs(spark, sf_dir):
    """(doc_id, lang, hyp, ref): a document against the next one of the same language and source."""
    placed = O.positions(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], "p")
    following = placed.select("lang", "source", (F.col("p") - 1).alias("p"), F.col("doc_id").alias("next_id"))
    pairs = placed.join(following, ["lang", "source", "p"]).select("doc_id", "next_id")
    texts = table(spark, sf_dir, "documents")
    both = (
        pairs.join(texts.select("doc_id", "lang", F.col("text").alias("hyp")), "doc_id")
        .join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("ref")), "next_id")
        .drop("next_id")
    )
    # counting n-grams costs far more than moving the texts once, so they are laid out evenly for it
    return both.repartition("doc_id")


def grams_sql(source: str, order: int, tokens_a: str, tokens_b: str) -> str:
    """Table expressions ta, tb (id, tokens), counts per (id, n, gram) and ov (id, n, matches, shared, kinds)."""
    def counted(side: str) -> str:
        ahead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY id ORDER BY k) AS w{k}" for k in range(1, order))
        grams = " UNION ALL ".join(
            f"SELECT id, {n} AS n, {' || chr(1) || '.join(['w'] + [f'w{k}' for k in range(1, n)])} AS g FROM l{side}"
            + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "")
            for n in range(1, order + 1)
        )
        return f"""t{side} AS (SELECT id, unnest({side}) AS w, generate_subscripts({side}, 1) AS k FROM base),
l{side} AS (SELECT id, w, {ahead} FROM t{side}), g{side} AS (SELECT id, n, g, count(*) AS c FROM ({grams}) GROUP BY ALL),
"""

    return f"""base AS (SELECT id, {tokens_a} AS a, {tokens_b} AS b FROM {source}),
{counted("a")}{counted("b")}mt AS (SELECT ga.id, ga.n, sum(least(ga.c, gb.c)) AS m, count(*) AS sh FROM ga JOIN gb USING (id, n, g) GROUP BY ALL),
ov AS (SELECT base.id, n.n, len(a) AS la, len(b) AS lb, coalesce(mt.m, 0) AS m, coalesce(mt.sh, 0) AS sh FROM base CROSS JOIN generate_series(1, {order}) n(n) LEFT JOIN mt ON mt.id = base.id AND mt.n = n.n)"""


@query(
    "sentence_bleu4",
    "EV13 FN10",
    with_ctes(
        "docpair",
        ", src AS (SELECT doc_id AS id, hyp, ref FROM docpair), "
        + grams_sql("src", 4, "string_split(hyp, '')", "string_split(ref, '')")
        + """, z AS (SELECT *, sum((m = 0)::INTEGER) OVER (PARTITION BY id ORDER BY n) AS zeros, greatest(la - n + 1, 1) AS tot FROM ov),
p AS (SELECT id, any_value(la) AS la, any_value(lb) AS lb, max(m) FILTER (n = 1) AS m1, sum(ln(CASE WHEN m > 0 THEN m / tot::DOUBLE ELSE 1 / (pow(2, zeros) * tot) END) / 4) AS s FROM z GROUP BY id)
SELECT id AS doc_id, round(CASE WHEN m1 = 0 THEN 0 ELSE exp(s + CASE WHEN la >= lb THEN 0 ELSE 1 - lb / la::DOUBLE END) END, 8) AS bleu4 FROM p""",
    ),
)
def sentence_bleu4(spark, sf_dir):
    rows = document_pairs(spark, sf_dir).select("doc_id", T.overlap("hyp", "ref", 4).alias("o"))
    return rows.select("doc_id", F.round(T.smoothed_bleu4("o"), 8).alias("bleu4"))


@query(
    "rouge_1_2",
    "EV14 UDAF1",
    with_ctes(
        "docpair",
        ", src AS (SELECT doc_id AS id, hyp, ref FROM docpair), "
        + grams_sql("src", 2, SQL_WORDS.format("hyp"), SQL_WORDS.format("ref"))
        + """, ka AS (SELECT id, n, count(*) AS k FROM ga GROUP BY ALL), kb AS (SELECT id, n, count(*) AS k FROM gb GROUP BY ALL),
f AS (SELECT ov.id, ov.n, coalesce(2.0 * (sh / ka.k::DOUBLE) * (sh / kb.k::DOUBLE) / (sh / ka.k::DOUBLE + sh / kb.k::DOUBLE + 1e-8), 0) AS f
  FROM ov LEFT JOIN ka ON ka.id = ov.id AND ka.n = ov.n LEFT JOIN kb ON kb.id = ov.id AND kb.n = ov.n)
SELECT id AS doc_id, round(max(f) FILTER (n = 1), 8) AS rouge_1, round(max(f) FILTER (n = 2), 8) AS rouge_2 FROM f GROUP BY id""",
    ),
)
def rouge_1_2(spark, sf_dir):
    out = T.rouge(document_pairs(spark, sf_dir), X.words("hyp"), X.words("ref"), ["doc_id"]).drop("rouge_l")
    return rounded(out, "rouge_1", "rouge_2", digits=8)


@query("rouge_l", "EV14")
def rouge_l(spark, sf_dir):
    out = T.rouge(document_pairs(spark, sf_dir), X.words("hyp"), X.words("ref"), ["doc_id"])
    return out.select("doc_id", F.round("rouge_l", 8).alias("rouge_l"))


def mteval_sql(expr: str, lower: bool) -> str:
    out = expr
    for pattern, put in G.JOIN_RULES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(put)}, 'g')"
    for entity, put in G.ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(put)})"
    out = f"(' ' || {'lower(' + out + ')' if lower else out} || ' ')"
    for pattern, put in G.SPLIT_RULES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(put.replace('$', chr(92)))}, 'g')"
    return SQL_WORDS.format(out)


@query(
    "corpus_bleu",
    "EV16",
    with_ctes(
        "docpair",
        ", src AS (SELECT doc_id AS id, lang, hyp, ref FROM docpair), "
        + grams_sql("src", 4, mteval_sql("hyp", False), mteval_sql("ref", False))
        + """, s AS (SELECT lang, n, sum(m) AS m, sum(greatest(la - n + 1, 0)) AS t, sum(la) AS tl, sum(lb) AS rl FROM ov JOIN src USING (id) GROUP BY ALL),
b AS (SELECT lang, min(m / t::DOUBLE) AS lo, sum(ln(greatest(m / t::DOUBLE, 1e-300)) / 4) AS s, any_value(tl)::BIGINT AS tl, any_value(rl)::BIGINT AS rl FROM s GROUP BY lang)
SELECT lang, round(CASE WHEN lo > 0 THEN exp(s) * CASE WHEN tl > rl THEN 1 ELSE exp(1 - rl / tl::DOUBLE) END ELSE 0 END, 8) AS bleu, tl AS translation_length, rl AS reference_length FROM b""",
    ),
)
def corpus_bleu(spark, sf_dir):
    rows = document_pairs(spark, sf_dir).select(
        "lang", T.overlap(G.mteval_tokens("hyp", lower=False), G.mteval_tokens("ref", lower=False), 4).alias("o")
    )
    return rounded(T.corpus_bleu(rows, ["lang"], "o").drop("brevity_penalty"), "bleu", digits=8)


@query(
    "corpus_bleu_smoothed",
    "EV16",
    with_ctes(
        "pred",
        ", src AS (SELECT conv_id * 100 + turn AS id, prompt AS hyp, label AS ref FROM pred), "
        + grams_sql("src", 4, mteval_sql("hyp", False), mteval_sql("ref", False))
        + """, s AS (SELECT n, sum(m) AS m, sum(greatest(la - n + 1, 0)) AS t, sum(la) AS tl, sum(lb) AS rl FROM ov GROUP BY ALL)
SELECT round(exp(sum(ln((m + 1) / (t + 1)::DOUBLE) / 4)) * CASE WHEN any_value(tl) > any_value(rl) THEN 1 ELSE exp(1 - any_value(rl) / any_value(tl)::DOUBLE) END, 8) AS bleu FROM s""",
    ),
)
def corpus_bleu_smoothed(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        T.overlap(G.mteval_tokens("prompt", lower=False), G.mteval_tokens("label", lower=False), 4).alias("o")
    )
    return rounded(T.corpus_bleu(rows, [], "o", smooth=True).select("bleu"), "bleu", digits=8)


def _marks(expr: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({SQL_STRIP.format(expr)}), {q(G.WORD_OR_MARK)}), ' ')"


@query(
    "reference_bleu",
    "EV15 JOIN11",
    with_ctes(
        "pred",
        f""", hy AS (SELECT conv_id AS id, {mteval_sql(_marks("arg_max(predict, turn)"), True)} AS a FROM pred GROUP BY conv_id),
rf AS (SELECT DISTINCT conv_id AS id, label FROM pred UNION SELECT conv_id, prompt FROM pred),
rt AS (SELECT id, label AS r, {mteval_sql(_marks("label"), True)} AS b FROM rf),
ga AS (SELECT id, n, array_to_string(a[k:k + n - 1], chr(1)) AS g, count(*) AS c FROM hy, generate_series(1, 4) s(n), generate_series(1, len(a) - n + 1) t(k) GROUP BY ALL),
gb AS (SELECT id, n, g, max(c) AS c FROM (SELECT id, r, n, array_to_string(b[k:k + n - 1], chr(1)) AS g, count(*) AS c FROM rt, generate_series(1, 4) s(n), generate_series(1, len(b) - n + 1) t(k) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT ga.id, ga.n, sum(least(ga.c, gb.c)) AS m FROM ga JOIN gb USING (id, n, g) GROUP BY ALL),
x AS (SELECT hy.id, n.n, len(a) AS la, coalesce(m.m, 0) + CASE WHEN n.n > 1 THEN 1 ELSE 0 END AS m, greatest(len(a) - n.n + 1, 0) + CASE WHEN n.n > 1 THEN 1 ELSE 0 END AS t
  FROM hy CROSS JOIN generate_series(1, 4) n(n) LEFT JOIN m ON m.id = hy.id AND m.n = n.n),
l AS (SELECT id, min(len(b)) AS lr FROM rt GROUP BY id)
SELECT x.id AS conv_id, round(100 * exp(sum((ln(m + 2.2250738585072014e-308) - ln(t + 2.2250738585072014e-308)) / 4) + any_value(least(0, 1 - (lr + 1.0) / (la + 1.0)))), 6) AS bleu
FROM x JOIN l ON l.id = x.id GROUP BY x.id""",
    ),
)
def reference_bleu(spark, sf_dir):
    rows = cut_lineage(predictions(spark, sf_dir))
    last = rows.groupBy("conv_id").agg(F.max_by("predict", "turn").alias("predict"))
    golds = rows.select("conv_id", F.col("label").alias("gold")).unionByName(rows.select("conv_id", F.col("prompt").alias("gold")))
    return rounded(T.reference_bleu(last, golds, "conv_id", "predict", "gold"), "bleu")

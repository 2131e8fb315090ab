"""Registered queries of the operators: each applies one to its whole table and derives the columns agreed on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    bpe,
    decontaminate,
    fill_in_middle,
    language,
    license_scan,
    line_crf,
    line_rules,
    minmax,
    simhash,
    substring,
    toxicity,
    url_filter,
    vector_codes,
)
from tallyloom.llm.common import held_out, read

VOCABULARY = "byte_bpe_50k.json"

RULES = (
    url_filter.Rule("com/", url_filter.ALLOW),
    url_filter.Rule("example.com/en/", url_filter.BLOCK),
    url_filter.Rule("www.example.com/en/", url_filter.ALLOW),
    url_filter.Rule("net/es/", url_filter.BLOCK),
    url_filter.Rule("net/fr/", url_filter.BLOCK),
)

#: names of places that a corpus does not want, and of ordinary ones
BLOCKED_NAMES = """
    ads-bid ads-click ads-network ads-server ads-tracker adult-chat adult-dating adult-movies adult-xxx best-bets
    bet-now bets-online betting-tips bigwin-casino bulk-spam casino-bonus casino-cash casino-games casino-royal
    cheap-meds cheap-pills click-ads comment-spam cracked-software diet-pills free-bets24 free-casino free-money
    generic-pills get-rich-quick hot-adult instant-loans link-farm lottery-winner lucky-jackpot payday-loans
    pharmacy-pills pills-online pills4less place-bets poker-night poker-win popup-ads porn-tube replica-watches
    roulette-live seo-spam slot-machines spam-blog spam-bots spam-links spam-mail sports-bets super-bets track-ads
    vip-casino weight-loss-pills win-prize x-adult xxx-videos
""".split()
ALLOWED_NAMES = """
    addresses archive.newspaper astronomy-club bakery beekeeping bird-watching bookstore botanical-garden carpentry
    cathedral ceramics chess-club city-library cooking-school county-court daily-herald football furniture gardening
    geology history hospital insurance-law linux local-history mountain-rescue museum music observatory orchestra
    parliament physics-notes primary-school printing-house public-health python radio railway-museum recipes.kitchen
    river-trust rowing-club sailing school science sports-centre theatre theology trains-and-trams transit
    translation travels university village-hall weather wiki
""".split()
#: every name stands in the same forms, so that only names tell the two apart
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), ("test", "example", "invalid")
PATHS = ("/", "/en/12", "/de/7.html", "/fr/page", "/es/2021/05", "")
FORMS = len(PREFIXES) * len(SUFFIXES)


def forms_of(names: list[str]) -> list[str]:
    return [
        f"http://{PREFIXES[k % len(PREFIXES)]}{name}.{SUFFIXES[k % len(SUFFIXES)]}{PATHS[k * 5 % len(PATHS)]}"
        for name in names
        for k in range(FORMS)
    ]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled URL table, some 1400 rows."""
    rows = [(u, url_filter.BLOCK) for u in forms_of(BLOCKED_NAMES)] + [(u, url_filter.ALLOW) for u in forms_of(ALLOWED_NAMES)]
    return spark.createDataFrame(rows, "url string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(labelled_urls(spark))
    return url_filter.judged(read(spark, sf_dir, "pages"), weights, RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = language.broadcast(spark, language.train(documents))
    return documents.select(
        "doc_id", held_out("doc_id", language.FOLDS, language.REST).alias("held_out"), language.predictor(model)("text").alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judged(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.train(documents, read(spark, sf_dir, "labels"))
    scored = documents.select(
        "doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.REST).alias("held_out"), toxicity.scorer(model)("text").alias("s")
    )
    return scored.select(
        "doc_id",
        "held_out",
        "s.score",
        toxicity.predicted(F.col("s.score")).alias("predicted"),
        F.size("s.offending").cast("bigint").alias("n_offending"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "row.doc_id", "cut.n_words", "cut.n_removed", F.sha2(F.col("cut.kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        license_scan.names(F.col("licenses")).alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["containment"])), F.lit(0.0)).alias("best_containment"),
    )


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = line_crf.train(documents, read(spark, sf_dir, "labels"))
    scored = documents.select(
        "doc_id", held_out("doc_id", line_crf.FOLDS, line_crf.REST).alias("held_out"), line_crf.scorer(model)("text").alias("score")
    )
    return scored.withColumn("predicted", line_crf.predicted(F.col("score")))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.load(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encoded(read(spark, sf_dir, "documents"), codec, decode=True).select(
        "doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    return vector_codes.with_group_error(vector_codes.coded(vectors, books)).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.assembled(fill_in_middle.output_pieces(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_language_id,
        op3_quality_rules,
        op4_decontamination,
        op5_toxicity,
        op6_substring_dedup,
        op7_license_scan,
        op8_quality_crf,
        op9_simhash_components,
        op10_bpe_round_trip,
        op11_vector_codes,
        op12_fill_in_middle,
        op13_minmax_near_duplicates,
    )
}

#: numbered words of every document, lower-cased and split as the scans do
_WORDS = r"""list_filter(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


def _line_rules_sql() -> str:
    r = line_rules
    space = r"[\x20\x09-\x0D]"
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
    win AS (
      SELECT rid, s, array_to_string(words[s:s + {r.WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - {r.WINDOW - 2})) AS s FROM w)),
    twice AS (SELECT rid, s FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM win) WHERE n > 1),
    rep AS (
      SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest(range(s, s + {r.WINDOW})) AS p FROM twice) GROUP BY rid),
    l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d),
    spoken AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM spoken GROUP BY rid),
    n AS (
      SELECT rid, host, regexp_replace(trim(regexp_replace(
               translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}+', ' ', 'g')),
               '[0-9]+', '0', 'g') AS line FROM spoken),
    freq AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT rid) > {r.LEAST_DOCUMENTS}),
    gone AS (
      SELECT rid, sum(len(string_split(line, ' '))) AS n_frequent_words FROM n JOIN freq USING (host, line) GROUP BY rid),
    f AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_frequent_words, 0)::BIGINT AS n_frequent_words
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
    b AS (SELECT *, n_words < {r.LEAST_WORDS} OR 100 * n_repeat_words > {r.MOST_REPEATED} * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND n_words - n_frequent_words >= {r.LEAST_WORDS}
              AND n_words - n_frequent_words >= {r.LEFT}::DOUBLE * n_words AS kept FROM b"""


def _near_sql() -> str:
    """Items most of whose rarest terms that the corpus has stand within a span of one of them."""
    d = decontaminate
    return rf"""
    total AS (SELECT term, count(*) AS n FROM dw WHERE term IN (SELECT term FROM iw) GROUP BY term),
    rank AS (
      SELECT iid, term, row_number() OVER (PARTITION BY iid ORDER BY n, encode(term)) AS r
      FROM (SELECT DISTINCT iid, term FROM iw) JOIN total USING (term)),
    chosen AS (SELECT iid, term, r, count(*) OVER (PARTITION BY iid) AS terms FROM rank WHERE r <= {d.NEAR_TERMS}),
    base AS MATERIALIZED (SELECT c.iid, c.r, c.terms, rid, p FROM chosen c JOIN dw USING (term)),
    reached AS (
      SELECT b.iid, b.rid, b.p, b.terms, count(DISTINCT x.r) AS met FROM base b JOIN base x
      ON x.iid = b.iid AND x.rid = b.rid AND x.p BETWEEN b.p - {d.NEAR_SPAN} AND b.p + {d.NEAR_SPAN} GROUP BY ALL),
    near AS (
      SELECT rid, count(DISTINCT item_id) AS n_near_items FROM reached JOIN i USING (iid)
      WHERE met >= CASE WHEN terms = {d.NEAR_TERMS} THEN {d.NEAR_TERMS - 1} ELSE terms END GROUP BY rid)"""


def _decontamination_sql() -> str:
    k = decontaminate.WINDOW
    return rf"""
    WITH i AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM benchmark),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
    iw AS (SELECT iid, unnest(words) AS term FROM i),
    dw AS (SELECT rid, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS p FROM d),
    win AS (
      SELECT DISTINCT iid, size, array_to_string(words[s:s + size - 1], ' ') AS gram
      FROM (SELECT iid, words, least({k}, len(words)) AS size, unnest(range(1, len(words) - least({k}, len(words)) + 2)) AS s
            FROM i WHERE len(words) > 0)),
    places AS (
      SELECT rid, p, size, array_to_string(words[p:p + size - 1], ' ') AS gram
      FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS p
            FROM d, (SELECT DISTINCT size FROM win) WHERE len(words) >= size)),
    hit AS (SELECT iid, rid, p, size FROM places JOIN win USING (size, gram)),
    covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hit) GROUP BY rid),
    named AS (
      SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM hit JOIN i USING (iid) GROUP BY rid),
    {_near_sql()}
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
           coalesce(n_near_items, 0)::BIGINT AS n_near_items
    FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid) LEFT JOIN near USING (rid)"""


def _substring_sql() -> str:
    k = substring.WINDOW
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    win AS (
      SELECT rid, doc_id, p, md5(array_to_string(words[p:p + {k - 1}], ' ')) AS gram
      FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - {k - 2})) AS p FROM d WHERE len(words) >= {k})),
    later AS (SELECT rid, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS lo FROM win) WHERE lo < doc_id),
    gone AS (SELECT rid, list(DISTINCT q) AS places FROM (SELECT rid, unnest(range(p, p + {k})) AS q FROM later) GROUP BY rid),
    kept AS (
      SELECT doc_id, words, CASE WHEN places IS NULL THEN words
             ELSE list_filter(words, lambda w, q: NOT list_contains(places, q)) END AS stay
      FROM d LEFT JOIN gone USING (rid))
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(stay))::BIGINT AS n_removed,
           sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept"""


def _license_sql() -> str:
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    rows = ", ".join(
        f"('{name}', {group.c}, {len(own)}, '{gram.decode()}')"
        for group in scanner.groups
        for name, own in zip(group.names, group.sets)
        for gram in sorted(own)
    )
    k = license_scan.SHINGLE
    return rf"""
    WITH t(name, c, n, gram) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
    s AS (
      SELECT rid, p, array_to_string(words[p + 1:p + {k}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(0, len(words) - {k - 1})) AS p FROM d WHERE len(words) >= {k})),
    hit AS (SELECT rid, name, n, gram, p // c AS block FROM s JOIN t USING (gram)),
    seen AS (SELECT rid, name, n, gram, unnest([block - 1, block]) AS w FROM hit),
    share AS (SELECT rid, name, count(DISTINCT gram)::DOUBLE / n AS containment FROM seen WHERE w >= 0 GROUP BY rid, name, n, w),
    best AS (
      SELECT rid, name, max(containment) AS containment FROM share WHERE containment >= {license_scan.CONTAINMENT}::DOUBLE GROUP BY ALL),
    found AS (
      SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(containment) AS most FROM best GROUP BY rid)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(most, 0)::DOUBLE AS best_containment
    FROM d LEFT JOIN found USING (rid)"""


def _vector_sql() -> str:
    v = vector_codes
    steps = []
    for k in range(v.ROUNDS + 1):
        # each part's nearest entry, ties to the lower one
        steps.append(
            f"""near{k} AS MATERIALIZED (
      SELECT rid, p, min({{'d': d, 'i': i}}) AS b
      FROM (SELECT rid, p, i, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM part JOIN entry{k} USING (p)) GROUP BY rid, p)"""
        )
        if k < v.ROUNDS:
            steps.append(
                f"""entry{k + 1} AS MATERIALIZED (
      SELECT p, i, coalesce(m, e) AS e FROM entry{k} LEFT JOIN (
        SELECT p, i, list(m ORDER BY q) AS m
        FROM (SELECT p, b.i AS i, q, floor(sum(x[q])::DOUBLE / count(*))::BIGINT AS m
              FROM near{k} JOIN part USING (rid, p), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM part))) AS q) GROUP BY ALL)
        GROUP BY p, i) USING (p, i))"""
            )
    last = v.ROUNDS
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, vec_id, label,
             list_transform(embedding, lambda x: floor({v.SCALE} * x::DOUBLE)::BIGINT) AS c
      FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS MATERIALIZED (
      SELECT rid, p, c[p * (len(c) // {v.PARTS}) + 1:(p + 1) * (len(c) // {v.PARTS})] AS x
      FROM (SELECT rid, c, unnest(range({v.PARTS})) AS p FROM d)),
    entry0 AS MATERIALIZED (
      SELECT p, r - 1 AS i, x AS e FROM part JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, c) AS r FROM d) USING (rid)
      WHERE r <= {v.ENTRIES}),
    {", ".join(steps)},
    done AS (
      SELECT rid, string_agg(printf('%02x', b.i), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near{last} GROUP BY rid),
    books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM entry{last})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM d JOIN done USING (rid), books"""


def _fill_in_middle_sql() -> str:
    m = fill_in_middle
    space = r"\x20\x09-\x0D"
    drawn = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    p, s, x = (mark.decode() for mark in (m.PREFIX, m.SUFFIX, m.MIDDLE))
    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{m.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
             regexp_extract_all(coalesce(text, ''), '[{space}]*[^{space}]+|[{space}]+') AS units FROM documents),
    r AS (SELECT doc_id, text, units, len(units) AS n, {drawn} FROM d),
    f AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{x}')
                    OR h3 % 100 >= {m.TRANSFORMED} THEN 'plain'
                  WHEN h4 % 100 < {m.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM r),
    c AS (
      SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS before, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:], '') AS after FROM f)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(before) END::BIGINT AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || before || '{s}' || after || '{x}' || mid
                  ELSE '{s}' || after || '{p}' || before || '{x}' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM c"""


def _minmax_sql() -> str:
    k = minmax.SHINGLE
    return rf"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
    g AS MATERIALIZED (
      SELECT DISTINCT rid, array_to_string(words[s:s + {k - 1}], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS s FROM d WHERE len(words) > 0)),
    n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
    link AS MATERIALIZED (
      SELECT u, v FROM (SELECT a.rid AS u, b.rid AS v, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.rid < b.rid GROUP BY ALL)
      JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * i >= {minmax.SIMILAR} * (x.n + y.n - i)),
    either AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
    reached AS (SELECT rid AS u, rid AS v FROM d UNION SELECT r.u, e.v FROM reached r JOIN either e ON e.u = r.v),
    least AS (SELECT r.u AS rid, min(d.doc_id) AS component_id FROM reached r JOIN d ON d.rid = r.v GROUP BY r.u)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM d JOIN least USING (rid) LEFT JOIN n USING (rid)"""


#: the others hash with XXH64, fit models or encode by a vocabulary; tests hold them against brute force or accuracy
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _line_rules_sql(),
    "op4_decontamination": _decontamination_sql(),
    "op6_substring_dedup": _substring_sql(),
    "op7_license_scan": _license_sql(),
    "op11_vector_codes": _vector_sql(),
    "op12_fill_in_middle": _fill_in_middle_sql(),
    "op13_minmax_near_duplicates": _minmax_sql(),
}

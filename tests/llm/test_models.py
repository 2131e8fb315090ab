"""Language, toxicity and line quality: held-out accuracy, and the awkward rows."""

import itertools
import math
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import common, language, line_crf, queries, toxicity
from tests.llm.cases import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_languages_are_found(spark):
    got = queries.op2_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == truth.count() and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    df = documents(spark)
    model = language.broadcast(spark, language.train(df))
    got = df.select("doc_id", "text", language.predictor(model)("text").alias("x")).select("doc_id", "text", "x.*").collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    none = language.broadcast(spark, language.train(documents(spark, [])))
    assert {r[0] for r in df.select(language.predictor(none)("text")["lang_pred"]).collect()} == {"und"}


def test_unseen_words_back_off_to_shorter_grams():
    model = language.fit(["strasse strasse strasse haus haus haus"] * 2, ["de", "de"])
    assert "strasse" in model.words and model.scores("strasse") == model.words["strasse"]
    other = language.fit(["strasse haus " * 3, "calle casas " * 3], ["de", "es"])
    scores = dict(zip(other.languages, other.scores("strassen")))
    assert scores["de"] > scores["es"]
    assert other.scores("ж") == (0.0, 0.0)


def plain_words(text):
    """Runs of letters, found by the category of every character."""
    runs = itertools.groupby(text.lower(), lambda c: unicodedata.category(c)[0] == "L")
    return ["".join(g) for letters, g in runs if letters]


def brute_language(text, model):
    """Language and score word by word from the model's tables, longest known n-grams first."""
    sums = [0.0] * len(model.languages)
    words = plain_words(text or "")
    if not words or not model.languages:
        return "und", 0.0
    for word in words:
        found = [model.words[word]] if word in model.words else []
        for n in (4, 3, 2, 1):
            whole = f"^{word}$" if n > 1 else word
            found = found or [model.grams[n][whole[k : k + n]] for k in range(len(whole)) if whole[k : k + n] in model.grams[n] and k + n <= len(whole)]
        for k in range(len(sums)):
            sums[k] += sum(f[k] for f in found) / len(found) if found else 0.0
    best = max(sums)
    return model.languages[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums)


def test_language_of_the_tables_is_that_of_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(df, most=300)
    long = spark.createDataFrame([(-1, "Stra\u00dfenbahn " * 30_000, None), (-2, "a\u0301 \u4e2d1\u6587 x_y", None)], df.schema)
    rows = df.union(long).union(documents(spark).select("doc_id", "text", "lang"))
    for r in rows.select("text", language.predictor(language.broadcast(spark, model))("text").alias("x")).collect():
        lang, score = brute_language(r["text"], model)
        assert r["x"]["score"] == pytest.approx(score, abs=1e-6)
        assert r["x"]["lang_pred"] == lang


def test_language_tables_are_plain_counts():
    texts, langs = ["Haus haus HAUS baum1baum", "casa la casa la la", "haus la"], ["de", "es", "de"]
    model = language.fit(texts, langs)
    counts = {x: Counter(w for t, y in zip(texts, langs) if x == y for w in plain_words(t)) for x in ("de", "es")}
    known = [w for w in set(counts["de"]) | set(counts["es"]) if counts["de"][w] + counts["es"][w] >= 3]
    assert sorted(model.words) == sorted(known) == ["haus", "la"]
    for w in known:
        for k, x in enumerate(("de", "es")):
            expected = math.log((counts[x][w] + 0.5) / (counts[x].total() + 0.5 * (len(known) + 1)))
            assert model.words[w][k] == pytest.approx(expected)
    assert "^hau" in model.grams[4] and "aus$" in model.grams[4] and "bau" not in model.grams[3]


def rates(rows, label):
    held = [r for r in rows if r["held_out"]]
    order = np.argsort(np.argsort([r["score"] for r in held])) + 1
    y = np.array([r[label] for r in held])
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)), held


def test_held_out_toxicity(spark, labels):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id"
    )
    area, held = rates(rows.collect(), "toxic")
    caught = np.mean([r["predicted"] for r in held if r["toxic"]])
    wrong = np.mean([r["predicted"] for r in held if not r["toxic"]])
    assert area > 0.95 and caught > 0.75 and wrong < 0.02


def test_offending_sentences_are_located():
    clean = ["the cat sat on the mat. it was warm\nand quiet", "we walk to the lake. birds sing!"] * 30
    foul = ["the cat sat. you utter scumbag! it was warm", "we walk\nwhat a scumbag. birds sing"] * 20
    model = toxicity.fit(clean + foul, np.array([0] * 60 + [1] * 40))
    weights = toxicity.WordWeights(model.weights)
    document, ordinal, p = toxicity.sentence_scores([b"birds sing. you scumbag!\nwarm and quiet", b"", b"..."], weights, model.bias)
    assert document.tolist() == [0, 0, 0] and ordinal.tolist() == [0, 1, 3]
    assert p[1] > 0.5 > max(p[0], p[2])


def brute_toxicity(text, model):
    """Noisy-or of the sentences by plain Python: words and their beginnings, sentence by sentence."""
    clean, found = 1.0, []
    for k, sentence in enumerate(re.split(r"[.!?\n]", text or "")):
        words = re.findall(r"[^\x00-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence))
        if words:
            z = model.bias
            for w in words:
                z += model.weights.get(w, 0) + sum(model.weights.get(f"{w[:n]}*", 0) for n in range(3, 9) if n <= len(w))
            p = 1 / (1 + math.exp(-max(-30, min(30, z))))
            clean *= 1 - p
            found += [(k, p)] if p >= 0.5 else []
    return 1 - clean, found


def test_toxicity_of_the_tables_is_that_of_brute_force(spark, labels):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    model = toxicity.train(df, labels)
    assert model.weights
    for r in df.select("text", toxicity.scorer(model)("text").alias("s")).collect():
        score, found = brute_toxicity(r["text"], model)
        assert r["s"]["score"] == pytest.approx(score, abs=1e-9)
        assert [x["ordinal"] for x in r["s"]["offending"]] == [k for k, _ in found]
        assert [x["score"] for x in r["s"]["offending"]] == pytest.approx([p for _, p in found])


def test_a_long_text_of_offending_sentences_is_split_once():
    model = toxicity.Model({"scumbag": 9.0}, -4.0)
    text = ("you scumbag! " * 80_000).encode()
    start = time.perf_counter()
    document, ordinal, p = toxicity.sentence_scores([b"birds sing", text], toxicity.WordWeights(model.weights), model.bias)
    found = toxicity.offending_sentences([b"birds sing", text], document, ordinal, p)
    assert time.perf_counter() - start < 5
    assert [len(f) for f in found] == [0, 80_000] and found[1][79_999]["ordinal"] == 79_999
    assert {f["text"] for f in found[1]} == {"you scumbag"}


def test_toxicity_of_awkward_rows(spark, labels):
    df = documents(spark)
    train = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (9, 0)], "doc_id bigint, toxic int")
    for own in (train, train.limit(0)):
        model = toxicity.train(df, own)
        kept = toxicity.keep_clean(df, model)
        assert kept.columns == df.columns
        scores = df.select("text", toxicity.scorer(model)("text").alias("x")).select("text", "x.score").collect()
        assert len(scores) == df.count() and all(0 <= r["score"] <= 1 for r in scores)
        assert all(r["score"] == 0 for r in scores if not (r["text"] or "").strip())
    assert toxicity.train(documents(spark, []), train).weights == {}


def test_held_out_quality(spark, labels):
    area, held = rates(queries.op8_quality_crf(spark, SF).join(labels, "doc_id").collect(), "quality")
    assert area > 0.97
    assert np.mean([r["predicted"] for r in held if r["quality"]]) > 0.97
    assert np.mean([r["predicted"] for r in held if not r["quality"]]) < 0.25


def brute_quality(text, model):
    """Length-weighted probability of good lines, by forward and backward sums line by line."""
    lines = [line for line in (text or "").encode().split(b"\n") if line.split()]
    if not lines:
        return 0.0
    own = [line_crf.line_figures(line, line.split()) for line in lines]
    none = (0.0,) * line_crf.N_FIGURES
    emit = []
    for k, figures in enumerate(own):
        before, after = own[k - 1] if k else none, own[k + 1] if k + 1 < len(own) else none
        x = (*figures, *before, *after, float(k == 0), float(k == len(own) - 1), 1.0)
        emit.append((0.0, math.fsum(a * b for a, b in zip(x, model.weights))))

    def both(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    ahead, back = [emit[0]], [(0.0, 0.0)]
    for e in emit[1:]:
        p = ahead[-1]
        ahead.append(tuple(e[j] + both(p[0] + model.moves[0][j], p[1] + model.moves[1][j]) for j in (0, 1)))
    for e in emit[:0:-1]:
        p = back[-1]
        back.append(tuple(both(model.moves[i][0] + e[0] + p[0], model.moves[i][1] + e[1] + p[1]) for i in (0, 1)))
    odds = [(f[1] + b[1]) - (f[0] + b[0]) for f, b in zip(ahead, back[::-1])]
    good = [1 / (1 + math.exp(-max(-700, min(700, z)))) for z in odds]
    return sum(len(line) * g for line, g in zip(lines, good)) / sum(map(len, lines))


def test_quality_of_the_tables_is_that_of_brute_force(spark, labels):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = line_crf.train(df, labels, most=300)
    assert np.abs(model.moves).max() > 0.1
    long = spark.createDataFrame([(-1, "a plain line of words.\n" * 20_000), (-2, "one line " * 50_000)], df.schema)
    rows = df.union(long).union(documents(spark).select("doc_id", "text"))
    for r in rows.select("text", line_crf.scorer(model)("text").alias("s")).collect():
        assert r["s"] == pytest.approx(brute_quality(r["text"], model), abs=1e-8)


def test_quality_of_awkward_rows(spark):
    df = documents(spark)
    train = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 1), (7, 0)], "doc_id bigint, quality int")
    for own in (train, train.limit(0)):
        scores = df.select("text", line_crf.scorer(line_crf.train(df, own))("text").alias("x")).collect()
        assert len(scores) == df.count() and all(0 <= r["x"] <= 1 for r in scores)
        assert all(r["x"] == 0 for r in scores if not (r["text"] or "").split())


def test_marginals_are_those_of_all_labellings():
    """Forward-backward against the sum over every labelling."""
    rng = np.random.default_rng(0)
    moves, n = rng.normal(size=(2, 2)), np.array([3, 0, 1, 4])
    emit = rng.normal(size=n.sum())
    good, pairs = line_crf._marginals(emit, moves, n)
    at = pair = 0
    for size in n:
        weights, sums, pair_sums = 0.0, np.zeros(size), np.zeros((max(size - 1, 0), 2, 2))
        for bits in range(2**size):
            y = [bits >> k & 1 for k in range(size)]
            w = np.exp(sum(emit[at + k] * y[k] for k in range(size)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weights += w
            sums += w * np.array(y)
            for k, (a, b) in enumerate(zip(y, y[1:])):
                pair_sums[k, a, b] += w
        assert np.allclose(good[at : at + size], sums / weights)
        assert np.allclose(pairs[pair : pair + len(pair_sums)], pair_sums / weights)
        at, pair = at + size, pair + len(pair_sums)


def test_a_fit_collects_one_text_a_key_and_bounded_characters(spark, monkeypatch):
    rows = [(1, f"hot {k} " + "word " * 20) for k in range(300)] + [(k, f"own {k} text") for k in range(2, 60)]
    df = spark.createDataFrame(rows * 2, "doc_id bigint, text string")
    sample = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id bigint, label int")
    texts, given = common.training_texts(df, sample, "doc_id", "text", 1000)
    assert len(texts) == 59 and given.tolist() == [k % 2 for k in range(1, 60)] and texts[1] == "own 2 text"
    for most in (0, 100, 250):
        texts, given = common.training_texts(df, sample, "doc_id", "text", 1000, most)
        assert sum(map(len, texts)) <= most and len(texts) == len(given) and (most == 0 or texts)
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append((texts, langs)))
    language.train(df.selectExpr("doc_id", "text", "'en' AS lang"), folds=1, rest=1)
    language.train(df.selectExpr("doc_id", "text", "'en' AS lang"), folds=1, rest=1, most_total=250)
    assert len(seen[0][0]) == 59 and 0 < sum(map(len, seen[1][0])) <= 250


def test_a_rare_language_is_in_the_sample(spark, monkeypatch):
    rows = [(k, f"the house {k}", "en") for k in range(3000)] + [(k, "ett hus " * 4, "sv") for k in range(3000, 3004)]
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append((texts, langs)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    language.train(df, folds=1, rest=1, most=60)
    language.train(df, folds=1, rest=1, most=60, most_total=300)
    language.train(df, folds=1, rest=1, most=60, most_total=1)
    assert [seen[0][1].count(x) for x in ("en", "sv")] == [56, 4]
    assert sum(map(len, seen[1][0])) <= 300 and seen[1][1].count("sv") == 4
    assert sorted(seen[2][1]) == ["en", "sv"]


def test_same_results_for_every_partitioning(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    tables = spark.read.parquet(f"{SF}/labels.parquet")
    for train in (toxicity.train, line_crf.train):
        a, b = train(df, tables), train(df.repartition(7), tables.repartition(3))
        if isinstance(a, toxicity.Model):
            assert a == b
        else:
            assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
    a, b = language.train(df), language.train(df.repartition(7))
    assert a == b

"""BPE against the public library, registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import bpe, queries, toxicity
from tests.llm.cases import documents, letter_words, space_words
from tests.llm.test_dedup import brute_components, brute_cut, brute_fingerprint
from tests.llm.test_scans import brute_matches
from tools.check import TABLES, key, plain

PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read())


def digest(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), digest(np.array(ids, "<u4").tobytes()), digest(decoded.encode())


def test_all_code_points(library, codec):
    for base in range(0, 0x30000, 512):
        if not 0xD800 <= base < 0xE000:
            text = "".join(f"a{chr(k)} {chr(k)}1" for k in range(base, base + 512))
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts(library, codec):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u200b", "'s", "'ll", "'", "ab", "Hello", "12", "½", "é"]
    parts += ["ß", "中", "😀", "<|endoftext|>", "<|", "the", "ing", "a" * 50, "!", "...", "\0", "ñ", "xyzzy" * 30]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, text
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_fragments_cut_only_where_no_token_reaches(codec):
    inside = {t[k : k + 2] for t in codec.bytes_of.values() for k in range(len(t) - 1)}
    piece = " zqxjkvbäöü中文qzzq".encode()
    starts = [0, *(np.flatnonzero(codec.cuts(np.frombuffer(piece, np.uint8))) + 1).tolist()]
    fragments = [piece[a:b] for a, b in zip(starts, [*starts[1:], len(piece)])]
    assert b"".join(fragments) == piece and len(fragments) > 1
    assert all(a[-1:] + b[:1] not in inside for a, b in zip(fragments, fragments[1:]))
    assert all(f[k : k + 2] in inside for f in fragments for k in range(len(f) - 1))


def test_memory_is_bounded_without_effect(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 700)
    text = "one two three four five six seven one two"
    assert codec.encode(text) == codec.encode(text)
    assert codec.held > 700
    codec.encode("eight")
    assert codec.held < 700
    codec.forget()
    assert codec.held == 0 and set(codec.known) == set(codec.special)


def test_other_ways_of_cutting_and_merging_are_refused():
    with open(PATH) as file:
        spec = json.load(file)
    bpe.check_supported(spec)
    for part, change in (
        (spec, {"normalizer": {"type": "NFC"}}),
        (spec["pre_tokenizer"], {"add_prefix_space": True}),
        (spec["pre_tokenizer"], {"type": "Whitespace"}),
        (spec["model"], {"ignore_merges": True}),
        (spec["model"], {"dropout": 0.1}),
    ):
        old = dict(part)
        part.update(change)
        with pytest.raises(ValueError, match=next(iter(change)) if part is not spec["pre_tokenizer"] else "pre_tokenizer"):
            bpe.Codec(json.dumps(spec).encode())
        part.clear()
        part.update(old)


def test_awkward_rows_round_trip(spark, library):
    df = documents(spark)
    vocabulary = bpe.load(spark, PATH)
    rows = bpe.encoded(df, vocabulary, "text", "text", decode=True).withColumn("again", bpe.decoder(vocabulary)("ids"))
    found = rows.collect()
    assert len(found) == df.count()
    for r in found:
        text = r["doc_id"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert r["decoded"] == r["again"] == text
    assert bpe.encoded(df, vocabulary).columns == ["doc_id", "ids"]
    assert bpe.encoded(documents(spark, []), vocabulary).count() == 0


def test_round_trip_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_bpe_round_trip(spark, sf_dir).collect()}
    assert got == {i: library_row(library, t) for i, t in texts.items()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((plain(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall()), key=key)
    assert sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=key) == expected


def test_simhash_query_against_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    expected = {i: (f"{f:016x}", rows[g][0]) for (i, _), f, g in zip(rows, prints, label)}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op9_simhash_components(spark, sf_dir).collect()} == expected


def brute_pipeline(rows, clean, items, library):
    """(doc_id, n_tokens, digests) of what the stages keep."""
    rows = [(i, t) for i, t in rows if clean(t)]
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    rows = [rows[k] for k in sorted(set(label))]
    cut = {i: (n, gone, kept) for i, n, gone, kept in brute_cut(rows, 50)}
    rows = [(i, t if not cut[i][1] else cut[i][2]) for i, t in rows if not cut[i][1] or cut[i][1] < cut[i][0]]
    hit = {i for i, _, n, _ in brute_matches(rows, items) if n}
    return {i: library_row(library, t) for i, t in rows if i not in hit}


def test_pipeline_against_brute_force(spark, sf_dir, library):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(df, labels)
    weights = toxicity.WordWeights(model.weights)

    def clean(text):
        _, _, p = toxicity.sentence_scores([text.encode()], weights, model.bias)
        return 1 - np.prod(1 - p) < toxicity.THRESHOLD

    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute_pipeline(rows, clean, items, library)
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected
    assert 0 < len(expected) < len(rows)


def test_stages_keep_columns_and_handle_awkward_rows(spark, sf_dir):
    for docs in (documents(spark), documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.schema == docs.schema, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_a_cut_text_changes_text_and_length_only(spark, sf_dir):
    df = documents(spark)
    cut = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, df, sf_dir)
    row = cut.where(F.col("doc_id") == 2).first()
    assert row["n_chars"] == len(row["text"]) < len(df.where("doc_id = 2").first()["text"])
    assert " ".join(space_words(row["text"])) == row["text"] and letter_words(row["text"])

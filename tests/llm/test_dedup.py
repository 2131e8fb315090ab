"""SimHash components and repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tallyloom.llm import simhash, substring
from tests.llm.cases import documents, lower, passage, space_words

SIMPLE = "doc_id bigint, text string"


def brute_fingerprint(text) -> int:
    words = space_words(lower(text))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values: list[int]) -> list[int]:
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a in range(len(values)):
            for b in range(a):
                if label[a] != label[b] and (values[a] ^ values[b]).bit_count() <= 3:
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if x == old else x for x in label]
                    changed = True
    return label


def test_fingerprints_and_components_of_awkward_rows(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    smallest = {
        g: min((i for (i, _), own in zip(rows, label) if own == g and i is not None), default=None) for g in set(label)
    }
    expected = sorted(((i, f"{f:016x}", smallest[g]) for (i, _), f, g in zip(rows, prints, label)), key=str)
    found = simhash.near_duplicates(df)
    got = found.select("doc_id", simhash.as_hex(found["fp"]), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected


@pytest.mark.parametrize("average,most", [(4, 8), (4, 1000), (10_000, 20_000), (1, 2)])
def test_every_way_of_tiling_gives_the_same_components(spark, average, most):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    hot = rng.getrandbits(64)
    values = set(base)
    for b in [*base[:15], *[hot] * 60]:
        values.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), average, most)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = defaultdict(set)
    for v, g in zip(signed, brute_components(values)):
        groups[g].add(v)
    expected = {v: min(own) for own in groups.values() for v in own}
    assert {v: roots.get(v, v) for v in signed} == expected


def test_a_long_chain_of_links_is_one_component(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 700), (900, 700)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 700: 500, 900: 500}


def test_tile_links_are_a_forest_that_keeps_every_group():
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.unique(center ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    assert len(simhash.tile_links(near, None)) == len(near) - 1
    assert len(simhash.tile_links(near[:20], near[20:])) == len(near) - 1


def test_keep_one_keeps_columns_and_one_row_of_each_component(spark):
    df = documents(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    every = [brute_fingerprint(r["text"]) for r in df.collect()]
    assert len(rows) == len(set(brute_components(every)))
    assert sorted(set(brute_components(prints))) == list(range(len(prints)))
    # of the two rows with key 9 and the one without a key, the row with a key stays
    assert [r["doc_id"] for r in rows if r["text"] == passage(5, 70)] == [9]


def test_keep_one_drops_repeated_rows_and_tells_texts_of_a_key_apart(spark):
    rows = [(1, passage(1, 90), "a")] * 40 + [(1, passage(2, 90), "b"), (2, passage(2, 90), "c"), (3, passage(3, 90), "d")]
    rows += [(None, passage(3, 90), "e"), (None, passage(4, 90), "f"), (None, passage(4, 90), "f"), (5, None, "g"), (6, "", "h")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, lost string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["lost"]) for r in kept) == [("1", "a"), ("1", "b"), ("3", "d"), ("5", "g"), ("None", "f")]


def test_a_row_repeated_many_times_and_a_passage_in_every_document(spark):
    shared = passage(7, 70)
    rows = [(1000, passage(11, 120) + " " + shared)] * 10_000 + [(k, f"{passage(100 + k, 20)} {shared} {passage(300 + k, 20)}") for k in range(300)]
    df = spark.createDataFrame(rows, SIMPLE).repartition(6)
    expected = {r[0]: r for r in brute_cut(list(set(rows)), substring.WINDOW)}
    assert cut(df) == sorted((expected[i] for i, _ in rows), key=str)


def test_empty_tables(spark):
    df = documents(spark, [])
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
    assert substring.without_repeats(df).count() == 0


def brute_cut(rows, window):
    """(doc_id, n_words, n_removed, kept) with rows of one key as one document."""
    first = {}
    for i, t in rows:
        w = space_words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = space_words(t)
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def cut(df, window=substring.WINDOW, **hot):
    rows = substring.without_repeats(df, window=window, **hot).select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept")
    return sorted(map(tuple, rows.collect()), key=str)


def test_awkward_rows_are_cut_as_by_brute_force(spark):
    df = documents(spark)
    expected = brute_cut([(r["doc_id"], r["text"]) for r in df.collect()], substring.WINDOW)
    assert any(n for _, _, n, _ in expected)
    assert cut(df) == expected


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats_are_cut_as_by_brute_force(spark, seed):
    """Texts over few words with copied, shifted and nested passages, so that minimisers repeat inside a text."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts += p[a : a + rng.randint(5, 60)] if rng.random() < 0.7 else [rng.choice("abcdefgh") for _ in range(20)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    df = spark.createDataFrame(rows, SIMPLE).repartition(5)
    for window in (12, 50):
        expected = brute_cut(rows, window)
        assert cut(df, window) == expected
        # every minimiser that occurs twice, or only some of them, counted window by window
        assert cut(df, window, hot=1) == cut(df, window, hot=1, most_hot=3) == expected


def test_super_kmers_hold_every_window_once():
    texts = [passage(k, 45 + 40 * k).encode() for k in range(5)] + [b"", b"one two"]
    found = substring.super_kmers(texts)
    windows = []
    for d, first, count, text in zip(found.doc, found.first, found.count, found.text):
        words = text.split(b" ")
        assert len(words) == count + substring.WINDOW - 1
        windows += [(d, first + k, b" ".join(words[k : k + substring.WINDOW])) for k in range(count)]
    expected = []
    for d, t in enumerate(texts):
        w = t.split()
        expected += [(d, k, b" ".join(w[k : k + substring.WINDOW])) for k in range(len(w) - substring.WINDOW + 1)]
    assert sorted(windows) == sorted(expected)

"""Vector codes, fill-in-middle outputs and min-max near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyloom.llm import fill_in_middle, minmax, vector_codes
from tests.llm.cases import documents, lower, passage, space_words

SIMPLE = "doc_id bigint, text string"


def sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


# --- vector codes ------------------------------------------------------------------------------


@pytest.mark.parametrize("dimension,most", [(16, 100), (1, 3), (2, 1 << 26), (5, 2)])
def test_tree_finds_the_nearest_entry_and_the_lowest_of_ties(dimension, most):
    rng = np.random.default_rng(dimension)
    entries = rng.integers(-most, most + 1, (256, dimension))
    entries[200:] = entries[:56]
    queries = np.concatenate([rng.integers(-2 * most, 2 * most + 1, (500, dimension)), entries])
    distance = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in entries] for q in queries[::7]])
    for tree in (vector_codes.Gnat(entries), vector_codes.Gnat(entries, splits=2, leaf=2)):
        index, best = tree.nearest(queries[::7])
        assert (index == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_search_leaves_whole_subtrees_out(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.integers(-100_000, 100_000, (16, 4))
    entries = (centers[:, None] + rng.integers(-50, 50, (16, 16, 4))).reshape(-1, 4)
    seen = []
    monkeypatch.setattr(vector_codes, "squared", lambda q, p, f=vector_codes.squared: seen.append(len(q) * len(p)) or f(q, p))
    tree = vector_codes.Gnat(entries, splits=16)
    seen.clear()
    tree.nearest(entries)
    assert sum(seen) < 256 * 256 / 3


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error, label_error, digest) of the rows (vec_id, vector, label) in plain Python."""
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[int(np.floor(np.float64(x) * scale)) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        distance = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return distance.index(min(distance)), min(distance)

    for _ in range(rounds):
        for p in range(parts):
            owner = [nearest(p, v[p])[0] for v in cut]
            new = list(books[p])
            for k in set(owner):
                own = [v[p] for v, o in zip(cut, owner) if o == k]
                new[k] = [sum(c) // len(own) for c in zip(*own)]
            books[p] = new
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for _, d in f) for f in found]
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    digest = sha(",".join(str(x) for b in books for e in b for x in e).encode())
    return sorted(
        ((r[0], "".join(f"{k:02x}" for k, _ in f), e, total[r[2]], digest) for r, f, e in zip(rows, found, errors)), key=str
    )


def codes(df, **options):
    books = vector_codes.train(df, **options)
    rows = vector_codes.with_group_error(vector_codes.coded(df, books)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256) for r in rows), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error long, label_error long, part int, k int, v string"


@pytest.mark.parametrize("entries", [256, 8])
def test_awkward_vectors_are_coded_as_by_brute_force(spark, entries):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(0, 0.3, (60, 8)), 2).astype(np.float32).tolist()
    rows = [(k, v, [0, 1, None][k % 3]) for k, v in enumerate(vectors)]
    rows += [(100, vectors[0], 0), (100, vectors[0], 0), (5, vectors[7], 1), (None, vectors[3], None), (None, vectors[4], 9)]
    rows += [(101, None, 0), (102, [], 0), (103, [None, *vectors[0][1:]], 0), (104, [float("nan")] * 8, 0)]
    rows += [(105, [float("-inf"), *vectors[0][1:]], None), (106, vectors[0][:4], 0), (-1, [0.0] * 8, 0), (107, [-0.0] * 8, 1)]
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], VECTORS).repartition(4)
    assert codes(df, entries=entries) == brute_codes(rows, entries=entries)


def test_vectors_of_no_row_or_of_odd_lengths(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes(empty) == []
    assert codes(spark.createDataFrame([(1, [], 0, *[None] * 6), (2, None, 0, *[None] * 6)], VECTORS)) == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.train(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, *[None] * 6)], VECTORS))
    with pytest.raises(Exception, match="64 bits"):
        codes(spark.createDataFrame([(1, [1e30] * 8, 0, *[None] * 6)], VECTORS))


def test_codes_stand_for_vectors_nearby(spark):
    df = spark.createDataFrame([(k, [k / 10, -k / 5, 0.25, 1.0], 0) for k in range(9)], "vec_id long, embedding array<float>, label int")
    books = vector_codes.train(df)
    for r in vector_codes.coded(df, books).join(df, "vec_id").collect():
        assert np.allclose(books.decoded(r["code"]), r["embedding"], atol=1 / 1024)


# --- fill in middle ----------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, lengths = "plain", text, (None, None)
    else:
        form, lengths = ("spm" if h[3] % 100 < 80 else "psm"), (len(prefix), len(middle))
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return key, len(units), form, *lengths, sha(out.encode()), sha(text.encode()), out


def middles(df, **options):
    found = fill_in_middle.assembled(fill_in_middle.output_pieces(df, **options))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return sorted(map(tuple, found.select(names).collect()), key=str)


def middle_rows():
    rows = [(k, passage(k, k % 40) + [" ", "", "\n\n", " <", "<P> ", "<M", "é 中文"][k % 7]) for k in range(120)]
    rows += [(k, t) for k in range(200, 212) for t in (" \t\n", "a", "", None, "<S>" * 3, " x <M> y", "\x1cü\x85 \xa0", "<P")]
    return rows


@pytest.mark.parametrize("size", [7, 50, fill_in_middle.CHUNK])
def test_outputs_and_restored_texts_are_those_of_brute_force(spark, size):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert middles(df, size=size) == sorted((brute_middle(*r)[:7] for r in rows), key=str)
    rows = middle_rows() + middle_rows()[:30]
    df = spark.createDataFrame(rows, SIMPLE).repartition(5)
    expected = [brute_middle(*r) for r in rows]
    assert {e[2] for e in expected} == {"plain", "spm", "psm"}
    assert middles(df, size=size) == sorted((e[:7] for e in expected), key=str)
    texts = fill_in_middle.outputs(fill_in_middle.output_pieces(df, size=size)).collect()
    assert sorted((str(r["doc_id"]), r["form"], bytes(r["output"])) for r in texts) == sorted(
        (str(e[0]), e[2], e[7].encode()) for e in expected
    )


def test_pieces_are_whole_units_of_bounded_size(spark):
    rows = [(1, passage(3, 400)), (2, "x" * 5000 + " " + passage(4, 50)), (3, " " * 3000)]
    found = fill_in_middle.output_pieces(spark.createDataFrame(rows, SIMPLE), size=100).where("place >= 0").collect()
    assert found and all(0 < len(r["piece"]) <= 100 for r in found)
    words = [w for r in found for w in bytes(r["piece"]).split() if w.startswith(b"w")]
    assert sorted(words) == sorted(w.encode() for t in (rows[0][1], rows[1][1]) for w in t.split() if w.startswith("w"))


def test_very_long_texts_and_repeated_rows_of_the_middle(spark):
    rows = [(k, t) for k in range(4) for t in ("a" * 1_000_000, " " * 1_000_000, "ab " * 300_000)] + [(7, "one two three")] * 3000
    df = spark.createDataFrame(rows, SIMPLE).repartition(3)
    known = {r: brute_middle(*r)[:7] for r in set(rows)}
    assert middles(df) == sorted((known[r] for r in rows), key=str)


def test_no_document_has_no_middle(spark):
    assert middles(documents(spark, [])) == []


# --- min-max hashing ---------------------------------------------------------------------------


def brute_sets(rows, width=4):
    out = []
    for _, t in rows:
        w = space_words(lower(t))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_near(rows):
    sets = brute_sets(rows)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and label[a] != label[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[b] if x == label[a] else x for x in label]
    least = {g: min((i for (i, _), x in zip(rows, label) if x == g and i is not None), default=None) for g in set(label)}
    return sorted(((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, label)), key=str)


def near(df, **options):
    found = minmax.near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def test_awkward_rows_are_linked_as_by_brute_force(spark):
    df = documents(spark)
    assert near(df) == brute_near([(r["doc_id"], r["text"]) for r in df.collect()])


def edited_copies(seed: int, n: int, words: int, edits: int) -> list[str]:
    """Copies of one text with some words replaced, so that pairs lie on both sides of the bound."""
    rng = random.Random(seed)
    base = passage(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.randint(0, edits)):
            own[k] = f"e{rng.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("options", [{}, {"small": 2, "tile": 7}, {"small": 1, "tile": 3, "tile_shingles": 300}])
def test_groups_of_copies_are_linked_as_by_brute_force(spark, options):
    rng = random.Random(5)
    texts = [t for seed, n, words, edits in ((1, 60, 100, 5), (2, 50, 80, 8), (3, 12, 300, 9)) for t in edited_copies(seed, n, words, edits)]
    texts += [passage(9, 60) + " " + passage(20 + k, 60) for k in range(30)]  # a passage that many share, no link
    texts += [" ".join(passage(40, 200).split()[k : k + 120]) for k in range(0, 80, 4)]  # a chain of overlaps
    texts += texts[:20] + [passage(50 + k, 3) for k in range(5)] * 2 + ["", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0])]
    expected = brute_near(rows)
    assert len({c for _, n, c in expected if n}) < 0.6 * len(rows)
    assert near(spark.createDataFrame(rows, SIMPLE).repartition(6), **options) == expected


def test_minima_and_maxima_estimate_the_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a, b, c = (np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in (160, 20, 20))
        (low, high) = minmax.signatures([np.concatenate([a, b]), np.concatenate([a, c])])
        errors.append(np.mean(np.concatenate([low[0] == low[1], high[0] == high[1]])) - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(3)
    linked = rng.random((40, 40)) < 0.03
    left, right, label = np.arange(40), np.arange(40, 80), np.arange(80)
    edges = minmax.forest(linked, left, right, label.copy())
    want, have = label.copy(), label.copy()
    for target, pairs in ((want, np.argwhere(linked) + [0, 40]), (have, edges)):
        for u, v in pairs:
            target[target == target[v]] = target[u]
    assert len(edges) == 80 - len(set(want)) and len(set(zip(want, have))) == len(set(want)) == len(set(have))


def test_no_document_has_no_near_duplicate(spark):
    assert near(documents(spark, [])) == []
    assert near(spark.createDataFrame([(1, ""), (1, None), (None, " ")], SIMPLE)) == [(1, 0, 1), (1, 0, 1), (None, 0, None)]

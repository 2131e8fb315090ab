"""BLEU and ROUGE between aligned texts, over whole texts.

One reference per row: both texts are in the row, so the overlap is counted where the row is and only
numbers leave the task. Several references per id: n-gram rows are counted and joined, so an id with very
many references is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import ngrams as G
from tallyloom.functions import text as X
from tallyloom.session import cut_lineage

COUNTS = ("matches", "shared", "kinds_a", "kinds_b")
OVERLAP = "struct<size_a:int,size_b:int," + ",".join(f"{c}:array<int>" for c in COUNTS) + ">"
UNITS = 1 << 18  # units of both sides that are numbered at a time, unless one pair has more


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _lengths(values: pa.Array) -> np.ndarray:
    """Characters of every text, or tokens of every array; 0 for NULL."""
    size = pc.utf8_length(values) if _is_text(values.type) else pc.list_value_length(values)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(left: pa.Array, right: pa.Array) -> np.ndarray:
    """A number for every unit of the left rows and then of the right ones, laid end to end."""
    if _is_text(left.type):
        text = "".join(v for side in (left, right) for v in side.to_pylist() if v)
        return pd.factorize(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))[0].astype(np.int64)
    units = pa.concat_arrays([left.flatten(), right.flatten()])
    return units.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(left: pa.Array, right: pa.Array):
    """(left, right, sizes of both, numbered units) of runs of rows that have UNITS units together.

    A batch has as many rows as Spark puts in it, whatever their length, so what is worked out at a time is
    bounded by its units here.
    """
    size_a, size_b = _lengths(left), _lengths(right)
    place = np.cumsum(size_a + size_b) // UNITS
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(left)]
    for start, end in zip(bounds, bounds[1:]):
        if start < end:
            a, b = left.slice(start, end - start), right.slice(start, end - start)
            yield size_a[start:end], size_b[start:end], _numbered(a, b)


def _grams(size_a: np.ndarray, size_b: np.ndarray, units: np.ndarray, order: int):
    """For n = 1 .. order: (n, number of every n-gram, numbered n-grams, its place in its row, whether that is a left one).

    N-grams are numbered by pair; the number of a kind modulo the pairs is its pair.
    """
    pairs = len(size_a)
    sizes = np.concatenate([size_a, size_b])
    segment = np.repeat(np.arange(2 * pairs), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(units))
    place = np.repeat(sizes, sizes) - rest
    base = int(units.max()) + 1 if len(units) else 1
    codes = units
    for n in range(1, order + 1):
        if n > 1:
            # an n-gram is the number of its first n - 1 units followed by one more unit
            codes = pd.factorize(codes[:-1] * base + units[n - 1 :])[0] if len(codes) > 1 else codes[:0]
        inside = np.flatnonzero(rest[: len(codes)] >= n)
        ids, kinds = pd.factorize(codes[inside] * pairs + segment[inside] % pairs)
        yield n, ids, kinds, place[inside], segment[inside] < pairs


def _counted(size_a: np.ndarray, size_b: np.ndarray, units: np.ndarray, order: int) -> np.ndarray:
    """[count, pair, n - 1] of COUNTS: units and n-grams are numbered once for all pairs."""
    pairs, found = len(size_a), []
    for _, ids, kinds, _, first in _grams(size_a, size_b, units, order):
        a, b = (np.bincount(ids[side], minlength=len(kinds)) for side in (first, ~first))
        whose = kinds % pairs
        found.append(
            [np.bincount(whose, w, pairs).astype(np.int32) for w in (np.minimum(a, b), (a > 0) & (b > 0), a > 0, b > 0)]
        )
    return np.array(found, dtype=np.int32).reshape(order, len(COUNTS), pairs).transpose(1, 2, 0)


def _overlaps(left: pa.Array, right: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the left rows, sizes of the right rows, counts as _counted gives them) of every pair of a batch."""
    parts = [(a, b, _counted(a, b, units, order)) for a, b, units in _pieces(left, right)]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(COUNTS), 0, order), np.int32))
    return tuple(np.concatenate(part, axis=-2 if k == 2 else 0) for k, part in enumerate(zip(none, *parts)))


def batch_overlap(left, right, order: int) -> pd.DataFrame:
    """The overlap of every pair of a batch."""
    kind = pa.string() if any(isinstance(v, str) for v in [*left, *right]) else pa.list_(pa.string())
    size_a, size_b, table = _overlaps(pa.array(left, kind), pa.array(right, kind), order)
    out = pd.DataFrame({"size_a": size_a, "size_b": size_b})
    for name, counts in zip(COUNTS, table):
        out[name] = counts.tolist()
    return out


def overlap(a, b, order: int) -> Column:
    """STRUCT(size_a, size_b, matches, shared, kinds_a, kinds_b) of two token arrays, or of two texts by character.

    ``matches[n-1]`` is the clipped number of common n-grams, ``shared`` the number of distinct common
    ones, ``kinds_*`` the number of distinct ones on each side.
    """

    @F.arrow_udf(OVERLAP)
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        size_a, size_b, table = _overlaps(left, right, order)
        ends = np.arange(len(left) + 1, dtype=np.int32) * order
        lists = [pa.ListArray.from_arrays(ends, np.ascontiguousarray(t).ravel()) for t in table]
        sizes = [pa.array(size.astype(np.int32)) for size in (size_a, size_b)]
        return pa.StructArray.from_arrays([*sizes, *lists], ["size_a", "size_b", *COUNTS])

    return count(X.col(a), X.col(b))


def _common_length(x: np.ndarray, y: np.ndarray) -> int:
    masks: dict[int, int] = {}
    for k, token in enumerate(x.tolist()):
        masks[token] = masks.get(token, 0) | (1 << k)
    full = (1 << len(x)) - 1
    row = full
    for token in y.tolist():
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def longest_common_subsequence(a, b) -> Column:
    """Length of the longest common subsequence of two token arrays, by bit-parallel rows."""

    @F.arrow_udf("int")
    def length(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for size_a, size_b, units in _pieces(left, right):
            rows = np.split(units, np.cumsum(np.concatenate([size_a, size_b]))[:-1])
            out += [_common_length(x, y) for x, y in zip(rows[: len(size_a)], rows[len(size_a) :])]
        return pa.array(out, pa.int32())

    return length(X.col(a), X.col(b))


# --- sentence BLEU with geometric smoothing --------------------------------------------------------


def smoothed_bleu4(o) -> Column:
    """BLEU-4 of ``overlap(hypothesis, reference, 4)``; the k-th zero precision becomes 1 / (2^k total)."""
    o = X.col(o)
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        total = F.greatest(o["size_a"] - (n - 1), F.lit(1))
        hits = F.get(o["matches"], F.lit(n - 1))
        zeros_now = zeros + F.when(hits == 0, 1).otherwise(0)
        precision = F.when(hits > 0, hits / total).otherwise(1 / (F.pow(F.lit(2.0), zeros_now) * total))
        logs, zeros = logs + F.log(precision) / 4, zeros_now
    penalty = F.when(o["size_a"] >= o["size_b"], F.lit(0.0)).otherwise(1 - o["size_b"] / o["size_a"])
    return F.when(F.get(o["matches"], F.lit(0)) == 0, F.lit(0.0)).otherwise(F.exp(logs + penalty))


# --- ROUGE ------------------------------------------------------------------------------------------


def f_score(hits, hypothesis, reference) -> Column:
    p, r = F.try_divide(hits, hypothesis), F.try_divide(hits, reference)
    return F.coalesce(F.try_divide(2.0 * p * r, p + r + 1e-8), F.lit(0.0))


def rouge(rows: DataFrame, hypothesis: Column, reference: Column, keep: Sequence[str]) -> DataFrame:
    """(keep, rouge_1, rouge_2, rouge_l): F scores of distinct n-grams and of the longest common subsequence.

    Arguments are token arrays, whatever the segmenter; an empty side scores 0.
    """
    tokens = rows.select(*keep, hypothesis.alias("__a"), reference.alias("__b"))
    counted = tokens.select(
        *keep, overlap("__a", "__b", 2).alias("o"), longest_common_subsequence("__a", "__b").alias("lcs")
    )

    def grams(n):
        return f_score(*[F.get(F.col(f"o.{c}"), F.lit(n - 1)) for c in ("shared", "kinds_a", "kinds_b")])

    return counted.select(
        *keep,
        grams(1).alias("rouge_1"),
        grams(2).alias("rouge_2"),
        f_score(F.col("lcs"), F.col("o.size_a"), F.col("o.size_b")).alias("rouge_l"),
    )


# --- corpus BLEU ------------------------------------------------------------------------------------


def corpus_bleu(rows: DataFrame, keys: Sequence[str], o: str, order: int = 4, smooth: bool = False) -> DataFrame:
    """(keys, bleu, brevity_penalty, translation_length, reference_length) from summed overlaps."""
    o = X.col(o)
    sums = rows.groupBy(*keys).agg(
        F.sum(o["size_a"]).cast("bigint").alias("translation_length"),
        F.sum(o["size_b"]).cast("bigint").alias("reference_length"),
        *[F.sum(F.get(o["matches"], F.lit(n - 1))).alias(f"__m{n}") for n in range(1, order + 1)],
        *[F.sum(F.greatest(o["size_a"] - (n - 1), F.lit(0))).alias(f"__t{n}") for n in range(1, order + 1)],
    )
    extra = 1.0 if smooth else 0.0
    precisions = [
        F.coalesce(F.try_divide(F.col(f"__m{n}") + extra, F.col(f"__t{n}") + extra), F.lit(0.0)) for n in range(1, order + 1)
    ]
    lowest = F.least(*precisions) if order > 1 else precisions[0]
    mean = sum((F.log(p) / order for p in precisions[1:]), F.log(precisions[0]) / order)
    ratio = F.col("translation_length") / F.col("reference_length")
    penalty = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    return sums.select(
        *keys,
        F.when(lowest > 0, F.exp(mean) * penalty).otherwise(0.0).alias("bleu"),
        penalty.alias("brevity_penalty"),
        "translation_length",
        "reference_length",
    )


# --- BLEU against several references -----------------------------------------------------------------

HITS = "array<struct<n:int,place:int,hits:int>>"


def batch_hits(left: pa.Array, right: pa.Array, order: int) -> pa.ListArray:
    """For every pair the n-grams both have: their first place on the left and their clipped number."""
    found, ends, done = [], [np.zeros(1, np.int64)], 0
    for size_a, size_b, units in _pieces(left, right):
        pairs, own = len(size_a), []
        for n, ids, kinds, place, first in _grams(size_a, size_b, units, order):
            a, b = (np.bincount(ids[side], minlength=len(kinds)) for side in (first, ~first))
            # the left rows come first, so where a kind is seen first is on the left if it is there at all
            start = np.full(len(kinds), -1, np.int64)
            start[ids[::-1]] = place[::-1]
            both = np.flatnonzero((a > 0) & (b > 0))
            own.append([kinds[both] % pairs, np.full(len(both), n), start[both], np.minimum(a, b)[both]])
        whose, *values = np.concatenate(own, axis=1)
        row = np.argsort(whose, kind="stable")
        found.append([v[row] for v in values])
        ends.append(done + np.cumsum(np.bincount(whose, minlength=pairs)))
        done = int(ends[-1][-1])
    columns = [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]).astype(np.int32) for k in range(3)]
    hits = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "place", "hits"])
    return pa.ListArray.from_arrays(np.concatenate(ends).astype(np.int32), hits)


def gram_hits(a, b, order: int) -> Column:
    """ARRAY(STRUCT(n, place, hits)) of the n-grams that two token arrays share, by the first place in ``a``."""

    @F.arrow_udf(HITS)
    def hits(left: pa.Array, right: pa.Array) -> pa.Array:
        return batch_hits(left, right, order)

    return hits(X.col(a), X.col(b))


def reference_bleu(predictions: DataFrame, golds: DataFrame, key: str, prediction: str, gold: str, order: int = 4) -> DataFrame:
    """(key, bleu): +1 smoothed BLEU x 100 against all golds of a key, shortest reference length.

    Both sides are lowercased, their punctuation is set apart and the mteval tokenizer applied. N-grams are
    counted per gold where it meets the prediction, and the largest count of each is kept.
    """

    def prepared(rows, column, name):
        # ids of the golds only have to tell them apart, the text does that
        return rows.select(key, G.mteval_tokens(G.split_marks(F.lower(X.strip(column)))).alias(name))

    texts = golds.join(predictions.select(key), key, "left_semi").select(key, gold).distinct()
    hyp = cut_lineage(prepared(predictions, prediction, "t"))
    ref = cut_lineage(prepared(texts, gold, "r"))
    met = ref.join(hyp, key).select(key, F.explode(gram_hits("t", "r", order)).alias("h"))
    most = met.groupBy(key, "h.n", "h.place").agg(F.max("h.hits").alias("most"))
    matched = most.groupBy(key).agg(*[F.sum(F.when(F.col("n") == n, F.col("most")).otherwise(0)).alias(f"__m{n}") for n in range(1, order + 1)])
    lengths = ref.groupBy(key).agg(F.min(F.size("r")).alias("__ref"))
    table = hyp.select(key, F.size("t").alias("__hyp")).join(lengths, key).join(matched, key, "left")
    tiny = F.lit(2.2250738585072014e-308)  # fixed value: smallest normal double, keeps the logarithm finite
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        add = 0.0 if n == 1 else 1.0
        hits, total = F.coalesce(f"__m{n}", F.lit(0)), F.greatest(F.col("__hyp") - (n - 1), F.lit(0))
        logs = logs + (F.log(hits + add + tiny) - F.log(total + add + tiny)) / order
    brevity = F.least(F.lit(0.0), 1 - (F.col("__ref") + 1.0) / (F.col("__hyp") + 1.0))
    return table.select(key, (100 * F.exp(logs + brevity)).alias("bleu"))

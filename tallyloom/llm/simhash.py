"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are compared in tiles with exclusive-or and bit counts. Two fingerprints within three bits agree on
at least one of their four 16-bit parts, so tiles are laid inside blocks of equal leading bits of a part; the number of
bits follows the number of fingerprints and a block holds a bounded number on average. Blocks that hold more are split
into tiles by population count and hash, and only tile pairs whose counts differ by the radius at most meet. A tile
pair returns a spanning forest of its links instead of all pairs, and components are joined by star contraction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyloom.llm.common import pieces
from tallyloom.session import cut_lineage

SEED = 42
SHINGLE = 3
RADIUS = 3
PARTS = 4
#: fingerprints a block holds on average, and from which on a block is split
AVERAGE, MOST = 2048, 8192
#: rows of one comparison
TILE = 512


def fingerprint(text: bytes) -> int:
    """Bitwise majority of the XXH64 of all word shingles, repeats included; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())),
        np.dtype(">u8"),
        len(words) - SHINGLE + 1,
    )
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """64-bit fingerprint of each text as a signed BIGINT; 0 for NULL and for texts without a word."""
    values = [fingerprint(t) for piece in pieces(texts) for t in piece]
    return pa.array(np.array(values, np.uint64).view(np.int64))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _union(values, rows, cols, label, mask, edges):
    """Joins the labels of all pairs in ``mask``; a pair of different labels adds one edge."""
    for r in np.flatnonzero(mask.any(axis=1)):
        groups = np.unique(np.append(label[cols[mask[r]]], label[rows[r]]))
        if len(groups) > 1:
            edges += [(values[groups[0]], values[g]) for g in groups[1:]]
            label[np.isin(label, groups[1:])] = groups[0]


def tile_links(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    values = left if right is None else np.concatenate([left, right])
    counts = np.bitwise_count(values).astype(np.int64)
    a = np.argsort(counts[: len(left)], kind="stable")
    b = a if right is None else len(left) + np.argsort(counts[len(left) :], kind="stable")
    label, edges = np.arange(len(values)), []
    for i in range(0, len(a), TILE):
        rows = a[i : i + TILE]
        for j in range(i if right is None else 0, len(b), TILE):
            cols = b[j : j + TILE]
            if counts[cols[0]] > counts[rows[-1]] + RADIUS or counts[rows[0]] > counts[cols[-1]] + RADIUS:
                continue
            near = np.bitwise_count(values[rows][:, None] ^ values[cols][None, :]) <= RADIUS
            if right is None and i == j:
                np.fill_diagonal(near, False)
            if near.any():
                _union(values, rows, cols, label, near, edges)
    return edges


def _compare(group: pa.Table) -> pa.Table:
    values = group.column("fp").to_numpy().view(np.uint64)
    second = group.column("second").to_numpy(zero_copy_only=False).astype(bool)
    edges = tile_links(values[~second], values[second] if second.any() else None)
    both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"u": both[:, 0], "v": both[:, 1]})


def links(distinct: DataFrame, average: int = AVERAGE, most: int = MOST) -> DataFrame:
    """(u, v): spanning forests, tile pair by tile pair, of the links among distinct fingerprints ``fp``."""
    n = distinct.count()
    bits = min(16, max(0, math.ceil(math.log2(max(n, 1) / average))))
    part = [
        F.struct(F.lit(p).alias("part"), F.expr(f"shiftright(fp, {48 - 16 * p}) & 65535").alias("value"))
        for p in range(PARTS)
    ]
    rows = distinct.select("fp", F.bit_count("fp").alias("pc"), F.explode(F.array(*part)).alias("p")).select(
        "fp", "pc", "p.part", F.shiftright("p.value", 16 - bits).alias("prefix")
    )
    # slots: tiles that a population count of a large block is dealt to
    large = (
        rows.groupBy("part", "prefix", "pc")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("part", "prefix")
        .agg(
            F.sum("n").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / average).cast("int")))).alias("slots"),
        )
        .where(F.col("n") > most)
        .select("part", "prefix", "slots")
    )
    rows = rows.join(large, ["part", "prefix"], "left").withColumn(
        "slot", F.coalesce(F.expr("pmod(xxhash64(fp), slots[pc])").cast("int"), F.lit(0))
    )
    meets = F.expr(
        f"""CASE WHEN slots IS NULL THEN array(struct(0 AS a, 0 AS b, 0 AS c, 0 AS d, false AS second)) ELSE
        flatten(transform(sequence(greatest(pc - {RADIUS}, 0), least(pc + {RADIUS}, 64)), q ->
          CASE WHEN slots[q] IS NULL THEN array() ELSE transform(sequence(0, slots[q] - 1), s ->
            CASE WHEN q > pc OR (q = pc AND s >= slot)
              THEN struct(pc AS a, slot AS b, q AS c, s AS d, false AS second)
              ELSE struct(q AS a, s AS b, pc AS c, slot AS d, true AS second) END) END)) END"""
    )
    tiles = rows.select("fp", "part", "prefix", F.explode(meets).alias("m")).select("fp", "part", "prefix", "m.*")
    return tiles.groupBy("part", "prefix", "a", "b", "c", "d").applyInArrow(_compare, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its own root, root being the smallest node reachable.

    Alternating large-star and small-star rounds; each round is written as a table, and the rounds end when the edges
    no longer change.
    """
    current, state = cut_lineage(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return current.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        state = tuple(seen)
        both = current.union(current.select("v", "u")).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", average: int = AVERAGE, most: int = MOST
) -> DataFrame:
    """(doc_id, text_key, fp, component_id), one row per document; links are fingerprints within three bits.

    Texts that are NULL or without a word share the fingerprint 0 and are linked like any other. ``component_id`` is
    the smallest key reachable, NULL where no document of the component has a key. Repeated rows give repeated rows.
    ``text_key`` is a 64-bit hash of the text, to tell rows of one key apart. Other columns of the input are not read.
    """
    prints = cut_lineage(
        documents.select(
            F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), fingerprints(F.col(text)).alias("fp")
        )
    )
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(links(distinct, average, most))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "text_key", "fp", "root", "component_id"
    )


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest key (then the smallest text
    hash); a document without a key only where its component has no other. Rows that repeat it are dropped.

    What goes is written first, as keys and text hashes, so that texts are only moved where that is large; rows that
    have to be told from their repetitions are dealt out on their own.
    """
    found = near_duplicates(documents, key, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("k"), F.col("text_key").alias("t"))
    each = found.groupBy("doc_id", "text_key", "root").agg(F.count(F.lit(1)).alias("times"))
    best = each.groupBy("root").agg(F.min(order).alias("best"))
    named = F.struct("doc_id", "text_key").alias("id")
    marked = each.join(best, "root").select(named, (order != F.col("best")).alias("lost"), "times").where("lost OR times > 1")
    marked = cut_lineage(marked)
    rows = documents.select(F.struct("*").alias("__row"))
    rows = rows.withColumn("__id", F.struct(F.col(f"__row.`{key}`").alias("doc_id"), F.xxhash64(F.col(f"__row.`{text}`")).alias("text_key")))
    kept = rows.join(marked, F.col("__id") == F.col("id"), "left_anti").select("__row.*")
    again = marked.where("NOT lost")
    if again.isEmpty():
        return kept
    first = rows.join(again, F.col("__id") == F.col("id"), "left_semi").dropDuplicates(["__id"])
    return kept.unionByName(first.select("__row.*"))

"""Near-duplicates by min-max hashing.

A document is the set of its word shingles. Under each permutation both the smallest and the largest value are kept, so
that half the hash evaluations give a signature of the full length; a minimum and a maximum of one permutation repel each
other a little, which lowers the variance of the signature, and stand in different bands. Documents of equal sets are one
class. Classes that share a band are candidates and every link is confirmed on the full sets:

* a band of few classes gives all its pairs, which are verified once however many bands name them;
* a larger one gives the pairs with its smallest class, which settles a group of close copies in one round;
* where that leaves several components in a large band, the classes outside the smallest one's component are compared with
  all others tile by tile, intersections being products of incidence matrices. A tile has a bounded number of shingles
  and returns a spanning forest of its links, never its pairs.

Two sets of similarity 0.8 share a band but for a chance of (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import pieces, starts_of
from tallyloom.llm.simhash import components
from tallyloom.session import cut_lineage

SHINGLE = 4
#: linked at 100 * intersection >= SIMILAR * union
SIMILAR = 80
#: values of a band; each permutation gives one to a band of minima and one to a band of maxima
ROWS, PERMUTATIONS = 4, 64
#: classes of a band whose pairs are all candidates
SMALL = 16
#: classes and shingles of a tile on average
TILE, TILE_SHINGLES = 1024, 1 << 20
#: shingles multiplied at once
COLUMNS = 4096

_STEP, _MIX, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 7
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes, known: dict[bytes, int], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words are one shingle, no word none."""
    words = text.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SHORT)] if words else [], np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + len(out)]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    known = _WordHash()
    return [shingle_set(t, known, width) for t in texts]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every set that is not empty under each permutation, a row for each set."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = starts_of(np.array([len(s) for s in sets], np.int64))
    low, high = (np.zeros((len(sets), PERMUTATIONS), np.uint64) for _ in range(2))
    for k, (factor, offset) in enumerate(zip(_FACTORS, _OFFSETS)) if sets else ():
        seen = values * factor + offset
        low[:, k], high[:, k] = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature: bands of minima, then bands of maxima."""
    values = np.concatenate([low, high], axis=1).reshape(len(low), 2 * PERMUTATIONS // ROWS, ROWS)
    keys = np.arange(values.shape[1], dtype=np.uint64)[None, :] * _MIX + np.uint64(1)
    for r in range(ROWS):
        keys = (keys ^ values[:, :, r]) * _STEP
        keys ^= keys >> np.uint64(32)
    return keys


def _printer(width: int):
    """(doc_id, text, text_key) -> (doc_id, text_key, n_shingles, set_id, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(1)):
                sets = shingle_sets(piece, width)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = bands(*signatures([sets[k] for k in full])).view(np.int64)
                # an empty set has no band
                lengths = np.zeros(len(sets), np.int32)
                lengths[full] = keys.shape[1]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(at, len(piece)),
                        "text_key": batch.column(2).slice(at, len(piece)),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_id": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.ListArray.from_arrays(
                            pa.array(np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))), pa.array(keys.ravel())
                        ),
                    }
                )
                at += len(piece)

    return run


def _set_reader(width: int):
    """(set_id, text) -> (set_id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(1)):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(piece, width)]
                yield pa.record_batch({"set_id": batch.column(0).slice(at, len(piece)), "shingles": pa.array(sets, pa.binary())})
                at += len(piece)

    return run


def similar(intersection, sizes, similarity: int = SIMILAR):
    """Whether sets of these sizes together and this intersection are linked, in integers."""
    return (100 + similarity) * intersection >= similarity * sizes


def _verifier(similarity: int):
    """(u, v, left, right) -> (u, v) of the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                similar(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), similarity)
                for a, b in (
                    (np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))
                    for x, y in zip(batch.column(2), batch.column(3))
                )
            ]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return run


@dataclass
class Incidence:
    """Sets as documents x shingles that at least two of the sets have."""

    sizes: np.ndarray
    owner: np.ndarray
    column: np.ndarray
    n_columns: int

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Incidence:
        sizes = np.array([len(s) for s in sets], np.int64)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        number = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        return cls(sizes, owner[shared], number[column[shared]], int((times > 1).sum()))

    def intersections(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of each left with each right set, exact in single precision."""
        total = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, self.n_columns, COLUMNS):
            inside = (self.column >= start) & (self.column < start + COLUMNS)
            dense = np.zeros((len(self.sizes), min(COLUMNS, self.n_columns - start)), np.float32)
            dense[self.owner[inside], self.column[inside] - start] = 1
            total += dense[left] @ dense[right].T
        return total


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the components of the links; ``label`` holds those known so far and follows."""
    edges = []
    for r in np.flatnonzero(linked.any(axis=1)):
        own = left[r]
        others = right[linked[r]]
        for other in others[np.unique(label[others], return_index=True)[1]]:
            if label[other] != label[own]:
                edges.append((int(own), int(other)))
                label[label == label[other]] = label[own]
    return edges


def _tile(similarity: int):
    """Links inside a tile, as a forest: set_id, comp (the component known), is_left, is_right, shingles -> (u, v)."""

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("set_id").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in group.column("shingles")]
        label = np.unique(np.array(group.column("comp").to_pylist(), "S16"), return_inverse=True)[1]
        left, right = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False).astype(bool)) for c in ("is_left", "is_right"))
        edges = []
        if len(left) and len(right):
            found = Incidence.of(sets)
            both = found.intersections(left, right)
            linked = similar(both.astype(np.int64), found.sizes[left][:, None] + found.sizes[right][None, :], similarity)
            edges = forest(linked, left, right, label)
        u, v = ([ids[e[k]] for e in edges] for k in range(2))
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return compare


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (u, v) that are linked on their full sets."""
    left = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("left")), "u")
    both = left.join(sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("right")), "v")
    return both.select("u", "v", "left", "right").mapInArrow(_verifier(similarity), "u binary, v binary")


def candidate_pairs(members: DataFrame, small: int) -> DataFrame:
    """Distinct (u, v): all pairs of small bands, pairs with the smallest class of larger ones."""
    star = members.where((F.col("n") > small) & (F.col("set_id") != F.col("least")))
    few = members.where(F.col("n") <= small).groupBy("band").agg(F.sort_array(F.collect_list("set_id")).alias("ids"))
    pairs = F.expr(
        "flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x AS u, y AS v))))"
    )
    every = few.select(F.explode(pairs).alias("p")).select("p.u", "p.v")
    return every.union(star.select(F.col("least").alias("u"), F.col("set_id").alias("v"))).distinct()


def tiles(members: DataFrame, known: DataFrame, small: int, tile: int, tile_shingles: int) -> DataFrame:
    """(set_id, comp, band, a, b, is_left, is_right): the tiles of the large bands that hold several components.

    ``inner`` classes are those known to be connected with the smallest class of the band, ``outer`` the others. Every
    tile of outer classes meets every tile of inner classes and every tile of outer ones; inner ones do not meet.
    """
    large = members.where(F.col("n") > small).join(known, F.col("set_id") == F.col("node"), "left")
    large = large.select("band", "set_id", "n_shingles", "least", F.coalesce("root", "set_id").alias("comp"))
    first = F.max(F.when(F.col("set_id") == F.col("least"), F.col("comp"))).alias("first")
    sided = large.join(large.groupBy("band").agg(first), "band").withColumn("outer", F.col("comp") != F.col("first"))

    def slots(side: Column) -> Column:
        n, size = F.count_if(side), F.sum(F.when(side, F.col("n_shingles")).otherwise(0))
        return F.greatest(F.ceil(n / tile), F.ceil(size / tile_shingles)).cast("int")

    open_bands = (
        sided.groupBy("band")
        .agg(slots(~F.col("outer")).alias("n_inner"), slots(F.col("outer")).alias("n_outer"))
        .where("n_outer > 0")
    )
    own = sided.join(open_bands, "band").withColumn("slot", F.expr("pmod(xxhash64(set_id), if(outer, n_outer, n_inner))").cast("int"))
    # a < 0 names inner tiles: -1, -2, ...
    meets = F.expr(
        """CASE WHEN NOT outer THEN transform(sequence(0, n_outer - 1),
             t -> struct(-1 - slot AS a, t AS b, true AS is_left, false AS is_right))
           ELSE concat(
             transform(sequence(0, n_inner - 1), t -> struct(-1 - t AS a, slot AS b, false AS is_left, true AS is_right)),
             transform(sequence(0, n_outer - 1), t -> struct(
               least(slot, t) AS a, greatest(slot, t) AS b, slot <= t AS is_left, slot >= t AS is_right))) END"""
    )
    return own.select("set_id", "comp", "band", F.explode(meets).alias("m")).select("set_id", "comp", "band", "m.*")


def class_links(
    classes: DataFrame, texts: DataFrame, width: int, similarity: int, small: int, tile: int, tile_shingles: int
) -> DataFrame:
    """(u, v): links between classes of different sets, so many that they connect what all links connect.

    ``classes`` are (set_id, n_shingles, bands, row) with a struct ``row`` that names one row of ``texts``.
    """
    keyed = classes.select("set_id", "n_shingles", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("least")).where("n > 1")
    members = cut_lineage(keyed.join(shared, "band"))
    named = classes.join(members.select("set_id").distinct(), "set_id").select("set_id", "row")
    wanted = texts.join(named, "row").select("set_id", "text").mapInArrow(_set_reader(width), "set_id binary, shingles binary")
    sets = cut_lineage(wanted.groupBy("set_id").agg(F.first("shingles").alias("shingles")))
    near = cut_lineage(_verified(candidate_pairs(members, small), sets, similarity))
    rest = tiles(members, components(near), small, tile, tile_shingles).join(sets, "set_id")
    columns = ["set_id", "comp", "is_left", "is_right", "shingles"]
    far = rest.select("band", "a", "b", *columns).groupBy("band", "a", "b").applyInArrow(_tile(similarity), "u binary, v binary")
    return near.union(far)


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: int = SIMILAR,
    small: int = SMALL, tile: int = TILE, tile_shingles: int = TILE_SHINGLES,
) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), one row per document row.

    Documents are linked where 100 * intersection >= ``similarity`` * union of their shingle sets; shingles are compared
    as 64-bit hashes, sets as 128-bit digests. NULL, empty and wordless texts have no shingle and are linked with nothing:
    their ``component_id`` is their own key. It is else the smallest key reachable, NULL where no document of the
    component has one. Repeated rows give repeated rows, rows of one key with other texts are documents of their
    own, told apart by ``text_key``, a 64-bit hash of the text. A task holds one very long text beside its batch. Other
    columns are not read.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    name = documents.schema[key].dataType.simpleString()
    prints = cut_lineage(
        rows.select("doc_id", "text", "text_key").mapInArrow(
            _printer(width), f"doc_id {name}, text_key bigint, n_shingles bigint, set_id binary, bands array<bigint>"
        )
    )
    row = F.struct("doc_id", "text_key").alias("row")
    own = prints.where("n_shingles > 0").select("set_id", "n_shingles", "bands", row, "doc_id").groupBy("set_id", "n_shingles")
    # the smallest key may be that of another row than the first; a key that is NULL never is
    classes = cut_lineage(own.agg(F.first("bands").alias("bands"), F.min("row").alias("row"), F.min("doc_id").alias("first")))
    named = rows.select(row, "text")
    edges = class_links(classes, named, width, similarity, small, tile, tile_shingles)
    rooted = classes.select("set_id", "first").join(components(edges), F.col("set_id") == F.col("node"), "left")
    rooted = cut_lineage(rooted.select("set_id", "first", F.coalesce("root", "set_id").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(least, "root").select("set_id", "component_id")
    linked = prints.drop("bands").join(component, "set_id", "left")
    return linked.select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )

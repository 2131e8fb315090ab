"""Vector compression by product codes, nearest entries found with a GNAT.

Vectors become integers and are cut into equal parts; each part is replaced by the number of its nearest codebook entry.
The entries of a part stand in a geometric near-neighbour access tree: a node has a few split points and, for every child
and split point, the range of distances from that point to the entries below the child. A query's distances to the split
points rule out each child whose ranges are strictly farther than the best entry so far, with bounds rounded outwards;
what remains is decided by squared distances in integers, ties to the lower index.

Codebooks are fitted in a few rounds over all vectors; a round returns one sum for each entry, added up in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.session import cut_lineage, known_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: split points of a node, and entries up to which a node has no children
SPLITS, LEAF = 8, 16
#: vectors searched at once
QUERIES = 4096
#: squared distances of larger components would not fit 64 bits
MOST = 1 << 27
#: share by which bounds on distances are widened, far above the rounding of a square root
ROUNDING = 1e-12


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every query to every point, all integers."""
    most = max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0))
    if 4 * queries.shape[1] * int(most) ** 2 < 1 << 53:
        # every term and sum is an integer that double precision holds
        q, p = queries.astype(float), points.astype(float)
        return (np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * (q @ p.T)).astype(np.int64)
    out = np.zeros((len(queries), len(points)), np.int64)
    for k in range(queries.shape[1]):
        out += (queries[:, k, None] - points[None, :, k]) ** 2
    return out


@dataclass
class Node:
    """Split points, and for each child the range of distances from every split point to the entries below it."""

    splits: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    """The entries of one codebook, searched for the nearest of many queries."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries = entries.astype(np.int64)
        self.n_splits, self.leaf = splits, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray) -> Node:
        if len(ids) <= self.leaf:
            return Node(ids)
        # split points far apart: each the farthest from those before, starting with the lowest index
        chosen = [0]
        nearest = squared(self.entries[ids], self.entries[ids[:1]])[:, 0]
        while len(chosen) < self.n_splits:
            nearest[chosen] = -1
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(self.entries[ids], self.entries[ids[chosen[-1:]]])[:, 0])
        chosen.sort()
        splits, rest = ids[chosen], np.delete(ids, chosen)
        apart = squared(self.entries[rest], self.entries[splits])
        owner = apart.argmin(axis=1)
        distance = np.sqrt(apart.astype(float))
        node = Node(splits, [], np.zeros((self.n_splits, self.n_splits)), np.zeros((self.n_splits, self.n_splits)))
        for child in range(self.n_splits):
            own = distance[owner == child]
            node.children.append(self._node(rest[owner == child]) if len(own) else None)
            if len(own):
                node.low[child], node.high[child] = own.min(axis=0) * (1 - ROUNDING), own.max(axis=0) * (1 + ROUNDING)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, the lowest of several, and its squared distance."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.zeros(len(queries), np.int64)
        for start in range(0, len(queries), QUERIES):
            part = slice(start, start + QUERIES)
            self._search(self.root, queries[part], np.arange(len(queries[part])), best[part], index[part])
        return index, best

    def _search(self, node: Node, queries: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Improves ``best`` and ``index`` of the queries ``at`` by the entries below a node."""
        apart = squared(queries[at], self.entries[node.splits])
        first = apart.argmin(axis=1)
        found, own = apart[np.arange(len(at)), first], node.splits[first]
        better = (found < best[at]) | ((found == best[at]) & (own < index[at]))
        best[at[better]], index[at[better]] = found[better], own[better]
        if not node.children:
            return
        distance = np.sqrt(apart.astype(float))
        low, high = distance * (1 - ROUNDING), distance * (1 + ROUNDING)
        for own_child in (True, False):
            for k, child in enumerate(node.children):
                if child is None:
                    continue
                # the child around a query's nearest split point comes first, so that its radius is small for the others
                mine = np.flatnonzero((first == k) == own_child)
                radius = np.sqrt(best[at[mine]].astype(float))[:, None] * (1 + ROUNDING)
                apart_for_certain = (low[mine] - radius > node.high[k]) | (node.low[k] - radius > high[mine])
                mine = mine[~apart_for_certain.any(axis=1)]
                if len(mine):
                    self._search(child, queries, at[mine], best, index)


@dataclass(frozen=True)
class Codebooks:
    """Integer entries, part by entry by position; fewer than 256 entries where there were fewer vectors."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for, at the middle of its integer cells."""
        numbers = [int(code[k : k + 2], 16) for k in range(0, len(code), 2)]
        return [(x + 0.5) / self.scale for part, n in zip(self.entries, numbers) for x in part[n].tolist()]


def kept(vectors: DataFrame, vector: str, dimension: int | None = None) -> DataFrame:
    """Rows whose vector is not NULL or empty and holds only finite numbers (and has the given length)."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    fits = F.size(vector) > 0
    if dimension is not None:
        fits = fits & (F.size(vector) == dimension)
    return vectors.where(F.col(vector).isNotNull() & fits & F.forall(vector, finite))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.floor(values * scale)
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"components beyond {MOST} after scaling: squared distances would not fit 64 bits")
    return out.astype(np.int64).reshape(len(column), len(out) // max(len(column), 1))


def _parts(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(rows, parts, axis=1)]


def _summer(trees: list[Gnat], scale: int):
    """vectors -> (part, entry, n, sums) of the task's vectors nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(tree.entries) for tree in trees]
        count = [np.zeros(len(tree.entries), np.int64) for tree in trees]
        for batch in batches:
            for p, rows in enumerate(_parts(integers(batch.column(0), scale), len(total))):
                index, _ = trees[p].nearest(rows)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    total[p][used] += np.add.reduceat(rows[order], starts, axis=0)
                count[p] += np.bincount(index, minlength=len(count[p]))
        for p, (sums, n) in enumerate(zip(total, count)):
            used = np.flatnonzero(n)
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(len(used), p, np.int32)),
                    "entry": pa.array(used.astype(np.int32)),
                    "n": pa.array(n[used]),
                    "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64())),
                }
            )

    return run


def _trees(books: Codebooks) -> list[Gnat]:
    """The trees of all parts, sent with the tasks: parts x entries vectors, whatever the number of rows."""
    return [Gnat(part) for part in books.entries]


def seeds(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    scale: int = SCALE,
) -> Codebooks:
    """The vectors of the smallest keys, ascending, as first entries.

    The smallest key's vector gives the dimension; vectors of another length are left out. Of several rows with one key the
    smaller vector comes first, a key that is NULL comes last.
    """
    rows = kept(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")), "v")
    first = rows.orderBy(F.asc_nulls_last("k"), "v").first()
    if first is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    if len(first["v"]) % parts:
        raise ValueError(f"vectors of {len(first['v'])} components cannot be cut into {parts} equal parts")
    some = kept(rows, "v", len(first["v"])).orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    numbers = integers(pa.array([r["v"] for r in some], pa.list_(pa.float64())), scale)
    return Codebooks(np.stack(_parts(numbers, parts)), scale)


def train(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks:
    """Codebooks fitted to all vectors; only the sums of each entry reach the driver."""
    books = seeds(vectors, key, vector, parts, entries, scale)
    if not books.entries.size:
        return books
    rows = kept(vectors.select(F.col(vector).alias("v")), "v", books.dimension)
    width = books.entries.shape[2]
    for _ in range(rounds):
        found = rows.mapInArrow(_summer(_trees(books), scale), "part int, entry int, n bigint, sums array<bigint>")
        sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        new = books.entries.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            new[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
        books = Codebooks(new, scale)
    return books


def coded(
    vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")
) -> DataFrame:
    """(kept columns, code, error) of every row whose vector can be coded.

    ``code`` holds two hex digits for each part, ``error`` is the squared distance from the integer vector to what its
    code stands for. Rows whose vector is NULL, empty, of another length, or holds NULL or a number that is not finite are
    left out. Repeated rows give repeated rows; other columns are not read.
    """
    rows = kept(vectors.select(*keep, F.col(vector).alias("__v")), "__v", books.dimension)
    fields = [rows.schema[c] for c in keep]
    trees, scale = _trees(books), books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _parts(integers(batch.column(len(keep)), scale), len(trees))
            found = [tree.nearest(rows) for tree, rows in zip(trees, numbers)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in codes], pa.string())
            error = pa.array(sum(distance for _, distance in found))
            own = [c.cast(to_arrow_type(f.dataType)) for c, f in zip(batch.columns, fields)]
            yield pa.record_batch([*own, code, error], [*keep, "code", "error"])

    return rows.mapInArrow(run, StructType([*fields, StructField("code", StringType()), StructField("error", LongType())]))


def with_group_error(rows: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """The rows with ``label_error``, the error summed over equal labels, NULL labels together.

    The rows are written once, as they are coded by a search; sums are added up in the tasks, and joined as a table
    whose size Spark knows.
    """
    rows = cut_lineage(rows)
    sums = known_small(rows.groupBy(F.col(label).alias("__label")).agg(F.sum(error).alias("label_error")))
    return rows.join(sums, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


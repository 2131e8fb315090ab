"""Benchmark decontamination by a distributed positional inverted index.

The training documents are indexed once: a segment holds the postings of a few megabytes of text, term by term, as
positions in the segment's stream of words, where every document is followed by one empty position so that no phrase
crosses documents. Segments are written as a table. Test items come in blocks of bounded size; for each window of an
item the posting lists are shifted by the word's place in the window and intersected from the rarest term on, and an
item is near a document where its rarest terms stand close together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import flat, pieces, starts_of
from tallyloom.session import cut_lineage

WINDOW = 10
#: words of the test items that one pass over the index holds
BLOCK_WORDS = 1_000_000
#: rarest terms of an item, of which all but one have to stand within so many words of one of them to be near
NEAR_TERMS, NEAR_SPAN = 4, 30

#: letters a-z, digits and all of non-ASCII stay, A-Z become a-z, all else separates
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


SEGMENT = "segment binary, doc_ids array<{key}>, n_words binary, terms binary, ends binary, positions binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for piece in pieces(batch.column(1)):
            words, n_words = flat([words_of(t) for t in piece])
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            stream = np.arange(len(words)) + np.repeat(np.arange(len(piece)), n_words)
            positions = stream[np.argsort(ids, kind="stable")].astype("<i4")
            ends = np.cumsum(np.bincount(ids, minlength=len(number))).astype("<i4")
            keys = batch.column(0).slice(at, len(piece))
            at += len(piece)
            yield pa.record_batch(
                {
                    "segment": pa.array([uuid.uuid4().bytes]),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    "n_words": pa.array([n_words.astype("<i4").tobytes()]),
                    "terms": pa.array([b" ".join(number)]),
                    "ends": pa.array([ends.tobytes()]),
                    "positions": pa.array([positions.tobytes()]),
                }
            )


def build_index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of the documents as a written table, one row per segment."""
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = SEGMENT.format(key=rows.schema["doc_id"].dataType.simpleString())
    return cut_lineage(rows.mapInArrow(_segments, schema))


def _numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<i4")


def _term_counts(terms: set[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ends in zip(batch.column(0), batch.column(1)):
                sizes = np.diff(_numbers(ends.as_py()), prepend=0)
                found = [(t, int(sizes[k])) for k, t in enumerate(blob.as_py().split()) if t in terms]
                yield pa.record_batch(
                    {"term": pa.array([t for t, _ in found], pa.binary()), "n": pa.array([n for _, n in found], pa.int64())}
                )

    return count


class Block:
    """Test items as windows and rarest terms over numbered terms."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids = [i for i, _ in items]
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.items = [[self.terms[w] for w in words] for _, words in items]
        #: items of each window
        self.windows: dict[tuple[int, ...], list[int]] = {}
        for k, words in enumerate(self.items):
            size = min(window, len(words))
            for s in range(len(words) - size + 1) if words else ():
                self.windows.setdefault(tuple(words[s : s + size]), []).append(k)
        self.near: list[tuple[int, ...]] = [()] * len(items)
        self.near_terms = 0

    def choose_near(self, counts: dict[bytes, int], n: int) -> None:
        """The ``n`` rarest terms of each item among those that the corpus has, rarest first."""
        names, self.near_terms = list(self.terms), n
        for k, words in enumerate(self.items):
            ranked = sorted({(counts[names[w]], names[w], w) for w in words if counts.get(names[w])})[:n]
            self.near[k] = tuple(w for _, _, w in ranked)


def phrase_starts(lists: list[np.ndarray], window: tuple[int, ...]) -> np.ndarray:
    """Stream positions where the window starts, by intersecting shifted lists from the shortest on."""
    order = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
    found = lists[window[order[0]]] - order[0]
    for k in order[1:]:
        postings, wanted = lists[window[k]], found + k
        at = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
        found = found[postings[at] == wanted]
        if not len(found):
            break
    return found


def near_places(lists: list[np.ndarray], terms: tuple[int, ...], needed: int, span: int, first, last) -> np.ndarray:
    """Positions of a term with ``needed`` of the terms, itself among them, within ``span`` words in the same document.

    ``first`` and ``last`` give the bounds of the document around a position.
    """
    places = np.concatenate([lists[t] for t in terms])
    low, high = np.maximum(places - span, first(places)), np.minimum(places + span, last(places))
    met = sum((np.searchsorted(lists[t], low) < np.searchsorted(lists[t], high, "right")).astype(int) for t in terms)
    return places[met >= needed]


RESULT = (
    "segment binary, ordinal int, doc_id {key}, n_words bigint, spans array<struct<`from`:int,`to`:int>>, "
    "items array<string>, near_items array<string>"
)


def _matcher(block: Block, span: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = [(np.array([w for w in block.windows if len(w) == n]), n) for n in {len(w) for w in block.windows}]
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _match_segment({c: batch.column(c)[row] for c in batch.schema.names}, block, wide, span)

    return match


def _match_segment(row: dict[str, pa.Scalar], block: Block, wide, span: int) -> Iterator[pa.RecordBatch]:
    value = {c: row[c].as_py() for c in ("segment", "n_words", "terms", "ends", "positions")}
    n_words = _numbers(value["n_words"]).astype(np.int64)
    ends, positions = _numbers(value["ends"]), _numbers(value["positions"]).astype(np.int64)
    empty = np.zeros(0, np.int64)
    lists = [empty] * len(block.terms)
    for k, term in enumerate(value["terms"].split()):
        if (q := block.terms.get(term)) is not None:
            lists[q] = positions[ends[k - 1] if k else 0 : ends[k]]
    here = np.array([len(p) > 0 for p in lists], bool)
    starts = starts_of(n_words + 1)
    document = lambda p: np.searchsorted(starts, p, "right") - 1
    covered, pairs, near = np.zeros(int(n_words.sum()) + len(n_words) + 1, np.int64), [], []
    for windows, size in wide:
        for window in map(tuple, windows[here[windows].all(axis=1)].tolist()):
            found = phrase_starts(lists, window)
            if len(found):
                np.add.at(covered, found, 1)
                np.add.at(covered, found + size, -1)
                docs = np.unique(document(found)).tolist()
                pairs += [(d, k) for k in block.windows[window] for d in docs]
    for k, terms in enumerate(block.near):
        # most of the terms where there are as many as were asked for, else all
        needed = len(terms) - (len(terms) == block.near_terms)
        if terms and here[list(terms)].sum() >= needed:
            found = near_places(lists, terms, needed, span, lambda p: starts[document(p)], lambda p: (starts + n_words)[document(p)])
            near += [(d, k) for d in np.unique(document(found)).tolist()]
    hit = np.cumsum(covered) > 0
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    spans: dict[int, list[dict[str, int]]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(document(a))
        spans.setdefault(d, []).append({"from": a - int(starts[d]), "to": b - int(starts[d])})

    def named(found: Iterable[tuple[int, int]]) -> list[list[str]]:
        sets: list[set[str]] = [set() for _ in n_words]
        for d, k in found:
            if block.ids[k] is not None:
                sets[d].add(block.ids[k])
        return [sorted(s) for s in sets]

    n = len(n_words)
    yield pa.record_batch(
        {
            "segment": pa.array([value["segment"]] * n, pa.binary()),
            "ordinal": pa.array(np.arange(n, dtype=np.int32)),
            "doc_id": row["doc_ids"].values,
            "n_words": pa.array(n_words),
            "spans": pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct({"from": pa.int32(), "to": pa.int32()}))),
            "items": pa.array(named(pairs), pa.list_(pa.string())),
            "near_items": pa.array(named(near), pa.list_(pa.string())),
        }
    )


def item_blocks(items: DataFrame, item: str, text: str, most_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items as (id, words) in blocks of about ``most_words`` words, read one after another."""
    rows = iter(items.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator())
    block: list[tuple[str | None, list[bytes]]] = []
    n = 0
    while some := list(islice(rows, 1)):
        words = words_of(bytes(some[0][1] or b""))
        block.append((some[0][0], words))
        n += len(words)
        if n >= most_words:
            yield block
            block, n = [], 0
    if block or n == 0:
        yield block


def matches(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    near_terms: int = NEAR_TERMS,
    near_span: int = NEAR_SPAN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, hits, n_hit, items, near_items) of every document row.

    ``hits`` are the spans of words (from, to) inside an occurrence of a window of some item, ``items`` the sorted ids of
    the items with an occurring window, ``near_items`` those of whose rarest terms that the corpus has all but one stand
    within ``near_span`` words of one of them (all, where it has fewer than ``near_terms``). An
    item of fewer words than a window is one window. A NULL text has no words; an item without an id hits but is not
    listed; repeated items count once. Repeated document rows give repeated rows; other columns are not read.
    """
    index = build_index(documents, key, text)
    schema = RESULT.format(key=documents.schema[key].dataType.simpleString())
    found = None
    for some in item_blocks(items, item, item_text, block_words):
        block = Block(some, window)
        counts = (
            index.select("terms", "ends")
            .mapInArrow(_term_counts(set(block.terms)), "term binary, n bigint")
            .groupBy("term")
            .agg(F.sum("n").alias("n"))
        )
        # a row for each term of the block at most
        block.choose_near({bytes(r["term"]): r["n"] for r in counts.collect()}, near_terms)
        part = index.mapInArrow(_matcher(block, near_span), schema)
        found = part if found is None else found.union(part)
    covered = F.expr(
        """aggregate(sort_array(hits), struct(0L AS n, 0 AS reach), (s, x) -> struct(
             s.n + greatest(x.`to` - greatest(s.reach, x.`from`), 0) AS n, greatest(s.reach, x.`to`) AS reach)).n"""
    )
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return (
        found.groupBy("segment", "ordinal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("hits"),
            listed("items").alias("items"),
            listed("near_items").alias("near_items"),
        )
        .select("doc_id", "n_words", "hits", covered.alias("n_hit"), "items", "near_items")
    )


def clean(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any occurring window, with all their columns.

    Rows are told apart by key and text, so that repeated keys with other texts are judged on their own. What is
    dropped is written first, so that its size is known when the documents are read again.
    """
    name = lambda k, t: F.struct(F.col(k).alias("k"), F.xxhash64(F.col(t)).alias("t"))
    named = documents.select(name(key, text).alias("id"), F.col(text).alias("text"))
    bad = cut_lineage(matches(named, items, "id", "text").where("n_hit > 0").select(F.col("doc_id").alias("bad")).distinct())
    rows = documents.select(F.struct("*").alias("row"))
    rows = rows.withColumn("id", name(f"row.`{key}`", f"row.`{text}`"))
    return rows.join(bad, F.col("id") == F.col("bad"), "left_anti").select("row.*")

"""Exact removal of repeated passages by super-k-mer partitioning.

A window is 50 consecutive words. Consecutive windows of a document that share their minimiser (the smallest hash among
their runs of five words) travel as one packed string to the minimiser's bucket; equal windows share their minimiser, so
they meet in one bucket, where sorting them tells the smallest document of each. A task sends every distinct string
once, with the smallest and largest document it saw, so that copies do not fill a bucket. The answers (which windows of
a string are shared, and by whom first) go back to the strings' places by a join on a 128-bit digest of the string,
which spreads over tasks however many places a string has.

A passage in very many documents with other words around it would still fill the bucket of its minimiser with
strings that differ at their ends. Minimisers are therefore counted first, and the windows of the most frequent ones
are counted one by one, by an aggregate on the window's digest that every task combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm.common import flat, pieces, starts_of
from tallyloom.session import cut_lineage

WINDOW = 50
MER = 5
#: bytes of distinct strings that a task gathers before it sends them, and what one takes beside its letters
GATHERED, OVERHEAD = 24 << 20, 350
#: buckets for each shuffle partition
BUCKETS = 4
#: strings of one minimiser from which on its windows are counted one by one, and the number of such minimisers at most
#: (those beyond go through their buckets, as all others do)
HOT, MOST_HOT = 5_000, 100_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@dataclass
class SuperKmers:
    """Runs of windows of one piece: document, first window, number of windows, minimiser and packed string."""

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    minimiser: np.ndarray
    text: list[bytes]


def super_kmers(texts: list[bytes], window: int = WINDOW, mer: int = MER) -> SuperKmers:
    words, n_words = flat([t.split() for t in texts])
    n_windows = np.maximum(n_words - window + 1, 0)
    total = int(n_windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return SuperKmers(none, none, none, none.view(np.uint64), [])
    hashes = np.fromiter(map(_WordHash().__getitem__, words), np.uint64, len(words))
    mers = np.zeros(len(words) - mer + 1, np.uint64)
    for k in range(mer):
        mers = mers * _STEP + hashes[k : k + len(mers)]
    mers = (mers ^ (mers >> np.uint64(31))) * _MIX
    mers ^= mers >> np.uint64(29)
    smallest = sliding_min(mers, window - mer + 1)
    starts = starts_of(n_words)
    doc = np.repeat(np.arange(len(texts)), n_windows)
    at = np.arange(total) + np.repeat(starts - starts_of(n_windows), n_windows)
    key = smallest[at]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(heads, total))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    joined = b" ".join(words)
    begin, end = (ends - lengths)[at[heads]], ends[at[heads] + count + window - 2]
    strings = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    return SuperKmers(doc[heads], at[heads] - starts[doc[heads]], count, key[heads], strings)


def windows_of(text: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    begin, end = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(text)]
    return [text[a:b] for a, b in zip(begin, end[window - 1 :])]


def _counter(window: int):
    """text -> (minimiser, number of super-k-mers), combined batch by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                keys, n = np.unique(super_kmers(piece, window).minimiser, return_counts=True)
                yield pa.record_batch({"minimiser": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return count


def hot_minimisers(texts: DataFrame, window: int, hot: int, most: int) -> frozenset[int]:
    """The most frequent minimisers, ``most`` at most."""
    counted = texts.mapInArrow(_counter(window), "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > hot).orderBy(F.desc("n"), "minimiser").limit(most).collect()
    return frozenset(r["minimiser"] & 0xFFFFFFFFFFFFFFFF for r in rows)


def _hot_windows(window: int, hot: frozenset[int]):
    """(doc_id, text) -> (digest, lo, hi) of every window of a hot minimiser, combined batch by batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for piece in pieces(batch.column(1)):
                found = super_kmers(piece, window)
                owners = ids[at + found.doc].tolist()
                at += len(piece)
                held: dict[bytes, list[int]] = {}
                for text, owner, minimiser in zip(found.text, owners, found.minimiser.tolist()):
                    for w in windows_of(text, window) if minimiser in hot else ():
                        entry = held.setdefault(xxhash.xxh3_128_digest(w), [owner, owner])
                        entry[:] = min(entry[0], owner), max(entry[1], owner)
                lo, hi = zip(*held.values()) if held else ((), ())
                yield pa.record_batch(
                    {"digest": pa.array(list(held), pa.binary()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())}
                )

    return send


def _pack(entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """Minimiser, smallest and largest document and string of each entry, compressed."""
    head = np.array([(m, lo, hi) for m, lo, hi, _ in entries], "<u8,<i8,<i8").tobytes()
    raw = len(entries).to_bytes(4, "little") + head + b"\n".join(e[3] for e in entries)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, "<u8,<i8,<i8", n, 4)
    for numbers, text in zip(head.tolist(), raw[4 + 24 * n :].split(b"\n")):
        yield *numbers, text


def _sender(buckets: int, window: int, hot: frozenset[int]):
    """(doc_id, text) -> (bucket, packed strings) of the minimisers that are not hot."""

    def packed(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        ranked = sorted(held.values(), key=lambda e: e[0] % buckets)
        names, blobs = [], []
        for bucket, entries in groupby(ranked, key=lambda e: e[0] % buckets):
            names.append(bucket)
            blobs.append(_pack(list(entries)))
        for k in range(0, len(names), 256):
            yield pa.record_batch(
                {"bucket": pa.array(names[k : k + 256], pa.int32()), "packed": pa.array(blobs[k : k + 256], pa.binary())}
            )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for piece in pieces(batch.column(1)):
                found = super_kmers(piece, window)
                owners = ids[at + found.doc].tolist()
                at += len(piece)
                for text, owner, minimiser in zip(found.text, owners, found.minimiser.tolist()):
                    if minimiser in hot:
                        continue
                    digest = xxhash.xxh3_128_digest(text)
                    entry = held.get(digest)
                    if entry is None:
                        held[digest] = [minimiser, owner, owner, text]
                        size += len(text) + OVERHEAD
                    elif owner < entry[1]:
                        entry[1] = owner
                    elif owner > entry[2]:
                        entry[2] = owner
                if size > GATHERED:
                    yield from packed(held)
                    held, size = {}, 0
        yield from packed(held)

    return send


def shared_windows(strings: dict[bytes, list[int]], window: int = WINDOW) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, from, to, smallest document) of the runs of windows that more than one document has.

    ``strings`` maps the packed strings of one minimiser to the smallest and largest document that has them.
    """
    if len(strings) == 1:
        ((text, (lo, hi)),) = strings.items()
        if lo != hi:
            yield text, 0, text.count(b" ") + 2 - window, lo
        return
    places = []
    for text, (lo, hi) in strings.items():
        places += [(w, k, lo, hi, text) for k, w in enumerate(windows_of(text, window))]
    places.sort(key=lambda p: p[0])
    shared: dict[bytes, list[tuple[int, int]]] = {}
    for _, group in groupby(places, key=lambda p: p[0]):
        same = list(group)
        lo = min(p[2] for p in same)
        if lo != max(p[3] for p in same):
            for _, k, _, _, text in same:
                shared.setdefault(text, []).append((k, lo))
    for text, found in shared.items():
        found.sort()
        first, lo = found[0]
        for (k, was), (after, now) in zip(found, [*found[1:], (-1, 0)]):
            if after != k + 1 or now != was:
                yield text, first, k + 1, lo
                first, lo = after, now


def _bucket(window: int):
    def answer(group: pa.Table) -> pa.Table:
        by_minimiser: dict[int, dict[bytes, list[int]]] = {}
        for blob in group.column("packed"):
            for minimiser, lo, hi, text in _unpack(blob.as_py()):
                seen = by_minimiser.setdefault(minimiser, {})
                if (entry := seen.get(text)) is None:
                    seen[text] = [lo, hi]
                else:
                    entry[:] = min(entry[0], lo), max(entry[1], hi)
        rows = [
            (xxhash.xxh3_128_digest(text), a, b, lo)
            for strings in by_minimiser.values()
            for text, a, b, lo in shared_windows(strings, window)
        ]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = pa.binary(), pa.int32(), pa.int32(), pa.int64()
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("digest", "from", "to", "lo"), columns, types)})

    return answer


def _placer(window: int, hot: frozenset[int]):
    """(doc_id, text, text_key) -> the places of its packed strings; the windows of hot minimisers one by one."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at = batch.column(0), batch.column(2), 0
            for piece in pieces(batch.column(1)):
                found = super_kmers(piece, window)
                digests, owners, firsts = [], [], []
                for text, d, first, minimiser in zip(found.text, found.doc.tolist(), found.first.tolist(), found.minimiser.tolist()):
                    parts = windows_of(text, window) if minimiser in hot else (text,)
                    for k, part in enumerate(parts):
                        digests.append(xxhash.xxh3_128_digest(part))
                        owners.append(at + d)
                        firsts.append(first + k)
                owner = pa.array(owners, pa.int64())
                at += len(piece)
                yield pa.record_batch(
                    {
                        "digest": pa.array(digests, pa.binary()),
                        "doc_id": ids.take(owner),
                        "text_key": keys.take(owner),
                        "first": pa.array(firsts, pa.int32()),
                    }
                )

    return place


def repeated_spans(
    documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, most_hot: int = MOST_HOT
) -> DataFrame:
    """(doc_id, text_key, spans): the word spans (from, to) covered by windows that start in a smaller document too.

    ``key`` is an integer column. A document without a key is neither compared nor cut; rows of one key are one
    document with several texts, told apart by ``text_key``, the 64-bit hash of the text. Documents without a
    repeated window have no row.
    """
    rows = documents.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key")
    ).where("doc_id IS NOT NULL")
    texts = rows.select("doc_id", "text")
    many = hot_minimisers(rows.select("text"), window, hot, most_hot)
    buckets = BUCKETS * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = (
        texts.mapInArrow(_sender(buckets, window, many), "bucket int, packed binary")
        .groupBy("bucket")
        .applyInArrow(_bucket(window), "digest binary, `from` int, `to` int, lo bigint")
    )
    if many:
        single = (
            texts.mapInArrow(_hot_windows(window, many), "digest binary, lo bigint, hi bigint")
            .groupBy("digest")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .where("lo < hi")
        )
        answers = answers.unionByName(single.select("digest", F.lit(0).alias("from"), F.lit(1).alias("to"), "lo"))
    answers = cut_lineage(answers)
    places = rows.mapInArrow(_placer(window, many), "digest binary, doc_id bigint, text_key bigint, first int")
    cut = F.struct((F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + window - 1).alias("to"))
    # a row that is repeated has each of its places many times
    return (
        places.join(answers, "digest")
        .where("lo < doc_id")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(cut).alias("spans"))
    )


KEPT = StructType(
    [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
)


def kept_words(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    """Words, removed words and the rest joined by one space."""
    words = text.split()
    if len(begin):
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, begin, 1)
        np.add.at(covered, end, -1)
        stay = np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()
        kept = [words[k] for k in stay]
    else:
        kept = words
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")


@F.arrow_udf(KEPT)
def cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Struct of n_words, n_removed and the kept words of a text without the given word spans."""
    offsets = spans.offsets.to_numpy()
    begin, end = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    parts, at = [pa.array([], kind)], 0
    for piece in pieces(texts):
        bounds = zip(offsets[at:], offsets[at + 1 :])
        columns = zip(*(kept_words(t, begin[a:b], end[a:b]) for t, (a, b) in zip(piece, bounds)))
        at += len(piece)
        parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))
    return pa.concat_arrays(parts)


def without_repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, most_hot: int = MOST_HOT
) -> DataFrame:
    """(row, cut) of every document row: all its columns as a struct, and n_words, n_removed and the kept words.

    A text that is NULL, empty or without a word has no words and nothing is removed; ``kept`` is then empty. Windows are
    equal where their 128-bit digests or bytes are. Repeated rows give repeated rows, cut alike.
    """
    spans = repeated_spans(documents, key, text, window, hot, most_hot)
    rows = documents.select(F.struct("*").alias("row")).withColumns(
        {"doc_id": F.col(f"row.`{key}`").cast("bigint"), "text_key": F.xxhash64(F.col(f"row.`{text}`"))}
    )
    none = F.array().cast("array<struct<`from`:int,`to`:int>>")
    return rows.join(spans, ["doc_id", "text_key"], "left").select(
        # declared nondeterministic, which it is not, so that filters on its figures do not cut the text again
        "row", cut_text.asNondeterministic()(F.col(f"row.`{text}`"), F.coalesce("spans", none)).alias("cut")
    )

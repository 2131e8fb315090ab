"""Quality rules: rules within a document, and lines that are frequent across the documents of a host.

Normalised lines are hashed; a line is frequent in a host where more distinct documents than a limit have it, however
large the host. Frequent lines are removed, and a document of which too little is left is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import flat, numbered, pieces, starts_of, sums_of

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: a line is frequent in a host from more than so many documents (and, if asked for, a share of the host's documents)
LEAST_DOCUMENTS, SHARE = 20, 0.0
#: a document is depleted when less than this share of its words, or fewer than LEAST_WORDS, remain
LEFT = 0.5

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes of UTF-8
_DIGITS = re.compile(rb"[0-9]+")


def normalised(line: bytes) -> bytes:
    """Words in ASCII lower case, runs of digits as one 0, joined by one space."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each document inside a window of words that the document has twice or more.

    Windows are numbered exactly by doubling: pairs of numbers of half windows get a number each (the size is a power
    of two).
    """
    items, n = flat(words)
    out = np.zeros(len(n), np.int64)
    if len(items) < window:
        return out
    ids, size = numbered(items), 1
    while size < window:
        pairs = ids[:-size] * (ids.max() + 1) + ids[size:]
        ids, size = np.unique(pairs, return_inverse=True)[1], 2 * size
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[: len(ids)] == owner[window - 1 :]
    place = np.flatnonzero(inside)
    _, which, times = np.unique(ids[place] * len(n) + owner[place], return_inverse=True, return_counts=True)
    covered = np.zeros(len(items) + 1, np.int64)
    twice = place[times[which] > 1]
    covered[twice] += 1
    np.add.at(covered, twice + window, -1)
    return sums_of((np.cumsum(covered[:-1]) > 0).astype(np.int64), n)


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base figures of each text."""
    words = [t.split() for t in texts]
    duplicates = []
    for t in texts:
        lines = [line for line in t.split(b"\n") if line.translate(None, _SPACE)]
        duplicates.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": np.array([len(t.translate(None, _NOT_COUNTED)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(duplicates, np.int64),
        "n_repeat_words": repeated_words(words),
    }


def lines_of(text: bytes) -> tuple[list[int], list[int]]:
    """64-bit hash of each normalised line with a word, and its words."""
    hashes, words = [], []
    for line in text.split(b"\n"):
        if line := normalised(line):
            hashes.append(xxhash.xxh64_intdigest(line) - (1 << 63))
            words.append(line.count(b" ") + 1)
    return hashes, words


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = "array<struct<hash:bigint,words:int>>"


def _lines_array(texts: list[bytes], distinct: bool) -> pa.Array:
    found = [lines_of(t) for t in texts]
    if distinct:
        found = [(list(own), [0] * len(own)) for own in ({h: 0 for h in hashes} for hashes, _ in found)]
    hashes, n = flat([h for h, _ in found])
    words, _ = flat([w for _, w in found])
    offsets = pa.array(np.append(starts_of(n), len(hashes)), pa.int32())
    values = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int32())], ["hash", "words"])
    return pa.ListArray.from_arrays(offsets, values)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for piece in pieces(batch.column(3)):
            own = [batch.column(k).slice(at, len(piece)) for k in range(3)]
            at += len(piece)
            figures = counts(piece)
            columns = [*own, *(pa.array(figures[f]) for f in FIGURES), _lines_array(piece, distinct=False)]
            yield pa.record_batch(columns, ["doc_id", "host", "text_key", *FIGURES, "lines"])


def _host_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for piece in pieces(batch.column(1)):
            hosts = batch.column(0).slice(at, len(piece))
            at += len(piece)
            yield pa.record_batch([hosts, _lines_array(piece, distinct=True)], ["host", "lines"])


def frequent_lines(
    documents: DataFrame, host: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, share: float = SHARE
) -> DataFrame:
    """(host, hash, n_docs) of the lines that are frequent in a host; every row is a document, a NULL host is a host."""
    rows = documents.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("binary").alias("text"))
    found = (
        rows.mapInArrow(_host_lines, f"host string, lines {LINES}")
        .select("host", F.explode("lines.hash").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > least)
    )
    if not share:
        return found
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return found.join(sizes, "host").where(F.col("n_docs") > share * F.col("host_docs")).select("host", "hash", "n_docs")


def judged(
    documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
    least: int = LEAST_DOCUMENTS, share: float = SHARE, left: float = LEFT,
) -> DataFrame:
    """(doc_id, the base figures, base_failed, n_frequent_words, kept) of every document row.

    A text that is NULL or has no word has zero figures and fails. Equal rows are judged alike and all returned;
    NULL keys are allowed; other columns are not read.
    """
    rows = documents.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_key"),
        F.col(text).cast("binary").alias("text"),
    )
    key_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, host string, text_key string, {', '.join(f'{f} bigint' for f in FIGURES)}, lines {LINES}"
    figures = rows.mapInArrow(_figures, schema)
    # a row for each line; a document without a line keeps one row
    lines = figures.select(
        *figures.columns[:-1], F.posexplode_outer("lines").alias("place", "line")
    ).select(*figures.columns[:-1], F.coalesce("place", F.lit(0)).alias("place"), "line.hash", "line.words")
    frequent = frequent_lines(documents, host, text, least, share)
    marked = lines.join(frequent, ["host", "hash"], "left")
    whole = marked.groupBy("doc_id", "host", "text_key").agg(
        *[F.first(f).alias(f) for f in FIGURES],
        F.sum(F.when(F.col("n_docs").isNotNull(), F.col("words")).otherwise(0)).alias("removed"),
        F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).alias("copies"),
    )
    removed = F.expr("removed div copies")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    remaining = F.col("n_words") - F.col("n_frequent_words")
    depleted = (remaining < LEAST_WORDS) | (remaining < left * F.col("n_words"))
    return (
        whole.select("doc_id", *FIGURES, removed.alias("n_frequent_words"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        .select("doc_id", *FIGURES, "n_frequent_words", failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )

"""Fill-in-middle transformation by secondary sort.

A text is cut into units (a word with the white space before it, or the white space at the end) and, by hashes of its key,
into a prefix, a middle and a suffix. What travels are pieces, runs of whole units of bounded size, keyed by document and
place in the output. Dealt out by document and sorted by place inside each partition, they stream into running digests, so
that no task holds a text; the restored text is read off the output and its form, sorted again by place in the text and
streamed once more.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tallyloom.llm.common import pieces

SEED = 42
#: of 100 documents so many are transformed, and of these so many in the order suffix, prefix, middle
TRANSFORMED, SUFFIX_FIRST = 50, 80
#: fixed values: the marks of the three parts
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: bytes of a piece, from which on the next one begins at the next unit (or inside a longer unit)
CHUNK = 16 << 10
#: bytes of pieces in one record batch
BATCH = 2 << 20
#: part and place of the row with a document's key and figures, before all its pieces
HEAD = -1
#: part of the text behind each mark
_PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def unit_ends(text: bytes) -> np.ndarray:
    """Offsets behind each unit: the ends of the words, and the end of a text that ends in white space."""
    codes = np.frombuffer(text, np.uint8)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(codes)) if len(codes) and space[-1] else ends


def draws(key: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers drawn from the key in decimal; a key that is NULL draws as the empty string."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def form_of(text: bytes, drawn: tuple[int, int, int, int], transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> str:
    if not text or any(m in text for m in MARKS) or drawn[2] % 100 >= transformed:
        return PLAIN
    return SPM if drawn[3] % 100 < suffix_first else PSM


def part_offsets(ends: np.ndarray, drawn: tuple[int, int, int, int]) -> tuple[int, int]:
    """Offsets behind the prefix and behind the middle."""
    first, second = sorted(h % (len(ends) + 1) for h in drawn[:2])
    return (int(ends[first - 1]) if first else 0), (int(ends[second - 1]) if second else 0)


def arranged(form: str, text: bytes, after_prefix: int, after_middle: int) -> list[tuple[bytes, int, int]]:
    """The output as marks with the part (from, to) of the text behind each; a plain one has no mark."""
    prefix, middle, suffix = (0, after_prefix), (after_prefix, after_middle), (after_middle, len(text))
    if form == PLAIN:
        return [(b"", 0, len(text))]
    if form == PSM:
        return [(PREFIX, *prefix), (SUFFIX, *suffix), (MIDDLE, *middle)]
    return [(SUFFIX, *suffix), (PREFIX, *prefix), (MIDDLE, *middle)]


def chunks(ends: np.ndarray, begin: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole units between two offsets, of ``size`` bytes or less; a unit that is longer is cut."""
    while begin < end:
        stop = min(begin + size, end)
        if stop < end:
            k = int(np.searchsorted(ends, stop, "right")) - 1
            stop = int(ends[k]) if k >= 0 and ends[k] > begin else stop
        yield begin, stop
        begin = stop


def characters(text: bytes) -> int:
    """Code points of UTF-8."""
    codes = np.frombuffer(text, np.uint8)
    return len(codes) - int(np.count_nonzero((codes & 0xC0) == 0x80))


_FIGURES = "copies bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_NO_FIGURES = (None,) * 5


def _rows_of(document: bytes, key, text: bytes, copies: int, size: int, options: dict) -> Iterator[tuple]:
    """The rows of one document: its key and figures, then marks and pieces in the order of the output."""
    drawn, ends = draws(key, options["seed"]), unit_ends(text)
    form = form_of(text, drawn, options["transformed"], options["suffix_first"])
    a, b = part_offsets(ends, drawn)
    lengths = (None, None) if form == PLAIN else (characters(text[:a]), characters(text[a:b]))
    yield document, HEAD, b"", copies, len(ends), form, *lengths, key
    place = 0
    for mark, begin, end in arranged(form, text, a, b):
        own = [mark] if mark else []
        own += [text[start:stop] for start, stop in chunks(ends, begin, end, size)]
        for piece in own:
            yield document, place, piece, *_NO_FIGURES, None
            place += 1


def _batched(rows: Iterable[tuple], schema: pa.Schema, column: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size; ``column`` holds the bytes."""

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[column]) + 64
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def output_pieces(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK,
    seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """(document, place, piece, copies, n, form, prefix_chars, middle_chars, doc_id): the output in pieces.

    ``document`` is a 128-bit digest of key and text, so that rows of one key with other texts stay apart. Equal rows
    of a record batch are one document with that many ``copies``. The row of place -1 has the key and the figures; in
    all others they are NULL. The pieces of a document joined in order of place are its output. NULL is the empty text,
    whose form is plain and which has no piece; a NULL key draws as the empty string. Other columns are not read.
    """
    options = {"seed": seed, "transformed": transformed, "suffix_first": suffix_first}
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    columns = _schema("document binary, place bigint, piece binary, " + _FIGURES, rows.schema["doc_id"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((row for batch in batches for row in _batch_rows(batch, size, options)), to_arrow_schema(columns), 2)

    return rows.mapInArrow(emit, columns)


def _batch_rows(batch: pa.RecordBatch, size: int, options: dict) -> Iterator[tuple]:
    """The rows of all documents of a batch, equal ones once."""
    keys = batch.column(0).to_pylist()
    names = [
        xxhash.xxh3_128_digest(repr(k).encode() + b"\n" + t)
        for k, t in zip(keys, (t for piece in pieces(batch.column(1)) for t in piece))
    ]
    copies, at = Counter(names), 0
    for piece in pieces(batch.column(1)):
        for t in piece:
            if n := copies.pop(names[at], 0):
                yield from _rows_of(names[at], keys[at], t, n, size, options)
            at += 1


def _schema(columns: str, *fields: StructField) -> StructType:
    return StructType([*StructType.fromDDL(columns), *fields])


def in_output_order(found: DataFrame) -> DataFrame:
    """The pieces dealt out by document and sorted by place inside each partition (a secondary sort that spills)."""
    return found.repartition("document").sortWithinPartitions("document", "place")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches; a piece that several tasks sent, for copies of a document, comes once."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] == HEAD or row[:2] != last:
                yield row
            last = row[:2]


def _restored_rows(found: Iterator[tuple]) -> Iterator[tuple]:
    """Digests each output piece by piece, and sends its pieces on under their part of the text, read off the marks."""
    for document, rows in groupby(found, key=lambda r: r[0]):
        digest, part, form, copies, figures, key = hashlib.sha256(), 0, PLAIN, 0, (), None
        for _, place, piece, n_copies, n, own_form, prefix_chars, middle_chars, own_key in rows:
            if place == HEAD:
                copies += n_copies
                form, key, figures = own_form, own_key, (n, own_form, prefix_chars, middle_chars)
                continue
            digest.update(piece)
            if form != PLAIN and piece in _PART:
                part = _PART[piece]
            else:
                yield document, part, place, piece, None, *_NO_FIGURES, None
        yield document, HEAD, HEAD, b"", digest.hexdigest(), copies, *figures, key


def _finished_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, own in groupby(rows, key=lambda r: r[0]):
        digest = hashlib.sha256()
        *_, output, copies, n, form, prefix_chars, middle_chars, key = next(own)
        for row in own:
            digest.update(row[3])
        for _ in range(copies):
            yield n, form, prefix_chars, middle_chars, output, digest.hexdigest(), key


def assembled(found: DataFrame) -> DataFrame:
    """(n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, doc_id), one row for each document row.

    Both digests are of streams: of the output's pieces in order, and of the text that is put together again from the
    output and its form alone, its pieces sorted by part and place. Takes ``output_pieces``.
    """
    key = found.schema["doc_id"]
    sent = _schema("document binary, part int, place bigint, piece binary, output_sha256 string, " + _FIGURES, key)
    result = _schema(
        "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", key
    )

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_restored_rows(_streamed(batches)), to_arrow_schema(sent), 3)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_finished_rows(batches), to_arrow_schema(result), 5)

    restored = in_output_order(found).mapInArrow(restore, sent)
    return restored.sortWithinPartitions("document", "part", "place").mapInArrow(finish, result)


def outputs(found: DataFrame) -> DataFrame:
    """(form, output, doc_id): the transformed texts as BINARY, one row for each document row. Takes ``output_pieces``.

    A row holds a whole text here, so a text must fit a task; ``assembled`` has no such bound.
    """
    result = _schema("form string, output binary", found.schema["doc_id"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in groupby(_streamed(batches), key=lambda r: r[0]):
            rows = list(own)
            heads = [r for r in rows if r[1] == HEAD]
            output = b"".join(r[2] for r in rows[len(heads) :])
            for _ in range(sum(r[3] for r in heads)):
                yield heads[0][5], output, heads[0][8]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(joined(batches), to_arrow_schema(result), 1)

    return in_output_order(found).mapInArrow(join, result)

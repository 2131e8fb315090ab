"""What the operators share: texts as bytes, numbers for words, held-out folds, bounded labelled samples."""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: bytes of text handled at once inside a task, and of a record batch that a task gets
PIECE, BATCH = 2 << 20, 4 << 20
#: bytes of text after which a worker gives freed memory back to the system
TRIMMED = 8 << 20
#: characters of all texts together that a model is fitted on, on the driver
MOST_TOTAL_CHARS = 12_000_000


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8 bytes, NULL as empty, in lists of about ``most`` bytes.

    What a task holds beside the Arrow batch is bounded by one piece, or one text that is longer.
    """
    if not len(column):
        return
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield [t or b"" for t in column.slice(start, end - start).to_pylist()]
        start = end
    release_memory(int(ends[-1]))


#: bytes of text a worker has handled since it gave memory back
_handled = 0


def release_memory(n_bytes: int) -> None:
    """Gives freed memory of Arrow back to the system, and every ``TRIMMED`` bytes of text that of the C library, where
    it can be asked to.

    Python workers live as long as the application; what their batches have freed would else stay with each of them.
    """
    global _handled
    pa.default_memory_pool().release_unused()
    _handled += n_bytes
    if _handled >= TRIMMED and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        _handled = 0
        trim(0)


def flat(lists: Sequence[Sequence]) -> tuple[list, np.ndarray]:
    """All items in one list and the number of items of each list."""
    return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """A number for every word, equal exactly where words are equal."""
    table = defaultdict(count().__next__)
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``, runs given by their lengths (zero allowed)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def bounded_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From here on the record batches that the session's Python tasks get are bounded in bytes, not in rows alone.

    Texts are long: ten thousand of them, Spark's usual batch, are tens of megabytes that a task holds several times, as
    rows, as Arrow memory of the executor and of the worker. A smaller bound that is set already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, handed to Python tasks in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; NULL for a NULL key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def held_out(key, folds: int, rest: int) -> Column:
    """True for keys kept away from training; a NULL key is never held out (and never trained on)."""
    return F.coalesce(fold(key, folds) == rest, F.lit(False))


def labelled_sample(
    labels: DataFrame, label: str, key: str, folds: int, rest: int, most: int
) -> DataFrame:
    """(key, label) of at most ``most`` labelled rows outside the held-out fold, the same ones at every partitioning.

    A key with several labels takes the largest. Rows without a key or a label are not used.
    """
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds, rest))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )


def fitting_texts(documents: DataFrame, key: str, text: str, most_chars: int, *others: Column) -> DataFrame:
    """(k, others, t, n_chars, digest) of the rows to fit on: with key and text, of at most ``most_chars`` characters."""
    return (
        documents.select(F.col(key).alias("k"), *others, F.col(text).alias("t"))
        .where("k IS NOT NULL AND t IS NOT NULL")
        .withColumns({"n_chars": F.length("t"), "digest": F.xxhash64("t")})
        .where(F.col("n_chars") <= most_chars)
    )


def one_row_each(texts: DataFrame) -> DataFrame:
    """(k, place, digest, label, n_chars) of one row of each key, that of the smallest digest; place is the key's hash."""
    own = texts.groupBy("k").agg(F.min(F.struct("digest", "label", "n_chars")).alias("own"))
    return own.select("k", F.xxhash64("k").alias("place"), "own.*")


def within(rows: list[Row], most_total: int) -> list[Row]:
    """The first rows by place, as many as have ``most_total`` characters together at most."""
    rows = sorted(rows, key=lambda r: (r["place"], r["k"]))
    ends = np.cumsum([r["n_chars"] for r in rows])
    return rows[: int(np.searchsorted(ends, most_total, "right"))]


def collected(texts: DataFrame, chosen: DataFrame) -> list[Row]:
    """(k, label, t) of the chosen (k, digest, label), copies once, on the driver."""
    chosen = F.broadcast(chosen.select("k", "digest", "label"))
    return texts.drop("label").join(chosen, ["k", "digest"]).groupBy("k", "label").agg(F.min("t").alias("t")).collect()


def training_texts(
    documents: DataFrame, sample: DataFrame, key: str, text: str, most_chars: int, most_total: int = MOST_TOTAL_CHARS
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a labelled sample, in key order, on the driver.

    The sample is bounded: rows by the sample and by one text for each key, characters of a row by ``most_chars`` and
    of all by ``most_total``. Longer rows and the keys beyond are not used for fitting.
    """
    sample = F.broadcast(sample.select(F.col(key).alias("k"), "label"))
    texts = fitting_texts(documents, key, text, most_chars).join(sample, "k")
    first = one_row_each(texts)
    chosen = documents.sparkSession.createDataFrame(within(first.collect(), most_total), first.schema)
    rows = collected(texts, chosen)
    rows.sort(key=lambda r: r["k"])
    return [r["t"] for r in rows], np.array([r["label"] for r in rows], np.int64)

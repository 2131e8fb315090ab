"""A corpus cleaned and tokenised in stages; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, simhash, substring, toxicity
from tallyloom.llm.common import bounded_batches, read
from tallyloom.session import remove, scratch_path, scratch_scope

VOCABULARY = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic by a model fitted to the labels.

    A text that is NULL or without a word is not toxic; repeated rows are judged alike; a NULL key is never trained on.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component.

    A text that is NULL, empty or without a word is one component with all others of this kind; rows that repeat the
    kept one go. The text may be of any length.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has; those of which nothing is left go.

    A text without such a passage stays as it is, else its words are joined by one space and ``n_chars`` follows. A
    document without a key or without a word stays; repeated rows stay, cut alike.
    """
    bounded_batches(spark)
    cut = substring.without_repeats(docs).where("cut.n_removed = 0 OR cut.n_removed < cut.n_words")
    changed = F.col("cut.n_removed") > 0
    new = {"text": F.col("cut.kept"), "n_chars": F.length("cut.kept")}

    def column(name: str):
        old = F.col(f"row.`{name}`")
        kind = docs.schema[name].dataType
        return (F.when(changed, new[name].cast(kind)).otherwise(old) if name in new else old).alias(name)

    return cut.select(*map(column, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Those without a word, and repeated rows of clean ones, stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers), and digests of the ids and of their text.

    NULL encodes like the empty text, as no token; repeated rows give repeated rows.
    """
    bounded_batches(spark)
    codec = bpe.load(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encoded(docs, codec, decode=True).select(
        "doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]

#: the stages fit a model, hash with XXH64 and encode by a vocabulary, which SQL does not express; tests hold run()
#: against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages; what a stage wrote on the way goes when its result is written, and a stage's
    result when the next one's is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}", keep=True)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

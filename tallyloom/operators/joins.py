"""Joins between record, score and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import sampling
from tallyloom.operators import ordering as O

# fixed values: names an id may have, in order of preference, and the overlap that makes one usable
ID_KEYS = ("id", "sample_id", "idx", "index", "question_id", "task_id", "uuid")
MIN_OVERLAP = 4


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Rows meeting by ordinal; the shorter side decides the length."""
    return left.join(right, [*keys, ordinal])


def checked_zip_join(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """As zip_join, but sides of different length are an error when the result is read."""
    joined = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), ordinal, "full_outer")
    same = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    value = F.when(same, F.col(ordinal)).otherwise(F.raise_error(F.lit("the two sides differ in length")).cast("bigint"))
    return joined.withColumn(ordinal, value).drop("__l", "__r")


def pair_records(raw: DataFrame, rewritten: DataFrame, fields: str = "fields", ordinal: str = "ordinal") -> DataFrame:
    """(raw, rewritten, mode, key): ordinals paired by the first usable id key, else by equal ordinal.

    A key is usable when at least four of its values occur on both sides; of rows sharing a value the
    last one counts.
    """
    names = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(n).alias("name")) for k, n in enumerate(ID_KEYS)])

    def by_key(rows, name):
        ids = rows.select(ordinal, fields, F.explode(names).alias("k")).select(
            "k.rank", F.col("k.name").alias("key"), F.try_element_at(F.col(fields), F.col("k.name")).alias("value"), ordinal
        )
        return ids.where("value is not null").groupBy("rank", "key", "value").agg(F.max(ordinal).alias(name))

    matched = by_key(raw, "raw").join(by_key(rewritten, "rewritten"), ["rank", "key", "value"])
    usable = matched.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_OVERLAP)
    chosen = usable.agg(F.min("rank").alias("rank"))
    keyed = matched.join(chosen, "rank").select("raw", "rewritten", F.lit("id_mapping").alias("mode"), "key")
    none_usable = chosen.where("rank is null").select(F.lit(1).alias("__k"))
    same = raw.select(F.col(ordinal).alias("raw"), F.lit(1).alias("__k")).join(
        rewritten.select(F.col(ordinal).alias("raw")), "raw", "left_semi"
    )
    same = same.join(none_usable, "__k").select(
        "raw", F.col("raw").alias("rewritten"), F.lit("same_index").alias("mode"), F.lit(None).cast("string").alias("key")
    )
    return keyed.unionByName(same)


def performance_pairs(
    features: DataFrame, performance: DataFrame, dataset: str, epoch: str, label_epochs: Sequence[str], metric: str
) -> tuple[DataFrame, DataFrame]:
    """Feature rows with both methods' performance at every label epoch, and the rows without it.

    The rejects are (dataset, feature epoch, label epoch, reason).
    """
    labels = F.explode(F.array(*[F.lit(e) for e in label_epochs])).alias("label_epoch")
    wanted = features.select(dataset, epoch).distinct().select(dataset, epoch, labels)
    table = performance.groupBy(dataset, F.col(epoch).alias("label_epoch")).agg(
        *[F.max(F.when(F.col("method") == m, F.col(metric))).alias(f"perf_{m}") for m in ("sft", "sdft")],
        *[F.max(F.when(F.col("method") == m, F.lit(1))).alias(f"__has_{m}") for m in ("sft", "sdft")],
    )
    table = table.where("__has_sft = 1 and __has_sdft = 1").drop("__has_sft", "__has_sdft")
    found = wanted.join(table, [dataset, "label_epoch"])
    rejects = wanted.join(table, [dataset, "label_epoch"], "left_anti").withColumn(
        "reason", F.lit("missing performance row for sft/sdft")
    )
    rows = features.join(found, [dataset, epoch]).withColumn("perf_diff", F.col("perf_sdft") - F.col("perf_sft"))
    return rows, rejects


def summary_table(
    base: DataFrame, decomposition: DataFrame, scores: DataFrame, performance: DataFrame,
    h_modes: Sequence[str], keys: Sequence[str] = ("dataset", "epoch", "method"),
) -> DataFrame:
    """One row per (dataset, epoch, method, h_mode) with everything known about it.

    Decomposition rows stand for all h_modes and create rows the base does not have; scores and
    performance only add columns.
    """
    modes = F.explode(F.array(*[F.lit(m) for m in h_modes])).alias("h_mode")
    fanned = decomposition.select("*", modes)
    out = base.join(fanned, [*keys, "h_mode"], "full_outer")
    out = out.join(scores, ["dataset", "epoch", "h_mode"], "left")
    return out.join(performance, list(keys), "left")


def method_deltas(rows: DataFrame, keys: Sequence[str], method: str, columns: Sequence[str], a: str = "sft", b: str = "sdft") -> DataFrame:
    """(keys, delta_<column>): a - b for every numeric column, for keys both methods have."""

    def value(name, m):
        return F.max(F.when(F.col(method) == m, F.col(name)))

    both = rows.groupBy(*keys).agg(
        F.count_if(F.col(method) == a).alias("__a"),
        F.count_if(F.col(method) == b).alias("__b"),
        *[(value(c, a) - value(c, b)).alias(f"delta_{c}") for c in columns],
    )
    return both.where("__a > 0 and __b > 0").drop("__a", "__b")


def outer_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """left - right per key: a missing side counts 0, both missing stays NULL."""
    joined = left.select(*keys, F.col(value).alias("__a")).join(right.select(*keys, F.col(value).alias("__b")), list(keys), "full_outer")
    diff = F.when(
        F.col("__a").isNotNull() | F.col("__b").isNotNull(), F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))
    )
    return joined.select(*keys, diff.alias(name))


def not_yet_done(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(done.select(*keys), list(keys), "left_anti")


def sampled_in_order(rows: DataFrame, ids: Sequence[str], count: int, seed: str) -> DataFrame:
    """``count`` rows (or all, if fewer) without replacement, in id order again."""
    return rows.orderBy(sampling.hash_int(*ids, seed=seed), *ids).limit(count).orderBy(*ids)


def shard(rows: DataFrame, order: Sequence[str], shards: int, index: int) -> DataFrame:
    """Every ``shards``-th row of the sorted work list, starting at ``index``."""
    return O.positions(rows, [], order, "__pos").where(F.col("__pos") % shards == index).drop("__pos")


def sort_for_output(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partitioned total order; only for writing."""
    return rows.orderBy(*order)


def mixed_records(a: DataFrame, b: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Both record sets together, and per group a status: ``ok``, or which side has no records."""
    rows = a.withColumn("__side", F.lit("a")).unionByName(b.withColumn("__side", F.lit("b")), allowMissingColumns=True)
    has_a, has_b = F.count_if(F.col("__side") == "a") > 0, F.count_if(F.col("__side") == "b") > 0
    status = rows.groupBy(group).agg(
        F.when(has_a & has_b, "ok").when(has_a, "missing second").otherwise("missing first").alias("status")
    )
    return rows.drop("__side"), status


def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marker: str, name: str) -> DataFrame:
    """Adds the latest non-NULL ``marker`` before the row, per key in ``order``; see :func:`ordering.last_before`."""
    return O.last_before(rows, keys, order, marker, name)

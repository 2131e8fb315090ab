"""Order statistics that never put one group into one task.

A plain window over a group sorts the whole group in a single task. Here rows are range
partitioned on (group, order), every slice is numbered on its own and shifted by the number of rows
in the slices before it. The slice table is one row per (group, slice), so it stays small whatever
the size of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import finite
from tallyloom.session import cut_lineage

SLICE = "__slice"
ALL = "__all"
PLACE = "__place"
#: bits of monotonically_increasing_id below the number of the partition
PLACE_BITS = 33


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str | None],
    totals: Mapping[str, str | None] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Adds exclusive running sums and group totals; a ``None`` column counts rows.

    ``sums`` and ``totals`` map output name to summed column. ``order`` has to identify a row inside
    its group, otherwise ties are numbered arbitrarily.
    """
    totals = dict(totals or {})
    keys = list(groups)
    if not keys:
        df, keys = df.withColumn(ALL, F.lit(0)), [ALL]
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]

    def step(column):
        return F.lit(1).cast("bigint") if column is None else F.col(column)

    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *direction).withColumn(SLICE, F.spark_partition_id())
    # both readers below need the same slices, and slice bounds come from a sample: fix them once
    ranged = cut_lineage(ranged)
    per_slice = ranged.groupBy(*keys, SLICE).agg(
        *[F.sum(step(c)).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.sum(step(c)).alias(f"__t_{n}") for n, c in totals.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(everything).alias(n) for n in totals],
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(step(c)).over(inside), F.lit(0)).alias(f"__l_{n}") for n, c in sums.items()]
    )
    kept = [c for c in df.columns if c != ALL]
    return local.join(offsets, [*keys, SLICE]).select(
        *kept, *[(F.col(f"__s_{n}") + F.col(f"__l_{n}")).alias(n) for n in sums], *totals
    )


def last_before(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the latest non-NULL ``value`` of an earlier row of the group, NULL where there is none.

    A slice starts with the last value of the slices before it, one row per (group, slice), so rows between two
    values may be any number. ``order`` has to identify a row inside its group.
    """
    keys = list(groups)
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(SLICE, F.spark_partition_id())
    ranged = cut_lineage(ranged)  # both readers below need the same slices
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy(*keys, SLICE).agg(F.max_by(value, place).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, SLICE, F.last("__end", ignorenulls=True).over(earlier).alias("__start"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__last", F.last(value, ignorenulls=True).over(inside))
    return local.join(starts, [*keys, SLICE]).select(*df.columns, F.coalesce("__last", "__start").alias(name))


def running_total(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    weight: str | None = None,
    before: str = "before",
    total: str | None = "total",
    descending: bool = False,
) -> DataFrame:
    """Exclusive running sum of one column (row count if None) and its group total."""
    return running_totals(
        df, groups, order, {before: weight}, {total: weight} if total else None, descending=descending
    )


def positions(df, groups, order, name: str = "pos", total: str | None = None, descending: bool = False) -> DataFrame:
    """0-based BIGINT position of each row in its group; without groups and total, ``order`` may hold columns."""
    if not groups and total is None:
        return row_numbers(df, order, name, descending)
    return running_total(df, groups, order, before=name, total=total, descending=descending)


def row_numbers(df: DataFrame, order: Sequence[str | Column], name: str, descending: bool = False) -> DataFrame:
    """Adds the 0-based position of each row in the whole table; what the order computes is not carried along.

    A slice is numbered as it is sorted, before it is written, so that the rows cross the network once. What is left
    to add is the number of rows in the slices before, one number a slice.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    direction = [k.desc() if descending else k.asc() for k in keys]
    ranged = df.repartitionByRange(*direction).sortWithinPartitions(*direction)
    placed = cut_lineage(ranged.withColumn(PLACE, F.monotonically_increasing_id()), codec="zstd")
    slice_of, inside = F.shiftright(PLACE, PLACE_BITS), F.col(PLACE).bitwiseAND((1 << PLACE_BITS) - 1)
    per_slice = placed.groupBy(slice_of.alias(SLICE)).agg(F.count(F.lit(1)).alias("__n")).withColumn(ALL, F.lit(0))
    earlier = Window.partitionBy(ALL).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    # one row a slice: without the hint the rows would be shuffled to meet them
    met = placed.withColumn(SLICE, slice_of).join(F.broadcast(offsets), SLICE)
    return met.select(*df.columns, (F.col("__before") + inside).alias(name))


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, cnt) over the finite values; combined before the shuffle."""
    return df.where(finite(value)).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt"))


def ranked_values(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct finite values with ``cnt``, ``before`` (rows with a smaller value) and ``total``."""
    return running_total(value_counts(df, groups, value), groups, [value], weight="cnt")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """1-based rank with ties sharing their mean rank, joined back to the rows."""
    table = ranked_values(df, groups, value).select(
        *groups, value, (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)).cast("double").alias(name)
    )
    return df.join(table, [*groups, value])


def order_statistic(value: str, position: Column) -> Column:
    """Aggregate: the value standing at 0-based ``position`` of a ranked_values table."""
    inside = (F.col("before") <= position) & (position < F.col("before") + F.col("cnt"))
    return F.max(F.when(inside, F.col(value)))


def quantile_aggregates(value: str, qs: Mapping[str, float]) -> list[Column]:
    """Aggregates of a ranked_values table that :func:`interpolated` makes quantiles of."""
    aggregates = []
    for name, q in qs.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        aggregates += [
            order_statistic(value, F.floor(at)).alias(f"{name}__lo"),
            order_statistic(value, F.ceil(at)).alias(f"{name}__hi"),
            F.max(at - F.floor(at)).alias(f"{name}__frac"),
        ]
    return aggregates


def interpolated(name: str) -> Column:
    low = F.col(f"{name}__lo")
    return low + (F.col(f"{name}__hi") - low) * F.col(f"{name}__frac")


def quantiles_of_ranked(ranked: DataFrame, groups: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    wide = ranked.groupBy(*groups).agg(*quantile_aggregates(value, qs))
    return wide.select(*groups, *[interpolated(n).alias(n) for n in qs])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, from ranked distinct values.

    The built-in ``percentile`` keeps all distinct values of a group in one task's memory.
    """
    return quantiles_of_ranked(ranked_values(df, groups, value), groups, value, qs)


def trimmed_means(ranked: DataFrame, groups: Sequence[str], value: str, alpha: float, name: str) -> DataFrame:
    """Mean without the k smallest and k largest rows, k = max(0, min(n//2 - 1, floor(alpha n)))."""
    k = F.greatest(
        F.lit(0), F.least(F.floor(F.col("total") / 2) - 1, F.floor(F.col("total") * F.lit(alpha)))
    ).cast("bigint")
    kept = F.greatest(
        F.lit(0),
        F.least(F.col("before") + F.col("cnt"), F.col("total") - k) - F.greatest(F.col("before"), k),
    )
    return ranked.groupBy(*groups).agg((F.sum(F.col(value) * kept) / F.sum(kept)).alias(name))


def near_equal_block(position, total, blocks) -> Column:
    """Block of a position when ``total`` rows are cut in ``blocks`` parts, the larger parts first."""
    size = F.floor(total / blocks)
    larger = total - size * blocks
    head = larger * (size + 1)
    return F.when(position < head, F.floor(position / (size + 1))).otherwise(
        larger + F.floor((position - head) / F.greatest(size, F.lit(1)))
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` as an aggregate (combined before the shuffle), not a window."""
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row")).select(*keys, "__row.*")

"""Running totals, ranks and exact percentiles that do not need a whole group in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ostiary import scale


def _partitions(df: DataFrame, rows: int) -> int:
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, 2, math.ceil(df.count() / rows))


def running_totals(
    df: DataFrame, by: list[str], order: list, totals: dict[str, Column], limit: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums within ``by`` in the given (unique) order.

    Groups up to ``limit`` rows use one window. Larger groups are range partitioned on the order, so a
    group spreads over many chunks; each chunk sums alone and adds the total of the chunks before it. ``large``
    passes on a size check that the caller already made.
    """
    limit = limit or scale.TASK_GROUP_ROWS
    if large is None:
        large = scale.has_large_group(df, by, limit)
    if not large:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(value).over(window).alias(name) for name, value in totals.items()])
    ranged = scale.checkpoint(
        df.repartitionByRange(_partitions(df, limit), *by, *order).withColumn("_chunk", F.spark_partition_id())
    )
    keys = [*by, "_chunk"]
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    ).select(*keys, *[
        F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in totals
    ])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunked = ranged.select("*", *[F.sum(value).over(inside).alias(f"_in_{name}") for name, value in totals.items()])
    return chunked.join(offsets, keys).select(*df.columns, *[
        (F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in totals
    ])


def rank_within(df: DataFrame, by: list[str], order: list, name: str, limit: int | None = None, large: bool | None = None) -> DataFrame:
    """Row number (bigint, from 1) within ``by``; the order must be unique for a deterministic result."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")}, limit, large)


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, wanted: dict[str, float], limit: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group; NULL values are ignored.

    Large groups are reduced to distinct values with counts, and the values at the wanted positions are
    picked from running counts, so no buffer ever holds a whole group. ``large`` passes on a size check that
    the caller already made.
    """
    limit = limit or scale.TASK_GROUP_ROWS
    present = df.filter(F.col(value).isNotNull())
    if large is None:
        large = scale.has_large_group(present, by, limit)
    if not large:
        return present.groupBy(*by).agg(*[F.percentile(value, p).alias(name) for name, p in wanted.items()])
    counts = present.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, by, [F.col(value)], {"_upto": F.col("_n")}, limit)
    sizes = present.groupBy(*by).agg(F.count("*").alias("_size"))
    joined = ranked.join(sizes, by) if by else ranked.join(F.broadcast(sizes))  # one row when `by` is empty

    def at(position: Column) -> Column:
        inside = (position >= F.col("_upto") - F.col("_n")) & (position < F.col("_upto"))
        return F.max(F.when(inside, F.col(value)))

    columns = []
    for name, p in wanted.items():
        position = F.lit(p) * (F.col("_size") - 1)
        low, high = F.floor(position), F.ceil(position)
        columns += [at(low).alias(f"_{name}_low"), at(high).alias(f"_{name}_high"),
                    F.max(position - low).alias(f"_{name}_part")]
    picked = joined.groupBy(*by).agg(*columns)
    return picked.select(*by, *[
        (F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part")).alias(name)
        for name in wanted
    ])


def join_all(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """Join one-row-per-key tables; with an empty ``by`` every table has exactly one row."""
    if by:
        return reduce(lambda left, right: left.join(right, by, "left"), frames)
    return reduce(lambda left, right: left.join(F.broadcast(right)), frames)

"""Limits and helpers that keep one hot case from landing in one task.

Every operator that needs a whole group in one place checks the group's size first and has another
way for the groups above the limit, so a case holding a third of all rows changes the route taken,
never the result.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one group that a single task may sort or aggregate (a few tens of MB).
TASK_GROUP_ROWS = 200_000
# Rows of one group folded as an array inside one row.
FOLD_ROWS = 256
# A key is hot if it is one of the HOT_KEYS with most rows and has over HOT_ROWS: no other key can hold more than
# 1 / HOT_KEYS of a table's rows. Rows of hot keys spread over SALTS tasks.
HOT_ROWS = 20_000
HOT_KEYS = 64
SALTS = 32


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage; survives executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can read.")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name``, evaluated once a row.

    Spark copies a plain computed column into every filter and join above it, and what that column is made of with it, until
    one condition holds the whole calculation hundreds of times. A generated column stays where it is.
    """
    return df.drop(name).select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))


def hot_keys(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """The hot keys of ``by``, at most HOT_KEYS rows, or None. Counts combine map-side and only the largest are kept."""
    counted = rows.groupBy(*by).count().filter(F.col("count") > HOT_ROWS)
    found = counted.orderBy(F.desc("count")).limit(HOT_KEYS).select(*by).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(*by).schema) if found else None


def per_group(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the values that ``table`` holds once per group, without bringing a hot group together.

    Without hot groups this is a plain join, which adaptive execution broadcasts if the table is small. Rows of hot
    groups alone are salted, and the table's rows for them copied SALTS times, so that a hot group spreads over as many
    tasks and a later aggregate by group is shuffled anew, after combining map-side, instead of resting on the join's
    partitioning.
    """
    hot = hot_keys(rows, by)
    if hot is None:
        return rows.join(table, by, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # HOT_KEYS rows at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(hot, by, "left").withColumn("_salt", salt).drop("_hot")
    copies = table.join(hot, by, "left").withColumn("_salt", F.explode(F.when(
        F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*by, "_salt"], how).drop("_salt")


def has_large_group(df: DataFrame, by: list[str], limit: int) -> bool:
    """True when one group of ``by`` (or the whole table for an empty ``by``) holds over ``limit`` rows."""
    if not by:
        return df.count() > limit
    return not df.groupBy(*by).count().filter(F.col("count") > limit).isEmpty()


def split_by_size(df: DataFrame, by: list[str], limit: int, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit`` rows, and the rest (None when there are none).

    The counts combine map-side, so the check itself never gathers a group. ``sized``, a table with at least as many rows of
    each group, is counted in place of ``df`` where that spares working out ``df`` a second time.
    """
    large = (df if sized is None else sized).groupBy(*by).count().filter(F.col("count") > limit).select(*by)
    if large.isEmpty():
        return df, None
    large = checkpoint(large)
    return df.join(large, by, "left_anti"), df.join(large, by, "left_semi")


def small_cases(left: DataFrame, right: DataFrame, by: list[str], limit: int, sized: DataFrame | None = None) -> tuple[tuple, tuple]:
    """((left, right) of groups up to ``limit`` rows in both tables, (left, right) of the others); (None, None) for no groups.

    Tables whose groups all are on one side of the limit are returned as they are. ``sized``, a table with at least as many rows
    of each group as either, is counted in place of both.
    """
    if not by:
        return (None, None), (left, right)
    if right is left:
        sized = left
    counted = [side.groupBy(*by).count() for side in ((left, right) if sized is None else (sized,))]
    largest = reduce(DataFrame.unionByName, counted).groupBy(*by).agg(F.max("count").alias("_n"))
    bounds = largest.agg(F.min("_n"), F.max("_n")).first()
    if bounds[1] is None or bounds[1] <= limit:
        return (left, right), (None, None)
    if bounds[0] > limit:
        return (None, None), (left, right)
    large = checkpoint(largest.filter(F.col("_n") > limit).select(*by))
    return tuple(tuple(side.join(large, by, how) for side in (left, right)) for how in ("left_anti", "left_semi"))

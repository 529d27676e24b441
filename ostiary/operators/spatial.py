"""Joins on physical distance, written as equi-joins on grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ostiary import scale
from ostiary.functions import geometry as g

CELL = ["_c0", "_c1", "_c2"]
# Rows of a case, on each side of a join, up to which all its pairs are looked at: fewer than its copies in cells would cost.
CASE_ROWS = 64


def _copy_to_cells(rows: DataFrame, point: str, radius: float, size: float) -> DataFrame:
    """Copy each row to every grid cell a ball around its point reaches: one or two per axis for
    size >= 2 * radius."""
    for cell, axis in zip(CELL, g.xyz(point)):
        reached = F.sequence(F.floor((axis - radius) / size), F.floor((axis + radius) / size))
        rows = rows.withColumn(cell, F.explode(reached))
    return rows


def pairs_within(
    left: DataFrame, right: DataFrame, by: list[str], left_point: str, right_point: str, radius: float,
    inclusive: bool = True, name: str = "distance",
) -> DataFrame:
    """All pairs of ``left`` and ``right`` rows of the same ``by`` at most (or below) ``radius`` apart.

    Cases with up to CASE_ROWS rows on either side meet by ``by`` alone, so no row is copied, and rows that already lie by
    case are not shuffled. For the others the grid cell is three radii wide: each right row is copied to the 1 to 8
    cells its ball touches (4.6 on average) and each left row stays in its own cell, so every pair meets exactly once. The
    join keys are (by, cell), so a case spreads over its cells, and adaptive execution splits a cell that is still hot.
    Apart from ``by`` the two sides must not share column names.
    """
    gap = g.distance(g.xyz(left_point), g.xyz(right_point))
    near = gap <= radius if inclusive else gap < radius
    (few_left, few_right), (left, right) = scale.small_cases(left, right, by, CASE_ROWS)
    found = [] if few_left is None else [few_left.join(few_right, by)]
    if left is not None:
        size = 3.0 * radius
        own = [F.floor(axis / size).alias(cell) for axis, cell in zip(g.xyz(left_point), CELL)]
        copies = _copy_to_cells(right, right_point, radius, size)
        found.append(left.select("*", *own).join(copies, [*by, *CELL]).drop(*CELL))
    return reduce(DataFrame.unionByName, [pairs.filter(near).withColumn(name, gap) for pairs in found])


def pairs_by_reach(rows: DataFrame, by: list[str], key: str, point: str, reach: Column, base: float) -> DataFrame:
    """``by, row_later, row_earlier, distance``: pairs of rows of one table nearer than the larger ``reach`` of the two, each once.

    Both are rows as structs, the one with the larger ``key`` first. ``reach`` is at least
    ``base``. A row lives on the grid level of its own reach, whose cells double in size from level to level, and looks
    up its cell on that level and on every coarser one in use; so a few rows of wide reach add pairs of their own only.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(reach / F.lit(base)))).cast("int")
    whole = scale.checkpoint(rows.withColumn("_level", level).withColumn("_reach", reach))
    used = sorted(r["_level"] for r in whole.select("_level").distinct().collect()) or [0]  # binary exponents: about 2,000 at most
    radius = F.lit(base * (1 + 1e-9)) * F.pow(F.lit(2.0), F.col("_level"))
    row = F.struct(*[c for c in rows.columns if c not in by], "_level", "_reach")
    copies = whole.select(*by, "_level", row.alias("_wide"), F.col(point).alias("_at"), radius.alias("_radius"))
    for cell, axis in zip(CELL, g.xyz("_at")):
        ball = F.col("_radius")
        copies = copies.withColumn(cell, F.explode(F.sequence(F.floor((axis - ball) / (3 * ball)), F.floor((axis + ball) / (3 * ball)))))
    looked = whole.select(*by, row.alias("_row"), F.col(point).alias("_here"), F.explode(F.filter(
        F.array(*[F.lit(v) for v in used]), lambda v: v >= F.col("_level"))).alias("_level"))
    looked = looked.select("*", *[F.floor(axis / (3 * radius)).alias(cell) for axis, cell in zip(g.xyz("_here"), CELL)])
    mine, other = F.col("_row"), F.col("_wide")
    gap = g.distance(g.xyz(mine[point]), g.xyz(other[point]))
    once = (mine["_level"] < other["_level"]) | (mine[key] > other[key])
    near = looked.join(copies.drop("_at", "_radius"), [*by, "_level", *CELL]).filter((mine[key] != other[key]) & once & (gap < F.greatest(mine["_reach"], other["_reach"])))
    first = mine[key] > other[key]
    return near.select(*by, F.when(first, mine).otherwise(other).alias("row_later"), F.when(first, other).otherwise(mine).alias("row_earlier"), gap.alias("distance"))


def keep_within(
    left: DataFrame, right: DataFrame, by: list[str], left_point: str, right_point: str, radius: float,
    inclusive: bool = True, found: bool = True,
) -> DataFrame:
    """Left rows with (``found``) or without any right row in reach.

    The distance test sits inside the semi or anti join, which stops at the first hit and emits no pairs. Cases with up to
    CASE_ROWS rows on either side meet by ``by`` alone, the others by grid cells, as in :func:`pairs_within`.
    """
    (few_left, few_right), (left, right) = scale.small_cases(left, right, by, CASE_ROWS)
    gap = g.distance(g.xyz(left_point), g.xyz("_there"))
    near = (gap <= radius) if inclusive else (gap < radius)

    def kept(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
        renamed = others.select("_there", *[F.col(name).alias(f"_r_{name}") for name in keys])
        condition = reduce(lambda p, q: p & q, [F.col(name) == F.col(f"_r_{name}") for name in keys], near)
        return rows.join(renamed, condition, "left_semi" if found else "left_anti")

    done = []
    if few_left is not None:
        done.append(kept(few_left, few_right.select(*by, F.col(right_point).alias("_there")), by))
    if left is not None:
        size = 3.0 * radius
        own = [F.floor(axis / size).alias(cell) for axis, cell in zip(g.xyz(left_point), CELL)]
        copies = _copy_to_cells(right.select(*by, F.col(right_point).alias("_there")).distinct(), "_there", radius, size)
        done.append(kept(left.select("*", *own), copies, [*by, *CELL]).drop(*CELL))
    return reduce(DataFrame.unionByName, done)


def nearest_within(
    points: DataFrame, members: DataFrame, by: list[str], key: list[str], point: str, member: str, radius: float,
) -> DataFrame:
    """Distance from each point to its nearest set member, NULL beyond ``radius``.

    Members at the same position are merged first; the minimum combines before the shuffle.
    """
    unique = members.select(*by, F.col(member).alias("_member")).distinct()
    found = pairs_within(points.select(*by, *key, point), unique, by, point, "_member", radius)
    nearest = found.groupBy(*by, *key).agg(F.min("distance").alias("nearest_mm"))
    return points.join(nearest, [*by, *key], "left")

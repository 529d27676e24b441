"""Ordered suppression: in rank order a row survives unless an earlier survivor lies within reach."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.operators.ordering import rank_within

# Rows of one case finished by one task once the rounds have thinned it out.
TAIL_ROWS = 20_000


def suppress(
    df: DataFrame, by: list[str], rank: str, point: str, radius: float, alive: Column | None = None,
    fold_rows: int | None = None, tail_rows: int | None = None, sized: DataFrame | None = None,
) -> DataFrame:
    """Add ``decision``, ``suppressor_rank``, ``suppressor_no`` and ``output_no`` to every row.

    ``rank`` is a unique bigint order inside ``by``. Rows whose ``alive`` is false are ``below_threshold``
    and neither survive nor suppress. The rest are ``retained`` or ``merged`` (an earlier retained row is
    closer than ``radius``; the suppressor is the earliest such row).

    Small cases are folded in one pass as an array per case. Larger ones go through rounds on a grid, see
    :func:`_kept_by_rounds`; both give the sequential result. ``sized`` may be counted in place of ``df``, see
    :func:`scale.split_by_size`.
    """
    fold_rows = scale.FOLD_ROWS if fold_rows is None else fold_rows
    marked = df.withColumn("_alive", F.coalesce(alive, F.lit(False)) if alive is not None else F.lit(True))
    small, large = scale.split_by_size(marked, by, fold_rows, sized)
    done = _fold(small, by, rank, point, radius)
    if large is not None:
        done = done.unionByName(_large(large, by, rank, point, radius, tail_rows or TAIL_ROWS))
    return done


def _fold(df: DataFrame, by: list[str], rank: str, point: str, radius: float) -> DataFrame:
    payload = [name for name in df.columns if name not in by]
    grouped = df.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("_rank"), *payload))).alias("rows")
    )
    kept_type = f"array<struct<rank:bigint,p:{g.POINT}>>"
    start = F.struct(
        F.array().cast(kept_type).alias("kept"),
        F.array().cast("array<struct<by_rank:bigint,by_no:int,no:int>>").alias("out"),
    )

    def step(state: Column, row: Column) -> Column:
        position = F.array_position(
            F.transform(state["kept"], lambda k: g.distance(g.xyz(k["p"]), g.xyz(row[point])) < radius), True
        ).cast("int")
        hit = F.when(row["_alive"], position)
        fresh = F.coalesce(hit == 0, F.lit(False))
        entry = F.struct(row["_rank"].alias("rank"), row[point].alias("p"))
        outcome = F.struct(
            F.when(hit > 0, F.get(state["kept"], hit - 1)["rank"]).alias("by_rank"),
            F.when(hit > 0, hit).alias("by_no"),
            F.when(fresh, F.size(state["kept"]) + 1).alias("no"),
        )
        return F.struct(
            F.when(fresh, F.concat(state["kept"], F.array(entry))).otherwise(state["kept"]).alias("kept"),
            F.concat(state["out"], F.array(outcome)).alias("out"),
        )

    folded = grouped.select(*by, F.explode(F.zip_with(
        F.col("rows"), F.aggregate("rows", start, step)["out"],
        lambda row, out: F.struct(row.alias("row"), out.alias("out")),
    )).alias("pair"))
    row, out = F.col("pair.row"), F.col("pair.out")
    return folded.select(
        *by, *[row[name].alias(name) for name in payload if name != "_alive"],
        _decision(row["_alive"], out["no"]).alias("decision"),
        out["by_rank"].alias("suppressor_rank"), out["by_no"].cast("bigint").alias("suppressor_no"),
        out["no"].cast("bigint").alias("output_no"),
    )


def _decision(alive: Column, output_no: Column) -> Column:
    return (
        F.when(~alive, "below_threshold").when(output_no.isNotNull(), "retained").otherwise("merged")
    )


def _cells(point: Column, size: float) -> list[Column]:
    return [F.floor(axis / size).alias(f"_c{i}") for i, axis in enumerate(g.xyz(point))]


def _spread(df: DataFrame, reach: int, keep: list[str]) -> DataFrame:
    """Copy each row to all cells up to ``reach`` away per axis; the offsets are one constant array."""
    steps = range(-reach, reach + 1)
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{axis}") for axis, v in enumerate((i, j, k))])
                        for i in steps for j in steps for k in steps])
    copied = df.select(*keep, *CELL, F.explode(offsets).alias("_o"))
    return copied.select(*keep, *[(F.col(cell) + F.col(f"_o.o{axis}")).alias(cell) for axis, cell in enumerate(CELL)])


CELL = ["_c0", "_c1", "_c2"]


def _kept_by_rounds(alive: DataFrame, by: list[str], radius: float, tail_rows: int) -> DataFrame:
    """Survivors of large cases as ``by, _rank, _p``.

    Cells are smaller than radius/sqrt(3), so a cell holds at most one survivor and all rows of a cell with
    a survivor are settled. Each round keeps every cell's first open row that precedes the first open rows
    of all cells within reach: no open or kept row can suppress it. Then all rows it reaches are dropped.
    A round compares cell minima and survivors only (at most 125 per row), never pairs of rows. Once every
    case is thin enough, the remaining rows, which no survivor reaches, finish in one grouped pass.
    """
    size, reach = radius / 1.75, 2
    open_rows = scale.checkpoint(alive.select(*by, "_rank", "_p", *_cells(F.col("_p"), size)))
    kept: DataFrame | None = None
    while scale.has_large_group(open_rows, by, tail_rows):
        firsts = open_rows.groupBy(*by, *CELL).agg(F.min(F.struct("_rank", "_p")).alias("_first"))
        firsts = firsts.select(*by, *CELL, "_first.*")
        nearby = _spread(firsts.select(*by, *CELL, F.col("_rank").alias("_other")), reach, [*by, "_other"])
        lowest = nearby.groupBy(*by, *CELL).agg(F.min("_other").alias("_lowest"))
        fresh = scale.checkpoint(
            firsts.join(lowest, [*by, *CELL]).filter(F.col("_rank") == F.col("_lowest")).select(*by, *CELL, "_rank", "_p")
        )
        reachable = _spread(fresh.select(*by, *CELL, F.col("_p").alias("_k")), reach, [*by, "_k"])
        settled = reachable.groupBy(*by, *CELL).agg(F.collect_list("_k").alias("_near"))  # at most 125 per cell
        open_rows = scale.checkpoint(
            open_rows.join(settled, [*by, *CELL], "left").filter(
                ~F.coalesce(F.exists("_near", lambda k: g.distance(g.xyz(k), g.xyz("_p")) < radius), F.lit(False))
            ).select(*open_rows.columns)
        )
        kept = fresh if kept is None else kept.unionByName(fresh)
    tail = open_rows.select(*by, "_rank", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.col("_p.z").alias("z"))
    finished = tail.groupBy(*by).applyInPandas(_greedy(radius), tail.schema).select(
        *by, "_rank", g.point(*g.cols("x", "y", "z")).alias("_p"),
    )
    return finished if kept is None else kept.select(*by, "_rank", "_p").unionByName(finished)


def _greedy(radius: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank").reset_index(drop=True)
        points = rows[["x", "y", "z"]].to_numpy()
        open_mask = np.ones(len(points), dtype=bool)
        chosen = []
        for i in range(len(points)):
            if open_mask[i]:
                chosen.append(i)
                open_mask[i:] &= np.sqrt(((points[i:] - points[i]) ** 2).sum(axis=1)) >= radius
        return rows.iloc[chosen]

    return run


def _large(df: DataFrame, by: list[str], rank: str, point: str, radius: float, tail_rows: int) -> DataFrame:
    alive = df.filter("_alive").select(*by, F.col(rank).alias("_rank"), F.col(point).alias("_p"))
    kept = scale.checkpoint(
        rank_within(_kept_by_rounds(alive, by, radius, tail_rows), by, [F.col("_rank")], "output_no")
    )
    size = radius / 1.75
    near = _spread(
        kept.select(*by, *_cells(F.col("_p"), size), F.struct("_rank", "output_no", "_p").alias("_k")), 2, [*by, "_k"],
    ).groupBy(*by, *CELL).agg(F.sort_array(F.collect_list("_k")).alias("_near"))  # at most 125 per cell
    located = df.select("*", *_cells(F.col(point), size)).join(near, [*by, *CELL], "left")
    # Kept rows sort by rank, so the first one in reach is the row itself (retained) or its suppressor.
    first = F.get(F.filter("_near", lambda k: g.distance(g.xyz(k["_p"]), g.xyz(point)) < radius), F.lit(0))
    found = located.withColumn("_hit", F.when(F.col("_alive"), first))
    itself = F.col("_hit._rank") == F.col(rank)
    output = F.when(itself, F.col("_hit.output_no"))
    return found.select(
        *[name for name in df.columns if name != "_alive"],
        _decision(F.col("_alive"), output).alias("decision"),
        F.when(~itself, F.col("_hit._rank")).alias("suppressor_rank"),
        F.when(~itself, F.col("_hit.output_no")).alias("suppressor_no"),
        output.alias("output_no"),
    )

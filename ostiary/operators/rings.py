"""Wall radius per centre-line ring, with gaps filled and a robust range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ostiary import scale
from ostiary.operators.ordering import exact_percentiles
from ostiary.operators.polyline import CHUNK, nearest_on_polyline


def fill_gaps(series: DataFrame, by: list[str], value: str = "value", large: bool = True) -> DataFrame:
    """NULL becomes the mean of the nearest filled values on both sides, else the one that exists, else 0.

    Windows run over chunks of ``seq``; what a chunk lacks comes from the nearest filled chunk before or after. Where the caller
    knows that no group is ``large``, one window goes over each group and the series is read once.
    """
    others = [c for c in series.columns if c != value]
    if not large:
        whole = Window.partitionBy(*by).orderBy("seq")
        left = F.last(value, True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
        right = F.first(value, True).over(whole.rowsBetween(0, Window.unboundedFollowing))
        return series.select(*others, value, left.alias("_l"), right.alias("_r")).select(*others, _filled(
            F.col(value), F.col("_l"), F.col("_r")).alias(value))
    keys = [*by, "_chunk"]
    rows = series.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    inside = Window.partitionBy(*keys).orderBy("seq")
    before, after = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    filled = F.when(F.col(value).isNotNull(), F.struct("seq", value))
    edges = rows.groupBy(*keys).agg(F.max(filled).alias("_last"), F.min(filled).alias("_first"))
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    edges = edges.select(
        *keys, F.last("_last", True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))[value].alias("_left_of"),
        F.first("_first", True).over(chunks.rowsBetween(1, Window.unboundedFollowing))[value].alias("_right_of"))
    near = rows.withColumns({"_l": F.last(value, True).over(before), "_r": F.first(value, True).over(after)}).join(edges, keys)
    left, right = F.coalesce("_l", "_left_of"), F.coalesce("_r", "_right_of")
    return near.select(*others, _filled(F.col(value), left, right).alias(value))


def _filled(value: Column, left: Column, right: Column) -> Column:
    return F.coalesce(value, (left + right) / 2, left, right, F.lit(0.0))


def ring_radii(vertices: DataFrame, samples: DataFrame, by: list[str], key: list[str], limit: int | None = None) -> DataFrame:
    """Median distance of the vertices nearest to each centre-line sample, gaps filled."""
    assigned = nearest_on_polyline(vertices, samples, by, key).select(
        *by, F.floor(F.col("position") + 0.5).alias("seq"), "nearest_mm")
    large = scale.has_large_group(vertices, by, limit or scale.TASK_GROUP_ROWS)  # bounds every ring of the case
    medians = exact_percentiles(assigned, [*by, "seq"], "nearest_mm", {"radius": 0.5}, limit, large)
    rings = samples.select(*by, F.col("seq").cast("bigint").alias("seq")).join(medians, [*by, "seq"], "left")
    return fill_gaps(rings, by, "radius", scale.has_large_group(samples, by, limit or scale.TASK_GROUP_ROWS))


def trimmed_range(
    rings: DataFrame, centres: DataFrame, by: list[str], window: int = 3, low: float = 0.01, high: float = 0.99,
    limit: int | None = None,
) -> DataFrame:
    """Percentile range of ring radii away from ``centres`` (all rings where nothing is left) and each ring's
    place in it."""
    around = centres.select(*by, F.explode(F.sequence(
        F.floor(F.col("seq") + 0.5) - window, F.floor(F.col("seq") + 0.5) + window)).alias("seq")).distinct()
    wanted = {"low": low, "high": high}
    rings = scale.checkpoint(rings)  # read by both ranges and the result
    large = scale.has_large_group(rings, by, limit or scale.TASK_GROUP_ROWS)
    if large:
        trimmed = exact_percentiles(rings.join(around, [*by, "seq"], "left_anti"), by, "radius", wanted, limit, large)
        whole = exact_percentiles(rings, by, "radius", wanted, limit, large).withColumnsRenamed({"low": "_low", "high": "_high"})
        ranges = whole.join(trimmed, by, "left")
    else:
        away = F.when(F.col("_near").isNull(), F.col("radius"))
        marked = rings.join(around.withColumn("_near", F.lit(True)), [*by, "seq"], "left").filter(F.col("radius").isNotNull())
        ranges = marked.groupBy(*by).agg(*[F.percentile(of, p).alias(f"{mark}{name}") for of, mark in ((away, ""), (F.col("radius"), "_"))
                                           for name, p in wanted.items()])
    ranges = ranges.select(*by, F.coalesce("low", "_low").alias("low"), F.coalesce("high", "_high").alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    return rings.join(ranges, by).withColumn("scaled", (F.col("radius") - F.col("low")) / span)


def next_progress(stops: DataFrame, current: DataFrame, by: list[str], forward: bool = True) -> DataFrame:
    """First stop ahead of (or last one behind) the current progress; NULL at either end.

    ``current`` holds one row per case, so the join adds one value to each stop."""
    here = current.select(*by, F.col("progress").alias("current"))
    joined = here.join(stops.select(*by, "progress"), by, "left")
    if forward:
        found = F.min(F.when(F.col("progress") > F.col("current") + 1e-4, F.col("progress")))
    else:
        found = F.max(F.when(F.col("progress") < F.col("current") - 1e-4, F.col("progress")))
    return joined.groupBy(*by, "current").agg(found.alias("next_progress"))

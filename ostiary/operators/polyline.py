"""Polylines as long tables (``by, seq, x, y, z`` with dense ``seq`` from 0) and as arrays in branch rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ostiary import scale
from ostiary.functions import geometry as g

# Vertices per chunk of a long polyline; also the longest line handled as one array.
CHUNK = 4096
PACKED = 512
# Junctions of a case that travel with each of its paths.
CASE_ROWS = 64
# Level of cells from which a point meets bins of a line's pieces before the pieces.
BIN_LEVEL = 3
# Lines of up to PACKED vertices that may be sent to every executor (12 KB each at most).


def segments(lines: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive vertices as ``by, seq, a, b``.

    Windows run over chunks of a line; the first vertex of a chunk is repeated at the end of the one before,
    so a very long line spreads over many tasks and no segment is lost at a border.
    """
    chunk = F.floor(F.col("seq") / CHUNK)
    border = (F.col("seq") % CHUNK == 0) & (F.col("seq") > 0)
    copied = lines.select(*by, "seq", g.point(*g.cols("x", "y", "z")).alias("a"), F.explode(
        F.when(border, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))).alias("chunk"))
    window = Window.partitionBy(*by, "chunk").orderBy("seq")
    return copied.withColumn("b", F.lead("a").over(window)).filter("b IS NOT NULL").select(*by, "seq", "chunk", "a", "b")


def arc_length(lines: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative length ``arc`` at every vertex: running sums per chunk plus the length of earlier chunks."""
    steps = segments(lines, by).withColumn("step", g.distance(g.xyz("a"), g.xyz("b")))
    inside = Window.partitionBy(*by, "chunk").orderBy("seq")
    earlier = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.groupBy(*by, "chunk").agg(F.sum("step").alias("total")).select(
        *by, "chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("before"))
    reached = steps.withColumn("arc", F.sum("step").over(inside)).join(offsets, [*by, "chunk"]).select(
        *by, (F.col("seq") + 1).alias("seq"), (F.col("arc") + F.col("before")).alias("arc"))
    return lines.join(reached, [*by, "seq"], "left").withColumn("arc", F.coalesce("arc", F.lit(0.0)))


def line_length(lines: DataFrame, by: list[str]) -> DataFrame:
    return segments(lines, by).groupBy(*by).agg(F.sum(g.distance(g.xyz("a"), g.xyz("b"))).alias("length_mm"))


def _pack(lines: DataFrame, by: list[str]) -> DataFrame:
    vertex = F.struct("seq", g.point(*g.cols("x", "y", "z")).alias("p"))
    return lines.groupBy(*by).agg(F.sort_array(F.collect_list(vertex))["p"].alias("_line"))


def nearest_on_polyline(
    points: DataFrame, lines: DataFrame, by: list[str], key: list[str], point: str = "point",
    packed: int | None = None, vertices_only: bool = False,
) -> DataFrame:
    """Add ``nearest_mm`` and ``position`` (segment index + fraction) of the closest place on the case's line.

    ``vertices_only`` looks at vertices alone. Lines up to ``packed`` vertices travel as one array and are
    searched inside the row. Longer ones use grid cells of each line's own sizes, see :func:`_growing_cells`.
    Points with a missing or non-finite coordinate have no nearest place (NULL).
    """
    packed = PACKED if packed is None else packed
    finite = F.lit(True)
    for axis in g.xyz(point):
        finite = finite & g.is_finite(axis)
    finite = F.coalesce(finite, F.lit(False))
    nowhere = F.lit(None).cast("double")
    lost = points.filter(~finite).withColumns({"nearest_mm": nowhere, "position": nowhere})
    points = points.filter(finite)
    short, long = scale.split_by_size(lines, by, packed)
    if vertices_only:
        found = F.array_min(F.transform("_line", lambda v, i: F.struct(
            g.distance(g.xyz(point), g.xyz(v)).alias("distance"), i.cast("double").alias("position"))))
    else:
        found = g.nearest_on_path(g.xyz(point), F.col("_line"))
    met = scale.per_group(points, _pack(short, by), by, "left" if long is None else "inner")
    joined = scale.computed_once(met, "_near", found)
    done = joined.select(*points.columns, F.col("_near.distance").alias("nearest_mm"), F.col("_near.position").alias("position"))
    if long is None:
        return done.unionByName(lost)
    far = points.join(short.select(*by).distinct(), by, "left_anti")
    found_far = _growing_cells(far, long, by, key, point, vertices_only)
    return done.unionByName(far.join(found_far, [*by, *key], "left").select(*done.columns)).unionByName(lost)


def _growing_cells(points: DataFrame, lines: DataFrame, by: list[str], key: list[str], point: str, vertices_only: bool) -> DataFrame:
    """Nearest places on lines of any length, by cells of each line's own sizes.

    On level k a line's cells have margin r = 2^k times its mean segment. A segment is copied to all cells its box reaches
    with that margin; a point looks into its own cell only. Every segment within r of a point is seen, so a hit at most r
    away is final; the others retry one level up. A point starts where r reaches the line's bounding box, so one far away
    does not climb through all levels, and a round copies lines on the levels that open points ask for. Segments longer
    than a cell are cut into pieces first, so none is copied to more than a few cells. From level BIN_LEVEL on, points meet
    bins of pieces first, so a point far away does not look at all of the line within its radius.
    """
    pieces = segments(lines, by).select(*by, "seq", "a", "b")
    mean = F.greatest(F.avg(g.distance(g.xyz("a"), g.xyz("b"))), F.lit(1e-6)).alias("_size")
    sizes = pieces.groupBy(*by).agg(mean)
    boxes = lines.groupBy(*by).agg(*[f(axis).alias(f"_{name}{axis}") for axis in "xyz" for name, f in (("lo", F.min), ("hi", F.max))])
    stats = scale.checkpoint(boxes.join(sizes, by, "left").withColumn("_size", F.coalesce("_size", F.lit(1e-6))))
    if vertices_only:
        pieces = lines.select(*by, "seq", g.point(*g.cols("x", "y", "z")).alias("a"))
        pieces = pieces.withColumn("b", F.col("a"))
    pieces = scale.checkpoint(_cut_segments(scale.per_group(pieces, stats.select(*by, "_size"), by), [*by, "_size"], 2 * F.col("_size")))
    outside = g.norm(tuple(F.greatest(F.col(f"_lo{n}") - axis, axis - F.col(f"_hi{n}"), F.lit(0.0)) for n, axis in zip("xyz", g.xyz(point))))
    level = F.greatest(F.lit(0), F.ceil(F.log2(outside / F.col("_size")))).cast("int")
    started = scale.per_group(points, stats, by)
    open_points = scale.checkpoint(started.select(*by, *key, point, "_size", F.coalesce(level, F.lit(0)).alias("_level")))
    radius = F.col("_size") * F.pow(F.lit(2.0), F.col("_level"))
    fraction, gap = g.segment_projection(g.xyz(point), g.xyz("a"), g.xyz("b"))
    place = F.min(F.struct(gap.alias("nearest_mm"), (F.col("seq") + fraction * F.col("share")).alias("position"))).alias("_best")
    settled = None
    while not open_points.isEmpty():
        rounds = []
        for far in (False, True):
            here = open_points.filter(F.col("_level") >= BIN_LEVEL if far else F.col("_level") < BIN_LEVEL)
            looked = pieces.join(here.select(*by, "_level").distinct(), by).withColumn("_r", radius)
            own = here.select(*by, *key, point, "_level", *[F.floor(axis / (2 * radius)).alias(f"_c{i}") for i, axis in enumerate(g.xyz(point))])
            if far:
                met = _pieces_of_near_bins(own, looked, by, key, point)
            else:
                for i, (a, b) in enumerate(zip(g.xyz("a"), g.xyz("b"))):
                    looked = looked.withColumn(f"_c{i}", _reached_cells(F.least(a, b), F.greatest(a, b)))
                met = own.join(looked.drop("_size"), [*by, "_level", "_c0", "_c1", "_c2"])
            rounds.append(met.groupBy(*by, *key).agg(place, F.max("_r").alias("_r")))
        best = rounds[0].unionByName(rounds[1])
        final = scale.checkpoint(best.filter(F.col("_best.nearest_mm") <= F.col("_r")).select(*by, *key, "_best.*"))
        open_points = scale.checkpoint(open_points.join(final, [*by, *key], "left_anti").withColumn("_level", F.col("_level") + 1))
        settled = final if settled is None else settled.unionByName(final)
    if settled is None:
        return open_points.select(*by, *key, F.lit(None).cast("double").alias("nearest_mm"), F.lit(None).cast("double").alias("position"))
    return settled


def _reached_cells(low: Column, high: Column) -> Column:
    """Cells of size 2 ``_r`` that a box reaches with margin ``_r``, along one axis."""
    r = F.col("_r")
    return F.explode(F.sequence(F.floor((low - r) / (2 * r)), F.floor((high + r) / (2 * r))))


def _pieces_of_near_bins(points: DataFrame, pieces: DataFrame, by: list[str], key: list[str], point: str) -> DataFrame:
    """Pairs of a point and a piece that may be its nearest, for points far from their line, whose cells hold much of it.

    Pieces lie in bins of 1/64 of the level's radius, and a point meets the bins' boxes first. A bin stays if its box is no
    farther away than the whole of some other bin, so the nearest piece is among those of the bins that stay.
    """
    bins = ["_b0", "_b1", "_b2"]
    edge = F.greatest(F.col("_size"), F.col("_r") / 64)
    binned = pieces.select("*", *[F.floor(axis / edge).alias(c) for c, axis in zip(bins, g.xyz("a"))])
    ends = list(zip("xyz", g.xyz("a"), g.xyz("b")))
    boxes = binned.groupBy(*by, "_level", "_r", *bins).agg(
        *[F.min(F.least(a, b)).alias(f"_lo{n}") for n, a, b in ends], *[F.max(F.greatest(a, b)).alias(f"_hi{n}") for n, a, b in ends])
    for i, n in enumerate("xyz"):
        boxes = boxes.withColumn(f"_c{i}", _reached_cells(F.col(f"_lo{n}"), F.col(f"_hi{n}")))
    met = points.join(boxes, [*by, "_level", "_c0", "_c1", "_c2"])
    sides = [(axis, F.col(f"_lo{n}"), F.col(f"_hi{n}")) for n, axis in zip("xyz", g.xyz(point))]
    least = g.norm(tuple(F.greatest(low - p, p - high, F.lit(0.0)) for p, low, high in sides))
    most = g.norm(tuple(F.greatest(F.abs(p - low), F.abs(p - high)) for p, low, high in sides))
    bounded = met.select(*by, *key, point, "_level", *bins, least.alias("_least"), most.alias("_most"))
    surest = F.min("_most").over(Window.partitionBy(*by, *key))
    near = bounded.withColumn("_surest", surest).filter(F.col("_least") <= F.col("_surest") * (1 + 1e-9))
    return near.select(*by, *key, point, "_level", *bins).join(binned.drop("_size"), [*by, "_level", *bins])


def _cut_segments(pieces: DataFrame, keep: list[str], size: float | Column) -> DataFrame:
    """Segments ``seq, a, b`` cut into pieces of at most ``size``; ``share`` is a piece's part of its segment."""
    cuts = F.greatest(F.lit(1.0), F.ceil(g.distance(g.xyz("a"), g.xyz("b")) / size).cast("double"))
    numbered = pieces.withColumn("_cuts", cuts).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("_cuts") - 1).cast("int"))))

    def between(share: Column) -> Column:
        return g.point(*[p + (q - p) * share for p, q in zip(g.xyz("a"), g.xyz("b"))])

    return numbered.select(
        *keep, (F.col("seq") + F.col("_i") / F.col("_cuts")).alias("seq"), (1 / F.col("_cuts")).alias("share"),
        F.when(F.col("_i") == 0, F.col("a")).otherwise(between(F.col("_i") / F.col("_cuts"))).alias("_from"),
        F.when(F.col("_i") == F.col("_cuts") - 1, F.col("b")).otherwise(between((F.col("_i") + 1) / F.col("_cuts"))).alias("b"),
    ).withColumnRenamed("_from", "a")


def nearest_sample(points: DataFrame, lines: DataFrame, by: list[str], key: list[str], point: str = "point",
                   packed: int | None = None) -> DataFrame:
    """Nearest vertex: ``nearest_mm``, ``index`` and ``progress`` = index / (n - 1)."""
    counts = lines.groupBy(*by).agg((F.count("*") - 1).alias("_last"))
    found = nearest_on_polyline(points, lines, by, key, point, packed, vertices_only=True)
    return found.join(counts, by, "left").select(
        *points.columns, "nearest_mm", F.col("position").cast("bigint").alias("index"),
        F.try_divide(F.col("position"), F.col("_last")).alias("progress"))


def stop_at_junction(paths: DataFrame, junctions: DataFrame, by: list[str], key: list[str], tolerance: float) -> DataFrame:
    """Cut each path at the first junction within ``tolerance`` of it (and past its start).

    Junctions of cases with up to CASE_ROWS of them travel as one array per case and are looked for inside the path's row.
    The others meet the paths in grid cells, see :func:`_stops_by_cells`.
    """
    traced = paths.withColumn("_arcs", g.arc_lengths(F.col("path")))
    spots = junctions.select(*by, "junction").filter(F.col("junction").isNotNull())
    few, many = scale.split_by_size(spots, by, CASE_ROWS)
    listed = few.groupBy(*by).agg(F.collect_set("junction").alias("_spots"))
    hits = F.transform("_spots", lambda j: g.nearest_on_path(g.xyz(j), F.col("path")))
    inside = F.filter(hits, lambda h: h["distance"] <= tolerance)

    def along(hit: Column) -> Column:
        at = F.least(F.floor(hit["position"]), F.size("path") - 2).cast("int")
        low = F.get("_arcs", at)
        return F.coalesce(low + (F.get("_arcs", at + 1) - low) * (hit["position"] - at), F.lit(0.0))

    first = F.array_min(F.filter(F.transform(inside, along), lambda arc: arc > 0))
    met = traced if many is None else traced.join(many.select(*by).distinct(), by, "left_anti")
    stopped = scale.per_group(met, listed, by, "left").withColumn("_stop", first)
    cut = F.when(F.col("_stop").isNull(), F.col("path")).otherwise(g.truncate_path(F.col("path"), F.col("_arcs"), F.col("_stop")))
    done = stopped.withColumn("path", cut).select(*paths.columns)
    if many is None:
        return done
    busy = traced.join(many.select(*by).distinct(), by, "left_semi")
    stops = _stops_by_cells(busy, many, by, key, tolerance)
    return done.unionByName(busy.join(stops, [*by, *key], "left").withColumn("path", cut).select(*paths.columns))


def _stops_by_cells(traced: DataFrame, junctions: DataFrame, by: list[str], key: list[str], tolerance: float) -> DataFrame:
    """``by, key, _stop``: segments lie in grid cells of twice the tolerance, cut where they are longer, and a junction looks
    into its own cell, so the work follows the true neighbours and not the longest path."""
    steps = F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda b, i: F.struct(
        i.alias("seq"), F.get("path", i).alias("a"), b.alias("b"), F.get("_arcs", i).alias("low"), F.get("_arcs", i + 1).alias("high")))
    pieces = _cut_segments(traced.select(*by, *key, F.inline(steps)), [*by, *key, F.col("seq").alias("_at"), "low", "high"], 2 * tolerance)
    cell = F.lit(2.0 * tolerance)
    for i, (p, q) in enumerate(zip(g.xyz("a"), g.xyz("b"))):
        pieces = pieces.withColumn(f"_c{i}", F.explode(F.sequence(
            F.floor((F.least(p, q) - tolerance) / cell), F.floor((F.greatest(p, q) + tolerance) / cell))))
    own = [F.floor(axis / cell).alias(f"_c{i}") for i, axis in enumerate(g.xyz("junction"))]
    near = pieces.join(junctions.select(*by, "junction", *own), [*by, "_c0", "_c1", "_c2"])
    fraction, gap = g.segment_projection(g.xyz("junction"), g.xyz("a"), g.xyz("b"))
    place = F.col("seq") + fraction * F.col("share")
    along = F.col("low") + (F.col("high") - F.col("low")) * (place - F.col("_at"))
    hit = near.select(*by, *key, "junction", F.struct(gap.alias("gap"), place.alias("place"), along.alias("along")).alias("_n")).filter(
        F.col("_n.gap") <= tolerance).groupBy(*by, *key, "junction").agg(F.min("_n").alias("_hit"))
    along = F.col("_hit.along")
    return hit.withColumn("_along", along).filter(F.col("_along") > 0).groupBy(
        *by, *key).agg(F.min("_along").alias("_stop"))


def shares_prefix(prefix: Column, other: Column, tolerance: Column) -> Column:
    """Every vertex of the truncated ``prefix`` runs within ``tolerance`` of the other path."""
    return F.forall(prefix, lambda p: g.nearest_on_path(g.xyz(p), other)["distance"] <= tolerance)


def same_trunk(a_path: Column, a_prefix: Column, a_radius: Column, b_path: Column, b_prefix: Column, b_radius: Column) -> Column:
    """Either first part lies inside the other's lumen; ``*_prefix`` are the paths cut at 3 mm."""
    def reach(radius: Column) -> Column:
        return F.greatest(F.lit(1.5), radius * 1.2)

    return shares_prefix(a_prefix, b_path, reach(b_radius)) | shares_prefix(b_prefix, a_path, reach(a_radius))


def on_path(path: Column, other: Column, spacing: float) -> Column:
    """The opening or first path point of ``path`` is nearer than 1.5 spacings to a later vertex of ``other``."""
    later = F.slice(other, 2, F.greatest(F.size(other) - 1, F.lit(0)))
    return F.exists(F.slice(path, 1, 2), lambda p: F.exists(
        later, lambda q: g.distance(g.xyz(p), g.xyz(q)) < 1.5 * spacing))


def smooth_series(series: DataFrame, by: list[str], values: list[str], sigma: float) -> DataFrame:
    """Gaussian smoothing along dense ``seq`` (radius 4 sigma, ends reflected).

    Each value is sent to the positions it contributes to, already weighted, and summed there: a fixed number
    of copies per row and a partial sum, so long series spread over all tasks.
    """
    reach = int(4.0 * sigma + 0.5)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    weight = F.exp(F.lit(-0.5) * F.pow(F.col("_o") / F.lit(float(sigma)), F.lit(2.0)))
    norm = F.aggregate(F.transform(steps, lambda o: F.exp(F.lit(-0.5) * F.pow(o / F.lit(float(sigma)), F.lit(2.0)))),
                       F.lit(0.0), lambda total, w: total + w)
    lengths = series.groupBy(*by).agg(F.count("*").alias("_n"))
    wanted = series.join(lengths, by).select(*by, "seq", "_n", F.explode(steps).alias("_o"))
    turn = F.pmod(F.col("seq") + F.col("_o"), 2 * F.col("_n"))
    source = F.when(turn < F.col("_n"), turn).otherwise(2 * F.col("_n") - 1 - turn)
    looked = wanted.select(*by, F.col("seq").alias("_to"), source.alias("seq"), (weight / norm).alias("_w"))
    sums = looked.join(series.select(*by, "seq", *values), [*by, "seq"]).groupBy(*by, "_to").agg(*[
        F.sum(F.col(v) * F.col("_w")).alias(v) for v in values])
    return sums.withColumnRenamed("_to", "seq")


def first_crossing(profiles: DataFrame, level: Column | float, step: float = 0.25) -> DataFrame:
    """Distance along each ray (``samples`` array) where it first falls to ``level``; NULL if it starts there."""
    level = F.lit(float(level)) if not isinstance(level, Column) else level
    # array_position gives 1 for the start and 0 when no sample is low enough.
    at = F.array_position(F.transform("samples", lambda s: s <= level), True).cast("int")
    before, after = F.get("samples", at - 2), F.get("samples", at - 1)
    crossing = step * (at - 2) + step * F.try_divide(before - level, before - after)
    return profiles.withColumn("crossing_mm", F.when(at >= 2, crossing)).withColumn("starts_low", at == 1)


def wall_crossing(connectors: DataFrame, gap_fraction: float = 0.0) -> DataFrame:
    """Position (sample index + fraction) where a connector's signed distance first reaches zero.

    NULL when it starts inside, never gets there, or more than ``gap_fraction`` of the samples up to the
    crossing lie outside the ``supported`` cells.
    """
    at = F.array_position(F.transform("samples", lambda s: s <= 0), True).cast("int")
    before, after = F.get("samples", at - 2), F.get("samples", at - 1)
    open_part = F.size(F.filter(F.slice("supported", 1, F.greatest(at, F.lit(0))), lambda ok: ~ok)) / F.greatest(at, F.lit(1))
    position = (at - 2) + F.try_divide(before, before - after)
    return connectors.withColumns({"unsupported": open_part, "crossing_at": F.when((at >= 2) & (open_part <= gap_fraction), position)})


def cross_section_radius(crossings: DataFrame, by: list[str], half: int = 16, needed: int = 12) -> DataFrame:
    """Half the median of opposite-ray diameters; NULL with too few pairs or a ray that starts low.

    A section has 2 * ``half`` rays, so its rays fit one array.
    """
    rays = F.array(*[F.max(F.when(F.col("ray") == i, F.col("crossing_mm"))) for i in range(2 * half)])
    grouped = crossings.groupBy(*by).agg(rays.alias("_rays"), F.bool_or("starts_low").alias("_low"))
    diameters = F.sort_array(F.array_compact(F.zip_with(
        F.slice("_rays", 1, half), F.slice("_rays", half + 1, half), lambda a, b: a + b)))
    sized = grouped.withColumn("_d", diameters).withColumn("_n", F.size("_d"))
    middle = (F.get("_d", F.floor((F.col("_n") - 1) / 2).cast("int")) + F.get("_d", F.floor(F.col("_n") / 2).cast("int"))) / 2
    return sized.select(*by, F.when(~F.col("_low") & (F.col("_n") >= needed), middle / 2).alias("radius_mm"))

"""Statistics over sparse cell grids ``(case_id, z, y, x, ...)``.

Cells are the largest tables here. Everything combines before the shuffle or joins on unique coordinates;
only per-case medians need an order, and they use the exact percentile operator with its own size check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, ShortType

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.operators.graph import Z, label_cells, neighbour_count, neighbour_pairs
from ostiary.operators.ordering import exact_percentiles, rank_within
from ostiary.operators.polyline import smooth_series
from ostiary.operators.spatial import pairs_within

CASE = ["case_id"]
SLAB_BLOCK = 16
# Cells of whole cases that a task walks at a time.
BATCH_CELLS = 100_000


def support_cells(cells: DataFrame, floor: float) -> DataFrame:
    """Flag cells that may belong to a vessel; ``lower`` and ``upper`` are columns of the row."""
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    tube = (F.col("tubular") >= floor) | (F.col("outside") <= 1.5)
    return cells.withColumn("support", (inside & tube & (F.col("outside") <= 16)) | F.col("parent"))


def shell_cells(cells: DataFrame, inner: float, outer: float, floor: float) -> DataFrame:
    return cells.filter(F.col("support") & ~F.col("excluded") & F.col("outside").between(inner, outer) & (F.col("tubular") >= floor))


def plane_slice(cells: DataFrame, axis: str, index: int, level: float, width: float) -> DataFrame:
    """Cells of one plane with their display value in 0..255; the plane is a pushed-down filter."""
    shown = (F.col("value") - level + width / 2) / width * 255
    return cells.filter(F.col(axis) == index).withColumn("shown", F.least(F.lit(255.0), F.greatest(F.lit(0.0), shown)))


def _median_and_mad(rows: DataFrame, prefix: str, limit: int | None, large: bool) -> DataFrame:
    median = exact_percentiles(rows, CASE, "value", {f"{prefix}median": 0.5}, limit, large)
    median = scale.checkpoint(median)
    spread = scale.per_group(rows, median, CASE).withColumn("_gap", F.abs(F.col("value") - F.col(f"{prefix}median")))
    gap = exact_percentiles(spread, CASE, "_gap", {f"{prefix}gap": 0.5}, limit, large)
    return median.join(gap, CASE).withColumn(
        f"{prefix}mad", F.col(f"{prefix}gap") * 1.4826).drop(f"{prefix}gap")


def intensity_window(
    cells: DataFrame, native_spacing: DataFrame, config: dict, limit: int | None = None,
) -> DataFrame:
    """Per-case intensity window of contrast-filled blood with two warnings.

    Core cells lie at least 2 mm inside the parent (or the whole parent when fewer than 20 do); background
    cells lie 8 to 16 mm outside. ``native_spacing`` holds the largest scan spacing per case.
    """
    large = scale.has_large_group(cells, CASE, limit or scale.TASK_GROUP_ROWS)  # bounds both cell subsets
    deep = cells.groupBy(*CASE).agg(F.count_if(F.col("inside") >= 2).alias("_deep"))
    core = scale.per_group(cells, deep, CASE).filter(F.when(F.col("_deep") >= 20, F.col("inside") >= 2).otherwise(F.col("parent")))
    background = cells.filter(F.col("outside").between(8, 16))
    stats = _median_and_mad(core, "", limit, large).join(_median_and_mad(background, "background_", limit, large), CASE, "left").join(
        native_spacing, CASE)
    median, mad = F.col("median"), F.col("mad")
    bg = F.coalesce("background_median", "median")
    bg_mad = F.coalesce("background_mad", F.lit(0.0))
    floor = F.greatest(F.lit(30.0), median - config["blood_lower_scale"] * F.greatest(F.lit(65.0), mad * 2.5))
    fraction = F.lit(float(config["support_contrast_fraction"]))
    scaled = config["native_contrast_scale"] > 0
    if scaled:
        area = config["minimum_radius_mm"] ** 2
        kept = area / (area + F.pow(F.col("native_spacing_mm") * 0.6, F.lit(2.0)))
        fraction = F.least(fraction, config["native_contrast_scale"] * kept)
    level = F.greatest(F.lit(30.0), bg + fraction * (median - bg))
    with_level = level if scaled else F.greatest(F.least(floor, level), (median + bg) / 2)
    contrast = (median - bg) / F.greatest(bg_mad, F.lit(1.0))
    return stats.select(
        *CASE, "median", "mad", F.when(bg < median, with_level).otherwise(floor).alias("lower"),
        (median + F.greatest(F.lit(120.0), mad * 3.5)).alias("upper"), bg.alias("background_median"),
        bg_mad.alias("background_mad"), fraction.alias("support_fraction"), contrast.alias("contrast_to_mad"),
        F.array_compact(F.array(F.when(median < 120, "low_parent_contrast"),
                                F.when(contrast <= 1, "intensities_overlap"))).alias("warnings"))


def percentile_normalize(cells: DataFrame, value: str, p: float = 0.995, limit: int | None = None) -> DataFrame:
    """Scale by the percentile over cells within 15 mm of the parent and clip to [0, 1]."""
    near = cells.filter((F.col("outside") > 0) & (F.col("outside") <= 15))
    peak = exact_percentiles(near, CASE, value, {"_peak": p}, limit)
    scaled = F.col(value) / F.greatest(F.col("_peak"), F.lit(1e-6))
    return scale.per_group(cells, peak, CASE, "left").withColumn("normalized", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_peak")


def roi_bounds(cells: DataFrame, headers: DataFrame, margin: float) -> DataFrame:
    """Index range of the parent widened by the margin and kept inside the grid.

    ``headers`` carries spacing and size arrays in x, y, z order."""
    parent = cells.filter("parent").groupBy(*CASE).agg(*[f(a).alias(f"{n}_{a}") for a in Z for n, f in (("lo", F.min), ("hi", F.max))])
    joined = parent.join(headers.select(*CASE, "spacing", "size"), CASE)
    columns = []
    for i, axis in enumerate(("x", "y", "z")):
        pad = F.ceil(F.lit(float(margin)) / F.get("spacing", F.lit(i)))
        columns += [F.greatest(F.col(f"lo_{axis}") - pad, F.lit(0)).cast("bigint").alias(f"lo_{axis}"),
                    F.least(F.col(f"hi_{axis}") + pad, F.get("size", F.lit(i)) - 1).cast("bigint").alias(f"hi_{axis}")]
    return joined.select(*CASE, *columns)


def crop(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    inside = reduce(lambda a, b: a & b, [F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in Z])
    return cells.join(bounds, CASE).filter(inside).select(*cells.columns)


def _boxes(labelled: DataFrame, by: list[str]) -> DataFrame:
    return labelled.groupBy(*by).agg(
        F.count("*").alias("cells"), *[f(a).alias(f"{n}_{a}") for a in Z for n, f in (("lo", F.min), ("hi", F.max))])


def _longest_axis() -> Column:
    """z, y or x with the largest extent; the first one wins ties."""
    extents = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in Z]
    return F.when((extents[0] >= extents[1]) & (extents[0] >= extents[2]), "z").when(extents[1] >= extents[2], "y").otherwise("x")


def cap_cells(cells: DataFrame, cap: float, margin: float, spacing: float = 1.0, minimum: int = 8) -> DataFrame:
    """Flag ``excluded`` cells: slabs at both ends of each parent component's longest axis.

    A slab is cut into grid blocks of SLAB_BLOCK cells a side, so a cell meets the slabs of its own block only: the join is
    on case and block, with the slab's borders as a last test, and stops at the first slab found.
    """
    labelled = label_cells(cells.filter("parent"), CASE, 6)
    boxes = _boxes(labelled, [*CASE, "component"]).filter(F.col("cells") >= minimum).withColumn("axis", _longest_axis())
    width, pad = max(1, math.ceil(cap / spacing)), math.ceil(margin / spacing)

    def slab(low_end: bool) -> Column:
        borders = []
        for a in Z:
            lo, hi = F.col(f"lo_{a}") - pad, F.col(f"hi_{a}") + pad
            along = F.col("axis") == a
            if low_end:
                hi = F.when(along, F.least(hi, F.col(f"lo_{a}") + width - 1)).otherwise(hi)
            else:
                lo = F.when(along, F.greatest(lo, F.col(f"hi_{a}") - width + 1)).otherwise(lo)
            borders += [lo.cast("bigint").alias(f"s_lo_{a}"), hi.cast("bigint").alias(f"s_hi_{a}")]
        return F.struct(*borders)

    slabs = boxes.select(*CASE, F.inline(F.array(slab(True), slab(False)))).distinct()
    for a in Z:
        slabs = slabs.withColumn(f"_b{a}", F.explode(F.sequence(F.floor(F.col(f"s_lo_{a}") / SLAB_BLOCK), F.floor(F.col(f"s_hi_{a}") / SLAB_BLOCK))))
    own = cells.select(*CASE, *Z, *[F.floor(F.col(a) / SLAB_BLOCK).alias(f"_b{a}") for a in Z])
    slabs = slabs.withColumnsRenamed({c: f"s{c}" for c in ("_bz", "_by", "_bx")}).withColumnRenamed("case_id", "_case")
    same = [F.col("case_id") == F.col("_case"), *[F.col(f"_b{a}") == F.col(f"s_b{a}") for a in Z], *[F.col(a).between(F.col(f"s_lo_{a}"), F.col(f"s_hi_{a}")) for a in Z]]
    excluded = own.join(slabs, reduce(lambda p, q: p & q, same), "left_semi").select(*CASE, *Z, F.lit(True).alias("excluded"))
    return cells.join(excluded, [*CASE, *Z], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def blob_stats(labelled: DataFrame, spacing: float = 1.0, minimum_radius: float = 0.0) -> DataFrame:
    """Size, volume and box per component; blobs smaller than a disc of the minimum radius are dropped."""
    boxes = _boxes(labelled, [*CASE, "component"]).withColumn("volume_mm3", F.col("cells") * spacing**3)
    return boxes.filter(F.col("volume_mm3") >= math.pi * minimum_radius**2 * spacing)


def blob_roots(labelled: DataFrame, k: int, separation: float = 4.0, root_depth: float = 3.5, spacing: float = 1.0) -> DataFrame:
    """Up to ``k`` best cells per blob, at least ``separation`` apart; wall-side cells only where a blob has any.

    ``k`` rounds of "best remaining cell, then drop its surroundings": one partial aggregate and one join per
    round, the same result as walking the sorted cells, without sorting a blob in one place.
    """
    by = [*CASE, "component"]
    quality = F.col("radius") * (F.col("tubular") + 0.3)
    near = F.col("outside") <= root_depth
    walls = labelled.groupBy(*by).agg(F.bool_or(near).alias("_walled"))
    open_cells = scale.per_group(labelled, walls, by).filter(near | ~F.col("_walled")).select(*by, *Z, quality.alias("quality"))
    if k > 1:
        open_cells = scale.checkpoint(open_cells)
    picked = None
    for number in range(k):
        best = open_cells.groupBy(*by).agg(F.min(F.struct((-F.col("quality")).alias("q"), *Z)).alias("_b")).select(
            *by, (-F.col("_b.q")).alias("quality"), *[F.col(f"_b.{a}").alias(a) for a in Z])
        if k > 1:
            best = scale.checkpoint(best)
        numbered = best.withColumn("pick", F.lit(number + 1))
        picked = numbered if picked is None else picked.unionByName(numbered)
        if number + 1 < k:
            taken = best.select(*by, *[F.col(a).alias(f"t_{a}") for a in Z])
            gap = F.sqrt(reduce(lambda p, q: p + q, [F.pow((F.col(a) - F.col(f"t_{a}")) * F.lit(float(spacing)), F.lit(2.0)) for a in Z]))
            open_cells = scale.checkpoint(scale.per_group(open_cells, taken, by).filter(gap >= separation).select(*open_cells.columns))
    return picked


def junctions(skeleton: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Centres of skeleton crossings with at least three arms that run from 3.5 mm or less to 4 mm or more.

    ``skeleton`` holds skeleton cells with their ``parent`` flag. Arms are components of the cells 2 to 5 mm
    from a centre; the distance join keeps that neighbourhood small.
    """
    nodes = neighbour_count(skeleton, CASE, 26).filter("neighbours >= 3").join(
        skeleton.filter(~F.col("parent")).select(*CASE, *Z), [*CASE, *Z], "left_semi")
    clusters = label_cells(nodes, CASE, 26)
    centres = clusters.groupBy(*CASE, "component").agg(*[F.avg(a).alias(f"c{a}") for a in Z]).select(
        *CASE, F.col("component").alias("junction"), g.point(*[F.col(f"c{a}") * spacing for a in reversed(Z)]).alias("centre"))
    members = skeleton.select(*CASE, *Z, g.point(*[F.col(a) * spacing for a in reversed(Z)]).alias("_p"))
    arms = pairs_within(members, centres, CASE, "_p", "centre", 5.0).filter(F.col("distance") > 2)
    arms = scale.checkpoint(arms.select(*CASE, "junction", "centre", *Z, "distance"))
    by = [*CASE, "junction"]
    parts = label_cells(arms, by, 26).join(arms.select(*by, *Z, "distance"), [*by, *Z])
    reaching = parts.groupBy(*by, "component").agg(F.min("distance").alias("near"), F.max("distance").alias("far")).filter(
        (F.col("near") <= 3.5) & (F.col("far") >= 4))
    count = reaching.groupBy(*by).agg(F.count("*").alias("arms")).filter("arms >= 3")
    return centres.join(count, by).select(*by, "centre", "arms")


def slice_curve(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Centre line of the parent: per plane along its longest axis the weighted centre (weight inside²), moved
    to the nearest member cell, then smoothed where the smoothed point stays inside the parent."""
    parent = cells.filter("parent")
    axis = _boxes(parent, CASE).select(*CASE, _longest_axis().alias("axis"))
    level = F.when(F.col("axis") == "z", F.col("z")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("x"))
    placed = scale.per_group(parent, axis, CASE).withColumn("level", level)
    weight = F.pow(F.col("inside"), F.lit(2.0))
    centres = placed.groupBy(*CASE, "level").agg(*[(F.sum(F.col(a) * weight) / F.sum(weight)).alias(f"c{a}") for a in Z])
    gap = reduce(lambda p, q: p + q, [F.pow(F.col(a) - F.col(f"c{a}"), F.lit(2.0)) for a in Z])
    snapped = placed.join(centres, [*CASE, "level"]).groupBy(*CASE, "level").agg(
        F.min(F.struct(gap.alias("gap"), *Z)).alias("_s")).select(*CASE, "level", *[F.col(f"_s.{a}").cast("double").alias(a) for a in Z])
    # Levels can have holes, so the order along the curve is the count of levels below; levels are few per case.
    ordered = snapped.withColumn("seq", F.row_number().over(Window.partitionBy(*CASE).orderBy("level")) - 1)
    smooth = smooth_series(ordered, CASE, Z, max(1.0, 2 / spacing)).withColumnsRenamed({a: f"s{a}" for a in Z})
    joined = ordered.join(smooth, [*CASE, "seq"])
    members = parent.select(*CASE, *[F.col(a).cast("bigint").alias(f"r{a}") for a in Z], F.lit(True).alias("_in"))
    checked = joined.withColumns({f"r{a}": F.rint(f"s{a}").cast("bigint") for a in Z}).join(members, [*CASE, *[f"r{a}" for a in Z]], "left")
    return checked.select(*CASE, "level", *[F.when(F.col("_in"), F.col(f"s{a}")).otherwise(F.col(a)).alias(a) for a in Z])


@F.pandas_udf(ArrayType(DoubleType()))
def _leading_direction(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Eigenvector of the largest eigenvalue for a batch of symmetric 3 x 3 matrices."""
    stacked = np.stack([np.stack(row, axis=-1) for row in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-2)
    return pd.Series(list(np.linalg.eigh(stacked)[1][:, :, -1]))


def _axes(points: DataFrame, by: list[str]) -> DataFrame:
    sums = points.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.covar_pop(a, b).alias(f"_{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]])
    found = sums.withColumn("_d", _leading_direction("_xx", "_xy", "_xz", "_yy", "_yz", "_zz"))
    return found.select(*by, "n", g.point(*[F.get("_d", F.lit(i)) for i in range(3)]).alias("axis"))


def principal_axis(points: DataFrame, by: list[str]) -> DataFrame:
    """First principal direction of each group with the range of projections on it; its sign is arbitrary.

    Six covariance sums combine map-side; the eigenvector is taken from one row per group, in Arrow batches.
    """
    axes = scale.checkpoint(_axes(points, by))
    along = g.dot(g.cols("x", "y", "z"), g.xyz("axis"))
    ranges = scale.per_group(points, axes.select(*by, "axis"), by).groupBy(*by).agg(F.min(along).alias("low"), F.max(along).alias("high"))
    return axes.join(ranges, by)


def parent_angle(probes: DataFrame, members: DataFrame, by: list[str], key: list[str], box: float = 12.0) -> DataFrame:
    """Angle between each probe's direction and the principal axis of the members in a box around it (90 if < 3).

    The box is written as cell lookups: members stay in their cell, probes are copied to the cells they touch. Where members
    lie on a grid of whole numbers, probes whose boxes hold the same grid places are looked up once, so the work follows the
    different boxes that a case can have and not the probes.
    """
    size, place = 2 * box, dict(zip("xyz", g.xyz("point")))
    own = members.select(*by, "x", "y", "z", *[F.floor(F.col(a) / size).alias(f"_c{i}") for i, a in enumerate("xyz")])
    if all(isinstance(members.schema[a].dataType, (ByteType, ShortType, IntegerType)) for a in "xyz"):
        boxed = {f"_{end}{a}": _box_end(place[a], box, end) for a in "xyz" for end in ("low", "high")}
        limits = {a: (F.col(f"_low{a}"), F.col(f"_high{a}")) for a in "xyz"}
        inside = [F.col(a).between(*limits[a]) for a in "xyz"]
        ends = F.struct(*[value.alias(name) for name, value in boxed.items()])
        probes, one = scale.computed_once(probes, "_box", ends).select("*", "_box.*").drop("_box"), [*by, *boxed]
        copies = probes.select(*one).distinct()
    else:
        boxed, one = {}, [*by, *key]
        limits = {a: (place[a] - box, place[a] + box) for a in "xyz"}
        inside = [F.abs(F.col(a) - place[a]) <= box for a in "xyz"]
        copies = probes.select(*one, "point")
    for i, (low, high) in enumerate(limits.values()):
        copies = copies.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    near = copies.join(own, [*by, "_c0", "_c1", "_c2"]).filter(reduce(lambda p, q: p & q, inside))
    axes = _axes(near, one).filter("n >= 3").select(*one, "axis")
    cosine = F.least(F.lit(1.0), F.abs(g.dot(g.xyz("axis"), g.xyz("direction"))))
    return probes.join(axes, one, "left").withColumn("parent_angle", F.coalesce(F.degrees(F.acos(cosine)), F.lit(90.0))).drop("axis", *boxed)


def _box_end(axis: Column, box: float, end: str) -> Column:
    """First or last whole number at most ``box`` from ``axis``, by the same rounding as that comparison; NULL far off the grid."""
    step, near = (-1, F.ceil(axis - box)) if end == "low" else (1, F.floor(axis + box))
    found = F.when(F.abs(near + step - axis) <= box, near + step).when(F.abs(near - axis) <= box, near).otherwise(near - step)
    return F.when(F.abs(axis) < 2.0**52, found)


def coverage(cells: DataFrame, lengths: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Occupied volume in ml and centre-line length."""
    volume = cells.groupBy(*CASE).agg((F.count("*") * spacing**3 / 1000).alias("volume_ml"))
    return volume.join(lengths, CASE, "left")


def max_projection(cells: DataFrame, axis: str) -> DataFrame:
    others = [a for a in Z if a != axis]
    return cells.groupBy(*CASE, *others).agg(F.max("value").alias("value"), F.bool_or("parent").alias("parent"))


def relocate_root(roots: DataFrame, cells: DataFrame, spacing: float = 1.0, maximum: float = 6.0, task_cells: int | None = None) -> DataFrame:
    """Move each root along supported non-parent cells to the nearest one that touches the parent.

    The walk starts at the contact cells and spreads outwards over faces, at most floor(maximum / spacing)
    steps: every lumen cell learns its nearest contact (ties to the smallest z, y, x) once, and all roots
    then look theirs up. The work depends on the cells only. ``relocated`` is NULL when nothing is near. A case of up to
    ``task_cells`` cells is walked by one task, a larger one in joins.
    """
    by = CASE
    cells = scale.checkpoint(cells.filter(F.col("support") | F.col("parent")).select(
        *by, *Z, (F.col("support") & ~F.col("parent") & ~F.col("excluded")).alias("_lumen"), F.col("parent").alias("_parent")))
    cells = cells.dropna(subset=[*by, *Z])  # they touch nothing
    steps = int(maximum / spacing + 1e-9)
    small, large = scale.split_by_size(cells, by, scale.TASK_GROUP_ROWS if task_cells is None else task_cells)
    found = [_walked_cells(small, steps)]
    if large is not None:
        found.append(_walk_by_joins(scale.checkpoint(large), steps))
    found = scale.checkpoint(reduce(DataFrame.unionByName, found))
    return roots.join(found.select(*by, *Z, "relocated", (F.col("steps") * spacing).alias("walk_mm")), [*by, *Z], "left")


def _walked_cells(cells: DataFrame, steps: int) -> DataFrame:
    """``case_id, z, y, x, relocated, steps`` of the lumen cells reached, for cases that a task can hold.

    Cells travel once, sorted by case; whole cases are walked together, BATCH_CELLS cells or more at a time.
    """
    place = ", ".join(f"{a}: {cells.schema[a].dataType.simpleString()}" for a in Z)
    schema = f"case_id {cells.schema['case_id'].dataType.simpleString()}, {place.replace(':', '')}, relocated struct<{place}>, steps int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_CELLS:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = _first_of_last(rows.column("case_id").combine_chunks())
                if last:
                    yield from _reached(rows.slice(0, last), steps)
                held = rows.slice(last).to_batches()
        if held:
            yield from _reached(pa.Table.from_batches(held).combine_chunks(), steps)

    return cells.repartition(*CASE).sortWithinPartitions(*CASE).mapInArrow(run, schema)


def _first_of_last(cases: pa.Array) -> int:
    """Where the last case of sorted rows begins."""
    codes = cases.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return int(np.argmax(codes == codes[-1]))


def _ranks(*values: np.ndarray) -> np.ndarray:
    """Numbers in the order of ``values``, one apart where only the last value differs and by one, two apart otherwise."""
    order = np.lexsort(values[::-1])
    steps = np.diff(values[-1][order])
    for value in values[:-1]:
        steps = np.where(np.diff(value[order]) != 0, 2, steps)
    found = np.empty(len(order), dtype=np.int64)
    found[order] = np.concatenate(([1], 1 + np.cumsum(np.minimum(steps, 2))))
    return found


def _reached(rows: pa.Table, steps: int) -> Iterator[pa.RecordBatch]:
    """The walk over whole cases: contact cells are step 0, and each further step takes the smallest contact of its neighbours."""
    cases = rows.column("case_id").combine_chunks()
    codes = cases.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    z, y, x = (rows.column(a).to_numpy().astype(np.int64) for a in Z)
    across, along = _ranks(y), _ranks(x)
    wide, deep = along.max() + 2, across.max() + 2
    key = (_ranks(codes, z) * deep + across) * wide + along
    lumen, parent = (rows.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) for c in ("_lumen", "_parent"))
    places, first = np.unique(key[lumen], return_index=True)
    walls = np.unique(key[parent])
    if not len(places) or not len(walls):
        return
    moves = [sign * size for size in (1, wide, wide * deep) for sign in (-1, 1)]

    def at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        where = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[where] == keys, where, -1)

    nearest = np.full(len(places), len(places))
    step_of = np.full(len(places), -1, dtype=np.int32)
    fresh = np.flatnonzero(reduce(np.logical_or, [at(walls, places + m) >= 0 for m in moves]))
    nearest[fresh], step_of[fresh] = fresh, 0
    for step in range(1, steps + 1):
        best = np.full(len(places), len(places))
        for move in moves:
            where = at(places, places[fresh] + move)
            np.minimum.at(best, where[where >= 0], nearest[fresh][where >= 0])
        fresh = np.flatnonzero((best < len(places)) & (step_of < 0))
        if not len(fresh):
            break
        nearest[fresh], step_of[fresh] = best[fresh], step
    seen = np.flatnonzero(step_of >= 0)
    own = np.flatnonzero(lumen)[first]
    here, there = (rows.select(["case_id", *Z]).take(pa.array(own[i])) for i in (seen, nearest[seen]))
    relocated = pa.StructArray.from_arrays([there.column(a).combine_chunks() for a in Z], names=Z)
    found = pa.Table.from_arrays([*(here.column(c) for c in ("case_id", *Z)), relocated, pa.array(step_of[seen])], names=["case_id", *Z, "relocated", "steps"])
    yield from found.combine_chunks().to_batches()


def _walk_by_joins(cells: DataFrame, steps: int) -> DataFrame:
    """The same walk for cases that no task should hold, step by step in joins."""
    by = CASE
    lumen = cells.filter("_lumen").select(*by, *Z)
    turned = {a: f"n{a}" for a in Z}
    pairs = neighbour_pairs(cells, by, 6)
    inside = pairs.join(lumen, [*by, *Z], "left_semi")
    parents = cells.filter("_parent").select(*by, *Z).withColumnsRenamed(turned)
    hops = scale.checkpoint(inside.join(lumen.withColumnsRenamed(turned), [*by, *turned.values()], "left_semi"))
    contact = inside.join(parents, [*by, *turned.values()], "left_semi").select(*by, *Z).distinct()
    seen = scale.checkpoint(contact.select(*by, *Z, F.struct(*Z).alias("relocated"), F.lit(0).alias("steps")))
    frontier = seen
    for step in range(1, steps + 1):
        reached = frontier.join(hops, [*by, *Z]).groupBy(*by, *turned.values()).agg(F.min("relocated").alias("relocated"))
        fresh = reached.select(*by, *[F.col(f"n{a}").alias(a) for a in Z], "relocated", F.lit(step).alias("steps"))
        frontier = scale.checkpoint(fresh.join(seen, [*by, *Z], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def follows_root(branches: DataFrame, roots: DataFrame) -> DataFrame:
    """Branches whose path passes within the radius of the root they were relocated from."""
    joined = branches.join(roots.select("case_id", "root_id", F.col("point").alias("_root"), F.col("radius").alias("_reach")), ["case_id", "root_id"])
    near = g.nearest_on_path(g.xyz("_root"), F.col("path"))["distance"]
    return joined.filter(near <= F.col("_reach")).select(*branches.columns)


def add_recovered(candidates: DataFrame, relocated: DataFrame, cap: int | None = None, broad: float = 1200.0) -> DataFrame:
    """Candidates plus relocated roots: disconnected ones only, not broad, new positions only.

    ``position`` counts existing candidates first, then additions in candidate order; a row beyond ``cap`` (the
    profile's setting, none by default) has the reason ``over_candidate_limit``.
    """
    usable = relocated.filter((F.col("reason") == "disconnected_ostium") & (F.col("volume_mm3") <= broad) & F.col("relocated").isNotNull())
    fresh = usable.select("case_id", "rank", *[F.col(f"relocated.{a}").alias(a) for a in Z], "quality", "volume_mm3")
    first = fresh.groupBy("case_id", *Z).agg(F.min(F.struct("rank", "quality", "volume_mm3")).alias("_f")).select("case_id", *Z, "_f.*")
    new = first.join(candidates.select("case_id", *Z), ["case_id", *Z], "left_anti").withColumn("added", F.lit(True))
    both = candidates.select("case_id", "rank", *Z, "quality", "volume_mm3").withColumn("added", F.lit(False)).unionByName(
        new.select("case_id", "rank", *Z, "quality", "volume_mm3", "added"))
    placed = rank_within(both, ["case_id"], ["added", "rank", *Z], "position")
    beyond = F.col("position") > cap if cap is not None else F.lit(False)
    return placed.withColumn("reason", F.when(beyond, "over_candidate_limit"))

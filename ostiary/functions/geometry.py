"""Column expressions over points, vectors and polylines.

A point is either a struct column with fields x, y, z or a triple of columns. Polylines are
``ARRAY<STRUCT<x,y,z>>`` inside one row, so all path functions here are row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINT = "struct<x:double,y:double,z:double>"
Triple = tuple[Column, Column, Column]


def xyz(point: Column | str) -> Triple:
    point = F.col(point) if isinstance(point, str) else point
    return point["x"], point["y"], point["z"]


def cols(*names: str) -> Triple:
    return tuple(F.col(name) for name in names)  # type: ignore[return-value]


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def subtract(a: Triple, b: Triple) -> Triple:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add_scaled(a: Triple, b: Triple, factor) -> Triple:
    return a[0] + b[0] * factor, a[1] + b[1] * factor, a[2] + b[2] * factor


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Triple, b: Triple) -> Column:
    return norm(subtract(a, b))


def unit(a: Triple) -> Triple:
    """Unit vector; a zero vector stays zero (its length counts as 1)."""
    length = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return a[0] / length, a[1] / length, a[2] / length


def angle_degrees(a: Triple, b: Triple) -> Column:
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(unit(a), unit(b))))
    return F.degrees(F.acos(cosine))


def is_finite(value: Column) -> Column:
    """NaN compares above every number in Spark, so it needs its own test."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def last(items: Column) -> Column:
    # get() rather than try_element_at(): the latter breaks Spark's code generation for non-null arrays.
    return F.get(items, F.size(items) - 1)


def mirror_xy(a: Triple) -> Triple:
    return -a[0], -a[1], a[2]


def segment_projection(p: Triple, a: Triple, b: Triple, floor: float = 1e-12) -> tuple[Column, Column]:
    """(fraction along a→b clamped to [0, 1], distance) of the closest position to ``p``."""
    along = subtract(b, a)
    squared = dot(along, along)
    fraction = F.when(
        squared > floor,
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(subtract(p, a), along), squared))),
    ).otherwise(F.lit(0.0))
    return fraction, distance(p, add_scaled(a, along, fraction))


def path_length(path: Column) -> Column:
    """Total vertex distance, in one pass that carries the previous vertex."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast(POINT).alias("at"))

    def step(state: Column, here: Column) -> Column:
        walked = F.coalesce(distance(xyz(here), xyz(state["at"])), F.lit(0.0))
        return F.struct((state["total"] + walked).alias("total"), here.alias("at"))

    return F.aggregate(path, start, step, lambda state: state["total"])


def arc_lengths(path: Column) -> Column:
    """Cumulative length at every vertex, starting with 0."""
    start = F.struct(F.array().cast("array<double>").alias("arcs"), F.lit(None).cast(POINT).alias("at"))

    def step(state: Column, here: Column) -> Column:
        arc = F.coalesce(last(state["arcs"]) + distance(xyz(here), xyz(state["at"])), F.lit(0.0))
        return F.struct(F.concat(state["arcs"], F.array(arc)).alias("arcs"), here.alias("at"))

    return F.aggregate(path, start, step, lambda state: state["arcs"])


def point_at_arc(path: Column, arcs: Column, length: Column) -> Column:
    """Linear interpolation at arc ``length``; the last vertex when the path is shorter.

    ``arcs`` is the stored result of :func:`arc_lengths`.
    """
    before = F.size(F.filter(arcs, lambda arc: arc < length))
    a, b = F.get(path, before - 1), F.get(path, before)
    start, stop = F.get(arcs, before - 1), F.get(arcs, before)
    ratio = F.try_divide(length - start, stop - start)
    cut = point(*add_scaled(xyz(a), subtract(xyz(b), xyz(a)), ratio))
    return (
        F.when(last(arcs) <= length, last(path))
        .when(before == 0, F.get(path, F.lit(0)))
        .otherwise(cut)
    )


def truncate_path(path: Column, arcs: Column, length: Column) -> Column:
    """Vertices before arc ``length`` plus the point at it; unchanged when the path is not longer."""
    before = F.size(F.filter(arcs, lambda arc: arc < length))
    return F.when(last(arcs) <= length, path).otherwise(
        F.concat(F.slice(path, 1, before), F.array(point_at_arc(path, arcs, length)))
    )


def nearest_on_path(p: Triple, path: Column) -> Column:
    """struct(distance, position) of the closest position on a polyline; position is index + fraction.

    The strict comparison keeps the lowest segment on ties. One vertex gives its distance at position 0;
    an empty path gives NULL. The steps are separate transforms because lambdas do not share
    subexpressions: each step names the values the next one uses more than once.
    """
    count = F.greatest(F.size(path) - 1, F.lit(1))
    starts = F.slice(path, 1, count)
    ends = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    vectors = F.zip_with(starts, ends, lambda a, b: F.struct(
        (F.coalesce(b["x"], a["x"]) - a["x"]).alias("x"), (F.coalesce(b["y"], a["y"]) - a["y"]).alias("y"),
        (F.coalesce(b["z"], a["z"]) - a["z"]).alias("z"),
        (p[0] - a["x"]).alias("px"), (p[1] - a["y"]).alias("py"), (p[2] - a["z"]).alias("pz")))
    fractions = F.transform(vectors, lambda v: F.struct(
        v.alias("v"), F.try_divide(v["px"] * v["x"] + v["py"] * v["y"] + v["pz"] * v["z"],
                                   v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]).alias("t")))
    clamped = F.transform(fractions, lambda f: F.struct(
        f["v"].alias("v"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f["t"])), F.lit(0.0)).alias("t")))
    gaps = F.transform(clamped, lambda f: F.struct(
        (f["v"]["px"] - f["t"] * f["v"]["x"]).alias("x"), (f["v"]["py"] - f["t"] * f["v"]["y"]).alias("y"),
        (f["v"]["pz"] - f["t"] * f["v"]["z"]).alias("z"), f["t"].alias("t")))
    found = F.transform(gaps, lambda d, i: F.struct(
        F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]).alias("distance"), (i + d["t"]).alias("position")))
    return F.when(F.size(path) > 0, F.array_min(found))


def path_chord_angle(path: Column, direction: Triple) -> Column:
    """Angle between the whole-path chord and ``direction``; NULL without a usable chord."""
    chord = subtract(xyz(last(path)), xyz(F.get(path, F.lit(0))))
    return F.when((F.size(path) >= 2), F.when(norm(chord) >= 1e-6, angle_degrees(chord, direction)))


def index_to_physical(index: Triple, origin: Column, spacing: Column, direction: Column) -> Triple:
    """origin + D · diag(spacing) · index, with D row-major in a 9-element array (x, y, z order)."""
    scaled = [index[i] * spacing[i] for i in range(3)]
    return tuple(  # type: ignore[return-value]
        origin[row] + direction[3 * row] * scaled[0] + direction[3 * row + 1] * scaled[1]
        + direction[3 * row + 2] * scaled[2] for row in range(3)
    )


def physical_to_index(position: Triple, origin: Column, spacing: Column, direction: Column) -> Triple:
    """Inverse of :func:`index_to_physical`; D is orthonormal, so its inverse is its transpose."""
    moved = [position[i] - origin[i] for i in range(3)]
    return tuple(  # type: ignore[return-value]
        (direction[axis] * moved[0] + direction[3 + axis] * moved[1] + direction[6 + axis] * moved[2])
        / spacing[axis] for axis in range(3)
    )


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def ring_index(progress: Column, ring_count) -> Column:
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    return round_half_up(clipped * (ring_count - 1))

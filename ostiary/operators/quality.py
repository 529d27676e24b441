"""Data-quality rules. Each returns violations ``(key columns, rule, detail)``; ``raise_on`` makes them strict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ostiary.functions import geometry as g
from ostiary.functions.features import FEATURE_NAMES


def raise_on(violations: DataFrame, shown: int = 5) -> None:
    """Strict mode: fail with a few examples."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{row['rule']}: {row['detail']}" for row in found))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """One output row per broken rule; a rule is a condition that marks a bad row. One pass over the rows."""
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"), (detail if detail is not None else F.concat_ws("/", *[
        F.col(name).cast("string") for name in key])).alias("detail"))


def _vector_bad(name: str) -> Column:
    return ~reduce(lambda a, b: a & b, [g.is_finite(part) for part in g.xyz(name)])


def validate_landmarks(rows: DataFrame, parent: str = "aorta") -> DataFrame:
    """Parent link, three finite numbers per vector, unit direction (0.01), positive radius, unique ids."""
    length = g.norm(g.xyz("direction"))
    single = violations(rows, ["case_id", "instance_id"], {
        "identifier": F.col("instance_id").isNull() | (F.col("instance_id") == parent),
        "parent": F.coalesce(F.col("parent_instance_id") != parent, F.lit(True)),
        "ostium": _vector_bad("ostium"), "seed": _vector_bad("seed"), "direction": _vector_bad("direction"),
        # 0.01 absolute plus 1e-5 relative tolerance.
        "unit_direction": ~(F.abs(length - 1) <= 0.01 + 1e-5),
        "radius": ~(g.is_finite(F.col("radius_mm")) & (F.col("radius_mm") > 0)),
    })
    repeated = rows.groupBy("case_id", "instance_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "case_id", "instance_id", F.lit("duplicate_identifier").alias("rule"),
        F.concat_ws("/", F.col("case_id").cast("string"), "instance_id").alias("detail"))
    return single.unionByName(repeated)


def _close(a: str, b: str, tolerance: float) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda same: same)


def _all_finite(name: str) -> Column:
    return F.forall(name, g.is_finite)


def validate_headers(images: DataFrame, masks: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Image and mask grids must be 3-D, scalar, finite, equal within tolerance, orthonormal, positive."""
    pairs = images.join(masks.select("case_id", *[
        F.col(c).alias(f"m_{c}") for c in ("size", "components", "spacing", "origin", "direction")]), "case_id", "left")
    d = F.col("direction")
    gram = []
    for i in range(3):
        for j in range(3):
            total = sum((F.get(d, F.lit(3 * k + i)) * F.get(d, F.lit(3 * k + j)) for k in range(3)), F.lit(0.0))
            gram.append(F.abs(total - (1.0 if i == j else 0.0)) <= tolerance)
    finite = reduce(lambda a, b: a & b, [_all_finite(c) for c in ("spacing", "origin", "direction", "m_spacing", "m_origin", "m_direction")])
    return violations(pairs, ["case_id"], {
        "mask_missing": F.col("m_size").isNull(),
        "dimension": (F.size("size") != 3) | (F.size("m_size") != 3),
        "components": (F.col("components") != 1) | (F.col("m_components") != 1),
        "size": F.col("size") != F.col("m_size"),
        "finite": ~finite,
        "geometry": ~(_close("spacing", "m_spacing", tolerance) & _close("origin", "m_origin", tolerance)
                      & _close("direction", "m_direction", tolerance)),
        "spacing": F.exists("spacing", lambda s: s <= 0),
        "orthonormal": ~reduce(lambda a, b: a & b, gram),
    })


def validate_cells(cells: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """Finite values, no negative label, at most one positive label per case.

    The smallest and largest positive label stand for the distinct count, so nothing is collected."""
    positive = F.when(F.col(label) > 0, F.col(label))
    cases = cells.groupBy("case_id").agg(
        F.count_if(~g.is_finite(F.col(value).cast("double"))).alias("bad"), F.min(label).alias("least"),
        F.min(positive).alias("first"), F.max(positive).alias("last"))
    return violations(cases, ["case_id"], {
        "finite": F.col("bad") > 0, "negative_label": F.coalesce(F.col("least") < 0, F.lit(False)),
        "multiple_labels": F.coalesce(F.col("first") < F.col("last"), F.lit(False))})


# Settings that may be zero; every other numeric setting must be positive.
MAY_BE_ZERO = [
    "connector_gap_fraction", "minimum_origin_diameter_mm", "wall_hug_penalty", "native_contrast_scale",
    "parallel_clearance_mm",
]


def validate_config(configs: DataFrame) -> DataFrame:
    numeric = [name for name, kind in configs.dtypes if kind in ("double", "int", "bigint")]
    value = {name: F.col(name).cast("double") for name in numeric}
    finite = reduce(lambda a, b: a & b, [g.is_finite(v) for v in value.values()])
    signs = reduce(lambda a, b: a & b, [v >= 0 if n in MAY_BE_ZERO else v > 0 for n, v in value.items()])
    return violations(configs, ["profile"], {
        "finite": ~finite, "positive": ~signs,
        "gap_fraction": ~((value["connector_gap_fraction"] >= 0) & (value["connector_gap_fraction"] < 1)),
        "contrast_fraction": ~((value["support_contrast_fraction"] > 0) & (value["support_contrast_fraction"] <= 1)),
        "shell": ~((value["shell_inner_mm"] < value["shell_outer_mm"]) & (value["shell_outer_mm"] < value["margin_mm"])),
        "lengths": (value["minimum_path_mm"] != 5) | (value["trace_length_mm"] != 10),
    })


def validate_features(rows: DataFrame, key: list[str], vector: str = "features") -> DataFrame:
    return violations(rows, key, {
        "length": F.size(vector) != len(FEATURE_NAMES), "finite": ~F.forall(vector, g.is_finite)})


def validate_split(split: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Exactly three non-empty disjoint partitions that cover exactly the reviewed cases."""
    def out(rows: DataFrame, rule: str, detail: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail"))

    wanted = split.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "partition string")
    present = split.groupBy("partition").count()
    cases = reviewed.select("case_id").distinct()
    repeated = split.groupBy("case_id").count().filter(F.col("count") > 1)
    return (
        out(wanted.join(present, "partition", "left_anti"), "empty_partition", "partition")
        .unionByName(out(present.join(wanted, "partition", "left_anti"), "unknown_partition", "partition"))
        .unionByName(out(repeated, "case_in_two_partitions", "case_id"))
        .unionByName(out(split.join(cases, "case_id", "left_anti"), "case_without_reviews", "case_id"))
        .unionByName(out(cases.join(split, "case_id", "left_anti"), "case_not_in_split", "case_id")))


def validate_threshold(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("a candidate threshold is a number from 0 to 1")


def select_cases(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted cases, wanted ids that are unknown or badly formed)."""
    ids = wanted.select("case_id").distinct()
    well_formed = F.col("case_id").cast("string").rlike(r"\A[A-Za-z0-9_-]+\z")
    known = rows.select("case_id").distinct()
    unknown = ids.filter(~well_formed).unionByName(ids.filter(well_formed).join(known, "case_id", "left_anti"))
    return rows.join(ids.filter(well_formed), "case_id", "left_semi"), unknown


def search_cases(rows: DataFrame, text: str, column: str = "case_id") -> DataFrame:
    """Case-insensitive contains with white space removed from the search text."""
    wanted = "".join(text.split()).lower()
    return rows.filter(F.contains(F.lower(F.col(column).cast("string")), F.lit(wanted)))


def first_failed_gate(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate whose condition holds, else NULL; later gates are not evaluated."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in gates])


def proposal_gates(parallel: bool = False, minimum_radius: float = 0.7, floor: float = 0.06,
                   minimum_path: float = 5.0, minimum_origin: float = 2.0, broad: float = 1200.0) -> list[tuple[str, Column]]:
    """Rejection order of a traced candidate row; broad contacts are dropped before tracing."""
    c = F.col
    # Reason codes.
    gates = [
        ("broad_wall_contact", c("volume_mm3") > broad),
        ("no_supported_5mm_path", c("path_points") == 0), ("short_path", c("path_points") < 3),
        ("disconnected_ostium", ~c("connected")), ("short_proximal_segment", c("path_length_mm") < minimum_path),
        ("wall_hugging_path", c("displacement_mm") < 3.5), ("small_radius", c("radius_mm") < minimum_radius),
        ("wide_nonarterial_region", c("radius_mm") > 8),
        ("origin_below_minimum_diameter", origin_rejected(minimum_origin)),
        ("weak_tubularity", c("mean_vesselness") < floor),
    ]
    if parallel:
        limit = c("median_hu") + 0.1 * F.greatest(c("median_hu") - c("background_hu"), F.lit(1.0))
        gates.append(("hyperdense_wall_structure", c("path_hu") > limit))
    return gates


def origin_rejected(minimum: float) -> Column:
    upper = F.col("origin_diameter_mm") + F.col("native_spacing_mm")
    return F.lit(minimum > 0) & F.coalesce(upper < minimum, F.lit(False))


def origin_eligibility(rows: DataFrame, minimum: float = 2.0) -> DataFrame:
    """Reject openings whose diameter plus one native voxel is below the minimum; warn near it or if unknown."""
    diameter = F.col("origin_diameter_mm")
    return rows.withColumns({
        "rejected": origin_rejected(minimum),
        "origin_warning": F.when(diameter.isNull(), "unresolved").when(diameter < minimum, "near_minimum")})


# Self-check limits.
ANGLE_LIMIT, SEED_LIMIT, RADIUS_LIMITS = 35.0, 1.5, (1.5, 7.0)


def self_check(branches: DataFrame) -> DataFrame:
    """Add ``warnings``: direction against the whole path, seed off the path, radius near its limits.

    Paths live in the row, so the check needs no join.
    """
    angle = g.path_chord_angle(F.col("path"), g.xyz("direction"))
    off = F.coalesce(g.nearest_on_path(g.xyz("seed"), F.col("path"))["distance"], F.lit(float("inf")))
    low, high = RADIUS_LIMITS
    measured = branches.withColumns({"_angle": angle, "_off": off})
    radius = F.col("radius_mm")
    return measured.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("_angle") > ANGLE_LIMIT, "direction_diverges"),
        F.when(F.col("_off") > SEED_LIMIT, "seed_off_path"),
        F.when((radius < low) | (radius > high), "radius_near_limit")))).withColumnsRenamed(
            {"_angle": "chord_angle", "_off": "seed_offset"})

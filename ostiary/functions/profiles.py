"""Named settings as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Default settings.
DEFAULTS: dict[str, float | int] = {
    "spacing_mm": 1.0, "margin_mm": 20.0, "shell_inner_mm": 1.5, "shell_outer_mm": 3.5, "cap_margin_mm": 4.0,
    "minimum_radius_mm": 0.7, "minimum_origin_diameter_mm": 2.0, "minimum_path_mm": 5.0, "trace_length_mm": 10.0,
    "vesselness_floor": 0.06, "maximum_candidates": 160, "shell_vesselness_floor": 0.06,
    "connector_gap_fraction": 0.0, "root_depth_mm": 3.5, "blood_lower_scale": 1.0, "support_contrast_fraction": 0.5,
    "native_contrast_scale": 1.2, "roots_per_contact": 1, "wall_hug_penalty": 0.0, "broad_contact_mm3": 1200.0,
    "parallel_clearance_mm": 0.0,
}
# What the review profile and the benchmark variants change.
REVIEW = {
    "shell_outer_mm": 6.0, "vesselness_floor": 0.03, "shell_vesselness_floor": 0.005, "connector_gap_fraction": 0.35,
    "root_depth_mm": 2.5, "blood_lower_scale": 2.0, "roots_per_contact": 6, "wall_hug_penalty": 0.8,
    "broad_contact_mm3": 1e6, "minimum_origin_diameter_mm": 0.0,
}
PLAIN_CONTRAST = {"support_contrast_fraction": 1.0, "native_contrast_scale": 0.0}
VARIANTS: dict[str, dict[str, float | int]] = {
    "strict": {}, "review": REVIEW, "benchmark-strict": PLAIN_CONTRAST,
    "finer": {"spacing_mm": 0.75, **PLAIN_CONTRAST}, "relaxed": {"blood_lower_scale": 2.0, **PLAIN_CONTRAST},
    "benchmark-review": {**REVIEW, **PLAIN_CONTRAST},
    "partial-volume": {"support_contrast_fraction": 0.5, "native_contrast_scale": 0.0},
    "native-contrast": {"native_contrast_scale": 1.2},
    "wall-parallel": {"native_contrast_scale": 1.2, "parallel_clearance_mm": 2.5},
}
# Settings a review pass takes over from the strict pass it accompanies.
SHARED = [
    "spacing_mm", "margin_mm", "minimum_radius_mm", "minimum_origin_diameter_mm", "parallel_clearance_mm",
    "support_contrast_fraction", "native_contrast_scale",
]


def settings(profile: str, overrides: dict | None = None) -> dict:
    return {**DEFAULTS, **VARIANTS[profile], **(overrides or {})}


def review_settings(strict: dict) -> dict:
    return settings("review", {name: strict[name] for name in SHARED})


def profile_configs(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """One row per profile."""
    names = list(DEFAULTS)
    schema = "profile string, " + ", ".join(
        f"{name} {'int' if isinstance(DEFAULTS[name], int) else 'double'}" for name in names)
    rows = []
    for profile in VARIANTS:
        values = settings(profile, (overrides or {}).get(profile))
        rows.append((profile, *[type(DEFAULTS[name])(values[name]) for name in names]))
    return spark.createDataFrame(rows, schema)

"""Candidate features and logistic scoring as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ostiary.functions import geometry as g

# Feature order of the candidate model.
GEOMETRY_FEATURES = [
    "radius_mm", "mean_vesselness", "evidence_score", "path_length_mm", "seed_distance_mm", "tortuosity",
]
CONTEXT_FEATURES = [
    "path_hu_relative", "bone_distance_mm", "parent_angle_degrees", "arc_position",
    "native_spacing_mm", "connector_gap", "candidate_volume_mm3",
]
FEATURE_NAMES = GEOMETRY_FEATURES + CONTEXT_FEATURES


@dataclass
class LogisticModel:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    threshold: float = 0.5
    split: dict[str, list[str]] = field(default_factory=dict)


def evidence_score(vesselness: Column, displacement: Column, length: Column, gap: Column) -> Column:
    one = F.lit(1.0)
    mixed = (
        F.least(vesselness / 0.5, one) * 0.4 + F.least(displacement / 5, one) * 0.35
        + F.least(length / 10, one) * 0.25
    )
    return F.greatest(F.lit(0.0), F.least(one, mixed * (1 - gap)))


def context_features(
    hu_along: Column, median: Column, background: Column, bone: Column, projection: Column,
    axis_low: Column, axis_high: Column,
) -> dict[str, Column]:
    """Relative path intensity, bone distance up to 50 mm, and position along the parent axis in [0, 1]."""
    span = F.greatest(axis_high - axis_low, F.lit(1e-6))
    return {
        "path_hu_relative": (hu_along - background) / F.greatest(median - background, F.lit(1.0)),
        "bone_distance_mm": F.least(bone, F.lit(50.0)),
        "arc_position": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (projection - axis_low) / span)),
    }


def with_feature_vector(branches: DataFrame, name: str = "vector") -> DataFrame:
    """Add the 13 doubles in FEATURE_NAMES order; a missing context key gives a NULL element, which the
    feature rule reports. The path length is its own projection because two features use it."""
    measured = branches.withColumn("_length", g.path_length(F.col("path")))
    chord = g.distance(g.xyz(g.last(F.col("path"))), g.xyz(F.get("path", F.lit(0))))
    geometry = [
        F.col("radius_mm"), F.col("mean_vesselness"), F.col("evidence_score"), F.col("_length"),
        g.distance(g.xyz("seed"), g.xyz("ostium")), F.col("_length") / F.greatest(chord, F.lit(0.001)),
    ]
    context = [F.col("features")[key] for key in CONTEXT_FEATURES]
    return measured.withColumn(name, F.array(*geometry, *context)).drop("_length")


def logistic_score(vector: Column, model: LogisticModel) -> Column:
    """Sigmoid of the standardised features; the model is a constant of the plan, so nothing is joined."""
    total = F.lit(float(model.bias))
    for i, (mean, scale, weight) in enumerate(zip(model.mean, model.scale, model.weights)):
        total = total + (F.get(vector, F.lit(i)) - mean) / scale * weight
    return 1 / (1 + F.exp(-total))

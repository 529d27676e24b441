"""Score-before-merge: score strict and review proposals, drop weak ones, merge the rest in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ostiary import scale
from ostiary.functions.features import FEATURE_NAMES, LogisticModel, logistic_score, with_feature_vector
from ostiary.functions.geometry import is_finite
from ostiary.operators.quality import raise_on, validate_threshold, violations
from ostiary.operators.suppress import suppress

MERGE_DISTANCE_MM = 3.0


def union_profiles(strict: DataFrame, review: DataFrame, order: str = "ord") -> DataFrame:
    """Strict rows first, then review rows; ``merge_rank`` is unique inside a case.

    The profile decides the high part of the rank, so no window over the case is needed.
    """
    def tagged(rows: DataFrame, profile: str, high: int) -> DataFrame:
        rank = F.lit(high * 2**40).cast("bigint") + F.col(order)
        return rows.withColumn("profile", F.lit(profile)).withColumn("merge_rank", rank)

    return tagged(strict, "strict", 0).unionByName(tagged(review, "review", 1))


def score_candidates(branches: DataFrame, model: LogisticModel) -> DataFrame:
    """Add ``score``; NULL when a feature is missing or not finite, which is never the same as a low score."""
    vectors = with_feature_vector(branches, "_vector")
    usable = (F.size("_vector") == len(FEATURE_NAMES)) & F.forall("_vector", is_finite)
    return scale.computed_once(vectors, "score", F.when(usable, logistic_score(F.col("_vector"), model))).drop("_vector")


def require_features(scored: DataFrame) -> None:
    """Raise with the first few candidates whose features cannot be scored."""
    raise_on(violations(scored, ["case_id"], {"invalid_features": F.col("score").isNull()}, F.col("instance_id").cast("string")))


def threshold_filter(scored: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Candidates scored ``threshold`` or more. Those without a score are left out, or with ``strict`` an error."""
    validate_threshold(threshold)
    if strict:
        require_features(scored)
    return scored.filter(F.col("score") >= threshold)


def score_before_merge(
    strict: DataFrame, review: DataFrame, model: LogisticModel, threshold: float | None = None, order: str = "ord",
    require: bool = False,
) -> DataFrame:
    """Decision log: every proposal with its score, decision, suppressor and output id.

    A proposal whose features are missing or not finite is ``invalid_features``; with ``require`` it is an error.
    """
    limit = model.threshold if threshold is None else threshold
    validate_threshold(limit)
    proposals = union_profiles(strict, review, order)
    scored = score_candidates(proposals, model)
    if require:
        require_features(scored)
    needed = scored.select(
        "case_id", "instance_id", "profile", "merge_rank", "ostium", "seed", "direction", "radius_mm", "score",
    )
    log = suppress(needed, ["case_id"], "merge_rank", "ostium", MERGE_DISTANCE_MM, F.col("score") >= limit, sized=proposals)
    log = log.withColumn("decision", F.when(F.col("score").isNull(), "invalid_features").otherwise(F.col("decision")))
    return log.withColumn("output_instance_id", branch_id("output_no")).withColumn(
        "suppressor_instance_id", branch_id("suppressor_no"))


def branch_id(number: str):
    return F.when(F.col(number).isNotNull(), F.format_string("branch_%03d", F.col(number)))


def retained(log: DataFrame) -> DataFrame:
    """Output branches under their new ids."""
    return log.filter(F.col("decision") == "retained").select(
        "case_id", F.col("output_instance_id").alias("instance_id"), "ostium", "seed", "direction", "radius_mm", "score",
    )


def strict_only(strict: DataFrame, model: LogisticModel | None = None, threshold: float | None = None) -> DataFrame:
    """The classical mode: strict proposals, optionally filtered by a model; nothing is merged."""
    if model is None and threshold is not None:
        raise ValueError("a threshold needs a model to score with")
    return strict if model is None else threshold_filter(
        score_candidates(strict, model), model.threshold if threshold is None else threshold)

"""Human review records: upsert, conflicts, status and reconciliation after a re-run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ostiary import scale
from ostiary.functions.features import FEATURE_NAMES
from ostiary.operators import spatial
from ostiary.operators.ordering import rank_within

KEY = ["case_id", "instance_id"]
# Fixed value: marker of review files.
SCOPE = "candidate_reviews_only"


def fingerprint(vector: str = "vector") -> Column:
    """Digest of a branch's geometry and features; it changes whenever any of them changes."""
    return F.sha2(F.to_json(F.struct("ostium", "seed", "direction", "radius_mm", vector)), 256)


def upsert_reviews(events: DataFrame) -> DataFrame:
    """Latest label per case and instance; a latest ``unreviewed`` removes the review."""
    rest = [name for name in events.columns if name not in KEY]
    latest = events.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("reviewed_at", "event_id")).alias("last"))
    return latest.select(*KEY, "last.*").filter(F.col("label") != "unreviewed")


def dedupe_reviews(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique rows, conflicts): equal duplicates collapse, keys with differing rows are conflicts.

    The smallest and largest row digest are compared, so a key repeated very often stays two values.
    """
    rest = [name for name in rows.columns if name not in KEY]
    digest = F.sha2(F.to_json(F.struct(*rest)), 256)
    grouped = rows.withColumn("_digest", digest).groupBy(*KEY).agg(
        F.min("_digest").alias("_low"), F.max("_digest").alias("_high"),
        F.min_by(F.struct(*rest), "_digest").alias("_row"), F.count("*").alias("copies"))
    agreed = F.col("_low") == F.col("_high")
    return grouped.filter(agreed).select(*KEY, "_row.*"), grouped.filter(~agreed).select(*KEY, "copies")


def review_status(branches: DataFrame, reviews: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Label of the review with the same fingerprint, else ``unreviewed``.

    Cases of up to CASE_ROWS rows in both tables meet by the case alone, so rows that already lie by case are not shuffled;
    the others meet by all keys. ``sized``, a table with at least as many rows of each case, is counted in place of both.
    """
    known = reviews.select(*KEY, "fingerprint", F.col("label").alias("status"))
    rest = [name for name in branches.columns if name not in (*KEY, "fingerprint")]
    (few, few_known), (many, many_known) = scale.small_cases(branches, known, ["case_id"], spatial.CASE_ROWS, sized)
    found = []
    if few is not None:
        listed = few_known.groupBy("case_id").agg(F.collect_list(F.struct("instance_id", "fingerprint", "status")).alias("_known"))
        same = F.filter("_known", lambda r: (r["instance_id"] == F.col("instance_id")) & (r["fingerprint"] == F.col("fingerprint")))
        found.append(few.join(listed, "case_id", "left").select(*KEY, "fingerprint", *rest, F.explode_outer(same["status"]).alias("status")))
    if many is not None:
        found.append(many.join(many_known, [*KEY, "fingerprint"], "left").select(*KEY, "fingerprint", *rest, "status"))
    return reduce(DataFrame.unionByName, found).withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def reconcile_reviews(reviews: DataFrame, branches: DataFrame, rerun_cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) reviews: in re-run cases only those whose branch still exists unchanged are kept."""
    current = branches.select(*KEY, "fingerprint").distinct()
    affected = reviews.join(rerun_cases.select("case_id").distinct(), "case_id", "left_semi")
    removed = affected.join(current, [*KEY, "fingerprint"], "left_anti")
    kept = reviews.join(rerun_cases.select("case_id").distinct(), "case_id", "left_anti").unionByName(
        affected.join(current, [*KEY, "fingerprint"], "left_semi").select(*reviews.columns))
    return kept, removed


def review_progress(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("case_id").agg(
        F.count_if(F.col("status") != "unreviewed").alias("reviewed"), F.count("*").alias("total"),
        F.count_if(F.size("warnings") > 0).alias("flagged"))


def by_review_status(statuses: DataFrame, status: str) -> DataFrame:
    return statuses if status == "all" else statuses.filter(F.col("status") == status)


def next_unreviewed(statuses: DataFrame, current: DataFrame, order: str = "ord") -> DataFrame:
    """First unreviewed row after the current one in its case, wrapping round to the start."""
    waiting = statuses.filter(F.col("status") == "unreviewed").join(
        current.select("case_id", F.col(order).alias("_at")), "case_id")
    wrapped = F.struct((F.col(order) <= F.col("_at")).alias("wrapped"), F.col(order))
    return waiting.groupBy("case_id").agg(F.min(wrapped).alias("_next")).select(
        "case_id", F.col(f"_next.{order}").alias(f"next_{order}"))


def export_reviews(reviews: DataFrame, records_per_envelope: int = 100_000) -> DataFrame:
    """JSON envelopes of a case's review records, ``records_per_envelope`` in each; ``part`` numbers them from 0."""
    ranked = rank_within(reviews, ["case_id"], [F.col("instance_id")], "_n")
    parts = ranked.withColumn("part", F.floor((F.col("_n") - 1) / records_per_envelope)).drop("_n")
    records = F.sort_array(F.collect_list(F.struct(*KEY, *[n for n in reviews.columns if n not in KEY])))
    return parts.groupBy("case_id", "part").agg(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.array(*map(F.lit, FEATURE_NAMES)).alias("feature_names"),
        F.lit(SCOPE).alias("scope"), records.alias("records"))).alias("envelope"))

"""A batch of cases in which a broken case is a row with an error text and never stops the others, and what a run leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ostiary import scale
from ostiary.functions.features import LogisticModel
from ostiary.operators import resolve as rs
from ostiary.operators.quality import validate_headers
from ostiary.plans import workflow as w

UNCALIBRATED = "Scores of the score-before-merge workflow are not calibrated."
STRICT_ONLY = "Only the strict profile proposed this branch."


def case_faults(scanned: DataFrame, images: DataFrame, masks: DataFrame, scored: DataFrame) -> DataFrame:
    """``case_id, error``: the first thing that is wrong with each broken case, in the order in which a run meets it.

    Files, then a header that could not be read, then header rules, then candidates that cannot be scored. ``scanned``
    has one row per case (:func:`ostiary.sources.files.scan_cases`), headers have a row per readable file, and ``scored``
    a row per candidate with its ``score``.
    """
    good = scanned.filter("status = 'ok'").select("case_id")
    files = scanned.filter("status <> 'ok'").select("case_id", F.lit(1).alias("step"), F.concat(F.lit("files: "), "error").alias("error"))
    unread = [good.join(side.select("case_id"), "case_id", "left_anti").select("case_id", F.lit(2).alias("step"), F.lit(f"{name}: no readable header").alias("error"))
              for name, side in (("scan", images), ("mask", masks))]
    rules = validate_headers(images.join(good, "case_id", "left_semi"), masks).filter("rule <> 'mask_missing'")
    headers = rules.groupBy("case_id").agg(F.lit(3).alias("step"), F.concat(F.lit("header: "), F.array_join(F.sort_array(F.collect_set("rule")), ", ")).alias("error"))
    unscored = scored.filter("score IS NULL").groupBy("case_id").agg(F.lit(4).alias("step"), F.concat(
        F.lit("features: "), F.count("*").cast("string"), F.lit(" without a score, first "), F.min("instance_id")).alias("error"))
    faults = reduce(DataFrame.unionByName, [files, *unread, headers, unscored])
    return faults.groupBy("case_id").agg(F.min(F.struct("step", "error"))["error"].alias("error"))


def run_batch(
    scanned: DataFrame, images: DataFrame, masks: DataFrame, strict: DataFrame, review: DataFrame, model: LogisticModel,
    runs: DataFrame, threshold: float | None = None,
) -> dict[str, DataFrame]:
    """Score before merge over all cases that are whole.

    ``cases``: one row per case with ``status``, ``error``, the number of ``branches`` and its times; a failed case has
    neither. ``log`` and ``branches`` hold whole cases only, ``totals`` counts cases and failures. ``runs`` has
    ``case_id, detection_s, end_to_end_s``. Candidates of cases that were not scanned take no part.
    """
    scored = w.score_candidates(w.union_profiles(strict, review), model)
    faults = scale.checkpoint(case_faults(scanned, images, masks, scored))
    whole = scale.checkpoint(scanned.select("case_id").distinct().join(faults, "case_id", "left_anti"))
    log = scale.checkpoint(w.score_before_merge(*(rows.join(whole, "case_id", "left_semi") for rows in (strict, review)), model, threshold))
    branches = w.retained(log)
    counts = branches.groupBy("case_id").agg(F.count("*").alias("branches"))
    failed = F.col("error").isNotNull()
    cases = scanned.select("case_id").distinct().join(faults, "case_id", "left").join(counts, "case_id", "left").join(
        runs.select("case_id", "detection_s", "end_to_end_s"), "case_id", "left").select(
        "case_id", F.when(failed, "failed").otherwise("ok").alias("status"), "error",
        F.when(~failed, F.coalesce("branches", F.lit(0))).alias("branches"), F.when(~failed, F.col("detection_s")).alias("detection_s"),
        F.when(~failed, F.col("end_to_end_s")).alias("end_to_end_s"))
    cases = scale.checkpoint(cases)
    totals = cases.agg(F.count("*").alias("cases"), F.count_if(F.expr("status = 'failed'")).alias("failures"), F.count_if(F.expr("status = 'ok'")).alias("ok"))
    return {"cases": cases, "log": log, "branches": branches, "totals": totals}


def run_records(log: DataFrame, profile_runs: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per case of what its run leaves: timings, blood model, roots, rejections, distinct warnings, profiles.

    ``profile_runs``: ``case_id, profile, total_s, end_s, blood, roots, proposals, rejections, warnings`` for each of the
    two passes; ``configs``: one row of settings per profile. Warnings keep the order of their first appearance, strict
    first. ``rejections`` counts what scoring and merging left out.
    """
    settings = F.struct(*[c for c in configs.columns if c != "profile"]).alias("config")
    named = profile_runs.join(F.broadcast(configs.select("profile", settings)), "profile")  # a handful of profiles
    entry = F.struct("config", F.col("blood").alias("blood_model"), F.col("roots").alias("candidate_roots"), "proposals", "rejections")

    def of(profile: str, value: str) -> Column:
        return F.max(F.when(F.col("profile") == profile, F.col(value)))

    def list_of(profile: str) -> Column:
        return F.flatten(F.collect_list(F.when(F.col("profile") == profile, F.col("warnings"))))

    per_case = named.groupBy("case_id").agg(
        of("strict", "total_s").alias("strict_s"), of("review", "total_s").alias("review_s"), F.max("end_s").alias("total_s"),
        F.first(F.when(F.col("profile") == "strict", F.col("blood")), True).alias("blood_model"), F.sum("roots").alias("candidates"),
        F.array_distinct(F.concat(list_of("strict"), list_of("review"), F.array(F.lit(UNCALIBRATED)))).alias("warnings"),
        F.map_from_entries(F.collect_list(F.struct("profile", entry))).alias("profiles"))  # two entries
    decided = log.groupBy("case_id").agg(F.count_if(F.expr("decision = 'below_threshold'")).alias("_below"), F.count_if(F.expr("decision = 'merged'")).alias("_merged"))
    counted = per_case.join(decided, "case_id", "left")
    return counted.select(
        "case_id", F.struct("strict_s", "review_s", "total_s").alias("timings"), "blood_model", "candidates",
        F.create_map(F.lit("learned_candidate_filter"), F.coalesce("_below", F.lit(0)), F.lit("merged_after_scoring"), F.coalesce("_merged", F.lit(0))).alias("rejections"),
        "warnings", "profiles")


def candidate_pool(review: DataFrame, strict: DataFrame, by: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """(branches, counts): the review pool with the strict branches that it lacks, under new ids in z, y, x order.

    ``source_id`` keeps a branch's own id. An added branch says so in ``warnings``; ``counts`` has the cases' number of
    branches and of added ones (``strict_only_added``). Counts need no numbers, so either table is made without the other.
    """
    pool = rs.pool_union(review, strict, by, rank)
    told = pool.withColumn("warnings", F.when(F.col("added"), F.array_append("warnings", F.lit(STRICT_ONLY))).otherwise(F.col("warnings")))
    proposals = review.select(*by).unionByName(strict.select(*by))  # the pool has no other rows
    large = scale.has_large_group(proposals, by, scale.TASK_GROUP_ROWS)
    numbered = rs.renumber(told.withColumn("source_id", F.col("instance_id")), by, ["added", rank], large)
    return numbered, pool.groupBy(*by).agg(F.count("*").alias("branches"), F.count_if("added").alias("strict_only_added"))

"""Detection metrics per case and over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.operators.matching import match_one_to_one
from ostiary.operators.ordering import exact_percentiles, join_all

ERRORS = ["ostium_error_mm", "seed_error_mm", "radius_error_mm", "direction_error_degrees"]


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Case and summary convention: no denominator gives NULL, also for f1."""
    return {
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def case_confusion(
    cases: DataFrame, predictions: DataFrame, references: DataFrame, matches: DataFrame,
    tolerances: list[float],
) -> DataFrame:
    """One row per case and tolerance, also for cases without any landmark."""
    grid = cases.select("*", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance_mm"))
    counts = predictions.select("case_id", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        references.select("case_id", F.lit(0).alias("p"), F.lit(1).alias("r"))
    ).groupBy("case_id").agg(F.sum("p").alias("predicted"), F.sum("r").alias("reference"))
    hits = matches.groupBy("case_id", "tolerance_mm").agg(F.count("*").alias("tp"))
    joined = grid.join(counts, "case_id", "left").join(hits, ["case_id", "tolerance_mm"], "left").na.fill(
        0, ["predicted", "reference", "tp"])
    fp, fn = F.col("predicted") - F.col("tp"), F.col("reference") - F.col("tp")
    rows = joined.withColumns({"fp": fp, "fn": fn})
    return rows.withColumns({
        "signed_error": F.col("fp") - F.col("fn"), "absolute_error": F.abs(F.col("fp") - F.col("fn")),
        **ratios(F.col("tp"), F.col("fp"), F.col("fn")),
    })


def totals() -> list[Column]:
    """Micro totals, count errors and negative controls as one set of partial aggregates."""
    fp, fn = F.col("fp"), F.col("fn")
    empty = F.col("tp") + fn == 0
    return [
        F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(F.abs(fp - fn)).alias("count_mae"), F.count_if(fp == fn).alias("exact_count_cases"),
        F.count_if(fp > fn).alias("overcount_cases"), F.count_if(fp < fn).alias("undercount_cases"),
        F.count_if(empty).alias("negative_cases"), F.count_if(empty & (fp > 0)).alias("negative_cases_with_fp"),
        F.coalesce(F.sum(F.when(empty, fp)), F.lit(0)).alias("negative_fp"),
    ]


def with_ratios(summary: DataFrame) -> DataFrame:
    return summary.withColumns(ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def summarize(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro-averaged summary: sums over cases first, ratios after, never a mean of case ratios."""
    return with_ratios(metrics.groupBy(*(by or [])).agg(*totals()))


def summarize_by(metrics: DataFrame, group: str) -> DataFrame:
    """Summary per group plus the overall row (``scope`` tells them apart) from one pass.

    Rows without a group count in the overall row only.
    """
    sets = metrics.groupingSets([[group], []], group).agg(F.grouping(group).alias("_all"), *totals())
    scoped = sets.filter((F.col("_all") == 1) | F.col(group).isNotNull()).withColumn(
        "scope", F.when(F.col("_all") == 1, "overall").otherwise("group")).drop("_all")
    return with_ratios(scoped)


def error_stats(
    matches: DataFrame, by: list[str] | None = None, errors: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Mean, median and p95 of the matched errors; NULL errors (unknown radii) are left out.

    One aggregate when every group fits a task; otherwise the written matches are ranked once per error.
    """
    by = by or []
    errors = errors or ERRORS
    limit = limit or scale.TASK_GROUP_ROWS
    matches = scale.checkpoint(matches.select(*by, *errors))
    plain = [F.count("*").alias("matches"), *[F.avg(e).alias(f"{e}_mean") for e in errors]]
    if not scale.has_large_group(matches, by, limit):
        for e in errors:
            plain += [F.percentile(e, 0.5).alias(f"{e}_median"), F.percentile(e, 0.95).alias(f"{e}_p95")]
        return matches.groupBy(*by).agg(*plain)
    frames = [matches.groupBy(*by).agg(*plain)] + [
        exact_percentiles(matches, by, e, {f"{e}_median": 0.5, f"{e}_p95": 0.95}, limit, large=True) for e in errors]
    return join_all(frames, by)


def mask_unknown_radii(matches: DataFrame, references: DataFrame) -> DataFrame:
    """Radius error becomes NULL where the reference radius is not known."""
    known = references.select("case_id", F.col("instance_id").alias("reference_id"), "radius_known")
    return matches.join(known, ["case_id", "reference_id"], "left").withColumn(
        "radius_error_mm", F.when(F.col("radius_known"), F.col("radius_error_mm"))).drop("radius_known")


def mirror(rows: DataFrame) -> DataFrame:
    """Negate x and y of ostium, seed and direction."""
    return rows.withColumns({
        name: g.point(*g.mirror_xy(g.xyz(name))) for name in ("ostium", "seed", "direction")
    })


def mirror_check(
    cases: DataFrame, predictions: DataFrame, references: DataFrame, matches: DataFrame, tolerance: float,
) -> DataFrame:
    """Per case: matches as given and with x and y mirrored; suspected if mirroring gains more than one."""
    flipped = match_one_to_one(mirror(predictions), references, [tolerance])
    gained = flipped.groupBy("case_id").agg(F.count("*").alias("mirror_tp"))
    plain = matches.filter(F.col("tolerance_mm") == tolerance).groupBy("case_id").agg(F.count("*").alias("tp"))
    joined = cases.select("case_id").join(plain, "case_id", "left").join(gained, "case_id", "left").na.fill(
        0, ["tp", "mirror_tp"])
    return joined.withColumn("mirror_suspected", F.col("mirror_tp") > F.col("tp") + 1)


def label_sources(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce("labeller", F.lit("unspecified")).alias("labeller")).agg(F.count("*").alias("n"))


def runtime_stats(runs: DataFrame) -> DataFrame:
    total = F.col("total_s") + F.coalesce("filter_s", F.lit(0.0))
    return runs.agg(F.avg(total).alias("mean_runtime_s"), F.max(total).alias("max_runtime_s"))


def batch_report(runs: DataFrame) -> DataFrame:
    """Totals of a batch in which failed cases carry status ``failed`` and an error text."""
    return runs.agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "failed").alias("failures"),
                    F.count_if(F.col("status") == "ok").alias("ok"))


def rejection_histogram(roots: DataFrame) -> DataFrame:
    """Map reason → count per case; reasons are few, so the map stays small."""
    counted = roots.filter(F.col("reason").isNotNull()).groupBy("case_id", "reason").agg(F.count("*").alias("n"))
    return counted.groupBy("case_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejections"))


def profile_summary(proposals: DataFrame) -> DataFrame:
    """Roots, proposals and rejections per case and profile; a proposal is a root without a reason."""
    return proposals.groupBy("case_id", "profile").agg(
        F.count("*").alias("roots"), F.count_if(F.col("reason").isNull()).alias("proposals"),
        F.count("reason").alias("rejections"))

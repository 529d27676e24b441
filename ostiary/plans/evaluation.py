"""Evaluation reports built from one matching pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame, functions as F

from ostiary import scale
from ostiary.functions.features import LogisticModel
from ostiary.operators import metrics as m
from ostiary.operators.matching import check_tolerances, match_one_to_one, missing_predictions
from ostiary.operators.quality import raise_on
from ostiary.plans.workflow import score_candidates, threshold_filter

TOLERANCES_MM = [2.0, 3.0, 5.0]


class Tables(Mapping):
    """Tables of a report by name. Each is made when it is first asked for, by the steps that it needs, which tables share."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]):
        self._made = {name: cache(make) for name, make in made.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._made[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def evaluate(cases: DataFrame, predictions: DataFrame, references: DataFrame, tolerances: list[float]) -> tuple[DataFrame, DataFrame]:
    """(case metrics, matches) per tolerance."""
    matches = match_one_to_one(predictions, references, tolerances)
    return m.case_confusion(cases, predictions, references, matches, tolerances), matches


def tolerance_report(
    cases: DataFrame, predictions: DataFrame, references: DataFrame, tolerances: list[float] | None = None,
) -> DataFrame:
    """Summary, negative controls and matched-error statistics per tolerance."""
    tolerances = tolerances or TOLERANCES_MM
    matches = scale.checkpoint(match_one_to_one(predictions, references, tolerances))  # read by counts and errors
    per_case = m.case_confusion(cases, predictions, references, matches, tolerances)
    stats = m.error_stats(matches, ["tolerance_mm"]).drop("matches")
    return m.summarize(per_case, ["tolerance_mm"]).join(stats, "tolerance_mm", "left")


def scoring_report(
    reference_cases: DataFrame, predicted_cases: DataFrame, predictions: DataFrame, references: DataFrame, tolerances: list[float] | None = None,
) -> Tables:
    """The whole report on a set of prediction records, as tables.

    ``missing``: reference cases without a prediction record; they are listed and count nowhere else. ``cases``: one row
    per remaining case and tolerance, with what mirroring x and y would match at the largest tolerance. ``matches``: the
    pairs behind them. ``summary``: totals and matched-error statistics per tolerance. ``mirror``: one row with the number
    of cases that match better mirrored, and whether there is any. ``notes``: what normalising the references changed, if
    they carry ``notes``.

    A reference without ``radius_known`` has a placeholder radius: it has no radius error, in matches and statistics.
    """
    tolerances = tolerances or TOLERANCES_MM
    scored = scale.checkpoint(reference_cases.join(predicted_cases.select("case_id").distinct(), "case_id", "left_semi"))
    own = predictions.join(scored.select("case_id"), "case_id", "left_semi")
    truth = references.join(scored.select("case_id"), "case_id", "left_semi")
    check_tolerances(tolerances)
    widest = float(max(tolerances))

    @cache
    def matches() -> DataFrame:
        found = match_one_to_one(own, truth, tolerances)
        return scale.checkpoint(m.mask_unknown_radii(found, truth) if "radius_known" in references.columns else found)

    @cache
    def confusion() -> DataFrame:
        return m.case_confusion(scored, own, truth, matches(), tolerances)

    def cases() -> DataFrame:
        checks = m.mirror_check(scored, own, truth, matches(), widest)
        return scale.checkpoint(confusion().join(checks.select("case_id", "mirror_tp", "mirror_suspected"), "case_id"))

    def summary() -> DataFrame:
        stats = m.error_stats(matches(), ["tolerance_mm"]).drop("matches")
        return m.summarize(confusion(), ["tolerance_mm"]).join(stats, "tolerance_mm", "left")

    def mirrored() -> DataFrame:
        checks = m.mirror_check(scored, own, truth, match_one_to_one(own, truth, [widest]), widest)
        return checks.agg(F.count_if("mirror_suspected").alias("mirrored_cases"),
                          F.coalesce(F.bool_or("mirror_suspected"), F.lit(False)).alias("mirror_suspected"))

    report = {"missing": lambda: missing_predictions(reference_cases, predicted_cases), "cases": cases, "matches": matches,
              "summary": summary, "mirror": mirrored}
    if "notes" in references.columns:
        report["notes"] = lambda: reference_notes(references)
    return Tables(report)


def reference_notes(references: DataFrame) -> DataFrame:
    """``case_id, note`` of everything that normalisation changed, each once."""
    return references.select("case_id", F.explode("notes").alias("note")).distinct()


def evaluate_bundle(
    branches: DataFrame, references: DataFrame, manifest: DataFrame, model: LogisticModel, tolerance: float,
) -> DataFrame:
    """Filtered and unfiltered predictions against the references, per family and overall."""
    frames = []
    scored = score_candidates(branches, model)
    for variant, rows in (("unfiltered", branches), ("filtered", threshold_filter(scored, model.threshold))):
        per_case, _ = evaluate(manifest, rows, references, [tolerance])
        frames.append(m.summarize_by(per_case, "family").withColumn("variant", F.lit(variant)))
    return frames[0].unionByName(frames[1])


def benchmark_report(
    files: DataFrame, manifest: DataFrame, manifest_files: DataFrame, branches: DataFrame, references: DataFrame, runs: DataFrame,
    model: LogisticModel, split: DataFrame, tolerance: float, sensitivity: list[float] | None = None,
) -> Tables:
    """The whole benchmark over a dataset whose files are first checked against their digests: a difference is an error.

    ``files`` and ``manifest_files`` have ``path, sha256``, ``manifest`` ``case_id, family``, ``runs`` ``case_id, total_s,
    filter_s``, ``split`` ``partition, case_id``. Tables: ``cases`` with family and runtime; ``summary`` of the filtered and
    ``unfiltered`` predictions, per family too; ``sensitivity`` of the filtered ones to the tolerance; ``overlap`` of the
    model's split with the dataset; ``runtime``.
    """
    broken = manifest_files.select("path", F.col("sha256").alias("stated")).join(files.select("path", "sha256"), "path", "left").filter(
        F.col("sha256").isNull() | (F.col("sha256") != F.col("stated")))
    raise_on(broken.select(F.lit("integrity").alias("rule"), F.col("path").alias("detail")))
    sensitivity = sensitivity or TOLERANCES_MM
    asked = sorted({float(tolerance), *map(float, sensitivity)})
    check_tolerances(asked)

    @cache
    def scored() -> DataFrame:
        return scale.checkpoint(score_candidates(branches, model))

    @cache
    def per_tolerance() -> DataFrame:
        return scale.checkpoint(evaluate(manifest, threshold_filter(scored(), model.threshold), references, asked)[0])

    @cache
    def chosen() -> DataFrame:
        return per_tolerance().filter(F.col("tolerance_mm") == float(tolerance))

    def cases() -> DataFrame:
        runtime = F.col("total_s") + F.coalesce("filter_s", F.lit(0.0))
        return chosen().join(runs.select("case_id", runtime.alias("runtime_s")), "case_id", "left")

    def summary() -> DataFrame:
        plain, _ = evaluate(manifest, branches, references, [tolerance])
        variants = [m.summarize_by(rows, "family").withColumn("variant", F.lit(name)) for name, rows in (("filtered", chosen()), ("unfiltered", plain))]
        return variants[0].unionByName(variants[1])

    return Tables({
        "cases": cases, "summary": summary,
        "sensitivity": lambda: m.summarize(per_tolerance().filter(F.col("tolerance_mm").isin([float(t) for t in sensitivity])), ["tolerance_mm"]),
        "overlap": lambda: dataset_overlap(split, manifest), "runtime": lambda: m.runtime_stats(runs.join(manifest.select("case_id"), "case_id", "left_semi")),
    })


def dataset_overlap(split: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated cases that the model's split already contains, one row per partition and case."""
    return split.join(evaluated.select("case_id").distinct(), "case_id").select("partition", "case_id").distinct()

"""Candidate classifier: split, standardise, fit, choose a threshold, report."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ostiary.functions.features import FEATURE_NAMES, LogisticModel, logistic_score
from ostiary.operators.ordering import rank_within, running_totals

PARTITIONS = ["train", "validation", "test"]


def split_cases(
    rows: DataFrame, seed: int, test: list | None = None, validation: list | None = None,
) -> DataFrame:
    """``case_id, partition``: a fifth of the cases for test, as many for validation, the rest for training.

    The order is a digest of case and seed, so it does not depend on row order. Explicit lists win.
    """
    test, validation = list(test or []), list(validation or [])
    if set(test) & set(validation) or len({*test, *validation}) != len(test) + len(validation):
        raise ValueError("A case cannot be chosen twice.")
    cases = rows.select("case_id").distinct()
    total = cases.count()
    if total < 6:
        raise ValueError("A three-way split needs at least six cases.")
    chosen = [*test, *validation]
    if chosen and cases.filter(F.col("case_id").isin(chosen)).count() != len(chosen):
        raise ValueError("every case chosen for a part of the split needs reviews")
    holdout = max(1, total // 5)
    digest = F.md5(F.concat_ws(":", F.col("case_id").cast("string"), F.lit(str(seed))))
    free = cases.filter(~F.col("case_id").isin(chosen)) if chosen else cases
    ranked = rank_within(free.withColumn("_digest", digest), [], [F.col("_digest"), F.col("case_id")], "_n")
    last_test = 0 if test else holdout
    last_validation = last_test + (0 if validation else max(1, len(test) or holdout))
    if total - len(chosen) <= last_validation:
        raise ValueError("no case is left for training")
    split = ranked.select("case_id", F.when(F.col("_n") <= last_test, "test")
                          .when(F.col("_n") <= last_validation, "validation").otherwise("train").alias("partition"))
    if chosen:
        named = cases.filter(F.col("case_id").isin(chosen)).select("case_id", F.when(
            F.col("case_id").isin(test or [None]), "test").otherwise("validation").alias("partition"))
        split = split.unionByName(named)
    return split


def fit_standardizer(train: DataFrame, vector: str = "features", size: int = len(FEATURE_NAMES)) -> DataFrame:
    """One row of mean and scale arrays: population deviation with floor 1e-6."""
    at = [F.get(vector, F.lit(i)) for i in range(size)]
    return train.agg(
        F.array(*[F.avg(v) for v in at]).alias("mean"),
        F.array(*[F.greatest(F.stddev_pop(v), F.lit(1e-6)) for v in at]).alias("scale"))


def fit_logistic(train: DataFrame, vector: str = "features", size: int = len(FEATURE_NAMES)) -> LogisticModel:
    """Minimise mean log-loss + 0.05 * sum of squared weights on standardised features; the bias is free."""
    fitted = fit_standardizer(train, vector, size).first()
    mean, scale = list(fitted["mean"]), list(fitted["scale"])
    standard = F.array(*[(F.get(vector, F.lit(i)) - mean[i]) / scale[i] for i in range(size)])
    data = train.select(
        array_to_vector(standard).alias("x"), (F.col("label") == "confirmed").cast("double").alias("y"))
    result = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=0.1, elasticNetParam=0.0, standardization=False,
        maxIter=500, tol=1e-10,
    ).fit(data)
    return LogisticModel(mean, scale, [float(w) for w in result.coefficients], float(result.intercept))


def classifier_metrics(scored: DataFrame, threshold: float | Column, by: list[str] | None = None) -> DataFrame:
    """Candidate-level counts; unlike the case summaries, f1 without any positive is 0."""
    threshold = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    said, truth = F.col("score") >= threshold, F.col("label") == "confirmed"
    counts = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("reviewed_candidates"), F.count_if(said & truth).alias("tp"),
        F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"),
        F.count_if(~said & ~truth).alias("tn"),
        F.avg(F.pow(F.col("score") - truth.cast("double"), F.lit(2.0))).alias("brier_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def keep_all_baseline(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return classifier_metrics(scored.withColumn("score", F.lit(1.0)), 0.5, by)


def threshold_curve(
    validation: DataFrame, train: DataFrame | None = None, minimum_recall: float = 0.0, limit: int | None = None,
) -> DataFrame:
    """f1 on validation at every candidate threshold, from one ordered pass over distinct scores."""
    truth = (F.col("label") == "confirmed").cast("bigint")
    zero = F.lit(0).cast("bigint")

    def tally(rows: DataFrame, pos, neg, train_pos, allowed) -> DataFrame:
        return rows.select("score", pos.alias("pos"), neg.alias("neg"), train_pos.alias("train_pos"), allowed.alias("allowed"))

    fixed = validation.sparkSession.range(3).select((F.col("id") / 2).alias("score"))
    parts = [tally(validation, truth, 1 - truth, zero, F.lit(1)), tally(fixed, zero, zero, zero, F.lit(1))]
    if minimum_recall > 0:
        parts.append(tally(train.filter(truth == 1), zero, zero, F.lit(1).cast("bigint"), F.lit(1)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    values = rows.groupBy("score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "train_pos")])
    names = ["pos", "neg", "train_pos"]
    ranked = running_totals(values, [], [F.col("score")], {f"upto_{c}": F.col(c) for c in names}, limit)
    sums = values.agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    joined = ranked.join(F.broadcast(sums))  # one row
    below = {c: F.col(f"upto_{c}") - F.col(c) for c in names}
    tp, fp, fn = F.col("all_pos") - below["pos"], F.col("all_neg") - below["neg"], below["pos"]
    recall = F.try_divide(F.col("all_train_pos") - below["train_pos"], F.col("all_train_pos"))
    allowed = recall >= minimum_recall if minimum_recall > 0 else F.lit(True)
    return joined.filter(allowed).select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def select_threshold(
    validation: DataFrame, train: DataFrame | None = None, minimum_recall: float = 0.0, limit: int | None = None,
) -> DataFrame:
    """Best f1, then closest to 0.5, then the smaller threshold: one row."""
    curve = threshold_curve(validation, train, minimum_recall, limit)
    return curve.orderBy(F.col("f1").desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def train(
    reviews: DataFrame, split: DataFrame, minimum_recall: float = 0.0, size: int = len(FEATURE_NAMES),
) -> tuple[LogisticModel, DataFrame]:
    """Fit on train rows, pick the threshold on validation rows, report all partitions.

    Test rows are read for the report only. Model and threshold are a few numbers on the driver.
    """
    from ostiary.operators.quality import raise_on, validate_split

    raise_on(validate_split(split, reviews))
    rows = reviews.join(split, "case_id")
    kinds = rows.groupBy("partition").agg(F.count_distinct("label").alias("n")).filter("n = 2").count()
    if kinds != len(PARTITIONS):
        raise ValueError("Every partition needs both confirmed and rejected candidates.")
    model = fit_logistic(rows.filter("partition = 'train'"), size=size)
    scored = rows.withColumn("score", logistic_score(F.col("features"), model))
    chosen = select_threshold(
        scored.filter("partition = 'validation'"), scored.filter("partition = 'train'"), minimum_recall).first()
    model.threshold = float(chosen["threshold"])
    report = classifier_metrics(scored, model.threshold, ["partition"]).withColumn("kind", F.lit("classifier")).unionByName(
        keep_all_baseline(scored, ["partition"]).withColumn("kind", F.lit("keep_all_baseline")))
    return model, report

from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.functions.features import LogisticModel, logistic_score
from ostiary.operators import quality, reviews as rv, training as tr
from ostiary.operators.metrics import label_sources
from ostiary.plans.catalog import query, r4, sr4
from ostiary.sources import adapters as a

TERMS = [(f"value / {i + 3}", f"k * {i + 1} / 7", f"value * k / {(i + 2) * 50}", f"(k - {i * 5}) / 11")[i % 4] for i in range(13)]
MODEL = LogisticModel(
    mean=[30.0 + i for i in range(13)], scale=[20.0 + i for i in range(13)],
    weights=[0.31, -0.22, 0.13, 0.24, -0.35, 0.16, 0.27, -0.18, 0.29, 0.1, -0.11, 0.12, 0.33], bias=-0.2, threshold=0.42)
LATEST = """SELECT case_id, instance_id, label, labeller, reviewed_at, value, k FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, instance_id ORDER BY reviewed_at DESC, event_id DESC) AS n FROM reviews)
    WHERE n = 1 AND label <> 'unreviewed'"""
TERMS_SQL = [f"CAST({t.replace('/', '::DOUBLE /')} AS DOUBLE)" for t in TERMS]
SCORED_SQL = "SELECT *, 1 / (1 + exp(-(" + f"{MODEL.bias}::DOUBLE" + "".join(
    f" + ({t} - {m}::DOUBLE) / {s}::DOUBLE * {w}::DOUBLE" for t, m, s, w in zip(TERMS_SQL, MODEL.mean, MODEL.scale, MODEL.weights)
) + "))) AS score FROM latest"
SPLIT_SQL = {
    "hashed": """SELECT case_id, row_number() OVER (ORDER BY md5(case_id::VARCHAR || ':42'), case_id) AS n, count(*) OVER () AS total
        FROM (SELECT DISTINCT case_id FROM latest)""",
    "split": """SELECT case_id, CASE WHEN n <= greatest(1, total // 5) THEN 'test'
        WHEN n <= 2 * greatest(1, total // 5) THEN 'validation' ELSE 'train' END AS partition FROM hashed""",
}
METRIC_SQL = """count(*) AS reviewed_candidates, count(*) FILTER (score >= {t} AND label = 'confirmed') AS tp,
    count(*) FILTER (score >= {t} AND label <> 'confirmed') AS fp, count(*) FILTER (score < {t} AND label = 'confirmed') AS fn,
    count(*) FILTER (score < {t} AND label <> 'confirmed') AS tn,
    round(avg((score - (label = 'confirmed')::INT) ** 2) + 1e-7, 4) + 0.0 AS brier_score,
    round(count(*) FILTER (score >= {t} AND label = 'confirmed') / nullif(count(*) FILTER (score >= {t}), 0) + 1e-7, 4) + 0.0 AS precision,
    round(count(*) FILTER (score >= {t} AND label = 'confirmed') / nullif(count(*) FILTER (label = 'confirmed'), 0) + 1e-7, 4) + 0.0 AS recall,
    round(coalesce(2 * count(*) FILTER (score >= {t} AND label = 'confirmed')
      / nullif(count(*) FILTER (score >= {t}) + count(*) FILTER (label = 'confirmed'), 0), 0) + 1e-7, 4) + 0.0 AS f1"""


def metric_columns():
    return ["reviewed_candidates", "tp", "fp", "fn", "tn", *[r4(c) for c in ("brier_score", "precision", "recall", "f1")]]


def latest(spark, folder):
    rows = rv.upsert_reviews(a.reviews(spark, folder))
    return rows.withColumn("features", F.array(*[F.expr(t).cast("double") for t in TERMS]))


def scored(spark, folder):
    return latest(spark, folder).withColumn("score", logistic_score(F.col("features"), MODEL))


def partitioned(spark, folder):
    rows = scored(spark, folder)
    return rows.join(tr.split_cases(rows, 42), "case_id")


@query("upsert_reviews", a.oracle("SELECT case_id, instance_id, label, labeller, reviewed_at FROM latest", "reviews",
                                  extra={"latest": LATEST}))
def upsert(spark, folder):
    return rv.upsert_reviews(a.reviews(spark, folder)).select("case_id", "instance_id", "label", "labeller", "reviewed_at")


DEDUPE = "SELECT case_id, instance_id, label FROM reviews WHERE label <> 'unreviewed'"


@query("dedupe_reviews", a.oracle("""
    SELECT case_id, instance_id, min(label) AS label FROM named GROUP BY ALL HAVING min(label) = max(label)""",
    "reviews", extra={"named": DEDUPE}))
def dedupe(spark, folder):
    rows = a.reviews(spark, folder).filter("label <> 'unreviewed'").select("case_id", "instance_id", "label")
    return rv.dedupe_reviews(rows)[0]


@query("review_conflicts", a.oracle("""
    SELECT case_id, instance_id, count(*) AS copies FROM named GROUP BY 1, 2 HAVING min(label) <> max(label)""",
    "reviews", extra={"named": DEDUPE}))
def conflicts(spark, folder):
    rows = a.reviews(spark, folder).filter("label <> 'unreviewed'").select("case_id", "instance_id", "label")
    return rv.dedupe_reviews(rows)[1]


@query("export_reviews", a.oracle("""
    SELECT case_id, 1::BIGINT AS schema_version, 'candidate_reviews_only' AS scope, 13::BIGINT AS n_features, count(*) AS records,
      min(instance_id) AS first_instance FROM latest GROUP BY 1""", "reviews", extra={"latest": LATEST}))
def export(spark, folder):
    parsed = rv.export_reviews(rv.upsert_reviews(a.reviews(spark, folder))).select("case_id", F.from_json(
        "envelope", "schema_version bigint, feature_names array<string>, scope string, records array<struct<instance_id:string>>").alias("e"))
    return parsed.select("case_id", "e.schema_version", "e.scope", F.size("e.feature_names").cast("bigint").alias("n_features"),
                         F.size("e.records").cast("bigint").alias("records"), F.array_min("e.records")["instance_id"].alias("first_instance"))


@query("split_cases", a.oracle("SELECT * FROM split", "reviews", extra={"latest": LATEST, **SPLIT_SQL}))
def split(spark, folder):
    return tr.split_cases(latest(spark, folder), 42)


@query("split_explicit", a.oracle("""
    SELECT case_id, CASE WHEN case_id IN (3, 5) THEN 'test' WHEN case_id = 8 THEN 'validation' ELSE 'train' END AS partition
    FROM (SELECT DISTINCT case_id FROM latest)""", "reviews", extra={"latest": LATEST}))
def split_explicit(spark, folder):
    return tr.split_cases(latest(spark, folder), 42, test=[3, 5], validation=[8])


@query("validate_split", a.oracle("""
    SELECT 'case_in_two_partitions' AS rule, case_id::VARCHAR AS detail FROM declared GROUP BY case_id HAVING count(*) > 1
    UNION ALL SELECT 'case_not_in_split', case_id::VARCHAR FROM (SELECT DISTINCT case_id FROM latest)
      WHERE case_id NOT IN (SELECT case_id FROM declared)
    UNION ALL SELECT 'case_without_reviews', case_id::VARCHAR FROM declared WHERE case_id NOT IN (SELECT case_id FROM latest)
    UNION ALL SELECT 'empty_partition', 'test' WHERE NOT EXISTS (SELECT 1 FROM declared WHERE partition = 'test')
    UNION ALL SELECT DISTINCT 'unknown_partition', partition FROM declared WHERE partition = 'holdout'""",
    "reviews", extra={"latest": LATEST, "declared": """
      SELECT DISTINCT user_id AS case_id, CASE WHEN value > 50 THEN 'train' WHEN value > 45 THEN 'holdout' ELSE 'validation' END AS partition
      FROM events WHERE event_type IN ('view', 'click', 'error')"""}))
def validate_split(spark, folder):
    events = a.table(spark, folder, "events").filter("event_type IN ('view', 'click', 'error')")
    declared = events.select(F.col("user_id").alias("case_id"), F.when(F.col("value") > 50, "train").when(
        F.col("value") > 45, "holdout").otherwise("validation").alias("partition")).distinct()
    return quality.validate_split(declared, latest(spark, folder))


@query("fit_standardizer", a.oracle(
    "SELECT " + ", ".join(sr4(f"avg({t})", f"mean_{i:02d}") + ", " + sr4(f"greatest(stddev_pop({t}), 1e-6)", f"scale_{i:02d}")
                          for i, t in enumerate(TERMS_SQL))
    + " FROM latest JOIN split USING (case_id) WHERE partition = 'train'", "reviews", extra={"latest": LATEST, **SPLIT_SQL}))
def fit_standardizer(spark, folder):
    fitted = tr.fit_standardizer(partitioned(spark, folder).filter("partition = 'train'"))
    return fitted.select(*[r4(F.get(c, F.lit(i)), f"{c}_{i:02d}") for i in range(13) for c in ("mean", "scale")])


@query("logistic_score", a.oracle(f"SELECT case_id, instance_id, {sr4('score', 'score')} FROM scored", "reviews",
                                  extra={"latest": LATEST, "scored": SCORED_SQL}))
def score(spark, folder):
    return scored(spark, folder).select("case_id", "instance_id", r4("score"))


@query("classifier_metrics", a.oracle(
    f"SELECT partition, {METRIC_SQL.format(t=MODEL.threshold)} FROM scored JOIN split USING (case_id) GROUP BY 1",
    "reviews", extra={"latest": LATEST, "scored": SCORED_SQL, **SPLIT_SQL}))
def classifier_metrics(spark, folder):
    return tr.classifier_metrics(partitioned(spark, folder), MODEL.threshold, ["partition"]).select("partition", *metric_columns())


@query("keep_all_baseline", a.oracle(
    f"SELECT partition, {METRIC_SQL.format(t=0.5)} FROM (SELECT label, 1.0::DOUBLE AS score, partition FROM latest JOIN split USING (case_id)) GROUP BY 1",
    "reviews", extra={"latest": LATEST, **SPLIT_SQL}))
def keep_all(spark, folder):
    return tr.keep_all_baseline(partitioned(spark, folder), ["partition"]).select("partition", *metric_columns())


@query("label_sources", a.oracle("SELECT coalesce(labeller, 'unspecified') AS labeller, count(*) AS n FROM latest GROUP BY 1",
                                 "reviews", extra={"latest": LATEST}))
def sources(spark, folder):
    return label_sources(latest(spark, folder))


CURVE = {
    "val": "SELECT score, label FROM scored JOIN split USING (case_id) WHERE partition = 'validation'",
    "trn": "SELECT score, label FROM scored JOIN split USING (case_id) WHERE partition = 'train'",
}
BEST = """SELECT round(t + 1e-7, 4) + 0.0 AS threshold, tp, fp, fn, round(f1 + 1e-7, 4) + 0.0 AS f1 FROM (
    SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
      SELECT t, count(*) FILTER (score >= t AND label = 'confirmed') AS tp, count(*) FILTER (score >= t AND label <> 'confirmed') AS fp,
        count(*) FILTER (score < t AND label = 'confirmed') AS fn FROM ts, val GROUP BY t))
    ORDER BY f1 DESC, abs(t - 0.5), t LIMIT 1"""


@query("select_threshold", a.oracle(BEST, "reviews", extra={"latest": LATEST, "scored": SCORED_SQL, **SPLIT_SQL, **CURVE,
       "ts": "SELECT DISTINCT score AS t FROM val UNION SELECT unnest([0, 0.5, 1])::DOUBLE"}))
def select_threshold(spark, folder):
    rows = partitioned(spark, folder)
    return tr.select_threshold(rows.filter("partition = 'validation'")).select(r4("threshold"), "tp", "fp", "fn", r4("f1"))


@query("select_threshold_min_recall", a.oracle(BEST, "reviews", extra={"latest": LATEST, "scored": SCORED_SQL, **SPLIT_SQL, **CURVE,
       "wide": "SELECT DISTINCT score AS t FROM val UNION SELECT unnest([0, 0.5, 1])::DOUBLE UNION SELECT score FROM trn WHERE label = 'confirmed'",
       "ts": """SELECT t FROM wide, trn GROUP BY t HAVING count(*) FILTER (score >= t AND label = 'confirmed')
            / count(*) FILTER (label = 'confirmed') >= 0.2"""}))
def select_threshold_recall(spark, folder):
    rows = partitioned(spark, folder)
    return tr.select_threshold(rows.filter("partition = 'validation'"), rows.filter("partition = 'train'"), 0.2).select(
        r4("threshold"), "tp", "fp", "fn", r4("f1"))


@query("train_classifier")
def train(spark, folder):
    rows = latest(spark, folder)
    _, report = tr.train(rows, tr.split_cases(rows, 42))
    return report.select("kind", "partition", *metric_columns())


@query("fit_logistic")
def fit(spark, folder):
    model = tr.fit_logistic(partitioned(spark, folder).filter("partition = 'train'"))
    return scored(spark, folder).agg(F.count("*").alias("rows")).select(
        "rows", F.array(*[F.lit(round(w, 4)) for w in model.weights]).alias("weights"), F.lit(round(model.bias, 4)).alias("bias"))


@query("fit_logistic_gradient", "SELECT i AS weight, 0.0::DOUBLE AS gradient FROM range(14) t(i)")
def fit_gradient(spark, folder):
    """Slope of the penalised loss at the fitted model along each weight and, last, the bias: all zero at the minimum."""
    train = partitioned(spark, folder).filter("partition = 'train'")
    model = tr.fit_logistic(train)
    standard = F.array(*[(F.get("features", F.lit(i)) - model.mean[i]) / model.scale[i] for i in range(13)])
    logit = F.aggregate(F.zip_with("x", F.array(*map(F.lit, model.weights)), lambda a, b: a * b), F.lit(float(model.bias)), lambda t, v: t + v)
    missed = train.select(standard.alias("x"), F.col("label")).select("x", (1 / (1 + F.exp(-logit)) - (F.col("label") == "confirmed").cast("double")).alias("e"))
    slopes = missed.agg(F.array(*[F.avg(F.col("e") * F.get("x", F.lit(i))) + 0.1 * w for i, w in enumerate(model.weights)], F.avg("e")).alias("g"))
    return slopes.select(F.posexplode("g").alias("i", "v")).select(F.col("i").cast("bigint").alias("weight"), (F.round("v", 4) + F.lit(0.0)).alias("gradient"))

"""Queries of whole batches: failure isolation, run records, the candidate pool, the benchmark report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.functions.profiles import profile_configs, settings
from ostiary.plans import batch as b, evaluation as e
from ostiary.plans.catalog import query, r4, sr4
from ostiary.plans.q_evaluation import TOTALS_SQL, confusion_sql, matching_sql, summary_columns
from ostiary.plans.q_learning import LATEST, SPLIT_SQL, latest
from ostiary.plans.q_workflow import MODEL, RANKED, SCORED, decision_log, greedy
from ostiary.operators.training import split_cases
from ostiary.sources import adapters as a

CASE_ERROR = "a case folder needs exactly one scan and one mask"


def headers(orders, missing, spacing):
    row = F.array(F.lit(1.0), *[F.lit(0.0)] * 3, F.lit(1.0), *[F.lit(0.0)] * 3, F.lit(1.0))
    return orders.filter(f"case_id % {missing} <> 1").select(
        "case_id", F.array(*[F.lit(4)] * 3).alias("size"), F.lit(1).alias("components"), spacing.alias("spacing"),
        F.array(*[F.lit(0.0)] * 3).alias("origin"), row.alias("direction"))


def batch(spark, folder):
    """Orders as cases; every few miss a file, a header, agree on no grid or hold a candidate without features."""
    orders = a.table(spark, folder, "orders").withColumnRenamed("o_orderkey", "case_id")
    good = (F.col("case_id") % 11 != 0) & (F.col("case_id") % 23 != 0)
    scanned = orders.select("case_id", F.when(good, "ok").otherwise("failed").alias("status"), F.when(~good, F.lit(CASE_ERROR)).alias("error"))
    first = F.when(F.col("case_id") % 29 == 0, -1.0).otherwise(1.0)
    images = headers(orders, 17, F.array(first, F.lit(1.0), F.lit(1.0)))
    masks = headers(orders, 19, F.array(first, F.lit(1.0), F.when(F.col("case_id") % 13 == 0, 1.5).otherwise(1.0)))
    rows = a.candidates(spark, folder)
    broken = (F.col("ord") % 4 == 3) & (F.col("case_id") % 31 == 0)
    rows = rows.withColumn("mean_vesselness", F.when(~broken, F.col("mean_vesselness")))
    runs = orders.select("case_id", (F.col("o_totalprice") / 1000).alias("detection_s"), (F.col("o_totalprice") / 900).alias("end_to_end_s"))
    return b.run_batch(scanned, images, masks, rows.filter("profile = 'strict'"), rows.filter("profile = 'review'"), MODEL, runs)


FAULTS = {"broken": "SELECT case_id, count(*) AS n, min(instance_id) AS first FROM cand WHERE ord % 4 = 3 AND case_id % 31 = 0 GROUP BY 1",
          "fault": f"""SELECT k.case_id, totalprice, CASE WHEN k.case_id % 11 = 0 OR k.case_id % 23 = 0 THEN 'files: {CASE_ERROR}'
            WHEN least(CASE WHEN k.case_id % 17 = 1 THEN 'scan' END, CASE WHEN k.case_id % 19 = 1 THEN 'mask' END) IS NOT NULL
              THEN least(CASE WHEN k.case_id % 17 = 1 THEN 'scan' END, CASE WHEN k.case_id % 19 = 1 THEN 'mask' END) || ': no readable header'
            WHEN k.case_id % 13 = 0 AND k.case_id % 29 = 0 THEN 'header: geometry, spacing' WHEN k.case_id % 13 = 0 THEN 'header: geometry'
            WHEN k.case_id % 29 = 0 THEN 'header: spacing'
            WHEN n IS NOT NULL THEN 'features: ' || n || ' without a score, first ' || first END AS error
            FROM (SELECT o_orderkey AS case_id, o_totalprice AS totalprice FROM orders) k LEFT JOIN broken b ON b.case_id = k.case_id"""}


@query("batch_cases", a.oracle(f"""
    SELECT f.case_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error,
      CASE WHEN error IS NULL THEN coalesce(n, 0) END AS branches, CASE WHEN error IS NULL THEN {sr4('totalprice / 1000', '_').removesuffix(' AS _')} END AS detection_s,
      CASE WHEN error IS NULL THEN {sr4('totalprice / 900', '_').removesuffix(' AS _')} END AS end_to_end_s
    FROM fault f LEFT JOIN (SELECT case_id, count(*) AS n FROM kept GROUP BY 1) k ON k.case_id = f.case_id""",
    "cand", extra={**FAULTS, "scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def batch_cases(spark, folder):
    return batch(spark, folder)["cases"].select("case_id", "status", "error", "branches", r4("detection_s"), r4("end_to_end_s"))


@query("batch_totals", a.oracle("SELECT count(*) AS cases, count(error) AS failures, count(*) - count(error) AS ok FROM fault", "cand", extra=FAULTS))
def batch_totals(spark, folder):
    return batch(spark, folder)["totals"]


def profile_runs(spark, folder):
    """Two passes of each order with invented counts."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = a.table(spark, folder, "orders")
    listed = {"strict": F.when(key % 2 == 0, F.array(F.lit("low contrast"))).otherwise(F.array().cast("array<string>")),
              "review": F.when(key % 3 == 0, F.array(F.lit("few cells"), F.lit("low contrast"))).otherwise(F.array(F.lit("wide search")))}
    frames = [orders.select(
        key.alias("case_id"), F.lit(name).alias("profile"), (price / share).alias("total_s"), (price / 300).alias("end_s"),
        F.create_map(F.lit("lower"), price / 100, F.lit("upper"), price / 50 + share).alias("blood"), (key % (share // 100)).alias("roots"),
        (key % 5 + share // 500).alias("proposals"), F.create_map(F.lit("short_path"), key % 3, F.lit("small_radius"), key % 4 + share // 500).alias("rejections"),
        listed[name].alias("warnings")) for name, share in (("strict", 1000), ("review", 500))]
    return frames[0].unionByName(frames[1])


def _profile_sql(name: str, share: int) -> str:
    chosen = settings(name)
    return f"""(o_orderkey % {share // 100})::BIGINT AS {name}_roots, (o_orderkey % 5 + {share // 500})::BIGINT AS {name}_proposals,
      'short_path=' || o_orderkey % 3 || ',small_radius=' || o_orderkey % 4 + {share // 500} AS {name}_rejections,
      {sr4(f'o_totalprice / 50 + {share}', f'{name}_upper')}, {chosen['shell_outer_mm']}::DOUBLE AS {name}_shell_outer_mm, {chosen['roots_per_contact']} AS {name}_roots_per_contact"""


@query("run_records", a.oracle(f"""
    SELECT o_orderkey AS case_id, {sr4('o_totalprice / 1000', 'strict_s')}, {sr4('o_totalprice / 500', 'review_s')}, {sr4('o_totalprice / 300', 'total_s')},
      {sr4('o_totalprice / 100', 'blood_lower')}, (o_orderkey % 10 + o_orderkey % 5)::BIGINT AS candidates,
      coalesce(l.below, 0) AS learned_candidate_filter, coalesce(l.merged, 0) AS merged_after_scoring,
      CASE WHEN o_orderkey % 2 = 0 THEN 'low contrast|' ELSE '' END || CASE WHEN o_orderkey % 3 <> 0 THEN 'wide search' WHEN o_orderkey % 2 = 0 THEN 'few cells'
        ELSE 'few cells|low contrast' END || '|{b.UNCALIBRATED}' AS warnings, {_profile_sql('strict', 1000)}, {_profile_sql('review', 500)}
    FROM orders LEFT JOIN (SELECT s.case_id, count(*) FILTER (s.score < 0.35) AS below, count(*) FILTER (s.score >= 0.35 AND p.no IS NULL) AS merged
      FROM scored s LEFT JOIN alive c ON c.case_id = s.case_id AND c.ord = s.ord LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k GROUP BY 1) l ON l.case_id = o_orderkey""",
    "cand", extra={"scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def run_records(spark, folder):
    records = b.run_records(decision_log(spark, folder), profile_runs(spark, folder), profile_configs(spark))
    columns = []
    for name in ("strict", "review"):
        entry = F.col("profiles")[name]
        pairs = F.transform(F.sort_array(F.map_entries(entry["rejections"])), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
        columns += [entry["candidate_roots"].alias(f"{name}_roots"), entry["proposals"].alias(f"{name}_proposals"), F.array_join(pairs, ",").alias(f"{name}_rejections"),
                    r4(entry["blood_model"]["upper"], f"{name}_upper"), entry["config"]["shell_outer_mm"].alias(f"{name}_shell_outer_mm"),
                    entry["config"]["roots_per_contact"].alias(f"{name}_roots_per_contact")]
    times = [r4(F.col(f"timings.{c}"), c) for c in ("strict_s", "review_s", "total_s")]
    counts = [F.col("rejections")[c].alias(c) for c in ("learned_candidate_filter", "merged_after_scoring")]
    return records.select("case_id", *times, r4(F.col("blood_model")["lower"], "blood_lower"), "candidates", *counts, F.array_join("warnings", "|").alias("warnings"), *columns)


def pool(spark, folder):
    rows = a.candidates(spark, folder).select("case_id", "instance_id", "ord", "profile", "ostium", F.when(
        F.col("ord") % 2 == 0, F.array(F.lit("near wall"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return b.candidate_pool(rows.filter("profile = 'review'"), rows.filter("profile = 'strict'"), ["case_id"], "ord")


POOL = {"alive": """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS k FROM cand s WHERE profile = 'strict' AND NOT EXISTS (
            SELECT 1 FROM cand r WHERE r.case_id = s.case_id AND r.profile = 'review'
            AND sqrt((r.ox-s.ox)*(r.ox-s.ox) + (r.oy-s.oy)*(r.oy-s.oy) + (r.oz-s.oz)*(r.oz-s.oz)) < 3)""", **greedy(3.0),
        "pooled": """SELECT *, FALSE AS added FROM cand WHERE profile = 'review' UNION ALL
            SELECT c.*, TRUE FROM cand c JOIN alive a ON a.case_id = c.case_id AND a.ord = c.ord JOIN kept k ON k.case_id = a.case_id AND k.k = a.k"""}


@query("candidate_pool", a.oracle(f"""
    SELECT case_id, printf('branch_%03d', row_number() OVER (PARTITION BY case_id ORDER BY oz, oy, ox, added, ord)) AS instance_id, instance_id AS source_id, added,
      array_to_string(list_concat(CASE WHEN ord % 2 = 0 THEN ['near wall'] ELSE [] END, CASE WHEN added THEN ['{b.STRICT_ONLY}'] ELSE [] END), '|') AS warnings
    FROM pooled""", "cand", extra=POOL))
def candidate_pool(spark, folder):
    return pool(spark, folder)[0].select("case_id", "instance_id", "source_id", "added", F.array_join("warnings", "|").alias("warnings"))


@query("candidate_pool_counts", a.oracle("SELECT case_id, count(*) AS branches, count(*) FILTER (added) AS strict_only_added FROM pooled GROUP BY 1", "cand", extra=POOL))
def candidate_pool_counts(spark, folder):
    return pool(spark, folder)[1]


def report(spark, folder):
    """The benchmark over orders: every order's comment stands for its file."""
    rows = a.candidates(spark, folder)
    orders = a.table(spark, folder, "orders")
    files = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.col("o_orderpriority"), 256).alias("sha256"))
    runs = orders.select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") / 1000).alias("total_s"),
                         F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 7000).alias("filter_s"))
    return e.benchmark_report(files, a.cases(spark, folder), files, rows.filter("side = 'O'"), a.side(rows, "F"), runs, MODEL,
                              split_cases(latest(spark, folder), 42), 3.0)


BENCH = {"scored": SCORED, "strong": "SELECT * FROM scored WHERE side = 'O' AND score >= 0.35", **matching_sql([2.0, 3.0, 5.0], pred="strong", tag="f"),
         **confusion_sql([2.0, 3.0, 5.0], pred="strong", tag="f")}
RUNTIME = "o_totalprice / 1000 + CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 7000 ELSE 0 END"


@query("benchmark_cases", a.oracle(f"""
    SELECT f.case_id, f.family, n_pred AS predicted, n_ref AS reference, tp, fp, fn, {sr4(RUNTIME, 'runtime_s')}
    FROM confusionf f JOIN orders ON o_orderkey = f.case_id WHERE tolerance_mm = 3""", "pred", "ref", "cases", extra=BENCH))
def benchmark_cases(spark, folder):
    return report(spark, folder)["cases"].select("case_id", "family", "predicted", "reference", "tp", "fp", "fn", r4("runtime_s"))


@query("benchmark_summary", a.oracle(f"""
    SELECT 'filtered' AS variant, CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'group' END AS scope, family, NULL::DOUBLE AS tolerance_mm, {TOTALS_SQL}
      FROM confusionf WHERE tolerance_mm = 3 GROUP BY GROUPING SETS ((family), ())
    UNION ALL SELECT 'unfiltered', CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'group' END, family, NULL, {TOTALS_SQL}
      FROM confusion GROUP BY GROUPING SETS ((family), ())
    UNION ALL SELECT 'sensitivity', 'overall', NULL, tolerance_mm, {TOTALS_SQL} FROM confusionf GROUP BY tolerance_mm""",
    "pred", "ref", "cases", extra={**matching_sql([3.0]), **confusion_sql([3.0]), **BENCH}))
def benchmark_summary(spark, folder):
    tables = report(spark, folder)
    nothing = {"variant": F.lit("sensitivity"), "scope": F.lit("overall"), "family": F.lit(None).cast("string")}
    both = tables["summary"].withColumn("tolerance_mm", F.lit(None).cast("double")).unionByName(tables["sensitivity"].withColumns(nothing))
    return both.select(*summary_columns("variant", "scope", "family", "tolerance_mm"))


@query("benchmark_overlap", a.oracle("SELECT partition, s.case_id FROM split s WHERE s.case_id IN (SELECT case_id FROM cases)", "cases", "reviews",
                                     extra={"latest": LATEST, **SPLIT_SQL}))
def benchmark_overlap(spark, folder):
    return report(spark, folder)["overlap"]


@query("benchmark_runtime", a.oracle(f"SELECT {sr4(f'avg({RUNTIME})', 'mean_runtime_s')}, {sr4(f'max({RUNTIME})', 'max_runtime_s')} FROM orders"))
def benchmark_runtime(spark, folder):
    return report(spark, folder)["runtime"].select(r4("mean_runtime_s"), r4("max_runtime_s"))

from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.operators import metrics as m
from ostiary.operators.matching import match_one_to_one, missing_predictions, unmatched
from ostiary.operators.spatial import nearest_within, pairs_within
from ostiary.plans import evaluation as e
from ostiary.plans.catalog import query, r4, sr4
from ostiary.plans.q_workflow import MODEL, SCORED
from ostiary.sources import adapters as a


def dist(p: str, r: str, pc=("ox", "oy", "oz"), rc=("ox", "oy", "oz"), sign: str = "") -> str:
    terms = []
    for i, (u, v) in enumerate(zip(pc, rc)):
        left = f"({sign if i < 2 else ''}{p}.{u})"
        terms.append(f"({left} - {r}.{v})*({left} - {r}.{v})")
    return f"sqrt({' + '.join(terms)})"


def matching_sql(tolerances, pred: str = "pred", ref: str = "ref", sign: str = "", tag: str = "") -> dict[str, str]:
    """Every assignment of each case is enumerated; the one with most pairs, then least distance, is kept."""
    values = ", ".join(f"({t}::DOUBLE)" for t in tolerances)
    return {
        f"pairs{tag}": f"""SELECT t.tol, p.case_id, p.ord AS l, r.ord AS r, {dist('p', 'r', sign=sign)} AS d
            FROM {pred} p JOIN {ref} r ON p.case_id = r.case_id JOIN (VALUES {values}) t(tol)
            ON {dist('p', 'r', sign=sign)} <= t.tol""",
        f"lefts{tag}": f"""SELECT tol, case_id, l, row_number() OVER (PARTITION BY tol, case_id ORDER BY l) AS i
            FROM (SELECT DISTINCT tol, case_id, l FROM pairs{tag})""",
        f"tries{tag}(tol, case_id, i, used, cost, picks)": f"""
            SELECT DISTINCT tol, case_id, 0::BIGINT, []::BIGINT[], 0::DOUBLE, []::STRUCT(l BIGINT, r BIGINT, d DOUBLE)[] FROM lefts{tag}
            UNION ALL
            SELECT t.tol, t.case_id, t.i + 1, CASE WHEN q.r IS NULL THEN t.used ELSE list_append(t.used, q.r) END,
              t.cost + coalesce(q.d, 0),
              CASE WHEN q.r IS NULL THEN t.picks ELSE list_append(t.picks, {{'l': n.l, 'r': q.r, 'd': q.d}}) END
            FROM tries{tag} t JOIN lefts{tag} n ON n.tol = t.tol AND n.case_id = t.case_id AND n.i = t.i + 1
            JOIN (SELECT tol, case_id, l, r, d FROM pairs{tag} UNION ALL
                  SELECT tol, case_id, l, NULL, NULL FROM lefts{tag}) q
              ON q.tol = t.tol AND q.case_id = t.case_id AND q.l = n.l
              AND (q.r IS NULL OR NOT list_contains(t.used, q.r))""",
        f"picked{tag}": f"""SELECT tol, case_id, unnest(picks) AS m FROM (
            SELECT *, row_number() OVER (PARTITION BY tol, case_id ORDER BY len(picks) DESC, cost) AS best
            FROM (SELECT t.* FROM tries{tag} t JOIN (SELECT tol, case_id, max(i) AS n FROM lefts{tag} GROUP BY ALL) n
              ON n.tol = t.tol AND n.case_id = t.case_id AND n.n = t.i)) WHERE best = 1""",
        f"matched{tag}": f"""SELECT k.tol AS tolerance_mm, k.case_id, p.instance_id AS prediction_id, r.instance_id AS reference_id,
            k.m.d AS ostium_error_mm, {dist('p', 'r', ('sx', 'sy', 'sz'), ('sx', 'sy', 'sz'))} AS seed_error_mm,
            abs(p.radius_mm - r.radius_mm) AS radius_error_mm, r.ord AS r_ord,
            degrees(acos(greatest(-1, least(1, p.dx*r.dx + p.dy*r.dy + p.dz*r.dz)))) AS direction_error_degrees
          FROM picked{tag} k JOIN {pred} p ON p.case_id = k.case_id AND p.ord = k.m.l
            JOIN {ref} r ON r.case_id = k.case_id AND r.ord = k.m.r""",
    }


def confusion_sql(tolerances, pred: str = "pred", ref: str = "ref", tag: str = "") -> dict[str, str]:
    values = ", ".join(f"({t}::DOUBLE)" for t in tolerances)
    return {f"confusion{tag}": f"""
        SELECT *, n_pred - tp AS fp, n_ref - tp AS fn FROM (
          SELECT c.case_id, c.family, t.tol AS tolerance_mm, coalesce(p.n, 0) AS n_pred, coalesce(r.n, 0) AS n_ref,
            coalesce(k.n, 0) AS tp
          FROM cases c CROSS JOIN (VALUES {values}) t(tol)
          LEFT JOIN (SELECT case_id, count(*) AS n FROM {pred} GROUP BY 1) p ON p.case_id = c.case_id
          LEFT JOIN (SELECT case_id, count(*) AS n FROM {ref} GROUP BY 1) r ON r.case_id = c.case_id
          LEFT JOIN (SELECT tol, case_id, count(*) AS n FROM picked{tag} GROUP BY 1, 2) k
            ON k.case_id = c.case_id AND k.tol = t.tol)"""}


RATIO_SQL = ", ".join([
    sr4("{t} / nullif({t} + {p}, 0)", "precision"), sr4("{t} / nullif({t} + {n}, 0)", "recall"),
    sr4("2 * {t} / nullif(2 * {t} + {p} + {n}, 0)", "f1")])
TOTALS_SQL = """count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    round(avg(abs(fp - fn)) + 1e-7, 4) + 0.0 AS count_mae, count(*) FILTER (fp = fn) AS exact_count_cases,
    count(*) FILTER (fp > fn) AS overcount_cases, count(*) FILTER (fp < fn) AS undercount_cases,
    count(*) FILTER (tp + fn = 0) AS negative_cases, count(*) FILTER (tp + fn = 0 AND fp > 0) AS negative_cases_with_fp,
    CAST(coalesce(sum(fp) FILTER (tp + fn = 0), 0) AS BIGINT) AS negative_fp, """ + RATIO_SQL.format(
        t="sum(tp)", p="sum(fp)", n="sum(fn)")
STATS_SQL = ", ".join(
    sr4(f"avg({x})", f"{x}_mean") + ", " + sr4(f"quantile_cont({x}, 0.5)", f"{x}_median") + ", "
    + sr4(f"quantile_cont({x}, 0.95)", f"{x}_p95") for x in m.ERRORS)
STAT_COLUMNS = [f"{x}_{s}" for x in m.ERRORS for s in ("mean", "median", "p95")]
COUNT_COLUMNS = ["cases", "tp", "fp", "fn", "exact_count_cases", "overcount_cases", "undercount_cases",
                 "negative_cases", "negative_cases_with_fp", "negative_fp"]
RATIO_COLUMNS = ["count_mae", "precision", "recall", "f1"]


def sides(spark, folder):
    rows = a.candidates(spark, folder)
    return a.side(rows, "O"), a.side(rows, "F")


def summary_columns(*keys):
    return [*keys, *COUNT_COLUMNS, *[r4(c) for c in RATIO_COLUMNS]]


@query("pairs_within", a.oracle(f"""
    SELECT p.case_id, p.ord AS left_ord, r.ord AS right_ord, {sr4(dist('p', 'r'), 'distance')}
    FROM pred p JOIN ref r ON p.case_id = r.case_id AND {dist('p', 'r')} <= 5""", "pred", "ref"))
def pairs(spark, folder):
    pred, ref = sides(spark, folder)
    left = pred.select("case_id", F.col("ord").alias("left_ord"), F.col("ostium").alias("left_point"))
    right = ref.select("case_id", F.col("ord").alias("right_ord"), F.col("ostium").alias("right_point"))
    return pairs_within(left, right, ["case_id"], "left_point", "right_point", 5.0).select(
        "case_id", "left_ord", "right_ord", r4("distance"))


@query("nearest_member_distance", a.oracle(f"""
    SELECT p.case_id, p.ord, {sr4('min(' + dist('p', 'r') + ')', 'nearest_mm')}
    FROM pred p LEFT JOIN ref r ON p.case_id = r.case_id AND {dist('p', 'r')} <= 4 GROUP BY 1, 2""", "pred", "ref"))
def nearest_member(spark, folder):
    pred, ref = sides(spark, folder)
    return nearest_within(pred.select("case_id", "ord", "ostium"), ref, ["case_id"], ["ord"], "ostium", "ostium", 4.0
                          ).select("case_id", "ord", r4("nearest_mm"))


ERROR_SQL = ", ".join(sr4(x, x) for x in m.ERRORS)


@query("match_one_to_one", a.oracle(
    f"SELECT case_id, prediction_id, reference_id, {ERROR_SQL} FROM matched", "pred", "ref", extra=matching_sql([5.0])))
def match(spark, folder):
    return match_one_to_one(*sides(spark, folder), [5.0]).select(
        "case_id", "prediction_id", "reference_id", *[r4(x) for x in m.ERRORS])


@query("match_at_tolerances", a.oracle(
    "SELECT tolerance_mm, case_id, prediction_id, reference_id, round(ostium_error_mm + 1e-7, 4) + 0.0 AS ostium_error_mm FROM matched",
    "pred", "ref", extra=matching_sql([2.0, 3.0, 5.0])))
def match_tolerances(spark, folder):
    return match_one_to_one(*sides(spark, folder), [2.0, 3.0, 5.0]).select(
        "tolerance_mm", "case_id", "prediction_id", "reference_id", r4("ostium_error_mm"))


@query("unmatched", a.oracle("""
    SELECT 'prediction' AS side, case_id, instance_id FROM pred p WHERE NOT EXISTS
      (SELECT 1 FROM matched m WHERE m.case_id = p.case_id AND m.prediction_id = p.instance_id)
    UNION ALL SELECT 'reference', case_id, instance_id FROM ref r WHERE NOT EXISTS
      (SELECT 1 FROM matched m WHERE m.case_id = r.case_id AND m.reference_id = r.instance_id)""",
    "pred", "ref", extra=matching_sql([3.0])))
def unmatched_rows(spark, folder):
    pred, ref = sides(spark, folder)
    matches = match_one_to_one(pred, ref, [3.0])
    return unmatched(pred, matches, "prediction_id").select(F.lit("prediction").alias("side"), "*").unionByName(
        unmatched(ref, matches, "reference_id").select(F.lit("reference").alias("side"), "*"))


@query("missing_predictions", a.oracle("""
    SELECT DISTINCT case_id FROM ref WHERE case_id NOT IN (SELECT case_id FROM pred)""", "pred", "ref"))
def missing(spark, folder):
    pred, ref = sides(spark, folder)
    return missing_predictions(ref, pred)


@query("case_confusion", a.oracle(f"""
    SELECT case_id, n_pred AS predicted, n_ref AS reference, tp, fp, fn, fp - fn AS signed_error,
      abs(fp - fn) AS absolute_error, {RATIO_SQL.format(t='tp', p='fp', n='fn')} FROM confusion""",
    "pred", "ref", "cases", extra={**matching_sql([3.0]), **confusion_sql([3.0])}))
def case_confusion(spark, folder):
    per_case, _ = e.evaluate(a.cases(spark, folder), *sides(spark, folder), [3.0])
    return per_case.select("case_id", "predicted", "reference", "tp", "fp", "fn", "signed_error", "absolute_error",
                           r4("precision"), r4("recall"), r4("f1"))


@query("summarize", a.oracle(f"SELECT {TOTALS_SQL} FROM confusion", "pred", "ref", "cases",
                             extra={**matching_sql([3.0]), **confusion_sql([3.0])}))
def summarize(spark, folder):
    per_case, _ = e.evaluate(a.cases(spark, folder), *sides(spark, folder), [3.0])
    return m.summarize(per_case).select(*summary_columns())


@query("error_stats", a.oracle(f"SELECT count(*) AS matches, {STATS_SQL} FROM matched", "pred", "ref",
                               extra=matching_sql([3.0])))
def error_stats(spark, folder):
    stats = m.error_stats(match_one_to_one(*sides(spark, folder), [3.0]))
    return stats.select("matches", *[r4(c) for c in STAT_COLUMNS])


@query("masked_radius_stats", a.oracle(
    "SELECT count(*) AS matches, " + sr4("avg(e)", "radius_error_mm_mean") + ", "
    + sr4("quantile_cont(e, 0.5)", "radius_error_mm_median") + ", " + sr4("quantile_cont(e, 0.95)", "radius_error_mm_p95")
    + " FROM (SELECT CASE WHEN r_ord % 3 <> 0 THEN radius_error_mm END AS e FROM matched)",
    "pred", "ref", extra=matching_sql([3.0])))
def masked_radius_stats(spark, folder):
    pred, ref = sides(spark, folder)
    known = ref.withColumn("radius_known", F.col("ord") % 3 != 0)
    masked = m.mask_unknown_radii(match_one_to_one(pred, ref, [3.0]), known)
    stats = m.error_stats(masked, errors=["radius_error_mm"])
    return stats.select("matches", *[r4(f"radius_error_mm_{s}") for s in ("mean", "median", "p95")])


@query("summarize_by_family", a.oracle(f"""
    SELECT CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'group' END AS scope, family, {TOTALS_SQL}
    FROM confusion GROUP BY GROUPING SETS ((family), ())""", "pred", "ref", "cases",
    extra={**matching_sql([3.0]), **confusion_sql([3.0])}))
def summarize_by_family(spark, folder):
    per_case, _ = e.evaluate(a.cases(spark, folder), *sides(spark, folder), [3.0])
    return m.summarize_by(per_case, "family").select(*summary_columns("scope", "family"))


@query("mirror_check", a.oracle("""
    SELECT c.case_id, coalesce(k.n, 0) AS tp, coalesce(f.n, 0) AS mirror_tp,
      coalesce(f.n, 0) > coalesce(k.n, 0) + 1 AS mirror_suspected
    FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM picked GROUP BY 1) k ON k.case_id = c.case_id
      LEFT JOIN (SELECT case_id, count(*) AS n FROM pickedm GROUP BY 1) f ON f.case_id = c.case_id""",
    "pred", "ref", "cases", extra={**matching_sql([5.0]), **matching_sql([5.0], sign="-", tag="m")}))
def mirror_check(spark, folder):
    pred, ref = sides(spark, folder)
    matches = match_one_to_one(pred, ref, [5.0])
    return m.mirror_check(a.cases(spark, folder), pred, ref, matches, 5.0)


@query("tolerance_report", a.oracle(f"""
    SELECT a.*, b.* EXCLUDE (tolerance_mm) FROM (SELECT tolerance_mm, {TOTALS_SQL} FROM confusion GROUP BY 1) a
    LEFT JOIN (SELECT tolerance_mm, {STATS_SQL} FROM matched GROUP BY 1) b ON a.tolerance_mm = b.tolerance_mm""",
    "pred", "ref", "cases", extra={**matching_sql([2.0, 3.0, 5.0]), **confusion_sql([2.0, 3.0, 5.0])}))
def tolerance_report(spark, folder):
    report = e.tolerance_report(a.cases(spark, folder), *sides(spark, folder))
    return report.select(*summary_columns("tolerance_mm"), *[r4(c) for c in STAT_COLUMNS])


SCORED_CASES = {"recorded": "SELECT * FROM confusion WHERE case_id IN (SELECT case_id FROM pred)"}


def scoring(spark, folder, tolerances=None):
    """Every third reference has a radius that nobody measured."""
    pred, ref = sides(spark, folder)
    known = ref.withColumn("radius_known", F.col("ord") % 3 != 0)
    return e.scoring_report(a.cases(spark, folder), pred.select("case_id"), pred, known, tolerances)


KNOWN = {"known": "SELECT * REPLACE (CASE WHEN r_ord % 3 <> 0 THEN radius_error_mm END AS radius_error_mm) FROM matched"}


@query("scoring_cases", a.oracle(f"""
    SELECT r.case_id, tolerance_mm, n_pred AS predicted, n_ref AS reference, tp, fp, fn, fp - fn AS signed_error, abs(fp - fn) AS absolute_error,
      {RATIO_SQL.format(t='tp', p='fp', n='fn')}, coalesce(f.n, 0) AS mirror_tp, coalesce(f.n, 0) > coalesce(k.n, 0) + 1 AS mirror_suspected
    FROM recorded r LEFT JOIN (SELECT case_id, count(*) AS n FROM picked WHERE tol = 5 GROUP BY 1) k ON k.case_id = r.case_id
      LEFT JOIN (SELECT case_id, count(*) AS n FROM pickedm GROUP BY 1) f ON f.case_id = r.case_id""",
    "pred", "ref", "cases", extra={**matching_sql([2.0, 3.0, 5.0]), **confusion_sql([2.0, 3.0, 5.0]), **SCORED_CASES, **matching_sql([5.0], sign="-", tag="m")}))
def scoring_cases(spark, folder):
    return scoring(spark, folder)["cases"].select("case_id", "tolerance_mm", "predicted", "reference", "tp", "fp", "fn", "signed_error", "absolute_error",
                                                  r4("precision"), r4("recall"), r4("f1"), "mirror_tp", "mirror_suspected")


@query("scoring_matches", a.oracle(f"SELECT tolerance_mm, case_id, prediction_id, reference_id, {ERROR_SQL} FROM known",
                                   "pred", "ref", extra={**matching_sql([2.0, 3.0, 5.0]), **KNOWN}))
def scoring_matches(spark, folder):
    return scoring(spark, folder)["matches"].select("tolerance_mm", "case_id", "prediction_id", "reference_id", *[r4(x) for x in m.ERRORS])


@query("scoring_summary", a.oracle(f"""
    SELECT a.*, b.* EXCLUDE (tolerance_mm) FROM (SELECT tolerance_mm, {TOTALS_SQL} FROM recorded GROUP BY 1) a
    LEFT JOIN (SELECT tolerance_mm, {STATS_SQL} FROM known GROUP BY 1) b ON a.tolerance_mm = b.tolerance_mm""",
    "pred", "ref", "cases", extra={**matching_sql([2.0, 3.0, 5.0]), **confusion_sql([2.0, 3.0, 5.0]), **SCORED_CASES, **KNOWN}))
def scoring_summary(spark, folder):
    return scoring(spark, folder)["summary"].select(*summary_columns("tolerance_mm"), *[r4(c) for c in STAT_COLUMNS])


@query("scoring_mirror", a.oracle("""
    SELECT count(*) FILTER (flipped > plain + 1) AS mirrored_cases, coalesce(bool_or(flipped > plain + 1), FALSE) AS mirror_suspected FROM (
      SELECT coalesce(k.n, 0) AS plain, coalesce(f.n, 0) AS flipped FROM (SELECT DISTINCT case_id FROM pred) c
      LEFT JOIN (SELECT case_id, count(*) AS n FROM picked GROUP BY 1) k ON k.case_id = c.case_id
      LEFT JOIN (SELECT case_id, count(*) AS n FROM pickedm GROUP BY 1) f ON f.case_id = c.case_id)""",
    "pred", "ref", "cases", extra={**matching_sql([3.0]), **matching_sql([3.0], sign="-", tag="m")}))
def scoring_mirror(spark, folder):
    return scoring(spark, folder, [2.0, 3.0])["mirror"]


@query("evaluate_bundle", a.oracle(f"""
    SELECT 'unfiltered' AS variant, CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'group' END AS scope, family, {TOTALS_SQL}
    FROM confusion GROUP BY GROUPING SETS ((family), ())
    UNION ALL
    SELECT 'filtered', CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'group' END, family, {TOTALS_SQL}
    FROM confusionf GROUP BY GROUPING SETS ((family), ())""", "pred", "ref", "cases", extra={
        "scored": SCORED, "strong": "SELECT * FROM scored WHERE side = 'O' AND score >= 0.35",
        **matching_sql([3.0]), **confusion_sql([3.0]),
        **matching_sql([3.0], pred="strong", tag="f"), **confusion_sql([3.0], pred="strong", tag="f")}))
def evaluate_bundle(spark, folder):
    rows = a.candidates(spark, folder)
    report = e.evaluate_bundle(rows.filter(F.col("side") == "O"), a.side(rows, "F"), a.cases(spark, folder), MODEL, 3.0)
    return report.select(*summary_columns("variant", "scope", "family"))

from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.functions.features import LogisticModel, with_feature_vector
from ostiary.plans import workflow as w
from ostiary.plans.catalog import query, r4, sr4
from ostiary.sources import adapters as a

MODEL = LogisticModel(
    mean=[3.2, 0.25, 0.8, 6.9, 5.0, 1.05, 0.5, 25.0, 45.0, 0.5, 0.54, 0.04, 50.0],
    scale=[1.5, 0.16, 0.1, 0.4, 1.0, 0.05, 0.3, 14.0, 26.0, 0.3, 0.03, 0.03, 29.0],
    weights=[0.9, 0.4, 0.3, -0.2, 0.1, 0.15, 0.5, -0.6, 0.35, 0.2, -0.1, -0.3, 0.25],
    bias=0.4, threshold=0.35,
)
FEATURE_SQL = [
    "radius_mm", "mean_vesselness", "evidence_score", "path_length", "5.0", "path_length / greatest(chord, 0.001)",
    "price / 97531", "quantity", "CAST(l_partkey % 90 AS DOUBLE)", "discount * 10", "tax + 0.5", "tax * 0.987::DOUBLE",
    "CAST(l_suppkey % 100 AS DOUBLE)",
]
LOGIT = str(MODEL.bias) + "::DOUBLE" + "".join(
    f" + (({f})::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE * {v}::DOUBLE"
    for f, m, s, v in zip(FEATURE_SQL, MODEL.mean, MODEL.scale, MODEL.weights)
)
SCORED = f"SELECT *, 1 / (1 + exp(-({LOGIT}))) AS score FROM cand"
# Greedy merge in DuckDB: one recursion step per rank, carrying the kept rows of each case as a list.
RANKED = """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN profile = 'strict' THEN 0 ELSE 1 END, ord) AS k
    FROM scored WHERE score >= 0.35"""


def greedy(radius: float, name: str = "alive") -> dict[str, str]:
    """Recursive views for ordered suppression of ``name(case_id, k, ox, oy, oz)``."""
    return {
        "walk(case_id, k, kept)": f"""
          SELECT case_id, k, [{{'k': k, 'x': ox, 'y': oy, 'z': oz}}] FROM {name} WHERE k = 1
          UNION ALL
          SELECT c.case_id, c.k, CASE WHEN len(list_filter(w.kept, lambda p:
              sqrt((p.x - c.ox)*(p.x - c.ox) + (p.y - c.oy)*(p.y - c.oy) + (p.z - c.oz)*(p.z - c.oz)) < {radius})) > 0
            THEN w.kept ELSE list_append(w.kept, {{'k': c.k, 'x': c.ox, 'y': c.oy, 'z': c.oz}}) END
          FROM walk w JOIN {name} c ON c.case_id = w.case_id AND c.k = w.k + 1""",
        "kept": """SELECT case_id, u.k AS k, u.x AS x, u.y AS y, u.z AS z,
            row_number() OVER (PARTITION BY case_id ORDER BY u.k) AS no
          FROM (SELECT case_id, unnest(arg_max(kept, k)) AS u FROM walk GROUP BY case_id)""",
        "suppressed": f"""SELECT c.case_id, c.k, min(p.no) AS no FROM {name} c JOIN kept p
            ON p.case_id = c.case_id AND p.k < c.k
            AND sqrt((p.x - c.ox)*(p.x - c.ox) + (p.y - c.oy)*(p.y - c.oy) + (p.z - c.oz)*(p.z - c.oz)) < {radius}
          WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.case_id = c.case_id AND q.k = c.k)
          GROUP BY c.case_id, c.k""",
    }


def profiles(spark, folder):
    rows = a.candidates(spark, folder)
    return rows.filter(F.col("profile") == "strict"), rows.filter(F.col("profile") == "review")


def decision_log(spark, folder):
    return w.score_before_merge(*profiles(spark, folder), MODEL)


@query("score_before_merge", a.oracle("""
    SELECT s.case_id, s.instance_id, s.profile, round(s.score + 1e-7, 4) + 0.0 AS score,
      CASE WHEN s.score < 0.35 THEN 'below_threshold' WHEN p.no IS NOT NULL THEN 'retained' ELSE 'merged' END AS decision,
      CASE WHEN p.no IS NOT NULL THEN printf('branch_%03d', p.no) END AS output_instance_id,
      CASE WHEN m.no IS NOT NULL THEN printf('branch_%03d', m.no) END AS suppressor_instance_id
    FROM scored s LEFT JOIN alive c ON c.case_id = s.case_id AND c.ord = s.ord
      LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k
      LEFT JOIN suppressed m ON m.case_id = c.case_id AND m.k = c.k""",
    "cand", extra={"scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def score_before_merge(spark, folder):
    return decision_log(spark, folder).select(
        "case_id", "instance_id", "profile", r4("score"), "decision", "output_instance_id", "suppressor_instance_id")


@query("feature_vector", a.oracle(
    "SELECT case_id, instance_id, " + ", ".join(
        sr4(f"({text})::DOUBLE", f"f{i:02d}") for i, text in enumerate(FEATURE_SQL)) + " FROM cand", "cand"))
def features(spark, folder):
    rows = with_feature_vector(a.candidates(spark, folder), "v")
    return rows.select("case_id", "instance_id", *[r4(F.get("v", F.lit(i)), f"f{i:02d}") for i in range(13)])


@query("threshold_filter", a.oracle("""
    SELECT case_id, instance_id, round(score + 1e-7, 4) + 0.0 AS score FROM scored WHERE score >= 0.35""",
    "cand", extra={"scored": SCORED}))
def threshold_filter(spark, folder):
    scored = w.score_candidates(a.candidates(spark, folder), MODEL)
    return w.threshold_filter(scored, MODEL.threshold).select("case_id", "instance_id", r4("score"))


@query("decision_counts", a.oracle("""
    SELECT s.profile, CASE WHEN s.score < 0.35 THEN 'below_threshold' WHEN p.no IS NOT NULL THEN 'retained'
        ELSE 'merged' END AS decision, count(*) AS n
    FROM scored s LEFT JOIN alive c ON c.case_id = s.case_id AND c.ord = s.ord
      LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k GROUP BY 1, 2""",
    "cand", extra={"scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def decision_counts(spark, folder):
    return decision_log(spark, folder).groupBy("profile", "decision").agg(F.count("*").alias("n"))


@query("strict_only", a.oracle("""
    SELECT case_id, instance_id, round(score + 1e-7, 4) + 0.0 AS score FROM scored
    WHERE score >= 0.35 AND profile = 'strict'""", "cand", extra={"scored": SCORED}))
def strict_only(spark, folder):
    return w.strict_only(profiles(spark, folder)[0], MODEL).select("case_id", "instance_id", r4("score"))

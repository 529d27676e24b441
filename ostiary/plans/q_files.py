from __future__ import annotations

from pyspark.sql import functions as F

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.functions.features import FEATURE_NAMES, context_features, evidence_score, with_feature_vector
from ostiary.operators import metrics as m, polyline as pl, reviews as rv
from ostiary.operators.spatial import pairs_within
from ostiary.plans import evaluation as e, workflow as w
from ostiary.plans.catalog import query, r4, sr4
from ostiary.plans.q_learning import LATEST, SPLIT_SQL, latest
from ostiary.plans.q_workflow import MODEL, RANKED, SCORED, decision_log, greedy, profiles
from ostiary.operators.training import split_cases
from ostiary.sources import adapters as a, files as fl

# Documents stand in for case files: a source is a case folder, a document a file.
FILES_SQL = {"files": """SELECT source AS case_id, CASE WHEN doc_id % 7 = 0 THEN 'orig' || doc_id || '.nii.gz' WHEN doc_id % 7 = 3 THEN 'mask' || doc_id || '.nii'
    ELSE 'note' || doc_id || '.txt' END AS name, text, doc_id FROM documents"""}


def files(spark, folder):
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("orig"), key, F.lit(".nii.gz"))).when(
        F.col("doc_id") % 7 == 3, F.concat(F.lit("mask"), key, F.lit(".nii"))).otherwise(F.concat(F.lit("note"), key, F.lit(".txt")))
    rows = a.table(spark, folder, "documents").select("source", "doc_id", name.alias("name"), "text")
    return rows.select(F.col("source").alias("case_id"), "doc_id", "name", F.concat(F.lit("/data/"), "source", F.lit("/"), "name").alias("path"),
                       F.encode("text", "UTF-8").alias("content"))


@query("scan_cases", a.oracle("""
    SELECT case_id, images, masks, CASE WHEN images = 1 AND masks = 1 THEN 'ok' ELSE 'failed' END AS status FROM (
      SELECT case_id, count(*) FILTER (name LIKE 'orig%') AS images, count(*) FILTER (name LIKE 'mask%') AS masks FROM files GROUP BY 1)""", extra=FILES_SQL))
def scan_cases(spark, folder):
    return fl.scan_cases(files(spark, folder)).select("case_id", "images", "masks", "status")


@query("file_availability", a.oracle("""
    SELECT lang AS case_id, bool_and(NOT starts_with(body, 'version https://git-lfs')) AS available, count(*) FILTER (doc_id % 5 = 2 AND doc_id % 333 <> 1) AS gzipped, count(*) AS files FROM (
      SELECT lang, doc_id, CASE WHEN doc_id % 333 = 1 THEN 'version https://git-lfs.github.com/spec/v1' ELSE '' END || text AS body FROM documents) GROUP BY 1"""))
def file_availability(spark, folder):
    pointer = F.when(F.col("doc_id") % 333 == 1, F.lit("version https://git-lfs.github.com/spec/v1")).otherwise(F.lit(""))
    packed = (F.col("doc_id") % 5 == 2) & (F.col("doc_id") % 333 != 1)
    rows = a.table(spark, folder, "documents").select("lang", F.concat(F.when(packed, F.lit(b"\x1f\x8b")).otherwise(F.lit(b"")), F.encode(
        F.concat(pointer, "text"), "UTF-8")).alias("content"))
    return fl.file_availability(rows, F.col("lang"))


@query("checksums", a.oracle("SELECT url AS path, sha256(html) AS sha256 FROM pages"))
def checksums(spark, folder):
    rows = a.table(spark, folder, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return fl.checksums(rows)


@query("verify_checksums", a.oracle("""
    SELECT '/data/' || source || '/' || name AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'mismatch' END AS rule
    FROM (SELECT f.*, case_id AS source FROM files f) WHERE doc_id % 5 = 0 OR doc_id % 4 = 0""", extra=FILES_SQL))
def verify_checksums(spark, folder):
    rows = files(spark, folder)
    manifest = fl.checksums(rows)
    changed = rows.filter("doc_id % 5 <> 0").withColumn("content", F.when(
        F.col("doc_id") % 4 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return fl.verify_checksums(changed, manifest)


@query("build_manifest", a.oracle(f"""
    SELECT case_id, n_docs, part, parts, string_agg(name || '=' || sha256, ',' ORDER BY name) AS files FROM (
      SELECT lang AS case_id, name, sha256(text) AS sha256, count(*) OVER (PARTITION BY lang) AS n_docs,
        (row_number() OVER (PARTITION BY lang ORDER BY name) - 1) // {fl.RECORD_ROWS} AS part, (count(*) OVER (PARTITION BY lang) + {fl.RECORD_ROWS - 1}) // {fl.RECORD_ROWS} AS parts
      FROM (SELECT lang, 'doc' || doc_id AS name, text FROM documents WHERE lang IS NOT NULL)) GROUP BY ALL"""))
def build_manifest(spark, folder):
    documents = a.table(spark, folder, "documents")
    attributes = documents.groupBy(F.col("lang").alias("case_id")).agg(F.count("*").alias("n_docs"))
    rows = documents.select(F.col("lang").alias("case_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    manifest = fl.build_manifest(rows, attributes)
    text = F.transform(F.map_entries("files"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return manifest.select("case_id", "n_docs", "part", "parts", F.array_join(text, ",").alias("files"))


@query("prediction_records", a.oracle("""
    SELECT o.o_orderkey AS case_id, count(p.ord) AS daughters, string_agg(p.instance_id, ',' ORDER BY p.instance_id) AS ids
    FROM orders o LEFT JOIN pred p ON p.case_id = o.o_orderkey GROUP BY 1""", "pred"))
def prediction_records(spark, folder):
    rows = a.side(a.candidates(spark, folder), "O")
    records = fl.prediction_records(a.cases(spark, folder), rows)
    ids = F.array_join(F.transform("daughters", lambda d: d["instance_id"]), ",")
    return records.select("case_id", F.size("daughters").cast("bigint").alias("daughters"), F.when(F.size("daughters") > 0, ids).alias("ids"))


@query("read_predictions", a.oracle(f"""
    SELECT case_id::VARCHAR AS case_id, instance_id, 'aorta' AS parent_instance_id, {sr4('ox', 'ox', 6)}, {sr4('sy', 'sy', 6)}, {sr4('dz', 'dz', 6)}, {sr4('radius_mm', 'radius_mm')} FROM pred""", "pred"))
def read_predictions(spark, folder):
    records = fl.prediction_records(a.cases(spark, folder), a.side(a.candidates(spark, folder), "O"))
    text = records.select(F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("j"))
    rows, _ = fl.flatten_predictions(text.select(F.from_json("j", fl.PREDICTION_SCHEMA).alias("r")).select("r.*"))
    return rows.select("case_id", "instance_id", "parent_instance_id", r4(F.col("ostium.x"), "ox", 6), r4(F.col("seed.y"), "sy", 6),
                       r4(F.col("direction.z"), "dz", 6), r4("radius_mm"))


@query("diagnostic_records", a.oracle("""
    SELECT o.o_orderkey AS case_id, count(s.ord) AS decisions, count(p.no) AS retained FROM orders o LEFT JOIN scored s ON s.case_id = o.o_orderkey
      LEFT JOIN alive c ON c.case_id = s.case_id AND c.ord = s.ord LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k GROUP BY 1""",
    "cand", extra={"scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def diagnostic_records(spark, folder):
    records = fl.diagnostic_records(a.cases(spark, folder).select("case_id"), decision_log(spark, folder), proposals=a.candidates(spark, folder))
    kept = F.filter("workflow.decisions", lambda d: d["decision"] == "retained")
    return records.select("case_id", F.coalesce(F.size("workflow.decisions"), F.lit(0)).cast("bigint").alias("decisions"),
                          F.coalesce(F.size(kept), F.lit(0)).cast("bigint").alias("retained"))


@query("prediction_record_rows", a.oracle(f"""
    SELECT case_id, 0::BIGINT AS part, 1::BIGINT AS parts, 'aorta' AS parent, row_number() OVER (PARTITION BY case_id ORDER BY instance_id) AS place, instance_id,
      'aorta' AS parent_instance_id, {', '.join(sr4(c, c, 6) for c in ('ox', 'oy', 'oz', 'sx', 'sy', 'sz', 'dx', 'dy', 'dz', 'radius_mm'))} FROM pred""", "pred"))
def prediction_record_rows(spark, folder):
    """Every field of every record, in the order of the record."""
    records = fl.prediction_records(a.cases(spark, folder), a.side(a.candidates(spark, folder), "O"))
    rows = records.select("case_id", "part", "parts", F.col("parent.instance_id").alias("parent"), F.posexplode("daughters").alias("i", "d"))
    vectors = [r4(F.get(F.col(f"d.{name}"), F.lit(i)), f"{short}{axis}", 6) for name, short in (("ostium_xyz_mm", "o"), ("seed_xyz_mm", "s"), ("direction_xyz", "d"))
               for i, axis in enumerate("xyz")]
    return rows.select("case_id", "part", "parts", "parent", (F.col("i") + 1).cast("bigint").alias("place"), "d.instance_id", "d.parent_instance_id", *vectors,
                       r4(F.col("d.radius_mm"), "radius_mm", 6))


@query("diagnostic_record_rows", a.oracle(f"""
    SELECT s.case_id, row_number() OVER (PARTITION BY s.case_id ORDER BY s.profile = 'review', s.ord) AS place, s.profile, s.instance_id AS source_instance_id,
      round(s.score + 1e-7, 4) + 0.0 AS score, {', '.join(sr4('s.' + c, c, 6) for c in ('ox', 'sy', 'dz', 'radius_mm'))},
      CASE WHEN s.score < 0.35 THEN 'below_threshold' WHEN p.no IS NOT NULL THEN 'retained' ELSE 'merged' END AS decision,
      CASE WHEN p.no IS NOT NULL THEN printf('branch_%03d', p.no) END AS output_instance_id, CASE WHEN m.no IS NOT NULL THEN printf('branch_%03d', m.no) END AS suppressor_instance_id
    FROM scored s LEFT JOIN alive c ON c.case_id = s.case_id AND c.ord = s.ord LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k
      LEFT JOIN suppressed m ON m.case_id = c.case_id AND m.k = c.k""", "cand", extra={"scored": SCORED, "alive": RANKED, **greedy(3.0)}))
def diagnostic_record_rows(spark, folder):
    records = fl.diagnostic_records(a.cases(spark, folder).select("case_id"), decision_log(spark, folder), proposals=a.candidates(spark, folder))
    rows = records.select("case_id", F.posexplode("workflow.decisions").alias("i", "d"))
    parts = [r4(F.get(F.col(f"d.candidate.{name}"), F.lit(i)), short, 6) for name, i, short in (("ostium_xyz_mm", 0, "ox"), ("seed_xyz_mm", 1, "sy"), ("direction_xyz", 2, "dz"))]
    return rows.select("case_id", (F.col("i") + 1).cast("bigint").alias("place"), "d.profile", "d.source_instance_id", r4(F.col("d.score"), "score"), *parts,
                       r4(F.col("d.candidate.radius_mm"), "radius_mm", 6), "d.decision", "d.output_instance_id", "d.suppressor_instance_id")


@query("read_reviews", a.oracle("""
    SELECT case_id::VARCHAR AS case_id, instance_id, label FROM latest""", "reviews", extra={"latest": LATEST}))
def read_reviews(spark, folder):
    rows = latest(spark, folder).select("case_id", "instance_id", "label", "labeller", "features")
    parsed = rv.export_reviews(rows).select(F.from_json("envelope", fl.REVIEW_SCHEMA).alias("e"), F.col("case_id").cast("string").alias("file"))
    records, _ = fl.flatten_reviews(parsed.select("file", "e.*"))
    return records.select("case_id", "instance_id", "label")


@query("review_file_rules", a.oracle("""
    SELECT case_id::VARCHAR AS file, 'label' AS rule, case_id || '/' || instance_id AS detail FROM reviews WHERE label = 'unreviewed'
    UNION ALL SELECT case_id::VARCHAR, 'features', case_id || '/' || instance_id FROM reviews WHERE value > 90""", "reviews"))
def review_rules(spark, folder):
    rows = a.reviews(spark, folder).select("case_id", "instance_id", "label", "labeller", F.array_repeat(
        F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("value")), 13).alias("features"))
    record = F.struct(F.col("case_id").cast("string").alias("case_id"), "instance_id", "label", "labeller", "features")
    envelopes = rows.select("case_id", F.array(record).alias("records"))
    shaped = envelopes.select(F.col("case_id").cast("string").alias("file"), F.lit(1).alias("schema_version"),
                              F.array(*map(F.lit, FEATURE_NAMES)).alias("feature_names"), F.lit(rv.SCOPE).alias("scope"), "records")
    return fl.flatten_reviews(shaped)[1]


def reviewed(spark, folder):
    """Branches with a fingerprint, and one review per branch of which every fourth is out of date."""
    rows = scale.computed_once(with_feature_vector(a.candidates(spark, folder), "vector"), "fingerprint", rv.fingerprint())
    branches = rows.select("case_id", "instance_id", "ord", "radius_mm", "direction", "seed", "path", "ostium", "fingerprint")
    quantity = F.col("radius_mm") * 10 - 7
    stale = F.col("ord") % 4 == 0
    marks = branches.select("case_id", "instance_id", F.when(F.round(quantity).cast("bigint") % 2 == 0, "confirmed").otherwise("rejected").alias("label"),
                            F.when(stale, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")).alias("fingerprint"), "ord")
    return branches, marks.filter(F.col("ord") % 5 != 0).drop("ord")


STATUS_SQL = """SELECT *, CASE WHEN ord % 5 = 0 OR ord % 4 = 0 THEN 'unreviewed' WHEN quantity::BIGINT % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM cand"""


def case_rows(spark, folder):
    """The cases of :func:`reviewed`, a row for each branch; no case has more reviews than branches."""
    return a.candidates(spark, folder).select("case_id")


def statuses(spark, folder):
    return rv.review_status(*reviewed(spark, folder), case_rows(spark, folder))


@query("review_status", a.oracle("SELECT case_id, instance_id, status FROM statuses", "cand", extra={"statuses": STATUS_SQL}))
def review_status(spark, folder):
    return statuses(spark, folder).select("case_id", "instance_id", "status")


@query("branches_by_review_status", a.oracle("SELECT case_id, instance_id FROM statuses WHERE status = 'confirmed'", "cand", extra={"statuses": STATUS_SQL}))
def by_status(spark, folder):
    return rv.by_review_status(statuses(spark, folder), "confirmed").select("case_id", "instance_id")


@query("next_unreviewed", a.oracle("""
    SELECT case_id, coalesce(min(ord) FILTER (ord > 4), min(ord)) AS next_ord FROM statuses WHERE status = 'unreviewed' GROUP BY 1""", "cand", extra={"statuses": STATUS_SQL}))
def next_unreviewed(spark, folder):
    rows = statuses(spark, folder)
    return rv.next_unreviewed(rows, rows.select("case_id", F.lit(4).cast("bigint").alias("ord")).distinct())


@query("review_progress", a.oracle("""
    SELECT case_id, count(*) FILTER (status <> 'unreviewed') AS reviewed, count(*) AS total, count(*) FILTER (radius_mm < 1.5
      OR radius_mm > 7 OR degrees(acos(least(1, greatest(-1, (dx*(dx*5+1.5) + dy*(dy*5+tax*10) + dz*(dz*5+discount*20)) / chord)))) > 35) AS flagged
    FROM statuses GROUP BY 1""", "cand", extra={"statuses": STATUS_SQL}))
def review_progress(spark, folder):
    from ostiary.operators.quality import self_check

    branches, marks = reviewed(spark, folder)
    # Checked before they are joined: what is joined is short then.
    return rv.review_progress(rv.review_status(self_check(branches), marks, case_rows(spark, folder)))


@query("reconcile_reviews", a.oracle("""
    SELECT case_id, instance_id, case_id % 2 = 0 AND ord % 4 = 0 AS removed FROM cand WHERE ord % 5 <> 0""", "cand"))
def reconcile(spark, folder):
    branches, marks = reviewed(spark, folder)
    rerun = a.cases(spark, folder).filter("case_id % 2 = 0")
    kept, removed = rv.reconcile_reviews(marks, branches, rerun)
    return kept.select("case_id", "instance_id", F.lit(False).alias("removed")).unionByName(
        removed.select("case_id", "instance_id", F.lit(True).alias("removed")))


@query("dataset_overlap", a.oracle("SELECT partition, s.case_id FROM split s WHERE s.case_id IN (SELECT case_id FROM ref)", "ref", "reviews",
                                   extra={"latest": LATEST, **SPLIT_SQL}))
def dataset_overlap(spark, folder):
    split = split_cases(latest(spark, folder), 42)
    return e.dataset_overlap(split, a.side(a.candidates(spark, folder), "F"))


@query("attach_family", a.oracle("SELECT r.case_id, c.family, count(*) AS n FROM ref r LEFT JOIN cases c ON c.case_id = r.case_id GROUP BY 1, 2", "ref", "cases"))
def attach_family(spark, folder):
    counts = a.side(a.candidates(spark, folder), "F").groupBy("case_id").agg(F.count("*").alias("n"))
    return counts.join(a.cases(spark, folder), "case_id", "left").select("case_id", "family", "n")


@query("runtime_stats", a.oracle(f"""
    SELECT {sr4('avg(total)', 'mean_runtime_s')}, {sr4('max(total)', 'max_runtime_s')} FROM (
      SELECT value + CASE WHEN event_type = 'click' THEN 0 ELSE value / 7 END AS total FROM events)"""))
def runtime_stats(spark, folder):
    runs = a.table(spark, folder, "events").select(F.col("value").alias("total_s"), F.when(F.col("event_type") != "click", F.col("value") / 7).alias("filter_s"))
    return m.runtime_stats(runs).select(r4("mean_runtime_s"), r4("max_runtime_s"))


@query("batch_report", a.oracle("""
    SELECT count(*) AS cases, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error') AS ok FROM events"""))
def batch_report(spark, folder):
    return m.batch_report(a.table(spark, folder, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status")))


def edges(spark, folder):
    """Pairs of one case with ostia within 5 mm, the later row left, with paths and first parts."""
    rows = a.candidates(spark, folder).withColumn("arcs", g.arc_lengths(F.col("path"))).withColumn(
        "prefix", g.truncate_path(F.col("path"), F.col("arcs"), F.lit(3.0)))
    names = ["ord", "ostium", "path", "prefix", "radius_mm"]
    left = rows.select("case_id", *[F.col(c).alias(f"l_{c}") for c in names])
    right = rows.select("case_id", *[F.col(c).alias(f"r_{c}") for c in names])
    return pairs_within(left, right, ["case_id"], "l_ostium", "r_ostium", 5.0).filter("r_ord < l_ord")


PAIR_SQL = {"near": """SELECT a.case_id, a.ord AS l_ord, b.ord AS r_ord, a.radius_mm AS lr, b.radius_mm AS rr,
      [[a.ox,a.oy,a.oz],[a.ox+2*a.dx,a.oy+2*a.dy,a.oz+2*a.dz],[a.sx,a.sy,a.sz],[a.sx+1.5,a.sy+a.tax*10,a.sz+a.discount*20]] AS lp,
      [[b.ox,b.oy,b.oz],[b.ox+2*b.dx,b.oy+2*b.dy,b.oz+2*b.dz],[b.sx,b.sy,b.sz],[b.sx+1.5,b.sy+b.tax*10,b.sz+b.discount*20]] AS rp,
      [[a.ox,a.oy,a.oz],[a.ox+2*a.dx,a.oy+2*a.dy,a.oz+2*a.dz],[a.ox+3*a.dx,a.oy+3*a.dy,a.oz+3*a.dz]] AS lq,
      [[b.ox,b.oy,b.oz],[b.ox+2*b.dx,b.oy+2*b.dy,b.oz+2*b.dz],[b.ox+3*b.dx,b.oy+3*b.dy,b.oz+3*b.dz]] AS rq
    FROM cand a JOIN cand b ON b.case_id = a.case_id AND b.ord < a.ord AND sqrt((a.ox-b.ox)**2+(a.oy-b.oy)**2+(a.oz-b.oz)**2) <= 5"""}


def _worst(points: str, path: str, tag: str) -> dict[str, str]:
    """Largest distance of the points from the path's segments, per pair."""
    return {f"seg{tag}": f"""SELECT case_id, l_ord, r_ord, i, {points}[i] AS p, {path}[j] AS a, {path}[j+1] AS b
              FROM near, (SELECT unnest([1,2,3]) AS i), (SELECT unnest([1,2,3]) AS j)""",
            f"far{tag}": f"""SELECT case_id, l_ord, r_ord, max(d) AS d FROM (SELECT case_id, l_ord, r_ord, i, min(sqrt((p[1]-a[1]-t*(b[1]-a[1]))**2
              + (p[2]-a[2]-t*(b[2]-a[2]))**2 + (p[3]-a[3]-t*(b[3]-a[3]))**2)) AS d FROM (SELECT *, greatest(0, least(1,
                ((p[1]-a[1])*(b[1]-a[1])+(p[2]-a[2])*(b[2]-a[2])+(p[3]-a[3])*(b[3]-a[3])) / ((b[1]-a[1])**2+(b[2]-a[2])**2+(b[3]-a[3])**2))) AS t FROM seg{tag})
              GROUP BY ALL) GROUP BY 1, 2, 3"""}


@query("same_trunk", a.oracle("""
    SELECT n.case_id, n.l_ord, n.r_ord, f1.d <= 1.5 AS shares_prefix, f1.d <= greatest(1.5, 1.2 * rr) OR f2.d <= greatest(1.5, 1.2 * lr) AS same_trunk FROM near n
      JOIN far1 f1 ON f1.case_id = n.case_id AND f1.l_ord = n.l_ord AND f1.r_ord = n.r_ord
      JOIN far2 f2 ON f2.case_id = n.case_id AND f2.l_ord = n.l_ord AND f2.r_ord = n.r_ord""", "cand",
    extra={**PAIR_SQL, **_worst("lq", "rp", "1"), **_worst("rq", "lp", "2")}))
def same_trunk(spark, folder):
    sides = [F.col(f"{s}_{c}") for s in "lr" for c in ("path", "prefix", "radius_mm")]
    return edges(spark, folder).select(
        "case_id", "l_ord", "r_ord", pl.shares_prefix(F.col("l_prefix"), F.col("r_path"), F.lit(1.5)).alias("shares_prefix"),
        pl.same_trunk(*sides).alias("same_trunk"))


@query("on_path", a.oracle("""
    SELECT case_id, l_ord, r_ord, list_min(list_transform([1,2], lambda i: list_min(list_transform([2,3,4], lambda j:
      sqrt((lp[i][1]-rp[j][1])**2 + (lp[i][2]-rp[j][2])**2 + (lp[i][3]-rp[j][3])**2))))) < 1.5 AS on_path FROM near""", "cand", extra=PAIR_SQL))
def on_path(spark, folder):
    return edges(spark, folder).select("case_id", "l_ord", "r_ord", pl.on_path(F.col("l_path"), F.col("r_path"), 1.0).alias("on_path"))


@query("evidence_score", a.oracle(f"""
    SELECT event_id, {sr4('greatest(0, least(1, (0.4*least(value/50/0.5, 1) + 0.35*least(value/12/5, 1) + 0.25*least(value/9/10, 1)) * (1 - value/400)))', 'score')} FROM events"""))
def evidence(spark, folder):
    v = F.col("value")
    return a.table(spark, folder, "events").select("event_id", r4(evidence_score(v / 50, v / 12, v / 9, v / 400), "score"))


@query("context_features", a.oracle(f"""
    SELECT event_id, {sr4('(value*3 - 20) / greatest(value - 20, 1)', 'path_hu_relative')}, {sr4('least(value * 2, 50)', 'bone_distance_mm')},
      {sr4('greatest(0, least(1, (value - 10) / greatest(30, 1e-6)))', 'arc_position')} FROM events"""))
def context(spark, folder):
    v = F.col("value")
    parts = context_features(v * 3, v, F.lit(20.0), v * 2, v, F.lit(10.0), F.lit(40.0))
    return a.table(spark, folder, "events").select("event_id", *[r4(c, name) for name, c in parts.items()])


@query("union_profiles", a.oracle("""
    SELECT case_id, instance_id, profile, CASE WHEN profile = 'strict' THEN 0 ELSE 1099511627776 END + ord AS merge_rank FROM cand""", "cand"))
def union_profiles(spark, folder):
    return w.union_profiles(*profiles(spark, folder)).select("case_id", "instance_id", "profile", "merge_rank")


@query("case_intersect", a.oracle("SELECT case_id FROM pred INTERSECT SELECT case_id FROM ref", "pred", "ref"))
def case_intersect(spark, folder):
    rows = a.candidates(spark, folder)
    return a.side(rows, "O").select("case_id").intersect(a.side(rows, "F").select("case_id"))


@query("case_except", a.oracle("SELECT case_id FROM cases EXCEPT SELECT case_id FROM pred", "cases", "pred"))
def case_except(spark, folder):
    wanted = a.cases(spark, folder)
    return wanted.select("case_id").exceptAll(a.side(a.candidates(spark, folder), "O").select("case_id").distinct())


@query("distinct_warnings", a.oracle("""
    SELECT profile, count(DISTINCT warning) AS warnings, string_agg(DISTINCT warning, ',' ORDER BY warning) AS listed FROM (
      SELECT profile, unnest([CASE WHEN radius_mm < 1.5 THEN 'small' ELSE 'wide' END, CASE WHEN tax > 0.04 THEN 'gap' ELSE 'wide' END]) AS warning FROM cand) GROUP BY 1""", "cand"))
def distinct_warnings(spark, folder):
    """Distinct warnings combine map-side as a set of the few warning texts."""
    rows = a.candidates(spark, folder).select("profile", F.explode(F.array(
        F.when(F.col("radius_mm") < 1.5, "small").otherwise("wide"),
        F.when(F.col("features")["connector_gap"] > 0.04, "gap").otherwise("wide"))).alias("warning"))
    return rows.distinct().groupBy("profile").agg(F.count("*").alias("warnings"), F.array_join(F.sort_array(F.collect_list("warning")), ",").alias("listed"))


@query("score_filter_counts", a.oracle("""
    SELECT profile, count(*) FILTER (score >= 0.35) AS kept, count(*) FILTER (score < 0.35) AS rejected FROM scored GROUP BY 1""", "cand", extra={"scored": SCORED}))
def filter_counts(spark, folder):
    scored = w.score_candidates(a.candidates(spark, folder), MODEL)
    return scored.groupBy("profile").agg(F.count_if(F.col("score") >= MODEL.threshold).alias("kept"), F.count_if(F.col("score") < MODEL.threshold).alias("rejected"))

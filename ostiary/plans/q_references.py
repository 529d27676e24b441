from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.functions import geometry as g, naming as n
from ostiary.functions.profiles import profile_configs
from ostiary.operators import metrics as m, quality as q
from ostiary.plans.catalog import query, r4, sr4
from ostiary.sources import adapters as a, references as rf

HEADER_SQL = """SELECT s_suppkey AS case_id, [0.5 + s_suppkey % 5 * 0.25, 0.75::DOUBLE, 1.0 + s_suppkey % 3 * 0.5]::DOUBLE[] AS spacing,
    [s_suppkey % 40 - 20, s_suppkey % 30 * 2, 100 - s_suppkey % 7]::DOUBLE[] AS origin, s_suppkey % 2 = 0 AS flipped FROM supplier"""


def headers(spark, folder):
    key = F.col("s_suppkey")
    rows = a.table(spark, folder, "supplier")
    plain, flipped = [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0, -1, 0, 1, 0, 0, 0, 0, 1]
    return rows.select(
        key.alias("case_id"), F.array(0.5 + key % 5 * 0.25, F.lit(0.75), 1.0 + key % 3 * 0.5).alias("spacing"),
        F.array(*[c.cast("double") for c in (key % 40 - 20, key % 30 * 2, 100 - key % 7)]).alias("origin"),
        F.when(key % 2 == 0, F.array(*[F.lit(float(v)) for v in flipped])).otherwise(
            F.array(*[F.lit(float(v)) for v in plain])).alias("direction"),
        F.array(*[F.lit(16)] * 3).alias("size"), F.lit(1).alias("components"))


def raw_documents(spark, folder):
    """Each order line as one reference document, in one of five layouts by its position in the order."""
    rows = a.candidates(spark, folder)
    x, y, z = g.xyz("ostium")
    sx, sy, sz = g.xyz("seed")
    dx, dy, dz = g.xyz("direction")
    case = F.concat(F.lit("case_"), F.col("case_id").cast("string"))
    layout = F.col("ord") % 5
    fields = F.coalesce(
        F.when(layout == 0, F.to_json(F.struct(case.alias("case_id"), F.array(F.struct(
            F.col("instance_id"), F.array(x, y, z).alias("ostium_xyz_mm"), F.array(sx, sy, sz).alias("seed_xyz_mm"),
            F.array(dx, dy, dz).alias("direction_xyz"), F.col("radius_mm"))).alias("daughters")))),
        F.when(layout == 1, F.to_json(F.array(F.struct(case.alias("subject"), F.array(F.struct(
            F.col("instance_id").alias("id"), F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("ostium"),
            F.array(sx, sy, sz).alias("seed"), (F.col("radius_mm") * 2).alias("diameter_mm"))).alias("branches"))))),
        F.when(layout == 2, F.to_json(F.struct(F.array(F.struct(F.col("case_id").alias("id"), F.array(
            F.struct(F.col("instance_id").alias("label"), F.array(x, y, z).alias("origin"), F.array(dx * 2, dy * 2, dz * 2).alias("dir")),
            F.struct(F.col("instance_id").alias("label"), F.array(sx, sy, sz).alias("origin"), F.array(dx, dy, dz).alias("dir")),
        ).alias("children"))).alias("cases")))),
        F.when(layout == 3, F.to_json(F.create_map(case, F.struct(F.lit("voxel indices").alias("units"), F.create_map(
            F.col("instance_id"), F.struct(F.array(x, y, z).alias("ostium_mm"), F.array(sx, sy, sz).alias("seed_mm"), F.lit(0.0).alias("radius"))
        ).alias("instances"))))),
        F.to_json(F.struct(F.array(F.struct(F.array(x, y, z).alias("ostium_ijk"), F.array(dx, dy, dz).alias("tangent"),
                                            F.col("radius_mm").alias("r_mm"))).alias("daughters"))))
    return rows.select(fields.alias("text"), F.concat(case, F.lit(".nii.gz")).alias("stem"))


def case_headers(spark, folder):
    cases = a.table(spark, folder, "orders").select(n.normalize_case_id(F.col("o_orderkey").cast("string")).alias("case_id"))
    return cases.select("case_id", F.array(F.lit(-10.0), F.lit(20.0), F.lit(100.0)).alias("origin"),
                        F.array(F.lit(0.5), F.lit(0.5), F.lit(2.0)).alias("spacing"),
                        F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("direction"))


NORMAL = """
    SELECT printf('subject%03d', case_id) AS case_id, ord, ord % 5 AS layout, 0 AS index, CASE ord % 5 WHEN 2 THEN instance_id || '_001'
        WHEN 4 THEN 'reference_001' ELSE instance_id END AS instance_id,
      CASE WHEN ord % 5 >= 3 THEN ox * 0.5 - 10 ELSE ox END AS ox, CASE WHEN ord % 5 >= 3 THEN oy * 0.5 + 20 ELSE oy END AS oy,
      CASE WHEN ord % 5 >= 3 THEN oz * 2 + 100 ELSE oz END AS oz,
      CASE WHEN ord % 5 = 3 THEN dx * 0.5 / sqrt((dx*0.5)**2 + (dy*0.5)**2 + (dz*2)**2) ELSE dx END AS dx,
      CASE WHEN ord % 5 = 3 THEN sx * 0.5 - 10 WHEN ord % 5 = 4 THEN ox * 0.5 - 10 + 5 * dx ELSE sx END AS sx,
      CASE WHEN ord % 5 IN (2, 3) THEN 1.0 ELSE radius_mm END AS radius_mm, ord % 5 NOT IN (2, 3) AS radius_known FROM cand
    UNION ALL SELECT printf('subject%03d', case_id), ord, 2, 1, instance_id || '_002', sx, sy, sz, dx, sx + 5 * dx, 1.0, FALSE FROM cand WHERE ord % 5 = 2"""


@query("normalize_references", a.oracle(f"""
    SELECT case_id, index::INTEGER AS index, instance_id, {', '.join(sr4(c, c, 6) for c in ('ox', 'oy', 'oz', 'dx', 'sx', 'radius_mm'))},
      radius_known, NULL::VARCHAR AS problem,
      CASE layout WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN CASE WHEN index = 0 THEN 8 ELSE 7 END WHEN 3 THEN 8 ELSE 5 END::INTEGER AS notes FROM normal""",
    "cand", extra={"normal": NORMAL}))
def normalize(spark, folder):
    rows = rf.normalize_references(rf.split_documents(raw_documents(spark, folder)).withColumn(
        "record", F.concat("record", F.xxhash64(F.to_json("raw")).cast("string"))), case_headers(spark, folder))
    return rows.select(
        "case_id", "index", "instance_id", *[r4(F.col(f"ostium.{c}"), f"o{c}", 6) for c in "xyz"],
        r4(F.col("direction.x"), "dx", 6), r4(F.col("seed.x"), "sx", 6), r4("radius_mm", digits=6), "radius_known", "problem",
        F.size("notes").alias("notes"))


@query("normalize_case_id", a.oracle("""
    SELECT s_name, CASE WHEN s_suppkey % 4 = 3 THEN raw ELSE printf('subject%03d', s_suppkey) END AS case_id FROM
      (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'Case_' || s_suppkey WHEN 1 THEN 'mask' || s_suppkey || '.nii.gz'
        WHEN 2 THEN '000' || s_suppkey ELSE 'patient ' || s_suppkey END AS raw FROM supplier)"""))
def normalize_case_id(spark, folder):
    key = F.col("s_suppkey").cast("string")
    raw = (F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Case_"), key)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("mask"), key, F.lit(".nii.gz")))
           .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("000"), key)).otherwise(F.concat(F.lit("patient "), key)))
    return a.table(spark, folder, "supplier").select("s_name", n.normalize_case_id(raw).alias("case_id"))


@query("case_id_from_path", a.oracle("""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'subject' || page_id ELSE 'orig' || page_id END AS case_id FROM pages"""))
def case_id_from_path(spark, folder):
    key = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/subject"), key, F.lit("/orig.nii.gz"))).otherwise(
        F.concat(F.lit("/data/other/orig"), key, F.lit(".nii.gz")))
    return a.table(spark, folder, "pages").select("page_id", n.case_id_from_path(path).alias("case_id"))


@query("index_to_physical", a.oracle(f"""
    SELECT c.case_id, z, y, x, {sr4('CASE WHEN flipped THEN origin[1] - spacing[2] * y ELSE origin[1] + spacing[1] * x END', 'px')},
      {sr4('CASE WHEN flipped THEN origin[2] + spacing[1] * x ELSE origin[2] + spacing[2] * y END', 'py')},
      {sr4('origin[3] + spacing[3] * z', 'pz')}, x::DOUBLE AS back_x FROM cells c JOIN headers h ON h.case_id = c.case_id""",
    "cells", extra={"headers": HEADER_SQL}))
def index_to_physical(spark, folder):
    joined = a.cells(spark, folder).join(headers(spark, folder), "case_id")
    parts = [F.col(c) for c in ("origin", "spacing", "direction")]
    placed = joined.withColumn("p", g.point(*g.index_to_physical(g.cols("x", "y", "z"), *parts)))
    back = g.physical_to_index(g.xyz("p"), *parts)[0]
    return placed.select("case_id", "z", "y", "x", *[r4(F.col(f"p.{c}"), f"p{c}") for c in "xyz"], r4(back, "back_x"))


@query("validate_headers", a.oracle("""
    SELECT case_id, rule FROM (SELECT s_suppkey AS case_id, unnest(list_filter([
      CASE WHEN s_suppkey % 11 = 0 THEN 'mask_missing' END,
      CASE WHEN s_suppkey % 11 = 0 THEN 'dimension' END, CASE WHEN s_suppkey % 11 = 0 THEN 'components' END,
      CASE WHEN s_suppkey % 11 = 0 THEN 'finite' END,
      CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 THEN 'size' END,
      CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 5 = 0 THEN 'geometry' END,
      CASE WHEN s_suppkey % 13 = 0 THEN 'orthonormal' END], lambda r: r IS NOT NULL)) AS rule FROM supplier)"""))
def validate_headers(spark, folder):
    images = headers(spark, folder)
    key = F.col("case_id")
    masks = images.filter(key % 11 != 0).withColumns({
        "size": F.when(key % 7 == 0, F.array(*[F.lit(15)] * 3)).otherwise(F.col("size")),
        "origin": F.when(key % 5 == 0, F.transform("origin", lambda v: v + 0.001)).otherwise(F.col("origin"))})
    tilted = images.withColumn("direction", F.when(key % 13 == 0, F.transform("direction", lambda v: v * 1.01)).otherwise(F.col("direction")))
    turned = masks.withColumn("direction", F.when(key % 13 == 0, F.transform("direction", lambda v: v * 1.01)).otherwise(F.col("direction")))
    return q.validate_headers(tilted, turned).select("case_id", "rule")


@query("validate_landmarks", a.oracle("""
    SELECT case_id, shown AS instance_id, rule FROM (SELECT case_id, shown, unnest(list_filter([
      CASE WHEN ord = 6 THEN 'identifier' END, CASE WHEN ord = 7 THEN 'parent' END,
      CASE WHEN quantity = 50 THEN 'radius' END, CASE WHEN tax > 0.07 THEN 'unit_direction' END,
      CASE WHEN discount > 0.095 THEN 'seed' END], lambda r: r IS NOT NULL)) AS rule FROM shown)
    UNION ALL SELECT case_id, shown, 'duplicate_identifier' FROM shown GROUP BY 1, 2 HAVING count(*) > 1""",
    "cand", extra={"shown": "SELECT *, CASE WHEN ord = 6 THEN 'aorta' WHEN ord = 5 THEN 'cand_4' ELSE instance_id END AS shown FROM cand"}))
def validate_landmarks(spark, folder):
    rows = a.candidates(spark, folder)
    f = F.col("features")
    bent = rows.select(
        "case_id", F.when(F.col("ord") == 6, "aorta").when(F.col("ord") == 5, "cand_4").otherwise(F.col("instance_id")).alias("instance_id"),
        F.when(F.col("ord") == 7, "other").otherwise("aorta").alias("parent_instance_id"), "ostium",
        F.when(f["arc_position"] > 0.95, F.lit(None)).otherwise(F.col("seed")).alias("seed"),
        g.point(*[c * F.when(f["connector_gap"] > 0.07, 1.02).otherwise(1.0) for c in g.xyz("direction")]).alias("direction"),
        F.when(f["bone_distance_mm"] == 50, F.lit(float("nan"))).otherwise(F.col("radius_mm")).alias("radius_mm"))
    return q.validate_landmarks(bent).select("case_id", "instance_id", "rule")


@query("validate_cells", a.oracle("""
    SELECT case_id, rule FROM (SELECT case_id, unnest(list_filter([
      CASE WHEN count(*) FILTER (value > 999.5) > 0 THEN 'finite' END, CASE WHEN min(label) < 0 THEN 'negative_label' END,
      CASE WHEN count(DISTINCT label) FILTER (label > 0) > 1 THEN 'multiple_labels' END], lambda r: r IS NOT NULL)) AS rule
    FROM (SELECT *, CASE WHEN x = 15 AND case_id % 9 = 0 THEN -1 WHEN x < 3 THEN 1 WHEN case_id % 4 = 0 AND x = 8 THEN 2 ELSE 0 END AS label FROM cells)
    GROUP BY case_id)""", "cells"))
def validate_cells(spark, folder):
    x, key = F.col("x"), F.col("case_id")
    rows = a.cells(spark, folder).withColumns({
        "label": F.when((x == 15) & (key % 9 == 0), -1).when(x < 3, 1).when((key % 4 == 0) & (x == 8), 2).otherwise(0),
        "value": F.when(F.col("value") > 999.5, F.lit(float("inf"))).otherwise(F.col("value"))})
    return q.validate_cells(rows).select("case_id", "rule")


@query("validate_features", a.oracle("""
    SELECT event_id, rule FROM (SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'view' THEN 'length' END,
      CASE WHEN value > 80 THEN 'finite' END], lambda r: r IS NOT NULL)) AS rule FROM events)"""))
def validate_features(spark, folder):
    value = F.when(F.col("value") > 80, F.lit(float("nan"))).otherwise(F.col("value"))
    vector = F.array_repeat(value, F.when(F.col("event_type") == "view", 12).otherwise(13))
    return q.validate_features(a.table(spark, folder, "events").withColumn("features", vector), ["event_id"]).select("event_id", "rule")


CONFIG = """SELECT p_partkey AS profile, unnest(list_filter([
    CASE WHEN p_size % 10 = 0 THEN 'positive' END, CASE WHEN p_size > 45 THEN 'gap_fraction' END,
    CASE WHEN p_partkey % 8 = 0 THEN 'shell' END, CASE WHEN p_retailprice < 905 THEN 'lengths' END,
    CASE WHEN p_partkey % 6 = 5 THEN 'contrast_fraction' END], lambda r: r IS NOT NULL)) AS rule FROM part"""


@query("validate_config", a.oracle(f"SELECT * FROM ({CONFIG})"))
def validate_config(spark, folder):
    """Every part row varies one base configuration."""
    base = profile_configs(spark).filter("profile = 'strict'").drop("profile")
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = a.table(spark, folder, "part").join(F.broadcast(base))  # one row
    varied = rows.withColumns({
        "profile": key, "spacing_mm": F.when(size % 10 == 0, 0.0).otherwise(F.col("spacing_mm")),
        "connector_gap_fraction": F.when(size > 45, 1.0).otherwise(F.col("connector_gap_fraction")),
        "shell_outer_mm": F.when(key % 8 == 0, 30.0).otherwise(F.col("shell_outer_mm")),
        "minimum_path_mm": F.when(F.col("p_retailprice") < 905, 6.0).otherwise(F.col("minimum_path_mm")),
        "support_contrast_fraction": F.when(key % 6 == 5, 1.5).otherwise(F.col("support_contrast_fraction")),
    }).select("profile", *base.columns)
    return q.validate_config(varied.withColumn("profile", F.col("profile").cast("string"))).select(
        F.col("profile").cast("bigint").alias("profile"), "rule")


@query("profile_configs", a.oracle("""
    SELECT l.l_returnflag AS flag, p.profile, count(*) AS lines, p.shell, p.roots FROM lineitem l
      JOIN (VALUES ('strict', 3.5::DOUBLE, 1, 'A'), ('review', 6.0, 6, 'R'), ('finer', 3.5, 1, 'N')) p(profile, shell, roots, flag) ON p.flag = l.l_returnflag
    GROUP BY ALL"""))
def configs(spark, folder):
    flags = F.when(F.col("l_returnflag") == "R", "review").when(F.col("l_returnflag") == "N", "finer").otherwise("strict")
    lines = a.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), flags.alias("profile")).agg(F.count("*").alias("lines"))
    return lines.join(profile_configs(spark), "profile").select(
        "flag", "profile", "lines", F.col("shell_outer_mm").alias("shell"), F.col("roots_per_contact").alias("roots"))


@query("select_cases", a.oracle("""
    SELECT case_id, ord FROM cand WHERE case_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""", "cand"))
def select_cases(spark, folder):
    wanted = a.table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("case_id"))
    return q.select_cases(a.candidates(spark, folder), wanted)[0].select("case_id", "ord")


@query("unknown_cases", a.oracle("""
    SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""))
def unknown_cases(spark, folder):
    return q.select_cases(a.candidates(spark, folder), a.cases(spark, folder))[1]


@query("search_cases", a.oracle("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000001')"))
def search_cases(spark, folder):
    return q.search_cases(a.table(spark, folder, "customer").select("c_custkey", "c_name"), " R#000 0001 ", "c_name")


@query("mirror_xy", a.oracle(f"SELECT case_id, ord, {sr4('-ox', 'ox', 6)}, {sr4('-oy', 'oy', 6)}, {sr4('oz', 'oz', 6)} FROM cand", "cand"))
def mirror_xy(spark, folder):
    return m.mirror(a.candidates(spark, folder)).select("case_id", "ord", *[r4(F.col(f"ostium.{c}"), f"o{c}", 6) for c in "xyz"])

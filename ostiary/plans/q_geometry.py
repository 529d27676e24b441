from __future__ import annotations

from pyspark.sql import functions as F

from ostiary.functions import geometry as g
from ostiary.operators import polyline as pl, quality as q, resolve as rs
from ostiary.operators.ordering import rank_within
from ostiary.operators.suppress import suppress
from ostiary.plans.catalog import query, r4, sr4
from ostiary.plans.q_workflow import greedy
from ostiary.sources import adapters as a

LINE = {"line": "SELECT case_id, ord - 1 AS seq, ox AS x, oy AS y, oz AS z FROM cand",
        "steps": "SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM line WINDOW w AS (PARTITION BY case_id ORDER BY seq)",
        "arcs": """SELECT case_id, seq, x, y, z, coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)))
            OVER (PARTITION BY case_id ORDER BY seq), 0) AS arc FROM steps""",
        "segs": """SELECT * FROM (SELECT case_id, seq, x AS ax, y AS ay, z AS az, arc, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz
            FROM arcs WINDOW w AS (PARTITION BY case_id ORDER BY seq)) WHERE bx IS NOT NULL""",
        # Each case's seeds against the line through its ostia.
        "proj0": """SELECT c.case_id, c.ord, c.sx, c.sy, c.sz, s.seq, s.ax, s.ay, s.az, bx-ax AS vx, by_-ay AS vy, bz-az AS vz,
            greatest(0, least(1, ((sx-ax)*(bx-ax)+(sy-ay)*(by_-ay)+(sz-az)*(bz-az))
              / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)))) AS t
            FROM cand c JOIN segs s ON s.case_id = c.case_id""",
        "proj": "SELECT *, sqrt((sx-ax-t*vx)**2 + (sy-ay-t*vy)**2 + (sz-az-t*vz)**2) AS d FROM proj0"}


def lines(spark, folder):
    rows = a.candidates(spark, folder)
    return rows.select("case_id", (F.col("ord") - 1).alias("seq"), *[F.col(f"ostium.{c}").alias(c) for c in "xyz"])


def seeds(spark, folder):
    return a.candidates(spark, folder).select("case_id", "ord", F.col("seed").alias("point"))


def traced(spark, folder):
    """Branch paths live in their rows, so cutting them needs no grouping."""
    rows = a.candidates(spark, folder).select("case_id", "ord", "path")
    return rows.withColumn("arcs", g.arc_lengths(F.col("path")))


@query("arc_length", a.oracle(f"SELECT case_id, seq, {sr4('arc', 'arc')} FROM arcs", "cand", extra=LINE))
def arc_length(spark, folder):
    return pl.arc_length(lines(spark, folder), ["case_id"]).select("case_id", "seq", r4("arc"))


@query("truncate_path", a.oracle(f"""
    SELECT case_id, ord, 4::BIGINT AS vertices,
      {sr4('least(path_length, 6.8)', 'length')} FROM cand""", "cand"))
def truncate_path(spark, folder):
    cut = g.truncate_path(F.col("path"), F.col("arcs"), F.lit(6.8))
    return traced(spark, folder).withColumn("cut", cut).select(
        "case_id", "ord", F.size("cut").cast("bigint").alias("vertices"), r4(g.path_length(F.col("cut")), "length"))


PART = "least(1, 1.8 / (path_length - 5))"


@query("point_at_arc", a.oracle(f"""
    SELECT case_id, ord, {sr4(f'sx + 1.5 * {PART}', 'x', 6)}, {sr4(f'sy + tax * 10 * {PART}', 'y', 6)},
      {sr4(f'sz + discount * 20 * {PART}', 'z', 6)} FROM cand""", "cand"))
def point_at_arc(spark, folder):
    at = g.point_at_arc(F.col("path"), F.col("arcs"), F.lit(6.8))
    return traced(spark, folder).withColumn("p", at).select("case_id", "ord", *[r4(F.col(f"p.{c}"), c, 6) for c in "xyz"])


@query("nearest_on_polyline", a.oracle(f"""
    SELECT c.case_id, c.ord, {sr4('coalesce(p.d, sqrt((c.sx-c.ox)**2+(c.sy-c.oy)**2+(c.sz-c.oz)**2))', 'nearest_mm')},
      {sr4('coalesce(p.seq + p.t, 0)', 'position')} FROM cand c LEFT JOIN (SELECT *, row_number() OVER
      (PARTITION BY case_id, ord ORDER BY d, seq) AS n FROM proj) p ON p.case_id = c.case_id AND p.ord = c.ord AND p.n = 1""",
    "cand", extra=LINE))
def nearest_on_polyline(spark, folder):
    found = pl.nearest_on_polyline(seeds(spark, folder), lines(spark, folder), ["case_id"], ["ord"])
    return found.select("case_id", "ord", r4("nearest_mm"), r4("position"))


LONG_LINE = {
    "long": """SELECT o_orderpriority AS case_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS seq,
        o_orderkey * 0.05::DOUBLE AS x, o_totalprice / 10000 AS y, (o_orderkey % 5)::DOUBLE AS z FROM orders""",
    "span": """SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM long WINDOW w AS (PARTITION BY case_id ORDER BY seq)""",
    "spot": """SELECT c_custkey AS id, p.o_orderpriority AS case_id, c_custkey * 0.5::DOUBLE AS x, c_acctbal / 100 AS y, CASE WHEN c_custkey % 50 = 0 THEN 5000.0::DOUBLE ELSE 1.0 END AS z
        FROM customer JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)) p ON p.i = c_custkey % 5""",
    "shot": """SELECT s.id, l.*, greatest(0, least(1, ((s.x-l.x)*(x2-l.x) + (s.y-l.y)*(y2-l.y) + (s.z-l.z)*(z2-l.z))
        / greatest((x2-l.x)**2 + (y2-l.y)**2 + (z2-l.z)**2, 1e-8))) AS t, s.x AS px, s.y AS py, s.z AS pz FROM spot s JOIN span l ON l.case_id = s.case_id WHERE x2 IS NOT NULL""",
}


@query("nearest_on_long_line", a.oracle(f"""
    SELECT id, {sr4('min(sqrt((px-x-t*(x2-x))**2 + (py-y-t*(y2-y))**2 + (pz-z-t*(z2-z))**2))', 'nearest_mm')} FROM shot GROUP BY 1""", extra=LONG_LINE))
def nearest_on_long_line(spark, folder):
    """Five lines through all orders and points at customers, some of them far away: no line fits one row."""
    orders = a.table(spark, folder, "orders")
    vertices = orders.select(F.col("o_orderpriority").alias("case_id"), (F.col("o_orderkey") * 0.05).alias("x"), (F.col("o_totalprice") / 10000).alias("y"),
                             (F.col("o_orderkey") % 5).cast("double").alias("z"), "o_orderkey")
    line = rank_within(vertices, ["case_id"], ["o_orderkey"], "seq").withColumn("seq", F.col("seq") - 1).drop("o_orderkey")
    cases = sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect())  # five priorities
    key = F.col("c_custkey")
    spots = a.table(spark, folder, "customer").select(key.alias("id"), F.get(F.array(*map(F.lit, cases)), (key % 5).cast("int")).alias("case_id"), g.point(
        key * 0.5, F.col("c_acctbal") / 100, F.when(key % 50 == 0, 5000.0).otherwise(1.0)).alias("point"))
    return pl.nearest_on_polyline(spots, line, ["case_id"], ["id"]).select("id", r4("nearest_mm"))


@query("nearest_sample", a.oracle(f"""
    SELECT case_id, ord, {sr4('d', 'nearest_mm')}, seq AS index, {sr4('seq / nullif(last, 0)', 'progress')} FROM (
      SELECT c.case_id, c.ord, l.seq, max(l.seq) OVER (PARTITION BY c.case_id) AS last,
        sqrt((c.sx-l.x)**2+(c.sy-l.y)**2+(c.sz-l.z)**2) AS d,
        row_number() OVER (PARTITION BY c.case_id, c.ord ORDER BY (c.sx-l.x)**2+(c.sy-l.y)**2+(c.sz-l.z)**2, l.seq) AS n
      FROM cand c JOIN line l ON l.case_id = c.case_id) WHERE n = 1""", "cand", extra=LINE))
def nearest_sample(spark, folder):
    found = pl.nearest_sample(seeds(spark, folder), lines(spark, folder), ["case_id"], ["ord"])
    return found.select("case_id", "ord", r4("nearest_mm"), "index", r4("progress"))


@query("stop_at_junction", a.oracle(f"""
    SELECT c.case_id, c.ord, {sr4('least(path_length, coalesce(min(along) FILTER (d <= 1.5 AND along > 0), path_length))', 'length')}
    FROM cand c LEFT JOIN best b ON b.case_id = c.case_id AND b.ord = c.ord GROUP BY c.case_id, c.ord, path_length""", "cand", extra={
        "verts": """SELECT case_id, ord, unnest([
            {'i': 0, 'arc': 0.0::DOUBLE, 'a': [ox, oy, oz], 'b': [ox+2*dx, oy+2*dy, oz+2*dz], 'len': 2.0::DOUBLE},
            {'i': 1, 'arc': 2.0::DOUBLE, 'a': [ox+2*dx, oy+2*dy, oz+2*dz], 'b': [sx, sy, sz], 'len': 3.0::DOUBLE},
            {'i': 2, 'arc': 5.0::DOUBLE, 'a': [sx, sy, sz], 'b': [sx+1.5, sy+tax*10, sz+discount*20], 'len': path_length - 5}]) AS s FROM cand""",
        "hits": """SELECT v.case_id, v.ord, j.ord AS junction, s.i AS i, s.arc AS arc, s.len AS len, s.a AS a, s.b AS b, [j.sx, j.sy, j.sz] AS p
            FROM verts v JOIN cand j ON j.case_id = v.case_id""",
        "cut0": """SELECT *, greatest(0, least(1, ((p[1]-a[1])*(b[1]-a[1])+(p[2]-a[2])*(b[2]-a[2])+(p[3]-a[3])*(b[3]-a[3]))
            / ((b[1]-a[1])**2+(b[2]-a[2])**2+(b[3]-a[3])**2))) AS t FROM hits""",
        "cut1": """SELECT *, sqrt((p[1]-a[1]-t*(b[1]-a[1]))**2+(p[2]-a[2]-t*(b[2]-a[2]))**2+(p[3]-a[3]-t*(b[3]-a[3]))**2) AS d,
            arc + t*len AS along FROM cut0""",
        "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, ord, junction ORDER BY round(d, 9), i) AS n FROM cut1) WHERE n = 1"""}))
def stop_at_junction(spark, folder):
    rows = a.candidates(spark, folder).select("case_id", "ord", "path", "seed")
    stopped = pl.stop_at_junction(rows, rows.select("case_id", F.col("seed").alias("junction")), ["case_id"], ["ord"], 1.5)
    return stopped.select("case_id", "ord", r4(g.path_length(F.col("path")), "length"))


@query("self_check", a.oracle(f"""
    SELECT case_id, ord, {sr4('angle', 'chord_angle')},
      concat_ws(',', CASE WHEN angle > 35 THEN 'direction_diverges' END, CASE WHEN ord % 6 = 5 THEN 'seed_off_path' END,
        CASE WHEN radius_mm < 1.5 OR radius_mm > 7 THEN 'radius_near_limit' END) AS warnings
    FROM (SELECT *, degrees(acos(least(1, greatest(-1, (dx*(dx*5+1.5) + dy*(dy*5+tax*10) + dz*(dz*5+discount*20)) / chord)))) AS angle FROM cand)""", "cand"))
def self_check(spark, folder):
    """Every sixth seed is moved away from its path."""
    x, y, z = g.xyz("seed")
    rows = a.candidates(spark, folder).withColumn("seed", F.when(F.col("ord") % 6 == 5, g.point(x, y, z + 50)).otherwise(F.col("seed")))
    return q.self_check(rows).select("case_id", "ord", r4("chord_angle"), F.concat_ws(",", "warnings").alias("warnings"))


@query("origin_eligibility", a.oracle("""
    SELECT case_id, ord, coalesce(d > 0 AND d + 0.5 + tax < 2, FALSE) AS rejected,
      CASE WHEN d IS NULL THEN 'unresolved' WHEN d < 2 THEN 'near_minimum' END AS origin_warning
    FROM (SELECT *, CASE WHEN ord % 5 <> 0 THEN radius_mm * 0.8::DOUBLE END AS d FROM cand)""", "cand"))
def origin_eligibility(spark, folder):
    rows = a.candidates(spark, folder).select(
        "case_id", "ord", F.when(F.col("ord") % 5 != 0, F.col("radius_mm") * 0.8).alias("origin_diameter_mm"),
        F.col("features")["native_spacing_mm"].alias("native_spacing_mm"))
    return q.origin_eligibility(rows).select("case_id", "ord", "rejected", "origin_warning")


GATE_SQL = """CASE WHEN vol > 90 THEN 'broad_wall_contact' WHEN pts = 0 THEN 'no_supported_5mm_path' WHEN pts < 3 THEN 'short_path'
    WHEN NOT linked THEN 'disconnected_ostium' WHEN len < 6.2 THEN 'short_proximal_segment' WHEN disp < 3.5 THEN 'wall_hugging_path'
    WHEN radius_mm < 1.0 THEN 'small_radius' WHEN radius_mm * 2 > 8 * 2 THEN 'wide_nonarterial_region'
    WHEN od IS NOT NULL AND od + 0.5 + tax < 2 THEN 'origin_below_minimum_diameter' WHEN mean_vesselness < 0.06 THEN 'weak_tubularity'
    WHEN hu > 300 + 0.1 * 200 THEN 'hyperdense_wall_structure' END"""
GATED = {"traces": """SELECT *, CAST(l_suppkey % 100 AS DOUBLE) AS vol, (l_partkey % 29) AS pts, l_suppkey % 17 <> 0 AS linked,
    path_length AS len, 3.2::DOUBLE + discount * 40 AS disp, CASE WHEN ord % 5 <> 0 THEN radius_mm * 0.8::DOUBLE END AS od, price / 300 AS hu FROM cand"""}


def gated(spark, folder):
    rows = a.candidates(spark, folder)
    f = F.col("features")
    # Supplier and part numbers are recovered from the features that carry them.
    lines_ = rank_within(a.table(spark, folder, "lineitem"), ["l_orderkey"], a.LINE_ORDER, "ord").select(
        F.col("l_orderkey").alias("case_id"), "ord", "l_partkey", "l_suppkey")
    joined = rows.join(lines_, ["case_id", "ord"])
    return joined.select(
        "case_id", "ord", "radius_mm", "mean_vesselness", f["candidate_volume_mm3"].alias("volume_mm3"),
        (F.col("l_partkey") % 29).alias("path_points"), (F.col("l_suppkey") % 17 != 0).alias("connected"),
        g.path_length(F.col("path")).alias("path_length_mm"), (3.2 + f["arc_position"] * 4).alias("displacement_mm"),
        F.when(F.col("ord") % 5 != 0, F.col("radius_mm") * 0.8).alias("origin_diameter_mm"),
        f["native_spacing_mm"].alias("native_spacing_mm"), (f["path_hu_relative"] * 97531 / 300).alias("path_hu"),
        F.lit(300.0).alias("median_hu"), F.lit(100.0).alias("background_hu"))


def gates():
    return q.proposal_gates(parallel=True, minimum_radius=1.0, minimum_path=6.2, broad=90.0)


@query("first_failed_gate", a.oracle(f"SELECT case_id, ord, {GATE_SQL} AS reason FROM traces", "cand", extra=GATED))
def first_failed_gate(spark, folder):
    return gated(spark, folder).select("case_id", "ord", q.first_failed_gate(gates()).alias("reason"))


@query("rejection_histogram", a.oracle(f"""
    SELECT case_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS rejections FROM
      (SELECT case_id, {GATE_SQL} AS reason, count(*) AS n FROM traces GROUP BY 1, 2) WHERE reason IS NOT NULL GROUP BY 1""", "cand", extra=GATED))
def rejection_histogram(spark, folder):
    from ostiary.operators.metrics import rejection_histogram as histogram

    counted = histogram(gated(spark, folder).withColumn("reason", q.first_failed_gate(gates())))
    text = F.transform(F.map_entries("rejections"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counted.select("case_id", F.array_join(text, ",").alias("rejections"))


@query("profile_summary", a.oracle(f"""
    SELECT case_id, profile, count(*) AS roots, count(*) FILTER (({GATE_SQL}) IS NULL) AS proposals, count({GATE_SQL}) AS rejections
    FROM traces GROUP BY 1, 2""", "cand", extra=GATED))
def profile_summary(spark, folder):
    from ostiary.operators.metrics import profile_summary as summary

    profiles = a.candidates(spark, folder).select("case_id", "ord", "profile")
    return summary(gated(spark, folder).withColumn("reason", q.first_failed_gate(gates())).join(profiles, ["case_id", "ord"]))


@query("rank_candidates", a.oracle("""
    SELECT case_id, instance_id, rank, CASE WHEN rank > 3 THEN 'over_candidate_limit' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY radius_mm DESC, oz, oy, ox) AS rank FROM cand)""", "cand"))
def rank_candidates(spark, folder):
    order = [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]
    return rs.rank_candidates(a.candidates(spark, folder), ["case_id"], order, 3).select("case_id", "instance_id", "rank", "reason")


@query("candidate_limit_warning", a.oracle("""
    SELECT case_id, count(*) AS candidates FROM cand GROUP BY 1 HAVING count(*) > 3""", "cand"))
def over_limit(spark, folder):
    return rs.over_limit(a.candidates(spark, folder), ["case_id"], 3)


@query("renumber", a.oracle("""
    SELECT case_id, ord, printf('branch_%03d', row_number() OVER (PARTITION BY case_id ORDER BY oz, oy, ox, ord)) AS instance_id FROM cand""", "cand"))
def renumber(spark, folder):
    return rs.renumber(a.candidates(spark, folder), ["case_id"], ["ord"]).select("case_id", "ord", "instance_id")


@query("suppress", a.oracle("""
    SELECT c.case_id, c.k AS ord, CASE WHEN p.no IS NOT NULL THEN 'retained' ELSE 'merged' END AS decision,
      p.no AS output_no, m.no AS suppressor_no FROM alive c LEFT JOIN kept p ON p.case_id = c.case_id AND p.k = c.k
      LEFT JOIN suppressed m ON m.case_id = c.case_id AND m.k = c.k""", "cand",
    extra={"alive": "SELECT *, ord AS k FROM cand", **greedy(3.0)}))
def suppress_all(spark, folder):
    rows = a.candidates(spark, folder).select("case_id", "ord", "ostium")
    return suppress(rows, ["case_id"], "ord", "ostium", 3.0).select("case_id", "ord", "decision", "output_no", "suppressor_no")


@query("pool_union", a.oracle("""
    SELECT case_id, instance_id, FALSE AS added FROM cand WHERE profile = 'review'
    UNION ALL SELECT a.case_id, a.instance_id, TRUE FROM alive a JOIN kept k ON k.case_id = a.case_id AND k.k = a.k""", "cand", extra={
        "alive": """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS k FROM cand s WHERE profile = 'strict' AND NOT EXISTS (
            SELECT 1 FROM cand r WHERE r.case_id = s.case_id AND r.profile = 'review'
            AND sqrt((r.ox-s.ox)*(r.ox-s.ox) + (r.oy-s.oy)*(r.oy-s.oy) + (r.oz-s.oz)*(r.oz-s.oz)) < 3)""", **greedy(3.0)}))
def pool_union(spark, folder):
    rows = a.candidates(spark, folder).select("case_id", "instance_id", "ord", "profile", "ostium")
    pool = rs.pool_union(rows.filter("profile = 'review'"), rows.filter("profile = 'strict'"), ["case_id"], "ord")
    return pool.select("case_id", "instance_id", "added")


_POINTS = "[[{0}.ox,{0}.oy,{0}.oz],[{0}.ox+2*{0}.dx,{0}.oy+2*{0}.dy,{0}.oz+2*{0}.dz],[{0}.sx,{0}.sy,{0}.sz],[{0}.sx+1.5,{0}.sy+{0}.tax*10,{0}.sz+{0}.discount*20]]"
_PREFIX = "[[{0}.ox,{0}.oy,{0}.oz],[{0}.ox+2*{0}.dx,{0}.oy+2*{0}.dy,{0}.oz+2*{0}.dz],[{0}.ox+3*{0}.dx,{0}.oy+3*{0}.dy,{0}.oz+3*{0}.dz]]"


def _off(point: str, path: str) -> str:
    """Distance of a point from the nearest of a path's three segments."""
    v = [f"({path}[j+1][{i}]-{path}[j][{i}])" for i in (1, 2, 3)]
    w = [f"({point}[{i}]-{path}[j][{i}])" for i in (1, 2, 3)]
    dot = "+".join(f"{x}*{y}" for x, y in zip(v, w))
    t = f"greatest(0, least(1, ({dot}) / ({'+'.join(f'{x}**2' for x in v)})))"
    return f"list_min(list_transform([1,2,3], lambda j: sqrt({'+'.join(f'({y}-{t}*{x})**2' for x, y in zip(v, w))})))"


def _trunk(prefix: str, path: str, radius: str) -> str:
    return f"list_max(list_transform({prefix}, lambda p: {_off('p', path)})) <= greatest(1.5, 1.2 * {radius})"


def _lies(a_path: str, b_path: str) -> str:
    return f"""list_min(list_transform([1,2], lambda i: list_min(list_transform([2,3,4], lambda j: sqrt(
      ({a_path}[i][1]-{b_path}[j][1])**2 + ({a_path}[i][2]-{b_path}[j][2])**2 + ({a_path}[i][3]-{b_path}[j][3])**2))))) < 1.5"""


def walked(parallel: bool) -> dict[str, str]:
    """Views of the sequential walk: pairs of a case with why they conflict, then one row after the other."""
    return {
        "rk": "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY radius_mm DESC, oz, oy, ox) AS k FROM cand",
        "pair": f"""SELECT a.case_id, a.k AS k, b.k AS e, a.radius_mm AS ar, b.radius_mm AS br, sqrt((a.ox-b.ox)**2+(a.oy-b.oy)**2+(a.oz-b.oz)**2) AS gap,
            sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2+(a.sz-b.sz)**2) AS seeds, {_POINTS.format('a')} AS ap, {_POINTS.format('b')} AS bp,
            {_PREFIX.format('a')} AS aq, {_PREFIX.format('b')} AS bq FROM rk a JOIN rk b ON b.case_id = a.case_id AND b.k < a.k""",
        "edge": f"""SELECT case_id, k, list({{'e': e, 'reason': CASE WHEN gap < greatest(2.5, ar + br) THEN CASE WHEN gap < 2.5 AND seeds < 3
              THEN 'same_opening_and_path' WHEN {_trunk('aq', 'bp', 'br')} OR {_trunk('bq', 'ap', 'ar')} THEN 'common_trunk' END END,
              'on_other': {_lies('ap', 'bp') if parallel else 'FALSE'}, 'under': {_lies('bp', 'ap') if parallel else 'FALSE'}}} ORDER BY e) AS es FROM pair GROUP BY ALL""",
        "ready": "SELECT r.case_id, r.k, coalesce(es, []) AS es FROM rk r LEFT JOIN edge e ON e.case_id = r.case_id AND e.k = r.k",
        "walk(case_id, k, kept, gone)": """
            SELECT case_id, k, [k], [{'k': k, 'reason': NULL::VARCHAR}][1:0] FROM ready WHERE k = 1
            UNION ALL
            SELECT case_id, k, CASE WHEN reason IS NULL THEN list_append(list_filter(kept, lambda x: NOT list_contains(below, x)), k) ELSE kept END,
              list_concat(gone, CASE WHEN reason IS NOT NULL THEN [{'k': k, 'reason': reason}]
                ELSE list_transform(below, lambda x: {'k': x, 'reason': 'opening_on_another_path'}) END)
            FROM (SELECT *, coalesce(list_filter(live, lambda e: e.reason IS NOT NULL)[1].reason,
                CASE WHEN len(list_filter(live, lambda e: e.on_other)) > 0 THEN 'opening_on_another_path' END) AS reason,
                list_transform(list_filter(live, lambda e: e.under), lambda e: e.e) AS below
              FROM (SELECT r.case_id, r.k, w.kept, w.gone, list_filter(r.es, lambda e: list_contains(w.kept, e.e)) AS live
                FROM walk w JOIN ready r ON r.case_id = w.case_id AND r.k = w.k + 1))""",
        "outcome": "SELECT case_id, unnest(arg_max(gone, k)) AS g FROM walk GROUP BY case_id",
    }


RESOLVED = """SELECT r.case_id, instance_id, r.k AS rank, o.g.reason AS reason FROM rk r LEFT JOIN outcome o ON o.case_id = r.case_id AND o.g.k = r.k"""


def proposals(spark, folder):
    return a.candidates(spark, folder).select("case_id", "instance_id", "ostium", "seed", "radius_mm", "path")


@query("resolve_candidates", a.oracle(RESOLVED, "cand", extra=walked(False)))
def resolve(spark, folder):
    order = [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]
    done = rs.resolve_candidates(proposals(spark, folder), ["case_id"], order)
    return done.select("case_id", "instance_id", "rank", "reason")


@query("resolve_parallel", a.oracle(RESOLVED, "cand", extra=walked(True)))
def resolve_parallel(spark, folder):
    order = [F.col("radius_mm").desc(), "ostium.z", "ostium.y", "ostium.x"]
    done = rs.resolve_candidates(proposals(spark, folder), ["case_id"], order, parallel_clearance=2.5)
    return done.select("case_id", "instance_id", "rank", "reason")


SMOOTH = 1.0


@query("smooth_series", a.oracle(f"""
    SELECT case_id, seq, {sr4('sum(w * x) / sum(w)', 'x', 6)}, {sr4('sum(w * y) / sum(w)', 'y', 6)} FROM (
      SELECT l.case_id, l.seq, exp(-0.5 * (o / {SMOOTH}) ** 2) AS w, s.x, s.y FROM line l
        JOIN (SELECT case_id, count(*) AS n FROM line GROUP BY 1) c ON c.case_id = l.case_id
        CROSS JOIN (SELECT unnest(range(-4, 5)) AS o) k
        JOIN line s ON s.case_id = l.case_id AND s.seq = CASE WHEN ((l.seq + o) % (2*n) + 2*n) % (2*n) < n
          THEN ((l.seq + o) % (2*n) + 2*n) % (2*n) ELSE 2*n - 1 - ((l.seq + o) % (2*n) + 2*n) % (2*n) END)
    GROUP BY 1, 2""", "cand", extra={"line": LINE["line"]}))
def smooth(spark, folder):
    return pl.smooth_series(lines(spark, folder), ["case_id"], ["x", "y"], SMOOTH).select("case_id", "seq", r4("x", digits=6), r4("y", digits=6))


RAYS = """SELECT vec_id, i AS ray, embedding[1 + i * 2] * 100::DOUBLE AS first, embedding[2 + i * 2] * 100::DOUBLE AS second FROM embeddings, range(32) r(i)"""


@query("first_crossing", a.oracle(f"""
    SELECT vec_id, ray, CASE WHEN 12 + first <= 10 THEN NULL WHEN 8 + second <= 10
      THEN round(0.25 * (12 + first - 10) / ((12 + first) - (8 + second)) + 1e-7, 4) + 0.0
      ELSE round(0.25 + 0.25 * (8 + second - 10) / (8 + second + 40) + 1e-7, 4) + 0.0 END AS crossing_mm FROM rays""", extra={"rays": RAYS}))
def first_crossing(spark, folder):
    return pl.first_crossing(rays(spark, folder), 10.0).select("vec_id", "ray", r4("crossing_mm"))


def rays(spark, folder):
    """32 rays of three samples per embedding: two embedding values and a low end."""
    rows = a.table(spark, folder, "embeddings")
    ray = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(
        12 + F.get("embedding", i * 2).cast("double") * 100, 8 + F.get("embedding", i * 2 + 1).cast("double") * 100, F.lit(-40.0))))
    return rows.select("vec_id", ray.alias("ray", "samples")).withColumn("ray", F.col("ray").cast("bigint"))


@query("wall_crossing", a.oracle(f"""
    SELECT vec_id, ray, CASE WHEN 12 + first <= 0 THEN NULL WHEN 8 + second <= 0 THEN
        CASE WHEN ray % 2 = 0 THEN round((12 + first) / ((12 + first) - (8 + second)) + 1e-7, 4) + 0.0 END
      ELSE round(1 + (8 + second) / (8 + second + 40) + 1e-7, 4) + 0.0 END AS crossing_at FROM rays""", extra={"rays": RAYS}))
def wall_crossing(spark, folder):
    """Connectors with an unsupported middle sample on odd rays; up to 35 % may be unsupported."""
    supported = F.array(F.lit(True), F.col("ray") % 2 == 0, F.lit(True))
    connectors = rays(spark, folder).withColumn("supported", supported)
    return pl.wall_crossing(connectors, 0.35).select("vec_id", "ray", r4("crossing_at"))


@query("cross_section_radius", a.oracle(f"""
    SELECT vec_id, CASE WHEN count(d) >= 12 AND NOT bool_or(low) THEN round(median(d) / 2 + 1e-7, 4) + 0.0 END AS radius_mm FROM (
      SELECT p.vec_id, p.c + q.c AS d, p.low OR q.low AS low FROM crossed p JOIN crossed q ON q.vec_id = p.vec_id AND q.ray = p.ray + 16)
    GROUP BY 1""", extra={"rays": RAYS, "crossed": """SELECT vec_id, ray, 12 + first <= -15 AS low, CASE WHEN 12 + first <= -15 THEN NULL
      WHEN 8 + second <= -15 THEN 0.25 * (12 + first + 15) / ((12 + first) - (8 + second))
      ELSE 0.25 + 0.25 * (8 + second + 15) / (8 + second + 40) END AS c FROM rays"""}))
def section_radius(spark, folder):
    crossed = pl.first_crossing(rays(spark, folder), -15.0)
    return pl.cross_section_radius(crossed, ["vec_id"]).select("vec_id", r4("radius_mm"))

from __future__ import annotations

from pyspark.sql import functions as F

from ostiary import scale
from ostiary.functions import geometry as g
from ostiary.functions.profiles import settings
from ostiary.operators import cells as c, graph, polyline as pl, resolve as rs, rings
from ostiary.plans.catalog import query, r4, sr4
from ostiary.plans.q_geometry import LINE, lines
from ostiary.plans.q_references import headers
from ostiary.sources import adapters as a

CONFIG = settings("strict")
WINDOW = {
    "deep": "SELECT case_id, count(*) FILTER (inside >= 2) AS n FROM cells GROUP BY 1",
    "core": "SELECT c.case_id, value FROM cells c JOIN deep d ON d.case_id = c.case_id WHERE CASE WHEN d.n >= 20 THEN inside >= 2 ELSE parent END",
    "core1": "SELECT case_id, median(value) AS med FROM core GROUP BY 1",
    "core2": "SELECT c.case_id, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS mad FROM core c JOIN core1 m ON m.case_id = c.case_id GROUP BY 1",
    "bg1": "SELECT case_id, median(value) AS med FROM cells WHERE outside BETWEEN 8 AND 16 GROUP BY 1",
    "bg2": """SELECT c.case_id, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS mad FROM cells c JOIN bg1 m ON m.case_id = c.case_id
        WHERE outside BETWEEN 8 AND 16 GROUP BY 1""",
    "w0": """SELECT o.case_id, o.med, o.mad, coalesce(b.med, o.med) AS bg, coalesce(b.mad, 0) AS bgmad,
        least(0.5, 1.2 * 0.7**2 / (0.7**2 + (0.6 * (1.0 + o.case_id % 3 * 0.5))**2)) AS f FROM core2 o LEFT JOIN bg2 b ON b.case_id = o.case_id""",
    "win": """SELECT *, CASE WHEN bg < med THEN greatest(30, bg + f * (med - bg)) ELSE greatest(30, med - greatest(65, 2.5 * mad)) END AS lower,
        med + greatest(120, 3.5 * mad) AS upper, (med - bg) / greatest(bgmad, 1) AS contrast FROM w0""",
    "supported": """SELECT c.*, w.lower, w.upper, (value BETWEEN lower AND upper AND (tubular >= 0.5 OR outside <= 1.5) AND outside <= 16) OR parent AS support
        FROM cells c JOIN win w ON w.case_id = c.case_id""",
}


def spacing(spark, folder):
    return a.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("case_id"), (1.0 + F.col("s_suppkey") % 3 * 0.5).alias("native_spacing_mm"))


def window(spark, folder):
    """The cells are derived once: the window reads them several times."""
    return c.intensity_window(scale.checkpoint(a.cells(spark, folder)), spacing(spark, folder), CONFIG)


def supported(spark, folder):
    """Cells with their support flag, written once for all that reads them."""
    cells = scale.checkpoint(a.cells(spark, folder))
    limits = c.intensity_window(cells, spacing(spark, folder), CONFIG).select("case_id", "lower", "upper")
    return scale.checkpoint(c.support_cells(scale.per_group(cells, limits, ["case_id"]), 0.5))


def shell(spark, folder):
    return c.shell_cells(supported(spark, folder).withColumn("excluded", F.lit(False)), 1.5, 6.0, 0.3)


SHELL = {**WINDOW, "shell": "SELECT * FROM supported WHERE support AND outside BETWEEN 1.5 AND 6.0 AND tubular >= 0.3"}


def components_sql(source: str, connectivity: int = 26, tag: str = "") -> dict[str, str]:
    """Smallest reachable member per cell, updated per key until nothing changes."""
    faces = "" if connectivity == 26 else "AND abs(p.z-q.z) + abs(p.y-q.y) + abs(p.x-q.x) = 1"
    return {
        f"nodes{tag}": f"SELECT case_id, z, y, x, case_id * 4096 + z * 256 + y * 16 + x AS id FROM {source}",
        f"links{tag}": f"""SELECT p.id AS a, q.id AS b FROM nodes{tag} p, (SELECT unnest([-1,0,1]) AS i) i, (SELECT unnest([-1,0,1]) AS j) j,
            (SELECT unnest([-1,0,1]) AS k) k, nodes{tag} q WHERE q.case_id = p.case_id AND q.z = p.z+i AND q.y = p.y+j AND q.x = p.x+k
            AND q.id <> p.id {faces}""",
        f"comp{tag}(id, label) USING KEY (id)": f"""SELECT id, id FROM nodes{tag} UNION
            SELECT l.a, min(v.label) FROM recurring.comp{tag} u, links{tag} l, comp{tag} v
            WHERE u.id = l.a AND v.id = l.b AND v.label < u.label GROUP BY l.a""",
        f"labelled{tag}": f"SELECT n.*, c.label FROM nodes{tag} n JOIN comp{tag} c ON c.id = n.id",
    }


def label():
    return (F.col("case_id") * 4096 + F.col("component.z") * 256 + F.col("component.y") * 16 + F.col("component.x")).alias("label")


@query("intensity_window", a.oracle(f"""
    SELECT case_id, {', '.join(sr4(e, n) for e, n in (('med', 'median'), ('mad', 'mad'), ('lower', 'lower'), ('upper', 'upper'),
      ('bg', 'background_median'), ('bgmad', 'background_mad'), ('f', 'support_fraction'), ('contrast', 'contrast_to_mad')))},
      concat_ws(',', CASE WHEN med < 120 THEN 'low_parent_contrast' END, CASE WHEN contrast <= 1 THEN 'intensities_overlap' END) AS warnings FROM win""",
    "cells", extra=WINDOW))
def intensity_window(spark, folder):
    return window(spark, folder).select("case_id", *[r4(n) for n in (
        "median", "mad", "lower", "upper", "background_median", "background_mad", "support_fraction", "contrast_to_mad")],
        F.concat_ws(",", "warnings").alias("warnings"))


@query("support_cells", a.oracle("SELECT case_id, z, y, x, support FROM supported", "cells", extra=WINDOW))
def support(spark, folder):
    return supported(spark, folder).select("case_id", "z", "y", "x", "support")


@query("shell_cells", a.oracle("SELECT case_id, z, y, x FROM shell", "cells", extra=SHELL))
def shell_query(spark, folder):
    return shell(spark, folder).select("case_id", "z", "y", "x")


@query("plane_slice", a.oracle(f"""
    SELECT case_id, z, x, {sr4('least(255, greatest(0, (value - 220 + 350) / 700 * 255))', 'shown')} FROM cells WHERE y = 7""", "cells"))
def plane_slice(spark, folder):
    return c.plane_slice(a.cells(spark, folder), "y", 7, 220.0, 700.0).select("case_id", "z", "x", r4("shown"))


@query("percentile_normalize", a.oracle(f"""
    SELECT c.case_id, z, y, x, {sr4('greatest(0, least(1, value / greatest(p, 1e-6)))', 'normalized', 6)} FROM cells c
      LEFT JOIN (SELECT case_id, quantile_cont(value, 0.995) AS p FROM cells WHERE outside > 0 AND outside <= 15 GROUP BY 1) k ON k.case_id = c.case_id""", "cells"))
def percentile_normalize(spark, folder):
    return c.percentile_normalize(a.cells(spark, folder), "value").select("case_id", "z", "y", "x", r4("normalized", digits=6))


BOUNDS = {"bounds": """SELECT h.case_id, greatest(min(x) - ceil(4 / (0.5 + h.case_id % 5 * 0.25)), 0)::BIGINT AS lo_x,
    least(max(x) + ceil(4 / (0.5 + h.case_id % 5 * 0.25)), 15)::BIGINT AS hi_x, greatest(min(y) - 6, 0)::BIGINT AS lo_y, least(max(y) + 6, 15)::BIGINT AS hi_y,
    greatest(min(z) - ceil(4 / (1 + h.case_id % 3 * 0.5)), 0)::BIGINT AS lo_z, least(max(z) + ceil(4 / (1 + h.case_id % 3 * 0.5)), 15)::BIGINT AS hi_z
    FROM cells c JOIN (SELECT s_suppkey AS case_id FROM supplier) h ON h.case_id = c.case_id WHERE parent GROUP BY 1"""}


@query("roi_bounds", a.oracle("SELECT * FROM bounds", "cells", extra=BOUNDS))
def roi_bounds(spark, folder):
    return c.roi_bounds(a.cells(spark, folder), headers(spark, folder), 4.0)


@query("crop", a.oracle("""SELECT c.case_id, z, y, x FROM cells c JOIN bounds b ON b.case_id = c.case_id
    WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z""", "cells", extra=BOUNDS))
def crop(spark, folder):
    rows = a.cells(spark, folder)
    return c.crop(rows, c.roi_bounds(rows, headers(spark, folder), 4.0)).select("case_id", "z", "y", "x")


@query("neighbour_count", a.oracle("""
    SELECT n.case_id, z, y, x, count(l.b) AS neighbours FROM nodes n LEFT JOIN links l ON l.a = n.id GROUP BY ALL""", "cells",
    extra={k: v for k, v in components_sql("cells").items() if k in ("nodes", "links")}))
def neighbour_count(spark, folder):
    return graph.neighbour_count(a.cells(spark, folder), ["case_id"], 26)


@query("neighbour_pairs_faces", a.oracle("SELECT p.case_id, a, b FROM links l JOIN nodes p ON p.id = l.a", "cells",
    extra={k: v for k, v in components_sql("cells", 6).items() if k in ("nodes", "links")}))
def neighbour_pairs(spark, folder):
    pairs = graph.neighbour_pairs(a.cells(spark, folder), ["case_id"], 6)
    base = F.col("case_id") * 4096
    return pairs.select("case_id", (base + F.col("z") * 256 + F.col("y") * 16 + F.col("x")).alias("a"),
                        (base + F.col("nz") * 256 + F.col("ny") * 16 + F.col("nx")).alias("b"))


@query("connected_components", a.oracle("SELECT case_id, z, y, x, label FROM labelled", "cells", extra={**SHELL, **components_sql("shell")}))
def components(spark, folder):
    return graph.label_cells(shell(spark, folder), ["case_id"], 26).select("case_id", "z", "y", "x", label())


@query("connected_components_faces", a.oracle("SELECT case_id, z, y, x, label FROM labelled", "cells", extra=components_sql("cells", 6)))
def components_faces(spark, folder):
    return graph.label_cells(a.cells(spark, folder), ["case_id"], 6).select("case_id", "z", "y", "x", label())


BLOBS = """SELECT case_id, label, count(*) AS cells, count(*)::DOUBLE AS volume_mm3, min(z) AS lo_z, max(z) AS hi_z, min(y) AS lo_y, max(y) AS hi_y,
    min(x) AS lo_x, max(x) AS hi_x FROM labelled GROUP BY 1, 2 HAVING count(*) >= pi() * 0.7 ** 2"""


@query("blob_stats", a.oracle(BLOBS, "cells", extra={**SHELL, **components_sql("shell")}))
def blob_stats(spark, folder):
    stats = c.blob_stats(graph.label_cells(shell(spark, folder), ["case_id"], 26), 1.0, 0.7)
    return stats.select("case_id", label(), "cells", "volume_mm3", *[f"{n}_{ax}" for ax in "zyx" for n in ("lo", "hi")])


def labelled_shell(spark, folder):
    rows = shell(spark, folder)
    return rows.join(graph.label_cells(rows, ["case_id"], 26), ["case_id", "z", "y", "x"])


ROOT_CELLS = {**SHELL, **components_sql("shell"), "alive": """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY quality DESC, z, y, x) AS k FROM (
    SELECT l.label AS case_id, s.z, s.y, s.x, s.x::DOUBLE AS ox, s.y::DOUBLE AS oy, s.z::DOUBLE AS oz, s.radius * (s.tubular + 0.3) AS quality,
      s.outside <= 3.5 AS near, bool_or(s.outside <= 3.5) OVER (PARTITION BY l.label) AS walled FROM shell s JOIN labelled l
      ON l.case_id = s.case_id AND l.z = s.z AND l.y = s.y AND l.x = s.x) WHERE near OR NOT walled"""}


def _roots_sql(k: int) -> str:
    from ostiary.plans.q_workflow import greedy

    return a.oracle(f"""SELECT a.case_id AS label, a.z, a.y, a.x, {sr4('quality', 'quality')}, p.no::INTEGER AS pick FROM alive a
        JOIN kept p ON p.case_id = a.case_id AND p.k = a.k WHERE p.no <= {k}""", "cells", extra={**ROOT_CELLS, **greedy(4.0)})


@query("blob_roots", _roots_sql(1))
def blob_roots(spark, folder):
    return c.blob_roots(labelled_shell(spark, folder), 1).select(label(), "z", "y", "x", r4("quality"), "pick")


@query("blob_roots_six", _roots_sql(6))
def blob_roots_six(spark, folder):
    return c.blob_roots(labelled_shell(spark, folder), 6).select(label(), "z", "y", "x", r4("quality"), "pick")


PARENTS = {**components_sql("(SELECT * FROM cells WHERE parent)", 6),
           "boxes": "SELECT case_id, label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labelled GROUP BY 1, 2 HAVING count(*) >= 8",
           "slabs": """SELECT *, CASE WHEN z1-z0 >= y1-y0 AND z1-z0 >= x1-x0 THEN 'z' WHEN y1-y0 >= x1-x0 THEN 'y' ELSE 'x' END AS axis FROM boxes"""}


@query("cap_cells", a.oracle("""
    SELECT c.case_id, z, y, x, EXISTS (SELECT 1 FROM slabs s WHERE s.case_id = c.case_id AND c.z BETWEEN z0-3 AND z1+3 AND c.y BETWEEN y0-3 AND y1+3
      AND c.x BETWEEN x0-3 AND x1+3 AND CASE axis WHEN 'z' THEN c.z < z0+2 OR c.z > z1-2 WHEN 'y' THEN c.y < y0+2 OR c.y > y1-2 ELSE c.x < x0+2 OR c.x > x1-2 END) AS excluded
    FROM cells c""", "cells", extra=PARENTS))
def cap_cells(spark, folder):
    return c.cap_cells(a.cells(spark, folder), 2.0, 3.0).select("case_id", "z", "y", "x", "excluded")


_OFF_CENTRE = "sqrt((s.x-c.cx)**2 + (s.y-c.cy)**2 + (s.z-c.cz)**2)"
CROSSINGS = {
    **SHELL, **{k: v for k, v in components_sql("shell", tag="s").items() if k in ("nodess", "linkss")},
    "knots": """SELECT n.case_id, n.z, n.y, n.x FROM nodess n JOIN shell h ON h.case_id = n.case_id AND h.z = n.z AND h.y = n.y AND h.x = n.x
        JOIN (SELECT a, count(*) AS n FROM linkss GROUP BY 1 HAVING count(*) >= 3) l ON l.a = n.id WHERE NOT h.parent""",
    **components_sql("knots", tag="k"),
    "centres": "SELECT case_id, label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM labelledk GROUP BY 1, 2",
    "arms": f"""SELECT c.label AS case_id, s.z, s.y, s.x, {_OFF_CENTRE} AS d FROM centres c JOIN shell s ON s.case_id = c.case_id
        WHERE {_OFF_CENTRE} > 2 AND {_OFF_CENTRE} <= 5""",
    **components_sql("arms", tag="a"),
    "reaching": """SELECT l.case_id AS junction, l.label FROM labelleda l JOIN arms a ON a.case_id = l.case_id AND a.z = l.z AND a.y = l.y AND a.x = l.x
        GROUP BY 1, 2 HAVING min(d) <= 3.5 AND max(d) >= 4""",
}


@query("junctions", a.oracle(f"""
    SELECT c.case_id, {sr4('cx', 'cx')}, {sr4('cy', 'cy')}, {sr4('cz', 'cz')}, n AS arms FROM centres c
      JOIN (SELECT junction, count(*) AS n FROM reaching GROUP BY 1 HAVING count(*) >= 3) r ON r.junction = c.label""", "cells", extra=CROSSINGS))
def junctions(spark, folder):
    found = c.junctions(shell(spark, folder).select("case_id", "z", "y", "x", "parent"))
    return found.select("case_id", *[r4(F.col(f"centre.{ax}"), f"c{ax}") for ax in "xyz"], "arms")


_OFF_PLANE = "(c.z-k.cz)**2 + (c.y-k.cy)**2 + (c.x-k.cx)**2"
CENTRE_LINE = {
    "axis": """SELECT case_id, CASE WHEN max(z)-min(z) >= max(y)-min(y) AND max(z)-min(z) >= max(x)-min(x) THEN 'z' WHEN max(y)-min(y) >= max(x)-min(x) THEN 'y'
        ELSE 'x' END AS axis FROM cells WHERE parent GROUP BY 1""",
    "placed": "SELECT c.*, CASE axis WHEN 'z' THEN z WHEN 'y' THEN y ELSE x END AS level FROM cells c JOIN axis a ON a.case_id = c.case_id WHERE parent",
    "centres": """SELECT case_id, level, sum(z * inside**2) / sum(inside**2) AS cz, sum(y * inside**2) / sum(inside**2) AS cy, sum(x * inside**2) / sum(inside**2) AS cx
        FROM placed GROUP BY 1, 2""",
    "snapped": f"""SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY level) - 1 AS seq, count(*) OVER (PARTITION BY case_id) AS n FROM (
        SELECT c.case_id, c.level, c.z::DOUBLE AS z, c.y::DOUBLE AS y, c.x::DOUBLE AS x,
          row_number() OVER (PARTITION BY c.case_id, c.level ORDER BY {_OFF_PLANE}, c.z, c.y, c.x) AS place
        FROM placed c JOIN centres k ON k.case_id = c.case_id AND k.level = c.level) WHERE place = 1""",
    "smooth": """SELECT l.case_id, l.seq, sum(w * s.z) / sum(w) AS sz, sum(w * s.y) / sum(w) AS sy, sum(w * s.x) / sum(w) AS sx FROM (
        SELECT case_id, seq, n, o, exp(-0.5 * (o / 2.0) ** 2) AS w, (((seq + o) % (2*n)) + 2*n) % (2*n) AS turn FROM snapped, (SELECT unnest(range(-8, 9)) AS o)) l
        JOIN snapped s ON s.case_id = l.case_id AND s.seq = CASE WHEN turn < l.n THEN turn ELSE 2*l.n - 1 - turn END GROUP BY 1, 2""",
}


@query("slice_curve", a.oracle(f"""
    SELECT s.case_id, s.level, {', '.join(sr4(f'CASE WHEN m.case_id IS NULL THEN s.{c} ELSE k.s{c} END', c) for c in 'zyx')} FROM snapped s
      JOIN smooth k ON k.case_id = s.case_id AND k.seq = s.seq LEFT JOIN placed m ON m.case_id = s.case_id
        AND m.z = round_even(sz, 0) AND m.y = round_even(sy, 0) AND m.x = round_even(sx, 0)""", "cells", extra=CENTRE_LINE))
def slice_curve(spark, folder):
    return c.slice_curve(a.cells(spark, folder)).select("case_id", "level", *[r4(ax) for ax in ("z", "y", "x")])


def axes():
    return [F.col(ax).cast("double").alias(ax) for ax in "xyz"]


def axis_sql(points: str, key: str) -> dict[str, str]:
    """Leading eigenvector per key: the covariance matrix squared again and again, scaled to trace 1, tends to its projector."""
    square = {"a": "a*a + b*b + c*c", "b": "a*b + b*d + c*e", "c": "a*c + b*e + c*f", "d": "b*b + d*d + e*e", "e": "b*c + d*e + e*f", "f": "c*c + e*e + f*f"}
    trace = f"({square['a']} + {square['d']} + {square['f']})"
    return {
        "cov": f"""SELECT {key}, count(*) AS n, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d,
            covar_pop(y, z) AS e, covar_pop(z, z) AS f FROM {points} GROUP BY ALL""",
        f"powers({key}, i, a, b, c, d, e, f)": f"""
            SELECT {key}, 0, a / (a + d + f), b / (a + d + f), c / (a + d + f), d / (a + d + f), e / (a + d + f), f / (a + d + f) FROM cov WHERE a + d + f > 0
            UNION ALL SELECT {key}, i + 1, {', '.join(f'({s}) / {trace}' for s in square.values())} FROM powers WHERE i < 16""",
        "main_lines": f"""SELECT {key}, CASE WHEN a >= d AND a >= f THEN [a, b, c] WHEN d >= f THEN [b, d, e] ELSE [c, e, f] END AS v FROM powers WHERE i = 16""",
        "directions": f"SELECT {key}, list_transform(v, lambda u: u / sqrt(v[1]**2 + v[2]**2 + v[3]**2)) AS v FROM main_lines",
    }


MEMBERS = {"members": "SELECT case_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM supported WHERE support"}


@query("principal_axis", a.oracle(f"""
    SELECT p.case_id, {', '.join(sr4(f'abs(any_value(v[{i}]))', n) for i, n in ((1, 'ax'), (2, 'ay'), (3, 'az')))},
      {sr4('max(x * v[1] + y * v[2] + z * v[3]) - min(x * v[1] + y * v[2] + z * v[3])', 'extent')}
    FROM members p JOIN directions d ON d.case_id = p.case_id GROUP BY 1""", "cells", extra={**WINDOW, **MEMBERS, **axis_sql("members", "case_id")}))
def principal_axis(spark, folder):
    points = supported(spark, folder).filter("support").select("case_id", *axes())
    found = c.principal_axis(points, ["case_id"])
    return found.select("case_id", r4(F.abs(F.col("axis.x")), "ax"), r4(F.abs(F.col("axis.y")), "ay"), r4(F.abs(F.col("axis.z")), "az"),
                        r4(F.col("high") - F.col("low"), "extent"))


NEAR = {
    "probes": "SELECT (l_suppkey % 100)::BIGINT AS case_id, case_id AS owner, ord, ox, oy, oz, dx, dy, dz FROM cand",
    "near": """SELECT p.case_id, p.owner, p.ord, c.x::DOUBLE AS x, c.y::DOUBLE AS y, c.z::DOUBLE AS z FROM probes p JOIN cells c ON c.case_id = p.case_id
        AND c.parent AND abs(c.x - ox) <= 12 AND abs(c.y - oy) <= 12 AND abs(c.z - oz) <= 12""",
}


@query("parent_angle", a.oracle(f"""
    SELECT p.case_id, p.ord, {sr4('coalesce(degrees(acos(least(1.0, abs(v[1] * dx + v[2] * dy + v[3] * dz)))), 90)', 'parent_angle', 2)}
    FROM probes p LEFT JOIN (SELECT d.* FROM directions d JOIN cov USING (case_id, owner, ord) WHERE n >= 3) d
      ON d.case_id = p.case_id AND d.owner = p.owner AND d.ord = p.ord""",
    "cells", "cand", extra={**NEAR, **axis_sql("near", "case_id, owner, ord")}))
def parent_angle(spark, folder):
    members = a.cells(spark, folder).filter("parent").select("case_id", "x", "y", "z")
    probes = a.candidates(spark, folder).select(
        F.col("features")["candidate_volume_mm3"].cast("bigint").alias("case_id"), F.struct("case_id", "ord").alias("probe"),
        F.col("ostium").alias("point"), "direction")
    return c.parent_angle(probes, members, ["case_id"], ["probe"], 12.0).select("case_id", "probe.ord", r4("parent_angle", digits=2))


@query("coverage", a.oracle(f"""
    SELECT v.case_id, {sr4('n / 1000', 'volume_ml')}, {sr4('len', 'length_mm')} FROM (SELECT case_id, count(*) AS n FROM cells GROUP BY 1) v
      LEFT JOIN (SELECT case_id, max(arc) AS len FROM arcs GROUP BY 1 HAVING count(*) > 1) l ON l.case_id = v.case_id""", "cells", "cand", extra=LINE))
def coverage(spark, folder):
    return c.coverage(a.cells(spark, folder), pl.line_length(lines(spark, folder), ["case_id"])).select(
        "case_id", r4("volume_ml"), r4("length_mm"))


@query("max_projection", a.oracle("""
    SELECT case_id, z, x, round(max(value) + 1e-7, 4) + 0.0 AS value, bool_or(parent) AS parent FROM cells GROUP BY 1, 2, 3""", "cells"))
def max_projection(spark, folder):
    return c.max_projection(a.cells(spark, folder), "y").select("case_id", "z", "x", r4("value"), "parent")


def roots(cells):
    """Supported cells a few steps outside the parent stand in for candidate roots."""
    return cells.filter("support AND NOT parent AND outside >= 3").select(
        "case_id", "z", "y", "x", F.struct("z", "y", "x").alias("root_id"))


def moved_roots(spark, folder):
    cells = supported(spark, folder)
    return c.relocate_root(roots(cells), cells.withColumn("excluded", F.col("y") == 0))


WALK = {**WINDOW, "lumen": "SELECT case_id, z, y, x FROM supported WHERE support AND NOT parent AND y <> 0",
        "touch": """SELECT DISTINCT l.* FROM lumen l JOIN cells p ON p.case_id = l.case_id AND p.parent AND abs(p.z-l.z)+abs(p.y-l.y)+abs(p.x-l.x) = 1""",
        "starts": "SELECT case_id, z, y, x FROM supported WHERE support AND NOT parent AND outside >= 3",
        "hops": """SELECT p.case_id, p.z, p.y, p.x, q.z AS nz, q.y AS ny, q.x AS nx FROM lumen p JOIN lumen q ON q.case_id = p.case_id
            AND abs(p.z-q.z)+abs(p.y-q.y)+abs(p.x-q.x) = 1""",
        "walk(case_id, rz, ry, rx, z, y, x, d)": """SELECT s.case_id, s.z, s.y, s.x, s.z, s.y, s.x, 0 FROM starts s SEMI JOIN lumen l
              ON l.case_id = s.case_id AND l.z = s.z AND l.y = s.y AND l.x = s.x
            UNION SELECT w.case_id, rz, ry, rx, h.nz, h.ny, h.nx, d + 1 FROM walk w JOIN hops h ON h.case_id = w.case_id AND h.z = w.z AND h.y = w.y AND h.x = w.x WHERE d < 6""",
        "ends": """SELECT w.case_id, rz, ry, rx, min({'d': d, 'z': w.z, 'y': w.y, 'x': w.x}) AS e FROM walk w SEMI JOIN touch t
            ON t.case_id = w.case_id AND t.z = w.z AND t.y = w.y AND t.x = w.x GROUP BY 1, 2, 3, 4"""}


@query("relocate_root", a.oracle("""
    SELECT s.case_id, s.z, s.y, s.x, e.e.z AS to_z, e.e.y AS to_y, e.e.x AS to_x, e.e.d::DOUBLE AS walk_mm FROM starts s
      LEFT JOIN ends e ON e.case_id = s.case_id AND e.rz = s.z AND e.ry = s.y AND e.rx = s.x""", "cells", extra=WALK))
def relocate_root(spark, folder):
    moved = moved_roots(spark, folder)
    return moved.select("case_id", "z", "y", "x", *[F.col(f"relocated.{ax}").alias(f"to_{ax}") for ax in "zyx"], "walk_mm")


def recovery(spark, folder):
    moved = moved_roots(spark, folder)
    rank = F.col("z") * 256 + F.col("y") * 16 + F.col("x")
    return moved.select("case_id", "z", "y", "x", rank.cast("bigint").alias("rank"), F.col("x").cast("double").alias("quality"),
                        (F.col("y") * 100.0).alias("volume_mm3"), "relocated",
                        F.when(F.col("z") % 3 == 0, "short_path").otherwise("disconnected_ostium").alias("reason"))


@query("add_recovered", a.oracle("""
    SELECT case_id, z, y, x, added, p AS position, CASE WHEN p > 2 THEN 'over_candidate_limit' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY added, rank) AS p FROM (
      SELECT case_id, z, y, x, z * 256 + y * 16 + x AS rank, FALSE AS added FROM starts
      UNION ALL SELECT case_id, z, y, x, min(rank), TRUE FROM (
        SELECT case_id, e.z AS z, e.y AS y, e.x AS x, rz * 256 + ry * 16 + rx AS rank FROM ends WHERE rz % 3 <> 0 AND ry * 100 <= 1200) n
        WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.case_id = n.case_id AND s.z = n.z AND s.y = n.y AND s.x = n.x) GROUP BY 1, 2, 3, 4))""",
    "cells", extra=WALK))
def add_recovered(spark, folder):
    rows = scale.checkpoint(recovery(spark, folder))  # read three times
    return c.add_recovered(rows, rows, 2).select("case_id", "z", "y", "x", "added", "position", "reason")


# Distance of the point 3 mm above the ostium from each of a path's three segments.
FOLLOWED = {"shares": """SELECT *, greatest(0, least(1, 3*dy / 2)) AS t1,
      greatest(0, least(1, (-2*dx*3*dx + (3-2*dy)*3*dy - 2*dz*3*dz) / 9)) AS t2,
      greatest(0, least(1, (-5*dx*1.5 + (3-5*dy)*tax*10 - 5*dz*discount*20) / (1.5**2 + (tax*10)**2 + (discount*20)**2))) AS t3 FROM cand"""}


@query("follows_root", a.oracle("""
    SELECT case_id, ord FROM shares WHERE least(
      sqrt((2*dx*t1)**2 + (3 - 2*dy*t1)**2 + (2*dz*t1)**2),
      sqrt((2*dx + 3*dx*t2)**2 + (3 - 2*dy - 3*dy*t2)**2 + (2*dz + 3*dz*t2)**2),
      sqrt((5*dx + 1.5*t3)**2 + (3 - 5*dy - tax*10*t3)**2 + (5*dz + discount*20*t3)**2)) <= radius_mm""", "cand", extra=FOLLOWED))
def follows_root(spark, folder):
    rows = a.candidates(spark, folder).withColumn("root_id", F.col("ord"))
    x, y, z = g.xyz("ostium")
    marks = rows.select("case_id", "root_id", g.point(x, y + 3.0, z).alias("point"), F.col("radius_mm").alias("radius"))
    return c.follows_root(rows, marks).select("case_id", "ord")


RING = {**LINE, "placed_v": """SELECT c.case_id, c.ord, coalesce(p.d, sqrt((c.sx-c.ox)**2+(c.sy-c.oy)**2+(c.sz-c.oz)**2)) AS d, floor(coalesce(p.seq + p.t, 0) + 0.5)::BIGINT AS seq
    FROM cand c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, ord ORDER BY d, seq) AS n FROM proj) p
    ON p.case_id = c.case_id AND p.ord = c.ord AND p.n = 1""",
    "med": "SELECT l.case_id, l.seq, median(v.d) AS r FROM line l LEFT JOIN placed_v v ON v.case_id = l.case_id AND v.seq = l.seq GROUP BY 1, 2",
    "near": """SELECT *, last_value(r IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
      first_value(r IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM med""",
    "ring": "SELECT case_id, seq, coalesce(r, (l + f) / 2, l, f, 0) AS radius FROM near"}


def ring_rows(spark, folder):
    vertices = a.candidates(spark, folder).select("case_id", "ord", F.col("seed").alias("point"))
    return rings.ring_radii(vertices, lines(spark, folder), ["case_id"], ["ord"])


@query("ring_radii", a.oracle(f"SELECT case_id, seq, {sr4('radius', 'radius', 6)} FROM ring", "cand", extra=RING))
def ring_radii(spark, folder):
    return ring_rows(spark, folder).select("case_id", "seq", r4("radius", digits=6))


@query("trimmed_range", a.oracle(f"""
    SELECT r.case_id, r.seq, {sr4('coalesce(t.lo, w.lo)', 'low', 6)}, {sr4('coalesce(t.hi, w.hi)', 'high', 6)},
      {sr4('(radius - coalesce(t.lo, w.lo)) / greatest(coalesce(t.hi, w.hi) - coalesce(t.lo, w.lo), 1e-6)', 'scaled')}
    FROM ring r JOIN (SELECT case_id, quantile_cont(radius, 0.01) AS lo, quantile_cont(radius, 0.99) AS hi FROM ring GROUP BY 1) w ON w.case_id = r.case_id
    LEFT JOIN (SELECT case_id, quantile_cont(radius, 0.01) AS lo, quantile_cont(radius, 0.99) AS hi FROM ring WHERE seq > 2 GROUP BY 1) t ON t.case_id = r.case_id""",
    "cand", extra=RING))
def trimmed_range(spark, folder):
    centres = a.candidates(spark, folder).filter("ord = 1").select("case_id", F.lit(0.3).alias("seq"))
    found = rings.trimmed_range(ring_rows(spark, folder), centres, ["case_id"], window=2)
    return found.select("case_id", "seq", r4("low", digits=6), r4("high", digits=6), r4("scaled"))


@query("fill_gaps", a.oracle(f"""
    SELECT case_id, seq, {sr4('coalesce(v, (l + f) / 2, l, f, 0)', 'value')} FROM (SELECT *,
      last_value(v IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
      first_value(v IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
      FROM (SELECT case_id, ord - 1 AS seq, CASE WHEN quantity < 25 THEN radius_mm END AS v FROM cand))""", "cand"))
def fill_gaps(spark, folder):
    rows = a.candidates(spark, folder).select("case_id", (F.col("ord") - 1).alias("seq"),
        F.when(F.col("features")["bone_distance_mm"] < 25, F.col("radius_mm")).alias("value"))
    return rings.fill_gaps(rows, ["case_id"]).select("case_id", "seq", r4("value"))


def _next_sql(extreme: str, test: str) -> str:
    return a.oracle(f"""SELECT c.case_id, {sr4(f'{extreme}(CASE WHEN {test} THEN s.discount END)', 'next_progress')}
        FROM cand c JOIN cand s ON s.case_id = c.case_id WHERE c.ord = 1 GROUP BY 1""", "cand")


def _next(spark, folder, forward):
    rows = a.candidates(spark, folder).select("case_id", "ord", (F.col("features")["arc_position"] / 10).alias("progress"))
    return rings.next_progress(rows, rows.filter("ord = 1"), ["case_id"], forward).select("case_id", r4("next_progress"))


@query("next_progress", _next_sql("min", "s.discount > c.discount + 1e-4"))
def next_progress(spark, folder):
    return _next(spark, folder, True)


@query("previous_progress", _next_sql("max", "s.discount < c.discount - 1e-4"))
def previous_progress(spark, folder):
    return _next(spark, folder, False)


@query("ring_index", a.oracle("SELECT event_id, floor(least(1, greatest(0, value / 60)) * 149 + 0.5)::BIGINT AS ring FROM events"))
def ring_index(spark, folder):
    return a.table(spark, folder, "events").select("event_id", g.ring_index(F.col("value") / 60, 150).alias("ring"))

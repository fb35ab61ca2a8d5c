"""Structure, openings, unit scale, gravity, capture, carving, QA and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.vec import r6
from ..operators import capture as cp
from ..operators import cells as cl
from ..operators import gravity as gr
from ..operators import normals as nm
from ..operators import openings as op
from ..operators import planes as pl
from ..operators import polygons as pg
from ..operators import qa
from ..operators import scale as sc
from ..operators import structure as st
from ..operators import transforms as tr
from ..operators import voxels as vx
from ..plans.canonical import canonicalize
from ..plans.reports import assess, scout_report
from ..session import cut_lineage
from . import query
from .neighbours import knn_sql
from .points import rounded
from .surfaces import NORMALS_SQL, with_normals

# -- structure ----------------------------------------------------------------------------------
_PAIRS = """f AS (SELECT scan_id, 'x' AS axis, nx AS n, plane_offset AS o, inlier_count AS c FROM planes WHERE kind = 'wall' AND abs(nx) >= 0.94e0 UNION ALL SELECT scan_id, 'y', ny, plane_offset, inlier_count FROM planes WHERE kind = 'wall' AND abs(ny) >= 0.94e0),
s AS (SELECT *, max(c) OVER (PARTITION BY scan_id, axis) AS top FROM f), k AS (SELECT * FROM s WHERE c >= greatest(0.15e0 * top, 200) OR top < greatest(0.15e0 * top, 200)),
pairs AS (SELECT scan_id, axis, abs(a.o + b.o) AS separation, least(a.c, b.c) AS weight FROM k a JOIN k b USING (scan_id, axis) WHERE a.n > 0 AND b.n <= 0 AND abs(a.o + b.o) > 0.5e0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, axis ORDER BY separation DESC, weight DESC) AS rn FROM pairs) WHERE rn = 1)"""


@query("facing_wall_pairs", ["planes"], f"WITH {_PAIRS} SELECT scan_id, axis, round(separation, 6) AS separation, weight FROM best")
def _(fx):
    return rounded(st.facing_wall_pairs(fx.planes), "separation")


@query("measure_room", ["planes", "points", "scans"], f"""WITH {_PAIRS}, q AS (SELECT scan_id, quantile_cont(x, 0.998) - quantile_cont(x, 0.002) AS sx, quantile_cont(z, 0.998) - quantile_cont(z, 0.002) AS sz, max(z) - min(z) AS rz FROM points GROUP BY 1)
SELECT s.scan_id, round(coalesce(bx.separation, sx), 6) AS x_m, CASE WHEN bx.separation IS NULL THEN 'percentile' ELSE 'planes' END AS x_method, round(by_.separation, 6) AS y_m, round(coalesce(ceiling_z - floor_z, sz), 6) AS z_m,
CASE WHEN ceiling_z IS NULL THEN 'percentile' ELSE 'planes' END AS z_method, round(CASE WHEN ceiling_z IS NULL THEN greatest(rz - sz, 0e0) / 2 ELSE 0.005e0 END, 6) AS z_uncertainty_m
FROM scans s JOIN q USING (scan_id) LEFT JOIN best bx ON bx.scan_id = s.scan_id AND bx.axis = 'x' LEFT JOIN best by_ ON by_.scan_id = s.scan_id AND by_.axis = 'y'""")
def _(fx):
    out = rounded(st.measure_room(fx.points, fx.planes, fx.scans), "x_m", "y_m", "z_m", "z_uncertainty_m")
    return out.select("scan_id", "x_m", "x_method", "y_m", "z_m", "z_method", "z_uncertainty_m")


_OUT = """flat AS (SELECT * FROM planes WHERE plane_id IN (1, 2)), d AS (SELECT scan_id, plane_id, x, y, z, nz * z - plane_offset AS d FROM points JOIN flat USING (scan_id)), onp AS (SELECT * FROM d WHERE abs(d) <= 0.06e0),
b AS (SELECT scan_id, plane_id, min(x) AS lx, min(y) AS ly, greatest(0.1e0, sqrt(3.0e0 * ((max(x) - min(x)) * (max(y) - min(y))) / count(*))) AS res, quantile_cont(z, 0.5) AS mz FROM onp GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT scan_id, plane_id, floor((x - lx) / res) AS i, floor((y - ly) / res) AS j, bool_or(abs(d) <= 0.06e0) AS foot, bool_or(d < -0.06e0) AS beyond FROM d JOIN b USING (scan_id, plane_id) WHERE d <= 0.06e0 GROUP BY 1, 2, 3, 4),
s AS (SELECT scan_id, plane_id, count(*) AS n, avg(CASE WHEN beyond THEN 1e0 ELSE 0e0 END) AS o FROM c WHERE foot GROUP BY 1, 2)"""


@query("outside_coverage", ["points", "planes"], f"""WITH {_OUT} SELECT f.scan_id, f.plane_id, round(coalesce(o, 1e0), 6) AS outside, round(coalesce(n * res * res, 0e0), 6) AS covered_m2, round(mz, 6) AS plane_z
FROM flat f LEFT JOIN s USING (scan_id, plane_id) LEFT JOIN b USING (scan_id, plane_id)""")
def _(fx):
    return rounded(st.outside_coverage(fx.points, fx.planes.where("plane_id <= 2")), "outside", "covered_m2", "plane_z")


@query("label_planes", ["points", "planes"])
def _(fx):
    return st.label_planes(fx.planes, fx.points).select("scan_id", "plane_id", "nx", "ny", "nz", "plane_offset", "kind")


@query("modal_floor_z", ["points"], """WITH b AS (SELECT scan_id, min(z) AS lo, max(z) AS hi, greatest(8, ceil((max(z) - min(z)) / 0.02e0)) AS bins FROM points GROUP BY 1), r AS (SELECT p.scan_id, z, lo, bins, (hi - lo) / bins AS w FROM points p JOIN b USING (scan_id)),
h AS (SELECT scan_id, least(floor((z - lo) / w), bins - 1) AS b, count(*) AS n FROM r GROUP BY 1, 2), f AS (SELECT scan_id, min(b) AS b FROM (SELECT *, max(n) OVER (PARTITION BY scan_id) AS top FROM h) WHERE n >= 0.25e0 * top GROUP BY 1)
SELECT scan_id, round(quantile_cont(z, 0.5), 6) AS floor_z FROM r JOIN f USING (scan_id) WHERE z >= lo + b * w AND z <= lo + least(b + 2, bins) * w GROUP BY 1""")
def _(fx):
    return rounded(st.modal_floor_z(fx.points), "floor_z")


@query("find_floor_ceiling", ["points", "planes"])
def _(fx):
    return st.find_floor_ceiling(fx.points, fx.planes)


@query("merge_duplicate_walls", ["planes"], """WITH w AS (SELECT * FROM planes WHERE kind = 'wall'), c AS (SELECT a.scan_id, a.plane_id, b.plane_id AS other, b.inlier_count AS oc, a.inlier_count AS ac FROM w a JOIN w b ON a.scan_id = b.scan_id AND a.plane_id <> b.plane_id
 AND abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) >= cos(radians(6)) AND abs(CASE WHEN a.nx*b.nx + a.ny*b.ny + a.nz*b.nz > 0 THEN a.plane_offset ELSE -a.plane_offset END - b.plane_offset) <= 0.2e0)
SELECT scan_id, plane_id FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scan_id = w.scan_id AND c.plane_id = w.plane_id AND (oc > ac OR (oc = ac AND other < c.plane_id)))""")
def _(fx):
    return st.merge_duplicate_walls(fx.planes).select("scan_id", "plane_id")


def closed_sql(src: str, out: str) -> str:
    """Cells of ``src`` after one dilation and one erosion over all neighbours, as ``out``."""
    square = "range(-1, 2) r(a), range(-1, 2) s(b)"
    return f"""{out}g AS (SELECT DISTINCT scan_id, i + a AS i, j + b AS j FROM {src}, {square}),
{out} AS (SELECT scan_id, i, j FROM (SELECT scan_id, i + a AS i, j + b AS j, count(*) AS n FROM {out}g, {square} GROUP BY 1, 2, 3) WHERE n = 9)"""


def outside_sql(src: str) -> str:
    """``free`` cells of each scan's box round ``src``, and those that the box's corner reaches over faces, as ``outside``."""
    return f"""box AS (SELECT scan_id, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM {src} GROUP BY 1),
bg AS (SELECT scan_id, i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT *, unnest(range(i0, i1 + 1)) AS i FROM box)), free AS (SELECT * FROM bg ANTI JOIN {src} USING (scan_id, i, j)),
outside AS (SELECT scan_id, i0 AS i, j0 AS j FROM box UNION SELECT f.scan_id, f.i, f.j FROM outside o, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(di, dj), free f
 WHERE f.scan_id = o.scan_id AND f.i = o.i + di AND f.j = o.j + dj)"""


def parts_sql(src: str, out: str, corners: bool = False) -> str:
    """Each cell of ``src`` with the first cell of its component, as ``out``."""
    steps = "(SELECT a AS di, b AS dj FROM range(-1, 2) r(a), range(-1, 2) s(b) WHERE a <> 0 OR b <> 0)" if corners else "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(di, dj)"
    return f"""{out}r AS (SELECT scan_id, i, j, i AS a, j AS b FROM {src} UNION SELECT r.scan_id, r.i, r.j, c.i, c.j FROM {out}r r, {steps}, {src} c
 WHERE c.scan_id = r.scan_id AND c.i = r.a + di AND c.j = r.b + dj), {out} AS (SELECT scan_id, i, j, min((a, b)) AS part FROM {out}r GROUP BY 1, 2, 3)"""


@query("floor_footprint", ["points", "scans"], f"""WITH RECURSIVE base AS (SELECT DISTINCT p.scan_id, CAST(floor(x / 0.5e0) AS BIGINT) AS i, CAST(floor(y / 0.5e0) AS BIGINT) AS j FROM points p JOIN scans s ON s.scan_id = p.scan_id
 WHERE z >= floor_z - 0.1e0 AND (ceiling_z IS NULL OR z <= ceiling_z - 0.05e0)), {closed_sql("base", "shut")}, {outside_sql("shut")},
filled AS (SELECT * FROM shut UNION ALL SELECT * FROM free ANTI JOIN outside USING (scan_id, i, j)), {parts_sql("filled", "lab")}
SELECT scan_id, max(n) AS cells, round(max(n) * 0.25e0, 6) AS area_m2 FROM (SELECT scan_id, part, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1""")
def _(fx):
    cells = st.floor_footprint(fx.points, fx.scans, 0.5)
    return cells.groupBy("scan_id").agg(F.count(F.lit(1)).alias("cells"), r6(F.count(F.lit(1)) * 0.25).alias("area_m2"))


@query("footprint_outline", ["points"], """WITH c AS (SELECT DISTINCT scan_id, CAST(floor(x / 0.15e0) AS BIGINT) AS i, CAST(floor(y / 0.15e0) AS BIGINT) AS j FROM points),
e AS (SELECT c.scan_id, d FROM c, (VALUES (1, 0, 'e'), (-1, 0, 'w'), (0, 1, 'n'), (0, -1, 's')) AS v(di, dj, d) WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.scan_id = c.scan_id AND o.i = c.i + di AND o.j = c.j + dj))
SELECT scan_id, count(*) AS edges, round(count(*) * 0.15e0, 6) AS perimeter, round(any_value(n) * 0.0225e0, 6) AS area FROM e JOIN (SELECT scan_id, count(*) AS n FROM c GROUP BY 1) USING (scan_id) GROUP BY 1""")
def _(fx):
    from ..operators.polygons import polygon_area

    cells = fx.points.select("scan_id", F.floor(F.col("x") / 0.15).alias("i"), F.floor(F.col("y") / 0.15).alias("j")).distinct()
    outline = st.footprint_outline(cells, 0.15)
    n = outline.groupBy("scan_id").agg(F.count(F.lit(1)).alias("edges"))
    return rounded(n.join(polygon_area(outline), "scan_id"), "perimeter", "area").select("scan_id", "edges", "perimeter", "area")


# -- openings -----------------------------------------------------------------------------------
@query("opening_on_wall", ["openings", "planes"], """SELECT o.scan_id, opening_id, plane_id FROM openings o JOIN planes p ON p.scan_id = o.scan_id AND p.kind = 'wall' WHERE abs(o.nx*p.nx + o.ny*p.ny + o.nz*p.nz) >= 0.8e0 AND abs(p.nx*cx + p.ny*cy + p.nz*cz - plane_offset) <= 0.4e0""")
def _(fx):
    return op.opening_on_wall(fx.openings, fx.planes.where("kind = 'wall'")).select("scan_id", "opening_id", "plane_id")


@query("classify_opening", ["openings"], "SELECT scan_id, opening_id, CASE WHEN sill_height <= 0.15e0 AND height >= 1.6e0 THEN 'door' WHEN sill_height > 0.4e0 THEN 'window' ELSE 'opening' END AS kind FROM openings")
def _(fx):
    return fx.openings.select("scan_id", "opening_id", op.classify_opening(F.col("sill_height"), F.col("height")).alias("kind"))


@query("opening_confidence", ["openings"], "SELECT scan_id, opening_id, round(least(greatest((0.25e0 * confidence + 0.35e0 * least(greatest(sill_height, width / 4) / 0.5e0, 1e0) + 0.2e0 * (height / 3) + 0.2e0 * 0.5e0) * (1 - 0.5e0 * (width / 4)), 0e0), 1e0), 6) AS score FROM openings")
def _(fx):
    c = F.col
    return fx.openings.select("scan_id", "opening_id", r6(op.opening_confidence(c("confidence"), c("sill_height"), c("width") / 4, c("height") / 3, F.lit(0.5), c("width") / 4)).alias("score"))


@query("dedupe_openings", ["openings"], """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY confidence DESC, opening_id) AS r FROM openings),
near AS (SELECT a.scan_id, a.r, list(b.r) AS stronger FROM o a JOIN o b ON a.scan_id = b.scan_id AND b.r < a.r AND sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) < 0.3e0 GROUP BY 1, 2),
walk AS (SELECT scan_id, r, [r] AS kept, opening_id, true AS k FROM o WHERE r = 1 UNION ALL SELECT o.scan_id, o.r, CASE WHEN coalesce(list_has_any(n.stronger, w.kept), false) THEN w.kept ELSE list_append(w.kept, o.r) END, o.opening_id, NOT coalesce(list_has_any(n.stronger, w.kept), false)
 FROM walk w JOIN o ON o.scan_id = w.scan_id AND o.r = w.r + 1 LEFT JOIN near n ON n.scan_id = o.scan_id AND n.r = o.r)
SELECT scan_id, opening_id FROM walk WHERE k""")
def _(fx):
    return op.dedupe_openings(fx.openings).select("scan_id", "opening_id")


_VOIDS = "v AS (SELECT DISTINCT scan_id, CAST(floor(x / 0.1e0) AS BIGINT) AS i, CAST(floor(z / 0.1e0) AS BIGINT) AS j FROM points)"


def voids_of(fx):
    return fx.points.select("scan_id", F.floor(F.col("x") / 0.1).alias("i"), F.floor(F.col("z") / 0.1).alias("j")).distinct()


_MED = "CAST(floor(quantile_cont({c}, 0.5)) AS BIGINT)"


def _retake(n, src, dst, i):
    """One re-taking round of the rectangle in SQL: rows inside the columns' extent, then columns inside the rows'."""
    return f"""rv{i} AS (SELECT r.scan_id, {_MED.format(c='first')} AS a, {_MED.format(c='last')} AS b, count(*) AS n FROM rowsv r JOIN {src} t USING (scan_id) WHERE j BETWEEN j0 AND j1 GROUP BY 1),
t{i} AS (SELECT t.scan_id, CASE WHEN n >= 3 THEN a ELSE i0 END AS i0, CASE WHEN n >= 3 THEN b ELSE i1 END AS i1, j0, j1 FROM {src} t LEFT JOIN rv{i} USING (scan_id)),
ru{i} AS (SELECT r.scan_id, {_MED.format(c='first')} AS a, {_MED.format(c='last')} AS b, count(*) AS n FROM colsv r JOIN t{i} t USING (scan_id) WHERE i BETWEEN i0 AND i1 GROUP BY 1),
{dst} AS (SELECT t.scan_id, i0, i1, CASE WHEN n >= 3 THEN a ELSE j0 END AS j0, CASE WHEN n >= 3 THEN b ELSE j1 END AS j1 FROM t{i} t LEFT JOIN ru{i} USING (scan_id))"""


@query("straight_rect", ["points"], f"""WITH {_VOIDS}, rowsv AS (SELECT scan_id, j, min(i) AS first, max(i) AS last FROM v GROUP BY 1, 2), colsv AS (SELECT scan_id, i, min(j) AS first, max(j) AS last FROM v GROUP BY 1, 2),
q0 AS (SELECT * FROM (SELECT scan_id, {_MED.format(c='first')} AS i0, {_MED.format(c='last')} AS i1 FROM rowsv GROUP BY 1) JOIN (SELECT scan_id, {_MED.format(c='first')} AS j0, {_MED.format(c='last')} AS j1 FROM colsv GROUP BY 1) USING (scan_id)),
{_retake(0, 'q0', 'q1', 1)}, {_retake(0, 'q1', 'q2', 2)},
sv AS (SELECT r.scan_id, avg(CASE WHEN abs(first - i0) <= 1 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN abs(last - i1) <= 1 THEN 1e0 ELSE 0e0 END) AS s FROM rowsv r JOIN q2 USING (scan_id) WHERE j BETWEEN j0 AND j1 GROUP BY 1),
su AS (SELECT r.scan_id, avg(CASE WHEN abs(first - j0) <= 1 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN abs(last - j1) <= 1 THEN 1e0 ELSE 0e0 END) AS s FROM colsv r JOIN q2 USING (scan_id) WHERE i BETWEEN i0 AND i1 GROUP BY 1)
SELECT q2.scan_id, i0, i1, j0, j1, round((sv.s + su.s) / 4, 6) AS straight, (SELECT count(*) FROM v WHERE v.scan_id = q2.scan_id) AS cells FROM q2 JOIN sv USING (scan_id) JOIN su USING (scan_id)""")
def _(fx):
    return rounded(op.straight_rect(voids_of(fx), ["scan_id"]), "straight")


@query("detect_openings", ["room_openings"], """SELECT o.scan_id, plane_id, kind, round(width, 6) AS width, round(height, 6) AS height, round(sill, 6) AS sill_height, round(CASE plane_id WHEN 3 THEN 0.1e0 + o.scan_id % 5 * 0.01e0 ELSE along END, 6) AS cx,
round(CASE plane_id WHEN 3 THEN along WHEN 5 THEN o.scan_id % 5 * 0.01e0 ELSE 4.2e0 - o.scan_id % 5 * 0.01e0 END, 6) AS cy, round(sill + height / 2, 6) AS cz FROM room_openings o""")
def _(fx):
    """Found from points alone; the oracle knows where the openings were left out."""
    found = op.detect_openings(fx.room_points, fx.planes.where("kind = 'wall'"), fx.scans)
    return rounded(found, "width", "height", "sill_height", "cx", "cy", "cz").select("scan_id", "plane_id", "kind", "width", "height", "sill_height", "cx", "cy", "cz")


# the true openings as apertures in their wall's frame, a little too large, on cells of 0.1 m
_APERTURES = """a0 AS (SELECT o.scan_id, plane_id, opening_id AS label, CASE plane_id WHEN 5 THEN -along ELSE along END AS at_u, width / 2 + 0.013e0 AS half, sill - 0.013e0 AS av, sill + height + 0.013e0 AS bv,
 CASE plane_id WHEN 5 THEN -5.0e0 ELSE 0.0e0 END AS u0, CASE plane_id WHEN 3 THEN 4.2e0 WHEN 5 THEN 0.0e0 ELSE 5.0e0 END AS u1, floor_z, ceiling_z, coalesce(ceiling_z, 2.7e0) AS v1 FROM room_openings o JOIN scans s ON s.scan_id = o.scan_id),
a AS (SELECT *, at_u - half AS au, at_u + half AS bu, CAST(floor(2 * half / 0.1e0) AS BIGINT) AS nw, CAST(floor((bv - av) / 0.1e0) AS BIGINT) AS nh FROM a0)"""
_WALL_UVS = "uvs AS (SELECT p.scan_id, plane_id, -ny * x + nx * y AS u, z AS v, nx * x + ny * y - plane_offset AS s FROM {} p JOIN planes w ON w.scan_id = p.scan_id WHERE w.plane_id BETWEEN 3 AND 6)"


def apertures_of(fx):
    c, o = F.col, fx.room_openings.join(fx.scans.select("scan_id", "floor_z", "ceiling_z"), "scan_id")
    p = c("plane_id")
    o = o.select(
        "scan_id", p.cast("long").alias("plane_id"), c("opening_id").alias("label"), F.when(p == 5, -c("along")).otherwise(c("along")).alias("at_u"), (c("width") / 2 + 0.013).alias("half"), (c("sill") - 0.013).alias("av"),
        (c("sill") + c("height") + 0.013).alias("bv"), F.when(p == 5, -5.0).otherwise(0.0).alias("u0"), F.when(p == 3, 4.2).when(p == 5, 0.0).otherwise(5.0).alias("u1"), "floor_z", "ceiling_z", F.coalesce("ceiling_z", F.lit(2.7)).alias("v1"),
    )
    o = o.withColumns({"au": c("at_u") - c("half"), "bu": c("at_u") + c("half"), "nw": F.floor(2 * c("half") / 0.1), "nh": F.floor((c("bv") - c("av")) / 0.1)})
    return o.withColumns({"res": F.lit(0.1), "pad": F.lit(2).cast("long"), "reveal_lo": F.lit(0.015), "sigma": F.lit(0.002)})


@query("depth_evidence", ["points", "planes", "scans", "room_openings"], f"""WITH {_WALL_UVS.format("points")}, {_APERTURES},
h AS (SELECT scan_id, plane_id, label, nw, nh, s, floor((u - au) / 0.1e0) AS i, floor((v - av) / 0.1e0) AS j FROM uvs JOIN a USING (scan_id, plane_id) WHERE u BETWEEN au AND bu AND v BETWEEN av AND bv AND ((s > 0.08e0 AND s < 2.0e0) OR s < -0.1e0)),
c AS (SELECT scan_id, plane_id, label, nw, nh, i, j, bool_or(s > 0.08e0 AND s < 2.0e0) AS f, bool_or(s < -0.1e0) AS b FROM h WHERE i < nw AND j < nh GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT scan_id, plane_id, label, round(sum(f::INT) / (any_value(nw) * any_value(nh)), 6) AS front, round(sum(b::INT) / (any_value(nw) * any_value(nh)), 6) AS behind FROM c GROUP BY 1, 2, 3""")
def _(fx):
    uvs = tr.plane_uv(fx.points, fx.planes.where("kind = 'wall'"))
    return rounded(op.depth_evidence(uvs, apertures_of(fx)), "front", "behind").select("scan_id", "plane_id", "label", "front", "behind")


_ROW_OK = "(abs(av + 0.1e0 * (j + 0.5e0) - floor_z) >= 0.1e0 AND coalesce(abs(av + 0.1e0 * (j + 0.5e0) - ceiling_z) >= 0.1e0, true))"


@query("reveal_coverage", ["room_points", "planes", "scans", "room_openings"], f"""WITH {_WALL_UVS.format("room_points")}, {_APERTURES},
e AS (SELECT *, au - 0.2e0 >= u0 + 0.12e0 AS l_ok, bu + 0.2e0 <= u1 - 0.12e0 AS r_ok, av - floor_z >= 3 * 0.1e0 AS s_ok, coalesce(ceiling_z - bv >= 3 * 0.1e0, true) AS h_ok FROM a),
n AS (SELECT scan_id, plane_id, label, count(*) AS n_rows FROM (SELECT *, unnest(range(nh)) AS j FROM a) t WHERE {_ROW_OK} GROUP BY 1, 2, 3),
t AS (SELECT scan_id, plane_id, label, coalesce(n_rows, 0) * (l_ok::INT + r_ok::INT) + nw * (s_ok::INT + h_ok::INT) AS eligible FROM e LEFT JOIN n USING (scan_id, plane_id, label)),
p AS (SELECT *, CAST(floor((u - au) / 0.1e0) AS BIGINT) AS i, CAST(floor((v - av) / 0.1e0) AS BIGINT) AS j FROM uvs JOIN e USING (scan_id, plane_id) WHERE u >= au - 0.2e0 AND u <= bu + 0.2e0 AND v >= av - 0.2e0 AND v <= bv + 0.2e0 AND s > 0.015e0 AND s < 0.08e0),
k AS (SELECT DISTINCT scan_id, plane_id, label, 'l' AS side, j AS pos FROM p WHERE j BETWEEN 0 AND nh - 1 AND {_ROW_OK} AND l_ok AND i BETWEEN -2 AND 0
 UNION ALL SELECT DISTINCT scan_id, plane_id, label, 'r', j FROM p WHERE j BETWEEN 0 AND nh - 1 AND {_ROW_OK} AND r_ok AND i BETWEEN nw - 1 AND nw + 1
 UNION ALL SELECT DISTINCT scan_id, plane_id, label, 's', i FROM p WHERE i BETWEEN 0 AND nw - 1 AND s_ok AND j BETWEEN -2 AND 0
 UNION ALL SELECT DISTINCT scan_id, plane_id, label, 'h', i FROM p WHERE i BETWEEN 0 AND nw - 1 AND h_ok AND j BETWEEN nh - 1 AND nh + 1)
SELECT scan_id, plane_id, label, round(count(*) / any_value(eligible), 6) AS reveal FROM k JOIN t USING (scan_id, plane_id, label) GROUP BY 1, 2, 3""")
def _(fx):
    uvs = tr.plane_uv(fx.room_points, fx.planes.where("kind = 'wall'"))
    return rounded(op.reveal_coverage(uvs, apertures_of(fx)), "reveal").select("scan_id", "plane_id", "label", "reveal")


_MID_V, _MID_U = "v BETWEEN av + 0.15e0 * (bv - av) AND bv - 0.15e0 * (bv - av)", "u BETWEEN au + 0.15e0 * (bu - au) AND bu - 0.15e0 * (bu - au)"
_EDGE_TESTS = {
    ("w", "au"): f"abs(s) <= 0.06e0 AND {_MID_V} AND u < au + 0.2e0", ("w", "bu"): f"abs(s) <= 0.06e0 AND {_MID_V} AND u > bu - 0.2e0", ("w", "av"): f"abs(s) <= 0.06e0 AND {_MID_U} AND v < av + 0.2e0", ("w", "bv"): f"abs(s) <= 0.06e0 AND {_MID_U} AND v > bv - 0.2e0",
    **{("r", e): f"s > 0.015e0 AND s < 0.08e0 AND v BETWEEN av AND bv AND abs(u - {e}) <= least(0.2e0, 0.4e0 * (bu - au))" for e in ("au", "bu")},
    **{("r", e): f"s > 0.015e0 AND s < 0.08e0 AND u BETWEEN au AND bu AND abs(v - {e}) <= least(0.2e0, 0.4e0 * (bv - av))" for e in ("av", "bv")},
}
_EDGE_OF = {e: f"coalesce(max(CASE WHEN how = 'r' AND edge = '{e}' AND n >= 30 AND 1.4826e0 * mad <= 0.015e0 THEN p50 END), max(CASE WHEN how = 'w' AND edge = '{e}' AND n >= 20 THEN {p} END))" for e, p in (("au", "p99"), ("bu", "p1"), ("av", "p99"), ("bv", "p1"))}


@query("refine_edges", ["room_points", "planes", "scans", "room_openings"], f"""WITH {_WALL_UVS.format("room_points")}, {_APERTURES},
p AS (SELECT * FROM uvs JOIN a USING (scan_id, plane_id) WHERE u BETWEEN au - 0.6e0 AND bu + 0.6e0 AND v BETWEEN av - 0.6e0 AND bv + 0.6e0),
l AS ({" UNION ALL ".join(f"SELECT scan_id, plane_id, label, '{h}' AS how, '{e}' AS edge, {e[1]} AS val FROM p WHERE {t}" for (h, e), t in _EDGE_TESTS.items())}),
q AS (SELECT scan_id, plane_id, label, how, edge, count(*) AS n, quantile_cont(val, 0.01) AS p1, quantile_cont(val, 0.5) AS p50, quantile_cont(val, 0.99) AS p99, mad(val) AS mad FROM l GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT scan_id, plane_id, label, {", ".join(f"{x} AS r_{e}" for e, x in _EDGE_OF.items())} FROM q GROUP BY 1, 2, 3)
SELECT scan_id, plane_id, label, round(coalesce(r_au, au), 6) AS eu0, round(coalesce(r_bu, bu), 6) AS eu1, round(coalesce(r_av, CASE WHEN av - floor_z < 3 * 0.1e0 THEN floor_z ELSE av END), 6) AS ev0,
 round(coalesce(r_bv, CASE WHEN ceiling_z - bv < 3 * 0.1e0 THEN ceiling_z ELSE least(bv, v1) END), 6) AS ev1 FROM a LEFT JOIN r USING (scan_id, plane_id, label)""")
def _(fx):
    uvs = tr.plane_uv(fx.room_points, fx.planes.where("kind = 'wall'"))
    return rounded(op.refine_edges(uvs, apertures_of(fx)), "eu0", "eu1", "ev0", "ev1").select("scan_id", "plane_id", "label", "eu0", "eu1", "ev0", "ev1")


@query("opening_probe_mask", ["points", "openings"], """SELECT DISTINCT p.scan_id, p.point_id FROM points p JOIN openings o ON o.scan_id = p.scan_id WHERE abs(-(x - cx)) <= width / 2 + 0.1e0 AND abs(z - cz) <= height / 2 + 0.1e0 AND abs(y - cy) <= 0.35e0""")
def _(fx):
    return qa.opening_probe_mask(fx.points.select("scan_id", "point_id", "x", "y", "z"), fx.openings, ["point_id"], F.lit(0.1))


@query("opening_cutout", ["points", "planes", "openings"], """WITH r AS (SELECT p.scan_id, w.plane_id, point_id, x, y, z FROM points p JOIN planes w ON w.scan_id = p.scan_id AND kind = 'wall' WHERE abs(nx*x + ny*y + nz*z - plane_offset) < 0.06e0),
c AS (SELECT o.scan_id, plane_id, cx, cz, width, height FROM openings o JOIN planes p ON p.scan_id = o.scan_id AND p.kind = 'wall' WHERE abs(o.nx*p.nx + o.ny*p.ny + o.nz*p.nz) >= 0.8e0 AND abs(p.nx*cx + p.ny*cy + p.nz*cz - plane_offset) <= 0.4e0)
SELECT scan_id, plane_id, point_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scan_id = r.scan_id AND c.plane_id = r.plane_id AND abs(x - cx) <= width / 2 + 0.08e0 AND abs(z - cz) <= height / 2 + 0.08e0)""")
def _(fx):
    walls = fx.planes.where("kind = 'wall'")
    rows = tr.with_planes(fx.points, walls).where(F.abs(tr.signed_distance()) < K.WALL_INLIER_TOL_M).select("scan_id", "plane_id", "point_id", "x", "y", "z")
    return qa.opening_cutout(rows, walls, fx.openings).select("scan_id", "plane_id", "point_id")


@query("analyze_structure", ["points", "planes"])
def _(fx):
    got = st.analyze_structure(fx.points, fx.planes.withColumns({"umin": F.lit(0.0), "umax": F.lit(4.0), "vmin": F.lit(0.0), "vmax": F.lit(2.7)}), 0.25)
    area = got["footprint"].groupBy("scan_id").agg((F.count(F.lit(1)) * 0.0625).alias("floor_m2"))
    walls = got["planes"].where("kind = 'wall'").groupBy("scan_id").agg(F.count(F.lit(1)).alias("walls"))
    return got["levels"].join(area, "scan_id", "left").join(walls, "scan_id", "left")


# -- unit scale -----------------------------------------------------------------------------------
@query("plane_weight", ["planes"], "SELECT scan_id, plane_id, CASE WHEN area > 2 THEN area ELSE CAST(inlier_count AS DOUBLE) END AS weight FROM planes")
def _(fx):
    p = fx.planes.withColumn("area", F.when(F.col("area") > 2, F.col("area")).otherwise(0.0))
    return p.select("scan_id", "plane_id", sc.plane_weight().alias("weight"))


_GAPS = """r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY area DESC, plane_id) AS r FROM planes), lead AS (SELECT scan_id, plane_id, r, CASE WHEN abs(nz) > 0.9e0 THEN 'z' WHEN abs(nx) > 0.9e0 THEN 'x' ELSE 'y' END AS fam, nx, ny, nz, plane_offset, area FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY scan_id, fam ORDER BY r) AS k, min(r) OVER (PARTITION BY scan_id, fam) AS founder FROM lead), o AS (SELECT *, dense_rank() OVER (PARTITION BY scan_id ORDER BY founder) - 1 AS family FROM m)"""


@query("parallel_plane_gaps", ["planes"], f"""WITH {_GAPS}
SELECT a.scan_id, CAST(a.family AS BIGINT) AS family, round(abs(a.plane_offset - CASE WHEN a.nx*b.nx + a.ny*b.ny + a.nz*b.nz < 0 THEN -b.plane_offset ELSE b.plane_offset END), 6) AS gap, a.area + b.area AS weight FROM o a JOIN o b ON a.scan_id = b.scan_id AND a.family = b.family AND a.k = 1 AND b.k = 2""")
def _(fx):
    return rounded(sc.parallel_plane_gaps(fx.planes), "gap")


@query("axis_slab_gaps", ["points"])
def _(fx):
    return sc.axis_slab_gaps(with_normals(fx))


@query("extent_diagonal", ["points"])
def _(fx):
    return sc.extent_diagonal(fx.points)


_LN = lambda x, c, s: f"exp(-0.5e0 * pow((ln({x}) - ln({c!r}e0)) / {s!r}e0, 2))"
_WIN = lambda x, lo, hi, a, b: f"(1 / (1 + exp(-(ln({x}) - ln({lo!r}e0)) / {a!r}e0)) / (1 + exp(-(ln({hi!r}e0) - ln({x})) / {b!r}e0)))"
_CEILP = lambda x: f"(({_LN(x, *K.CEILING_CORE)} + {K.CEILING_WIDE[2]!r}e0 * {_LN(x, *K.CEILING_WIDE[:2])}) * {_WIN(x, *K.CEILING_WINDOW)})"
_PRI = lambda x, p: f"({_LN(x, p[0], p[1])} * {_WIN(x, p[2], p[3], p[4], p[4])})"


def _term(i):
    a, b = [j for j in range(3) if j != i]
    asp = f"(1 / (1 + exp(-(ln(least(g{a}, g{b}) / g{i}) - ln({K.ASPECT_KNEE!r}e0)) / {K.ASPECT_WIDTH!r}e0)))"
    return f"w{i} * {_CEILP(f'g{i}')} * {_PRI(f'g{a}', K.PLAN_PRIOR)} * {_PRI(f'g{b}', K.PLAN_PRIOR)} * {asp}"


_SCORED = f"""s AS (SELECT scan_id, unit, f, o, (ln(greatest({_term(0)} + {_term(1)} + {_term(2)}, 1e-300)) + 0.5e0 * ln(greatest({_PRI('dg', K.DIAGONAL_PRIOR)}, 1e-300)) + 0.35e0 * ln(greatest({_PRI('sp', K.SPACING_PRIOR)}, 1e-300))) / 1.85e0 AS score FROM w),
b AS (SELECT *, max(score) OVER (PARTITION BY scan_id) AS top, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, o) AS rn FROM s), h AS (SELECT scan_id, 1 / sum(exp(score - top)) AS share FROM b GROUP BY 1)
SELECT scan_id, CASE WHEN exp(top) >= 0.03e0 THEN unit ELSE 'unknown' END AS unit, CASE WHEN exp(top) >= 0.03e0 THEN f ELSE 1e0 END AS factor, round(CASE WHEN exp(top) >= 0.03e0 THEN share * least(exp(top) / 0.12e0, 1e0) ELSE 0e0 END, 5) AS confidence FROM b JOIN h USING (scan_id) WHERE rn = 1"""


@query("infer_unit_scale", ["scans"], f"""WITH u AS (SELECT scan_id, unit, f, o, (2.4e0 + scan_id % 9 * 0.1e0) * k * f AS g0, 5.0e0 * k * f AS g1, 4.2e0 * k * f AS g2, 7.1e0 * k * f AS dg, 0.02e0 * k * f AS sp FROM (SELECT scan_id, CASE scan_id % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 100e0 WHEN 2 THEN 1000e0 ELSE 39.3701e0 END AS k FROM scans),
 (VALUES (0, 'm', 1e0), (1, 'cm', 0.01e0), (2, 'mm', 0.001e0), (3, 'in', 0.0254e0), (4, 'ft', 0.3048e0)) AS v(o, unit, f)), w AS (SELECT *, pow(42e0, 3) / (pow(42e0, 3) + pow(22e0, 3) + pow(27e0, 3)) AS w0, pow(22e0, 3) / (pow(42e0, 3) + pow(22e0, 3) + pow(27e0, 3)) AS w1, pow(27e0, 3) / (pow(42e0, 3) + pow(22e0, 3) + pow(27e0, 3)) AS w2 FROM u),
{_SCORED}""")
def _(fx):
    k = F.col("scan_id") % 4
    s = fx.scans.withColumn("k", F.when(k == 0, 1.0).when(k == 1, 100.0).when(k == 2, 1000.0).otherwise(39.3701))
    measures = s.select("scan_id", F.lit(600).alias("n"), (7.1 * F.col("k")).alias("diagonal"), (0.02 * F.col("k")).alias("spacing"))
    sizes = ((2.4 + F.col("scan_id") % 9 * 0.1, 42.0), (F.lit(5.0), 22.0), (F.lit(4.2), 27.0))
    gaps = s.select("scan_id", F.inline(F.array(*[F.struct(F.lit(i).alias("family"), (g * F.col("k")).alias("gap"), F.lit(w).alias("weight")) for i, (g, w) in enumerate(sizes)])))
    return sc.infer_unit_scale(measures, gaps).select("scan_id", "unit", "factor", F.round("confidence", 5).alias("confidence"))


@query("infer_unit_scale_measured", ["points", "planes"], f"""WITH t AS (SELECT scan_id, unnest([0, 1, 2]) AS axis, unnest([x, y, z]) AS t FROM points), dia AS (SELECT scan_id, sqrt(sum((hi - lo) * (hi - lo))) AS d FROM (SELECT scan_id, axis, quantile_cont(t, 0.002) AS lo, quantile_cont(t, 0.998) AS hi FROM t GROUP BY 1, 2) GROUP BY 1),
{knn_sql(1)}, spc AS (SELECT scan_id, quantile_cont(CASE WHEN dist > 0 THEN dist END, 0.5) AS sp FROM near GROUP BY 1), {_GAPS},
g AS (SELECT a.scan_id, abs(a.plane_offset - CASE WHEN a.nx*b.nx + a.ny*b.ny + a.nz*b.nz < 0 THEN -b.plane_offset ELSE b.plane_offset END) AS gap, pow(a.area + b.area, 3) AS m, row_number() OVER (PARTITION BY a.scan_id ORDER BY a.area + b.area DESC, a.family) AS rk FROM o a JOIN o b ON a.scan_id = b.scan_id AND a.family = b.family AND a.k = 1 AND b.k = 2),
p AS (SELECT scan_id, {", ".join(f"max(CASE WHEN rk = {i + 1} THEN gap END) AS a{i}, max(CASE WHEN rk = {i + 1} THEN m END) / sum(m) AS w{i}" for i in range(3))} FROM g WHERE rk <= 3 GROUP BY 1),
w AS (SELECT scan_id, unit, f, v.o, a0 * f AS g0, a1 * f AS g1, a2 * f AS g2, w0, w1, w2, d * f AS dg, sp * f AS sp FROM p JOIN dia USING (scan_id) JOIN spc USING (scan_id), (VALUES (0, 'm', 1e0), (1, 'cm', 0.01e0), (2, 'mm', 0.001e0), (3, 'in', 0.0254e0), (4, 'ft', 0.3048e0)) AS v(o, unit, f)),
{_SCORED}""")
def _(fx):
    box = gr.axis_extremes(fx.points, unit_axes(fx)).groupBy("scan_id").agg(F.sqrt(F.sum((F.col("hi") - F.col("lo")) * (F.col("hi") - F.col("lo")))).alias("diagonal"))
    n = fx.points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    measures = n.join(box, "scan_id").join(nm.median_spacing(fx.points), "scan_id", "left")
    return sc.infer_unit_scale(measures, sc.parallel_plane_gaps(fx.planes)).select("scan_id", "unit", "factor", F.round("confidence", 5).alias("confidence"))


# -- gravity and yaw ------------------------------------------------------------------------------
def unit_axes(fx):
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("axis"), *[F.lit(1.0 if i == j else 0.0).alias(f"a{d}") for j, d in enumerate("xyz")]) for i in range(3)])
    return fx.scans.select("scan_id", F.inline(rows))


_AX = "t AS (SELECT scan_id, point_id, 0 AS axis, x AS t, y AS p, z AS q FROM points UNION ALL SELECT scan_id, point_id, 1, y, x, z FROM points UNION ALL SELECT scan_id, point_id, 2, z, x, y FROM points), ext AS (SELECT scan_id, axis, quantile_cont(t, 0.002) AS lo, quantile_cont(t, 0.998) AS hi FROM t GROUP BY 1, 2)"
_CLUT = "cl AS (SELECT scan_id, point_id FROM t JOIN ext USING (scan_id, axis) GROUP BY 1, 2 HAVING bool_and(t > lo + 0.08e0 AND t < hi - 0.08e0))"


@query("clutter_mask", ["points"], f"WITH {_AX}, {_CLUT} SELECT scan_id, point_id FROM cl")
def _(fx):
    ax = unit_axes(fx)
    return gr.clutter_mask(fx.points, ax, gr.axis_extremes(fx.points, ax)).where("clutter").select("scan_id", "point_id")


_BAND = "SELECT scan_id, axis, sum(CASE WHEN t > lo + sk AND t < lo + sk + b THEN 1e0 ELSE 0e0 END) AS l, sum(CASE WHEN t < hi - sk AND t > hi - sk - b THEN 1e0 ELSE 0e0 END) AS h FROM (SELECT *, least(1.2e0, 0.45e0 * (hi - lo)) AS b, least({skin}, 0.08e0 * (hi - lo)) AS sk FROM t JOIN ext USING (scan_id, axis){extra}) GROUP BY 1, 2"


@query("band_asymmetry", ["points"], f"WITH {_AX}, s AS ({_BAND.format(skin='0.18e0', extra='')}) SELECT scan_id, CAST(axis AS BIGINT) AS axis, round(CASE WHEN l + h <= 0 THEN 0e0 ELSE (l - h) / (l + h) END, 6) + 0.0e0 AS band FROM s")
def _(fx):
    ax = unit_axes(fx)
    return rounded(gr.band_asymmetry(fx.points, ax, gr.axis_extremes(fx.points, ax)), "band")


@query("contact_fractions", ["points"])
def _(fx):
    ax = unit_axes(fx)
    ext = gr.axis_extremes(fx.points, ax)
    return gr.contact_fractions(gr.clutter_mask(fx.points, ax, ext).where("clutter"), ax, ext)


@query("axis_margin", ["points"], f"WITH {_AX}, s AS ({_BAND.format(skin='0.18e0', extra='')}), c AS (SELECT scan_id, axis, abs(CASE WHEN l + h <= 0 THEN 0e0 ELSE (l - h) / (l + h) END) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, axis) AS rn, lead(score) OVER (PARTITION BY scan_id ORDER BY score DESC, axis) AS nxt FROM c) SELECT scan_id, CAST(axis AS BIGINT) AS axis, round(CASE WHEN score <= 0 THEN 0e0 ELSE 1 - nxt / score END, 6) AS axis_margin FROM r WHERE rn = 1")
def _(fx):
    ax = unit_axes(fx)
    band = gr.band_asymmetry(fx.points, ax, gr.axis_extremes(fx.points, ax)).select("scan_id", "axis", F.abs("band").alias("score"))
    return rounded(gr.axis_margin(band), "axis_margin").select("scan_id", "axis", "axis_margin")


@query("rotation_columns", ["cameras"], """WITH a AS (SELECT scan_id, cam_id, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM cameras))
SELECT scan_id, cam_id, round(1 - x*x / (1 + z), 6) + 0.0e0 AS r0, round(-x*y / (1 + z), 6) + 0.0e0 AS r1, round(-x, 6) + 0.0e0 AS r2, round(y, 6) + 0.0e0 AS r7, round(z, 6) + 0.0e0 AS r8 FROM a""")
def _(fx):
    c = fx.cameras.withColumn("_l", vec.norm(vec.cols("x", "y", "z"))).withColumns({f"_{a}": F.col(a) / F.col("_l") for a in "xyz"})
    c = gr.add_rotation(c, vec.cols("_x", "_y", "_z"), [F.lit(0.0), F.lit(0.0), F.lit(1.0)], "r")
    return rounded(c, "r0", "r1", "r2", "r7", "r8").select("scan_id", "cam_id", "r0", "r1", "r2", "r7", "r8")


@query("manhattan_axes", ["planes"], "SELECT scan_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS axis, unnest([0e0, 0e0, -1e0]) AS ax, unnest([0e0, 1e0, 0e0]) AS ay, unnest([1e0, 0e0, 0e0]) AS az FROM planes GROUP BY scan_id")
def _(fx):
    return rounded(gr.manhattan_axes(fx.planes), "ax", "ay", "az")


@query("normal_pole", ["points"])
def _(fx):
    return gr.normal_pole(with_normals(fx), unit_axes(fx))


def ups_of(fx):
    pts = fx.points
    return gr.find_up(gr.axis_evidence(pts, unit_axes(fx), fx.cameras), fx.planes)


@query("find_up", ["points", "cameras", "planes"])
def _(fx):
    return ups_of(fx)


@query("resolve_sign", ["planes", "scans"], """SELECT s.scan_id, CASE WHEN v >= 0 THEN 1e0 ELSE -1e0 END AS uz, round(abs(v) / 3.0e0, 6) AS sign_margin FROM (SELECT scan_id, 1.0e0 * ((scan_id % 7 - 3) / 10.0e0) + 1.0e0 * ((scan_id % 5 - 2) / 10.0e0) + 0.5e0 * 0.1e0 + 0.5e0 * 0e0 AS v FROM scans) s""")
def _(fx):
    z = F.lit(0.0)
    best = fx.scans.select(
        "scan_id", F.lit(2).cast("long").alias("axis"), z.alias("ax"), z.alias("ay"), F.lit(1.0).alias("az"), z.alias("lo"), F.lit(2.7).alias("hi"), ((F.col("scan_id") % 7 - 3) / 10.0).alias("band"), ((F.col("scan_id") % 5 - 2) / 10.0).alias("free"),
        F.lit(0.3).alias("low_contact"), F.lit(0.2).alias("high_contact"), F.lit(None).cast("double").alias("cam_t"), F.lit(None).cast("double").alias("cams"), F.lit(None).cast("double").alias("_hint"), F.lit(0.5).alias("axis_margin"),
    )
    return rounded(gr.resolve_sign(best, fx.planes), "sign_margin").select("scan_id", "uz", "sign_margin")


_WEIGHT = "CASE WHEN area > 0 THEN area ELSE CAST(inlier_count AS DOUBLE) END"


@query("refine_on_floor", ["planes", "scans"], f"""WITH u AS (SELECT scan_id, sin(radians((scan_id % 8) * 0.2e0)) AS ux, cos(radians((scan_id % 8) * 0.2e0)) AS uz FROM scans),
r AS (SELECT scan_id, plane_id, nx, ny, nz, nx * ux + nz * uz AS c, {_WEIGHT} AS w, ux, uz FROM planes JOIN u USING (scan_id)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY w DESC, plane_id) AS rn FROM r WHERE abs(c) >= cos(radians({K.HORIZONTAL_TOL_DEG!r}e0))) WHERE rn = 1),
s AS (SELECT scan_id, sqrt(sum(w * t * t) / sum(w)) AS scatter, count(*) AS k FROM (SELECT *, degrees(asin(least(1e0, abs(c)))) AS t FROM r WHERE abs(c) <= sin(radians({K.WALL_TOL_DEG!r}e0))) GROUP BY 1),
m AS (SELECT u.scan_id, degrees(acos(least(1e0, abs(c)))) AS swing, CASE WHEN k >= 2 THEN least(greatest(scatter, {K.REFINE_MAX_DEG!r}e0), {K.REFINE_MAX_TOLERANCE_DEG!r}e0) ELSE {K.REFINE_MAX_DEG!r}e0 END AS tol, u.ux, nx * sign(c) AS up FROM u LEFT JOIN h USING (scan_id) LEFT JOIN s USING (scan_id))
SELECT scan_id, round(swing, 4) AS swing_deg, round(CASE WHEN swing <= tol THEN up ELSE ux END, 6) + 0.0e0 AS ux FROM m""")
def _(fx):
    a = F.radians((F.col("scan_id") % 8) * 0.2)
    ups = fx.scans.select("scan_id", F.sin(a).alias("ux"), F.lit(0.0).alias("uy"), F.cos(a).alias("uz"))
    out = gr.refine_on_floor(ups, fx.planes)
    return out.select("scan_id", F.round("swing_deg", 4).alias("swing_deg"), r6(F.col("ux")).alias("ux"))


_YAW = "w AS (SELECT scan_id, area AS w, atan2(c * ny + sn * nx, c * nx - sn * ny) AS t FROM planes JOIN (SELECT scan_id, cos(radians(scan_id % 17 * 1.0e0)) AS c, sin(radians(scan_id % 17 * 1.0e0)) AS sn FROM scans) USING (scan_id) WHERE kind = 'wall')"


def turned_planes(fx):
    a = F.radians(F.col("scan_id") % 17 * 1.0)
    return fx.planes.withColumns({"nx": F.cos(a) * F.col("nx") - F.sin(a) * F.col("ny"), "ny": F.sin(a) * F.col("nx") + F.cos(a) * F.col("ny")})


@query("find_yaw", ["planes", "scans"], f"WITH {_YAW}, k AS (SELECT *, max(w) OVER (PARTITION BY scan_id) AS m FROM w) SELECT scan_id, round(-atan2(sum(w * sin(4 * t)), sum(w * cos(4 * t))) / 4, 6) + 0.0e0 AS yaw, count(*) AS walls FROM k WHERE w >= 0.05e0 * m GROUP BY 1")
def _(fx):
    ups = fx.scans.select("scan_id", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    return rounded(gr.find_yaw(ups, turned_planes(fx)), "yaw")


@query("yaw_residual", ["planes", "scans"], f"WITH {_YAW}, k AS (SELECT *, max(w) OVER (PARTITION BY scan_id) AS m, degrees(atan2(sin(4 * t), cos(4 * t)) / 4) AS d FROM w) SELECT scan_id, round(sqrt(sum(w * d * d) / sum(w)), 6) AS yaw_residual_deg FROM k WHERE w >= 0.3e0 * m GROUP BY 1")
def _(fx):
    return rounded(gr.yaw_residual(turned_planes(fx)), "yaw_residual_deg")


@query("choose_quadrant", ["points"], """WITH q AS (SELECT scan_id, avg(x) AS mx, avg(y) AS my, quantile_cont(x, 0.002) AS x0, quantile_cont(x, 0.998) AS x1, quantile_cont(y, 0.002) AS y0, quantile_cont(y, 0.998) AS y1 FROM points GROUP BY 1), f AS (SELECT scan_id, (quantile_cont(x, 0.002) + quantile_cont(x, 0.998)) / 2 AS cx, (quantile_cont(y, 0.002) + quantile_cont(y, 0.998)) / 2 AS cy FROM points WHERE z < 0.1e0 GROUP BY 1),
s AS (SELECT scan_id, cx, cy, x1 - x0 < y1 - y0 AS turn, 0.002e0 * greatest(x1 - x0, y1 - y0) AS dead, CASE WHEN x1 - x0 < y1 - y0 THEN -(my - cy) ELSE mx - cx END AS sx, CASE WHEN x1 - x0 < y1 - y0 THEN mx - cx ELSE my - cy END AS sy FROM q JOIN f USING (scan_id)),
k AS (SELECT *, (turn::INT + CASE WHEN CASE WHEN abs(sx) > dead THEN sx < 0 ELSE sy < 0 END THEN 2 ELSE 0 END) % 4 AS qt FROM s) SELECT scan_id, CAST(qt AS BIGINT) AS quarter, round(CASE qt WHEN 0 THEN cx WHEN 1 THEN -cy WHEN 2 THEN -cx ELSE cy END, 6) AS centre_x, abs(sx) > dead OR abs(sy) > dead AS decisive FROM k""")
def _(fx):
    return rounded(gr.choose_quadrant(fx.points, fx.points.where("z < 0.1")), "centre_x").select("scan_id", "quarter", "centre_x", "decisive")


@query("ground_residual", ["points"])
def _(fx):
    return gr.ground_residual(fx.points)


@query("canonicalize", ["points", "planes", "cameras"])
def _(fx):
    out = canonicalize(with_normals(fx), fx.planes, fx.cameras)
    return out.select("scan_id", "unit", "factor", "axis_margin", "sign_margin", "up_residual_deg", "yaw_residual_deg", "ceiling_height_m", F.array_join("warnings", "; ").alias("warnings"))


# -- capture and carving ----------------------------------------------------------------------------
@query("capture_bounds", ["points", "scans", "cameras"])
def _(fx):
    return cp.capture_bounds(fx.points, fx.scans, fx.cameras, 0.2)[1]


_NEAR_FLOOR = f"""near AS (SELECT p.scan_id, CAST(floor(x / 0.2e0) AS BIGINT) AS i, CAST(floor(y / 0.2e0) AS BIGINT) AS j FROM points p JOIN scans s ON s.scan_id = p.scan_id WHERE abs(z - floor_z) <= {K.CAPTURE_FLOOR_BAND_M!r}e0),
base AS (SELECT DISTINCT scan_id, i, j FROM near SEMI JOIN (SELECT scan_id FROM near GROUP BY 1 HAVING count(*) >= 3) USING (scan_id))"""


@query("capture_bounds_inferred", ["points", "scans"], f"""WITH RECURSIVE {_NEAR_FLOOR}, {closed_sql("base", "shut")}, {parts_sql("shut", "lab", corners=True)},
kept AS (SELECT scan_id, i, j FROM lab SEMI JOIN (SELECT scan_id, part FROM lab GROUP BY 1, 2 HAVING count(*) * 0.2e0 * 0.2e0 >= {K.MIN_PART_AREA_M2!r}e0) USING (scan_id, part)), {outside_sql("kept")},
void AS (SELECT * FROM free ANTI JOIN outside USING (scan_id, i, j)), {parts_sql("void", "hole")},
whole AS (SELECT scan_id, i, j FROM kept UNION ALL SELECT scan_id, i, j FROM hole SEMI JOIN (SELECT scan_id, part FROM hole GROUP BY 1, 2 HAVING count(*) * 0.2e0 * 0.2e0 < {K.MIN_VOID_AREA_M2!r}e0) USING (scan_id, part))
SELECT s.scan_id, floor_z AS z_lo, floor_z AS z_hi, round(coalesce(n * (0.2e0 * 0.2e0), 0e0), 6) AS area_m2, 'inferred' AS source FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS n FROM whole GROUP BY 1) w ON w.scan_id = s.scan_id""")
def _(fx):
    return rounded(cp.capture_bounds(fx.points, fx.scans, None, 0.2)[1], "area_m2")


_CARVE = """vox AS (SELECT scan_id, min(x) - 0.5e0 AS gx, min(y) - 0.5e0 AS gy, min(z) - 0.5e0 AS gz, CAST(ceil((max(x) - min(x) + 1.0e0) / 0.5e0) AS BIGINT) AS dx, CAST(ceil((max(y) - min(y) + 1.0e0) / 0.5e0) AS BIGINT) AS dy, CAST(ceil((max(z) - min(z) + 1.0e0) / 0.5e0) AS BIGINT) AS dz FROM points GROUP BY 1),
sol AS (SELECT scan_id, CAST(floor((x - gx) / 0.5e0) AS BIGINT) AS i, CAST(floor((y - gy) / 0.5e0) AS BIGINT) AS j, CAST(floor((z - gz) / 0.5e0) AS BIGINT) AS k FROM points JOIN vox USING (scan_id) GROUP BY ALL HAVING count(*) >= 3),
cm AS (SELECT scan_id, x AS ox, y AS oy, z AS oz, row_number() OVER (PARTITION BY scan_id ORDER BY cam_id) - 1 AS o, count(*) OVER (PARTITION BY scan_id) AS n FROM cameras),
ry AS (SELECT p.scan_id, point_id, x, y, z, ox, oy, oz, gx, gy, gz, dx, dy, dz, sqrt((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz)) AS len FROM points p JOIN cm ON cm.scan_id = p.scan_id AND cm.o = ((point_id % 1000003) * 40503 + 12345) % n JOIN vox ON vox.scan_id = p.scan_id),
sm AS (SELECT *, CAST(s AS DOUBLE) / (m - 1) AS t FROM (SELECT *, unnest(range(m)) AS s FROM (SELECT ry.*, CAST(greatest(ceil(2 * len / 0.5e0) + 1, 8) AS BIGINT) AS m FROM ry))),
ix AS (SELECT scan_id, point_id, s, CAST(floor((ox + t * (x - ox) - gx) / 0.5e0) AS BIGINT) AS i, CAST(floor((oy + t * (y - oy) - gy) / 0.5e0) AS BIGINT) AS j, CAST(floor((oz + t * (z - oz) - gz) / 0.5e0) AS BIGINT) AS k, dx, dy, dz FROM sm WHERE s <= floor(least(greatest(1 - 0.25e0 / greatest(len, 1e-9), 0e0), 1e0) * (m - 1) + 1e-9)),
st AS (SELECT scan_id, point_id, min(s) AS stop FROM ix JOIN sol USING (scan_id, i, j, k) GROUP BY 1, 2),
free AS (SELECT DISTINCT x.scan_id, i, j, k FROM ix x LEFT JOIN st ON st.scan_id = x.scan_id AND st.point_id = x.point_id WHERE (stop IS NULL OR s < stop) AND i BETWEEN 0 AND dx - 1 AND j BETWEEN 0 AND dy - 1 AND k BETWEEN 0 AND dz - 1)"""


def carve_inputs(fx, v=0.5):
    b = vx.cloud_bounds(fx.points)
    grids = b.select("scan_id", *[(F.col(f"min_{a}") - v).alias(f"o{a}") for a in "xyz"], *[F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}") + 2 * v) / v).alias(f"dim_{a}") for a in "xyz"], F.lit(v).alias("voxel"), F.lit(v).alias("cell"))
    return grids, vx.occupancy(fx.points, grids, 3)


@query("carve_free_space", ["points", "cameras"], f"WITH {_CARVE} SELECT * FROM free")
def _(fx):
    grids, solid = carve_inputs(fx)
    return cp.carve_free_space(fx.points, fx.cameras, solid, grids)


@query("first_hit", ["points", "cameras"], f"WITH {_CARVE}, h AS (SELECT i.scan_id, i.point_id, i.s AS step, s.scan_id IS NOT NULL AS hit FROM ix i LEFT JOIN sol s ON s.scan_id = i.scan_id AND s.i = i.i AND s.j = i.j AND s.k = i.k) SELECT h.scan_id, h.point_id, count(*) AS clear_steps FROM h LEFT JOIN st USING (scan_id, point_id) WHERE stop IS NULL OR step < stop GROUP BY 1, 2")
def _(fx):
    grids, solid = carve_inputs(fx)
    hit = cp.first_hit(cp.rays_of(fx.points, fx.cameras, grids), solid, ["point_id"])
    return hit.where("clear_steps > 0").select("scan_id", "point_id", "clear_steps")


@query("sample_mask", ["points", "cameras"], f"""WITH {_CARVE}, c AS (SELECT scan_id, cam_id, least(greatest((x - gx) / 0.5e0 - 0.5e0, 0e0), dx - 1) AS a, least(greatest((y - gy) / 0.5e0 - 0.5e0, 0e0), dy - 1) AS b, least(greatest((z - gz) / 0.5e0 - 0.5e0, 0e0), dz - 1) AS d FROM cameras JOIN vox USING (scan_id)),
e AS (SELECT scan_id, cam_id, CAST(floor(a) AS BIGINT) + p AS i, CAST(floor(b) AS BIGINT) + q AS j, CAST(floor(d) AS BIGINT) + r AS k, (CASE p WHEN 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE q WHEN 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) * (CASE r WHEN 1 THEN d - floor(d) ELSE 1 - (d - floor(d)) END) AS w FROM c, range(2) x(p), range(2) y(q), range(2) z(r))
SELECT e.scan_id, cam_id, round(sum(CASE WHEN s.scan_id IS NULL THEN 0e0 ELSE w END), 6) AS value FROM e LEFT JOIN sol s ON s.scan_id = e.scan_id AND s.i = e.i AND s.j = e.j AND s.k = e.k GROUP BY 1, 2""")
def _(fx):
    grids, solid = carve_inputs(fx)
    return rounded(cp.sample_mask(solid, fx.cameras.select("scan_id", "cam_id", "x", "y", "z"), grids, ["cam_id"]), "value")


@query("observed_volume", ["points", "cameras"])
def _(fx):
    """Closed by the operator's own two voxels, then by its 0.45 m: three voxels, so the second closing reaches further than the first."""
    fx.keep_scans_together()
    grids, solid = carve_inputs(fx, 0.15)
    solid = cut_lineage(solid.select("scan_id", "i", "j", "k"))
    free = cut_lineage(cl.minus(cp.carve_free_space(fx.points, fx.cameras, solid, grids), solid, ["i", "j", "k"]))
    return cp.observed_volume(free, 0.15).groupBy("scan_id").agg(F.count(F.lit(1)).alias("voxels"))


@query("complete_shell", ["points", "cameras"])
def _(fx):
    fx.keep_scans_together()
    grids, solid = carve_inputs(fx)
    return cp.complete_shell(fx.points, fx.cameras, solid, grids, 0.5, 1, 0.5)[2]


# -- QA and reports -----------------------------------------------------------------------------------
@query("wall_support", ["planes"], """WITH w AS (SELECT *, max(area) OVER (PARTITION BY scan_id) AS ma FROM planes WHERE kind = 'wall'), b AS (SELECT *, inlier_count * 0.0009e0 / area AS s FROM w WHERE area >= greatest(2e0, 0.15e0 * ma)), k AS (SELECT *, s >= 0.5e0 * max(s) OVER (PARTITION BY scan_id) AS ok FROM b),
n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY scan_id) AS k FROM k) SELECT scan_id, plane_id, round(s, 6) AS support FROM n WHERE ok OR k < 2""")
def _(fx):
    spacing = fx.scans.select("scan_id", F.lit(0.03).alias("median_spacing_m"))
    return rounded(qa.wall_support(fx.planes, spacing), "support").select("scan_id", "plane_id", "support")


def fits_of(fx):
    """Planes standing in for refitted walls."""
    return turned_planes(fx).where("kind = 'wall'").select("scan_id", "plane_id", "nx", "ny", "nz", (F.col("area") / 2.7).alias("span_u"), F.col("area").alias("weight"))


@query("wall_frame_stats", ["planes", "scans"], f"""WITH {_YAW}, m AS (SELECT scan_id, atan2(sum(w * sin(4 * t)), sum(w * cos(4 * t))) / 4 AS m FROM w GROUP BY 1), d AS (SELECT scan_id, w, m, t - m + pi() / 4 AS e FROM w JOIN m USING (scan_id)), f AS (SELECT *, abs(degrees(e - floor(e / (pi() / 2)) * (pi() / 2) - pi() / 4)) AS d FROM d)
SELECT scan_id, round(max(d), 5) AS manhattan_residual_deg, round(degrees(any_value(m)), 5) + 0.0e0 AS wall_frame_offset_deg, round(sum(CASE WHEN d <= 5 THEN w ELSE 0e0 END) / sum(w), 5) AS wall_rectilinear_fraction FROM f GROUP BY 1""")
def _(fx):
    return qa.wall_frame_stats(fits_of(fx)).select("scan_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("manhattan_residual_deg", "wall_frame_offset_deg", "wall_rectilinear_fraction")])


@query("wall_parallelism", ["planes", "scans"], """WITH w AS (SELECT scan_id, plane_id, nx, ny, nz, area / 2.7e0 AS s FROM planes WHERE kind = 'wall'), p AS (SELECT a.scan_id, a.plane_id AS x, b.plane_id AS y, greatest(a.s, b.s) AS run, greatest(-1e0, (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) / (sqrt(a.nx*a.nx+a.ny*a.ny+a.nz*a.nz) * sqrt(b.nx*b.nx+b.ny*b.ny+b.nz*b.nz))) AS c FROM w a JOIN w b ON a.scan_id = b.scan_id AND a.plane_id < b.plane_id),
g AS (SELECT *, 180 - degrees(acos(c)) AS ang FROM p WHERE c < -cos(radians(15))) SELECT scan_id, round(max(ang), 4) AS opposite_wall_parallelism_deg, round(arg_max(run, ang) * tan(radians(max(ang))), 4) AS opposite_wall_gap_m FROM g GROUP BY 1""")
def _(fx):
    return qa.wall_parallelism(fits_of(fx)).select("scan_id", *[F.round(c, 4).alias(c) for c in ("opposite_wall_parallelism_deg", "opposite_wall_gap_m")])


@query("wall_residual_drift", ["points", "planes", "openings"])
def _(fx):
    return qa.wall_residual_drift(fx.points, fx.planes.where("kind = 'wall'"), fx.openings, 5)


@query("measure_floor", ["points", "scans"])
def _(fx):
    return qa.measure_floor(fx.points, fx.scans, fx.scans.select("scan_id", F.lit(0.03).alias("median_spacing_m")), 20)


@query("scale_prior", ["scans", "openings"], """WITH d AS (SELECT scan_id, max(height) AS d FROM openings WHERE sill_height < 0.15e0 AND height > 0 GROUP BY 1), s AS (SELECT scan_id, ceiling_z - floor_z AS h, d FROM scans LEFT JOIN d USING (scan_id)),
t AS (SELECT scan_id, CASE WHEN h IS NULL THEN NULL ELSE 1e0 END AS a, CASE WHEN d <= 1.4e0 OR d >= 3.2e0 THEN 0e0 WHEN d < 1.9e0 THEN (d - 1.4e0) / (1.9e0 - 1.4e0) WHEN d > 2.4e0 THEN (3.2e0 - d) / (3.2e0 - 2.4e0) WHEN d IS NULL THEN NULL ELSE 1e0 END AS b FROM s)
SELECT scan_id, round(0.75e0 * (coalesce(2 * a, 0e0) + coalesce(b, 0e0) + 1e0) / (CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + 1), 6) AS scale_confidence_prior FROM t""")
def _(fx):
    return rounded(qa.scale_prior(fx.scans, fx.openings, fx.scans.select("scan_id", F.lit(0.03).alias("median_spacing_m"))), "scale_confidence_prior")


_COVER = """lat AS (SELECT p.scan_id, x0 - 0.5e0 AS x0, y0 - 0.5e0 AS y0, CAST(greatest(2, ceil((x1 + 0.5e0 - (x0 - 0.5e0)) / 0.5e0)) AS BIGINT) AS ni, CAST(greatest(2, ceil((y1 + 0.5e0 - (y0 - 0.5e0)) / 0.5e0)) AS BIGINT) AS nj, floor_z, ceiling_z, coalesce(ceiling_z, z1) AS top
 FROM (SELECT scan_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM points GROUP BY 1) p JOIN scans USING (scan_id)),
grid AS (SELECT *, x0 + (i + 0.5e0) * 0.5e0 AS x, y0 + (j + 0.5e0) * 0.5e0 AS y FROM (SELECT *, unnest(range(nj)) AS j FROM (SELECT *, unnest(range(ni)) AS i FROM lat))),
ins AS (SELECT g.scan_id, i, j FROM grid g JOIN footprint_edges e ON e.scan_id = g.scan_id WHERE (e.y0 > g.y) <> (e.y1 > g.y) AND g.x < (e.x1 - e.x0) * (g.y - e.y0) / nullif(e.y1 - e.y0, 0) + e.x0 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
pc AS (SELECT scan_id, CAST(least(greatest(floor((x - x0) / 0.5e0), 0), ni - 1) AS BIGINT) AS i, CAST(least(greatest(floor((y - y0) / 0.5e0), 0), nj - 1) AS BIGINT) AS j, z, floor_z, ceiling_z FROM points JOIN lat USING (scan_id)),
occ AS (SELECT scan_id, i, j, bool_or(z >= floor_z - 0.25e0 AND z < floor_z + 0.75e0) AS f, bool_or(coalesce(z >= ceiling_z - 0.75e0 AND z < ceiling_z + 0.25e0, false)) AS c FROM pc GROUP BY 1, 2, 3),
seen AS (SELECT s.scan_id, count(*) AS n, sum(coalesce(f::INT, 0)) AS fn, sum(coalesce(c::INT, 0)) AS cn FROM ins s LEFT JOIN occ o ON o.scan_id = s.scan_id AND o.i = s.i AND o.j = s.j GROUP BY 1),
ero AS (SELECT scan_id, i, j FROM (SELECT scan_id, i + a AS i, j + b AS j, count(*) AS n FROM ins, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS v(a, b) GROUP BY 1, 2, 3) WHERE n = 5), edg AS (SELECT * FROM ins ANTI JOIN ero USING (scan_id, i, j)),
prb AS (SELECT scan_id, i, j, k, x0 + (i + 0.5e0) * 0.5e0 AS x, y0 + (j + 0.5e0) * 0.5e0 AS y, floor_z + 0.25e0 + k * 0.5e0 AS z, floor_z FROM (SELECT e.*, x0, y0, floor_z, unnest(range(CAST(greatest(ceil((top - 0.125e0 - floor_z - 0.25e0) / 0.5e0), 0) AS BIGINT))) AS k FROM edg e JOIN lat USING (scan_id))),
fil AS (SELECT DISTINCT scan_id, i + a AS i, j + b AS j, CAST(floor((z - floor_z) / 0.5e0) AS BIGINT) AS k FROM pc, range(-1, 2) r(a), range(-1, 2) s(b) WHERE z >= floor_z),
skp AS (SELECT DISTINCT p.scan_id, i, j, k FROM prb p JOIN openings o ON o.scan_id = p.scan_id WHERE abs(x - cx) <= width / 2 + 0.5e0 AND abs(z - cz) <= height / 2 + 0.5e0 AND abs(y - cy) <= 0.35e0),
wl AS (SELECT p.scan_id, z - p.floor_z AS h, f.scan_id IS NOT NULL AS hit, s.scan_id IS NULL AS cnt FROM prb p LEFT JOIN fil f ON f.scan_id = p.scan_id AND f.i = p.i AND f.j = p.j AND f.k = p.k LEFT JOIN skp s ON s.scan_id = p.scan_id AND s.i = p.i AND s.j = p.j AND s.k = p.k),
ws AS (SELECT scan_id, sum((h BETWEEN 0.5e0 AND 2.0e0 AND hit)::INT) AS bh, sum((h BETWEEN 0.5e0 AND 2.0e0)::INT) AS bn, sum((cnt AND hit)::INT) AS wh, sum(cnt::INT) AS wn FROM wl GROUP BY 1)"""


@query("coverage", ["points", "scans", "footprint_edges", "openings"], f"""WITH {_COVER} SELECT scan_id, round(fn / n, 6) AS floor_coverage, round(CASE WHEN ceiling_z IS NOT NULL THEN cn / n END, 6) AS ceiling_coverage, round(bh / bn, 6) AS wall_coverage,
round(1 - (fn + CASE WHEN ceiling_z IS NULL THEN 0 ELSE cn END + wh) / (n + CASE WHEN ceiling_z IS NULL THEN 0 ELSE n END + wn), 6) + 0.0e0 AS hole_fraction FROM seen JOIN ws USING (scan_id) JOIN lat USING (scan_id)""")
def _(fx):
    out = qa.coverage(fx.points, fx.scans, fx.footprint_edges, fx.openings, fx.scans.select("scan_id", F.lit(0.5).alias("cell")))
    return rounded(out, "floor_coverage", "ceiling_coverage", "wall_coverage", "hole_fraction").drop("footprint_cells")


def metrics_of(fx):
    """A metric table with every kind of value: present, out of bounds and missing."""
    k = F.col("scan_id")
    miss = lambda c, n: F.when(k % n == 0, F.lit(None).cast("double")).otherwise(c)
    n = fx.points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("point_count"))
    o = fx.openings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("opening_count"), F.sum(F.col("width") * F.col("height")).alias("opening_area_m2"))
    base = fx.scans.join(n, "scan_id").join(o, "scan_id", "left").fillna(0, ["opening_count"]).fillna(0.0, ["opening_area_m2"])
    return base.select(
        "scan_id", "point_count", "opening_count", "opening_area_m2", ((k % 10) / 10.0).alias("scale_confidence"), miss((k % 15) / 10.0, 7).alias("gravity_residual_deg"), miss((k % 9) / 2.0, 8).alias("manhattan_residual_deg"),
        miss((k % 25) / 10.0, 8).alias("wall_frame_offset_deg"), miss((k % 11) / 10.0, 8).alias("wall_rectilinear_fraction"), miss((k % 30) / 10.0, 6).alias("opposite_wall_parallelism_deg"), F.lit(0.02).alias("opposite_wall_gap_m"),
        miss((k % 70) / 1000.0, 5).alias("drift_estimate_m"), miss((k % 40) / 1000.0, 5).alias("wall_planarity_rms_m"), (F.col("ceiling_z") - F.col("floor_z") + (k % 4)).alias("ceiling_height_m"), miss((k % 12) / 11.0, 13).alias("floor_coverage"),
        miss((k % 8) * 100.0, 9).alias("density_per_m2"), miss((k % 6) / 100.0, 9).alias("median_spacing_m"), miss((k % 12) / 10.0, 4).alias("capture_coverage_ratio"), miss((k % 5) / 20.0, 14).alias("duplicate_fraction"), F.lit(0.25).alias("hole_fraction"),
        miss((k % 3) / 10.0, 2).alias("mesh_boundary_edge_fraction"), F.lit(5.0).alias("extent_x_m"), F.lit(4.2).alias("extent_y_m"), F.lit(2.7).alias("extent_z_m"), miss((k % 6) / 10.0, 3).alias("gravity_axis_margin"), miss((k % 4) / 10.0, 3).alias("gravity_sign_margin"),
    )


_MISS = lambda e, n: f"CASE WHEN scan_id % {n} = 0 THEN NULL ELSE {e} END"
_RULES = """chk AS (SELECT scan_id, unnest(['metric_scale', 'gravity', 'manhattan', 'yaw', 'wall_parallelism', 'ceiling_height', 'coverage', 'density', 'drift', 'wall_planarity', 'capture_bounds', 'duplicates', 'openings', 'watertight', 'gravity_axis', 'gravity_sign']) AS name, unnest([
 CASE WHEN conf < 0.4e0 THEN 'fail' ELSE 'pass' END, CASE WHEN grav IS NULL THEN 'warn' WHEN grav > 1 THEN 'fail' WHEN grav > 0.25e0 THEN 'warn' ELSE 'pass' END, 'info',
 CASE WHEN off IS NULL THEN 'warn' WHEN rect < 0.6e0 THEN 'info' WHEN off > 2 THEN 'fail' WHEN off > 0.5e0 THEN 'warn' ELSE 'pass' END,
 CASE WHEN rect < 0.6e0 THEN 'info' WHEN par IS NULL THEN 'info' WHEN par <= 0.5e0 THEN 'pass' WHEN drift > 0.02e0 AND par > 2 THEN 'fail' ELSE 'warn' END, CASE WHEN h IS NULL THEN 'info' WHEN h < 2.1e0 OR h > 5 THEN 'warn' ELSE 'pass' END,
 CASE WHEN cov IS NULL THEN 'warn' WHEN cov < 0.5e0 THEN 'fail' WHEN cov < 0.8e0 THEN 'warn' ELSE 'pass' END, CASE WHEN dens IS NULL THEN 'warn' WHEN dens < 300 OR sp > 0.05e0 THEN 'warn' ELSE 'pass' END, CASE WHEN drift IS NULL THEN 'warn' WHEN drift > 0.05e0 THEN 'fail' WHEN drift > 0.02e0 THEN 'warn' ELSE 'pass' END,
 CASE WHEN rms IS NULL THEN 'info' WHEN rms > 0.02e0 THEN 'warn' ELSE 'pass' END, CASE WHEN ratio IS NULL OR ratio < 0.5e0 THEN 'warn' ELSE 'pass' END, CASE WHEN dup IS NULL THEN 'info' WHEN dup > 0.15e0 THEN 'warn' ELSE 'pass' END, CASE WHEN oc = 0 AND h IS NOT NULL THEN 'warn' ELSE 'info' END, 'info',
 CASE WHEN gax < 0.1e0 THEN 'fail' WHEN gax < 0.25e0 THEN 'warn' WHEN gax IS NULL THEN NULL ELSE 'pass' END, CASE WHEN gsi < 0.1e0 THEN 'warn' END]) AS status FROM met), checks AS (SELECT * FROM chk WHERE status IS NOT NULL)"""
_METRICS = f"""met AS (SELECT scan_id, (scan_id % 10) / 10.0e0 AS conf, {_MISS('(scan_id % 15) / 10.0e0', 7)} AS grav, {_MISS('(scan_id % 9) / 2.0e0', 8)} AS man, {_MISS('(scan_id % 25) / 10.0e0', 8)} AS off, {_MISS('(scan_id % 11) / 10.0e0', 8)} AS rect, {_MISS('(scan_id % 30) / 10.0e0', 6)} AS par,
 {_MISS('(scan_id % 70) / 1000.0e0', 5)} AS drift, {_MISS('(scan_id % 40) / 1000.0e0', 5)} AS rms, ceiling_z - floor_z + scan_id % 4 AS h, {_MISS('(scan_id % 12) / 11.0e0', 13)} AS cov, {_MISS('(scan_id % 8) * 100.0e0', 9)} AS dens, {_MISS('(scan_id % 6) / 100.0e0', 9)} AS sp, {_MISS('(scan_id % 12) / 10.0e0', 4)} AS ratio,
 {_MISS('(scan_id % 5) / 20.0e0', 14)} AS dup, {_MISS('(scan_id % 6) / 10.0e0', 3)} AS gax, {_MISS('(scan_id % 4) / 10.0e0', 3)} AS gsi, coalesce(oc, 0) AS oc FROM scans LEFT JOIN (SELECT scan_id, count(*) AS oc FROM openings GROUP BY 1) USING (scan_id)),
{_RULES}"""



@query("qa_checks", ["scans", "openings"], f"WITH {_METRICS} SELECT scan_id, name, status, true AS has_number FROM checks")
def _(fx):
    return qa.qa_checks(metrics_of(fx)).select("scan_id", "name", "status", F.col("message").rlike("[0-9]|no mesh").alias("has_number"))


@query("qa_verdict", ["scans", "openings"], f"WITH {_METRICS} SELECT scan_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM checks GROUP BY 1")
def _(fx):
    return qa.qa_verdict(qa.qa_checks(metrics_of(fx)), fx.scans)


def measured_of(fx):
    """The metrics that SQL can measure too, all from the tables; drift and the gravity sign stay unmeasured."""
    ax = unit_axes(fx)
    stats = cut_lineage(nm.neighbour_stats(fx.points))
    band = gr.band_asymmetry(fx.points, ax, gr.axis_extremes(fx.points, ax)).select("scan_id", "axis", F.abs("band").alias("score"))
    n = fx.points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("point_count"))
    o = fx.openings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("opening_count"), F.sum(F.col("width") * F.col("height")).alias("opening_area_m2"))
    level = fx.planes.where("kind = 'floor'").groupBy("scan_id").agg(F.degrees(F.acos(F.min(F.struct("plane_id", "nz"))["nz"])).alias("gravity_residual_deg"))
    worst = pl.planarity_rms(fx.points, fx.planes.where("kind = 'wall'"), K.WALL_INLIER_TOL_M).groupBy("scan_id").agg(F.max("rms_m").alias("wall_planarity_rms_m"))
    seen = pg.polygon_area(fx.capture_edges).select("scan_id", F.col("area").alias("_seen")).join(pg.polygon_area(fx.footprint_edges).select("scan_id", "area"), "scan_id")
    out = fx.scans.select("scan_id", (F.col("ceiling_z") - F.col("floor_z")).alias("ceiling_height_m")).join(n, "scan_id")
    for df in (
        o, stats, level, worst, qa.wall_frame_stats(fits_of(fx)), qa.wall_parallelism(fits_of(fx)), gr.axis_margin(band).select("scan_id", F.col("axis_margin").alias("gravity_axis_margin")),
        qa.coverage(fx.points, fx.scans, fx.footprint_edges, fx.openings, fx.scans.select("scan_id", F.lit(0.5).alias("cell"))), qa.scale_prior(fx.scans, fx.openings, stats).withColumnRenamed("scale_confidence_prior", "scale_confidence"),
        seen.select("scan_id", (F.col("_seen") / F.col("area")).alias("capture_coverage_ratio")), vx.cloud_bounds(fx.points).select("scan_id", *[F.col(f"extent_{a}").alias(f"extent_{a}_m") for a in "xyz"]),
    ):
        out = out.join(df, "scan_id", "left")
    none = F.lit(None).cast("double")
    return out.fillna(0, ["opening_count"]).fillna(0.0, ["opening_area_m2"]).withColumns({c: none for c in ("drift_estimate_m", "gravity_sign_margin", "mesh_boundary_edge_fraction")})


_RAMP = lambda x, a, b, c, d: f"CASE WHEN {x} <= {a}e0 OR {x} >= {d}e0 THEN 0e0 WHEN {x} < {b}e0 THEN ({x} - {a}e0) / ({b}e0 - {a}e0) WHEN {x} > {c}e0 THEN ({d}e0 - {x}) / ({d}e0 - {c}e0) WHEN {x} IS NULL THEN NULL ELSE 1e0 END"
_SHOELACE = "SELECT scan_id, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM {} GROUP BY 1"


@query("qa_checks_measured", ["points", "scans", "planes", "openings", "footprint_edges", "capture_edges"], f"""WITH {_COVER}, {_YAW},
wm AS (SELECT scan_id, atan2(sum(w * sin(4 * t)), sum(w * cos(4 * t))) / 4 AS m FROM w GROUP BY 1), wd AS (SELECT scan_id, w, m, t - m + pi() / 4 AS e FROM w JOIN wm USING (scan_id)), wf AS (SELECT *, abs(degrees(e - floor(e / (pi() / 2)) * (pi() / 2) - pi() / 4)) AS d FROM wd),
frm AS (SELECT scan_id, max(d) AS man, abs(degrees(any_value(m))) AS off, sum(CASE WHEN d <= 5 THEN w ELSE 0e0 END) / sum(w) AS rect FROM wf GROUP BY 1),
opp AS (SELECT scan_id, max(180 - degrees(acos(c))) AS par FROM (SELECT a.scan_id, greatest(-1e0, (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) / (sqrt(a.nx*a.nx+a.ny*a.ny+a.nz*a.nz) * sqrt(b.nx*b.nx+b.ny*b.ny+b.nz*b.nz))) AS c FROM planes a JOIN planes b ON a.scan_id = b.scan_id AND a.plane_id < b.plane_id AND a.kind = 'wall' AND b.kind = 'wall') WHERE c < -cos(radians(15)) GROUP BY 1),
flat AS (SELECT scan_id, max(r) AS rms FROM (SELECT scan_id, plane_id, sqrt(avg(d * d)) AS r FROM (SELECT scan_id, plane_id, nx * x + ny * y + nz * z - plane_offset AS d FROM points JOIN planes USING (scan_id) WHERE kind = 'wall') WHERE abs(d) <= 0.06e0 GROUP BY 1, 2) GROUP BY 1),
{knn_sql(8)}, nb AS (SELECT scan_id, point_id, min(dist) AS d1, min(CASE WHEN dist >= 0.001e0 THEN dist END) AS f, max(dist) AS rk FROM near GROUP BY 1, 2),
nst AS (SELECT scan_id, quantile_cont(f, 0.5) AS sp, quantile_cont(7 / (pi() * rk * rk), 0.5) AS dens, avg(CASE WHEN d1 < 0.001e0 THEN 1e0 ELSE 0e0 END) AS dup FROM nb GROUP BY 1),
axt AS (SELECT scan_id, unnest([0, 1, 2]) AS axis, unnest([x, y, z]) AS t FROM points), axe AS (SELECT scan_id, axis, quantile_cont(t, 0.002) AS lo, quantile_cont(t, 0.998) AS hi FROM axt GROUP BY 1, 2),
axb AS (SELECT scan_id, axis, sum(CASE WHEN t > lo + sk AND t < lo + sk + b THEN 1e0 ELSE 0e0 END) AS l, sum(CASE WHEN t < hi - sk AND t > hi - sk - b THEN 1e0 ELSE 0e0 END) AS h FROM (SELECT *, least(1.2e0, 0.45e0 * (hi - lo)) AS b, least(0.18e0, 0.08e0 * (hi - lo)) AS sk FROM axt JOIN axe USING (scan_id, axis)) GROUP BY 1, 2),
axs AS (SELECT scan_id, axis, abs(CASE WHEN l + h <= 0 THEN 0e0 ELSE (l - h) / (l + h) END) AS score FROM axb), axr AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, axis) AS rn, lead(score) OVER (PARTITION BY scan_id ORDER BY score DESC, axis) AS nxt FROM axs),
door AS (SELECT scan_id, max(height) AS d FROM openings WHERE sill_height < 0.15e0 AND height > 0 GROUP BY 1), pri AS (SELECT scan_id, ceiling_z - floor_z AS h, {_RAMP('(ceiling_z - floor_z)', 1.6, 2.2, 3.6, 6.0)} AS a, {_RAMP('d', 1.4, 1.9, 2.4, 3.2)} AS b, {_RAMP('sp', 0.0005, 0.002, 0.05, 0.3)} AS c FROM scans LEFT JOIN door USING (scan_id) LEFT JOIN nst USING (scan_id)),
met AS (SELECT scan_id, 0.75e0 * (coalesce(2 * a, 0e0) + coalesce(b, 0e0) + coalesce(c, 0e0)) / ((a IS NOT NULL)::INT * 2 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS conf, degrees(acos(nz)) AS grav, man, off, rect, par, CAST(NULL AS DOUBLE) AS drift, rms, h, fn / n AS cov, dens, sp, ca.area / fa.area AS ratio, dup,
 CASE WHEN score <= 0 THEN 0e0 ELSE 1 - nxt / score END AS gax, CAST(NULL AS DOUBLE) AS gsi, coalesce(oc, 0) AS oc
 FROM pri JOIN planes fl USING (scan_id) LEFT JOIN frm USING (scan_id) LEFT JOIN opp USING (scan_id) LEFT JOIN flat USING (scan_id) LEFT JOIN seen USING (scan_id) LEFT JOIN nst USING (scan_id) LEFT JOIN ({_SHOELACE.format("capture_edges")}) ca USING (scan_id) LEFT JOIN ({_SHOELACE.format("footprint_edges")}) fa USING (scan_id)
 LEFT JOIN axr USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS oc FROM openings GROUP BY 1) USING (scan_id) WHERE fl.kind = 'floor' AND rn = 1), {_RULES}
SELECT scan_id, name, status FROM checks""")
def _(fx):
    return qa.qa_checks(measured_of(fx)).select("scan_id", "name", "status")


def twin_metrics(fx):
    return assess(fx.points, fx.scans, fx.planes, fx.openings, fx.footprint_edges, pg.polygon_area(fx.capture_edges).select("scan_id", F.col("area").alias("capture_bounds_area_m2")), fx.mesh_faces, min_wall_points=5, min_floor_points=20)


@query("qa_metrics", ["points", "scans", "planes", "openings", "footprint_edges", "capture_edges", "mesh_faces"])
def _(fx):
    return qa.qa_metrics(twin_metrics(fx))


_VER = """req AS (SELECT scan_id, cam_id AS request_id, x, y, z, x + 0.8e0 AS bx, y + 0.3e0 AS b2, z + 0.1e0 * (cam_id % 9) AS bz FROM cameras), m AS (SELECT scan_id, CASE WHEN scan_id % 9 = 0 THEN NULL ELSE (scan_id % 6) / 100.0e0 END AS sp, CASE WHEN scan_id % 5 = 0 THEN NULL ELSE (scan_id % 70) / 1000.0e0 END AS dr, (scan_id % 10) / 10.0e0 AS cf FROM scans),
d AS (SELECT *, sqrt((bx-x)*(bx-x) + (b2-y)*(b2-y) + (bz-z)*(bz-z)) AS d FROM req JOIN m USING (scan_id)), t AS (SELECT *, sqrt(2e0) * 0.5e0 * sp AS t1, dr * least(1e0, d / sqrt(5e0*5e0 + 4.2e0*4.2e0 + 2.7e0*2.7e0)) AS t2, CASE WHEN cf > 0 THEN 0.01e0 * (1 - cf) * d END AS t3 FROM d)"""


@query("verify_measurement", ["cameras", "scans"], f"""WITH {_VER} SELECT scan_id, request_id, round(d, 3) AS distance_m, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL THEN greatest(0.001e0, round(sqrt(t1*t1 + t2*t2 + t3*t3), 3)) END AS uncertainty_m,
CASE WHEN coalesce(t1, t2, t3) IS NOT NULL THEN greatest(0.001e0, round(sqrt(coalesce(t1*t1, 0e0) + coalesce(t2*t2, 0e0) + coalesce(t3*t3, 0e0)), 3)) END AS uncertainty_floor_m, cam_in AS within_capture FROM (SELECT t.*, request_id % 2 = 0 AS cam_in FROM t)""")
def _(fx):
    c = F.col
    req = fx.cameras.select("scan_id", c("cam_id").alias("request_id"), c("x").alias("ax"), c("y").alias("ay"), c("z").alias("az"), (c("x") + 0.8).alias("bx"), (c("y") + 0.3).alias("by"), (c("z") + 0.1 * (c("cam_id") % 9)).alias("bz"))
    inside = fx.cameras.select("scan_id", c("cam_id").alias("request_id"), (c("cam_id") % 2 == 0).alias("inside"))
    out = qa.verify_measurement(req, metrics_of(fx), inside)
    return out.select("scan_id", "request_id", "distance_m", "uncertainty_m", "uncertainty_floor_m", "within_capture")


@query("scout_report", ["points", "scans", "footprint_edges", "capture_edges", "openings", "mesh_vertices", "planes"])
def _(fx):
    m = cut_lineage(measured_of(fx))
    return scout_report(fx.points, fx.scans, fx.footprint_edges, fx.capture_edges, fx.openings, m, qa.qa_checks(m), fx.mesh_vertices.select("scan_id", "filled"), 0.5)

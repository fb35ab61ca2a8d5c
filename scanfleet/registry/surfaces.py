"""Sampling, meshes, normals and planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.linalg import moments
from ..functions.vec import r6
from ..operators import cells as cl
from ..operators import mesh as ms
from ..operators import normals as nm
from ..operators import planes as pl
from ..operators import sampling as sp
from . import query
from .neighbours import knn_sql
from .points import rounded

_LADDER = ", ".join(f"({i}, {v!r}e0)" for i, v in enumerate(sp.LADDER))
_IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1 AS idx, count(*) OVER (PARTITION BY scan_id) AS total FROM points)"


@query("voxel_subsample", ["points"], f"""WITH box AS (SELECT scan_id, count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))) AS diag FROM points GROUP BY 1),
ladder AS (SELECT * FROM (VALUES {_LADDER}) AS v(step, share)),
keyed AS (SELECT p.scan_id, point_id, step, share, floor((x - lx) / (diag * share)) AS vx, floor((y - ly) / (diag * share)) AS vy, floor((z - lz) / (diag * share)) AS vz FROM points p JOIN box b ON p.scan_id = b.scan_id AND n > 300 CROSS JOIN ladder),
sizes AS (SELECT scan_id, step, count(DISTINCT (vx, vy, vz)) AS c FROM keyed GROUP BY 1, 2), fit AS (SELECT scan_id, min(step) AS step FROM sizes WHERE c <= 300 GROUP BY 1)
SELECT k.scan_id, min(point_id) AS point_id FROM keyed k JOIN fit f ON k.scan_id = f.scan_id AND k.step = f.step GROUP BY k.scan_id, vx, vy, vz
UNION ALL SELECT p.scan_id, point_id FROM points p JOIN box b ON p.scan_id = b.scan_id AND n <= 300""")
def _(fx):
    return sp.voxel_subsample(fx.points, 300).select("scan_id", "point_id")


@query("read_points", ["points"], """SELECT scan_id, count(*) AS before, CASE WHEN count(*) > 100000 THEN NULL ELSE count(*) END AS after FROM points GROUP BY 1""")
def _(fx):
    from ..sources.tables import read_budget

    kept, report = read_budget(fx.points, 100_000)
    return report.select("scan_id", "before", "after")


@query("stride_sample", ["points"], f"WITH {_IDX} SELECT scan_id, point_id FROM idx WHERE idx % CAST(ceil(total / 200.0e0) AS BIGINT) = 0")
def _(fx):
    return sp.stride_sample(fx.points, 200).select("scan_id", "point_id")


@query("jittered_stride_decimate", ["points"], f"""WITH {_IDX}, picks AS (SELECT DISTINCT scan_id, CAST(least(floor((b + ((b * 40503 + scan_id * 30011 + 12345) % 65536) / 65536.0e0) * (total / 150.0e0)), total - 1) AS BIGINT) AS idx
 FROM (SELECT DISTINCT scan_id, total FROM idx WHERE total > 150), range(150) r(b)) SELECT scan_id, point_id FROM idx JOIN picks USING (scan_id, idx) UNION ALL SELECT scan_id, point_id FROM idx WHERE total <= 150""")
def _(fx):
    return sp.jittered_stride_decimate(fx.points, 150).select("scan_id", "point_id")


@query("lattice_unique", ["points"], "SELECT scan_id, min(point_id) AS point_id FROM points GROUP BY scan_id, floor(x / 0.3e0), floor(y / 0.3e0)")
def _(fx):
    return sp.lattice_unique(fx.points, 0.3).select("scan_id", "point_id")


@query("union_clouds", ["points", "mesh_vertices"], "SELECT scan_id, point_id, x, r, CAST(NULL AS DOUBLE) AS filled FROM points UNION ALL SELECT scan_id, vertex_id, x, r, filled FROM mesh_vertices")
def _(fx):
    verts = fx.mesh_vertices.select("scan_id", F.col("vertex_id").alias("point_id"), "x", "r", "filled")
    return sp.union_clouds(fx.points.select("scan_id", "point_id", "x", "r"), verts)


@query("filter_finite", ["points"], "SELECT scan_id, point_id FROM points WHERE quantity_ok".replace("quantity_ok", "NOT (point_id % 7 = 0) AND NOT (point_id % 11 = 0)"))
def _(fx):
    bad = fx.points.withColumns({
        "x": F.when(F.col("point_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")),
        "z": F.when(F.col("point_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("z")),
    })
    return ms.filter_finite(bad).select("scan_id", "point_id")


_FACE = """corner AS (SELECT f.scan_id, face_id, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2, a.r AS r0, b.r AS r1, c.r AS r2
 FROM mesh_faces f JOIN mesh_vertices a ON a.scan_id = f.scan_id AND a.vertex_id = f.v0 JOIN mesh_vertices b ON b.scan_id = f.scan_id AND b.vertex_id = f.v1 JOIN mesh_vertices c ON c.scan_id = f.scan_id AND c.vertex_id = f.v2),
av AS (SELECT *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS ax, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS ay, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS az FROM corner), fg AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS l FROM av)"""
_MESH = ["mesh_vertices", "mesh_faces"]


@query("face_geometry", _MESH, f"WITH {_FACE} SELECT scan_id, face_id, round(ax / l, 6) + 0.0e0 AS nx, round(ay / l, 6) + 0.0e0 AS ny, round(az / l, 6) + 0.0e0 AS nz, round(0.5e0 * l, 6) AS area FROM fg")
def _(fx):
    return rounded(ms.face_geometry(fx.mesh_vertices, fx.mesh_faces), "nx", "ny", "nz", "area").drop("v0", "v1", "v2")


@query("vertex_normals", _MESH, f"""WITH {_FACE}, w AS (SELECT scan_id, unnest([v0, v1, v2]) AS vertex_id, ax, ay, az FROM fg), s AS (SELECT scan_id, vertex_id, sum(ax) AS x, sum(ay) AS y, sum(az) AS z FROM w GROUP BY 1, 2)
SELECT scan_id, vertex_id, round(x / sqrt(x*x+y*y+z*z), 6) + 0.0e0 AS nx, round(y / sqrt(x*x+y*y+z*z), 6) + 0.0e0 AS ny, round(z / sqrt(x*x+y*y+z*z), 6) + 0.0e0 AS nz FROM s""")
def _(fx):
    return rounded(ms.vertex_normals(fx.mesh_vertices, fx.mesh_faces), "nx", "ny", "nz")


@query("fan_triangulate", ["mesh_faces"], """WITH p AS (SELECT scan_id, face_id AS polygon_id, unnest(range(2 + face_id % 3)) + 1 AS t, v0, v1, v2 FROM mesh_faces), c AS (SELECT scan_id, face_id AS polygon_id, [v0, v1, v2, v0 + 1, v1 + 7] AS c, 3 + face_id % 3 AS n FROM mesh_faces)
SELECT scan_id, polygon_id, t, c[1] AS v0, c[t + 1] AS v1, c[t + 2] AS v2 FROM (SELECT *, unnest(range(n - 2)) + 1 AS t FROM c)""")
def _(fx):
    corners = F.slice(F.array("v0", "v1", "v2", F.col("v0") + 1, F.col("v1") + 7), F.lit(1), (3 + F.col("face_id") % 3).cast("int"))
    return ms.fan_triangulate(fx.mesh_faces.select("scan_id", F.col("face_id").alias("polygon_id"), corners.alias("corners")))


_EDGES = "edges AS (SELECT scan_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS u FROM (SELECT scan_id, unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b FROM mesh_faces) GROUP BY 1, 2, 3)"


@query("boundary_edge_fraction", ["mesh_faces"], f"WITH {_EDGES} SELECT scan_id, round(avg(CASE WHEN u = 1 THEN 1e0 ELSE 0e0 END), 6) AS boundary_edge_fraction, count(*) AS edges FROM edges GROUP BY 1")
def _(fx):
    return rounded(ms.boundary_edge_fraction(fx.mesh_faces), "boundary_edge_fraction")


@query("mesh_components", _MESH, """WITH RECURSIVE strip AS (SELECT * FROM mesh_faces), e AS (SELECT DISTINCT scan_id, unnest([v0, v1, v2, v1, v2, v0]) AS a, unnest([v1, v2, v0, v0, v1, v2]) AS b FROM strip),
reach AS (SELECT scan_id, vertex_id AS id, vertex_id AS seen FROM mesh_vertices UNION SELECT r.scan_id, r.id, e.b FROM reach r JOIN e ON e.scan_id = r.scan_id AND e.a = r.seen)
SELECT scan_id, id AS vertex_id, min(seen) AS component FROM reach GROUP BY 1, 2""")
def _(fx):
    return ms.mesh_components(fx.mesh_vertices, fx.mesh_faces)


_CLUSTER = """o AS (SELECT scan_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM mesh_vertices GROUP BY 1),
k AS (SELECT v.*, floor((x - lx) / 0.6e0) AS kx, floor((y - ly) / 0.6e0) AS ky, floor((z - lz) / 0.6e0) AS kz FROM mesh_vertices v JOIN o USING (scan_id)),
c AS (SELECT scan_id, kx, ky, kz, min(vertex_id) AS cid, avg(x) AS x, avg(y) AS y, avg(z) AS z, CAST(floor(avg(r)) AS INT) AS r FROM k GROUP BY 1, 2, 3, 4), m AS (SELECT k.scan_id, vertex_id, cid FROM k JOIN c USING (scan_id, kx, ky, kz)),
f AS (SELECT f.scan_id, face_id, a.cid AS a, b.cid AS b, d.cid AS d FROM mesh_faces f JOIN m a ON a.scan_id = f.scan_id AND a.vertex_id = f.v0 JOIN m b ON b.scan_id = f.scan_id AND b.vertex_id = f.v1 JOIN m d ON d.scan_id = f.scan_id AND d.vertex_id = f.v2)"""


@query("mesh_vertex_cluster", _MESH, f"""WITH {_CLUSTER} SELECT 'vertex' AS part, scan_id, cid AS id, round(x, 6) AS x, round(y, 6) AS y, r FROM c
UNION ALL SELECT 'face', scan_id, min(face_id), NULL, NULL, NULL FROM f WHERE a <> b AND b <> d AND d <> a GROUP BY scan_id, list_sort([a, b, d])""")
def _(fx):
    v, f = ms.mesh_vertex_cluster(fx.mesh_vertices, fx.mesh_faces, 0.6)
    v = rounded(v, "x", "y").select(F.lit("vertex").alias("part"), "scan_id", F.col("vertex_id").alias("id"), "x", "y", "r")
    null = F.lit(None)
    return v.union(f.select(F.lit("face"), "scan_id", "face_id", null.cast("double"), null.cast("double"), null.cast("int")))


@query("decimate_mesh", _MESH)
def _(fx):
    v, f = ms.decimate_mesh(fx.mesh_vertices, fx.mesh_faces, 80)
    return f.groupBy("scan_id").agg(F.count(F.lit(1)).alias("faces"))


@query("sample_mesh_surface", _MESH, f"""WITH {_FACE}, t AS (SELECT scan_id, sum(0.5e0 * l) AS total FROM fg GROUP BY 1), w AS (SELECT fg.*, round(0.5e0 * l / total * 500, 9) AS want FROM fg JOIN t USING (scan_id)),
q AS (SELECT *, floor(want) AS base, round(floor(want) - want, 9) AS rem FROM w), s AS (SELECT scan_id, 500 - sum(base) AS short FROM q GROUP BY 1),
n AS (SELECT q.*, CAST(base + CASE WHEN row_number() OVER (PARTITION BY scan_id ORDER BY rem, face_id) <= short THEN 1 ELSE 0 END AS BIGINT) AS n FROM q JOIN s USING (scan_id)),
e AS (SELECT *, unnest(range(n)) AS s FROM n), uv AS (SELECT *, (0.5e0 + s * 0.7548776662466927e0 + face_id * 0.6180339887498949e0) % 1.0e0 AS u0, (0.5e0 + s * 0.5698402909980532e0 + face_id * 0.4142135623730951e0) % 1.0e0 AS w0 FROM e),
f AS (SELECT *, CASE WHEN u0 + w0 > 1 THEN 1 - u0 ELSE u0 END AS u, CASE WHEN u0 + w0 > 1 THEN 1 - w0 ELSE w0 END AS v FROM uv)
SELECT scan_id, face_id, s, round(x0 + u * (x1 - x0) + v * (x2 - x0), 6) AS x, round(y0 + u * (y1 - y0) + v * (y2 - y0), 6) AS y, round(z0 + u * (z1 - z0) + v * (z2 - z0), 6) AS z,
 CAST(least(greatest(floor((1 - u - v) * r0 + u * r1 + v * r2), 0), 255) AS INT) AS r FROM f""")
def _(fx):
    out = ms.sample_mesh_surface(fx.mesh_vertices, fx.mesh_faces, 500)
    return rounded(out, "x", "y", "z").select("scan_id", "face_id", "s", "x", "y", "z", "r")


@query("mute_inferred_colours", ["mesh_vertices"], "SELECT scan_id, vertex_id, " + ", ".join(f"CAST(floor({c} * (1 - 0.75e0 * filled) + 128 * (0.75e0 * filled)) AS INT) AS {c}" for c in "rgb") + " FROM mesh_vertices")
def _(fx):
    from ..operators.transforms import mute_inferred_colours

    return mute_inferred_colours(fx.mesh_vertices).select("scan_id", "vertex_id", "r", "g", "b")


@query("neighbour_stats", ["points"], f"""WITH {knn_sql(8)}, p AS (SELECT scan_id, point_id, min(dist) AS d1, min(CASE WHEN dist >= 0.001e0 THEN dist END) AS f, max(dist) AS rk FROM near GROUP BY 1, 2)
SELECT scan_id, round(quantile_cont(f, 0.5), 6) AS median_spacing_m, round(quantile_cont(7 / (pi() * rk * rk), 0.5), 4) AS density_per_m2, round(avg(CASE WHEN d1 < 0.001e0 THEN 1e0 ELSE 0e0 END), 6) AS duplicate_fraction FROM p GROUP BY 1""")
def _(fx):
    return rounded(nm.neighbour_stats(fx.points).withColumn("density_per_m2", F.round("density_per_m2", 4)), "median_spacing_m", "duplicate_fraction")


@query("trim_outliers", ["points"], f"""WITH {knn_sql(8)}, m AS (SELECT scan_id, point_id, avg(dist) AS m FROM near GROUP BY 1, 2), d AS (SELECT scan_id, quantile_cont(m, 0.5) AS med FROM m GROUP BY 1),
a AS (SELECT scan_id, any_value(med) + 3.0e0 * 1.4826e0 * quantile_cont(abs(m - med), 0.5) AS lim FROM m JOIN d USING (scan_id) GROUP BY 1) SELECT scan_id, point_id FROM m JOIN a USING (scan_id) WHERE m <= lim""")
def _(fx):
    return nm.trim_outliers(fx.points).select("scan_id", "point_id")


@query("estimate_normals", ["points"])
def _(fx):
    return nm.estimate_normals(fx.points, 12)


@query("local_curvature", ["points"])
def _(fx):
    return nm.local_curvature(fx.points, 12)


def with_normals(fx):
    """The test points have no normals; levels that read as floor or ceiling get vertical ones, the rest face X or Y."""
    flat = (F.col("z") < 0.1) | (F.col("z") > 2.6)
    side = F.col("r") % 72 == 0
    one, zero = F.lit(1.0), F.lit(0.0)
    return fx.points.withColumns({
        "nx": F.when(~flat & side, one).otherwise(zero), "ny": F.when(~flat & ~side, -one).otherwise(zero),
        "nz": F.when(flat, F.when(F.col("z") < 1.0, one).otherwise(-one)).otherwise(zero),
    })


NORMALS_SQL = """np AS (SELECT *, CASE WHEN NOT (z < 0.1e0 OR z > 2.6e0) AND r % 72 = 0 THEN 1e0 ELSE 0e0 END AS nx, CASE WHEN NOT (z < 0.1e0 OR z > 2.6e0) AND r % 72 <> 0 THEN -1e0 ELSE 0e0 END AS ny,
 CASE WHEN z < 0.1e0 THEN 1e0 WHEN z > 2.6e0 THEN -1e0 ELSE 0e0 END AS nz FROM points)"""


@query("orient_normals", ["points", "cameras"], f"""WITH {NORMALS_SQL}, near AS (SELECT a.scan_id, a.point_id, arg_min(struct_pack(x := c.x, y := c.y, z := c.z), struct_pack(d := (a.x-c.x)*(a.x-c.x) + (a.y-c.y)*(a.y-c.y) + (a.z-c.z)*(a.z-c.z), i := c.cam_id)) AS c FROM points a JOIN cameras c USING (scan_id) GROUP BY 1, 2),
s AS (SELECT np.*, CASE WHEN nx * (c.x - x) + ny * (c.y - y) + nz * (c.z - z) < 0 THEN -1e0 ELSE 1e0 END AS s FROM np JOIN near n ON n.scan_id = np.scan_id AND n.point_id = np.point_id)
SELECT scan_id, point_id, nx * s + 0.0e0 AS nx, ny * s + 0.0e0 AS ny, nz * s + 0.0e0 AS nz FROM s""")
def _(fx):
    pts = with_normals(fx)
    return rounded(nm.orient_normals(pts, pts.select("scan_id", "point_id", "nx", "ny", "nz"), fx.cameras), "nx", "ny", "nz")


@query("plane_moments", ["points", "planes"], """SELECT scan_id, plane_id, count(*) AS n, round(sum(x), 4) AS mx, round(sum(x * x), 4) AS mxx, round(sum(x * y), 4) AS mxy, round(sum(y * z), 4) AS myz, round(sum(z * z), 4) AS mzz
FROM points JOIN planes USING (scan_id) WHERE abs(nx * x + ny * y + nz * z - plane_offset) <= 0.06e0 GROUP BY 1, 2""")
def _(fx):
    from ..operators.transforms import plane_inliers

    rows = plane_inliers(fx.points, fx.planes, 0.06)
    out = rows.groupBy("scan_id", "plane_id").agg(*moments(F.col("x"), F.col("y"), F.col("z")))
    return out.select("scan_id", "plane_id", "n", *[F.round(c, 4).alias(c) for c in ("mx", "mxx", "mxy", "myz", "mzz")])


@query("fit_plane", ["points", "planes"])
def _(fx):
    from ..operators.transforms import plane_inliers

    return pl.fit_plane(plane_inliers(fx.points, fx.planes, 0.06), ["scan_id", "plane_id"])


@query("planarity_rms", ["points", "planes"], """SELECT scan_id, plane_id, round(sqrt(avg(d * d)), 6) AS rms_m, count(*) AS n FROM (SELECT scan_id, plane_id, nx * x + ny * y + nz * z - plane_offset AS d FROM points JOIN planes USING (scan_id)) WHERE abs(d) <= 0.06e0 GROUP BY 1, 2""")
def _(fx):
    return rounded(pl.planarity_rms(fx.points, fx.planes, 0.06), "rms_m")


_ROUNDS = ", ".join(
    f"k{i + 1} AS (SELECT *, CASE WHEN 1 - exp(-n / greatest(c{i}, 1e-9)) < 1e-6 THEN c{i} ELSE least(c0 / (1 - exp(-n / greatest(c{i}, 1e-9))), cap) END AS c{i + 1} FROM k{i})" for i in range(8)
)


@query("plane_extent_area", ["points", "planes"], f"""WITH uv AS (SELECT scan_id, plane_id, CASE WHEN plane_id IN (1, 2) THEN nz * x ELSE (nx * y - ny * x) / sqrt(nx * nx + ny * ny) END AS u, CASE WHEN plane_id IN (1, 2) THEN y ELSE z END AS v FROM points JOIN planes USING (scan_id) WHERE abs(nx * x + ny * y + nz * z - plane_offset) <= 0.06e0),
b AS (SELECT scan_id, plane_id, count(*) AS n, min(u) AS umin, max(u) AS umax, min(v) AS vmin, max(v) AS vmax FROM uv GROUP BY 1, 2), s AS (SELECT *, greatest(umax - umin, 1e-9) AS su, greatest(vmax - vmin, 1e-9) AS sv FROM b),
c AS (SELECT *, least(greatest(sqrt(4 / greatest(n / (su * sv), 1e-9)), 0.04e0), 0.4e0) AS cell FROM s), d AS (SELECT *, floor(su / cell) + 1 AS nu, floor(sv / cell) + 1 AS nv FROM c),
o AS (SELECT scan_id, plane_id, count(DISTINCT (least(floor((u - umin) / cell), nu - 1), least(floor((v - vmin) / cell), nv - 1))) AS occ FROM uv JOIN d USING (scan_id, plane_id) GROUP BY 1, 2),
k0 AS (SELECT d.*, CAST(occ AS DOUBLE) AS c0, nu * nv AS cap FROM d JOIN o USING (scan_id, plane_id)), {_ROUNDS}
SELECT scan_id, plane_id, n, round(least(c8 * cell * cell, su * sv), 5) AS area, round(su, 6) AS span_u, round(sv, 6) AS span_v FROM k8""")
def _(fx):
    from ..operators.transforms import plane_inliers

    out = pl.plane_extent_area(plane_inliers(fx.points, fx.planes, 0.06), fx.planes)
    return out.select("scan_id", "plane_id", "n", F.round("area", 5).alias("area"), r6(F.col("umax") - F.col("umin")).alias("span_u"), r6(F.col("vmax") - F.col("vmin")).alias("span_v"))


@query("score_hypotheses", ["points", "planes"], f"""WITH {NORMALS_SQL} SELECT n.scan_id, plane_id, CAST(sum(CASE WHEN abs(p.nx * x + p.ny * y + p.nz * z - plane_offset) <= 0.06e0 AND abs(p.nx * n.nx + p.ny * n.ny + p.nz * n.nz) >= cos(radians(12)) THEN 1 ELSE 0 END) AS BIGINT) AS inliers
FROM np n JOIN planes p ON p.scan_id = n.scan_id GROUP BY 1, 2""")
def _(fx):
    return pl.score_hypotheses(with_normals(fx), fx.planes, 0.06, 12.0)


@query("rank_planes", ["planes"], "SELECT scan_id, plane_id, inlier_count, row_number() OVER (PARTITION BY scan_id ORDER BY inlier_count DESC, plane_id) AS rank FROM planes")
def _(fx):
    return pl.rank_planes(fx.planes).select("scan_id", "plane_id", "inlier_count", "rank")


@query("detect_planes", ["points"])
def _(fx):
    return pl.detect_planes(with_normals(fx), min_inliers=15).select("scan_id", "plane_id", "nx", "ny", "nz", "plane_offset", "inlier_count", "area")


_CELLS = "base AS (SELECT DISTINCT scan_id, CAST(floor(x / 0.15e0) AS BIGINT) AS i, CAST(floor(y / 0.15e0) AS BIGINT) AS j FROM points)"
_N8 = "(SELECT a AS di, b AS dj FROM range(-1, 2) r(a), range(-1, 2) s(b))"


def cells_of(fx):
    return fx.points.select("scan_id", F.floor(F.col("x") / 0.15).alias("i"), F.floor(F.col("y") / 0.15).alias("j")).distinct()


@query("dilate_cells", ["points"], f"WITH {_CELLS} SELECT DISTINCT scan_id, i + di AS i, j + dj AS j FROM base, {_N8}")
def _(fx):
    return cl.dilate_cells(cells_of(fx), ["i", "j"])


@query("erode_cells", ["points"], f"WITH {_CELLS} SELECT scan_id, i, j FROM (SELECT scan_id, i + di AS i, j + dj AS j, count(*) AS n FROM base, {_N8} WHERE di = 0 OR dj = 0 GROUP BY 1, 2, 3) WHERE n = 5")
def _(fx):
    return cl.erode_cells(cells_of(fx), ["i", "j"], "faces")


@query("boundary_shell", ["points"], f"WITH {_CELLS}, e AS (SELECT scan_id, i, j FROM (SELECT scan_id, i + di AS i, j + dj AS j, count(*) AS n FROM base, {_N8} WHERE di = 0 OR dj = 0 GROUP BY 1, 2, 3) WHERE n = 5) SELECT * FROM base ANTI JOIN e USING (scan_id, i, j)")
def _(fx):
    return cl.boundary_shell(cells_of(fx), ["i", "j"])


_CLOSE = f"""g AS (SELECT DISTINCT scan_id, i + a AS i, j + b AS j FROM base, range(-2, 3) r(a), range(-2, 3) s(b)), closed AS (SELECT scan_id, i, j FROM (SELECT scan_id, i + a AS i, j + b AS j, count(*) AS n FROM g, range(-2, 3) r(a), range(-2, 3) s(b) GROUP BY 1, 2, 3) WHERE n = 25)"""


@query("close_cells", ["points"], f"WITH {_CELLS}, {_CLOSE} SELECT * FROM closed")
def _(fx):
    return cl.close_cells(cells_of(fx), ["i", "j"], 2)


@query("fill_holes", ["points"], f"""WITH RECURSIVE {_CELLS}, box AS (SELECT scan_id, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM base GROUP BY 1),
bg AS (SELECT scan_id, i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT *, unnest(range(i0, i1 + 1)) AS i FROM box)), free AS (SELECT * FROM bg ANTI JOIN base USING (scan_id, i, j)),
outside AS (SELECT scan_id, i0 AS i, j0 AS j FROM box UNION SELECT f.scan_id, f.i, f.j FROM outside o, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(di, dj), free f WHERE f.scan_id = o.scan_id AND f.i = o.i + di AND f.j = o.j + dj)
SELECT * FROM base UNION ALL SELECT * FROM free ANTI JOIN outside USING (scan_id, i, j)""")
def _(fx):
    return cl.fill_holes(cells_of(fx), ["i", "j"])


@query("connected_components", ["points"], f"""WITH RECURSIVE {_CELLS}, small AS (SELECT * FROM base), reach AS (SELECT scan_id, i, j, i AS a, j AS b FROM small UNION SELECT r.scan_id, r.i, r.j, s.i, s.j FROM reach r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(di, dj), small s
 WHERE s.scan_id = r.scan_id AND s.i = r.a + di AND s.j = r.b + dj), lab AS (SELECT scan_id, i, j, min(a * 1000 + b) AS first_cell FROM reach GROUP BY 1, 2, 3) SELECT scan_id, first_cell, count(*) AS cells FROM lab GROUP BY 1, 2""")
def _(fx):
    lab = cl.cell_components(cells_of(fx), ["i", "j"])
    return lab.groupBy("scan_id", "label").agg(F.min(F.col("i") * 1000 + F.col("j")).alias("first_cell"), F.count(F.lit(1)).alias("cells")).drop("label")


@query("free_minus_solid", ["points", "cameras"], f"WITH {_CELLS}, s AS (SELECT DISTINCT scan_id, CAST(floor(x / 0.15e0) AS BIGINT) AS i, CAST(floor(y / 0.15e0) AS BIGINT) AS j FROM cameras) SELECT * FROM base ANTI JOIN s USING (scan_id, i, j)")
def _(fx):
    solid = fx.cameras.select("scan_id", F.floor(F.col("x") / 0.15).alias("i"), F.floor(F.col("y") / 0.15).alias("j")).distinct()
    return cl.minus(cells_of(fx), solid, ["i", "j"])


@query("percentile_span", ["points"], "SELECT scan_id, round(quantile_cont(x, 0.998) - quantile_cont(x, 0.002), 6) AS span_x, round(greatest(0e0, (max(x) - min(x)) - (quantile_cont(x, 0.998) - quantile_cont(x, 0.002))) / 2, 6) AS trim_x FROM points GROUP BY 1")
def _(fx):
    from ..operators.structure import percentile_span

    return rounded(percentile_span(fx.points, "x"), "span_x", "trim_x")


@query("axis_extremes", ["points"], "SELECT scan_id, round(quantile_cont(0.6e0 * x + 0.8e0 * z, 0.002), 6) AS lo, round(quantile_cont(0.6e0 * x + 0.8e0 * z, 0.998), 6) AS hi FROM points GROUP BY 1")
def _(fx):
    return rounded(stats.percentiles(fx.points, ["scan_id"], 0.6 * F.col("x") + 0.8 * F.col("z"), {"lo": 0.002, "hi": 0.998}), "lo", "hi")

"""Transforms, predicates, bounds and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vec import r6
from ..operators import transforms as tr
from ..operators import voxels as vx
from . import query


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def matrices(fx):
    """The fixture's similarities as 16-double matrices."""
    c, s, k = F.col("c"), F.col("sn"), F.col("s")
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(k * c, -k * s, zero, F.col("tx"), k * s, k * c, zero, F.col("ty"), zero, zero, k, F.col("tz"), zero, zero, zero, one)
    return fx.transforms.select("scan_id", m.alias("m"))


MOVED = "s * c * {x} - s * sn * {y} + tx", "s * sn * {x} + s * c * {y} + ty", "s * {z} + tz"


def _r(expr, name):
    return f"round({expr}, 6) + 0.0e0 AS {name}"


_MOVED_SQL = ", ".join(_r(e.format(x="x", y="y", z="z"), n) for e, n in zip(MOVED, "xyz"))


@query("transform_points", ["points", "transforms"], f"SELECT scan_id, point_id, {_MOVED_SQL} FROM points JOIN transforms USING (scan_id)")
def _(fx):
    out = tr.transform_points(fx.points.select("scan_id", "point_id", "x", "y", "z"), matrices(fx))
    return rounded(out, "x", "y", "z")


@query("transform_mesh", ["mesh_vertices", "mesh_faces", "transforms"], f"""
WITH flipped AS (SELECT *, CASE WHEN scan_id % 2 = 1 THEN -1e0 ELSE 1e0 END AS zs FROM transforms),
v AS (SELECT scan_id, vertex_id, {_MOVED_SQL.replace("s * z", "zs * s * z")} FROM mesh_vertices JOIN flipped USING (scan_id))
SELECT f.scan_id, face_id, a.x AS ax, a.y AS ay, a.z AS az, c.x AS cx, c.y AS cy, c.z AS cz
FROM (SELECT scan_id, face_id, CASE WHEN scan_id % 2 = 1 THEN v2 ELSE v0 END AS v0, CASE WHEN scan_id % 2 = 1 THEN v0 ELSE v2 END AS v2 FROM mesh_faces) f
JOIN v a ON f.scan_id = a.scan_id AND f.v0 = a.vertex_id JOIN v c ON f.scan_id = c.scan_id AND f.v2 = c.vertex_id""")
def _(fx):
    mats = matrices(fx).withColumn("m", F.transform("m", lambda v, i: F.when((i == 10) & (F.col("scan_id") % 2 == 1), -v).otherwise(v)))
    v, f = tr.transform_mesh(fx.mesh_vertices.select("scan_id", "vertex_id", "x", "y", "z"), fx.mesh_faces, mats)
    v = rounded(v, "x", "y", "z")
    a = v.select("scan_id", F.col("vertex_id").alias("v0"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    c = v.select("scan_id", F.col("vertex_id").alias("v2"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return f.join(a, ["scan_id", "v0"]).join(c, ["scan_id", "v2"]).select("scan_id", "face_id", "ax", "ay", "az", "cx", "cy", "cz")


@query("transform_planes", ["planes", "transforms"], """
WITH n AS (SELECT *, c * nx - sn * ny AS ax, sn * nx + c * ny AS ay, nz AS az FROM planes JOIN transforms USING (scan_id)),
u AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS l FROM n)
SELECT scan_id, plane_id, round(ax / l, 6) + 0.0e0 AS nx, round(ay / l, 6) + 0.0e0 AS ny, round(az / l, 6) + 0.0e0 AS nz,
       round(s * plane_offset + (ax * tx + ay * ty + az * tz) / l, 6) + 0.0e0 AS plane_offset, kind, inlier_count, round(area * s * s, 6) + 0.0e0 AS area
FROM u""")
def _(fx):
    return rounded(tr.transform_planes(fx.planes, matrices(fx)), "nx", "ny", "nz", "plane_offset", "area")


_DIST = "nx * x + ny * y + nz * z - plane_offset"


@query("plane_signed_distance", ["points", "planes"], f"SELECT scan_id, point_id, plane_id, {_r(_DIST, 'dist')} FROM points JOIN planes USING (scan_id)")
def _(fx):
    return rounded(tr.plane_signed_distance(fx.points, fx.planes), "dist")


@query("plane_inliers", ["points", "planes"], f"SELECT scan_id, point_id, plane_id FROM points JOIN planes USING (scan_id) WHERE abs({_DIST}) <= 0.03e0")
def _(fx):
    return tr.plane_inliers(fx.points, fx.planes, 0.03).select("scan_id", "point_id", "plane_id")


@query("plane_uv", ["points", "planes"], f"""
WITH p AS (SELECT scan_id, plane_id, nx / l AS nx, ny / l AS ny, nz / l AS nz, nx AS rx, ny AS ry, nz AS rz, plane_offset,
  CASE WHEN abs(nz / l) > 0.99e0 THEN 1e0 ELSE 0e0 END AS ry0, CASE WHEN abs(nz / l) > 0.99e0 THEN 0e0 ELSE 1e0 END AS rz0
  FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS l FROM planes)),
v AS (SELECT *, -(ry0*ny + rz0*nz)*nx AS wx, ry0 - (ry0*ny + rz0*nz)*ny AS wy, rz0 - (ry0*ny + rz0*nz)*nz AS wz FROM p),
w AS (SELECT *, wx / sqrt(wx*wx+wy*wy+wz*wz) AS vx, wy / sqrt(wx*wx+wy*wy+wz*wz) AS vy, wz / sqrt(wx*wx+wy*wy+wz*wz) AS vz FROM v),
u AS (SELECT *, vy*nz - vz*ny AS ux, vz*nx - vx*nz AS uy, vx*ny - vy*nx AS uz FROM w)
SELECT q.scan_id, q.point_id, plane_id, round(x*ux + y*uy + z*uz, 6) + 0.0e0 AS u, round(x*vx + y*vy + z*vz, 6) + 0.0e0 AS v,
       round(rx*x + ry*y + rz*z - plane_offset, 6) + 0.0e0 AS s
FROM u JOIN points q USING (scan_id)""")
def _(fx):
    return rounded(tr.plane_uv(fx.points, fx.planes), "u", "v", "s")


@query("orient_planes", ["points", "planes"], f"""
WITH s AS (SELECT scan_id, plane_id, CASE WHEN sum(CASE WHEN {_DIST} > 0 THEN 1 ELSE 0 END) < sum(CASE WHEN {_DIST} < 0 THEN 1 ELSE 0 END) THEN -1e0 ELSE 1e0 END AS g
  FROM points JOIN planes USING (scan_id) GROUP BY 1, 2)
SELECT scan_id, plane_id, nx * g + 0.0e0 AS nx, ny * g + 0.0e0 AS ny, nz * g + 0.0e0 AS nz, round(plane_offset * g, 6) + 0.0e0 AS plane_offset
FROM planes JOIN s USING (scan_id, plane_id)""")
def _(fx):
    out = tr.orient_planes(fx.planes, fx.points)
    z = F.lit(0.0)
    return out.select("scan_id", "plane_id", (F.col("nx") + z).alias("nx"), (F.col("ny") + z).alias("ny"), (F.col("nz") + z).alias("nz"), r6(F.col("plane_offset")).alias("plane_offset"))


@query("subset_points", ["points"], "SELECT scan_id, point_id, x, y, z FROM points WHERE r > g AND z < 1.0e0")
def _(fx):
    index = fx.points.where("r > g AND z < 1.0e0").select("scan_id", "point_id")
    return tr.subset_points(fx.points.select("scan_id", "point_id", "x", "y", "z"), index)


@query("slab_filter", ["points", "scans"], """
SELECT DISTINCT scan_id, CAST(floor((x - 0.0e0) / 0.1e0) AS BIGINT) AS i, CAST(floor((y - 0.0e0) / 0.1e0) AS BIGINT) AS j
FROM points JOIN scans USING (scan_id) WHERE z >= floor_z + 0.5e0 AND z < floor_z + 2.0e0""")
def _(fx):
    lattice = fx.scans.select("scan_id", "floor_z", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.1).alias("cell"))
    return tr.slab_filter(fx.points, lattice, F.col("floor_z") + 0.5, F.col("floor_z") + 2.0)


_BOUNDS = "SELECT scan_id, " + ", ".join(f"{s}({a}) AS {s}_{a}" for s in ("min", "max") for a in "xyz") + " FROM points GROUP BY scan_id"
_GRID = "SELECT scan_id, " + ", ".join(
    f"min_{a} - 0.1e0 AS o{a}, CAST(greatest(ceil(greatest((max_{a} + 0.1e0) - (min_{a} - 0.1e0), 0.05e0) / 0.05e0), 1) AS BIGINT) AS dim_{a}" for a in "xyz"
) + " FROM bounds"
_VOX = """SELECT scan_id, i, j, k, count(*) AS n FROM (SELECT scan_id, dim_x, dim_y, dim_z, CAST(floor((x - ox) / 0.05e0) AS BIGINT) AS i,
  CAST(floor((y - oy) / 0.05e0) AS BIGINT) AS j, CAST(floor((z - oz) / 0.05e0) AS BIGINT) AS k FROM points JOIN grids USING (scan_id))
  WHERE i >= 0 AND i < dim_x AND j >= 0 AND j < dim_y AND k >= 0 AND k < dim_z GROUP BY 1, 2, 3, 4"""
_GRIDDED = f"WITH bounds AS ({_BOUNDS}), grids AS ({_GRID}), voxels AS ({_VOX})"


@query("cloud_bounds", ["points"], f"WITH bounds AS ({_BOUNDS}) SELECT *, " + ", ".join(f"round(max_{a} - min_{a}, 6) AS extent_{a}" for a in "xyz") + " FROM bounds")
def _(fx):
    return rounded(vx.cloud_bounds(fx.points), "extent_x", "extent_y", "extent_z")


def grids_of(fx):
    grids = vx.grid_frames(vx.cloud_bounds(fx.points))
    return grids, vx.voxel_grid(fx.points, grids)


@query("voxel_grid", ["points"], f"{_GRIDDED} SELECT * FROM voxels")
def _(fx):
    return grids_of(fx)[1]


@query("grid_stats", ["points"], f"""{_GRIDDED} SELECT scan_id, dim_x, dim_y, dim_z, round(oz + dim_z * 0.05e0, 6) AS far_z, count(*) AS occupied,
CAST(sum(n) AS BIGINT) AS returns, round(0.05e0 * 0.05e0 * 0.05e0, 9) AS voxel_volume FROM voxels JOIN grids USING (scan_id) GROUP BY scan_id, dim_x, dim_y, dim_z, oz""")
def _(fx):
    grids, voxels = grids_of(fx)
    out = vx.grid_stats(voxels, grids).select("scan_id", "dim_x", "dim_y", "dim_z", r6(F.col("far_z")).alias("far_z"), "occupied", "returns", F.round("voxel_volume", 9).alias("voxel_volume"))
    return out


for _name, _agg, _col in (("height_map", "max", "top_z"), ("floor_map", "min", "bottom_z")):
    @query(_name, ["points"], f"{_GRIDDED} SELECT scan_id, i, j, round(min(oz) + ({_agg}(k) + 0.5e0) * 0.05e0, 6) AS {_col} FROM voxels JOIN grids USING (scan_id) GROUP BY 1, 2, 3")
    def _(fx, fn=getattr(vx, _name), col=_col):
        grids, voxels = grids_of(fx)
        return rounded(fn(voxels, grids), col)


@query("column_occupancy", ["points", "cameras"], f"""{_GRIDDED} SELECT c.scan_id, cam_id AS request_id, k, n
FROM cameras c JOIN grids g USING (scan_id) JOIN voxels v ON v.scan_id = c.scan_id AND v.i = CAST(floor((c.x - g.ox) / 0.05e0) AS BIGINT) AND v.j = CAST(floor((c.y - g.oy) / 0.05e0) AS BIGINT)""")
def _(fx):
    grids, voxels = grids_of(fx)
    return vx.column_occupancy(voxels, grids, fx.cameras.select("scan_id", F.col("cam_id").alias("request_id"), "x", "y"))


@query("occupied_points", ["points"], f"""{_GRIDDED} SELECT scan_id, i, j, k, round(ox + (i + 0.5e0) * 0.05e0, 6) AS cx, round(oy + (j + 0.5e0) * 0.05e0, 6) AS cy, round(oz + (k + 0.5e0) * 0.05e0, 6) AS cz
FROM voxels JOIN grids USING (scan_id)""")
def _(fx):
    grids, voxels = grids_of(fx)
    return rounded(vx.occupied_points(voxels, grids), "cx", "cy", "cz")


@query("voxel_coords", ["points"], f"""{_GRIDDED} SELECT scan_id, point_id, CAST(floor((x - ox) / 0.05e0) AS BIGINT) AS i, CAST(floor((y - oy) / 0.05e0) AS BIGINT) AS j, CAST(floor((z - oz) / 0.05e0) AS BIGINT) AS k,
round(oz + (floor((z - oz) / 0.05e0) + 0.5e0) * 0.05e0, 6) AS cz, true AS inside FROM points JOIN grids USING (scan_id)""")
def _(fx):
    out = tr.voxel_coords(fx.points, grids_of(fx)[0])
    return rounded(out, "cz").select("scan_id", "point_id", "i", "j", "k", "cz", "inside")


@query("occupied_at", ["points", "cameras"], f"""{_GRIDDED} SELECT c.scan_id, cam_id, v.n IS NOT NULL AS occupied FROM cameras c JOIN grids g USING (scan_id)
LEFT JOIN voxels v ON v.scan_id = c.scan_id AND v.i = CAST(floor((c.x - g.ox) / 0.05e0) AS BIGINT) AND v.j = CAST(floor((c.y - g.oy) / 0.05e0) AS BIGINT) AND v.k = CAST(floor((c.z - g.oz) / 0.05e0) AS BIGINT)""")
def _(fx):
    grids, voxels = grids_of(fx)
    return tr.occupied_at(fx.cameras.select("scan_id", "cam_id", "x", "y", "z"), voxels, grids).select("scan_id", "cam_id", "occupied")


_SIGHT = "SELECT scan_id, " + ", ".join(
    f"min_{a} - 0.08e0 AS o{a}, CAST(greatest(ceil((max_{a} + 0.08e0 - (min_{a} - 0.08e0)) / 0.08e0), 1) AS BIGINT) AS dim_{a}" for a in "xyz"
) + " FROM bounds"
SOLID_SQL = f"""bounds AS ({_BOUNDS}), sight AS ({_SIGHT}),
solid AS (SELECT scan_id, i, j, k, count(*) AS n FROM (SELECT scan_id, """ + ", ".join(
    f"CAST(least(greatest(floor(({a} - o{a}) / 0.08e0), 0), dim_{a} - 1) AS BIGINT) AS {k}" for a, k in zip("xyz", "ijk")
) + ") FROM points JOIN sight USING (scan_id)) GROUP BY 1, 2, 3, 4 HAVING count(*) >= {minimum})"
SOLID_SQL = SOLID_SQL.replace(") FROM points JOIN sight", " FROM points JOIN sight")


@query("occupancy", ["points"], "WITH " + SOLID_SQL.replace("{minimum}", "2") + " SELECT * FROM solid")
def _(fx):
    return vx.occupancy(fx.points, vx.sight_grids(vx.cloud_bounds(fx.points)), 2)


_RASTER = """box AS (SELECT scan_id, min(x) AS u0, min(y) AS v0, greatest(0.1e0, sqrt(3.0e0 * ((max(x) - min(x)) * (max(y) - min(y))) / count(*))) AS res FROM points GROUP BY scan_id),
cells AS (SELECT scan_id, CAST(floor((x - u0) / res) AS BIGINT) AS iu, CAST(floor((y - v0) / res) AS BIGINT) AS iv, count(*) AS n, min(res) AS res FROM points JOIN box USING (scan_id) GROUP BY 1, 2, 3)"""


@query("raster_counts", ["points"], f"WITH {_RASTER} SELECT scan_id, iu, iv, n, round(res, 6) AS res FROM cells")
def _(fx):
    return rounded(vx.raster_counts(fx.points.select("scan_id", F.col("x").alias("u"), F.col("y").alias("v")), ["scan_id"], 0.1), "res")


@query("footprint_area", ["points"], f"WITH {_RASTER} SELECT scan_id, count(*) AS cells, round(count(*) * min(res) * min(res), 6) AS area FROM cells GROUP BY scan_id")
def _(fx):
    return rounded(vx.footprint_area(fx.points), "area").select("scan_id", "cells", "area")


@query("georeference_points", ["points", "scans"], """
WITH g AS (SELECT *, radians(heading_deg % 360.0e0) AS h, CASE WHEN NOT (longitude BETWEEN -180e0 AND 180e0) THEN 'longitude out of range' END AS error FROM scans)
SELECT scan_id, point_id, error,
  CASE WHEN error IS NULL THEN round(x * sin(h) + y * sin(h - pi() / 2), 6) + 0.0e0 END AS east,
  CASE WHEN error IS NULL THEN round(x * cos(h) + y * cos(h - pi() / 2), 6) + 0.0e0 END AS north,
  CASE WHEN error IS NULL THEN round(z + elevation_m, 6) + 0.0e0 END AS up,
  CASE WHEN error IS NULL THEN round(longitude / 15.0e0, 6) + 0.0e0 END AS utc_offset_hours
FROM points JOIN g USING (scan_id)""")
def _(fx):
    return rounded(tr.georeference_points(fx.points, fx.scans), "east", "north", "up", "utc_offset_hours")

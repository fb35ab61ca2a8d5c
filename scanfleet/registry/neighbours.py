"""Nearest-neighbour joins and the statistics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn
from . import query
from .points import rounded

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def knn_sql(k):
    return f"""near AS (SELECT * FROM (SELECT a.scan_id, a.point_id, b.point_id AS id, {_D} AS dist, row_number() OVER (PARTITION BY a.scan_id, a.point_id ORDER BY {_D}, b.point_id) AS rank
  FROM points a JOIN points b ON a.scan_id = b.scan_id AND a.point_id <> b.point_id) WHERE rank <= {k})"""


@query("knn_join", ["points"], f"WITH {knn_sql(4)} SELECT scan_id, point_id, id, rank, round(dist, 6) AS dist FROM near")
def _(fx):
    return rounded(knn.self_knn(fx.points, 4), "dist")


@query("nearest_viewpoint", ["points", "cameras"], f"""SELECT scan_id, point_id, cam_id, round(dist, 6) AS dist FROM (SELECT a.scan_id, a.point_id, b.cam_id, {_D} AS dist,
row_number() OVER (PARTITION BY a.scan_id, a.point_id ORDER BY {_D}, b.cam_id) AS rn FROM points a JOIN cameras b ON a.scan_id = b.scan_id) WHERE rn = 1""")
def _(fx):
    return rounded(knn.nearest_viewpoint(fx.points, fx.cameras), "dist").select("scan_id", "point_id", "cam_id", "dist")


@query("transfer_colours", ["points", "mesh_vertices"], f"""SELECT scan_id, vertex_id, r, g, b, round(dist, 6) AS dist FROM (SELECT a.scan_id, a.vertex_id, b.r, b.g, b.b, {_D} AS dist,
row_number() OVER (PARTITION BY a.scan_id, a.vertex_id ORDER BY {_D}, b.point_id) AS rn FROM mesh_vertices a JOIN points b ON a.scan_id = b.scan_id) WHERE rn = 1""")
def _(fx):
    return rounded(knn.transfer_colours(fx.mesh_vertices, fx.points), "dist")

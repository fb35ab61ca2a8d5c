"""Coordinate transforms, predicates and projections of points, meshes and planes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.stats import percentiles


def _rows(m: Column) -> tuple[list[list[Column]], list[Column]]:
    rows = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    return rows, [m[4 * i + 3] for i in range(3)]


def _apply(rows, shift, p) -> list[Column]:
    return [vec.dot(row, p) + t for row, t in zip(rows, shift)]


def det3(rows) -> Column:
    return vec.dot(rows[0], vec.cross(rows[1], rows[2]))


def transform_points(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Apply each scan's 4x4 (``m``, 16 doubles row-major); normals go by the inverse transpose, renormalised."""
    joined = points.join(transforms.select("scan_id", "m"), "scan_id")
    rows, shift = _rows(F.col("m"))
    moved = _apply(rows, shift, vec.cols("x", "y", "z"))
    out = joined.withColumns({f"_{a}": c for a, c in zip("xyz", moved)})
    if "nx" in points.columns:
        n = vec.cols("nx", "ny", "nz")
        # the inverse transpose is the cofactor matrix over the determinant, whose sign alone survives renormalising
        sides = [vec.cross(rows[1], rows[2]), vec.cross(rows[2], rows[0]), vec.cross(rows[0], rows[1])]
        out = out.withColumns({f"_n{a}": vec.dot(n, c) for a, c in zip("xyz", sides)} | {"_det": F.signum(det3(rows))})
        out = out.withColumn("_l", vec.norm(vec.cols("_nx", "_ny", "_nz"))).withColumns({f"n{a}": F.try_divide(F.col(f"_n{a}") * F.col("_det"), F.col("_l")) for a in "xyz"})
        out = out.fillna(0.0, ["nx", "ny", "nz"]).drop("_nx", "_ny", "_nz", "_det", "_l")
    return out.withColumns({a: F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z", "m")


def transform_mesh(vertices: DataFrame, faces: DataFrame, transforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move vertices; a mirroring transform reverses the winding so faces keep pointing the same way."""
    rows, _ = _rows(F.col("m"))
    flips = transforms.select("scan_id", (det3(rows) < 0).alias("_flip"))
    turned = (
        faces.join(flips, "scan_id")
        .withColumns({
            "v0": F.when(F.col("_flip"), F.col("v2")).otherwise(F.col("v0")),
            "v2": F.when(F.col("_flip"), F.col("v0")).otherwise(F.col("v2")),
        })
        .drop("_flip")
    )
    return transform_points(vertices, transforms), turned


def transform_planes(planes: DataFrame, transforms: DataFrame) -> DataFrame:
    """Carry planes through a similarity: rotate the normal, move and scale the offset, scale the area."""
    joined = planes.join(transforms.select("scan_id", "m"), "scan_id")
    rows, shift = _rows(F.col("m"))
    n = vec.cols("nx", "ny", "nz")
    # in steps, so no expression repeats inside the next one's
    out = joined.withColumns({"_s": F.cbrt(F.abs(det3(rows)))} | {f"_r{a}": vec.dot(r, n) for a, r in zip("xyz", rows)})
    out = out.withColumn("_l", vec.norm(vec.cols("_rx", "_ry", "_rz")))
    out = out.withColumns({f"n{a}": F.col(f"_r{a}") / F.col("_l") for a in "xyz"})
    new = {"plane_offset": F.col("_s") * F.col("plane_offset") + vec.dot(vec.cols("nx", "ny", "nz"), shift)}
    if "area" in planes.columns:
        new["area"] = F.col("area") * F.col("_s") * F.col("_s")
    return out.withColumns(new).select(*planes.columns)


_PLANE = ["scan_id", "plane_id", "nx", "ny", "nz", "plane_offset"]


def with_planes(points: DataFrame, planes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Points paired with the planes of their scan, plane columns prefixed ``p_``.

    The plane side is a few rows per scan; AQE broadcasts it when its size allows and splits skewed scans when not.
    """
    keep = ["plane_id", "nx", "ny", "nz", "plane_offset"] + (extra or [])
    side = planes.select("scan_id", *[F.col(c).alias("plane_id" if c == "plane_id" else f"p_{c}") for c in keep])
    return points.join(side, "scan_id")


def signed_distance() -> Column:
    return vec.dot(vec.cols("x", "y", "z"), vec.cols("p_nx", "p_ny", "p_nz")) - F.col("p_plane_offset")


def plane_signed_distance(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Signed distance of every point to every plane of its scan."""
    return with_planes(points, planes).select("scan_id", "point_id", "plane_id", signed_distance().alias("dist"))


def plane_inliers(points: DataFrame, planes: DataFrame, distance: float = 0.03, normal_deg: float | None = None) -> DataFrame:
    """Points within ``distance`` of a plane and, if asked, whose own normal agrees with it up to sign."""
    rows = with_planes(points, planes).where(F.abs(signed_distance()) <= distance)
    if normal_deg is not None:
        agree = F.abs(vec.dot(vec.cols("nx", "ny", "nz"), vec.cols("p_nx", "p_ny", "p_nz")))
        rows = rows.where(agree >= math.cos(math.radians(normal_deg)))
    return rows.select(*points.columns, "plane_id")


def plane_frame(n) -> tuple[list[Column], list[Column]]:
    """Horizontal in-plane axis u of a unit normal, as (direction, length): across +Z for walls, across +Y for flat planes."""
    flat = F.abs(n[2]) > 0.99
    zero = F.lit(0.0)
    u = [F.when(flat, n[2]).otherwise(-n[1]), F.when(flat, zero).otherwise(n[0]), F.when(flat, -n[0]).otherwise(zero)]
    return u, F.when(flat, F.hypot(n[2], n[0])).otherwise(F.hypot(n[0], n[1]))


def wall_frame(n) -> tuple[list[Column], list[Column]]:
    """The same for walls only: a plane without horizontal direction gets u = +X."""
    length = F.hypot(n[0], n[1])
    flat = length < 1e-9
    u = [F.when(flat, F.lit(1.0)).otherwise(-n[1]), F.when(flat, F.lit(0.0)).otherwise(n[0]), F.lit(0.0)]
    return u, F.when(flat, F.lit(1.0)).otherwise(length)


def add_plane_frame(planes: DataFrame, frame=plane_frame) -> DataFrame:
    """Planes with in-plane axes ux..uz and vx..vz: u horizontal, v = n x u, as close to +Z (+Y if flat) as the plane allows.

    Built in steps, so no step's expression repeats inside the next one's.
    """
    out = planes.withColumn("_l", vec.norm(vec.cols("nx", "ny", "nz")))
    out = out.withColumns({f"_n{a}": F.col(f"n{a}") / F.col("_l") for a in "xyz"})
    n = vec.cols("_nx", "_ny", "_nz")
    u, length = frame(n)
    out = out.withColumn("_h", length).withColumns({f"u{a}": c / F.col("_h") for a, c in zip("xyz", u)})
    v = vec.cross(n, vec.cols("ux", "uy", "uz"))
    return out.withColumns(dict(zip(("vx", "vy", "vz"), v))).drop("_l", "_h", "_nx", "_ny", "_nz")


def plane_uv(points: DataFrame, planes: DataFrame, frame=plane_frame) -> DataFrame:
    """Points in each plane's own frame: (u, v) in the plane and s along its normal."""
    framed = add_plane_frame(planes, frame)
    rows = with_planes(points, framed, ["ux", "uy", "uz", "vx", "vy", "vz"])
    p = vec.cols("x", "y", "z")
    return rows.select(
        "scan_id", "point_id", "plane_id",
        vec.dot(p, vec.cols("p_ux", "p_uy", "p_uz")).alias("u"),
        vec.dot(p, vec.cols("p_vx", "p_vy", "p_vz")).alias("v"),
        signed_distance().alias("s"),
    )


def orient_planes(planes: DataFrame, points: DataFrame) -> DataFrame:
    """Flip planes so that at least as many points lie on the positive side as on the negative."""
    d = signed_distance()
    sides = with_planes(points, planes).groupBy("scan_id", "plane_id").agg(
        F.sum(F.when(d > 0, 1).otherwise(0)).alias("_pos"), F.sum(F.when(d < 0, 1).otherwise(0)).alias("_neg")
    )
    sign = F.when(F.col("_pos") < F.col("_neg"), F.lit(-1.0)).otherwise(F.lit(1.0))
    out = planes.join(sides, ["scan_id", "plane_id"], "left")
    return out.withColumns({c: F.col(c) * sign for c in ("nx", "ny", "nz", "plane_offset")}).select(*planes.columns)


def subset_points(points: DataFrame, index: DataFrame) -> DataFrame:
    """Keep the points named by an index table, with all attributes."""
    return points.join(index.select("scan_id", "point_id"), ["scan_id", "point_id"], "left_semi")


def slab_filter(points: DataFrame, lattice: DataFrame, lo: Column, hi: Column, closed: bool = False) -> DataFrame:
    """Distinct XY cells of the points with lo <= z < hi (<= when ``closed``).

    ``lattice`` carries per scan ``x0, y0, cell`` and whatever ``lo``/``hi`` refer to.
    """
    rows = points.join(lattice, "scan_id")
    top = F.col("z") <= hi if closed else F.col("z") < hi
    return (
        rows.where((F.col("z") >= lo) & top)
        .select("scan_id", vec.cell(F.col("x"), F.col("x0"), F.col("cell")).alias("i"), vec.cell(F.col("y"), F.col("y0"), F.col("cell")).alias("j"))
        .distinct()
    )


def georeference_points(points: DataFrame, georef: DataFrame) -> DataFrame:
    """Twin coordinates to East-North-Up by compass heading, with the solar hour offset; bad rows carry an error."""
    g = georef.select(
        "scan_id", "latitude", "longitude",
        F.radians(F.pmod(F.col("heading_deg"), F.lit(360.0))).alias("_h"), "elevation_m",
    )
    bad = F.when(~F.col("latitude").between(-90.0, 90.0), F.lit("latitude out of range")).when(
        ~F.col("longitude").between(-180.0, 180.0), F.lit("longitude out of range")
    )
    h, side = F.col("_h"), F.col("_h") - math.pi / 2
    return points.join(g, "scan_id").select(
        "scan_id", "point_id",
        F.when(bad.isNull(), F.col("x") * F.sin(h) + F.col("y") * F.sin(side)).alias("east"),
        F.when(bad.isNull(), F.col("x") * F.cos(h) + F.col("y") * F.cos(side)).alias("north"),
        F.when(bad.isNull(), F.col("z") + F.col("elevation_m")).alias("up"),
        F.when(bad.isNull(), F.col("longitude") / 15.0).alias("utc_offset_hours"),
        bad.alias("error"),
    )


def camera_centres(poses: DataFrame) -> DataFrame:
    """World position of each camera, minus R transposed times t (``r`` 9 doubles row-major, ``t`` 3 doubles)."""
    r, t = F.col("r"), F.col("t")
    centre = [-(r[k] * t[0] + r[3 + k] * t[1] + r[6 + k] * t[2]) for k in range(3)]
    return poses.withColumns({"cx": centre[0], "cy": centre[1], "cz": centre[2]})


def unproject_depth(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """Depth pixels to world points; drops non-finite, non-positive and (if the column exists) padded pixels.

    ``cameras`` holds per (scan, frame): fx, fy, px, py, r (9) and t (3), world-to-camera.
    """
    rows = pixels.join(cameras, ["scan_id", "frame_id"])
    d = F.col("recon_depth")
    ok = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))
    if "valid" in pixels.columns:
        ok = ok & F.col("valid")
    r, t = F.col("r"), F.col("t")
    ray = [(F.col("col") - F.col("px")) / F.col("fx") * d - t[0], (F.col("row_no") - F.col("py")) / F.col("fy") * d - t[1], d - t[2]]
    world = [r[k] * ray[0] + r[3 + k] * ray[1] + r[6 + k] * ray[2] for k in range(3)]
    return rows.where(ok).select(*pixels.columns, world[0].alias("x"), world[1].alias("y"), world[2].alias("z"))


def depth_edge_filter(pixels: DataFrame, max_step: float = K.MAX_DEPTH_STEP_RATIO) -> DataFrame:
    """Keep pixels whose depth steps to all four neighbours stay below a share of the depth; borders go.

    Neighbours are fetched by an equi-join on shifted pixel addresses, so one huge frame still spans tasks.
    """
    key = ["scan_id", "frame_id"]
    shifts = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = pixels.select(*key, "col", "row_no", F.col("recon_depth").alias("_near"), F.inline(shifts)).select(
        *key, (F.col("col") + F.col("di")).alias("col"), (F.col("row_no") + F.col("dj")).alias("row_no"), "_near"
    )
    own = pixels.select(*key, "col", "row_no", F.col("recon_depth").alias("_own"))
    keep = (
        near.join(own, key + ["col", "row_no"])
        .groupBy(*key, "col", "row_no")
        .agg(F.count("_near").alias("_n"), F.max(F.abs(F.col("_near") - F.col("_own"))).alias("_step"), F.max("_own").alias("_d"))
        .where((F.col("_n") == 4) & (F.col("_step") / F.greatest(F.abs(F.col("_d")), F.lit(1e-9)) <= max_step))
        .select(*key, "col", "row_no")
    )
    return pixels.join(keep, key + ["col", "row_no"], "left_semi")


def confidence_filter(pixels: DataFrame, quantile: float = K.DEPTH_CONF_QUANTILE, minimum: int = 1000) -> DataFrame:
    """Keep the confident pixels of each scan unless fewer than ``minimum`` would survive."""
    cut = percentiles(pixels, ["scan_id"], F.col("conf"), {"_cut": quantile})
    marked = pixels.join(cut, "scan_id")
    enough = marked.groupBy("scan_id").agg((F.sum(F.when(F.col("conf") >= F.col("_cut"), 1).otherwise(0)) >= minimum).alias("_use"))
    return marked.join(enough, "scan_id").where(~F.col("_use") | (F.col("conf") >= F.col("_cut"))).select(*pixels.columns)


def mute_inferred_colours(vertices: DataFrame) -> DataFrame:
    """Blend completed surface toward mid grey so it never passes for measured surface."""
    w = 0.75 * vec.clip(F.col("filled"), 0.0, 1.0)
    return vertices.withColumns({
        c: vec.clip(F.floor(F.col(c) * (1.0 - w) + 128.0 * w), 0, 255).cast("int") for c in ("r", "g", "b")
    })


def voxel_coords(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Voxel index, voxel centre and in-range flag per point; indices are not clipped."""
    rows = points.join(grids, "scan_id")
    idx = [vec.cell(F.col(a), F.col(f"o{a}"), F.col(f"voxel_{s}")) for a, s in zip("xyz", ("xy", "xy", "z"))]
    rows = rows.withColumns(dict(zip("ijk", idx)))
    inside = (
        F.col("i").between(0, F.col("dim_x") - 1) & F.col("j").between(0, F.col("dim_y") - 1) & F.col("k").between(0, F.col("dim_z") - 1)
    )
    centre = {
        f"c{a}": F.col(f"o{a}") + (F.col(k) + 0.5) * F.col(f"voxel_{s}") for a, k, s in zip("xyz", "ijk", ("xy", "xy", "z"))
    }
    return rows.withColumns({**centre, "inside": inside}).select(*points.columns, "i", "j", "k", "cx", "cy", "cz", "inside")


def occupied_at(queries: DataFrame, voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Whether each query position lies in an occupied voxel; outside the grid counts as free."""
    hit = voxels.select("scan_id", "i", "j", "k", F.lit(True).alias("_hit"))
    rows = voxel_coords(queries, grids).join(hit, ["scan_id", "i", "j", "k"], "left")
    return rows.select(*queries.columns, (F.col("inside") & F.coalesce(F.col("_hit"), F.lit(False))).alias("occupied"))

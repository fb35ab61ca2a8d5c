"""Bounds, sparse voxel grids and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec


def cloud_bounds(points: DataFrame, scans: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """Bounds and extent per scan; with ``scans`` an empty scan gets zeros, with ``vertices`` the mesh is included."""
    xyz = points.select("scan_id", "x", "y", "z")
    if vertices is not None:
        xyz = xyz.unionByName(vertices.select("scan_id", "x", "y", "z"))
    names = [f"{s}_{a}" for s in ("min", "max") for a in "xyz"]
    out = xyz.groupBy("scan_id").agg(*[getattr(F, n[:3])(n[-1]).alias(n) for n in names])
    if scans is not None:
        out = scans.select("scan_id").join(out, "scan_id", "left").fillna(0.0, names)
    return out.withColumns({f"extent_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"})


def grid_frames(bounds: DataFrame, voxel_xy: float = 0.05, voxel_z: float = 0.05, pad: float = 0.1) -> DataFrame:
    """Grid origin and dimensions per scan from its (padded) bounds. Grids are sparse, so size needs no cap."""
    size = {"x": voxel_xy, "y": voxel_xy, "z": voxel_z}
    span = {a: F.greatest((F.col(f"max_{a}") + pad) - (F.col(f"min_{a}") - pad), F.lit(size[a])) for a in "xyz"}
    return bounds.select(
        "scan_id",
        *[(F.col(f"min_{a}") - pad).alias(f"o{a}") for a in "xyz"],
        *[F.greatest(F.ceil(span[a] / size[a]), F.lit(1)).alias(f"dim_{a}") for a in "xyz"],
        F.lit(voxel_xy).alias("voxel_xy"), F.lit(voxel_z).alias("voxel_z"),
    )


def voxel_grid(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Occupied voxels with their return counts; points outside the grid are dropped."""
    rows = points.select("scan_id", "x", "y", "z").join(grids, "scan_id")
    idx = {k: vec.cell(F.col(a), F.col(f"o{a}"), F.col(f"voxel_{s}")) for k, a, s in zip("ijk", "xyz", ("xy", "xy", "z"))}
    rows = rows.withColumns(idx)
    for k, a in zip("ijk", "xyz"):
        rows = rows.where(F.col(k).between(0, F.col(f"dim_{a}") - 1))
    return rows.groupBy("scan_id", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


def grid_stats(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Dimensions, far corner, voxel volume and occupied count per scan."""
    occupied = voxels.groupBy("scan_id").agg(F.count(F.lit(1)).alias("occupied"), F.sum("n").alias("returns"))
    g = grids.join(occupied, "scan_id", "left").fillna(0, ["occupied", "returns"])
    far = {f"far_{a}": F.col(f"o{a}") + F.col(f"dim_{a}") * F.col(f"voxel_{s}") for a, s in zip("xyz", ("xy", "xy", "z"))}
    return g.withColumns({**far, "voxel_volume": F.col("voxel_xy") * F.col("voxel_xy") * F.col("voxel_z")})


def _column_extreme(voxels: DataFrame, grids: DataFrame, pick, name: str) -> DataFrame:
    level = voxels.groupBy("scan_id", "i", "j").agg(pick("k").alias("k"))
    z = F.col("oz") + (F.col("k") + 0.5) * F.col("voxel_z")
    return level.join(grids.select("scan_id", "oz", "voxel_z"), "scan_id").select("scan_id", "i", "j", z.alias(name))


def height_map(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Centre height of the top occupied voxel of each non-empty column (an empty column has no row)."""
    return _column_extreme(voxels, grids, F.max, "top_z")


def floor_map(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Centre height of the lowest occupied voxel of each non-empty column."""
    return _column_extreme(voxels, grids, F.min, "bottom_z")


def column_occupancy(voxels: DataFrame, grids: DataFrame, requests: DataFrame) -> DataFrame:
    """Occupied levels of the voxel column through each requested XY, one row per level."""
    at = requests.join(grids, "scan_id").select(
        "scan_id", "request_id",
        vec.cell(F.col("x"), F.col("ox"), F.col("voxel_xy")).alias("i"), vec.cell(F.col("y"), F.col("oy"), F.col("voxel_xy")).alias("j"),
    )
    return at.join(voxels, ["scan_id", "i", "j"]).select("scan_id", "request_id", "k", "n")


def occupied_points(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Centres of the occupied voxels."""
    rows = voxels.join(grids, "scan_id")
    return rows.select(
        "scan_id", "i", "j", "k",
        *[(F.col(f"o{a}") + (F.col(k) + 0.5) * F.col(f"voxel_{s}")).alias(f"c{a}") for a, k, s in zip("xyz", "ijk", ("xy", "xy", "z"))],
    )


def sight_grids(bounds: DataFrame, cell: float = K.SIGHT_CELL_M) -> DataFrame:
    """The grid sightlines are tested on: one cell of margin around the scan."""
    dims = [F.greatest(F.ceil((F.col(f"max_{a}") + cell - (F.col(f"min_{a}") - cell)) / cell), F.lit(1)).alias(f"dim_{a}") for a in "xyz"]
    return bounds.select("scan_id", *[(F.col(f"min_{a}") - cell).alias(f"o{a}") for a in "xyz"], *dims, F.lit(cell).alias("cell"))


def occupancy(points: DataFrame, grids: DataFrame, minimum: int = K.MIN_RETURNS) -> DataFrame:
    """Voxels solid enough to block a sightline: at least ``minimum`` returns."""
    rows = points.select("scan_id", "x", "y", "z").join(grids, "scan_id")
    idx = {k: vec.clip(vec.cell(F.col(a), F.col(f"o{a}"), F.col("cell")), 0, F.col(f"dim_{a}") - 1) for k, a in zip("ijk", "xyz")}
    counts = rows.withColumns(idx).groupBy("scan_id", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= minimum)


def adaptive_resolution(requested: Column, count: Column, area: Column) -> Column:
    """A cell coarse enough to expect three points in it."""
    needed = F.sqrt(K.POINTS_PER_CELL * area / count)
    return F.when((count <= 0) | (area <= 0), requested).otherwise(F.greatest(requested, needed))


def raster_counts(uv: DataFrame, keys: list[str], res: float) -> DataFrame:
    """2-D counts of (u, v) rows per group, on a cell coarsened until three points are expected in each."""
    box = uv.groupBy(*keys).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.max("u").alias("u1"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("_n"))
    box = box.withColumn("res", adaptive_resolution(F.lit(res), F.col("_n"), (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))))
    return (
        uv.select(*keys, "u", "v").join(box.select(*keys, "u0", "v0", "res"), keys)
        .groupBy(*keys, vec.cell(F.col("u"), F.col("u0"), F.col("res")).alias("iu"), vec.cell(F.col("v"), F.col("v0"), F.col("res")).alias("iv"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("res").alias("res"))
    )


def footprint_area(points: DataFrame, keys: list[str] | None = None, res: float = K.COVERAGE_RES_M) -> DataFrame:
    """Covered floor area: distinct XY cells times the cell area."""
    keys = keys or ["scan_id"]
    cells = raster_counts(points.select(*keys, F.col("x").alias("u"), F.col("y").alias("v")), keys, res)
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.max("res").alias("res")).withColumn(
        "area", F.col("cells") * F.col("res") * F.col("res")
    )

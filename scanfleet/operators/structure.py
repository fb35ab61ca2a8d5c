"""What the planes mean: floor, ceiling, walls, footprint and room size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.stats import percentiles
from ..session import cut_lineage
from . import cells as cl
from .sampling import keep_strongest
from .transforms import orient_planes, signed_distance, with_planes
from .voxels import adaptive_resolution, footprint_area

PLANE = ["scan_id", "plane_id"]


def percentile_span(points: DataFrame, axis: str, low: float = 0.002, high: float = 0.998) -> DataFrame:
    """Span between two quantiles and, as its uncertainty, half of what they trim off."""
    q = percentiles(points, ["scan_id"], F.col(axis), {"_lo": low, "_hi": high})
    raw = points.groupBy("scan_id").agg((F.max(axis) - F.min(axis)).alias("_raw"))
    span = F.col("_hi") - F.col("_lo")
    return q.join(raw, "scan_id").select("scan_id", span.alias(f"span_{axis}"), (F.greatest(F.col("_raw") - span, F.lit(0.0)) / 2.0).alias(f"trim_{axis}"))


def facing_wall_pairs(planes: DataFrame) -> DataFrame:
    """The widest supported pair of opposed walls per axis: ``scan_id, axis, separation, weight``.

    A wall counts for an axis when it faces along it and has enough of the best wall's support (all do, if none has).
    Only the outermost wall on either side can be in the widest pair, so aggregates replace the self-join.
    """
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"n{a}").alias("n")) for a in "xy"])
    rows = planes.where(F.col("kind") == "wall").select("scan_id", "plane_offset", "inlier_count", F.inline(axes)).where(F.abs("n") >= 0.94)
    best = rows.groupBy("scan_id", "axis").agg(F.max("inlier_count").alias("_top"))
    need = F.greatest(K.MIN_WALL_SUPPORT * F.col("_top"), F.lit(200.0))
    rows = rows.join(best, ["scan_id", "axis"]).withColumn("_ok", F.col("inlier_count") >= need)
    # the best wall is supported whenever anything is, so its count tells if the support rule applies at all
    rows = rows.where(F.col("_ok") | (F.col("_top") < need))
    pos = F.col("n") > 0
    pick = F.struct("plane_offset", "inlier_count")
    low = F.struct((-F.col("plane_offset")).alias("o"), "inlier_count")
    ends = rows.groupBy("scan_id", "axis").agg(
        F.max(F.when(pos, pick)).alias("ph"), F.max(F.when(~pos, pick)).alias("nh"), F.max(F.when(pos, low)).alias("pl"), F.max(F.when(~pos, low)).alias("nl")
    )
    outer = F.abs(F.col("ph")["plane_offset"] + F.col("nh")["plane_offset"])
    inner = F.abs(F.col("pl")["o"] + F.col("nl")["o"])
    by_high = F.struct(outer.alias("separation"), F.least(F.col("ph")["inlier_count"], F.col("nh")["inlier_count"]).alias("weight"))
    by_low = F.struct(inner.alias("separation"), F.least(F.col("pl")["inlier_count"], F.col("nl")["inlier_count"]).alias("weight"))
    out = ends.withColumn("_b", F.greatest(by_high, by_low)).where(F.col("_b")["separation"] > 0.5)
    return out.select("scan_id", "axis", F.col("_b")["separation"].alias("separation"), F.col("_b")["weight"].alias("weight"))


def measure_room(points: DataFrame, planes: DataFrame, scans: DataFrame) -> DataFrame:
    """Length, method and uncertainty per axis: facing planes where they exist, the trimmed point span otherwise."""
    pairs = facing_wall_pairs(planes)
    out = scans.select("scan_id", "floor_z", "ceiling_z")
    for a in "xyz":
        out = out.join(percentile_span(points, a), "scan_id", "left")
    for a in "xy":
        out = out.join(pairs.where(F.col("axis") == a).select("scan_id", F.col("separation").alias(f"_p{a}")), "scan_id", "left")
    out = out.withColumn("_pz", F.col("ceiling_z") - F.col("floor_z"))
    cols = []
    for a in "xyz":
        known = F.col(f"_p{a}").isNotNull()
        cols += [
            F.coalesce(f"_p{a}", f"span_{a}").alias(f"{a}_m"), F.when(known, "planes").otherwise("percentile").alias(f"{a}_method"),
            F.when(known, F.lit(0.005)).otherwise(F.col(f"trim_{a}")).alias(f"{a}_uncertainty_m"),
        ]
    return out.select("scan_id", *cols)


def outside_coverage(points: DataFrame, planes: DataFrame) -> DataFrame:
    """For each (horizontal) plane: share of its cells with points beyond it, its covered area, its median height.

    Planes with fewer than ten points on them read as fully covered, arealess and of unknown height.
    """
    d = signed_distance()
    rows = with_planes(points.select("scan_id", "x", "y", "z"), planes).withColumn("_d", d).where(F.col("_d") <= K.PLANE_BAND_M)
    rows = rows.select(*PLANE, "x", "y", "z", (F.abs("_d") <= K.PLANE_BAND_M).alias("on"))
    on = rows.where("on")
    box = on.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("_n"), *[f(a).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in "xy"])
    box = box.where(F.col("_n") >= 10).withColumn("res", adaptive_resolution(F.lit(K.COVERAGE_RES_M), F.col("_n"), (F.col("hx") - F.col("lx")) * (F.col("hy") - F.col("ly"))))
    cell = {"i": vec.cell(F.col("x"), F.col("lx"), F.col("res")), "j": vec.cell(F.col("y"), F.col("ly"), F.col("res"))}
    cells = rows.join(box.select(*PLANE, "lx", "ly", "res"), PLANE).withColumns(cell).groupBy(*PLANE, "i", "j").agg(F.max("on").alias("foot"), F.max(~F.col("on")).alias("beyond"))
    share = cells.where("foot").groupBy(*PLANE).agg(F.count(F.lit(1)).alias("_c"), F.avg(F.col("beyond").cast("double")).alias("_out"))
    mid = percentiles(on, PLANE, F.col("z"), {"_z": 0.5})
    out = planes.select(*PLANE).join(box.select(*PLANE, "res"), PLANE, "left").join(share, PLANE, "left").join(mid, PLANE, "left")
    known = F.col("res").isNotNull()
    return out.select(
        *PLANE, F.coalesce("_out", F.lit(1.0)).alias("outside"), F.coalesce(F.col("_c") * F.col("res") * F.col("res"), F.lit(0.0)).alias("covered_m2"), F.when(known, F.col("_z")).alias("plane_z")
    )


def label_planes(planes: DataFrame, points: DataFrame) -> DataFrame:
    """Planes turned into the room and named floor, ceiling, wall or other."""
    z = percentiles(points, ["scan_id"], F.col("z"), {"z_low": 0.03, "z_high": 0.97})
    room = footprint_area(points).select("scan_id", F.greatest("area", F.lit(K.COVERAGE_RES_M**2)).alias("room_m2"))
    turned = cut_lineage(orient_planes(planes, points))
    flat = turned.where(F.abs("nz") >= math.cos(math.radians(K.AXIS_TOL_DEG)))
    rows = turned.join(outside_coverage(points, flat), PLANE, "left").join(z, "scan_id").join(room, "scan_id")
    reach = 0.25 * F.greatest(F.col("z_high") - F.col("z_low"), F.lit(1e-6))
    bounding = (F.col("covered_m2") / F.col("room_m2") >= K.MIN_BOUNDARY_COVERAGE) & (F.col("outside") <= K.MAX_OUTSIDE_COVERAGE)
    kind = (
        F.when(F.abs("nz") <= math.sin(math.radians(K.AXIS_TOL_DEG)), "wall")
        .when(bounding & (F.col("nz") > 0) & (F.col("plane_z") <= F.col("z_low") + reach), "floor")
        .when(bounding & (F.col("nz") < 0) & (F.col("plane_z") >= F.col("z_high") - reach), "ceiling")
        .otherwise("other")
    )
    return rows.withColumn("kind", kind).select(*planes.columns)


def modal_floor_z(points: DataFrame) -> DataFrame:
    """Floor level without a floor plane: median of the lowest 20 mm bin with a quarter of the fullest bin's points."""
    box = points.groupBy("scan_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    flat = box.where(F.col("hi") - F.col("lo") < 1e-6).select("scan_id", F.col("lo").alias("floor_z"))
    box = box.where(F.col("hi") - F.col("lo") >= 1e-6).withColumn("bins", F.greatest(F.lit(8).cast("long"), F.ceil((F.col("hi") - F.col("lo")) / 0.02)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    rows = points.select("scan_id", "z").join(box, "scan_id").withColumn("w", width)
    b = F.least(F.floor((F.col("z") - F.col("lo")) / F.col("w")), F.col("bins") - 1)
    hist = rows.groupBy("scan_id", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    top = hist.groupBy("scan_id").agg(F.max("n").alias("_top"))
    first = hist.join(top, "scan_id").where(F.col("n") >= 0.25 * F.col("_top")).groupBy("scan_id").agg(F.min("b").alias("b"))
    band = rows.join(first, "scan_id").where(
        (F.col("z") >= F.col("lo") + F.col("b") * F.col("w")) & (F.col("z") <= F.col("lo") + F.least(F.col("b") + 2, F.col("bins")) * F.col("w"))
    )
    return percentiles(band, ["scan_id"], F.col("z"), {"floor_z": 0.5}).union(flat)


def find_floor_ceiling(points: DataFrame, planes: DataFrame) -> DataFrame:
    """``scan_id, floor_z, ceiling_z``: ceiling is null unless a plane overhead covers enough of the room."""
    d = signed_distance()
    flat = planes.where(F.col("kind").isin("floor", "ceiling"))
    near = with_planes(points.select("scan_id", "x", "y", "z"), flat, ["kind"]).where(F.abs(d) <= K.PLANE_BAND_M).select(*PLANE, F.col("p_kind").alias("kind"), "x", "y", "z")
    count = near.groupBy(*PLANE, "kind").agg(F.count(F.lit(1)).alias("_n"))
    mid = percentiles(near, PLANE, F.col("z"), {"_z": 0.5})
    cover = footprint_area(near, PLANE).select(*PLANE, F.col("area").alias("_cover"))
    stats = cut_lineage(count.join(mid, PLANE).join(cover, PLANE))
    floor = stats.where(F.col("kind") == "floor").groupBy("scan_id").agg(F.max(F.struct("_n", (-F.col("plane_id")).alias("p"), "_z"))["_z"].alias("floor_z"))
    rest = points.join(floor.select("scan_id"), "scan_id", "left_anti")
    floor = cut_lineage(floor.union(modal_floor_z(rest)))
    room_pts = points.select("scan_id", "x", "y", "z").join(floor, "scan_id").where(F.col("z") >= F.col("floor_z") - 0.1)
    room = footprint_area(room_pts).select("scan_id", F.col("area").alias("_room")).where(F.col("_room") > 0)
    ceiling = stats.where(F.col("kind") == "ceiling").join(floor, "scan_id").join(room, "scan_id")
    share = F.col("_cover") / F.col("_room")
    ok = (F.col("_z") - F.col("floor_z") >= K.CEILING_MIN_HEIGHT_M) & (share >= K.CEILING_COVERAGE)
    best = ceiling.where(ok).groupBy("scan_id").agg(F.max(F.struct(share.alias("s"), (-F.col("plane_id")).alias("p"), "_z"))["_z"].alias("ceiling_z"))
    return floor.join(best, "scan_id", "left").select("scan_id", "floor_z", "ceiling_z")


def merge_duplicate_walls(planes: DataFrame) -> DataFrame:
    """Walls without the weaker copies of the same surface: strongest first (ties to the lower id), keep what no kept wall duplicates.

    A wall and the same one turned round are two ways to write one surface, so each also stands where its reverse does.
    """
    walls = planes.where(F.col("kind") == "wall")
    n, kept = ["nx", "ny", "nz"], ["kept_nx", "kept_ny", "kept_nz"]
    c = vec.dot(vec.cols(*n), vec.cols(*kept))
    same = (F.abs(c) >= math.cos(math.radians(K.DUPLICATE_WALL_ANGLE_DEG))) & (F.abs(F.when(c > 0, F.col("plane_offset")).otherwise(-F.col("plane_offset")) - F.col("kept_plane_offset")) <= K.DUPLICATE_WALL_OFFSET_M)
    # a little over the furthest that two copies can lie apart, as normals are of unit length to within rounding only
    cells = {f"_b{a}": F.floor(F.col(a) / (2.2 * math.sin(math.radians(K.DUPLICATE_WALL_ANGLE_DEG / 2)))) for a in n} | {"_bd": F.floor(F.col("plane_offset") / (1.05 * K.DUPLICATE_WALL_OFFSET_M))}
    ranked = walls.withColumn("rank", F.struct("inlier_count", (-F.col("plane_id")).alias("t")))
    features = [*n, "plane_offset"]
    ids = keep_strongest(ranked, "plane_id", features, cells, same, lambda df: df.withColumns({f: -F.col(f) for f in features}))
    return walls.join(ids, PLANE, "left_semi")


def floor_footprint(points: DataFrame, levels: DataFrame, res: float = 0.05) -> DataFrame:
    """Footprint cells (``scan_id, i, j`` on a lattice of ``res`` from the world origin): occupied columns between floor
    and ceiling, closed over 12 cm, holes filled, largest part kept."""
    rows = points.select("scan_id", "x", "y", "z").join(levels, "scan_id")
    keep = (F.col("z") >= F.col("floor_z") - 0.10) & (F.col("ceiling_z").isNull() | (F.col("z") <= F.col("ceiling_z") - 0.05))
    cells = rows.where(keep).select("scan_id", F.floor(F.col("x") / res).alias("i"), F.floor(F.col("y") / res).alias("j")).distinct()
    closed = cut_lineage(cl.close_cells(cells, ["i", "j"], max(1, round(0.12 / res))))
    filled = cut_lineage(cl.fill_holes(closed, ["i", "j"]))
    return cl.largest_component(filled, ["i", "j"])


def footprint_outline(cells: DataFrame, res: float = 0.05) -> DataFrame:
    """Boundary segments of a footprint in metres, for polygon tests, with an edge number."""
    e = cl.boundary_edges(cells, res)
    return e.withColumn("seq", F.monotonically_increasing_id())


def analyze_structure(points: DataFrame, planes: DataFrame, res: float = 0.05) -> dict[str, DataFrame]:
    """Labels, levels, footprint and openings, in that order. Keys: planes, levels, footprint, outline, openings."""
    from .openings import detect_openings

    labelled = cut_lineage(label_planes(planes, points))
    levels = cut_lineage(find_floor_ceiling(points, labelled))
    footprint = cut_lineage(floor_footprint(points, levels, res))
    openings = cut_lineage(detect_openings(points, merge_duplicate_walls(labelled), levels))
    return {"planes": labelled, "levels": levels, "footprint": footprint, "outline": footprint_outline(footprint, res), "openings": openings}

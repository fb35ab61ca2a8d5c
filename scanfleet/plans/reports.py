"""Whole-twin reports: the QA assessment and the location scout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..operators import floor as fl
from ..operators import qa
from ..operators.mesh import boundary_edge_fraction
from ..operators.normals import neighbour_stats
from ..operators.polygons import polygon_area
from ..operators.voxels import cloud_bounds
from ..session import cut_lineage


def assess(
    points: DataFrame, scans: DataFrame, planes: DataFrame, openings: DataFrame, footprint: DataFrame, capture_area: DataFrame | None = None,
    faces: DataFrame | None = None, canonical: DataFrame | None = None, stats: DataFrame | None = None, min_wall_points: int = 50, min_floor_points: int = 256,
) -> DataFrame:
    """Wide QA metrics, one row per scan. ``canonical`` brings scale_confidence and the gravity margins; null is unknown."""
    stats = cut_lineage(neighbour_stats(points)) if stats is None else stats
    n = F.count(F.lit(1))
    base = scans.select("scan_id", "floor_z", "ceiling_z", (F.col("ceiling_z") - F.col("floor_z")).alias("ceiling_height_m"))
    base = base.join(points.groupBy("scan_id").agg(n.alias("point_count"), F.max("z").alias("_zmax")), "scan_id")
    box = cloud_bounds(points).select("scan_id", *[F.col(f"extent_{a}").alias(f"extent_{a}_m") for a in "xyz"])
    area = polygon_area(footprint).select("scan_id", F.col("area").alias("floor_area_m2"))
    base = cut_lineage(base.join(box, "scan_id").join(area, "scan_id", "left").join(stats, "scan_id", "left"))
    cell = base.select("scan_id", F.coalesce(vec.clip(4.0 * F.col("median_spacing_m"), 0.05, 0.20), F.lit(0.10)).alias("cell"))
    cover = cut_lineage(qa.coverage(points, scans, footprint, openings, cell))
    level = qa.measure_floor(points, scans, stats, min_floor_points)
    declared = planes.where(F.col("kind") == "floor").groupBy("scan_id").agg(F.min(F.struct("plane_id", "nz"))["nz"].alias("_declared"))
    tilt = scans.select("scan_id").join(level.select("scan_id", "nz"), "scan_id", "left").join(declared, "scan_id", "left")
    tilt = tilt.select("scan_id", F.degrees(F.acos(vec.clip(F.coalesce("nz", "_declared"), -1.0, 1.0))).alias("gravity_residual_deg"))
    walls = cut_lineage(qa.wall_support(planes, stats))
    fits = cut_lineage(qa.wall_residual_drift(points, walls, openings, min_wall_points))
    worst = fits.groupBy("scan_id").agg(F.max("rms_m").alias("wall_planarity_rms_m"), F.max("drift_m").alias("drift_estimate_m"))
    counts = planes.where(F.col("kind") == "wall").groupBy("scan_id").agg(n.alias("wall_count")).join(walls.groupBy("scan_id").agg(n.alias("structural_wall_count")), "scan_id", "left")
    cut = openings.groupBy("scan_id").agg(n.alias("opening_count"), F.sum(F.col("width") * F.col("height")).alias("opening_area_m2"))
    # each figure is a written row per scan before they meet: one plan of all of them would not fit the driver
    out = base
    for df in (cover, tilt, qa.wall_frame_stats(fits), qa.wall_parallelism(fits), worst, counts, cut, qa.scale_prior(scans, openings, stats)):
        out = out.join(df if df is cover else cut_lineage(df), "scan_id", "left")
    out = cut_lineage(out)
    for df, names in ((faces and boundary_edge_fraction(faces).drop("edges"), ["mesh_boundary_edge_fraction"]), (faces and faces.groupBy("scan_id").agg(n.alias("mesh_face_count")), ["mesh_face_count"]), (capture_area, ["capture_bounds_area_m2"]), (canonical, ["scale_confidence", "gravity_axis_margin", "gravity_sign_margin"])):
        if df is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in names})
        else:
            out = out.join(cut_lineage(df.select("scan_id", *[F.col(c if c in df.columns else c.replace("mesh_", "")).alias(c) for c in names])), "scan_id", "left")
    out = cut_lineage(out)
    ex, ey = F.col("extent_x_m"), F.col("extent_y_m")
    out = out.fillna(0, ["wall_count", "structural_wall_count", "opening_count", "mesh_face_count"]).fillna(0.0, ["opening_area_m2"])
    return out.withColumns({
        "volume_m3": F.col("floor_area_m2") * F.coalesce("ceiling_height_m", F.col("_zmax") - F.col("floor_z")), "long_axis_ratio": F.greatest(ex, ey) / F.nullif(F.least(ex, ey), F.lit(0.0)),
        "long_axis_is_x": (ex >= ey).cast("double"), "capture_coverage_ratio": F.col("capture_bounds_area_m2") / F.nullif(F.col("floor_area_m2"), F.lit(0.0)),
        "scale_confidence": F.coalesce("scale_confidence", "scale_confidence_prior"),
    }).drop("floor_z", "ceiling_z", "_zmax", "footprint_cells")


def scout_report(
    points: DataFrame, scans: DataFrame, footprint: DataFrame, capture: DataFrame, openings: DataFrame, metrics: DataFrame, checks: DataFrame, filled: DataFrame | None = None, cell: float = K.FLOOR_CELL_M
) -> DataFrame:
    """One row per location: trust, space, camera, grip and sound as JSON, and the caveats that go with them.

    ``metrics`` needs scale_confidence; ``filled`` (scan_id, filled) tells how much of the mesh was completed.
    """
    maps = cut_lineage(fl.floor_maps(points, scans, footprint, capture, cell))
    space = fl.workable_floor(maps, cell)
    shots = fl.lens_plan(maps).groupBy("scan_id").agg(F.max("run_m").alias("run_m"), F.sort_array(F.collect_list(F.struct("min_distance_m", "shot", F.round("focal_mm", 1).alias("focal_mm"), "prime_mm"))).alias("shots"))
    grip = fl.equipment_fit(maps, cell).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("gear", "verdict", *[F.round(c, d).alias(c) for c, d in (("radius_m", 2), ("area_m2", 1), ("area_surveyed_m2", 1), ("best_clearance_m", 2))]))).alias("fits"))
    sound = fl.rt60(scans, footprint, openings, points)
    verdict = qa.qa_verdict(checks, scans)
    fails = checks.where(F.col("status") == "fail").groupBy("scan_id").agg(F.sort_array(F.collect_list("name")).alias("failing"))
    out = scans.select("scan_id", "name", "floor_z", "ceiling_z").join(verdict, "scan_id").join(fails, "scan_id", "left").join(metrics.select("scan_id", "scale_confidence"), "scan_id", "left")
    for df in (space, shots, grip, sound.withColumnRenamed("verdict", "sound_verdict")):
        out = out.join(df, "scan_id", "left")
    inferred = F.lit(None).cast("double")
    if filled is not None:
        out = out.join(filled.groupBy("scan_id").agg(F.avg((F.col("filled") > 0.5).cast("double")).alias("_inf")), "scan_id", "left")
        inferred = F.col("_inf")
    conf = F.col("scale_confidence")
    caveats = F.array_compact(F.array(
        F.when(F.col("verdict") == "fail", F.concat(F.lit("failed QA, figures are provisional: "), F.array_join("failing", ", "))),
        F.when(conf < K.SCALE_CONFIDENCE_FAIL, F.format_string("scale confidence %.2f: check one length with a tape", conf)),
        F.when(inferred > 0.02, F.format_string("%.0f%% of the surface was completed, not measured", inferred * 100)),
        F.when(F.col("ceiling_z").isNull(), F.lit("no ceiling captured: nothing overhead can be answered")),
        F.when(F.col("height_assumed"), F.lit("sound figures assume the room ends at the top of the points")),
        F.when(F.col("openings_capped"), F.lit("openings exceeded the wall cap and were limited")),
    ))
    r = lambda c, d: F.round(c, d)
    # catalogue items whose sizes are typical of their class rather than published
    unverified = F.array(*[F.lit(g[0]) for g in K.GEAR if g[2] in ("dolly", "support") and not g[-1]]).cast("array<string>")
    return out.select(
        "scan_id", "name", "verdict", r("workable_m2", 1).alias("workable_m2"), r("workable_fraction", 2).alias("workable_fraction"), r("run_m", 2).alias("longest_run_m"), "sound_verdict",
        F.to_json(F.struct("verdict", "failing", r("scale_confidence", 3).alias("scale_confidence"), r("surveyed_fraction", 3).alias("surveyed_fraction"))).alias("trust"),
        F.to_json(F.struct(r("floor_m2", 1).alias("floor_m2"), r(F.col("ceiling_z") - F.col("floor_z"), 2).alias("ceiling_m"), r("workable_m2", 1).alias("workable_m2"))).alias("space"),
        F.to_json(F.struct("shots")).alias("camera"), F.to_json(F.struct("fits", unverified.alias("unverified_dimensions"))).alias("grip"),
        F.to_json(F.struct(r("volume_m3", 1).alias("volume_m3"), *[r(f"rt60_{k}_s", 2).alias(k) for k in ("softest", "typical", "hardest")], F.col("sound_verdict").alias("verdict"))).alias("sound"),
        F.array_join(caveats, "; ").alias("caveats"), F.size(caveats).cast("long").alias("n_caveats"),
    )

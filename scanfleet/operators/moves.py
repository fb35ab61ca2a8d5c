"""Camera moves at scale: paths, sightlines and the checks every camera position has to pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import optics, vec
from ..functions.stats import GROUP_LIMIT, largest_group, row_index
from ..session import cut_lineage
from .floor import map_cell
from .rays import first_solid

PATH = ["scan_id", "path_id"]


def _beats(length: Column, spacing: float) -> Column:
    return F.greatest(F.lit(K.MIN_BEATS).cast("long"), F.ceil(length / max(spacing, 1e-3)) + 1)


def _steps(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def straight_paths(moves: DataFrame, spacing: float = K.BEAT_SPACING_M) -> DataFrame:
    """Evenly spaced positions from (x0, y0, z0) to (x1, y1, z1), at least three."""
    d = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
    rows = moves.withColumn("_n", _beats(vec.norm(d), spacing)).withColumn("beat", _steps(F.col("_n")))
    t = F.col("beat") / (F.col("_n") - 1)
    rows = rows.withColumn("t", t)
    return rows.withColumns({a: F.col(f"{a}0") + F.col("t") * (F.col(f"{a}1") - F.col(f"{a}0")) for a in "xyz"}).withColumnRenamed("_n", "beats")


def arc_paths(arcs: DataFrame, spacing: float = K.BEAT_SPACING_M) -> DataFrame:
    """Positions on an arc: centre (cx, cy), radius_m, start_deg, end_deg, height_m."""
    length = F.col("radius_m") * F.radians(F.abs(F.col("end_deg") - F.col("start_deg")))
    rows = arcs.withColumn("beats", _beats(length, spacing)).withColumn("beat", _steps(F.col("beats"))).withColumn("t", F.col("beat") / (F.col("beats") - 1))
    a = F.radians(F.col("start_deg") + F.col("t") * (F.col("end_deg") - F.col("start_deg")))
    return rows.withColumns({"x": F.col("cx") + F.col("radius_m") * F.cos(a), "y": F.col("cy") + F.col("radius_m") * F.sin(a), "z": F.col("height_m")})


def polyline_paths(waypoints: DataFrame, spacing: float = K.BEAT_SPACING_M) -> DataFrame:
    """Straight runs through ordered waypoints (path rows ``seq, x, y, z``), corners not repeated: seg, beat, x, y, z."""
    idx = row_index(waypoints.select(*PATH, "seq", "x", "y", "z"), PATH, ["seq"])
    nxt = idx.select(*PATH, (F.col("idx") - 1).alias("idx"), *[F.col(a).alias(f"{a}1") for a in "xyz"])
    seg = idx.select(*PATH, "idx", *[F.col(a).alias(f"{a}0") for a in "xyz"]).join(nxt, PATH + ["idx"])
    run = straight_paths(seg, spacing).where(F.col("beat") < F.col("beats") - 1).select(*PATH, F.col("idx").alias("seg"), "beat", "x", "y", "z")
    last = idx.where(F.col("idx") == F.col("total") - 1).select(*PATH, F.col("idx").alias("seg"), F.lit(0).cast("long").alias("beat"), "x", "y", "z")
    return run.union(last)


def arc_length(paths: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Step length and cumulative length along each ordered path. A path too long for one task is summed in blocks."""
    p = vec.cols("x", "y", "z")
    if largest_group(paths, PATH) <= limit:
        w = Window.partitionBy(*PATH).orderBy("seq")
        step = F.coalesce(vec.norm([c - F.lag(c).over(w) for c in p]), F.lit(0.0))
        return paths.withColumn("step_m", step).withColumn("length_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    idx = row_index(paths, PATH, ["seq"], limit)
    prev = idx.select(*PATH, (F.col("idx") + 1).alias("idx"), *[F.col(a).alias(f"_{a}") for a in "xyz"])
    gap = vec.norm(vec.sub(p, vec.cols("_x", "_y", "_z")))
    steps = cut_lineage(
        idx.join(prev, PATH + ["idx"], "left").withColumn("step_m", F.coalesce(gap, F.lit(0.0))).withColumn("_blk", F.floor(F.col("idx") / limit))
        .drop("_x", "_y", "_z", "total")
    )
    sums = steps.groupBy(*PATH, "_blk").agg(F.sum("step_m").alias("_s"))
    before = sums.select(*PATH, "_blk", (F.sum("_s").over(Window.partitionBy(*PATH).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_b"))
    local = F.sum("step_m").over(Window.partitionBy(*PATH, "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return steps.join(before, PATH + ["_blk"]).withColumn("length_m", F.col("_b") + local).drop("_b", "_blk", "idx")


def resample_paths(paths: DataFrame, n: int, still: bool = True) -> DataFrame:
    """Each path at ``n`` points evenly spaced along its length; a path without length repeats its first point, or has no row without ``still``.

    Every segment works out which targets fall on it, so no range join is needed.
    """
    run = arc_length(paths)
    ends = run.groupBy(*PATH).agg(F.max("length_m").alias("_L"), F.max("seq").alias("_last"), F.min(F.struct("seq", "x", "y", "z")).alias("_first"))
    idx = row_index(run.select(*PATH, "seq", "x", "y", "z", "length_m"), PATH, ["seq"])
    nxt = idx.select(*PATH, (F.col("idx") - 1).alias("idx"), F.col("seq").alias("_seq1"), F.col("length_m").alias("_s1"), *[F.col(a).alias(f"_{a}1") for a in "xyz"])
    seg = idx.join(nxt, PATH + ["idx"]).join(ends.where(F.col("_L") >= 1e-9), PATH)
    scale = (n - 1) / F.col("_L")
    lo = F.ceil(F.col("length_m") * scale - 1e-12)
    hi = F.when(F.col("_seq1") == F.col("_last"), F.lit(n - 1).cast("long")).otherwise(F.ceil(F.col("_s1") * scale - 1e-12) - 1)
    rows = seg.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_hi") >= F.col("_lo"))
    rows = rows.withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    u = (F.col("k") * F.col("_L") / (n - 1) - F.col("length_m")) / F.nullif(F.col("_s1") - F.col("length_m"), F.lit(0.0))
    rows = rows.withColumn("_u", F.coalesce(u, F.lit(0.0)))
    moving = rows.select(*PATH, "k", *[(F.col(a) + F.col("_u") * (F.col(f"_{a}1") - F.col(a))).alias(a) for a in "xyz"])
    if not still:
        return moving
    spots = ends.where(F.col("_L") < 1e-9).select(*PATH, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"), *[F.col("_first")[a].alias(a) for a in "xyz"])
    return moving.union(spots)


def line_of_sight(rays: DataFrame, solid: DataFrame, grids: DataFrame, keys: list[str], slack: float = K.SIGHT_SLACK_M) -> DataFrame:
    """Whether each segment (ax..az to bx..bz) misses every solid voxel, ignoring a little at both ends. Samples are half a voxel apart."""
    g = grids.select("scan_id", *[F.col(f"o{a}").alias(f"g{a}") for a in "xyz"], F.col("cell").alias("voxel"))
    rows = rays.select("scan_id", *keys, *[f"{p}{a}" for p in "ab" for a in "xyz"]).join(g, "scan_id")
    rows = rows.withColumn("_len", vec.norm([F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"])).where(F.col("_len") >= 1e-6)
    rows = rows.withColumn("n", F.greatest(F.lit(2).cast("long"), F.ceil(F.col("_len") / (F.col("voxel") * 0.5))))
    # which samples lie beyond the slack is told from their own distance; one more at either end is looked at for rounding
    skip = F.floor(F.lit(slack) / F.col("_len") * (F.col("n") - 1)) - 1
    rows = rows.withColumns({"lo": F.greatest(F.lit(0).cast("long"), skip), "hi": F.least(F.col("n") - 1, F.col("n") - 1 - skip)})
    apart = lambda s: (s / (F.col("n") - 1) * F.col("_len") > slack) & ((1.0 - s / (F.col("n") - 1)) * F.col("_len") > slack)
    blocked = first_solid(rows, solid, keys, apart).select("scan_id", *keys, F.lit(True).alias("_hit"))
    return rays.join(blocked, ["scan_id"] + keys, "left").withColumn("visible", F.col("_hit").isNull()).drop("_hit")


def forward(position, aim) -> list[Column]:
    """Unit view direction; a camera on its target looks along +X."""
    d = vec.sub(aim, position)
    n = vec.norm(d)
    return [F.when(n > 1e-9, c / n).otherwise(F.lit(float(e))) for c, e in zip(d, (1, 0, 0))]


def pan_tilt(fwd) -> tuple[Column, Column]:
    return F.degrees(F.atan2(fwd[1], fwd[0])), F.degrees(F.asin(vec.clip(fwd[2], -1.0, 1.0)))


def project_to_frame(position, fwd, point, width_mm: Column, height_mm: Column, focal_mm: Column) -> dict[str, Column]:
    """Frame coordinates of a point in half-widths and half-heights, and whether it is in shot."""
    rel = vec.sub(point, position)
    depth = vec.dot(rel, fwd)
    right = [fwd[1], -fwd[0], F.lit(0.0)]
    n = vec.norm(right)
    right = [F.when(n < 1e-9, F.lit(float(e))).otherwise(c / n) for c, e in zip(right, (1, 0, 0))]
    up = vec.cross(right, fwd)
    ahead = depth > 1e-6
    u = F.when(ahead, vec.dot(rel, right) / (0.5 * depth * width_mm / focal_mm)).otherwise(0.0)
    v = F.when(ahead, vec.dot(rel, up) / (0.5 * depth * height_mm / focal_mm)).otherwise(0.0)
    return {"in_frame": ahead & (F.abs(u) <= 1.0) & (F.abs(v) <= 1.0), "frame_u": u, "frame_v": v}


def gear_columns(gear: Column) -> dict[str, Column]:
    """Catalogue values of a gear key as columns; an unknown or null key gives nulls."""
    spec = {g[0]: {"gear_radius_m": 0.5 * math.hypot(g[3], g[4]), "gear_height_m": g[5], "lens_low_m": g[6], "lens_high_m": g[7]} for g in K.GEAR}
    out = {}
    for name in ("gear_radius_m", "gear_height_m", "lens_low_m", "lens_high_m"):
        c = F.lit(None).cast("double")
        for key, values in spec.items():
            if values[name] is not None:
                c = F.when(gear == key, F.lit(float(values[name]))).otherwise(c)
        out[name] = c
    return out


def score_beats(beats: DataFrame, maps: DataFrame, frames: DataFrame, solid: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Judge every camera position of every move in bulk.

    ``beats``: scan_id, keys, x, y, z (camera), sx, sy, sz and subject_height_m (subject, null for none), focal_mm,
    sensor, gear (nullable). Problems come back as codes with their numbers; a beat with none is good.
    """
    at = beats.join(frames, "scan_id").withColumns(map_cell(F.col("x"), F.col("y")))
    at = at.join(maps.select("scan_id", "i", "j", "inside", "surveyed", "headroom_m", "clearance_m", "floor_rise_m"), ["scan_id", "i", "j"])
    eye = [F.col("sx"), F.col("sy"), F.col("sz") + K.EYELINE_SHARE * F.col("subject_height_m")]
    # written once: the sightlines and the checks below would otherwise each build the maps again
    at = cut_lineage(at.withColumns(dict(zip(("bx", "by", "bz"), eye))).withColumns({"ax": F.col("x"), "ay": F.col("y"), "az": F.col("z")}))
    rays = at.where(F.col("bx").isNotNull()).select("scan_id", *keys, "ax", "ay", "az", "bx", "by", "bz")
    seen = line_of_sight(rays, solid, grids, keys).select("scan_id", *keys, "visible")
    at = at.join(seen, ["scan_id"] + keys, "left").withColumns(gear_columns(F.col("gear")))
    pos, target = vec.cols("x", "y", "z"), vec.cols("bx", "by", "bz")
    at = at.withColumn("distance_m", vec.norm(vec.sub(target, pos)))
    w, h = optics.sensor_value(F.col("sensor"), 0), optics.sensor_value(F.col("sensor"), 1)
    at = at.withColumns({"_w": w, "_h": h})
    at = at.withColumns(dict(zip(("_fx", "_fy", "_fz"), forward(pos, target))))
    at = at.withColumns(project_to_frame(pos, vec.cols("_fx", "_fy", "_fz"), target, F.col("_w"), F.col("_h"), F.col("focal_mm")))
    at = at.withColumn("framed_height_m", F.when(F.col("distance_m") > 1e-6, optics.framed(F.col("_h"), F.col("focal_mm"), F.col("distance_m"))))
    at = at.withColumn("shot", optics.classify_framing(F.col("framed_height_m")))
    subject = F.col("bx").isNotNull()
    lens = F.col("z") - F.col("floor_z")
    at = at.withColumn("gear_fits", F.coalesce(F.col("clearance_m") >= F.col("gear_radius_m"), F.lit(True)))
    problems = F.array_compact(F.array(
        F.when(~F.col("inside"), F.lit("outside the floor outline")),
        F.when(~F.col("gear_fits"), F.format_string("needs %.0f cm clear radius, has %.0f cm", F.col("gear_radius_m") * 100, F.col("clearance_m") * 100)),
        F.when((lens < F.col("lens_low_m")) | (lens > F.col("lens_high_m")), F.format_string("lens at %.2f m, range %.2f-%.2f m", lens, "lens_low_m", "lens_high_m")),
        F.when(F.col("headroom_m") < F.col("gear_height_m"), F.format_string("stands %.2f m, headroom %.2f m", "gear_height_m", "headroom_m")),
        F.when(subject & ~F.col("in_frame"), F.lit("eyeline out of frame")),
        F.when(subject & ~F.col("visible"), F.lit("sightline blocked")),
    ))
    keep = [c for c in ("t", "beat", "on_track") if c in beats.columns and c not in keys]
    return at.withColumn("problems", problems).select(
        "scan_id", *keys, *keep, "x", "y", "z", "distance_m", "framed_height_m", "shot", "in_frame", "frame_u", "frame_v", "visible", "gear_fits",
        "clearance_m", "headroom_m", "floor_rise_m", "surveyed", "problems",
    )


def track_level(scored: DataFrame) -> DataFrame:
    """Floor variation under each move (null when fewer than two beats were seen) and the beat to blame for it.

    The blamed beat is the one furthest from the median rise; the earliest wins a tie.
    """
    return _track_level(cut_lineage(scored.select("scan_id", "move_id", "beat", "floor_rise_m")))


def _track_level(scored: DataFrame) -> DataFrame:
    """As :func:`track_level`, of written rows: they are read three times."""
    key = ["scan_id", "move_id"]
    seen = scored.where(F.col("floor_rise_m").isNotNull())
    level = seen.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("floor_rise_m") - F.min("floor_rise_m")).alias("_range"), F.percentile("floor_rise_m", 0.5).alias("_mid")
    ).where(F.col("_n") >= 2)
    worst = seen.join(level, key).groupBy(*key).agg(
        F.max(F.struct(F.abs(F.col("floor_rise_m") - F.col("_mid")).alias("d"), (-F.col("beat")).alias("b")))["b"].alias("_b"), F.max("_range").alias("track_level_range_m")
    )
    blame = F.when(F.col("track_level_range_m") > K.TRACK_LEVEL_M, -F.col("_b"))
    return scored.select(*key).distinct().join(worst, key, "left").select(*key, "track_level_range_m", blame.alias("blamed_beat"))


def with_track_problem(scored: DataFrame) -> DataFrame:
    """Scored beats where the blamed beat of each move on track (``on_track``) also names the uneven floor."""
    key = ["scan_id", "move_id"]
    scored = cut_lineage(scored)
    uneven = _track_level(scored.where("on_track")).where(F.col("blamed_beat").isNotNull())
    said = F.format_string("floor under the track varies by %.0f mm and needs cribbing", F.col("track_level_range_m") * 1000)
    joined = scored.join(uneven, key, "left")
    problems = F.when(F.col("beat") == F.col("blamed_beat"), F.concat("problems", F.array(said))).otherwise(F.col("problems"))
    return joined.withColumn("problems", problems).select(*scored.columns)


def first_problem(scored: DataFrame) -> DataFrame:
    """Per move: whether it works and, if not, the first beat that fails, where and why. Moves have few beats. A move on track also fails where the
    floor under it is too uneven."""
    key = ["scan_id", "move_id"]
    if "on_track" in scored.columns:
        scored = with_track_problem(scored)
    bad = F.size("problems") > 0
    first = F.min(F.when(bad, F.struct("beat", "t", "problems", "x", "y", "z")))
    ends = {n: f(F.struct("beat", "x", "y", "z")) for n, f in (("_a", F.min), ("_b", F.max))}
    out = scored.groupBy(*key).agg(
        F.count(F.lit(1)).alias("beats"), F.min(F.struct("beat", "shot"))["shot"].alias("first_shot"), F.max(F.struct("beat", "shot"))["shot"].alias("last_shot"),
        F.min("distance_m").alias("min_distance_m"), F.max("distance_m").alias("max_distance_m"), F.max("surveyed").alias("any_surveyed"), first.alias("_first"),
        *[c.alias(n) for n, c in ends.items()],
    )
    length = vec.norm([F.col("_b")[a] - F.col("_a")[a] for a in "xyz"])
    return out.withColumn("length_m", length).select(
        *key, "beats", "length_m", F.col("_first").isNull().alias("feasible"), F.when(F.col("first_shot") == F.col("last_shot"), F.col("first_shot"))
        .otherwise(F.concat_ws(" to ", "first_shot", "last_shot")).alias("shot_range"), "min_distance_m", "max_distance_m",
        (F.col("_first")["t"] * F.col("length_m")).alias("fails_at_m"), F.concat_ws("; ", F.col("_first")["problems"]).alias("problems"), "any_surveyed",
    )

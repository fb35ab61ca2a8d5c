"""Floor maps, placements, equipment, lenses and sound."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import optics, vec
from ..functions.vec import r6
from ..operators import cells as cl
from ..operators import floor as fl
from ..operators import polygons as pg
from . import query
from .points import rounded

CELL_M = 0.5  # test scans hold about six points per square metre per level, so cells are wide

# the same pipeline in SQL; every later query selects from one of these steps
FLOOR_SQL = """frames AS (SELECT p.scan_id, x0, y0, CAST(greatest(ceil((x1 - x0) / 0.5e0), 1) AS BIGINT) AS nx, CAST(greatest(ceil((y1 - y0) / 0.5e0), 1) AS BIGINT) AS ny, floor_z, ceiling_z
  FROM (SELECT scan_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY scan_id) p JOIN scans USING (scan_id)),
ret AS (SELECT scan_id, CAST(least(greatest(floor((x - x0) / 0.5e0), 0), nx - 1) AS BIGINT) AS i, CAST(least(greatest(floor((y - y0) / 0.5e0), 0), ny - 1) AS BIGINT) AS j, z - floor_z AS h
  FROM points JOIN frames USING (scan_id)),
heights AS (SELECT f.scan_id, coalesce(any_value(ceiling_z - floor_z), quantile_cont(h, 0.995)) AS room_h FROM frames f JOIN ret USING (scan_id) GROUP BY f.scan_id),
head AS (SELECT scan_id, i, j, least(any_value(room_h), min(h)) AS headroom_m FROM ret JOIN heights USING (scan_id) WHERE h > 1.8e0 GROUP BY 1, 2, 3 HAVING count(*) >= 4),
rise AS (SELECT scan_id, i, j, h AS floor_rise_m FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, i, j ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY scan_id, i, j) AS n FROM ret WHERE h < 0.3e0)
  WHERE n >= 4 AND r = floor(n * 0.2e0)),
blocked AS (SELECT scan_id, i, j FROM ret WHERE h BETWEEN 0.3e0 AND 1.8e0 GROUP BY 1, 2, 3 HAVING count(*) >= 4),
cells AS (SELECT scan_id, i, j, x0 + (i + 0.5e0) * 0.5e0 AS x, y0 + (j + 0.5e0) * 0.5e0 AS y, greatest(nx, ny) AS side
  FROM (SELECT *, unnest(range(ny)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM frames))),
clear AS (SELECT c.scan_id, c.i, c.j, coalesce(sqrt(min(CAST((c.i - b.i) * (c.i - b.i) + (c.j - b.j) * (c.j - b.j) AS DOUBLE))) * 0.5e0, max(c.side) * 0.5e0) AS clearance_m
  FROM cells c LEFT JOIN blocked b ON c.scan_id = b.scan_id GROUP BY 1, 2, 3),
ins AS (SELECT scan_id, i, j FROM cells JOIN footprint_edges USING (scan_id) WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / nullif(y1 - y0, 0) + x0 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
sur AS (SELECT scan_id, i, j FROM cells JOIN capture_edges USING (scan_id) WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / nullif(y1 - y0, 0) + x0 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
maps AS (SELECT c.scan_id, c.i, c.j, c.x, c.y, ins.i IS NOT NULL AS inside, sur.i IS NOT NULL AS surveyed, coalesce(headroom_m, room_h) AS headroom_m, clearance_m, floor_rise_m
  FROM cells c JOIN heights USING (scan_id) JOIN clear USING (scan_id, i, j) LEFT JOIN head USING (scan_id, i, j) LEFT JOIN rise USING (scan_id, i, j)
  LEFT JOIN ins ON ins.scan_id = c.scan_id AND ins.i = c.i AND ins.j = c.j LEFT JOIN sur ON sur.scan_id = c.scan_id AND sur.i = c.i AND sur.j = c.j)"""
FLOOR_VIEWS = ["points", "scans", "footprint_edges", "capture_edges"]


def gear_sql(kinds=("dolly", "support")):
    rows = ", ".join(f"('{g[0]}', {0.5 * math.hypot(g[3], g[4])!r}e0, {g[5]!r}e0)" for k in kinds for g in K.GEAR if g[2] == k)
    return f"gear AS (SELECT * FROM (VALUES {rows}) AS v(gear, radius_m, gear_height_m))"


def maps_of(fx):
    return fl.floor_maps(fx.points, fx.scans, fx.footprint_edges, fx.capture_edges, CELL_M)


def returns_of(fx):
    frames = fl.floor_frames(fx.points, fx.scans, CELL_M)
    return frames, fl.floor_returns(fx.points, frames)


@query("headroom_map", FLOOR_VIEWS, f"WITH {FLOOR_SQL} SELECT scan_id, i, j, round(headroom_m, 6) AS headroom_m FROM maps")
def _(fx):
    return rounded(maps_of(fx), "headroom_m").select("scan_id", "i", "j", "headroom_m")


@query("floor_rise_map", FLOOR_VIEWS, f"WITH {FLOOR_SQL} SELECT scan_id, i, j, round(floor_rise_m, 6) AS floor_rise_m FROM rise")
def _(fx):
    return rounded(fl.floor_rise_map(returns_of(fx)[1]), "floor_rise_m")


@query("clearance_map", FLOOR_VIEWS, f"WITH {FLOOR_SQL} SELECT scan_id, i, j, round(clearance_m, 6) AS clearance_m FROM clear")
def _(fx):
    frames, ret = returns_of(fx)
    return rounded(fl.clearance_map(frames, fl.blocked_cells(ret)), "clearance_m")


@query("floor_maps", FLOOR_VIEWS, f"""WITH {FLOOR_SQL} SELECT scan_id, i, j, round(x, 6) AS x, round(y, 6) AS y, inside, surveyed, round(headroom_m, 6) AS headroom_m,
round(clearance_m, 6) AS clearance_m, round(floor_rise_m, 6) AS floor_rise_m FROM maps""")
def _(fx):
    return rounded(maps_of(fx), "x", "y", "headroom_m", "clearance_m", "floor_rise_m")


@query("workable_floor", FLOOR_VIEWS, f"""WITH {FLOOR_SQL}, s AS (SELECT *, inside AND headroom_m >= 1.9e0 AND clearance_m >= 0.28e0 AS ok FROM maps)
SELECT scan_id, round(sum(ok::INT) * (0.5e0 * 0.5e0), 6) AS workable_m2, round(sum(ok::INT) / greatest(sum(inside::INT), 1), 6) AS workable_fraction, CAST(sum(inside::INT) AS BIGINT) AS inside_cells,
round(coalesce(avg(CASE WHEN inside THEN CAST(surveyed::INT AS DOUBLE) END), 0e0), 6) AS surveyed_fraction FROM s GROUP BY scan_id""")
def _(fx):
    return rounded(fl.workable_floor(maps_of(fx), CELL_M), "workable_m2", "workable_fraction", "surveyed_fraction")


_FIT = f"{gear_sql()}, fit AS (SELECT *, inside AND clearance_m >= radius_m AND headroom_m >= least(gear_height_m, 1.9e0) AS fits FROM maps CROSS JOIN gear)"


@query("gear_fit_join", FLOOR_VIEWS, f"WITH {FLOOR_SQL}, {_FIT} SELECT scan_id, i, j, gear, fits FROM fit")
def _(fx):
    return fl.gear_fit_join(maps_of(fx)).select("scan_id", "i", "j", "gear", "fits")


@query("equipment_fit", FLOOR_VIEWS, f"""WITH {FLOOR_SQL}, {_FIT}
SELECT scan_id, gear, round(max(radius_m), 6) AS radius_m, round(sum(fits::INT) * (0.5e0 * 0.5e0), 6) AS area_m2, round(sum((fits AND surveyed)::INT) * (0.5e0 * 0.5e0), 6) AS area_surveyed_m2,
round(coalesce(max(CASE WHEN fits THEN clearance_m END), 0e0), 6) AS best_clearance_m,
CASE WHEN bool_or(fits AND surveyed) THEN 'fits' WHEN bool_or(fits) THEN 'marginal' ELSE 'does not fit' END AS verdict FROM fit GROUP BY 1, 2""")
def _(fx):
    return rounded(fl.equipment_fit(maps_of(fx), CELL_M), "radius_m", "area_m2", "area_surveyed_m2", "best_clearance_m")


@query("placements", FLOOR_VIEWS, f"""WITH {FLOOR_SQL}, {gear_sql()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id, gear ORDER BY round(clearance_m, 6) DESC, i, j) AS rank
  FROM maps CROSS JOIN gear WHERE inside AND clearance_m >= radius_m AND headroom_m >= 1.9e0)
SELECT scan_id, gear, rank, i, j, round(clearance_m, 6) AS clearance_m, round(headroom_m, 6) AS headroom_m, surveyed,
CASE WHEN NOT surveyed THEN 'not surveyed: rests on reconstructed geometry' END AS note FROM ranked WHERE rank <= 5""")
def _(fx):
    out = fl.placements(rounded(maps_of(fx), "clearance_m"), limit=5)
    return rounded(out, "headroom_m").drop("x", "y")


@query("fits_at", FLOOR_VIEWS + ["cameras"], f"""WITH {FLOOR_SQL}, {gear_sql()}, spot AS (SELECT c.scan_id, cam_id, CAST(least(greatest(floor((c.x - x0) / 0.5e0), 0), nx - 1) AS BIGINT) AS i,
  CAST(least(greatest(floor((c.y - y0) / 0.5e0), 0), ny - 1) AS BIGINT) AS j FROM cameras c JOIN frames USING (scan_id))
SELECT scan_id, cam_id, gear, clearance_m >= radius_m AS fits FROM spot JOIN clear USING (scan_id, i, j) CROSS JOIN gear""")
def _(fx):
    frames = fl.floor_frames(fx.points, fx.scans, CELL_M)
    return fl.fits_at(fx.cameras, maps_of(fx), frames).select("scan_id", "cam_id", "gear", "fits")


_SHOTS = ", ".join(f"('{n}', {h!r}e0)" for k, n, h in K.SHOTS if k not in ("ecu", "els"))
_PRIMES = ", ".join(f"({i}, {p!r}e0)" for i, p in enumerate(K.PRIMES_MM))


@query("lens_plan", FLOOR_VIEWS, f"""WITH {FLOOR_SQL}, shots AS (SELECT * FROM (VALUES {_SHOTS}) AS v(shot, framed_m)), primes AS (SELECT * FROM (VALUES {_PRIMES}) AS v(o, p)),
runs AS (SELECT scan_id, sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y))) AS run_m FROM maps WHERE inside AND headroom_m >= 1.9e0 AND clearance_m >= 0.28e0 GROUP BY scan_id HAVING count(*) >= 2),
f AS (SELECT *, 14.0e0 * run_m / framed_m AS focal_mm FROM runs CROSS JOIN shots),
n AS (SELECT f.*, (SELECT p FROM primes ORDER BY abs(ln(greatest(focal_mm, 1e-6) / p)), o LIMIT 1) AS prime FROM f)
SELECT scan_id, shot, round(run_m, 6) AS run_m, round(focal_mm, 6) AS focal_mm, CASE WHEN abs(focal_mm - prime) <= 0.15e0 * focal_mm THEN prime END AS prime_mm,
NOT (abs(focal_mm - prime) <= 0.15e0 * focal_mm) AS beyond_primes, round(framed_m * 18.0e0 / 14.0e0, 6) AS min_distance_m FROM n""")
def _(fx):
    return rounded(fl.lens_plan(maps_of(fx)), "run_m", "focal_mm", "min_distance_m")


@query("gear_catalogue", [], f"""SELECT gear, kind, verified, round(width_m * length_m, 6) AS area_m2, round(width_m + 2 * working_m, 6) AS swept_width_m, round(length_m + 2 * working_m, 6) AS swept_length_m, n_parts
FROM (VALUES {", ".join(f"('{g[0]}', '{g[2]}', {g[3]!r}e0, {g[4]!r}e0, {g[8]!r}e0, {str(g[9]).lower()})" for g in K.GEAR)}) AS v(gear, kind, width_m, length_m, working_m, verified)
JOIN (SELECT CASE p_size % 4 WHEN 0 THEN 'dolly' WHEN 1 THEN 'track' WHEN 2 THEN 'support' ELSE 'lighting' END AS kind, count(*) AS n_parts FROM part GROUP BY 1) USING (kind)""")
def _(fx):
    """The catalogue against an inventory table of the same kinds."""
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "dolly").when(k == 1, "track").when(k == 2, "support").otherwise("lighting")
    stock = fx.table("part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_parts"))
    out = stock.join(F.broadcast(fl.gear_catalogue(fx.spark)), "kind")
    return rounded(out, "area_m2", "swept_width_m", "swept_length_m").select("gear", "kind", "verified", "area_m2", "swept_width_m", "swept_length_m", "n_parts")


@query("point_in_polygon", ["points", "footprint_edges"], """SELECT scan_id, point_id FROM points JOIN footprint_edges USING (scan_id)
WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / nullif(y1 - y0, 0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def _(fx):
    return pg.point_in_polygon(fx.points, fx.footprint_edges, ["point_id"])


@query("point_in_capture", ["cameras", "capture_edges"], """SELECT c.scan_id, c.cam_id, h.cam_id IS NOT NULL AS in_capture FROM cameras c LEFT JOIN (SELECT scan_id, cam_id FROM cameras JOIN capture_edges USING (scan_id)
WHERE (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / nullif(y1 - y0, 0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1) h ON h.scan_id = c.scan_id AND h.cam_id = c.cam_id""")
def _(fx):
    hit = pg.point_in_polygon(fx.cameras, fx.capture_edges, ["cam_id"]).withColumn("_h", F.lit(True))
    return fx.cameras.select("scan_id", "cam_id").join(hit, ["scan_id", "cam_id"], "left").select("scan_id", "cam_id", F.coalesce("_h", F.lit(False)).alias("in_capture"))


@query("polygon_area", ["capture_edges"], """SELECT scan_id, round(sum(x0 * y1 - x1 * y0) / 2, 6) AS signed_area, round(abs(sum(x0 * y1 - x1 * y0) / 2), 6) AS area,
round(sum(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0))), 6) AS perimeter FROM capture_edges GROUP BY scan_id""")
def _(fx):
    ring = fx.capture_edges.select("scan_id", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return rounded(pg.polygon_area(pg.edges_of_ring(ring)), "signed_area", "area", "perimeter")


_FIN = ", ".join(f"round(0.161e0 * volume / (area * {f!r}e0 + solid * {w!r}e0 + area * {c!r}e0 + opn), 6) AS rt60_{n}_s" for n, f, w, c in K.FINISHES)


@query("rt60", ["scans", "footprint_edges", "openings", "points"], f"""WITH a AS (SELECT scan_id, abs(sum(x0 * y1 - x1 * y0) / 2) AS area, sum(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0))) AS per FROM footprint_edges GROUP BY 1),
t AS (SELECT scan_id, quantile_cont(z, 0.995) AS top FROM points GROUP BY 1), o AS (SELECT scan_id, sum(width * height) AS o FROM openings GROUP BY 1),
r AS (SELECT scan_id, area, per, coalesce(o, 0e0) AS o, ceiling_z IS NULL AS assumed, coalesce(ceiling_z - floor_z, greatest(top - floor_z, 0.1e0)) AS h FROM scans JOIN a USING (scan_id) LEFT JOIN t USING (scan_id) LEFT JOIN o USING (scan_id)),
v AS (SELECT *, per * h AS wall, least(o, 0.6e0 * per * h) AS opn, o > 0.6e0 * (per * h) AS capped, area * h AS volume FROM r),
s AS (SELECT *, greatest(wall - opn, 0e0) AS solid FROM v),
f AS (SELECT scan_id, round(volume, 6) AS volume_m3, round(area, 6) AS floor_m2, round(wall, 6) AS wall_m2, round(opn, 6) AS opening_m2, {_FIN}, assumed AS height_assumed, capped AS openings_capped FROM s)
SELECT *, CASE WHEN rt60_hardest_s <= 0.45e0 THEN 'clean' WHEN rt60_softest_s >= 1.0e0 THEN 'problem' WHEN rt60_softest_s >= 0.7e0 THEN 'difficult' ELSE 'depends on the finishes' END AS verdict FROM f""")
def _(fx):
    out = fl.rt60(fx.scans, fx.footprint_edges, fx.openings, fx.points)
    return rounded(out, "volume_m3", "floor_m2", "wall_m2", "opening_m2", "rt60_softest_s", "rt60_typical_s", "rt60_hardest_s")


_SENS = ", ".join(f"('{k}', {w!r}e0, {h!r}e0, {c!r}e0)" for k, w, h, c in K.SENSORS)
_CAMS = f"""cams AS (SELECT c.scan_id, cam_id, CASE cam_id % 5 WHEN 0 THEN 'super35' WHEN 1 THEN 'super35-4perf' WHEN 2 THEN 'fullframe' WHEN 3 THEN 'm43' ELSE 'phone-main' END AS sensor,
  12.0e0 + cam_id % 90 AS focal_mm, 1.4e0 + cam_id % 8 AS aperture, 0.4e0 + z + x AS distance_m FROM cameras c), sens AS (SELECT * FROM (VALUES {_SENS}) AS v(sensor, w, h, coc)),
cs AS (SELECT * FROM cams JOIN sens USING (sensor))"""


def cams_of(fx):
    k = F.col("cam_id") % 5
    sensor = F.lit("phone-main")
    for i, key in enumerate(("super35", "super35-4perf", "fullframe", "m43")):
        sensor = F.when(k == i, F.lit(key)).otherwise(sensor)
    return fx.cameras.select(
        "scan_id", "cam_id", sensor.alias("sensor"), (12.0 + F.col("cam_id") % 90).alias("focal_mm"), (1.4 + F.col("cam_id") % 8).alias("aperture"),
        (0.4 + F.col("z") + F.col("x")).alias("distance_m"),
    ).withColumns({n: optics.sensor_value(F.col("sensor"), i) for i, n in enumerate(("w", "h", "coc"))})


@query("field_of_view", ["cameras"], f"WITH {_CAMS} SELECT scan_id, cam_id, round(2 * degrees(atan(w / (2 * focal_mm))), 6) AS h_deg, round(2 * degrees(atan(h / (2 * focal_mm))), 6) AS v_deg FROM cs")
def _(fx):
    f = F.col("focal_mm")
    return cams_of(fx).select("scan_id", "cam_id", r6(optics.field_of_view(F.col("w"), f)).alias("h_deg"), r6(optics.field_of_view(F.col("h"), f)).alias("v_deg"))


@query("framing", ["cameras"], f"""WITH {_CAMS} SELECT scan_id, cam_id, round(distance_m * h / focal_mm, 6) AS framed_height_m, round(distance_m * w / focal_mm, 6) AS framed_width_m,
round(1.2e0 * focal_mm / h, 6) AS distance_for_ms_m, round(h * distance_m / 0.6e0, 6) AS focal_for_cu_mm, round(1.75e0 / (distance_m * h / focal_mm), 6) AS subject_share FROM cs""")
def _(fx):
    f, d = F.col("focal_mm"), F.col("distance_m")
    fh = optics.framed(F.col("h"), f, d)
    return cams_of(fx).select(
        "scan_id", "cam_id", r6(fh).alias("framed_height_m"), r6(optics.framed(F.col("w"), f, d)).alias("framed_width_m"),
        r6(optics.distance_for(F.col("h"), f, F.lit(1.2))).alias("distance_for_ms_m"), r6(optics.focal_for(F.col("h"), d, F.lit(0.6))).alias("focal_for_cu_mm"),
        r6(1.75 / fh).alias("subject_share"),
    )


@query("depth_of_field", ["cameras"], f"""WITH {_CAMS}, q AS (SELECT *, focal_mm * focal_mm / (aperture * coc) + focal_mm AS hf, distance_m * 1000.0e0 AS d FROM cs)
SELECT scan_id, cam_id, round(d * (hf - focal_mm) / (hf + d - 2 * focal_mm) / 1000, 6) AS near_m, CASE WHEN d >= hf THEN CAST('infinity' AS DOUBLE) ELSE round(d * (hf - focal_mm) / (hf - d) / 1000, 6) END AS far_m,
round(hf / 1000, 6) AS hyperfocal_m FROM q""")
def _(fx):
    dof = optics.depth_of_field(F.col("focal_mm"), F.col("aperture"), F.col("coc"), F.col("distance_m"))
    out = cams_of(fx).withColumns(dof)
    far = F.when(F.col("far_m") == float("inf"), F.col("far_m")).otherwise(r6(F.col("far_m")))
    return out.select("scan_id", "cam_id", r6(F.col("near_m")).alias("near_m"), far.alias("far_m"), r6(F.col("hyperfocal_m")).alias("hyperfocal_m"))


_ALLSHOTS = ", ".join(f"({i}, '{n}', {h!r}e0)" for i, (_, n, h) in enumerate(K.SHOTS))


@query("nearest_prime", ["cameras"], f"""WITH {_CAMS}, primes AS (SELECT * FROM (VALUES {_PRIMES}) AS v(o, p)), q AS (SELECT *, h * distance_m / 0.9e0 AS focal FROM cs)
SELECT scan_id, cam_id, (SELECT p FROM primes ORDER BY abs(ln(greatest(focal, 1e-6) / p)), o LIMIT 1) AS prime_mm FROM q""")
def _(fx):
    focal = optics.focal_for(F.col("h"), F.col("distance_m"), F.lit(0.9))
    return cams_of(fx).select("scan_id", "cam_id", optics.nearest_prime(focal).alias("prime_mm"))


@query("classify_framing", ["cameras"], f"""WITH {_CAMS}, shots AS (SELECT * FROM (VALUES {_ALLSHOTS}) AS v(o, shot, s)), q AS (SELECT *, distance_m * h / focal_mm AS f FROM cs)
SELECT scan_id, cam_id, (SELECT shot FROM shots ORDER BY abs(ln(greatest(f, 1e-6) / s)), o LIMIT 1) AS shot FROM q""")
def _(fx):
    return cams_of(fx).select("scan_id", "cam_id", optics.classify_framing(optics.framed(F.col("h"), F.col("focal_mm"), F.col("distance_m"))).alias("shot"))


@query("slug", [], """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), ''), 'twin') AS slug FROM part
UNION ALL SELECT doc_id AS p_partkey, coalesce(nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), ''), 'twin') AS slug FROM documents""")
def _(fx):
    parts = fx.table("part").select("p_partkey", optics.slug(F.col("p_name")).alias("slug"))
    return parts.union(fx.table("documents").select("doc_id", optics.slug(F.col("text"))))


@query("eyeline", ["moves"], "SELECT scan_id, move_id, round(sz + 0.94e0 * subject_height_m, 6) AS eye_z FROM moves")
def _(fx):
    return fx.moves.select("scan_id", "move_id", r6(F.col("sz") + K.EYELINE_SHARE * F.col("subject_height_m")).alias("eye_z"))


@query("mask_intersect", FLOOR_VIEWS, f"WITH {FLOOR_SQL} SELECT scan_id, i, j FROM maps WHERE inside AND surveyed AND clearance_m >= 0.5e0")
def _(fx):
    m = maps_of(fx)
    return cl.mask_intersect(m.where("inside"), m.where("surveyed"), m.where("clearance_m >= 0.5"), axes=["i", "j"]).select("scan_id", "i", "j")

"""Readers, header hints, attributes and video tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.vec import r6
from ..operators import transforms as tr
from ..operators import video as vd
from ..session import shared_dir
from ..sources import readers as rd
from ..sources import tables as tb
from . import query
from .points import rounded

_FLOOR = lambda e: f"CAST(floor({e}) AS INT)"


@query("read_point_text", ["points"], f"""SELECT scan_id, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN scan_id % 3 = 1 THEN r WHEN scan_id % 3 = 2 THEN CAST(floor(round(r / 255.0e0, 4) * 255) AS INT) END AS r FROM points""")
def _(fx):
    """Points written out as text lines of three layouts (xyz, xyz i rgb, xyz with 0..1 rgb) and parsed back."""
    num = lambda c: F.format_string("%.9f", F.col(c).cast("double"))
    plain = F.concat_ws(" ", num("x"), num("y"), num("z"))
    pts = F.concat_ws(" ", plain, F.lit("0.5"), "r", "g", "b")
    unit = F.concat_ws(",", num("x"), num("y"), num("z"), *[F.format_string("%.4f", F.round(F.col(c) / 255.0, 4)) for c in "rgb"])
    kind = F.col("scan_id") % 3
    lines = fx.points.select(F.col("scan_id").alias("source"), F.col("point_id").alias("line_no"), F.when(kind == 0, plain).when(kind == 1, pts).otherwise(unit).alias("value"))
    head = fx.scans.select(F.col("scan_id").alias("source"), F.lit(-1).cast("long").alias("line_no"), F.explode(F.array(F.lit("# header"), F.lit(" // note"), F.lit("12345"), F.lit(""))).alias("value"))
    points, _report = rd.parse_point_lines(lines.union(head))
    return rounded(points, "x", "y", "z").select(F.col("source").alias("scan_id"), F.col("line_no").alias("point_id"), "x", "y", "z", "r")


_SOFT = "CASE " + " ".join(f"WHEN regexp_matches(value, '(?i){p}') THEN {i}" for i, (_, p) in enumerate(K.SOFTWARE_PATTERNS)) + " END"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_APART = "NOT regexp_matches(g[i], '[0-9_]$') AND NOT regexp_matches(g[i + 1], '^[0-9_]')"
_VALUE = f"""(regexp_matches(g[i], '[:=][^\\n]{{0,{K.UNIT_REACH}}}$') OR (i > 1 AND list_contains({_LIST(K.UNIT_LEADS)}, w[i - 1]) AND length(g[i]) <= {K.UNIT_REACH} AND NOT contains(g[i], chr(10))
 AND NOT regexp_matches(g[i - 1], '[0-9_]$') AND NOT regexp_matches(g[i], '^[0-9_]'))) AND NOT regexp_matches(g[i + 1], '^[0-9_]') AND (i = len(w) OR regexp_matches(g[i + 1], '\\S'))"""
_UNIT = "CASE " + " ".join(
    [f"WHEN len([1 FOR i IN range(1, len(w) + 1) IF list_contains({_LIST(names)}, w[i]) AND {_APART}]) > 0 THEN '{u}'" for u, names in K.UNIT_NAMES.items()]
    + [f"WHEN len([1 FOR i IN range(1, len(w) + 1) IF w[i] = '{u}' AND {_VALUE}]) > 0 THEN '{u}'" for u in K.UNIT_SHORT]
) + " END"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in K.SOFTWARE_PATTERNS) + "]"


@query("scan_header_hints", [], f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, '.')) AS value, unnest(range(len(string_split(text, '.')))) AS line_no FROM documents UNION ALL
 SELECT page_id, html, 0 FROM pages UNION ALL SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'exported by Poly Cam 3, units: cm' WHEN 1 THEN 'scale in feet' WHEN 2 THEN 'comment measured in a single pass' WHEN 3 THEN 'VCGLIB generated; 1 unit = 1 mm' WHEN 4 THEN 'dimensions in centimetres' ELSE p_name END, p_size FROM part),
h AS (SELECT doc_id, line_no, {_SOFT} AS s, CASE WHEN regexp_matches(value, '(?i){K.UNIT_CONTEXT}') THEN {_UNIT} END AS u FROM (SELECT *, [lower(x) FOR x IN regexp_extract_all(value, '[A-Za-z]+')] AS w, regexp_split_to_array(value, '[A-Za-z]+') AS g FROM lines))
SELECT doc_id, {_NAMES}[min(s) + 1] AS software, arg_min(u, line_no) FILTER (WHERE u IS NOT NULL) AS unit_hint FROM h WHERE s IS NOT NULL OR u IS NOT NULL GROUP BY 1""")
def _(fx):
    docs = fx.table("documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("line_no", "value"))
    pages = fx.table("pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("line_no"), F.col("html").alias("value"))
    k = F.col("p_partkey") % 6
    said = (
        F.when(k == 0, "exported by Poly Cam 3, units: cm").when(k == 1, "scale in feet").when(k == 2, "comment measured in a single pass")
        .when(k == 3, "VCGLIB generated; 1 unit = 1 mm").when(k == 4, "dimensions in centimetres").otherwise(F.col("p_name"))
    )
    parts = fx.table("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("line_no"), said.alias("value"))
    return rd.scan_header_hints(docs.union(pages).union(parts), ["doc_id"])


@query("normalise_point_attributes", ["splats"], f"""SELECT scan_id, point_id, {", ".join(f"CAST(floor(least(greatest(0.5e0 + {K.SPLAT_C0!r}e0 * f_dc_{i}, 0e0), 1e0) * 255) AS INT) AS {c}" for i, c in enumerate("rgb"))},
round(nx / sqrt(nx*nx+ny*ny+nz*nz), 6) + 0.0e0 AS nx, round(1 / (1 + exp(-opacity)), 6) AS alpha FROM splats""")
def _(fx):
    return rounded(rd.normalise_splats(fx.splats)[0], "nx", "alpha").select("scan_id", "point_id", "r", "g", "b", "nx", "alpha")


@query("faint_splats", ["splats"], "SELECT scan_id, round(avg(CASE WHEN 1 / (1 + exp(-opacity)) < 0.1e0 THEN 1e0 ELSE 0e0 END), 6) AS faint_fraction FROM splats GROUP BY 1")
def _(fx):
    return rounded(rd.normalise_splats(fx.splats)[1], "faint_fraction").select("scan_id", "faint_fraction")


@query("integer_colours", [], """WITH p AS (SELECT l_suppkey AS scan_id, l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS r, l_partkey % 256 AS g FROM lineitem), m AS (SELECT scan_id, greatest(max(r), max(g)) AS peak FROM p GROUP BY 1)
SELECT scan_id, l_orderkey, l_linenumber, CAST(floor(least(CASE WHEN peak > 255 THEN r / pow(2e0, length(bin(peak)) - 8) ELSE r END, 255)) AS INT) AS r, CAST(floor(CASE WHEN peak > 255 THEN g / pow(2e0, length(bin(peak)) - 8) ELSE g END) AS INT) AS g FROM p JOIN m USING (scan_id)""")
def _(fx):
    p = fx.table("lineitem").select(F.col("l_suppkey").alias("scan_id"), "l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("long").alias("r"), (F.col("l_partkey") % 256).alias("g"))
    return rd.normalise_colours(p, ("r", "g"))


@query("write_twin_tables", ["points", "openings"], """SELECT 'points' AS name, count(*) AS n, round(sum(round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3)), 1) AS total FROM points UNION ALL SELECT 'openings', count(*), round(sum(round(width, 3)), 1) FROM openings""")
def _(fx):
    import uuid

    path = f"{shared_dir(fx.spark)}/twins-{uuid.uuid4().hex}"
    tb.write_twin_tables({"points": fx.points, "openings": fx.openings}, path, buckets=8)
    back = tb.load_twin_tables(fx.spark, path, ["points", "openings"])
    parts = [back[n].agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(c, 3)), 1).alias("total")).select(F.lit(n).alias("name"), "n", "total") for n, c in (("points", "x"), ("openings", "width"))]
    return parts[0].union(parts[1])


@query("twin_summary", ["scans", "points", "mesh_faces", "footprint_edges", "openings"], """WITH a AS (SELECT scan_id, abs(sum(x0 * y1 - x1 * y0) / 2) AS area FROM footprint_edges GROUP BY 1), p AS (SELECT scan_id, count(*) AS n, max(x) - min(x) AS ex FROM points GROUP BY 1),
f AS (SELECT scan_id, count(*) AS n FROM mesh_faces GROUP BY 1), o AS (SELECT scan_id, count(*) AS n FROM openings GROUP BY 1)
SELECT s.scan_id, name, round(ceiling_z - floor_z, 3) AS ceiling_height_m, coalesce(p.n, 0) AS points, coalesce(f.n, 0) AS faces, round(ex, 3) AS extent_x, round(area, 2) AS floor_area_m2, coalesce(o.n, 0) AS openings, 'unknown' AS verdict
FROM scans s LEFT JOIN a USING (scan_id) LEFT JOIN p USING (scan_id) LEFT JOIN f USING (scan_id) LEFT JOIN o USING (scan_id)""")
def _(fx):
    return tb.twin_summary(fx.scans, fx.points, fx.mesh_faces, fx.footprint_edges, fx.openings).drop("extent_y", "extent_z")


_NB = "sum(CASE WHEN b.col IS NOT NULL THEN 1 ELSE 0 END)"


@query("depth_edge_filter", ["depth_pixels"], """SELECT a.scan_id, a.frame_id, a.col, a.row_no FROM depth_pixels a JOIN depth_pixels b ON a.scan_id = b.scan_id AND a.frame_id = b.frame_id AND abs(a.col - b.col) + abs(a.row_no - b.row_no) = 1
GROUP BY 1, 2, 3, 4 HAVING count(*) = 4 AND max(abs(a.recon_depth - b.recon_depth)) / any_value(a.recon_depth) <= 0.5e0""")
def _(fx):
    return tr.depth_edge_filter(fx.depth_pixels, 0.5).select("scan_id", "frame_id", "col", "row_no")


@query("confidence_filter", ["depth_pixels"], """WITH c AS (SELECT scan_id, quantile_cont(conf, 0.35) AS cut FROM depth_pixels GROUP BY 1), n AS (SELECT scan_id, cut, sum(CASE WHEN conf >= cut THEN 1 ELSE 0 END) >= 90 AS use FROM depth_pixels JOIN c USING (scan_id) GROUP BY 1, 2)
SELECT scan_id, frame_id, col, row_no FROM depth_pixels JOIN n USING (scan_id) WHERE NOT use OR conf >= cut""")
def _(fx):
    return tr.confidence_filter(fx.depth_pixels, minimum=90).select("scan_id", "frame_id", "col", "row_no")


def poses_of(fx):
    """Cameras as world-to-camera poses: yaw about Z with the camera's y axis down."""
    a = F.radians("yaw_deg")
    c, s, z, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    r = F.array(c, s, z, z, z, -one, -s, c, z)
    p = [F.col(x) for x in "xyz"]
    t = F.array(*[-(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2]) for i in range(3)])
    return fx.cameras.select("scan_id", "cam_id", "x", "y", "z", "yaw_deg", r.alias("r"), t.alias("t"))


@query("camera_centres", ["cameras"], "SELECT scan_id, cam_id, round(x, 6) AS cx, round(y, 6) AS cy, round(z, 6) AS cz FROM cameras")
def _(fx):
    return rounded(tr.camera_centres(poses_of(fx)), "cx", "cy", "cz").select("scan_id", "cam_id", "cx", "cy", "cz")


@query("unproject_depth", ["depth_pixels", "cameras"], """WITH f AS (SELECT scan_id, x, y, z, radians(yaw_deg) AS a FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY cam_id) AS rn FROM cameras) WHERE rn = 1),
p AS (SELECT scan_id, frame_id, col, row_no, (col - 4.0e0) / 8.0e0 * recon_depth AS u, (row_no - 4.0e0) / 8.0e0 * recon_depth AS v, recon_depth AS d FROM depth_pixels)
SELECT scan_id, frame_id, col, row_no, round(f.x + cos(a) * u - sin(a) * d, 4) + 0.0e0 AS x, round(f.y + sin(a) * u + cos(a) * d, 4) + 0.0e0 AS y, round(f.z - v, 4) + 0.0e0 AS z FROM p JOIN f USING (scan_id)""")
def _(fx):
    first = poses_of(fx).groupBy("scan_id").agg(F.min(F.struct("cam_id", "r", "t")).alias("p"))
    cams = first.select("scan_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("frame_id"), F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(4.0).alias("px"), F.lit(4.0).alias("py"), F.col("p")["r"].alias("r"), F.col("p")["t"].alias("t"))
    out = tr.unproject_depth(fx.depth_pixels, cams)
    return out.select("scan_id", "frame_id", "col", "row_no", *[(F.round(a, 4) + 0.0).alias(a) for a in "xyz"])


@query("sharpest_frame_per_bucket", ["frames"], """WITH i AS (SELECT *, row_number() OVER (PARTITION BY sweep_id ORDER BY frame_id) - 1 AS idx, count(*) OVER (PARTITION BY sweep_id) AS n FROM frames), b AS (SELECT DISTINCT sweep_id, n, k, round_even(n * k / 3.0e0, 0) AS lo, round_even(n * (k + 1) / 3.0e0, 0) AS hi FROM i, range(3) r(k)),
j AS (SELECT i.sweep_id, i.frame_id, i.sharpness, i.idx, CASE WHEN i.n <= 3 THEN i.idx ELSE b.k END AS k FROM i LEFT JOIN b ON b.sweep_id = i.sweep_id AND i.idx >= b.lo AND i.idx < b.hi)
SELECT sweep_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY sweep_id, k ORDER BY sharpness DESC, idx) AS rn FROM j) WHERE rn = 1""")
def _(fx):
    return vd.sharpest_frame_per_bucket(fx.frames, 3).select("sweep_id", "frame_id")


@query("blur_flags", ["frames"], "SELECT sweep_id, frame_id, round(sharpness / max(sharpness) OVER (PARTITION BY sweep_id), 6) AS ratio, sharpness / max(sharpness) OVER (PARTITION BY sweep_id) < 0.15e0 AS blurry FROM frames")
def _(fx):
    return rounded(vd.blur_flags(fx.frames), "ratio").select("sweep_id", "frame_id", "ratio", "blurry")


@query("overlap_windows", ["frames"], """WITH s AS (SELECT sweep_id, count(*) AS n FROM frames GROUP BY 1), w AS (SELECT sweep_id, n, unnest(range(CAST(greatest(ceil((n - 4) / 3.0e0), 0) AS BIGINT) + 1)) AS w FROM s)
SELECT sweep_id, w, CAST(CASE WHEN w * 3 + 4 >= n THEN greatest(n - 4, 0) ELSE w * 3 END AS BIGINT) AS lo, CAST(CASE WHEN w * 3 + 4 >= n THEN n ELSE w * 3 + 4 END AS BIGINT) AS hi FROM w""")
def _(fx):
    return vd.overlap_windows(fx.frames.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n")), 4, 1)


@query("up_from_cameras", ["cameras"], "SELECT scan_id, 1.0e0 AS coherence, 0.0e0 AS up_x, 0.0e0 AS up_y, 1.0e0 AS up_z FROM cameras GROUP BY 1 HAVING count(*) >= 2")
def _(fx):
    return rounded(vd.up_from_cameras(poses_of(fx)), "coherence", "up_x", "up_y", "up_z")


_SOLVE = """cut AS (SELECT scan_id, frame_id, quantile_cont(conf, 0.5) AS c FROM depth_pixels GROUP BY 1, 2), q AS (SELECT scan_id, frame_id, ln(metric_depth / recon_depth) AS q FROM depth_pixels JOIN cut USING (scan_id, frame_id) WHERE conf >= c AND metric_depth > 0.25e0 AND metric_depth < 15e0),
n AS (SELECT scan_id, frame_id, quantile_cont(q, 0.5) AS med FROM q GROUP BY 1, 2 HAVING count(*) >= 20), f AS (SELECT scan_id, frame_id, med, 1.4826e0 * quantile_cont(abs(q - med), 0.5) AS spread FROM q JOIN n USING (scan_id, frame_id) GROUP BY 1, 2, 3),
m AS (SELECT scan_id, count(*) AS used, quantile_cont(med, 0.5) AS lf, quantile_cont(spread, 0.5) AS within FROM f WHERE spread <= 0.35e0 GROUP BY 1), b AS (SELECT scan_id, 1.4826e0 * quantile_cont(abs(med - lf), 0.5) AS between FROM f JOIN m USING (scan_id) WHERE spread <= 0.35e0 GROUP BY 1),
depth AS (SELECT scan_id, 'metric-depth' AS source, exp(lf) AS factor, greatest(CASE WHEN used > 1 THEN between ELSE within END, 0.25e0 * within) AS log_spread, ln(1.3e0) AS prior_bias, used AS frames_used FROM m JOIN b USING (scan_id))"""
_CONF = "least(greatest(1 - (exp(greatest({0}, 0e0)) - 1) / 0.3e0, 0.05e0), 0.95e0)"


@query("solve_scale", ["depth_pixels"], f"WITH {_SOLVE} SELECT scan_id, round(factor, 6) AS factor, round(log_spread, 6) AS log_spread, round({_CONF.format('log_spread')}, 6) AS confidence, frames_used FROM depth")
def _(fx):
    return rounded(vd.solve_scale(fx.depth_pixels, 20), "factor", "log_spread", "confidence").select("scan_id", "factor", "log_spread", "confidence", "frames_used")


_CAMH = """cam AS (SELECT scan_id, quantile_cont(z, 0.5) AS c, count(*) AS n FROM cameras GROUP BY 1), pt AS (SELECT scan_id, quantile_cont(z, 0.01) AS f, quantile_cont(z, 0.995) AS t FROM points GROUP BY 1),
height AS (SELECT scan_id, 'camera-height' AS source, 1.55e0 / (c - f) AS factor, 0e0 AS log_spread, ln(1.12e0) AS prior_bias, n AS frames_used FROM cam JOIN pt USING (scan_id) WHERE n >= 2 AND (c - f) / (t - f) BETWEEN 0.15e0 AND 0.85e0)"""


def ups(fx):
    return fx.scans.select("scan_id", F.lit(0.0).alias("up_x"), F.lit(0.0).alias("up_y"), F.lit(1.0).alias("up_z"))


@query("scale_from_camera_height", ["cameras", "points"], f"WITH {_CAMH} SELECT scan_id, round(factor, 6) AS factor, frames_used FROM height")
def _(fx):
    return rounded(vd.scale_from_camera_height(fx.points, fx.cameras, ups(fx), 100), "factor").select("scan_id", "factor", "frames_used")


_DOOR = """d AS (SELECT * FROM openings WHERE confidence >= 0.3e0 AND sill_height <= 0.08e0 * height AND height / width BETWEEN 1.5e0 AND 3.5e0), dm AS (SELECT scan_id, quantile_cont(height, 0.5) AS h, quantile_cont(ln(2.03e0 / height), 0.5) AS l, count(*) AS n FROM d GROUP BY 1),
door AS (SELECT scan_id, 'door-height' AS source, 1.5e0 * 2.03e0 / any_value(h) AS factor, CASE WHEN any_value(n) > 1 THEN 1.4826e0 * quantile_cont(abs(ln(2.03e0 / height) - l), 0.5) ELSE 0e0 END AS log_spread, ln(1.08e0) AS prior_bias, any_value(n) AS frames_used FROM d JOIN dm USING (scan_id) GROUP BY 1)"""


def doors(fx):
    return vd.scale_from_doors(fx.openings, fx.scans.select("scan_id", F.lit(1.5).alias("factor")))


@query("scale_from_doors", ["openings"], f"WITH {_DOOR} SELECT scan_id, round(factor, 6) AS factor, round(log_spread, 6) AS log_spread, frames_used FROM door")
def _(fx):
    return rounded(doors(fx), "factor", "log_spread").select("scan_id", "factor", "log_spread", "frames_used")


@query("combine_scales", ["depth_pixels", "cameras", "points", "openings"], f"""WITH {_SOLVE}, {_CAMH}, {_DOOR}, e AS (SELECT * FROM depth UNION ALL SELECT * FROM height UNION ALL SELECT * FROM door), w AS (SELECT *, sqrt(log_spread*log_spread + prior_bias*prior_bias) AS s, ln(factor) AS y FROM e),
g AS (SELECT scan_id, count(*) AS n, sum(1 / (s*s)) AS w, sum(y / (s*s)) / sum(1 / (s*s)) AS mu, min(s) AS lone FROM w GROUP BY 1), c AS (SELECT scan_id, sum((y - mu)*(y - mu) / (s*s)) AS chi FROM w JOIN g USING (scan_id) GROUP BY 1),
o AS (SELECT scan_id, n, mu, CASE WHEN n > 1 THEN greatest(1e0, sqrt(chi / (n - 1))) / sqrt(w) ELSE lone END AS sp FROM g JOIN c USING (scan_id)) SELECT scan_id, round(exp(mu), 6) AS factor, round(sp, 6) AS log_spread, round({_CONF.format('sp')}, 6) AS confidence, n AS estimators FROM o""")
def _(fx):
    every = vd.solve_scale(fx.depth_pixels, 20).union(vd.scale_from_camera_height(fx.points, fx.cameras, ups(fx), 100)).union(doors(fx))
    return rounded(vd.combine_scales(every), "factor", "log_spread", "confidence").select("scan_id", "factor", "log_spread", "confidence", "estimators")


def window_poses(fx):
    """Each scan's cameras cut into windows of eight overlapping by five, every window in its own turned, scaled frame. Cameras step on as
    they are numbered: those of a scan may all stand in one spot (they do at 60 times sf0.1), and from one spot no scale can be told."""
    poses = poses_of(fx).withColumn("sweep_id", F.col("scan_id")).withColumn("frame_id", F.col("cam_id"))
    sizes = poses.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n"))
    rows = vd.window_frames(poses, vd.overlap_windows(sizes, 8, 5))
    step = F.col("idx") % 16
    rows = rows.withColumn("t", F.array(*[F.col("t")[i] - step * (0.4 * F.col("r")[3 * i] + 0.3 * F.col("r")[3 * i + 1]) for i in range(3)]))
    # window frame: p' = s Q p + d, with Q a turn about Z; a pose becomes (R Q', s t - R Q' d)
    a = F.radians(17.0 * F.col("w"))
    s = 1.0 + 0.1 * F.col("w")
    c, n = F.cos(a), F.sin(a)
    r = F.col("r")
    turned = F.array(*[v for i in range(3) for v in (r[3 * i] * c - r[3 * i + 1] * n, r[3 * i] * n + r[3 * i + 1] * c, r[3 * i + 2])])
    rows = rows.withColumn("r2", turned)
    d = [0.3 * F.col("w"), -0.2 * F.col("w"), 0.1 * F.col("w")]
    t = F.array(*[s * F.col("t")[i] - sum(F.col("r2")[3 * i + j] * d[j] for j in range(3)) for i in range(3)])
    return rows.select("scan_id", "w", "frame_id", F.col("r2").alias("r"), t.alias("t"))


@query("register_windows", ["cameras"], """WITH i AS (SELECT scan_id, count(*) AS n FROM cameras GROUP BY 1), w AS (SELECT scan_id, n, unnest(range(CAST(greatest(ceil((n - 8) / 3.0e0), 0) AS BIGINT) + 1)) AS w FROM i),
s AS (SELECT scan_id, w, CASE WHEN w * 3 + 8 >= n THEN greatest(n - 8, 0) ELSE w * 3 END AS lo, least(w * 3 + 8, n) AS hi FROM w)
SELECT b.scan_id, b.w, CAST(a.hi - b.lo AS BIGINT) AS shared, round((1 + 0.1e0 * a.w) / (1 + 0.1e0 * b.w), 5) AS scale, round(cos(radians(17.0e0)), 5) AS r00, round(0e0, 5) AS residual_m FROM s a JOIN s b ON a.scan_id = b.scan_id AND b.w = a.w + 1 WHERE a.hi - b.lo >= 4""")
def _(fx):
    out = vd.register_windows(window_poses(fx))
    return out.select("scan_id", "w", "shared", F.round("scale", 5).alias("scale"), F.round(F.col("rot")[0], 5).alias("r00"), (F.round("residual_m", 5) + 0.0).alias("residual_m"))


@query("compose_windows", ["cameras"], """WITH i AS (SELECT scan_id, count(*) AS n FROM cameras GROUP BY 1), w AS (SELECT scan_id, unnest(range(CAST(greatest(ceil((n - 8) / 3.0e0), 0) AS BIGINT) + 1)) AS w FROM i)
SELECT scan_id, w, round(1 / (1 + 0.1e0 * w), 5) AS scale, round(cos(radians(17.0e0 * w)), 5) + 0.0e0 AS r00 FROM w""")
def _(fx):
    poses = window_poses(fx)
    out = vd.compose_windows(vd.register_windows(poses), poses.select("scan_id", "w").distinct())
    return out.select("scan_id", "w", F.round("scale", 5).alias("scale"), (F.round(F.col("rot")[0], 5) + 0.0).alias("r00"))

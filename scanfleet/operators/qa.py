"""How far a twin can be trusted: coverage, wall flatness, frame, scale, and the checks built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.stats import percentiles
from ..session import cut_lineage
from . import cells as cl
from .openings import opening_on_wall
from .planes import fit_plane
from .polygons import cells_inside
from .transforms import add_plane_frame, signed_distance, wall_frame, with_planes

WALL = ["scan_id", "plane_id"]
#: Side of the squares by which probes and wall points find openings.
GRID_M = 1.0
P, N = ("x", "y", "z"), ("nx", "ny", "nz")


def opening_probe_mask(probes: DataFrame, openings: DataFrame, keys: list[str], margin: Column) -> DataFrame:
    """Keys of wall probes that fall in an opening grown by ``margin`` and 0.35 m deep. Openings are spread over the squares of a grid that
    their box touches, so a probe meets those near it."""
    o = openings.select("scan_id", *[F.col(f"c{a}").alias(f"o{a}") for a in "xyz"], *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"], "width", "height")
    o = o.withColumn("_h", F.hypot("mx", "my")).where(F.col("_h") >= 1e-9)
    asked = probes.select("scan_id", *keys, *P, margin.alias("_m"))
    # the box of an opening over the floor, at the scan's widest margin: half its width along the wall and its depth across
    o = o.join(asked.groupBy("scan_id").agg(F.max("_m").alias("_mm")), "scan_id")
    half, deep = F.col("width") / 2.0 + F.col("_mm"), (0.35 + F.abs("mz") * (F.col("height") / 2.0 + F.col("_mm"))) / F.col("_h")
    for a, along, across in (("x", "my", "mx"), ("y", "mx", "my")):
        reach = (F.abs(along) * half + F.abs(across) * deep) / F.col("_h") + 1e-6
        o = o.withColumn(f"_g{a}", F.explode(F.sequence(F.floor((F.col(f"o{a}") - reach) / GRID_M), F.floor((F.col(f"o{a}") + reach) / GRID_M))))
    d = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    along = (-F.col("my") * d[0] + F.col("mx") * d[1]) / F.col("_h")
    hit = (F.abs(along) <= F.col("width") / 2.0 + F.col("_m")) & (F.abs(d[2]) <= F.col("height") / 2.0 + F.col("_m")) & (F.abs(vec.dot(d, vec.cols("mx", "my", "mz"))) <= 0.35)
    asked = asked.withColumns({f"_g{a}": F.floor(F.col(a) / GRID_M) for a in "xy"})
    return asked.join(o, ["scan_id", "_gx", "_gy"]).where(hit).select("scan_id", *keys).distinct()


def coverage(points: DataFrame, scans: DataFrame, footprint: DataFrame, openings: DataFrame, cells: DataFrame) -> DataFrame:
    """Floor, ceiling and wall coverage and the share of the expected shell without points.

    ``cells``: scan_id, cell. Only occupied and footprint cells become rows; wall probes are boundary cells times heights.
    """
    box = points.groupBy("scan_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.max("x").alias("_x1"), F.max("y").alias("_y1"), F.max("z").alias("z_max"))
    c = F.col("cell")
    lat = box.join(cells, "scan_id").join(scans.select("scan_id", "floor_z", "ceiling_z"), "scan_id")
    lat = lat.withColumns({"x0": F.col("_x") - c, "y0": F.col("_y") - c})
    lat = lat.withColumns({"ni": F.greatest(F.lit(2).cast("long"), F.ceil((F.col("_x1") + c - F.col("x0")) / c)), "nj": F.greatest(F.lit(2).cast("long"), F.ceil((F.col("_y1") + c - F.col("y0")) / c))})
    lat = cut_lineage(lat.drop("_x", "_y", "_x1", "_y1"))
    inside = cut_lineage(cells_inside(footprint, lat))
    rows = points.select("scan_id", *P).join(lat, "scan_id").withColumns({"i": vec.clip(vec.cell(F.col("x"), F.col("x0"), c), 0, F.col("ni") - 1), "j": vec.clip(vec.cell(F.col("y"), F.col("y0"), c), 0, F.col("nj") - 1)})
    z, fz, cz = F.col("z"), F.col("floor_z"), F.col("ceiling_z")
    slab = F.greatest(F.lit(0.10), 1.5 * c)
    on_floor = (z >= fz - 0.5 * c) & (z < fz + slab)
    on_ceiling = F.coalesce((z >= cz - slab) & (z < cz + 0.5 * c), F.lit(False))
    occ = rows.groupBy("scan_id", "i", "j").agg(F.max(on_floor).alias("floor"), F.max(on_ceiling).alias("ceiling"))
    seen = inside.join(occ, ["scan_id", "i", "j"], "left").groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("floor").cast("int"), F.lit(0))).alias("floor_n"), F.sum(F.coalesce(F.col("ceiling").cast("int"), F.lit(0))).alias("ceil_n")
    )
    edge = cl.boundary_shell(inside, ["i", "j"]).join(lat, "scan_id").withColumn("top", F.coalesce("ceiling_z", "z_max"))
    last = F.ceil((F.col("top") - 0.25 * c - fz - 0.5 * c) / c) - 1
    probes = edge.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumns({"z": fz + 0.5 * c + F.col("k") * c, "x": F.col("x0") + (F.col("i") + 0.5) * c, "y": F.col("y0") + (F.col("j") + 0.5) * c})
    probes = cut_lineage(probes.select("scan_id", "i", "j", "k", *P, "cell", (F.col("z") - fz).alias("h")))
    level = vec.cell(z, fz, c)
    filled = rows.withColumn("k", level).where(F.col("k") >= 0).select("scan_id", "i", "j", "k").distinct()
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    filled = filled.select("scan_id", "i", "j", "k", F.inline(around)).select("scan_id", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "k").distinct().withColumn("_f", F.lit(1))
    skip = cut_lineage(opening_probe_mask(probes, openings, ["i", "j", "k"], F.col("cell")).withColumn("_o", F.lit(1)))
    seen = cut_lineage(seen)
    walls = probes.join(filled, ["scan_id", "i", "j", "k"], "left").join(skip, ["scan_id", "i", "j", "k"], "left")
    band = F.col("h").between(K.WALL_BAND_LOW_M, K.WALL_BAND_HIGH_M)
    hit, count = F.col("_f").isNotNull(), F.col("_o").isNull()
    one = lambda cnd: F.sum(F.when(cnd, 1).otherwise(0))
    w = walls.groupBy("scan_id").agg(one(band & hit).alias("band_hit"), one(band).alias("band_n"), one(count & hit).alias("wall_hit"), one(count).alias("wall_n"))
    out = lat.select("scan_id", "ceiling_z").join(seen, "scan_id").join(w, "scan_id", "left").fillna(0, ["band_hit", "band_n", "wall_hit", "wall_n"])
    roof = F.col("ceiling_z").isNotNull()
    total = F.col("n") + F.when(roof, F.col("n")).otherwise(0) + F.col("wall_n")
    got = F.col("floor_n") + F.when(roof, F.col("ceil_n")).otherwise(0) + F.col("wall_hit")
    return out.select(
        "scan_id", (F.col("floor_n") / F.col("n")).alias("floor_coverage"), F.when(roof, F.col("ceil_n") / F.col("n")).alias("ceiling_coverage"),
        F.when(F.col("band_n") > 0, F.try_divide("band_hit", "band_n")).alias("wall_coverage"), (1.0 - got / total).alias("hole_fraction"), F.col("n").alias("footprint_cells"),
    )


def wall_support(planes: DataFrame, spacing: DataFrame) -> DataFrame:
    """Structural walls: the large ones, minus those far more thinly supported than the best (unless under two remain)."""
    walls = planes.where(F.col("kind") == "wall").join(spacing.select("scan_id", "median_spacing_m"), "scan_id", "left")
    by = Window.partitionBy("scan_id")
    top = walls.groupBy("scan_id").agg(F.max(F.greatest("area", F.lit(0.0))).alias("_a"), F.max(F.greatest("inlier_count", F.lit(0))).alias("_c"))
    walls = walls.join(top, "scan_id")
    large = F.when(F.col("_a") > 0, F.col("area") >= F.greatest(F.lit(2.0), 0.15 * F.col("_a"))).when(F.col("_c") > 0, F.col("inlier_count") >= F.greatest(F.lit(500), F.floor(0.15 * F.col("_c")))).otherwise(True)
    walls = walls.withColumn("_big", large).withColumn("_any", F.max("_big").over(by)).where(F.col("_big") | ~F.col("_any"))
    s = F.col("median_spacing_m")
    walls = walls.withColumn("support", F.when((F.col("area") > 0) & (s > 0), F.col("inlier_count") * s * s / F.col("area")))
    walls = walls.withColumns({"_best": F.max("support").over(by)})
    walls = walls.withColumn("_ok", F.coalesce(F.col("support") >= K.WALL_SUPPORT_REL * F.col("_best"), F.lit(False)))
    walls = walls.withColumn("_k", F.sum(F.col("_ok").cast("int")).over(by)).where(F.col("_ok") | (F.col("_k") < 2))
    return walls.select(*planes.columns, "support")


def opening_cutout(rows: DataFrame, walls: DataFrame, openings: DataFrame, grow: float = 0.08) -> DataFrame:
    """Wall points outside every opening of their wall, each grown by 8 cm. ``rows``: scan_id, plane_id, point_id, x, y, z."""
    cut = opening_on_wall(openings, walls)
    frame = add_plane_frame(walls, wall_frame).select(*WALL, "ux", "uy", "uz")
    cut = cut.join(frame, WALL).select(*WALL, *[F.col(f"c{a}").alias(f"o{a}") for a in "xyz"], "width", "height", "ux", "uy", "uz")
    u = lambda names: vec.dot(vec.cols(*names), vec.cols("ux", "uy", "uz"))
    for name, at, size in (("_gu", u(("ox", "oy", "oz")), "width"), ("_gv", F.col("oz"), "height")):
        reach = F.col(size) / 2.0 + grow + 1e-6
        cut = cut.withColumn(name, F.explode(F.sequence(F.floor((at - reach) / GRID_M), F.floor((at + reach) / GRID_M))))
    placed = rows.select(*WALL, "point_id", *P).join(frame, WALL).withColumns({"_gu": F.floor(u(P) / GRID_M), "_gv": F.floor(F.col("z") / GRID_M)}).drop("ux", "uy", "uz")
    d = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    hit = (F.abs(vec.dot(d, vec.cols("ux", "uy", "uz"))) <= F.col("width") / 2.0 + grow) & (F.abs(d[2]) <= F.col("height") / 2.0 + grow)
    gone = placed.join(cut, [*WALL, "_gu", "_gv"]).where(hit).select(*WALL, "point_id").distinct()
    return rows.join(gone, WALL + ["point_id"], "left_anti")


def _tile_medians(rows: DataFrame) -> DataFrame:
    tiles = WALL + ["iu", "iv"]
    n = rows.groupBy(*tiles).agg(F.count(F.lit(1)).alias("_c"))
    mid = n.where(F.col("_c") >= 12).groupBy(*WALL).agg(F.percentile("_c", 0.5).alias("_typ"))
    need = n.join(mid, WALL, "left").where(F.col("_c") >= F.greatest(F.lit(12.0), 0.35 * F.coalesce("_typ", F.lit(0.0)))).select(*tiles)
    return percentiles(rows.join(need, tiles, "left_semi"), tiles, F.col("r"), {"med": 0.5})


def wall_residual_drift(points: DataFrame, walls: DataFrame, openings: DataFrame, min_points: int = 50, tile: float = K.DRIFT_TILE_M) -> DataFrame:
    """Each wall refitted from its points: ``nx, ny, nz, rms_m, drift_m, span_u, weight``.

    Drift is the range of the median residuals of half-metre tiles, after points off their own tile are trimmed: noise
    averages out inside a tile, a bend does not.
    """
    rows = with_planes(points, walls).where(F.abs(signed_distance()) < K.WALL_INLIER_TOL_M)
    if "nx" in points.columns:
        rows = rows.where(F.abs(vec.dot(vec.cols(*N), vec.cols("p_nx", "p_ny", "p_nz"))) > math.cos(math.radians(30.0)))
    rows = opening_cutout(rows.select(*WALL, "point_id", *P), walls, openings)
    rows = cut_lineage(rows)
    enough = rows.groupBy(*WALL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    fit = fit_plane(rows.join(enough.select(*WALL), WALL, "left_semi"), WALL)
    old = walls.select(*WALL, *[F.col(c).alias(f"w{c}") for c in N], F.when(F.col("area") > 0, F.col("area")).alias("_area"))
    fit = fit.join(old, WALL)
    sign = F.when(vec.dot(vec.cols(*N), vec.cols("wnx", "wny", "wnz")) < 0, -1.0).otherwise(1.0)
    fit = fit.withColumn("_s", sign).withColumns({c: F.col(c) * F.col("_s") for c in (*N, "plane_offset")}).withColumn("weight", F.coalesce(F.col("_area"), F.col("n").cast("double")))
    fit = cut_lineage(add_plane_frame(fit.select(*WALL, *N, "plane_offset", "weight"), wall_frame))
    at = rows.join(fit, WALL)
    p = vec.cols(*P)
    at = at.select(*WALL, (vec.dot(p, vec.cols(*N)) - F.col("plane_offset")).alias("r"), vec.dot(p, vec.cols("ux", "uy", "uz")).alias("u"), vec.dot(p, vec.cols("vx", "vy", "vz")).alias("v"))
    box = at.groupBy(*WALL).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), (F.max("u") - F.min("u")).alias("span_u"))
    at = cut_lineage(at.join(box, WALL).withColumns({"iu": vec.cell(F.col("u"), F.col("u0"), tile), "iv": vec.cell(F.col("v"), F.col("v0"), tile)}))
    tiles = at.select(*WALL, "iu", "iv").distinct().groupBy(*WALL).agg(F.count(F.lit(1)).alias("_t"))
    med = cut_lineage(_tile_medians(at))
    off = at.join(med, WALL + ["iu", "iv"], "left").withColumn("_d", F.col("r") - F.col("med"))
    sigma = percentiles(off, WALL, F.abs("_d"), {"_mad": 0.5})
    kept = off.join(sigma, WALL, "left").withColumn("_keep", F.coalesce(F.abs("_d") < F.greatest(4.0 * 1.4826 * F.col("_mad"), F.lit(0.004)), F.lit(False)))
    few = kept.groupBy(*WALL).agg(F.sum(F.col("_keep").cast("int")).alias("_k")).where(F.col("_k") < min_points).select(*WALL, F.lit(True).alias("_all"))
    many = tiles.where(F.col("_t") < 4).select(*WALL, F.lit(True).alias("_few"))
    kept = kept.join(few, WALL, "left").join(many, WALL, "left").where(F.col("_keep") | F.coalesce("_all", F.lit(False)) | F.coalesce("_few", F.lit(False)))
    kept = cut_lineage(kept.select(*WALL, "r", "iu", "iv"))
    drift = _tile_medians(kept).groupBy(*WALL).agg(F.count(F.lit(1)).alias("_m"), (F.max("med") - F.min("med")).alias("_range"))
    rms = kept.groupBy(*WALL).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms_m"))
    out = fit.join(box, WALL).join(rms, WALL).join(tiles, WALL).join(drift, WALL, "left")
    known = (F.col("_t") >= 4) & (F.col("_m") >= 4)
    return out.select(*WALL, *N, "rms_m", F.when(known, F.col("_range")).alias("drift_m"), "span_u", "weight")


def wall_frame_stats(fits: DataFrame) -> DataFrame:
    """Fourfold mean direction of the walls, the worst wall's distance from it, and the share within five degrees."""
    t = F.atan2("ny", "nx")
    rows = fits.withColumns({"_t": t, "_w": F.greatest("weight", F.lit(1e-9))})
    mean = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_k"), (F.atan2(F.sum(F.col("_w") * F.sin(4.0 * F.col("_t"))), F.sum(F.col("_w") * F.cos(4.0 * F.col("_t")))) / 4.0).alias("_m")).where(F.col("_k") >= 2)
    half = math.pi / 2.0
    dev = F.abs(F.degrees(F.pmod(F.col("_t") - F.col("_m") + math.pi / 4.0, F.lit(half)) - math.pi / 4.0))
    rows = rows.join(mean, "scan_id").withColumn("_d", dev)
    return rows.groupBy("scan_id").agg(
        F.max("_d").alias("manhattan_residual_deg"), F.degrees(F.max("_m")).alias("wall_frame_offset_deg"),
        (F.sum(F.when(F.col("_d") <= K.FRAME_TOL_DEG, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("wall_rectilinear_fraction"),
    )


def wall_parallelism(fits: DataFrame) -> DataFrame:
    """Worst angle between facing walls and the width difference it makes over the longer one.

    Facing walls have azimuths half a turn apart to within about sixteen degrees, so walls meet through 20-degree azimuth
    bins instead of as all pairs of a scan.
    """
    az = F.degrees(F.atan2("ny", "nx"))
    a = fits.select("scan_id", F.col("plane_id").alias("ida"), *[F.col(c).alias(f"a{c}") for c in N], F.col("span_u").alias("sa"), F.pmod(F.floor(F.pmod(az + 180.0, F.lit(360.0)) / 20.0), F.lit(18)).alias("bin"))
    near = F.explode(F.array(*[F.pmod(F.floor(F.pmod(az, F.lit(360.0)) / 20.0) + d, F.lit(18)) for d in (-1, 0, 1)])).alias("bin")
    b = fits.select("scan_id", F.col("plane_id").alias("idb"), *N, F.col("span_u").alias("sb"), near)
    d = vec.dot(vec.cols("anx", "any", "anz"), vec.cols(*N)) / (vec.norm(vec.cols("anx", "any", "anz")) * vec.norm(vec.cols(*N)))
    rows = a.join(b, ["scan_id", "bin"]).where(F.col("ida") < F.col("idb")).withColumn("_c", vec.clip(d, -1.0, 1.0)).where(F.col("_c") < -math.cos(math.radians(K.PARALLEL_PAIR_MAX_DEG)))
    rows = rows.withColumn("angle", 180.0 - F.degrees(F.acos("_c")))
    best = rows.groupBy("scan_id").agg(F.max(F.struct("angle", (-F.col("ida")).alias("o"), (-F.col("idb")).alias("q"), F.greatest("sa", "sb").alias("run"))).alias("w"))
    return best.select("scan_id", F.col("w")["angle"].alias("opposite_wall_parallelism_deg"), (F.col("w")["run"] * F.tan(F.radians(F.col("w")["angle"]))).alias("opposite_wall_gap_m"))


def measure_floor(points: DataFrame, scans: DataFrame, spacing: DataFrame, minimum: int = 256) -> DataFrame:
    """Floor refitted from the points near its level: a robust fit, re-cut about itself twice. ``scan_id, nx, ny, nz, plane_offset``."""
    band = scans.select("scan_id", "floor_z").join(spacing.select("scan_id", "median_spacing_m"), "scan_id", "left")
    band = band.select("scan_id", "floor_z", F.greatest(F.lit(0.12), F.coalesce(3.0 * F.col("median_spacing_m"), F.lit(0.06))).alias("band"))

    def resid():
        return vec.dot(vec.cols(*P), vec.cols(*N)) - F.col("plane_offset")

    def up(fit):
        s = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
        return fit.withColumn("_s", s).select("scan_id", "n", *[(F.col(c) * F.col("_s")).alias(c) for c in (*N, "plane_offset")])

    def robust(rows):
        first = cut_lineage(up(fit_plane(rows, ["scan_id"])).where(F.col("n") >= minimum))
        at = rows.join(first.drop("n"), "scan_id").withColumn("_r", resid())
        med = percentiles(at, ["scan_id"], F.col("_r"), {"_m": 0.5})
        mad = percentiles(at.join(med, "scan_id"), ["scan_id"], F.abs(F.col("_r") - F.col("_m")), {"_mad": 0.5})
        keep = at.join(mad, "scan_id").where(F.abs("_r") < 3.0 * F.greatest(1.4826 * F.col("_mad"), F.lit(0.005))).select("scan_id", *P)
        second = up(fit_plane(keep, ["scan_id"])).where(F.col("n") >= minimum)
        return cut_lineage(second.union(first.join(second.select("scan_id"), "scan_id", "left_anti")))

    pts = points.select("scan_id", *P)
    fit = robust(pts.join(band, "scan_id").where(F.abs(F.col("z") - F.col("floor_z")) < F.col("band")).select("scan_id", *P))
    for _ in range(2):
        rows = pts.join(fit.drop("n").join(band.select("scan_id", "band"), "scan_id"), "scan_id").where(F.abs(resid()) < F.col("band")).select("scan_id", *P)
        again = robust(rows)
        fit = cut_lineage(again.union(fit.join(again.select("scan_id"), "scan_id", "left_anti")))
    return fit.drop("n")


def plateau(x: Column, lo0: float, lo1: float, hi1: float, hi0: float) -> Column:
    return F.when((x <= lo0) | (x >= hi0), 0.0).when(x < lo1, (x - lo0) / (lo1 - lo0)).when(x > hi1, (hi0 - x) / (hi0 - hi1)).when(x.isNotNull(), 1.0)


def scale_prior(scans: DataFrame, openings: DataFrame, spacing: DataFrame) -> DataFrame:
    """How metric the architecture looks: ceiling, tallest door and point spacing, as one score up to 0.75."""
    door = openings.where((F.col("sill_height") < 0.15) & (F.col("height") > 0)).groupBy("scan_id").agg(F.max("height").alias("_door"))
    rows = scans.join(door, "scan_id", "left").join(spacing.select("scan_id", "median_spacing_m"), "scan_id", "left")
    h = F.col("ceiling_z") - F.col("floor_z")
    s = F.col("median_spacing_m")
    terms = [(F.when(h > 0, plateau(h, 1.6, 2.2, 3.6, 6.0)), 2.0), (plateau(F.col("_door"), 1.4, 1.9, 2.4, 3.2), 1.0), (F.when(s > 0, plateau(s, 0.0005, 0.002, 0.05, 0.30)), 1.0)]
    top = sum(F.coalesce(t * w, F.lit(0.0)) for t, w in terms)
    total = sum(F.when(t.isNotNull(), w).otherwise(0.0) for t, w in terms)
    return rows.withColumns({"_t": top, "_w": total}).select("scan_id", F.when(F.col("_w") > 0, 0.75 * F.col("_t") / F.col("_w")).otherwise(0.0).alias("scale_confidence_prior"))


def qa_metrics(wide: DataFrame) -> DataFrame:
    """The long metric table (``scan_id, metric, value``) of a wide one; unmeasured metrics stay null."""
    names = [c for c in wide.columns if c != "scan_id"]
    return wide.select("scan_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("scan_id", names, "metric", "value")


def _ms(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *[F.col(c) if isinstance(c, str) else c for c in cols])


def qa_checks(m: DataFrame) -> DataFrame:
    """Named checks per scan from the wide metrics: ``scan_id, name, status, message``. A missing measurement never passes.

    Every message carries the number it rests on and the line it was held against.
    """
    col = F.col

    def rule(name, *cases):
        s, t = F.lit(None).cast("string"), F.lit(None).cast("string")
        for cond, status, text in reversed(cases):
            status = F.lit(status) if isinstance(status, str) else status
            text = F.lit(text) if isinstance(text, str) else text
            s = status if cond is None else F.when(cond, status).otherwise(s)
            t = text if cond is None else F.when(cond, text).otherwise(t)
        return F.when(~col("_few"), F.struct(F.lit(name).alias("name"), s.alias("status"), t.alias("message")))

    rect, par, drift = col("wall_rectilinear_fraction"), col("opposite_wall_parallelism_deg"), col("drift_estimate_m")
    off = F.abs("wall_frame_offset_deg")
    splay = rect < K.RECTILINEAR_MIN_FRACTION
    bent = F.coalesce(drift > K.DRIFT_WARN_M, F.lit(False))
    h, cov, ratio = col("ceiling_height_m"), col("floor_coverage"), col("capture_coverage_ratio")
    thin = (col("density_per_m2") < K.DENSITY_WARN_PER_M2) | (col("median_spacing_m") > K.SPACING_WARN_M)
    conf, grav = col("scale_confidence"), col("gravity_residual_deg")
    skew = 1000.0 * (col("extent_x_m") * F.abs(F.cos(F.radians(off)) - 1.0) + col("extent_y_m") * F.abs(F.sin(F.radians(off))))
    checks = [
        rule("metric_scale", (conf < K.SCALE_CONFIDENCE_FAIL, "fail", _ms("scale confidence %.2f under 0.40: lengths are proportions, not metres", conf)), (conf.isNull(), "fail", "no scale confidence: nothing says what 1 m is"), (None, "pass", _ms("scale confidence %.2f, at least 0.40", conf))),
        rule("gravity", (grav.isNull(), "warn", "no floor to level against, 0 planes fitted: skipped, not satisfied"), (grav > K.GRAVITY_FAIL_DEG, "fail", _ms("floor %.2f deg off level, over 1.00", grav)), (grav > K.GRAVITY_WARN_DEG, "warn", _ms("floor %.2f deg off level, over 0.25", grav)), (None, "pass", _ms("floor level to %.2f deg, within 0.25", grav))),
        rule("manhattan", (col("manhattan_residual_deg").isNull(), "info", "fewer than 2 walls could be refitted"), (None, "info", _ms("walls up to %.2f deg from one square frame", "manhattan_residual_deg"))),
        rule("yaw", (off.isNull(), "warn", "fewer than 2 walls could be refitted: skipped, not satisfied"), (rect.isNull() | splay, "info", _ms("only %.0f%% of the walls share a square frame, under 60%%: not a rectangular room", rect * 100)), (off > K.YAW_FAIL_DEG, "fail", _ms("walls %.2f deg off the axes, over 2.00; about %.0f mm on the plan", off, skew)), (off > K.YAW_WARN_DEG, "warn", _ms("walls %.2f deg off the axes, over 0.50; about %.0f mm on the plan", off, skew)), (None, "pass", _ms("walls within %.2f deg of the axes, limit 0.50", off))),
        rule("wall_parallelism", (splay, "info", _ms("only %.0f%% of the walls share a square frame: facing walls need not be parallel", rect * 100)), (par.isNull(), "info", "no 2 walls face each other within 15 deg"), (par <= K.PARALLEL_WARN_DEG, "pass", _ms("facing walls parallel to %.2f deg; width varies by %.0f mm", par, col("opposite_wall_gap_m") * 1000)), (bent & (par > K.PARALLEL_FAIL_DEG), "fail", _ms("facing walls %.2f deg from parallel and bent by drift", par)), (None, "warn", _ms("facing walls %.2f deg from parallel, over 0.50", par))),
        rule("ceiling_height", (h.isNull(), "info", "0 ceiling planes: nothing overhead can be answered"), ((h < K.CEILING_MIN_M) | (h > K.CEILING_MAX_M), "warn", _ms("ceiling at %.2f m, outside 2.10-5.00", h)), (None, "pass", _ms("ceiling at %.2f m, within 2.10-5.00", h))),
        rule("coverage", (cov.isNull(), "warn", "0 footprint cells: how much was scanned is unknown"), (cov < K.FLOOR_COVERAGE_FAIL, "fail", _ms("floor seen under %.0f%% of the footprint, under 50%%", cov * 100)), (cov < K.FLOOR_COVERAGE_WARN, "warn", _ms("floor seen under %.0f%% of the footprint, under 80%%", cov * 100)), (None, "pass", _ms("floor seen under %.0f%% of the footprint", cov * 100))),
        rule("density", (col("density_per_m2").isNull() & col("median_spacing_m").isNull(), "warn", "spacing of 0 points measured: sampling unknown"), (F.coalesce(thin, F.lit(False)), "warn", _ms("%.0f points per m2 at %.0f mm, targets 300 and 50", "density_per_m2", col("median_spacing_m") * 1000)), (None, "pass", _ms("%.0f points per m2 at %.0f mm", "density_per_m2", col("median_spacing_m") * 1000))),
        rule("drift", (drift.isNull(), "warn", "0 walls large enough to show drift: skipped, not satisfied"), (drift > K.DRIFT_FAIL_M, "fail", _ms("worst wall bows %.0f mm, over 50: tracking drift", drift * 1000)), (drift > K.DRIFT_WARN_M, "warn", _ms("worst wall bows %.0f mm, over 20", drift * 1000)), (None, "pass", _ms("worst wall flat to %.0f mm, within 20", drift * 1000))),
        rule("wall_planarity", (col("wall_planarity_rms_m").isNull(), "info", "0 walls to measure noise on"), (col("wall_planarity_rms_m") > K.PLANARITY_WARN_M, "warn", _ms("worst wall scatters %.0f mm, over 20", col("wall_planarity_rms_m") * 1000)), (None, "pass", _ms("worst wall within %.0f mm of flat", col("wall_planarity_rms_m") * 1000))),
        rule("capture_bounds", (ratio.isNull(), "warn", "0 m2 of capture region known: every standpoint is unverified"), (ratio < K.CAPTURE_RATIO_WARN, "warn", _ms("scanner covered %.2f of the floor, under 0.50", ratio)), (None, "pass", _ms("scanner covered %.2f of the floor", ratio))),
        rule("duplicates", (col("duplicate_fraction").isNull(), "info", "copies among 0 neighbours: not measurable"), (col("duplicate_fraction") > K.DUPLICATE_WARN, "warn", _ms("%.0f%% of points within 1 mm of another, over 15%%", col("duplicate_fraction") * 100)), (None, "pass", _ms("%.1f%% of points within 1 mm of another", col("duplicate_fraction") * 100))),
        rule("openings", ((col("opening_count") == 0) & h.isNotNull(), "warn", "0 openings in a room with a ceiling"), (col("opening_count") == 0, "info", "0 openings, and no ceiling captured"), (None, "info", _ms("%.0f openings, %.2f m2", col("opening_count").cast("double"), "opening_area_m2"))),
        rule("watertight", (None, "info", F.concat(_ms("%.2f of the shell has no points", F.coalesce("hole_fraction", F.lit(0.0))), F.coalesce(_ms("; %.0f%% of mesh edges are open", col("mesh_boundary_edge_fraction") * 100), F.lit("; no mesh"))))),
        F.when(col("_few"), F.struct(F.lit("input").alias("name"), F.lit("fail").alias("status"), _ms("only %.0f points", col("point_count").cast("double")).alias("message"))),
        rule("gravity_axis", (col("gravity_axis_margin").isNull(), None, None), (col("gravity_axis_margin") < K.GRAVITY_AXIS_FAIL, "fail", _ms("vertical axis won by %.0f%%, under 10%%", col("gravity_axis_margin") * 100)), (col("gravity_axis_margin") < K.GRAVITY_AXIS_WARN, "warn", _ms("vertical axis won by %.0f%%, under 25%%", col("gravity_axis_margin") * 100)), (None, "pass", _ms("vertical axis won by %.0f%%", col("gravity_axis_margin") * 100))),
        rule("gravity_sign", (col("gravity_sign_margin") < K.GRAVITY_SIGN_WARN, "warn", _ms("floor and ceiling told apart by %.0f%%, under 10%%", col("gravity_sign_margin") * 100)), (None, None, None)),
    ]
    rows = m.withColumn("_few", col("point_count") < 32).select("scan_id", F.inline(F.array_compact(F.array(*checks))))
    return rows.where(col("status").isNotNull())


def qa_verdict(checks: DataFrame, scans: DataFrame) -> DataFrame:
    """The worst status of a scan's checks; informational ones pass, none at all is unknown."""
    level = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    worst = checks.groupBy("scan_id").agg(level.alias("_l"))
    name = F.when(F.col("_l") == 2, "fail").when(F.col("_l") == 1, "warn").when(F.col("_l") == 0, "pass").otherwise("unknown")
    return scans.select("scan_id").join(worst, "scan_id", "left").select("scan_id", name.alias("verdict"))


def verify_measurement(requests: DataFrame, metrics: DataFrame, in_region: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """A quoted distance with its error: endpoint spacing, drift over its share of the room, and scale, in quadrature.

    ``requests``: scan_id, request_id, ax..bz. ``metrics``: the wide table (needs spacing, drift, scale_confidence, extents).
    ``in_region``: scan_id, request_id, inside (both ends). An unmeasured term leaves the error unknown and the rest a floor.
    ``measured`` (scan_id, spacing_m, drift_m) stands in where the report lacks a spacing or drift. A scale confidence of zero supports
    nothing and counts as unmeasured. Each term says where it comes from, and ``unmeasured_terms`` names those that are missing.
    """
    d = vec.norm([F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"])
    rows = requests.withColumn("_d", d).join(metrics, "scan_id", "left").join(in_region, ["scan_id", "request_id"], "left")
    none = F.lit(None).cast("double")
    here = measured.select("scan_id", F.col("spacing_m").alias("_spacing"), F.col("drift_m").alias("_drift")) if measured is not None else None
    rows = rows.join(here, "scan_id", "left") if here is not None else rows.withColumns({"_spacing": none, "_drift": none})
    sources = {"endpoint": ("median_spacing_m", "_spacing"), "drift": ("drift_estimate_m", "_drift")}
    basis = {
        f"{term}_basis": F.when(F.col(told).isNotNull(), "measured by the report").when(F.col(own).isNotNull(), "measured from the points").otherwise("unknown")
        for term, (told, own) in sources.items()
    }
    basis["scale_basis"] = F.when(F.col("scale_confidence") > 0, "measured by the report").otherwise("unknown")
    rows = rows.withColumns(basis).withColumns({told: F.coalesce(told, own) for told, own in sources.values()})
    diag = vec.norm(vec.cols("extent_x_m", "extent_y_m", "extent_z_m"))
    span = F.when(diag <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_d") / diag))
    rows = rows.withColumns({
        "endpoint_m": math.sqrt(2.0) * 0.5 * F.col("median_spacing_m"), "drift_m": F.col("drift_estimate_m") * span, "scale_m": F.when(F.col("scale_confidence") > 0, 0.01 * (1.0 - F.col("scale_confidence")) * F.col("_d")),
    })
    terms = ["endpoint_m", "drift_m", "scale_m"]
    known = sum(F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in terms)
    total = F.sqrt(sum(F.coalesce(F.col(t) * F.col(t), F.lit(0.0)) for t in terms))
    mm = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.001), F.round(c, 3)))
    rows = rows.withColumns({"_k": known, "_u": total})
    floor = F.when(F.col("_k") > 0, mm(F.col("_u")))
    return rows.select(
        "scan_id", "request_id", F.round("_d", 3).alias("distance_m"), F.when(F.col("_k") == 3, floor).alias("uncertainty_m"), floor.alias("uncertainty_floor_m"),
        *[mm(F.col(t)).alias(t) for t in terms], *basis, F.array_compact(F.array(*[F.when(F.col(t).isNull(), t) for t in terms])).alias("unmeasured_terms"),
        F.coalesce("inside", F.lit(False)).alias("within_capture"),
    )

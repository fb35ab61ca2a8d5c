"""Which way is up, which way the walls run, and the canonical frame built from both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.linalg import eigh3, moments
from ..functions.stats import percentiles, ranked_value
from ..session import cut_lineage
from .planes import fit_plane
from .scale import plane_families, plane_weight

AXIS = ["scan_id", "axis"]
N, P = ("nx", "ny", "nz"), ("x", "y", "z")


def add_rotation(df: DataFrame, a, b, prefix: str) -> DataFrame:
    """Row-major 3x3 (``prefix0..prefix8``) of the shortest rotation from unit vector a to unit vector b.

    Opposed vectors get half a turn about an axis perpendicular to a. Shared parts are columns of their own first, so
    each of the nine entries stays small.
    """
    v = vec.cross(a, b)
    near_x = F.abs(a[0]) < 0.9
    zero = F.lit(0.0)
    h = [F.when(near_x, zero).otherwise(-a[2]), F.when(near_x, a[2]).otherwise(zero), F.when(near_x, -a[1]).otherwise(a[0])]
    out = df.withColumns({f"_rv{i}": c for i, c in enumerate(v)} | {f"_rh{i}": c for i, c in enumerate(h)} | {"_rc": vec.dot(a, b)})
    v, h, c = vec.cols("_rv0", "_rv1", "_rv2"), vec.cols("_rh0", "_rh1", "_rh2"), F.col("_rc")
    out = out.withColumns({"_rs": vec.dot(v, v), "_rq": vec.dot(h, h), "_rk": 1.0 / F.when(1.0 + c < 1e-12, F.lit(1.0)).otherwise(1.0 + c)})
    s2, k = F.col("_rs"), F.col("_rk")
    skew = [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]
    cols = {}
    for i in range(3):
        for j in range(3):
            eye = 1.0 if i == j else 0.0
            turn = F.lit(eye) * (1.0 - s2 * k) + skew[3 * i + j] + v[i] * v[j] * k
            half = 2.0 * h[i] * h[j] / F.col("_rq") - eye
            cols[f"{prefix}{3 * i + j}"] = F.when(F.sqrt(s2) < 1e-12, F.when(c > 0, F.lit(eye)).otherwise(half)).otherwise(turn)
    return out.withColumns(cols).drop(*[f"_rv{i}" for i in range(3)], *[f"_rh{i}" for i in range(3)], "_rc", "_rs", "_rq", "_rk")


def manhattan_axes(planes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Three perpendicular directions per scan from its plane families: ``scan_id, axis, ax, ay, az``.

    The heaviest family gives the first, the heaviest family within 20 degrees of perpendicular the second. Scans without
    planes use the spread of their normals, if ``points`` with normals are given.
    """
    fams = plane_families(planes, 10.0)
    order = fams.select("scan_id", F.posexplode("fams").alias("o", "f"))
    order = cut_lineage(order)
    key = F.struct((-F.col("f")["w"]).alias("w"), "o", F.col("f").alias("f"))
    first = order.groupBy("scan_id").agg(F.min(key)["f"].alias("a"))
    dot = F.col("f")["nx"] * F.col("a")["nx"] + F.col("f")["ny"] * F.col("a")["ny"] + F.col("f")["nz"] * F.col("a")["nz"]
    second = order.join(first, "scan_id").where(F.abs(dot) <= math.sin(math.radians(20.0))).groupBy("scan_id").agg(F.min(key)["f"].alias("b"))
    a = [F.col("a")[c] for c in N]
    rows = cut_lineage(first.join(second, "scan_id", "left").withColumns(dict(zip(("_x", "_y", "_z"), a))))
    u = vec.cols("_x", "_y", "_z")
    near_x = F.abs(u[0]) < 0.9
    spare = [F.when(near_x, F.lit(0.0)).otherwise(-u[2]), F.when(near_x, u[2]).otherwise(F.lit(0.0)), F.when(near_x, -u[1]).otherwise(u[0])]
    rows = rows.withColumns({f"_b{c}": F.coalesce(F.col("b")[f"n{c}"], s) for c, s in zip("xyz", spare)})
    b = vec.cols("_bx", "_by", "_bz")
    rows = rows.withColumns(dict(zip(("_px", "_py", "_pz"), vec.sub(b, vec.scale(u, vec.dot(b, u))))))
    rows = rows.withColumn("_l", vec.norm(vec.cols("_px", "_py", "_pz")))
    rows = rows.withColumns({f"_q{c}": F.col(f"_p{c}") / F.col("_l") for c in "xyz"})
    q = vec.cols("_qx", "_qy", "_qz")
    axes = F.array(*[F.struct(F.lit(k).cast("long").alias("axis"), *[c.alias(f"a{d}") for c, d in zip(v, "xyz")]) for k, v in enumerate((u, q, vec.cross(u, q)))])
    out = rows.select("scan_id", F.inline(axes))
    if points is None:
        return out
    rest = points.join(first.select("scan_id"), "scan_id", "left_anti").groupBy("scan_id").agg(*moments(*vec.cols(*N))).where(F.col("n") >= 64)
    e = rest.select("scan_id", eigh3("mxx", "mxy", "mxz", "myy", "myz", "mzz").alias("e"))
    return out.union(e.select("scan_id", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("axis"), *[F.col("e")[f"v{k}{d}"].alias(f"a{d}") for d in "xyz"]) for k in range(3)]))))


def normal_pole(points: DataFrame, axes: DataFrame, degrees: float = K.WALL_TOL_DEG, rounds: int = 4) -> DataFrame:
    """Each axis refined to the pole of the normals lying near its great circle, with whether enough of them did."""
    limit = math.sin(math.radians(degrees))
    out = cut_lineage(axes.withColumn("converged", F.lit(False)))
    n, a = vec.cols(*N), vec.cols("ax", "ay", "az")
    for _ in range(rounds):
        m = points.select("scan_id", *N).join(out, "scan_id").where(F.abs(vec.dot(n, a)) <= limit).groupBy(*AXIS).agg(*moments(*n)).where(F.col("n") >= 64)
        e = m.select(*AXIS, eigh3("mxx", "mxy", "mxz", "myy", "myz", "mzz").alias("e"))
        new = out.join(e, AXIS, "left")
        v = [F.col("e")[f"v0{d}"] for d in "xyz"]
        sign = F.when(vec.dot(v, a) < 0, -1.0).otherwise(1.0)
        new = new.withColumn("_s", sign)
        out = cut_lineage(new.select(*AXIS, *[F.coalesce(c * F.col("_s"), o).alias(f"a{d}") for c, o, d in zip(v, a, "xyz")], (F.col("converged") | F.col("e").isNotNull()).alias("converged")))
    return out


def along(points: DataFrame, axes: DataFrame) -> DataFrame:
    """Point coordinate t on every axis of its scan."""
    return points.select("scan_id", "point_id", *P).join(axes, "scan_id").select(*AXIS, "point_id", *P, "ax", "ay", "az", vec.dot(vec.cols(*P), vec.cols("ax", "ay", "az")).alias("t"))


def axis_extremes(points: DataFrame, axes: DataFrame) -> DataFrame:
    return percentiles(along(points, axes), AXIS, F.col("t"), {"lo": 0.002, "hi": 0.998})


def clutter_mask(points: DataFrame, axes: DataFrame, extremes: DataFrame) -> DataFrame:
    """Points clear of all six bounding slabs: what stands in the room rather than bounds it."""
    box = axes.join(extremes, AXIS).groupBy("scan_id").agg(F.collect_list(F.struct("ax", "ay", "az", "lo", "hi")).alias("_axes"))  # three per scan

    def clear(b):
        t = F.col("x") * b["ax"] + F.col("y") * b["ay"] + F.col("z") * b["az"]
        return (t > b["lo"] + K.SHELL_SKIN_M) & (t < b["hi"] - K.SHELL_SKIN_M)

    return points.select("scan_id", "point_id", *P).join(box, "scan_id").withColumn("clutter", F.forall("_axes", clear)).drop("_axes")


def _asymmetry(rows: DataFrame, skin: float, name: str) -> DataFrame:
    span = F.col("hi") - F.col("lo")
    band, edge = F.least(F.lit(K.CLUTTER_BAND_M), 0.45 * span), F.least(F.lit(skin), 0.08 * span)
    t = F.col("t")
    low = F.sum(F.when((t > F.col("lo") + edge) & (t < F.col("lo") + edge + band), 1.0).otherwise(0.0))
    high = F.sum(F.when((t < F.col("hi") - edge) & (t > F.col("hi") - edge - band), 1.0).otherwise(0.0))
    out = rows.groupBy(*AXIS).agg(low.alias("_a"), high.alias("_b"))
    return out.select(*AXIS, F.when(F.col("_a") + F.col("_b") <= 0, 0.0).otherwise((F.col("_a") - F.col("_b")) / (F.col("_a") + F.col("_b"))).alias(name))


def band_asymmetry(points: DataFrame, axes: DataFrame, extremes: DataFrame, skin: float = K.CLUTTER_SKIN_M, name: str = "band") -> DataFrame:
    """(low - high) / (low + high) of the points in the end bands of every axis."""
    return _asymmetry(along(points, axes).join(extremes, AXIS), skin, name)


def contact_fractions(clutter: DataFrame, axes: DataFrame, extremes: DataFrame) -> DataFrame:
    """Share of clutter columns that rest on the low end, and that touch the high end, of every axis."""
    rows = along(clutter, axes)
    flat = F.abs("az") < 0.9
    a = vec.cols("ax", "ay", "az")
    ref = [F.when(flat, 0.0).otherwise(1.0), F.lit(0.0), F.when(flat, 1.0).otherwise(0.0)]
    u = vec.cross(a, ref)
    frame = axes.withColumns(dict(zip(("_ux", "_uy", "_uz"), u))).withColumn("_l", vec.norm(vec.cols("_ux", "_uy", "_uz")))
    frame = frame.withColumns({f"u{d}": F.col(f"_u{d}") / F.col("_l") for d in "xyz"})
    frame = frame.withColumns({f"v{d}": c for d, c in zip("xyz", vec.cross(a, vec.cols("ux", "uy", "uz")))}).select(*AXIS, "ux", "uy", "uz", "vx", "vy", "vz")
    rows = rows.join(frame, AXIS).select(*AXIS, "t", vec.dot(vec.cols(*P), vec.cols("ux", "uy", "uz")).alias("u"), vec.dot(vec.cols(*P), vec.cols("vx", "vy", "vz")).alias("v"))
    box = rows.groupBy(*AXIS).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 64)
    cols = rows.join(box, AXIS).groupBy(*AXIS, vec.cell(F.col("u"), F.col("u0"), K.CONTACT_CELL_M).alias("i"), vec.cell(F.col("v"), F.col("v0"), K.CONTACT_CELL_M).alias("j")).agg(
        F.count(F.lit(1)).alias("c"), F.min("t").alias("bottom"), F.max("t").alias("top")
    )
    tol = K.SHELL_SKIN_M + K.CONTACT_TOL_M
    cols = cols.where(F.col("c") >= 4).join(extremes, AXIS)
    out = cols.groupBy(*AXIS).agg(
        F.count(F.lit(1)).alias("_k"), F.avg((F.col("bottom") <= F.col("lo") + tol).cast("double")).alias("_lo"), F.avg((F.col("top") >= F.col("hi") - tol).cast("double")).alias("_hi")
    )
    enough = (F.col("_k") >= 8) & F.col("_lo").isNotNull()
    return axes.select(*AXIS).join(out, AXIS, "left").select(*AXIS, F.when(enough, F.col("_lo")).otherwise(0.0).alias("low_contact"), F.when(enough, F.col("_hi")).otherwise(0.0).alias("high_contact"))


def taper(x: Column, lo: float, hi: float, width: float = 0.10) -> Column:
    lx = F.ln(x)
    inside = 1.0 / (1.0 + F.exp(-(lx - math.log(lo)) / width)) / (1.0 + F.exp(-(math.log(hi) - lx) / width))
    return F.when(x > 0, inside).otherwise(0.0)


def axis_margin(scores: DataFrame) -> DataFrame:
    """Best-scoring axis per scan and how far it beat the runner-up, as a share of its own score."""
    top = scores.groupBy("scan_id").agg(F.max(F.struct("score", (-F.col("axis")).alias("o"))).alias("b"))
    best = top.select("scan_id", (-F.col("b")["o"]).alias("axis"), F.col("b")["score"].alias("score"))
    rest = scores.join(best.select("scan_id", "axis"), AXIS, "left_anti").groupBy("scan_id").agg(F.max("score").alias("_next"))
    margin = F.when(F.col("score") <= 0, 0.0).otherwise(1.0 - F.coalesce("_next", F.lit(0.0)) / F.col("score"))
    return best.join(rest, "scan_id", "left").select("scan_id", "axis", "score", margin.alias("axis_margin"))


def axis_evidence(points: DataFrame, axes: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """All measurements that tell a vertical axis from a horizontal one, and a floor end from a ceiling end."""
    ext = cut_lineage(axis_extremes(points, axes))
    clut = clutter_mask(points, axes, ext).where("clutter")
    out = axes.join(ext, AXIS).join(band_asymmetry(points, axes, ext), AXIS).join(band_asymmetry(clut, axes, ext, 0.0, "free"), AXIS, "left").join(contact_fractions(clut, axes, ext), AXIS)
    out = out.fillna(0.0, ["free"])
    if cameras is not None:
        t = along(cameras.withColumnRenamed("cam_id", "point_id"), axes)
        med = percentiles(t, AXIS, F.col("t"), {"cam_t": 0.5})
        mad = percentiles(t.join(med, AXIS), AXIS, F.abs(F.col("t") - F.col("cam_t")), {"cam_spread": 0.5})
        n = cameras.groupBy("scan_id").agg(F.count(F.lit(1)).alias("cams"))
        out = out.join(med, AXIS, "left").join(mad, AXIS, "left").join(n, "scan_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("cam_t", "cam_spread", "cams")})
    return cut_lineage(out)


def find_up(evidence: DataFrame, planes: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Up per scan: ``scan_id, axis, ux, uy, uz, axis_margin, sign_margin``.

    The axis is the one with the most clutter at one end, weighed by how plausible a room height its span is; the sign is
    a weighted vote. ``hints``: scan_id, hx, hy, hz.
    """
    e = evidence.join(hints, "scan_id", "left") if hints is not None else evidence.withColumns({c: F.lit(None).cast("double") for c in ("hx", "hy", "hz")})
    e = e.withColumn("_hint", vec.dot(vec.cols("ax", "ay", "az"), vec.cols("hx", "hy", "hz")))
    wide = e.where(F.col("cams") >= 8).groupBy("scan_id").agg(F.max("cam_spread").alias("_wide"))
    e = cut_lineage(e.join(wide, "scan_id", "left"))
    score = (
        K.W_BAND * F.abs("band") + K.W_FREE * F.abs("free") + K.W_CONTACT * F.greatest("low_contact", "high_contact")
        + F.when(F.col("_wide") > 0, K.W_CAMERA_AXIS * (1.0 - F.col("cam_spread") / F.col("_wide"))).otherwise(0.0) + F.coalesce(K.W_UP_HINT * F.abs("_hint"), F.lit(0.0))
    )
    low, high, floor = K.VERTICAL_PRIOR
    e = e.withColumn("score", score * (floor + (1.0 - floor) * taper(F.col("hi") - F.col("lo"), low, high)))
    best = cut_lineage(e.join(axis_margin(e).select("scan_id", "axis", "axis_margin"), AXIS))
    return resolve_sign(best, planes)


def resolve_sign(best: DataFrame, planes: DataFrame) -> DataFrame:
    """Which end of the chosen axis is the floor: a weighted vote of up to six kinds of evidence."""
    a = vec.cols("ax", "ay", "az")
    c = vec.dot(vec.cols(*N), a)
    fam = planes.join(best.select("scan_id", "ax", "ay", "az"), "scan_id").withColumns({"_c": c, "_w": plane_weight()}).where(F.abs("_c") >= math.cos(math.radians(K.HORIZONTAL_TOL_DEG)))
    fam = fam.where(F.col("_w") > 0).select("scan_id", "plane_id", "_w", (F.col("plane_offset") / F.col("_c")).alias("_h"))
    from .sampling import top_by

    two = top_by(fam, ["scan_id"], [F.desc("_w"), "plane_id"], 2).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("_k"), F.min(F.struct("_h", "_w"))["_w"].alias("_wl"), F.max(F.struct("_h", "_w"))["_w"].alias("_wh")
    )
    rows = best.join(two, "scan_id", "left")
    rows = cut_lineage(rows)
    el, eh = F.abs(F.col("cam_t") - F.col("lo") - K.CAMERA_HEIGHT_M), F.abs(F.col("hi") - F.col("cam_t") - K.CAMERA_HEIGHT_M)
    votes = {
        "hint": F.col("_hint"), "band": F.col("band"), "mass": F.col("free"), "contact": F.col("low_contact") - F.col("high_contact"),
        "coverage": F.when(F.col("_k") == 2, (F.col("_wl") - F.col("_wh")) / (F.col("_wl") + F.col("_wh"))),
        "camera": F.when((F.col("cams") >= 8) & (el + eh > 1e-6), (eh - el) / (eh + el)),
    }
    rows = rows.withColumns({f"v_{n}": v for n, v in votes.items()})
    total = sum(F.when(F.col(f"v_{n}").isNotNull(), w).otherwise(0.0) for n, w in K.SIGN_WEIGHTS.items())
    vote = sum(F.coalesce(F.col(f"v_{n}"), F.lit(0.0)) * w for n, w in K.SIGN_WEIGHTS.items())
    rows = rows.withColumns({"_vote": vote, "_total": total})
    sign = F.when(F.col("_vote") >= 0, 1.0).otherwise(-1.0)
    flat = F.col("hi") - F.col("lo") <= 0
    return rows.select(
        "scan_id", "axis", *[F.when(flat, F.col(f"a{d}")).otherwise(F.col(f"a{d}") * sign).alias(f"u{d}") for d in "xyz"], "axis_margin",
        F.when(flat, 0.0).otherwise(F.abs("_vote") / F.col("_total")).alias("sign_margin"),
    )


def _up_planes(ups: DataFrame, planes: DataFrame) -> DataFrame:
    rows = planes.join(ups.select("scan_id", "ux", "uy", "uz"), "scan_id").withColumns({"_c": vec.dot(vec.cols(*N), vec.cols("ux", "uy", "uz")), "_w": plane_weight()})
    return rows.where(F.col("_w") > 0)


def refine_on_floor(ups: DataFrame, planes: DataFrame) -> DataFrame:
    """Level up on the heaviest horizontal plane when it disagrees no more than half a degree, or than the walls scatter."""
    rows = _up_planes(ups, planes)
    horiz = rows.where(F.abs("_c") >= math.cos(math.radians(K.HORIZONTAL_TOL_DEG)))
    best = horiz.groupBy("scan_id").agg(F.max(F.struct("_w", (-F.col("plane_id")).alias("o"), *N, "_c")).alias("b"))
    tilt = F.degrees(F.asin(F.least(F.lit(1.0), F.abs("_c"))))
    walls = rows.where(F.abs("_c") <= math.sin(math.radians(K.WALL_TOL_DEG))).groupBy("scan_id").agg(F.sqrt(F.sum(F.col("_w") * tilt * tilt) / F.sum("_w")).alias("_scatter"), F.count(F.lit(1)).alias("_k"))
    out = ups.join(best, "scan_id", "left").join(walls, "scan_id", "left")
    # least() passes over nulls, so a scan without such a plane must not look level
    swing = F.when(F.col("b").isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.col("b")["_c"])))))
    room = F.when(F.col("_k") >= 2, vec.clip(F.col("_scatter"), K.REFINE_MAX_DEG, K.REFINE_MAX_TOLERANCE_DEG)).otherwise(K.REFINE_MAX_DEG)
    out = out.withColumns({"swing_deg": swing, "_tol": F.coalesce(room, F.lit(K.REFINE_MAX_DEG))})
    take = F.coalesce(F.col("swing_deg") <= F.col("_tol"), F.lit(False))
    sign = F.when(F.col("b")["_c"] < 0, -1.0).otherwise(1.0)
    new = {f"u{d}": F.when(take, F.col("b")[f"n{d}"] * sign).otherwise(F.col(f"u{d}")) for d in "xyz"}
    return out.withColumns(new).drop("b", "_scatter", "_k", "_tol")


def wall_planes(ups: DataFrame, planes: DataFrame, share: float) -> DataFrame:
    """Near-vertical planes with at least a share of the heaviest one's weight."""
    rows = _up_planes(ups, planes).where(F.abs("_c") <= math.sin(math.radians(K.WALL_TOL_DEG)))
    top = rows.groupBy("scan_id").agg(F.max("_w").alias("_top"))
    return rows.join(top, "scan_id").where(F.col("_w") >= share * F.col("_top")).drop("_top")


def find_yaw(ups: DataFrame, planes: DataFrame) -> DataFrame:
    """Rotation about up that squares the walls with the axes (radians), from the fourfold circular mean of their directions."""
    rows = wall_planes(ups, planes, K.YAW_MIN_REL_WEIGHT)
    u, n = vec.cols("ux", "uy", "uz"), vec.cols(*N)
    level = cut_lineage(add_rotation(ups.select("scan_id", "ux", "uy", "uz"), u, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], "_t"))
    rows = rows.join(level.drop("ux", "uy", "uz"), "scan_id")
    rows = rows.withColumns({"_mx": vec.dot(vec.cols("_t0", "_t1", "_t2"), n), "_my": vec.dot(vec.cols("_t3", "_t4", "_t5"), n)}).where(F.hypot("_mx", "_my") >= 1e-9).withColumn("_t", 4.0 * F.atan2("_my", "_mx"))
    out = rows.groupBy("scan_id").agg(F.sum(F.col("_w") * F.sin("_t")).alias("_s"), F.sum(F.col("_w") * F.cos("_t")).alias("_c"), F.count(F.lit(1)).alias("walls"))
    out = ups.select("scan_id").join(out, "scan_id", "left").fillna(0.0, ["_s", "_c"]).fillna(0, ["walls"])
    none = F.abs("_s") + F.abs("_c") < 1e-12
    return out.select("scan_id", F.when(none, 0.0).otherwise(-F.atan2("_s", "_c") / 4.0).alias("yaw"), F.when(none, F.lit(0).cast("long")).otherwise(F.col("walls")).alias("walls"))


def yaw_residual(planes: DataFrame) -> DataFrame:
    """Area-weighted RMS angle of the canonical walls from the axes, degrees."""
    up = planes.select("scan_id").distinct().select("scan_id", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    t = 4.0 * F.atan2("ny", "nx")
    d = F.degrees(F.atan2(F.sin(t), F.cos(t)) / 4.0)
    rows = wall_planes(up, planes, K.YAW_RESIDUAL_MIN_REL_WEIGHT).withColumn("_d", d)
    return rows.groupBy("scan_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_d") * F.col("_d")) / F.sum("_w")).alias("yaw_residual_deg"))


def choose_quadrant(points: DataFrame, footprint: DataFrame) -> DataFrame:
    """Quarter turns that put the long side on X and the fuller half toward +X, the turned centre, and whether it was clear."""
    q = {f"{n}{a}": v for a in "xy" for n, v in (("lo_", 0.002), ("hi_", 0.998))}

    def spans(df, prefix):
        out = None
        for a in "xy":
            s = percentiles(df, ["scan_id"], F.col(a), {f"{prefix}lo_{a}": q[f"lo_{a}"], f"{prefix}hi_{a}": q[f"hi_{a}"]})
            out = s if out is None else out.join(s, "scan_id")
        return out

    rows = spans(points, "s").join(spans(footprint, "f"), "scan_id").join(points.groupBy("scan_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), "scan_id")
    rows = rows.withColumns({"ex": F.col("shi_x") - F.col("slo_x"), "ey": F.col("shi_y") - F.col("slo_y"), "cx": 0.5 * (F.col("flo_x") + F.col("fhi_x")), "cy": 0.5 * (F.col("flo_y") + F.col("fhi_y"))})
    turn = F.col("ex") < F.col("ey")
    dx, dy = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    rows = rows.withColumns({"_q": F.when(turn, 1).otherwise(0), "_sx": F.when(turn, -dy).otherwise(dx), "_sy": F.when(turn, dx).otherwise(dy), "_dead": K.SKEW_DEADBAND * F.greatest("ex", "ey", F.lit(1e-9))})
    wide = F.abs("_sx") > F.col("_dead")
    flip = F.when(wide, F.col("_sx") < 0).otherwise(F.col("_sy") < 0)
    rows = rows.withColumns({"quarter": ((F.col("_q") + F.when(flip, 2).otherwise(0)) % 4).cast("long"), "decisive": wide | (F.abs("_sy") > F.col("_dead"))})
    cx, cy = F.col("cx"), F.col("cy")
    tx = F.when(F.col("quarter") == 0, cx).when(F.col("quarter") == 1, -cy).when(F.col("quarter") == 2, -cx).otherwise(cy)
    ty = F.when(F.col("quarter") == 0, cy).when(F.col("quarter") == 1, cx).when(F.col("quarter") == 2, -cy).otherwise(-cx)
    return rows.select("scan_id", "quarter", tx.alias("centre_x"), ty.alias("centre_y"), "decisive")


def ground_residual(points: DataFrame) -> DataFrame:
    """Floor tilt re-derived from low column picks, without any plane: ``scan_id, up_residual_deg, ground_cells``.

    Null where too little floor shows, or what shows is not flat.
    """
    key = ["scan_id", "i", "j"]
    box = points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("x0"), F.min("y").alias("y0")).where(F.col("_n") >= 256)
    span = percentiles(points, ["scan_id"], F.col("z"), {"_a": 0.001, "_b": 0.999}).where(F.col("_b") > F.col("_a"))
    rows = points.select("scan_id", *P).join(box.join(span, "scan_id"), "scan_id")
    rows = cut_lineage(rows.select("scan_id", *P, "_a", "_b", vec.cell(F.col("x"), F.col("x0"), K.GROUND_CELL_M).alias("i"), vec.cell(F.col("y"), F.col("y0"), K.GROUND_CELL_M).alias("j")))
    pick = ranked_value(rows, key, F.col("z"), F.least(F.floor(F.col("_n") * K.GROUND_QUANTILE), F.col("_n") - 1), "bottom")
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.first("_b").alias("_b"), F.first("_a").alias("_a")).join(pick, key)
    level = percentiles(cells, ["scan_id"], F.col("bottom"), {"_level": 0.10})
    reach = F.greatest(F.lit(0.20), F.least(F.lit(1.0), 0.35 * (F.col("_b") - F.col("_a"))))
    good = cut_lineage(cells.join(level, "scan_id").where((F.col("c") >= 4) & (F.col("bottom") <= F.col("_level") + reach)).select(*key, "bottom"))
    n_cells = good.groupBy("scan_id").agg(F.count(F.lit(1)).alias("ground_cells"))
    floor = rows.join(good, key).where(F.col("z") <= F.col("bottom") + K.GROUND_TRIM_M).select("scan_id", *P)
    enough = floor.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_f")).join(n_cells, "scan_id").where((F.col("_f") >= 64) & (F.col("ground_cells") >= 12)).select("scan_id")
    floor = cut_lineage(floor.join(enough, "scan_id", "left_semi"))

    def residuals(df, fit):
        d = vec.dot(vec.cols(*P), vec.cols("nx", "ny", "nz")) - F.col("plane_offset")
        out = df.join(fit.drop("n"), "scan_id").withColumn("_r", d)
        med = percentiles(out, ["scan_id"], F.col("_r"), {"_m": 0.5})
        mad = percentiles(out.join(med, "scan_id"), ["scan_id"], F.abs(F.col("_r") - F.col("_m")), {"_mad": 0.5})
        return out, mad.select("scan_id", (1.4826 * F.col("_mad")).alias("sigma"))

    fit = cut_lineage(fit_plane(floor, ["scan_id"]))
    rows1, sigma = residuals(floor, fit)
    kept = rows1.join(sigma, "scan_id").where(F.abs("_r") < F.greatest(3.0 * F.col("sigma"), F.lit(0.005)))
    many = kept.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 64).select("scan_id")
    trimmed = kept.join(many, "scan_id", "left_semi").select("scan_id", *P).union(floor.join(many, "scan_id", "left_anti"))
    trimmed = cut_lineage(trimmed)
    fit = cut_lineage(fit_plane(trimmed, ["scan_id"]))
    _, sigma = residuals(trimmed, fit)
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz"))))
    done = fit.join(sigma, "scan_id").select("scan_id", F.when(F.col("sigma") <= K.GROUND_MAX_SCATTER_M, angle).alias("up_residual_deg"))
    return points.select("scan_id").distinct().join(done, "scan_id", "left").join(n_cells, "scan_id", "left").fillna(0, ["ground_cells"])

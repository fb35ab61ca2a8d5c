"""Tables that come from a video sweep: frames, windows of poses, and the scale estimates that make them metric."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vec
from ..functions.linalg import nearest_rotation
from ..functions.stats import percentiles, row_index
from ..session import cut_lineage
from .transforms import camera_centres


def sharpest_frame_per_bucket(frames: DataFrame, count: int) -> DataFrame:
    """Split each sweep into ``count`` equal slices and keep the sharpest frame of each (the earliest of equals).

    A sweep with no more frames than slices keeps them all.
    """
    idx = row_index(frames, ["sweep_id"], ["frame_id"])
    n = F.col("total")
    b = F.floor((F.col("idx") + 0.5) * count / n)
    # slice edges are rounded half to even, so a frame may sit one slice off the straight division
    def edge(k):
        return F.rint(n * k / count).cast("long")

    b = F.when(F.col("idx") < edge(b), b - 1).when(F.col("idx") >= edge(b + 1), b + 1).otherwise(b)
    idx = idx.withColumn("bucket", F.when(n <= count, F.col("idx")).otherwise(b))
    best = idx.groupBy("sweep_id", "bucket").agg(F.max(F.struct("sharpness", (-F.col("idx")).alias("o"), "frame_id"))["frame_id"].alias("frame_id"))
    return frames.join(best, ["sweep_id", "frame_id"])


def blur_flags(frames: DataFrame, ratio: float = K.BLUR_WARN_RATIO) -> DataFrame:
    """Sharpness relative to the sweep's sharpest frame, and whether it is low enough to warn about."""
    best = frames.groupBy("sweep_id").agg(F.max("sharpness").alias("_best"))
    rel = F.when(F.col("_best") > 0, F.col("sharpness") / F.col("_best")).otherwise(1.0)
    return frames.join(best, "sweep_id").withColumn("ratio", rel).withColumn("blurry", F.col("ratio") < ratio).drop("_best")


def overlap_windows(sweeps: DataFrame, chunk: int = K.WINDOW_SIZE, overlap: int = K.WINDOW_OVERLAP) -> DataFrame:
    """Index ranges [lo, hi) of overlapping solve windows per sweep (``sweep_id, n``); the last one is pulled back."""
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    stride = chunk - min(max(overlap, 0), chunk - 1)
    last = F.greatest(F.ceil((F.col("n") - chunk) / stride), F.lit(0))
    rows = sweeps.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    end = F.col("w") * stride + chunk >= F.col("n")
    lo = F.when(end, F.greatest(F.col("n") - chunk, F.lit(0))).otherwise(F.col("w") * stride)
    return rows.select("sweep_id", "w", lo.cast("long").alias("lo"), F.least(F.when(end, F.col("n")).otherwise(F.col("w") * stride + chunk), F.col("n")).cast("long").alias("hi"))


def window_frames(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames of every window; a frame in an overlap belongs to both."""
    idx = row_index(frames, ["sweep_id"], ["frame_id"]).drop("total")
    span = windows.select("sweep_id", "w", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx"))
    return idx.join(span, ["sweep_id", "idx"])


def up_from_cameras(poses: DataFrame, floor: float = K.UP_COHERENCE_FLOOR) -> DataFrame:
    """Mean camera-up per scan and how well the frames agree; withheld (null) when they do not."""
    down = [F.col("r")[3], F.col("r")[4], F.col("r")[5]]
    rows = poses.withColumns({f"_d{a}": d for a, d in zip("xyz", down)}).withColumn("_l", vec.norm(vec.cols("_dx", "_dy", "_dz"))).where(F.col("_l") > 1e-9)
    mean = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(-F.col(f"_d{a}") / F.col("_l")).alias(f"m{a}") for a in "xyz"])
    mean = mean.where(F.col("_n") >= 2).withColumn("coherence", vec.norm(vec.cols("mx", "my", "mz")))
    ok = F.col("coherence") >= floor
    return mean.select("scan_id", "coherence", *[F.when(ok, F.col(f"m{a}") / F.col("coherence")).alias(f"up_{a}") for a in "xyz"])


def confidence_of(log_sigma: Column) -> Column:
    return vec.clip(1.0 - F.expm1(F.greatest(log_sigma, F.lit(0.0))) / 0.30, 0.05, 0.95)


def solve_scale(pixels: DataFrame, minimum: int = 500, conf_quantile: float = 0.5) -> DataFrame:
    """Metres per reconstruction unit from paired depths: median log ratio per frame, frames that scatter too much
    rejected, median over the rest; spread is the larger of between-frame scatter and a quarter of the within."""
    key = ["scan_id", "frame_id"]
    cut = percentiles(pixels, key, F.col("conf"), {"_cut": conf_quantile})
    m, r = F.col("metric_depth"), F.col("recon_depth")
    ok = (m > K.MIN_VALID_M) & (m < K.MAX_VALID_M) & (r > 1e-6) & ~F.isnan(m) & ~F.isnan(r) & (r < float("inf")) & F.coalesce(F.col("conf") >= F.col("_cut"), F.lit(True))
    rows = pixels.join(cut, key, "left").where(ok).select(*key, F.ln(m / r).alias("_q"))
    enough = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    rows = cut_lineage(rows.join(enough.select(*key), key, "left_semi"))
    med = percentiles(rows, key, F.col("_q"), {"med": 0.5})
    mad = percentiles(rows.join(med, key), key, F.abs(F.col("_q") - F.col("med")), {"_mad": 0.5})
    per = cut_lineage(med.join(mad, key).withColumn("spread", 1.4826 * F.col("_mad")))
    used = per.where(F.col("spread") <= K.MAX_FRAME_LOG_SPREAD)
    total = pixels.select(*key).distinct().groupBy("scan_id").agg(F.count(F.lit(1)).alias("frames"))
    mid = used.groupBy("scan_id").agg(F.count(F.lit(1)).alias("frames_used"), F.percentile("med", 0.5).alias("log_factor"), F.percentile("spread", 0.5).alias("within"))
    between = used.join(mid, "scan_id").groupBy("scan_id").agg((1.4826 * F.percentile(F.abs(F.col("med") - F.col("log_factor")), 0.5)).alias("between"))
    out = mid.join(between, "scan_id").join(total, "scan_id")
    across = F.when(F.col("frames_used") > 1, F.col("between")).otherwise(F.col("within"))
    out = out.withColumn("log_spread", F.greatest(across, 0.25 * F.col("within")))
    return out.select(
        "scan_id", F.lit("metric-depth").alias("source"), F.exp("log_factor").alias("factor"), "log_spread", F.lit(math.log(K.DEPTH_PRIOR_BIAS)).alias("prior_bias"),
        confidence_of(F.col("log_spread")).alias("confidence"), "frames_used", (F.col("frames") - F.col("frames_used")).alias("frames_rejected"),
    )


def scale_from_camera_height(points: DataFrame, cameras: DataFrame, ups: DataFrame, minimum: int = 1000) -> DataFrame:
    """Scale that puts the median camera 1.55 m over the floor, along the given up; no row where it cannot be trusted."""
    def along(df):
        t = vec.dot(vec.cols("x", "y", "z"), vec.cols("ux", "uy", "uz"))
        axis = ups.select("scan_id", *[F.col(f"up_{a}").alias(f"u{a}") for a in "xyz"]).where(vec.norm(vec.cols("ux", "uy", "uz")) >= 1e-9)
        rows = df.join(axis, "scan_id").select("scan_id", (t / vec.norm(vec.cols("ux", "uy", "uz"))).alias("t"))
        return rows.where(~F.isnan("t") & (F.abs("t") < float("inf")))

    p, c = along(points), along(cameras)
    n = p.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_np")).join(c.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_nc")), "scan_id")
    n = n.where((F.col("_np") >= minimum) & (F.col("_nc") >= 2))
    q = percentiles(p, ["scan_id"], F.col("t"), {"_floor": 0.01, "_top": 0.995})
    mid = percentiles(c, ["scan_id"], F.col("t"), {"_cam": 0.5})
    out = n.join(q, "scan_id").join(mid, "scan_id").withColumn("_h", F.col("_cam") - F.col("_floor"))
    span = F.col("_top") - F.col("_floor")
    out = out.where((span > 0) & (F.col("_h") > 0)).withColumn("fraction", F.col("_h") / span).where(F.col("fraction").between(K.CAMERA_FRACTION_LOW, K.CAMERA_FRACTION_HIGH))
    bias = math.log(K.PERSON_CAMERA_BIAS)
    return out.select(
        "scan_id", F.lit("camera-height").alias("source"), (K.PERSON_CAMERA_HEIGHT_M / F.col("_h")).alias("factor"), F.lit(0.0).alias("log_spread"), F.lit(bias).alias("prior_bias"),
        confidence_of(F.lit(bias)).alias("confidence"), F.col("_nc").alias("frames_used"), F.lit(0).cast("long").alias("frames_rejected"),
    )


def scale_from_doors(openings: DataFrame, factors: DataFrame) -> DataFrame:
    """Scale that makes the median door 2.03 m tall, from openings shaped like doors (``factors``: scan_id, factor)."""
    h, w = F.col("height"), F.col("width")
    doors = openings.where(
        (h > 0) & (w > 0) & (F.col("confidence") >= K.DOOR_MIN_CONFIDENCE) & (F.col("sill_height") <= K.DOOR_MAX_SILL_RATIO * h)
        & (h / F.nullif(w, F.lit(0.0))).between(K.DOOR_MIN_ASPECT, K.DOOR_MAX_ASPECT)
    )
    mid = percentiles(doors, ["scan_id"], h, {"_h": 0.5}).join(percentiles(doors, ["scan_id"], F.ln(K.DOOR_HEIGHT_M / h), {"_l": 0.5}), "scan_id")
    off = doors.join(mid, "scan_id")
    mad = percentiles(off, ["scan_id"], F.abs(F.ln(K.DOOR_HEIGHT_M / h) - F.col("_l")), {"_mad": 0.5})
    n = doors.groupBy("scan_id").agg(F.count(F.lit(1)).alias("frames_used"))
    out = mid.join(mad, "scan_id").join(n, "scan_id").join(factors.select("scan_id", F.col("factor").alias("_f")), "scan_id")
    spread = F.when(F.col("frames_used") > 1, 1.4826 * F.col("_mad")).otherwise(0.0)
    bias = math.log(K.DOOR_BIAS)
    return out.withColumn("log_spread", spread).select(
        "scan_id", F.lit("door-height").alias("source"), (F.col("_f") * K.DOOR_HEIGHT_M / F.col("_h")).alias("factor"), "log_spread", F.lit(bias).alias("prior_bias"),
        confidence_of(F.hypot(F.col("log_spread"), F.lit(bias))).alias("confidence"), "frames_used", F.lit(0).cast("long").alias("frames_rejected"),
    )


def combine_scales(estimates: DataFrame) -> DataFrame:
    """Inverse-variance mean of the estimates in log space; disagreement beyond their error bars widens the result."""
    e = estimates.where(F.col("factor") > 0).withColumn("_s", F.hypot(F.col("log_spread"), F.col("prior_bias")))
    e = e.withColumn("_sig", F.greatest("_s", F.lit(1e-6))).withColumns({"_w": 1.0 / (F.col("_sig") * F.col("_sig")), "_y": F.ln("factor")})
    mean = e.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_total"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("mu"), F.first("_s").alias("_only"), F.first("source").alias("_src"), F.max("frames_used").alias("frames_used")
    )
    chi = e.join(mean, "scan_id").groupBy("scan_id").agg(F.sum(F.col("_w") * (F.col("_y") - F.col("mu")) * (F.col("_y") - F.col("mu"))).alias("_chi2"))
    out = mean.join(chi, "scan_id")
    many = F.col("n") > 1
    widen = F.when(many, F.greatest(F.lit(1.0), F.sqrt(F.col("_chi2") / F.nullif(F.col("n") - 1, F.lit(0))))).otherwise(1.0)
    out = out.withColumn("inflation", widen).withColumn("log_spread", F.when(many, F.col("inflation") / F.sqrt("_total")).otherwise(F.col("_only")))
    return out.select(
        "scan_id", F.when(many, "combined").otherwise(F.col("_src")).alias("source"), F.exp("mu").alias("factor"), "log_spread", confidence_of(F.col("log_spread")).alias("confidence"),
        "inflation", F.col("n").alias("estimators"), "frames_used",
    )


def register_windows(poses: DataFrame) -> DataFrame:
    """Similarity from each window into the one before it, from the frames both hold (``scan_id, w, frame_id, r, t``).

    Rotation comes from the orientations, scale from the spreads of the centres; the residual is their mean distance
    afterwards. ``w`` is the later window; pairs sharing too few frames have no row.
    """
    at = camera_centres(poses).select("scan_id", "w", "frame_id", "r", "cx", "cy", "cz")
    a = at.select("scan_id", (F.col("w") + 1).alias("w"), "frame_id", F.col("r").alias("ra"), *[F.col(f"c{x}").alias(f"a{x}") for x in "xyz"])
    pair = at.withColumnsRenamed({"r": "rb", "cx": "bx", "cy": "by", "cz": "bz"}).join(a, ["scan_id", "w", "frame_id"])
    key = ["scan_id", "w"]
    # sum over frames of Ra' Rb, entry (i, j) = sum_k ra[3k+i] rb[3k+j]
    acc = [F.sum(sum(F.col("ra")[3 * k + i] * F.col("rb")[3 * k + j] for k in range(3))).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    mean = pair.groupBy(*key).agg(F.count(F.lit(1)).alias("shared"), *acc, *[F.avg(f"{s}{x}").alias(f"{s}m{x}") for s in "ab" for x in "xyz"])
    mean = mean.where(F.col("shared") >= K.MIN_SHARED_FRAMES)
    centred = pair.join(mean.select(*key, *[f"{s}m{x}" for s in "ab" for x in "xyz"]), key)
    spread = centred.groupBy(*key).agg(*[F.sum(sum((F.col(f"{s}{x}") - F.col(f"{s}m{x}")) ** 2 for x in "xyz")).alias(f"v{s}") for s in "ab"])
    sim = mean.join(spread, key).withColumn("rot", nearest_rotation(F.array(*[F.col(f"m{i}{j}") for i in range(3) for j in range(3)])))
    sim = sim.withColumn("scale", F.when(F.col("vb") > 1e-18, F.sqrt(F.col("va") / F.col("vb"))).otherwise(1.0))
    turned = [sum(F.col("rot")[3 * i + j] * F.col(f"bm{x}") for j, x in enumerate("xyz")) for i in range(3)]
    sim = sim.withColumn("shift", F.array(*[F.col(f"am{x}") - F.col("scale") * t for x, t in zip("xyz", turned)])).select(*key, "shared", "scale", "rot", "shift")
    sim = cut_lineage(sim)
    moved = pair.join(sim, key)
    gap = [F.col("scale") * sum(F.col("rot")[3 * i + j] * F.col(f"b{y}") for j, y in enumerate("xyz")) + F.col("shift")[i] - F.col(f"a{x}") for i, x in enumerate("xyz")]
    res = moved.groupBy(*key).agg(F.avg(vec.norm(gap)).alias("residual_m"))
    return sim.join(res, key)


def compose_windows(similarities: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window's similarity into the first window's frame, and the worst join on the way.

    Joins are chained in window order per scan; the chain stops at the first window that could not be registered. A scan
    has few windows, so the fold runs over one short array of reduced rows.
    """
    first = windows.groupBy("scan_id").agg(F.min("w").alias("_w0"))
    eye = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)"
    start = f"named_struct('w', _w0, 's', 1D, 'r', {eye}, 't', array(0D, 0D, 0D), 'res', 0D)"
    lists = similarities.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("w", "scale", "rot", "shift", "residual_m"))).alias("steps"))
    mul = "array(" + ", ".join("p.r[{0}]*x.rot[{1}]+p.r[{2}]*x.rot[{3}]+p.r[{4}]*x.rot[{5}]".format(3 * i, j, 3 * i + 1, 3 + j, 3 * i + 2, 6 + j) for i in range(3) for j in range(3)) + ")"
    move = "array(" + ", ".join(f"p.s*(p.r[{3 * i}]*x.shift[0]+p.r[{3 * i + 1}]*x.shift[1]+p.r[{3 * i + 2}]*x.shift[2])+p.t[{i}]" for i in range(3)) + ")"
    step = f"transform(array(element_at(acc, -1)), p -> named_struct('w', x.w, 's', p.s*x.scale, 'r', {mul}, 't', {move}, 'res', greatest(p.res, x.residual_m)))"
    chain = F.expr(f"aggregate(coalesce(steps, array()), array({start}), (acc, x) -> IF(x.w = element_at(acc, -1).w + 1, concat(acc, {step}), acc))")
    out = first.join(lists, "scan_id", "left").select("scan_id", F.inline(chain))
    return out.select("scan_id", "w", F.col("s").alias("scale"), F.col("r").alias("rot"), F.col("t").alias("shift"), F.col("res").alias("worst_residual_m"))


def similarity_matrix() -> Column:
    """The 4x4 of a (scale, rot, shift) row, for transform_points."""
    rows = [[F.col("scale") * F.col("rot")[3 * i + j] for j in range(3)] + [F.col("shift")[i]] for i in range(3)]
    return F.array(*[c for row in rows for c in row], *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def merge_windows(points: DataFrame, composed: DataFrame) -> DataFrame:
    """Points of all windows (``scan_id, w, ...``) in the first window's frame; windows off the chain are dropped."""
    m = composed.select("scan_id", "w", similarity_matrix().alias("m"))
    rows = points.join(m, ["scan_id", "w"])
    moved = [F.col("m")[4 * i] * F.col("x") + F.col("m")[4 * i + 1] * F.col("y") + F.col("m")[4 * i + 2] * F.col("z") + F.col("m")[4 * i + 3] for i in range(3)]
    return rows.withColumns(dict(zip("xyz", moved))).drop("m")

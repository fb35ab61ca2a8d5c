"""Floor maps: for every square of floor, is it inside, was it surveyed, how high and how wide is it clear."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import optics, vec
from ..functions.stats import percentiles, ranked_value
from ..session import cut_lineage
from .polygons import point_in_polygon

CELL = ["scan_id", "i", "j"]


def floor_frames(points: DataFrame, scans: DataFrame, cell: float = K.FLOOR_CELL_M) -> DataFrame:
    """Per scan: map origin and size, floor and ceiling level. Scans without points have no map."""
    box = points.groupBy("scan_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    n = [F.greatest(F.ceil((F.col(f"_{a}1") - F.col(f"{a}0")) / cell), F.lit(1)).alias(f"n{a}") for a in "xy"]
    out = box.select("scan_id", "x0", "y0", *n, F.lit(cell).alias("cell"))
    return out.join(scans.select("scan_id", "floor_z", "ceiling_z"), "scan_id")


def map_cell(x: Column, y: Column) -> dict[str, Column]:
    """Cell of a position, clipped to the map."""
    return {
        "i": vec.clip(vec.cell(x, F.col("x0"), F.col("cell")), 0, F.col("nx") - 1),
        "j": vec.clip(vec.cell(y, F.col("y0"), F.col("cell")), 0, F.col("ny") - 1),
    }


def floor_returns(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points as (cell, height above the floor)."""
    rows = points.select("scan_id", "x", "y", "z").join(frames, "scan_id")
    return rows.withColumns(map_cell(F.col("x"), F.col("y"))).select(*CELL, (F.col("z") - F.col("floor_z")).alias("h"))


def room_heights(returns: DataFrame, frames: DataFrame, quantile: float = 0.995) -> DataFrame:
    """Ceiling height per scan, or the 99.5th percentile of height where no ceiling was captured."""
    open_top = frames.where(F.col("ceiling_z").isNull()).select("scan_id")
    top = percentiles(returns.join(open_top, "scan_id", "left_semi"), ["scan_id"], F.col("h"), {"_top": quantile})
    return frames.join(top, "scan_id", "left").select("scan_id", F.coalesce(F.col("ceiling_z") - F.col("floor_z"), F.col("_top")).alias("room_h"))


def headroom_map(returns: DataFrame, heights: DataFrame) -> DataFrame:
    """Cells with something overhead: the lowest of at least four returns above body height, capped by the room."""
    low = returns.where(F.col("h") > K.BODY_HIGH_M).groupBy(*CELL).agg(F.min("h").alias("_low"), F.count(F.lit(1)).alias("_n"))
    solid = low.where(F.col("_n") >= K.MIN_RETURNS).join(heights, "scan_id")
    return solid.select(*CELL, F.least("room_h", "_low").alias("headroom_m"))


def floor_rise_map(returns: DataFrame) -> DataFrame:
    """A low pick of the returns near the floor: the value at sorted position floor(0.2 n) of at least four."""
    low = returns.where(F.col("h") < K.BODY_LOW_M)
    enough = low.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= K.MIN_RETURNS)
    return ranked_value(low.join(enough, CELL, "left_semi"), CELL, F.col("h"), F.floor(F.col("_n") * 0.2), "floor_rise_m")


def blocked_cells(returns: DataFrame) -> DataFrame:
    """Cells with at least four returns between knee and head height."""
    band = returns.where(F.col("h").between(K.BODY_LOW_M, K.BODY_HIGH_M))
    return band.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= K.MIN_RETURNS).select(*CELL)


def floor_cells(frames: DataFrame) -> DataFrame:
    """Every cell of every map with its centre. Rows are spread before columns, so a huge map is built by many tasks."""
    lines = frames.select("scan_id", "x0", "y0", "ny", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("i"))
    cells = lines.select("scan_id", "x0", "y0", "cell", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("j"))
    return cells.select(
        *CELL, (F.col("x0") + (F.col("i") + 0.5) * F.col("cell")).alias("x"), (F.col("y0") + (F.col("j") + 0.5) * F.col("cell")).alias("y")
    )


def lower_envelope(g2: np.ndarray) -> np.ndarray:
    """For each position j the minimum over k of g2[k] + (j - k)^2.

    The first k that gives the minimum never falls as j grows. So the positions are settled from the middle outwards, each looking only between
    the choices of its settled neighbours: every level looks at some len(g2) sums, and there are logarithmically many levels.
    """
    n, source = len(g2), np.flatnonzero(np.isfinite(g2))
    if not len(source):
        return np.full(n, np.inf)
    height = g2[source]
    best, choice = np.empty(n), np.zeros(n + 2, dtype=np.int64)  # choice[j + 1] is that of position j, between two posts
    choice[n + 1] = len(source) - 1
    step = 1 << (n - 1).bit_length()
    while step:
        # with posts at -1 and n, the positions half-way between those of the level before
        at = np.arange(step - 1, n, 2 * step)
        low, high = choice[at + 1 - step], choice[np.minimum(at + 1 + step, n + 1)]
        width = high - low + 1
        first = np.cumsum(width) - width
        k = np.arange(width.sum()) + np.repeat(low - first, width)
        cost = height[k] + (np.repeat(at, width) - source[k]).astype(float) ** 2
        best[at] = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == np.repeat(best[at], width))
        choice[at + 1] = k[hit[np.searchsorted(hit, first)]]
        step //= 2
    return best


#: Columns up to this length are solved side by side, by trying every distance.
SHORT = 64


def lower_envelopes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """:func:`lower_envelope` of each column. Short ones of one length share a matrix, as numpy takes as long for a few numbers as for some thousand."""
    out: list[np.ndarray] = [None] * len(columns)
    sizes = np.array([len(c) for c in columns])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n > SHORT:
            for k in at:
                out[k] = lower_envelope(columns[k])
            continue
        g2 = np.stack([columns[k] for k in at])
        best = g2.copy()
        for d in range(1, n):
            np.minimum(best[:, d:], g2[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], g2[:, d:] + d * d, out=best[:, :-d])
        for k, row in zip(at, best):
            out[k] = row
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _min_parabola(g2: pd.Series) -> pd.Series:
    return pd.Series(lower_envelopes([np.asarray(values, dtype=float) for values in g2]))


def clearance_map(frames: DataFrame, blocked: DataFrame) -> DataFrame:
    """Exact distance from each floor cell to the nearest blocked one; a scan with none gets its longer side.

    The distance transform is separable. Along i it is two running lookups (nearest blocked cell before and after);
    along j it is the lower envelope of parabolas over one map column, an array no longer than the map is wide.
    """
    cells = floor_cells(frames).select(*CELL).join(blocked.select(*CELL, F.col("i").alias("_b")), CELL, "left")
    line = Window.partitionBy("scan_id", "j").orderBy("i")
    before = F.last("_b", True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_b", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("i") - before, after - F.col("i")).cast("double")
    g2 = F.coalesce(gap * gap, F.lit(float("inf")))
    columns = cells.select(*CELL, g2.alias("g2")).groupBy("scan_id", "i").agg(F.sort_array(F.collect_list(F.struct("j", "g2"))).alias("_c"))
    solved = columns.select("scan_id", "i", F.posexplode(_min_parabola(F.col("_c.g2"))).alias("j", "_d2"))
    size = frames.select("scan_id", "cell", F.greatest("nx", "ny").alias("_side"))
    far = F.when(F.col("_d2") == float("inf"), F.col("_side") * F.col("cell")).otherwise(F.sqrt("_d2") * F.col("cell"))
    return solved.join(size, "scan_id").select("scan_id", "i", F.col("j").cast("long").alias("j"), far.alias("clearance_m"))


def floor_maps(
    points: DataFrame, scans: DataFrame, footprint: DataFrame | None = None, capture: DataFrame | None = None, cell: float = K.FLOOR_CELL_M
) -> DataFrame:
    """All five maps, one row per floor cell: inside, surveyed, headroom_m, clearance_m, floor_rise_m (null unseen). What several maps read is written once."""
    frames = cut_lineage(floor_frames(points, scans, cell))
    returns = cut_lineage(floor_returns(points, frames))
    heights = cut_lineage(room_heights(returns, frames))
    cells = floor_cells(frames)
    out = cells
    for name, edges, default in (("inside", footprint, True), ("surveyed", capture, False)):
        if edges is None:
            out = out.withColumn(name, F.lit(default))
            continue
        hit = point_in_polygon(cells, edges, ["i", "j"]).withColumn(f"_{name}", F.lit(True))
        ring = edges.groupBy("scan_id").agg((F.count(F.lit(1)) >= 3).alias("_ring"))
        got = F.when(F.col("_ring"), F.coalesce(F.col(f"_{name}"), F.lit(False))).otherwise(F.lit(default))
        out = out.join(hit, CELL, "left").join(ring, "scan_id", "left").withColumn("_ring", F.coalesce("_ring", F.lit(False)))
        out = cut_lineage(out.withColumn(name, got).drop(f"_{name}", "_ring"))
    out = (
        out.join(headroom_map(returns, heights), CELL, "left")
        .join(heights, "scan_id")
        .join(clearance_map(frames, blocked_cells(returns)), CELL)
        .join(floor_rise_map(returns), CELL, "left")
    )
    return out.select(
        *CELL, "x", "y", "inside", "surveyed", F.coalesce("headroom_m", "room_h").alias("headroom_m"), "clearance_m", "floor_rise_m"
    )


def standable() -> Column:
    return F.col("inside") & (F.col("headroom_m") >= K.STANDING_HEADROOM_M) & (F.col("clearance_m") >= K.STANDING_RADIUS_M)


def workable_floor(maps: DataFrame, cell: float = K.FLOOR_CELL_M) -> DataFrame:
    """Area a person can stand and work in, and its share of the floor."""
    n = F.sum(F.when(standable(), 1).otherwise(0))
    inside = F.sum(F.when(F.col("inside"), 1).otherwise(0))
    return maps.groupBy("scan_id").agg(
        (n * (cell * cell)).alias("workable_m2"), (n / F.greatest(inside, F.lit(1))).alias("workable_fraction"), inside.alias("inside_cells"),
        F.coalesce(F.avg(F.when(F.col("inside"), F.col("surveyed").cast("double"))), F.lit(0.0)).alias("surveyed_fraction"),
    )


def gear_rows(kinds: list[str] | None = None) -> list[tuple]:
    rows = K.GEAR if kinds is None else [g for k in kinds for g in K.GEAR if g[2] == k]
    if not rows:
        raise ValueError(f"no gear of kind {kinds}")
    return rows


def gear_catalogue(spark) -> DataFrame:
    """The gear table with footprint area, swept footprint and the clear radius each item needs."""
    schema = "gear string, gear_name string, kind string, width_m double, length_m double, height_m double, lens_low_m double, lens_high_m double, working_m double, verified boolean"
    g = spark.createDataFrame(K.GEAR, schema)
    w, l, c = F.col("width_m"), F.col("length_m"), F.col("working_m")
    return g.withColumns({
        "area_m2": w * l, "swept_width_m": w + 2 * c, "swept_length_m": l + 2 * c, "radius_m": 0.5 * F.sqrt(w * w + l * l),
    })


def _gear_array(kinds: list[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(g[0]).alias("gear"), F.lit(0.5 * float(np.hypot(g[3], g[4]))).alias("radius_m"), F.lit(g[5]).alias("gear_height_m"), F.lit(g[9]).alias("verified"))
        for g in gear_rows(kinds)
    ])


def gear_fit_join(maps: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Every floor cell against the (fixed, ten-row) gear catalogue, with whether the item fits there."""
    rows = maps.select("*", F.inline(_gear_array(kinds or ["dolly", "support"])))
    need = F.least(F.col("gear_height_m"), F.lit(K.GRIP_HEADROOM_CAP_M))
    return rows.withColumn("fits", F.col("inside") & (F.col("clearance_m") >= F.col("radius_m")) & (F.col("headroom_m") >= need))


def equipment_fit(maps: DataFrame, cell: float = K.FLOOR_CELL_M, kinds: list[str] | None = None) -> DataFrame:
    """Per scan and item: area it fits in, how much of that was surveyed, best clearance and a verdict."""
    ok = F.col("fits")
    seen = ok & F.col("surveyed")
    count = F.sum(F.when(ok, 1).otherwise(0))
    count_seen = F.sum(F.when(seen, 1).otherwise(0))
    return gear_fit_join(maps, kinds).groupBy("scan_id", "gear").agg(
        F.max("radius_m").alias("radius_m"),
        (count * (cell * cell)).alias("area_m2"),
        (count_seen * (cell * cell)).alias("area_surveyed_m2"),
        F.coalesce(F.max(F.when(ok, F.col("clearance_m"))), F.lit(0.0)).alias("best_clearance_m"),
        F.when(count_seen > 0, F.lit("fits")).when(count > 0, F.lit("marginal")).otherwise(F.lit("does not fit")).alias("verdict"),
    )


def placements(
    maps: DataFrame, kinds: list[str] | None = None, min_headroom_m: float = K.STANDING_HEADROOM_M, surveyed_only: bool = False, limit: int | None = None
) -> DataFrame:
    """Positions where each item fits, most clearance first. ``limit`` keeps the best few per scan and item."""
    rows = maps.select("*", F.inline(_gear_array(kinds or ["dolly", "support"])))
    ok = F.col("inside") & (F.col("clearance_m") >= F.col("radius_m")) & (F.col("headroom_m") >= min_headroom_m)
    rows = rows.where(ok & F.col("surveyed") if surveyed_only else ok)
    note = F.when(~F.col("surveyed"), F.lit("not surveyed: rests on reconstructed geometry"))
    out = rows.select("scan_id", "gear", "i", "j", "x", "y", "clearance_m", "headroom_m", "surveyed", note.alias("note"))
    if limit is None:
        return out
    order = Window.partitionBy("scan_id", "gear").orderBy(F.desc("clearance_m"), "i", "j")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def sample_maps(requests: DataFrame, maps: DataFrame, frames: DataFrame, values: list[str]) -> DataFrame:
    """Map values at requested positions (``x, y``), clipped to the map's edge like a raster lookup."""
    at = requests.join(frames.select("scan_id", "x0", "y0", "nx", "ny", "cell"), "scan_id").withColumns(map_cell(F.col("x"), F.col("y")))
    return at.join(maps.select(*CELL, *values), CELL).drop("x0", "y0", "nx", "ny", "cell")


def fits_at(requests: DataFrame, maps: DataFrame, frames: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Whether each item fits at each requested position, by clearance alone."""
    rows = sample_maps(requests, maps, frames, ["clearance_m"]).select("*", F.inline(_gear_array(kinds or ["dolly", "support"])))
    return rows.withColumn("fits", F.col("clearance_m") >= F.col("radius_m"))


def lens_plan(maps: DataFrame, sensor: str = K.DEFAULT_SENSOR) -> DataFrame:
    """Longest clear run per scan and, per shot size, the focal length that holds it from there."""
    box = maps.where(standable()).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("_n"), *[f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xy"]
    )
    dx, dy = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    runs = box.where(F.col("_n") >= 2).select("scan_id", F.sqrt(dx * dx + dy * dy).alias("run_m"))
    shots = F.array(*[F.struct(F.lit(n).alias("shot"), F.lit(h).alias("framed_m")) for k, n, h in K.SHOTS if k not in ("ecu", "els")])
    h = optics.sensor_value(F.lit(sensor), 1)
    rows = runs.select("scan_id", "run_m", F.inline(shots)).withColumn("focal_mm", optics.focal_for(h, F.col("run_m"), F.col("framed_m")))
    rows = rows.withColumn("_prime", optics.nearest_prime(F.col("focal_mm")))
    covered = F.abs(F.col("focal_mm") - F.col("_prime")) <= K.PRIME_TOLERANCE * F.col("focal_mm")
    return rows.select(
        "scan_id", "shot", "run_m", "focal_mm", F.when(covered, F.col("_prime")).alias("prime_mm"), (~covered).alias("beyond_primes"),
        optics.distance_for(h, F.lit(K.WIDE_END_MM), F.col("framed_m")).alias("min_distance_m"),
    )


def rt60(scans: DataFrame, footprint: DataFrame, openings: DataFrame, points: DataFrame) -> DataFrame:
    """Sabine reverberation for the softest, typical and hardest finishes the room could have, and a verdict."""
    from .polygons import polygon_area

    no_ceiling = scans.where(F.col("ceiling_z").isNull() | (F.col("ceiling_z") <= F.col("floor_z"))).select("scan_id")
    top = percentiles(points.join(no_ceiling, "scan_id", "left_semi"), ["scan_id"], F.col("z"), {"_top": 0.995})
    cut = openings.groupBy("scan_id").agg(F.sum(F.col("width") * F.col("height")).alias("_open"))
    room = scans.join(polygon_area(footprint), "scan_id").where(F.col("area") > 0).join(top, "scan_id", "left").join(cut, "scan_id", "left")
    given = F.when(F.col("ceiling_z") > F.col("floor_z"), F.col("ceiling_z") - F.col("floor_z"))
    room = room.withColumn("height_m", F.coalesce(given, F.greatest(F.col("_top") - F.col("floor_z"), F.lit(0.1)))).withColumn("height_assumed", given.isNull())
    room = room.withColumn("wall_m2", F.col("perimeter") * F.col("height_m")).withColumn("_open", F.coalesce("_open", F.lit(0.0)))
    room = room.withColumn("openings_capped", F.col("_open") > K.OPENING_WALL_CAP * F.col("wall_m2"))
    room = room.withColumn("opening_m2", F.least(F.col("_open"), K.OPENING_WALL_CAP * F.col("wall_m2")))
    room = room.withColumn("volume_m3", F.col("area") * F.col("height_m"))
    solid = F.greatest(F.col("wall_m2") - F.col("opening_m2"), F.lit(0.0))
    for name, floor, wall, ceiling in K.FINISHES:
        total = F.col("area") * floor + solid * wall + F.col("area") * ceiling + F.col("opening_m2")
        room = room.withColumn(f"rt60_{name}_s", F.when(total <= 0, F.lit(float("inf"))).otherwise(K.SABINE * F.col("volume_m3") / total))
    verdict = (
        F.when(F.col("rt60_hardest_s") <= K.RT60_CLEAN_S, "clean").when(F.col("rt60_softest_s") >= K.RT60_PROBLEM_S, "problem")
        .when(F.col("rt60_softest_s") >= K.RT60_WORKABLE_S, "difficult").otherwise("depends on the finishes")
    )
    return room.select(
        "scan_id", "volume_m3", F.col("area").alias("floor_m2"), "wall_m2", "opening_m2",
        *[f"rt60_{n}_s" for n, *_ in K.FINISHES], "height_assumed", "openings_capped", verdict.alias("verdict"),
    )

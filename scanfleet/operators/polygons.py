"""Polygons as edge tables (scan_id, seq, x0, y0, x1, y1): containment, area, perimeter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIP_M = 0.25


def edges_of_ring(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges of a closed ring from its ordered vertices (``seq, x, y``), the last one back to the first."""
    keys = keys or ["scan_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"{a}1": F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) for a in "xy"}
    return vertices.withColumns(nxt).select(*keys, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def point_in_polygon(points: DataFrame, edges: DataFrame, keys: list[str], strip: float = STRIP_M) -> DataFrame:
    """Keys of the points inside their scan's polygon, by even-odd crossings.

    Edges are indexed by horizontal strip, so a point only meets the edges at its own height, and the join is an
    equi-join on (scan, strip) that spreads one scan over many tasks.
    """
    e = edges.where(F.col("y0") != F.col("y1")).select(
        "scan_id", "x0", "y0", "x1", "y1",
        F.explode(F.sequence(F.floor(F.least("y0", "y1") / strip), F.floor(F.greatest("y0", "y1") / strip))).alias("_strip"),
    )
    p = points.select("scan_id", *keys, F.col("x").alias("_px"), F.col("y").alias("_py"), F.floor(F.col("y") / strip).alias("_strip"))
    straddles = (F.col("y0") > F.col("_py")) != (F.col("y1") > F.col("_py"))
    cross_x = (F.col("x1") - F.col("x0")) * (F.col("_py") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    return (
        p.join(e, ["scan_id", "_strip"]).where(straddles & (F.col("_px") < cross_x))
        .groupBy("scan_id", *keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1).select("scan_id", *keys)
    )


def cells_inside(edges: DataFrame, lattices: DataFrame) -> DataFrame:
    """``scan_id, i, j`` of the lattice cells whose centre lies inside their scan's polygon, by even-odd crossings.

    ``lattices``: scan_id, x0, y0, cell, ni, nj. The polygon is drawn row by row: where its edges cross a row's centre line, sorted, every second stretch
    is inside. Only cells inside become rows, whatever the size of the lattice.
    """
    lat = lattices.select("scan_id", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), "cell", "ni", "nj")
    e = edges.where(F.col("y0") != F.col("y1")).join(lat, "scan_id")
    row = lambda y: (y - F.col("_y0")) / F.col("cell") - 0.5
    lo = F.greatest(F.floor(row(F.least("y0", "y1"))), F.lit(0).cast("long"))
    hi = F.least(F.ceil(row(F.greatest("y0", "y1"))), F.col("nj") - 1)
    e = e.withColumn("j", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn("_py", F.col("_y0") + (F.col("j") + 0.5) * F.col("cell"))
    e = e.where((F.col("y0") > F.col("_py")) != (F.col("y1") > F.col("_py")))
    cross_x = (F.col("x1") - F.col("x0")) * (F.col("_py") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    rows = e.groupBy("scan_id", "j", "_x0", "cell", "ni").agg(F.sort_array(F.collect_list(cross_x)).alias("_xs"))
    # of an odd number, what lies before the first is inside
    whole = F.when(F.size("_xs") % 2 == 1, F.concat(F.array(F.lit(float("-inf"))), F.col("_xs"))).otherwise(F.col("_xs"))
    rows = rows.withColumn("_xs", whole).withColumn("_t", F.explode(F.sequence(F.lit(0), F.size("_xs") - 2, F.lit(2))))
    rows = rows.withColumns({"_a": F.get("_xs", F.col("_t")), "_b": F.get("_xs", F.col("_t") + 1)})
    col = lambda x: (x - F.col("_x0")) / F.col("cell") - 0.5
    first = F.when(F.col("_a") == float("-inf"), 0).otherwise(F.greatest(F.floor(col(F.col("_a"))), F.lit(0))).cast("long")
    last = F.least(F.ceil(col(F.col("_b"))), F.col("ni") - 1).cast("long")
    rows = rows.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    px = F.col("_x0") + (F.col("i") + 0.5) * F.col("cell")
    return rows.where((px >= F.col("_a")) & (px < F.col("_b"))).select("scan_id", "i", "j")


def polygon_area(edges: DataFrame) -> DataFrame:
    """Signed and absolute shoelace area and ring length per scan (fewer than three edges: zero)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    few = F.count(F.lit(1)) < 3
    twice = F.sum(x0 * y1 - x1 * y0)
    out = edges.groupBy("scan_id").agg(
        F.when(few, F.lit(0.0)).otherwise(twice / 2.0).alias("signed_area"),
        F.when(few, F.lit(0.0)).otherwise(F.sum(F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))).alias("perimeter"),
    )
    return out.withColumn("area", F.abs("signed_area"))

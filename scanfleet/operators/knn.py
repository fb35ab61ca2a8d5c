"""Exact k nearest neighbours by equi-joins on the leaves of k-d trees.

A scan's references are cut at medians, always across the widest spread, until a leaf holds about ``LEAF`` of them. Medians follow the
points, so one stray return a hundred kilometres away costs one cut and neither empties nor overfills the other leaves. The cuts come from a sample of
the scan; they decide how even the leaves are, never what is found. A sample of bounded size makes a bounded number of leaves, so leaves that are
still too large are cut again, each from a sample of its own, until none holds over twice ``LEAF``. Leaves are packed once. Each query location first
looks into its own leaf; only if the ball of its k-th distance crosses a cut does it visit the leaves behind that cut. A scan of up to one leaf has no
tree at all.

Copies collapse before anything else: at most k references per location can ever be among anyone's k nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import moments
from ..session import cut_lineage

#: References of one leaf, and query locations of one leaf that share a task row.
LEAF, CHUNK = 1024, 256
#: References of a scan, or of a leaf that is cut again, that the cuts are taken from, and the fewest of them that a leaf gets.
SAMPLE, LEAF_SAMPLE = 262_144, 16
#: Numbers that a leaf's own leaves may take, and the levels that fit into a long: enough for more references than there are numbers for.
FAN, LEVELS = 1 << 15, 4
#: Points of a scan that are led through its tree in one task.
DEAL = 65_536
#: Distances that a kernel holds at a time, and what a worker gets at a time: rows hold a leaf each, so ten thousand of them fill it.
DISTANCES, BATCH = 1 << 22, "4m"

_OUT = ("q", "id", "dist", "rx", "ry", "rz", "rank")
#: What is left of a neighbourhood when only its second moments about the location are wanted.
_MOMENTS = ("x", "y", "z", "n", "mx", "my", "mz", "mxx", "mxy", "mxz", "myy", "myz", "mzz")
_ROWS = T.StructType([T.StructField(c, T.ArrayType(T.LongType() if c in ("q", "id", "rank") else T.DoubleType())) for c in _OUT])


@F.pandas_udf(_ROWS)
def _block_knn(
    qi: pd.Series, qx: pd.Series, qy: pd.Series, qz: pd.Series, ri: pd.Series, rx: pd.Series, ry: pd.Series, rz: pd.Series, k: pd.Series
) -> pd.DataFrame:
    """k nearest references of every query location of a leaf, by distance then id."""
    out = []
    for qid, ax, ay, az, rid, bx, by, bz, kk in zip(qi, qx, qy, qz, ri, rx, ry, rz, k):
        step = max(1, DISTANCES // len(bx))
        parts = [_nearest(qid[i : i + step], ax[i : i + step], ay[i : i + step], az[i : i + step], rid, bx, by, bz, int(kk)) for i in range(0, len(ax), step)]
        out.append(tuple(np.concatenate(c) for c in zip(*parts)))
    return pd.DataFrame(out, columns=list(_OUT))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType() if c == "n" else T.DoubleType())) for c in _MOMENTS]))
def _block_moments(
    qi: pd.Series, qx: pd.Series, qy: pd.Series, qz: pd.Series, ri: pd.Series, rx: pd.Series, ry: pd.Series, rz: pd.Series, k: pd.Series
) -> pd.DataFrame:
    """Moments of the k nearest references of every query location of a leaf, relative to the location."""
    out = []
    for ax, ay, az, rid, bx, by, bz, kk in zip(qx, qy, qz, ri, rx, ry, rz, k):
        step = max(1, DISTANCES // len(bx))
        parts = [_spread(ax[i : i + step], ay[i : i + step], az[i : i + step], rid, bx, by, bz, int(kk)) for i in range(0, len(ax), step)]
        out.append(tuple(np.concatenate(c) for c in zip(*parts)))
    return pd.DataFrame(out, columns=list(_MOMENTS))


def _spread(ax, ay, az, rid, bx, by, bz, k: int) -> tuple:
    row, _, _, nx, ny, nz, _ = _nearest(np.arange(len(ax)), ax, ay, az, rid, bx, by, bz, k)
    x, y, z = nx - ax[row], ny - ay[row], nz - az[row]
    n = np.bincount(row, minlength=len(ax))
    sums = [np.bincount(row, weights=w, minlength=len(ax)) for w in (x, y, z, x * x, x * y, x * z, y * y, y * z, z * z)]
    some = n > 0
    return ax[some], ay[some], az[some], n[some], *[c[some] for c in sums]


def _nearest(qid, ax, ay, az, rid, bx, by, bz, k: int) -> tuple:
    d2 = (ax[:, None] - bx[None, :]) ** 2
    d2 += (ay[:, None] - by[None, :]) ** 2
    d2 += (az[:, None] - bz[None, :]) ** 2
    k = min(k, d2.shape[1])
    # everything at or below the k-th distance, so ties are settled by id and not by memory order
    row, col = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((rid[col], d2[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    row, col, rank = row[rank <= k], col[rank <= k], rank[rank <= k]
    return qid[row], rid[col], np.sqrt(d2[row, col]), bx[col], by[col], bz[col], rank


def cuts(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each cut of a balanced tree with at least ``leaves`` leaves, in heap order. A node that can't be cut sends all to the
    left."""
    depth = max(0, math.ceil(math.log2(leaves)))
    axis, value = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
    held = {0: points}
    for node in range(len(axis)):
        here = held.pop(node)
        left, right = here, here[:0]
        if len(here) > 1:
            # the spread of the middle nine tenths: strays don't choose the axis
            low, high = np.percentile(here, [5, 95], axis=0)
            for a in np.argsort(-(high - low), kind="stable"):
                column = here[:, a]
                at = np.median(column)
                if at <= column.min():
                    above = column[column > at]
                    at = above.min() if len(above) else np.inf
                if at < np.inf:
                    axis[node], value[node] = a, at
                    left, right = here[column < at], here[column >= at]
                    break
        if 2 * node + 1 < len(axis):
            held[2 * node + 1], held[2 * node + 2] = left, right
    return axis, value


def leaf_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(axis)


def leaves_within(points: np.ndarray, reach: np.ndarray, axis: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a point's ball touches."""
    row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        with np.errstate(invalid="ignore"):
            gap = points[row, axis[node]] - value[node]
        left, right = (gap < 0) | (gap <= reach[row]), (gap >= 0) | (-gap <= reach[row]) & (value[node] < np.inf)
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - len(axis)


_NODE = ["scan_id", "leaf"]


def _trees(refs: DataFrame, big: DataFrame, leaf: int) -> DataFrame:
    """scan_id, leaf, axis and value for each leaf of ``big`` (with its size n), from a bounded sample of its references. One without two
    locations in its sample has no tree."""
    share = F.pmod(F.xxhash64("x", "y", "z"), F.lit(1 << 20)) * F.col("n") < F.lit(float(SAMPLE) * (1 << 20))
    sample = refs.join(big, _NODE).where(share).select(*_NODE, "n", "x", "y", "z")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = min(math.ceil(pdf["n"].iloc[0] / leaf), max(2, len(pdf) // LEAF_SAMPLE), FAN // 2)
        axis, value = cuts(pdf[["x", "y", "z"]].to_numpy(), leaves)
        out = pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "leaf": [pdf["leaf"].iloc[0]], "axis": [axis], "value": [value]})
        return out[[bool(np.isfinite(value).any())]]

    return cut_lineage(sample.groupBy(*_NODE).applyInPandas(build, "scan_id long, leaf long, axis array<long>, value array<double>"))


def _through(rows: DataFrame, trees: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows, axis, value)`` on the rows of leaves with a tree, some ten thousand of a leaf at a time."""
    many = rows.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"))
    salts = cut_lineage(many.join(trees.select(*_NODE), _NODE).select(*_NODE, F.ceil(F.col("n") / DEAL).cast("int").alias("salts")))
    dealt = rows.join(salts, _NODE).withColumn("salt", F.pmod(F.xxhash64("x", "y", "z"), F.col("salts")).cast("int")).drop("salts")
    spread = trees.join(salts, _NODE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def led(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return fn(left, np.zeros(0, dtype=np.int64), np.zeros(0))
        return fn(left, np.asarray(right["axis"].iloc[0], dtype=np.int64), np.asarray(right["value"].iloc[0], dtype=float))

    return dealt.groupBy(*_NODE, "salt").cogroup(spread.groupBy(*_NODE, "salt")).applyInPandas(led, schema)


def _placed(rows: DataFrame, trees: DataFrame, number: str) -> DataFrame:
    """``rows`` (scan_id, leaf, x, y, z and ``number``) led one level further down; leaves without a tree stay as they are."""
    schema = f"scan_id long, leaf long, x double, y double, z double, {number} long"
    cols = ["scan_id", "leaf", "x", "y", "z", number]

    def into(pdf: pd.DataFrame, axis: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        if not len(pdf):
            return pdf[cols]
        return pdf[cols].assign(leaf=pdf["leaf"] * FAN + 1 + leaf_of(pdf[["x", "y", "z"]].to_numpy(), axis, value))

    return cut_lineage(_through(rows, trees, into, schema).union(rows.join(trees.select(*_NODE), _NODE, "left_anti").select(*cols)))


def _touched(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows (scan_id, leaf, q, x, y, z, reach, own) for every leaf one level down that the ball of a row touches."""
    cols = ["scan_id", "leaf", "q", "x", "y", "z", "reach", "own"]

    def beyond(pdf: pd.DataFrame, axis: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        if not len(pdf):
            return pdf[cols]
        row, leaves = leaves_within(pdf[["x", "y", "z"]].to_numpy(), pdf["reach"].to_numpy(), axis, value)
        return pdf[cols].iloc[row].assign(leaf=pdf["leaf"].to_numpy()[row] * FAN + 1 + leaves)

    below = _through(rows, trees, beyond, "scan_id long, leaf long, q long, x double, y double, z double, reach double, own long")
    return below.union(rows.join(trees.select(*_NODE), _NODE, "left_anti").select(*cols))


def _solve(asked: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """Rows of _OUT for query locations (scan_id, leaf, q, x, y, z) against the references of their leaf."""
    return _by_leaf(asked, packed, k, _block_knn, _OUT)


def _by_leaf(asked: DataFrame, packed: DataFrame, k: int, kernel, columns: tuple) -> DataFrame:
    sizes = asked.groupBy("scan_id", "leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("_parts"))
    dealt = asked.join(sizes, ["scan_id", "leaf"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("_parts")))
    rows = dealt.groupBy("scan_id", "leaf", "part").agg(F.collect_list(F.struct("q", "x", "y", "z")).alias("s")).join(packed, ["scan_id", "leaf"])
    nearest = kernel(*[F.col("s")[n] for n in ("q", "x", "y", "z")], *[F.col("r")[n] for n in ("rid", "x", "y", "z")], F.lit(k))
    return rows.select("scan_id", nearest.alias("o")).select("scan_id", F.inline(F.arrays_zip(*[F.col("o")[c].alias(c) for c in columns])))


def knn_join(queries: DataFrame, refs: DataFrame, k: int, leaf: int | None = None, same: bool = False) -> DataFrame:
    """``scan_id, point_id, id, dist, rank`` (rank 1..k): the k nearest ``refs`` of each query in its scan.

    Both sides are ``scan_id, point_id, x, y, z``. Ties go to the lower reference id.
    """
    spots, found = knn_locations(queries, refs, k, leaf, same)
    at = queries.select("scan_id", "point_id", "x", "y", "z").join(spots, ["scan_id", "x", "y", "z"])
    return at.join(found, ["scan_id", "q"]).select("scan_id", "point_id", "id", "dist", "rank")


def knn_locations(queries: DataFrame, refs: DataFrame, k: int, leaf: int | None = None, same: bool = False) -> tuple[DataFrame, DataFrame]:
    """The join before copies of a query location are told apart.

    Returns the distinct query locations (``scan_id, q, x, y, z``) and their neighbours with coordinates
    (``scan_id, q, id, dist, rx, ry, rz, rank``), so neighbourhood sums need no second join on points. ``same`` says that
    both sides are one table.
    """
    spots, spots_at, packed, levels = _arranged(queries, refs, k, leaf, same)
    return spots, _found(spots_at, packed, levels, k)


def knn_moments(points: DataFrame, k: int, leaf: int | None = None) -> DataFrame:
    """``scan_id, x, y, z`` of each distinct location with ``n`` and the moments ``mx..mzz`` of its k nearest points about it. Where a leaf answers for good, its
    neighbours are summed up in the task that found them, so they neither leave it nor are shuffled: a location takes a row, not k."""
    spots, spots_at, packed, levels = _arranged(points, points, k, leaf, True)
    if not levels:
        return _by_leaf(spots_at, packed, k, _block_moments, _MOMENTS)
    found = _found(spots_at, packed, levels, k).join(spots, ["scan_id", "q"])
    return found.groupBy("scan_id", "x", "y", "z").agg(*moments(*[F.col(f"r{a}") - F.col(a) for a in "xyz"]))


def _arranged(queries: DataFrame, refs: DataFrame, k: int, leaf: int | None, same: bool) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Distinct query locations, the same with their leaves, the references packed by leaf, and the trees of each level."""
    refs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    leaf = max(LEAF if leaf is None else leaf, 4 * k)
    loc = ["scan_id", "x", "y", "z"]
    copies = Window.partitionBy(*loc).orderBy("rid")
    ranked = refs.select(*loc, F.col("point_id").alias("rid")).withColumn("_c", F.row_number().over(copies))
    ref = cut_lineage(ranked.where(F.col("_c") <= k))
    own = ref.where(F.col("_c") == 1).select(*loc) if same else queries.select(*loc).distinct().join(ref.select("scan_id").distinct(), "scan_id", "left_semi")
    ref = ref.drop("_c")
    # written once, so a location keeps its number wherever it is used
    spots = cut_lineage(own.withColumn("q", F.monotonically_increasing_id()))
    levels = []
    refs_at, spots_at = ref.withColumn("leaf", F.lit(0).cast("long")), spots.withColumn("leaf", F.lit(0).cast("long"))
    while len(levels) < LEVELS:
        sizes = refs_at.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"))
        trees = _trees(refs_at, cut_lineage(sizes.where(F.col("n") > (2 * leaf if levels else leaf))), leaf)
        if trees.isEmpty():
            break
        levels.append(trees)
        refs_at, spots_at = _placed(refs_at, trees, "rid"), _placed(spots_at, trees, "q")
    return spots, spots_at, refs_at.groupBy(*_NODE).agg(F.collect_list(F.struct("rid", "x", "y", "z")).alias("r")), levels


def _found(spots_at: DataFrame, packed: DataFrame, levels: list[DataFrame], k: int) -> DataFrame:
    """Neighbours of all locations: from their own leaf, and from those behind a cut that the ball of the k-th distance crosses."""
    if not levels:
        return _solve(spots_at, packed, k)
    packed = cut_lineage(packed)
    first = cut_lineage(_solve(spots_at, packed, k))
    reach = first.where(F.col("rank") == k).select("scan_id", "q", F.col("dist").alias("reach"))
    open_ = spots_at.join(levels[0].select("scan_id"), "scan_id", "left_semi").join(reach, ["scan_id", "q"], "left")
    reach = F.coalesce(F.col("reach") * (1 + 1e-12), F.lit(float("inf")))
    other = cut_lineage(open_.select("scan_id", F.lit(0).cast("long").alias("leaf"), "q", "x", "y", "z", reach.alias("reach"), F.col("leaf").alias("own")))
    for trees in levels:
        other = cut_lineage(_touched(other, trees))
    other = other.where(F.col("leaf") != F.col("own")).select("scan_id", "leaf", "q", "x", "y", "z")
    second = _solve(other, packed, k)
    unsettled = other.select("scan_id", "q").distinct()
    order = Window.partitionBy("scan_id", "q").orderBy("dist", "id")
    both = first.join(unsettled, ["scan_id", "q"], "left_semi").union(second)
    merged = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return first.join(unsettled, ["scan_id", "q"], "left_anti").union(merged)


def self_knn(points: DataFrame, k: int, include_self: bool = False, leaf: int | None = None) -> DataFrame:
    """k nearest other points of every point (or k including itself, which comes first)."""
    pts = points.select("scan_id", "point_id", "x", "y", "z")
    if include_self:
        return knn_join(pts, pts, k, leaf, same=True)
    near = knn_join(pts, pts, k + 1, leaf, same=True).where(F.col("id") != F.col("point_id"))
    w = Window.partitionBy("scan_id", "point_id").orderBy("dist", "id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def nearest_viewpoint(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each point's nearest camera (``cam_id`` and its position); the lower id wins a tie."""
    cams = cameras.select("scan_id", F.col("cam_id").alias("point_id"), "x", "y", "z")
    best = knn_join(points, cams, 1).select("scan_id", "point_id", F.col("id").alias("cam_id"), "dist")
    at = cameras.select("scan_id", "cam_id", F.col("x").alias("cam_x"), F.col("y").alias("cam_y"), F.col("z").alias("cam_z"))
    return best.join(at, ["scan_id", "cam_id"])


def transfer_colours(vertices: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest source point's colour for every mesh vertex."""
    q = vertices.select("scan_id", F.col("vertex_id").alias("point_id"), "x", "y", "z")
    best = knn_join(q, points, 1).select("scan_id", F.col("point_id").alias("vertex_id"), F.col("id").alias("point_id"), "dist")
    return best.join(points.select("scan_id", "point_id", "r", "g", "b"), ["scan_id", "point_id"]).select("scan_id", "vertex_id", "r", "g", "b", "dist")

"""Set operations on tables of grid cells, 2-D (i, j) or 3-D (i, j, k), per group.

A cell set is a table of distinct rows ``keys + axes``. Dilation and erosion are one explode and one aggregate.
Components join runs of touching cells first and then contract the run graph, so rounds grow with the logarithm of
the component size and every round is cut to a written table. Holes are components of gaps, which stay intervals until they are known to be enclosed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import by_scan, cut_lineage, drop_stages, settled

KEYS = ["scan_id"]


def offsets(dims: int, connectivity: str) -> list[tuple[int, ...]]:
    """``faces`` (4 or 6), ``edges`` (8 or 18) or ``all`` (8 or 26) neighbours plus the cell itself."""
    reach = {"faces": 1, "edges": 2, "all": dims}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=dims) if sum(map(abs, o)) <= reach]


def _spread(cells: DataFrame, keys: list[str], axes: list[str], offs) -> DataFrame:
    shifts = F.array(*[F.struct(*[F.lit(d).cast("long").alias(f"_{a}") for a, d in zip(axes, o)]) for o in offs])
    wide = cells.select(*keys, *axes, F.inline(shifts))
    return wide.select(*keys, *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in axes])


def dilate_cells(cells: DataFrame, axes: list[str], connectivity: str = "all", keys: list[str] | None = None) -> DataFrame:
    """The cells and their neighbours."""
    keys = keys or KEYS
    return _spread(cells, keys, axes, offsets(len(axes), connectivity)).distinct()


def _inner(cells: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """``cells`` with ``_in``: whether both neighbours are there along every axis. Lines are looked at in order, so no cell is copied."""
    rows = cells.select(*keys, *axes, F.lit(True).alias("_in"))
    for a in axes:
        w = Window.partitionBy(*keys, *[c for c in axes if c != a]).orderBy(a)
        rows = rows.withColumn("_in", F.col("_in") & F.coalesce((F.lag(a).over(w) == F.col(a) - 1) & (F.lead(a).over(w) == F.col(a) + 1), F.lit(False)))
    return rows


def erode_cells(cells: DataFrame, axes: list[str], connectivity: str = "all", keys: list[str] | None = None) -> DataFrame:
    """Cells whose whole neighbourhood is present. Over faces that is told from the lines along the axes; otherwise each cell votes for its neighbours
    and full counts survive."""
    keys = keys or KEYS
    if connectivity == "faces":
        return _inner(cells, axes, keys).where("_in").select(*keys, *axes)
    offs = offsets(len(axes), connectivity)
    votes = _spread(cells, keys, axes, offs).groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n"))
    return votes.where(F.col("_n") == len(offs)).select(*keys, *axes)


def boundary_shell(cells: DataFrame, axes: list[str], connectivity: str = "faces", keys: list[str] | None = None) -> DataFrame:
    """The skin of a cell set: its cells minus its erosion."""
    keys = keys or KEYS
    if connectivity == "faces" and set(cells.columns) == {*keys, *axes}:
        return _inner(cells, axes, keys).where(~F.col("_in")).select(*cells.columns)
    return cells.join(erode_cells(cells, axes, connectivity, keys), keys + axes, "left_anti")


def close_by(cells: DataFrame, axes: list[str], radius: str, keys: list[str]) -> DataFrame:
    """Full-neighbourhood closing whose number of rounds is the column ``radius``, constant within a group."""
    by = keys + [radius]
    return _box(_box(cells, axes, by, F.col(radius), True), axes, by, F.col(radius), False).select(*keys, *axes)


def close_cells(cells: DataFrame, axes: list[str], iterations: int, connectivity: str = "all", keys: list[str] | None = None) -> DataFrame:
    """``iterations`` dilations then as many erosions; a table of cells has no border to shrink from. Neither takes rounds: boxes (``all``) and
    distances over faces are both had one axis at a time, the latter from the skin of the set and from the rim around it alone."""
    keys = keys or KEYS
    if iterations <= 0:
        return cells
    if connectivity == "all":
        grown = _box(cells, axes, keys, iterations, grow=True)
        return _box(grown, axes, keys, iterations, grow=False)
    if connectivity != "faces":
        raise ValueError("closing takes faces or all")
    cells = by_scan(cells.select(*keys, *axes), keys)
    grown = cut_lineage(cells.union(_within(boundary_shell(cells, axes, "faces", keys), axes, keys, iterations)).distinct())
    grown = by_scan(grown, keys)
    rim = dilate_cells(boundary_shell(grown, axes, "faces", keys), axes, "faces", keys).join(grown, keys + axes, "left_anti")
    return grown.join(_within(rim, axes, keys, iterations), keys + axes, "left_anti")


def _stretch(lo, hi):
    """The numbers from ``lo`` to ``hi``, none where these cross or are null."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _within(cells: DataFrame, axes: list[str], keys: list[str], r: int) -> DataFrame:
    """Cells at most ``r`` steps over faces from one of ``cells``: their distance, taken one axis at a time.

    On a line, what lies between two neighbours gets its distance from the least that either side has to offer. So each place is made once, by the
    cell before it, and only what is there already crosses the network.
    """
    far = cells.select(*keys, *[F.col(a).cast("long").alias(a) for a in axes], F.lit(0).cast("long").alias("_d"))
    for a in axes:
        w = Window.partitionBy(*keys, *[c for c in axes if c != a]).orderBy(a)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        at = F.col(a)
        rows = far.withColumns({"_f": F.min(F.col("_d") - at).over(back) + at, "_b": F.min(F.col("_d") + at).over(ahead) - at, "_first": F.lag(a).over(w).isNull(), "_next": F.lead(a).over(w)})
        rows = rows.withColumn("_nb", F.lead("_b").over(w))
        end = F.least(at + r - F.col("_f"), F.col("_next") - 1)
        places = F.concat(
            F.when(F.col("_first"), _stretch(at - (r - F.col("_b")), at - 1)).otherwise(F.array().cast("array<bigint>")), _stretch(at, end),
            _stretch(F.greatest(F.col("_next") - (r - F.col("_nb")), end + 1), F.col("_next") - 1),
        )
        rows = rows.withColumn("_p", F.explode(places))
        p = F.col("_p")
        d = F.when(p < at, F.col("_b") + at - p).when(p == at, F.least("_f", "_b")).otherwise(F.least(F.col("_f") + p - at, F.col("_nb") + F.col("_next") - p))
        far = rows.select(*keys, *[c for c in axes if c != a], p.alias(a), d.alias("_d"))
    return far.select(*keys, *axes)


def _box(cells: DataFrame, axes: list[str], keys: list[str], r, grow: bool) -> DataFrame:
    """``r`` rounds of the full neighbourhood at once: a (2r+1)-wide box, taken one axis at a time. Lines are looked at in order: growing, a cell adds what no
    cell before it reaches; shrinking, it keeps the middle of the box that ends with it. So no cell is made twice, and only whole sets cross the network.
    Shrinking begins with the last axis, along whose lines growing has just dealt the cells."""
    for a in axes if grow else reversed(axes):
        rest = [c for c in axes if c != a]
        w = Window.partitionBy(*keys, *rest).orderBy(a)
        before, at = F.lag(a).over(w), F.col(a)
        if grow:
            rows = cells.withColumn("_from", F.greatest(at - r, before + r + 1))
            cells = rows.select(*keys, *rest, F.explode(F.when(F.col("_from") <= at + r, F.sequence(F.col("_from"), (at + r).cast("long")))).alias(a)).select(*keys, *axes)
        else:
            rows = cells.withColumn("_start", F.when(F.coalesce(at - before > 1, F.lit(True)), at))
            rows = rows.withColumn("_start", F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            cells = rows.where(at - 2 * r >= F.col("_start")).select(*keys, *rest, (at - r).alias(a)).select(*keys, *axes)
    return cells


def dilate_by_radius(cells: DataFrame, axes: list[str], radius_cells: float, keys: list[str] | None = None) -> DataFrame:
    """Every cell whose centre lies within a radius (in cells) of a member's centre."""
    keys = keys or KEYS
    n = int(radius_cells)
    offs = [o for o in product(range(-n, n + 1), repeat=len(axes)) if sum(d * d for d in o) <= radius_cells * radius_cells + 1e-9]
    return _spread(cells, keys, axes, offs).distinct()


def runs(cells: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Cells with the first cell of their unbroken run along the last axis (``_start``)."""
    keys = keys or KEYS
    *rest, last = axes
    w = Window.partitionBy(*keys, *rest).orderBy(last)
    return cells.select(*keys, *axes).withColumn("_grp", F.col(last) - F.row_number().over(w)).withColumn(
        "_start", F.min(last).over(Window.partitionBy(*keys, *rest, "_grp"))
    ).drop("_grp")


#: Edges that are contracted at once, and side in cells of the squares that share a task for it.
AT_ONCE, NEAR = 200_000, 256


def _stars(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Edges that connect what ``rows`` connect: from each node to the smallest that it reaches by them."""
    ends = pd.concat([rows[[*keys, c]].set_axis([*keys, "a"], axis=1) for c in "ab"], ignore_index=True)
    code = ends.groupby([*keys, "a"]).ngroup().to_numpy()
    a, b = code[: len(rows)], code[len(rows) :]
    root = np.arange(code.max() + 1)
    while True:
        p, q = root[a], root[b]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    first = np.zeros(len(root), dtype=np.int64)
    first[code] = np.arange(len(code))
    own = np.flatnonzero(root != np.arange(len(root)))
    return ends.iloc[first[own]].assign(b=ends["a"].to_numpy()[first[root[own]]])


def _contracted(edges: DataFrame, keys: list[str], near: list[str]) -> DataFrame:
    """Edges (keys, a, b) that connect the same nodes as ``edges`` do. Those of a place ``near`` come together, and as many as fit the bound are replaced by
    stars; a place with more is replaced part by part, so memory is bounded and only edges between parts are left to be contracted."""

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows[[*keys, *near]] == rows[[*keys, *near]].iloc[-1]).all(axis=1)
            held = [] if last.all() else [rows[last]]
            yield _stars(rows if last.all() else rows[~last], keys)
        if held and sum(map(len, held)):
            yield _stars(pd.concat(held, ignore_index=True), keys)

    rows = edges.select(*keys, "a", "b", *near).repartition(*keys, *near).sortWithinPartitions(*keys, *near)
    return rows.mapInPandas(tasks, edges.select(*keys, "a", "b").schema)


def connected_components(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None, near: list[str] | None = None) -> DataFrame:
    """Smallest node id of each node's component: ``keys, id, component``.

    ``edges`` are (keys, a, b) and ``nodes`` (keys, id), ids LONG. Alternates the large-star and small-star
    contractions until the edge set stops changing. Both are aggregates with map-side combine joined on a node id;
    a hub only ever sits on the split side of a skew join. Where ``near`` names columns of edges that say where in its group an edge lies, edges of
    one place are replaced by stars first, which leaves little to contract.
    """
    keys = keys or KEYS
    if near is not None:
        edges = _contracted(edges, keys, near)

    def large(e: DataFrame) -> DataFrame:
        both = e.select(*keys, "a", "b").union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        return both.where(F.col("b") > F.col("a")).join(low, keys + ["a"]).select(*keys, F.col("b").alias("a"), F.col("_m").alias("b")).where(F.col("a") != F.col("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = down.groupBy(*keys, "a").agg(F.min("b").alias("_m"))
        hang = down.join(low, keys + ["a"]).where(F.col("b") != F.col("_m")).select(*keys, F.col("b").alias("a"), F.col("_m").alias("b"))
        return low.select(*keys, "a", F.col("_m").alias("b")).union(hang).where(F.col("a") != F.col("b")).distinct()

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, and a fingerprint of them that is taken as they are written."""
        seen = Observation()
        e = cut_lineage(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "a", "b")).alias("x"), F.bit_xor(F.hash(*keys, "a", "b")).alias("y")))
        return e, tuple(sorted(seen.get.items()))

    e, seen = written(edges.select(*keys, "a", "b").where(F.col("a") != F.col("b")))
    while seen and dict(seen)["n"]:
        last = e
        e, now = written(small(large(e)))
        drop_stages(last)
        if now == seen:
            break
        seen = now
    root = e.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("_root"))
    return nodes.select(*keys, "id").distinct().join(root, keys + ["id"], "left").select(*keys, "id", F.coalesce("_root", "id").alias("component"))


def cell_components(cells: DataFrame, axes: list[str], connectivity: str = "faces", keys: list[str] | None = None) -> DataFrame:
    """Cells with a component label (``label``, the smallest run id in it)."""
    keys = keys or KEYS
    *rest, last = axes
    # a run is told apart by its line and first cell; only runs meet one another, and cells come back at the end
    numbered = F.xxhash64(*keys, *rest, "_lo").bitwiseAND(F.lit(2**63 - 1)).alias("id")
    rows = cut_lineage(runs(cells, axes, keys).groupBy(*keys, *rest, F.col("_start").alias("_lo")).agg(F.max(last).alias("_hi")).select("*", numbered))
    reach: dict[tuple, int] = {}
    for o in offsets(len(axes), connectivity):
        if o[:-1] > (0,) * (len(axes) - 1):
            reach[o[:-1]] = max(reach.get(o[:-1], 0), o[-1])
    labels = connected_components(_overlaps(rows, rest, keys, reach), rows, keys, _places(rest))
    return rows.join(labels, keys + ["id"]).select(*keys, *rest, F.explode(F.sequence("_lo", "_hi")).alias(last), F.col("component").alias("label")).select(*keys, *axes, "label")


def largest_component(cells: DataFrame, axes: list[str], connectivity: str = "faces", keys: list[str] | None = None) -> DataFrame:
    """The biggest component of each group; equal sizes go to the one with the smallest first cell."""
    keys = keys or KEYS
    labelled = cut_lineage(cell_components(cells, axes, connectivity, keys))
    sizes = labelled.groupBy(*keys, "label").agg(F.struct((-F.count(F.lit(1))).alias("n"), F.min(F.struct(*axes)).alias("at"), F.col("label").alias("l")).alias("_s"))
    best = sizes.groupBy(*keys).agg(F.min("_s")["l"].alias("label"))
    return labelled.join(best, keys + ["label"], "left_semi").select(*keys, *axes)


#: Length of the stretches of the last axis by which overlapping intervals find each other.
SPAN = 128


def gap_runs(cells: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Bounded gaps between the cells of each line along the last axis: ``keys, rest, _lo, _hi``."""
    keys = keys or KEYS
    *rest, last = axes
    w = Window.partitionBy(*keys, *rest).orderBy(last)
    after = cells.select(*keys, *axes).withColumn("_next", F.lead(last).over(w)).where(F.col("_next") > F.col(last) + 1)
    return after.select(*keys, *rest, (F.col(last) + 1).alias("_lo"), (F.col("_next") - 1).alias("_hi"))


def _overlaps(runs_: DataFrame, rest: list[str], keys: list[str], reach: dict[tuple, int] | None = None) -> DataFrame:
    """Pairs (a, b) of runs of neighbouring lines that touch: face to face or, where ``reach`` says so, within so many cells along the last axis for each
    step to another line. Runs are dealt to the stretches they lie in; a pair is told in the stretch where the later of the two begins."""
    reach = reach or {tuple(int(c == x) for c in rest): 0 for x in rest}
    steps = F.array(*[F.struct(*[F.lit(d).cast("long").alias(f"_{c}") for c, d in zip(rest, o)], F.lit(t).cast("long").alias("_t")) for o, t in reach.items()])
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SPAN), F.floor(hi / SPAN)))
    cut = runs_.withColumn("_at", spans(F.col("_lo"), F.col("_hi")))
    moved = runs_.select(*keys, *rest, F.col("id").alias("a"), F.col("_lo").alias("_alo"), F.col("_hi").alias("_ahi"), F.inline(steps))
    moved = moved.select(*keys, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in rest], "a", (F.col("_alo") - F.col("_t")).alias("_alo"), (F.col("_ahi") + F.col("_t")).alias("_ahi"))
    moved = moved.withColumn("_at", spans(F.col("_alo"), F.col("_ahi")))
    met = moved.join(cut.withColumnRenamed("id", "b"), keys + rest + ["_at"])
    low = F.greatest("_lo", "_alo")
    return met.where((low <= F.least("_hi", "_ahi")) & (F.floor(low / SPAN) == F.col("_at"))).select(*keys, "a", "b", *[F.floor(F.col(c) / NEAR).alias(n) for c, n in zip(rest, _places(rest))], F.floor(F.col("_at") * SPAN / NEAR).alias("_pat"))


def _places(rest: list[str]) -> list[str]:
    return [*[f"_p{c}" for c in rest], "_pat"]


def hole_runs(cells: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Background that cannot reach the outside through faces, as intervals of the last axis: ``keys, rest, _lo, _hi, label``.

    Background is taken as the gaps between runs along the last axis, so an empty exterior is never enumerated, nor is the inside of a gap. Between
    the first and the last cell of a line everything is a cell or a bounded gap; so a gap leaks into a neighbouring line where that line
    has no cells or the gap reaches past their ends, and nowhere else.
    """
    keys = keys or KEYS
    *rest, last = axes
    gaps = cut_lineage(gap_runs(cells, axes, keys).withColumn("id", F.monotonically_increasing_id()))
    ends = cells.groupBy(*keys, *rest).agg(F.min(last).alias("_first"), F.max(last).alias("_last"))
    sides = F.array(*[F.struct(*[F.lit(d * int(c == x)).cast("long").alias(f"_{c}") for c in rest]) for x in rest for d in (-1, 1)])
    beside = gaps.select(*keys, *rest, "id", "_lo", "_hi", F.inline(sides)).select(*keys, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in rest], "id", "_lo", "_hi")
    open_ = beside.join(ends, keys + rest, "left").where(F.col("_first").isNull() | (F.col("_lo") < F.col("_first")) | (F.col("_hi") > F.col("_last"))).select(*keys, "id").distinct()
    labels = settled(lambda: connected_components(_overlaps(gaps, rest, keys), gaps.select(*keys, "id"), keys, _places(rest)))
    leaking = labels.join(open_, keys + ["id"]).select(*keys, "component").distinct()
    shut = labels.join(leaking, keys + ["component"], "left_anti")
    return gaps.join(shut, keys + ["id"]).select(*keys, *rest, "_lo", "_hi", F.col("component").alias("label"))


def holes(cells: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Background cells that cannot reach the outside through faces, with their component label."""
    keys = keys or KEYS
    *rest, last = axes
    return hole_runs(cells, axes, keys).select(*keys, *rest, F.explode(F.sequence("_lo", "_hi")).alias(last), "label").select(*keys, *axes, "label")


def fill_holes(cells: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """The cell set with its enclosed background added."""
    keys = keys or KEYS
    return cells.select(*keys, *axes).union(holes(cells, axes, keys).select(*keys, *axes))


def minus(a: DataFrame, b: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Cells of ``a`` that are not in ``b``."""
    keys = keys or KEYS
    return a.join(b.select(*keys, *axes), keys + axes, "left_anti")


def mask_intersect(*sets: DataFrame, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Cells present in every set."""
    keys = keys or KEYS
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s.select(*keys, *axes), keys + axes, "left_semi")
    return out


def boundary_edges(cells: DataFrame, res: float) -> DataFrame:
    """Outline segments of a 2-D cell set in cell units times ``res``: one per face without a neighbour."""
    sides = [((1, 0), (1, 0, 1, 1)), ((-1, 0), (0, 1, 0, 0)), ((0, 1), (1, 1, 0, 1)), ((0, -1), (0, 0, 1, 0))]
    arr = F.array(*[
        F.struct((F.col("i") + o[0]).alias("ni"), (F.col("j") + o[1]).alias("nj"),
                 *[((F.col(a) + d) * res).alias(n) for a, d, n in zip("ijij", s, ("x0", "y0", "x1", "y1"))])
        for o, s in sides
    ])
    faces = cells.select("scan_id", "i", "j", F.inline(arr))
    other = cells.select("scan_id", F.col("i").alias("ni"), F.col("j").alias("nj"))
    return faces.join(other, ["scan_id", "ni", "nj"], "left_anti").select("scan_id", "x0", "y0", "x1", "y1")

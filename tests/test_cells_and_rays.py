"""Closing, holes and rays against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfleet import session
from scanfleet.operators import capture as cp
from scanfleet.operators import cells as cl
from scanfleet.operators import moves as mv
from scanfleet.operators import rays as ry
from scanfleet.session import cut_lineage


def table(spark, sets, axes):
    rows = [(g, *c) for g, s in sets.items() for c in s]
    return spark.createDataFrame(rows, "scan_id long, " + ", ".join(f"{a} long" for a in axes))


def sets_of(df, axes):
    out = {}
    for r in df.select("scan_id", *axes).collect():
        assert tuple(r[1:]) not in out.setdefault(r.scan_id, set())
        out[r.scan_id].add(tuple(r[1:]))
    return out


def faces(c):
    for x in range(len(c)):
        for d in (-1, 1):
            yield (*c[:x], c[x] + d, *c[x + 1 :])


def grow(s):
    return s | {n for c in s for n in faces(c)}


def shrink(s):
    return {c for c in s if all(n in s for n in faces(c))}


def filled(s):
    dims = range(len(next(iter(s))))
    lo, hi = [min(c[x] for c in s) - 1 for x in dims], [max(c[x] for c in s) + 1 for x in dims]
    seen, stack = {tuple(lo)}, [tuple(lo)]
    while stack:
        for n in faces(stack.pop()):
            if n not in seen and n not in s and all(a <= v <= b for a, v, b in zip(lo, n, hi)):
                seen.add(n)
                stack.append(n)
    return s | {c for c in itertools.product(*[range(a, b + 1) for a, b in zip(lo, hi)]) if c not in seen}


def random_sets(dims, seed):
    rng = np.random.default_rng(seed)
    out = {g: set(map(tuple, rng.integers(-6, 7, (int(13**dims * p), dims)).tolist())) for g, p in ((1, 0.1), (2, 0.5), (3, 1.1))}
    box = set(itertools.product(range(3, 9), repeat=dims))
    out[4] = (box - set(itertools.product(range(4, 8), repeat=dims))) | {tuple([20] * dims)}  # hollow, and one cell apart
    out[5] = out[4] - {tuple([3] + [5] * (dims - 1))}  # with a pinhole
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_closing_over_faces_equals_rounds(spark, dims):
    axes, sets = list("ijk")[:dims], random_sets(dims, 5)
    df = cut_lineage(table(spark, sets, axes))
    for r in (1, 3):
        want = {}
        for g, s in sets.items():
            for step in (grow, shrink):
                for _ in range(r):
                    s = step(s)
            want[g] = s
        assert sets_of(cl.close_cells(df, axes, r, "faces"), axes) == {g: s for g, s in want.items() if s}
    assert cl.close_cells(df.where("false"), axes, 2, "faces").count() == 0


@pytest.mark.parametrize("dims", [2, 3])
def test_filled_holes_equal_a_flood(spark, dims, monkeypatch):
    axes, sets = list("ijk")[:dims], random_sets(dims, 6)
    df = cut_lineage(table(spark, sets, axes))
    want = {g: filled(s) for g, s in sets.items()}
    for span in (128, 3):
        monkeypatch.setattr(cl, "SPAN", span)
        assert sets_of(cl.fill_holes(df, axes), axes) == want
    parts = cl.holes(df, axes).groupBy("scan_id", "label").count().groupBy("scan_id").count().where("scan_id = 4").collect()
    assert [r[1] for r in parts] == [1]
    assert cl.holes(df.where("false"), axes).count() == 0


def test_a_hollow_cube_stays_intervals(spark):
    n = 120
    side = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b")))
    skin = [side.select(*(F.lit(v) if x == axis else F.col("a" if (x == 0 or (x == 1 and axis == 0)) else "b") for x in range(3))).toDF("i", "j", "k") for axis in range(3) for v in (0, n - 1)]
    cells = skin[0]
    for s in skin[1:]:
        cells = cells.union(s)
    cells = cut_lineage(cells.distinct().select(F.lit(1).cast("long").alias("scan_id"), *[F.col(c).cast("long").alias(c) for c in "ijk"]))
    runs = cut_lineage(cl.hole_runs(cells, ["i", "j", "k"]))
    assert runs.count() == (n - 2) ** 2 and runs.select("label").distinct().count() == 1
    assert runs.agg(F.sum(F.col("_hi") - F.col("_lo") + 1)).first()[0] == (n - 2) ** 3


def room(seed, rays):
    rng = np.random.default_rng(seed)
    p, o = rng.uniform(-3, 9, (rays, 3)), rng.uniform(0, 4, (5, 3))
    solid = {tuple(v) for v in rng.integers(-10, 60, (900, 3)).tolist()} | set(itertools.product(range(10, 12), range(0, 60), range(0, 60)))
    return p, o, solid


def sample(a, b, s, n, g, voxel):
    t = s / (n - 1)
    return tuple(math.floor((a[x] + t * (b[x] - a[x]) - g[x]) / voxel) for x in range(3))


def test_carving_equals_plain_loops(spark):
    p, o, solid = room(8, 250)
    voxel, g, dim = 0.2, (-3.1, -3.1, -3.1), (55, 60, 62)
    pts = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(p)) * 7))
    cams = spark.createDataFrame(pd.DataFrame(o, columns=list("xyz")).assign(scan_id=1, cam_id=np.arange(len(o))))
    grids = spark.createDataFrame([(1, *g, *dim, voxel)], "scan_id long, ox double, oy double, oz double, dim_x long, dim_y long, dim_z long, voxel double")
    df = table(spark, {1: solid}, ["i", "j", "k"])
    want, stops = set(), {}
    for r in range(len(p)):
        a, b = o[(r * 7 % 1_000_003 * 40503 + 12345) % len(o)], p[r]
        length = math.sqrt(sum((b[x] - a[x]) * (b[x] - a[x]) for x in range(3)))
        n = max(math.ceil(2.0 * length / voxel) + 1, 8)
        last = math.floor(min(max(1 - 0.5 * voxel / max(length, 1e-9), 0.0), 1.0) * (n - 1) + 1e-9)
        passed = [sample(a, b, s, n, g, voxel) for s in range(last + 1)]
        stops[r * 7] = next((s for s, v in enumerate(passed) if v in solid), last + 1)
        want |= {v for v in passed[: stops[r * 7]] if all(0 <= c < d for c, d in zip(v, dim))}
    rays = cp.rays_of(pts, cams, grids)
    assert {r.point_id: r.clear_steps for r in cp.first_hit(rays, df, ["point_id"]).collect()} == stops
    assert sets_of(cp.carve_free_space(pts, cams, df, grids), ["i", "j", "k"]) == {1: want}
    assert sets_of(cp.carve_free_space(pts, cams, df.where("false"), grids), ["i", "j", "k"])[1] > want


def test_sightlines_equal_plain_loops(spark):
    p, o, solid = room(9, 300)
    cell, g, slack = 0.15, (-3.0, -3.2, -3.4), 0.25
    rows = [(1, r, *map(float, o[r % 5]), *map(float, p[r])) for r in range(len(p))] + [(1, 900, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 901, 1.0, 1.0, 1.0, 1.1, 1.1, 1.0)]
    rays = spark.createDataFrame(rows, "scan_id long, ray long, ax double, ay double, az double, bx double, by double, bz double")
    grids = spark.createDataFrame([(1, *g, cell)], "scan_id long, ox double, oy double, oz double, cell double")
    want = {}
    for _, r, *ends in rows:
        a, b = ends[:3], ends[3:]
        length = math.sqrt(sum((b[x] - a[x]) * (b[x] - a[x]) for x in range(3)))
        n = max(2, math.ceil(length / (cell * 0.5)))
        want[r] = not any(s / (n - 1) * length > slack and (1 - s / (n - 1)) * length > slack and sample(a, b, s, n, g, cell) in solid for s in range(n)) if length >= 1e-6 else True
    got = {r.ray: r.visible for r in mv.line_of_sight(rays, table(spark, {1: solid}, ["i", "j", "k"]), grids, ["ray"], slack).collect()}
    assert got == want and 30 < sum(want.values()) < 270


def test_samples_cross_the_network_as_stretches(spark):
    """One long ray through empty space meets no block; what is joined is a row per stretch and block, not per sample."""
    ends = {f"{p}{a}": v for (p, a), v in zip(itertools.product("abg", "xyz"), (0.0, 0.5, 0.5, 1000.0, 0.5, 0.5, 0.0, 0.0, 0.0))}
    n = 20_001
    rays = spark.range(1).select(F.lit(1).cast("long").alias("scan_id"), F.col("id").alias("ray"), *[F.lit(v).alias(c) for c, v in ends.items()], F.lit(0.1).alias("voxel"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("lo"), F.lit(n - 1).cast("long").alias("hi"))
    solid = table(spark, {1: {(7777, 5, 5), (9000, 5, 5), (7777, 6, 5)}}, ["i", "j", "k"])
    assert ry.solid_blocks(solid).count() == 2
    first = next(s for s in range(n) if sample((0.0, 0.5, 0.5), (1000.0, 0.5, 0.5), s, n, (0.0, 0.0, 0.0), 0.1) == (7777, 5, 5))
    assert [tuple(r) for r in ry.first_solid(rays, solid, ["ray"]).collect()] == [(1, 0, first)]


def test_observed_volume_and_shell_of_a_closed_room(spark):
    """A box of solid voxels around free space with pinholes and a shadow: the volume is whole and the shell lies on the walls."""
    n = 14
    inside = set(itertools.product(range(n), repeat=3))
    rng = np.random.default_rng(2)
    free = inside - {tuple(c) for c in rng.integers(0, n, (60, 3)).tolist()} - set(itertools.product(range(5, 7), range(5, 7), range(0, 4)))
    df = table(spark, {1: free}, ["i", "j", "k"])
    v = free
    for r in (1, 2):
        for step in (grow, shrink):
            for _ in range(r):
                v = step(v)
    want = filled(v)
    got = cut_lineage(cp.observed_volume(df, 0.5, 1, 1.0))
    assert sets_of(got, ["i", "j", "k"]) == {1: want}

    solid = {c for c in itertools.product(range(-1, n + 1), repeat=3) if c not in inside}
    walls = table(spark, {1: solid}, ["i", "j", "k"])
    grids = spark.createDataFrame([(1, -0.5, -0.5, -0.5, n + 2, n + 2, n + 2, 0.5)], "scan_id long, ox double, oy double, oz double, dim_x long, dim_y long, dim_z long, voxel double")
    shifted = walls.select("scan_id", *[(F.col(c) + 1).alias(c) for c in "ijk"])
    pts = pd.DataFrame([[(c + 0.5) * 0.5 for c in v] for v in sorted(solid)], columns=list("xyz")).assign(scan_id=1)
    pts["point_id"] = np.arange(len(pts))
    cams = spark.createDataFrame([(1, k, 3.0 + 0.3 * k, 3.2, 3.4) for k in range(4)], "scan_id long, cam_id long, x double, y double, z double")
    completed, inferred, stats = cp.complete_shell(spark.createDataFrame(pts), cams, shifted, grids, 0.5, 1, 1.0)
    s = stats.first()
    assert s.carved and s.reason is None and s.free_voxels <= n**3 and s.swept_voxels == n**3 and s.swept_m3 == pytest.approx(n**3 * 0.125)
    assert s.shell_voxels == n**3 - (n - 2) ** 3 and s.inferred_voxels == 0 and s.inferred_fraction == 0
    assert sets_of(completed, ["i", "j", "k"])[1] == {tuple(x + 1 for x in c) for c in solid | {c for c in inside if 0 in c or n - 1 in c}}
    few = cp.complete_shell(spark.createDataFrame(pts), cams.where("cam_id = 0"), shifted, grids, 0.5, 1, 1.0)
    assert few[2].first().reason == "no camera poses" and few[0].count() == len(solid) and few[1].count() == 0


def test_lines_are_dealt_out_not_copies_of_cells(spark):
    """Closing, shrinking and skins equal plain loops on crowded and sparse sets, and no shuffle reads more rows than a set on its way has cells."""
    rng = np.random.default_rng(12)
    held = {(s, *map(int, c)) for s, size in ((1, 9), (2, 40)) for c in rng.integers(-size, size, (150, 2))} | {(3, 5, 5)}
    df = spark.createDataFrame(sorted(held), "scan_id long, i long, j long")

    def grow(cells, r, faces):
        return {(s, i + a, j + b) for s, i, j in cells for a in range(-r, r + 1) for b in range(-r, r + 1) if not faces or abs(a) + abs(b) <= r}

    def shrink(cells, r, faces):
        return {(s, i, j) for s, i, j in cells if grow({(s, i, j)}, r, faces) <= cells}

    rows = lambda d: sorted(tuple(r) for r in d.collect())
    for r in (1, 2, 5):
        for kind in ("all", "faces"):
            assert rows(cl.close_cells(df, ["i", "j"], r, kind)) == sorted(shrink(grow(held, r, kind == "faces"), r, kind == "faces"))
    assert rows(cl.erode_cells(df, ["i", "j"], "faces")) == sorted(shrink(held, 1, True))
    assert rows(cl.boundary_shell(df, ["i", "j"])) == sorted(held - shrink(held, 1, True))
    radius = df.withColumn("r", F.col("scan_id").cast("int"))
    assert rows(cl.close_by(radius, ["i", "j"], "r", ["scan_id"])) == sorted(c for s in (1, 2, 3) for c in shrink(grow({h for h in held if h[0] == s}, s, False), s, False))
    plan = cl.close_cells(df, ["i", "j"], 2)._jdf.queryExecution().toString()
    assert "HashAggregate" not in plan


def test_edges_of_one_place_are_contracted_in_one_round(spark, monkeypatch):
    """A chain of touching runs needs no round but the one that finds nothing to do; a bound on what is held at once changes nothing."""
    rng = np.random.default_rng(13)
    held = {(s, *map(int, c)) for s, size in ((1, 12), (2, 30)) for c in rng.integers(0, size, (400, 3 if s == 3 else 2))} | {(3, i, 0) for i in range(700)}
    df = spark.createDataFrame(sorted(held), "scan_id long, i long, j long")

    def parts(neighbours):
        left, out = set(held), set()
        while left:
            todo, part = [left.pop()], set()
            while todo:
                s, i, j = c = todo.pop()
                part.add(c)
                for a, b in neighbours:
                    if (n := (s, i + a, j + b)) in left:
                        left.remove(n)
                        todo.append(n)
            out.add(frozenset(part))
        return out

    cross = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    for at_once in (200_000, 64):
        monkeypatch.setattr(cl, "AT_ONCE", at_once)
        for kind, near in (("faces", cross), ("all", [*cross, (1, 1), (1, -1), (-1, 1), (-1, -1)])):
            got: dict = {}
            for r in cl.cell_components(df, ["i", "j"], kind).collect():
                got.setdefault((r.scan_id, r.label), set()).add((r.scan_id, r.i, r.j))
            assert {frozenset(p) for p in got.values()} == parts(near)
    monkeypatch.setattr(cl, "AT_ONCE", 200_000)
    writes = []
    monkeypatch.setattr(cl, "cut_lineage", lambda d, cut=cl.cut_lineage: writes.append(1) or cut(d))
    cl.cell_components(df.where("scan_id = 3 AND i < 250"), ["i", "j"]).count()
    assert len(writes) <= 3  # the runs, the stars, and the same stars again


def test_a_shell_leaves_no_tables_of_its_steps(spark):
    """What closing, filling and searching wrote on the way goes with each step; only what the results read is left."""
    free = table(spark, {1: set(itertools.product(range(1, 9), repeat=3)) - {(4, 4, 4)}}, ["i", "j", "k"])
    walls = table(spark, {1: {c for c in itertools.product(range(10), repeat=3) if 0 in c or 9 in c}}, ["i", "j", "k"])
    pts = walls.select("scan_id", F.xxhash64("i", "j", "k").alias("point_id"), *[((F.col(c) + 0.5) * 0.5).alias(a) for a, c in zip("xyz", "ijk")])
    cams = spark.createDataFrame([(1, k, 2.0 + 0.3 * k, 2.2, 2.4) for k in range(3)], "scan_id long, cam_id long, x double, y double, z double")
    grids = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10, 10, 10, 0.5)], "scan_id long, ox double, oy double, oz double, dim_x long, dim_y long, dim_z long, voxel double")
    left = set(session._stages)
    stats = cp.complete_shell(pts, cams, walls, grids, 0.5, 1, 1.0)[2]
    assert len(set(session._stages) - left) <= 6  # walls, shares, scans, volume, shell, inferred
    assert stats.first().swept_voxels == free.count() + 1


def test_scans_that_stay_together_are_dealt_out_once(spark):
    """Closing gives the same cells, but its lines along three axes are not dealt out anew for each; rounds of a search leave one table of edges, not one each."""
    rng = np.random.default_rng(14)
    held = sorted({(s, *map(int, c)) for s in (1, 2, 3) for c in rng.integers(0, 8, (120, 3))})
    df = spark.createDataFrame(held, "scan_id long, i long, j long, k long")
    session.plan_by_rows(spark)
    try:
        spread = cl.close_cells(df, ["i", "j", "k"], 2, "faces")
        want, by_line = sorted(map(tuple, spread.collect())), spread._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        session.keep_scans_together(spark)
        kept = cl.close_cells(df, ["i", "j", "k"], 2, "faces")
        assert sorted(map(tuple, kept.collect())) == want
        plan = cl.close_cells(df, ["i", "j", "k"], 2, "faces")._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hashpartitioning(scan_id" in plan and by_line > 3
        left = set(session._stages)
        chain = spark.range(1, 4000).select(F.lit(1).cast("long").alias("scan_id"), (F.col("id") * 7919 % 4001).alias("a"), ((F.col("id") + 1) * 7919 % 4001).alias("b"))
        nodes = chain.select("scan_id", F.col("a").alias("id")).union(chain.select("scan_id", F.col("b").alias("id")))
        assert cl.connected_components(chain, nodes).select("component").distinct().count() == 1
        assert len(set(session._stages) - left) == 1
    finally:
        session.plan_by_rows(spark)
        for c in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.cbo.planStats.enabled", "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)

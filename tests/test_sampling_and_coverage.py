"""Voxel thinning on codes, polygons drawn on lattices, and openings met by grid, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfleet.operators import polygons as pg
from scanfleet.operators import qa
from scanfleet.operators import sampling as sp
from scanfleet.session import cut_lineage


def brute_subsample(p, budget):
    if len(p) <= budget:
        return set(range(len(p)))
    lo = p.min(axis=0)
    diag = math.sqrt(((p.max(axis=0) - lo) ** 2).sum())
    for share in sp.LADDER if diag > 0 else []:
        first = {}
        for i, v in enumerate(np.floor((p - lo) / (diag * share)).astype(int).tolist()):
            first.setdefault(tuple(v), i)
        if len(first) <= budget:
            return set(first.values())
    return set(range(budget))


def test_voxel_subsample_equals_every_size_tried(spark, monkeypatch):
    rng = np.random.default_rng(5)
    clouds = {
        1: rng.uniform(0, 5, (900, 3)), 2: np.repeat(rng.normal(0, 1, (40, 3)), 30, axis=0), 3: np.array([[float(i), 0.0, 0.0] for i in range(5)]), 4: np.zeros((30, 3)),
        5: np.concatenate([rng.normal(0, 0.001, (600, 3)), rng.uniform(-50, 50, (50, 3))]), 6: np.round(rng.uniform(0, 64, (800, 3))), 7: rng.uniform(0, 1, (3, 3)), 8: np.array([[0.0, 0, 0], [8192.0, 0, 0], [4096.0, 0, 0]] * 40),
    }
    df = cut_lineage(spark.createDataFrame(pd.concat([pd.DataFrame(p, columns=list("xyz")).assign(scan_id=g, point_id=np.arange(len(p))) for g, p in clouds.items()])))
    for budget, local in ((1, 8), (4, 8), (25, 3), (200, 8), (500, 1)):
        monkeypatch.setattr(sp, "LOCAL", local)
        got = {}
        for r in sp.voxel_subsample(df, budget).select("scan_id", "point_id").collect():
            got.setdefault(r.scan_id, set()).add(r.point_id)
        assert got == {g: brute_subsample(p, budget) for g, p in clouds.items()}, budget


def test_codes_nest(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 14, (200, 3))
    got = sp.morton(spark.createDataFrame(pd.DataFrame(v, columns=list("ijk"))), ["i", "j", "k"], "m").collect()
    for r in got:
        assert r.m == sum(((c >> b) & 1) << (3 * b + a) for a, c in enumerate((r.i, r.j, r.k)) for b in range(14))


def rings(rng):
    out = {1: [(0, 0), (5, 0), (5, 2), (3, 2), (3, 4.2), (0, 4.2)], 2: [(math.cos(t) * (2 + (k % 2)), math.sin(t) * (2 + (k % 2))) for k, t in enumerate(np.linspace(0, 2 * math.pi, 24, endpoint=False))], 3: [(0, 0), (2, 2), (0, 2), (2, 0)], 4: rng.uniform(-3, 3, (15, 2)).tolist()}
    return {g: [(g, k, *map(float, r[k]), *map(float, r[(k + 1) % len(r)])) for k in range(len(r))] for g, r in out.items()} | {5: [(5, 0, 1.0, 0.1, 2.0, 3.0)]}


def test_cells_inside_equal_the_test_of_every_centre(spark):
    edges = rings(np.random.default_rng(3))
    e = spark.createDataFrame([r for s in edges.values() for r in s], "scan_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    lattice = {1: (-1.0, -1.0, 0.25, 30, 28), 2: (-2.0, -4.0, 0.2, 17, 50), 3: (-1.05, -1.0, 0.1, 40, 40), 4: (-4.0, -4.0, 0.3, 25, 28), 5: (0.0, 0.0, 0.5, 8, 8), 6: (0.0, 0.0, 1.0, 5, 5)}
    lat = spark.createDataFrame([(g, *v) for g, v in lattice.items()], "scan_id long, x0 double, y0 double, cell double, ni long, nj long")
    want = set()
    for g, (x0, y0, c, ni, nj) in lattice.items():
        for i in range(ni):
            for j in range(nj):
                px, py = x0 + (i + 0.5) * c, y0 + (j + 0.5) * c
                if sum((b > py) != (d > py) and px < (cx - a) * (py - b) / (d - b) + a for _, _, a, b, cx, d in edges.get(g, [])) % 2:
                    want.add((g, i, j))
    got = [tuple(r) for r in pg.cells_inside(e, lat).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 900


def test_a_stray_return_far_away_makes_no_rows(spark):
    ring = [(1, k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate([((0, 0), (4, 0)), ((4, 0), (4, 3)), ((4, 3), (0, 3)), ((0, 3), (0, 0))])]
    e = spark.createDataFrame(ring, "scan_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    rng = np.random.default_rng(2)
    p = np.concatenate([np.column_stack([rng.uniform(0, 4, 4000), rng.uniform(0, 3, 4000), rng.choice([0.0, 2.5], 4000)]), [[100_000.0, -100_000.0, 1.0]]])
    pts = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(p))))
    scans = spark.createDataFrame([(1, 0.0, 2.5)], "scan_id long, floor_z double, ceiling_z double")
    openings = spark.createDataFrame([], "scan_id long, opening_id long, cx double, cy double, cz double, nx double, ny double, nz double, width double, height double")
    row = qa.coverage(pts, scans, e, openings, spark.createDataFrame([(1, 0.25)], "scan_id long, cell double")).first()
    assert row.footprint_cells == pytest.approx(192, abs=30) and row.floor_coverage > 0.95 and row.ceiling_coverage > 0.95


def openings_of(rng, n):
    t = rng.uniform(0, 2 * math.pi, n)
    tilt = rng.choice([0.0, 0.0, 0.4], n)
    return pd.DataFrame({
        "scan_id": 1, "opening_id": np.arange(n), "cx": rng.uniform(0, 30, n), "cy": rng.uniform(0, 30, n), "cz": rng.uniform(0, 3, n), "nx": np.cos(t) * np.cos(tilt), "ny": np.sin(t) * np.cos(tilt), "nz": np.sin(tilt), "width": rng.uniform(0.3, 2.5, n), "height": rng.uniform(0.3, 2.0, n),
    })


def test_probes_meet_a_thousand_openings(spark):
    rng = np.random.default_rng(9)
    o = openings_of(rng, 1000)
    q = pd.DataFrame(rng.uniform([-1, -1, -1], [31, 31, 4], (4000, 3)), columns=list("xyz")).assign(scan_id=1, k=np.arange(4000))
    q["cell"] = rng.choice([0.05, 0.3], 4000)
    want = set()
    for r in o.itertuples():
        h = math.hypot(r.nx, r.ny)
        d = q[["x", "y", "z"]].to_numpy() - [r.cx, r.cy, r.cz]
        hit = (np.abs((-r.ny * d[:, 0] + r.nx * d[:, 1]) / h) <= r.width / 2 + q.cell) & (np.abs(d[:, 2]) <= r.height / 2 + q.cell) & (np.abs(d @ [r.nx, r.ny, r.nz]) <= 0.35)
        want |= set(q.k[hit])
    got = qa.opening_probe_mask(spark.createDataFrame(q), spark.createDataFrame(o), ["k"], F.col("cell"))
    assert {r.k for r in got.collect()} == want and 100 < len(want) < 3900


def test_wall_points_outside_a_thousand_openings(spark):
    rng = np.random.default_rng(10)
    o = openings_of(rng, 1000).assign(cy=0.02, nx=0.0, ny=1.0, nz=0.0, cx=rng.uniform(0, 200, 1000), width=rng.uniform(0.05, 0.3, 1000))
    p = pd.DataFrame(rng.uniform([0, -0.05, 0], [200, 0.05, 3], (5000, 3)), columns=list("xyz")).assign(scan_id=1, plane_id=5, point_id=np.arange(5000))
    walls = spark.createDataFrame([(1, 5, 0.0, 1.0, 0.0, 0.0)], "scan_id long, plane_id long, nx double, ny double, nz double, plane_offset double")
    kept = np.ones(5000, dtype=bool)
    for r in o.itertuples():
        kept &= ~((np.abs(p.x - r.cx) <= r.width / 2 + 0.08) & (np.abs(p.z - r.cz) <= r.height / 2 + 0.08))
    got = qa.opening_cutout(spark.createDataFrame(p), walls, spark.createDataFrame(o))
    assert {r.point_id for r in got.collect()} == set(p.point_id[kept]) and 300 < kept.sum() < 4900

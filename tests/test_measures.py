"""Fits and measures that no SQL can say, against numpy on small, skewed scans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfleet.operators import gravity as gr
from scanfleet.operators import qa
from scanfleet.operators import scale as sc
from scanfleet.session import cut_lineage


def svd_plane(p):
    c = p.mean(axis=0)
    n = np.linalg.svd(p - c)[2][2]
    return n, float(n @ c)


def clouds():
    """A large scan with furniture and a tilted floor, a small one, and one of too few points."""
    rng = np.random.default_rng(21)

    def room(n, size, tilt):
        w, d, h = size
        k = n // 6
        u = lambda m: rng.uniform(0, 1, m)
        faces = [np.column_stack([u(2 * k) * w, u(2 * k) * d, np.zeros(2 * k)]), np.column_stack([u(k) * w, u(k) * d, np.full(k, h)])]
        faces += [np.column_stack([np.full(k, x), u(k) * d, u(k) * h]) for x in (0.0, w)] + [np.column_stack([u(k) * w, np.full(k, y), u(k) * h]) for y in (0.0, d)]
        faces.append(np.column_stack([rng.uniform(1, 2.2, k), rng.uniform(0.8, 1.7, k), rng.uniform(0.0, 0.8, k)]))
        normals = np.concatenate([np.tile(v, (len(f), 1)) for f, v in zip(faces, ([0, 0, 1], [0, 0, -1], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1]))]).astype(float)
        p = np.concatenate(faces) + rng.normal(0, 0.004, (sum(map(len, faces)), 3))
        t = np.radians(tilt)
        r = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
        m = normals + rng.normal(0, 0.03, normals.shape)
        return p @ r.T, (m / np.linalg.norm(m, axis=1, keepdims=True)) @ r.T

    return {1: room(9000, (5.0, 3.6, 2.6), 1.5), 2: room(1500, (4.0, 2.5, 2.4), 0.0), 3: room(36, (2.0, 2.0, 2.0), 0.0)}


@pytest.fixture(scope="module")
def scans():
    return clouds()


@pytest.fixture(scope="module")
def points(spark, scans):
    parts = []
    for g, (p, m) in scans.items():
        parts.append(pd.DataFrame({"scan_id": g, "point_id": np.arange(len(p)), **{c: p[:, i] for i, c in enumerate("xyz")}, **{f"n{c}": m[:, i] for i, c in enumerate("xyz")}}))
    return cut_lineage(spark.createDataFrame(pd.concat(parts)).repartition(5))


def test_extent_diagonal(points, scans):
    got = {r.scan_id: r.diagonal for r in sc.extent_diagonal(points).collect()}
    for g, (p, _) in scans.items():
        c = p - p.mean(axis=0)
        t = c @ np.linalg.eigh(c.T @ c / len(c))[1]
        assert got[g] == pytest.approx(np.linalg.norm(np.quantile(t, 0.998, axis=0) - np.quantile(t, 0.002, axis=0)), abs=1e-6)


def slab_gaps(p, m):
    axes = np.linalg.eigh(m.T @ m)[1].T
    t = p @ axes.T
    lo, hi = np.quantile(t, 0.001, axis=0), np.quantile(t, 0.999, axis=0)
    span = hi - lo
    out = {}
    for k in range(3):
        bins = max(1, int(np.rint(span[k] / (span.max() / 400.0))))
        inside = t[(t[:, k] >= lo[k]) & (t[:, k] <= lo[k] + span[k]), k]
        h = np.bincount(np.minimum(np.floor((inside - lo[k]) / span[k] * bins), bins - 1).astype(int), minlength=bins).astype(float)
        s = (h + np.concatenate([[0], h[:-1]]) + np.concatenate([h[1:], [0]])) / 3.0
        a = int(np.argmax(s))
        far = np.abs(np.arange(bins) - a) > max(1, math.floor(0.15 * bins))
        if not far.any():
            continue
        b = int(np.flatnonzero(far)[np.argmax(s[far])])
        gap = abs(a - b) * span[k] / bins
        if s[b] >= 2.5 * np.median(s[s > 0]) and gap >= 0.2 * span[k]:
            out[k] = (gap, s[a] + s[b])
    return out


def test_axis_slab_gaps(points, scans):
    got = {}
    for r in sc.axis_slab_gaps(points).collect():
        got.setdefault(r.scan_id, {})[r.family] = (r.gap, r.weight)
    want = {g: slab_gaps(*v) for g, v in scans.items() if len(v[0]) >= 64}
    assert set(got) == {g for g, v in want.items() if v} and 1 in got
    for g in got:
        assert got[g].keys() == want[g].keys()
        for k in got[g]:
            assert got[g][k] == pytest.approx(want[g][k], abs=1e-6)


def axes_of(spark):
    q = np.linalg.qr(np.random.default_rng(4).normal(0, 1, (3, 3)))[0]
    near = np.linalg.qr(np.eye(3) + 0.05 * q)[0].T
    near *= np.sign(np.diag(near))[:, None]
    rows = [(g, k, *map(float, near[k])) for g in (1, 2, 3) for k in range(3)]
    return near, spark.createDataFrame(rows, "scan_id long, axis long, ax double, ay double, az double")


def test_normal_pole(spark, points, scans):
    near, axes = axes_of(spark)
    got = {(r.scan_id, r.axis): r for r in gr.normal_pole(points, axes).collect()}
    assert len(got) == 9
    for g, (_, m) in scans.items():
        for k in range(3):
            a, done = near[k].copy(), False
            for _ in range(4):
                s = m[np.abs(m @ a) <= math.sin(math.radians(15.0))]
                if len(s) >= 64:
                    v = np.linalg.eigh(s.T @ s)[1][:, 0]
                    a, done = v * (-1 if v @ a < 0 else 1), True
            r = got[g, k]
            assert (r.ax, r.ay, r.az) == pytest.approx(a, abs=1e-6) and r.converged == done


def test_contact_fractions(spark, points, scans):
    near, axes = axes_of(spark)
    low_high = {(g, k): (float(np.quantile(p @ near[k], 0.002)), float(np.quantile(p @ near[k], 0.998))) for g, (p, _) in scans.items() for k in range(3)}
    ends = spark.createDataFrame([(*key, *v) for key, v in low_high.items()], "scan_id long, axis long, lo double, hi double")
    clutter = points.where("scan_id <> 1 OR z < 1.5")
    got = {(r.scan_id, r.axis): (r.low_contact, r.high_contact) for r in gr.contact_fractions(clutter, axes, ends).collect()}
    some = 0
    for g, (p, _) in scans.items():
        p = p[p[:, 2] < 1.5] if g == 1 else p
        for k in range(3):
            a = near[k]
            ref = np.array([0.0, 0, 1]) if abs(a[2]) < 0.9 else np.array([1.0, 0, 0])
            u = np.cross(a, ref) / np.linalg.norm(np.cross(a, ref))
            v = np.cross(a, u)
            uu, vv, t = p @ u, p @ v, p @ a
            columns = {}
            for i, j, h in zip(np.floor((uu - uu.min()) / 0.25), np.floor((vv - vv.min()) / 0.25), t):
                columns.setdefault((i, j), []).append(h)
            full = [c for c in columns.values() if len(c) >= 4] if len(p) >= 64 else []
            lo, hi = low_high[g, k]
            want = (0.0, 0.0) if len(full) < 8 else (np.mean([min(c) <= lo + 0.18 for c in full]), np.mean([max(c) >= hi - 0.18 for c in full]))
            some += len(full) >= 8
            assert got[g, k] == pytest.approx(want, abs=1e-6)
    assert some >= 5


def residual(p, n, d):
    r = p @ n - d
    return r, 1.4826 * np.median(np.abs(r - np.median(r)))


def ground(p):
    if len(p) < 256:
        return None, 0
    a, b = np.quantile(p[:, 2], [0.001, 0.999])
    ij = np.floor((p[:, :2] - p[:, :2].min(axis=0)) / 0.30).astype(int)
    cells = {}
    for k, c in enumerate(map(tuple, ij)):
        cells.setdefault(c, []).append(k)
    bottom = {c: np.sort(p[k, 2])[min(math.floor(len(k) * 0.10), len(k) - 1)] for c, k in cells.items()}
    level = np.quantile(list(bottom.values()), 0.10)
    reach = max(0.20, min(1.0, 0.35 * (b - a)))
    good = {c: z for c, z in bottom.items() if len(cells[c]) >= 4 and z <= level + reach}
    floor = p[[k for c, z in good.items() for k in cells[c] if p[k, 2] <= z + 0.05]]
    if len(floor) < 64 or len(good) < 12:
        return None, len(good)
    n, d = svd_plane(floor)
    r, sigma = residual(floor, n, d)
    kept = floor[np.abs(r) < max(3.0 * sigma, 0.005)]
    trimmed = kept if len(kept) >= 64 else floor
    n, d = svd_plane(trimmed)
    _, sigma = residual(trimmed, n, d)
    return (math.degrees(math.acos(min(1.0, abs(n[2])))) if sigma <= 0.06 else None), len(good)


def test_ground_residual(points, scans):
    got = {r.scan_id: (r.up_residual_deg, r.ground_cells) for r in gr.ground_residual(points).collect()}
    for g, (p, _) in scans.items():
        angle, n = ground(p)
        assert got[g][1] == n and (got[g][0] is None) == (angle is None)
        if angle is not None:
            assert got[g][0] == pytest.approx(angle, abs=1e-5)
    assert got[1][0] == pytest.approx(1.5, abs=0.1)


def floor_fit(p, floor_z, spacing, minimum=256):
    band = max(0.12, 3.0 * spacing if spacing is not None else 0.06)

    def robust(q):
        if len(q) < minimum:
            return None
        n, d = svd_plane(q)
        r, sigma = residual(q, n, d)
        kept = q[np.abs(r) < 3.0 * max(sigma, 0.005)]
        return svd_plane(kept) if len(kept) >= minimum else (n, d)

    fit = robust(p[np.abs(p[:, 2] - floor_z) < band])
    for _ in range(2):
        if fit:
            fit = robust(p[np.abs(p @ fit[0] - fit[1]) < band]) or fit
    return fit


def test_measure_floor(spark, points, scans):
    levels = spark.createDataFrame([(1, 0.05), (2, -0.03), (3, 0.0)], "scan_id long, floor_z double")
    spacing = spark.createDataFrame([(1, 0.06), (2, None), (3, 0.05)], "scan_id long, median_spacing_m double")
    got = {r.scan_id: r for r in qa.measure_floor(points, levels, spacing).collect()}
    want = {g: floor_fit(scans[g][0], z, s) for g, z, s in ((1, 0.05, 0.06), (2, -0.03, None), (3, 0.0, 0.05))}
    assert set(got) == {g for g, f in want.items() if f} == {1, 2}
    for g, r in got.items():
        n, d = want[g]
        s = 1 if n[2] > 0 else -1
        assert (r.nx, r.ny, r.nz, r.plane_offset) == pytest.approx((*(n * s), d * s), abs=1e-6)


def tile_medians(r, tiles):
    cells = {}
    for k, c in enumerate(tiles):
        cells.setdefault(c, []).append(k)
    many = [len(v) for v in cells.values() if len(v) >= 12]
    least = max(12.0, 0.35 * (np.median(many) if many else 0.0))
    return {c: float(np.median(r[k])) for c, k in cells.items() if len(k) >= least}


def test_wall_residual_drift(spark):
    """A wall bent by 3 cm, a flat one, a small one with noise, and one of too few points; an opening is left out."""
    rng = np.random.default_rng(33)
    walls, rows, want = [], [], {}
    for k, (n, length, bend, noise) in enumerate(((6000, 6.0, 0.03, 0.002), (2500, 4.0, 0.0, 0.003), (60, 0.9, 0.0, 0.01), (20, 3.0, 0.0, 0.001)), 1):
        x, z = rng.uniform(0, length, n), rng.uniform(0, 2.5, n)
        y = 0.02 + bend * np.sin(np.pi * x / length) - bend / 2 + rng.normal(0, noise, n)
        y[: n // 50] += 0.03
        rows.append(pd.DataFrame({"scan_id": k, "point_id": np.arange(n), "x": x, "y": y, "z": z}))
        walls.append((k, 9, 0.01, -1.0, 0.0, -0.02, length * 2.5))
    openings = spark.createDataFrame([(2, 1, 2.0, 0.02, 1.2, 0.0, 1.0, 0.0, 0.8, 1.0)], "scan_id long, opening_id long, cx double, cy double, cz double, nx double, ny double, nz double, width double, height double")
    for f in rows:
        k = int(f.scan_id[0])
        p = f[["x", "y", "z"]].to_numpy()
        w = np.array([0.01, -1.0, 0.0])
        p = p[np.abs(p @ w + 0.02) < 0.06]
        if k == 2:
            u = np.array([1.0, 0.01, 0.0]) / math.hypot(1.0, 0.01)
            p = p[~((np.abs((p - [2.0, 0.02, 1.2]) @ u) <= 0.48) & (np.abs(p[:, 2] - 1.2) <= 0.58))]
        if len(p) < 50:
            continue
        n, d = svd_plane(p)
        s = -1 if n @ w < 0 else 1
        n, d = n * s, d * s
        u = np.array([-n[1], n[0], 0.0]) / math.hypot(n[0], n[1])
        r, uu, vv = p @ n - d, p @ u, p @ np.cross(n, u)
        tiles = list(zip(np.floor((uu - uu.min()) / 0.5).astype(int), np.floor((vv - vv.min()) / 0.5).astype(int)))
        med = tile_medians(r, tiles)
        off = np.array([r[i] - med[c] if c in med else np.nan for i, c in enumerate(tiles)])
        sigma = 1.4826 * np.nanmedian(np.abs(off)) if np.isfinite(off).any() else np.nan
        keep = np.abs(off) < max(4.0 * sigma, 0.004) if np.isfinite(sigma) else np.zeros(len(r), bool)
        n_tiles = len(set(tiles))
        if keep.sum() < 50 or n_tiles < 4:
            keep[:] = True
        again = tile_medians(r[keep], [c for c, ok in zip(tiles, keep) if ok])
        drift = max(again.values()) - min(again.values()) if n_tiles >= 4 and len(again) >= 4 else None
        want[k] = (*n, math.sqrt(np.mean(r[keep] ** 2)), drift, uu.max() - uu.min())
    df = spark.createDataFrame(pd.concat(rows))
    planes = spark.createDataFrame(walls, "scan_id long, plane_id long, nx double, ny double, nz double, plane_offset double, area double")
    got = {r.scan_id: r for r in qa.wall_residual_drift(df, planes, openings).collect()}
    assert set(got) == set(want) and {1, 2} <= set(want) and 4 not in want
    for k, (*numbers, drift, span) in want.items():
        r = got[k]
        assert [r.nx, r.ny, r.nz, r.rms_m, r.span_u] == pytest.approx([*numbers, span], abs=1e-6)
        assert (r.drift_m is None) == (drift is None) and (drift is None or r.drift_m == pytest.approx(drift, abs=1e-6))
    assert got[1].drift_m > 0.02 > 0.01 > got[2].drift_m

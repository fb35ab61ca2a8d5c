"""Greedy wall merging and the clearance map against plain loops."""

import math

import numpy as np
import pandas as pd

from scanfleet import constants as K
from scanfleet.operators import floor as fl
from scanfleet.operators import moves as mv
from scanfleet.operators import openings as op
from scanfleet.operators import structure as st


def test_duplicate_walls_go_as_in_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = []
    for scan in (1, 2):
        # chains of walls that duplicate their neighbours but not their neighbours' neighbours, either way round, with equal counts
        for i in range(150):
            az, d = rng.normal(0, math.radians(4)) + rng.integers(0, 4) * math.pi / 2, rng.integers(0, 3) * 0.4 + rng.normal(0, 0.12)
            s = rng.choice([-1.0, 1.0])
            rows.append((scan, i, s * math.cos(az), s * math.sin(az), 0.0, s * d, "wall", int(rng.integers(1, 12))))
    rows += [(3, 1, 1.0, 0.0, 0.0, 0.0, "wall", 5), (3, 2, -1.0, 0.0, 0.0, -0.0, "wall", 5), (3, 3, 0.0, 0.0, 1.0, 0.0, "floor", 9)]
    pdf = pd.DataFrame(rows, columns=["scan_id", "plane_id", "nx", "ny", "nz", "plane_offset", "kind", "inlier_count"])
    got = {tuple(r) for r in st.merge_duplicate_walls(spark.createDataFrame(pdf)).select("scan_id", "plane_id").collect()}
    want = set()
    for scan, walls in pdf[pdf.kind == "wall"].groupby("scan_id"):
        kept = []
        for w in walls.sort_values(["inlier_count", "plane_id"], ascending=[False, True]).itertuples():
            for k in kept:
                c = w.nx * k.nx + w.ny * k.ny + w.nz * k.nz
                if abs(c) >= math.cos(math.radians(K.DUPLICATE_WALL_ANGLE_DEG)) and abs((w.plane_offset if c > 0 else -w.plane_offset) - k.plane_offset) <= K.DUPLICATE_WALL_OFFSET_M:
                    break
            else:
                kept.append(w)
        want |= {(scan, w.plane_id) for w in kept}
    assert got == want and len(want) > 20


def test_no_walls_and_no_openings(spark):
    planes = spark.createDataFrame([], "scan_id long, plane_id long, nx double, ny double, nz double, plane_offset double, kind string, inlier_count long")
    assert st.merge_duplicate_walls(planes).count() == 0
    openings = spark.createDataFrame([], "scan_id long, opening_id long, cx double, cy double, cz double, confidence double")
    assert op.dedupe_openings(openings).count() == 0


def test_lower_envelope():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 7, 8, 9, 40, 333):
        for share in (0.0, 0.3, 0.9, 1.0):
            g = rng.integers(0, 30, size).astype(float) ** 2
            g[rng.random(size) < share] = np.inf
            j = np.arange(size)
            assert (fl.lower_envelope(g) == (g[None] + (j[:, None] - j[None]) ** 2.0).min(1)).all()


def test_clearance_is_the_distance_to_the_nearest_blocked_cell(spark):
    rng = np.random.default_rng(8)
    sizes = {1: (37, 52), 2: (5, 1), 3: (1, 9), 4: (20, 20)}
    frames = spark.createDataFrame([(s, 0.0, 0.0, nx, ny, 0.1) for s, (nx, ny) in sizes.items()], "scan_id long, x0 double, y0 double, nx long, ny long, cell double")
    blocked = {s: {(int(i), int(j)) for i, j in zip(rng.integers(0, nx, 6), rng.integers(0, ny, 6))} for s, (nx, ny) in sizes.items() if s != 4}
    cells = spark.createDataFrame([(s, i, j) for s, b in blocked.items() for i, j in b], "scan_id long, i long, j long")
    got = {(r.scan_id, r.i, r.j): r.clearance_m for r in fl.clearance_map(frames, cells).collect()}
    assert len(got) == sum(nx * ny for nx, ny in sizes.values())
    for (s, i, j), v in got.items():
        want = min(math.hypot(i - a, j - b) for a, b in blocked[s]) if s in blocked else max(sizes[s])
        assert abs(v - 0.1 * want) < 1e-9


def test_lower_envelopes_of_many_columns():
    rng = np.random.default_rng(9)
    columns = [np.where(rng.random(n) < share, np.inf, rng.integers(0, 30, n).astype(float) ** 2) for n in (1, 2, 9, 9, 64, 65, 130) for share in (0.0, 0.5, 1.0)]
    for g, got in zip(columns, fl.lower_envelopes(columns)):
        j = np.arange(len(g))
        assert (got == (g[None] + (j[:, None] - j[None]) ** 2.0).min(1)).all()


def test_scored_beats_and_maps_are_built_once(spark, capsys):
    """What several steps read is written, so that no plan holds the work behind it more than once."""
    rows = [(1, m, b, 0.5 * b, 0.0, 0.0, 0.0, 1.0, "medium", True, 0.03 * b * m, m == 1, []) for m in (0, 1) for b in range(3)]
    scored = spark.createDataFrame(rows, "scan_id long, move_id long, beat long, t double, x double, y double, z double, distance_m double, shot string, surveyed boolean, floor_rise_m double, on_track boolean, problems array<string>")
    level, first = mv.track_level(scored), mv.first_problem(scored)
    points = spark.createDataFrame([(1, 0.3 * (n % 7), 0.3 * (n % 5), 0.1 * (n % 27)) for n in range(200)], "scan_id long, x double, y double, z double")
    edges = spark.createDataFrame([(1, s, *e) for s, e in enumerate([(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 0.0)])], "scan_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    maps = fl.floor_maps(points, spark.createDataFrame([(1, 0.0, None)], "scan_id long, floor_z double, ceiling_z double"), edges, edges, 0.5)
    for df in (level, first, maps):
        df.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
    assert {r.move_id: r.blamed_beat for r in level.collect()} == {0: None, 1: 0}
    assert {r.move_id: r.problems for r in first.collect()} == {0: "", 1: "floor under the track varies by 60 mm and needs cribbing"}

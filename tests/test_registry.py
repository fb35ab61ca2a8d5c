"""Every registered query agrees with its oracle on the smallest tables (a fast subset; check.py runs them all)."""

import os

import pytest

import __spark_entry__ as entry
from scanfleet.operators import cells as cl

DIR = "/root/testdata/sf0.001"
FAST = [
    "transform_points", "plane_uv", "voxel_grid", "height_map", "occupancy", "point_in_polygon", "floor_maps", "equipment_fit", "lens_plan", "line_of_sight", "arc_length", "resample_paths",
    "knn_join", "voxel_subsample", "face_geometry", "boundary_edge_fraction", "close_cells", "fill_holes", "facing_wall_pairs", "infer_unit_scale", "find_yaw", "coverage", "qa_checks", "solve_scale", "register_windows",
]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_agrees_with_oracle(spark, name):
    import duckdb

    from check import norm
    from scanfleet.sources.testviews import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=key)
    exp = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=key)
    assert got == exp


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
def test_observed_volume_closes_further_the_second_time(spark, monkeypatch):
    """Its query takes the operator's own radii, on voxels that tell them apart: a second closing by no more than the first would change nothing."""
    radii = []
    monkeypatch.setattr(cl, "close_cells", lambda cells, axes, r, *rest: radii.append(r) or cells)
    monkeypatch.setattr(cl, "fill_holes", lambda cells, axes: cells)
    entry.queries()["observed_volume"](spark, DIR)
    assert radii == [2, 3]

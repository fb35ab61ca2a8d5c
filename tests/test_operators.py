"""Properties and skewed branches on small tables, against brute force or known truth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfleet.functions import optics, stats
from scanfleet.operators import capture as cp
from scanfleet.operators import cells as cl
from scanfleet.operators import knn
from scanfleet.operators import openings as op
from scanfleet.operators import qa
from scanfleet.sources import readers as rd
from scanfleet.sources import tables as tb


def _values(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    # one group holds most rows, with copies and far outliers
    a = pd.DataFrame({"g": 1, "v": np.concatenate([np.round(rng.normal(0, 1, n), 2), [1e9, -1e9]])})
    b = pd.DataFrame({"g": 2, "v": rng.uniform(0, 1, 37)})
    return pd.concat([a, b])


def test_percentiles_of_groups_too_big_for_a_task(spark):
    pdf = _values()
    df = spark.createDataFrame(pdf)
    qs = {"a": 0.002, "b": 0.5, "c": 0.9973, "d": 1.0}
    got = stats.percentiles(df, ["g"], F.col("v"), qs, limit=20).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        for name, q in qs.items():
            assert got.loc[g, name] == pytest.approx(np.percentile(rows.v, q * 100), rel=1e-12)


def test_ranked_value_and_row_index_of_big_groups(spark):
    pdf = _values(800)
    df = spark.createDataFrame(pdf.reset_index(drop=True).reset_index(names="id"))
    got = stats.ranked_value(df, ["g"], F.col("v"), F.floor(F.col("_n") * 0.2), "p", limit=20).toPandas().set_index("g")["p"]
    for g, rows in pdf.groupby("g"):
        assert got[g] == np.sort(rows.v)[int(len(rows) * 0.2)]
    idx = stats.row_index(df, ["g"], ["id"], limit=20).toPandas()
    for _, rows in idx.groupby("g"):
        rows = rows.sort_values("id")
        assert list(rows.idx) == list(range(len(rows))) and (rows.total == len(rows)).all()


@pytest.mark.parametrize("leaf", [1024, 24])
def test_knn_matches_brute_force_with_clusters_and_copies(spark, leaf):
    rng = np.random.default_rng(5)
    sparse = rng.uniform(0, 10, (150, 3))
    dense = 5 + rng.normal(0, 0.01, (400, 3))
    copies = np.repeat([[2.0, 2.0, 2.0]], 120, 0)
    p = np.concatenate([sparse, dense, copies])
    pdf = pd.DataFrame(p, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(p)))
    df = spark.createDataFrame(pdf).select("scan_id", "point_id", "x", "y", "z")
    got = knn.knn_join(df, df, 5, leaf=leaf, same=True).toPandas()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    order = np.lexsort((np.broadcast_to(np.arange(len(p)), d.shape), d), axis=1)[:, :5]
    got = got.sort_values(["point_id", "rank"])
    assert len(got) == 5 * len(p)
    assert (got.id.to_numpy().reshape(-1, 5) == order).all()


@pytest.mark.parametrize("leaf", [1024, 24])
def test_moments_of_neighbourhoods_stay_in_the_task_that_found_them(spark, leaf):
    """Moments equal brute force with copies and with trees; a location is one row once its neighbours are known, and nothing gathers them again."""
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.uniform(0, 3, (300, 3)), np.repeat([[1.0, 1.0, 1.0]], 40, 0)])
    df = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(p)))).select("scan_id", "point_id", "x", "y", "z")
    sums = knn.knn_moments(df, 6, leaf)
    got = {(r.x, r.y, r.z): r for r in sums.collect()}
    assert len(got) == 301
    for at in p[:301]:
        near = np.concatenate([p[:301], np.repeat(p[-1:], 5, 0)])  # six copies of a place are as many as can count
        rel = (near - at)[np.argsort(((near - at) ** 2).sum(1), kind="stable")[:6]]
        r = got[tuple(at)]
        assert r.n == 6 and [r.mx, r.my, r.mz] == pytest.approx(rel.sum(0)) and [r.mxx, r.mxy, r.mxz, r.myy, r.myz, r.mzz] == pytest.approx((rel.T @ rel)[np.triu_indices(3)])
    if leaf == 1024:
        plan = sums._jdf.queryExecution().optimizedPlan().toString()
        assert not {"Aggregate", "Join"} & set(plan[: plan.index("_block_moments")].split())


def test_knn_with_one_stray_point(spark):
    """A return 100 km away neither pairs the rest with itself nor changes their neighbours."""
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.uniform(0, 5, (40_000, 3)) * [1, 1, 0.001], 2 + rng.normal(0, 0.02, (10_000, 3)), [[1e5, 0, 0]]])
    df = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(p)))).select("scan_id", "point_id", "x", "y", "z")
    got = knn.knn_join(df, df, 4, same=True).toPandas().sort_values(["point_id", "rank"])
    assert len(got) == 4 * len(p)
    ids = got.id.to_numpy().reshape(-1, 4)
    for i in [*rng.integers(0, len(p), 60), len(p) - 1]:
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        assert list(ids[i]) == list(np.lexsort((np.arange(len(p)), d))[:4])


def test_knn_cuts_follow_the_points():
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.uniform(0, 1, (4000, 3)), [[1e5, 1e5, 1e5]], np.zeros((500, 3))])
    axis, value = knn.cuts(p, 40)
    leaf = knn.leaf_of(p, axis, value)
    assert np.bincount(leaf).max() <= 700 and np.bincount(leaf[:4000]).max() <= 150
    row, leaves = knn.leaves_within(p[:50], np.full(50, 0.1), axis, value)
    for i in range(50):
        inside = np.flatnonzero(((p - p[i]) ** 2).sum(1) <= 0.01)
        assert set(leaf[inside]) <= set(leaves[row == i])


def test_knn_cuts_large_leaves_again(spark, monkeypatch):
    """A sample too small for all the leaves makes more levels, not larger leaves, and the same neighbours."""
    monkeypatch.setattr(knn, "SAMPLE", 128)
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.uniform(0, 4, (2500, 3)), 1 + rng.normal(0, 0.01, (1200, 3)), [[1e5, 0, 0]], np.repeat([[2.0, 2.0, 2.0]], 60, 0)])
    few = rng.uniform(0, 1, (20, 3))
    pdf = pd.concat([pd.DataFrame(a, columns=list("xyz")).assign(scan_id=s, point_id=np.arange(len(a))) for s, a in ((1, p), (2, few))])
    df = spark.createDataFrame(pdf).select("scan_id", "point_id", "x", "y", "z")
    asked, largest = [], []
    solve = knn._solve
    monkeypatch.setattr(knn, "_solve", lambda rows, packed, k: (asked.append(rows), largest.append(packed.selectExpr("max(size(r))").first()[0]), solve(rows, packed, k))[-1])
    got = knn.knn_join(df, df, 4, leaf=40, same=True).toPandas().sort_values(["scan_id", "point_id", "rank"])
    assert max(largest) <= 80
    for s, a in ((1, p), (2, few)):
        ids = got[got.scan_id == s].id.to_numpy().reshape(-1, 4)
        d = ((a[:, None] - a[None]) ** 2).sum(-1)
        assert (ids == np.lexsort((np.broadcast_to(np.arange(len(a)), d.shape), d), axis=1)[:, :4]).all()
    other = knn.knn_join(df.where("point_id < 300"), df.where("point_id >= 300"), 1, leaf=40).where("scan_id = 1").toPandas().sort_values("point_id")
    assert (other.id.to_numpy() == 300 + ((p[:300, None] - p[None, 300:]) ** 2).sum(-1).argmin(1)).all()


def test_knn_between_two_tables_with_far_queries(spark):
    rng = np.random.default_rng(6)
    refs, qs = rng.uniform(0, 1, (80, 3)), rng.uniform(-3, 4, (700, 3))
    mk = lambda a: spark.createDataFrame(pd.DataFrame(a, columns=list("xyz")).assign(scan_id=1, point_id=np.arange(len(a)))).select("scan_id", "point_id", "x", "y", "z")
    got = knn.knn_join(mk(qs), mk(refs), 1).toPandas().set_index("point_id").sort_index()
    want = ((qs[:, None] - refs[None]) ** 2).sum(-1).argmin(1)
    assert (got.id.to_numpy() == want).all()
    small = knn.knn_join(mk(qs), mk(refs), 1, leaf=8).toPandas().set_index("point_id").sort_index()
    assert (small.id.to_numpy() == want).all()


def test_holes_and_components_in_three_dimensions(spark):
    shell = [(1, i, j, k) for i in range(5) for j in range(5) for k in range(5) if not (0 < i < 4 and 0 < j < 4 and 0 < k < 4)]
    door = [c for c in shell if c != (1, 0, 2, 2)]
    other = [(2, *c[1:]) for c in door]
    df = spark.createDataFrame(shell + other, "scan_id long, i long, j long, k long")
    filled = cl.fill_holes(df, ["i", "j", "k"]).groupBy("scan_id").count().toPandas().set_index("scan_id")["count"]
    assert filled[1] == 125 and filled[2] == len(door)
    skin = cl.boundary_shell(cl.fill_holes(df.where("scan_id = 1"), ["i", "j", "k"]), ["i", "j", "k"])
    assert skin.count() == len(shell)


def test_closing_keeps_a_border_and_a_doorway(spark):
    line = spark.createDataFrame([(1, i, 0) for i in range(10) if i not in (4, 5)], "scan_id long, i long, j long")
    closed = {(r.i, r.j) for r in cl.close_cells(line, ["i", "j"], 1).collect()}
    assert closed == {(i, 0) for i in range(10)}


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n) if i != 120], "scan_id long, a long, b long")
    nodes = spark.createDataFrame([(1, i) for i in range(n + 1)], "scan_id long, id long")
    got = cl.connected_components(edges, nodes).groupBy("component").count().toPandas().set_index("component")["count"]
    assert dict(got) == {0: 121, 121: 80}


def test_dedupe_keeps_what_a_sorted_pass_keeps(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 2, (300, 3))
    p[100:250] = p[0]  # a pile of copies
    conf = np.round(rng.uniform(0, 1, 300), 2)
    pdf = pd.DataFrame({"scan_id": 1, "opening_id": np.arange(300), "cx": p[:, 0], "cy": p[:, 1], "cz": p[:, 2], "confidence": conf})
    kept = []
    for i in sorted(range(300), key=lambda i: (-conf[i], i)):
        if all(np.linalg.norm(p[i] - p[k]) >= 0.3 for k in kept):
            kept.append(i)
    got = {r.opening_id for r in op.dedupe_openings(spark.createDataFrame(pdf)).collect()}
    assert got == set(kept)


def test_carving_stops_at_the_first_surface(spark):
    grids = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 20, 3, 3, 0.1)], "scan_id long, ox double, oy double, oz double, dim_x long, dim_y long, dim_z long, voxel double")
    solid = spark.createDataFrame([(1, 10, 1, 1)], "scan_id long, i long, j long, k long")
    pts = spark.createDataFrame([(1, 1, 1.95, 0.15, 0.15)], "scan_id long, point_id long, x double, y double, z double")
    cams = spark.createDataFrame([(1, 0, 0.05, 0.15, 0.15)], "scan_id long, cam_id long, x double, y double, z double")
    free = {r.i for r in cp.carve_free_space(pts, cams, solid, grids).collect()}
    assert free and max(free) <= 9


def test_text_points_by_layout(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# made by hand\n\n1 2 3\n4 5 6\n")
    (tmp_path / "b.pts").write_text("2\n1 2 3 0.5 10 20 30\n4 5 6 0.5 40 50 60\n")
    (tmp_path / "c.csv").write_text("x,y,z,r,g,b\n1,2,3,0.1,0.2,1.0\n")
    (tmp_path / "d.asc").write_text("1 2 3 10 20 30 0 0 1\n")
    pts, report = rd.read_point_text(spark, str(tmp_path))
    rows = {(r.source[-5:], r.x): r for r in pts.collect()}
    assert rows[("b.pts", 4.0)].g == 50 and rows[("c.csv", 1.0)].b == 255 and rows[("d.asc", 1.0)].nz == 1.0 and rows[("a.xyz", 1.0)].r is None
    assert {r.source[-5:]: r["columns"] for r in report.collect()} == {"a.xyz": 3, "b.pts": 7, "c.csv": 6, "d.asc": 9}


def test_units_are_read_as_declarations(spark):
    lines = ["units: cm", "scale in feet", "measured in a single pass", "1 unit = 1 mm", "unit (0.001) m", "dimensions in millimetres", "scale: 2 apples"]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(lines)], "k long, line_no long, value string")
    got = {r.k: r.unit_hint for r in rd.scan_header_hints(df, ["k"]).collect()}
    assert got == {0: "cm", 1: "ft", 3: "mm", 4: "m", 5: "mm"}


def test_newer_tables_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.1)], "scan_id long, point_id long, x double")
    tb.write_twin_tables({"points": df}, str(tmp_path / "t"), buckets=2)
    assert tb.load_twin_tables(spark, str(tmp_path / "t"), ["points"])["points"].first().x == pytest.approx(0.1, abs=1e-7)
    df.withColumn("schema_version", F.lit(99)).withColumn("scan_bucket", F.lit(0)).write.parquet(str(tmp_path / "n" / "points"))
    with pytest.raises(ValueError):
        tb.load_twin_tables(spark, str(tmp_path / "n"), ["points"])


def test_optics_closed_forms(spark):
    row = spark.range(1).select(
        optics.nearest_prime(F.lit(30.0)).alias("p"), optics.classify_framing(F.lit(1.25)).alias("s"), optics.field_of_view(F.lit(36.0), F.lit(18.0)).alias("v"),
        optics.depth_of_field(F.lit(32.0), F.lit(2.8), F.lit(0.02), F.lit(50.0))["far_m"].alias("far"), optics.slug(F.lit(" --Hello, Wörld!! ")).alias("g"), optics.slug(F.lit("!!")).alias("e"),
    ).first()
    assert (row.p, row.s, row.v, row.far, row.g, row.e) == (32.0, "Medium shot", pytest.approx(90.0), math.inf, "hello-wörld", "twin")


def test_a_missing_metric_never_passes(spark):
    names = (
        "opening_count opening_area_m2 scale_confidence gravity_residual_deg manhattan_residual_deg wall_frame_offset_deg wall_rectilinear_fraction opposite_wall_parallelism_deg opposite_wall_gap_m drift_estimate_m wall_planarity_rms_m "
        "ceiling_height_m floor_coverage density_per_m2 median_spacing_m capture_coverage_ratio duplicate_fraction hole_fraction mesh_boundary_edge_fraction extent_x_m extent_y_m extent_z_m gravity_axis_margin gravity_sign_margin"
    ).split()
    m = spark.range(1).select(F.lit(1).cast("long").alias("scan_id"), F.lit(100).cast("long").alias("point_count"), *[F.lit(None).cast("double").alias(n) for n in names]).fillna(0.0, ["opening_count", "opening_area_m2"])
    checks = qa.qa_checks(m).collect()
    assert len(checks) == 14 and all(c.status != "pass" for c in checks)
    few = qa.qa_checks(m.withColumn("point_count", F.lit(5).cast("long"))).collect()
    assert [(c.name, c.status) for c in few] == [("input", "fail")]


def test_read_point_text_reports_what_it_drops(spark):
    lines = [("a", 0, "1 2 3"), ("a", 1, "4 5"), ("a", 2, "7 8 9"), ("b", 0, "1 2"), ("b", 1, "3 4"), ("c", 0, "# x y z"), ("c", 1, "1,2,3"), ("c", 2, "1 2 oops")]
    points, report = rd.parse_point_lines(spark.createDataFrame(lines, "source string, line_no long, value string"))
    assert sorted((r.source, r.x) for r in points.collect()) == [("a", 1.0), ("a", 7.0), ("c", 1.0)]
    got = {r.source: (r.rows, r.dropped, r.status) for r in report.collect()}
    assert got == {"a": (2, 1, "ragged"), "b": (0, 2, "unreadable"), "c": (1, 1, "ragged")}


def test_read_point_text_reads_the_text_once(spark, capsys):
    """Neither the points nor the report go back to the text, and a file takes its width and colours from its own first row."""
    lines = [("a", 0, "1 2 3 0.5 1 0"), ("a", 1, "4 5 6 0 0 0.25"), ("a", 2, "7 8 9"), ("b", 0, "1,2,3,9,255,0,2"), ("b", 1, "// 1 2"), ("b", 2, "oops"), ("c", 0, "1 2 3 1 1 1 0 0 1"), ("c", 1, "9 9 9 300 0 0")]
    points, report = rd.parse_point_lines(spark.createDataFrame(lines, "source string, line_no long, value string"))
    for df in (points, report):
        df.explain(True)
        assert "regexp" not in capsys.readouterr().out.lower()
    assert sorted((r.source, r.line_no, r.r, r.g, r.b, r.nz) for r in points.collect()) == [("a", 0, 127, 255, 0, None), ("a", 1, 0, 0, 63, None), ("b", 0, 255, 0, 2, None), ("c", 0, 255, 255, 255, 1.0)]
    assert {r.source: (r.columns, r.rows, r.dropped, r.headers, r.scaled_colours) for r in report.collect()} == {"a": (6, 2, 1, 0, True), "b": (7, 1, 0, 1, False), "c": (9, 1, 1, 0, True)}


def test_units_that_a_line_declares(spark):
    said = {
        "units: cm": "cm", "1 unit = 1 mm": "mm", "scale in feet": "ft", "measured in a single pass": None, "dimensions in centimetres": "cm", "unit m": "m", "in m.": "m", "scale1 mm": None,
        "unit: mmx": None, "unit = m_": None, "units (in)": "in", "unit is in metres": "m", "unit 1234567890123 mm": None, "the unit is in the box": None,
    }
    rows = spark.createDataFrame(list(said.items()), "line string, want string").withColumn("got", rd.unit_of(F.col("line"))).collect()
    assert {r.line: r.got for r in rows} == said


@pytest.mark.parametrize("n", [80, 16])
def test_capture_region_of_a_walk_round_a_circle(spark, n):
    """The inside of the loop counts however far apart the positions are."""
    t = np.arange(n) * 2 * np.pi / n
    cams = spark.createDataFrame(pd.DataFrame({"scan_id": 1, "cam_id": np.arange(n), "x": 4 * np.cos(t), "y": 4 * np.sin(t), "z": 1.5}))
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "scan_id long, point_id long, x double, y double, z double")
    report = cp.capture_bounds(pts, spark.createDataFrame([(1, 0.0)], "scan_id long, floor_z double"), cams, 0.1)[1].collect()
    assert [(r.source, r.z_lo) for r in report] == [("poses", 1.5)]
    assert report[0].area_m2 == pytest.approx(math.pi * 4.6**2, abs=4.0)


@pytest.mark.parametrize("jitter", [0.004])
def test_capture_region_of_ten_poses_at_each_stop(spark, jitter):
    """Stops 1.57 m apart on a circle are one walk; so far away another walk of two stops is not part of it."""
    t, rng = np.repeat(np.arange(16), 10) * 2 * np.pi / 16, np.random.default_rng(3)
    x, y = 4 * np.cos(t) + rng.uniform(-jitter, jitter, 160), 4 * np.sin(t) + rng.uniform(-jitter, jitter, 160)
    x, y = np.append(x, [40.0] * 10 + [41.5] * 10), np.append(y, [0.0] * 20)
    cams = spark.createDataFrame(pd.DataFrame({"scan_id": 1, "cam_id": np.arange(180), "x": x, "y": y, "z": 1.5}))
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], "scan_id long, point_id long, x double, y double, z double")
    report = cp.capture_bounds(pts, spark.createDataFrame([(1, 0.0)], "scan_id long, floor_z double"), cams, 0.1)[1].collect()
    assert [r.source for r in report] == ["poses+largest-part"]
    assert report[0].area_m2 == pytest.approx(math.pi * 4.6**2, abs=4.0)


def test_a_long_ray_stops_at_a_thin_wall(spark):
    """Over a thousand voxels long, and a wall one voxel thick: nothing behind it is freed."""
    pts = spark.createDataFrame([(1, 0, 150.05, 0.05, 0.05)], "scan_id long, point_id long, x double, y double, z double")
    cams = spark.createDataFrame([(1, 0, 0.05, 0.05, 0.05)], "scan_id long, cam_id long, x double, y double, z double")
    grid = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1600, 1, 1, 0.1)], "scan_id long, ox double, oy double, oz double, dim_x long, dim_y long, dim_z long, voxel double")
    solid = spark.createDataFrame([(1, 700, 0, 0)], "scan_id long, i long, j long, k long")
    assert sorted(r.i for r in cp.carve_free_space(pts, cams, solid, grid).collect()) == list(range(700))


def test_an_uneven_track_fails_the_move(spark):
    from scanfleet.operators import moves as mv

    cols = "scan_id long, move_id long, beat long, t double, x double, y double, z double, floor_rise_m double, on_track boolean, distance_m double, shot string, surveyed boolean, problems array<string>"
    rows = [(1, m, b, b / 3, float(b), 0.0, 1.0, 0.08 if b == 2 else 0.0, m == 0, 1.0, "wide", True, []) for m in (0, 1) for b in range(4)]
    got = {r.move_id: r for r in mv.first_problem(spark.createDataFrame(rows, cols)).collect()}
    assert not got[0].feasible and "cribbing" in got[0].problems and got[0].fails_at_m == pytest.approx(2.0)
    assert got[1].feasible

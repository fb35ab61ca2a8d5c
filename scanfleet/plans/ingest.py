"""From raw points to a graded twin: every step of a scan's way, for all scans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normals as nm
from ..operators import planes as pl
from ..operators import qa
from ..operators.capture import capture_bounds
from ..operators.structure import analyze_structure
from ..operators.transforms import transform_points
from ..session import cut_lineage
from ..sources.tables import write_twin_tables
from .canonical import canonicalize
from .reports import assess

_PT = ["scan_id", "point_id", "x", "y", "z"]


def with_normals(points: DataFrame, cameras: DataFrame | None) -> DataFrame:
    """Points with unit normals: their own, or estimated ones turned towards the cameras."""
    if "nx" in points.columns:
        return points
    found = nm.orient_normals(points, cut_lineage(nm.estimate_normals(points)), cameras)
    return points.join(found.select("scan_id", "point_id", "nx", "ny", "nz"), ["scan_id", "point_id"])


def ingest(
    points: DataFrame, cameras: DataFrame | None = None, up_hints: DataFrame | None = None, unit_hints: DataFrame | None = None, min_inliers: int = 500,
    resolution: float = 0.05, capture_cell: float = 0.1, path: str | None = None,
) -> dict[str, DataFrame]:
    """Twin tables of every scan: points, cameras, canonical, planes, levels, footprint, outline, openings, capture, metrics, checks and verdict.

    Normals, planes in source units (the tolerance is each scan's own point spacing), the canonical frame, planes again in metres, structure,
    capture region, checks and verdict. Points are written once in source units and once in metres. With ``path`` the tables are also
    written there.
    """
    raw = cut_lineage(with_normals(points, cameras).select(*_PT, "nx", "ny", "nz"))
    spacing = nm.median_spacing(raw)
    rough = raw.join(spacing.select("scan_id", F.greatest(F.coalesce("spacing", F.lit(0.0)), F.lit(1e-9)).alias("tol")), "scan_id")
    source_planes = cut_lineage(pl.detect_planes(rough, min_inliers, distance=None))
    canon = cut_lineage(canonicalize(raw, source_planes, cameras, up_hints, unit_hints))
    metric = cut_lineage(transform_points(raw, canon))
    cams = None if cameras is None else cut_lineage(transform_points(cameras.select("scan_id", "cam_id", "x", "y", "z"), canon))
    parts = analyze_structure(metric, cut_lineage(pl.detect_planes(metric, min_inliers)), resolution)
    levels = parts["levels"]
    _, capture = capture_bounds(metric, levels, cams, capture_cell)
    capture = cut_lineage(capture)
    margins = canon.select("scan_id", "scale_confidence", F.col("axis_margin").alias("gravity_axis_margin"), F.col("sign_margin").alias("gravity_sign_margin"))
    area = capture.select("scan_id", F.col("area_m2").alias("capture_bounds_area_m2"))
    metrics = cut_lineage(assess(metric, levels, parts["planes"], parts["openings"], parts["outline"], area, canonical=margins))
    checks = cut_lineage(qa.qa_checks(metrics))
    out = {
        "points": metric, "canonical": canon, "planes": parts["planes"], "levels": levels, "footprint": parts["footprint"], "outline": parts["outline"], "openings": parts["openings"],
        "capture": capture, "metrics": metrics, "checks": checks, "verdict": qa.qa_verdict(checks, levels),
    }
    if cams is not None:
        out["cameras"] = cams
    if path is not None:
        write_twin_tables(out, path)
    return out

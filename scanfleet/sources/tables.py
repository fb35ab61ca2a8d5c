"""Twin tables on disk, the point-budget reader and the per-scan summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.sampling import voxel_subsample

POINTS = "scan_id LONG, point_id LONG, x DOUBLE, y DOUBLE, z DOUBLE"
BUCKETS = 64


def read_points(spark: SparkSession, path: str, max_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded points with a budget per scan, and what the budget dropped (``scan_id, before, after``)."""
    points = spark.read.schema(POINTS).parquet(path)
    return read_budget(points, max_points)


def read_budget(points: DataFrame, max_points: int | None) -> tuple[DataFrame, DataFrame]:
    kept = points if max_points is None else voxel_subsample(points, max_points)
    n = F.count(F.lit(1))
    report = points.groupBy("scan_id").agg(n.alias("before")).join(kept.groupBy("scan_id").agg(n.alias("after")), "scan_id", "left")
    return kept, report.withColumn("warning", F.when(F.col("after") < F.col("before"), F.format_string("thinned from %d to %d points; density no longer reflects the source", "before", "after")))


def write_twin_tables(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Write each table under ``path``, partitioned so that one scan's rows sit in few files.

    Doubles of the big geometry tables shrink to floats, as on-disk precision is far finer than the measurement.
    """
    for name, df in tables.items():
        if name in ("points", "mesh_vertices"):
            df = df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if f.dataType.typeName() == "double"})
        out = df.withColumn("scan_bucket", F.pmod(F.hash("scan_id"), F.lit(buckets)))
        (
            out.withColumn("schema_version", F.lit(K.SCHEMA_VERSION)).repartition("scan_bucket", F.pmod(F.hash(*df.columns[:2]), F.lit(16)))
            .sortWithinPartitions("scan_id").write.partitionBy("scan_bucket").mode("errorifexists").parquet(f"{path}/{name}")
        )


def load_twin_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Read tables back; a table written by a newer schema is refused before any row is used."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        newest = df.agg(F.max("schema_version")).first()[0]
        if newest is not None and newest > K.SCHEMA_VERSION:
            raise ValueError(f"{name} was written with schema {newest}; this library reads up to {K.SCHEMA_VERSION}")
        cast = {f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.typeName() == "float"}
        out[name] = (df.withColumns(cast) if cast else df).drop("schema_version", "scan_bucket")
    return out


def twin_summary(scans: DataFrame, points: DataFrame, faces: DataFrame, footprint: DataFrame, openings: DataFrame, verdicts: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """One line per scan: points, faces, extent, ceiling height, floor area, openings and verdict."""
    from ..operators.polygons import polygon_area
    from ..operators.voxels import cloud_bounds

    n = F.count(F.lit(1))
    out = scans.select("scan_id", "name", F.round(F.col("ceiling_z") - F.col("floor_z"), 3).alias("ceiling_height_m"))
    out = out.join(points.groupBy("scan_id").agg(n.alias("points")), "scan_id", "left").join(faces.groupBy("scan_id").agg(n.alias("faces")), "scan_id", "left")
    box = cloud_bounds(points, vertices=vertices).select("scan_id", *[F.round(f"extent_{a}", 3).alias(f"extent_{a}") for a in "xyz"])
    area = polygon_area(footprint).select("scan_id", F.round("area", 2).alias("floor_area_m2"))
    out = out.join(box, "scan_id", "left").join(area, "scan_id", "left").join(openings.groupBy("scan_id").agg(n.alias("openings")), "scan_id", "left")
    out = out.fillna(0, ["points", "faces", "openings"]).fillna(0.0, ["floor_area_m2", "extent_x", "extent_y", "extent_z"])
    if verdicts is None:
        return out.withColumn("verdict", F.lit("unknown"))
    return out.join(verdicts.select("scan_id", "verdict"), "scan_id", "left").fillna("unknown", ["verdict"])

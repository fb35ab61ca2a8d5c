"""Scan-shaped views over the driver's tables: one SQL text that Spark and the DuckDB oracle both run.

One scan is one supplier, a 5.0 x 4.2 x 2.7 m box of points. Literals carry ``e0`` because a bare 0.1 is DECIMAL in
both engines. See FIXTURES.md.
"""

from __future__ import annotations

from ..functions.stats import GROUP_LIMIT, largest_group
from ..session import keep_scans_together, plan_by_rows

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # order, line, part and quantity name a row uniquely, so ids need no window over a whole scan
    "points": """
SELECT l_suppkey AS scan_id,
       ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id,
       l_quantity * 0.1e0 AS x, l_extendedprice / 25000.0e0 AS y, l_discount * 27.0e0 AS z,
       CAST(l_linenumber * 36 AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b
FROM lineitem""",
    "scans": """
SELECT s_suppkey AS scan_id, s_name AS name, 0.0e0 AS floor_z,
       CASE WHEN s_suppkey % 10 = 9 THEN CAST(NULL AS DOUBLE) ELSE 2.7e0 END AS ceiling_z,
       CAST(s_suppkey % 90 AS DOUBLE) AS latitude, CAST(s_suppkey * 7 % 400 - 200 AS DOUBLE) AS longitude,
       CAST(s_suppkey * 37 % 720 AS DOUBLE) AS heading_deg, CAST(s_suppkey % 50 AS DOUBLE) AS elevation_m
FROM supplier""",
    "cameras": """
SELECT c_custkey % (SELECT count(*) FROM supplier) AS scan_id, c_custkey AS cam_id,
       0.5e0 + (c_custkey * 7 % 40) * 0.1e0 AS x, 0.5e0 + (c_custkey * 11 % 32) * 0.1e0 AS y,
       1.2e0 + (c_custkey % 5) * 0.1e0 AS z, CAST(c_custkey * 37 % 360 AS DOUBLE) AS yaw_deg
FROM customer""",
    "frames": "SELECT user_id AS sweep_id, event_id AS frame_id, ts, value AS sharpness FROM events",
    "depth_pixels": """
SELECT scan_id, frame_id, CAST(idx % 8 AS BIGINT) AS col, CAST(floor(idx / 8) AS BIGINT) AS row_no,
       recon_depth, recon_depth * (1.5e0 + (o_orderkey % 7) * 0.01e0) AS metric_depth, (o_orderkey * 13 % 100) / 100.0e0 AS conf
FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS scan_id, o_orderkey % 2 AS frame_id, o_orderkey,
             0.5e0 + o_totalprice / 100000.0e0 AS recon_depth,
             CAST(row_number() OVER (PARTITION BY o_custkey % (SELECT count(*) FROM supplier), o_orderkey % 2 ORDER BY o_orderkey) - 1 AS BIGINT) AS idx
      FROM orders) t""",
    "openings": """
SELECT p_partkey % (SELECT count(*) FROM supplier) AS scan_id, p_partkey AS opening_id,
       0.5e0 + p_size * 0.03e0 AS width, 0.8e0 + (p_partkey * 17 % 30) * 0.05e0 AS height,
       CASE WHEN p_partkey % 3 = 0 THEN 0.0e0 ELSE (p_partkey % 10) * 0.12e0 END AS sill_height,
       (p_size % 10) / 10.0e0 AS confidence,
       (p_partkey * 3 % 50) * 0.1e0 AS cx, CAST(0.0e0 AS DOUBLE) AS cy, 1.0e0 + (p_partkey % 7) * 0.1e0 AS cz,
       CAST(0.0e0 AS DOUBLE) AS nx, CAST(1.0e0 AS DOUBLE) AS ny, CAST(0.0e0 AS DOUBLE) AS nz
FROM part""",
    "planes": """
SELECT s_suppkey AS scan_id, CAST(plane_id AS BIGINT) AS plane_id, nx, ny, nz, d + (s_suppkey % 5) * 0.01e0 AS plane_offset, kind,
       CAST(500 * plane_id + s_suppkey % 100 AS BIGINT) AS inlier_count, area
FROM supplier CROSS JOIN (
  SELECT * FROM (VALUES
    (1, 0e0, 0e0, 1e0, 0e0, 'floor', 21e0), (2, 0e0, 0e0, -1e0, -2.7e0, 'ceiling', 21e0),
    (3, 1e0, 0e0, 0e0, 0.1e0, 'wall', 11.34e0), (4, -1e0, 0e0, 0e0, -5e0, 'wall', 11.34e0),
    (5, 0e0, 1e0, 0e0, 0e0, 'wall', 13.5e0), (6, 0e0, -1e0, 0e0, -4.2e0, 'wall', 13.5e0),
    (7, 0.999e0, 0.0447e0, 0e0, 0.15e0, 'wall', 1.2e0)) AS v(plane_id, nx, ny, nz, d, kind, area)) p""",
    "footprint_edges": """
SELECT s_suppkey AS scan_id, CAST(seq AS BIGINT) AS seq, x0, y0, x1, y1
FROM supplier CROSS JOIN (SELECT * FROM (VALUES
    (0, 0e0, 0e0, 5e0, 0e0), (1, 5e0, 0e0, 5e0, 2e0), (2, 5e0, 2e0, 3e0, 2e0),
    (3, 3e0, 2e0, 3e0, 4.2e0), (4, 3e0, 4.2e0, 0e0, 4.2e0), (5, 0e0, 4.2e0, 0e0, 0e0)) AS v(seq, x0, y0, x1, y1)) e""",
    "capture_edges": """
SELECT s_suppkey AS scan_id, CAST(seq AS BIGINT) AS seq, x0, y0, x1, y1
FROM supplier CROSS JOIN (SELECT * FROM (VALUES
    (0, 0.6e0, 0.7e0, 4.3e0, 0.4e0), (1, 4.3e0, 0.4e0, 4.1e0, 1.9e0), (2, 4.1e0, 1.9e0, 2.2e0, 3.7e0),
    (3, 2.2e0, 3.7e0, 0.6e0, 0.7e0)) AS v(seq, x0, y0, x1, y1)) e""",
    "mesh_vertices": """
SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS scan_id, p_partkey AS vertex_id,
       (p_partkey % 20) * 0.25e0 AS x, CAST(floor(p_partkey % 200 / 20) AS BIGINT) * 0.25e0 AS y, p_size * 0.01e0 AS z,
       CAST(p_partkey % 256 AS INT) AS r, CAST(p_size * 5 AS INT) AS g, CAST(p_partkey * 7 % 256 AS INT) AS b,
       (p_size % 11) / 10.0e0 AS filled
FROM part""",
    "mesh_faces": """
SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS scan_id, p_partkey * 2 + t AS face_id,
       CASE WHEN t = 0 THEN p_partkey ELSE p_partkey + 1 END AS v0,
       CASE WHEN t = 0 THEN p_partkey + 1 ELSE p_partkey + 21 END AS v1,
       p_partkey + 20 AS v2
FROM part CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS v(t)) s
WHERE p_partkey % 20 < 19 AND p_partkey % 200 < 180""",
    "moves": """
SELECT scan_id, cam_id AS move_id, x AS x0, y AS y0, z AS z0, x + 1.2e0 AS x1, y + 0.4e0 AS y1, z AS z1,
       2.5e0 AS sx, 2.1e0 AS sy, 0.0e0 AS sz, 1.75e0 AS subject_height_m, 32.0e0 AS focal_mm
FROM cameras""",
    # a window in two walls of each scan and a door in a third: where they lie along the wall, and how large they are
    "room_openings": """
SELECT scan_id, CAST(CASE w WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 5 END AS BIGINT) AS plane_id, p AS opening_id, 1.5e0 + (p * 3 % 10) * 0.1e0 AS along, 0.8e0 + (p * 7 % 5) * 0.1e0 AS width,
       CASE WHEN w = 1 THEN 0.0e0 ELSE 0.8e0 + (p % 3) * 0.1e0 END AS sill, CASE WHEN w = 1 THEN 2.0e0 ELSE 1.0e0 + (p % 4) * 0.1e0 END AS height,
       CASE WHEN w = 1 THEN 'door' ELSE 'window' END AS kind
FROM (SELECT p_partkey % (SELECT count(*) FROM supplier) AS scan_id, p_partkey % 3 AS w, min(p_partkey) AS p FROM part GROUP BY 1, 2) t""",
    # points on the four walls but for their openings, and on the jambs, sills and heads of these
    "room_points": """
SELECT scan_id, point_id, CASE plane_id WHEN 3 THEN 0.1e0 + e + s WHEN 4 THEN 5.0e0 - e - s ELSE pos END AS x, CASE plane_id WHEN 5 THEN e + s WHEN 6 THEN 4.2e0 - e - s ELSE pos END AS y, z
FROM (
  SELECT w.scan_id, w.plane_id, point_id, e, pos, z, (point_id % 5 - 2) * 0.001e0 AS s
  FROM (SELECT scan_id, 3 + k % 4 AS plane_id, point_id * 32 + k AS point_id, e, CASE WHEN k % 4 < 2 THEN e + fa * (4.2e0 - 2 * e) ELSE 0.1e0 + e + fa * (4.9e0 - 2 * e) END AS pos, fb * 2.7e0 AS z FROM room_draws WHERE k < 12) w
  LEFT JOIN room_openings o ON o.scan_id = w.scan_id AND o.plane_id = w.plane_id
  WHERE o.plane_id IS NULL OR abs(pos - along) >= width / 2 OR z <= sill OR z >= sill + height
  UNION ALL
  SELECT d.scan_id, o.plane_id, point_id * 32 + k, e, along + CASE WHEN fa < 0.25e0 THEN -width / 2 WHEN fa < 0.5e0 THEN width / 2 ELSE (fa * 4 - floor(fa * 4) - 0.5e0) * width END,
         sill + CASE WHEN fa < 0.5e0 THEN (fa * 4 - floor(fa * 4)) * height WHEN fa < 0.75e0 AND sill > 0 THEN 0e0 ELSE height END, 0.02e0 + fb * 0.055e0
  FROM room_draws d JOIN room_openings o ON o.scan_id = d.scan_id AND o.plane_id = CASE d.k % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 6 END WHERE k >= 12) r""",
    "room_draws": """
SELECT l_suppkey AS scan_id, ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id, CAST(k AS BIGINT) AS k, (l_suppkey % 5) * 0.01e0 AS e,
       ((l_orderkey * 7919 + l_partkey * 613 + l_linenumber * 131 + k * 3571) % 9973) / 9973.0e0 AS fa,
       ((l_orderkey * 104729 + l_partkey * 7331 + l_linenumber * 911 + k * 6553) % 9967) / 9967.0e0 AS fb
FROM lineitem CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) AS v(k)) n""",
    # a similarity per scan: turn by (3,4,5)/5 about Z, scale, shift
    "transforms": """
SELECT s_suppkey AS scan_id, 0.5e0 + s_suppkey % 4 AS s, 0.6e0 AS c, 0.8e0 AS sn,
       1.0e0 + s_suppkey % 3 AS tx, -2.0e0 AS ty, 0.25e0 * (s_suppkey % 5) AS tz
FROM supplier""",
    "splats": """
SELECT CAST(label AS BIGINT) AS scan_id, vec_id AS point_id,
       CAST(embedding[{i0}] AS DOUBLE) AS f_dc_0, CAST(embedding[{i1}] AS DOUBLE) AS f_dc_1, CAST(embedding[{i2}] AS DOUBLE) AS f_dc_2,
       CAST(embedding[{i3}] AS DOUBLE) * 20.0e0 AS opacity,
       CAST(embedding[{i4}] AS DOUBLE) AS nx, CAST(embedding[{i5}] AS DOUBLE) AS ny, CAST(embedding[{i6}] AS DOUBLE) AS nz
FROM embeddings""",
}

_NEEDS = {"moves": ["cameras"], "room_points": ["room_draws", "room_openings"]}


def view_sql(name: str, engine: str) -> str:
    text = VIEWS[name].strip()
    if name == "splats":
        first = 0 if engine == "spark" else 1  # array subscripts start at 0 in Spark and at 1 in DuckDB
        text = text.format(**{f"i{k}": k + first for k in range(7)})
    return text


def _closure(names) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [d for d in _NEEDS.get(n, []) if d not in out]
        if n not in out:
            out.append(n)
    return out


def oracle(names, body: str) -> str:
    """DuckDB SQL: the views used, as common table expressions, then ``body`` (which may start with more of them)."""
    ctes = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in _closure(names)]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join(ctes + [body[len(head):]]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Fixture:
    """The test tables and views of one directory as Spark DataFrames, read when first used."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}
        plan_by_rows(spark)

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep_scans_together(self) -> None:
        """Scans stay together from join to join if none is too large for a task."""
        if largest_group(self.points, ["scan_id"]) <= GROUP_LIMIT:
            keep_scans_together(self.spark)

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._seen:
            text = view_sql(name, "spark")
            for dep in _NEEDS.get(name, []):
                getattr(self, dep).createOrReplaceTempView(dep)
            for t in TABLES:
                if t in text:
                    rows = self.table(t)
                    # eighteen points are drawn from a row: rows are dealt out by scan before that, not the points after it, unless a scan is too large for a task
                    if name == "room_draws" and t == "lineitem" and largest_group(rows, ["l_suppkey"]) <= GROUP_LIMIT // 18:
                        keep_scans_together(self.spark)
                        rows = rows.repartition("l_suppkey")
                    rows.createOrReplaceTempView(t)
            self._seen[name] = self.spark.sql(text)
        return self._seen[name]

"""Sizes by which joins choose their strategy."""

import pytest
from pyspark.sql import functions as F

from scanfleet import session
from scanfleet.operators import knn

CONFS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.cbo.planStats.enabled", "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")


@pytest.fixture
def by_rows(spark):
    session.plan_by_rows(spark)
    yield spark
    for c in CONFS:
        spark.conf.unset(c)


def _size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_a_table_that_packs_well_is_planned_by_its_rows(by_rows):
    n = 600_000
    cells = by_rows.range(n).select((F.col("id") % 3).alias("scan_id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"))
    kept = session.cut_lineage(cells)
    assert kept.schema.names == cells.schema.names and kept.count() == n
    assert _size(kept) >= 24 * n  # some kilobytes as files, yet too much to broadcast
    points = by_rows.range(9_000_000).select((F.col("id") % 3).alias("scan_id"))
    plan = points.join(kept, "scan_id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_other_tables_come_back_whole_and_few_rows_stay_few(by_rows):
    lists = by_rows.range(50).select("id", F.sequence(F.lit(0), F.col("id")).alias("s"))
    assert sorted(map(tuple, session.cut_lineage(lists).collect())) == sorted(map(tuple, lists.collect()))
    few = session.cut_lineage(by_rows.range(1000).select("id", F.lit("wall").alias("kind"), F.lit(None).cast("double").alias("z")))
    assert _size(few) < 100_000 and few.where("kind = 'wall' AND z IS NULL").count() == 1000


def test_neighbours_hand_few_leaves_to_a_worker_at_a_time(spark):
    pts = spark.range(40).select((F.col("id") % 2).alias("scan_id"), F.col("id").alias("point_id"), *[F.rand(i).alias(a) for i, a in enumerate("xyz")])
    assert knn.self_knn(pts, 3).count() == 120
    size = F.pandas_udf(lambda s: s * 0 + len(s), "long")
    leaves = spark.range(0, 400, 1, 1).select("id", F.sequence(F.lit(0).cast("long"), F.lit(8191).cast("long")).alias("r"))
    held = F.pandas_udf(lambda i, r: i * 0 + len(r), "long")
    assert leaves.select(size("id").alias("n")).agg(F.max("n")).first()[0] == 400
    assert leaves.select(held("id", "r").alias("n")).agg(F.max("n")).first()[0] < 100


def test_a_task_reads_little_of_a_shuffle(by_rows):
    by_rows.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    rows = by_rows.range(5_000_000).select(F.xxhash64("id").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows.select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.count("k")).count() > 2


def test_little_is_broadcast_and_a_lower_limit_of_the_session_stays(by_rows):
    """A table of some megabytes is shuffled: dozens of those in one query are what fills a driver."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    try:
        edges = session.cut_lineage(by_rows.range(200_000).select((F.col("id") % 3).alias("scan_id"), "id", F.lit(0).cast("long").alias("b")))
        assert session.BROADCAST_BYTES < _size(edges) < 10 * 1024**2
        plan = by_rows.range(9_000_000).join(edges, "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        for own in ("256k", "-1"):
            by_rows.conf.set(conf, own)
            session.plan_by_rows(by_rows)
            assert by_rows.conf.get(conf) == own
    finally:
        by_rows.conf.unset(conf)


def test_what_a_query_shuffled_goes_when_it_ends(by_rows):
    """Shuffles of steps long written would otherwise stay on disk until the driver collects garbage. A result may still be read twice."""
    disk = by_rows._jsc.sc().env().blockManager().diskBlockManager()
    rows = by_rows.range(200_000).select((F.col("id") % 1009).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    before = disk.getAllFiles().size()
    kept = session.cut_lineage(rows.join(rows.withColumnRenamed("n", "m"), "a"))
    assert kept.count() == 1009 and disk.getAllFiles().size() <= before
    total = rows.groupBy(F.col("n") > 198).agg(F.sum("n").alias("s"))
    assert total.collect() == total.collect()


def test_tables_of_a_step_go_with_it(by_rows):
    """Only the result of a step is left of what was written for it, and of the tables it was the last to read."""
    first = session.cut_lineage(by_rows.range(100).select("id"))
    left = set(session._stages)
    out = session.settled(lambda: session.cut_lineage(first.where("id < 50")).where("id < 20"))
    assert out.count() == 20 and len(set(session._stages) - left) == 1
    last = session.settled(lambda: out.where("id < 5"), out, first)
    assert last.count() == 5 and len(set(session._stages)) == len(left)

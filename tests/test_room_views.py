"""Points of the test rooms: drawn where their scan lies, not shuffled after they are drawn."""

import re

import numpy as np
import pandas as pd
import pytest

from scanfleet import session
from scanfleet.sources import testviews as tv


#: Points shuffled by more than their scan.
BY_MORE = r"Exchange hashpartitioning\(scan_id#\d+L, (?!\d+\))"


@pytest.fixture
def tables(spark, tmp_path):
    """Forty scans, few enough for any plan."""
    n = np.arange(400)
    spark.createDataFrame(pd.DataFrame({"s_suppkey": np.arange(40), "s_name": "s"})).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(pd.DataFrame({"p_partkey": n, "p_size": n % 50})).write.parquet(f"{tmp_path}/part.parquet")
    lines = pd.DataFrame({"l_orderkey": n, "l_partkey": n, "l_suppkey": n % 40, "l_linenumber": (n % 7).astype("int32"), "l_quantity": (n % 50 + 1).astype(float)})
    spark.createDataFrame(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield str(tmp_path)
    session.plan_by_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for c in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.cbo.planStats.enabled", "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        spark.conf.unset(c)


def test_rows_are_dealt_out_by_scan_before_points_are_drawn(spark, tables, monkeypatch):
    points = tv.Fixture(spark, tables).room_points
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_suppkey") == 2 and not re.search(BY_MORE, plan)
    rows = sorted(map(tuple, points.collect()))
    monkeypatch.setattr(tv, "GROUP_LIMIT", 18)  # scans too large for a task span tasks, by all keys of a join
    points = tv.Fixture(spark, tables).room_points
    assert re.search(BY_MORE, points._jdf.queryExecution().executedPlan().toString())
    assert len(rows) > 4000 and sorted(map(tuple, points.collect())) == rows

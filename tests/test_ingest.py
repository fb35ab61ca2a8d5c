"""Raw points of seeded rooms through every step: what passes must be right."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rooms import box_room
from scanfleet.plans.ingest import ingest

ROOMS = 10  # one run covers them all


@pytest.fixture(scope="module")
def twins(spark):
    rng = np.random.default_rng(42)
    frames, cams, sizes = [], [], {}
    for i in range(ROOMS):
        size = (rng.uniform(4.5, 8), rng.uniform(3.2, 4.2), rng.uniform(2.4, 3.2))
        a, c, _ = box_room(i, size=size, spacing=0.09, noise=0.002, scale=[1.0, 100.0, 1000.0][i % 3], tilt=rng.uniform(-5, 5), yaw=rng.uniform(-40, 40), door=False, window=False, seed=i)
        frames.append(a)
        cams.append(c)
        sizes[i] = size
    return sizes, ingest(spark.createDataFrame(pd.concat(frames)), spark.createDataFrame(pd.concat(cams)), min_inliers=150, resolution=0.1)


def test_every_scan_gets_a_verdict(twins):
    sizes, t = twins
    got = {r.scan_id: r.verdict for r in t["verdict"].collect()}
    assert set(got) == set(sizes) and set(got.values()) <= {"pass", "warn", "fail"}


def test_what_is_not_failed_is_true(twins):
    """No room that passes is off by more than 50 mm; rooms in a known unit keep 15 mm on plan and ceiling."""
    sizes, t = twins
    failed = {r.scan_id for r in t["verdict"].collect() if r.verdict == "fail"}
    unit = {r.scan_id: r.unit for r in t["canonical"].collect()}
    ext = t["points"].groupBy("scan_id").agg(*[F.percentile(a, F.array(F.lit(0.005), F.lit(0.995))).alias(a) for a in "xy"]).toPandas().set_index("scan_id")
    levels = {r.scan_id: r for r in t["levels"].collect()}
    trusted = [i for i in sizes if i not in failed and unit[i] != "unknown"]
    assert len(trusted) >= ROOMS // 2
    for i in trusted:
        w, d, h = sizes[i]
        got = [ext.loc[i, a][1] - ext.loc[i, a][0] for a in "xy"]
        assert got[0] == pytest.approx(w, abs=0.05) and got[1] == pytest.approx(d, abs=0.05)
        assert levels[i].ceiling_z - levels[i].floor_z == pytest.approx(h, abs=0.015)

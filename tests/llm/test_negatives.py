import math
import random

import numpy as np
from pyspark.sql import functions as F

from scanfleet.llm import op13_negatives as N


def rows():
    rnd = random.Random(13)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    out = []
    for i in range(1200):
        c = rnd.randrange(7)
        out.append((i, [x + rnd.gauss(0, 0.4) for x in centres[c]], c if rnd.random() < 0.7 else rnd.randrange(7)))
    out += [(2000 + i, centres[0], i % 3) for i in range(300)]  # one vector under three labels: ties
    out += [(3000, None, 1), (3100, [1.0, None] * 3, 1), (3200, [float("nan")] * 6, 1), (3300, [float("inf")] * 6, 2), (None, centres[1], 1), (3400, [0.0] * 6, 1)]
    out += [(3500, centres[2][:4], 2), (3600, [], 3), (3700, centres[3], None), (3800, [-x for x in centres[4]], 4), (3900, centres[5], 99)]
    return out + [(100, [2.0] * 6, 5), (101, out[101][1], out[101][2]), (2007, centres[0], 1)]  # repeated ids and rows


def brute(data, positives=5, negatives=5):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in data if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        score = lambda c: sum(x * y for x, y in zip(v, c))
        others = sorted((-score(c), i, x) for i, x, c in ok if i != a)
        for place, (minus, i, _) in enumerate([r for r in others if r[2] == lab][:positives]):
            held = [(j, -m) for m, j, x in others if x != lab and -80 * minus <= -100 * m <= -100 * minus][:negatives]
            out += [(a, place + 1, i, k + 1, j, -minus, s) for k, (j, s) in enumerate(held)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_rank", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "vec_id long, embedding array<double>, label int, rank int, tile int, v int").repartition(4)
    want = brute(data)
    assert len(want) > 150
    for tile, side, leaf in ((2048, 256, 16), (64, 24, 4)):
        monkeypatch.setattr(N, "TILE", tile)
        monkeypatch.setattr(N, "SIDE", side)
        monkeypatch.setattr(N, "LEAF", leaf)
        got = sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % 100 == 0).select(*COLUMNS).collect())
        assert got == want


def test_few_rows(spark):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>, label int")
    assert N.mine(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert N.mine(df, F.col("vec_id") == -1).count() == 0
    assert N.mine(df.where("vec_id = 200"), F.col("vec_id") % 100 == 0).count() == 0


def test_strassen_is_exact():
    r = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (33, 7, 65), (70, 64, 31), (40, 129, 40)):
        a, b = r.integers(-(2**28), 2**28, (m, k)), r.integers(-(2**28), 2**28, (k, n))
        assert (N.strassen(a, b, 4) == a.astype(object) @ b.astype(object)).all()
    big = np.full((20, 1), 2**61)  # sums on the way pass 64 bits, the product doesn't
    assert (N.strassen(np.hstack([big, big]), np.vstack([np.ones((1, 20)), -np.ones((1, 20))]).astype(np.int64), 1) == 0).all()


def test_heaps_merge():
    rnd = random.Random(2)
    items = [(rnd.randrange(10), rnd.randrange(1000)) for _ in range(200)]
    whole, left, right = N.Heap(7), N.Heap(7), N.Heap(7)
    for x, i in enumerate(items):
        whole.push(*i)
        (left if x % 2 else right).push(*i)
    left.merge(right)
    assert left.best() == whole.best() == sorted(items, key=lambda t: (-t[0], t[1]))[:7]


def test_label_over_many_tiles_meets_its_anchors_only(spark):
    v = N.whole_rows(spark.createDataFrame([(i, [1.0, float(i % 5)], 1 if i % 3 else i) for i in range(900)], "vec_id long, embedding array<double>, label int"), F.col("label"))
    tiles = N.pack(v, 2, "int16", 64).collect()
    assert sum(len(t["ids"]) // 8 for t in tiles) == 900 and all(len(t["ids"]) <= 8 * 64 for t in tiles) and len({t["tile"] for t in tiles}) == len(tiles)
    assert sum(list(t["distinct"]) == [1] for t in tiles) >= 8

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scanfleet.llm import op08_mtree as M


def rows():
    rnd = random.Random(8)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    out = []
    for i in range(1500):
        c = rnd.choice(centres)
        out.append((i, [x + rnd.gauss(0, 0.1) for x in c]))
    out += [(2000 + i, centres[0]) for i in range(400)]
    out += [(3000, None), (3020, [1.0, None] * 4), (3040, [float("nan")] * 8), (3060, [float("inf")] * 8), (None, centres[1]), (3080, [0.0] * 8), (3100, centres[2][:5]), (3120, [])]
    return out + [(40, [9.0] * 8), (41, out[41][1])]


def brute(data, k):
    ok = [(i, np.array([math.floor(64 * x) for x in v] + [0] * (8 - len(v)))) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda a: a.tolist())
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = []
    for i, q in asked.items():
        s = m @ q
        best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:k]
        out += [(i, r + 1, c, -x) for r, (x, c) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<double>, rank int, score int").repartition(5)
    want = brute(data, 20)
    for shard, asked, page in ((8192, 2048, 256), (300, 40, 16)):
        monkeypatch.setattr(M, "SHARD_ROWS", shard)
        monkeypatch.setattr(M, "QUERY_ROWS", asked)
        monkeypatch.setattr(M, "PAGE", page)
        got = sorted(tuple(r) for r in M.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
        assert got == want


def test_large_numbers_and_few_rows(spark):
    data = [(0, [1e7] * 8), (1, [-1e7] * 8), (2, [1e7, 1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in M.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()) == brute(data, 20)
    assert M.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert M.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_skip_pages(spark):
    vectors = spark.createDataFrame([r for r in rows() if r[1] and None not in r[1]], "vec_id long, embedding array<double>")
    v = M.whole_vectors(vectors)
    tree = M.Tree(v.limit(200).collect(), 8, v.agg(F.max("n2")).first()[0], v.count())
    pages = [r.asDict() for r in M.build(v, tree).collect()]
    assert sum(len(p["ids"]) for p in pages) == v.count() and all(len(p["ids"]) <= M.PAGE for p in pages)
    assert all(p["near"] <= d <= p["far"] for p in pages for d in p["parents"])


def test_pages_go_where_they_are_asked_for(spark, monkeypatch):
    """Twice the clusters, twice the rows: each page is still copied to few groups of queries, not to all."""
    copies = []
    real = M.pages_asked_for

    def counted(pages, asked):
        met = real(pages, asked)
        copies.append((met.count(), pages.count(), asked.select("part").distinct().count()))
        return met

    monkeypatch.setattr(M, "pages_asked_for", counted)
    for name, n in (("SHARD_ROWS", 100), ("QUERY_ROWS", 5), ("PAGE", 16)):
        monkeypatch.setattr(M, name, n)
    rnd = random.Random(4)
    for clusters in (8, 16):
        centres = [[rnd.choice([-1.0, 1.0]) * rnd.uniform(3, 9) for _ in range(10)] for _ in range(clusters)]
        data = [(i, [x + rnd.gauss(0, 0.05) for x in centres[i % clusters]]) for i in range(150 * clusters)]
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        got = sorted(tuple(r) for r in M.search(df, F.col("vec_id") % 20 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(data, 5)
    (a, pages_a, groups_a), (b, pages_b, groups_b) = copies
    assert groups_b > 8 and b < 0.7 * pages_b * groups_b and b / pages_b < 3 * a / pages_a

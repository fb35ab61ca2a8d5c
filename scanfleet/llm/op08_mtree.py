"""Exact top-k search by inner product with an M-tree.

Components become floor(64 x). With M the largest norm, the vector (v, sqrt(M^2 - |v|^2)) and the query (q, 0) lie at a distance whose square
is |q|^2 + M^2 - 2 q.v, so the k highest inner products are the k nearest neighbours in a metric space, and bounds by the triangle inequality hold.

Routing objects come from a sample of at most ``SAMPLE`` rows; it decides how good the tree is, never what is found. Every row
goes to its nearest routing object. A routing object's rows become pages of at most ``PAGE`` rows in the order of their distance to it; the
page stores these parent distances and its covering radii. A query's k-th best score within the sample is its first threshold. Pages and queries
meet in blocks of bounded size, queries of neighbouring regions in one; a page goes to the blocks whose queries its radii allow, and to no other. There each query goes best first: pages wait in a heap by the
least distance that their radii allow; of an opened page only the entries whose parent distance lies within the threshold are computed; the
search ends when the nearest waiting page is beyond it. Scores are computed on whole numbers, and pages at the threshold are opened, so ties are
exact. The blocks' best are merged per query.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null vec_id. Vectors of different lengths are compared as if
the shorter were padded with zeros. Rows with the query's own vec_id are no candidates; a vec_id that occurs more than once is asked once, with its
smallest vector, and found as often as it occurs. Scores are 64-bit integers, which components up to some 10**8 keep within. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table

K, SAMPLE, PAGE, REGIONS = 20, 4096, 256, 1024
#: Rows of a block of pages and queries of a block of queries.
SHARD_ROWS, QUERY_ROWS = 8192, 2048


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, v (array of long) and n2, its squared norm, of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return kept.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Tree:
    """What every task knows: the routing objects, M^2, and how to measure."""

    def __init__(self, sample: list, width: int, most: float, rows: int):
        self.width, self.most = width, most
        self.ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
        self.sample = matrix([r["v"] for r in sample], width)
        self.n2 = np.array([r["n2"] for r in sample])
        self.regions = max(1, min(REGIONS, len(sample), math.ceil(rows / PAGE)))
        #: Below 2**53, sums of products are exact in floating point, which BLAS is fast for.
        self.exact = most < 1 << 52
        self.slack = 1e-7 * math.sqrt(most + 1.0)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return a.astype(np.float64) @ b.astype(np.float64).T
        return (a @ b.T).astype(np.int64)

    def lift(self, n2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - n2.astype(np.float64)))

    def to_routing(self, v: np.ndarray, n2: np.ndarray, query: bool) -> np.ndarray:
        """Distances to all routing objects."""
        p, pn2 = self.sample[: self.regions], self.n2[: self.regions]
        flat = n2[:, None].astype(np.float64) + pn2[None, :] - 2.0 * self.products(v, p)
        height = (0.0 if query else self.lift(n2)[:, None]) - self.lift(pn2)[None, :]
        return np.sqrt(np.maximum(0.0, flat + height * height))

    def reach(self, n2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a candidate has ``score``; infinite where there is none yet."""
        return np.where(np.isneginf(score), np.inf, np.sqrt(np.maximum(0.0, n2.astype(np.float64) + self.most - 2.0 * score)))

    def first_scores(self, v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query within the sample, which the true one reaches or passes."""
        scores = self.products(v, self.sample).astype(np.float64)
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(v), -np.inf)


def by_region(rows: DataFrame, most: int) -> Column:
    """The number of a row's group: some whole regions that follow each other, or by hash a part of a region that has more than ``most`` rows."""
    counts = {r["region"]: r["count"] for r in rows.groupBy("region").count().collect()}  # at most REGIONS rows
    if not counts:
        return F.lit(0)
    group, filled, first, salts = 0, 0, {}, {g: math.ceil(n / most) for g, n in counts.items()}
    for g in sorted(counts):
        if filled and filled + counts[g] > most:
            group, filled = group + 1, 0
        first[g] = group
        group, filled = (group + salts[g], 0) if salts[g] > 1 else (group, filled + counts[g])
    of = lambda values: F.create_map(*[F.lit(x) for g in values for x in (g, values[g])])[F.col("region")]
    # hashed with the vector, so that different rows of one vec_id don't meet in one part
    return of(first) + F.pmod(F.xxhash64("vec_id", "v"), of(salts)).cast("int")


def build(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Pages: region, shard, near and far (radii), ids, parents (distances) and the vectors' bytes."""

    def route(batches):
        for batch in batches:
            v = matrix(batch["v"].to_pylist(), tree.width)
            d = tree.to_routing(v, batch["n2"].to_numpy(), query=False)
            region = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(region.astype(np.int32)), pa.array(d[np.arange(len(v)), region])], names=["vec_id", "v", "region", "parent"])

    routed = cut_lineage(vectors.mapInArrow(route, "vec_id bigint, v array<bigint>, region int, parent double"))

    def pages(group: pa.Table) -> pa.Table:
        group = group.sort_by([("region", "ascending"), ("parent", "ascending"), ("vec_id", "ascending")])
        region, parent, ids = group["region"].to_numpy(), group["parent"].to_numpy(), group["vec_id"].to_numpy()
        v = matrix(group["v"].to_pylist(), tree.width)
        ends = np.flatnonzero(np.concatenate([region[1:] != region[:-1], [True]])) + 1
        out, begin = [], 0
        for end in ends:
            for i in range(begin, end, PAGE):
                j = min(i + PAGE, end)
                out.append({"shard": int(group["shard"][0].as_py()), "region": int(region[i]), "near": parent[i], "far": parent[j - 1], "ids": ids[i:j], "parents": parent[i:j], "vectors": v[i:j].tobytes()})
            begin = end
        return pa.Table.from_pylist(out, schema=_PAGE)

    return cut_lineage(routed.withColumn("shard", by_region(routed, SHARD_ROWS)).groupBy("shard").applyInArrow(pages, _PAGE_DDL))


_PAGE = pa.schema([("shard", pa.int32()), ("region", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.list_(pa.int64())), ("parents", pa.list_(pa.float64())), ("vectors", pa.binary())])
_PAGE_DDL = "shard int, region int, near double, far double, ids array<bigint>, parents array<double>, vectors binary"


def best_first(tree: Tree, k: int, q: np.ndarray, own: int, n2: float, to_routing: np.ndarray, floor_score: float, pages: list[dict]) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best candidates in ``pages`` that reach ``floor_score``, highest first, ties to the smaller id."""
    best: list[tuple[int, int]] = []  # a heap; its least is the k-th so far
    reach = math.sqrt(max(0.0, n2 + tree.most - 2.0 * floor_score)) if floor_score > -math.inf else math.inf
    waiting = []
    for i, p in enumerate(pages):
        d = to_routing[p["region"]]
        least = max(0.0, d - p["far"], p["near"] - d)
        if least <= reach + tree.slack:
            waiting.append((least, i))
    heapq.heapify(waiting)
    while waiting:
        least, i = heapq.heappop(waiting)
        if least > reach + tree.slack:
            break
        p = pages[i]
        d = to_routing[p["region"]]
        a, b = np.searchsorted(p["parents"], [d - reach - tree.slack, d + reach + tree.slack]) if reach < math.inf else (0, len(p["parents"]))
        if a == b:
            continue
        scores = p["floats"][a:b] @ q.astype(np.float64) if tree.exact else p["whole"][a:b] @ q
        low = best[0][0] if len(best) == k else floor_score
        for j in np.flatnonzero(scores >= low):
            vec_id = int(p["ids"][a + j])
            if vec_id != own:
                entry = (int(scores[j]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        if len(best) == k:
            reach = min(reach, math.sqrt(max(0.0, n2 + tree.most - 2.0 * best[0][0])))
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def pages_asked_for(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Pages with ``part``: once for each group of queries of which one asks for their shard, and nowhere else."""
    pairs = asked.select(F.col("shard").alias("shard"), F.col("part").alias("part")).distinct()
    return pages.join(pairs, "shard")


def search(rows: DataFrame, queries: Column, k: int = K, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``rows`` where ``queries`` holds, its k best candidates among all others."""
    vectors = cut_lineage(whole_vectors(rows, vector))
    told = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("most"), F.max(F.size("v")).alias("width")).first()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    tree = Tree(sample, told["width"] or 1, told["most"] or 0.0, told["n"])
    pages = build(vectors, tree)
    shards = pages.groupBy("shard", "region").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    # radii of a shard's regions: a row for each region, and for each part of a large one
    radii: dict[int, list[tuple[int, float, float]]] = {}
    for r in shards.collect():
        radii.setdefault(r["shard"], []).append((r["region"], r["near"], r["far"]))
    asked = vectors.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"), F.min(F.struct("v", "n2")).alias("s")).select("vec_id", "v", "s.n2")

    def route(batches):
        for batch in batches:
            d = tree.to_routing(matrix(batch["v"].to_pylist(), tree.width), batch["n2"].to_numpy(), query=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32))], names=[*batch.schema.names, "region"])

    # queries of neighbouring regions share a group, so that a group asks few shards
    routed = cut_lineage(asked.mapInArrow(route, "vec_id bigint, v array<bigint>, n2 double, region int"))
    dealt = routed.withColumn("part", by_region(routed, QUERY_ROWS)).drop("region")

    def spread(batches):
        """Each query with its first threshold, once for each shard that can hold a candidate."""
        for batch in batches:
            v, n2, ids = matrix(batch["v"].to_pylist(), tree.width), batch["n2"].to_numpy(), batch["vec_id"].to_numpy()
            score = tree.first_scores(v, ids, k)
            reach, d = tree.reach(n2, score) + tree.slack, tree.to_routing(v, n2, query=True)
            for shard, parts in radii.items():
                region, near, far = (np.array(x) for x in zip(*parts))
                hit = (np.maximum(d[:, region] - far, near - d[:, region]) <= reach[:, None]).any(axis=1)
                if hit.any():
                    rows_ = batch.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays(
                        [rows_["vec_id"], rows_["v"], rows_["n2"], rows_["part"], pa.array(np.full(rows_.num_rows, shard, dtype=np.int32)), pa.array(score[hit])], names=["vec_id", "v", "n2", "part", "shard", "score"]
                    )

    spread_out = cut_lineage(dealt.mapInArrow(spread, "vec_id bigint, v array<bigint>, n2 double, part int, shard int, score double"))
    met = pages_asked_for(pages, spread_out)

    def find(asked_: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        held = found.to_pylist() if asked_.num_rows else []
        for p in held:
            p["ids"], p["parents"] = np.array(p["ids"], dtype=np.int64), np.array(p["parents"])
            p["whole"] = np.frombuffer(p["vectors"], dtype=np.int64).reshape(len(p["ids"]), tree.width)
            p["floats"] = p["whole"].astype(np.float64)
        for i in range(0, asked_.num_rows if held else 0, 256):
            part = asked_.slice(i, 256)
            v, n2, ids = matrix(part["v"].to_pylist(), tree.width), part["n2"].to_numpy(), part["vec_id"].to_numpy()
            d, floors = tree.to_routing(v, n2, query=True), part["score"].to_numpy()
            for x in range(len(v)):
                best = best_first(tree, k, v[x], int(ids[x]), float(n2[x]), d[x], float(floors[x]), held)
                out["query_id"] += [int(ids[x])] * len(best)
                out["vec_id"] += [c for _, c in best]
                out["score"] += [s for s, _ in best]
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    kept = spread_out.groupBy("shard", "part").cogroup(met.groupBy("shard", "part")).applyInArrow(find, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


@query("op8_mtree_top_k", SQL)
def op8_mtree_top_k(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)

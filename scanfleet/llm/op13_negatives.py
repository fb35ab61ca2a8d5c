"""Hard negatives for contrastive training: per anchor and positive, the best-scoring rows of another label inside a score window.

Scores are integer inner products. Rows are sorted by label and packed into tiles of at most ``TILE`` rows; the anchors, too, are packed into blocks. A
block of anchors and a tile of candidates give a block of scores by Strassen's recursion on int64 matrices, padded with zeros to even sides: seven products
of half the size and additions of whole numbers, down to ``LEAF``. Integer additions lose nothing, and as int64 arithmetic is a ring modulo 2**64, a
score is exact whenever it fits 64 bits itself, whatever the sums on the way are.

First, blocks meet the tiles that share a label with them; each anchor keeps a bounded heap of its best positives. Then, all blocks meet all tiles, and each
pair of anchor and positive keeps a bounded heap of what lies in its window. Heaps of the same anchor merge: those of a block and a tile are merged per
anchor by Spark's ranked windows, which cut to the best before and after the shuffle. No task holds more than one block, one tile and their heaps.

Rows with a null vec_id, label or vector, or a null or non-finite component take no part. Vectors of different lengths are compared as if the shorter were
padded with zeros. Rows with the anchor's own vec_id are neither positives nor negatives of it. A vec_id that occurs more than once is an anchor once, with its
smallest (label, vector), and is found as often as it occurs; equal rows get ranks next to each other. Ties go to the smaller vec_id. A window below
zero (a negative positive_score) is empty. An empty table, or one without anchors, gives no rows. Other columns are ignored.
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

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: Rows of a tile of candidates and of a block of anchors, at most; fewer where vectors are long.
TILE, CELLS = 2048, 1 << 20
#: Sides of the score blocks that are multiplied at once, and the side at which the recursion ends.
SIDE, LEAF = 256, 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, i, j = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (2 * h, 2 * i, 2 * j) != (m, k, n):
        a = np.pad(a, ((0, 2 * h - m), (0, 2 * i - k)))
        b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - n)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * h, 2 * j), dtype=np.int64)
    c[:h, :j] = p1 + p4 - p5 + p7
    c[:h, j:] = p3 + p5
    c[h:, :j] = p2 + p4
    c[h:, j:] = p1 - p2 + p3 + p6
    return c[:m, :n]


class Heap:
    """The ``k`` best (score, vec_id) seen: higher scores first, then smaller ids. Two heaps merge into one."""

    __slots__ = ("k", "items")

    def __init__(self, k: int):
        self.k, self.items = k, []

    @property
    def floor(self) -> int | None:
        """A score below this can't enter."""
        return self.items[0][0] if len(self.items) == self.k else None

    def push(self, score: int, vec_id: int) -> None:
        if len(self.items) < self.k:
            heapq.heappush(self.items, (score, -vec_id))
        elif (score, -vec_id) > self.items[0]:
            heapq.heapreplace(self.items, (score, -vec_id))

    def merge(self, other: Heap) -> None:
        for score, minus in other.items:
            self.push(score, -minus)

    def best(self) -> list[tuple[int, int]]:
        return [(s, -i) for s, i in sorted(self.items, reverse=True)]


def whole_rows(rows: DataFrame, label: Column, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (array of long) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


_PACK = pa.schema([("tile", pa.int64()), ("distinct", pa.list_(pa.int64())), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("rest", pa.binary())])
_PACK_DDL = "tile bigint, distinct array<bigint>, ids binary, labels binary, vectors binary, rest binary"


def _matrix(vectors: pa.Array, width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _packed(tile: int, rows: pa.Table, width: int, kind: str) -> pa.Table:
    labels = rows["label"].to_numpy()
    v = _matrix(pa.concat_arrays(rows["v"].chunks), width, kind)
    rest = pa.concat_arrays(rows["rest"].chunks).flatten().to_numpy().tobytes() if "rest" in rows.column_names else b""
    values = [tile], [np.unique(labels)], [rows["vec_id"].to_numpy().tobytes()], [labels.tobytes()], [v.tobytes()], [rest]
    return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(values, _PACK)], schema=_PACK)


def pack(rows: DataFrame, width: int, kind: str, most: int) -> DataFrame:
    """Tiles of at most ``most`` rows that follow each other by label and vec_id. A label of any size is spread over as many tiles
    as it fills, and a tile is cut off as soon as it is full, so that no task holds a whole label."""
    ordered = rows.repartitionByRange("label", "vec_id", F.xxhash64("v")).sortWithinPartitions("label", "vec_id")

    def packed(batches):
        from pyspark import TaskContext

        first, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield from _packed(first + made, pa.Table.from_batches(held), width, kind).to_batches()
                    made, held, n = made + 1, [], 0
        if n:
            yield from _packed(first + made, pa.Table.from_batches(held), width, kind).to_batches()

    return ordered.mapInArrow(packed, _PACK_DDL)


def deal(rows: DataFrame, width: int, kind: str, blocks: int) -> DataFrame:
    """Blocks 0 to ``blocks`` - 1 of rows with distinct vec_id, by hash."""
    at = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return rows.withColumn("_block", at).groupBy("_block").applyInArrow(lambda key, held: _packed(key[0].as_py(), held, width, kind), _PACK_DDL)


class Tile:
    def __init__(self, packed: pa.Table, width: int, kind: str):
        row = {c: packed[c][0].as_py() for c in ("ids", "labels", "vectors", "rest")}
        self.ids, self.labels = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64)
        self.v = np.frombuffer(row["vectors"], dtype=kind).reshape(len(self.ids), width).astype(np.int64)
        self.rest = np.frombuffer(row["rest"], dtype=np.int64)


def scores(block: Tile, tile: Tile, side: int, leaf: int):
    """(anchors, candidates, their scores) for squares of the block and the tile; the first two are slices."""
    for j in range(0, len(tile.ids), side):
        right = np.ascontiguousarray(tile.v[j : j + side].T)
        for i in range(0, len(block.ids), side):
            yield slice(i, i + side), slice(j, j + side), strassen(block.v[i : i + side], right, leaf)


def feed(heap: Heap, row: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
    """Push what fits and can still enter. Of many equal scores the heap keeps the smaller ids."""
    low = heap.floor
    at = np.flatnonzero(fits if low is None else fits & (row >= low))
    if len(at) > heap.k:  # no more than the k best of this square can stay
        order = np.lexsort((ids[at], -row[at]))[: heap.k]
        at = at[order]
    for x in at:
        heap.push(int(row[x]), int(ids[x]))


_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor_id bigint, place int, vec_id bigint, score bigint"


def _found(heaps: dict[tuple[int, int], Heap]) -> pa.Table:
    flat = [(a, p, i, s) for (a, p), h in heaps.items() for s, i in h.best()]
    return pa.Table.from_arrays([pa.array([r[c] for r in flat], type=f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)


def best_positives(width: int, kind: str, k: int):
    """For each anchor of a block, the heap of its best rows of the same label in a tile."""

    side, leaf = SIDE, LEAF

    def meet(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], Heap] = {}
        if anchors.num_rows and candidates.num_rows:
            block, tile = Tile(anchors, width, kind), Tile(candidates, width, kind)
            for a, c, square in scores(block, tile, side, leaf):
                labels, ids = tile.labels[c], tile.ids[c]
                for own, label, row in zip(block.ids[a].tolist(), block.labels[a], square):
                    fits = (labels == label) & (ids != own)
                    if fits.any():
                        feed(heaps.setdefault((own, 0), Heap(k)), row, ids, fits)
        return _found(heaps)

    return meet


def window_negatives(width: int, kind: str, places: int, k: int):
    """For each anchor of a block and each of its positives, the heap of the rows of other labels in a tile that lie in the window.
    ``rest`` of an anchor holds a flag and the two bounds of each place."""

    side, leaf = SIDE, LEAF

    def meet(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], Heap] = {}
        if anchors.num_rows and candidates.num_rows:
            block, tile = Tile(anchors, width, kind), Tile(candidates, width, kind)
            bounds = block.rest.reshape(len(block.ids), places, 3)
            for a, c, square in scores(block, tile, side, leaf):
                labels, ids, told = tile.labels[c], tile.ids[c], bounds[a]
                # most rows have no score in the widest of an anchor's windows
                some = told[:, :, 0] == 1
                low = np.where(some, told[:, :, 1], np.iinfo(np.int64).max).min(axis=1)
                high = np.where(some, told[:, :, 2], np.iinfo(np.int64).min).max(axis=1)
                may = (square >= low[:, None]) & (square <= high[:, None]) & (labels[None, :] != block.labels[a, None])
                for x in np.flatnonzero(may.any(axis=1)):
                    row, own = square[x], int(block.ids[a][x])
                    other = may[x] & (ids != own)
                    for place in np.flatnonzero(some[x]):
                        fits = other & (row >= told[x, place, 1]) & (row <= told[x, place, 2])
                        if fits.any():
                            feed(heaps.setdefault((own, int(place)), Heap(k)), row, ids, fits)
        return _found(heaps)

    return meet


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each key: the heaps of all tiles merged."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(blocks: DataFrame, tiles: DataFrame, pairs: DataFrame, meet) -> DataFrame:
    """Each pair (block, tile) in a task of its own."""
    names = [F.col(c) for c in blocks.columns if c != "tile"]
    left = blocks.select(F.col("tile").alias("block"), *names).join(pairs.select(F.col("block").alias("block"), F.col("tile").alias("at")), "block")
    right = tiles.join(pairs.select(F.col("tile").alias("tile"), F.col("block").alias("with")), "tile")
    return left.groupBy("block", "at").cogroup(right.groupBy("with", "tile")).applyInArrow(meet, _FOUND_DDL)


def mine(
    rows: DataFrame, anchors: Column, label: str | Column = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low_percent: int = 80, high_percent: int = 100, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, with the positive's ``positive_rank``: for each row of ``rows``
    where ``anchors`` holds and each of its best ``positives`` of the same label, the best ``negatives`` of other labels whose
    score lies between ``low_percent`` and ``high_percent`` of the positive's."""
    vectors = cut_lineage(whole_rows(rows, F.col(label) if isinstance(label, str) else label, vector, scale))
    told = vectors.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low"), F.count_if(anchors).alias("anchors")).first()
    width = max(1, told["width"] or 1)
    kind = next(k for k in ("int16", "int32", "int64") if max(told["high"] or 0, -1 - (told["low"] or 0)) <= np.iinfo(k).max)
    most = max(16, min(TILE, CELLS // width))
    tiles = cut_lineage(pack(vectors, width, kind, most))
    asked = cut_lineage(vectors.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v"))

    sorted_ = cut_lineage(pack(asked, width, kind, most))
    of_tile = tiles.select("tile", F.explode("distinct").alias("label"))
    of_block = sorted_.select(F.col("tile").alias("block"), F.explode("distinct").alias("label"))
    same = cut_lineage(of_block.join(of_tile, "label").select("block", "tile").distinct())
    best = _ranked(_met(sorted_, tiles, same, best_positives(width, kind, positives)), positives, "anchor_id")
    kept = cut_lineage(best.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # exact bounds in whole numbers: low*p <= 100*s <= high*p, without overflow for any score of 64 bits
    p = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(p * low_percent / 100), F.floor(p * high_percent / 100)
    spans = kept.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_rank", low.cast("long").alias("low"), high.cast("long").alias("high"))).alias("spans"))
    at = F.map_from_entries(F.transform("spans", lambda s: F.struct(s["positive_rank"], F.array(F.lit(1).cast("long"), s["low"], s["high"]))))
    none = F.array(*[F.lit(0).cast("long")] * 3)
    rest = F.flatten(F.array(*[F.coalesce(F.element_at("at", i + 1), none) for i in range(positives)]))
    bounded = asked.join(spans.select("vec_id", at.alias("at")), "vec_id").select("vec_id", "label", "v", rest.alias("rest"))
    blocks = max(1, math.ceil(told["anchors"] / most))
    dealt = cut_lineage(deal(bounded, width, kind, blocks))
    every = tiles.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = _ranked(_met(dealt, tiles, every, window_negatives(width, kind, positives, negatives)), negatives, "anchor_id", "place")
    out = found.select("anchor_id", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(kept, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT g.anchor_id, g.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.vec_id AS negative_id, g.positive_score, p.score AS negative_score
FROM g JOIN p ON p.anchor_id = g.anchor_id AND p.label <> p.own AND 80 * g.positive_score <= 100 * p.score AND p.score <= g.positive_score
WINDOW w AS (PARTITION BY g.anchor_id, g.positive_id ORDER BY p.score DESC, p.vec_id)
QUALIFY row_number() OVER w <= 5"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label).drop("positive_rank")

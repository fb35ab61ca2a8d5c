"""Exact order statistics and row numbers that do not need a whole group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and a window sorts a whole group in
one task. Both are right choices for ordinary scans and wrong for a scan holding a third of all points, so each
function here checks the largest group first and narrows big groups before it ranks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of one group that one task may rank or buffer.
GROUP_LIMIT = 2_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("m")).first()
    return int(row["m"] or 0)


def percentiles(df: DataFrame, keys: list[str], value: Column, qs: dict[str, float], limit: int | None = None) -> DataFrame:
    """Linear-interpolation percentiles per group: ``keys + list(qs)``; null values are ignored."""
    limit = GROUP_LIMIT if limit is None else limit
    base = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names = list(qs)
    if largest_group(base, keys) <= limit:
        picked = base.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(qs[n])) for n in names])).alias("_p"))
        return picked.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pos = F.col("q") * (F.col("_n") - 1)
    grid = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(qs[n])).alias("q")) for n in names])
    wanted = (
        sizes.select(*keys, "_n", F.inline(grid))
        .withColumn("_pos", pos)
        .select(*keys, "name", "_pos", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    )
    ranks = wanted.select(*keys, "_rank").distinct()
    found = _select_ranks(base, keys, ranks, limit)
    weight = F.when(F.floor("_pos") == F.ceil("_pos"), F.lit(1.0)).otherwise(1.0 - F.abs(F.col("_pos") - F.col("_rank")))
    joined = wanted.join(found, keys + ["_rank"]).groupBy(*keys, "name").agg(F.sum(F.col("_v") * weight).alias("_p"))
    return joined.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in names])


def ranked_value(df: DataFrame, keys: list[str], value: Column, rank: Column, name: str, limit: int | None = None) -> DataFrame:
    """The value at zero-based sorted position ``rank`` (an expression over the group size ``_n``)."""
    limit = GROUP_LIMIT if limit is None else limit
    base = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if largest_group(base, keys) <= limit:
        w = Window.partitionBy(*keys)
        ranked = base.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy("_v")) - 1)
        return ranked.where(F.col("_r") == rank).select(*keys, F.col("_v").alias(name))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sizes.select(*keys, rank.cast("long").alias("_rank"))
    return _select_ranks(base, keys, ranks, limit).select(*keys, F.col("_v").alias(name))


def _select_ranks(base: DataFrame, keys: list[str], ranks: DataFrame, limit: int) -> DataFrame:
    """Values at exact ranks of big groups: ``keys, _rank, _v``.

    Copies collapse to (value, count) first. While a group still has more than ``limit`` distinct values, a
    mergeable quantile sketch cuts it into about a hundred value ranges, the ranges are counted, and only the one
    that holds the wanted rank stays. The sketch only chooses where to cut; counting is exact, so the answer is too.
    """
    vals = cut_lineage(base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w")))
    todo = cut_lineage(ranks.select(*keys, "_rank", F.lit(0).cast("long").alias("_below")))
    by = keys + ["_rank"]
    rows = vals.join(todo, keys)
    while True:
        size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        if size <= limit:
            break
        cuts = rows.groupBy(*by).agg(
            F.percentile_approx("_v", F.array(*[F.lit(i / 100.0) for i in range(101)]), F.lit(10_000)).alias("_cuts")
        )
        below = (
            rows.join(cuts, by)
            .withColumn("_i", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))
            .groupBy(*by, "_i")
            .agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min("_below").alias("_b"))
        )
        run = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        hit = (
            below.withColumn("_end", F.sum("_w").over(run) + F.col("_b")).withColumn("_start", F.col("_end") - F.col("_w"))
            .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
            .select(*by, "_lo", "_hi", F.col("_start").alias("_nb"))
        )
        rows = cut_lineage(
            rows.join(hit, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .select(*by, "_v", "_w", F.col("_nb").alias("_below"))
        )
    run = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_w").over(run) + F.col("_below")
    return (
        rows.withColumn("_end", end)
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_w")))
        .select(*by, "_v")
    )


def row_index(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Add ``idx`` (zero-based position in ``order`` within ``keys``) and ``total`` (group size).

    Ordinary groups use one window. When some group is too big for one task, rows are range-partitioned, so a
    big group spans many partitions, and the counts of earlier partitions are added to a local row number.
    """
    limit = GROUP_LIMIT if limit is None else limit
    w = Window.partitionBy(*keys)
    if largest_group(df, keys) <= limit:
        return df.withColumn("idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn(
            "total", F.count(F.lit(1)).over(w)
        )
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    placed = cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    base = counts.select(
        *keys, "_part",
        (F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_base"),
        F.sum("_c").over(w).alias("total"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return (
        placed.join(base, keys + ["_part"]).withColumn("idx", (F.col("_base") + local).cast("long")).drop("_part", "_base")
    )

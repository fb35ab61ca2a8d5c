"""N-gram Jaccard join: documents whose sets of word five-grams have a similarity of 0.8 or more are linked.

Each distinct set gets MinHash band keys, with as few bands as find a pair at the threshold with the target recall. Sets that share
a band's key meet in a bucket and are verified on their full n-gram sets, each pair in the first band that it shares and nowhere else.

Equal sets are one member with a count of copies, so copies are never paired. A bucket is a square of blocks when it is
large: its members are dealt into parts by hash, and a block holds two parts. A block is some thousand texts at most, however many
members the bucket has. It gives a row per member, its links and its block's smallest linked set, not its pairs. Links
are summed, and classes are the components of those rows.

Words are lower-cased runs without white space. A text of fewer than five words is one n-gram; null texts and texts without
words have none, are linked to nothing and are classes of their own. Repeated rows are copies of each other. Null doc_ids take part; a
class is named after its smallest doc_id. An empty table gives no rows. ``deduplicate`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import connected_components
from ..session import cut_lineage
from .batches import slices
from .names import free
from .ngrams import MinHash, bands_for, ngram_set
from .registry import query, table

SIMILARITY, WORDS, ROWS, RECALL = 0.8, 5, 6, 0.9999
#: Members of one part of a bucket and code points of their texts.
PART_MEMBERS, PART_CHARS = 1024, 1 << 24


def with_bands(docs: DataFrame, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """``docs`` with _set: the set's key, size and band keys; null for a text without words."""
    kind = pa.struct([("key", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<key:bigint,check:bigint,bands:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        minhash = MinHash(bands, rows)
        for texts in slices(batches):
            out = []
            for t in texts:
                ngrams = ngram_set(t.as_py(), words)
                if not len(ngrams):
                    out.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(ngrams.tobytes()), dtype=np.int64)
                out.append({"key": int(digest[0]), "check": int(digest[1]), "bands": minhash.band_keys(ngrams).view(np.int64)})
            yield pa.array(out, type=kind)

    return docs.withColumn("_set", of(F.col(text)))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, from columns of the elements that more than one set has."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    group = np.cumsum(first) - 1
    shared = np.bincount(group)[group] > 1
    row, column = row[shared], group[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(256, (1 << 23) // len(sets))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        here = slice(*np.searchsorted(column, [a, a + width]))
        part = np.zeros((len(sets), min(width, int(column[-1]) + 1 - a)), dtype=np.float32)
        part[row[here], column[here] - a] = 1
        out += part @ part.T
    return out


def links_in_block(keys, parts, sets, bands, band: int, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which members are linked here, as a matrix, and the smallest key of each one's component. Only pairs whose first shared band is this
    one count, and in a block of two parts only pairs across them."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    inter = common(sets)
    linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        linked &= parts[:, None] != parts[None, :]
    a, b = np.nonzero(np.triu(linked))
    if band and len(a):
        for i in range(0, len(a), 65536):
            x, y = a[i : i + 65536], b[i : i + 65536]
            earlier = (bands[x, :band] == bands[y, :band]).any(axis=1)
            linked[x[earlier], y[earlier]] = linked[y[earlier], x[earlier]] = False
    root = np.arange(len(keys))
    order = np.argsort(keys)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = root
    while True:  # the smallest rank spreads along links
        least = np.minimum(rank, np.where(linked, rank[None, :], len(keys)).min(axis=1))
        if (least == rank).all():
            return linked, keys[order[rank]]
        rank = least


def similar_sets(docs: DataFrame, sets: DataFrame, text: str, words: int, bands: int, threshold: float) -> DataFrame:
    """key, links and root of every linked set, a row per block: ``sets`` has key, bands, copies and one row that
    holds the text of each (doc_id, text_key)."""
    spots = sets.select("key", "n_chars", F.posexplode("bands").alias("band", "bucket"))
    sizes = spots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n_chars").alias("chars")).where("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / PART_MEMBERS), F.ceil(F.col("chars") / PART_CHARS)).cast("int")
    placed = cut_lineage(spots.join(sizes, ["band", "bucket"]).select("key", "band", "bucket", parts.alias("parts")))
    wanted = sets.join(placed.select("key").distinct(), "key", "left_semi").select("key", "bands", "copies", "doc_id", "text_key")
    texts = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    full = wanted.join(texts, same).select("key", "bands", "copies", "text")
    part = F.pmod(F.xxhash64("key", "band"), F.col("parts")).cast("int")
    dealt = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = dealt.select("key", "band", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    rows = block.join(full, "key").repartition("band", "bucket", "low", "high").sortWithinPartitions("band", "bucket", "low", "high", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: list[tuple]) -> pa.RecordBatch | None:
            members = {r["key"]: r for _, r in held}  # repeated rows bring a set twice
            if len(members) < 2:
                return None
            (band, _, low, high), rows_ = held[0][0], list(members.values())
            keys = np.array([r["key"] for r in rows_])
            copies = np.array([r["copies"] for r in rows_], dtype=np.int64)
            linked, root = links_in_block(
                keys, np.array([r["part"] for r in rows_]), [ngram_set(r["text"], words) for r in rows_], np.array([r["bands"] for r in rows_]), band, low != high, threshold
            )
            links = linked @ copies
            kept = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(links[kept]), pa.array(root[kept])], names=["key", "links", "root"])

        held: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    at = (r["band"], r["bucket"], r["low"], r["high"])
                    if held and held[0][0] != at:
                        out = finish(held)
                        held = []
                        if out is not None and out.num_rows:
                            yield out
                    held.append((at, r))
        out = finish(held)
        if out is not None and out.num_rows:
            yield out

    return rows.mapInArrow(verify, "key bigint, links bigint, root bigint")


def join(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row per document: doc_id, text_key (xxhash64 of the text), class_id and n_links, the number of other documents linked to it."""
    bands = bands_for(similarity, rows, recall)
    base = docs.select("doc_id", F.col(text).alias("text"))
    signed = with_bands(base.withColumn("text_key", F.xxhash64("text")).withColumn("n_chars", F.length("text")), "text", words, bands, rows)
    members = cut_lineage(signed.select("doc_id", "text_key", "n_chars", "_set.key", "_set.check", "_set.bands"))
    keyed = members.where(F.col("key").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n_chars", "bands"))
    # sets are told apart by 128 bits; from here on a number that is written once stands for each
    sets = keyed.groupBy("key", "check").agg(F.count(F.lit(1)).alias("copies"), first.alias("f"))
    sets = cut_lineage(sets.select(F.monotonically_increasing_id().alias("id"), "key", "check", "copies", "f.doc_id", "f.text_key", "f.n_chars", "f.bands"))
    found = cut_lineage(similar_sets(base, sets.drop("key", "check").withColumnRenamed("id", "key"), "text", words, bands, similarity)).withColumnRenamed("key", "id")
    one = F.lit(0).alias("all")
    edges = found.where("id != root").select(one, F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    components = connected_components(edges, found.select(one, "id"), ["all"]).select("id", "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = sets.join(links, "id", "left").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = known.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_set = known.join(names, "component").select("key", "check", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(of_set, ["key", "check"], "left").select(
        "doc_id", "text_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("key").isNotNull().alias("_has")
    )


def deduplicate(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id, and of the smallest text_key where ids repeat. Of rows that
    repeat both, one stays. Documents without words stay."""
    joined = join(docs, text, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = joined.where("_has").groupBy("class_id").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_key")
    ranked = first.union(joined.where("NOT _has").select("doc_id", "text_key")).distinct()
    key = free(docs, "_text_key")
    ranked = ranked.select(F.col("doc_id").alias((of_id := free(docs, "_of"))), F.col("text_key").alias((of_key := free(docs, "_of_key"))))
    keyed = docs.withColumn(key, F.xxhash64(text))
    chosen = keyed.join(ranked, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left_semi")
    return chosen.dropDuplicates(["doc_id", key]).drop(key)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE w <> ['']) t),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE k >= 0.8 * (nx.n + ny.n - k) - 1e-9),
c AS (WITH RECURSIVE reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x) SELECT x, y FROM reach)
SELECT d.doc_id, m.class_id, coalesce(l.n_links, 0) AS n_links
FROM d JOIN (SELECT c.x, min(o.doc_id) AS class_id FROM c JOIN d o ON o.r = c.y GROUP BY c.x) m ON m.x = d.r
LEFT JOIN (SELECT x, count(*) AS n_links FROM e GROUP BY x) l ON l.x = d.r"""


@query("op2_ngram_join", SQL)
def op2_ngram_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")

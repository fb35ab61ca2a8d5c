"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line is what stands between line breaks, lower-cased and with single spaces. Every line that isn't blank is compared, in the order of doc_id, text_key (a
hash of the text) and line number; blank lines always stay. A line goes if an earlier line is the same, or if an earlier one is at an edit distance of one and
neither is shorter than ten units: one edit is a tenth of the line at most. The unit is the word in lines of ``fuzzy_words`` words or more, and the character in lines of
fewer, such as those of a script without spaces. Whether that earlier line stays itself doesn't matter.

Equal lines are one, with their first place. Of the others, only those that share a half with another line can lie within the bound, since one
edit leaves one half as it is; that is an exact filter on two or four keys a line. What is left emits its whole neighbourhood as hashed keys: the
line without each of its words, and the line itself with a gap at each place. A key is the hash of what stands before and after, so lines
that share one are all within one edit of each other. Each is joined to the earliest of its key, never to all, and the distance is
verified on the words. Lines are told apart by 128 bits of hash, candidates by a number of their own.

Null texts stay null; empty texts stay as they are; a text that loses all lines is empty. Rows that agree in doc_id and text are one document
given twice: they keep the same lines. Null doc_ids come last. An empty table gives an empty table. A column that already has the output's name is replaced; all
others stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import free
from .registry import query, table

FUZZY_WORDS = 10
#: Characters from which on a line of few words can have near ones: under ten, a tenth of the line is less than one edit.
FUZZY_CHARS = 10
#: Document keys that may be broadcast: 16 bytes each. Above, documents are shuffled instead.
BROADCAST_ROWS = 500_000

_PLACE = "struct<none:boolean,doc_id:bigint,text_key:bigint,line_no:int>"


def normal(line: Column) -> Column:
    """Lower case, single spaces. The regular expression is left to lines with other white space or a run of it."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def _step(n: Column) -> Column:
    """The largest whole power of 1.25, rounded down, that n reaches: neighbouring lengths mostly have the same."""
    return F.floor(F.pow(F.lit(1.25), F.floor(F.log(1.25, n) + 1e-9))).cast("int")


def _halves(line: Column, n: Column, chars: bool = False) -> Column:
    """Hashes of the first and last m words, or characters. Two lines within one edit share the first or the last half of the shorter one, so also
    any smaller m; each line has the m of its own length and of one word less, which are mostly the same."""

    def ends(m: Column) -> list[Column]:
        if chars:
            return [F.xxhash64(F.lit("chars"), F.lit(side), m, F.substring(line, F.lit(1) if side > 0 else -m, m)) for side in (1, -1)]
        return [F.xxhash64(F.lit(side), m, F.call_function("substring_index", line, F.lit(" "), m * F.lit(side))) for side in (1, -1)]

    own, less = _step(F.floor(n / 2)), _step(F.floor((n - 1) / 2))
    return F.when(own == less, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(less)))


def lines_of(docs: DataFrame, text: str = "text", fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """A row per line that isn't blank: its place, two hashes, and its halves' keys where it can have near ones."""
    # normalised before they are exploded: as a generator's output a line is computed once, however often it is used below
    found = F.transform(F.split(F.col(text), "\n"), normal)
    exploded = docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(found).alias("line_no", "line"))
    lines = exploded.withColumn("words", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), "text_key", "line_no").cast(_PLACE)
    by_words, by_chars = _halves(F.col("line"), F.col("words")), _halves(F.col("line"), F.length("line"), chars=True)
    halves = F.when(F.col("words") >= fuzzy_words, by_words).when(F.length("line") >= FUZZY_CHARS, by_chars)
    return lines.where("line <> ''").select(place.alias("place"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("again"), "line").alias("k2"), halves.alias("halves"))


def _run(hashes: Column) -> Column:
    """0 and the chained hash up to each element. An appended array is copied, so blocks of about the root of the length are run on their own."""
    chain = lambda a, start: F.aggregate(a, F.array(start), lambda acc, h: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), h)))
    size = F.ceil(F.sqrt(F.size(hashes))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / size).cast("int")), lambda b: F.slice(hashes, b * size + 1, size))
    zero = F.lit(0).cast("long")
    starts = F.aggregate(blocks, F.array(zero), lambda acc, b: F.array_append(acc, F.aggregate(b, F.element_at(acc, -1), lambda h, x: F.xxhash64(h, x))))
    within = F.transform(F.array(starts), lambda s: F.flatten(F.transform(blocks, lambda b, i: F.slice(chain(b, F.get(s, i)), F.lit(2), F.size(b)))))[0]
    return F.concat(F.array(zero), within)


def _neighbourhood(words: Column) -> Column:
    """Keys of a line's variants: hash(before, after) without each word, and with a gap at each place."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # bound to variables of lambdas, so that no array is made anew for each element
    run = lambda a: F.transform(F.array(a), _run)[0]
    both = F.struct(run(hashes).alias("before"), F.reverse(run(F.reverse(hashes))).alias("after"), F.size(words).alias("n"))
    return F.transform(
        F.array(both),
        lambda b: F.concat(
            F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: F.xxhash64(F.get(b["before"], i), F.get(b["after"], i + 1))),
            F.transform(F.sequence(F.lit(0), b["n"]), lambda i: F.xxhash64(F.get(b["before"], i), F.get(b["after"], i))),
        ),
    )[0]


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""
    rest = lambda x, k: F.slice(x, k, F.greatest(F.size(x) - k + 1, F.lit(0)))
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")  # 1-based; 0: the same
    return (first == 0) | (rest(a, first + 1) == rest(b, first + 1)) | (rest(a, first) == rest(b, first + 1)) | (rest(a, first + 1) == rest(b, first))


def _units(line: Column, fuzzy_words: int) -> Column:
    """Words of a line, or the characters of one of few words, each after a line break, so that no word is the same."""
    words = F.split(line, " ")
    return F.when(F.size(words) < fuzzy_words, F.transform(F.split(line, ""), lambda c: F.concat(F.lit("\n"), c))).otherwise(words)


def _with_lines(docs: DataFrame, text: str, wanted: DataFrame, limit: int, fuzzy_words: int) -> DataFrame:
    """id and words, or characters, of each line at ``wanted``'s places."""
    places = wanted.groupBy("place.doc_id", "place.text_key").agg(F.collect_list(F.struct("id", "place.line_no")).alias("at"))
    if wanted.count() <= limit:
        places = F.broadcast(places)
    base = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    hit = base.join(places, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    at = hit.select(F.split("_text", "\n").alias("lines"), F.explode("at").alias("a"))
    line = at.select("a.id", normal(F.get("lines", F.col("a.line_no"))).alias("line"))
    return line.select("id", _units(F.col("line"), fuzzy_words).alias("words")).dropDuplicates(["id"])


def dropped_lines(docs: DataFrame, text: str = "text", fuzzy_words: int = FUZZY_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key, same and near: the numbers of the lines that go, for each document that loses any."""
    lines = cut_lineage(lines_of(docs, text, fuzzy_words))
    distinct = cut_lineage(lines.groupBy("k1", "k2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"), F.any_value("halves").alias("halves")))
    half = distinct.where("halves IS NOT NULL").select("k1", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    near_any = half.join(shared, "half", "left_semi").select("k1").distinct()
    # a number that is written once stands for the line from here on
    some = cut_lineage(distinct.join(near_any, "k1", "left_semi").select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "place"))
    places = some.select("id", "place")
    texts = cut_lineage(_with_lines(docs, text, places, broadcast_rows, fuzzy_words))
    variants = cut_lineage(texts.select("id", F.explode(F.array_distinct(_neighbourhood(F.col("words")))).alias("key")))
    met = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # only keys that more than one line has carry the lines' places
    keys = cut_lineage(variants.join(met, "key", "left_semi").join(places, "id"))
    earliest = keys.groupBy("key").agg(F.min(F.struct("place", "id")).alias("first")).select("key", F.col("first.id").alias("first"))
    pairs = keys.join(earliest, "key").where("id <> first").select("id", "first").distinct()
    left, right = texts.select("id", F.col("words").alias("a")), texts.select(F.col("id").alias("first"), F.col("words").alias("b"))
    near = pairs.join(left, "id").join(right, "first").where(within_one(F.col("a"), F.col("b"))).select("id").distinct()
    marked = near.join(some, "id").select("k1", "k2", F.lit(True).alias("near"))
    fate = distinct.join(marked, ["k1", "k2"], "left").where("times > 1 OR near").select("k1", "k2", F.col("place").alias("kept"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(fate, ["k1", "k2"]).where("near OR place <> kept").select("place.*", "near").distinct()
    number = lambda flag: F.sort_array(F.collect_list(F.when(F.col("near") == flag, F.col("line_no"))))
    return gone.groupBy("doc_id", "text_key").agg(number(False).alias("same"), number(True).alias("near"))


def dedup_lines(docs: DataFrame, text: str = "text", out: str = "dropped", **options) -> DataFrame:
    """``docs`` with ``text`` without the lines that go, and ``out``: struct of their numbers, same and near."""
    id_, of_id, lost = free(docs, "_key"), free(docs, "_of"), free(docs, "_gone")
    gone = dropped_lines(docs.select("doc_id", text), text, **options).select(F.col("doc_id").alias(of_id), F.col("text_key"), F.struct("same", "near").alias(lost))
    gone = gone.withColumnRenamed("text_key", (of_key := free(docs, "_of_key")))
    keyed = docs.withColumn(id_, F.xxhash64(text))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(id_) == F.col(of_key)), "left")
    numbers = F.concat(F.col(lost)["same"], F.col(lost)["near"])
    # the lines are bound once; what stays is found by hashing, whatever the number of lines
    left = F.transform(F.array(F.split(F.col(text), "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), numbers), lambda i: F.get(x, i)), "\n"))[0]
    none = F.array().cast("array<int>")
    dropped = F.struct(F.coalesce(F.col(lost)["same"], none).alias("same"), F.coalesce(F.col(lost)["near"], none).alias("near"))
    kept = F.when(F.col(lost).isNull(), F.col(text)).otherwise(left)
    return joined.withColumns({text: kept, out: dropped}).select(*[c for c in docs.columns if c.lower() != out.lower()], out)


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i - 1 AS line_no, lower(trim(regexp_replace(ls[i], '\s+', ' ', 'g'))) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) t),
l AS (SELECT *, string_split(line, ' ') AS w FROM o WHERE line <> ''),
u AS (SELECT line, any_value(w) AS w, min((doc_id, line_no)) AS place FROM l GROUP BY line),
k AS (
  SELECT line, place, i, array_to_string(w[:i - 1], ' ') || chr(1) || array_to_string(w[i + g:], ' ') AS key
  FROM (SELECT line, place, w, g, unnest(range(1, len(w) + 2 - g)) AS i FROM u, (VALUES (0), (1)) v(g) WHERE len(w) >= 10) t
  UNION ALL
  SELECT line, place, i, left(line, i - 1) || chr(2) || substr(line, i + g) AS key
  FROM (SELECT line, place, g, unnest(range(1, length(line) + 2 - g)) AS i FROM u, (VALUES (0), (1)) v(g) WHERE len(w) < 10 AND length(line) >= 10) t),
near AS (SELECT DISTINCT k.line FROM k JOIN (SELECT key, min(place) AS place FROM k GROUP BY key) e ON k.key = e.key WHERE k.place > e.place),
f AS (SELECT l.doc_id, l.line_no, near.line IS NOT NULL AS near FROM l JOIN u ON l.line = u.line LEFT JOIN near ON near.line = l.line
      WHERE near.line IS NOT NULL OR (l.doc_id, l.line_no) > u.place),
n AS (SELECT doc_id, count(*) FILTER (NOT near) AS same, count(*) FILTER (near) AS near, list(line_no ORDER BY line_no) AS gone FROM f GROUP BY doc_id)
SELECT x.doc_id, coalesce(len(string_split(x.text, chr(10))), 0) AS n_lines, coalesce(n.same, 0) AS n_same, coalesce(n.near, 0) AS n_near,
       coalesce(array_to_string(n.gone, ','), '') AS dropped,
       sha256(array_to_string([string_split(x.text, chr(10))[i] FOR i IN range(1, len(string_split(x.text, chr(10))) + 1) IF NOT coalesce(list_contains(n.gone, i - 1), false)], chr(10))) AS text_sha256
FROM documents x LEFT JOIN n ON n.doc_id = x.doc_id"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    return dedup_lines(docs).select(
        "doc_id",
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size("dropped.same").cast("long").alias("n_same"),
        F.size("dropped.near").cast("long").alias("n_near"),
        F.array_join(F.sort_array(F.concat("dropped.same", "dropped.near")), ",").alias("dropped"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )

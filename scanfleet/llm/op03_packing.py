"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

A document is its ids and an end id. Only documents above the capacity are cut, into full pieces; what is left over
comes first, so that the last piece ends where the document ends. Full pieces are sequences by themselves.

Lengths are whole numbers up to the capacity, so a packing is decided on counts per length. Pieces above a third of the
capacity go at most two to a sequence: from the longest down, each is matched with the longest partner that fits, which
gives the most pairs. The smaller ones follow, longest first, into the tightest gap that takes them. Both steps move whole
counts of one length at once. The plan is a list of slots, as bounded by the capacity as the counts are, whatever the number of
documents. Each piece then finds its slot by its rank among the pieces of its length. Ranks come from salted groups and
prefix sums, so a length that many copies share is no single task's work.

Null and empty texts are one piece with the end id alone. Rows that agree in every column get different slots of the same
length; which of them gets which has no meaning. An empty table gives no pieces. Null doc_ids are kept.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import slices
from .chunks import ChunkStore
from .op05_bpe import byte_names
from .registry import query, table

CAPACITY = 1024
END_ID = 2
SALTS = 256

# A chunk begins at a space or line break after other text. Texts with any other white space are encoded whole.
_CHUNK = re.compile("[ \n]*[^ \n]+|[ \n]+$")
_ODD = re.compile("[^\\S \n]|[\x1c-\x1f\x85]")
# The same characters. Looking for one after the other takes a thirtieth of the pattern's time.
_ODD_MARKS = [c for c in map(chr, range(sys.maxunicode + 1)) if _ODD.match(c)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class DocumentIds:
    """Ids of whole texts as the tokenizers library gives them. Ordinary texts are encoded by tiktoken with the same vocabulary, which takes a
    third of the time. Texts with an added token go by distinct chunks, of which those with the token go to the library itself, as
    texts with other white space do."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {name: b for b, name in enumerate(byte_names())}
        vocab = spec["model"]["vocab"]
        parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab[x + y] != 256 + i for i, (x, y) in enumerate(parts)):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
        self.store = ChunkStore(self.encode)

    def encode(self, chunks: list[str]) -> list[bytes]:
        encode = self.ranks.encode_ordinary
        return [array("i", self.library.encode(c, add_special_tokens=False).ids if self.special(c) else encode(c)).tobytes() for c in chunks]

    def special(self, text: str) -> bool:
        return any(a in text for a in self.added) or self.odd(text)

    def odd(self, text: str) -> bool:
        return any(c in text for c in _ODD_MARKS)

    def chunks(self, text: str) -> list[str]:
        return [text] if self.odd(text) else _CHUNK.findall(text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        encode = self.ranks.encode_ordinary
        return [self.store.ids([t], self.chunks)[0] if t and self.special(t) else array("i", encode(t or "")).tobytes() for t in texts]


_loaded: dict[str, DocumentIds] = {}


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of each piece."""
    first = len(ids) % capacity
    starts = ([0] if first else []) + list(range(first, len(ids), capacity))
    return [(a, ids[a : min(a + capacity, len(ids)) if a or not first else first]) for a in starts]


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, the ids themselves."""
    file = path or default_path()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []
    kind = pa.list_(pa.struct(fields))
    ddl = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>" if keep_ids else "") + ">>"
    end = np.array([end_id], dtype=np.int32).tobytes()

    @F.arrow_udf(ddl)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if file not in _loaded:
            _loaded[file] = DocumentIds(file)
        for texts in slices(batches):
            offsets, rows = [0], []
            for ids in _loaded[file].ids(texts.to_pylist()):
                for k, (start, part) in enumerate(cut(np.frombuffer(ids + end, dtype=np.int32), capacity)):
                    rows.append((k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), *([part] if keep_ids else [])))
                offsets.append(len(rows))
            columns = [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(fields)]
            yield pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])).cast(kind)

    return docs.select("doc_id", F.inline(of(F.col(text))))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences), in full for ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: list[tuple[list[int], int]] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    for n in large:
        while left[n]:
            at = bisect.bisect_right(rising, min(capacity - n, n)) - 1
            while at >= 0 and (left[rising[at]] == 0 or rising[at] == n and left[n] < 2):
                at -= 1
            if at < 0:
                bins.append(([n], left[n]))
                left[n] = 0
            else:
                partner = rising[at]
                pairs = left[n] // 2 if partner == n else min(left[n], left[partner])
                bins.append(([n, partner], pairs))
                left[n] -= pairs
                left[partner] -= pairs
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for content, many in bins:
        gaps.setdefault(capacity - sum(content), []).append((content, many))
    known = sorted(gaps)

    def add(gap: int, content: list[int], many: int) -> None:
        if many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(known, gap)
            gaps[gap].append((content, many))

    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(known, n)
            if at == len(known):
                gap, content, many = capacity, [], left[n]
            else:
                gap = known[at]
                content, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], known[at]
            each = gap // n
            full = min(many, left[n] // each)
            rest = left[n] - full * each if full < many and left[n] - full * each < each else 0
            add(gap - n * each, content + [n] * each, full)
            add(gap - n * rest, content + [n] * rest, 1 if rest else 0)
            if content:
                add(gap, content, many - full - (1 if rest else 0))
            left[n] -= full * each + rest
    return [group for gap in sorted(gaps) for group in gaps[gap]]


def slots(groups: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Slots by length and first rank: ranks from ``first`` on, up to the next slot of the length, lie at ``offset`` of the
    sequences from ``sequence`` on."""
    rows, taken, sequence = [], {}, 0
    for content, many in groups:
        at = 0
        for n in content:
            rows.append((n, taken.get(n, 0), sequence, at))
            taken[n] = taken.get(n, 0) + many
            at += n
        sequence += many
    rows.sort()
    return {name: np.array([r[i] for r in rows], dtype=np.int64) for i, name in enumerate(("length", "first", "sequence", "offset"))}


def place(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``parts`` with sequence_id and offset. ``parts`` has doc_id, piece, start, length and ids_crc32; it is read three times, so give
    a written table."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    salted = parts.withColumn("_salt", salt)
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity rows come back, however many documents there are
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table_of = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(bases, ["length", "_salt"])
    wide = np.int64(1) << 48
    starts = table_of["length"] * wide + table_of["first"]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(starts, n * wide + r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(table_of["sequence"][at] + r - table_of["first"][at]), pa.array(table_of["offset"][at])], names=["sequence_id", "offset"])

    found = ranked.withColumn("_slot", slot(F.col("length"), F.col("_base") + F.col("_rank") - 1))
    own = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    return found.select(*own, "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` with their sequence and place. The pieces are written once; only then is their packing known."""
    return place(cut_lineage(pieces(docs, text, capacity, end_id, path, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """A row per sequence: sequence_id and its ids in order, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)

"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as its bytes, the last one marked as the word's end. A tournament tree stands over the ranks of adjacent
pairs; each leaf also carries its place, so the root is the leftmost pair of lowest rank. A merge changes three leaves:
the merged pair, the pair before it and the pair that vanishes. Each change climbs one path to the root. It ends when the
root holds no mergeable pair. Words of one size class are merged side by side in numpy, one tree per word. In long words all
leaves of the root's rank are merged in one step, left to right, wherever no pair with the new symbol ranks before them: then
one by one would come out the same.

Null texts count as empty and have no ids; null id lists decode to the empty string. Texts of any length are
encoded whole. Repeated rows get equal ids. A column that already has the output's name is replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .chunks import ChunkStore, id_lists
from .registry import query, table

NONE = np.int64(1) << 62  # a leaf without a mergeable pair
CELLS = 1 << 19  # leaves merged side by side, which bounds memory
LONG = 64  # leaves from which a step takes all pairs of the root's rank

# Up to here, and without odd white space, Python's case folding, classes and white space are those of the tokenizer's own steps.
_ODD = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85\xa0]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_names() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class SegmentTreeBpe:
    """The merges of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        names = byte_names()
        self.byte_of = {n: b for b, n in enumerate(names)}
        self.inner = np.array([vocab[n] for n in names], dtype=np.int64)
        self.last = np.array([vocab[n + suffix] for n in names], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # a symbol may be made in several ways, so a pair that holds it can rank before one of them
        first_use = np.full(max(vocab.values()) + 1, len(pairs), dtype=np.int64)
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(first_use, side, np.arange(len(pairs)))
        self.together = first_use[self.made] > np.arange(len(pairs))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*vocab.values(), *self.added.values()]) + 1, dtype=object)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        import regex

        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.store = ChunkStore(self.encode_chunks)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word."""
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, CELLS // size)
            for k in range(0, len(members), step):
                block = members[k : k + step]
                for i, ids in zip(block, self._merge_block([words[i] for i in block], size)):
                    out[i] = ids
        return out

    def _merge_block(self, words: list[bytes], size: int) -> list[np.ndarray]:
        n = len(words)
        length = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        inside = np.arange(size) < length[:, None]
        symbol = np.full((n, size + 1), -1, dtype=np.int64)
        symbol[:, :size][inside] = self.inner[flat]
        rows = np.arange(n)
        symbol[rows, length - 1] = self.last[flat[np.cumsum(length) - 1]]
        after = np.tile(np.arange(1, size + 2), (n, 1))  # the next symbol's place; the word's length and beyond: none
        before = np.tile(np.arange(-1, size), (n, 1))
        alive = inside.copy()
        bits = size.bit_length() - 1
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        paired = np.arange(1, size + 1) < length[:, None]
        pair_rank = self.rank(symbol[:, :size], symbol[:, 1 : size + 1])
        tree[:, size:] = np.where(paired & (pair_rank >= 0), (pair_rank << bits) | np.arange(size), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + size
            tree[row, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def leaf(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            r = self.rank(symbol[row, left], symbol[row, right])
            return np.where(r >= 0, (r << bits) | left, NONE)

        def of_roots_rank(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Word and place of every leaf of the root's rank, in order, without those that share a symbol with one taken before."""
            rank = tree[row, 1] >> bits
            alone = ~self.together[rank]
            single, single_left = row[alone], tree[row[alone], 1] & (size - 1)
            row, rank = row[~alone], rank[~alone]
            node = np.ones(len(row), dtype=np.int64)
            for _ in range(bits):
                node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                row, rank = np.repeat(row, 2), np.repeat(rank, 2)
                holds = tree[row, node] >> bits == rank
                row, rank, node = row[holds], rank[holds], node[holds]
            left = node - size
            # pairs that overlap are of one symbol repeated: every second one of such a chain is taken
            chained = np.zeros(len(row), dtype=bool)
            chained[1:] = (row[1:] == row[:-1]) & (after[row[:-1], left[:-1]] == left[1:])
            at = np.arange(len(row))
            taken = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0 if len(row) else chained
            return np.concatenate([row[taken], single]), np.concatenate([left[taken], single_left])

        busy = rows[tree[:, 1] < NONE]
        while len(busy):
            if size < LONG:
                row, left = busy, tree[busy, 1] & (size - 1)
            else:
                row, left = of_roots_rank(busy)
            root = tree[row, left + size]
            gone = after[row, left]
            then = after[row, gone]
            symbol[row, left] = self.made[root >> bits]
            alive[row, gone] = False
            after[row, left] = then
            more = then < length[row]
            before[row[more], then[more]] = left[more]
            put(row, gone, np.full(len(row), NONE))
            value = np.full(len(row), NONE)
            value[more] = leaf(row[more], left[more], then[more])
            put(row, left, value)
            prior = before[row, left]
            has = prior >= 0
            put(row[has], prior[has], leaf(row[has], prior[has], left[has]))
            busy = busy[tree[busy, 1] < NONE]
        kept = symbol[:, :size][alive].astype(np.int32)
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        return [kept[a:b] for a, b in zip([0, *ends], ends)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of normalised chunks without white space, each a sequence of words. \\0w before a chunk says that it is one word, \\0a that it is an
        added token."""
        split = [self.words.findall(c) if c[0] != "\0" else [c[2:]] if c[1] == "w" else [c] for c in chunks]
        distinct = list({w for words in split for w in words if w[:2] != "\0a"})
        ids = dict(zip(distinct, (x.tobytes() for x in self.merge([w.encode() for w in distinct]))))
        ids |= {"\0a" + token: np.int32(i).tobytes() for token, i in self.added.items()}
        return [b"".join([ids[w] for w in words]) for words in split]

    def pieces(self, text: str) -> list[str]:
        """The chunks of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "\0" not in text and not _ODD.search(text):
            return text.lower().split()
        named = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return ["\0w" + bytes(self.byte_of[c] for c in word).decode("utf-8") for word, _ in named]

    def chunks(self, text: str) -> list[str]:
        if self.split_added is None or not any(a in text for a in self.added):
            return self.pieces(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            out += ["\0a" + part] if part in self.added else self.pieces(part) if part else []
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.store.ids(texts, self.chunks)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with a space between, as a vocabulary without a decoder is read back."""
        return " ".join(self.tokens[ids].tolist())


_loaded: dict[str, SegmentTreeBpe] = {}


def bpe(path: str) -> SegmentTreeBpe:
    """One instance and store per Python worker."""
    if path not in _loaded:
        _loaded[path] = SegmentTreeBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``out``: array<int>, the ids of the whole text."""
    file = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for texts in slices(batches):
            yield id_lists(bpe(file).encode(texts.to_pylist()))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with ``out``: string, the text that the ids stand for."""
    file = path or default_path()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in slices(batches):
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            yield pa.array([bpe(file).decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], type=pa.string())

    return docs.withColumn(out, text(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

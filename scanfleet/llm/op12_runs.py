"""Periodic runs of words, found online by catchers of squares over completed power-of-two blocks.

A square is a stretch of words that stands twice in a row; squares of one period that overlap are one run. Words are appended to a text and become whole
numbers. As soon as the aligned block of 2**k words [s, s + 2**k) is complete, a catcher for it is live: it watches for the block to stand again r words later,
for r from 2**(k+1) - 1 to 2**(k+2) - 2. So each appended word, which ends one window of each length 2**k, is held against exactly two catchers a level, and
any square of period r has a whole block of its level in its left half, whose catcher sees it. Windows are compared by names: the name of a window of length
2**(k+1) is a hash of the names of its halves. Catches in neighbouring blocks with the same r chain up, and a chain goes on over later appends until a block misses.
A chain of enough blocks has its two suffixes compared word by word, to the left and to the right as far as they agree; a chain at the end of the text is
compared further as words come. What agrees for long enough is a run. The comparison is of words, not of names, so equal names of different windows
change nothing, and equal windows always have equal names. A chain inside a known run whose period divides r is no new run.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run has a smallest period q, at least ``min_length`` words and ``min_exponent`` times q, and no neighbouring
word that goes on with the period. Texts of a slice are appended one after the other, each followed by a word that occurs once, which no square can hold.
Null and empty texts, and texts of white space, have no words and no runs; the collapsed text is then empty. Repeated rows get equal results. A very long text
is one task's work, in memory of some tens of bytes a word and level. Columns of the names given as ``out`` are replaced; all others stay as they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .registry import query, table

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that are appended at a time, and rows and bytes of text that share a catcher.
APPENDED, ROWS, BYTES = 1 << 17, 2048, 1 << 20


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of windows from those of their halves."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Level:
    """The catchers of blocks of ``size`` words: names of the windows so far, and chains of catches that may go on."""

    def __init__(self, size: int):
        self.size, self.low, self.high = size, 2 * size - 1, 4 * size - 2
        self.names = np.zeros(0, dtype=np.uint64)
        self.tested = 0  # windows that have met their catchers
        self.chains = np.zeros((3, 0), dtype=np.int64)  # r, first and last block

    def catch(self) -> np.ndarray:
        """Chains (r, first, last) after the windows named since the last call have met their two catchers each."""
        t = np.arange(self.tested, len(self.names))
        newest = (t - self.low) // self.size * self.size
        found = [self.chains]
        for s in (newest, newest - self.size):
            ok = s >= 0
            u, v = t[ok], s[ok]
            hit = self.names[u] == self.names[v]
            found.append(np.array([u[hit] - v[hit], v[hit], v[hit]]))
        self.tested = len(self.names)
        chains = np.concatenate(found, axis=1)
        if chains.shape[1] > 1:
            chains = chains[:, np.lexsort((chains[1], chains[0]))]
            fresh = np.concatenate([[True], (chains[0, 1:] != chains[0, :-1]) | (chains[1, 1:] != chains[2, :-1] + self.size)])
            starts = np.flatnonzero(fresh)
            chains = np.array([chains[0, starts], chains[1, starts], np.maximum.reduceat(chains[2], starts)])
        self.chains = chains[:, chains[2] + self.size + chains[0] >= self.tested]
        return chains


class Catchers:
    """Runs of a text that grows. ``longest`` bounds the length of runs, where the caller knows one, and so the periods looked for."""

    def __init__(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
        if min_exponent < 2:
            raise ValueError("squares are runs of exponent two or more")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.words = np.zeros(0, dtype=np.int64)
        self.levels: list[Level] = []
        self.runs: dict[tuple[int, int], int] = {}  # (start, period) to end

    def append(self, words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
        """Take in more words. Returns the runs that are new or longer than before, as (start, end, period)."""
        self.words = np.concatenate([self.words, words])
        most = (longest or len(self.words)) // self.min_exponent
        news, k = [], 0
        while (size := 1 << k) <= max(1, most):
            if k == len(self.levels):
                self.levels.append(Level(size))
            level = self.levels[k]
            at = len(level.names)
            if k == 0:
                more = self.words[at:].astype(np.uint64)
            else:
                below = self.levels[k - 1].names
                more = _mix(below[at : len(below) - size // 2], below[at + size // 2 :]) if len(below) >= at + size // 2 else below[:0]
            level.names = np.concatenate([level.names, more])
            if level.low <= most:
                news += self._report(level)
            k += 1
        return news

    def _report(self, level: Level) -> list[tuple[int, int, int]]:
        chains = level.catch()
        r, first, last = chains
        need = np.maximum(self.min_length, self.min_exponent * r) - r  # words that agree with the one r later
        enough = (last - first) // level.size + 1 >= (need - level.size + 1) // level.size
        news = []
        known = self._known() if enough.any() else None
        for r, first, last in chains[:, enough].T.tolist():
            if known is not None and self._inside(known, first, last + r + level.size, r):
                continue
            while first <= last:
                start = self._back(first, r)
                end = self._forth(self.runs.get((start, r), first + r), r)
                if end - start >= max(self.min_length, self.min_exponent * r) and self.runs.get((start, r)) != end and self._primitive(start, r):
                    self.runs[start, r] = end
                    news.append((start, end, r))
                first = ((end - r) // level.size + 1) * level.size  # past last, unless only names agreed there
        return news

    def _known(self):
        """Runs by start, with the one that reaches furthest among those up to each."""
        runs = sorted((s, e, r) for (s, r), e in self.runs.items())
        best, furthest = (-1, -1, 1), []
        for x in runs:
            best = max(best, x, key=lambda y: y[1])
            furthest.append(best)
        return [x[0] for x in runs], furthest

    @staticmethod
    def _inside(known, start: int, end: int, r: int) -> bool:
        i = bisect_right(known[0], start) - 1
        return i >= 0 and known[1][i][1] >= end and known[1][i][2] < r and r % known[1][i][2] == 0

    def _back(self, at: int, r: int) -> int:
        """The first place from which on, up to ``at``, words agree with those r later."""
        w, step = self.words, 64
        while at > 0:
            a = max(0, at - step)
            differ = np.flatnonzero(w[a:at] != w[a + r : at + r])
            if len(differ):
                return a + int(differ[-1]) + 1
            at, step = a, 2 * step
        return 0

    def _forth(self, at: int, r: int) -> int:
        """The place after the last word that, from ``at`` on, agrees with the one r before."""
        w, step, n = self.words, 64, len(self.words)
        while at < n:
            b = min(n, at + step)
            differ = np.flatnonzero(w[at:b] != w[at - r : b - r])
            if len(differ):
                return at + int(differ[0])
            at, step = b, 2 * step
        return n

    def _primitive(self, start: int, r: int) -> bool:
        """Whether no shorter period fits a run of period r that begins at ``start``. A shorter one divides r."""
        w, left, p = self.words, r, 2
        while left > 1:
            if p * p > left:
                p = left
            if left % p == 0:
                d = r // p
                if np.array_equal(w[start : start + r], w[start + d : start + d + r]):
                    return False
                while left % p == 0:
                    left //= p
            p += 1
        return True


def words_of(text: str | None) -> list[bytes]:
    """Splitting bytes without an argument cuts at the blank, tab, line feed, vertical tab, form feed and carriage return alone."""
    return text.encode().split() if text else []


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and then period."""
    ids: dict[bytes, int] = {}
    numbers, ends, at = [], [], 0
    for k, words in enumerate(texts):
        numbers.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words)))
        numbers.append(np.array([-1 - k]))
        at += len(words) + 1
        ends.append(at)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    catchers, whole, longest = Catchers(min_length, min_exponent), np.concatenate(numbers), max(map(len, texts))
    for i in range(0, len(whole), APPENDED):
        catchers.append(whole[i : i + APPENDED], longest)
    for (start, period), end in sorted(catchers.runs.items()):
        k = bisect_right(ends, start)
        out[k].append((start - (ends[k - 1] if k else 0), end - start, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by blanks, of which each run keeps its first period only."""
    if not runs:
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]).decode()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(
    docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
    key: str | None = None, reword: Callable[[list[bytes], int | None], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` with ``runs``, array<struct<start, length, period>> by start and then period, and ``collapsed``, the text without what runs repeat.
    ``reword`` changes a text's words by its ``key`` before anything else."""

    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in slices(batches, ROWS, BYTES):
            words = [words_of(t) for t in rows.field("text").to_pylist()]
            if reword:
                words = [reword(w, k) for w, k in zip(words, rows.field("key").to_pylist())]
            of_texts = runs_of_texts(words, min_length, min_exponent)
            told = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in of_texts]
            yield pa.StructArray.from_arrays([pa.array(told, type=_RUNS), pa.array([collapse(w, x) for w, x in zip(words, of_texts)], type=pa.string())], names=["runs", "collapsed"])

    made = found(F.struct(F.col(text).alias("text"), (F.col(key) if key else F.lit(None)).cast("long").alias("key")))
    name = "_runs"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, made).withColumns({runs: F.col(name)["runs"], collapsed: F.col(name)["collapsed"]}).drop(name)


def best_run(runs: Column) -> Column:
    """The run of the greatest length over period; ties by start, then period. Null where there is none."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        first = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when(a.isNull() | (right > left) | ((right == left) & first), b).otherwise(a)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def with_repeats(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, which from some word on repeat in every tenth document, as crc32 of the decimal doc_id says. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op12_word_runs")
def op12_word_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = find_runs(docs, key="doc_id", reword=with_repeats).select("doc_id", "runs", "collapsed", best_run(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfleet.llm import op12_runs as R


def brute(words, min_length=6, min_exponent=4):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rnd = random.Random(12)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 700, ["a", "b"] * 100 + ["a"], ["x"] + ["a", "a", "b"] * 9 + ["c"] + ["a", "a", "b"] * 4]
    for k in range(150):
        words: list[str] = []
        while len(words) < rnd.choice((5, 40, 300)):
            part = [rnd.choice("abc"[: 1 + k % 3]) for _ in range(rnd.choice((1, 2, 3, 5, 8, 21, 40)))]
            words += part * rnd.choice((1, 1, 2, 4, 5, 9)) + part[: rnd.randrange(len(part) + 1)]
        out.append(words[:420])
    return out


def test_runs_equal_brute_force():
    every = texts()
    got = R.runs_of_texts([[w.encode() for w in t] for t in every])
    for t, g in zip(every, got):
        assert g == brute(t), t
    assert sum(map(len, got)) > 150 and max(q for g in got for _, _, q in g) > 30


@pytest.mark.parametrize("size", [1, 7])
def test_appended_in_parts(size):
    for t in texts()[::9]:
        ids = np.array([ord(w) for w in t], dtype=np.int64)
        c, seen = R.Catchers(), {}
        for i in range(0, len(ids), size):
            for start, end, q in c.append(ids[i : i + size]):
                assert seen.get((start, q), -1) < end <= i + size
                seen[start, q] = end
        assert sorted((s, e - s, q) for (s, q), e in seen.items()) == sorted(brute(t))
        assert seen == c.runs


def test_squares_and_other_bounds():
    t = list("abcabcxyxyxyzz") + list("mississippi")
    assert R.runs_of_texts([[w.encode() for w in t]], 2, 2) == [brute(t, 2, 2)]


def test_equal_names_of_different_windows(monkeypatch):
    monkeypatch.setattr(R, "_mix", lambda a, b: (a + b) % np.uint64(5))
    for t in texts()[::5]:
        assert R.runs_of_texts([[w.encode() for w in t]]) == [brute(t)]


def digest(rows):
    """The query's columns for (doc_id, text), by plain loops."""
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((0, 3, 30, 120))))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "a a a a\x1ca " * 9), (None, "x " * 8), (204, "x\ty\n" * 3000), (205, "lone"), (7, "x " * 8), (7, "x " * 8), (206, "é ü " * 12)]
    rows += [(300 + i, "w" + str(i) + " " + " ".join(t)) for i, t in enumerate(texts()[::4])]
    docs = spark.createDataFrame([(*r, 1, "r", "c") for r in rows], "doc_id long, text string, start int, runs string, collapsed string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in R.op12_word_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == digest(rows)
    assert sum(r[1] for r in got) > 40


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", "old", 3)], "doc_id long, text string, runs string, _runs int")
    row = R.find_runs(docs).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "text": "a a a a a a b", "runs": [{"start": 0, "length": 6, "period": 1}], "_runs": 3, "collapsed": "a b"}
    assert R.find_runs(docs.where("false")).count() == 0


def test_long_text_of_one_word():
    (runs,) = R.runs_of_texts([[b"a"] * 200_000])
    assert runs == [(0, 200_000, 1)]

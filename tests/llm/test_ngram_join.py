import random

import numpy as np
from pyspark.sql import functions as F

from scanfleet.llm import ngrams as N
from scanfleet.llm import op02_ngram_join as J


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fixture():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four five", "é è ñ ß 中 文"]
    for size in (1, 2, 5, 40, 150):
        base = [word() for _ in range(rnd.randint(100, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(60)]
    texts += ["copy " * 3 + "of one text here now"] * 200
    texts += [" ".join(word() for _ in range(20000))] * 2
    return texts


def brute(texts):
    sets = [grams(t) for t in texts]
    n = len(texts)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if k and k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return [(i, find(i), links[i]) for i in range(n)]


def test_join_equals_brute_force(spark, monkeypatch):
    texts = fixture()
    want = brute(texts)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, key int, bands int")
    for members in (J.PART_MEMBERS, 16):
        monkeypatch.setattr(J, "PART_MEMBERS", members)
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect())
        assert got == want
    kept = sorted(r.doc_id for r in J.deduplicate(docs).collect())
    assert kept == sorted({c for _, c, _ in want})


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in J.join(docs).collect())
    assert got == sorted([("None", "4", 3)] * 2 + [("4", "4", 3)] * 2 + [("5", "5", 0), ("None", "None", 0)])
    assert sorted(str(r.doc_id) for r in J.deduplicate(docs).collect()) == ["4", "5", "None"]
    assert J.join(docs.where("false")).count() == 0 and J.deduplicate(docs.where("false")).count() == 0


def test_sets_that_share_a_key_stay_apart(spark, monkeypatch):
    """Keys of three values only: the second hash tells the sets apart."""
    texts = fixture()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = J.with_bands
    monkeypatch.setattr(J, "with_bands", lambda *a: real(*a).withColumn("_set", F.col("_set").withField("key", F.pmod(F.col("_set.key"), F.lit(3)))))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()) == brute(texts)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f", 5, 6, 7, 8), (3, "other words", 5, 6, 7, 8)], "doc_id long, text string, _text_key int, text_key int, _of int, class_id int")
    assert sorted(tuple(r) for r in J.deduplicate(docs).collect()) == [(1, "a b c d e f", 5, 6, 7, 8), (3, "other words", 5, 6, 7, 8)]


def test_band_count():
    assert J.SIMILARITY == 0.8 and 1 - (1 - 0.8**6) ** N.bands_for(0.8, 6, 0.9999) >= 0.9999 > 1 - (1 - 0.8**6) ** (N.bands_for(0.8, 6, 0.9999) - 1)


def test_minhash_matches_similarity():
    rnd = np.random.default_rng(3)
    mh = N.MinHash(400, 1)
    for s in (0.2, 0.5, 0.9):
        pool = N.mix(rnd.integers(0, 1 << 63, 2000).astype(np.uint64))
        k = int(2000 * s)
        a, b = np.unique(pool[: k + (2000 - k) // 2]), np.unique(np.concatenate([pool[:k], pool[k + (2000 - k) // 2 :]]))
        assert abs((mh.band_keys(a) == mh.band_keys(b)).mean() - s) < 0.1


def test_ngram_hashes():
    texts = fixture()
    for t in texts:
        assert len(N.ngram_set(t)) == len(grams(t))
    a, b = "x y z w v u t s", "q y z w v u t r"
    assert len(np.intersect1d(N.ngram_set(a), N.ngram_set(b))) == len(grams(a) & grams(b)) == 2

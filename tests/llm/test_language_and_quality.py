import math
import os
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from scanfleet.llm import op04_language_id as L
from scanfleet.llm import op07_quality as Q

DIR = "/root/testdata/sf0.01"
WORDS = {"xx": ["alpha", "beta", "gamma", "delta", "kappa"], "yy": ["uno", "dos", "tres", "cuatro", "cinco"]}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "ing"]) for _ in range(n))


def toy(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang, rnd.randint(5, 80)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_edges(spark):
    model = L.train(toy(spark).unionByName(spark.createDataFrame([(900, None, "zz"), (901, "", "zz"), (902, "text", None)], "doc_id long, text string, lang string")))
    assert model.languages == ["xx", "yy"]
    rows = [(None, None), (1, ""), (2, "12 34 !?"), (3, "alpha betas gamma delta kappas"), (3, "alpha betas gamma delta kappas"), (4, "UNO DOS tres " * 20000), (5, "q")]
    got = L.identify(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, language int"), model).collect()
    lang = [r.language.lang for r in got]
    assert lang[:3] == ["und"] * 3 and lang[3:6] == ["xx", "xx", "yy"] and lang[6] in ("xx", "yy")
    assert all(r.language.rejected for r in got[:3]) and not any(r.language.rejected for r in got[3:6])
    assert got[6].language.rejected and all(0 <= r.language.score <= 1 for r in got)
    assert L.identify(spark.createDataFrame([], "text string"), model).count() == 0


def test_language_without_labels(spark):
    none = L.train(spark.createDataFrame([], "text string, lang string"))
    assert none.predict("words") == ("und", 0.0, True)
    one = L.train(toy(spark).where("lang = 'xx'"))
    assert one.predict("words") == ("xx", 1.0, False) and one.predict("77") == ("und", 0.0, True)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
def test_language_held_out(spark):
    done = L.op4_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = done.where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert sum(r.rejected for r in rows) / len(rows) < 0.02


def test_quality_edges(spark):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        docs.append((i, prose(rnd, "xx", 40) if good else "BUY!! NOW!! " * rnd.randint(2, 30) + prose(rnd, "yy", 20)))
        labels.append((i, int(good)))
    docs += [(300, None), (301, ""), (None, "alpha"), (302, "alpha beta " * 30000), (5, docs[5][1])]
    labels += [(0, 0), (7, None), (None, 1), (5, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.train(d, lab)
    got = Q.score(d.withColumn("quality", F.lit(1)), model).collect()
    assert len(got) == len(docs) and all(0 <= r.quality <= 1 for r in got)
    by = {r.doc_id: r.quality for r in got}
    assert sum((by[i] >= 0.7) == (i % 3 > 0) for i in range(300)) > 290
    assert by[300] == by[301] == model.scores([None])[0]
    alone = Q.train(d, lab.where("quality = 1"))
    assert alone.scores(["x", None]).min() > 0.99
    assert Q.train(d, lab.where("false")).scores(["x"])[0] == 0.5
    assert Q.score(d.where("false"), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables not present")
def test_quality_held_out(spark):
    done = Q.op7_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(done) > 800 and sum(r.predicted == r.quality for r in done) / len(done) > 0.95


def plain_size(data, content, level, chunk):
    """Compressed bytes by the library's one-shot call, with nothing digested before or kept after."""
    total = 0
    for i in range(0, max(1, len(data)), chunk):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
        total += len(c.compress(data[i : i + chunk]))
    return total


def test_language_equals_plain_compression(spark):
    model = L.train(toy(spark))
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.choice(["xx", "yy"]), n) for n in (1, 3, 20, 2000)] + [prose(rnd, "xx", 4) + " " + prose(rnd, "yy", 4), "q", "ALPHA Uno", "é" * 5000]
    rows = L.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        data, narrow = text.lower().encode(), None
        for level in (L.LEVEL, L.STRONGEST):
            sizes = sorted((plain_size(data, c, level, L.CHUNK), name) for c, name in zip(model.dictionaries.contents, model.languages))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            narrow = margin <= model.narrow
            if not narrow:
                break
        assert (row.language.lang, row.language.rejected) == (sizes[0][1], narrow) and row.language.score == pytest.approx(1 - math.exp(-margin / L.SURE))


def test_quality_equals_plain_compression(spark):
    rnd = random.Random(6)
    bad, good = (("BUY!! NOW!! " * 40 + prose(rnd, "yy", 50)).encode(), prose(rnd, "xx", 200).encode())
    model = Q.QualityModel(Q.Dictionaries([bad, good], Q.LEVEL, Q.CHUNK), 9.0, -0.5)
    texts = [None, "", "x", prose(rnd, "xx", 900), "BUY!! " * 700, prose(rnd, "yy", 30)]
    got = [r.quality for r in Q.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got):
        b, g = (plain_size(text.encode(), c, Q.LEVEL, Q.CHUNK) for c in (bad, good)) if text else (0, 0)
        assert score == pytest.approx(1 / (1 + math.exp(-(9.0 * ((b - g) / (b + g) if text else 0) - 0.5))))


def test_dictionary_has_something_of_every_text():
    texts = ["a" * 10, "b" * 1000, "c" * 500, "a" * 10, "d" * 3]
    whole = L.dictionary(texts, 5000)
    assert whole.split(b"\n") == [b"a" * 10, b"b" * 1000, b"c" * 500, b"d" * 3]
    cut = L.dictionary(texts, 400).split(b"\n")
    assert [len(p) for p in cut] == [10, 191, 191, 3] and len(L.dictionary(texts, 400)) <= 400
    assert L.dictionary([], 10) == b"" and len(L.dictionary(["é" * 50] * 2, 33)) <= 33


def test_samples_are_bounded_and_distinct(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", f"l{i % 2}" if i < 900 else f"rare{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = L.sample(df.select("lang", "text"), "lang", {"l0": 450, "l1": 450}, 50, F.col("text")).collect()
    for lang in ("l0", "l1"):
        texts = [r.text for r in few if r.lang == lang]
        assert len(texts) == len(set(texts)) == 50
    assert L.train(df, max_languages=3).languages == ["l0", "l1", "rare900"]
    order = np.array([r.hash for r in few])
    assert len(set(order.tolist())) > 90

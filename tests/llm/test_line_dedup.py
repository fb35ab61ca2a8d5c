import random

import pytest
from pyspark.sql import functions as F

from scanfleet.llm import op09_line_dedup as D


def words(line):
    return " ".join(line.split()).lower().split(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(docs):
    """text by doc_id, without the lines that an earlier line comes close to; a line of few words is compared by characters."""
    seen, out = [], {}
    units = lambda w: w if len(w) >= D.FUZZY_WORDS else list(" ".join(w))
    for i in sorted(docs):
        kept = []
        for line in docs[i].split("\n") if docs[i] is not None else []:
            w = words(line)
            kind, u = len(w) >= D.FUZZY_WORDS, units(w)
            close = lambda s: s == w or min(len(u), len(units(s))) >= 10 and kind == (len(s) >= D.FUZZY_WORDS) and abs(len(u) - len(units(s))) < 2 and distance(u, units(s)) <= 1  # noqa: E731, B023
            if w == [""] or not any(close(s) for s in seen):
                kept.append(line)
            if w != [""]:
                seen.append(w)
        out[i] = None if docs[i] is None else "\n".join(kept)
    return out


def corpus():
    rnd = random.Random(6)
    word = lambda: rnd.choice(["ab", "cd", "ef", "gh", "é", "1"])
    bases = [[word() for _ in range(n)] for n in (4, 5, 6, 9, 10, 11, 12, 13, 30, 31)]
    docs = {}
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            w = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            lines.append(rnd.choice(["  ", "", "\t"]) + rnd.choice([" ", "  "]).join(x.upper() if rnd.random() < 0.1 else x for x in w))
        docs[i] = "\n".join(lines) if i % 17 else None
    docs[500] = "\n\n"
    docs[501] = "same line " * 3 + "\n" + "same line " * 3
    for k in range(40):
        docs[600 + k] = f"a template whose only change is the number {k} here and now\nand one line that all of them have in common"
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, dropped string, near int")
    df = df.withColumns({c: F.lit(7) for c in ("_key", "_gone", "_OF", "_of_key", "text_key", "place", "k1", "id", "line")})
    want = brute(docs)
    for limit in (10_000, 0):
        done = D.dedup_lines(df, broadcast_rows=limit)
        assert sorted(done.columns) == sorted(df.columns)
        got = {r.doc_id: r.text for r in done.collect()}
        assert got == want and done.where("_key + _gone + k1 = 21").count() == len(docs)
    assert want[639] == ""


def test_edges(spark):
    rows = [(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four five\nx"), (None, None), (2, "long " * 3000), (3, "long " * 2999)]
    got = sorted((str(r.doc_id), str(r.text)[:20]) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "one two three four f")] * 2 + [("None", "x"), ("None", "None"), ("2", "long long long long "), ("3", "")])
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark):
    df = spark.createDataFrame(list(corpus().items()), "doc_id long, text string")
    plan = D.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1].replace("PythonRDD", "") or pytest.fail(plan)
    a, b = F.split(F.lit("a b c"), " "), F.split(F.lit("a c"), " ")
    assert spark.range(1).select(D.within_one(a, b) & D.within_one(b, a) & ~D.within_one(a, F.split(F.lit("a"), " "))).first()[0]


def few_words():
    docs = dict(list(corpus().items())[:60])
    lines = ["les.", "Les.", " les.", "", "  ", "yes", "yet", "a b", "1234567890", "123456789", "12345678901", "0123456789", "a b c d e f g h i j", "abcdefghij", "abcdefghi", "page number 1", "page number 2", "Page  number 13"]
    lines += ["天地玄黃宇宙洪荒日月盈昃", "天地玄黃宇宙洪荒日月盈昃", "天地玄黃宇宙洪荒日月盈", "天地玄黃宇宙洪荒日日盈昃", "天地玄黃宇宙宇宙洪荒日月盈昃", "𝄞😀" * 6, "𝄞😀" * 5 + "𝄞", "one two three four five six", "one two three four five sax", "one two three for five sax"]
    return docs | {1000 + i: line + "\n\n" + line for i, line in enumerate(lines)} | {2000: "les.\n\nles.", 2001: "\n\n"}


def test_every_line_equals_brute_force(spark):
    docs = few_words()
    want = brute(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for limit in (10_000, 0):
        assert {r.doc_id: r.text for r in D.dedup_lines(df, broadcast_rows=limit).collect()} == want
    assert want[1001] == want[2000].strip() == want[1019].strip() == want[1021].strip() == want[1016].strip() == ""
    assert want[1006] == "yet\n" and want[2001] == "\n\n"


def test_long_line_without_spaces(spark):
    rnd = random.Random(8)
    line = "".join(rnd.choice("日月火水木金土") for _ in range(60_000))
    df = spark.createDataFrame([(1, line), (2, line[:31_000] + "x" + line[31_000:]), (3, line[1:]), (4, "y" + line[2:-1])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.dedup_lines(df).collect()}
    assert got[1] == line and got[2] == got[3] == "" and got[4]

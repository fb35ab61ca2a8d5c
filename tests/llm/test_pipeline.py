import math
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from scanfleet.llm import op01_secrets, op04_language_id
import test_line_dedup as lines
import test_ngram_join as near
import test_packing as packing

WORDS = {"xx": ["alpha", "beta", "gamma", "delta", "kappa"], "yy": ["uno", "dos", "tres", "cuatro", "cinco"]}


def corpus():
    rnd = random.Random(12)

    def prose(lang, n):
        return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "ing", "ed", "or"]) for _ in range(n))

    docs = []
    for i in range(150):
        lang = rnd.choice(["xx", "yy"])
        docs.append((i, "\n".join(prose(lang, rnd.randint(3, 60)) for _ in range(rnd.randint(1, 4))), lang, f"s{i % 3}"))
    for i in range(150, 200):
        _, text, lang, source = docs[rnd.randrange(150)]
        w = text.split(" ")
        if i % 2 and len(w) > 60:
            w[rnd.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w), lang, source))
    docs += [(200, None, "xx", None), (201, "", "xx", "s"), (202, "123 !!", None, "s"), (203, 'key alpha beta token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" gamma', None, "s")]
    docs.append((204, "alphas betaing " * 2000, "xx", "s"))
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = op04_language_id.train(docs.where(op04_language_id.fold(F.col("doc_id"), 3) != 1))
    kept = {r[0]: r for r in rows if not model.predict(r[1])[2]}
    assert 203 in kept and not {200, 201, 202} & set(kept) and len(kept) >= 200
    texts = lines.brute({i: r[1] for i, r in kept.items()})
    texts = {i: t for i, t in texts.items() if t == kept[i][1] or t.split()}
    ids = sorted(texts)
    classes = near.brute([texts[i] for i in ids])
    texts = {ids[i]: texts[ids[i]] for i, c, _ in classes if c == i}
    found = {}
    ready = [(c, re.compile(c.pattern), [0.0] + [n * math.log2(n) for n in range(1, c.window + 2)]) for c in op01_secrets.CLASSES]
    allow = re.compile("|".join(f"(?:{a})" for a in op01_secrets.ALLOW))
    for i, t in texts.items():
        out, at = "", 0
        for s in op01_secrets.spans_of(t, ready, allow):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        found[i] = out + t[at:]
    assert "[assign]" in found[203]
    stage, at = docs, {}
    for name, f in P.STAGES[:4]:
        stage = P.cut_lineage(f(spark, stage, str(tmp_path)))
        assert stage.columns == docs.columns
        at[name] = {r.doc_id: r for r in stage.collect()}
    assert set(at["language_id"]) == set(kept)
    assert at["language_id"][203].lang in ("xx", "yy")
    assert {i: r.text for i, r in at["ngram_join"].items()} == texts
    assert {i: r.text for i, r in at["secret_scans"].items()} == found
    assert all(r.n_chars == len(r.text) for r in at["secret_scans"].values())
    packed = P.run(spark, str(tmp_path)).collect()
    order = sorted(found)
    place = {i: k for k, i in enumerate(order)}
    assert {r.doc_id for r in packed} == set(order)
    renamed = [type("R", (), {**r.asDict(), "doc_id": place[r.doc_id]})() for r in packed]
    packing.check(renamed, [found[i] for i in order])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from scanfleet.llm import op05_bpe as B

LETTERS = "abcdefgéèñüßÀİΣσКдж中文字😀🎉ﬁ２½²_'\"-.,!? \t\n\r\x0b\x0c\x1c\x1f\x85 　́̇​\x00\x01<|>0123ABC"


def library():
    t = Tokenizer.from_file(B.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(5)
    out = [None, "", " ", "a", "It's the END, isn't it?", "x<|startoftext|>y <|endoftext|><|ENDOFTEXT|>", "ΣΑΣ straße İstanbul", "été", "\0word", "\1<|endoftext|>", "a" * 900, "theand" * 300, "!?" * 500]
    out += ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    out += ["".join(rnd.choice("thernaedionlÉèßñ ") for _ in range(200)) for _ in range(100)]
    return out


def test_equals_the_library():
    tree, lib = B.SegmentTreeBpe(B.default_path()), library()
    import numpy as np

    for t, ids in zip(texts(), tree.encode(texts())):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=np.int32).tolist() == want, repr(t)
        assert tree.decode(np.frombuffer(ids, dtype=np.int32)) == lib.decode(want, skip_special_tokens=False)


def test_long_words_in_few_steps():
    """Words without white space: repeated symbols, overlapping pairs, and one of 32,000 letters."""
    tree, lib, rnd = B.SegmentTreeBpe(B.default_path()), library(), random.Random(9)
    words = ["a" * n for n in (63, 64, 65, 127, 1001)] + ["ab" * 500, "aab" * 400, "abaa" * 300, "the" * 333 + "t"]
    words += ["".join(rnd.choice(letters) for _ in range(rnd.randint(60, 900))) for letters in ("ab", "aabc", "etaoins", "thernaedionlus") for _ in range(40)]
    long = "".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(32_000))
    assert tree.merge([long.encode()])[0].tolist() == lib.encode(long, add_special_tokens=False).ids
    for w, ids in zip(words, tree.merge([w.encode() for w in words])):
        assert ids.tolist() == lib.encode(w, add_special_tokens=False).ids, w


def test_pairs_that_rank_before_another_way_to_make_their_symbol():
    """A vocabulary in which all pairs of a rank at once would be wrong is merged one by one."""
    import json

    import numpy as np

    tree = B.SegmentTreeBpe(B.default_path())
    with open(B.default_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    a, b, c = (vocab[x] for x in "abc")
    ab, bc, abc = vocab["ab"], vocab["bo"], vocab["and"]  # any three other symbols
    # (b c) -> bc, (a bc) -> abc, (abc a) -> ab, (a b) -> abc: the last way to make abc ranks after a pair that holds it
    pairs, made = [(b, c), (a, bc), (abc, a), (a, b)], [bc, abc, ab, abc]
    keys = np.array([(x << 32) | y for x, y in pairs])
    order = np.argsort(keys)
    tree.keys, tree.ranks, tree.made = keys[order], order.astype(np.int64), np.array(made)
    tree.together = np.array([True, True, True, False])
    rnd = random.Random(3)
    for _ in range(60):
        word = "".join(rnd.choice("abcab") for _ in range(rnd.randint(70, 200)))
        ids = [vocab[x] for x in word[:-1]] + [vocab[word[-1] + "</w>"]]
        while True:
            best = min(((pairs.index(p), i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [made[best[0]]]
        assert tree.merge([word.encode()])[0].tolist() == ids


def test_store_limit_changes_nothing():
    tree = B.SegmentTreeBpe(B.default_path())
    once = tree.encode(texts())
    tree.store.limit = 0
    assert tree.encode(texts()) == once == tree.encode(texts())


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(4, texts()[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = library()
    got = sorted(tuple(r) for r in B.op5_bpe(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_empty_table_and_name_clash(spark):
    assert B.encode(spark.createDataFrame([], "text string")).count() == 0
    row = B.decode(B.encode(spark.createDataFrame([("a b", "x", 1)], "text string, ids string, decoded int"))).first()
    assert list(row.ids) and row.decoded == "a</w> b</w>"
    with pytest.raises(Exception):
        B.encode(spark.createDataFrame([(1,)], "other int")).count()

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from scanfleet.llm import op03_packing as P

TEXTS = [
    None, "", " ", "word", "a  b\n\n c \n", "tab\there\n x", "x<|endoftext|>y <|endoftext|>", "a\t\n b", "  lead", "trail  \n", "é è ñ ß 中文 😀", "it's we'll", "\x1c a\x85b", "a　 b",
    "long word " * 3000, "x" * 5000, "short one", "short one",
]


def library():
    t = Tokenizer.from_file(P.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_equal_the_library():
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab cd\n\t '.,é1　\x1c") for _ in range(80)) for _ in range(500)]
    lib, own = library(), P.DocumentIds(P.default_path())
    for t, ids in zip(texts, own.ids(texts)):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_ordinary_texts_are_encoded_whole():
    """Most chunks of prose are new to a worker, so looking them up costs more than encoding them: only texts with an added token or rare white space are cut."""
    own = P.DocumentIds(P.default_path())
    plain = [t for t in TEXTS if not own.special(t or "")]
    cut_up = own.chunks
    own.chunks = lambda t: (_ for _ in ()).throw(AssertionError(t))
    got = own.ids(plain)
    own.chunks = cut_up
    assert 0 < len(plain) < len(TEXTS) and got == own.store.ids(plain, cut_up)


def test_cut():
    for n in (1, 1023, 1024, 1025, 2048, 5000):
        parts = P.cut(np.arange(n), 1024)
        assert np.concatenate([p for _, p in parts]).tolist() == list(range(n))
        assert all(len(p) == 1024 for _, p in parts[1:]) and all(p[0] == a for a, p in parts)


def best_fit(lengths, capacity):
    """The same rule, one piece at a time."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    bins = []
    while large:
        n = large.pop(0)
        partner = next((m for m in large if m <= capacity - n), None)
        if partner is not None:
            large.remove(partner)
        bins.append([n] + ([partner] if partner is not None else []))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return bins


def test_plan_equals_one_at_a_time():
    rnd = random.Random(7)
    for trial in range(150):
        capacity = rnd.choice([10, 30, 64])
        lengths = [rnd.choice([rnd.randint(1, capacity), rnd.randint(1, capacity // 3), 5]) for _ in range(rnd.randint(0, 120))]
        groups = P.plan(dict(Counter(lengths)), capacity)
        assert all(many > 0 and 0 < sum(c) <= capacity for c, many in groups)
        assert sum((Counter({n: k * many for n, k in Counter(c).items()}) for c, many in groups), Counter()) == Counter(lengths)
        assert sum(many for _, many in groups) == len(best_fit(lengths, capacity)), (trial, capacity)


def check(rows, texts, capacity=1024):
    lib = library()
    byd, bys = {}, {}
    for r in rows:
        byd.setdefault(r.doc_id, []).append(r)
        bys.setdefault(r.sequence_id, []).append(r)
    assert set(byd) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(byd[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in bys.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bys)


def test_query(spark, tmp_path):
    texts = TEXTS + ["copy of one text"] * 400 + [f"text {i} " * (i % 90) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op3_best_fit_packing(spark, str(tmp_path)).collect()
    n = check(rows, texts)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_sequences_and_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string")
    packed = P.pack(docs)
    assert packed.count() == 3
    assert sorted(len(r.ids) for r in P.sequences(packed).collect()) == [8]
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0

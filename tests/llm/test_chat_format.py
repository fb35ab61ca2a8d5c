import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from scanfleet.llm import op06_chat_format as C

PARTS = ["<s>", "</s>", "<sep>", "[INST]", "[/INST]", "<nl>", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "\n", "é😀", "plain", "", "<", "[", "/s>", "$1", "<<s>>", "[[INST]]"]


def turns():
    rnd = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for k in range(rnd.randint(1, 9)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 6)))
            rows.append((conv, rnd.choice([k, k, 3, None]), rnd.choice(["user", "assistant", "assistant", "system", None, "a\nb</s>"]), text))
    rows += [(100, 0, "user", "x")] * 3 + [(101, i, "assistant", "same <sep> é") for i in range(300)] + [(102, 0, "assistant", "long [INST] " * 20000)]
    rnd.shuffle(rows)
    return rows


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c in by:
        by[c].sort(key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))
    return {c: [(r, x) for _, _, r, x in v] for c, v in by.items()}


def test_round_trip_and_mask(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = C.format_chats(df).select("*", C.read_chats(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    expect = want(rows)
    assert len(got) == len(expect)
    for r in got:
        turns_ = expect[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns_
        assert r.loss == "".join(x for role, x in turns_ if role == "assistant")
        assert len(r.loss_mask) == sum(role == "assistant" for role, _ in turns_)
        runs = sum(i == 0 or turns_[i - 1][0] != turns_[i][0] for i in range(len(turns_)))
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == runs
        under = set().union(*[range(s.start, s.start + s.length) for s in r.loss_mask]) if len(r.formatted) < 10000 else set()
        assert all("</s>" not in r.formatted[s.start : s.start + s.length] for s in r.loss_mask) and len(under) <= len(r.formatted)


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in turns() if r[0] is not None]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in C.op6_chat_format(spark, str(tmp_path)).collect()}
    expect = want(rows) | {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, t in expect.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(C.SQL)
    names = [d[0] for d in cur.description]
    assert {r[0]: dict(zip(names, r)) for r in cur.fetchall()} == got


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

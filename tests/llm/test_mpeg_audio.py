import hashlib
import random
import zlib

from scanfleet.llm import op10_mpeg_audio as M

TEXTS = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "\xff\xfb" * 4000, "".join(chr(random.Random(1).randint(32, 900)) for _ in range(5000)), "a" * 100000, "TAG" * 200]


def payload(text):
    raw = (text or "").encode()
    while not raw or len(raw) % 576:
        raw += b"\xff"
    return raw


def test_round_trip():
    rnd = random.Random(2)
    for raw in [payload(t) for t in TEXTS] + [rnd.randbytes(576 * rnd.randint(1, 9)) for _ in range(60)] + [b"\xff" * 5760, b"\0" * 576]:
        got = M.read(M.write(raw))
        n = len(raw) // 576
        assert got["payload"] == raw
        assert (got["frames"], got["told_frames"], got["samples"], got["crc_good"], got["crc_bad"], got["skipped"], got["resyncs"]) == (n, n, n * 1152, n + 1, 0, 0, 0)
        assert got["seconds"] == n * 1152 / 44100 and got["tags"]["TLEN"] == str(n * 1152000 // 44100)
        assert len(got["offsets"]) == n and len(got["toc"]) == 100


def test_seek_offsets_and_table():
    media = M.write(payload("word " * 2000))
    got = M.read(media)
    assert all(M.header(media[o : o + 4]) for o in got["offsets"])
    assert got["variable"] and got["toc"] == sorted(got["toc"])


def test_checksum_by_bits():
    def bitwise(data):
        c = 0xFFFF
        for b in data:
            for i in range(7, -1, -1):
                top = (c >> 15) ^ ((b >> i) & 1)
                c = (c << 1) & 0xFFFF
                c ^= 0x8005 if top else 0
        return c

    for n in range(40):
        data = random.Random(n).randbytes(n)
        assert M.checksum(data) == bitwise(data)


def test_damage():
    raw = payload("some text here " * 500)
    media = M.write(raw)
    got = M.read(media)
    o = got["offsets"]
    lost = M.read(media[: o[3] + 7] + media[o[4] :])  # a frame cut short
    assert lost["skipped"] > 0 and lost["resyncs"] == 1 and lost["frames"] == got["frames"] - 1
    junk = M.read(media[: o[2]] + b"\xff\xfbjunk" * 9 + media[o[2] :])
    assert junk["frames"] == got["frames"] and junk["payload"] == raw and junk["skipped"] == 54
    bad = bytearray(media)
    bad[o[5] + 4] ^= 1
    assert M.read(bytes(bad))["crc_bad"] == 1 and M.read(bytes(bad))["payload"] == raw
    assert M.read(media[:-300])["frames"] >= got["frames"] - 2
    for broken in (b"", None, b"\xff" * 50, b"ID3", b"ID3\x04\0\x40\0\0\0\x7f" + b"\0" * 4, b"TAG" + b"\0" * 125):
        assert M.read(broken)["frames"] == 0


def test_headers():
    assert M.header(b"\xff\xfb\x90\x64").length == 417 and M.header(b"\xff\xfb\x92\x64").length == 418
    assert M.header(b"\xff\xf3\x80\xc0").samples == 576 and M.header(b"\xff\xf3\x80\xc0").length == 72 * 64000 // 22050
    assert M.header(b"\xff\xfd\x90\x64").samples == 1152 and M.header(b"\xff\xff\x90\x64").samples == 384
    assert M.header(b"\xff\xeb\x90\x64") is None and M.header(b"\xff\xfb\xf0\x64") is None and M.header(b"\xff\xfb\x9c\x64") is None


def test_query(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS), (2, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = M.op10_mpeg_audio(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = payload(TEXTS[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((TEXTS[r.doc_id] or "").encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-32:])
        media = M.write(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    cols = ["doc_id", "media", "audio"]
    by_id = lambda df: {r.doc_id: r for r in df.select(*cols).collect()}
    assert by_id(M.parse(M.store(docs))) == by_id(M.store_and_parse(docs))
    assert M.parse(M.store(spark.createDataFrame([], "text string"))).count() == 0
    assert M.parse(spark.createDataFrame([(None, 1)], "media binary, audio int")).first().audio.frames == 0

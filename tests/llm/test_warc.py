import gzip
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scanfleet.llm import op11_warc as W


def pages():
    rnd = random.Random(11)
    same = "<p>" + "x" * 200
    rows = [(i, f"http://h/{i % 50}", rnd.choice([None, "", "é" * 49, "é" * 50, "z" * 99, "z" * 100, same, f"<b>{i}</b>" * rnd.randrange(60)])) for i in range(400)]
    rows += [(None, None, same), (None, "http://n", "only null " * 20), (1000, "  http://x/\r\nWARC-Type: revisit  ", "a\r\n\r\nWARC/1.1\r\n" * 20), (1001, "http://ü/", "y" * 3_000_000)]
    return rows + [(5000, "u", "repeated " * 30), (5000, "v", "repeated " * 30), (5001, "u", "repeated " * 30)] + [(6000 + i, "hot", same) for i in range(800)]


def brute(rows):
    out, first = [], {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and i != first.get(data)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "e") for r in rows], "page_id long, url string, html string, offset int, content string, error string").repartition(3)


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = pages()
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in W.op11_warc_packages(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_sound_and_ranges_are_enough(spark, zip64):
    rows = pages()
    packages = W.write_packages(frame(spark, rows), most_bytes=9_000, most_records=50, zip64=zip64).cache()
    kept = packages.collect()
    assert len(kept) > 10 and len({p["package"] for p in kept}) == len(kept)
    for p in kept:  # another reader of the formats sees the same
        with zipfile.ZipFile(io.BytesIO(p["content"])) as z:
            assert z.testzip() is None and z.namelist() == [W.ARCHIVE, W.INDEX] and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert gzip.decompress(z.read(W.ARCHIVE)).count(b"WARC-Record-ID:") == len(z.read(W.INDEX).splitlines())
    places = W.locate(packages).cache()
    assert places.count() == len(rows) and places.where("error IS NOT NULL").count() == 0
    want = {(r["package"], r["offset"]): r.asDict() for r in W.read_packages(packages).collect()}
    some = W.fetch(packages, places.where("offset % 3 = 0")).collect()
    assert 50 < len(some) < len(want) and all(want[r["package"], r["offset"]] == r.asDict() for r in some)
    # responses bring their payload and url back, revisits their response
    html = {i: (u, (h or "").encode()) for i, u, h in rows if i is not None}
    for r in want.values():
        if r["page_id"] in html and r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]][1] and (r["page_id"] == 5000 or r["url"] == W._escape(html[r["page_id"]][0]))
        elif r["page_id"] in html:
            assert r["payload"] is None and hashlib.sha256(html[r["refers_to"]][1]).hexdigest() == r["payload_digest"] and r["payload_bytes"] == len(html[r["page_id"]][1])


def test_packages_of_other_writers():
    one = W.record(7, "http://a", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None, False)
    two = W.record(8, None, b"x" * 100_000, hashlib.sha256(b"x" * 100_000).hexdigest(), 100_000, None, False)
    for force in (False, True):
        for name, body in (("archive/a.warc.gz", gzip.compress(one) + gzip.compress(two)), ("archive/a.warc", one + two)):
            raw = io.BytesIO(b"#!stub before the first member\n")
            raw.seek(0, 2)
            with zipfile.ZipFile(raw, "a", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo("pages/ä.txt"), "w", force_zip64=force) as f:
                    f.write(b"PK\x05\x06 not the end")
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
                    f.write(body)
                z.writestr("packed.txt", "y" * 1000, compress_type=zipfile.ZIP_DEFLATED)
                z.comment = b"a comment with PK\x05\x06 in it and more text behind it"
            data = memoryview(raw.getvalue())
            assert "packed.txt" not in W.zip_directory(data) and "pages/ä.txt" in W.zip_directory(data)
            got = [W.read_record(data, *p) for p in W.record_places(data)]
            assert [(g["page_id"], g["payload_bytes"], g["url"]) for g in got] == [(7, 5, "http://a"), (8, 100_000, None)]


def test_many_members_need_zip64():
    data = W.zip_stored([(f"m{i}", b"") for i in range(66_000)])
    assert len(W.zip_directory(memoryview(data))) == 66_000
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert len(z.namelist()) == 66_000


def test_damage_gives_errors_and_no_crash(spark):
    sound = W.write_packages(frame(spark, [(1, "u", "first " * 30), (2, "v", "second " * 30)]).coalesce(1)).first()["content"]
    rnd = random.Random(4)
    bad = [None, b"", b"PK", bytes(sound[:-30]), bytes(sound[40:]), bytes(1000), bytes(sound)]
    for _ in range(200):
        b = bytearray(sound)
        for _ in range(rnd.choice((1, 3, 20))):
            b[rnd.randrange(len(b))] = rnd.randrange(256)
        bad.append(bytes(b[: rnd.choice((len(b), rnd.randrange(len(b))))]))
    df = spark.createDataFrame([(str(i), b, 1) for i, b in enumerate(bad)], "package string, content binary, page_id int")
    got = W.read_packages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["package"], []).append(r)
    assert all(by[str(i)][0]["error"] for i in range(6) if i != 4) and [r["error"] for r in by["6"]] == [None, None]
    told = {hashlib.sha256(("first " * 30).encode()).hexdigest(), hashlib.sha256(("second " * 30).encode()).hexdigest()}
    assert all(r["payload_digest"] in told for r in got if r["error"] is None and r["record_type"] == "response")
    assert {r["package"] for r in W.locate(df).collect()} == set(map(str, range(len(bad))))


def test_empty(spark):
    none = frame(spark, pages()).where("false")
    packages = W.write_packages(none)
    assert packages.count() == 0 and W.read_packages(packages).count() == 0 and W.locate(packages).count() == 0

"""WARC records in ZIP packages: a writer, and a reader that takes ranges of stored members instead of unpacking them.

A package is a ZIP file of two stored members: ``archive/data.warc.gz``, a gzip member per record, and ``indexes/index.cdx``, a line per record with its
offset and length in the former. The reader goes from the end: the end record of the central directory (searched behind a comment of any length), the ZIP64 locator and end record where
the file has them, the central directory with its ZIP64 extra fields, and the local headers, which say where a member's bytes begin. ``locate`` gives a row per
record from directory and index alone; ``fetch`` reads rows of that kind from their packages: one range a record, whose gzip member alone is unpacked. An archive
member without an index is walked record by record. Spark's rows stay independent of each other: any executor can read any package again.

Records of equal payloads are written once: the one with the smallest page_id as response, the others as revisits that name it and carry its HTTP header
(with the payload's length) and its payload digest. Which payloads are equal is decided by SHA-256; it is counted per digest before anything is joined, and the join of the payloads to
the digests that occur more than once can be split where one digest has many rows.

A null html is an empty payload. Payloads of under ``SMALL`` bytes are always responses. Rows that repeat the smallest page_id of their payload are each a
response; a null page_id is larger than all others, and its record has no page in its id (page_id is null again when read). Control characters in a url are percent-encoded, a null
url is left out. A payload of any length is one record. Other columns are ignored by the writer. What can't be read never stops the reader: it gives a row with ``error`` and nulls.
Extra columns of a table of packages are ignored; packages that are null or empty give a row with an error. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table

SMALL = 100
#: Bytes of compressed records, and records, from which on a package is closed.
PACKAGE_BYTES, PACKAGE_RECORDS = 4 << 20, 20_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Stated so that equal rows give equal packages.
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- ZIP


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members. With ``zip64`` all sizes and offsets stand in ZIP64 fields, as files past 4 GB or 65,535 members need."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, raw, crc = len(out), name.encode(), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= 0xFFFFFFFF
        size, where, version = (0xFFFFFFFF, 0xFFFFFFFF, 45) if wide else (len(data), at, 20)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += struct.pack("<4s5H3I2H", b"PK\x03\x04", version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", version, version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or n >= 0xFFFF or max(at, len(central)) >= 0xFFFFFFFF:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
        out += struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, len(central), at, 0)
    return bytes(out)


def zip_directory(data: memoryview) -> dict[str, tuple[int, int]]:
    """Where the stored, unencrypted members begin and how long they are, by name. Raises ValueError where the file has no directory."""
    tail = bytes(data[-(22 + 0xFFFF) :])
    first = len(data) - len(tail)
    at = len(tail)
    while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:  # a comment may hold the mark, so its length has to fit
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, n, length, begin, _ = struct.unpack_from("<4H2IH", tail, at + 4)
    end = first + at
    if end >= 20 and data[end - 20 : end - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", data, end - 12)
        if where + 56 > len(data) or data[where : where + 4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator says")
        n, length, begin = struct.unpack_from("<3Q", data, where + 32)
        end = where
    shift = max(0, end - length - begin)  # bytes before the first member, as self-extracting files have
    out, at = {}, begin + shift
    for _ in range(n):
        if at + 46 > len(data) or data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is cut off")
        flags, method = struct.unpack_from("<2H", data, at + 8)
        packed, size = struct.unpack_from("<2I", data, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<3H", data, at + 28)
        (local,) = struct.unpack_from("<I", data, at + 42)
        name = bytes(data[at + 46 : at + 46 + name_n])
        extra = bytes(data[at + 46 + name_n : at + 46 + name_n + extra_n])
        at += 46 + name_n + extra_n + comment_n
        wide = _zip64_fields(extra)
        sizes = [size, packed, local]
        for k, value in enumerate(sizes):  # only those that don't fit stand in the field, in this order
            if value == 0xFFFFFFFF and len(wide) >= 8:
                sizes[k], wide = int.from_bytes(wide[:8], "little"), wide[8:]
        size, packed, local = sizes
        if method == 0 and not flags & 1 and packed == size:
            local += shift
            if local + 30 > len(data) or data[local : local + 4] != b"PK\x03\x04":
                raise ValueError("no local header where the directory says")
            name_n, extra_n = struct.unpack_from("<2H", data, local + 26)
            if (start := local + 30 + name_n + extra_n) + size > len(data):
                raise ValueError("a member is cut off")
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (start, size)
    return out


def _zip64_fields(extra: bytes) -> bytes:
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if kind == 1:
            return extra[4 : 4 + n]
        extra = extra[4 + n :]
    return b""


# ---------------------------------------------------------------- WARC


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = _HTTP.format(length).encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escape(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + body + CRLF + CRLF


def _escape(url: str) -> str:
    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return re.sub(r"^ +| +$", lambda m: "%20" * len(m[0]), url)


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Names in lower case and values, and where the body begins."""
    end = data.find(CRLF + CRLF)
    if end < 0:
        raise ValueError("a header doesn't end")
    out: dict[str, str] = {}
    for line in data[:end].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip(b" \t").decode("utf-8", "replace")
    return out, end + 4


def parse_record(data: bytes) -> dict:
    """What a record that isn't compressed says. ``payload`` is what it holds itself; a revisit has the length and digest of what it refers to."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, at = _headers(data)
    body = data[at : at + int(head.get("content-length", ""))]
    if len(body) != int(head["content-length"]):
        raise ValueError("a record is cut off")
    payload, length = body, len(body)
    if head.get("content-type", "").startswith("application/http"):
        http, begin = _headers(body)
        payload = body[begin:]
        length = len(payload)
        if "content-length" in http:
            length = int(http["content-length"])
    revisit = head.get("warc-type") == "revisit"
    told = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    digest = told if revisit else hashlib.sha256(payload).hexdigest()
    if not revisit and (told not in (None, digest) or length != len(payload)):
        raise ValueError("the payload isn't what its record says")
    return {
        "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": _page(head.get("warc-refers-to")) if revisit else None,
        "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload, "error": None,
    }


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def package(records: Iterable[tuple[int | None, str, bytes]], zip64: bool = False) -> bytes:
    """A package of (page_id, digest, compressed record) rows."""
    body, lines, at = [], [], 0
    for page_id, digest, data in records:
        lines.append(f"{'-' if page_id is None else page_id} {digest} {at} {len(data)}\n")
        body.append(data)
        at += len(data)
    return zip_stored([(ARCHIVE, b"".join(body)), (INDEX, "".join(lines).encode())], zip64)


def record_places(data: memoryview) -> list[tuple[int, int]]:
    """(offset in the package, length) of each record: what the index says, or else what a walk through the archive's gzip members finds."""
    members = zip_directory(data)
    archives = [n for n in members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))]
    if INDEX in members and archives == [ARCHIVE]:
        (start, size), (at, n) = members[ARCHIVE], members[INDEX]
        out = []
        for line in bytes(data[at : at + n]).splitlines():
            _, _, offset, length = line.split(b" ")
            if int(offset) + int(length) > size or int(offset) < 0 or int(length) < 0:
                raise ValueError("the index points past the archive")
            out.append((start + int(offset), int(length)))
        return out
    if not archives:
        raise ValueError("no stored archive")
    return [x for name in archives for x in _walk(data, *members[name], name.endswith(".gz"))]


def _walk(data: memoryview, at: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    end = at + size
    while at < end:
        if packed:
            d, taken = zlib.decompressobj(31), at
            while not d.eof and taken < end:
                d.decompress(data[taken : min(end, taken + 65536)])
                taken += 65536
            if not d.eof:
                raise ValueError("the last gzip member is cut off")
            n = min(taken, end) - at - len(d.unused_data)
        else:
            head, begin = _headers(bytes(data[at : min(end, at + 65536)]))
            n = begin + int(head["content-length"]) + 4
        yield at, n
        at += n


def read_record(data: memoryview, offset: int, length: int) -> dict:
    part = bytes(data[offset : offset + length])
    return parse_record(zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else part)


# ---------------------------------------------------------------- Spark


def roles(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, payload_bytes, refers_to and revisit for each row of ``pages``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("payload_bytes") >= small).groupBy(F.col("payload_digest").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(shared, rows["payload_digest"] == shared["digest"], "left")
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


_PACKAGES = "package string, content binary"


def write_packages(pages: DataFrame, small: int = SMALL, most_bytes: int = PACKAGE_BYTES, most_records: int = PACKAGE_RECORDS, zip64: bool = False) -> DataFrame:
    """package (a name) and content (the ZIP file), a row per package, of tables with page_id, url and html. Packages are closed as they fill, so a task holds one at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{made:06d}.wacz"]), pa.array([package(held, zip64)], type=pa.binary())], names=["package", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                data = _gzip(record(row["page_id"], row["url"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["refers_to"], row["revisit"]))
                held.append((row["page_id"], row["payload_digest"], data))
                size += len(data)
                if size >= most_bytes or len(held) >= most_records:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    return roles(pages, small).mapInArrow(packed, _PACKAGES)


def locate(packages: DataFrame) -> DataFrame:
    """package, offset and length of every record, from directories and indexes alone; ``error`` where a package can't be read."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch["package"][i].as_py(), batch["content"][i]
                try:
                    places, error = record_places(memoryview(content.as_buffer() or b"")), None
                except Exception as e:  # noqa: BLE001 - a broken file gives a row that says so
                    places, error = [(None, None)], _said(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(places), type=pa.string()), pa.array([p[0] for p in places], type=pa.int64()), pa.array([p[1] for p in places], type=pa.int64()), pa.array([error] * len(places), type=pa.string())],
                    names=["package", "offset", "length", "error"],
                )

    return packages.select("package", "content").mapInArrow(located, "package string, offset bigint, length bigint, error string")


_RECORD = pa.schema([
    ("package", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])
_RECORD_DDL = "package string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
#: Records, and bytes of their payloads, that a reader gives on at a time.
GIVEN, GIVEN_BYTES = 1024, 8 << 20


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def _records(name: str | None, content: pa.BinaryScalar, wanted: list[tuple[int, int]] | None, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records of one package: all, or those at ``wanted`` places."""
    try:
        data = memoryview(content.as_buffer() or b"")
        places = record_places(data) if wanted is None else wanted
    except Exception as e:  # noqa: BLE001
        yield pa.RecordBatch.from_pylist([{"package": name, "error": _said(e)}], schema=_RECORD)
        return
    held, size = [], 0
    for offset, length in places:
        try:
            row = read_record(data, offset, length)
        except Exception as e:  # noqa: BLE001
            row = {"error": _said(e)}
        size += len(row.get("payload") or b"")
        held.append(row | {"package": name, "offset": offset} | ({} if payloads else {"payload": None}))
        if len(held) >= GIVEN or size >= GIVEN_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of tables with package and content (as Spark's binaryFile source gives them as path and content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _records(batch["package"][i].as_py(), batch["content"][i], None, payloads)

    return packages.select("package", "content").mapInArrow(read, _RECORD_DDL)


def fetch(packages: DataFrame, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the places in ``wanted`` (package, offset and length, as ``locate`` gives them). A place that isn't one gives an error; so does a package
    of that name that can't be read. Places whose package is missing give nothing."""
    places = wanted.where("offset IS NOT NULL").groupBy("package").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = sorted((p["offset"], p["length"]) for p in batch["places"][i].as_py())
                yield from _records(batch["package"][i].as_py(), batch["content"][i], at, payloads)

    return packages.select("package", "content").join(places, "package").mapInArrow(read, _RECORD_DDL)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f"""


@query("op11_warc_packages", SQL)
def op11_warc_packages(spark, sf_dir):
    packages = cut_lineage(write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    records = read_packages(packages, payloads=False)
    # a record that can't be read back must not pass for a page
    sound = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unreadable record: "), F.col("error"))).cast("boolean"))
    return records.where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

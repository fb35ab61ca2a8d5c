"""MPEG audio as a media column: a writer that carries bytes losslessly, and a reader for any MPEG-1/2/2.5 stream.

The writer makes an ID3v2 tag, a frame with a variable-bitrate table, a Layer III frame per 576 payload bytes and an ID3v1 tag. A
frame is silent (its side information is zero) and protected by a checksum; the payload lies in its ancillary data: a count,
a fill byte and the bytes before the run of fill bytes that ends the unit, in the lowest bitrate that holds them.

The reader skips ID3v2, ID3v1 and APE tags, finds frames by their sync word and, where a header doesn't lead to another one,
goes on byte by byte to the next that does. It verifies Layer III checksums, reads Xing, Info and VBRI tables, counts samples and keeps
the byte offset of every frame. Durations are exact: samples over the sample rate.

Null texts count as empty; a payload has one unit at least. Null or empty media have no frames, null duration and an empty payload. Damaged
streams give what can be read, with ``skipped`` bytes and ``crc_bad`` frames counted. Texts of any length are stored whole, equal
texts as equal bytes. A column that already has the output's name is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .registry import query, table

UNIT = 576

# fixed values: kbit/s by index, per (version 1, layer) and (version 2 or 2.5, layer); Hz by version and index
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header(NamedTuple):
    key: tuple[int, int, int]  # version bits, layer and sample rate, which stay the same along a stream
    samples: int
    rate: int
    kbps: int
    length: int
    protected: bool
    side: int


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None for bytes that aren't one. Free-format frames have no length of their own and don't count."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    bitrate, rate = four[2] >> 4, (four[2] >> 2) & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbps, hz, padding = BITRATES[1 if first else 2, layer][bitrate], RATES[version][rate], (four[2] >> 1) & 1
    mono = four[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    length = (12_000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header((version, layer, hz), samples, hz, kbps, length, not four[1] & 1, side if layer == 3 else 0)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def checksum(covered: bytes) -> int:
    """CRC-16 of the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in covered:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


# ---- writer: MPEG-1 Layer III, 44.1 kHz, one channel

_SIDE = 17
_HEAD = 4 + 2 + _SIDE


@lru_cache(maxsize=2048)
def _start(room: int) -> tuple[bytes, int]:
    """Header, checksum and side information of the smallest frame with ``room`` bytes behind them, and the frame's length."""
    for index in range(1, 15):
        four = bytes([0xFF, 0xFA, index << 4, 0xC0])
        length = header(four).length
        if length >= _HEAD + room:
            side = bytes(_SIDE)
            return four + struct.pack(">H", checksum(four[2:] + side)) + side, length
    raise ValueError(f"no frame holds {room} bytes")


def _frame(data: bytes) -> bytes:
    head, length = _start(len(data))
    return (head + data).ljust(length, b"\0")


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _id3v2(frames: dict[str, str]) -> bytes:
    body = b"".join(k.encode() + struct.pack(">IH", len(v) + 1, 0) + b"\0" + v.encode("latin-1") for k, v in frames.items())
    return b"ID3\x03\0\0" + _synchsafe(len(body)) + body


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def write(payload: bytes) -> bytes:
    """The stored form of a payload of whole units."""
    frames = []
    for at in range(0, len(payload), UNIT):
        unit = payload[at : at + UNIT]
        kept = unit.rstrip(unit[-1:])
        frames.append(_frame(struct.pack(">HB", len(kept), unit[-1]) + kept))
    total, ends, n = sum(map(len, frames)), [0], len(frames)
    for f in frames:
        ends.append(ends[-1] + len(f))
    info_length = _start(120)[1]
    whole = total + info_length
    toc = bytes(min(255, 256 * (info_length + ends[i * n // 100]) // whole) for i in range(100))
    info = _frame(b"Xing" + struct.pack(">III", 0xF, n, whole) + toc + struct.pack(">I", 0))
    tag = _id3v2({"TLEN": str(n * 1152 * 1000 // 44100), "TSSE": "payload in ancillary data"})
    return tag + info + b"".join(frames) + b"TAG".ljust(127, b"\0") + b"\xff"


# ---- reader


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where audio begins and ends, and the text frames of ID3v2.3 and 2.4 tags."""
    begin, end, said = 0, len(data), {}
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[begin + 6 : begin + 10], (21, 14, 7, 0)))
        at, stop, newer = begin + 10, min(begin + 10 + size, len(data)), data[begin + 3] == 4
        if data[begin + 5] & 0x40 and at + 4 <= stop:  # extended header
            at += sum((b & 0x7F) << s for b, s in zip(data[at : at + 4], (21, 14, 7, 0))) if newer else 4 + struct.unpack(">I", data[at : at + 4])[0]
        while at + 10 <= stop and data[at : at + 4].isalnum():
            n = sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0))) if newer else struct.unpack(">I", data[at + 4 : at + 8])[0]
            if data[at : at + 1] == b"T" and n > 1:
                body = data[at + 10 : min(at + 10 + n, stop)]
                said[data[at : at + 4].decode("latin-1")] = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            at += 10 + n
        begin += 10 + size + (10 if data[begin + 5] & 0x10 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - begin >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        end -= size + (32 if flags >> 31 else 0)
    return min(begin, len(data)), max(begin, end), said


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in a first frame."""
    body = at + 4 + (2 if h.protected else 0) + h.side
    name = data[body : body + 4]
    if name in (b"Xing", b"Info") and body + 8 <= len(data):
        flags, p, out = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8, {"frames": None, "toc": []}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(data):
                out[key], p = struct.unpack(">I", data[p : p + 4])[0], p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    v = at + 4 + 32
    if data[v : v + 4] == b"VBRI" and v + 26 <= len(data):
        frames, entries, scale, width = struct.unpack(">IHHH", data[v + 14 : v + 24])
        steps = [int.from_bytes(data[v + 26 + i * width : v + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"frames": frames, "toc": steps}
    return None


def read(data: bytes | None) -> dict:
    """Everything that the stream says, and the payload that ``write`` put there."""
    data = data or b""
    at, end, said = _tags(data)
    begin, key, offsets, payload = at, None, [], []
    samples = skipped = resyncs = good = bad = 0
    vbr, rates, hz = None, set(), None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and key in (None, h.key) and at + h.length <= end:
            then = at + h.length
            follower = header(data[then : then + 4]) if then + 4 <= end else h
            if follower and follower.key == h.key or key is not None and (not skipped or offsets and offsets[-1] + last == at):
                first = key is None
                key, last, hz = h.key, h.length, h.rate
                body = at + 4 + (2 if h.protected else 0) + h.side
                if h.protected and h.side:
                    if checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big"):
                        good += 1
                    else:
                        bad += 1
                found = _table(data, at, h) if first else None
                if found:
                    vbr = found
                else:
                    offsets.append(at)
                    samples += h.samples
                    rates.add(h.kbps)
                    n, fill = int.from_bytes(data[body : body + 2], "big"), data[body + 2 : body + 3]
                    payload.append(data[body + 3 : body + 3 + n] + fill * (UNIT - n) if n <= UNIT else b"")
                at = then
                continue
        nxt = data.find(b"\xff", at + 1, end)
        resyncs += at == begin or bool(offsets) and offsets[-1] + last == at
        skipped += (nxt if nxt >= 0 else end) - at
        at = nxt if nxt >= 0 else end
    return {
        "payload": b"".join(payload), "frames": len(offsets), "samples": samples, "sample_rate": hz, "seconds": samples / hz if hz and samples else None,
        "variable": len(rates) > 1, "told_frames": vbr["frames"] if vbr else None, "toc": vbr["toc"] if vbr else [], "offsets": offsets, "tags": said,
        "crc_good": good, "crc_bad": bad, "resyncs": int(resyncs), "skipped": skipped,
    }


AUDIO = pa.struct([
    ("payload", pa.binary()), ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("seconds", pa.float64()), ("variable", pa.bool_()), ("told_frames", pa.int64()),
    ("toc", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("resyncs", pa.int64()), ("skipped", pa.int64()),
])
AUDIO_DDL = (
    "struct<payload:binary,frames:bigint,samples:bigint,sample_rate:int,seconds:double,variable:boolean,told_frames:bigint,toc:array<int>,"
    "offsets:array<bigint>,tags:map<string,string>,crc_good:bigint,crc_bad:bigint,resyncs:bigint,skipped:bigint>"
)

def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with ``out``: binary, the text's bytes as an MPEG stream."""

    @F.arrow_udf("binary")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([write(payload_of(t.as_py())) for t in texts], type=pa.binary())

    return docs.withColumn(out, made(F.col(text)))


def parse(docs: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """``docs`` with ``out``: what the stream in ``media`` says."""

    @F.arrow_udf(AUDIO_DDL)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for streams in slices(batches):
            yield _audio([s.as_py() for s in streams])

    return docs.withColumn(out, parsed(F.col(media)))


def _audio(streams: list[bytes | None]) -> pa.Array:
    rows = [read(s) for s in streams]
    for r in rows:
        r["tags"] = list(r["tags"].items())
    return pa.array(rows, type=AUDIO)


def store_and_parse(docs: DataFrame, text: str = "text", media: str = "media", audio: str = "audio") -> DataFrame:
    """``store`` and then ``parse`` in one Python worker a task, so that streams don't go back and forth between the two."""

    @F.arrow_udf(f"struct<media:binary,audio:{AUDIO_DDL}>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            stored = [write(payload_of(t.as_py())) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(stored, type=pa.binary()), _audio(stored)], names=["media", "audio"])

    done = docs.withColumn("_both", both(F.col(text)))
    return done.withColumns({media: F.col("_both.media"), audio: F.col("_both.audio")}).drop("_both")


@query("op10_mpeg_audio")
def op10_mpeg_audio(spark, sf_dir):
    done = store_and_parse(table(spark, sf_dir, "documents").select("doc_id", "text"))
    audio = F.col("audio")
    return done.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length(audio["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(audio["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(audio["payload"], -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws(
            ":",
            audio["frames"], audio["samples"], audio["sample_rate"], audio["variable"], audio["told_frames"], audio["crc_good"], audio["crc_bad"], audio["skipped"],
            F.element_at(audio["offsets"], -1), F.element_at(audio["toc"], -1), audio["tags"]["TLEN"],
        ).alias("feature"),
    )

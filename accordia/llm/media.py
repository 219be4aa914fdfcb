"""Operator 8: MPEG audio columns: frames with checksums, tags and variable-bitrate tables, durations and seek offsets.

A payload is kept losslessly in the ancillary bytes of silent Layer III frames (mono, 48 kHz, variable bitrate, with
checksums), behind an ID3v2 tag that has its length and a Xing table, and before an ID3v1 tag. The parser takes any
MPEG audio: it finds frames again after damage, in MPEG 1, 2 and 2.5, Layers I to III.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The bitrate (kbit/s) and sampling-rate tables of the MPEG audio standards.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES[2, 3] = BITRATES[2, 2]
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

#: Bytes of header, checksum and side information before a stored frame's ancillary bytes.
OVERHEAD = 4 + 2 + 17
PAD = 64


@dataclass(slots=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III's side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The frame header in four bytes; None where they are none (free-format frames count as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = (2.5, None, 2, 1)[raw[1] >> 3 & 3], (None, 3, 2, 1)[raw[1] >> 1 & 3]
    if version is None or layer is None or raw[2] >> 4 in (0, 15) or raw[2] >> 2 & 3 == 3 or raw[3] & 3 == 2:
        return None
    bitrate, rate = BITRATES[1 if version == 1 else 2, layer][raw[2] >> 4], RATES[version][raw[2] >> 2 & 3]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    pad = raw[2] >> 1 & 1
    size = (12000 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + pad
    return Header(version, layer, not raw[1] & 1, bitrate, rate, raw[3] >> 6 == 3, size, samples)


@lru_cache(65536)
def crc16(raw: bytes) -> int:
    """The checksum of MPEG audio, bit by bit from the highest."""
    crc = CRC_START
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def checked(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's checksum is right; None where there is none, or in Layer II, whose extent needs its tables."""
    if not h.protected or h.layer == 2:
        return None
    n = h.side if h.layer == 3 else (16 if h.mono else 32)
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What parse() found. offsets: of each audio frame, to seek by."""

    rate: int = 0
    samples: int = 0
    frames: int = 0
    offsets: list[int] = field(default_factory=list)
    bitrates: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds, exactly: samples over rate."""
        return self.samples, self.rate


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length and text frames of a version-2 tag at the start (versions 3 and 4)."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    end, at, tags = min(10 + size, len(data)), 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("ascii")
        raw = data[at + 4 : at + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(at + 10 + n, end)]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + n
    return 10 + size + (10 if data[5] & 16 else 0), tags


def _xing(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table of a Xing/Info or VBRI frame."""
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, x, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": data[x : x + 4].decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(data[x : x + 4], "big")
                x += 4
        if flags & 4:
            out["toc"] = list(data[x : x + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        size, frames, entries, scale, width = struct.unpack_from(">IIHHH", data, at + 46) if len(data) >= at + 60 else (0, 0, 0, 0, 0)
        table = [int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": table}
    return None


def parse(data: bytes) -> Stream:
    """Every frame of the stream. A frame counts if its header is valid and the next frame or the end follows, or if it
    follows a frame and its checksum is right; else the search goes on behind, and skipped counts the bytes passed over. A frame whose checksum is
    wrong counts as audio, but its ancillary bytes are still given, and crc_bad says so. Empty data: an empty stream."""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and len(data) - 128 >= at:
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1"):
                out.tags[key] = value
    first, trusted = True, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h and out.rate and h.rate != out.rate:
            h = None
        if not h or after > end or not (after == end or trusted and checked(data, at, h) or (n := header(data[after : after + 4])) and n.rate == h.rate and n.layer == h.layer):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, trusted = nxt, False
            continue
        trusted = True
        if (ok := checked(data, at, h)) is not None:
            out.crc_good, out.crc_bad = out.crc_good + ok, out.crc_bad + (not ok)
        table = _xing(data, at, h) if first else None
        first, out.rate = False, h.rate
        if table:
            out.vbr = table
        else:
            out.offsets.append(at)
            out.frames += 1
            out.samples += h.samples
            out.bitrates.add(h.bitrate)
            if h.layer == 3:
                out.ancillary.append(data[at + 4 + 2 * h.protected + h.side : after])
        at = after
    out.skipped += max(0, end - at)
    return out


@lru_cache(32)
def _lead(index: int) -> bytes:
    """Header, checksum and empty side information of a stored frame of this bitrate index."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC4))
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


#: Ancillary room of each bitrate index at 48 kHz, where a frame has three bytes for each kbit/s.
ROOM = [3 * b - OVERHEAD for b in BITRATES[1, 3]]


def encode(payload: bytes) -> bytes:
    """A payload as an MPEG audio stream; decode() gives it back."""
    frames = []
    full = ROOM[14]
    for a in range(0, len(payload) - len(payload) % full, full):
        frames.append(_lead(14) + payload[a : a + full])
    rest = payload[len(payload) - len(payload) % full :]
    if rest or not frames:
        index = next(i for i in range(1, 15) if ROOM[i] >= len(rest))
        frames.append(_lead(index) + rest + bytes(ROOM[index] - len(rest)))
    text = b"\x03payload\x00%d" % len(payload)
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\x00\x00" + _syncsafe(len(frame)) + frame
    xing_index = 4  # the least frame that holds the table
    body = b"".join(frames)
    total = len(body) + 3 * BITRATES[1, 3][xing_index]
    ends = [3 * BITRATES[1, 3][xing_index] + i * len(frames[0]) for i in range(len(frames))]
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    xing = _lead(xing_index) + xing + bytes(ROOM[xing_index] - len(xing))
    end = b"TAG" + b"stored text".ljust(30, b"\0") + bytes(94) + b"\xff"
    return tag + xing + body + end


def decode(data: bytes) -> tuple[bytes, Stream]:
    s = parse(data)
    return b"".join(s.ancillary)[: int(s.tags.get("payload", 0))], s


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate long, seek_offsets array<long>"


def store(docs: DataFrame) -> DataFrame:
    """A media column of every whole text (null: empty), padded with zeros to a positive multiple of 64 bytes.

    Each row is stored by itself: repeated rows and rows without an id stay, and an empty table gives none. Columns
    besides doc_id and text are not read.
    """

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                made = [(n, encode(p)) for n, p in map(padded, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array([m for _, m in made], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, STORED)


def features(media: DataFrame) -> DataFrame:
    """Parse each stored stream: what it holds, and its frames, exact duration (samples over rate) and seek offsets."""

    def rows(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for part in common.slices(batch, "media", 4 << 20):
                out = []
                for key, n, data in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                    payload, s = decode(data)
                    text = f"frames={s.frames};samples={s.samples};rate={s.rate};bitrates={'/'.join(map(str, sorted(s.bitrates)))};crc={s.crc_good}:{s.crc_bad};skipped={s.skipped};vbr={(s.vbr or {}).get('frames')}"
                    out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), text, s.samples, s.rate, s.offsets))
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.mapInArrow(rows, READ)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(common.settle(store(common.table(spark, sf_dir, "documents")), "media", "zstd"))

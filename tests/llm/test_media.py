import hashlib
import os
import zlib

import pytest

from accordia.llm import common, media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 936, 937, 938, 5000, 100_000])
def test_round_trip(n):
    for text in ("x" * n, "é" * (n // 2)):
        size, payload = media.padded(text)
        back, s = media.decode(media.encode(payload))
        assert back == payload and len(payload) % 64 == 0 and payload and size <= len(payload)
        assert s.skipped == 0 and s.crc_bad == 0 and s.frames == s.vbr["frames"] and s.samples == 1152 * s.frames and s.duration == (s.samples, 48000)


def test_any_bytes():
    data = os.urandom(20_000) + b"\xff\xfb" * 500
    assert media.decode(media.encode(data))[0] == data


def test_damage():
    data = media.encode(b"abc" * 3000)
    whole = media.parse(data)
    at = whole.offsets[3]
    junk = media.parse(data[:at] + b"\xff\xfajunk\xff" + data[at:])
    assert junk.frames == whole.frames and junk.skipped == 7
    cut = media.parse(data[: whole.offsets[5] + 100] + data[whole.offsets[6] + 50 :])
    assert whole.frames - 2 <= cut.frames < whole.frames and cut.skipped > 0
    bad = bytearray(data)
    bad[whole.offsets[2] + 10] ^= 1
    assert (media.parse(bytes(bad)).crc_bad, whole.crc_bad) == (1, 0)
    for n in range(0, 400, 7):
        media.parse(data[:n])
    media.parse(os.urandom(5000))
    assert media.parse(b"").frames == 0


def test_headers():
    h = media.header(bytes((0xFF, 0xFB, 0x90, 0x64)))
    assert (h.version, h.layer, h.bitrate, h.rate, h.size, h.samples, h.protected, h.mono) == (1, 3, 128, 44100, 417, 1152, False, False)
    assert media.header(bytes((0xFF, 0xF3, 0x40, 0xC0))).size == 72 * 32000 // 22050
    assert media.header(bytes((0xFF, 0xFF, 0x14, 0x00))).size == (12 * 32000 // 48000) * 4
    for raw in (b"\xff\xeb\x90\x64", b"\xff\xf9\x90\x64", b"\xff\xfb\xf0\x64", b"\xff\xfb\x9c\x64", b"\xff\xfb\x90\x66", b"abcd", b"\xff"):
        assert media.header(raw) is None


def test_checksum():
    # the published check value of this polynomial and start over the nine digits
    assert media.crc16(b"123456789") == 0xAEE7


def test_tags():
    s = media.parse(media.encode(b"x" * 64))
    assert s.tags == {"payload": "64", "title": "stored text"} and s.vbr["kind"] == "Xing" and len(s.vbr["toc"]) == 100 and s.vbr["toc"] == sorted(s.vbr["toc"])


def test_query(spark, sf, local):
    got = {r.doc_id: r for r in media.op8_media_columns(spark, sf).collect()}
    assert got.keys() == local.keys()
    for i, d in local.items():
        n, payload = media.padded(d.text)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert all(media.header(stored[o : o + 4]) for o in r.seek_offsets)


def test_odd_rows(odd, empty):
    got = media.features(common.settle(media.store(odd), "m")).collect()
    assert len(got) == odd.count() and sum(r.n_bytes == 0 and r.payload_bytes == 64 for r in got) == 3
    assert len({repr(r) for r in got if r.doc_id == 1}) == 1
    assert media.features(common.settle(media.store(empty), "m")).count() == 0

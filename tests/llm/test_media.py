import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import media


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=20_000))
def test_round_trip(payload):
    made = media.write(payload)
    assert media.read_payload(made) == payload
    seen = media.parse(made)
    assert seen["codec"] == "raw " and seen["duration"] == len(payload) and seen["error"] is None
    assert seen["samples"] == -(-len(payload) // media.SAMPLE_BYTES)
    body = len(made) - len(payload)
    assert [k["start"] - body for k in seen["keyframes"]] == list(range(0, len(payload), media.SAMPLE_BYTES * media.KEY_EVERY))


def test_many_chunks_and_nesting():
    payload = bytes(range(256)) * 1500
    made = media.write(payload)
    paths = [b"/".join(p) for p, _, _ in media.walk(made)]
    assert b"moov/trak/mdia/minf/stbl/stsz" in paths and paths.count(b"mdat") == 1
    assert media.read_payload(made) == payload


def sized(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_other_tables():
    full = bytes(4)
    stbl = sized(b"stbl", sized(b"stsd", full + struct.pack(">I", 1) + sized(b"avc1", bytes(78))) + sized(b"stts", full + struct.pack(">III", 1, 3, 512)) + sized(b"stsc", full + struct.pack(">IIII", 1, 1, 3, 1))
                 + sized(b"stz2", full + bytes([0, 0, 0, 4]) + struct.pack(">I", 3) + bytes([0x12, 0x30])) + sized(b"co64", full + struct.pack(">IQ", 1, 5000)))
    mdhd = sized(b"mdhd", full + struct.pack(">IIIIHH", 0, 0, 12800, 1536, 0, 0))
    trak = sized(b"trak", sized(b"mdia", mdhd + sized(b"minf", stbl)))
    large = struct.pack(">I4sQ", 1, b"moov", len(trak) + 16) + trak
    seen = media.parse(sized(b"ftyp", b"isom" + full) + large + bytes(6000))
    assert (seen["codec"], seen["timescale"], seen["duration"], seen["samples"]) == ("avc1", 12800, 1536, 3)
    assert seen["keyframes"] == [{"start": 5000, "length": 1}, {"start": 5001, "length": 2}, {"start": 5003, "length": 3}]


@pytest.mark.parametrize("broken", [None, b"", b"abc", b"\0\0\0\x04moov", b"\0\0\0\xffmoov", sized(b"moov", b"")])
def test_broken(broken):
    assert media.parse(broken)["error"]


def table_file(stsc, stsz, stco):
    full = bytes(4)
    stbl = sized(b"stbl", sized(b"stsc", full + stsc) + sized(b"stsz", full + stsz) + sized(b"stco", full + stco))
    return sized(b"moov", sized(b"trak", sized(b"mdia", sized(b"minf", stbl)))) + bytes(200)


def test_hostile():
    deep = b""
    for _ in range(1200):
        deep = sized(b"moov", deep)
    one, chunk = struct.pack(">II", 4, 1), struct.pack(">II", 1, 10)
    good = struct.pack(">IIII", 1, 1, 1, 1)
    assert media.parse(table_file(good, one, chunk))["error"] is None
    for broken, why in (
        (deep, "deep"), (table_file(good, struct.pack(">II", 1, 0xFFFFFFFF), chunk), "exceed"), (table_file(struct.pack(">IIII", 1, 0, 1, 1), one, chunk), "order"),
        (table_file(struct.pack(">7I", 2, 2, 1, 1, 1, 1, 1), one, chunk), "order"), (table_file(good, one, struct.pack(">II", 1, 5000)), "outside"),
    ):
        assert why in media.parse(broken)["error"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 255), st.binary(max_size=12))
def test_never_raises(at, byte, tail):
    made = bytearray(media.write(b"abc" * 3000)[:1200] + tail)
    made[at % len(made)] = byte
    media.parse(bytes(made))


def test_columns(spark):
    made = media.write(b"x" * 100)
    df = spark.createDataFrame([(1, bytearray(made), "own"), (2, None, "own")], "id int, content binary, media string")
    got = {r.id: r for r in media.media_columns(df).collect()}
    assert got[1].media.codec == "raw " and got[1].media_input == "own" and got[2].media.error


def test_texts(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 40_000), (5, "a" * 64), (6, "a" * 65)]
    got = {r.doc_id: r for r in media.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        stored = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
    assert got[3].feature == got[5].feature and got[3].media_sha256 == got[5].media_sha256 and got[6].payload_bytes == 128
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []

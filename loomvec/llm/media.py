"""ISO media containers as columns: written, walked and summarised.

``parse`` walks the nested boxes of a container, decodes the sample tables
(stts, stsc, stsz/stz2, stco/co64, stss) and returns codec, duration and the
byte ranges of the keyframes without touching the payload. ``write`` stores
bytes losslessly as 8-bit samples, so that any payload can make the round
trip. Broken containers give a result with ``error`` set and never raise:
boxes nested deeper than ``DEPTH``, tables that claim more than the file
holds, chunk runs out of order and samples outside the file are errors.

Defined cases: a null text counts as empty; an empty text becomes one block of
64 zero bytes; equal texts give equal containers; a null ``doc_id`` is kept;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
BLOCK = 64
RATE = 8000
SAMPLE_BYTES = 4096
SAMPLES_PER_CHUNK = 16
KEY_EVERY = 8
#: Boxes within boxes.
DEPTH = 32

FEATURE_SCHEMA = "codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,length:long>>, error string"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, n_keyframes long"


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags) + body)


def write(payload: bytes) -> bytes:
    """A container with one audio track of unsigned 8-bit samples that holds ``payload``.

    A table entry ("sample") covers up to 4096 bytes, 16 of them a chunk, and
    each eighth is marked as a sync sample.
    """
    n = len(payload)
    sizes = [SAMPLE_BYTES] * (n // SAMPLE_BYTES) + ([n % SAMPLE_BYTES] if n % SAMPLE_BYTES else [])
    count = len(sizes)
    chunks = -(-count // SAMPLES_PER_CHUNK)
    last = count - (chunks - 1) * SAMPLES_PER_CHUNK
    entry = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)
    stsd = _full(b"stsd", struct.pack(">I", 1) + _box(b"raw ", entry))
    runs = [(count - 1, SAMPLE_BYTES)] * (count > 1) + [(1, sizes[-1])]
    stts = _full(b"stts", struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs))
    layout = [(1, SAMPLES_PER_CHUNK if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last != SAMPLES_PER_CHUNK else [])
    stsc = _full(b"stsc", struct.pack(">I", len(layout)) + b"".join(struct.pack(">III", a, b, 1) for a, b in layout))
    stsz = _full(b"stsz", struct.pack(">II", 0, count) + struct.pack(f">{count}I", *sizes))
    keys = range(1, count + 1, KEY_EVERY)
    stss = _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))
    ftyp = _box(b"ftyp", b"qt  " + struct.pack(">I", 0x200) + b"qt  isom")
    wide = n + 8 > 0xFFFFFFF0
    chunk_bytes = SAMPLE_BYTES * SAMPLES_PER_CHUNK

    def moov(first: int) -> bytes:
        code = "Q" if wide else "I"
        offsets = [first + k * chunk_bytes for k in range(chunks)]
        stco = _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{code}", chunks, *offsets))
        stbl = _box(b"stbl", stsd + stts + stsc + stsz + stco + stss)
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)) + dinf + stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", struct.pack(">4s4s12x", b"mhlr", b"soun") + b"\0")
        matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, n, 0, 0, 0x100, 0) + matrix + bytes(8), version=1, flags=7)
        trak = _box(b"trak", tkhd + _box(b"mdia", mdhd + hdlr + minf))
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, n, 0x10000, 0x100) + matrix + bytes(24) + struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd + trak)

    head = len(ftyp) + len(moov(0)) + (16 if wide else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", n + 16) if wide else struct.pack(">I4s", n + 8, b"mdat")
    return ftyp + moov(head) + mdat + payload


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start of the body, end) of every box, nested ones included, in the file's order."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]  # path, place, end
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("cut size of a large box")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} exceeds its parent")
        if len(path) >= DEPTH:
            raise ValueError("boxes are nested too deep")
        yield (*path, kind), start + head, start + size
        open_.append((path, start + size, end))
        if kind in CONTAINERS:
            open_.append(((*path, kind), start + head, start + size))


def _table(data: bytes, at: tuple[int, int], form: str, skip: int = 4) -> list[tuple]:
    begin, end = at
    (n,) = struct.unpack_from(">I", data, begin + skip)
    width = struct.calcsize(">" + form)
    begin += skip + 4
    if begin + n * width > end:
        raise ValueError("a sample table exceeds its box")
    return list(struct.iter_unpack(">" + form, data[begin : begin + n * width]))


def _sizes(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> list[int]:
    if b"stsz" in boxes:
        begin, end = boxes[b"stsz"]
        same, n = struct.unpack_from(">II", data, begin + 4)
        if same * n > len(data):
            raise ValueError("the samples exceed the file")
        if same:
            return [same] * n
        if begin + 12 + 4 * n > end:
            raise ValueError("stsz exceeds its box")
        return list(struct.unpack_from(f">{n}I", data, begin + 12))
    if b"stz2" in boxes:
        begin, end = boxes[b"stz2"]
        bits, n = data[begin + 7], struct.unpack_from(">I", data, begin + 8)[0]
        if bits not in (4, 8, 16) or begin + 12 + (n * bits + 7) // 8 > end:
            raise ValueError("stz2 exceeds its box")
        if bits == 16:
            return list(struct.unpack_from(f">{n}H", data, begin + 12))
        raw = data[begin + 12 : begin + 12 + (n * bits + 7) // 8]
        return list(raw) if bits == 8 else [x for b in raw for x in (b >> 4, b & 15)][:n]
    return []


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, timescale, duration, sample ranges and sync samples."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, begin, end in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (begin, end))
    out = []
    for boxes in found:
        track: dict = {"codec": None, "timescale": 0, "duration": 0}
        if b"stsd" in boxes:
            track["codec"] = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
        if b"mdhd" in boxes:
            at = boxes[b"mdhd"][0]
            track["timescale"], track["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        sizes = _sizes(data, boxes)
        offsets = [x for (x,) in _table(data, boxes[b"co64"], "Q")] if b"co64" in boxes else [x for (x,) in _table(data, boxes[b"stco"], "I")] if b"stco" in boxes else []
        layout = _table(data, boxes[b"stsc"], "III") if b"stsc" in boxes else []
        ranges: list[tuple[int, int]] = []
        if any(a < 1 or a >= b for a, b in zip([x[0] for x in layout], [*[x[0] for x in layout[1:]], 1 << 32], strict=True)):
            raise ValueError("chunk runs are out of order")
        for k, (first, each, _) in enumerate(layout):
            until = layout[k + 1][0] if k + 1 < len(layout) else len(offsets) + 1
            for chunk in range(first, min(until, len(offsets) + 1)):
                at = offsets[chunk - 1]
                for _ in range(min(each, len(sizes) - len(ranges))):
                    ranges.append((at, sizes[len(ranges)]))
                    at += ranges[-1][1]
        if any(a + n > len(data) for a, n in ranges):
            raise ValueError("a sample lies outside the file")
        keys = [x for (x,) in _table(data, boxes[b"stss"], "I")] if b"stss" in boxes else range(1, len(ranges) + 1)
        track |= {"ranges": ranges, "keyframes": [ranges[x - 1] for x in keys if 0 < x <= len(ranges)], "ticks": sum(a * b for a, b in _table(data, boxes[b"stts"], "II")) if b"stts" in boxes else 0}
        out.append(track)
    return out


def parse(data: bytes | None) -> dict:
    """Codec, duration and keyframe byte ranges of the first track."""
    empty = {"codec": None, "timescale": None, "duration": None, "samples": 0, "keyframes": [], "error": None}
    try:
        found = tracks(data or b"")
    except (ValueError, struct.error, IndexError) as why:
        return empty | {"error": str(why)}
    if not found:
        return empty | {"error": "no track"}
    t = found[0]
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["ranges"]), "keyframes": [{"start": a, "length": n} for a, n in t["keyframes"]], "error": None}


def read_payload(data: bytes) -> bytes:
    """All samples of the first track, in order."""
    ranges = tracks(data)[0]["ranges"]
    merged: list[list[int]] = []
    for start, n in ranges:
        if merged and merged[-1][1] == start:
            merged[-1][1] = start + n
        else:
            merged.append([start, start + n])
    return b"".join(data[a:b] for a, b in merged)


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with a ``media`` struct: what ``parse`` finds in its binary column."""
    names = df.columns
    if "media" in names:
        df = df.withColumnRenamed("media", "media_input")
        names = df.columns
    where = names.index(content)
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("media", T._parse_datatype_string(FEATURE_SCHEMA))])
    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())])

    def run(batches):
        for records in batches:
            found = pa.array([parse(x.as_py()) for x in records.column(where)], kind)
            yield pa.RecordBatch.from_arrays([*records.columns, found], names=[*names, "media"])

    return df.mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text stored in a container and read back; digests of both and the features."""

    def one(doc, text):
        raw = (text or "").encode()
        size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
        media = write(raw.ljust(size, b"\0"))
        back, seen = read_payload(media), parse(media)
        ranges = ",".join(f"{k['start']}+{k['length']}" for k in seen["keyframes"])
        seconds = seen["duration"] / seen["timescale"]
        feature = f"{seen['codec']}:{seen['timescale']}:{seen['duration']}:{seen['samples']}:{len(seen['keyframes'])}:{hashlib.md5(ranges.encode()).hexdigest()}"
        return doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, seen["codec"], seconds, seen["samples"], len(seen["keyframes"])

    fields = [x.split() for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        for records in batches:
            rows = [one(doc, text.as_py()) for doc, text in zip(records.column(0).to_pylist(), records.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)

"""ISO base media files: a writer, a box walker and sample-table decoder.

A payload becomes the samples of one audio track (8-bit PCM, 192 bytes a
sample, 16 samples a chunk); an edit list gives the time, a unit for each byte,
that the unpadded payload takes. The reader walks nested boxes and decodes each
track by itself: sample tables (stsz, stsc, stco/co64, stts, stss) and the runs
of movie fragments (tfhd, trun, with the defaults of trex) become byte ranges,
and codec, duration and keyframe byte ranges are reported. Every sample of a
track without stss is a keyframe. Sample payloads are never decoded.

Defined results: null and empty texts store one sample of 192 spaces; equal
texts give equal files; repeated rows give repeated results; extra columns are
ignored. A damaged file raises ``ValueError``, whatever its tables claim.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows

SAMPLE = 192
PER_CHUNK = 16
TIMESCALE = 8000
#: Boxes whose payload is other boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"udta", b"edts", b"mvex", b"moof", b"traf"))
#: Boxes within boxes; files nest about ten.
MAX_DEPTH = 64


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // SAMPLE)) * SAMPLE
    return data.ljust(n, b"\x20")


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write(data: bytes) -> bytes:
    """A media file whose samples are ``data`` padded with spaces; its edit list plays the unpadded part."""
    payload = padded(data)
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    duration = n * SAMPLE  # one unit of time for each byte
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = [first + i * PER_CHUNK * SAMPLE for i in range(chunks)]
        runs = [(1, min(n, PER_CHUNK), 1)] + ([(chunks, n - (chunks - 1) * PER_CHUNK, 1)] if chunks > 1 and n % PER_CHUNK else [])
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"text\x00")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        elst = _full(b"elst", struct.pack(">IQqHH", 1, len(data), 0, 1, 0), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"edts", elst), _box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))
    if len(ftyp) + size + head + len(payload) >= 1 << 32:
        size = len(moov(1 << 32))
    return ftyp + moov(len(ftyp) + size + head) + _box(b"mdat", payload)


def walk(data: bytes | memoryview):
    """(path, first byte of the box, first byte of its body, byte after it) of every box, parents first.

    Boxes nested deeper than ``MAX_DEPTH`` are damage.
    """
    at, open_boxes = 0, [((), len(data))]  # paths and ends
    while open_boxes:
        path, end = open_boxes[-1]
        if at == end:
            open_boxes.pop()
            continue
        if end - at < 8:
            raise ValueError(f"a box header at byte {at} is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - body < 8:
                raise ValueError(f"a box header at byte {at} is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"the box {kind!r} at byte {at} has a wrong size")
        yield (*path, kind), at, body, stop
        if kind in CONTAINERS:
            if len(open_boxes) > MAX_DEPTH:
                raise ValueError(f"the box {kind!r} at byte {at} is nested too deep")
            open_boxes.append(((*path, kind), stop))
            at = body
        else:
            at = stop


def _ints(data, at: int, end: int, fmt: str) -> tuple:
    """Unpack ``fmt`` at ``at``, which must lie before ``end``."""
    if at + struct.calcsize(fmt) > end:
        raise ValueError("a box is shorter than its fields")
    return struct.unpack_from(fmt, data, at)


def _table(data, span: tuple[int, int], fmt: str) -> list[tuple]:
    """The rows of a full box that counts them."""
    at, end = span
    (n,) = _ints(data, at + 4, end, ">I")
    size = struct.calcsize(fmt)
    if at + 8 + n * size > end:
        raise ValueError("a table is longer than its box")
    return list(struct.iter_unpack(fmt, bytes(data[at + 8 : at + 8 + n * size])))


class _Track:
    def __init__(self):
        self.boxes: dict[bytes, tuple[int, int]] = {}


def _need(boxes: dict, kind: bytes) -> tuple[int, int]:
    if kind not in boxes:
        raise ValueError(f"no box {kind!r}")
    return boxes[kind]


def _sizes(data, span: tuple[int, int]) -> list[int] | range:
    a, b = span
    each, n = _ints(data, a + 4, b, ">II")
    if each:
        if n * each > len(data):
            raise ValueError("the samples are longer than the file")
        return [each] * n
    if a + 12 + 4 * n > b:
        raise ValueError("a table is longer than its box")
    return [x for (x,) in struct.iter_unpack(">I", bytes(data[a + 12 : a + 12 + 4 * n]))]


def _described(data, boxes: dict) -> dict:
    """A track of the movie box: what it is, and the samples of its tables."""
    a, b = _need(boxes, b"mdhd")
    wide = b > a and data[a] == 1
    scale, duration = _ints(data, a + 20, b, ">IQ") if wide else _ints(data, a + 12, b, ">II")
    a, b = _need(boxes, b"tkhd")
    (ident,) = _ints(data, a + (20 if b > a and data[a] == 1 else 12), b, ">I")
    a, b = _need(boxes, b"stsd")
    codec = struct.pack(">I", *_ints(data, a + 12, b, ">I")).decode("latin-1").strip()
    if not scale:
        raise ValueError("the time scale is 0")
    sizes = _sizes(data, _need(boxes, b"stsz"))
    offsets = [x for (x,) in (_table(data, boxes[b"co64"], ">Q") if b"co64" in boxes else _table(data, _need(boxes, b"stco"), ">I"))]
    runs = _table(data, _need(boxes, b"stsc"), ">III")
    samples, k = [], 0
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        if not 1 <= first <= last <= len(offsets) + 1 or (last - first) * per > len(sizes) - k:
            raise ValueError("the sample tables disagree")
        for chunk in range(first, last):
            at = offsets[chunk - 1]
            for _ in range(per):
                samples.append((at, at + sizes[k]))
                at += sizes[k]
                k += 1
    times = _table(data, _need(boxes, b"stts"), ">II")
    if k != len(sizes) or sum(c for c, _ in times) != k or any(b > len(data) for _, b in samples):
        raise ValueError("the sample tables disagree")
    keys = [x for (x,) in _table(data, boxes[b"stss"], ">I")] if b"stss" in boxes else range(1, k + 1)
    if any(not 1 <= x <= k for x in keys):
        raise ValueError("a keyframe is no sample")
    played = None
    if b"elst" in boxes:
        span = boxes[b"elst"]
        played = sum(x for x, *_ in _table(data, span, ">QqHH" if data[span[0]] == 1 else ">IiHH"))
    return {"id": ident, "codec": codec, "timescale": scale, "duration": duration, "sample_time": sum(c * d for c, d in times), "played": played, "samples": samples, "keyframes": [samples[i - 1] for i in keys]}


_NOT_SYNC = 0x10000


def _run(data, span: tuple[int, int], base: int, given: tuple[int, int, int], track: dict) -> int:
    """Add the samples of a fragment's run (trun) to its track; the byte after the last."""
    a, b = span
    word, n = _ints(data, a, b, ">II")
    flags, at = word & 0xFFFFFF, a + 8
    if flags & 1:
        base += _ints(data, at, b, ">i")[0]
        at += 4
    first = None
    if flags & 4:
        (first,) = _ints(data, at, b, ">I")
        at += 4
    fields = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
    if at + 4 * len(fields) * n > b or (not fields and n * max(1, given[1]) > len(data)):
        raise ValueError("a run is longer than its box")
    for i in range(n):
        own = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, at), strict=True))
        at += 4 * len(fields)
        size = own.get(0x200, given[1])
        if base < 0 or base + size > len(data):
            raise ValueError("a run lies outside the file")
        track["samples"].append((base, base + size))
        if not (first if first is not None and not i else own.get(0x400, given[2])) & _NOT_SYNC:
            track["keyframes"].append((base, base + size))
        track["sample_time"] += own.get(0x100, given[0])
        base += size
    return base


def tracks(data: bytes) -> list[dict]:
    """The tracks of a file: id, codec, time scale, duration, sample byte ranges and keyframe byte ranges."""
    found: list[_Track] = []
    fragments: list[tuple[int, list[dict]]] = []  # (start of the moof, its trafs)
    extends = []
    for path, begun, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(_Track())
        elif b"trak" in path and found:
            found[-1].boxes.setdefault(kind, (a, b))
        elif kind == b"trex":
            extends.append(_ints(data, a + 4, b, ">IIIII"))
        elif kind == b"moof":
            fragments.append((begun, []))
        elif kind == b"traf":
            fragments[-1][1].append({"runs": []})
        elif path[-2:-1] == (b"traf",) and kind == b"tfhd":
            fragments[-1][1][-1]["head"] = (a, b)
        elif path[-2:-1] == (b"traf",) and kind == b"trun":
            fragments[-1][1][-1]["runs"].append((a, b))
    out = [_described(data, t.boxes) for t in found]
    if not out:
        raise ValueError("no track")
    of, usual = {t["id"]: t for t in out}, {t: (d, s, f) for t, _, d, s, f in extends}
    for start, parts in fragments:
        end = start
        for part in parts:
            if "head" not in part:
                raise ValueError("a track's fragment has no header")
            a, b = part["head"]
            word, ident = _ints(data, a, b, ">II")
            if ident not in of:
                raise ValueError("a fragment of no track")
            at, base = a + 8, start if word & 0x20000 or end == start else end
            if word & 1:
                (base,) = _ints(data, at, b, ">Q")
            at += 8 * (word & 1) + 4 * bool(word & 2)
            given = list(usual.get(ident, (0, 0, 0)))
            for i, flag in enumerate((0x8, 0x10, 0x20)):
                if word & flag:
                    (given[i],) = _ints(data, at, b, ">I")
                    at += 4
            end = base
            for run in part["runs"]:
                end = _run(data, run, base if _ints(data, *run, ">I")[0] & 1 else end, tuple(given), of[ident])
    return out


def read(data: bytes) -> dict:
    """The first track; see ``tracks``."""
    return tracks(data)[0]


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<start:long,end:long>>"


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a media file, read the file back, and describe it."""
    kind = df.schema[key].dataType.simpleString()

    def describe(t: str | None) -> tuple:
        stored = write((t or "").encode("utf-8", "surrogatepass"))
        m = read(stored)
        back = b"".join(stored[a:b] for a, b in m["samples"])
        keys = m["keyframes"]
        marks = zlib.crc32(b"".join(struct.pack(">QQ", *k) for k in keys))
        feature = f"{m['codec']}|{m['timescale']}|{m['duration']}|{len(m['samples'])}|{len(keys)}|{keys[0][0]}-{keys[0][1]}|{marks:08x}"
        return (m["played"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, m["codec"], m["duration"] / m["timescale"], [{"start": a, "end": b} for a, b in keys])

    def make():
        def f(cols):
            rows = [describe(t) for t in cols[1]]
            return [cols[0], *(map(list, zip(*rows, strict=True)) if rows else [[] for _ in range(10)])]

        return f

    return map_rows(df.select(F.col(key), F.col(text)), f"{key} {kind}, {SCHEMA}", make)

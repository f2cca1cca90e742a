"""Media columns: Matroska files become packet tables.

The parser walks the EBML elements (variable-length identifiers and sizes, unknown sizes for segments and
clusters), reads time scale, tracks, clusters and cues, and takes apart simple blocks and block groups with any
lacing (Xiph, EBML, fixed). It reads headers only: a packet is given by its byte range, never by a copy of its bytes.

Info, tracks and cues hold for their whole segment, wherever in it they stand.

Defined results: null media give no rows; empty, truncated or foreign bytes, and numbers of more than 8 bytes, give what
could be read before the fault and no error; a time, duration or byte offset that 64 bits can't hold is null; packets
of tracks without an entry have null codec and type; times are nanoseconds; very long files are read whole; repeated
rows are parsed again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, NUMBER, TYPE, CODEC, DEFAULT = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))
_TYPES = {1: "video", 2: "audio", 3: "complex", 16: "logo", 17: "subtitle", 18: "buttons", 32: "control", 33: "metadata"}


class Fault(ValueError):
    """The bytes end or make no sense."""


def vint(b: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int, int]:
    """(value, bytes, value of all ones) of the variable-length integer at ``at``; with ``marker`` its marker bit stays."""
    if at >= end:
        raise Fault("end")
    first = b[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > end:
        raise Fault("size")
    v = int.from_bytes(b[at : at + n], "big")
    return (v if marker else v & ((1 << 7 * n) - 1)), n, (1 << 7 * n) - 1


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, data start, data end) of the elements in a range; an unknown size ends at the parent's end."""
    while at < end:
        start = at
        ident, n, _ = vint(b, at, end, True)
        at += n
        if n > 4:
            raise Fault("id")
        size, n, ones = vint(b, at, end)
        at += n
        stop = end if size == ones else at + size
        yield ident, start, at, -1 if size == ones else stop
        if size == ones:
            return
        at = stop


def children(b: bytes, s: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(id, data start, data end) of elements that must lie within a range whole."""
    for ident, _, x, y in elements(b, s, e):
        if y < 0 or y > e:
            raise Fault("truncated")
        yield ident, x, y


def _uint(b: bytes, s: int, e: int) -> int:
    if e - s > 8:
        raise Fault("number")
    return int.from_bytes(b[s:e], "big")


def _long(n: int | None) -> int | None:
    """The number if 64 bits with a sign can hold it."""
    return n if n is not None and -(2**63) <= n < 2**63 else None


def _float(b: bytes, s: int, e: int) -> float:
    return struct.unpack(">f" if e - s == 4 else ">d", b[s:e])[0] if e - s in (4, 8) else 0.0


@dataclass(slots=True)
class Packet:
    """``time`` and ``duration`` in units of the scale until the segment ends, then in nanoseconds."""

    track: int
    time: int | None
    duration: int | None
    key: bool
    lacing: int
    index: int
    frames: int
    start: int
    end: int
    cluster: int
    kind: str | None = None
    codec: str | None = None
    cue: bool = False


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    #: time in units of the scale, track, cluster's offset in the segment
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    fault: str | None = None


def lace(b: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose payload is at ``at``; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end)]
    if at >= end:
        raise Fault("lace")
    n = b[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            s = 0
            while True:
                if at >= end:
                    raise Fault("lace")
                s += b[at]
                at += 1
                if b[at - 1] != 255:
                    break
            sizes.append(s)
    elif kind == 3 and n > 1:
        s, w, _ = vint(b, at, end)
        at += w
        sizes.append(s)
        for _ in range(n - 2):
            d, w, ones = vint(b, at, end)
            at += w
            sizes.append(sizes[-1] + d - (ones >> 1))
    if kind == 2:
        each, rest = divmod(end - at, n)
        if rest:
            raise Fault("lace")
        sizes = [each] * n
    else:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Fault("lace")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def _block(m: Media, b: bytes, s: int, e: int, cluster: tuple[int, int], simple: bool, duration: int | None, key: bool) -> None:
    track, n, _ = vint(b, s, e)
    if s + n + 3 > e:
        raise Fault("block")
    rel = int.from_bytes(b[s + n : s + n + 2], "big", signed=True)
    flags = b[s + n + 2]
    kind = flags >> 1 & 3
    if simple:
        key = bool(flags & 0x80)
    frames = lace(b, s + n + 3, e, kind)
    for i, (fs, fe) in enumerate(frames):
        m.packets.append(Packet(track, cluster[0] + rel, duration, key, kind, i, len(frames), fs, fe, cluster[1]))


def _cluster(m: Media, b: bytes, s: int, e: int, offset: int, unknown: bool) -> int:
    """Read a cluster; the end of its data, which for an unknown size is where the next top element begins."""
    time = 0
    for ident, es, ds, de in elements(b, s, e):
        if unknown and ident in _TOP:
            return es
        if de > e or de < 0:
            raise Fault("truncated")
        if ident == TIME:
            time = _uint(b, ds, de)
        elif ident == SIMPLE:
            _block(m, b, ds, de, (time, offset), True, None, False)
        elif ident == GROUP:
            block, duration, key = None, None, True
            for i2, s2, e2 in children(b, ds, de):
                if i2 == BLOCK:
                    block = (s2, e2)
                elif i2 == BLOCK_DURATION:
                    duration = _uint(b, s2, e2)
                elif i2 == REFERENCE:
                    key = False
            if block:
                _block(m, b, *block, (time, offset), False, duration, key)
    return e


def parse(b: bytes) -> Media:
    """All tracks, packets and cues of a file, up to the first fault."""
    m = Media()
    try:
        for ident, _, s, e in elements(b, 0, len(b)):
            if ident == SEGMENT:
                first = len(m.packets)
                m.scale, m.tracks, m.cues = 1_000_000, {}, []
                try:
                    _segment(m, b, s, min(e, len(b)) if e >= 0 else len(b))
                finally:
                    _settle(m, first)
                if e > len(b):
                    raise Fault("truncated")
    except Fault as f:
        m.fault = str(f)
    return m


def _settle(m: Media, first: int) -> None:
    """Give a segment's packets their times, and what its tracks and cues say of them."""
    cues = set(m.cues)
    for p in m.packets[first:]:
        t = m.tracks.get(p.track, {})
        p.kind, p.codec, p.cue = t.get("type"), t.get("codec"), p.index == 0 and (p.time, p.track, p.cluster) in cues
        # frames of a lace follow each other by the track's default duration, or share the block's duration
        each = t.get("default") if p.duration is None else p.duration * m.scale // p.frames
        p.time, p.duration = _long(p.time * m.scale + p.index * (each or 0)), _long(each)


def _segment(m: Media, b: bytes, s: int, e: int) -> None:
    at = s
    while at < e:
        ident, es, ds, de = next(elements(b, at, e))
        unknown = de < 0
        stop = min(de, e) if not unknown else e
        if ident == CLUSTER:
            stop = _cluster(m, b, ds, stop, es - s, unknown)
        elif not unknown and de > e:
            raise Fault("truncated")
        elif ident == INFO:
            for i, x, y in children(b, ds, stop):
                if i == SCALE:
                    m.scale = _uint(b, x, y) or 1_000_000
                elif i == DURATION:
                    m.duration = _float(b, x, y)
        elif ident == TRACKS:
            for i, x, y in children(b, ds, stop):
                if i == ENTRY:
                    t: dict = {}
                    for i2, x2, y2 in children(b, x, y):
                        if i2 == NUMBER:
                            t["number"] = _uint(b, x2, y2)
                        elif i2 == TYPE:
                            t["type"] = _TYPES.get(_uint(b, x2, y2), "other")
                        elif i2 == CODEC:
                            t["codec"] = b[x2:y2].rstrip(b"\0").decode("ascii", "replace")
                        elif i2 == DEFAULT:
                            t["default"] = _uint(b, x2, y2)
                    m.tracks[t.get("number", 0)] = t
        elif ident == CUES:
            for i, x, y in children(b, ds, stop):
                if i == POINT:
                    time = 0
                    for i2, x2, y2 in children(b, x, y):
                        if i2 == CUE_TIME:
                            time = _uint(b, x2, y2)
                        elif i2 == POSITIONS:
                            got = {i3: _uint(b, x3, y3) for i3, x3, y3 in children(b, x2, y2) if i3 in (CUE_TRACK, CUE_CLUSTER)}
                            m.cues.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
        if not unknown and de > e:
            raise Fault("truncated")
        at = stop


_LACING = ("none", "xiph", "fixed", "ebml")
SCHEMA = "doc_id long, track long, track_type string, codec string, packet int, timestamp_ns long, duration_ns long, keyframe boolean, lacing string, lace_index int, byte_start long, byte_end long, cue boolean"


def _arrow_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("track_type", pa.string()), ("codec", pa.string()), ("packet", pa.int32()), ("timestamp_ns", pa.int64()), ("duration_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("lace_index", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("cue", pa.bool_())])


def rows_of(ident: int | None, b: bytes) -> list[tuple]:
    """The packet table's rows for one file."""
    return [(ident, p.track, p.kind, p.codec, i, p.time, p.duration, p.key, _LACING[p.lacing], p.index, p.start, p.end, p.cue) for i, p in enumerate(parse(b).packets)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    for b in batches:
        rows: list[tuple] = []
        for ident, media in zip(b.column(0).to_pylist(), b.column(1)):
            if media.is_valid:
                rows += rows_of(ident, media.as_py())
            if len(rows) > 50_000:
                yield batch(rows)
                rows = []
        yield batch(rows)


def packets(media: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """The packet table of all files: one row per packet, with track, time, byte range and whether a cue points to it."""
    return media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{data_col}`").cast("binary").alias("b")).mapInArrow(_run, SCHEMA)


# --------------------------------------------------------------------------- writing


def _size(n: int) -> bytes:
    w = 1
    while n >= (1 << 7 * w) - 1:
        w += 1
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, data: bytes, unknown: bool = False) -> bytes:
    head = ident.to_bytes((ident.bit_length() + 7) // 8, "big")
    return head + (b"\xff" if unknown else _size(len(data))) + data


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The payload of a block with these frames."""
    if kind == 0:
        return frames[0]
    out = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3 and len(frames) > 1:
        out += _size(len(frames[0]))
        for a, f in zip(frames, frames[1:-1]):
            d = len(f) - len(a)
            w = 1
            while abs(d) >= (1 << 7 * w - 1) - 1:
                w += 1
            out += (d + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")
    return out + b"".join(frames)


def block(track: int, rel: int, frames: list[bytes], kind: int, key: bool = True) -> bytes:
    return _size(track) + rel.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | kind << 1]) + laced(frames, kind)


def timed_text(text: str, per_cluster: int = 32, step: int = 1000) -> bytes:
    """A file with the lines of a text as subtitle packets: track 1 has all lines, up to four in a block with changing
    lacing; track 2 has each cluster's first word in a block group with a duration. The first cluster of each
    track is in the cues."""
    lines = [x.encode() for x in text.split("\n")]
    head = element(EBML, number(0x4286, 1) + element(0x4282, b"matroska"))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(lines) * step))))
    entry = lambda n, codec, more=b"": element(ENTRY, number(NUMBER, n) + number(0x73C5, n) + number(TYPE, 17) + element(CODEC, codec) + more)
    tracks = element(TRACKS, entry(1, b"S_TEXT/UTF8", number(DEFAULT, step * 1_000_000)) + entry(2, b"S_TEXT/WEBVTT"))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, len(lines), per_cluster):
        parts = [number(TIME, c * step)]
        part = lines[c : c + per_cluster]
        i = k = 0
        while i < len(part):
            kind = k % 4
            group = part[i : i + (4 if kind else 1)]
            if kind == 2 and len({len(f) for f in group}) > 1:
                kind, group = 0, group[:1]
            parts.append(element(SIMPLE, block(1, i * step, group, kind, i == 0)))
            i, k = i + len(group), k + 1
        word = part[0].split(b" ", 1)[0]
        parts.append(element(GROUP, element(BLOCK, block(2, 0, [word], 0, False)) + number(BLOCK_DURATION, step) + (b"" if c == 0 else element(REFERENCE, b"\xff"))))
        cluster = element(CLUSTER, b"".join(parts))
        for track in (1, 2):
            cues.append(element(POINT, number(CUE_TIME, c * step) + element(POSITIONS, number(CUE_TRACK, track) + number(CUE_CLUSTER, at))))
        at += len(cluster)
        body.append(cluster)
    body.append(element(0xEC, b"\0" * 3))
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _mux(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else timed_text(t) for t in texts.to_pylist()], pa.binary())


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every document as a timed-text file, for lack of a table of media."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.arrow_udf(_mux, "binary")(F.col(f"`{text_col}`").cast("string")).alias("media"))

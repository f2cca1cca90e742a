"""Strings of a compiled resource table: string pools, packages, type specs and configurations."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POOL, TABLE, PACKAGE, TYPE = 0x0001, 0x0002, 0x0200, 0x0201
STRING, REFERENCE = 0x03, 0x01
STRINGS = "array<struct<key:string,value:string,locale:string>>"


def _length8(b: bytes, at: int) -> tuple[int, int]:
    return ((b[at] & 0x7F) << 8 | b[at + 1], at + 2) if b[at] & 0x80 else (b[at], at + 1)


def _length16(b: bytes, at: int) -> tuple[int, int]:
    (n,) = struct.unpack_from("<H", b, at)
    if n & 0x8000:
        return (n & 0x7FFF) << 16 | struct.unpack_from("<H", b, at + 2)[0], at + 4
    return n, at + 2


def string_pool(b: bytes, at: int) -> list[str]:
    """The strings of the pool chunk at ``at``, UTF-8 or UTF-16."""
    count, _, flags, start = struct.unpack_from("<4I", b, at + 8)
    (head,) = struct.unpack_from("<H", b, at + 2)
    out = []
    for i in range(count):
        p = at + start + struct.unpack_from("<I", b, at + head + 4 * i)[0]
        if flags & 0x100:
            _, p = _length8(b, p)
            n, p = _length8(b, p)
            out.append(b[p : p + n].decode("utf-8", "replace"))
        else:
            n, p = _length16(b, p)
            out.append(b[p : p + 2 * n].decode("utf-16-le", "replace"))
    return out


def unpack_code(two: bytes, base: str) -> str:
    """A language or region: two letters, or three packed in five bits each."""
    if two == b"\0\0":
        return ""
    if two[0] & 0x80:
        a, b = two
        return "".join(chr(ord(base) + x) for x in (b & 0x1F, (b >> 5) + ((a & 3) << 3), a >> 2 & 0x1F))
    return two.decode("ascii", "replace")


def qualifiers(config: bytes) -> str:
    """The qualifier string of a configuration, in the platform's order."""
    c = config.ljust(64, b"\0")
    mcc, mnc = struct.unpack_from("<HH", c, 4)
    out = f"-mcc{mcc:03d}" if mcc else ""
    if mcc and mnc:
        out += "-mnc00" if mnc == 0xFFFF else f"-mnc{mnc:02d}"
    lang, region = unpack_code(c[8:10], "a"), unpack_code(c[10:12], "0")
    script, variant = c[36:40].rstrip(b"\0").decode("ascii", "replace"), c[40:48].rstrip(b"\0").decode("ascii", "replace")
    if script or variant:
        out += "-b+" + "+".join(x for x in (lang, script, region, variant) if x)
    elif lang:
        out += f"-{lang}" + (f"-r{region}" if region else "")
    orientation, touch = c[12], c[13]
    (density,) = struct.unpack_from("<H", c, 14)
    keyboard, navigation, flags = c[16], c[17], c[18]
    width, height, sdk, minor = struct.unpack_from("<4H", c, 20)
    layout, mode = c[28], c[29]
    (smallest,) = struct.unpack_from("<H", c, 30)
    dp_w, dp_h = struct.unpack_from("<HH", c, 32)
    layout2, colour = c[48], c[49]
    pick = lambda v, names: "".join(f"-{n}" for k, n in names.items() if k == v)
    out += pick(layout & 0xC0, {0x40: "ldltr", 0x80: "ldrtl"})
    out += f"-sw{smallest}dp" if smallest else ""
    out += f"-w{dp_w}dp" if dp_w else ""
    out += f"-h{dp_h}dp" if dp_h else ""
    out += pick(layout & 0x0F, {1: "small", 2: "normal", 3: "large", 4: "xlarge"})
    out += pick(layout & 0x30, {0x10: "notlong", 0x20: "long"})
    out += pick(layout2 & 3, {1: "notround", 2: "round"})
    out += pick(colour & 3, {1: "nowidecg", 2: "widecg"})
    out += pick(colour & 0xC, {4: "lowdr", 8: "highdr"})
    out += pick(orientation, {1: "port", 2: "land", 3: "square"})
    out += pick(mode & 0x0F, {2: "desk", 3: "car", 4: "television", 5: "appliance", 6: "watch", 7: "vrheadset"})
    out += pick(mode & 0x30, {0x10: "notnight", 0x20: "night"})
    if density:
        out += {120: "-ldpi", 160: "-mdpi", 213: "-tvdpi", 240: "-hdpi", 320: "-xhdpi", 480: "-xxhdpi", 640: "-xxxhdpi", 0xFFFE: "-anydpi", 0xFFFF: "-nodpi"}.get(density, f"-{density}dpi")
    out += pick(touch, {1: "notouch", 2: "stylus", 3: "finger"})
    out += pick(flags & 3, {1: "keysexposed", 2: "keyshidden", 3: "keyssoft"})
    out += pick(keyboard, {1: "nokeys", 2: "qwerty", 3: "12key"})
    out += pick(flags & 0xC, {4: "navexposed", 8: "navhidden"})
    out += pick(navigation, {1: "nonav", 2: "dpad", 3: "trackball", 4: "wheel"})
    if width and height:
        out += f"-{max(width, height)}x{min(width, height)}"
    if sdk:
        out += f"-v{sdk}" + (f".{minor}" if minor else "")
    return out


def strings(b: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, value, qualifiers) of all simple string resources of a table."""
    if len(b) < 12 or struct.unpack_from("<H", b, 0)[0] != TABLE:
        return
    pool: list[str] = []
    at = struct.unpack_from("<H", b, 2)[0]
    while at + 8 <= len(b):
        kind, head, size = struct.unpack_from("<HHI", b, at)
        if size < 8:
            return
        if kind == POOL and not pool:
            pool = string_pool(b, at)
        elif kind == PACKAGE:
            yield from _package(b, at, head, min(at + size, len(b)), pool)
        at += size


def _package(b: bytes, at: int, head: int, end: int, pool: list[str]) -> Iterator[tuple[str, str, str]]:
    type_at, _, key_at = struct.unpack_from("<3I", b, at + 268)
    types, keys = string_pool(b, at + type_at), string_pool(b, at + key_at)
    p = at + head
    while p + 8 <= end:
        kind, h, size = struct.unpack_from("<HHI", b, p)
        if size < 8:
            return
        if kind == TYPE and types[b[p + 8] - 1].lower() == "string":
            sparse = b[p + 9] & 1
            count, start = struct.unpack_from("<II", b, p + 12)
            (n,) = struct.unpack_from("<I", b, p + 20)
            config = b[p + 20 : p + 20 + n]
            locale = qualifiers(config)
            for i in range(count):
                (o,) = struct.unpack_from("<I", b, p + h + 4 * i)
                if not sparse and o == 0xFFFFFFFF:
                    continue
                e = p + start + ((o >> 16) * 4 if sparse else o)
                _, flags, key = struct.unpack_from("<HHI", b, e)
                if flags & 1:  # a bag
                    continue
                data_type = b[e + 11]
                (data,) = struct.unpack_from("<I", b, e + 12)
                if data_type == STRING and data < len(pool):
                    yield keys[key], pool[data], locale
                elif data_type == REFERENCE:
                    yield keys[key], f"@{data:08x}", locale
        p += size


def _all(tables: pa.Array) -> pa.Array:
    out = []
    for x in tables.to_pylist():
        try:
            out.append(None if x is None else [{"key": k, "value": v, "locale": q} for k, v, q in strings(x)])
        except (struct.error, IndexError):
            out.append(None)
    return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("locale", pa.string())])))


def resource_strings(table: Column) -> Column:
    """The string resources of a compiled table, null where the bytes are none."""
    return F.arrow_udf(_all, STRINGS)(table)


def styled(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A pooled string with its style spans (tag with ``;name=value`` attributes, first and last character) as markup."""
    from html import escape

    opens: dict[int, list[tuple[int, str]]] = {}
    for tag, first, last in spans:
        opens.setdefault(first, []).append((last, tag))
    out, stack = [], []
    for i, c in enumerate(text):
        for last, tag in sorted(opens.get(i, []), key=lambda x: -x[0]):
            name, *attrs = tag.split(";")
            out.append(f"<{name}" + "".join(f' {k}="{escape(v)}"' for k, _, v in (a.partition("=") for a in attrs)) + ">")
            stack.append((last, name))
        out.append(escape(c, quote=False))
        while stack and stack[-1][0] <= i:
            out.append(f"</{stack.pop()[1]}>")
    out.extend(f"</{name}>" for _, name in reversed(stack))
    return "".join(out)


def string_styles(b: bytes, at: int) -> list[list[tuple[str, int, int]]]:
    """The style spans of the pool chunk at ``at``, for each of its styled strings."""
    count, styles, _, _, start = struct.unpack_from("<5I", b, at + 8)
    (head,) = struct.unpack_from("<H", b, at + 2)
    names, out = string_pool(b, at), []
    for i in range(styles):
        p = at + start + struct.unpack_from("<I", b, at + head + 4 * (count + i))[0]
        spans = []
        while struct.unpack_from("<I", b, p)[0] != 0xFFFFFFFF:
            name, first, last = struct.unpack_from("<3I", b, p)
            spans.append((names[name], first, last))
            p += 12
        out.append(spans)
    return out


#: The record of a signature check; certificates' times are milliseconds made timestamps.
SIGNATURE = "struct<verified:boolean,certs:array<struct<subject:string,issuer:string,not_after:timestamp,not_before:timestamp,algorithm:string,format:string,key:binary>>,warnings:array<string>,errors:array<string>>"
#: The record of a class in a code model.
CODE_CLASS = "struct<name:string,super:string,interfaces:array<string>,access:array<string>,source:string,annotations:array<struct<type:string,visibility:string,elements:map<string,string>>>,fields:array<struct<name:string,type:string,access:array<string>>>,methods:array<struct<name:string,parameters:array<string>,returns:string,access:array<string>,hash:int>>>"

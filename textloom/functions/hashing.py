"""64-bit string hashes, their unsigned order, pair keys and z-order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 0xDEADBEEF
_M = np.uint64(0xC6A4A7935BD1E995)
_R = np.uint64(47)
LONG = 64


def murmur64a_bytes(values: np.ndarray, offsets: np.ndarray, seed: int = SEED) -> np.ndarray:
    """MurmurHash64A of byte strings that follow each other."""
    return murmur64a_spans(values, offsets[:-1], np.diff(offsets), seed)


def murmur64a_spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """MurmurHash64A of many byte ranges at once: block by block over all ranges that are long enough, and range by range over those
    of more than ``LONG`` blocks, so that a few long ones don't take a pass each for every block."""
    size = sizes.astype(np.int64)
    order = np.argsort(-size, kind="stable")
    n, start = size[order], starts[order].astype(np.int64)
    h = np.uint64(seed) ^ (n.astype(np.uint64) * _M)
    padded = np.concatenate([values, np.zeros(8, np.uint8)])
    eight = np.arange(8)
    blocks = n // 8
    long, left = int(np.searchsorted(-blocks, -LONG)), len(n)
    for i in range(long):
        k = values[start[i] : start[i] + 8 * blocks[i]].copy().view("<u8") * _M
        k = (k ^ (k >> _R)) * _M
        x = int(h[i])
        for y in k.tolist():
            x = (x ^ y) * 0xC6A4A7935BD1E995 & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    for j in range(int(blocks[long]) if long < len(n) else 0):
        while left > long and blocks[left - 1] <= j:
            left -= 1
        k = padded[(start[long:left] + 8 * j)[:, None] + eight].view("<u8").ravel() * _M
        k = (k ^ (k >> _R)) * _M
        h[long:left] = (h[long:left] ^ k) * _M
    rest = n % 8
    if rest.any():
        tail = padded[(start + 8 * blocks)[:, None] + eight]
        tail = np.where(eight < rest[:, None], tail, 0).astype(np.uint8).view("<u8").ravel()
        h = np.where(rest > 0, (h ^ tail) * _M, h)
    h = (h ^ (h >> _R)) * _M
    h = h ^ (h >> _R)
    out = np.empty_like(h)
    out[order] = h
    return out


def murmur64a_array(texts: pa.Array) -> np.ndarray:
    """Hashes of the texts as unsigned numbers; null hashes as empty."""
    return murmur64a_spans(*_binary(texts))


def _murmur(texts: pa.Array) -> pa.Array:
    return pa.array(murmur64a_array(texts).view(np.int64), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def murmur64a(text: Column) -> Column:
    """The hash of a text's UTF-8 bytes, its bits as a signed long; null for null."""
    return F.arrow_udf(_murmur, "long")(text)


def unsigned_order(h: Column) -> Column:
    """A long that sorts as the hash would unsigned."""
    return h.bitwiseXOR(F.lit(-(2**63)))


def unsigned_value(h: Column) -> Column:
    """The hash as an unsigned decimal."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unordered(a: Column, b: Column) -> Column:
    """The canonical pair of two values."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _spread(x: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_order(x: Column, y: Column) -> Column:
    """The low 16 bits of both numbers interleaved, x in the even bits."""
    low = lambda c: c.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    return _spread(low(x)).bitwiseOR(F.shiftleft(_spread(low(y)), 1))


def sha256_list(items: Column) -> Column:
    """SHA-256 of the strings of a list, each followed by a slash."""
    return F.sha2(F.concat(F.array_join(items, "/"), F.when(F.size(items) > 0, F.lit("/")).otherwise(F.lit(""))), 256)


def combine(hashes: Column) -> Column:
    """One 32-bit hash of an ordered list of 32-bit hashes; the same on every machine."""
    wrap = lambda x: ((x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) + F.lit(2**31)) % F.lit(2**32)) - F.lit(2**31)
    step = lambda a, x: wrap(a.bitwiseXOR(x.cast("long") + F.lit(0x9E3779B9).cast("long") + F.shiftleft(a.bitwiseAND(F.lit(0x3FFFFFF).cast("long")), 6) + F.shiftright(a, 2)))
    return F.aggregate(hashes, F.lit(0).cast("long"), step).cast("int")


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return x << x.dtype.type(by) | x >> x.dtype.type(bits - by)


def _binary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, zeros after them, with starts and sizes; null counts as empty."""
    t = texts.cast(pa.large_binary())
    if t.null_count:
        t = t.fill_null(b"")
    _, off, val = t.buffers()
    offsets = np.frombuffer(off, np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    values = np.frombuffer(val, np.uint8) if val is not None else np.zeros(0, np.uint8)
    return np.concatenate([values, np.zeros(16, np.uint8)]), offsets[:-1], np.diff(offsets)


def _steps(sizes: np.ndarray, block: int):
    """(rows, block number) for each block that some rows have whole; the longest rows first."""
    order = np.argsort(-sizes, kind="stable")
    many = (sizes // block)[order]
    left = len(order)
    for j in range(int(many[0]) if len(many) else 0):
        while left and many[left - 1] <= j:
            left -= 1
        yield order[:left], j


def _words(values: np.ndarray, at: np.ndarray, keep: np.ndarray | None, block: int, kind: str) -> np.ndarray:
    """The words of one block of each row, without the bytes past ``keep``."""
    w = values[at[:, None] + np.arange(block)]
    if keep is not None:
        w = np.where(np.arange(block) < keep[:, None], w, 0).astype(np.uint8)
    return np.ascontiguousarray(w).view(kind)


def murmur3_array(texts: pa.Array, seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 of all texts, unsigned."""
    values, start, size = _binary(texts)
    u = np.uint32
    h = np.full(len(start), seed, u)
    scramble = lambda k: _rotate(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    for rows, j in _steps(size, 4):
        h[rows] = _rotate(h[rows] ^ scramble(_words(values, start[rows] + 4 * j, None, 4, "<u4")[:, 0]), 13) * u(5) + u(0xE6546B64)
    if len(h):
        h ^= np.where(size % 4 > 0, scramble(_words(values, start + size // 4 * 4, size % 4, 4, "<u4")[:, 0]), u(0))
    h ^= size.astype(u)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return h ^ h >> u(16)


def murmur3_x64_128_array(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of MurmurHash3 x64_128 of all texts, unsigned."""
    values, start, size = _binary(texts)
    u = np.uint64
    c1, c2 = u(0x87C37B91114253D5), u(0x4CF5AD432745937F)
    a, b = np.full(len(start), seed, u), np.full(len(start), seed, u)
    first = lambda k: _rotate(k * c1, 31) * c2
    second = lambda k: _rotate(k * c2, 33) * c1
    for rows, j in _steps(size, 16):
        k = _words(values, start[rows] + 16 * j, None, 16, "<u8")
        x = (_rotate(a[rows] ^ first(k[:, 0]), 27) + b[rows]) * u(5) + u(0x52DCE729)
        b[rows] = (_rotate(b[rows] ^ second(k[:, 1]), 31) + x) * u(5) + u(0x38495AB5)
        a[rows] = x
    if len(a):
        k = _words(values, start + size // 16 * 16, size % 16, 16, "<u8")
        a, b = a ^ first(k[:, 0]), b ^ second(k[:, 1])
    a, b = a ^ size.astype(u), b ^ size.astype(u)
    a = a + b
    b = b + a

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> u(33)) * u(0xFF51AFD7ED558CCD)
        x = (x ^ x >> u(33)) * u(0xC4CEB9FE1A85EC53)
        return x ^ x >> u(33)

    a, b = mix(a), mix(b)
    a = a + b
    return a, b + a


def murmur3_x86_128_array(texts: pa.Array, seed: int = 0) -> np.ndarray:
    """The four words of MurmurHash3 x86_128 of all texts, unsigned."""
    values, start, size = _binary(texts)
    u = np.uint32
    c = [u(x) for x in (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)]
    turn, after, add = (15, 16, 17, 18), (19, 17, 15, 13), [u(x) for x in (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)]
    h = np.full((len(start), 4), seed, u)
    scramble = lambda k, i: _rotate(k * c[i], turn[i]) * c[(i + 1) % 4]
    for rows, j in _steps(size, 16):
        k, x = _words(values, start[rows] + 16 * j, None, 16, "<u4"), h[rows]
        for i in range(4):
            x[:, i] = (_rotate(x[:, i] ^ scramble(k[:, i], i), after[i]) + x[:, (i + 1) % 4]) * u(5) + add[i]
        h[rows] = x
    if len(h):
        k = _words(values, start + size // 16 * 16, size % 16, 16, "<u4")
        for i in range(4):
            h[:, i] ^= scramble(k[:, i], i)
    h ^= size.astype(u)[:, None]

    def spread(h: np.ndarray) -> None:
        h[:, 0] += h[:, 1] + h[:, 2] + h[:, 3]
        h[:, 1:] += h[:, :1]

    spread(h)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    h = h ^ h >> u(16)
    spread(h)
    return h


def murmur3(text: Column, seed: int = 0) -> Column:
    """The 32-bit key of a text in a constant database, as a long; null for null."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array(murmur3_array(col, seed).astype(np.int64), mask=col.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "long")(text)


def murmur3_128(text: Column, seed: int = 0, words: int = 64) -> Column:
    """The 128-bit hash of a text's bytes, made by steps of 64 or of 32 bits, as hexadecimal words in order; null for null."""
    if words not in (32, 64):
        raise ValueError("words must be 32 or 64")

    def run(col: pa.Array) -> pa.Array:
        h = np.stack(murmur3_x64_128_array(col, seed), 1) if words == 64 else murmur3_x86_128_array(col, seed)
        out = ["".join(f"{int(x):0{words // 4}x}" for x in r) for r in h]
        return pa.array(out, pa.string(), mask=col.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "string")(text)

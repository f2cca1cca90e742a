"""Shared helpers: safe column handling, lineage cuts and vectorised token hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.lineage import cut, shared_folder  # noqa: F401  (for the operators)

ID, TEXT = "__id", "__text"


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **extra: str) -> DataFrame:
    """Only the identifier, the text and ``extra`` columns, under names of our own, so no other column can clash."""
    cols = [F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{text_col}`").cast("string").alias(TEXT)]
    return df.select(*cols, *[F.col(f"`{c}`").alias(k) for k, c in extra.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null and blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --------------------------------------------------------------------------- token hashing

_POW = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False  # whitespace-separated words
ALNUM = np.zeros(256, bool)  # runs of letters, digits and non-ASCII bytes
ALNUM[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    ALNUM[_c] = True


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, val = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    values = np.frombuffer(val, np.uint8) if val is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(values: np.ndarray, offsets: np.ndarray, keep: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (maximal runs of kept bytes), first token of each text (n + 1), byte starts and ends."""
    k = keep[values]
    n = len(k)
    none = np.zeros(0, np.int64)
    if n == 0 or not k.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = k[:-1]
    starts = np.flatnonzero(k & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = k[1:]
    ends = np.flatnonzero(k & (~after | edge[1:])) + 1
    lens = ends - starts
    first = np.cumsum(lens) - lens
    body = values[k].astype(np.uint64)
    body += np.uint64(1)
    place = np.arange(len(body), dtype=np.int64)
    place -= np.repeat(first, lens)
    body *= _powers(int(lens.max()))[place]
    h = mix(np.add.reduceat(body, first) + lens.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return h, np.searchsorted(starts, offsets), starts, ends


def chunks(arr: pa.Array | pa.ChunkedArray, limit: int = 1_000_000):
    """(first row, rows) slices of ``arr`` of about ``limit`` bytes each; a longer text is a slice of its own."""
    _, offsets = flat(arr)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside one text each, and the index of the text of each."""
    per = np.maximum(np.diff(first) - n + 1, 0)
    m = len(h) - n + 1
    if m <= 0 or not per.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g += h[j : j + m] * (_powers(n + 2)[j + 1])
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    return mix(g[at]), doc


def hash_of(tok: str) -> int:
    """Hash of one token, as ``tokens`` gives it."""
    return int(tokens(*flat(pa.array([tok])), np.ones(256, bool))[0][0])


def trim() -> None:
    """Give memory that Arrow and the allocator hold for later back to the system; several workers share an executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

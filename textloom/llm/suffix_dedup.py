"""Repeated passages by a depth-limited radix sort of suffixes.

Texts are sequences of whitespace-separated words. Suffixes are ordered only through their first ``threshold`` words,
by passes from the most significant digit on: a digit is a run of words, the first digit distributes the
suffixes, the next ones order them within, and suffixes that are equal in all digits, hence in ``threshold``
words, are exactly the repeated windows.

Most suffixes can't repeat, and are left out before the sort. A repeated window holds a repeated run of half its length,
and among the runs in a window the one with the smallest hash is the same wherever the window occurs (its
anchor). So only windows around anchors that occur twice are sorted; no repeated window is lost.

Documents of equal text have the same windows: one of them is sorted for all. All windows of such
a text are repeated, and in all but the first of its documents they are copies. Texts are taken for equal by a 64-bit hash,
and a second one tells apart texts on which the first agrees.

Defined results: null, empty and short texts have no windows; texts of any length are taken whole; a passage that repeats within
one text counts; of equal windows the first, by identifier and position, is the original and the others are copies; null
identifiers come last; rows that repeat identifier and text are one document; an empty table gives none; other
columns are ignored. Identifiers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, chunks, cut, flat, mix, n_words, narrow, shuffle_partitions, tokens

THRESHOLD = 50
_MAX = np.uint64(2**64 - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, by doubling; the last n - 1 positions are missing."""
    power = {1: h}
    w = 1
    while 2 * w <= n:
        p = power[w]
        power[2 * w] = _pair(p[: max(len(p) - w, 0)], p[w:])
        w *= 2
    p = power[w]
    m = max(len(h) - n + 1, 0)
    return p[:m] if w == n else _pair(p[:m], p[n - w : n - w + m]) + np.uint64(n)


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each ``w`` consecutive values."""
    v, have = x, 1
    while 2 * have <= w:
        v = f(v[: max(len(v) - have, 0)], v[have:])
        have *= 2
    m = max(len(x) - w + 1, 0)
    return v[:m] if have == w else f(v[:m], v[w - have : w - have + m])


def anchors(h: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the runs of half a window that are the smallest of some window."""
    k = threshold // 2
    w = threshold - k + 1
    count = np.diff(first)
    g = runs(h, k)
    none = np.zeros(0, np.int64)
    if len(g) < w:
        return none, none, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(count)), count)[: len(g)]
    place = np.arange(len(g)) - first[doc]
    g = np.where(place + k <= count[doc], g, _MAX)  # runs over the end of a text
    low = _slide(g, w, np.minimum)
    low = np.where(place[: len(low)] + threshold <= count[doc[: len(low)]], low, np.uint64(0))  # windows over the end
    best = _slide(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)[: len(g)]
    at = np.flatnonzero((best == g) & (g != _MAX))
    return doc[at], place[at], g[at]


def _find_anchors(threshold: int, parts: int):
    names = ["part", "hash", "k", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(b.column(1)):
                h, first, _, _ = tokens(*flat(b.column(1).slice(i, j - i)))
                doc, pos, g = anchors(h, first, threshold)
                part = ((g >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)
                order = np.lexsort((g, part))
                part, doc, pos, g = part[order], doc[order], pos[order], g[order]
                head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
                for s, e in zip(head, np.append(head[1:], len(part)).astype(int) if len(part) else []):
                    for c, v in zip(rows, (int(part[s]), g[s:e].tobytes(), keys[doc[s:e] + i].tobytes(), pos[s:e].astype(np.int32).tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=names)

    return run, "part int, hash binary, k binary, pos binary"


def _bytes(col: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def _twice(t: pa.Table) -> pa.Table:
    """Of one part's anchors, those that occur twice, be it in one text: for each text its positions."""
    g, k, p = _bytes(t["hash"], np.uint64), _bytes(t["k"], np.int64), _bytes(t["pos"], np.int32)
    order = np.argsort(g, kind="stable")
    g = g[order]
    size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g)))
    keep = np.repeat(size > 1, size)
    g, k, p = g[keep], k[order][keep], p[order][keep]
    order = np.lexsort((p, k, g))
    g, k, p = g[order], k[order], p[order]
    once = np.ones(len(g), bool)  # documents of equal text posted the same
    once[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    g, k, p = g[once], k[once], p[once]
    size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g))) if len(g) else np.zeros(0, int)
    keep = np.repeat(size > 1, size)
    k, p = k[keep], p[keep]
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return pa.table({"k": pa.array(k[head], pa.int64()), "pos": pa.ListArray.from_arrays(pa.array(np.append(head, len(k)), pa.int32()), pa.array(p, pa.int32()))})


_ALONE = 1 << 30  # marks suffixes of texts that several documents have; they are repeated even if no other text has them


def _digits(threshold: int, parts: int):
    """Texts with their anchors -> the suffixes around them with their digits, by the first digit."""
    size = [threshold // 2, threshold - threshold // 2]
    k = threshold // 2
    names = ["part", "k", "id", "pos", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            keys, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            several = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunks(b.column(2)):
                h, first, _, _ = tokens(*flat(b.column(2).slice(i, j - i)))
                lists = b.column(3).slice(i, j - i)
                at = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
                # a window around an anchor begins at most so far before it
                mark = np.bincount(np.maximum(at - (threshold - k), 0), minlength=len(h) + 1) - np.bincount(at + 1, minlength=len(h) + 1)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                place = np.arange(len(h)) - first[doc]
                whole = several[i:j][doc]
                s = np.flatnonzero(((np.cumsum(mark[: len(h)]) > 0) | whole) & (place + threshold <= count[doc]))
                if not len(s):
                    continue
                d = np.stack([runs(h, size[0])[s], runs(h, size[1])[s + size[0]]], 1)
                part = ((d[:, 0] >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, own, pos, d = part[order], doc[s][order] + i, (place[s] + whole[s] * _ALONE)[order], d[order]
                head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for x, y in zip(head, np.append(head[1:], len(part))):
                    for c, v in zip(rows, (int(part[x]), keys[own[x:y]].tobytes(), ids[own[x:y]].tobytes(), pos[x:y].astype(np.int32).tobytes(), np.ascontiguousarray(d[x:y]).tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=names)

    return run, "part int, k binary, id binary, pos binary, d binary"


def _equal(back: int):
    """One part's suffixes -> passes from the most significant digit on, each dropping what stands alone; the windows of
    the groups that remain, packed by a part of the texts."""

    def run(t: pa.Table) -> pa.Table:
        k, ident, p = _bytes(t["k"], np.int64), _bytes(t["id"], np.int64), _bytes(t["pos"], np.int32)
        d = _bytes(t["d"], np.uint64).reshape(-1, 2)
        alone = p >= _ALONE
        p = p % _ALONE
        live, group = np.arange(len(k)), np.zeros(len(k), np.int64)
        for digit in (0, 1):  # order the groups by the next digit, cut them, drop the single ones
            x = d[live, digit]
            order = np.lexsort((x, group))
            live, group, x = live[order], group[order], x[order]
            new = np.ones(len(live), bool)
            new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
            group = np.cumsum(new) - 1
            keep = (np.bincount(group, minlength=1)[group] > 1) | alone[live]
            live, group = live[keep], group[keep]
        order = np.lexsort((p[live], k[live], ident[live], group))
        live, group = live[order], group[order]
        k, p = k[live], p[live]
        copy = np.zeros(len(k), bool)
        copy[1:] = group[1:] == group[:-1]
        part = (mix(k.astype(np.uint64)) % np.uint64(back)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, k, p, copy = part[order], k[order], p[order], copy[order]
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, int)
        ends = np.append(head[1:], len(part)).astype(int) if len(part) else head
        cut_ = lambda a, dt: pa.array([a[s:e].astype(dt).tobytes() for s, e in zip(head, ends)], pa.binary())
        return pa.table({"part": pa.array(part[head], pa.int32()), "k": cut_(k, np.int64), "pos": cut_(p, np.int32), "copy": cut_(copy, np.uint8)})

    return run, "part int, k binary, pos binary, copy binary"


def _spans(threshold: int):
    """The windows of some texts -> merged spans, originals and copies apart."""

    def run(t: pa.Table) -> pa.Table:
        k, p, c = _bytes(t["k"], np.int64), _bytes(t["pos"], np.int32).astype(np.int64), _bytes(t["copy"], np.uint8)
        order = np.lexsort((p, c, k))
        k, p, c = k[order], p[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (p[1:] > p[:-1] + threshold)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(k)) - 1
        return pa.table({"k": k[head], "start": p[head], "end": p[last] + threshold, "copy": pa.array(c[head] > 0)})

    return run, "k long, start long, end long, copy boolean"


def _key():
    return F.xxhash64(TEXT)


def repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: (doc_id, start_word, end_word, is_copy).

    A span joins overlapping and adjoining windows of ``threshold`` words that occur more than once; ``is_copy`` tells
    the windows that occurred before from the first occurrences."""
    if threshold < 6:
        raise ValueError("threshold must be at least 6")
    parts = 2 * shuffle_partitions(docs.sparkSession)
    last = np.iinfo(np.int64).max  # null identifiers come last
    d = narrow(docs, id_col, text_col).where(F.col(TEXT).isNotNull())
    d = d.select(_key().alias("k"), F.coalesce(ID, F.lit(last)).alias("id"), TEXT)
    second = F.xxhash64(F.lit(1), TEXT)

    def grouped(d: DataFrame) -> DataFrame:
        same = d.groupBy("k", "id").agg(F.count(F.lit(1)).alias("rows"), F.max(n_words(F.col(TEXT))).alias("n"), F.min(second).alias("lo"), F.max(second).alias("hi")).where(F.col("n") >= threshold)
        # combined before the shuffle
        tops = same.groupBy("k").agg(F.min("id").alias("rep"), (F.count(F.lit(1)) > 1).alias("several"), (F.min("lo") < F.max("hi")).alias("mixed"))
        return cut(same.join(tops, "k"))

    same = grouped(d)
    mixed = same.where("mixed").select(F.col("k").alias("m")).distinct()
    if not mixed.isEmpty():  # texts that the first hash doesn't tell apart go by both
        d = d.join(mixed, d["k"] == mixed["m"], "left").select(F.when(F.col("m").isNull(), F.col("k")).otherwise(F.xxhash64("k", second)).alias("k"), "id", TEXT)
        same = grouped(d)
    f, schema = _find_anchors(threshold, parts)
    got = d.select("k", TEXT).mapInArrow(f, schema).groupBy("part").applyInArrow(_twice, "k long, pos array<int>")
    lists = got.groupBy("k").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    rep = same.where("id = rep").select("k", "rep", "several")
    need = rep.join(lists, "k", "left").where("several or pos is not null").select("k", "rep", F.coalesce("pos", F.expr("cast(array() as array<int>)")).alias("pos"), "several")
    own = d.join(need.hint("shuffle_hash"), "k").where("id = rep").select("k", "id", TEXT, "pos", "several")
    if not same.where("id = rep and rows > 1").isEmpty():
        own = own.dropDuplicates(["k"])
    f, schema = _digits(threshold, parts)
    g, schema2 = _equal(parts)
    e, schema3 = _spans(threshold)
    spans = own.mapInArrow(f, schema).groupBy("part").applyInArrow(g, schema2).groupBy("part").applyInArrow(e, schema3)
    first = spans.join(rep.select("k", "rep"), "k").select(F.col("rep").alias("id"), "start", "end", "copy")
    rest = same.where("id <> rep").select("id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(True).alias("copy"))
    out = first.unionByName(rest)
    return out.select(F.when(F.col("id") < last, F.col("id")).alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("copy").alias("is_copy"))

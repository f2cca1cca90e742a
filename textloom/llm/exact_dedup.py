"""Exact duplicates by a tree-merge of sorted digest runs.

Each partition makes a sorted run of digests with the smallest identifier of each. The runs are merged in
binomial rounds: in every round ``fan`` neighbouring runs come together, each merged run being cut into
``fan`` times as many digest ranges, so that all rounds have as many pieces and move only 56 bytes a document.
A piece of a run travels as one block of sorted arrays, and pieces that meet are merged as the sorted runs they are.
After the last round a range holds the digests of all runs. A merge takes two documents for copies only if
the sort digest (64 bits), the SHA-256 of the text and its byte length agree.

Defined results: null text is never a copy; empty text is a text like any other; texts of any length are compared whole;
among copies the smallest identifier stays, null counting as larger than all (as the largest 64-bit number); of
rows that repeat identifier and text one stays, the smallest by the other columns (those without an order, such as maps, by
their JSON); an empty table gives an empty table; other columns pass through untouched. Identifiers are integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, cut, fresh, narrow, shuffle_partitions

FAN = 8
_KEY = ["d", "sha", "bytes"]


def _digest(text):
    return F.xxhash64(text).alias("d"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, d, sha, bytes) of the documents that have text."""
    d = narrow(docs, id_col, text_col).where(F.col(TEXT).isNotNull())
    return d.select(ID, *_digest(F.col(TEXT)))


_LAST = np.iinfo(np.int64).max
_BLOCK = "grp long, d binary, sha binary, bytes binary, keep binary"


def merge(d: np.ndarray, sha: np.ndarray, size: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs one after the other, each sorted by digest -> one run, with the smallest identifier of each text.

    The stable sort finds the runs and merges them."""
    order = np.argsort(d, kind="stable")
    d, sha, size, keep = d[order], sha[order], size[order], keep[order]
    same = d[1:] == d[:-1]
    equal = same & (sha[1:] == sha[:-1]).all(1) & (size[1:] == size[:-1])
    if (same & ~equal).any():  # texts of one digest may stand in any order
        order = np.lexsort((size, *sha.T, d))
        d, sha, size, keep = d[order], sha[order], size[order], keep[order]
        equal = (d[1:] == d[:-1]) & (sha[1:] == sha[:-1]).all(1) & (size[1:] == size[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~equal))) if len(d) else np.zeros(0, int)
    return d[head], sha[head], size[head], np.minimum.reduceat(keep, head) if len(d) else keep


def _blocks(run: int, cols: tuple, level: int, fan: int) -> pa.Table:
    """A sorted run cut into the ``fan ** level`` digest ranges of its next round, by the group and range where each goes."""
    pieces = fan**level
    d = cols[0]
    piece = ((d >> np.uint64(40)) * np.uint64(pieces) >> np.uint64(24)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(d) else np.zeros(0, int)
    ends = np.append(head[1:], len(d)).astype(int) if len(d) else head
    cut_ = [pa.array([np.ascontiguousarray(c[s:e]).tobytes() for s, e in zip(head, ends)], pa.binary()) for c in cols]
    return pa.table([pa.array(run // pieces * pieces + piece[head], pa.int64()), *cut_], names=["grp", "d", "sha", "bytes", "keep"])


def _first_run(runs: int, fan: int):
    """A partition's digests -> its sorted run, in blocks for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, held = TaskContext.get().partitionId() % runs, []
        for b in batches:
            sha = np.frombuffer(b"".join(b.column("sha").to_pylist()), "<u8").reshape(-1, 4)
            held.append((b.column("d").to_numpy().astype(np.uint64), sha, b.column("bytes").to_numpy(), pc.fill_null(b.column(ID), _LAST).to_numpy(zero_copy_only=False)))
            if len(held) > 64:
                held = [merge(*map(np.concatenate, zip(*held)))]
        if held:
            yield from _blocks(own, merge(*map(np.concatenate, zip(*held))), 1, fan).to_batches()

    return run


def _round(level: int, fan: int, last: bool):
    """The blocks of one group and range -> their merged run, in blocks for the next round, or as rows after the last."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cat = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        d, sha, size, keep = merge(cat("d", "<u8"), cat("sha", "<u8").reshape(-1, 4), cat("bytes", "<i8"), cat("keep", "<i8"))
        if last:
            b = np.ascontiguousarray(sha).tobytes()
            return pa.table({"d": d.astype(np.int64), "sha": pa.array([b[i : i + 32] for i in range(0, len(b), 32)], pa.binary()), "bytes": size, "keep": pa.array(keep, mask=keep == _LAST)})
        return _blocks(key[0].as_py(), (d, sha, size, keep), level + 1, fan)

    return run


def smallest(digest: DataFrame, fan: int = FAN, runs: int | None = None) -> DataFrame:
    """The smallest identifier of each text: (d, sha, bytes, keep)."""
    runs = runs or shuffle_partitions(digest.sparkSession)
    levels = max(1, math.ceil(math.log(max(runs, 2), fan)))
    df = digest.select(ID, *_KEY).mapInArrow(_first_run(runs, fan), _BLOCK)
    for level in range(1, levels + 1):
        last = level == levels
        df = df.groupBy("grp").applyInArrow(_round(level, fan, last), "d long, sha binary, bytes long, keep long" if last else _BLOCK)
    return df


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """Each identifier and text with the identifier that stays for it: (doc_id, keep_id, n_rows).

    ``n_rows`` is how many rows have this identifier and text. Documents without text are not listed."""
    return _decided(docs, id_col, text_col, fan).select(F.col(ID).alias("doc_id"), F.col("keep").alias("keep_id"), "n_rows")


def _decided(docs: DataFrame, id_col: str, text_col: str, fan: int) -> DataFrame:
    each = cut(digests(docs, id_col, text_col))
    rows = each.groupBy(ID, *_KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(smallest(each, fan), _KEY)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """``docs`` without the copies; the columns stay as they are."""
    decided = cut(_decided(docs, id_col, text_col, fan))
    wins = F.col(ID).eqNullSafe(F.col("keep"))
    names = {k: fresh(docs, k) for k in [ID, *_KEY]}
    own = docs.withColumns({names[ID]: F.col(f"`{id_col}`").cast("long"), **dict(zip([names[k] for k in _KEY], _digest(F.col(f"`{text_col}`").cast("string"))))})

    def on(other: DataFrame):
        r = other.select(*[F.col(k).alias(f"{names[k]}r") for k in names])
        cond = own[names[ID]].eqNullSafe(r[f"{names[ID]}r"])
        for k in _KEY:
            cond = cond & (own[names[k]] == r[f"{names[k]}r"])
        return r, cond

    out, cond = on(decided.where(~wins | (F.col("n_rows") > 1)).hint("shuffle_hash"))
    kept = own.join(out, cond, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    many = decided.where(wins & (F.col("n_rows") > 1))
    if many.isEmpty():
        return kept
    r, cond = on(many)
    unordered = re.compile(r"\b(?:map|variant|interval|geometry|geography)\b")
    w = Window.partitionBy(*[names[k] for k in names]).orderBy(*[F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if unordered.search(t) else F.col(f"`{c}`") for c, t in docs.dtypes])
    n = fresh(own, "n")
    first = own.join(r, cond, "left_semi").withColumn(n, F.row_number().over(w)).where(F.col(n) == 1)
    return kept.unionByName(first.select(*[F.col(f"`{c}`") for c in docs.columns]))

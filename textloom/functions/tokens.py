"""Token hashes of keyed rows, and masking of the names that parallel rows share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import _binary, murmur64a_array, murmur64a_spans
from textloom.functions.text import clean_tokens, strips

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\r\x00")] = True
TOKENS = "array<struct<hash:long,offset:int,length:int>>"


def split_tokens(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, bytes) of the tokens of rows that follow each other. The scan for ends begins at the first tab, so the
    key belongs to the first token; a blank right after an end belongs to the next token, so in a run of blanks
    every other one is an end, from the first on, or from the second where the run begins the row."""
    base, n = (int(start[0]), int(size.sum())) if len(start) else (0, 0)
    v, first = values[base : base + n], start - base
    row = np.repeat(np.arange(len(start)), size)
    tabs = np.flatnonzero(v == 9)
    tab = np.full(len(start), n, np.int64)
    np.minimum.at(tab, row[tabs], tabs)
    at = np.arange(n)
    blank = _BLANK[v] & (at >= tab[row])
    head = blank.copy()
    head[1:] &= ~blank[:-1] | (row[1:] != row[:-1])
    run = np.maximum.accumulate(np.where(head, at, 0)) if n else at
    ends = np.flatnonzero(blank & ((at - run) % 2 == (run == first[row])))
    owner = row[ends]
    starts, rows = np.concatenate([first, ends + 1]), np.concatenate([np.arange(len(start)), owner])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    stop = np.empty(len(starts), np.int64)
    stop[:-1] = starts[1:] - 1
    last = np.ones(len(starts), bool)
    last[:-1] = rows[1:] != rows[:-1]
    stop[last] = (first + size)[rows[last]]
    keep = stop > starts
    return rows[keep], starts[keep] + base, (stop - starts)[keep]


def _hash_tokens(texts: pa.Array) -> pa.Array:
    values, start, size = _binary(texts)
    many, parts = [np.zeros(1, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for i, j in strips(size):  # the work takes some dozen bytes of memory for each byte
        first, own = start[i:j] - start[i], size[i:j]
        v = values[start[i] : start[i] + own.sum()]
        row, at, n = split_tokens(v, first, own)
        h = murmur64a_spans(v, at, n).view(np.int64)
        last = at + n == (first + own)[row]  # the last token of a row has offset and length 0
        parts.append((h, np.where(last, 0, at - first[row]).astype(np.int32), np.where(last, 0, n).astype(np.int32)))
        many.append(np.bincount(row, minlength=j - i))
    item = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["hash", "offset", "length"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(many)).astype(np.int32)), item, mask=texts.is_null())


def hash_tokens(row: Column) -> Column:
    """The tokens of a row as hash, byte offset and byte length."""
    return F.arrow_udf(_hash_tokens, TOKENS)(row)


def _by_hash(lists: pa.Array) -> pa.Array:
    items, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((murmur64a_array(items), np.repeat(np.arange(len(n)), n)))
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items.take(pa.array(order)), mask=lists.is_null())


def by_hash(items: Column) -> Column:
    """A list of strings in the unsigned order of their hashes."""
    return F.arrow_udf(_by_hash, "array<string>")(items)


def row_tokens(text: Column) -> Column:
    """The tokens of a row without a key: those of the cleaned text, the first with the tab before it."""
    return F.split(F.concat(F.lit("\t"), clean_tokens(text)), " ")


def shared_tokens(rows: Column) -> Column:
    """The tokens that all rows (lists of tokens) have."""
    first = F.array_distinct(F.element_at(rows, 1))
    return F.filter(F.aggregate(rows, first, lambda a, x: F.array_intersect(a, x)), lambda x: x != "")


def substitute_names(df: DataFrame, group: list[str], order: list[str], text: str, drop_verbatim: str = "rows") -> DataFrame:
    """Mask the tokens shared by all rows of a group: each becomes ``$$propername<i>$$``, i being its place among the shared
    tokens by hash. One row per group with ``texts``, its rows in order.

    Tokens of one byte and the last token of a row stay. A group whose rows are copies is dropped (null texts left out):
    with ``drop_verbatim="rows"`` where as many tokens are shared as there are rows, with ``"tokens"`` where all tokens are."""
    rows = df.select(*group, *order, row_tokens(F.col(text)).alias("__t"), F.col(text).alias("__raw"))
    rows = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, "__raw", "__t"))).alias("__r"))
    rows = rows.select(*group, F.transform("__r", lambda r: r["__t"]).alias("__rows"))
    rows = rows.select("*", by_hash(shared_tokens(F.col("__rows"))).alias("__common"))

    def mask(t, i, n):
        place = (F.array_position("__common", t) - 1).cast("string")
        swap = F.array_contains("__common", t) & (F.octet_length(t) > 1) & (i < n - 1)
        return F.when(swap, F.concat(F.lit("$$propername"), place, F.lit("$$"))).otherwise(t)

    done = F.transform("__rows", lambda r: F.trim(F.regexp_replace(F.array_join(F.transform(r, lambda t, i: mask(t, i, F.size(r))), " "), r"^\t", "")))
    plain = F.transform("__rows", lambda r: F.trim(F.regexp_replace(F.array_join(r, " "), r"^\t", "")))
    if drop_verbatim == "rows":
        drop = F.size("__common") == F.size("__rows")
    else:
        drop = F.forall("__rows", lambda r: F.size(F.array_distinct(r)) == F.size("__common"))
    texts = F.when((F.size("__rows") == 1) | (F.size("__common") == 0), plain).when(drop, F.array().cast("array<string>")).otherwise(done)
    return rows.select(*group, texts.alias("texts"))

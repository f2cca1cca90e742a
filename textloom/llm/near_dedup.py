"""N-gram Jaccard join by vertical partitioning.

A document's set is that of its word n-grams (words are runs of letters and digits, case ignored). Two documents are
linked if their sets have a Jaccard similarity of at least ``threshold``. All links are found, exactly:

1. The n-gram space is cut into fragments (ranges of the n-gram hash). Each fragment knows how many documents
   have each of its n-grams and reports, per document, how many it shares with any other. Only documents that share
   enough n-grams in all (``threshold`` of their set) can have a link; documents with equal sets are
   represented by the smallest identifier.
2. Crowds of near copies are taken together without looking at their pairs. Minima of the set's hashes gather a crowd, and
   the n-grams that most of (a sample of) it has are its centre. If A lacks m(A) of the P n-grams of the centre and
   has x(A) others, A and B share at least P - m(A) - m(B), so they are linked for certain if
   (m(A) + threshold x(A)) + (m(B) + threshold x(B)) <= (1 - threshold) P. These sums are additive: the links of a
   document by this rule are counted by its rank, from a histogram of the crowd. Any centre gives right counts.
3. Of the rest, each posts its prefix under a global n-gram order that puts the most frequent last: the first
   size - ceil(threshold * size) + 1 n-grams. Two linked sets share an n-gram of their prefixes (and differ
   in size by the threshold at most), so postings that meet in a fragment give all candidates. Pairs that are certain
   by 2 are passed over, not made.
4. Fragments count the partial overlaps of the candidates separately, for blocks of pairs that met in the same n-gram (their
   number follows from the count of candidates), and the sum per pair decides.

The order only needs to be the same everywhere; the list of most frequent n-grams that it moves to the end may thus be
bounded (``FREQUENT``) without any pair being lost.

Defined results: null, empty and wordless texts have no set, no link and a class of their own; texts of fewer than ``n``
words have one n-gram, the whole; rows that repeat identifier and text are one document, rows that repeat the identifier
with another text are another; null identifiers come after all others; very long texts are taken whole; an empty table gives
none; other columns pass through ``dedup`` untouched and are ignored elsewhere. Identifiers are integers (others
are cast to long, which fails under ANSI rules if they aren't numbers). A document is known by its identifier and a
64-bit hash of both; of two documents whose hashes agree by chance one is left alone, as if it had no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ALNUM, ID, TEXT, chunks, cut, flat, fresh, grams, mix, narrow, shuffle_partitions, tokens, trim

N = 3
THRESHOLD = 0.5
FREQUENT = 1_000_000
HEAVY = 64
PARTS = 2
PIECES = 8
FIRST = 4
BROADCAST_ROWS = 1_000_000
#: Hash minima by which crowds are gathered; fewest documents of a crowd; documents that its centre is made of; documents scored together.
MINIMA = 4
CROWD = 8
SAMPLE = 64
SALT = 1024
#: Candidate pairs of a block.
BLOCK = 40_000
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LAST = np.iinfo(np.int64).max
_ALONE = 1 << 40  # the score of a document outside of crowds
_FORTY = np.uint64((1 << 40) - 1)


def _least(size: np.ndarray | int, threshold: float):
    """Fewest n-grams of a set that a partner must share."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: their first row, the different n-grams of each text (by row, then n-gram), and their rows."""
    for i, j in chunks(texts):
        h, first, _, _ = tokens(*flat(pc.utf8_lower(texts.slice(i, j - i))), ALNUM)
        g, doc = grams(h, first, n)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = np.array([mix(np.array([(h[first[r] : first[r + 1]] * np.arange(3, 3 + 2 * count[r], 2, dtype=np.uint64)).sum() + np.uint64(count[r])], np.uint64))[0] for r in short], np.uint64)
            g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        yield i, g[new], doc[new]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, __id, __text): k stands for a document, that is an identifier and its text."""
    return narrow(docs, id_col, text_col).select(F.xxhash64(ID, TEXT).alias("k"), ID, TEXT)


def _pieces(part: np.ndarray, key: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows cut by part: (part, different keys, rows of each key, the columns in that order)."""
    order = np.lexsort((key, part))
    part, key, cols = part[order], key[order], [c[order] for c in cols]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, int)
    for s, e in zip(at, np.append(at[1:], len(part))):
        k = key[s:e]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        yield int(part[s]), k[head], np.diff(np.append(head, len(k))), [c[s:e] for c in cols]


def _narrow(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _short(g: np.ndarray, parts: int) -> np.ndarray:
    """An n-gram by its fragment and 32 bits. Two n-grams may share this, which only ever adds candidates; with fragments as
    many as the corpus asks for it stays as rare as it is."""
    return _fragment(g, parts).astype(np.uint64) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)


def _fragment(g: np.ndarray, parts: int) -> np.ndarray:
    """The fragment of each n-gram: equal ranges of the hash."""
    return ((g >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


# --------------------------------------------------------------------------- 1. who shares enough


def _post_all(n: int, parts: int):
    """Documents -> for each fragment, its documents (40 bits of their key) with their n-grams (32 bits); under fragments
    -1, -2 .. the documents with size, two signatures of the set and ``MINIMA`` minima of its hashes. What is cut short can
    only let a document through."""
    names = ["part", "k", "ids", "count", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            rows: list[list] = [[] for _ in names]
            keys, ids = b.column(0).to_numpy(zero_copy_only=False), pc.fill_null(b.column(1), _LAST).to_numpy(zero_copy_only=False)
            bare = np.ones(len(keys), bool)

            def whole(own: np.ndarray, size: np.ndarray, sig: np.ndarray) -> None:
                for p, _, _, (o,) in _pieces(_home(keys[own], parts), np.arange(len(own)), np.arange(len(own))):
                    for c, v in zip(rows, (-1 - p, keys[own[o]].tobytes(), ids[own[o]].tobytes(), size[o].tobytes(), np.ascontiguousarray(sig[o]).tobytes())):  # noqa: B023
                        c.append(v)

            for i, g, doc in sets(b.column(2), n):
                if not len(g):
                    continue
                head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                own = doc[head] + i
                size = np.diff(np.append(head, len(g))).astype(np.int32)
                sums = [np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), head), np.add.reduceat(mix(g + np.uint64(0x14057B7EF767814F)), head)]
                whole(own, size, np.stack([*sums, *[np.minimum.reduceat(g * x, head) for x in _SEEDS]], 1))
                bare[own] = False
                for p, k, c, (x,) in _pieces(_fragment(g, parts), keys[doc + i], g):
                    for col, v in zip(rows, (p, _narrow(k, 5), b"", _counts(c), _narrow(x, 4))):
                        col.append(v)
            rest = np.flatnonzero(bare)
            whole(rest, np.zeros(len(rest), np.int32), np.repeat(keys[rest].astype(np.uint64)[:, None], 2 + MINIMA, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=names)

    return run, "part int, k binary, ids binary, count binary, grams binary"


def _home(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the documents that a document belongs to, by the 40 bits of its key."""
    return ((keys.astype(np.uint64) & np.uint64((1 << 40) - 1)) % np.uint64(parts)).astype(np.int32)


def _counts(c: np.ndarray) -> bytes:
    """Counts in two bytes each; a larger one takes 65535 and then four bytes at the end."""
    big = c >= 65535
    return np.where(big, 65535, c).astype("<u2").tobytes() + c[big].astype("<u4").tobytes()


def _uncounts(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b, "<u2", n).astype(np.int64)
    c[c == 65535] = np.frombuffer(b, "<u4", offset=2 * n)
    return c


def _join(col: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def _shared(parts: int):
    """A fragment -> how many of its n-grams a document has that others have too, packed by parts of the documents; and the
    fragment's frequent n-grams, under part -1. Sizes pass through."""
    names = ["home", "k", "ids", "count", "grams"]
    kind = pa.schema([("home", pa.int32()), *[(n, pa.binary()) for n in names[1:]]])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        trim()
        part = key[0].as_py()
        if part < 0:
            return t.set_column(0, "home", pa.array(np.full(len(t), -1 - part, np.int32)))
        ks = t["k"].to_pylist()
        c = np.concatenate([_uncounts(x, len(k) // 5) for k, x in zip(ks, t["count"].to_pylist())])
        who, number = np.unique(_wide(b"".join(ks), 5), return_inverse=True)
        doc = np.repeat(number.astype(np.int32), c)
        g = np.frombuffer(b"".join(t["grams"].to_pylist()), "<u4")
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]
        times = np.diff(np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g)))
        many = np.repeat(times > 1, times)
        # a repeated row posts its n-grams again; it is one document all the same
        pair = np.unique(g[many].astype(np.uint64) << np.uint64(32) | doc[many].astype(np.uint64))
        g, doc = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
        df = np.diff(np.append(head, len(g)))
        n = np.bincount(doc[np.repeat(df > 1, df)], minlength=len(who))
        some = np.flatnonzero(n)
        out: list[list] = [[] for _ in names]
        for p, _, _, (o,) in _pieces(_home(who[some], parts), some, some):
            for col, v in zip(out, (p, _narrow(who[o], 5), b"", _counts(n[o]), b"")):
                col.append(v)
        hot = df >= HEAVY
        for col, v in zip(out, (-1, b"", b"", df[hot].astype(np.int32).tobytes(), (g[head[hot]] | part << 32).astype(np.int64).tobytes())):
            col.append(v)
        return pa.table([pa.array(x, f.type) for x, f in zip(out, kind)], schema=kind)

    return run, "home int, k binary, ids binary, count binary, grams binary"


def _sum_shared(t: pa.Table) -> pa.Table:
    """One part of the documents: with each its size, its signatures and minima, and how many of its n-grams others have too."""
    rows = t.to_pylist()
    whole = [r for r in rows if r["ids"]]
    part = [r for r in rows if not r["ids"]]
    cat = lambda f, d, rs: np.frombuffer(b"".join(r[f] for r in rs), d)
    k, at = np.unique(cat("k", np.int64, whole), return_index=True)
    ids, size, sig = cat("ids", np.int64, whole)[at], cat("count", np.int32, whole)[at], cat("grams", np.int64, whole).reshape(-1, 2 + MINIMA)[at]
    key = k.astype(np.uint64) & np.uint64((1 << 40) - 1)
    who = np.unique(key)
    at = np.searchsorted(who, _wide(b"".join(r["k"] for r in part), 5))
    n = np.bincount(at, np.concatenate([np.zeros(0), *[_uncounts(r["count"], len(r["k"]) // 5) for r in part]]), len(who)).astype(np.int64)
    return pa.table({"k": k, "id": ids, "size": size.astype(np.int64), "shared": n[np.searchsorted(who, key)], "s1": sig[:, 0], "s2": sig[:, 1], "minima": pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * MINIMA, pa.int32()), pa.array(sig[:, 2:].ravel()))})


def _unpack_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [np.concatenate([np.zeros(0, d), *[np.frombuffer(x, d) for x in b.column(i).to_pylist()]]) for i, d in ((0, np.int64), (1, np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int64))], names=["gram", "df"])


# --------------------------------------------------------------------------- 2. crowds


def _centres(n: int, threshold: float):
    """A sample of a crowd -> centres: of the document with most neighbours in the sample and these, the n-grams that more than
    half have; then the same of the rest, while there are neighbours. A crowd may have gathered several families."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        own: dict[int, np.ndarray] = {}
        for i, g, doc in sets(t[TEXT].combine_chunks(), n):
            for r in np.unique(doc):
                own[i + int(r)] = g[doc == r]
        g, doc = np.concatenate([np.zeros(0, np.uint64), *own.values()]), np.repeat(np.arange(len(own)), [len(x) for x in own.values()])
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]
        names, at = np.unique(g, return_inverse=True)
        has = np.zeros((len(own), len(names)), np.float32)
        has[doc, at] = 1
        both, size = has @ has.T, has.sum(1)
        near = both >= threshold * (size[:, None] + size[None, :] - both)
        left, out = np.ones(len(own), bool), []
        while left.any():
            count = (near & left).sum(1) * left
            top = int(np.argmax(count))
            if count[top] < 3:
                break
            which = near[top] & left
            out.append(names[has[which].sum(0) * 2 > which.sum()].tobytes())
            left &= ~which
        return pa.table({"crowd": t["crowd"].slice(0, 1), "centres": pa.array([out], pa.list_(pa.binary()))})

    return run, "crowd long, centres array<binary>"


def _score(n: int, threshold: float):
    """Documents with the centres of their crowd -> the centre that they are nearest to, 1024 (m + threshold x), rounded up, and
    1024 (1 - threshold) P, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            score, most, best = np.ones(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, g, doc in sets(b.column(1), n):
                head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(g) else np.zeros(0, int)
                for s, e in zip(head, np.append(head[1:], len(g)).astype(int)):
                    row, own = doc[s] + i, g[s:e]
                    for k, c in enumerate(b.column(3)[int(row)]):
                        p = np.frombuffer(c.as_buffer(), np.uint64)
                        if not len(p):
                            continue
                        both = int((p[np.searchsorted(p, own).clip(max=len(p) - 1)] == own).sum())
                        x, y = int(np.ceil(1024 * (len(p) - both + threshold * (len(own) - both)) + 1e-6)), int(np.floor(1024 * (1 - threshold) * len(p) - 1e-6))
                        if x <= y and (not most[row] or x * most[row] < score[row] * y):
                            score[row], most[row], best[row] = x, y, k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(best), pa.array(score), pa.array(most)], names=["k", "crowd", "centre", "score", "most"])

    return run, "k long, crowd long, centre long, score long, most long"


def _crowds(texts: DataFrame, rep: DataFrame, n: int, threshold: float) -> DataFrame:
    """(k, weight, crowd, score, most) of the documents in crowds: two of a crowd are linked for certain if the sum of their scores is ``most`` at most."""
    own = rep.select("k", F.posexplode("minima")).select("k", F.xxhash64("pos", "col").alias("key"))
    often = own.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= CROWD)
    # of a document's keys the most frequent; a key leads on to the most frequent one that its documents have
    best = _with(own, cut(often), "key").groupBy("k").agg(F.max(F.struct("times", "key")).alias("best"), F.collect_list("key").alias("keys"))
    best = cut(best).select("k", "best", F.explode("keys").alias("key"))
    leads = cut(best.groupBy("key").agg(F.max("best").alias("to")))
    of = cut(_with(best.select("k", "key"), leads, "key").groupBy("k").agg(F.max("to")["key"].alias("crowd")))
    sizes = cut(of.groupBy("crowd").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= CROWD))
    of = cut(_with(of, sizes, "crowd"))
    w = Window.partitionBy("crowd").orderBy("k")
    some = of.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SAMPLE).select("k", "crowd")
    f, schema = _centres(n, threshold)
    centres = cut(_with(texts.select("k", TEXT), cut(some), "k").groupBy("crowd").applyInArrow(f, schema).where(F.size("centres") > 0))
    salts = F.ceil(F.col("members") / SALT).cast("int")
    ends = centres.join(sizes, "crowd").select("crowd", "centres", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    of = _with(of, centres.select("crowd"), "crowd")
    members = _with(texts, cut(of), "k").withColumn("salt", F.pmod(F.xxhash64("k"), salts).cast("int"))
    f, schema = _score(n, threshold)
    scored = members.join(ends.hint("shuffle_hash"), ["crowd", "salt"]).select("k", TEXT, "crowd", "centres").mapInArrow(f, schema).where("score <= most")
    return cut(scored.join(rep.select("k", "weight"), "k").select("k", "weight", F.xxhash64("crowd", "centre").alias("crowd"), "score", "most"))


def _ranks(t: pa.Table) -> pa.Table:
    """A crowd's histogram (score, weight) -> for each score the documents that are linked for certain to one that has it."""
    score, weight, most = t["score"].to_numpy(), t["weight"].to_numpy(), t["most"].to_numpy()
    order = np.argsort(score)
    upto = np.concatenate(([0], np.cumsum(weight[order])))
    return pa.table({"crowd": t["crowd"], "score": t["score"], "near": upto[np.searchsorted(score[order], most - score, "right")]})


def _certain(crowds: DataFrame) -> DataFrame:
    """(k, links): how many other documents each document is linked to for certain."""
    bins = crowds.groupBy("crowd", "score", "most").agg(F.sum("weight").alias("weight"))
    near = cut(bins.groupBy("crowd").applyInArrow(_ranks, "crowd long, score long, near long"))
    own = F.when(F.col("score") * 2 <= F.col("most"), F.col("weight")).otherwise(0)
    return crowds.join(near, ["crowd", "score"]).select("k", (F.col("near") - own).alias("links"))


def _stars(crowds: DataFrame) -> DataFrame:
    """Links (a, b) for certain that connect each crowd: of all to the one with the least score. (a, b, most)."""
    least = crowds.groupBy("crowd").agg(F.min(F.struct("score", "k")).alias("m")).select("crowd", F.col("m.score").alias("least"), F.col("m.k").alias("b"))
    near = _with(crowds, cut(least), "crowd").where(F.col("score") + F.col("least") <= F.col("most"))
    return cut(near.where("k <> b").select(F.col("k").alias("a"), "b"))


# --------------------------------------------------------------------------- 3. candidates


def _post_prefix(n: int, threshold: float, parts: int, frequent, listed: int):
    """Documents -> for each fragment, the postings of the prefixes (40 bits: a clash only adds a candidate), and with each
    document ``FIRST`` n-grams of its prefix, the first by an order that takes the frequent ones first.

    The order of the prefix: n-grams in the frequent list (a broadcast pair of n-grams and their counts, made with
    ``listed`` fragments) last, by their count."""
    names = ["part", "k", "size", "crowd", "count", "first", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_, df = frequent.value
        for b in batches:
            trim()
            rows: list[list] = [[] for _ in names]
            keys = b.column(0).to_numpy(zero_copy_only=False)
            crowd = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4)], 1)
            for i, g, doc in sets(b.column(1), n):
                if not len(g):
                    continue
                often = np.zeros(len(g), np.int64)
                if len(often_):
                    low = _short(g, listed)
                    at = np.searchsorted(often_, low).clip(max=len(often_) - 1)
                    often = np.where(often_[at] == low, df[at], 0)
                order = np.lexsort((g, often, doc))
                g, doc, often = g[order], doc[order], often[order]
                head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                size = np.diff(np.append(head, len(g)))
                prefix = size - _least(size, threshold) + 1
                keep = np.arange(len(g)) - np.repeat(head, size) < np.repeat(prefix, size)
                own = np.repeat(np.arange(len(head)), size)[keep]  # documents by their place in this slice
                # how far into the document's order an n-gram stands, in 255ths, rounded down
                far = ((np.arange(len(g)) - np.repeat(head, size)) * 255 // np.repeat(size, size))[keep].astype(np.uint64)
                g, often, who = g[keep], often[keep], doc[head]
                order = np.lexsort((g, often, often == 0, own))
                # where a prefix has fewer, the last of them again
                first = g[order][(np.cumsum(prefix) - prefix)[:, None] + np.minimum(np.arange(FIRST), prefix[:, None] - 1)]
                for p, k, c, (x,) in _pieces(_fragment(g, parts), own, g & _FORTY | far << np.uint64(40)):
                    for col, v in zip(rows, (p, keys[who[k] + i].tobytes(), size[k].astype(np.int32).tobytes(), crowd[who[k] + i].tobytes(), c.astype(np.int32).tobytes(), first[k].tobytes(), _narrow(x, 6))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=names)

    return run, "part int, k binary, size binary, crowd binary, count binary, first binary, grams binary"


def _pairs(start: np.ndarray, end: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with start[i] <= j < end[i], some hundred thousands at a time."""
    later = end - start
    total = np.cumsum(later)
    at = 0
    while at < len(later):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        c = later[at:stop]
        yield np.repeat(np.arange(at, stop), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[at:stop], c)
        at = stop


def _candidates(threshold: float):
    """A fragment's prefix postings -> the pairs of documents that meet in one and aren't linked for certain, with the n-gram where they meet. A pair that has n-grams
    in common among the first of both documents is reported where the first of these is, and nowhere else."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        k, s, c = _join(t["k"], np.int64), _join(t["size"], np.int32).astype(np.int64), _join(t["count"], np.int32)
        first, g = _join(t["first"], np.uint64).reshape(-1, FIRST), _wide(b"".join(t["grams"].to_pylist()), 6)
        far, g = (g >> np.uint64(40)).astype(np.int64), g & _FORTY
        crowd = _join(t["crowd"], np.int64).reshape(-1, 3)
        number = np.lexsort((crowd[:, 1], crowd[:, 0]))  # documents by crowd, then score
        place = np.empty(len(k), np.int64)
        place[number] = np.arange(len(k))
        doc = np.repeat(np.arange(len(k)), c)
        order = np.lexsort((place[doc], g))
        g, doc = g[order], doc[order]
        after = s[doc] - far[order] * s[doc] // 255  # n-grams from this one on, or some more
        size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g)))
        many = np.repeat(size > 1, size)
        g, doc, after, size = g[many], doc[many], after[many], size[size > 1]
        end = np.repeat(np.cumsum(size), size)
        which, score, most = (crowd[doc, i] for i in range(3))
        run_ = np.cumsum(np.concatenate(([True], (which[1:] != which[:-1]) | (g[1:] != g[:-1])))) if len(g) else np.zeros(0, np.int64)
        # partners of a document come after it: those of its crowd whose score is too large, then those of other crowds
        each = np.unique(score)
        run_ *= len(each) + 1
        start = np.searchsorted(run_ + np.searchsorted(each, score), run_ + np.searchsorted(each, most - score, "right") - 1, "right")
        start = np.maximum(start, np.arange(1, len(g) + 1))
        names, number = np.unique(k, return_inverse=True)
        found, met = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in _pairs(start, end):
            at, rest, i, j = g[i], np.minimum(after[i], after[j]), doc[i], doc[j]
            ok = (np.minimum(s[i], s[j]) >= _least(np.maximum(s[i], s[j]), threshold)) & (k[i] != k[j])
            at, rest, i, j = at[ok], rest[ok], i[ok], j[ok]
            common = (first[i][:, :, None] == first[j][:, None, :]).any(2)
            # a link's first n-gram in common leaves enough n-grams in both orders for all that it needs
            enough = rest >= _least(s[i] + s[j], threshold / (1 + threshold))
            ok = np.where(common.any(1), first[i, common.argmax(1)] & _FORTY == at, enough)
            i, j = number[i[ok]], number[j[ok]]
            pair, first_ = np.unique(np.minimum(i, j) * len(names) + np.maximum(i, j), return_index=True)
            found.append(pair)
            met.append(at[ok][first_])
        pair, first_ = np.unique(np.concatenate(found), return_index=True)
        n = max(len(names), 1)
        return pa.table({"a": pa.array(names[pair // n] if len(pair) else pair, pa.int64()), "b": pa.array(names[pair % n] if len(pair) else pair, pa.int64()), "met": pa.array(np.concatenate(met)[first_].astype(np.int64))})

    return run, "a long, b long, met long"


# --------------------------------------------------------------------------- 4. partial overlaps


def _grams(n: int, parts: int, coarse: bool):
    """Documents -> the n-grams of each (48 bits), by fragment; ``coarse``: 16 bits of every other n-gram, in one fragment."""
    names = ["k", "weight", "total", "part", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            keys, weight = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            row, part, grams_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            total = np.zeros(len(keys), np.int64)
            for i, g, doc in sets(b.column(1), n):
                total += np.bincount(doc + i, minlength=len(keys))
                if coarse:
                    g, doc = g[g & np.uint64(1) == 0] >> np.uint64(1), doc[g & np.uint64(1) == 0]
                where = (doc + i) * parts + (0 if coarse else _fragment(g, parts))
                order = np.argsort(where, kind="stable")
                g, where = g[order], where[order]
                head = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(g) else np.zeros(0, int)
                row.append(where[head] // parts)
                part.append(where[head] % parts)
                grams_ += [_narrow(g[s:e], 2 if coarse else 6) for s, e in zip(head, np.append(head[1:], len(g)).astype(int))]
            row, part = np.concatenate(row), np.concatenate(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(weight[row]), pa.array(total[row]), pa.array(part.astype(np.int32)), pa.array(grams_, pa.binary())], names=names)

    return run, "k long, weight long, total long, part int, grams binary"


_LIMIT = 500_000  # rows looked up at a time
_PARTIAL = "a long, b long, met long, overlap long, size_a long, size_b long, total_a long, total_b long, weight_a long, weight_b long"


def _overlaps(coarse: bool):
    """A block's documents and candidate pairs -> of each pair the partial overlap in one fragment, and the partial and whole sizes
    and the weights of both sets."""

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        trim()
        width = 2 if coarse else 6
        k, weight, total = (docs[c].to_numpy() for c in ("k", "weight", "total"))
        c, g = pc.binary_length(docs["grams"]).to_numpy() // width, _wide(b"".join(docs["grams"].to_pylist()), width)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        names, at = np.unique(np.concatenate([k, a, b]), return_index=True)
        weight, total = (np.concatenate([x, np.zeros(2 * len(a), np.int64)])[at] for x in (weight, total))  # a document may have nothing in this fragment
        fa, fb = np.searchsorted(names, a).astype(np.int32), np.searchsorted(names, b).astype(np.int32)
        owner = np.repeat(np.searchsorted(names, k).astype(np.int32), c)
        size = np.bincount(owner, minlength=len(names))
        out = np.zeros(len(a), np.int32)
        piece = mix(g) % np.uint64(PIECES)
        for p in range(PIECES):  # a piece of the fragment at a time, so that a large block takes little memory
            mine = piece == p
            _add_overlaps(out, owner[mine], g[mine], fa, fb, len(names))
        return pa.table({"a": a, "b": b, "met": pairs["met"], "overlap": out.astype(np.int64), "size_a": size[fa], "size_b": size[fb], "total_a": total[fa], "total_b": total[fb], "weight_a": weight[fa], "weight_b": weight[fb]})

    return run


def _add_overlaps(out: np.ndarray, owner: np.ndarray, g: np.ndarray, fa: np.ndarray, fb: np.ndarray, docs: int) -> None:
    """Add to each pair (fa, fb) of documents how many of these n-grams both have."""
    if not len(g):
        return
    uniq, rank = np.unique(g, return_inverse=True)
    n = len(uniq)
    code = np.sort(owner * np.int64(n) + rank)  # by document, then n-gram
    start = np.searchsorted(code, np.arange(docs + 1) * np.int64(n))
    rank = (code % n).astype(np.int32)
    size = np.diff(start)
    at, step = 0, 50_000
    while at < len(out):
        x, y = fa[at : at + step], fb[at : at + step]
        swap = size[x] > size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        upto = np.cumsum(size[x])
        m = max(1, int(np.searchsorted(upto, _LIMIT, "right")))
        x, y = x[:m], y[:m]
        many = size[x]
        row = np.repeat(np.arange(len(x)), many)
        src = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + start[x[row]]
        want = y[row] * np.int64(n) + rank[src]
        hit = code[np.searchsorted(code, want).clip(max=len(code) - 1)] == want
        out[at : at + len(x)] += np.bincount(row[hit], minlength=len(x)).astype(np.int32)
        at += len(x)


def _tops(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, each with the smallest node that these connect it to."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    top = np.arange(len(names))
    while True:
        x, y = top[u], top[v]
        apart = x != y
        if not apart.any():
            return names, names[top]
        u, v = u[apart], v[apart]
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := top[top], top):
            top = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges as many as connect the same nodes: each node with the smallest one."""
    a = b = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > 1_000_000:
            a, b = _tops(np.concatenate([a, *[x for x, _ in held]]), np.concatenate([b, *[y for _, y in held]]))
            held = []
    a, b = _tops(np.concatenate([a, *[x for x, _ in held]]), np.concatenate([b, *[y for _, y in held]]))
    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(k, comp): each node of ``edges`` (a, b) with the smallest node it is connected to: in one task where the edges that
    are left of each partition are counted to be few, else by alternating large and small stars."""
    few = edges.select("a", "b").mapInArrow(_forest, "a long, b long")
    e = cut(few)
    if e.count() <= BROADCAST_ROWS:
        e = cut(e.coalesce(1).mapInArrow(_forest, "a long, b long"))
        return e.select(F.col("a").alias("k"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("k"), F.col("b").alias("comp")).distinct())
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(x: DataFrame, large: bool) -> DataFrame:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else x
        least = both.groupBy("u").agg(F.min("v").alias("m"))  # combined before the shuffle: a node may have any number of edges
        m = both.join(least, "u").select("u", "v", F.least("m", "u").alias("m"))
        if large:  # link the larger neighbours to the smallest
            return m.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return m.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    last = None
    while True:
        e = cut(star(star(e, True), False))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last is not None and (now["n"], now["h"]) == last:
            break
        last = (now["n"], now["h"])
    tops = e.select(F.col("v").alias("k")).distinct()
    return e.select(F.col("u").alias("k"), F.col("v").alias("comp")).unionByName(tops.select("k", F.col("k").alias("comp"))).distinct()


# --------------------------------------------------------------------------- the join


def _with(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on a key, sending ``right`` to all executors only where it is counted to be small."""
    few = right.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right.hint("shuffle_hash"), on, how)


def _counted(texts: DataFrame, pairs: DataFrame, n: int, coarse: bool) -> DataFrame:
    """The partial overlaps of the candidates (a, b, met), by blocks of pairs and fragments."""
    parts = 1 if coarse else PARTS
    # pairs that met in one n-gram stand together, by blocks of both of their documents where they are many
    sizes = cut(pairs.groupBy("met").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > BLOCK))
    slots = max(shuffle_partitions(texts.sparkSession), -(-pairs.count() // BLOCK))
    side = F.coalesce(F.ceil(F.sqrt(F.col("pairs") / BLOCK)).cast("long"), F.lit(1))
    own = [F.pmod(F.xxhash64(c), side) for c in ("a", "b")]
    block = F.pmod(F.xxhash64("met", F.least(*own), F.greatest(*own)), F.lit(slots)).cast("int")
    pairs = cut(_with(pairs, sizes, "met", "left").select("a", "b", "met", block.alias("block")))
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("k"), "block").distinct())
    f, schema = _grams(n, parts, coarse)
    grams_ = _with(texts.select("k", TEXT, "weight"), cut(ends.select("k").distinct()), "k").select("k", TEXT, "weight").mapInArrow(f, schema)
    # as many partitions as blocks, whatever their bytes: pairs take more time than room
    left = _with(cut(grams_), ends, "k").select(F.col("block").alias("block"), "part", "k", "weight", "total", "grams").repartition(slots, "block", "part")
    right = pairs.select("a", "b", "met", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(slots, "block", "part")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_overlaps(coarse), _PARTIAL)


def _verified(texts: DataFrame, cand: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of the candidates (a, b, met) those that are links, with their partial overlaps summed: (a, b, overlap, size_a, size_b, weight_a, weight_b).

    A look at 16 bits of half of the n-grams comes first: these overlap as much as the n-grams themselves at least, so a pair goes on
    if it could be a link with all of the other half in common."""
    most = F.col("overlap") + F.least(F.col("total_a") - F.col("size_a"), F.col("total_b") - F.col("size_b"))
    enough = lambda overlap, a, b: overlap >= (F.col(a) + F.col(b) - overlap) * F.lit(threshold) - F.lit(1e-9)
    # a document without an n-gram in the half has sizes of 0 here: it goes on
    maybe = enough(most, "total_a", "total_b") | (F.col("total_a") == 0) | (F.col("total_b") == 0)
    pairs = cut(_counted(texts, cut(cand), n, True).where(maybe).select("a", "b", "met"))
    sums = _counted(texts, pairs, n, False).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("overlap", "size_a", "size_b")], *[F.max(c).alias(c) for c in ("weight_a", "weight_b")])
    return sums.where(enough(F.col("overlap"), "size_a", "size_b"))


def _found(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, use: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The documents (k, id, rep, rep_id, weight), the crowds and the other links of representatives, as ``_verified`` gives them.

    ``use``: "links" takes what crowds tell for certain and finds all other links; "classes" finds what connects documents, so that
    links between documents that the crowd connects already are passed over; "pairs" finds all links one by one."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    keyed = _keyed(docs, id_col, text_col)
    f, schema = _post_all(n, parts)
    f2, schema2 = _shared(parts)
    one = cut(keyed.mapInArrow(f, schema).groupBy("part").applyInArrow(f2, schema2))
    each = cut(one.where("home >= 0").groupBy("home").applyInArrow(_sum_shared, "k long, id long, size long, shared long, s1 long, s2 long, minima array<long>"))
    sig = ["s1", "s2", "size"]
    least = each.groupBy(*sig).agg(F.min(F.struct("id", "k")).alias("m"), F.count(F.lit(1)).alias("weight")).select(*sig, F.col("m.id").alias("rep_id"), F.col("m.k").alias("rep"), "weight")
    each = cut(each.join(least, sig).select("k", "id", "size", "shared", "minima", "rep", "rep_id", "weight"))
    enough = F.col("shared") >= F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9))
    rep = each.where((F.col("k") == F.col("rep")) & (F.col("size") > 0) & enough).select("k", "weight", "minima")
    texts = cut(_with(keyed.select("k", TEXT), rep.select("k", "weight"), "k").dropDuplicates(["k"]))
    crowds = _crowds(texts, rep, n, threshold) if use != "pairs" else None
    if crowds is None:
        of = texts.select("k", TEXT, F.col("k").alias("crowd"), F.lit(_ALONE).alias("score"), F.lit(0).cast("long").alias("most"))
    else:
        own = crowds.select("k", "crowd", "score", "most")
        if use == "classes":  # all that the crowd connects count as linked to each other
            stars = _stars(crowds)
            own = cut(stars.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(own, "k").select("k", "crowd", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("most")))
        of = _with(texts.select("k", TEXT), own, "k", "left").select("k", TEXT, F.coalesce("crowd", "k").alias("crowd"), F.coalesce("score", F.lit(_ALONE)).alias("score"), F.coalesce("most", F.lit(0)).alias("most"))
    hot = one.where("home = -1").select("grams", "count").mapInArrow(_unpack_frequent, "gram long, df long").orderBy(F.desc("df"), "gram").limit(FREQUENT).toArrow()
    gram, df = hot["gram"].to_numpy().astype(np.uint64), hot["df"].to_numpy()
    order = np.argsort(gram)
    f, schema = _post_prefix(n, threshold, max(1, parts // 2), spark.sparkContext.broadcast((gram[order], df[order])), parts)
    f2, schema2 = _candidates(threshold)
    cand = of.mapInArrow(f, schema).groupBy("part").applyInArrow(f2, schema2).groupBy("a", "b").agg(F.min("met").alias("met"))
    return each, crowds, _verified(texts, cand, n, threshold)


def _null(c):
    """Identifiers were made comparable by taking null for the largest; this takes them back."""
    return F.when(c == F.lit(_LAST), F.lit(None)).otherwise(c)


def _classes(each: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, comp, class): of the representatives that have links, the smallest identifier among all that they are connected to."""
    comp = cut(components(edges))
    own = _with(each.where("k = rep").select("k", "rep_id"), comp, "k")
    least = own.groupBy("comp").agg(F.min(F.struct("rep_id", "k")).alias("m")).select("comp", F.col("m.rep_id").alias("class_id"), F.col("m.k").alias("first"))
    return _with(comp.withColumnRenamed("k", "rep"), cut(least), "comp")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of all documents: how many other documents each is linked to, copies and all, and the smallest
    identifier of those that it is connected to by links."""
    each, crowds, found = _found(docs, n, threshold, id_col, text_col, "links")
    found = cut(found.select("a", "b", "weight_a", "weight_b"))
    classes = cut(_classes(each, found.select("a", "b").unionByName(_stars(crowds))))
    count = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("weight_b").alias("links")), F.struct(F.col("b").alias("rep"), F.col("weight_a").alias("links"))))
    near = found.select(count.alias("x")).select("x.*").unionByName(_certain(crowds).withColumnRenamed("k", "rep")).groupBy("rep").agg(F.sum("links").alias("links"))
    info = cut(classes.join(near, "rep", "left").select("rep", "class_id", "links"))
    out = _with(each.select("id", "rep", "rep_id", "weight"), info, "rep", "left")
    n_links = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
    return out.select(_null(F.col("id")).alias("doc_id"), _null(F.coalesce("class_id", "rep_id")).alias("class_id"), n_links.cast("long").alias("n_links"))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(left_id, right_id, jaccard) of all linked pairs of different sets, each set represented by the smallest identifier that has it.
    Their number grows with the square of a crowd of near copies; ``links`` tells the same in a row per document."""
    each, _, found = _found(docs, n, threshold, id_col, text_col, "pairs")
    rep = each.where("k = rep").select("k", "id")
    j = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    pairs = found.select("a", "b", F.round(j, 6).alias("jaccard"))
    for c in ("a", "b"):
        pairs = pairs.join(rep.select(F.col("k").alias(c), F.col("id").alias(f"id_{c}")), c)
    return pairs.select(_null(F.least("id_a", "id_b")).alias("left_id"), _null(F.greatest("id_a", "id_b")).alias("right_id"), "jaccard")


def dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of connected documents, that of the smallest identifier; the columns stay as they are."""
    each, crowds, found = _found(docs, n, threshold, id_col, text_col, "classes")
    classes = cut(_classes(each, found.select("a", "b").unionByName(_stars(crowds))))
    all_ = _with(each.select("k", "id", "rep"), classes.select("rep", "first"), "rep", "left")
    out = cut(all_.where(F.col("k") != F.coalesce("first", "rep")).select("k", "id"))
    k, i = fresh(docs, "k"), fresh(docs, "i")
    number = F.col(f"`{id_col}`").cast("long")
    own = docs.withColumns({k: F.xxhash64(number, F.col(f"`{text_col}`").cast("string")), i: F.coalesce(number, F.lit(_LAST))})
    lost = out.select(F.col("k").alias(f"{k}r"), F.col("id").alias(f"{i}r"))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost.hint("shuffle_hash")
    return own.join(lost, (F.col(k) == F.col(f"{k}r")) & (F.col(i) == F.col(f"{i}r")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

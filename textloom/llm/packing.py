"""Best-fit packing planned over the length histogram.

Documents are cut into pieces of at most ``capacity`` words. The plan is made from the histogram of piece
lengths alone: lengths go from long to short, and as many pieces of a length as fit go at once into the
fullest open packs that can hold them, so the work depends on ``capacity`` and not on the documents. A plan
row says: the pieces of this length with ranks lo <= rank < hi go to the packs from ``pack`` on, at ``at``.
Pieces then take their places by joining on length and rank.

Defined results: null, empty and blank texts have no words and get no place; repeated rows are pieces of
their own; ties within a length are ordered by (hash, identifier, piece); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, cut, n_words, narrow

CAPACITY = 2048
BUCKETS = 16
_PLAN = "len long, lo long, hi long, pack long, at long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (len, lo, hi, first pack, offset) of a best-fit-decreasing packing of ``histogram``."""
    rows, packs = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first pack, packs)
    for n in sorted(histogram, reverse=True):
        todo, rank = histogram[n], 0

        def fill(space: int, first: int, many: int) -> None:
            """Pieces into a range of equal packs: the fullest pack is filled as far as it goes before the next is begun."""
            nonlocal todo, rank
            full, rest = divmod(min(todo, many * (space // n)), space // n)
            for width, at, count in ((space // n, first, full), (rest, first + full, 1 if rest else 0)):
                for j in range(width if count else 0):
                    rows.append((n, rank, rank + count, at, capacity - space + j * n))
                    rank, todo = rank + count, todo - count
                if count and space - width * n:
                    free.setdefault(space - width * n, []).append((at, count))
            used = full + (1 if rest else 0)
            if used < many:
                free.setdefault(space, []).append((first + used, many - used))

        for space in sorted(s for s in free if s >= n):
            ranges = free.pop(space)
            while ranges and todo:
                fill(space, *ranges.pop())
            if ranges:
                free.setdefault(space, []).extend(ranges)
            if not todo:
                break
        if todo:
            new = -(-todo // (capacity // n))
            first, packs = packs, packs + new
            fill(capacity, first, new)
    return rows


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, piece, start, len): the documents cut into pieces of at most ``capacity`` words."""
    n = narrow(docs, id_col, text_col).select(ID, n_words(F.col(TEXT)).alias("n")).where("n > 0")
    many = F.ceil(F.col("n") / F.lit(capacity)).cast("long")
    cutup = n.select(ID, "n", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return cutup.select(ID, "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("long").alias("len"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its place: (pack_id, pack_offset, doc_id, piece, start_word, n_words)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64(ID, "piece"), F.lit(BUCKETS)).cast("int").alias("bucket")
    p = cut(pieces(docs, capacity, id_col, text_col).select("*", bucket))
    # at most capacity * BUCKETS counts, however large the corpus
    counts = {(r["len"], r["bucket"]): r["count"] for r in p.groupBy("len", "bucket").count().collect()}
    histogram: dict[int, int] = {}
    before = []
    for (n, b), c in sorted(counts.items()):
        before.append((n, b, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + c
    rows = plan(histogram, capacity)
    # the rank within a length: the earlier buckets' count and the rank within the bucket, so a hot length is spread
    w = Window.partitionBy("len", "bucket").orderBy(F.col(ID).asc_nulls_last(), "piece")
    local = p.select("*", (F.row_number().over(w) - 1).cast("long").alias("r"))
    offsets = spark.createDataFrame(before, "len long, bucket int, before long")
    ranked = local.join(F.broadcast(offsets), ["len", "bucket"]).select(ID, "piece", "start", "len", (F.col("r") + F.col("before")).alias("rank"))
    # the plan's size depends on capacity alone (checked: beyond 200,000 rows the plan is joined without broadcast)
    slots = spark.createDataFrame(rows, _PLAN)
    slots = F.broadcast(slots) if len(rows) <= 200_000 else slots
    placed = ranked.join(slots, (ranked["len"] == slots["len"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"]))
    return placed.select(
        (slots["pack"] + ranked["rank"] - slots["lo"]).alias("pack_id"), slots["at"].alias("pack_offset"), ranked[ID].alias("doc_id"), ranked["piece"], ranked["start"].alias("start_word"), ranked["len"].alias("n_words")
    )

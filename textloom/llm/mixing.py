"""Mixing sources to target weights by the cube method.

Every source gets the inclusion probability that brings its words to its target share. The flight phase then
moves the probabilities of three documents at a time along the null space of the balancing constraints
(number of documents, number of words), which fixes one of them at 0 or 1 and leaves both totals as they
were. It runs in independent buckets of a source; the at most two open documents of each bucket fly again
within the source, and the at most two left per source land by giving up the word constraint and then the count.

The sample is as large as the weights allow without repeating a document: its budget is the largest at which the
sources that cannot reach their share hold at most ``SHORT`` of all words (of the weight, where weights are given).
These are taken whole and fall short of their share; the others share out the rest by weight. Without given
weights the budget is at least ``KEEP`` of all words, whatever the number of small sources; still more of
these may then fall short.

Defined results: null sources are a source of their own; null, empty and blank texts have 0 words and take part in the document count; rows that
repeat identifier, source and text are one unit; sources without words, or without a weight, give nothing;
an empty table gives none. The draw depends on ``seed`` and the documents alone, not on their partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, cut, fresh, n_words, narrow, shuffle_partitions

BUCKETS = 256
ALPHA = 0.5
SHORT = 0.01
KEEP = 0.5
_EPS = 1e-9


def _source(col):
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(__id, h, src, words, rows): the documents as units of the draw."""
    d = narrow(docs, id_col, text_col, __s=source_col)
    d = d.select(ID, F.xxhash64(TEXT).alias("h"), _source(F.col("__s")).alias("src"), n_words(F.col(TEXT)).alias("w"))
    return d.groupBy(ID, "h", "src").agg(F.sum("w").cast("double").alias("words"), F.count(F.lit(1)).cast("double").alias("rows"))


def step(p: list[float], a: list[float], b: list[float], rng: random.Random) -> None:
    """Move three probabilities along the null space of the constraints with coefficients a and b, till one is 0 or 1."""
    u = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    if max(map(abs, u)) < _EPS:  # proportional constraints: two documents are enough
        u = [a[1], -a[0], 0.0]
    up = down = float("inf")
    for x, v in zip(p, u):
        if v > _EPS:
            up, down = min(up, (1 - x) / v), min(down, x / v)
        elif v < -_EPS:
            up, down = min(up, x / -v), min(down, (1 - x) / -v)
    t = up if rng.random() * (up + down) < down else -down
    for i, v in enumerate(u):
        x = p[i] + t * v
        p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def land(left: list[list], rng: random.Random) -> None:
    """Decide the last documents of a source: first keeping the count in expectation and total, then by a draw."""
    left = [u for u in left if 0 < u[0] < 1]
    while len(left) > 1:
        x, y = left[0], left[1]
        s = x[0] + y[0]
        if s <= 1:
            x[0], y[0] = (s, 0.0) if rng.random() * s < x[0] else (0.0, s)
        else:
            x[0], y[0] = (1.0, s - 1) if rng.random() * (2 - s) < 1 - y[0] else (s - 1, 1.0)
        left = [u for u in left if _EPS < u[0] < 1 - _EPS]
    for u in left:
        u[0] = 1.0 if rng.random() < u[0] else 0.0


def flight(seed: int, final: bool):
    """Rows sorted by group -> the same rows with moved probabilities; those at 0 are dropped. Three rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rng = None, random.Random(0)
        hold: list[list] = []
        for batch in batches:
            out: list[list] = []
            names = batch.schema.names
            g, p = names.index("grp"), names.index("p")
            pi, words, rows = names.index("pi"), names.index("words"), names.index("rows")

            def close():
                if final:
                    land(hold, rng)
                out.extend(u for u in hold if u[0] > 0)

            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[g] != group:
                    close()
                    hold, group = [], row[g]
                    rng = random.Random(f"{seed}:{final}:{group}")
                hold.append([row[p], row[rows] / row[pi], row[words] / row[pi], row])
                if len(hold) == 3:
                    ps = [u[0] for u in hold]
                    step(ps, [u[1] for u in hold], [u[2] for u in hold], rng)
                    for u, x in zip(hold, ps):
                        u[0] = x
                    out.extend(u for u in hold if u[0] >= 1)
                    hold = [u for u in hold if 0 < u[0] < 1]
            yield _batch(out, batch.schema, p)
        out = []
        if hold:
            if final:
                land(hold, rng)
            yield _batch([u for u in hold if u[0] > 0], batch.schema, p)

    return run


def _batch(units_: list[list], schema: pa.Schema, p: int) -> pa.RecordBatch:
    rows = [(*u[3][:p], min(1.0, u[0]), *u[3][p + 1 :]) for u in units_]
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def probabilities(u: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """(src, pi) of each source: 1 where it falls short of its share, words shared out by the weights among the others."""
    t = u.groupBy("src").agg(F.sum("words").alias("total")).where("total > 0")
    if weights is None:
        t = t.withColumn("weight", F.pow("total", F.lit(alpha)))
    else:
        rows = [("" if k is None else f"={k}", float(v)) for k, v in weights.items() if v > 0]
        t = t.join(u.sparkSession.createDataFrame(rows, "src string, weight double"), "src")
    # a source is whole at the level (words per weight) full; the sums run over the sources in this order
    t = t.withColumn("full", F.col("total") / F.col("weight"))
    by = Window.orderBy("full", "src")
    here, ever = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("*", *[F.sum(c).over(w).alias(f"{c}_{n}") for c in ("total", "weight") for n, w in (("here", here), ("ever", ever))])
    of = "total" if weights is None else "weight"
    level = F.min(F.when(F.col(f"{of}_here") > F.lit(SHORT) * F.col(f"{of}_ever"), F.col("full")))
    if weights is None:
        words = F.lit(KEEP) * F.col("total_ever")
        rest = F.col("weight_ever") - F.col("weight_here")
        enough = F.col("total_here") + F.col("full") * rest >= words
        level = F.greatest(level, F.min_by((words - F.col("total_here") + F.col("total")) / (rest + F.col("weight")), F.when(enough, F.struct("full", "src"))))
    return t.crossJoin(F.broadcast(t.agg(level.alias("level")))).select("src", F.least(F.lit(1.0), F.col("weight") * F.col("level") / F.col("total")).alias("pi"))


def draw(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The units drawn: (__id, h, src, words, rows, pi). Without ``weights``, a source weighs its words to the power ``alpha``."""
    n = shuffle_partitions(docs.sparkSession)
    u = cut(units(docs, id_col, text_col, source_col))
    x = u.join(probabilities(u, weights, alpha), "src").where("pi > 0")
    cols = [ID, "h", "src", "words", "rows", "pi"]
    sure = x.where(F.col("pi") >= 1 - _EPS).select(*cols)
    order = F.xxhash64(F.col(ID), F.col("h"), F.lit(seed)).alias("o")
    open_ = x.where(F.col("pi") < 1 - _EPS).select(*cols, F.col("pi").alias("p"), order)
    open_ = open_.withColumn("grp", F.concat_ws(":", F.pmod("o", F.lit(BUCKETS)), "src"))
    flown = open_.repartition(n, "grp").sortWithinPartitions("grp", "o", ID, "h")
    flown = cut(flown.mapInArrow(flight(seed, False), flown.schema))
    again = flown.where("p < 1").withColumn("grp", F.col("src"))
    again = again.repartition("grp").sortWithinPartitions("grp", "o", ID, "h")
    landed = again.mapInArrow(flight(seed, True), again.schema)
    return sure.unionByName(flown.where("p >= 1").select(*cols)).unionByName(landed.where("p >= 1").select(*cols))


def sample(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with only the drawn documents; the columns stay as they are."""
    got = cut(draw(docs, weights, alpha, seed, id_col, text_col, source_col))
    names = {k: fresh(docs, k) for k in (ID, "h", "src")}
    own = docs.withColumns({names[ID]: F.col(f"`{id_col}`").cast("long"), names["h"]: F.xxhash64(F.col(f"`{text_col}`").cast("string")), names["src"]: _source(F.col(f"`{source_col}`"))})
    r = got.select(*[F.col(k).alias(f"{names[k]}r") for k in names]).hint("shuffle_hash")
    cond = own[names[ID]].eqNullSafe(r[f"{names[ID]}r"])
    for k in ("h", "src"):
        cond = cond & (own[names[k]] == r[f"{names[k]}r"])
    return own.join(r, cond, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def selection(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The draw as a report: (doc_id, source, n_words, n_rows, inclusion)."""
    got = draw(docs, weights, alpha, seed, id_col, text_col, source_col)
    source = F.when(F.col("src") == "", F.lit(None)).otherwise(F.substring("src", 2, 1 << 20))
    return got.select(F.col(ID).alias("doc_id"), source.alias("source"), F.col("words").cast("long").alias("n_words"), F.col("rows").cast("long").alias("n_rows"), F.round("pi", 6).alias("inclusion"))

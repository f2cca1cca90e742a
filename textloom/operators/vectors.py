"""Nearest neighbours by angle, and suggestions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.cooc import partitions

#: Vectors of a block of the exact search, and queries that are compared at once.
BLOCK, STRIP = 16384, 256
#: Strings of a partition, where suggestions get theirs.
STRINGS = 25_000
#: How much a neighbour of a cosine near 0.4 leans to its query's side of a plane, by the logistic curve.
LEAN = 0.8


def angular(cosine: Column) -> Column:
    """Distance of unit vectors with this cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * (1.0 - cosine)))


def nonzero(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as a native expression."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that have a direction."""
    v = F.col(vector)
    d = df.where(v.isNotNull() & nonzero(v) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return d.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix of unit vectors."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(k: int, itself: bool):
    """From the queries and the vectors of a group to the ``k`` best of these for each of those, in memory that is bounded by the
    vectors: the queries go by strips."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and index.num_rows:
            ids, xs = index["id"].to_numpy(), _matrix(index["v"]).T
            for i in range(0, queries.num_rows, STRIP):
                q = queries.slice(i, STRIP)
                own = q["id"].to_numpy()
                sim = np.round(_matrix(q["v"]) @ xs, 9)
                if not itself:
                    sim[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(sim, -k, axis=1)[:, -k, None] if k < len(ids) else -np.inf
                r, c = np.nonzero((sim >= least) & np.isfinite(sim))
                s = sim[r, c]
                order = np.lexsort((ids[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                parts.append((own[r[keep]], ids[c[keep]], s[keep]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["query", "neighbour", "cos"])

    return run


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("cos"), "neighbour")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.select("query", "neighbour", "rank", F.round(angular(F.col("cos")), 6).alias("distance"))


def neighbours(index: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, itself: bool = False) -> DataFrame:
    """(query, neighbour, rank, distance): the ``k`` nearest of the index for every query, exactly; ties by identifier.

    Both sides are cut into blocks of some ``BLOCK`` vectors, by the hash of the identifier, as many as there are rows for; each pair
    of blocks is a group of its own and keeps k per query, and the blocks' answers are merged per query. So a task holds two
    blocks at a time, however many rows there are, and rows cross the network once per block of the other side and not n times."""
    x, q = _usable(index, id_col, vector), _usable(queries, id_col, vector)
    xs, qs = (max(1, -(-d.count() // BLOCK)) for d in (x, q))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = q.select("id", "v", place(qs).alias("a")).withColumn("b", every(xs))
    right = x.select("id", "v", place(xs).alias("b")).withColumn("a", every(qs))
    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_best(k, itself), "query long, neighbour long, cos double")
    return _ranked(near, k)


def _planes(dimension: int, bits: int, seed: int) -> np.ndarray:
    """Orthogonal directions, as columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))[0][:, :bits]


def approximate_neighbours(index: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, bits: int = 6, probe: float = 0.85, seed: int = 1) -> DataFrame:
    """The same by locality-sensitive hashing: every vector of the index stands in one of 2^``bits`` buckets, by the sides of as many
    random orthogonal planes that it is on, and a query looks into the share ``probe`` of the buckets that its neighbours
    are likeliest in, told from its distances to the planes; what stands in the others is missed.

    Each vector of the index crosses the network once and each query once per bucket that it looks into; a bucket is one group, and
    the candidates of a query are compared there and not listed. Vectors without structure need so large a share: of
    their neighbours, two in five stand beyond any one plane."""
    x, q = _usable(index, id_col, vector), _usable(queries, id_col, vector)

    def hashed(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                side = m @ _planes(m.shape[1], min(bits, m.shape[1]), seed) > 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(side @ (1 << np.arange(side.shape[1])), pa.int32())], names=["id", "v", "bucket"])

    def probed(batches):
        for b in batches:
            for i in range(0, b.num_rows, STRIP):
                s = b.slice(i, STRIP)
                m = _matrix(s.column(1))
                planes = _planes(m.shape[1], min(bits, m.shape[1]), seed)
                z = LEAN * np.sqrt(m.shape[1]) * (m @ planes)
                one = np.arange(1 << planes.shape[1])[:, None] >> np.arange(planes.shape[1]) & 1
                likely = -np.logaddexp(0, -z) @ one.T - np.logaddexp(0, z) @ (1 - one).T
                n = max(1, int(np.ceil(probe * len(one))))
                bucket = np.argsort(-likely, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(s.num_rows), n))
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in s.columns], pa.array(bucket.ravel(), pa.int32())], names=["id", "v", "bucket"])

    kind = f"id long, v {x.schema['v'].dataType.simpleString()}, bucket int"
    left, right = q.mapInArrow(probed, kind), x.mapInArrow(hashed, kind)
    return _ranked(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_best(k, False), "query long, neighbour long, cos double"), k)


def suggest(near: DataFrame, ambiguity: DataFrame, strings: DataFrame, k: int, raw: DataFrame | None = None, translations: DataFrame | None = None) -> DataFrame:
    """Of each query's neighbours the ``k`` least ambiguous (unknown ambiguity first), with their strings.

    ``ambiguity`` is (id, score), ``strings`` (id, text). With ``raw`` (id, raw), the raw strings of a clean one, come ``raws``, and with
    ``translations`` (left, others), an index of counts, ``translations``: text, raws and share of each, the largest first."""
    j = near.join(ambiguity.select(F.col("id").alias("neighbour"), "score"), "neighbour", "left")
    w = Window.partitionBy("query").orderBy(F.asc_nulls_first("score"), "rank")
    j = j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    named = strings.select(F.col("id").alias("neighbour"), "text").repartition(partitions(strings, STRINGS), "neighbour")
    out = j.join(named, "neighbour", "left").select("query", "place", "neighbour", "distance", "score", "text")
    named = strings.select("id", "text")
    if raw is not None:
        raws = raw.groupBy("id").agg(F.array_sort(F.collect_set("raw")).alias("raws"))
        named = named.join(raws, "id", "left")
        out = out.join(raws.withColumnRenamed("id", "neighbour"), "neighbour", "left")
    if translations is not None:
        each = out.select(F.col("neighbour").alias("left")).distinct().join(translations, "left")
        each = each.select("left", F.explode("others").alias("o"), F.aggregate("others", F.lit(0).cast("long"), lambda s, o: s + o["count"]).alias("all"))
        each = each.select("left", F.col("o.other").alias("id"), (F.col("o.count") / F.col("all")).alias("share")).join(named, "id", "left")
        item = F.struct((-F.col("share")).alias("order"), "id", *[c for c in named.columns if c != "id"], "share")
        lists = each.groupBy("left").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("order")).alias("translations"))
        out = out.join(lists.withColumnRenamed("left", "neighbour"), "neighbour", "left")
    return out.select("query", "place", "neighbour", "distance", "score", "text", *[c for c in ("raws", "translations") if c in out.columns])


def sentence_vectors(df: DataFrame, tokens: str, size: int = 100, min_count: int = 5, passes: int = 1, seed: int = 1, partitions: int = 1) -> DataFrame:
    """``df`` with ``vector``: the mean of word vectors trained on the same sentences (lists of tokens)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    m = Word2Vec(vectorSize=size, minCount=min_count, maxIter=passes, seed=seed, numPartitions=partitions, inputCol=tokens, outputCol="__v").fit(df)
    return m.transform(df).withColumn("vector", vector_to_array("__v", "float32")).drop("__v")

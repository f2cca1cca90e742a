"""Grouping, deduplication and hash-indexed tables of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.hashing import murmur64a, unsigned_order
from textloom.functions.text import clean_tokens, english_locale, has_tokens
from textloom.lineage import cut


def key_groups(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key with its values as a list in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(*[r[v].alias(v) for v in values])).alias("items"))


def first_run(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the first contiguous run of each key; later runs of a key go.

    Neighbours are found by a range-partitioned order, not in one partition: a row belongs to its key's first run if no
    row of another key lies between the key's first row and it, that is if its place within its key and its
    place among all rows advance together."""
    place = ordinal(df, [order], "__pos")
    w = Window.partitionBy(key).orderBy("__pos")
    start = F.min("__pos").over(Window.partitionBy(key))
    place = place.withColumn("__n", F.row_number().over(w)).withColumn("__start", start)
    return place.where(F.col("__pos") - F.col("__start") == F.col("__n") - 1).drop("__pos", "__n", "__start")


def ordinal(df: DataFrame, order: list[str | Column], name: str, buckets: int = 1024) -> DataFrame:
    """Number the rows from 0 in an order, distributed: rows are cut into ranges of the order, numbered within each, and
    shifted by the counts of the ranges before."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    parts = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    # cut, since the ranges come from a sample and a second evaluation could draw others
    tmp = cut(df.repartitionByRange(parts, *cols).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*cols)
    counts = tmp.groupBy("__part").count()  # at most ``buckets`` rows
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    shift = F.broadcast(counts.select("__part", before))
    return tmp.withColumn("__rn", F.row_number().over(w)).join(shift, "__part").withColumn(name, (F.col("__rn") - 1 + F.col("__before")).cast("long")).drop("__part", "__rn", "__before")


def duplicate_mask(df: DataFrame, key: str, order: str) -> DataFrame:
    """Whether a row is the first of its key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("keep", F.row_number().over(w) == 1)


def first_occurrence(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the first row of each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def index_build(df: DataFrame, value: str) -> DataFrame:
    """(hash, value): the distinct strings by hash. Equal hashes keep the smallest string."""
    return df.select(F.col(value).alias("value")).where("value is not null").distinct().select(murmur64a(F.col("value")).alias("hash"), "value").groupBy("hash").agg(F.min("value").alias("value"))


def index_write(index: DataFrame, path: str, files: int | None = None) -> None:
    """Write an index in the unsigned order of its hashes, so that lookups prune by the files' statistics."""
    o = unsigned_order(F.col("hash"))
    out = index.repartitionByRange(files, o) if files else index.repartitionByRange(o)
    out.sortWithinPartitions(o).write.mode("overwrite").parquet(path)


def index_scan(index: DataFrame) -> DataFrame:
    """The rows in the unsigned order of their hashes."""
    return index.orderBy(unsigned_order(F.col("hash")))


def index_lookup(index: DataFrame, hashes: DataFrame, default: str | None = None, strict: bool = False) -> DataFrame:
    """(hash, value) for each wanted hash: null or ``default`` where it is missing, or an error if ``strict``."""
    j = hashes.select("hash").join(index, "hash", "left")
    miss = F.raise_error(F.concat(F.lit("no such key: "), F.col("hash").cast("string"))).cast("string") if strict else F.lit(default)
    return j.select("hash", F.coalesce("value", miss).alias("value"))


def index_positions(index: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The place of each wanted key in the sorted index, or -1."""
    placed = ordinal(index.select(key), [key], "idx")
    return wanted.join(placed, key, "left").withColumn("idx", F.coalesce("idx", F.lit(-1)).cast("long"))


def clean_corpus(df: DataFrame, app: str, key: str, locale: str, value: str) -> dict[str, DataFrame]:
    """The cleaned corpus of resource strings in its four forms: ``clean`` (app, key, clean), ``pairs`` (clean and raw hash),
    ``english`` (hashes of English rows) and ``groups`` (hash of the key, hash of the value)."""
    # emptiness is told of the raw value: a filter on the cleaned one would be pushed down and clean again
    rows = df.where(has_tokens(F.col(value))).select(F.col(app).alias("app"), F.col(key).alias("key"), F.col(locale).alias("locale"), F.col(value).alias("value"), F.trim(clean_tokens(F.col(value))).alias("clean"))
    h = rows.select("*", murmur64a(F.col("clean")).alias("clean_hash"), murmur64a(F.concat(F.col("locale"), F.lit("\t"), F.col("value"))).alias("raw_hash"), murmur64a(F.concat(F.col("app"), F.lit("\t"), F.col("key"))).alias("key_hash"))
    return {
        "clean": rows.select("app", "key", "clean"),
        "pairs": h.select("clean_hash", "raw_hash"),
        "english": h.where(english_locale(F.col("locale"))).select("clean_hash").distinct(),
        "groups": h.select("key_hash", F.col("clean_hash").alias("value_hash")),
    }


def greedy_bins(df: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """Cut rows in order into bins: a bin ends where the next row would bring it to ``limit``; a larger row is a bin of its own.

    The fold is sequential by nature; it runs over (order, size) alone, in one task, in constant memory."""
    import pyarrow as pa

    def run(batches):
        total, no, any_ = 0, 0, False
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                n = n or 0
                if any_ and total + n >= limit:
                    no, total = no + 1, 0
                total, any_ = total + n, True
                out.append(no)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=[order, size, "bin"])

    s = df.select(F.col(order), F.col(size).cast("long").alias(size))
    kind = s.schema.add("bin", "long")
    return s.repartition(1).sortWithinPartitions(order).mapInArrow(run, kind)

"""Document-term bags: counts, dense ids, samples, and topic models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.corpus import ordinal


def histogram(df: DataFrame, *values: str) -> DataFrame:
    """Each value (nulls left out) with its count."""
    return df.dropna(subset=list(values)).groupBy(*values).agg(F.count(F.lit(1)).alias("count"))


def bag(df: DataFrame, doc: str, term: str) -> DataFrame:
    """(doc, term, cnt): how often each document has each term."""
    return df.dropna(subset=[doc, term]).groupBy(F.col(doc).alias("doc"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("cnt"))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Renumber a column 0 .. n - 1 in the order of its values."""
    ids = ordinal(df.select(column).distinct(), [column], name)
    return df.join(ids, column)


def first_seen_ids(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """(column, name): number the values 0 .. n - 1 in the order of their first rows."""
    first = df.groupBy(column).agg(F.min(order).alias("__first"))
    return ordinal(first, ["__first", column], name).drop("__first")


def residue_sample(df: DataFrame, column: str, percent: int) -> DataFrame:
    """Rows whose number leaves less than ``percent`` on division by 100; negative remainders count as less."""
    return df.where(F.col(column) % 100 < percent)


def topic_lines(bag_: DataFrame) -> DataFrame:
    """(doc, line): one line per document for a topic-model trainer, ``| term:cnt term:cnt``."""
    items = F.sort_array(F.collect_list(F.struct("term", "cnt")))
    line = F.concat(F.lit("| "), F.array_join(F.transform(items, lambda x: F.concat(x["term"].cast("string"), F.lit(":"), x["cnt"].cast("string"))), " "))
    return bag_.groupBy("doc").agg(line.alias("line"))


def vectors(bag_: DataFrame, terms: int) -> DataFrame:
    """(doc, features): sparse vectors over ``terms`` dense term ids."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    make = F.udf(lambda items: SparseVector(terms, [(i["term"], float(i["cnt"])) for i in items]), VectorUDT())
    return bag_.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "cnt"))).alias("items")).select("doc", make("items").alias("features"))


def topics(bag_: DataFrame, terms: int, k: int = 20, passes: int = 10, seed: int = 1):
    """A fitted topic model of a bag with dense term ids."""
    from pyspark.ml.clustering import LDA

    return LDA(k=k, maxIter=passes, optimizer="online", seed=seed).fit(vectors(bag_, terms))


def heavy_hitters(df: DataFrame, column: str | Column, k: int) -> DataFrame:
    """The ``k`` most frequent values, exactly; ties by value."""
    c = F.col(column) if isinstance(column, str) else column
    return df.select(c.alias("value")).dropna().groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def approximate_heavy_hitters(df: DataFrame, column: str, k: int, counters: int = 4000) -> DataFrame:
    """The same with a bounded number of counters."""
    top = df.agg(F.expr(f"approx_top_k(`{column}`, {int(k)}, {int(counters)})").alias("t")).select(F.explode("t").alias("x"))
    return top.select(F.col("x.item").alias("value"), F.col("x.count").alias("count"))

"""Co-occurrence within groups, and the ambiguity scores made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import word_counts, words

#: Rows of a partition, before they are paired: each meets some four others.
ROWS = 250_000
#: Texts of a partition, before they are cut into words.
TEXTS = 5_000


def partitions(df: DataFrame, rows: int | None = None) -> int:
    """Partitions for the pairs of a table's rows (or as many ``rows`` each), so that one holds as many however many rows there are."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // (rows or ROWS)))


def _groups(df: DataFrame, key: str, value: str, distinct: bool, parts: int) -> DataFrame:
    """(items): the values of each group, in order and once each, with their numbers as ``n`` unless ``distinct``."""
    d = df.select(F.col(key).alias("k"), F.col(value).alias("v")).dropna().repartition(parts, "k")
    if distinct:
        return d.groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("items"))
    return d.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("items"))


def pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(left, right, count): in how many groups two different values occur together, in both directions.

    A group is one row with its values, which are paired there; the pairs are distributed by their left value, over partitions whose
    number follows that of the rows, and summed up where they arrive: hardly any pair occurs twice in a partition, so
    summing up before would only hold them all."""
    return _paired(df, key, value).groupBy("left", "right").agg(F.count(F.lit(1)).alias("count"))


def _paired(df: DataFrame, key: str, value: str, distinct: bool = True, ordered: bool = False) -> DataFrame:
    """(left, right), each occurrence, by ``left``; with ``n`` and ``m`` unless ``distinct``; left < right if ``ordered``."""
    parts = partitions(df)
    d = _groups(df, key, value, distinct, parts).where(F.size("items") > 1).select(F.posexplode("items").alias("i", "a"), "items")
    d = d.select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items")) if ordered else F.col("items")).alias("b"))
    names = [F.col("a").alias("left"), F.col("b").alias("right")] if distinct else [F.col("a.v").alias("left"), F.col("b.v").alias("right"), F.col("a.n").alias("n"), F.col("b.n").alias("m")]
    return d.select(*names).where("left < right" if ordered else "left <> right").repartition(parts, "left")


def occurrence_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same, counting every pair of occurrences."""
    return _paired(df, key, value, distinct=False).groupBy("left", "right").agg(F.sum(F.col("n") * F.col("m")).alias("count"))


def unordered_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(lo, hi, count) of unordered pairs."""
    return _paired(df, key, value, ordered=True).groupBy(F.col("left").alias("lo"), F.col("right").alias("hi")).agg(F.count(F.lit(1)).alias("count"))


def merge_counts(*parts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sum partial pair counts, over as many partitions by ``left`` as said."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.repartition(partitions, "left") if partitions else out
    return out.groupBy("left", "right").agg(F.sum("count").alias("count"))


def ambiguity(counts: DataFrame) -> DataFrame:
    """(left, n, total, total_squared, variance): the population variance of each value's counts, from exact integer sums."""
    n, s, q = F.count(F.lit(1)), F.sum("count"), F.sum(F.col("count") * F.col("count"))
    return _variance(counts.groupBy("left").agg(n.alias("n"), s.alias("total"), q.alias("squares")))


def _variance(g: DataFrame) -> DataFrame:
    v = (F.col("n") * F.col("squares") - F.col("total") * F.col("total")).cast("double") / (F.col("n") * F.col("n")).cast("double")
    return g.select("left", "n", "total", (F.col("total") * F.col("total")).alias("total_squared"), F.round(v, 9).alias("variance"))


def text_ambiguity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same of the word counts of each identifier's texts; nulls and identifiers without a word have no row.

    A text's words are counted where it stands and only their three sums cross the network; the words of identifiers that have
    several rows are counted together, over partitions whose number follows that of the rows."""
    d = df.select(F.col(id_col).alias("left"), F.col(text_col).alias("text")).where("left is not null")
    w = d.select("left", word_counts(F.col("text")).alias("w")).select("left", "w.*")
    sums = w.groupBy("left").agg(F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in ("n", "total", "squares")])
    once = _variance(sums.where("rows = 1 and n > 0"))
    again = d.groupBy("left").count().where("count > 1").select("left")
    if again.isEmpty():
        return once
    several = d.join(again, "left", "left_semi").repartition(partitions(d, TEXTS), "left")
    counts = several.select("left", F.explode(words(F.col("text"))).alias("term")).groupBy("left", "term").agg(F.count(F.lit(1)).alias("count"))
    return once.unionByName(ambiguity(counts))


def ambiguity_floor(counts: DataFrame) -> DataFrame:
    """The same in whole numbers: floor of the mean square less the square of the floor of the mean."""
    g = counts.groupBy("left").agg(F.expr("sum(count * count) div count(1)").alias("q"), F.expr("sum(count) div count(1)").alias("m"))
    return g.select("left", (F.col("q") - F.col("m") * F.col("m")).alias("variance"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(left, right, count, prob): each count as a share of its left value's."""
    w = Window.partitionBy("left")
    return counts.select("left", "right", "count", F.round(F.col("count") / F.sum("count").over(w), 9).alias("prob"))


def scores(counts: DataFrame) -> DataFrame:
    """(left, right, score): standard deviation times share, its logarithm clipped to 0 .. 10; 0 where the product is 0."""
    w = Window.partitionBy("left")
    n, s, q = F.count(F.lit(1)).over(w), F.sum("count").over(w), F.sum(F.col("count") * F.col("count")).over(w)
    var = (n * q - s * s).cast("double") / (n * n).cast("double")
    x = F.sqrt(var) * F.col("count") / s
    x = F.when(x <= 0, F.lit(1.0)).otherwise(x)
    return counts.select("left", "right", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.ln(x))), 9).alias("score"))


def score_ambiguity(scored: DataFrame) -> DataFrame:
    """(left, n, total, deviation): the same over the scores, the second pass, as a standard deviation."""
    g = scored.groupBy("left").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.var_pop("score").alias("v"))
    return g.select("left", "n", F.round("total", 6).alias("total"), F.round(F.sqrt("v"), 6).alias("deviation"))


def translations(counts: DataFrame) -> DataFrame:
    """(left, others): the index from a value to those it occurs with and how often, most frequent first."""
    item = F.struct((-F.col("count")).alias("c"), F.col("right").alias("other"))
    others = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["other"].alias("other"), (-x["c"]).alias("count")))
    return counts.groupBy("left").agg(others.alias("others"))


def lookup_translations(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, other, count, score): the translations of the keys, scored by their share, best first within a key (keys in no order)."""
    total = F.aggregate("others", F.lit(0).cast("long"), lambda s, o: s + o["count"])
    e = keys.select(F.col(key).alias("left")).join(index.select("left", "others", total.alias("all")), "left", "left").select("left", "all", F.explode_outer("others").alias("o"))
    return e.select("left", F.col("o.other").alias("other"), F.col("o.count").alias("count"), (F.col("o.count") / F.col("all")).alias("score"))

"""Retry logs: what becomes of jobs that are tried until they succeed or run out of tries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL = 20


def fold(df: DataFrame, job: str, order: str, success: str, ttl: int = TTL) -> DataFrame:
    """The attempts that count: those up to a job's first success, and at most ``ttl`` + 1; with ``attempt``, ``done`` and ``left``."""
    w = Window.partitionBy(job).orderBy(order)
    n = df.withColumn("attempt", F.row_number().over(w)).withColumn("__before", F.coalesce(F.max(F.col(success).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.where((F.col("__before") == 0) & (F.col("attempt") <= ttl + 1)).drop("__before")
    return n.withColumn("left", (F.lit(ttl + 1) - F.col("attempt")).cast("int"))


def unseen(items: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """Items that have a name and are not among the seen."""
    return items.where(F.col(name).isNotNull()).join(seen.select(F.trim(name).alias(name)).distinct(), name, "left_anti")


def valid_response(status, content_type, url):
    """Whether a download answered with a file: status 200, no page, and not from the store itself."""
    return (status == 200) & ~F.coalesce(content_type, F.lit("")).startswith("text/html") & url.isNotNull() & ~F.coalesce(F.contains(url, F.lit("play.google.com")), F.lit(False))


def after_marker(df: DataFrame, key: str, order: str | list[str], marker: str) -> DataFrame:
    """The rows from the first one whose key is the marker on. Rows stand in the order of these columns; for the place of every
    row to be known, no two may have them equal."""
    place = F.struct(*([order] if isinstance(order, str) else order))
    at = df.where(F.col(key) == marker).agg(F.min(place).alias("__at"))  # one row
    return df.crossJoin(F.broadcast(at)).where(place >= F.col("__at")).drop("__at")

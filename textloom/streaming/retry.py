"""The same folds over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.attempts import TTL

OUT = "job long, attempt int, done boolean, left int"


def fold_stream(events: DataFrame, job: str, order: str, success: str, ttl: int = TTL, forget: str | None = None) -> DataFrame:
    """Attempts that count, as they come: state is one counter per job.

    Within a micro-batch attempts are taken in order; across batches they must arrive in order. Counters stay for ever unless
    ``forget`` (as "7 days") drops those of jobs for which nothing has come that long; attempts that come later count anew. A
    stream that forgets runs batches without end to see the time pass, so it never ends by itself under ``availableNow``."""
    silent = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    from pyspark.sql.streaming.state import GroupState

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, over = state.get if state.exists else (0, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("o").itertuples():
            if over or n > ttl:
                break
            n += 1
            over = bool(row.s)
            out.append((key[0], n, over, ttl + 1 - n))
        state.update((n, over))
        if silent is not None:
            state.setTimeoutDuration(silent)
        yield pd.DataFrame(out, columns=["job", "attempt", "done", "left"])

    e = events.select(F.col(job).cast("long").alias("job"), F.col(order).alias("o"), F.col(success).alias("s"))
    return e.groupBy("job").applyInPandasWithState(step, OUT, "n int, over boolean", "append", "NoTimeout" if silent is None else "ProcessingTimeTimeout")


def unseen_stream(items: DataFrame, name: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Items whose name has not come before, as far back as the watermark."""
    return items.where(F.col(name).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark([name])


def histogram_stream(events: DataFrame, value: str, at: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of a value per time window, final once the watermark has passed."""
    return events.where(F.col(value).isNotNull()).withWatermark(at, delay).groupBy(F.window(at, width), value).agg(F.count(F.lit(1)).alias("count"))

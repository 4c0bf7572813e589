"""State over time, as batch windows and as Structured Streaming.

The batch forms give each row's result over a whole table; the stream forms keep the state that a
row can still need, and a watermark lets it go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def rate_limit(df: DataFrame, key: str, ts: str, seconds: int = 600, most: int = 12) -> DataFrame:
    """All rows with hits (of the key within the last seconds, itself included) and limited; refused hits count."""
    micros = _micros(ts)
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("hits", F.count("*").over(w)).withColumn("limited", F.col("hits") > most)


def rate_limit_stream(df: DataFrame, key: str, ts: str, seconds: int = 600, most: int = 12, late: str = "10 minutes") -> DataFrame:
    """key, ts, hits, limited for each row of a stream, as rate_limit gives them: by event time, whatever order rows come in.

    A row waits until the watermark (late behind the newest time) has passed it, since an earlier one may
    still come; later than that it is dropped. A key's state is the rows that wait and the times of the last
    seconds before the watermark; an event-time timer brings the next row out, or ends the state. Work is
    in proportion to a key's rows, but for sorting the new ones.
    """
    kind, window = df.schema[key].dataType.simpleString(), seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, waiting = (np.array(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        if not state.hasTimedOut:
            waiting = np.sort(np.concatenate([waiting, *(f["micros"].to_numpy(np.int64) for f in frames)]), kind="stable")
        mark = state.getCurrentWatermarkMs() * 1000
        due, waiting = np.split(waiting, [np.searchsorted(waiting, mark, "right")])
        every = np.concatenate([kept, due])
        hits = np.searchsorted(every, due, "right") - np.searchsorted(every, due - window, "right")
        kept = every[every > mark - window]
        if len(waiting) or len(kept):
            state.update((kept.tolist(), waiting.tolist()))
            state.setTimeoutTimestamp(int(waiting[0] if len(waiting) else kept[-1] + window) // 1000 + 1)
        elif state.exists:
            state.remove()
        if len(due):
            yield pd.DataFrame({key: [k[0]] * len(due), "micros": due, "hits": hits, "limited": hits > most})

    slim = df.select(key, F.col(ts).cast("timestamp").alias("_ts"), _micros(ts).alias("micros")).withWatermark("_ts", late)
    out = slim.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, micros long, hits long, limited boolean", "kept array<long>, waiting array<long>", "append", "EventTimeTimeout")
    return out.select(key, F.timestamp_micros("micros").alias(ts), "hits", "limited")


def daily_budget(df: DataFrame, ts: str, cost: str, cap: float, order: str) -> DataFrame:
    """All rows with day and spent (the day's cost before the row) and over (spent >= cap).

    A minute's rows are one ordered group; the minutes before it add what their sums say, so a busy
    day is no single task. Rows without a time are a group of their own.
    """
    timed = df.withColumns({"day": F.to_date(ts), "_minute": F.date_trunc("minute", ts)})
    sums = timed.groupBy("day", "_minute").agg(F.sum(cost).alias("_sum"))
    past = Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("day").alias("_d"), F.col("_minute").alias("_m"), F.coalesce(F.sum("_sum").over(past), F.lit(0.0)).alias("_before"))
    w = Window.partitionBy("day", "_minute").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    within = timed.withColumn("_within", F.coalesce(F.sum(cost).over(w), F.lit(0.0)))
    both = within.join(earlier, F.col("day").eqNullSafe(F.col("_d")) & F.col("_minute").eqNullSafe(F.col("_m")))
    return both.withColumn("spent", F.col("_before") + F.col("_within")).withColumn("over", F.col("spent") >= cap).drop("_minute", "_within", "_before", "_d", "_m")


def debounce(df: DataFrame, key: str, ts: str, millis: int) -> DataFrame:
    """The rows after which their key is silent for millis."""
    w = Window.partitionBy(key).orderBy(ts)
    wait = _micros(F.lead(ts).over(w)) - _micros(ts)
    return df.withColumn("wait", wait).where(F.col("wait").isNull() | (F.col("wait") >= millis * 1000)).drop("wait")


def latest_run(df: DataFrame, key: str, token: str, value: str) -> DataFrame:
    """The value of each key's largest token."""
    return df.groupBy(key).agg(F.max(token).alias(token), F.max_by(value, token).alias(value))


def usage_by_window(df: DataFrame, ts: str, kind: str, value: str, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, kind, n, total; a stream needs late, after which a window closes."""
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def first_answers(df: DataFrame, key: list[str], ts: str, late: str | None = None) -> DataFrame:
    """One row for each key, the earliest; on a stream, within the watermark."""
    if late:
        return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    return df.groupBy(*key).agg(F.min(ts).alias(ts), F.count("*").alias("asked"))

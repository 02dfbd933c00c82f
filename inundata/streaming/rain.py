"""Streaming twins of three batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_rain_daily(hours: DataFrame, late: str = "2 days") -> DataFrame:
    """day, tp_mm of an hourly stream (ts, tp_mm): negative hours are 0, rows past the watermark go."""
    day = F.window("ts", "1 day")
    return hours.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.sum(F.greatest(F.lit(0.0), "tp_mm")).alias("tp_mm")).select(F.col("w.start").alias("day"), "tp_mm")


def stream_new_products(products: DataFrame, begin: str = "begin", published: str = "published", tie: str = "id", late: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest publication of each begin time, the least ``tie`` (a number) of equally new ones.

    As ``latest_product``, but once: the state holds the newest of what has come, and gives it out
    when the watermark of begin times has passed by. Publications of a begin time that arrive after
    that go. The rows' own columns come back.
    """
    newest = F.max_by(F.struct("*"), F.struct(F.col(published), -F.col(tie))).alias("_p")
    return products.withWatermark(begin, late).groupBy(*keys, begin).agg(newest).select("_p.*")


def stream_thin_datetimes(times: DataFrame, key: str = "key", ts: str = "ts", seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """key, ts: times at least ``seconds`` after the last one kept.

    Times wait in state until the watermark has passed them, so that the fold sees them in order.
    """
    gap = int(seconds * 1_000_000)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = list(waiting)
        for pdf in batches:
            waiting += pdf[ts].astype("datetime64[us]").astype("int64").tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        ready, waiting = sorted(t for t in set(waiting) if t <= mark), [t for t in waiting if t > mark]
        kept = []
        for t in ready:
            if last is None or t - last >= gap:
                last = t
                kept.append(t)
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(kept), ts: pd.to_datetime(kept, unit="us")})

    kind = dict(times.dtypes)[key]
    return times.withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        fold, f"`{key}` {kind}, `{ts}` timestamp", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )

"""Live overdue detection: a feed that stops is noticed while the stream runs, without a scan of its history.

Each feed has one state row: its last arrival, a histogram of the gaps between arrivals and the timer that is set. A gap
falls into a bin of ``BIN_BITS`` significant bits (rounded down, so the median is at most one part in 512 too small), which
bounds the bins of a feed whatever its history. After every batch a feed's timer stands at its last arrival plus
``factor`` medians; a new arrival moves it, and when it fires the feed is reported once for that expected time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from vigilake.fixed import MIN_ARRIVALS, OVERDUE_FACTOR

BIN_BITS = 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OVERDUE_FIELDS = [
    StructField("last_seen", TimestampType()), StructField("median_interval_seconds", LongType()),
    StructField("expected_by", TimestampType()), StructField("overdue_seconds", LongType())]


def gap_bin(gap: int) -> int:
    """The gap with all but its ``BIN_BITS`` leading bits cleared."""
    low = max(0, gap.bit_length() - BIN_BITS)
    return gap >> low << low


def histogram_median(bins: dict[int, int]) -> float:
    """Median of the binned gaps; the mean of the two middle ones where their number is even."""
    n, middle = sum(bins.values()), []
    wanted = [(n + 1) // 2, (n + 2) // 2]
    upto = 0
    for b in sorted(bins):
        upto += bins[b]
        while len(middle) < 2 and upto >= wanted[len(middle)]:
            middle.append(b)
    return sum(middle) / 2 if middle else 0.0


class OverdueFeeds(StatefulProcessor):
    """Input per feed: ``at_us`` (microseconds). Arrivals not after the feed's last one leave its rhythm as it is."""

    STATE = "last_us bigint, bins array<bigint>, counts array<bigint>, expected_us bigint, median_us bigint, timer_ms bigint"

    def __init__(self, keys: list[str], factor: float, min_arrivals: int, event_time: bool):
        self.keys, self.factor, self.min_arrivals, self.event_time = keys, factor, min_arrivals, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        last, bins, counts, _, _, timer = self.feed.get() if self.feed.exists() else (None, [], [], None, None, None)
        times = sorted({int(t) for part in rows for t in part["at_us"] if not pd.isna(t)})
        seen = dict(zip(bins, counts, strict=True))
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None:
                b = gap_bin(t - last)
                seen[b] = seen.get(b, 0) + 1
            last = t
        if last is None:
            return
        median = histogram_median(seen)
        expected = int(last + self.factor * median) if sum(seen.values()) + 1 >= self.min_arrivals and median > 0 else None
        # Never before the expected time: the next whole millisecond.
        due = None if expected is None else expected // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.feed.update((last, list(seen), list(seen.values()), expected, int(median), due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, bins, counts, expected, median, timer = self.feed.get()
        if expected is None or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.feed.update((last, bins, counts, expected, median, None))
        at = lambda us: pd.Timestamp(us, unit="us")
        yield pd.DataFrame({
            **{k: [v] for k, v in zip(self.keys, key, strict=True)}, "last_seen": [at(last)], "median_interval_seconds": [median // 1_000_000],
            "expected_by": [at(expected)], "overdue_seconds": [max(0, now * 1000 - expected) // 1_000_000]})

    def close(self) -> None:
        pass


def stream_overdue(
    arrivals: DataFrame, keys: tuple[str, ...] = ("source", "fileset"), ts: str = "mtime", factor: float = OVERDUE_FACTOR,
    min_arrivals: int = MIN_ARRIVALS, delay: str = "1 hour", event_time: bool = True,
) -> DataFrame:
    """Reports of feeds whose next file is late: ``keys, last_seen, median_interval_seconds, expected_by, overdue_seconds``.

    With ``event_time`` time is what the arrivals of all feeds show, less ``delay``: runs over the same arrivals report the same. Without it
    the clock counts, so a report comes though no feed moves. Keys are text; a null key is a feed of its own.
    """
    rows = arrivals.withWatermark(ts, delay) if event_time else arrivals
    rows = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    schema = StructType([*[StructField(k, StringType()) for k in keys], *OVERDUE_FIELDS])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=OverdueFeeds(list(keys), float(factor), min_arrivals, event_time), outputStructType=schema, outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime")


@contextmanager
def timers(spark: SparkSession):
    """Queries started inside keep their state where timers can be kept; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)

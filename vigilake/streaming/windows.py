"""Metric points from an event stream: closed time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_metrics(
    events: DataFrame, owner: Column, ts: str, aggs: dict[str, Column], window: str = "1 day",
    slide: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """``uri, ts, metric_name, metric_value`` per window and owner; rows later than ``delay`` are dropped."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    wide = (
        events.withWatermark(ts, delay)
        .groupBy(span.alias("_window"), owner.alias("_owner"))
        .agg(*[c.cast("double").alias(n) for n, c in aggs.items()])
        .select("_owner", F.col("_window.start").alias("ts"), *aggs)
    )
    return wide.unpivot(["_owner", "ts"], list(aggs), "metric_name", "metric_value").select(
        F.concat_ws("/", "_owner", "metric_name").alias("uri"), "ts", "metric_name", "metric_value")


def session_metrics(events: DataFrame, owner: Column, ts: str, aggs: dict[str, Column], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """``owner, opened, closed, ...`` per burst of an owner: rows with less than ``gap`` between neighbours.

    Sessions merge in the stream's state as late rows join them. One is given out when the watermark has passed its last
    row by ``gap``, so nothing can be added to it any more; ``closed`` is the time of its last row.
    """
    wide = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_session"), owner.alias("owner")).agg(
        F.max(ts).alias("closed"), *[c.alias(n) for n, c in aggs.items()])
    return wide.select("owner", F.col("_session.start").alias("opened"), "closed", *aggs)


def append_closed(metrics: DataFrame, table: str, checkpoint: str):
    """Run over everything available and append the closed windows to a parquet table."""
    query = (
        metrics.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query

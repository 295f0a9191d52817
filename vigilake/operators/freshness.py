"""Freshness: arrivals of a feed, overdue feeds, odd load gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.fixed import MIN_ARRIVALS, OVERDUE_FACTOR
from vigilake.functions.changes import detail_json, severity
from vigilake.functions.uris import fileset_uri
from vigilake.operators.scale import adjacent_gaps, exact_median


def upsert_arrivals(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """Arrivals keyed by (source_uri, fileset, file_name); a file seen again takes its new time."""
    rows = existing.withColumn("_batch", F.lit(0)).unionByName(observed.withColumn("_batch", F.lit(1)))
    return latest_arrivals(rows, "_batch")


def latest_arrivals(log: DataFrame, batch: str) -> DataFrame:
    """Current arrivals from an append-only log: the newest batch wins."""
    return log.groupBy("source_uri", "fileset", "file_name").agg(
        F.max_by("mtime", F.struct(batch, "mtime")).alias("mtime"))


def cadence(arrivals: DataFrame, keys: Sequence[str] = ("source", "fileset"), ts: str = "mtime") -> DataFrame:
    """Learned rhythm of each feed: ``keys, arrivals, last_us, median_us``.

    Several files of one moment count once. Feeds of fewer than two distinct times
    have no gap and no row.
    """
    rows = arrivals.select(*keys, ts)
    gaps = exact_median(adjacent_gaps(rows, keys, ts), keys, "gap_us", largest="at_us")
    return gaps.select(
        *keys, (F.col("n") + 1).alias("arrivals"), F.col("largest").alias("last_us"), F.col("median").alias("median_us"))


def overdue_feeds(
    arrivals: DataFrame,
    now,
    factor: float = OVERDUE_FACTOR,
    keys: Sequence[str] = ("source", "fileset"),
    ts: str = "mtime",
    min_arrivals: int = MIN_ARRIVALS,
) -> DataFrame:
    """Feeds whose next file is late: strictly more than ``factor`` medians after the last one."""
    us = F.unix_micros(F.lit(now).cast("timestamp"))
    return (
        cadence(arrivals, keys, ts)
        .where((F.col("arrivals") >= min_arrivals) & (F.col("median_us") > 0))
        .withColumn("expected_us", (F.col("last_us") + F.lit(float(factor)) * F.col("median_us")).cast("bigint"))
        .withColumn("late_us", us - F.col("expected_us"))
        .where("late_us > 0")
        .select(
            *keys,
            F.timestamp_micros("last_us").alias("last_seen"),
            F.floor(F.col("median_us") / 1_000_000).alias("median_interval_seconds"),
            F.timestamp_micros("expected_us").alias("expected_by"),
            F.floor(F.col("late_us") / 1_000_000).alias("overdue_seconds"),
        )
    )


def overdue_events(overdue: DataFrame) -> DataFrame:
    """Overdue feeds of ``source, fileset`` as change events."""

    def iso(column: str):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(F.unix_micros(column) % 1_000_000 == 0, whole).otherwise(micros)

    return overdue.select(
        fileset_uri(F.col("source"), F.col("fileset")).alias("object_uri"),
        F.lit("fileset_overdue").alias("change_type"),
        severity(F.lit("fileset_overdue")).alias("severity"),
        detail_json(
            fileset=F.col("fileset"),
            last_seen=iso("last_seen"),
            median_interval_seconds=F.col("median_interval_seconds"),
            expected_by=iso("expected_by"),
            overdue_seconds=F.col("overdue_seconds"),
        ).alias("detail"),
    )


def load_gap_zscore(loads: DataFrame, keys: Sequence[str], ts: str = "loaded_at") -> DataFrame:
    """How unusual the newest load's gap is: ``keys, loaded_at, gap_seconds, z_score``, newest load only."""
    gaps = adjacent_gaps(loads, keys, ts)
    return (
        gaps.groupBy(*keys)
        .agg(
            F.max("at_us").alias("_last"),
            F.max_by("gap_us", "at_us").alias("_gap"),
            F.avg("gap_us").alias("_mean"),
            F.stddev_pop("gap_us").alias("_std"),
        )
        .select(
            *keys,
            F.timestamp_micros("_last").alias(ts),
            (F.col("_gap") / 1_000_000).alias("gap_seconds"),
            F.abs((F.col("_gap") - F.col("_mean")) / F.nullif("_std", F.lit(0.0))).alias("z_score"),
        )
    )

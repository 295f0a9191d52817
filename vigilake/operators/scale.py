"""Building blocks that keep results whole when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.session import cut_lineage

GAP_BUCKET_SECONDS = 3600


def with_group_stats(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregates first (partial sums before the shuffle) and joins the one-row-per-
    group result back, instead of a window that would sort a whole group in one task.
    Adaptive execution broadcasts a small result and splits the rows of a hot group.
    """
    return rows.join(rows.groupBy(*keys).agg(*aggs), list(keys))


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_at``: 0, 1, 2, ... per key in ``order``; no key is numbered in one task.

    Rows are dealt by ranges of (keys, order) and numbered inside a range; a range's
    rows of a key follow those of the ranges before it.
    """
    keys, order = list(keys), list(order)
    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return (
        ranged.withColumn("_inside", inside).join(starts, ["_range", *keys])
        .withColumn("_at", F.col("_start") + F.col("_inside") - 1).drop("_range", "_inside", "_start")
    )


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, as an aggregate with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*rows.columns)


def _times(points: DataFrame, keys: Sequence[str], ts: str, bucket_seconds: int) -> DataFrame:
    return (
        points.where(F.col(ts).isNotNull())
        .select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
        .withColumn("_bucket", F.expr(f"at_us div {bucket_seconds * 1_000_000}L"))
    )


def adjacent_gaps(
    points: DataFrame,
    keys: Sequence[str],
    ts: str,
    bucket_seconds: int = GAP_BUCKET_SECONDS,
) -> DataFrame:
    """Microseconds between consecutive distinct times of each key: ``keys, at_us, gap_us``.

    Works in two levels so no task sorts a whole key: gaps inside one time bucket
    come from a window over (key, bucket); the gap across a bucket border lies between
    its first time and the last one of the bucket before. Both come from one shuffle of
    the distinct times.
    """
    keys = list(keys)
    bucket = Window.partitionBy(*keys, "_bucket")
    spaced = (
        _times(points, keys, ts, bucket_seconds).distinct()
        .withColumn("_prev", F.lag("at_us").over(bucket.orderBy("at_us")))
        .withColumn("_last", F.max("at_us").over(bucket))
    )
    borders = spaced.where("_prev is null").withColumn(
        "_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
    columns = [*keys, "at_us", (F.col("at_us") - F.col("_prev")).alias("gap_us")]
    return spaced.where("_prev is not null").select(*columns).unionByName(borders.where("_prev is not null").select(*columns))


def exact_median(values: DataFrame, keys: Sequence[str], value: str, *, largest: str | None = None) -> DataFrame:
    """Exact median of a non-negative long per key: ``keys, median double, n bigint``.

    ``largest`` names another column whose maximum per key is added as ``largest``.

    Counts each distinct value, finds by cumulative count the coarse bin (top 15
    significant bits) that holds each middle rank, then ranks only inside those
    bins. A key's values are never gathered as one list.
    """
    keys = list(keys)
    # Kept in the shared folder: the steps below read these counts instead of the values.
    counted = (
        cut_lineage(values.groupBy(*keys, F.col(value).alias("_v")).agg(
            F.count("*").alias("_n"), F.max(largest or value).alias("_top")))
        .withColumn("_w", F.expr("shiftleft(1L, greatest(length(bin(_v)) - 15, 0))"))
        .withColumn("_bin", F.expr("_v - _v % _w"))
        .drop("_w")
    )
    key = Window.partitionBy(*keys)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_in_bin"), F.max("_top").alias("_bin_top"))
        .withColumn("_upto", F.sum("_in_bin").over(
            key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_total", F.sum("_in_bin").over(key))
        .withColumn("_largest", F.max("_bin_top").over(key))
        .withColumn("_before", F.col("_upto") - F.col("_in_bin"))
        .withColumn("_lo", F.expr("(_total + 1) div 2"))
        .withColumn("_hi", F.expr("(_total + 2) div 2"))
        .where("(_before < _lo and _lo <= _upto) or (_before < _hi and _hi <= _upto)")
        .drop("_upto", "_in_bin", "_bin_top")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        counted.join(bins, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
        .groupBy(*keys)
        .agg(
            F.expr("(max(if(_from < _lo and _lo <= _upto, _v, null))"
                   " + max(if(_from < _hi and _hi <= _upto, _v, null))) / 2.0D").alias("median"),
            F.max("_total").alias("n"),
            *([F.max("_largest").alias("largest")] if largest else []),
        )
    )


__all__ = [
    "adjacent_gaps",
    "cut_lineage",
    "exact_median",
    "first_per_key",
    "places",
    "with_group_stats",
]

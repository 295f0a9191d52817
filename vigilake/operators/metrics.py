"""Metric series: per-file points, appends without duplicates, series reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.uris import fileset_uri
from vigilake.operators.scale import first_per_key


def fileset_metrics(matched: DataFrame) -> DataFrame:
    """Size, column count and row count of each matched file as points of its feed.

    Input: ``source, fileset, pos, size, mtime, columns, num_rows``; files without a
    fileset are left out, unknown values give no point.
    """
    n_columns = F.size("columns")
    return (
        matched.where("fileset is not null")
        .select(
            fileset_uri(F.col("source"), F.col("fileset")).alias("owner"),
            F.col("mtime").alias("ts"),
            "pos",
            F.col("size").cast("double").alias("file_size"),
            F.when(n_columns > 0, n_columns).cast("double").alias("column_count"),
            F.col("num_rows").cast("double").alias("row_count"),
        )
        .unpivot(["owner", "ts", "pos"], ["file_size", "column_count", "row_count"], "metric_name", "metric_value")
        .where("metric_value is not null")
        .select(F.concat_ws("/", "owner", "metric_name").alias("uri"), "ts", "metric_name", "metric_value", "pos")
    )


def new_points(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Points of ``batch`` to append: no nulls, first of a (uri, ts) wins, none stored yet."""
    first = first_per_key(batch.where("metric_value is not null"), ["uri", "ts"], [F.col("pos")])
    return first.join(existing.select("uri", "ts"), ["uri", "ts"], "left_anti").drop("pos")


def series(metrics: DataFrame, max_points: int | None = None, keep: str = "oldest") -> DataFrame:
    """Points per series as ``uri, ds, y`` without nulls, all or the first ``max_points``.

    The cap is a top-k per series: the optimizer cuts each map task to
    ``max_points`` per series before the shuffle.
    """
    points = metrics.select("uri", F.col("ts").alias("ds"), F.col("metric_value").alias("y"))
    if max_points is not None:
        order = F.col("ds").asc() if keep == "oldest" else F.col("ds").desc()
        rank = F.row_number().over(Window.partitionBy("uri").orderBy(order))
        points = points.withColumn("_rank", rank).where(F.col("_rank") <= max_points).drop("_rank")
    return points.where("y is not null")

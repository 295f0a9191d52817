"""Reading recorded changes: latest scan, since a time, the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.changes import describe_change


def changes_of_latest_scan(changes: DataFrame, scans: DataFrame) -> DataFrame:
    """Changes of each source's newest scan.

    ``scans`` (``source_uri, scan_id``) is the register of all scans. A clean scan
    reports nothing; one that found no objects any more reports what is gone.
    """
    newest = scans.groupBy("source_uri").agg(F.max("scan_id").alias("scan_id"))
    return changes.join(newest, ["source_uri", "scan_id"], "left_semi")


def changes_since(changes: DataFrame, since) -> DataFrame:
    return changes.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def change_report(changes: DataFrame) -> DataFrame:
    """One line per change, oldest first."""
    return changes.withColumn("summary", describe_change(F.col("change_type"), F.col("detail"))).orderBy(
        "ts", "object_uri", "change_type")


def gate(changes: DataFrame, fail_on: str = "breaking") -> DataFrame:
    """One row ``total, breaking, failed``; ``fail_on`` is ``any`` or ``breaking``."""
    if fail_on not in ("any", "breaking"):
        raise ValueError(f"fail_on must be 'any' or 'breaking', got: {fail_on}")
    counts = changes.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "breaking").alias("breaking"))
    return counts.withColumn("failed", F.col("total" if fail_on == "any" else "breaking") > 0)

"""Schema snapshots: one row per object with its columns as a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.uris import file_uri


def snapshot_from_fields(fields: DataFrame, kind: str = "table") -> DataFrame:
    """``owner_uri, name, type`` rows as snapshot rows; an object's columns are one map.

    A group is one object's column list, so its size is a schema's width.
    """
    pairs = F.array_sort(F.collect_list(F.struct("name", "type")))
    return fields.groupBy(F.col("owner_uri").alias("object_uri")).agg(
        F.lit(kind).alias("kind"), F.map_from_entries(pairs).alias("columns"))


def snapshot_from_files(files: DataFrame, protocol: str) -> DataFrame:
    """Crawled files as snapshot rows; a file without a schema has an empty map."""
    return files.select(
        file_uri(protocol, F.col("source"), F.col("path")).alias("object_uri"),
        F.lit("file").alias("kind"),
        F.coalesce("columns", F.expr("cast(map() as map<string,string>)")).alias("columns"),
    )


def latest_snapshot(snapshots: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of each source; none if its newest scan found nothing.

    ``scans`` (``source_uri, scan_id``) is the register of all scans.
    """
    newest = scans.groupBy("source_uri").agg(F.max("scan_id").alias("scan_id"))
    return snapshots.join(newest, ["source_uri", "scan_id"], "left_semi")


def merge_snapshots(previous: DataFrame, current: DataFrame, filesets: DataFrame | None = None) -> DataFrame:
    """What a file source looks like after an incremental scan.

    The previous objects, overlaid by those of this scan. Fileset entries come only
    from ``filesets``, so one no longer declared disappears.
    """
    columns = ["object_uri", "kind", "columns"]
    kept = previous.where(~F.col("object_uri").startswith("fileset://")).select(*columns)
    newer = current.select(*columns)
    merged = kept.join(newer.select("object_uri"), "object_uri", "left_anti").unionByName(newer)
    return merged if filesets is None else merged.unionByName(filesets.select(*columns))

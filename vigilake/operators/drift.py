"""Schema drift: two snapshots, or a whole history, as change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.changes import columns_json, detail_json, severity, sorted_entries
from vigilake.schemas import EMPTY_COLUMNS

_WHOLE = ("file", "fileset")


def _side(snapshot: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    kind = F.col("kind") if "kind" in snapshot.columns else F.lit(None).cast("string")
    return snapshot.select(
        *keys,
        F.lit(True).alias(f"in_{name}"),
        F.coalesce(kind, F.lit("table")).alias(f"{name}_kind"),
        F.coalesce("columns", F.expr(EMPTY_COLUMNS)).alias(name),
    )


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("object_uri",)) -> DataFrame:
    """Change events from ``old`` to ``new``: ``keys, kind, change_type, severity, detail``.

    One full outer join of objects; unchanged objects are dropped before anything is
    expanded. Objects are compared column by column, except files and filesets,
    which are compared as a whole and only when both sides have a schema. A file
    that is gone is no change.
    """
    pairs = _side(old, keys, "old").join(_side(new, keys, "new"), list(keys), "full_outer")
    pairs = pairs.withColumn("kind", F.coalesce("new_kind", "old_kind"))
    added, removed = F.col("in_old").isNull(), F.col("in_new").isNull()
    differs = sorted_entries(F.col("old")) != sorted_entries(F.col("new"))
    whole = F.col("kind").isin(*_WHOLE)
    both_known = (F.size("old") > 0) & (F.size("new") > 0)
    pairs = pairs.where(
        F.when(added, True)
        .when(removed, F.col("kind") != "file")
        .otherwise(differs & (~whole | both_known))
    )

    def event(change_type: Column, detail: Column) -> Column:
        return F.struct(change_type.alias("change_type"), detail.alias("detail"))

    old_map, new_map = F.col("old"), F.col("new")

    def column_event(c: Column) -> Column:
        before, after = F.try_element_at(old_map, c), F.try_element_at(new_map, c)
        return (
            F.when(before.isNull(), event(F.lit("column_added"), detail_json(column=c, type=after)))
            .when(after.isNull(), event(F.lit("column_removed"), detail_json(column=c, type=before)))
            .otherwise(event(F.lit("column_type_changed"), detail_json(column=c, old_type=before, new_type=after)))
        )

    names = F.array_union(F.map_keys(new_map), F.map_keys(old_map))
    changed = F.filter(names, lambda c: ~F.try_element_at(old_map, c).eqNullSafe(F.try_element_at(new_map, c)))
    gone_or_new = F.array(event(
        F.concat("kind", F.when(added, "_added").otherwise("_removed")),
        detail_json(columns=columns_json(F.when(added, new_map).otherwise(old_map)))))
    reshaped = F.array(event(
        F.concat("kind", F.lit("_schema_changed")),
        detail_json(old_columns=columns_json(old_map), new_columns=columns_json(new_map))))
    events = (
        F.when(added | removed, gone_or_new)
        .when(whole, reshaped)
        .otherwise(F.transform(changed, column_event))
    )
    return (
        pairs.select(*keys, "kind", F.explode(events).alias("_event"))
        .select(*keys, "kind", F.col("_event.change_type").alias("change_type"), F.col("_event.detail").alias("detail"))
        .withColumn("severity", severity(F.col("change_type")))
        .select(*keys, "kind", "change_type", "severity", "detail")
    )


def diff_with_baseline(
    old: DataFrame, new: DataFrame, scanned: DataFrame, known: DataFrame, findings: DataFrame | None = None
) -> DataFrame:
    """Changes of one round of scans over several sources: ``source_uri, object_uri, ...``.

    ``scanned`` (``source_uri``) are the sources scanned this time, with or without
    objects; all others are left alone. ``known`` (``source_uri``) are those with an
    earlier scan, again with or without objects. A source without one only sets its
    baseline and reports no differences; ``findings`` made during the scan are
    reported regardless.
    """
    compared = scanned.select("source_uri").join(known.select("source_uri"), "source_uri", "left_semi").distinct()
    before, after = (side.join(compared, "source_uri", "left_semi") for side in (old, new))
    changes = diff_snapshots(before, after, ["source_uri", "object_uri"]).drop("kind")
    return changes if findings is None else changes.unionByName(findings.select(*changes.columns))


def diff_history(snapshots: DataFrame, scans: DataFrame) -> DataFrame:
    """Changes between each two consecutive scans of every source, in one job.

    ``scans`` (``source_uri, scan_id``) is the register of all scans: those without
    objects count, rows of scans that are not in it do not. Every snapshot is compared
    with the one before it by giving the older one the ordinal of its successor; the
    window runs over scans, not over their rows.
    """
    order = Window.partitionBy("source_uri").orderBy("scan_id")
    scans = scans.select("source_uri", "scan_id").distinct()
    scans = scans.withColumn("_next", F.lead("scan_id").over(order)).withColumn(
        "_first", F.row_number().over(order) == 1)
    rows = snapshots.join(scans, ["source_uri", "scan_id"])
    old = rows.where("_next is not null").drop("scan_id").withColumnRenamed("_next", "scan_id")
    new = rows.where("not _first")
    return diff_snapshots(old, new, ["source_uri", "scan_id", "object_uri"])

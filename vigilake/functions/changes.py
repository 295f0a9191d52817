"""Change events: severity, detail as JSON, detail as one line of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.fixed import BREAKING_CHANGES, CHANGE_TEXTS


def severity(change_type: Column) -> Column:
    return F.when(change_type.isin(*BREAKING_CHANGES), "breaking").otherwise("info")


def sorted_entries(columns: Column) -> Column:
    """Comparable form of a map: its entries in key order."""
    return F.array_sort(F.map_entries(columns))


def columns_json(columns: Column) -> Column:
    return F.map_from_entries(sorted_entries(columns))


def detail_json(**fields: Column) -> Column:
    """JSON object text with its keys in sorted order."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def describe_change(change_type: Column, detail: Column) -> Column:
    """One line saying what changed, for reports."""

    def text(path: str) -> Column:
        return F.get_json_object(detail, f"$.{path}")

    def keys(path: str) -> Column:
        return F.coalesce(
            F.map_keys(F.from_json(text(path), "map<string,string>")), F.expr("cast(array() as array<string>)"))

    def listed(names: Column, mark: str) -> Column:
        joined = F.array_join(F.transform(F.array_sort(names), lambda n: F.concat(F.lit(mark), n)), ", ")
        return F.when(F.size(names) > 0, joined)

    old, new = keys("old_columns"), keys("new_columns")
    differences = F.concat_ws("; ", listed(F.array_except(new, old), "+"), listed(F.array_except(old, new), "-"))
    summary = F.when(differences == "", CHANGE_TEXTS["reshaped"]).otherwise(differences)
    hours = F.coalesce(text("median_interval_seconds").cast("double"), F.lit(0.0)) / 3600
    n_columns = F.size(keys("columns"))
    typed = F.format_string(CHANGE_TEXTS["column"], text("column"), text("type"))
    return (
        F.when(change_type.isin("column_added", "column_removed"), typed)
        .when(change_type == "column_type_changed",
              F.format_string(CHANGE_TEXTS["column_type_changed"], text("column"), text("old_type"), text("new_type")))
        .when(change_type.isin("file_schema_changed", "fileset_schema_changed"),
              F.when(text("fileset").isNotNull(), F.format_string(CHANGE_TEXTS["fileset_reshaped"], text("fileset"), summary))
              .otherwise(summary))
        .when(change_type == "unrecognized_file", CHANGE_TEXTS["unrecognized_file"])
        .when(change_type == "fileset_overdue", F.format_string(
            CHANGE_TEXTS["fileset_overdue"],
            F.substring(text("last_seen"), 1, 16), F.substring(text("expected_by"), 1, 16), F.bround(hours, 1)))
        .when(change_type == "fileset_suggested", F.format_string(
            CHANGE_TEXTS["fileset_suggested"],
            text("file_count"), F.when(text("via").isNotNull(), F.format_string(CHANGE_TEXTS["via"], F.upper(text("via"))))
            .otherwise(""), text("name"), text("pattern")))
        .when(change_type.rlike("^(table|fileset|endpoint|schema|probe)_(added|removed)$")
              | (change_type == "file_added"),
              F.when(n_columns > 0, F.format_string(CHANGE_TEXTS["columns"], n_columns)).otherwise(""))
        .otherwise("")
    )

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilake.fixed import BREAKING_CHANGES
from vigilake.operators import drift as D
from vigilake.operators import reports as R
from vigilake.operators import snapshots as S

SNAP = "object_uri string, kind string, columns map<string,string>"


def snap(spark, *rows):
    return spark.createDataFrame(list(rows), SNAP)


def events(df):
    return sorted((r.object_uri, r.change_type, r.severity, r.detail) for r in df.collect())


def test_column_changes(spark):
    old = snap(spark, ("t", "table", {"id": "integer", "email": "string"}))
    new = snap(spark, ("t", "table", {"id": "string", "note": "string"}))
    assert events(D.diff_snapshots(old, new)) == [
        ("t", "column_added", "info", '{"column":"note","type":"string"}'),
        ("t", "column_removed", "breaking", '{"column":"email","type":"string"}'),
        ("t", "column_type_changed", "breaking", '{"column":"id","new_type":"string","old_type":"integer"}')]


def test_objects_added_and_removed_by_kind(spark):
    rows = [(k, k, {"b": "y", "a": "x"}) for k in ("table", "file", "fileset", "endpoint", "schema", "probe")]
    some, none = snap(spark, *rows), snap(spark, *rows).where("false")
    assert [(e[1], e[2]) for e in events(D.diff_snapshots(none, some))] == [(f"{k}_added", "info") for k in sorted(r[0] for r in rows)]
    removed = {e[1]: e[2] for e in events(D.diff_snapshots(some, none))}
    assert removed == {"table_removed": "breaking", "fileset_removed": "info", "endpoint_removed": "breaking",
                       "schema_removed": "breaking", "probe_removed": "info"}
    assert events(D.diff_snapshots(none, some))[0][3] == '{"columns":{"a":"x","b":"y"}}'


def test_files_compare_whole_schemas_known_on_both_sides(spark):
    old = snap(spark, ("a", "file", {"x": "1", "y": "2"}), ("b", "file", {"x": "1"}), ("c", "file", {}), ("d", "fileset", {"x": "1"}))
    new = snap(spark, ("a", "file", {"y": "2", "x": "1"}), ("b", "file", {"x": "2"}), ("c", "file", {"x": "1"}), ("d", "fileset", {"x": "3"}))
    assert events(D.diff_snapshots(old, new)) == [
        ("b", "file_schema_changed", "breaking", '{"new_columns":{"x":"2"},"old_columns":{"x":"1"}}'),
        ("d", "fileset_schema_changed", "breaking", '{"new_columns":{"x":"3"},"old_columns":{"x":"1"}}')]


def test_missing_kind_is_a_table_and_null_columns_are_empty(spark):
    old = snap(spark, ("t", None, {"a": "x"}), ("u", "table", None))
    new = snap(spark, ("u", None, {"b": "y"}))
    assert [(e[0], e[1]) for e in events(D.diff_snapshots(old, new))] == [("t", "table_removed"), ("u", "column_added")]


def expected_diff(old, new):
    out = []
    for uri in old.keys() | new.keys():
        o, n = old.get(uri), new.get(uri)
        kind = (n or o)[0]
        if o is None:
            out.append((uri, f"{kind}_added"))
        elif n is None:
            out += [(uri, f"{kind}_removed")] if kind != "file" else []
        elif kind in ("file", "fileset"):
            out += [(uri, f"{kind}_schema_changed")] if o[1] and n[1] and o[1] != n[1] else []
        else:
            for c in o[1].keys() | n[1].keys():
                if c not in o[1]:
                    out.append((uri, "column_added"))
                elif c not in n[1]:
                    out.append((uri, "column_removed"))
                elif o[1][c] != n[1][c]:
                    out.append((uri, "column_type_changed"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_brute_force(spark, seed):
    rnd = random.Random(seed)
    kinds = ["table", "file", "fileset", "endpoint", "probe", "schema"]

    def make():
        return {f"o{i}": (kinds[i % 6], {c: rnd.choice("xyz") for c in "abcde" if rnd.random() < 0.6}) for i in range(60) if rnd.random() < 0.8}

    old, new = make(), make()
    frames = [snap(spark, *[(u, k, c) for u, (k, c) in side.items()]) for side in (old, new)]
    found = sorted((r.object_uri, r.change_type) for r in D.diff_snapshots(*frames).collect())
    assert found == expected_diff(old, new)
    assert D.diff_snapshots(frames[0], frames[0]).count() == 0
    flip = {"column_added": "column_removed", "column_removed": "column_added"}
    back = [(r.object_uri, r.change_type) for r in D.diff_snapshots(frames[1], frames[0]).collect() if r.change_type.startswith("column")]
    assert sorted((u, flip.get(t, t)) for u, t in back) == [e for e in found if e[1].startswith("column")]


def test_first_scan_is_a_silent_baseline(spark):
    rows = snap(spark, ("t", "table", {"a": "x"})).withColumn("source_uri", F.lit("s1"))
    more = rows.unionByName(rows.withColumn("source_uri", F.lit("s2")).withColumn("object_uri", F.lit("u")))
    findings = spark.createDataFrame([("s2", "f", "unrecognized_file", "info", "{}")], "source_uri string, object_uri string, change_type string, severity string, detail string")
    assert [tuple(r)[:3] for r in D.diff_with_baseline(rows, more, more, rows, findings).collect()] == [("s2", "f", "unrecognized_file")]


def test_sources_not_scanned_are_left_alone_and_emptied_ones_reported(spark):
    old = snap(spark, ("a", "table", {"x": "y"})).withColumn("source_uri", F.lit("A")).unionByName(
        snap(spark, ("b", "table", {"x": "y"})).withColumn("source_uri", F.lit("B")))
    new = old.where("source_uri = 'A'")
    sources = lambda *names: spark.createDataFrame([(n,) for n in names], "source_uri string")
    assert D.diff_with_baseline(old, new, sources("A"), sources("A", "B")).count() == 0
    gone = D.diff_with_baseline(old, new, sources("A", "B"), sources("A", "B")).collect()
    assert [(r.source_uri, r.change_type, r.severity) for r in gone] == [("B", "table_removed", "breaking")]


def test_history_compares_consecutive_scans(spark):
    schema = "scan_id bigint, source_uri string, object_uri string, kind string, columns map<string,string>"
    rows = [(1, "s", "t", "table", {"a": "x"}), (4, "s", "t", "table", {"a": "y"}), (9, "s", "t", "table", {"a": "y", "b": "z"}), (9, "s", "u", "table", {}),
            (5, "other", "t", "table", {"q": "x"})]
    found = sorted((r.source_uri, r.scan_id, r.object_uri, r.change_type) for r in D.diff_history(*2 * [spark.createDataFrame(rows, schema)]).collect())
    assert found == [("s", 4, "t", "column_type_changed"), ("s", 9, "t", "column_added"), ("s", 9, "u", "table_added")]


def test_latest_and_merged_snapshots(spark):
    schema = "scan_id bigint, source_uri string, object_uri string, kind string, columns map<string,string>"
    rows = [(1, "s", "a", "file", {}), (2, "s", "b", "file", {}), (1, "r", "c", "file", {})]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.object_uri for r in S.latest_snapshot(df, df).collect()) == ["b", "c"]
    emptied = df.select("source_uri", "scan_id").union(spark.createDataFrame([("s", 3)], "source_uri string, scan_id bigint"))
    assert sorted(r.object_uri for r in S.latest_snapshot(df, emptied).collect()) == ["c"]
    previous = snap(spark, ("f1", "file", {"a": "x"}), ("f2", "file", {"a": "x"}), ("fileset://s/gone", "fileset", {}))
    merged = S.merge_snapshots(previous, snap(spark, ("f2", "file", {"b": "y"})), snap(spark, ("fileset://s/now", "fileset", {})))
    assert sorted((r.object_uri, r.columns) for r in merged.collect()) == [("f1", {"a": "x"}), ("f2", {"b": "y"}), ("fileset://s/now", {})]


def test_changes_of_the_latest_scan_and_gate(spark):
    schema = "scan_id bigint, source_uri string, ts timestamp, object_uri string, change_type string, severity string, detail string"
    t = dt.datetime(2026, 1, 1)
    changes = spark.createDataFrame([
        (1, "s", t, "a", "column_removed", "breaking", "{}"), (3, "r", t + dt.timedelta(days=1), "b", "column_added", "info", '{"column":"c","type":"x"}')], schema)
    snapshots = spark.createDataFrame([(1, "s"), (2, "s"), (3, "r")], "scan_id bigint, source_uri string")
    latest = R.changes_of_latest_scan(changes, snapshots)
    assert [r.object_uri for r in latest.collect()] == ["b"]
    assert tuple(R.gate(latest).first()) == (1, 0, False) and tuple(R.gate(latest, "any").first()) == (1, 0, True)
    assert tuple(R.gate(changes).first()) == (2, 1, True) and tuple(R.gate(changes.where("false"), "any").first()) == (0, 0, False)
    assert [r.object_uri for r in R.changes_since(changes, "2026-01-02").collect()] == ["b"]
    assert [r.summary for r in R.change_report(changes).collect()][1] == "c (x)"
    with pytest.raises(ValueError):
        R.gate(changes, "never")


def test_breaking_list_is_complete():
    assert len(BREAKING_CHANGES) == 8

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vigilake.operators import metrics as M
from vigilake.operators import outliers as Z
from vigilake.operators import reports as R
from vigilake.plans import scan as P
from vigilake.plans.state import State
from vigilake.sources.files import list_files

LISTING = "source string, path string, size bigint, mtime timestamp"
CRAWLED = "path string, columns map<string,string>, num_rows bigint"
DAY0 = dt.datetime(2026, 7, 1, 6)
GOOD = {"id": "integer", "amount": "number"}


@pytest.fixture
def state(spark, tmp_path):
    return State(spark, str(tmp_path / "state"))


def files(spark, *rows):
    listing = spark.createDataFrame([("s", name, 100 + i, DAY0 + dt.timedelta(days=day)) for i, (name, day, _) in enumerate(rows)], LISTING)
    return listing, spark.createDataFrame([(name, columns, 5 if columns else None) for name, _, columns in rows], CRAWLED)


def scan(state, rows, now_day, **options):
    listing, crawled = files(state.spark, *rows)
    return P.scan_files(state, "s", "sftp", listing, crawled=crawled, now=DAY0 + dt.timedelta(days=now_day), **options)


def changes(state, scan_id):
    return sorted((r.change_type, r.object_uri) for r in state.read("changes").where(F.col("scan_id") == scan_id).collect())


FEED = [{"name": "orders", "pattern": "orders_{date}.csv"}]


def test_scans_of_a_landing_zone(state):
    rows = [(f"orders_2026070{d + 1}.csv", d, GOOD) for d in range(3)]
    assert scan(state, rows, 2.5, filesets=FEED) == 1
    assert changes(state, 1) == []
    assert scan(state, rows, 2.6, filesets=FEED) == 2
    assert changes(state, 2) == []
    more = [*rows, ("orders_20260704.csv", 3, {"id": "string"}), ("mystery.bin", 3, {})]
    assert scan(state, more, 3.5, filesets=FEED) == 3
    assert changes(state, 3) == [
        ("file_added", "sftp://s//mystery.bin"), ("file_added", "sftp://s//orders_20260704.csv"),
        ("file_schema_changed", "sftp://s//orders_20260704.csv"), ("unrecognized_file", "sftp://s//mystery.bin")]
    assert scan(state, more, 9, filesets=FEED) == 4
    assert changes(state, 4) == [("fileset_overdue", "fileset://s/orders")]
    assert scan(state, more, 10, filesets=[]) == 5
    assert changes(state, 5) == [("fileset_removed", "fileset://s/orders")]
    snapshot = {r.object_uri: r["columns"] for r in state.snapshot("s", 4).collect()}
    assert len(snapshot) == 6 and snapshot["fileset://s/orders"] == GOOD
    points = state.read("metrics")
    assert sorted({r.uri for r in points.collect()}) == [f"fileset://s/orders/{m}" for m in ("column_count", "file_size", "row_count")]
    assert points.groupBy("uri", "ts").count().where("count > 1").count() == 0 and points.count() == 12
    assert state.current("files").count() == 5 and state.read("arrivals").count() == 4
    latest = R.changes_of_latest_scan(state.read("changes"), state.read("scans"))
    assert [r.change_type for r in latest.collect()] == ["fileset_removed"]


def test_suggestions_during_a_scan(state):
    rows = [("a-1.csv", 0, GOOD), ("a-2.csv", 0, GOOD), ("lonely.txt", 0, {}), ("b_x.log", 0, {}), ("b_y.log", 0, {})]
    claims = state.spark.createDataFrame([(0, "b_logs", "b_*.log", "b_x.log"), (0, "b_logs", "b_*.log", "b_y.log")], "suggestion int, name string, pattern string, path string")
    scan(state, rows, 1, filesets=FEED, outside_claims=claims)
    assert changes(state, 1) == [("fileset_suggested", "fileset://s/a"), ("fileset_suggested", "fileset://s/b_logs"), ("unrecognized_file", "sftp://s//lonely.txt")]


def test_switches(state):
    rows = [("orders_20260701.csv", 0, GOOD), ("odd.bin", 0, {})]
    scan(state, rows, 1, filesets=FEED, alert_unrecognized=False, infer_filesets=False, freshness=False, file_metrics=False)
    assert changes(state, 1) == [] and state.read("arrivals").count() == 0 and state.read("metrics").count() == 0


def test_without_filesets_nothing_is_unrecognized(state):
    scan(state, [("odd.bin", 0, {})], 1)
    assert changes(state, 1) == []


def test_an_unregistered_scan_is_no_baseline(state):
    state.append("snapshots", state.spark.createDataFrame([("sftp://s/", "sftp://s//x", "file", {})], "source_uri string, object_uri string, kind string, columns map<string,string>"), "s", 1)
    assert state.last_scan("s") is None and state.next_scan_id() == 1
    scan(state, [("a.csv", 0, GOOD)], 1)
    assert {r.object_uri for r in state.snapshot("s", 1).collect()} == {"sftp://s//a.csv"}


def test_a_source_that_lost_everything_fails_the_gate(state):
    table = state.spark.range(3)
    P.scan_tables(state, "w", {"db://w/main/d/t": table}, analyze=False, now=DAY0)
    empty = P.scan_tables(state, "w", {}, now=DAY0 + dt.timedelta(days=1))
    latest = R.changes_of_latest_scan(state.read("changes"), state.read("scans"))
    assert [(r.scan_id, r.change_type) for r in latest.collect()] == [(empty, "table_removed")]
    assert R.gate(latest).first().failed


def test_rows_of_a_failed_scan_are_never_read(state):
    snapshot = state.spark.createDataFrame([("db://a/x", "table", {"c": "int"})], "object_uri string, kind string, columns map<string,string>")
    P.scan_snapshot(state, "a", "db://a", snapshot)
    failed = state.start("a")
    ghost = state.spark.createDataFrame([("db://a", DAY0, "db://a/x", "table_removed", "breaking", "{}")],
                                        "source_uri string, ts timestamp, object_uri string, change_type string, severity string, detail string")
    state.append("changes", ghost, "a", failed)
    P.scan_snapshot(state, "b", "db://b", snapshot)
    P.scan_snapshot(state, "a", "db://a", snapshot)
    assert state.read("changes").count() == 0 and state.read("snapshots").count() == 3


def test_inferred_names_are_taken(state):
    rows = [("a-1.csv", 0, GOOD), ("a-2.csv", 0, GOOD), ("b_x.log", 0, {}), ("b_y.log", 0, {})]
    claims = state.spark.createDataFrame([(0, "a", "b_*.log", "b_x.log"), (0, "a", "b_*.log", "b_y.log")], "suggestion int, name string, pattern string, path string")
    scan(state, rows, 1, outside_claims=claims)
    assert [c for c in changes(state, 1) if c[0] == "fileset_suggested"] == [("fileset_suggested", "fileset://s/a")]


def test_scans_of_tables(state):
    spark = state.spark
    orders = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "id int, total double, kind string")
    uri = "db://w/main/default/orders"
    first = P.scan_tables(state, "w", {uri: orders, "db://w/main/default/old": orders}, heavy=True, now=DAY0)
    second = P.scan_tables(state, "w", {uri: orders.drop("total").withColumn("id", F.col("id").cast("bigint"))}, now=DAY0 + dt.timedelta(days=1))
    assert changes(state, first) == []
    assert changes(state, second) == [("column_removed", uri), ("column_type_changed", uri), ("table_removed", "db://w/main/default/old")]
    found = {(r.uri, r.ts): r.metric_value for r in state.read("metrics").collect()}
    assert found[(uri + "/row_count", DAY0)] == 10 and found[(uri + "/kind__unique_count", DAY0)] == 2 and (uri + "/kind__unique_count", DAY0 + dt.timedelta(days=1)) not in found
    assert {r.uri: r.type for r in state.current("fields").collect()}[uri + "/id"] == "bigint"
    assert P.scan_tables(state, "w", {uri: orders}, analyze=False) == 3
    assert state.read("metrics").where("scan_id = 3").count() == 0
    series = M.series(state.read("metrics"))
    assert Z.zscore_outliers(series).count() == 0


def test_snapshots_from_elsewhere(state):
    schema = "object_uri string, kind string, columns map<string,string>"
    one = state.spark.createDataFrame([("api://a/x#get", "endpoint", {"p": "int"})], schema)
    two = state.spark.createDataFrame([("api://a/x#get", "endpoint", {"p": "string"}), ("api://a/probe/q", "probe", {})], schema)
    P.scan_snapshot(state, "a", "api://a", one)
    P.scan_snapshot(state, "a", "api://a", two)
    assert changes(state, 2) == [("column_type_changed", "api://a/x#get"), ("probe_added", "api://a/probe/q")]


def test_scan_of_real_files(state, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "orders_20260701.csv").write_text("id,amount\n1,2.5\n")
    os.utime(root / "orders_20260701.csv", (1_780_000_000, 1_780_000_000))
    P.scan_files(state, "s", "sftp", list_files(state.spark, str(root), "s"), str(root), filesets=FEED)
    (root / "orders_20260702.csv").write_text("id,amount\n1,x\n")
    P.scan_files(state, "s", "sftp", list_files(state.spark, str(root), "s"), str(root), filesets=FEED)
    assert [c for c, _ in changes(state, 2)] == ["file_added", "file_schema_changed"]
    assert {r.file_encoding for r in state.current("files").collect()} == {"utf-8"}

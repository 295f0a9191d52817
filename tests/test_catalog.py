import datetime as dt
import json
import random

import pytest

from vigilake.operators import catalog as K

T0 = dt.datetime(2026, 1, 1)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_upsert_updates_and_insert_keeps(spark):
    schema = "uri string, name string, type string"
    old = frame(spark, schema, ("a", "a", "int"), ("b", "b", "int"))
    new = frame(spark, schema, ("b", "b", "string"), ("c", "c", "int"), ("a", None, None))
    assert sorted(map(tuple, K.upsert(old, new).collect())) == [("a", "a", "int"), ("b", "b", "string"), ("c", "c", "int")]
    assert sorted(map(tuple, K.insert_missing(old, new).collect())) == [("a", "a", "int"), ("b", "b", "int"), ("c", "c", "int")]


def test_source_selection(spark):
    sources = frame(spark, "name string, type string, uri string", ("a", "x", "1"), ("b", "x", "2"))
    assert [r.name for r in K.select_sources(sources, " a ").collect()] == ["a"]
    with pytest.raises(ValueError, match="zz"):
        K.select_sources(sources, "a,zz")


def test_status(spark):
    sources = frame(spark, "name string, type string, uri string", ("a", "database", "db://a"), ("b", "sftp", "sftp://b/"))
    tables = frame(spark, "source_uri string", ("db://a",), ("db://a",))
    files = frame(spark, "source_uri string", ("sftp://b/",))
    assert sorted(map(tuple, K.status_summary(sources, tables, files).collect())) == [("a", "database", 2, 0), ("b", "sftp", 0, 1)]
    scans = frame(spark, "server string, scan_time timestamp", *[("a", T0 + dt.timedelta(days=i)) for i in range(60)], ("old", T0))
    assert {r.server: r.scan_time for r in K.last_scans(scans).collect()} == {"a": T0 + dt.timedelta(days=59), "old": T0}


def payload(day, metrics, field_type="int"):
    table = {"name": "t", "uri": "db://s/t", "db_name": "d", "schema_name": day, "fields": [{"name": "c", "type": field_type, "uri": "db://s/t/c"}], "metrics": metrics}
    file = {"name": "f", "uri": "s3://s//f", "filetype": "csv", "file_encoding": "utf-8", "fields": []}
    return json.dumps({"sources": [{"name": "s", "type": "database", "uri": "db://s", "tables": [table], "files": [file]}], "cli_version": "1"})


def test_tenant_pushes(spark):
    def m(value, ts):
        return {"metric_name": "row_count", "metric_value": value, "uri": "db://s/t/row_count", "ts": ts}

    rows = [
        ("o1", "b1", T0, payload("one", [m("5", "2026-01-01T00:00:00"), m("x", "2026-01-02T00:00:00"), m("7", "bad time")])),
        ("o1", "b2", T0 + dt.timedelta(days=1), payload("two", [m("5", "2026-01-01T00:00:00"), m("9", "2026-01-03T00:00:00")], "string")),
        ("o2", "b1", T0, payload("one", [m("1", "2026-01-01T00:00:00")])),
        ("o3", "b1", T0, "no json"),
    ]
    parts = K.ingest_payloads(frame(spark, "org_id string, batch_id string, received_at timestamp, payload string", *rows))
    points = sorted((r.org_id, r.batch_id, str(r.ts)[:10], r.metric_value) for r in K.dedupe_points(parts["metrics"]).collect())
    assert points == [("o1", "b1", "2026-01-01", 5.0), ("o1", "b1", "2026-01-02", None), ("o1", "b1", "None", 7.0), ("o1", "b2", "2026-01-03", 9.0), ("o2", "b1", "2026-01-01", 1.0)]
    tables = {r.org_id: (r.schema_name, r.last_seen_at) for r in parts["tables"].collect()}
    assert tables == {"o1": ("two", T0 + dt.timedelta(days=1)), "o2": ("one", T0)}
    assert {r.org_id: r.type for r in parts["fields"].collect()} == {"o1": "string", "o2": "int"}
    assert parts["sources"].count() == 2 and parts["files"].count() == 2
    assert sorted((r.org_id, r.source_count) for r in parts["ingests"].where("source_count >= 0").collect()) == [("o1", 1), ("o1", 1), ("o2", 1)]


def test_dashboard(spark):
    anomalies = frame(spark, "anomaly_id int, org_id string, is_acknowledged boolean, created_at timestamp",
                      *[(i, "o", i % 3 == 0, T0 + dt.timedelta(hours=i)) for i in range(20)], (99, "p", False, T0))
    sources = frame(spark, "org_id string", ("o",), ("o",), ("q",))
    assert sorted(map(tuple, K.dashboard_counts(sources, anomalies).collect())) == [("o", 2, 13), ("p", 0, 1), ("q", 1, 0)]
    assert [r.anomaly_id for r in K.recent_anomalies(anomalies, "o").collect()] == list(range(19, 9, -1))
    seen = K.acknowledge(anomalies, "o", 19)
    assert K.anomaly_list(seen, "o", True).count() == 12 and K.anomaly_list(seen, "o").first().anomaly_id == 19
    assert K.acknowledge(anomalies, "p", 19).where("is_acknowledged").count() == 7


def exported(spark, order):
    sources = frame(spark, "name string, type string, uri string", ("s", "database", "db://s"))
    tables = frame(spark, "source_uri string, uri string, name string, db_name string, schema_name string", ("db://s", "db://s/t", "t", "d", "x"), ("db://s", "db://s/u", "u", "d", "x"))
    files = frame(spark, "source_uri string, uri string, name string, filetype string, file_encoding string", ("f://s/", "f://s//a", "a", "csv", "utf-8"))
    fields = [("db://s/t", "c", "int", "db://s/t/c"), ("db://s/t", "b", "int", "db://s/t/b"), ("f://s//a", "x", "string", "f://s//a/x")]
    metrics = [("db://s/t", f"db://s/t/m{i}", T0 + dt.timedelta(days=i % 2), f"m{i}", float(i)) for i in range(6)]
    random.Random(order).shuffle(fields)
    random.Random(order).shuffle(metrics)
    changes = frame(spark, "ts timestamp, source_uri string, object_uri string, change_type string, severity string, detail string", (T0, "db://s", "db://s/t", "table_added", "info", "{}"))
    return K.export_records(sources, tables, files, frame(spark, "owner_uri string, name string, type string, uri string", *fields),
                            frame(spark, "table_uri string, uri string, ts timestamp, metric_name string, metric_value double", *metrics), changes)


def test_export_and_hash(spark):
    records = exported(spark, 1)
    kinds = sorted((r.record, r.key) for r in records.collect())
    assert [k for k, _ in kinds] == ["change", "file", "metrics", "metrics", "source", "table", "table"]
    table = json.loads(records.where("key = 'db://s/t'").first().body)
    assert [f["name"] for f in table["fields"]] == ["b", "c"] and json.loads(records.where("key = 'db://s/u'").first().body)["fields"] == []
    point = json.loads(records.where("record = 'metrics'").orderBy("key").first().body)
    assert [m["metric_name"] for m in point["metrics"]] == ["m0", "m2", "m4"]
    same = K.export_hash(exported(spark, 7).repartition(5)).first()
    assert tuple(K.export_hash(records).first()) == tuple(same)
    assert K.export_hash(records.where("record != 'change'")).first().push_hash != same.push_hash
    assert K.export_hash(records.unionByName(records.limit(1))).first().push_hash != same.push_hash
    assert K.export_hash(records.where("false")).first().records == 0


def test_source_pages(spark):
    sources = frame(spark, "org_id string, uri string, name string, last_seen_at timestamp", ("o", "db://s", "s", T0), ("o", "db://r", "r", T0 + dt.timedelta(days=1)))
    tables = frame(spark, "org_id string, source_uri string, uri string, name string", ("o", "db://s", "db://s/t", "t"), ("o", "db://s", "db://s/u", "u"), ("p", "db://s", "db://s/v", "v"))
    metrics = frame(spark, "org_id string, table_uri string", ("o", "db://s/t"), ("o", "db://s/t"), ("p", "db://s/t"))
    assert sorted(map(tuple, K.source_detail(sources, tables, metrics, "o", "db://s").collect())) == [("s", "db://s/t", "t", 2), ("s", "db://s/u", "u", 0)]
    assert [r.name for r in K.source_list(sources, "o").collect()] == ["r", "s"]
    ingests = frame(spark, "org_id string, batch_id int, received_at timestamp", *[("o", i, T0 + dt.timedelta(hours=i)) for i in range(120)])
    assert [r.batch_id for r in K.ingest_list(ingests, "o").collect()] == list(range(119, 19, -1))

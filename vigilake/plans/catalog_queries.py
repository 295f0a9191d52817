"""Registered queries: catalog upserts, tenants, status, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators import catalog as K
from vigilake.plans import inputs as I
from vigilake.plans.inputs import load, with_ctes
from vigilake.plans.profile_queries import show_ts, sql_ts


def _cells(spark, sf_dir) -> DataFrame:
    """Fields ``owner_uri, uri, name, type`` of customers, on both sides of 1998."""
    owner = F.concat(F.lit("db://lake/"), "o_custkey")
    return load(spark, sf_dir, "orders").groupBy(
        F.when(F.col("o_orderdate") < "1998-01-01", "old").otherwise("new").alias("side"), owner.alias("owner_uri"),
        F.col("o_orderpriority").alias("name"),
    ).agg(F.max("o_orderstatus").alias("type")).withColumn("uri", F.concat_ws("/", "owner_uri", "name"))


def catalog_upsert(spark, sf_dir) -> DataFrame:
    cells = _cells(spark, sf_dir)
    side = [cells.where(F.col("side") == s).select("owner_uri", "uri", "name", "type") for s in ("old", "new")]
    return K.upsert(*side)


def file_catalog_upsert(spark, sf_dir) -> DataFrame:
    """Known files stay as first recorded, new ones are added."""
    files = I.files(spark, sf_dir).select("path", "mtime", F.concat(F.lit("sftp://lake//"), "path").alias("uri"))
    known = files.where("mtime < '2024-01-12'").select("uri", F.col("path").alias("name"), F.lit("utf-8").alias("file_encoding"))
    seen = files.where("mtime >= '2024-01-06'").select("uri", F.col("path").alias("name"), F.lit("cp1252").alias("file_encoding"))
    return K.insert_missing(known, seen)


def _payloads(spark, sf_dir) -> DataFrame:
    """A push per tenant (event type) and day: a table per user group with a field and two points."""
    slots = (
        load(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("org_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 20).alias("slot"))
        .agg(F.max("value").alias("top"))
        .withColumn("uri", F.concat(F.lit("db://x/"), "slot"))
    )
    point = "named_struct('metric_name', 'value__max', 'metric_value', {v}, 'uri', concat(uri, '/value__max'), 'ts', {t})"
    value = "if(slot % 7 = 0, 'n/a', cast(top as string))"
    points = f"array({point.format(v=value, t='day')}, {point.format(v=value, t=chr(39) + '2024-01-01T00:00:00' + chr(39))}, " \
             f"{point.format(v='cast(top as string)', t='if(slot = 3, ' + chr(39) + 'never' + chr(39) + ', day)')})"
    table = F.struct(
        F.concat(F.lit("t"), "slot").alias("name"), "uri", F.lit("d").alias("db_name"), F.col("day").alias("schema_name"),
        F.expr("array(named_struct('name', 'value', 'type', if(top > 30, 'number', 'integer'), 'uri', concat(uri, '/value')))").alias("fields"),
        F.expr(points).alias("metrics"))
    file = F.struct(F.col("day").alias("name"), F.concat(F.lit("s3://x//"), "slot").alias("uri"), F.lit("csv").alias("filetype"),
                    F.lit("utf-8").alias("file_encoding"), F.expr("array(named_struct('name', 'c', 'type', day, 'uri', concat('s3://x//', slot, '/c')))").alias("fields"))
    # At most twenty tables per push, by construction.
    pushed = slots.groupBy("org_id", "day").agg(F.collect_list(table).alias("tables"), F.collect_list(file).alias("files"))
    source = F.struct(F.lit("x").alias("name"), F.lit("database").alias("type"), F.lit("db://x").alias("uri"), "tables", "files")
    return pushed.select(
        "org_id", F.col("day").alias("batch_id"), F.col("day").cast("timestamp").alias("received_at"),
        F.to_json(F.struct(F.array(source).alias("sources"), F.lit("1").alias("cli_version"))).alias("payload"))


def tenant_ingest(spark, sf_dir) -> DataFrame:
    points = K.dedupe_points(K.ingest_payloads(_payloads(spark, sf_dir))["metrics"])
    return points.select("org_id", "batch_id", "table_uri", "uri", "metric_name", show_ts(), "metric_value")


def tenant_catalog(spark, sf_dir) -> DataFrame:
    """Newest state of every tenant's sources, tables, files and fields."""
    parts = K.ingest_payloads(_payloads(spark, sf_dir))
    rows = [
        parts["sources"].select("org_id", F.lit("source").alias("record"), "uri", F.col("type").alias("state"), show_ts("last_seen_at")),
        parts["tables"].select("org_id", F.lit("table").alias("record"), "uri", F.col("schema_name").alias("state"), show_ts("last_seen_at")),
        parts["files"].select("org_id", F.lit("file").alias("record"), "uri", F.col("name").alias("state"), show_ts("last_seen_at")),
        parts["fields"].select("org_id", F.lit("field").alias("record"), "uri", F.col("type").alias("state"), show_ts("last_seen_at")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def ingest_list(spark, sf_dir) -> DataFrame:
    ingests = K.ingest_payloads(_payloads(spark, sf_dir))["ingests"]
    return K.ingest_list(ingests, "click").select("org_id", "batch_id", show_ts("received_at"), F.col("source_count").cast("bigint").alias("source_count"))


def _sources(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.lit("database").alias("type"), F.concat(F.lit("db://"), "n_nationkey").alias("uri"))


def status_summary(spark, sf_dir) -> DataFrame:
    """Nations are sources, suppliers their tables, customers their files."""
    tables = load(spark, sf_dir, "supplier").select(F.concat(F.lit("db://"), "s_nationkey").alias("source_uri"))
    files = load(spark, sf_dir, "customer").select(F.concat(F.lit("db://"), "c_nationkey").alias("source_uri"))
    return K.status_summary(_sources(spark, sf_dir), tables, files)


def select_sources(spark, sf_dir) -> DataFrame:
    sources = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("last_seen"))
    return K.select_sources(sources, "click, view").select("name", show_ts("last_seen"))


def last_scan_per_source(spark, sf_dir) -> DataFrame:
    scans = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("server"), F.col("o_orderdate").alias("scan_time"))
    return K.last_scans(scans).select("server", show_ts("scan_time"))


def source_detail(spark, sf_dir) -> DataFrame:
    events = load(spark, sf_dir, "events")
    source = F.concat(F.lit("db://s"), F.col("user_id") % 3)
    sources = events.select(F.col("event_type").alias("org_id"), source.alias("uri"), F.concat(F.lit("name of "), source).alias("name")).distinct()
    table = F.concat(source, F.lit("/"), "user_id")
    tables = events.select(F.col("event_type").alias("org_id"), source.alias("source_uri"), table.alias("uri"), F.concat(F.lit("t"), "user_id").alias("name")).distinct()
    metrics = events.select(F.col("event_type").alias("org_id"), table.alias("table_uri"))
    return K.source_detail(sources, tables, metrics, "view", "db://s1")


def source_list(spark, sf_dir) -> DataFrame:
    sources = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("org_id"), F.concat(F.lit("db://"), "user_id").alias("uri")).agg(
        F.max("ts").alias("last_seen_at"))
    return K.source_list(sources, "click").select("org_id", "uri", show_ts("last_seen_at"))


def dashboard_counts(spark, sf_dir) -> DataFrame:
    sources = load(spark, sf_dir, "events").select(F.col("event_type").alias("org_id"), "user_id").distinct()
    return K.dashboard_counts(sources, I.anomalies(spark, sf_dir))


def recent_anomalies(spark, sf_dir) -> DataFrame:
    return K.recent_anomalies(I.anomalies(spark, sf_dir), "click").select(
        "anomaly_id", "org_id", "metric_uri", "observed_value", "is_acknowledged", show_ts("created_at"))


def open_anomalies(spark, sf_dir) -> DataFrame:
    """Unacknowledged anomalies after one of them was acknowledged."""
    rows = K.acknowledge(I.anomalies(spark, sf_dir), "click", 1)
    return K.anomaly_list(rows, unacknowledged_only=True).select("anomaly_id", "org_id", "metric_uri", "observed_value", show_ts("created_at"))


def _export(spark, sf_dir) -> DataFrame:
    cells = _cells(spark, sf_dir).where("side = 'new'")
    orders = load(spark, sf_dir, "orders")
    files = I.files(spark, sf_dir)
    file_uri = F.concat(F.lit("sftp://lake//"), "path")
    table = F.concat(F.lit("db://lake/"), "o_custkey")
    points = orders.groupBy(table.alias("table_uri"), F.date_trunc("year", "o_orderdate").alias("ts")).agg(
        F.count("*").cast("double").alias("row_count"), F.max("o_custkey").cast("double").alias("o_custkey__max"))
    metrics = points.unpivot(["table_uri", "ts"], ["row_count", "o_custkey__max"], "metric_name", "metric_value").withColumn(
        "uri", F.concat_ws("/", "table_uri", "metric_name"))
    return K.export_records(
        _sources(spark, sf_dir),
        orders.select(F.lit("db://lake").alias("source_uri"), F.concat(F.lit("c"), "o_custkey").alias("name"), table.alias("uri"),
                      F.lit("main").alias("db_name"), F.lit("s").alias("schema_name")).distinct(),
        files.select(F.lit("sftp://lake/").alias("source_uri"), F.col("path").alias("name"), file_uri.alias("uri"),
                     F.lit("x").alias("filetype"), F.lit("utf-8").alias("file_encoding")),
        cells.select("owner_uri", "name", "type", "uri").unionByName(files.select(
            file_uri.alias("owner_uri"), F.explode("columns").alias("name", "type"), file_uri.alias("f")).select(
            "owner_uri", "name", "type", F.concat_ws("/", "f", "name").alias("uri"))),
        metrics,
        I.recorded_changes(spark, sf_dir),
    )


def scan_payload(spark, sf_dir) -> DataFrame:
    return _export(spark, sf_dir)


def payload_hash(spark, sf_dir) -> DataFrame:
    return K.export_hash(_export(spark, sf_dir))


_EXPORT = with_ctes("files changes", r"""
, cells AS (SELECT 'db://lake/' || o_custkey o, o_orderpriority n, max(o_orderstatus) t FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2),
  tf AS (SELECT o, string_agg('{"name":"' || n || '","type":"' || t || '","uri":"' || o || '/' || n || '"}', ',' ORDER BY n) f FROM cells GROUP BY o),
  yearly AS (SELECT 'db://lake/' || o_custkey t, strftime(date_trunc('year', o_orderdate), '%Y-%m-%dT%H:%M:%S.%f') ts, count(*)::DOUBLE c, max(o_custkey)::DOUBLE m
    FROM orders GROUP BY o_custkey, date_trunc('year', o_orderdate)),
  ff AS (SELECT path, 'sftp://lake//' || path u, coalesce('{' || nullif(replace(replace(cols, '":"', '","type":"'), '","', '","'), '') || '}', '') c, cols FROM files),
  fc AS (SELECT path, unnest(CASE WHEN cols = '' THEN []::VARCHAR[] ELSE string_split(cols, ',') END) e FROM files),
  fl AS (SELECT path, string_agg('{"name":' || split_part(e, ':', 1) || ',"type":' || split_part(e, ':', 2) || ',"uri":"sftp://lake//' || path || '/'
    || replace(split_part(e, ':', 1), '"', '') || '"}', ',' ORDER BY e) f FROM fc GROUP BY path),
  records AS (
    SELECT 'source' record, 'db://' || n_nationkey AS "key", '{"name":"' || n_name || '","type":"database","uri":"db://' || n_nationkey || '"}' body FROM nation
    UNION ALL SELECT 'table', t.u, '{"source_uri":"db://lake","name":"c' || k || '","uri":"' || t.u || '","db_name":"main","schema_name":"s","fields":[' || coalesce(f, '') || ']}'
      FROM (SELECT DISTINCT o_custkey k, 'db://lake/' || o_custkey u FROM orders) t LEFT JOIN tf ON tf.o = t.u
    UNION ALL SELECT 'file', 'sftp://lake//' || path, '{"source_uri":"sftp://lake/","name":"' || path || '","uri":"sftp://lake//' || path
      || '","filetype":"x","file_encoding":"utf-8","fields":[' || coalesce(f, '') || ']}' FROM files LEFT JOIN fl USING (path)
    UNION ALL SELECT 'metrics', t || '@' || ts, '{"table_uri":"' || t || '","ts":"' || ts || '","metrics":[{"metric_name":"o_custkey__max","metric_value":' || m
      || ',"uri":"' || t || '/o_custkey__max"},{"metric_name":"row_count","metric_value":' || c || ',"uri":"' || t || '/row_count"}]}' FROM yearly
    UNION ALL SELECT 'change', object_uri || '@' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","source_uri":"' || source_uri
      || '","object_uri":"' || object_uri || '","change_type":"' || change_type || '","severity":"' || severity || '","detail":"' || replace(detail, '"', '\"') || '"}' FROM changes)
""").replace("""
  ff AS (SELECT path, 'sftp://lake//' || path u, coalesce('{' || nullif(replace(replace(cols, '":"', '","type":"'), '","', '","'), '') || '}', '') c, cols FROM files),""", "")

_SLOTS = """
WITH s AS (SELECT event_type org_id, strftime(ts, '%Y-%m-%d') d, user_id % 20 slot, max(value) top FROM events GROUP BY 1, 2, 3)
"""

QUERIES = {
    "catalog_upsert": (catalog_upsert, """
WITH c AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' old, 'db://lake/' || o_custkey owner_uri, o_orderpriority AS name, max(o_orderstatus) AS type FROM orders GROUP BY 1, 2, 3)
SELECT owner_uri, owner_uri || '/' || name AS uri, name, coalesce(max(type) FILTER (WHERE NOT old), max(type)) AS type FROM c GROUP BY owner_uri, name"""),
    "file_catalog_upsert": (file_catalog_upsert, with_ctes("files", """
SELECT 'sftp://lake//' || path AS uri, path AS name, CASE WHEN mtime < TIMESTAMP '2024-01-12' THEN 'utf-8' ELSE 'cp1252' END AS file_encoding FROM files""")),
    "tenant_ingest": (tenant_ingest, _SLOTS + f"""
, p AS (SELECT org_id, d, slot, 0 pos, d::TIMESTAMP ts, CASE WHEN slot % 7 = 0 THEN NULL ELSE top END v FROM s
    UNION ALL SELECT org_id, d, slot, 1, TIMESTAMP '2024-01-01', CASE WHEN slot % 7 = 0 THEN NULL ELSE top END FROM s
    UNION ALL SELECT org_id, d, slot, 2, CASE WHEN slot = 3 THEN NULL ELSE d::TIMESTAMP END, top FROM s)
SELECT org_id, d AS batch_id, 'db://x/' || slot AS table_uri, 'db://x/' || slot || '/value__max' AS uri, 'value__max' AS metric_name, {sql_ts('ts')}, v AS metric_value
FROM p QUALIFY row_number() OVER (PARTITION BY org_id, slot, ts ORDER BY d, pos) = 1"""),
    "tenant_catalog": (tenant_catalog, _SLOTS + """
, last AS (SELECT org_id, slot, max(d) d, arg_max(top, d) top FROM s GROUP BY 1, 2)
SELECT org_id, 'source' AS record, 'db://x' AS uri, 'database' AS state, max(d) || ' 00:00:00.000000' AS last_seen_at FROM s GROUP BY org_id
UNION ALL SELECT org_id, 'table', 'db://x/' || slot, d, d || ' 00:00:00.000000' FROM last
UNION ALL SELECT org_id, 'file', 's3://x//' || slot, d, d || ' 00:00:00.000000' FROM last
UNION ALL SELECT org_id, 'field', 'db://x/' || slot || '/value', CASE WHEN top > 30 THEN 'number' ELSE 'integer' END, d || ' 00:00:00.000000' FROM last
UNION ALL SELECT org_id, 'field', 's3://x//' || slot || '/c', d, d || ' 00:00:00.000000' FROM last"""),
    "ingest_list": (ingest_list, """
SELECT 'click' AS org_id, strftime(ts, '%Y-%m-%d') AS batch_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS received_at, 1::BIGINT AS source_count
FROM events WHERE event_type = 'click' GROUP BY date_trunc('day', ts), strftime(ts, '%Y-%m-%d') ORDER BY 3 DESC LIMIT 100"""),
    "status_summary": (status_summary, """
SELECT n_name AS name, 'database' AS type, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS "tables",
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS files FROM nation"""),
    "select_sources": (select_sources, f"""
SELECT event_type AS name, {sql_ts('max(ts)', 'last_seen')} FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type"""),
    "last_scan_per_source": (last_scan_per_source, f"""
SELECT o_custkey AS server, {sql_ts('max(o_orderdate)', 'scan_time')} FROM orders GROUP BY o_custkey"""),
    "source_detail": (source_detail, """
SELECT 'name of db://s1' AS source_name, 'db://s1/' || user_id AS uri, 't' || user_id AS name, count(*) AS metrics
FROM events WHERE event_type = 'view' AND user_id % 3 = 1 GROUP BY user_id"""),
    "source_list": (source_list, f"""
SELECT 'click' AS org_id, 'db://' || user_id AS uri, {sql_ts('max(ts)', 'last_seen_at')} FROM events WHERE event_type = 'click' GROUP BY user_id"""),
    "dashboard_counts": (dashboard_counts, with_ctes("anomalies", """
SELECT event_type AS org_id, count(DISTINCT user_id) AS source_count,
  (SELECT count(*) FROM anomalies a WHERE a.org_id = e.event_type AND NOT is_acknowledged) AS open_anomalies FROM events e GROUP BY event_type""")),
    "recent_anomalies": (recent_anomalies, with_ctes("anomalies", f"""
SELECT anomaly_id, org_id, metric_uri, observed_value, is_acknowledged, {sql_ts('created_at')} FROM anomalies WHERE org_id = 'click'
ORDER BY anomalies.created_at DESC, anomaly_id LIMIT 10""")),
    "open_anomalies": (open_anomalies, with_ctes("anomalies", f"""
SELECT anomaly_id, org_id, metric_uri, observed_value, {sql_ts('created_at')} FROM anomalies
WHERE NOT is_acknowledged AND NOT (org_id = 'click' AND anomaly_id = 1)""")),
    "scan_payload": (scan_payload, _EXPORT + 'SELECT record, "key", body FROM records'),
    "payload_hash": (payload_hash, _EXPORT + """
, digests AS (SELECT sha256(concat_ws('|', record, "key", body)) h FROM records)
SELECT count(*) AS records, sha256(concat_ws('-', sum(('0x' || h[1:15])::BIGINT), sum(('0x' || h[16:30])::BIGINT),
  sum(('0x' || h[31:45])::BIGINT), sum(('0x' || h[46:60])::BIGINT))) AS push_hash FROM digests"""),
}

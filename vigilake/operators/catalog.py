"""The catalog of sources, tables, files and fields: upserts, status, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.scale import first_per_key


def _one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else rows.distinct()


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("uri",)) -> DataFrame:
    """Insert by key; a row already there takes the incoming non-null values.

    Of several incoming rows of a key the first in the order of all columns counts.
    """
    keys = list(keys)
    incoming = _one_per_key(incoming, keys)
    values = [c for c in existing.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values if c in incoming.columns])
    merged = existing.join(new, keys, "full_outer")
    return merged.select(*keys, *[
        F.coalesce(f"_new_{c}", c).alias(c) if c in incoming.columns else F.col(c) for c in values
    ]).select(*existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("uri",)) -> DataFrame:
    """Insert by key; rows already there stay as they are.

    Of several incoming rows of a key the first in the order of all columns counts.
    """
    missing = _one_per_key(incoming, list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(missing.select(*existing.columns))


def select_sources(sources: DataFrame, names: str) -> DataFrame:
    """The sources named in a comma list; an unknown name is an error."""
    wanted = sorted({n.strip() for n in names.split(",")})
    chosen = sources.where(F.col("name").isin(*wanted))
    found = {r.name for r in chosen.select("name").distinct().limit(len(wanted)).collect()}
    missing = [n for n in wanted if n not in found]
    if missing:
        raise ValueError(f"unknown sources: {', '.join(missing)}")
    return chosen


def status_summary(sources: DataFrame, tables: DataFrame, files: DataFrame) -> DataFrame:
    """Number of tables and files per source, counted before joining."""
    n_tables = tables.groupBy("source_uri").agg(F.count("*").alias("tables"))
    n_files = files.groupBy("source_uri").agg(F.count("*").alias("files"))
    named = sources.withColumnRenamed("uri", "source_uri")
    return (
        named.join(n_tables, "source_uri", "left").join(n_files, "source_uri", "left")
        .select("name", "type", F.coalesce("tables", F.lit(0)).alias("tables"),
                F.coalesce("files", F.lit(0)).alias("files"))
    )


def last_scans(scans: DataFrame) -> DataFrame:
    """Newest scan of every server."""
    return scans.groupBy("server").agg(F.max("scan_time").alias("scan_time"))


def source_detail(sources: DataFrame, tables: DataFrame, metrics: DataFrame, org_id, source_uri: str) -> DataFrame:
    """One tenant source's tables with the number of metric points of each."""
    mine = tables.where((F.col("org_id") == org_id) & (F.col("source_uri") == source_uri))
    counts = metrics.where(F.col("org_id") == org_id).groupBy("table_uri").agg(F.count("*").alias("metrics"))
    owner = sources.where((F.col("org_id") == org_id) & (F.col("uri") == source_uri)).select(
        F.col("uri").alias("source_uri"), F.col("name").alias("source_name"))
    return (
        owner.join(mine, "source_uri")
        .join(counts.withColumnRenamed("table_uri", "uri"), "uri", "left")
        .select("source_name", "uri", "name", F.coalesce("metrics", F.lit(0)).alias("metrics"))
    )


def source_list(sources: DataFrame, org_id) -> DataFrame:
    return sources.where(F.col("org_id") == org_id).orderBy(F.desc("last_seen_at"))


def ingest_list(ingests: DataFrame, org_id, limit: int = 100) -> DataFrame:
    return ingests.where(F.col("org_id") == org_id).orderBy(F.desc("received_at")).limit(limit)


def dashboard_counts(sources: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Sources and open anomalies of every tenant."""
    n_sources = sources.groupBy("org_id").agg(F.count("*").alias("source_count"))
    n_open = anomalies.where("not is_acknowledged").groupBy("org_id").agg(F.count("*").alias("open_anomalies"))
    return n_sources.join(n_open, "org_id", "full_outer").select(
        "org_id", F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.coalesce("open_anomalies", F.lit(0)).alias("open_anomalies"))


def recent_anomalies(anomalies: DataFrame, org_id, limit: int = 10, tie: str = "anomaly_id") -> DataFrame:
    return anomalies.where(F.col("org_id") == org_id).orderBy(F.desc("created_at"), tie).limit(limit)


def anomaly_list(anomalies: DataFrame, org_id=None, unacknowledged_only: bool = False) -> DataFrame:
    rows = anomalies if org_id is None else anomalies.where(F.col("org_id") == org_id)
    if unacknowledged_only:
        rows = rows.where("not is_acknowledged")
    return rows.orderBy(F.desc("created_at"))


def acknowledge(anomalies: DataFrame, org_id, anomaly_id) -> DataFrame:
    """The anomalies with one of a tenant's marked as seen."""
    hit = (F.col("org_id") == org_id) & (F.col("anomaly_id") == anomaly_id)
    return anomalies.withColumn("is_acknowledged", F.col("is_acknowledged") | hit)


def export_records(
    sources: DataFrame, tables: DataFrame, files: DataFrame, fields: DataFrame, metrics: DataFrame, changes: DataFrame
) -> DataFrame:
    """The whole catalog as JSON records ``record, key, body``, one object per record.

    A record is a source, a table or file with its fields, the points a table got at
    one time, or a change. Fields per object and points per scan are bounded by a
    schema's width, so no record grows with the data.
    """
    listed = F.array_sort(F.collect_list(F.struct("name", "type", "uri")))
    per_owner = fields.groupBy("owner_uri").agg(listed.alias("fields"))

    def with_fields(objects: DataFrame) -> DataFrame:
        none = F.expr("cast(array() as array<struct<name:string,type:string,uri:string>>)")
        return objects.join(per_owner, objects["uri"] == per_owner["owner_uri"], "left").withColumn(
            "fields", F.coalesce("fields", none)).drop("owner_uri")

    def records(kind: str, rows: DataFrame, key, *columns) -> DataFrame:
        return rows.select(F.lit(kind).alias("record"), key.alias("key"), F.to_json(F.struct(*columns)).alias("body"))

    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    points = metrics.groupBy("table_uri", when.alias("ts")).agg(
        F.array_sort(F.collect_list(F.struct("metric_name", "metric_value", "uri"))).alias("metrics"))
    parts = [
        records("source", sources, F.col("uri"), "name", "type", "uri"),
        records("table", with_fields(tables), F.col("uri"),
                "source_uri", "name", "uri", "db_name", "schema_name", "fields"),
        records("file", with_fields(files), F.col("uri"),
                "source_uri", "name", "uri", "filetype", "file_encoding", "fields"),
        records("metrics", points, F.concat_ws("@", "table_uri", "ts"), "table_uri", "ts", "metrics"),
        records("change", changes, F.concat_ws("@", "object_uri", when), when.alias("ts"), "source_uri", "object_uri",
                "change_type", "severity", "detail"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def export_hash(records: DataFrame) -> DataFrame:
    """One hash of all records, the same for any order: ``records, push_hash``.

    Each record is hashed where it lies; the digests are added up slice by slice as
    exact decimals, and the sums are hashed.
    """
    digest = F.sha2(F.concat_ws("|", "record", "key", "body"), 256)
    slices = [F.conv(F.substring("_digest", start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16, 31, 46)]
    sums = [F.coalesce(F.sum(s), F.lit(0)).cast("string") for s in slices]
    return records.withColumn("_digest", digest).agg(
        F.count("*").alias("records"), F.sha2(F.concat_ws("-", *sums), 256).alias("push_hash"))


def ingest_payloads(payloads: DataFrame) -> dict[str, DataFrame]:
    """Tenant pushes (``org_id, batch_id, received_at, payload``) as flat catalog rows.

    ``payload`` is a JSON object with ``sources``, each with ``tables`` and ``files``.
    A ``push_hash`` column stays with the ingests. Times and numbers that do not parse become null. Returns ``sources, tables,
    files, fields, metrics, ingests``; the newest push of an object wins.
    """
    field = "struct<name:string,type:string,uri:string>"
    metric = "struct<metric_name:string,metric_value:string,uri:string,ts:string>"
    table = (f"struct<name:string,uri:string,db_name:string,schema_name:string,fields:array<{field}>,"
             f"metrics:array<{metric}>>")
    file = f"struct<name:string,uri:string,filetype:string,file_encoding:string,fields:array<{field}>>"
    source = f"struct<name:string,type:string,uri:string,tables:array<{table}>,files:array<{file}>>"
    push = ["org_id", "batch_id", "received_at"]
    parsed = payloads.withColumn("_p", F.from_json("payload", f"sources array<{source}>, cli_version string"))
    each_source = parsed.select(*push, F.explode("_p.sources").alias("s"))
    each_table = each_source.select(*push, F.col("s.uri").alias("source_uri"), F.explode("s.tables").alias("t"))
    each_file = each_source.select(*push, F.col("s.uri").alias("source_uri"), F.explode("s.files").alias("f"))

    def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = F.struct("received_at", "batch_id")
        rest = [c for c in rows.columns if c not in [*keys, *push]]
        return rows.groupBy(*keys).agg(
            F.max_by(F.struct(*rest), order).alias("_r"), F.max("received_at").alias("last_seen_at")
        ).select(*keys, "_r.*", "last_seen_at")

    fields = each_table.select(*push, F.col("t.uri").alias("owner_uri"), F.explode("t.fields").alias("c")).unionByName(
        each_file.select(*push, F.col("f.uri").alias("owner_uri"), F.explode("f.fields").alias("c")))
    metrics = each_table.select(
        *push, F.col("t.uri").alias("table_uri"), F.posexplode("t.metrics").alias("pos", "m")
    ).select(
        *push, "table_uri", "pos", F.col("m.uri").alias("uri"), F.col("m.metric_name").alias("metric_name"),
        F.col("m.ts").try_cast("timestamp").alias("ts"), F.col("m.metric_value").try_cast("double").alias("metric_value"))
    return {
        "ingests": parsed.select(
            *push, *[c for c in payloads.columns if c == "push_hash"], F.size("_p.sources").alias("source_count"), "_p.cli_version"),
        "sources": latest(each_source.select(*push, "s.name", "s.type", "s.uri"), ["org_id", "uri"]),
        "tables": latest(each_table.select(
            *push, "source_uri", "t.name", "t.uri", "t.db_name", "t.schema_name"), ["org_id", "uri"]),
        "files": latest(each_file.select(
            *push, "source_uri", "f.name", "f.uri", "f.filetype", "f.file_encoding"), ["org_id", "uri"]),
        "fields": latest(fields.select(*push, "owner_uri", "c.name", "c.type", "c.uri"), ["org_id", "uri"]),
        "metrics": metrics,
    }


def dedupe_points(metrics: DataFrame) -> DataFrame:
    """One point per (org, uri, ts): pushes repeat history, the first push of a point stays."""
    return first_per_key(metrics, ["org_id", "uri", "ts"], [F.col("received_at"), F.col("batch_id"), F.col("pos")])

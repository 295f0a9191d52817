"""Pushed catalogs of many tenants: store what is new, find anomalies in it."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.operators.catalog import dedupe_points, ingest_payloads
from vigilake.operators.outliers import anomaly_records, batch_anomalies
from vigilake.operators.scale import first_per_key
from vigilake.session import cut_lineage

# Logs of the tenants; each batch of pushes is one folder of every log.
LAYOUTS = {
    "ingests": "org_id string, received_at timestamp, source_count int, cli_version string, push_hash string",
    "sources": "org_id string, uri string, name string, type string, last_seen_at timestamp",
    "tables": "org_id string, uri string, source_uri string, name string, db_name string, schema_name string, last_seen_at timestamp",
    "files": "org_id string, uri string, source_uri string, name string, filetype string, file_encoding string, last_seen_at timestamp",
    "fields": "org_id string, uri string, owner_uri string, name string, type string, last_seen_at timestamp",
    "metrics": "org_id string, table_uri string, uri string, metric_name string, ts timestamp, metric_value double",
    "anomalies": (
        "anomaly_id string, org_id string, metric_uri string, metric_name string, table_uri string, anomaly_ts timestamp, "
        "observed_value double, z_score double, algorithm string, is_acknowledged boolean, alert_sent boolean, created_at timestamp"),
}


class TenantState:
    """Append-only logs of pushes under one folder; a repeated batch replaces itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, name: str, rows: DataFrame, batch_id: str) -> None:
        layout = T.StructType.fromDDL(LAYOUTS[name])
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in layout]).write.mode("overwrite").parquet(
            f"{self.root}/{name}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        layout = T.StructType.fromDDL(LAYOUTS[name]).add("batch_id", T.StringType())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(f"{self.root}/{name}")

    def current(self, name: str) -> DataFrame:
        """Newest row of every object of a tenant."""
        return first_per_key(self.read(name), ["org_id", "uri"], [-F.unix_micros("last_seen_at"), F.col("batch_id")])


def push_hash(payload: Column) -> Column:
    """Hash of a push without the client's version; the order of a payload's members does not count.

    Members of objects are sorted by the parser. Text that is no JSON is hashed as it is.
    """
    value = F.try_parse_json(payload)
    # Of the payload's members only the version may differ between equal pushes.
    members = F.try_variant_get(value, "$", "map<string,variant>")
    rest = F.to_json(F.map_filter(members, lambda k, v: k != "cli_version"))
    return F.sha2(F.coalesce(rest, payload), 256)


def ingest_batch(
    state: TenantState, pushes: DataFrame, batch_id: str, threshold: float = 3.0, now: datetime.datetime | None = None
) -> DataFrame:
    """Store one batch of pushes (``org_id, received_at, payload``) and return its anomalies.

    A push a tenant has made before is skipped; points already stored are not stored again.
    """
    now = now or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    hashed = pushes.withColumn("push_hash", push_hash(F.col("payload"))).withColumn("batch_id", F.lit(batch_id))
    before = state.read("ingests").where(F.col("batch_id") != batch_id)
    fresh = first_per_key(
        hashed.join(before.select("org_id", "push_hash"), ["org_id", "push_hash"], "left_anti"),
        ["org_id", "push_hash"], [F.col("received_at")])
    fresh = cut_lineage(fresh)
    parts = ingest_payloads(fresh)
    for name in ("sources", "tables", "files", "fields"):
        state.append(name, parts[name], batch_id)
    points = dedupe_points(parts["metrics"])
    stored = state.read("metrics").where(F.col("batch_id") != batch_id)
    # Points without a time cannot be told apart from stored ones and are kept per push.
    new = points.join(stored.select("org_id", "uri", "ts"), ["org_id", "uri", "ts"], "left_anti")
    state.append("metrics", new, batch_id)
    created = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    metrics = state.read("metrics")
    touched = metrics.where(F.col("batch_id") == batch_id).select("org_id", "uri").distinct()
    history = metrics.join(touched, ["org_id", "uri"], "left_semi")
    state.append("anomalies", anomaly_records(batch_anomalies(history, batch_id, threshold), created), batch_id)
    state.append("ingests", parts["ingests"], batch_id)
    return state.read("anomalies").where(F.col("batch_id") == batch_id)

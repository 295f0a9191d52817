"""Inputs of the registered queries, derived from the given tables.

Each input exists twice: as a DataFrame here, and as a SQL common table expression
of the same name and columns in ``CTES``, so a query and its SQL counterpart start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.filesets import Fileset

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
SOURCE = "lake"
NOW = "2024-02-05 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; times become instants in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local_times = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local_times}) if local_times else df


def table_uri_of(name: str) -> str:
    return f"db://{SOURCE}/main/default/{name}"


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily count and mean of each event type as metric points."""
    daily = load(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(
        F.count("*").cast("double").alias("row_count"), F.avg("value").alias("value__avg"))
    return _to_points(daily, F.concat(F.lit("db://lake/main/events/"), "event_type"), ["row_count", "value__avg"])


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals per status and priority as metric points."""
    monthly = load(spark, sf_dir, "orders").groupBy(
        "o_orderstatus", "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("ts")
    ).agg(F.count("*").cast("double").alias("row_count"), F.max("o_totalprice").alias("o_totalprice__max"))
    owner = F.concat(F.lit("db://lake/main/orders/"), "o_orderstatus", F.lit("-"), "o_orderpriority")
    return _to_points(monthly, owner, ["row_count", "o_totalprice__max"])


def shipping_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped quantity per supplier as metric points: one series per supplier."""
    daily = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("l_quantity__sum"))
    return _to_points(daily, F.concat(F.lit("db://lake/main/shipping/"), "l_suppkey"), ["l_quantity__sum"])


def _to_points(wide: DataFrame, owner, metrics: list[str]) -> DataFrame:
    return wide.withColumn("owner", owner).unpivot(["owner", "ts"], metrics, "metric_name", "metric_value").select(
        F.concat_ws("/", "owner", "metric_name").alias("uri"), "ts", "metric_name", "metric_value")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir).unionByName(order_points(spark, sf_dir)).unionByName(
        shipping_points(spark, sf_dir))


_FILE_NAME = """
concat(user_id, '/', case event_type
  when 'click' then concat('click_', date_format(ts, 'yyyy-MM-dd'), '.csv')
  when 'view' then concat('view_', date_format(ts, 'yyyyMMdd'), 'T', date_format(ts, 'HHmmss'), '.jsonl.gz')
  when 'error' then concat('error-', lpad(cast(event_id as string), 8, '0'), '.JSON')
  when 'purchase' then concat('export_', substr(md5(cast(event_id as string)), 1, 8), '-',
    substr(md5(cast(event_id as string)), 9, 4), '-', substr(md5(cast(event_id as string)), 13, 4), '-',
    substr(md5(cast(event_id as string)), 17, 4), '-', substr(md5(cast(event_id as string)), 21, 12), '.parquet')
  else concat('signup ', date_format(ts, 'HH:mm:ss'), '.v', event_id % 3) end)
"""
_FILE_COLUMNS = """
case when pos % 10 = 3 then cast(map() as map<string,string>)
     when pos % 10 = 7 then map('id', 'integer/string', 'value', 'string')
     when pos % 100 = 9 then map('value', 'number/string', 'id', 'integer/string', 'note', 'string')
     else map('id', 'integer/string', 'value', 'number/string') end
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing zone: files of five naming styles, with size, time, schema and rows."""
    return (
        load(spark, sf_dir, "events")
        .withColumn("path", F.expr(_FILE_NAME))
        .groupBy("path")
        .agg(
            F.min("event_id").alias("pos"),
            F.sum(F.length("props")).alias("size"),
            F.max("ts").alias("mtime"),
            F.count("*").alias("num_rows"),
        )
        .withColumn("columns", F.expr(_FILE_COLUMNS))
        .withColumn("source", F.lit(SOURCE))
        .withColumn("num_rows", F.when(F.col("pos") % 4 > 0, F.col("num_rows")))
        .select("source", "path", "pos", "size", "mtime", "columns", "num_rows")
    )


FILESETS = [
    Fileset("clicks", pattern="click_{date}.csv"),
    Fileset("views", pattern="view_*.jsonl.gz"),
    Fileset("anything_with_v", pattern="v*"),
    Fileset("errors", regex=r"error-\d{8}\.JSON"),
]


def old_new_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of customers as objects: the priorities they used are the columns."""
    cells = (
        load(spark, sf_dir, "orders")
        .withColumn("side", F.when(F.col("o_orderdate") < "1998-01-01", "old").otherwise("new"))
        .groupBy("side", "o_custkey", "o_orderpriority")
        .agg(F.max("o_orderstatus").alias("type"))
    )
    kinds = F.expr("element_at(array('table','file','fileset','endpoint','probe'), cast(o_custkey % 5 as int) + 1)")
    objects = (
        cells.groupBy("side", "o_custkey")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "type")))).alias("columns"))
        .select("side", F.concat(F.lit("obj://"), "o_custkey").alias("object_uri"), kinds.alias("kind"), "columns",
                (F.col("o_custkey") % 7).cast("string").alias("source_uri"))
    )
    return objects.where("side = 'old'").drop("side"), objects.where("side = 'new'").drop("side")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly scans: priority is the source, customer the object, statuses the columns."""
    return (
        load(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").cast("bigint").alias("scan_id"), F.col("o_orderpriority").alias("source_uri"),
                 "o_custkey", "o_orderstatus")
        .agg(F.when(F.max("o_totalprice") > 250000, "number").otherwise("integer").alias("type"))
        .groupBy("scan_id", "source_uri", "o_custkey")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "type")))).alias("columns"))
        .select("scan_id", "source_uri", F.concat(F.lit("obj://"), "o_custkey").alias("object_uri"),
                F.lit("table").alias("kind"), "columns")
    )


def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of the yearly scans; even customers removed a column, odd ones added one."""
    return load(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("scan_id"),
        F.col("o_orderpriority").alias("source_uri"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("obj://"), "o_custkey").alias("object_uri"),
        F.when(F.col("o_custkey") % 2 == 0, "column_removed").otherwise("column_added").alias("change_type"),
        F.when(F.col("o_custkey") % 2 == 0, "breaking").otherwise("info").alias("severity"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("column"), F.lit("text").alias("type"))).alias("detail"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by user (from events) and by supplier (from shipments)."""
    by_user = load(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), "user_id").alias("fileset"),
        F.concat(F.lit("f"), "event_id").alias("file_name"), F.col("ts").alias("mtime"))
    by_supplier = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier"), "l_suppkey").alias("fileset"),
        F.concat_ws("-", F.lit("s"), "l_orderkey", "l_linenumber").alias("file_name"), F.col("l_shipdate").alias("mtime"))
    return by_user.unionByName(by_supplier).withColumn("source", F.lit(SOURCE))


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant metric points: event type is the tenant, a day is a batch."""
    return load(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("org_id"), F.date_trunc("day", "ts").alias("ts"),
        (F.col("user_id") % 20).alias("slot"),
    ).agg(F.max("value").alias("metric_value"), F.min("event_id").alias("anomaly_id")).select(
        "org_id", F.concat(F.lit("db://x/"), "slot", F.lit("/value__max")).alias("uri"),
        F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), "ts", "metric_value", "anomaly_id")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored anomalies: the events."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("anomaly_id"), F.col("event_type").alias("org_id"),
        F.concat(F.lit("db://x/"), "user_id").alias("metric_uri"), F.col("value").alias("observed_value"),
        (F.col("event_id") % 3 == 0).alias("is_acknowledged"), F.col("ts").alias("created_at"))


def rows_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, num_rows`` of the given tables' files."""
    parts = [load(spark, sf_dir, t).agg(F.count("*").alias("num_rows")).select(F.lit(f"{t}.parquet").alias("name"), "num_rows") for t in TABLES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


FILES_SQL = " UNION ALL ".join(
    f"SELECT '{SOURCE}' AS source, '{t}.parquet' AS name, count(*) AS num_rows{{rest}} FROM {t}" for t in TABLES)

CTES = {
    "event_points": """
  event_daily AS (SELECT event_type, date_trunc('day', ts) ts, count(*)::DOUBLE c, avg(value) a FROM events GROUP BY 1, 2),
  event_points AS (
    SELECT 'db://lake/main/events/' || event_type || '/row_count' uri, ts, 'row_count' metric_name, c metric_value FROM event_daily
    UNION ALL SELECT 'db://lake/main/events/' || event_type || '/value__avg', ts, 'value__avg', a FROM event_daily)""",
    "metrics": """
  order_monthly AS (SELECT o_orderstatus || '-' || o_orderpriority k, date_trunc('month', o_orderdate) ts,
    count(*)::DOUBLE c, max(o_totalprice) m FROM orders GROUP BY 1, 2),
  metrics AS (
    SELECT * FROM event_points
    UNION ALL SELECT 'db://lake/main/orders/' || k || '/row_count', ts, 'row_count', c FROM order_monthly
    UNION ALL SELECT 'db://lake/main/orders/' || k || '/o_totalprice__max', ts, 'o_totalprice__max', m FROM order_monthly
    UNION ALL SELECT 'db://lake/main/shipping/' || l_suppkey || '/l_quantity__sum', date_trunc('day', l_shipdate),
      'l_quantity__sum', sum(l_quantity) FROM lineitem GROUP BY l_suppkey, date_trunc('day', l_shipdate))""",
    "files": """
  file_rows AS (SELECT *, md5(event_id::VARCHAR) h FROM events),
  named AS (SELECT user_id || '/' || CASE event_type
      WHEN 'click' THEN 'click_' || strftime(ts, '%Y-%m-%d') || '.csv'
      WHEN 'view' THEN 'view_' || strftime(ts, '%Y%m%dT%H%M%S') || '.jsonl.gz'
      WHEN 'error' THEN 'error-' || lpad(event_id::VARCHAR, 8, '0') || '.JSON'
      WHEN 'purchase' THEN 'export_' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '.parquet'
      ELSE 'signup ' || strftime(ts, '%H:%M:%S') || '.v' || event_id % 3 END AS path, event_id, ts, props FROM file_rows),
  file_groups AS (SELECT path, min(event_id) pos, sum(length(props))::BIGINT size, max(ts) mtime, count(*) n FROM named GROUP BY path),
  files AS (SELECT path, regexp_extract(path, '[^/]*$') base, pos, size, mtime,
      CASE WHEN pos % 4 > 0 THEN n END num_rows,
      CASE WHEN pos % 10 = 3 THEN '' WHEN pos % 10 = 7 THEN '"id":"integer/string","value":"string"'
           WHEN pos % 100 = 9 THEN '"id":"integer/string","note":"string","value":"number/string"'
           ELSE '"id":"integer/string","value":"number/string"' END cols,
      CASE WHEN pos % 10 = 3 THEN 0 WHEN pos % 10 = 7 THEN 2 WHEN pos % 100 = 9 THEN 3 ELSE 2 END n_cols
    FROM file_groups)""",
    "matched": """
  matched AS (SELECT *, CASE
      WHEN regexp_full_match(base, 'click_\\d{4}[-_.]?\\d{2}[-_.]?\\d{2}\\.csv') THEN 'clicks'
      WHEN base LIKE 'view\\_%.jsonl.gz' ESCAPE '\\' THEN 'views'
      WHEN base LIKE 'v%' THEN 'anything_with_v'
      WHEN regexp_full_match(base, 'error-\\d{8}\\.JSON') THEN 'errors' END fileset FROM files)""",
    "snapshots": """
  cells AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'old' ELSE 'new' END side, o_custkey,
      o_orderpriority col, max(o_orderstatus) typ FROM orders GROUP BY 1, 2, 3),
  objects AS (SELECT side, o_custkey, 'obj://' || o_custkey object_uri,
      ['table','file','fileset','endpoint','probe'][o_custkey % 5 + 1] kind, (o_custkey % 7)::VARCHAR source_uri,
      string_agg('"' || col || '":"' || typ || '"', ',' ORDER BY col) cols
    FROM cells GROUP BY side, o_custkey),
  old_o AS (SELECT * FROM objects WHERE side = 'old'), new_o AS (SELECT * FROM objects WHERE side = 'new'),
  old_c AS (SELECT * FROM cells WHERE side = 'old'), new_c AS (SELECT * FROM cells WHERE side = 'new')""",
    "diff": """
  pairs AS (SELECT coalesce(n.o_custkey, o.o_custkey) k, coalesce(n.object_uri, o.object_uri) object_uri,
      coalesce(n.kind, o.kind) kind, coalesce(n.source_uri, o.source_uri) source_uri, o.cols oc, n.cols nc
    FROM old_o o FULL JOIN new_o n ON o.o_custkey = n.o_custkey),
  col_pairs AS (SELECT coalesce(n.o_custkey, o.o_custkey) k, coalesce(n.col, o.col) col, o.typ ot, n.typ nt
    FROM old_c o FULL JOIN new_c n ON o.o_custkey = n.o_custkey AND o.col = n.col),
  diff AS (
    SELECT source_uri, object_uri, kind, kind || '_added' change_type, '{"columns":{' || nc || '}}' detail FROM pairs WHERE oc IS NULL
    UNION ALL SELECT source_uri, object_uri, kind, kind || '_removed', '{"columns":{' || oc || '}}' FROM pairs WHERE nc IS NULL AND kind <> 'file'
    UNION ALL SELECT source_uri, object_uri, kind, kind || '_schema_changed', '{"new_columns":{' || nc || '},"old_columns":{' || oc || '}}'
      FROM pairs WHERE oc IS NOT NULL AND nc IS NOT NULL AND kind IN ('file', 'fileset') AND oc <> nc
    UNION ALL SELECT source_uri, object_uri, kind,
      CASE WHEN ot IS NULL THEN 'column_added' WHEN nt IS NULL THEN 'column_removed' ELSE 'column_type_changed' END,
      CASE WHEN ot IS NULL THEN '{"column":"' || col || '","type":"' || nt || '"}'
           WHEN nt IS NULL THEN '{"column":"' || col || '","type":"' || ot || '"}'
           ELSE '{"column":"' || col || '","new_type":"' || nt || '","old_type":"' || ot || '"}' END
      FROM col_pairs JOIN pairs USING (k) WHERE oc IS NOT NULL AND nc IS NOT NULL AND kind NOT IN ('file', 'fileset')
        AND ot IS DISTINCT FROM nt)""",
    "history": """
  hist AS (SELECT year(o_orderdate) scan_id, o_orderpriority source_uri, 'obj://' || o_custkey object_uri, o_orderstatus col,
      CASE WHEN max(o_totalprice) > 250000 THEN 'number' ELSE 'integer' END typ FROM orders GROUP BY 1, 2, 3, 4),
  hist_o AS (SELECT scan_id, source_uri, object_uri, string_agg('"' || col || '":"' || typ || '"', ',' ORDER BY col) cols
    FROM hist GROUP BY 1, 2, 3)""",
    "changes": """
  changes AS (SELECT year(o_orderdate) scan_id, o_orderpriority source_uri, o_orderdate ts, 'obj://' || o_custkey object_uri,
      CASE WHEN o_custkey % 2 = 0 THEN 'column_removed' ELSE 'column_added' END change_type,
      CASE WHEN o_custkey % 2 = 0 THEN 'breaking' ELSE 'info' END severity,
      '{"column":"' || o_orderstatus || '","type":"text"}' detail FROM orders)""",
    "arrivals": """
  arrivals AS (SELECT 'user' || user_id fileset, 'f' || event_id file_name, ts mtime FROM events
    UNION ALL SELECT 'supplier' || l_suppkey, 's-' || l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem)""",
    "gaps": """
  times AS (SELECT DISTINCT fileset, epoch_us(mtime) us FROM arrivals),
  gaps AS (SELECT fileset, us, us - lag(us) OVER (PARTITION BY fileset ORDER BY us) gap FROM times)""",
    "pushes": """
  pushes AS (SELECT event_type org_id, 'db://x/' || user_id % 20 || '/value__max' uri, strftime(date_trunc('day', ts), '%Y-%m-%d') batch_id,
      date_trunc('day', ts) ts, max(value) metric_value, min(event_id) anomaly_id
    FROM events GROUP BY event_type, user_id % 20, date_trunc('day', ts))""",
    "anomalies": """
  anomalies AS (SELECT event_id anomaly_id, event_type org_id, 'db://x/' || user_id metric_uri, value observed_value,
      event_id % 3 = 0 is_acknowledged, ts created_at FROM events)""",
}
_NEEDS = {"metrics": ["event_points"], "matched": ["files"], "diff": ["snapshots"], "gaps": ["arrivals"]}


def with_ctes(names: str, select: str) -> str:
    """A SQL text that defines the named inputs, and what they need, before ``select``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",".join(CTES[n] for n in order) + "\n" + select

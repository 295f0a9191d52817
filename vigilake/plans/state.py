"""State tables of the scans: append-only parquet logs, one folder per source and scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake import schemas
from vigilake.operators.scale import first_per_key

_LAYOUTS = {
    "scans": schemas.SCANS,
    "snapshots": schemas.SNAPSHOTS,
    "changes": schemas.CHANGES,
    "metrics": schemas.METRICS,
    "arrivals": schemas.ARRIVALS,
    "tables": schemas.TABLES,
    "files": schemas.FILES,
    "fields": schemas.FIELDS,
}


class State:
    """Named logs under one folder.

    A scan writes each of its logs to its own folder and marks every row with a run of
    its own; the row it finally adds to ``scans`` names that run. Rows of any other run,
    left by a scan that failed, are never read, whoever takes the same number later.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._runs: dict[tuple[str, int], str] = {}

    def start(self, source: str) -> int:
        """Number of a new scan of ``source``."""
        scan_id = self.next_scan_id()
        self._runs[source, scan_id] = uuid.uuid4().hex
        return scan_id

    def append(self, name: str, rows: DataFrame, source: str, scan_id: int) -> None:
        layout = T.StructType.fromDDL(_LAYOUTS[name])
        columns = [c for c in layout.fieldNames() if c != "scan_id"]
        run = self._runs.setdefault((source, scan_id), uuid.uuid4().hex)
        rows.select(*[F.col(c).cast(layout[c].dataType).alias(c) for c in columns], F.lit(run).alias("run")).write.mode("overwrite").parquet(
            f"{self.root}/{name}/source={source}/scan_id={scan_id}")

    def read(self, name: str, running: tuple[str, int] | None = None) -> DataFrame:
        """All rows of a log of registered scans, with ``source`` and ``scan_id``.

        ``running`` (source, number) adds the rows of a scan that is not registered yet.
        """
        layout = T.StructType.fromDDL(_LAYOUTS[name])
        whole = T.StructType([f for f in layout if f.name != "scan_id"])
        for field in ("run", "source"):
            whole = whole.add(field, T.StringType())
        whole = whole.add("scan_id", T.LongType())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], whole).drop("run")
        rows = self.spark.read.schema(whole).parquet(f"{self.root}/{name}")
        if name == "scans":
            return rows.drop("run")
        return rows.join(self._valid(running), ["source", "scan_id", "run"], "left_semi").drop("run")

    def _valid(self, running: tuple[str, int] | None) -> DataFrame:
        keys = T.StructType.fromDDL("source string, scan_id bigint, run string")
        more = [] if running is None else [(*running, self._runs[running])]
        valid = self.spark.createDataFrame(more, keys)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/scans")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return valid
        return valid.unionByName(self.spark.read.schema(keys).parquet(f"{self.root}/scans"))

    def last_scan(self, source: str):
        """Row ``scan_id, last_modified`` (as text) of a source's newest registered scan, or None."""
        scans = self.read("scans").where(F.col("source") == source)
        text = F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_modified")
        return scans.orderBy(F.desc("scan_id")).select("scan_id", text).first()

    def next_scan_id(self) -> int:
        newest = self.read("scans").agg(F.max("scan_id")).first()[0]
        return (newest or 0) + 1

    def snapshot(self, source: str, scan_id: int, running: bool = False) -> DataFrame:
        return self.read("snapshots", (source, scan_id) if running else None).where((F.col("source") == source) & (F.col("scan_id") == scan_id)).select(
            "source_uri", "object_uri", "kind", "columns")

    def current(self, name: str) -> DataFrame:
        """Newest row per uri of a catalog log; a file's fields keep their first type."""
        rows = self.read(name)
        if name == "fields":
            is_table = F.col("owner_uri").startswith("db://")
            order = F.when(is_table, -F.col("scan_id")).otherwise(F.col("scan_id"))
        else:
            order = F.col("scan_id") if name == "files" else -F.col("scan_id")
        return first_per_key(rows, ["uri"], [order])

"""Incremental listing as a stream: the checkpoint takes the place of the highwater mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.filesets import Fileset, match_filesets
from vigilake.sources.files import LISTING_SCHEMA


def stream_listing(spark: SparkSession, root: str, source: str, glob: str | None = None) -> DataFrame:
    """Files not seen by earlier runs of the same checkpoint; contents are not kept."""
    reader = spark.readStream.format("binaryFile").schema(LISTING_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        F.lit(source).alias("source"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def append_new(stream: DataFrame, table: str, checkpoint: str, name: str | None = None):
    """Run a stream over everything new and append it to a parquet table, once each.

    A batch replaces its own partition, so a batch repeated after a failure leaves no
    duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_arrivals(listing: DataFrame, filesets: list[Fileset]) -> DataFrame:
    """Arrivals of declared feeds, as an append-only log for ``freshness.latest_arrivals``."""
    return match_filesets(listing, filesets).where("fileset is not null").select(
        "source", "fileset", F.col("path").alias("file_name"), "mtime")

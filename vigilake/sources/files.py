"""Files as sources: listing, highwater mark, encodings, exact row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.names import base_name, file_type, reader_for

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def list_files(spark: SparkSession, root: str, source: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``source, path, size, mtime`` of the files under ``root``; contents are not read.

    With ``recursive=False`` it lists one level and drops empty files, as object
    stores are listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select(
        F.lit(source).alias("source"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return files if recursive else files.where("size > 0")


def source_path() -> Column:
    """Path of the file a row came from, as a listing has it (the metadata column is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def label_files(files: DataFrame) -> DataFrame:
    """Adds ``filetype`` and ``reader`` (null when no reader handles the extension)."""
    return files.withColumn("filetype", file_type(F.col("path"))).withColumn("reader", reader_for(F.col("path")))


def newer_than_highwater(listing: DataFrame, scans: DataFrame) -> DataFrame:
    """Files changed after their source's last scan; all files of a source never scanned."""
    last = scans.groupBy(F.col("server").alias("source")).agg(
        F.max_by("last_modified", F.struct("scan_time", "scan_id")).alias("_highwater"))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return (
        listing.join(last, ["source"], "left")
        .where(F.col("mtime") > F.coalesce("_highwater", start))
        .drop("_highwater")
    )


def highwater(listing: DataFrame) -> DataFrame:
    """Newest modification per source, to be stored with the scan."""
    return listing.groupBy("source").agg(F.max("mtime").alias("last_modified"))


def detect_encoding(content: Column) -> Column:
    """Encoding of a file's bytes: byte order mark, strict UTF-8, cp1252, else latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .when(~F.decode(content, "ISO-8859-1").rlike(r"[\x81\x8d\x8f\x90\x9d]"), "cp1252")
        .otherwise("latin-1")
    )


def encoding_census(files: DataFrame, sample_bytes: int | None = None) -> DataFrame:
    """Adds ``encoding`` to rows with ``content``; on all bytes unless a sample size is given."""
    content = F.col("content") if sample_bytes is None else F.substring("content", 1, sample_bytes)
    return files.withColumn("encoding", detect_encoding(content)).drop("content")


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Exact rows per parquet file, from the footers: no column is read."""
    return (
        spark.read.parquet(path)
        .groupBy(source_path().alias("path"))
        .agg(F.count("*").alias("num_rows"))
    )


def file_names(files: DataFrame) -> DataFrame:
    return files.withColumn("name", base_name(F.col("path")))

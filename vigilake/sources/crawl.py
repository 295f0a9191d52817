"""Crawl of a file source: encoding, schema and row count of every new file.

Text files are read as lines with their path, so a large file is split over tasks
like any other input, and all files of one format share one job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.names import reader_for
from vigilake.session import cut_lineage
from vigilake.sources.csv_files import DELIMITERS, csv_cells, csv_columns, csv_records, find_delimiters
from vigilake.sources.files import detect_encoding, label_files, source_path
from vigilake.sources.json_arrays import array_elements, array_records, comma_pieces
from vigilake.sources.text import document_rows, infer_json_columns, parsed_json, payload_columns, record_columns

# The characters cp1252 has at bytes where latin-1 has control codes.
CP1252_BYTES = "".join(map(chr, (
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95,
    0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)))
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

#: Bytes from which a JSON array is read by element.
SPLIT_ABOVE = 64 << 20
_GLOBS = {kind: "*.{%s,%s.gz}" % (2 * ("".join(f"[{c}{c.upper()}]" for c in kind),)) for kind in ("csv", "jsonl", "json")}


def _reader(spark: SparkSession, kind: str, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOBS[kind])
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def raw_lines(spark: SparkSession, root: str, kind: str, modified_after: str | None = None) -> DataFrame:
    """``path, line_id, raw``: the lines of all files of one kind; ids grow within a file."""
    return _reader(spark, kind, modified_after).text(root).select(
        source_path().alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line_id"),
        F.col("value").cast("binary").alias("raw"),
    )


def _open(path: str):
    """pyarrow filesystem and path of a listed file."""
    from urllib.parse import quote

    import pyarrow.fs as pafs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}")


def file_heads(listing: DataFrame) -> DataFrame:
    """``path, head``: the first three bytes of each file (unpacked) as hex, read inside the tasks.

    The line reader drops a UTF-8 byte order mark, so it is looked up in the file itself.
    """

    def heads(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                filesystem, inner = _open(path)
                with filesystem.open_input_stream(inner, compression="detect") as stream:
                    rows.append((path, stream.read(3).hex().upper()))
            yield pd.DataFrame(rows, columns=["path", "head"])

    return listing.select("path").repartition("path").mapInPandas(heads, "path string, head string")


def line_census(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``path, encoding`` from the head of each file and all bytes of its lines."""
    undefined = F.decode("raw", "ISO-8859-1").rlike(r"[\x81\x8d\x8f\x90\x9d]")
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("_utf8"), F.bool_or(undefined).alias("_undefined"))
    return heads.join(facts, "path", "left").select("path", (
        F.when(F.col("head") == "EFBBBF", "utf-8-sig")
        .when(F.col("head").startswith("FFFE"), "utf-16")
        .when(F.col("head").startswith("FEFF"), "utf-16-be")
        .when(F.coalesce("_utf8", F.lit(True)), "utf-8")
        .when(~F.col("_undefined"), "cp1252")
        .otherwise("latin-1")).alias("encoding"))


def decoded_lines(
    spark: SparkSession, root: str, kind: str, census: DataFrame, modified_after: str | None = None
) -> DataFrame:
    """``path, encoding, line_id, line`` with each file in its own encoding (``census``).

    UTF-16 files cannot be cut at newline bytes; they are decoded whole.
    """
    lines = raw_lines(spark, root, kind, modified_after)
    mine = census.where(reader_for(F.col("path")) == kind)
    # One small row per file, as the reader's own list has it: lines need not move.
    narrow = lines.join(F.broadcast(mine.where("encoding not like 'utf-16%'")), ["path"]).select(
        "path", "encoding", "line_id", decoded(F.col("raw"), F.col("encoding")).alias("line"))
    # Only the paths come to the driver, where a reader's file list lives anyway.
    paths = [r.path for r in mine.where("encoding like 'utf-16%'").select("path").toLocalIterator()]
    if not paths:
        return narrow
    content = spark.read.format("binaryFile").load(_escaped(paths))
    wide = content.select("path", "content").join(F.broadcast(mine), ["path"]).select(
        "path", "encoding", F.posexplode(F.split(decoded(F.col("content"), F.col("encoding")), "\r?\n")).alias("n", "line"))
    at = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("n").cast("bigint").alias("n"))
    return narrow.unionByName(wide.select("path", "encoding", at.alias("line_id"), "line"))


def decoded(raw: Column, encoding: Column) -> Column:
    """Bytes as text, without a byte order mark."""
    latin = F.decode(raw, "ISO-8859-1")
    return (
        F.when(encoding == "cp1252", F.translate(latin, CP1252_BYTES, CP1252_CHARS))
        .when(encoding == "latin-1", latin)
        .when(encoding.startswith("utf-16"), F.decode(raw, "UTF-16"))
        .otherwise(F.regexp_replace(raw.cast("string"), "^\ufeff", ""))
    )


def _escaped(paths: Sequence[str]) -> list[str]:
    """Paths that a reader takes as they are, not as patterns."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]


def json_documents(
    spark: SparkSession, root: str, modified_after: str | None = None, most_bytes: int | None = None, besides: Sequence[str] = (),
) -> DataFrame:
    """``path, encoding, doc``: one row per file, of at most ``most_bytes``, and of the files ``besides`` whatever their size."""
    small = _reader(spark, "json", modified_after).text(root, wholetext=True)
    if most_bytes is not None:
        small = small.where(F.col("_metadata.file_size") <= most_bytes)
    whole = small.select(source_path().alias("path"), F.col("value").cast("binary").alias("raw"))
    if besides:
        whole = whole.unionByName(spark.read.text(_escaped(besides), wholetext=True).select(source_path().alias("path"), F.col("value").cast("binary").alias("raw")))
    return whole.withColumn("encoding", detect_encoding(F.col("raw"))).select(
        "path", "encoding", decoded(F.col("raw"), F.col("encoding")).alias("doc"))


def csv_schemas(lines: DataFrame, delimiter: str | None = ",", header: bool | None = True) -> DataFrame:
    """``path, name, type`` of CSV files; ``None`` finds each file's own delimiter, or whether its first record is a header."""
    known = DELIMITERS if delimiter is None else (delimiter,)
    records = csv_records(lines, find_delimiters(lines) if delimiter is None else delimiter, known)
    return csv_columns(records, header, known)[0]


def large_documents(spark: SparkSession, listing: DataFrame, split_above: int) -> tuple[DataFrame | None, list[str]]:
    """Elements ``path, encoding, element, text`` of the large JSON files that begin an array, and the paths of the other large ones.

    The paths of large files come to the driver, where a reader's file list lives anyway.
    """
    large = listing.where((F.col("reader") == "json") & (F.col("size") > split_above)).select("path")
    paths = [r.path for r in large.toLocalIterator()]
    if not paths:
        return None, []
    pieces = comma_pieces(spark, _escaped(paths))
    census = line_census(pieces.select("path", F.encode("piece", "ISO-8859-1").alias("raw")), file_heads(large))
    begins = pieces.groupBy("path").agg(F.min_by(F.substring(F.regexp_replace("piece", r"^(?:\xef\xbb\xbf)?[ \t\r\n]+", ""), 1, 4), F.struct("block", "n")).alias("_begin"))
    told = cut_lineage(census.join(begins, "path", "left").withColumn(
        "_array", F.coalesce(F.col("_begin").rlike(r"^(?:\xef\xbb\xbf)?\["), F.lit(False)) & ~F.col("encoding").startswith("utf-16")))
    others = [r.path for r in told.where("not _array").select("path").toLocalIterator()]
    arrays = [p for p in paths if p not in set(others)]
    if not arrays:
        return None, others
    elements = array_elements(comma_pieces(spark, _escaped(arrays))).join(told.select("path", "encoding"), "path")
    return elements.select("path", "encoding", "element", decoded(F.encode("text", "ISO-8859-1"), F.col("encoding")).alias("text")), others


def parquet_footers(listing: DataFrame) -> DataFrame:
    """``path, columns, num_rows`` of parquet files, read from the footers inside the tasks.

    A file that is no parquet file has no row.
    """

    def footers(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        def type_text(kind) -> str:
            try:
                return from_arrow_type(kind).simpleString()
            except Exception:  # noqa: BLE001  a type that Spark lacks keeps the file's own name for it
                return str(kind)

        for batch in batches:
            rows = []
            for path in batch["path"]:
                filesystem, inner = _open(path)
                with filesystem.open_input_file(inner) as handle:
                    try:
                        file = pq.ParquetFile(handle)
                    except pa.ArrowInvalid:
                        continue
                    # Of columns with one name the last stands for it.
                    columns = {f.name: type_text(f.type) for f in file.schema_arrow}
                    rows.append((path, list(columns.items()), file.metadata.num_rows))
            yield pd.DataFrame(rows, columns=["path", "entries", "num_rows"])

    spread = listing.select("path").repartition("path")
    read = spread.mapInPandas(footers, "path string, entries array<struct<name:string,type:string>>, num_rows bigint")
    return read.select("path", F.map_from_entries("entries").alias("columns"), "num_rows")


def crawl_files(
    spark: SparkSession, root: str, listing: DataFrame, modified_after: str | None = None,
    get_schemas: bool = True, delimiter: str | None = ",", encoding: str | None = None, header: bool | None = True,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """The listed files with ``encoding, columns, num_rows`` added.

    ``modified_after`` keeps older files from being read at all. A known ``encoding`` of
    all text files saves the pass over their bytes that finds it. ``delimiter=None`` and ``header=None`` find the CSV files'
    delimiters and headers from all of their lines. JSON arrays of more than ``split_above`` bytes are read by element, so
    they may be of any size; other JSON documents are one value. A file that cannot
    be parsed or has no reader has an empty schema. Rows are known for parquet and
    JSON documents only.
    """
    labelled = label_files(listing)
    kinds = ("csv", "jsonl")
    text_files = labelled.where(F.col("reader").isin(*kinds))
    if encoding:
        census = text_files.select("path", F.lit(encoding).alias("encoding"))
    else:
        all_lines = reduce(DataFrame.unionByName, [raw_lines(spark, root, k, modified_after) for k in kinds])
        # One small row per file that every branch below needs: kept once, in the shared folder.
        census = cut_lineage(line_census(all_lines, file_heads(text_files)))
    elements, others = large_documents(spark, labelled, split_above) if get_schemas else (None, [])
    documents = json_documents(spark, root, modified_after, split_above if get_schemas else None, others)
    encodings = census.unionByName(documents.select("path", "encoding"))
    if elements is not None:
        encodings = encodings.unionByName(elements.select("path", "encoding").distinct())
    result = labelled.join(encodings, "path", "left")
    empty = F.expr("cast(map() as map<string,string>)")
    if not get_schemas:
        return result.withColumn("columns", empty).withColumn("num_rows", F.lit(None).cast("bigint"))
    lines = {k: decoded_lines(spark, root, k, census, modified_after) for k in kinds}
    fields = (
        csv_schemas(lines["csv"], delimiter, header)
        .unionByName(infer_json_columns(lines["jsonl"], "line", ["path"]))
        .unionByName(payload_columns(documents, "doc", ["path"]))
    )
    rows = document_rows(documents, "doc").where("num_rows is not null").select("path", F.col("num_rows").alias("_doc_rows"))
    if elements is not None:
        records, counts = array_records(elements, parsed_json)
        fields = fields.unionByName(record_columns(records, ["path"]))
        rows = rows.unionByName(counts.select("path", F.col("num_rows").alias("_doc_rows")))
    schemas = fields.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "type")))).alias("columns"),
        F.lit(None).cast("bigint").alias("num_rows"))
    parquet = parquet_footers(labelled.where("reader = 'parquet'"))
    known = schemas.unionByName(parquet)
    return (
        result.join(known, "path", "left").join(rows, "path", "left")
        .withColumn("columns", F.coalesce("columns", empty))
        .withColumn("num_rows", F.coalesce("num_rows", "_doc_rows"))
        .drop("_doc_rows")
    )


__all__ = [
    "crawl_files", "csv_cells", "csv_schemas", "decoded", "decoded_lines", "file_heads", "json_documents", "large_documents", "line_census", "parquet_footers", "raw_lines",
]

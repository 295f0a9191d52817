"""Schemas of text data: CSV columns, JSON lines, JSON documents, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.fixed import SAMPLE_RATE
from vigilake.functions.text_types import infer_text_type, json_value_type, pick_type, render_type
from vigilake.operators.scale import places


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV with a header line, every value as text; ``.gz`` is unpacked by the reader."""
    return spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, inferSchema=False, quote='"', escape='"')


def parsed_json(text: str) -> Column:
    """Text as a variant, null if it is no JSON; of repeated keys in an object the last counts."""
    SparkSession.getActiveSession().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


def _typed(integers: Column, numbers: Column, strings: Column) -> Column:
    return render_type(pick_type(integers, numbers, strings))


def infer_columns(rows: DataFrame) -> DataFrame:
    """``name, type`` of every text column, from all rows in one aggregate pass."""
    # The widest class wins, so one number per column is enough: its rank.
    rank = lambda kind: F.when(kind == "string", 3).when(kind == "number", 2).when(kind == "integer", 1)
    kinds = rows.select(*[infer_text_type(F.col(f"`{name}`")).alias(name) for name in rows.columns])
    widest = kinds.agg(*[F.max(rank(F.col(f"`{name}`"))).alias(name) for name in rows.columns])
    stacked = widest.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("rank")) for n in rows.columns])).alias("c"))
    named = F.when(F.col("c.rank") == 1, "integer").when(F.col("c.rank") == 2, "number").otherwise("string")
    return stacked.select("c.name", render_type(named).alias("type"))


def _columns_from_votes(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, name, vote`` rows to ``keys, name, type``; null votes keep the column as text.

    Booleans are a type of their own only if the column holds nothing else.
    """
    count = {t: F.count_if(F.col("vote") == t) for t in ("integer", "number", "string", "boolean")}
    tallied = votes.groupBy(*keys, "name").agg(*[c.alias(f"_{t}") for t, c in count.items()])
    plain = _typed(F.col("_integer"), F.col("_number"), F.col("_string") + F.col("_boolean"))
    only_boolean = (F.col("_boolean") > 0) & (F.col("_integer") + F.col("_number") + F.col("_string") == 0)
    return tallied.select(
        *keys, "name", F.when(only_boolean, render_type(F.lit("boolean"))).otherwise(plain).alias("type"))


def _object_votes(objects: DataFrame, keys: Sequence[str], lenient: bool) -> DataFrame:
    """One vote per top-level member of the variant objects in column ``v``."""
    spark = objects.sparkSession
    members = objects.where(F.schema_of_variant("v").startswith("OBJECT")).lateralJoin(
        spark.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    text = F.when(kind.isin("STRING", "DOUBLE", "FLOAT"), F.try_variant_get("value", "$", "string"))
    return members.select(*keys, F.col("key").alias("name"), json_value_type(kind, text, lenient).alias("vote"))


def infer_json_columns(
    docs: DataFrame, column: str, keys: Sequence[str] = (), lenient_numbers: bool = False
) -> DataFrame:
    """``keys, name, type`` of JSON lines: top-level members of the objects in ``column``."""
    objects = docs.select(*keys, parsed_json(column).alias("v")).where("v is not null")
    return _columns_from_votes(_object_votes(objects, keys, lenient_numbers), keys)


def records_of(payloads: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Records ``keys, v`` of JSON documents: the elements of an array, or the lone object."""
    parsed = payloads.select(*keys, parsed_json(column).alias("_doc")).where("_doc is not null")
    is_list = F.schema_of_variant("_doc").startswith("ARRAY")
    elements = parsed.where(is_list).select(*keys, F.explode(
        F.try_variant_get("_doc", "$", "array<variant>")).alias("v"))
    return elements.where("v is not null").unionByName(parsed.where(~is_list).select(*keys, F.col("_doc").alias("v")))


def payload_columns(
    payloads: DataFrame, column: str, keys: Sequence[str], lenient_numbers: bool = False
) -> DataFrame:
    """``keys, name, type`` of JSON payloads; scalars and unparseable text give no column."""
    return record_columns(records_of(payloads, column, keys), keys, lenient_numbers)


def record_columns(records: DataFrame, keys: Sequence[str], lenient_numbers: bool = False) -> DataFrame:
    """``keys, name, type`` of variant records ``keys, v``."""
    return _columns_from_votes(_object_votes(records, keys, lenient_numbers), keys)


def document_rows(docs: DataFrame, column: str) -> DataFrame:
    """Adds ``num_rows`` per JSON document: an array's length, 1 for an object, else null."""
    # The text classes below only pick a branch; the parser decides what is valid.
    parsed = parsed_json(column)
    shape = F.regexp_extract(F.schema_of_variant(parsed), "^[A-Z]+", 0)
    return docs.withColumn("num_rows", F.when(shape == "OBJECT", F.lit(1)).when(
        shape == "ARRAY", F.json_array_length(column)).cast("bigint"))


def systematic_sample(
    rows: DataFrame, order: str, every: int = SAMPLE_RATE, first: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows 0, ``every``, 2x``every``, ... of all rows, or of the first ``first``, per key or overall.

    A head is a top-k (cut in every map task), so only ``first`` rows are numbered.
    """
    if first is None:
        return places(rows, keys, [order]).where(F.col("_at") % every == 0).drop("_at")
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        head = rows.withColumn("_at", place).where(F.col("_at") <= first)
    else:
        head = rows.orderBy(order).limit(first).withColumn(
            "_at", F.row_number().over(Window.orderBy(order)))
    return head.where((F.col("_at") - 1) % every == 0).drop("_at")

"""JSON arrays of any size, cut into their elements without ever being one value.

A file is read in pieces between commas, by Spark's line reader and so in parallel. Whether a piece begins inside a string
is the parity of the quotes before it; with that its brackets count, and their sum before it is its depth. A comma at
depth one outside of strings ends an element. A first pass sums up each split for both cases, begun inside a string or not;
one small row per split then tells where every split begins, and a second pass cuts the elements where they stand. Only
elements over the border of a split move between tasks. Only an element has to fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.session import cut_lineage, stash
from vigilake.sources.files import source_path
from vigilake.sources.prefix import stretches

#: What a byte adds to the depth.
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_ESCAPED = re.compile(rb"\\[^,]")
_BEGIN = r"^(?:\xef\xbb\xbf)?[ \t\r\n]*\["
_SUMMARY = "path string, block long, head boolean, parity int, d0 long, d1 long, low0 long, low1 long, n0 long, n1 long"


def comma_pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, block, n, raw, piece``: what stands between the commas of the files, as bytes and one character per byte; ``n`` grows within a file."""
    raw = F.col("value").cast("binary")
    return spark.read.option("lineSep", ",").text(list(paths)).select(
        source_path().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), raw.alias("raw"), F.decode(raw, "ISO-8859-1").alias("piece"))


def _piece_ends(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """At each piece's end: parity of the quotes, and the depth if ``data`` begins outside, or inside, of a string."""
    plain = np.frombuffer(_ESCAPED.sub(b"__", data) if b"\\" in data else data, dtype=np.uint8)
    inside = np.cumsum(plain == ord('"')) & 1
    step = _STEP[plain]
    return inside[ends], [np.cumsum(np.where(inside == p, step, 0))[ends] for p in (0, 1)]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch, bytes, np.ndarray]]:
    """``(new, rows, data, ends)``: stretches of one split, their pieces with a comma behind each, and where these commas are."""
    for new, rows in stretches(batches, ("path", "block")):
        pieces = rows.column("raw").cast(pa.large_binary())
        offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        yield new, rows, pieces.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes(), offsets[1:] - offsets[0] - 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split, for both cases: depth behind it, least depth outside of strings and how often; the last piece does not count for these two."""
    row, last = None, None

    def fold(p: int, depths: np.ndarray) -> None:
        if len(depths):
            low = int(depths.min())
            if row[f"low{p}"] is None or low < row[f"low{p}"]:
                row[f"low{p}"], row[f"n{p}"] = low, 0
            if low == row[f"low{p}"]:
                row[f"n{p}"] += int((depths == low).sum())

    for new, rows, data, ends in _stretches(batches):
        if new:
            if row:
                yield pa.RecordBatch.from_pylist([row], schema=_summary_schema)
            row = {"path": rows.column("path")[0].as_py(), "block": rows.column("block")[0].as_py(), "head": rows.column("head")[0].as_py(),
                   "parity": 0, "d0": 0, "d1": 0, "low0": None, "low1": None, "n0": 0, "n1": 0}
        elif last:
            for p in (0, 1):
                fold(p, last[p])
        parity, depths = _piece_ends(data, ends)
        begun, last = row["parity"], []
        for p in (0, 1):
            depth = row[f"d{p}"] + depths[begun ^ p]
            outside = parity ^ begun ^ p == 0
            fold(p, depth[:-1][outside[:-1]])
            last.append(depth[-1:][outside[-1:]])
            row[f"d{p}"] = int(depth[-1])
        row["parity"] = int(begun ^ parity[-1])
    if row:
        yield pa.RecordBatch.from_pylist([row], schema=_summary_schema)


_summary_schema = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("head", pa.bool_()), ("parity", pa.int32()),
    *[(c, pa.int64()) for c in ("d0", "d1", "low0", "low1", "n0", "n1")]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the state before their split (``_open, _depth, _element``) to elements; ``whole`` if one surely lies in the split."""

    def out(texts: list[bytes], at: int) -> pa.RecordBatch:
        n = len(texts)
        whole = np.ones(n, dtype=bool)
        whole[:1] = whole[:1] & (at > first)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(np.arange(at, at + n)), pa.array(texts, pa.binary()), pa.array(whole)],
            names=["path", "block", "element", "text", "whole"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            left = out([b"".join(held)[:-1]], element)
            yield left.set_column(4, "whole", pa.array([False]))

    path, held = None, []
    for new, rows, data, ends in _stretches(batches):
        if new:
            yield from rest()
            path, block, inside, depth, first = (rows.column(c)[0].as_py() for c in ("path", "block", "_open", "_depth", "_element"))
            element, held = first, []
        parity, depths = _piece_ends(data, ends)
        borders = ends[(parity ^ inside == 0) & (depth + depths[inside] == 1)].tolist()
        if borders:
            begins = [0, *[b + 1 for b in borders]]
            texts = [data[a:b] for a, b in zip(begins, borders, strict=False)]
            texts[0] = b"".join([*held, texts[0]])
            yield out(texts, element)
            element, held, data = element + len(texts), [], data[begins[-1]:]
        if data:
            held.append(data)
        inside, depth = int(inside ^ parity[-1]), int(depth + depths[inside][-1])
    yield from rest()


def _split_states(pieces: DataFrame) -> DataFrame:
    """``path, block, _open, _depth, _element, _most, _proper``: what stands before each split, and whether its file is an array."""
    summed = pieces.select("path", "block", F.col("piece").rlike(_BEGIN).alias("head"), F.concat("raw", F.lit(b",")).alias("raw")).mapInArrow(_summed, _SUMMARY)
    order = Window.partitionBy("path").orderBy("block")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    case = lambda c: F.when(F.col("_open") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    states = summed.withColumn("_open", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    states = states.withColumn("_step", case("d")).withColumn("_depth", F.coalesce(F.sum("_step").over(before), F.lit(0)))
    low, after = F.col("_depth") + case("low"), F.col("_depth") + F.col("_step")
    closed, final = (F.col("_open") + F.col("parity")) % 2 == 0, F.lead("block").over(order).isNull()
    # In an array nothing but its last piece ends below depth one, so what ends an element stands at the least depth.
    ends = F.when(low == 1, case("n")).otherwise(0) + F.when(closed & (after == 1), 1).otherwise(0)
    early = F.coalesce(low <= 0, F.lit(False)) | (~final & closed & (after <= 0))
    begins = F.lag("block").over(order).isNotNull() | F.col("head")
    states = states.withColumns({"_ends": ends, "_right": ~early & begins & (~final | (closed & (after == 0)))})
    return states.select(
        "path", "block", "_open", "_depth", F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_element"),
        F.sum("_ends").over(every).alias("_most"), F.bool_and("_right").over(every).alias("_proper"))


def array_elements(pieces: DataFrame) -> DataFrame:
    """``path, element, text``: elements of the arrays in order, numbered from 0; a file that is no array has one, ``text`` null.

    ``pieces`` stand as the reader gives them: those of a split in one task, in order. ``text`` has one character per byte.
    An empty array has one element without text. Brackets that do not match, text
    behind the array and open strings make the whole file no array; whether elements are valid is the parser's business.
    """
    # One small row per split, as the reader's own list of splits has it.
    states = cut_lineage(_split_states(pieces))
    begun = pieces.select("path", "block", F.concat("raw", F.lit(b",")).alias("raw")).join(
        F.broadcast(states.where("_proper").select("path", "block", "_open", "_depth", "_element")), ["path", "block"])
    kept = stash(begun.mapInArrow(_cut, "path string, block long, element long, text binary, whole boolean"), "elements")
    inner = kept.where("whole").select("path", "element", F.decode("text", "ISO-8859-1").alias("text"))
    joined = kept.where("not whole").groupBy("path", "element").agg(F.array_sort(F.collect_list(F.struct("block", F.decode("text", "ISO-8859-1").alias("text")))).alias("_parts"))
    files = states.groupBy("path").agg(F.max("_most").alias("_most"), F.bool_and("_proper").alias("_proper"))
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), ",")
    text = F.when(F.col("element") == 0, F.regexp_replace(text, _BEGIN, "")).otherwise(text)
    text = F.when(F.col("element") == F.col("_most"), F.regexp_replace(text, r"\][ \t\r\n]*$", "")).otherwise(text)
    border = joined.join(files, "path").select("path", "element", text.alias("text"))
    others = files.where("not _proper").select("path", F.lit(0).cast("bigint").alias("element"), F.lit(None).cast("string").alias("text"))
    return inner.unionByName(border).unionByName(others)


def array_records(elements: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """``path, v`` of the objects and other values in proper arrays, and ``path, num_rows`` of these.

    ``parse`` makes a variant of a text, null where it is no JSON; one such element and its whole file has no records and no row count.
    """
    values = elements.select("path", (F.trim(F.translate("text", "\t\r\n", "   ")) == "").alias("_bare"), parse("text").alias("v"))
    facts = values.groupBy("path").agg(F.count("*").alias("_n"), F.count("v").alias("_parsed"), F.count_if("_bare").alias("_empty"))
    empty = (F.col("_n") == 1) & (F.col("_empty") == 1)
    # Kept once: one small row per file, for the counts and for the records.
    rows = cut_lineage(facts.where(empty | (F.col("_parsed") == F.col("_n"))).select("path", F.when(empty, F.lit(0)).otherwise(F.col("_n")).cast("bigint").alias("num_rows")))
    return values.where("v is not null").join(F.broadcast(rows), "path", "left_semi").select("path", "v"), rows

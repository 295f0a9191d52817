"""Declared filesets: files recognised as feeds and checked against a canonical schema."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.changes import columns_json, detail_json, severity, sorted_entries
from vigilake.functions.names import base_name, literal_ends, pattern_regex
from vigilake.functions.uris import file_uri, fileset_uri

# One CASE expression holds at most this many patterns; more are looked up by their plain ends, of at most so many characters.
_CASE_WIDTH, _KEY_CHARS = 200, 32


@dataclass(frozen=True)
class Fileset:
    """A named feed, given by a glob with tokens or by a regex."""

    name: str
    pattern: str | None = None
    regex: str | None = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("a fileset needs a name")
        if bool(self.pattern) == bool(self.regex):
            raise ValueError(f"fileset {self.name!r} needs either 'pattern' or 'regex'")
        if self.regex:
            try:
                re.compile(self.regex)
            except re.error as error:
                raise ValueError(f"fileset {self.name!r}: bad regex: {error}") from error

    @property
    def spec(self) -> str:
        return self.pattern or self.regex

    def matches(self, path: Column) -> Column:
        """Whole-string match; on the base name unless the spec has a ``/``."""
        target = path if "/" in self.spec else base_name(path)
        return target.rlike(self.anchored)

    @property
    def anchored(self) -> str:
        return "^(?:" + self.regex.replace("(?P<", "(?<") + r")\z" if self.regex else pattern_regex(self.pattern)


def parse_filesets(config: Iterable[dict] | None) -> list[Fileset]:
    """Filesets from a list of mappings; wrong, unnamed or repeated entries are refused."""
    filesets: list[Fileset] = []
    for entry in config or []:
        if not isinstance(entry, dict):
            raise ValueError(f"a fileset entry must be a mapping, got: {entry!r}")
        extra = sorted(set(entry) - {"name", "pattern", "regex"})
        if extra:
            raise ValueError(f"fileset {entry.get('name')!r} has unknown keys: {', '.join(extra)}")
        fileset = Fileset(entry.get("name"), entry.get("pattern"), entry.get("regex"))
        if any(f.name == fileset.name for f in filesets):
            raise ValueError(f"fileset name used twice: {fileset.name}")
        filesets.append(fileset)
    return filesets


def match_filesets(files: DataFrame, filesets: list[Fileset]) -> DataFrame:
    """Adds ``fileset``, the first declared one that matches ``path``, or null.

    Few patterns become literals of a CASE expression, many a table of their plain beginnings or ends, so a name meets
    only those that it can match: one pass, no join, no shuffle.
    """
    if len(filesets) > _CASE_WIDTH:
        return files.withColumn("fileset", _first_of_many(F.col("path"), filesets))
    chain = F
    for fileset in filesets:
        chain = chain.when(fileset.matches(F.col("path")), F.lit(fileset.name))
    return files.withColumn("fileset", F.lit(None).cast("string") if chain is F else chain)


def _first_of_many(path: Column, filesets: list[Fileset]) -> Column:
    """The first matching fileset's name, by look-ups of the name's own beginnings and ends in a constant hash table.

    A pattern stands under its longer plain end (``_KEY_CHARS`` at most); one without any is met by every name.
    """
    size = 1 << (2 * len(filesets)).bit_length()
    slots: list[list[dict]] = [[] for _ in range(size)]
    looks = set()
    for pos, fileset in enumerate(filesets):
        prefix, suffix = ("", "") if fileset.regex else (e for e in literal_ends(fileset.pattern))
        at_end = len(suffix) > len(prefix)
        text = suffix[-_KEY_CHARS:] if at_end else prefix[:_KEY_CHARS]
        look = (at_end, "/" in fileset.spec, len(text))
        looks.add(look)
        key = f"{look[0]:d}{look[1]:d}{text}"
        slots[zlib.crc32(key.encode()) % size].append({"key": key, "pos": pos, "name": fileset.name, "regex": fileset.anchored})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<key:string,pos:int,name:string,regex:string>>>")

    def found(at_end: bool, whole: bool, length: int) -> Column:
        target = path if whole else base_name(path)
        part = F.right(target, F.lit(length)) if at_end else F.left(target, F.lit(length))
        key = F.concat(F.lit(f"{at_end:d}{whole:d}"), part)
        slot = F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(size)).cast("int"))
        hits = F.filter(slot, lambda x: (x["key"] == key) & F.rlike(target, x["regex"]))
        return F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name")))

    return F.array_min(F.concat(*[found(*look) for look in sorted(looks)]))["name"]


def declared(spark, filesets: list[Fileset], source: str) -> DataFrame:
    """The declarations as rows ``source, fileset, pattern``."""
    rows = [(source, f.name, f.spec) for f in filesets]
    return spark.createDataFrame(rows, "source string, fileset string, pattern string")


def canonical_schemas(
    matched: DataFrame, declarations: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """Canonical schema per fileset: ``source, fileset, pattern, columns``.

    The earlier snapshot's if it has one (``previous``: ``object_uri, columns``), else
    that of the first matched file with a schema; later files never move it.
    """
    keys = ["source", "fileset"]
    first = (
        matched.where(F.col("fileset").isNotNull() & (F.size("columns") > 0))
        .groupBy(*keys)
        .agg(F.min_by(F.map_entries("columns"), "pos").alias("_first"))
    )
    result = declarations.join(first, keys, "left").withColumn("columns", F.map_from_entries("_first"))
    if previous is not None:
        stored = previous.where(F.size("columns") > 0).select("object_uri", F.col("columns").alias("_stored"))
        result = (
            result.withColumn("object_uri", fileset_uri(F.col("source"), F.col("fileset")))
            .join(stored, "object_uri", "left")
            .withColumn("columns", F.coalesce("_stored", "columns"))
        )
    return result.select(
        *keys, "pattern", F.coalesce("columns", F.expr("cast(map() as map<string,string>)")).alias("columns"))


def fileset_snapshot(canonical: DataFrame) -> DataFrame:
    return canonical.select(
        fileset_uri(F.col("source"), F.col("fileset")).alias("object_uri"),
        F.lit("fileset").alias("kind"),
        "columns",
        "pattern",
    )


def schema_deviations(matched: DataFrame, canonical: DataFrame, protocol: str) -> DataFrame:
    """Breaking events of files whose schema is not their fileset's canonical one.

    Files without a schema belong to their fileset but are not checked.
    """
    known = canonical.select("source", "fileset", F.col("columns").alias("_canonical"))
    checked = matched.where(F.col("fileset").isNotNull() & (F.size("columns") > 0)).join(known, ["source", "fileset"], "inner")
    return checked.where(sorted_entries(F.col("columns")) != sorted_entries(F.col("_canonical"))).select(
        file_uri(protocol, F.col("source"), F.col("path")).alias("object_uri"),
        F.lit("file_schema_changed").alias("change_type"),
        severity(F.lit("file_schema_changed")).alias("severity"),
        detail_json(
            fileset=F.col("fileset"),
            new_columns=columns_json(F.col("columns")),
            old_columns=columns_json(F.col("_canonical")),
        ).alias("detail"),
    )


def unrecognized_files(files: DataFrame, filesets: list[Fileset], protocol: str) -> DataFrame:
    """Info events of files (already without matched and suggested ones) that no fileset covers."""
    names = F.array(*[F.lit(f.name) for f in filesets])
    return files.select(
        file_uri(protocol, F.col("source"), F.col("path")).alias("object_uri"),
        F.lit("unrecognized_file").alias("change_type"),
        severity(F.lit("unrecognized_file")).alias("severity"),
        detail_json(declared_filesets=names, file=F.col("path")).alias("detail"),
    )

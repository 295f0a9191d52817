"""Object addresses, the keys of every state table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_source_uri(protocol, source) -> Column:
    return F.concat(_c(protocol), F.lit("://"), _c(source), F.lit("/"))


def file_uri(protocol, source, path) -> Column:
    return F.concat(file_source_uri(protocol, source), F.lit("/"), _c(path))


def fileset_uri(source, name) -> Column:
    return F.concat(F.lit("fileset://"), _c(source), F.lit("/"), _c(name))


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)

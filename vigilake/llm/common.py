"""Shared pieces: tables, words as columns, tables kept in the shared folder, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import stash

#: The white space between words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    spaced = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def up_to(count: Column) -> Column:
    """0 ... count - 1, no element if there is none."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], spread_by: Column, salts: int = 16) -> DataFrame:
    """Left join of many rows with one row per key; a hot key's rows go to ``salts`` tasks, chosen by ``spread_by``.

    ``right`` is repeated ``salts`` times, so it should be the small, aggregated side.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")

"""Table profiling: every statistic of a table in one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNT_SUFFIXES = ("__null_count", "__non_null_count")
#: log2 of a sketch's registers: an error of about 1.6 percent.
SKETCH_PRECISION = 12
_TEXT = (T.StringType, T.CharType, T.VarcharType)


def profile_items(schema: T.StructType, heavy: bool = False, quote: str = '"') -> list[tuple[str, str]]:
    """The statistics as (SQL aggregate, ``{column}__{statistic}``), last ``row_count``.

    Text rather than column objects: a wide table has thousands of them.
    """
    numbers, texts = _names(schema, T.NumericType), _names(schema, _TEXT)
    items = []
    for c in numbers:
        items += [(f"{f}({_quoted(c, quote)})", f"{c}__{f}") for f in ("min", "avg", "max")]
    for c in numbers + texts:
        col = _quoted(c, quote)
        items += [(f"count(*) - count({col})", f"{c}__null_count"), (f"count({col})", f"{c}__non_null_count")]
    if heavy:
        items += [(f"count(distinct {_quoted(c, quote)})", f"{c}__unique_count") for c in texts]
    return [*items, ("count(*)", "row_count")]


def _names(schema: T.StructType, kinds) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def _quoted(name: str, quote: str = "`") -> str:
    return quote + name.replace(quote, quote * 2) + quote


def _distinct(column: str, approx: bool) -> str:
    """Distinct count of a text column, long texts by their digest.

    Keeps whole documents out of the shuffle. A short text never equals a stand-in,
    which is longer than any text left as it is.
    """
    col = _quoted(column)
    key = f"if(length({col}) > 64, concat('sha256:', sha2({col}, 256)), {col})"
    return f"approx_count_distinct({key})" if approx else f"count(distinct {key})"


def profile_table(
    df: DataFrame,
    heavy: bool = False,
    approx: bool = False,
    sample_percent: float | None = None,
    seed: int = 17,
    sample: Column | None = None,
) -> DataFrame:
    """One row of statistics.

    ``heavy`` adds distinct counts of text columns (``approx`` for sketches instead
    of exact sets). ``sample_percent`` profiles a random sample, or the rows of
    ``sample``, a condition that holds for that share of them, and scales the counts
    back up.
    """
    if sample is not None:
        target = df.where(sample)
    else:
        target = df.sample(sample_percent / 100.0, seed) if sample_percent else df
    items = profile_items(df.schema, quote="`")
    if heavy:
        texts = _names(df.schema, _TEXT)
        items = [*items[:-1], *[(_distinct(c, approx), f"{c}__unique_count") for c in texts], items[-1]]
    stats = target.selectExpr(*[f"{e} as {_quoted(n)}" for e, n in items])
    return scale_counts(stats, sample_percent)


def profile_query(schema: T.StructType, table: str, heavy: bool = False, quote: str = '"') -> str:
    """The profile as one SELECT for the database that holds the table.

    Read through JDBC's ``query`` option it moves one row instead of the table, and
    has the columns of ``profile_table``.
    """
    items = profile_items(schema, heavy, quote)
    return f"select {', '.join(f'{e} as {_quoted(n, quote)}' for e, n in items)} from {table}"


def scale_counts(stats: DataFrame, sample_percent: float | None) -> DataFrame:
    """Scale row and null counts of a sample to the whole table, half to even.

    Distinct counts do not scale; min, avg and max need no scaling.
    """
    if not sample_percent:
        return stats
    factor = 100.0 / sample_percent

    def scaled(name: str) -> str:
        if name == "row_count" or name.endswith(COUNT_SUFFIXES):
            return f"cast(bround({_quoted(name)} * {factor!r}D, 0) as bigint) as {_quoted(name)}"
        return _quoted(name)

    return stats.selectExpr(*[scaled(c) for c in stats.columns])


def to_metrics(stats: DataFrame, table_uri: str, ts: Column) -> DataFrame:
    """A one-row profile as metric points, one per statistic."""
    names = [_quoted(c) for c in stats.columns]
    return (
        stats.selectExpr(*[f"try_cast({c} as double) as {c}" for c in names])
        .unpivot([], names, "metric_name", "metric_value")
        .select(
            F.concat(F.lit(table_uri + "/"), "metric_name").alias("uri"),
            ts.alias("ts"),
            "metric_name",
            "metric_value",
        )
    )


def profile_tables(
    tables: dict[str, DataFrame], ts: Column, heavy: bool = False,
    profiles: dict[str, DataFrame] | None = None, **options,
) -> DataFrame:
    """Metric points of several tables (uri to table), one scan of each, in one job.

    A table with a one-row profile of its own in ``profiles``, made by its database, is not read.
    """
    made = profiles or {}
    parts = [
        to_metrics(made[uri] if uri in made else profile_table(df, heavy, **options), uri, ts)
        for uri, df in tables.items()
    ]
    points = parts[0]
    for part in parts[1:]:
        points = points.unionByName(part)
    return points


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, precision: int = SKETCH_PRECISION) -> DataFrame:
    """``name, sketch, rows``: a HyperLogLog sketch of the values of each column, a few kilobytes whatever their number.

    Values count by their text, nulls not at all. Kept with a scan, sketches of appended partitions are merged with
    the older ones, so a profile of the whole reads the new partitions only.
    """
    names = list(columns) if columns is not None else _names(df.schema, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, *_TEXT))
    if not names:
        return df.sparkSession.createDataFrame([], "name string, sketch binary, rows bigint")
    aggs = [F.struct(F.hll_sketch_agg(F.col(f"`{n}`").cast("string"), precision).alias("sketch"), F.count("*").alias("rows")).alias(f"s{i}") for i, n in enumerate(names)]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{i}.sketch"), F.col(f"s{i}.rows")) for i, n in enumerate(names)])).alias("s")).select("s.*")


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """``name, sketch, rows`` of all parts together; parts of other precision take the lowest."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("name").agg(F.hll_union_agg("sketch", True).alias("sketch"), F.sum("rows").alias("rows"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``name, unique_count, rows``: estimates, off by two percent or so at the usual precision."""
    return sketches.select("name", F.hll_sketch_estimate("sketch").alias("unique_count"), "rows")

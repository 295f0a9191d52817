"""Registered queries: table profiles, metric series, outliers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators import metrics as M
from vigilake.operators import outliers as Z
from vigilake.operators import profile as P
from vigilake.plans import inputs as I
from vigilake.plans.inputs import load, table_uri_of, with_ctes
from vigilake.session import cut_lineage
from vigilake.sources.tables import crawl_fields

# Numeric and text columns of the given tables, for the SQL side.
COLUMNS = {
    "region": (["r_regionkey"], ["r_name"]),
    "nation": (["n_nationkey", "n_regionkey"], ["n_name"]),
    "customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    "supplier": (["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"]),
    "events": (["event_id", "user_id", "value"], ["event_type", "props"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source"]),
    "embeddings": (["vec_id", "label"], []),
    "pages": (["page_id"], ["url", "html"]),
    "benchmark": (["item_id"], ["text"]),
    "labels": (["doc_id", "quality", "toxic"], []),
    "conversations": (["conv_id", "turn"], ["role", "text"]),
}
OTHER = {
    "orders": [("o_orderdate", "timestamp")],
    "lineitem": [("l_shipdate", "timestamp")],
    "events": [("ts", "timestamp")],
    "embeddings": [("embedding", "array<float>")],
}
TS = "%Y-%m-%d %H:%M:%S.%f"


def rounded(column: str, digits: int = 4):
    """Rounded with ties moved off the half, where sums added in another order would differ."""
    return F.round(F.col(column) + F.lit(1.3e-7), digits).alias(column)


def show_ts(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def sql_ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '{TS}') AS {name or column}"


def _stats_sql(table: str, heavy: bool, scale: float | None = None) -> list[tuple[str, str]]:
    numbers, texts = COLUMNS[table]
    stats = []
    for c in numbers:
        stats += [(f"{c}__min", f"min({c})"), (f"{c}__avg", f"avg({c})"), (f"{c}__max", f"max({c})")]
    for c in numbers + texts:
        stats += [(f"{c}__null_count", f"count(*) FILTER (WHERE {c} IS NULL)"), (f"{c}__non_null_count", f"count({c})")]
    if heavy:
        stats += [(f"{c}__unique_count", f"count(DISTINCT {c})") for c in texts]
    stats.append(("row_count", "count(*)"))
    if scale:
        stats = [(n, f"round_even(({e}) * {scale}, 0)::BIGINT")
                 if n == "row_count" or n.endswith(P.COUNT_SUFFIXES) else (n, e) for n, e in stats]
    return stats


def _long_sql(tables: list[str], heavy: bool) -> str:
    parts = []
    for t in tables:
        wide = ", ".join(f'({e})::DOUBLE AS "{n}"' for n, e in _stats_sql(t, heavy))
        parts.append(
            f"SELECT '{table_uri_of(t)}/' || metric_name AS uri, metric_name, round(metric_value + 1.3e-7, 4) AS metric_value "
            f"FROM (UNPIVOT (SELECT {wide} FROM {t}) ON COLUMNS(*) INTO NAME metric_name VALUE metric_value)")
    return " UNION ALL ".join(parts)


def _rounded(points: DataFrame) -> DataFrame:
    return points.select("uri", "metric_name", rounded("metric_value", 4)).where(
        "metric_value is not null")


def metric_long(spark, sf_dir) -> DataFrame:
    tables = {table_uri_of(t): load(spark, sf_dir, t) for t in I.TABLES}
    return _rounded(P.profile_tables(tables, F.lit(I.NOW).cast("timestamp")))


def table_profile_heavy(spark, sf_dir) -> DataFrame:
    tables = {table_uri_of(t): load(spark, sf_dir, t) for t in I.TABLES}
    return _rounded(P.profile_tables(tables, F.lit(I.NOW).cast("timestamp"), heavy=True))


def _round_floats(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table_profile(spark, sf_dir) -> DataFrame:
    return _round_floats(P.profile_table(load(spark, sf_dir, "lineitem")))


def _wide_sql(table: str, scale: float | None = None) -> str:
    floats = ("__avg",)
    doubles = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
    cols = [f"round({e} + 1.3e-7, 4) AS {n}" if n.endswith(floats) or n.rsplit("__", 1)[0] in doubles and n.endswith(("min", "max"))
            else f"{e} AS {n}" for n, e in _stats_sql(table, False, scale)]
    return f"SELECT {', '.join(cols)} FROM {table}"


def profile_scaled(spark, sf_dir) -> DataFrame:
    return _round_floats(P.scale_counts(P.profile_table(load(spark, sf_dir, "orders")), 40.0))


def profile_sampled(spark, sf_dir) -> DataFrame:
    """A tenth of the orders, chosen by key: the same rows in every run and engine."""
    chosen = F.substring(F.md5(F.col("l_orderkey").cast("string").cast("binary")), 1, 3) < F.lit("19a")
    return _round_floats(P.profile_table(load(spark, sf_dir, "lineitem"), sample_percent=10.0, sample=chosen))


def profile_approx(spark, sf_dir) -> DataFrame:
    """Sketched distinct counts beside exact ones, and whether they lie within a tenth."""
    documents = load(spark, sf_dir, "documents")
    counts = []
    for approx in (True, False):
        stats = P.profile_table(documents, heavy=True, approx=approx)
        names = [c for c in stats.columns if c.endswith("__unique_count")]
        counts.append(stats.select(*names).unpivot([], names, "name", "approx" if approx else "exact"))
    near = F.abs(F.col("approx") - F.col("exact")) <= F.col("exact") * 0.1
    return counts[0].join(counts[1], "name").select("name", "exact", near.alias("within"))


def profile_sketches(spark, sf_dir) -> DataFrame:
    """Distinct counts of all orders from sketches kept per year, beside exact ones, and whether they lie within a twentieth."""
    orders = load(spark, sf_dir, "orders")
    columns = [*COLUMNS["orders"][0], *COLUMNS["orders"][1]]
    years = [orders.where(F.year("o_orderdate") == y) for y in range(1995, 2001)]
    rest = orders.where((F.year("o_orderdate") < 1995) | (F.year("o_orderdate") > 2000) | F.col("o_orderdate").isNull())
    kept = cut_lineage(reduce(DataFrame.unionByName, [P.distinct_sketches(part, columns) for part in [*years, rest]]))
    counted = P.sketched_counts(P.merge_sketches(kept))
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "name", "exact")
    return counted.join(exact, "name").select("name", "rows", "exact", (F.abs(F.col("unique_count") - F.col("exact")) <= F.col("exact") * 0.05).alias("within"))


def catalog_crawl(spark, sf_dir) -> DataFrame:
    """Every column of every table with its type and class, from the tables' schemas alone."""
    from vigilake.functions.text_types import generic_class

    tables = {table_uri_of(t): load(spark, sf_dir, t) for t in I.TABLES}
    return crawl_fields(spark, tables).select("uri", "name", "type", generic_class(F.col("type")).alias("type_class"))


def _crawl_sql() -> str:
    ints = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber", "label", "quality", "toxic"}
    doubles = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
    rows = []
    for t, (numbers, texts) in COLUMNS.items():
        for c in numbers:
            typ = "int" if c in ints else "double" if c in doubles else "bigint"
            rows.append((t, c, typ, "number" if typ == "double" else "integer"))
        rows += [(t, c, "string", "string") for c in texts]
        rows += [(t, c, typ, "date-time" if typ == "timestamp" else "nested") for c, typ in OTHER.get(t, [])]
    return " UNION ALL ".join(
        f"SELECT '{table_uri_of(t)}/{c}' AS uri, '{c}' AS name, '{typ}' AS type, '{cls}' AS type_class"
        for t, c, typ, cls in rows)


def _series_input(spark, sf_dir) -> DataFrame:
    daily = load(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        F.count("*").cast("double").alias("metric_value"))
    return I.metrics(spark, sf_dir).unionByName(daily.select(
        F.lit("db://lake/main/lineitem/row_count").alias("uri"), "ts", F.lit("row_count").alias("metric_name"), "metric_value"))


def metric_series(spark, sf_dir) -> DataFrame:
    return M.series(_series_input(spark, sf_dir)).select("uri", show_ts("ds"), rounded("y", 4))


def zscore_outliers(spark, sf_dir) -> DataFrame:
    found = Z.zscore_outliers(M.series(I.metrics(spark, sf_dir)))
    return found.select("uri", show_ts("ds"), rounded("y", 4), rounded("z_index", 4))


_Z = with_ctes("metrics", """
, scored AS (SELECT uri, ts ds, metric_value y, count(*) OVER w n, stddev_pop(metric_value) OVER w s,
    abs(metric_value - avg(metric_value) OVER w) d FROM metrics WINDOW w AS (PARTITION BY uri)),
  found AS (SELECT *, d / s z FROM scored WHERE n >= 2 AND s > 0 AND d / s > 3.0)
""")


def outlier_series(spark, sf_dir) -> DataFrame:
    found = Z.reportable_series(Z.zscore_outliers(M.series(I.metrics(spark, sf_dir))), 2)
    return found.select("uri", show_ts("ds"), rounded("y", 4), rounded("z_index", 4))


def forecast_band(spark, sf_dir) -> DataFrame:
    found = Z.band_outliers(M.series(I.metrics(spark, sf_dir)))
    return found.select("uri", show_ts("ds"), *[rounded(c, 3) for c in ("observed", "lower", "upper")])


def seasonal_band(spark, sf_dir) -> DataFrame:
    found = Z.seasonal_outliers(M.series(I.metrics(spark, sf_dir)))
    return found.select("uri", show_ts("ds"), *[rounded(c, 3) for c in ("observed", "lower", "upper")])


def _season_sql() -> str:
    """The band by Gram-Schmidt: each column less what the ones before it explain, sums over the series as windows."""
    columns = ["1.0::DOUBLE", "t", *[f"{f}(t * {2 * math.pi / 7 * k!r})" for k in (1, 2) for f in ("sin", "cos")]]
    sql = ", s AS (SELECT uri, ts, metric_value y, epoch_us(ts) / 86400000000.0 x FROM metrics)"
    sql += ", c AS (SELECT *, count(*) OVER w n, y - avg(y) OVER w yc, avg(y) OVER w m, x - min(x) OVER w t FROM s WINDOW w AS (PARTITION BY uri) QUALIFY n >= 12)"
    before, named = "c", []
    for j, column in enumerate(columns):
        sql += f", f{j} AS (SELECT *, {column} r{j}, {column} w{j} FROM {before})"
        before = f"f{j}"
        for k in named:
            sql += (f", f{j}_{k} AS (SELECT * REPLACE (w{j} - CASE WHEN u{k} THEN q{k} * sum(w{j} * q{k}) OVER (PARTITION BY uri) / sum(q{k} * q{k}) OVER (PARTITION BY uri) ELSE 0 END AS w{j}) FROM {before})")
            before = f"f{j}_{k}"
        sql += f", g{j} AS (SELECT *, w{j} q{j}, sum(w{j} * w{j}) OVER (PARTITION BY uri) > 1e-9 * sum(r{j} * r{j}) OVER (PARTITION BY uri) u{j} FROM {before})"
        before = f"g{j}"
        named.append(j)
    fit = " + ".join(f"CASE WHEN u{j} THEN q{j} * sum(yc * q{j}) OVER (PARTITION BY uri) / sum(q{j} * q{j}) OVER (PARTITION BY uri) ELSE 0 END" for j in named)
    sql += f", fitted AS (SELECT uri, ts, y, m + {fit} fit FROM {before})"
    sql += ", band AS (SELECT *, sqrt(avg((y - fit) * (y - fit)) OVER (PARTITION BY uri)) * 1.2815515655446004 s FROM fitted)"
    return with_ctes("metrics", sql + f"""
SELECT uri, {sql_ts('ts', 'ds')}, round(y + 1.3e-7, 3) AS observed, round(fit - s + 1.3e-7, 3) AS "lower", round(fit + s + 1.3e-7, 3) AS "upper"
FROM band WHERE y < fit - s OR y > fit + s""")


def running_anomalies(spark, sf_dir) -> DataFrame:
    """The anomalies of the last batch from moments that were kept and merged twice; older points are not read for them."""
    pushes = I.pushes(spark, sf_dir)
    first, second, last = (pushes.where(w) for w in (
        "batch_id < '2024-01-15'", "batch_id >= '2024-01-15' and batch_id < '2024-01-30'", "batch_id = '2024-01-30'"))
    state = cut_lineage(Z.merge_moments(Z.moments(first), Z.moments(second)))
    found = Z.running_anomalies(Z.merge_moments(state, Z.moments(last)), last, threshold=1.5)
    return found.select("org_id", "uri", "batch_id", show_ts(), "metric_value", rounded("z_score", 4), "algorithm")


def batch_anomalies(spark, sf_dir) -> DataFrame:
    found = Z.batch_anomalies(I.pushes(spark, sf_dir), "2024-01-30", threshold=1.5)
    return found.select("org_id", "uri", "batch_id", show_ts(), "metric_value", rounded("z_score", 4), "algorithm")


QUERIES = {
    "metric_long": (metric_long, f"SELECT * FROM ({_long_sql(list(COLUMNS), False)}) WHERE metric_value IS NOT NULL"),
    "table_profile": (table_profile, _wide_sql("lineitem")),
    "table_profile_heavy": (
        table_profile_heavy,
        f"SELECT * FROM ({_long_sql(list(COLUMNS), True)}) WHERE metric_value IS NOT NULL"),
    "profile_scaled": (profile_scaled, _wide_sql("orders", 2.5)),
    "profile_sampled": (
        profile_sampled, _wide_sql("lineitem", 10.0).replace("FROM lineitem", "FROM lineitem WHERE substr(md5(l_orderkey::VARCHAR), 1, 3) < '19a'")),
    "profile_approx": (profile_approx, " UNION ALL ".join(
        f"SELECT '{c}__unique_count' AS name, count(DISTINCT {c}) AS exact, true AS within FROM documents" for c in COLUMNS["documents"][1])),
    "profile_sketches": (profile_sketches, " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS rows, count(DISTINCT {c}) AS exact, true AS within FROM orders" for c in [*COLUMNS["orders"][0], *COLUMNS["orders"][1]])),
    "catalog_crawl": (catalog_crawl, _crawl_sql()),
    "metric_series": (metric_series, with_ctes("metrics", f"""
, all_points AS (SELECT * FROM metrics UNION ALL
    SELECT 'db://lake/main/lineitem/row_count', date_trunc('day', l_shipdate), 'row_count', count(*)::DOUBLE FROM lineitem GROUP BY 2)
SELECT uri, {sql_ts('ts', 'ds')}, round(metric_value + 1.3e-7, 4) AS y FROM all_points WHERE metric_value IS NOT NULL""")),
    "zscore_outliers": (
        zscore_outliers, _Z + f"SELECT uri, {sql_ts('ds')}, round(y + 1.3e-7, 4) AS y, round(z + 1.3e-7, 4) AS z_index FROM found"),
    "outlier_series": (
        outlier_series, _Z + f""", frequent AS (SELECT uri FROM found GROUP BY uri HAVING count(*) >= 2)
SELECT uri, {sql_ts('ds')}, round(y + 1.3e-7, 4) AS y, round(z + 1.3e-7, 4) AS z_index FROM found WHERE uri IN (SELECT uri FROM frequent)"""),
    "forecast_band": (forecast_band, with_ctes("metrics", f"""
, xy AS (SELECT uri, ts, metric_value y, epoch_us(ts) / 86400000000.0 x FROM metrics),
  fits AS (SELECT uri, regr_slope(y, x) b, regr_intercept(y, x) a FROM xy GROUP BY uri HAVING count(*) >= 2),
  resid AS (SELECT xy.*, a + b * x fit FROM xy JOIN fits USING (uri) WHERE b IS NOT NULL),
  spread AS (SELECT uri, stddev_pop(y - fit) * 1.2815515655446004 s FROM resid GROUP BY uri)
SELECT uri, {sql_ts('ts', 'ds')}, round(y + 1.3e-7, 3) AS observed, round(fit - s + 1.3e-7, 3) AS "lower", round(fit + s + 1.3e-7, 3) AS "upper"
FROM resid JOIN spread USING (uri) WHERE y < fit - s OR y > fit + s""")),
    "seasonal_band": (seasonal_band, _season_sql()),
    "running_anomalies": (running_anomalies, with_ctes("pushes", f"""
, scored AS (SELECT *, count(*) OVER w n, stddev_pop(metric_value) OVER w s,
    abs(metric_value - avg(metric_value) OVER w) d FROM pushes WHERE batch_id <= '2024-01-30' WINDOW w AS (PARTITION BY org_id, uri))
SELECT org_id, uri, batch_id, {sql_ts('ts')}, metric_value, round(d / s + 1.3e-7, 4) AS z_score, 'zscore' AS algorithm
FROM scored WHERE n >= 3 AND s > 0 AND d / s >= 1.5 AND batch_id = '2024-01-30'""")),
    "batch_anomalies": (batch_anomalies, with_ctes("pushes", f"""
, scored AS (SELECT *, count(*) OVER w n, stddev_pop(metric_value) OVER w s,
    abs(metric_value - avg(metric_value) OVER w) d FROM pushes WINDOW w AS (PARTITION BY org_id, uri))
SELECT org_id, uri, batch_id, {sql_ts('ts')}, metric_value, round(d / s + 1.3e-7, 4) AS z_score, 'zscore' AS algorithm
FROM scored WHERE n >= 3 AND s > 0 AND d / s >= 1.5 AND batch_id = '2024-01-30'""")),
}

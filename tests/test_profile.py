import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vigilake.operators import metrics as M
from vigilake.operators import profile as P


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(i, Decimal(10 * i), ["ann", "bob", "cy"][i % 3], dt.datetime(2026, 1, 1), i % 2 == 0) for i in range(6)]
    return spark.createDataFrame(rows, "id int, total decimal(10,2), customer string, created_at timestamp, flag boolean")


def test_profile_covers_numbers_and_text_only(orders):
    row = P.profile_table(orders).first().asDict()
    assert row["row_count"] == 6 and row["id__min"] == 0 and row["id__max"] == 5 and row["total__avg"] == 25
    assert row["customer__null_count"] == 0 and row["customer__non_null_count"] == 6
    assert not [k for k in row if k.startswith(("created_at", "flag")) or k.endswith("unique_count")]


def test_heavy_profile_counts_distinct_text(orders):
    row = P.profile_table(orders, heavy=True).first()
    assert row["customer__unique_count"] == 3
    assert P.profile_table(orders, heavy=True, approx=True).first()["customer__unique_count"] == 3


def test_nulls_and_empty_tables(spark, orders):
    holes = orders.withColumn("total", F.when(F.col("id") > 3, F.col("total")))
    row = P.profile_table(holes).first()
    assert (row["total__null_count"], row["total__non_null_count"]) == (4, 2)
    empty = P.profile_table(orders.where("false")).first()
    assert empty["row_count"] == 0 and empty["id__min"] is None


def test_profile_is_one_pass(orders):
    plan = P.profile_table(orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1 and plan.count("Scan") == 1


def test_profile_reads_only_profiled_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderdate")
    plan = P.profile_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_sampled_counts_are_scaled(spark):
    stats = spark.sql("select 500L row_count, 50L customer__null_count, 42L customer__unique_count, 12.5D total__avg, cast(null as bigint) x__null_count")
    row = P.scale_counts(stats, 10).first()
    assert (row.row_count, row.customer__null_count, row.customer__unique_count, row.total__avg, row.x__null_count) == (5000, 500, 42, 12.5, None)
    half = spark.sql("select 1L row_count, 3L a__null_count")
    assert P.scale_counts(half, 200).first() == (0, 2)
    assert P.scale_counts(stats, None).first() == stats.first() and P.scale_counts(stats, 100).first() == stats.first()


def test_sampling_estimates_the_table(spark):
    row = P.profile_table(spark.range(100_000), sample_percent=20).first()
    assert abs(row.row_count - 100_000) < 3000


def test_metrics_are_long(orders):
    points = P.to_metrics(P.profile_table(orders), "db://s/d/x/orders", F.lit("2026-01-01").cast("timestamp"))
    found = {r.uri: r.metric_value for r in points.collect()}
    assert found["db://s/d/x/orders/row_count"] == 6.0 and found["db://s/d/x/orders/total__max"] == 50.0
    assert len(found) == 3 * 2 + 2 * 3 + 1


FILES = "source string, fileset string, pos int, size bigint, mtime timestamp, columns map<string,string>, num_rows bigint"


def test_fileset_metrics_skip_unknown_values(spark):
    t = dt.datetime(2026, 7, 1)
    files = spark.createDataFrame([("s", "f", 0, 10, t, {"a": "x"}, 7), ("s", "f", 1, 20, t, {}, None), ("s", None, 2, 5, t, {"a": "x"}, 1)], FILES)
    found = sorted((r.uri, r.metric_value, r.pos) for r in M.fileset_metrics(files).collect())
    assert found == [("fileset://s/f/column_count", 1.0, 0), ("fileset://s/f/file_size", 10.0, 0), ("fileset://s/f/file_size", 20.0, 1),
                     ("fileset://s/f/row_count", 7.0, 0)]


def test_points_are_appended_once(spark):
    t = dt.datetime(2026, 7, 1)
    schema = "uri string, ts timestamp, metric_name string, metric_value double, pos int"
    batch = spark.createDataFrame([("u", t, "file_size", 1024.0, 0), ("u", t, "file_size", 9999.0, 1), ("v", t, "row_count", None, 2)], schema)
    stored = M.new_points(batch, batch.where("false"))
    assert [(r.uri, r.metric_value) for r in stored.collect()] == [("u", 1024.0)]
    assert M.new_points(batch, stored).count() == 0


def test_series_caps_are_optional(spark):
    rows = [("u", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), "m", float(i)) for i in range(20)] + [("w", dt.datetime(2026, 1, 1), "m", None)]
    points = spark.createDataFrame(rows, "uri string, ts timestamp, metric_name string, metric_value double")
    assert M.series(points).count() == 20
    assert max(r.y for r in M.series(points, 5).collect()) == 4.0
    assert min(r.y for r in M.series(points, 5, "latest").collect()) == 15.0
    assert "WindowGroupLimit" in M.series(points, 5)._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_counted_by_digest(spark):
    texts = ["a" * 64, "a" * 65, "a" * 66, "b" * 5000, "b" * 5000, "b" * 5001, "short", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert P.profile_table(df, heavy=True).first()["t__unique_count"] == 6


def test_pushed_profile_equals_the_local_one(spark, orders):
    holes = orders.withColumn("customer", F.when(F.col("id") != 2, F.col("customer"))).withColumnRenamed("total", "odd name")
    holes.createOrReplaceTempView("orders_view")
    pushed = spark.sql(P.profile_query(holes.schema, "orders_view", heavy=True, quote="`"))
    local = P.profile_table(holes, heavy=True)
    assert sorted(pushed.columns) == sorted(local.columns)
    assert pushed.select(*local.columns).first() == local.first()
    assert 'min("odd name") as "odd name__min"' in P.profile_query(holes.schema, "t")
    ready = P.profile_tables({"a": holes, "b": holes}, F.lit("2026-01-01").cast("timestamp"), profiles={"b": pushed.limit(1)})
    assert ready.where("uri = 'b/row_count'").first().metric_value == 6.0


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, "x"), (3, "y")], "`a.b` int, `c d` string")
    found = {r.metric_name: r.metric_value for r in P.to_metrics(P.scale_counts(P.profile_table(df, heavy=True), 100), "t", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert found["a.b__max"] == 3.0 and found["c d__unique_count"] == 2.0


def test_merged_sketches_count_like_the_sketch_of_the_whole(spark):
    df = spark.range(40000).select((F.col("id") % 12345).alias("k"), F.concat(F.lit("v"), F.col("id") % 300).alias("few"), F.lit(None).cast("string").alias("none"))
    parts = [P.distinct_sketches(df.where(f"k % 3 = {i}")) for i in range(3)]
    merged = {r.name: (r.unique_count, r.rows) for r in P.sketched_counts(P.merge_sketches(*parts)).collect()}
    whole = {r.name: (r.unique_count, r.rows) for r in P.sketched_counts(P.merge_sketches(P.distinct_sketches(df))).collect()}
    assert set(merged) == {"k", "few", "none"} and all(merged[n][1] == whole[n][1] == 40000 for n in merged)
    for name, exact in (("k", 12345), ("few", 300), ("none", 0)):
        assert abs(merged[name][0] - whole[name][0]) <= 0.001 * exact and abs(merged[name][0] - exact) <= 0.05 * exact
    again = P.sketched_counts(P.merge_sketches(parts[0], parts[0])).where("name = 'k'").first().unique_count
    assert abs(again - 12345 / 3) <= 0.05 * 12345 / 3
    assert P.distinct_sketches(df.select("none").limit(0)).first().rows == 0 and P.distinct_sketches(df, []).count() == 0

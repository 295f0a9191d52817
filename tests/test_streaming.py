import datetime as dt

from pyspark.sql import functions as F

from vigilake.operators.filesets import Fileset
from vigilake.operators.freshness import latest_arrivals
from vigilake.streaming import listing as L
from vigilake.streaming import windows as W


def test_listing_stream_sees_each_file_once(spark, tmp_path):
    root, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    root.mkdir()
    (root / "a_1.csv").write_text("x")
    L.append_new(L.stream_listing(spark, str(root), "s", "*.csv"), table, checkpoint)
    (root / "a_2.csv").write_text("xyz")
    (root / "skip.txt").write_text("x")
    for _ in range(2):
        L.append_new(L.stream_listing(spark, str(root), "s", "*.csv"), table, checkpoint)
    rows = spark.read.parquet(table).select(F.substring_index("path", "/", -1).alias("n"), "size").collect()
    assert sorted(map(tuple, rows)) == [("a_1.csv", 1), ("a_2.csv", 3)]


def test_arrivals_from_a_listing_stream(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "t")
    root.mkdir()
    for name in ("a_1.csv", "a_2.csv", "other.csv"):
        (root / name).write_text("x")
    stream = L.stream_arrivals(L.stream_listing(spark, str(root), "s"), [Fileset("a", pattern="a_{seq}.csv")])
    L.append_new(stream, table, str(tmp_path / "c"))
    log = spark.read.parquet(table).withColumn("source_uri", F.lit("s3://s/"))
    assert latest_arrivals(log, "batch_id").count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("a", start + dt.timedelta(hours=h), float(h)) for h in range(50)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    aggs = {"row_count": F.count("*"), "v__max": F.max("v")}
    W.append_closed(W.windowed_metrics(events, F.col("k"), "ts", aggs), str(tmp_path / "out"), str(tmp_path / "c"))
    found = sorted((r.uri, r.ts, r.metric_value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    days = [start, start + dt.timedelta(days=1)]
    assert found == [("a/row_count", d, 24.0) for d in days] + [("a/v__max", d, v) for d, v in zip(days, (23.0, 47.0))]

"""Live overdue detection and session windows."""

import datetime as dt
import random
from statistics import median

from pyspark.sql import functions as F

from vigilake.streaming import listing as SL
from vigilake.streaming import overdue as SO
from vigilake.streaming import windows as SW

START = dt.datetime(2026, 7, 1, 6)
SCHEMA = "source string, fileset string, mtime timestamp"


def at(hours):
    return START + dt.timedelta(hours=hours)


class Landing:
    """A folder of arrivals that a stream reads file by file, with its checkpoint and table of reports."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        (root / "in").mkdir()

    def add(self, rows):
        frame = self.spark.createDataFrame([("s", f, at(h)) for f, h in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def run(self, **options):
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.root / "in"))
        with SO.timers(self.spark):
            SL.append_new(SO.stream_overdue(stream, delay="0 seconds", **options), str(self.root / "out"), str(self.root / "check"))
        rows = self.spark.read.schema("source string, fileset string, last_seen timestamp, median_interval_seconds long, expected_by timestamp, overdue_seconds long").parquet(str(self.root / "out")).collect()
        return sorted((r.fileset, r.last_seen, r.median_interval_seconds, r.expected_by) for r in rows)


def test_a_stopped_feed_is_reported_once_per_expected_time(spark, tmp_path):
    feed = Landing(spark, tmp_path)
    feed.add([("daily", 24 * d) for d in range(5)] + [("clock", h) for h in range(0, 24 * 5, 6)])
    assert feed.run() == []
    feed.add([("clock", h) for h in range(24 * 5, 24 * 8, 6)])
    late = ("daily", at(96), 86400 * 0 + SO.gap_bin(86400_000000) // 1_000_000, at(96) + 2 * dt.timedelta(microseconds=SO.gap_bin(86400_000000)))
    assert feed.run() == [late]
    # A restart, and more time, say nothing new.
    assert feed.run() == [late]
    feed.add([("clock", h) for h in range(24 * 8, 24 * 9, 6)])
    assert feed.run() == [late]
    # It comes back and stops again: a new expected time.
    feed.add([("daily", 24 * 9)])
    assert feed.run() == [late]
    feed.add([("clock", h) for h in range(24 * 9, 24 * 14, 6)])
    found = feed.run()
    assert len(found) == 2 and found[0] == late and found[1][1] == at(24 * 9)


def test_too_few_arrivals_equal_times_and_late_files_report_nothing(spark, tmp_path):
    feed = Landing(spark, tmp_path)
    feed.add([("two", 0), ("two", 1), *[("same", 2)] * 5, ("clock", 0), ("clock", 1), ("clock", 2)])
    feed.run()
    feed.add([("clock", h) for h in range(3, 200)])
    assert feed.run() == []


def test_binned_median_is_near_the_median():
    rng = random.Random(1)
    for _ in range(50):
        gaps = [rng.randrange(1, 10 ** rng.randint(1, 12)) for _ in range(rng.randint(1, 40))]
        bins = {}
        for g in gaps:
            b = SO.gap_bin(g)
            assert 0 <= g - b <= g / 512
            bins[b] = bins.get(b, 0) + 1
        assert SO.histogram_median(bins) == median(map(SO.gap_bin, gaps))
    assert SO.histogram_median({}) == 0.0


def test_state_provider_comes_back(spark):
    before = spark.conf.get(SO.PROVIDER)
    with SO.timers(spark):
        assert spark.conf.get(SO.PROVIDER) == SO.ROCKSDB
    assert spark.conf.get(SO.PROVIDER) == before


def test_sessions_merge_and_close_behind_the_watermark(spark, tmp_path):
    times = {"a": [0, 0.2, 0.4, 2, 2.3, 9], "b": [1, 5, 5.4, 5.8]}
    rows = [(k, at(h), float(h)) for k, v in times.items() for h in v]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = SW.session_metrics(events, F.col("k"), "ts", {"n": F.count("*"), "most": F.max("v")}, "30 minutes", "2 hours")
    SW.append_closed(found, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r.owner, r.opened, r.closed, r.n, r.most) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", at(0), at(0.4), 3, 0.4), ("a", at(2), at(2.3), 2, 2.3), ("b", at(1), at(1), 1, 1.0), ("b", at(5), at(5.8), 3, 5.8)]

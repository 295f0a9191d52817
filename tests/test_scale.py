import random
import statistics

import pytest
from pyspark.sql import functions as F

from vigilake.operators import scale as S


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows."""
    rnd = random.Random(3)
    rows = [("hot" if i % 2 else f"k{i % 37}", i, rnd.random() * 100) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "k string, i int, v double").cache()


def test_group_stats_without_a_job(spark, skewed):
    rows, big = skewed
    spark.sparkContext.setJobGroup("plan", "plan")
    joined = S.with_group_stats(big, ["k"], [F.count("*").alias("n"), F.avg("v").alias("m")])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = {}
    for k, _, v in rows:
        sizes.setdefault(k, []).append(v)
    found = joined.collect()
    assert len(found) == len(rows)
    assert all(r.n == len(sizes[r.k]) and abs(r.m - sum(sizes[r.k]) / r.n) < 1e-9 for r in found)


def test_places_number_every_key_whole(spark, skewed):
    rows, big = skewed
    found = {(r.k, r.i): r._at for r in S.places(big, ["k"], ["i"]).collect()}
    for key in {k for k, _, _ in rows}:
        mine = sorted(i for k, i, _ in rows if k == key)
        assert [found[key, i] for i in mine] == list(range(len(mine)))
    overall = {r.i: r._at for r in S.places(big, [], ["i"]).collect()}
    assert overall == {i: n for n, i in enumerate(sorted(i for _, i, _ in rows))}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, pos int, v string")
    assert sorted(map(tuple, S.first_per_key(df, ["k"], [F.col("pos")]).collect())) == [("a", 1, None), ("b", 5, "z")]


@pytest.mark.parametrize("seed", range(3))
def test_exact_median_against_statistics(spark, seed):
    rnd = random.Random(seed)
    groups = {}
    for g in range(8):
        size = rnd.choice([1, 2, 3, 10, 501])
        top = rnd.choice([3, 1000, 10**7, 10**15])
        groups[f"g{g}"] = [rnd.randint(0, top) for _ in range(size)]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    found = {r.g: (r["median"], r.n) for r in S.exact_median(df, ["g"], "v").collect()}
    assert found == {g: (float(statistics.median(vs)), len(vs)) for g, vs in groups.items()}


@pytest.mark.parametrize("bucket", [1, 3600, 10**6])
def test_gaps_across_buckets(spark, bucket):
    rnd = random.Random(bucket)
    rows = [(rnd.choice("ab"), rnd.randint(-50_000, 200_000)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
    found = sorted((r.k, r.at_us, r.gap_us) for r in S.adjacent_gaps(df, ["k"], "ts", bucket).collect())
    expected = []
    for k in "ab":
        times = sorted({s for key, s in rows if key == k})
        expected += [(k, b * 1_000_000, (b - a) * 1_000_000) for a, b in zip(times, times[1:])]
    assert found == sorted(expected)


def windows(df):
    import re
    return re.findall(r"windowspecdefinition\(([^)]*?)(?:ASC|DESC|,? ?specifiedwindow)", df._jdf.queryExecution().executedPlan().toString())


def test_no_window_spans_a_whole_key_of_raw_rows(spark, skewed):
    from vigilake.operators.outliers import zscore_outliers
    _, big = skewed
    points = big.select(F.col("k").alias("uri"), F.timestamp_seconds("i").alias("ds"), F.col("v").alias("y"))
    assert windows(zscore_outliers(points)) == []
    text = S.adjacent_gaps(points, ["uri"], "ds")._jdf.queryExecution().executedPlan().toString()
    lags = [line for line in text.splitlines() if "Window [lag(at_us" in line]
    assert lags and all("_bucket" in line for line in lags)


def test_local_times_are_accepted(spark):
    df = spark.sql("select 'a' k, timestamp_ntz'2026-01-01 00:00:00' t union all select 'a', timestamp_ntz'2026-01-01 00:00:05'")
    assert [r.gap_us for r in S.adjacent_gaps(df, ["k"], "t").collect()] == [5_000_000]

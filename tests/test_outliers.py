import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import outliers as Z

DAY = dt.datetime(2024, 1, 1)


def points(spark, **series):
    rows = [(u, DAY + dt.timedelta(days=i), float(y) if y is not None else None) for u, ys in series.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "uri string, ds timestamp, y double")


def test_zscore_finds_the_spike_only(spark):
    df = points(spark, a=[10] * 9 + [100], flat=[5] * 12, one=[1], empty=[])
    assert [(r.uri, r.y) for r in Z.zscore_outliers(df, 2.0).collect()] == [("a", 100.0)]
    assert Z.zscore_outliers(df, 100.0).count() == 0
    assert abs(Z.zscore_outliers(df, 2.0).first().z_index - 3.0) < 1e-12


def test_zscore_threshold_is_strict_and_nulls_are_dropped(spark):
    df = points(spark, a=[10] * 9 + [100, None, None])
    z = Z.zscore_outliers(df, 2.0).first().z_index
    assert Z.zscore_outliers(df, z).count() == 0 and Z.zscore_outliers(df, z - 1e-9).count() == 1


def test_zscore_per_series_threshold(spark):
    df = points(spark, a=[10] * 9 + [100], b=[10] * 9 + [100])
    own = spark.createDataFrame([("b", 50.0)], "uri string, threshold double")
    assert [r.uri for r in Z.zscore_outliers(df, 2.0, thresholds=own).collect()] == ["a"]


def test_zscore_brute_force_on_both_join_paths(spark):
    rnd = random.Random(1)
    series = {f"s{i}": [rnd.gauss(0, 1) for _ in range(rnd.randint(1, 60))] for i in range(15)}
    df = points(spark, **series)
    expected = set()
    for u, ys in series.items():
        a = np.array(ys)
        if len(a) >= 2 and a.std() > 0:
            expected |= {(u, y) for y, z in zip(ys, np.abs(a - a.mean()) / a.std()) if z > 1.5}
    assert {(r.uri, r.y) for r in Z.zscore_outliers(df, 1.5).collect()} == expected


def test_series_with_one_outlier_are_not_reported(spark):
    df = points(spark, a=[10] * 9 + [100], b=[10] * 18 + [100, 100])
    found = Z.zscore_outliers(df, 2.0)
    assert {r.uri for r in Z.reportable_series(found, 2).collect()} == {"b"}
    assert {r.uri for r in Z.reportable_series(found, 1).collect()} == {"a", "b"}


def test_band_brute_force(spark):
    rnd = random.Random(2)
    series = {"up": [i * 2 + rnd.gauss(0, 1) for i in range(80)], "line": [3.0 * i for i in range(10)], "two": [1, 2], "one": [4]}
    df = points(spark, **series)
    expected = set()
    for u, ys in series.items():
        if len(ys) < 3:
            continue
        x, y = np.arange(len(ys), dtype=float), np.array(ys, dtype=float)
        b, a = np.polyfit(x, y, 1)
        rest = y - a - b * x
        if rest.std() < 1e-9:
            continue
        expected |= {(u, v) for v, r in zip(y.tolist(), rest) if abs(r) > 1.2815515655446004 * rest.std()}
    found = Z.band_outliers(df.where("uri in ('up', 'one')"))
    assert {(r.uri, r.observed) for r in found.collect()} == {e for e in expected if e[0] == "up"}


def test_custom_model(spark):
    def fit(frame):
        return frame.assign(lower=frame["y"].median() - 5, upper=frame["y"].median() + 5)

    df = points(spark, a=[10] * 9 + [100], one=[1])
    assert [(r.uri, r.observed) for r in Z.model_outliers(df, fit, 1000).collect()] == [("a", 100.0)]
    with pytest.raises(Exception, match="longer than 5"):
        Z.model_outliers(df, fit, 5).collect()


def test_algorithm_and_threshold_precedence(spark):
    df = points(spark, a=[10] * 9 + [100])
    assert Z.detect_outliers(df).count() == 0
    assert Z.detect_outliers(df, config={"threshold": 2.0}).count() == 1
    assert Z.detect_outliers(df, threshold=50, config={"threshold": 2.0}).count() == 0
    assert "lower" in Z.detect_outliers(df, config={"algorithm": "band"}).columns
    assert "z_index" in Z.detect_outliers(df, "zindex", config={"algorithm": "band"}).columns
    with pytest.raises(NotImplementedError):
        Z.detect_outliers(df, "guess")


def test_batch_anomalies_flag_new_points_only(spark):
    history = [("o", "u", "b1", DAY + dt.timedelta(days=i), 10.0 + i % 2) for i in range(20)]
    history += [("o", "u", "b1", DAY + dt.timedelta(days=30), 500.0)]
    batch = [("o", "u", "b2", DAY + dt.timedelta(days=40), 600.0), ("o", "u", "b2", DAY + dt.timedelta(days=41), 10.0)]
    other = [("p", "u", "b1", DAY, 600.0), ("o", "short", "b2", DAY, 1.0), ("o", "null", "b2", DAY, None)]
    df = spark.createDataFrame(history + batch + other, "org_id string, uri string, batch_id string, ts timestamp, metric_value double")
    found = Z.batch_anomalies(df, "b2", 2.0).collect()
    assert [(r.org_id, r.uri, r.metric_value, r.algorithm) for r in found] == [("o", "u", 600.0, "zscore")]


def test_batch_threshold_includes_its_value(spark):
    df = points(spark, u=[0.0] * 9 + [10.0]).select(F.lit("o").alias("org_id"), "uri", F.lit("b").alias("batch_id"), F.col("ds").alias("ts"), F.col("y").alias("metric_value"))
    z = Z.batch_anomalies(df, "b", 2.0).first().z_score
    assert Z.batch_anomalies(df, "b", z).count() == 1


def weekly(spark, weeks=10, broken=31, trend=0.5, uri="w"):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for d in range(7 * weeks):
        y = 1e6 + trend * d + [0, 3, 5, 4, 2, -20, -22][d % 7] + (0.3 if d % 2 else -0.3)
        rows.append((uri, start + dt.timedelta(days=d), y + (15 if d == broken else 0)))
    return spark.createDataFrame(rows, "uri string, ds timestamp, y double")


def test_season_finds_the_broken_day_that_a_trend_misses(spark):
    points = weekly(spark)
    found = Z.seasonal_outliers(points, width=0.999, harmonics=3).collect()
    assert [r.ds for r in found] == [dt.datetime(2024, 1, 1) + dt.timedelta(days=31)]
    assert dt.datetime(2024, 2, 1) not in [r.ds for r in Z.band_outliers(points, width=0.999).collect()]
    named = Z.detect_outliers(points, "seasonal", config={"harmonics": 3})
    assert named.columns == ["uri", "ds", "observed", "lower", "upper"] and named.where("ds = '2024-02-01'").count() == 1


def test_season_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for k, n in enumerate((12, 40, 200, 11)):
        days = np.sort(rng.choice(500, n, replace=False))
        rows += [(f"s{k}", start + dt.timedelta(days=int(d), hours=int(rng.integers(24))), float(rng.normal(50, 9))) for d in days]
    rows += [("flat", start + dt.timedelta(days=7 * i), 3.0) for i in range(20)] + [("s1", start, None)]
    points = spark.createDataFrame(rows, "uri string, ds timestamp, y double")
    found = {(r.uri, r.ds): (r.lower, r.upper) for r in Z.seasonal_outliers(points).collect()}
    want = {}
    for uri in ("s0", "s1", "s2"):
        own = [(t, y) for u, t, y in rows if u == uri and y is not None]
        t = np.array([(x - min(t for t, _ in own)).total_seconds() / 86400 for x, _ in own])
        y = np.array([v for _, v in own])
        a = np.stack([np.ones_like(t), t, *[f(2 * np.pi * k * t / 7) for k in (1, 2) for f in (np.sin, np.cos)]], axis=1)
        fit = a @ np.linalg.lstsq(a, y, rcond=None)[0]
        spread = np.sqrt(np.mean((y - fit) ** 2)) * 1.2815515655446004
        want.update({(uri, x): (f - spread, f + spread) for (x, v), f in zip(own, fit) if v < f - spread or v > f + spread})
    assert set(found) == set(want)
    assert all(np.allclose(found[k], want[k], atol=1e-6) for k in want)


def test_moments_merge_to_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [("o", f"u{int(rng.integers(6))}", int(rng.integers(4)), DAY + dt.timedelta(hours=i), float(1e6 + rng.normal())) for i in range(400)]
    rows += [("o", "new", 3, DAY, 5.0), ("o", "old", 0, DAY, 6.0), ("o", "nulls", 1, DAY, None)]
    points = spark.createDataFrame(rows, "org_id string, uri string, batch_id int, ts timestamp, metric_value double")
    state = Z.moments(points.where("batch_id = 0"))
    for b in (1, 2, 3):
        state = Z.merge_moments(state, Z.moments(points.where(f"batch_id = {b}")))
    whole = {r.uri: (r.n, r["mean"], r.m2) for r in Z.moments(points).collect()}
    merged = {r.uri: (r.n, r["mean"], r.m2) for r in state.collect()}
    assert set(whole) == set(merged) and all(np.allclose(whole[k], merged[k], rtol=1e-7, atol=1e-6) for k in whole)
    batch = points.where("batch_id = 3")
    full = {(r.uri, r.ts): r.z_score for r in Z.batch_anomalies(points, 3, threshold=1.5).collect()}
    running = {(r.uri, r.ts): r.z_score for r in Z.running_anomalies(state, batch, threshold=1.5).collect()}
    assert set(full) == set(running) and len(full) > 3 and all(abs(full[k] - running[k]) < 1e-4 for k in full)

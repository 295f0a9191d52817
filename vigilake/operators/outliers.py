"""Outliers of metric series: z-score, forecast band, new points of a batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.fixed import BAND_WIDTH, Z_THRESHOLD
from vigilake.operators.scale import with_group_stats

#: Share of a column that must be left unexplained by the columns before it.
SINGULAR = 1e-9


def _moments(y: str = "y") -> list:
    return [F.count(y).alias("_n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_std")]


def zscore_outliers(
    points: DataFrame,
    threshold: float = Z_THRESHOLD,
    keys: Sequence[str] = ("uri",),
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Points of ``keys, ds, y`` further than ``threshold`` population deviations from the mean.

    Adds ``z_index``. Series of one point or of equal values have no outliers.
    ``thresholds`` (``uri, threshold``) overrides the threshold of single series.
    """
    rows = points.where("y is not null")
    scored = (
        with_group_stats(rows, keys, _moments())
        .where("_n >= 2 and _std > 0")
        .withColumn("z_index", F.abs((F.col("y") - F.col("_mean")) / F.col("_std")))
    )
    limit = F.lit(float(threshold))
    if thresholds is not None:
        own = thresholds.select("uri", F.col("threshold").alias("_own"))
        scored = scored.join(own, ["uri"], "left")
        limit = F.coalesce("_own", limit)
    return scored.where(F.col("z_index") > limit).select(*points.columns, "z_index")


def band_outliers(
    points: DataFrame, width: float = BAND_WIDTH, keys: Sequence[str] = ("uri",)
) -> DataFrame:
    """Points outside the prediction band of a linear trend: ``keys, ds, observed, lower, upper``.

    The residual deviation follows from the regression sums, so the fit takes one
    aggregate and no second pass over the residuals.
    """
    half = NormalDist().inv_cdf((1 + width) / 2)
    rows = points.where("y is not null").withColumn("_x", F.unix_micros(F.col("ds").cast("timestamp")) / 86_400_000_000)
    fit = [
        F.count("y").alias("_n"),
        F.regr_slope("y", "_x").alias("_slope"),
        F.regr_intercept("y", "_x").alias("_intercept"),
        F.regr_syy("y", "_x").alias("_syy"),
        F.regr_sxy("y", "_x").alias("_sxy"),
        F.regr_sxx("y", "_x").alias("_sxx"),
    ]
    return (
        with_group_stats(rows, keys, fit)
        .where("_n >= 2 and _slope is not null")
        .withColumn("_fit", F.expr("_intercept + _slope * _x"))
        .withColumn("_spread", F.expr("sqrt(greatest((_syy - _sxy * _sxy / _sxx) / _n, 0.0D))") * F.lit(half))
        .select(*keys, "ds", F.col("y").alias("observed"), F.expr("_fit - _spread").alias("lower"),
                F.expr("_fit + _spread").alias("upper"))
        .where("observed < lower or observed > upper")
    )


def _solved(size: int) -> list[list[tuple[str, str]]]:
    """SQL of a Cholesky solution of the normal equations in a row, step by step: columns ``g_i_j``, ``v_i`` to ``b_i``.

    A column that the ones before it explain but for rounding gets a pivot so large that its coefficient is 0.
    """
    steps = []
    for j in range(size):
        below = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        steps.append([(f"l_{j}_{j}", f"if(g_{j}_{j}{below} > {SINGULAR} * g_{j}_{j}, sqrt(g_{j}_{j}{below}), 1e150D)")])
        steps.append([
            (f"l_{i}_{j}", f"(g_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j}") for i in range(j + 1, size)
        ] + [(f"z_{j}", f"(v_{j}" + "".join(f" - l_{j}_{k} * z_{k}" for k in range(j)) + f") / l_{j}_{j}")])
    for j in reversed(range(size)):
        steps.append([(f"b_{j}", f"(z_{j}" + "".join(f" - l_{i}_{j} * b_{i}" for i in range(j + 1, size)) + f") / l_{j}_{j}")])
    return steps


def seasonal_outliers(
    points: DataFrame, period_days: float = 7.0, harmonics: int = 2, width: float = BAND_WIDTH, keys: Sequence[str] = ("uri",),
) -> DataFrame:
    """Points outside the band of a trend and a season: ``keys, ds, observed, lower, upper``.

    Least squares on a constant, a trend and ``harmonics`` sines and cosines of the period. Per series the products of these columns are
    summed (one aggregate with partial sums, whatever the series' length) and the equations solved inside the one row
    that comes out. Times and values are taken from the series' first time and mean, so the sums stay small. Series with fewer
    than twice as many points as columns have no band.
    """
    half = NormalDist().inv_cdf((1 + width) / 2)
    x = F.unix_micros(F.col("ds").cast("timestamp")) / 86_400_000_000
    rows = with_group_stats(points.where("y is not null").withColumn("_x", x), keys, [F.count("y").alias("_n"), F.min("_x").alias("_from"), F.avg("y").alias("_mean")])
    angle = 2 * math.pi / period_days
    waves = [f(F.col("_t") * (angle * k)) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    columns = [F.lit(1.0), F.col("_t"), *waves]
    size = len(columns)
    rows = rows.where(F.col("_n") >= 2 * size).withColumn("_t", F.col("_x") - F.col("_from"))
    rows = rows.select(*points.columns, "_mean", "_n", (F.col("y") - F.col("_mean")).alias("_y"), *[c.alias(f"f_{i}") for i, c in enumerate(columns)])
    sums = [F.sum(F.col(f"f_{i}") * F.col(f"f_{j}")).alias(f"g_{i}_{j}") for i in range(size) for j in range(i + 1)]
    sums += [F.sum(F.col(f"f_{i}") * F.col("_y")).alias(f"v_{i}") for i in range(size)]
    fits = rows.groupBy(*keys).agg(*sums, F.sum(F.col("_y") * F.col("_y")).alias("_yy"))
    for step in _solved(size):
        fits = fits.selectExpr("*", *[f"{e} as {n}" for n, e in step])
    explained = "".join(f" - z_{j} * z_{j}" for j in range(size))
    fits = fits.select(*keys, *[f"b_{j}" for j in range(size)], F.expr(f"greatest(_yy{explained}, 0.0D)").alias("_rest"))
    fit = F.col("_mean")
    for j in range(size):
        fit = fit + F.col(f"b_{j}") * F.col(f"f_{j}")
    return (
        rows.join(fits, list(keys)).withColumn("_fit", fit).withColumn("_spread", F.sqrt(F.col("_rest") / F.col("_n")) * half)
        .select(*keys, "ds", F.col("y").alias("observed"), F.expr("_fit - _spread").alias("lower"), F.expr("_fit + _spread").alias("upper"))
        .where("observed < lower or observed > upper")
    )


def model_outliers(points: DataFrame, fit: Callable, max_points: int) -> DataFrame:
    """Band outliers by a model of the caller's own.

    ``fit(pandas frame with ds, y)`` returns the frame with ``lower`` and ``upper``.
    A model sees one whole series at a time, so ``points`` must already be cut to
    ``max_points`` per series (``metrics.series``); a longer one is refused.
    """

    def one(frame):
        if len(frame) > max_points:
            raise ValueError(f"series longer than {max_points} points")
        if len(frame) < 2:
            return frame.assign(observed=0.0, lower=0.0, upper=0.0).head(0)[
                ["uri", "ds", "observed", "lower", "upper"]]
        frame = frame.sort_values("ds").reset_index(drop=True)
        band = fit(frame[["ds", "y"]].copy())
        frame["observed"], frame["lower"], frame["upper"] = frame["y"], band["lower"], band["upper"]
        outside = (frame["observed"] < frame["lower"]) | (frame["observed"] > frame["upper"])
        return frame.loc[outside, ["uri", "ds", "observed", "lower", "upper"]]

    schema = "uri string, ds timestamp, observed double, lower double, upper double"
    return points.select("uri", "ds", "y").groupBy("uri").applyInPandas(one, schema)


def detect_outliers(
    points: DataFrame,
    algorithm: str | None = None,
    threshold: float | None = None,
    config: dict | None = None,
    min_outliers: int = 1,
) -> DataFrame:
    """Outliers by a named algorithm; an argument wins over ``config``, then the default."""
    config = config or {}
    algorithm = algorithm or config.get("algorithm", "zindex")
    if threshold is None:
        threshold = config.get("threshold", Z_THRESHOLD)
    if algorithm == "zindex":
        found = zscore_outliers(points, threshold)
    elif algorithm == "band":
        found = band_outliers(points)
    elif algorithm == "seasonal":
        found = seasonal_outliers(points, float(config.get("period_days", 7.0)), int(config.get("harmonics", 2)))
    else:
        raise NotImplementedError(f"unknown outlier algorithm: {algorithm}")
    return reportable_series(found, min_outliers)


def reportable_series(outliers: DataFrame, min_outliers: int = 2) -> DataFrame:
    """Outliers of the series that have at least ``min_outliers`` of them."""
    if min_outliers <= 1:
        return outliers
    frequent = outliers.groupBy("uri").agg(F.count("*").alias("n")).where(F.col("n") >= min_outliers)
    return outliers.join(frequent.select("uri"), ["uri"], "left_semi")


def batch_anomalies(
    history: DataFrame,
    batch_id,
    threshold: float = Z_THRESHOLD,
    min_points: int = 3,
    keys: Sequence[str] = ("org_id", "uri"),
) -> DataFrame:
    """Points of one batch at least ``threshold`` deviations off their full history.

    ``history``: ``keys, batch_id, ts, metric_value``. Statistics cover only the
    series the batch touches; one aggregate over the history, then only the batch's
    points are joined to it.
    """
    rows = history.where("metric_value is not null")
    mine = F.col("batch_id") == F.lit(batch_id)
    stats = (
        rows.groupBy(*keys)
        .agg(*_moments("metric_value"), F.count_if(mine).alias("_new"))
        .where((F.col("_new") > 0) & (F.col("_n") >= min_points) & (F.col("_std") > 0))
        .drop("_new")
    )
    return (
        rows.where(mine).join(stats, list(keys))
        .withColumn("z_score", F.abs((F.col("metric_value") - F.col("_mean")) / F.col("_std")))
        .where(F.col("z_score") >= threshold)
        .select(*history.columns, "z_score", F.lit("zscore").alias("algorithm"))
    )


def moments(points: DataFrame, keys: Sequence[str] = ("org_id", "uri"), value: str = "metric_value") -> DataFrame:
    """``keys, n, mean, m2`` (sum of squared differences from the mean) of the series in ``points``; nulls do not count."""
    return points.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_moments(state: DataFrame, news: DataFrame, keys: Sequence[str] = ("org_id", "uri")) -> DataFrame:
    """Moments of two disjoint sets of points, by the pairwise update; a series may be in one of them only."""
    both = state.alias("s").join(news.alias("b"), list(keys), "full")
    n = F.coalesce(F.col("s.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))
    gap = F.coalesce(F.col("b.mean") - F.col("s.mean"), F.lit(0.0))
    return both.select(
        *keys, n.alias("n"),
        F.when(F.col("b.n").isNull(), F.col("s.mean")).otherwise(F.coalesce(F.col("s.mean") + gap * F.col("b.n") / n, F.col("b.mean"))).alias("mean"),
        (F.coalesce(F.col("s.m2"), F.lit(0.0)) + F.coalesce(F.col("b.m2"), F.lit(0.0))
         + F.coalesce(gap * gap * F.col("s.n") * F.col("b.n") / n, F.lit(0.0))).alias("m2"))


def running_anomalies(
    state: DataFrame, batch: DataFrame, threshold: float = Z_THRESHOLD, min_points: int = 3, keys: Sequence[str] = ("org_id", "uri"),
) -> DataFrame:
    """The anomalies of ``batch_anomalies`` from moments instead of the history.

    ``state``: moments of all points, the batch's own included (``merge_moments``). Only the batch and the one row per
    series that it touches are read.
    """
    rows = batch.where("metric_value is not null")
    known = state.where(F.col("n") >= min_points).select(*keys, F.col("mean").alias("_mean"), F.sqrt(F.col("m2") / F.col("n")).alias("_std"))
    return (
        rows.join(known, list(keys)).where("_std > 0")
        .withColumn("z_score", F.abs((F.col("metric_value") - F.col("_mean")) / F.col("_std")))
        .where(F.col("z_score") >= threshold)
        .select(*batch.columns, "z_score", F.lit("zscore").alias("algorithm"))
    )


def anomaly_records(found: DataFrame, created_at) -> DataFrame:
    """Batch anomalies as stored rows, open until somebody acknowledges them.

    ``found`` also has ``metric_name`` and ``table_uri``; a series without a table
    stands for itself.
    """
    return found.select(
        F.sha2(F.concat_ws("|", "org_id", "uri", F.col("ts").cast("string"), F.col("batch_id").cast("string")), 256).alias("anomaly_id"),
        "org_id", "batch_id",
        F.col("uri").alias("metric_uri"), "metric_name", F.coalesce("table_uri", "uri").alias("table_uri"),
        F.col("ts").alias("anomaly_ts"), F.col("metric_value").alias("observed_value"), "z_score", "algorithm",
        F.lit(False).alias("is_acknowledged"), F.lit(False).alias("alert_sent"), created_at.alias("created_at"),
    )

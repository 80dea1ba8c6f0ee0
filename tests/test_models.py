"""The grouped models: planted structure, repeatability, agreement with direct sums."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import anomaly, decompose, extremes, forecast, grouped, isolation
from tests.conftest import rows

SCHEMA = "station_id string, obs_date date, tmax double, tmin double, prcp double"


def frame(spark, tmax, tmin=None, prcp=None, start=dt.date(2018, 1, 1), station="S"):
    n = len(tmax)
    columns = [tmax, np.arange(n) * 0.0 if tmin is None else tmin, np.arange(n) * 0.0 if prcp is None else prcp]
    data = [(station, start + dt.timedelta(days=i), *[None if np.isnan(c[i]) else float(c[i]) for c in columns]) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def direct_loess(y, q, rw):
    """The textbook local line, one point at a time."""
    n, out = len(y), np.empty(len(y))
    for x in range(n):
        left = 0 if q >= n else int(np.clip(x - (q - 1) // 2, 0, n - q))
        right = n - 1 if q >= n else left + q - 1
        reach = max(x - left, right - x) + (max(0, q - n) // 2)
        j = np.arange(left, right + 1)
        w = np.where(np.abs(j - x) <= 0.999 * reach, (1 - (np.abs(j - x) / reach) ** 3) ** 3, 0) * rw[left:right + 1]
        slope, intercept = np.polyfit(j - x, y[left:right + 1], 1, w=np.sqrt(w))
        out[x] = intercept
    return out


@pytest.mark.parametrize("n, q", [(60, 15), (40, 41), (40, 81)])
def test_loess_matches_direct_fit(n, q):
    rng = np.random.default_rng(n + q)
    y, rw = rng.normal(size=n).cumsum(), rng.uniform(0.2, 1, size=n)
    assert np.allclose(decompose._loess(y, q, rw), direct_loess(y, q, rw), atol=1e-8)


def test_stl_parts_add_up_and_recover_the_season(spark):
    t = np.arange(140)
    season = 5 * np.sin(2 * np.pi * t / 7)
    df = frame(spark, 0.1 * t + season, tmin=np.full(140, 3.0))
    out = decompose.stl(df, period=7, seasonal=35, trend=15, min_rows=100).orderBy("obs_date").toPandas()
    assert np.allclose(out.tmax_trend + out.tmax_seasonal + out.tmax_residual, out.tmax)
    assert np.abs(out.tmax_seasonal - season).max() < 0.3
    assert out.tmin_trend.isna().all()
    short = decompose.stl(df, period=7, seasonal=35, trend=15, min_rows=1000)
    assert short.where("tmax_trend IS NOT NULL").count() == 0


def test_stl_resists_outliers():
    t = np.arange(210)
    y = 10 + 3 * np.sin(2 * np.pi * t / 7)
    y[100] += 60
    level, _, rest = decompose.seasonal_trend(y, 7, 35, 15, True)
    assert rest[100] > 50 and np.abs(level[80:130] - 10).max() < 1


@pytest.mark.parametrize("trend", [15, 301])
def test_series_decomposed_together_are_as_alone(trend):
    rng = np.random.default_rng(trend)
    series = [rng.normal(size=n).cumsum() for n in (150, 163, 150, 200, 331)]
    series[1][40] += 80
    for y, found in zip(series, decompose.seasonal_trends(series, 7, 35, trend, True)):
        assert np.allclose(found, decompose.seasonal_trend(y, 7, 35, trend, True), atol=1e-9)
        assert np.allclose(sum(found), y)


def test_whole_groups_are_never_cut(spark):
    data = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("station_id"), "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        def count(pdf):
            sizes = np.diff(np.r_[grouped.group_starts(pdf["station_id"]), len(pdf)])
            return pdf.assign(rows=np.repeat(sizes, sizes), together=len(sizes))

        out = grouped.whole_groups(data.repartition(2, "station_id"), ["station_id"], "id", count, "station_id string, id long, rows long, together long")
        sizes = {r.station_id: (r.n, r["min(rows)"], r["max(rows)"]) for r in out.groupBy("station_id").agg(
            F.count("*").alias("n"), F.min("rows"), F.max("rows")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(sizes) == 7 and all(n == low == high for n, low, high in sizes.values())


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    x[:3], x[20:25], x[50:95], x[-40:] = np.nan, np.nan, np.nan, np.nan
    out = decompose.interpolate(frame(spark, x), ["tmax"]).orderBy("obs_date").toPandas()
    expected = pd.Series(x).interpolate(method="linear", limit=30).bfill().ffill()
    assert np.allclose(out.tmax, expected)


def test_classical_parts_add_up(spark):
    t = np.arange(105)
    df = frame(spark, 0.5 * t + np.tile([0, 1, 2, 3, -1, -2, -3], 15))
    out = decompose.classical(df, "tmax", 7).where("trend IS NOT NULL").toPandas()
    assert len(out) == 99 and np.abs(out.residual).max() < 1e-9
    with pytest.raises(ValueError):
        decompose.classical(df, "tmax", 8)


def features_frame(spark, n=400, extreme=5, partitions=3):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 5))
    x[-extreme:] += 8
    data = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, "abcd", *map(float, x[i])) for i in range(n)]
    columns = anomaly.FEATURES[:5]
    return spark.createDataFrame(data, "station_id string, obs_date date, latitude double, longitude double, "
                                 "geohash_prefix string, " + ", ".join(f"{c} double" for c in columns)).repartition(partitions)


def test_forest_ranks_planted_outliers_first(spark):
    scored = isolation.model_scores(features_frame(spark), trees=100)
    top = [r.obs_date for r in scored.orderBy(F.col("iforest_score").desc()).limit(5).collect()]
    assert set(top) == {dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(395, 400)}
    again = isolation.model_scores(features_frame(spark, partitions=7), trees=100)
    pick = ["obs_date", "iforest_score", "seq_score"]
    assert rows(scored.select(pick)) == rows(again.select(pick))
    assert isolation.model_scores(features_frame(spark, n=100), trees=10).count() == 0


def test_stations_scored_together_are_as_alone(spark):
    days = features_frame(spark)
    several = days.withColumn("station_id", F.lit("T")).unionByName(days).unionByName(
        days.where("obs_date < '2020-06-01'").withColumn("station_id", F.lit("short")))
    scored = isolation.model_scores(several, trees=20)
    assert "FlatMapGroups" not in scored._jdf.queryExecution().executedPlan().toString()  # no call for each station
    pick = ["station_id", "obs_date", "iforest_score", "seq_score", "scored_by"]
    alone = [isolation.model_scores(several.where(F.col("station_id") == s), trees=20).select(pick) for s in ("S", "T")]
    assert rows(scored.select(pick)) == rows(alone[0].unionByName(alone[1])) and scored.count() == 800


def test_forest_ranges_skip_features_without_spread():
    x = np.array([[1.0, 5.0], [1.0, 7.0], [2.0, 3.0], [2.0, 3.0]])
    draw = np.array([[0.9, 0.1], [0.9, 0.1]])
    pick, low, high = isolation._ranges(x.ravel(), 2, np.arange(4), np.array([0, 2]), np.array([2, 2]), draw)
    assert (pick[0], low[0], high[0]) == (1, 5.0, 7.0) and low[1] == high[1]


def test_sequence_score_peaks_at_the_broken_pattern():
    t = np.arange(400)
    x = np.stack([np.sin(t / 5), np.cos(t / 5), np.sin(t / 9)], axis=1)
    x[300:304] += 6
    score = isolation.reconstruction_scores(x)
    assert 300 <= int(np.argmax(score)) < 335 and len(set(score[:30])) == 1
    assert not isolation.reconstruction_scores(x[:60]).any()


def test_detect_end_to_end(spark):
    out = isolation.detect(features_frame(spark), trees=100).toPandas()
    assert list(out.columns) == anomaly.OUTPUT
    assert out.severity.between(0.1, 1.0).all() and len(out) >= 8
    assert out.sort_values("severity").obs_date.iloc[-1] >= dt.date(2021, 1, 30)


def test_ensemble_score_matches_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.gamma(2, size=300), rng.gamma(1, size=300)
    df = spark.createDataFrame([("S", i, float(a[i]), float(b[i])) for i in range(300)],
                               "station_id string, i int, iforest_score double, seq_score double")
    out = anomaly.ensemble_score(df).orderBy("i").toPandas()
    mixed = 0.6 * (a - a.min()) / np.ptp(a) + 0.4 * (b - b.min()) / np.ptp(b)
    tail = np.quantile(mixed[mixed > 0], 0.95)
    raw = mixed * np.where(mixed > tail, 1 + np.log1p(mixed / tail), 1)
    assert np.allclose(out.raw_score, raw)
    assert (out.is_anomaly == ((raw >= np.percentile(raw, 98)) | (a > np.quantile(a, 0.98)))).all()


@pytest.mark.parametrize("model", [forecast.harmonic, forecast.arx])
def test_weekly_models_beat_the_seasonal_guess(spark, model):
    rng = np.random.default_rng(4)
    t = np.arange(6 * 365)
    y = 10 + 12 * np.sin(2 * np.pi * t / 365.25) + 0.002 * t + rng.normal(scale=2, size=len(t))
    df = frame(spark, y, tmin=y - 8 + rng.normal(size=len(t)), prcp=rng.gamma(1, size=len(t)))
    out = model(df).toPandas()
    tmax = out[out.variable == "tmax"].sort_values("forecast_date")
    assert len(tmax) == 52 and (tmax.lower_bound < tmax.upper_bound).all()
    ahead = np.array([(d - dt.date(2018, 1, 1)).days for d in tmax.forecast_date])
    truth = 10 + 12 * np.sin(2 * np.pi * (ahead - 3) / 365.25) + 0.002 * ahead
    assert np.abs(tmax.predicted_value - truth).mean() < (1.5 if model is forecast.harmonic else 6)
    assert (out[out.variable == "prcp"].predicted_value >= 0).all()
    assert set(out.model_type) == {model.__name__}


def test_registry_keeps_the_newest(spark):
    df = spark.createDataFrame([("m", "S", "tmax", "1.0", 0.5, dt.date(2024, 1, 1)), ("m", "S", "tmax", "1.1", 0.4, dt.date(2024, 2, 1))],
                               "model_name string, station_id string, variable string, version string, mae double, trained_at date")
    out = forecast.active_models(df).collect()
    assert len(out) == 1 and out[0].version == "1.1" and out[0].is_active


def test_series_fitted_together_are_as_alone(spark):
    """Extremes of different numbers of years and forecasts of different stations share calls."""
    rng = np.random.default_rng(6)
    values = pd.Series([np.sort(rng.gumbel(size=n)) * 3 + 20 for n in (7, 9, 7, 12, 7)])
    starts = [pd.Series([0.1] * 5), pd.Series([float(np.mean(x)) for x in values]), pd.Series([float(np.std(x)) for x in values])]
    together = extremes._refine(values, *starts)
    for i in range(5):
        alone = extremes._refine(values[i:i + 1], *[c[i:i + 1] for c in starts])
        assert np.allclose(alone.iloc[0], together.iloc[i])
    t = np.arange(500)
    days = [frame(spark, 10 + np.sin(t / 58) + k, prcp=np.abs(np.sin(t / 9)) * k, station=f"S{k}") for k in (1, 2, 3)]
    several = days[0].unionByName(days[1]).unionByName(days[2])
    for model in (forecast.arx, forecast.harmonic):
        out = model(several, min_rows=400)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no call for each series
        assert rows(out) == sorted((r for d in days for r in rows(model(d, min_rows=400))),
                                   key=lambda r: tuple((x is None, str(x)) for x in r))


def test_arx_gaps_fill_as_in_pandas():
    rng = np.random.default_rng(9)
    x = rng.normal(size=60)
    x[:4], x[20:31], x[-3:] = np.nan, np.nan, np.nan
    assert np.array_equal(forecast._filled(x), pd.Series(x).ffill().bfill())
    assert np.isnan(forecast._filled(np.full(3, np.nan))).all()

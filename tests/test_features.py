"""Look-back statistics by events, reloads with commit, residuals beside features, map pruning."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from skyframe.operators import decompose, isolation, joins, lookback, rolling
from skyframe.sources.lake import Lake
from skyframe.sources.reload import Serving

DAILY = "station_id string, obs_date date, tmax double, tmin double, prcp double"
ALL = {5: {"tmax": ["mean", "std", "min", "max", "sum"], "prcp": ["max"]}, 40: {"tmin": ["std", "min"], "tmax": ["sum"]}}


def series(stations=3, days=300, seed=1, gaps=0.3):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    return [(f"S{s}", dt.date(1999, 12, 1) + dt.timedelta(days=d), maybe(rng.gauss(15, 8)), maybe(7.25), maybe(rng.choice([0.0, 0.0, 3.5])))
            for s in range(stations) for d in range(days) if rng.random() > gaps]


@pytest.mark.parametrize("specs", [ALL, rolling.DEFAULT_SPECS])
def test_lookback_equals_frames(spark, specs):
    days = series() + [("one", dt.date(2020, 1, 1), 3.0, None, None), ("none", dt.date(2020, 1, 1), None, None, None)]
    daily = spark.createDataFrame(days, DAILY).withColumn("other", F.lit("kept"))
    daily = daily.unionByName(daily.where("station_id = 'S1' AND day(obs_date) = 3"))  # repeated days
    got, want = lookback.rolling(daily, specs), rolling.rolling(daily, specs)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: (r.station_id, r.obs_date, str(r.tmax))
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        for c in want.columns:
            x, y = a[c], b[c]
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (c, a, b)


def test_lookback_keeps_constant_series_flat(spark):
    daily = spark.createDataFrame([("S", dt.date(2000, 1, 1) + dt.timedelta(days=d), 1000.1 if d < 900 else -40.0, None, None) for d in range(1000)], DAILY)
    out = lookback.rolling(daily, {30: {"tmax": ["std"]}}).where("obs_date < '2002-06-01'")
    assert {r[0] for r in out.where("obs_date > '2000-01-01'").select("tmax_rolling_30d_std").collect()} == {0.0}


def test_lookback_is_one_shuffle_and_does_not_grow_with_the_range(spark):
    daily = spark.range(30_000).select((F.col("id") % 1).cast("string").alias("station_id"), F.expr("date_add(DATE '1900-01-01', CAST(id AS INT))").alias("obs_date"),
                                       F.rand(3).alias("tmax"))
    plan = lookback.rolling(daily, {365: {"tmax": ["mean", "std", "min"]}})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

    def seconds(form):
        started = time.time()
        form(daily, {3650: {"tmax": ["mean", "std", "min"]}}).write.format("noop").mode("overwrite").save()
        return time.time() - started
    seconds(lookback.rolling)
    assert seconds(lookback.rolling) < seconds(rolling.rolling)


def summary(spark, rows):
    return spark.createDataFrame([(2000 + i, 1, i, 0, 0, i, 0.5, "FR", 0.25) for i in range(rows)], (
        "year int, month int, total_anomalies long, heatwave_count long, cold_snap_count long, precip_extreme_count long, "
        "avg_severity double, top_region string, global_temp_anomaly double"))


def test_reload_replaces_all_or_nothing(spark, tmp_path):
    serving = Serving(spark, str(tmp_path))
    with pytest.raises(ValueError):
        serving.read("monthly_summary")
    assert serving.reload(summary(spark, 3), "monthly_summary", "a")
    before = serving.read("monthly_summary")
    assert serving.reload(summary(spark, 5), "monthly_summary", "b")
    assert serving.read("monthly_summary").count() == 5
    assert before.count() == 3  # a reader that began before goes on with what it saw
    assert not serving.reload(summary(spark, 9), "monthly_summary", "b")  # a replay changes nothing
    assert serving.read("monthly_summary").count() == 5
    failing = summary(spark, 4).withColumn("year", F.when(F.col("year") == 2002, F.raise_error(F.lit("lost"))).otherwise(F.col("year")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        serving.reload(failing, "monthly_summary", "c")
    assert serving.read("monthly_summary").count() == 5 and serving.manifest("monthly_summary")["batches"] == ["a", "b"]
    assert serving.reload(summary(spark, 4), "monthly_summary", "c") and serving.read("monthly_summary").count() == 4
    assert not (tmp_path / "monthly_summary" / "g-a").exists()


def test_generations_are_packed(spark, tmp_path):
    serving = Serving(spark, str(tmp_path))
    assert serving.reload(summary(spark, 5), "monthly_summary", "a")
    files = [f.name for f in (tmp_path / "monthly_summary" / "g-a").glob("*.parquet")]
    assert files and all(name.endswith(".zstd.parquet") for name in files)
    assert serving.read("monthly_summary").count() == 5


def stations_with_jump(spark):
    """A series whose jump shows in the residual alone: the features around it stay the same."""
    start, rng = dt.date(2015, 1, 1), random.Random(5)
    rows = []
    for d in range(800):
        wave = 10 * math.sin(2 * math.pi * d / 30)
        rows.append(("S", start + dt.timedelta(days=d), wave + rng.gauss(0, 1), wave - 5 + rng.gauss(0, 1), abs(rng.gauss(0, 2))))
    daily = spark.createDataFrame(rows, DAILY).withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0), "geohash_prefix": F.lit("s0")})
    return rolling.features(daily), decompose.stl(daily, period=30, seasonal=13, trend=61, min_rows=200)


def test_residuals_take_part_in_anomalies(spark, tmp_path):
    features, components = stations_with_jump(spark)
    lake = Lake(spark, str(tmp_path))
    features = lake.bucketed(features, "features", "rolling", ["station_id"], ["obs_date"], 3)
    components = lake.bucketed(components, "features", "components", ["station_id"], ["obs_date"], 3)
    joined = joins.with_residuals(features, components, ["tmax", "tmin", "prcp"])
    assert joined.count() == 800
    row = joined.agg(*[F.countDistinct(f"{v}_residual").alias(v) for v in ("tmax", "tmin", "prcp")]).first()
    assert min(row) > 700  # all three vary

    def scores(df):
        return {r.obs_date: r.iforest_score for r in isolation.model_scores(df, trees=100).select("obs_date", "iforest_score").collect()}
    with_them, day = scores(joined), dt.date(2016, 6, 1)
    without = scores(joined.drop("tmax_residual", "tmin_residual", "prcp_residual"))
    assert without.keys() == with_them.keys() and without != with_them
    # a jump in the residual alone moves its row up, past most others
    moved = scores(joined.withColumn("tmax_residual", F.when(F.col("obs_date") == "2016-06-01", 60.0).otherwise(F.col("tmax_residual"))))
    rank = lambda found: sum(s > found[day] for s in found.values())
    assert moved[day] > with_them[day] and rank(moved) < min(rank(with_them), 80)


def test_features_meet_residuals_without_a_shuffle(spark, tmp_path):
    features, components = stations_with_jump(spark)
    lake = Lake(spark, str(tmp_path))
    left = lake.bucketed(features, "features", "rolling", ["station_id"], ["obs_date"], 4)
    right = lake.bucketed(components, "features", "components", ["station_id"], ["obs_date"], 4)
    joined = joins.with_residuals(left.hint("merge"), right, ["tmax", "tmin", "prcp"])
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert lake.bucketed(features.limit(10), "features", "rolling", ["station_id"], ["obs_date"], 4).count() == 10  # replaced
    lake.forget("features", "rolling")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("features_rolling")]

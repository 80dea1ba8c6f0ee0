"""One station holding a third of all raw records: what reaches a single task."""

import datetime as dt

from pyspark.sql import functions as F

from skyframe.operators import anomaly, daily, joins, rolling
from tests.conftest import rows


def hot_long(spark, n=60000):
    """A third of the records belong to one station, many per day and element."""
    day = F.expr("date_format(date_add(DATE '2020-01-01', cast(id % 700 as int)), 'yyyyMMdd')")
    return spark.range(n).select(
        F.expr("if(id % 3 = 0, 'HOT', concat('S', id % 90))").alias("station_id"), day.alias("obs_date"),
        F.expr("element_at(array('TMAX', 'TMIN', 'PRCP'), cast(id % 7 % 3 + 1 as int))").alias("element"),
        (F.col("id") % 311).cast("double").alias("value"), F.lit(None).cast("string").alias("q_flag"))


def test_daily_form_bounds_a_hot_station_by_the_calendar(spark):
    wide = daily.pivot_elements(daily.clean_long(hot_long(spark)))
    assert wide.where("station_id = 'HOT'").count() <= 700
    text = wide._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_max") > text.index("Exchange")  # combined below the exchange


def test_blocks_split_a_hot_series(spark):
    wide = daily.pivot_elements(daily.clean_long(hot_long(spark))).select("station_id", "obs_date", "tmax", "tmin", "prcp")
    specs = {30: {"tmax": ["mean", "max"], "prcp": ["sum"]}}
    whole, split = rolling.rolling(wide, specs), rolling.rolling(wide, specs, block_days=60)
    assert rows(split) == rows(whole)


def test_hot_subscriptions_and_anomalies(spark):
    found = spark.range(900).select(F.expr("if(id % 3 = 0, 'HOT', concat('S', id % 50))").alias("station_id"),
                                    F.expr("element_at(array('heatwave', 'cold_snap', 'precip_extreme'), cast(id % 3 + 1 as int))")
                                    .alias("anomaly_type"), (F.col("id") % 10 / 10).alias("severity"), "id")
    wanted = spark.range(60).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"),
                                    F.expr("if(id % 3 = 0, 'HOT', concat('S', id % 50))").alias("station_id"),
                                    F.expr("if(id % 2 = 0, 'any', 'heatwave')").alias("alert_type"),
                                    (F.col("id") % 10 / 10).alias("min_severity"))
    out = anomaly.match_subscriptions(found, wanted).select("id", "subscription_id")
    left = [tuple(r) for r in found.collect()]
    right = [tuple(r) for r in wanted.collect()]
    expected = sorted((i, a) for s, t, v, i in left for a, s2, k, m in right if s == s2 and k in ("any", t) and v >= m)
    assert sorted(map(tuple, out.collect())) == expected


def test_unify_without_broadcast_equals_broadcast(spark, monkeypatch):
    obs = spark.createDataFrame([(f"S{i % 4}", dt.date(2020, 1 + i % 12, 1 + i % 28), 20.0 + i, 10.0, None, 1.0, None, None)
                                 for i in range(300)], "station_id string, obs_date date, tmax double, tmin double, tavg double, "
                                                       "prcp double, snow double, snwd double")
    places = daily.with_geohash(spark.createDataFrame(
        [(f"S{i}", f"n{i}", 10.0 * (i % 2), 5.0, 1.0, "US") for i in range(4)],
        "station_id string, name string, latitude double, longitude double, elevation double, country string"), 7, 4)
    grid = daily.convert_grid(spark.createDataFrame(
        [(10.0 * (i % 2), 5.0, f"2020-{1 + i % 12:02d}-10", 280.0 + i, 0.001, 101000.0, 1.0, 1.0) for i in range(48)],
        "latitude double, longitude double, time string, t2m double, tp double, sp double, u10 double, v10 double"))
    plain = rows(joins.unify(obs, places, grid))
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("left", 0))
    monkeypatch.setattr(joins.with_grid, "__defaults__", (0,))
    shuffled = rows(joins.unify(obs, places, grid))
    assert shuffled == plain and len(plain) == 300


def test_equal_rows_of_a_hot_key_reach_many_tasks(spark):
    left = spark.range(6000).selectExpr("if(id % 2 = 0, 0L, id) AS k", "1 AS v")
    right = spark.range(6000).selectExpr("id AS k", "id AS w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.skew_join(left, right, ["k"], "inner", tasks=16)
        sizes = [r["count"] for r in out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and len(sizes) > 1 and max(sizes) < 2000
    assert text.count("Range (0, 6000") == 2 - 1  # the left side is read from its stored form

"""Known answers on small fixtures."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import geo, scores, units
from skyframe.operators import (anomaly, daily, extremes, forecast, islands, joins, project, rolling, trends)
from skyframe.plans import serve
from tests.conftest import rows

START = dt.date(2020, 1, 1)


def days(n, start=START):
    return [start + dt.timedelta(days=i) for i in range(n)]


def drift(spark, n=60):
    data = [("A", d, 20 + 0.1 * i) for i, d in enumerate(days(n))] + [("B", d, 30 - 0.1 * i) for i, d in enumerate(days(n))]
    return spark.createDataFrame(data, "station_id string, obs_date date, tmax double")


def month_shape(spark, n=90):
    data = [("STATION_A", d, 20 + 10 * (i % 30) / 30, 10 + 5 * (i % 30) / 30, max(0.0, 5.0 - abs(15 - i % 30)))
            for i, d in enumerate(days(n))]
    return spark.createDataFrame(data, "station_id string, obs_date date, tmax double, tmin double, prcp double")


def test_rolling_ranges(spark):
    out = rolling.features(month_shape(spark)).orderBy("obs_date").collect()
    assert len(out) == 90
    for r in out[30:]:
        assert 20 <= r.tmax_rolling_30d_mean <= 30 and r.tmax_rolling_30d_std > 0 and abs(r.tmax_zscore_30d) < 10
    window = [20 + 10 * (i % 30) / 30 for i in range(45 - 30, 46)]
    assert out[45].tmax_rolling_30d_mean == pytest.approx(np.mean(window))
    assert out[45].tmax_rolling_30d_std == pytest.approx(np.std(window, ddof=1))


def test_rolling_keeps_stations_apart(spark):
    out = rolling.rolling(drift(spark), {30: {"tmax": ["mean"]}}).orderBy("station_id", "obs_date").collect()
    a = [r.tmax_rolling_30d_mean for r in out if r.station_id == "A"]
    assert len(a) == 60 and len(out) == 120 and a[-1] > a[0]


def test_rolling_blocks_and_layout_do_not_matter(spark):
    random.seed(1)
    picked = [d for d in days(900) if random.random() < 0.6]
    df = spark.createDataFrame([("S", d, float(i % 37), float(i % 11), float(i % 5)) for i, d in enumerate(picked)],
                               "station_id string, obs_date date, tmax double, tmin double, prcp double")
    plain = rows(rolling.rolling(df))
    assert plain == rows(rolling.rolling(df.repartition(7), block_days=365))
    with pytest.raises(ValueError):
        rolling.rolling(df, block_days=100)


def test_classify_known_rows(spark):
    hot = [(f"S{i}", 4.0 if i >= 90 else 0.3, -0.1 if i >= 90 else 0.2, 0.1) for i in range(100)]
    df = spark.createDataFrame(hot, "id string, h double, m double, p double")
    kinds = df.select(scores.classify_extreme(F.col("h"), F.col("m"), F.col("p"), 2.5, -2.5, 3.0).alias("k")).collect()
    assert [r.k for r in kinds].count("heatwave") == 10 and [r.k for r in kinds].count(None) == 90


@pytest.mark.parametrize("z, expected", [((2.1, 0, 0, 0), "heatwave"), ((0, 0, 0, 2.1), "heatwave"),
                                         ((0, -2.1, 0, 0), "cold_snap"), ((-2.1, 0, 3, 0), "cold_snap"),
                                         ((0, 0, 2.1, 0), "precip_extreme"), ((1.6, 0, 0, 0), "heatwave"),
                                         ((0, -1.6, 0, 0), "cold_snap"), ((0.5, 0, -1.0, 0), "precip_extreme"),
                                         ((None, None, None, None), "heatwave")])
def test_six_branches(spark, z, expected):
    numbers = tuple(None if x is None else float(x) for x in z)
    df = spark.createDataFrame([numbers], "h double, m double, p double, c double")
    assert df.select(scores.classify(*[F.col(c) for c in "hmpc"])).first()[0] == expected


def test_ties_do_not_depend_on_rounding(spark):
    """Three equal days and another score 1.5 exactly, two days 0.7071 in every variable; sums in another order miss that in the last bits."""
    up, down = math.nextafter(1.5, 2), math.nextafter(1.5, 1)
    columns = "tmax_zscore_30d double, tmin_zscore_30d double, prcp_zscore_30d double, tmax_climatology_deviation double"
    flagged = anomaly.threshold_score(spark.createDataFrame([(z, 0.0, 0.0, 0.0) for z in (up, 1.5, down, 1.4999)], columns), 1.5)
    assert [r.is_anomaly for r in flagged.collect()] == [True, True, True, False]
    half = 0.5 ** 0.5
    tied = spark.createDataFrame([(half, half, p, 1.6) for p in (math.nextafter(half, 1), half, math.nextafter(half, 0), half + 1e-6)], columns)
    assert [r.k for r in tied.select(scores.classify(*[F.col(c) for c in tied.columns]).alias("k")).collect()] == [
        "heatwave", "heatwave", "heatwave", "precip_extreme"]
    strict = spark.createDataFrame([(z, -z, z) for z in (up, 1.5, 1.5001)], "h double, m double, p double")
    assert [r.k for r in strict.select(scores.classify_extreme(F.col("h"), F.col("m"), F.col("p"), 1.5, -1.5, 1.5).alias("k")).collect()] == [
        None, None, "heatwave"]


def test_severity(spark):
    df = spark.createDataFrame([(3.0,), (5.0,), (8.0,), (-20.0,)], "z double")
    assert [r[0] for r in df.select(scores.severity(F.col("z"), 10.0)).collect()] == pytest.approx([0.3, 0.5, 0.8, 1.0])


def test_tiles(spark):
    data = [("dr5r", 2020, 7, "heatwave", 0.8, 40.7, -74.0), ("dr5r", 2020, 7, "heatwave", 0.9, 40.8, -73.9),
            ("dr5r", 2020, 7, "cold_snap", 0.6, 40.7, -74.0), ("u33d", 2020, 7, "heatwave", 0.7, 48.8, 2.3)]
    df = spark.createDataFrame(data, "geohash_prefix string, year int, month int, anomaly_type string, severity double, "
                                     "latitude double, longitude double")
    out = {r.geohash_prefix: r for r in anomaly.tiles(df).collect()}
    assert len(out) == 2 and out["u33d"].anomaly_count == 1
    assert (out["dr5r"].anomaly_count, out["dr5r"].heatwave_count, out["dr5r"].cold_snap_count) == (3, 2, 1)
    assert out["dr5r"].dominant_type == "heatwave"


def brute_geohash(lat, lon, precision):
    low, high = [-90.0, -180.0], [90.0, 180.0]
    text, bits, value = "", 0, 0
    while len(text) < precision:
        axis, x = (1, lon) if (bits + 5 * len(text)) % 2 == 0 else (0, lat)
        middle = (low[axis] + high[axis]) / 2
        value *= 2
        if x >= middle:
            value, low[axis] = value + 1, middle
        else:
            high[axis] = middle
        bits += 1
        if bits == 5:
            text, bits, value = text + geo.ALPHABET[value], 0, 0
    return text


def test_geohash(spark):
    random.seed(3)
    points = [(57.64911, 10.40744), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0)]
    points += [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(300)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(points)], "lat double, lon double, i int")
    for precision in (4, 5, 7):
        out = df.orderBy("i").select(geo.geohash(F.col("lat"), F.col("lon"), precision)).collect()
        assert [r[0] for r in out] == [brute_geohash(*p, precision) for p in points]
    nothing = spark.createDataFrame([(None, 1.0)], "lat double, lon double")
    assert nothing.select(geo.geohash(F.col("lat"), F.col("lon"))).first()[0] is None


def test_geohash_cover_holds_every_point_of_the_box():
    random.seed(4)
    box = geo.Box(10, 20, -30, -5)
    cells = set(geo.cover(box, 3))
    for _ in range(300):
        assert brute_geohash(random.uniform(10, 20), random.uniform(-30, -5), 3) in cells
    wrapped = set(geo.cover(geo.Box(0, 5, 170, 190, wrap=True), 2))
    assert brute_geohash(2, 175, 2) in wrapped and brute_geohash(2, -175, 2) in wrapped


def test_quality_scale_and_pivot(spark):
    data = [("S", "20200101", "TMAX", 251.0, None), ("S", "20200101", "TMAX", 249.0, ""), ("S", "20200101", "PRCP", 12.0, ""),
            ("S", "20200102", "TMIN", -31.0, ""), ("S", "20200102", "TMAX", 999.0, "X"), ("S", "bad", "SNOW", 5.0, "")]
    raw = spark.createDataFrame(data, "station_id string, obs_date string, element string, value double, q_flag string")
    clean = daily.clean_long(raw)
    wide = {r.obs_date: r for r in daily.pivot_elements(clean).collect()}
    assert wide[START].tmax == 25.1 and wide[START].prcp == 1.2 and wide[START].tmin is None
    assert wide[dt.date(2020, 1, 2)].tmin == -3.1 and wide[dt.date(2020, 1, 2)].tmax is None
    assert wide[None].snow == 5.0
    assert [(r.element, r.copies) for r in daily.duplicates(clean).collect()] == [("TMAX", 2)]


def test_grid_join_keeps_row_count(spark):
    obs = spark.createDataFrame([(s, d, "dr5r") for s in "AB" for d in days(60)],
                                "station_id string, obs_date date, geohash_prefix string")
    grid = spark.createDataFrame([("dr5r", d, float(i)) for i, d in enumerate(days(60))],
                                 "geohash_prefix string, obs_date date, t double")
    for limit in (joins.BROADCAST_LIMIT, 0):
        out = joins.with_grid(obs, grid, ["t"], limit)
        assert out.count() == 120
        assert out.where("obs_date = '2020-01-09'").first().t == pytest.approx(15.0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, how):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', if(id % 50 = 0, null, concat('k', id % 400))) AS k", "id AS v")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(0, 400, 2)], (None, 9)],
                                  "k string, w int")
    plan = joins.skew_join(left, right, ["k"], how)
    assert rows(plan.select("k", "v", "w")) == rows(left.join(right, "k", how).select("k", "v", "w"))


def test_skew_join_spreads_the_hot_key(spark):
    left = spark.range(6000).selectExpr("if(id % 3 = 0, 0L, id) AS k", "id AS v")
    right = spark.range(6000).selectExpr("id AS k", "id AS w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = joins.skew_join(left, right, ["k"], "inner", tasks=64)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 6000 and max(sizes) < 2000


def test_optional_source(spark):
    base = spark.createDataFrame([("A", 1)], "k string, v int")
    out = joins.with_optional(base, None, ["k"], {"x": "double"})
    assert out.dtypes[-1] == ("x", "double") and out.first().x is None


def test_islands_by_row_and_by_calendar(spark):
    dates = [START + dt.timedelta(days=i) for i in (0, 1, 3, 4, 5)]  # one day missing inside the first run
    df = spark.createDataFrame([("S", d, z, 30.0 + i) for i, (d, z) in enumerate(zip(dates, (0.0, 3.0, 3.0, 0.0, 3.0)))],
                               "station_id string, obs_date date, z double, tmax double")
    assert [r.duration_days for r in islands.events(df, "z").orderBy("start_date").collect()] == [2, 1]
    assert [r.duration_days for r in islands.events(df, "z", adjacency="calendar").orderBy("start_date").collect()] == [1, 1, 1]
    runs = islands.calendar_runs(df.where("z > 2")).orderBy("obs_date").collect()
    assert [r.duration_days for r in runs] == [1, 1, 1]


def annual_frame(spark, values):
    return spark.createDataFrame([("S", "tmax", 2000 + i, float(v)) for i, v in enumerate(values)],
                                 "station_id string, variable string, year int, value double")


def brute_trend(x):
    n = len(x)
    pairs = [(j, i) for i in range(n) for j in range(i)]
    s = sum(np.sign(x[i] - x[j]) for j, i in pairs)
    slopes = sorted((x[i] - x[j]) / (i - j) for j, i in pairs)
    _, counts = np.unique(x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in counts)) / 18
    z = 0 if s == 0 or var <= 0 else (s - np.sign(s)) / math.sqrt(var)
    half = 1.96 * math.sqrt(len(slopes)) / 2
    low = int(max(0, (len(slopes) - half) / 2))
    high = int(min(len(slopes) - 1, (len(slopes) + half) / 2))
    return s, var, z, math.erfc(abs(z) / math.sqrt(2)), np.median(slopes), slopes[low], slopes[high]


@pytest.mark.parametrize("values", [list(range(1, 13)), [1, 1, 2, 2, 3, 3, 4, 4, 5, 5], [7.0] * 12,
                                    list(np.random.default_rng(5).normal(size=40))])
def test_trend_statistics(spark, values):
    series = trends.annual_arrays(annual_frame(spark, values))
    out = trends.sen(trends.mann_kendall(series)).first()
    s, var, z, p, slope, low, high = brute_trend(np.array(values, dtype=float))
    assert (out.s, out.var_s) == (s, pytest.approx(var))
    assert out.z_statistic == pytest.approx(z) and out.p_value == pytest.approx(p, abs=1e-12)
    assert (out.sens_slope, out.ci_lower, out.ci_upper) == (pytest.approx(slope), pytest.approx(low), pytest.approx(high))


def test_trend_table(spark):
    data = [("S", dt.date(2000 + i, 6, 1), 1.0 + i, 5.0, None) for i in range(12)]
    df = spark.createDataFrame(data, "station_id string, obs_date date, tmax double, tmin double, prcp double")
    out = {r.variable: r for r in trends.trend(df).collect()}
    assert set(out) == {"tmax", "tmin"}
    assert out["tmax"].trend_direction == "increasing" and out["tmax"].tau == 1 and out["tmax"].significant
    assert out["tmin"].trend_direction == "no_trend" and out["tmin"].z_statistic == 0


def test_special_functions(spark):
    zs = [0.0, 0.5, 1.0, 1.959963984540054, 3.0, 6.0, 8.0, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for got, z in zip(df.select(scores.two_sided_p(F.col("z"))).collect(), zs):
        assert got[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-7, abs=1e-15)
    xs = [-0.4, 0.1, 0.5, 0.9, 1.0, 1.5, 2.7, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for got, x in zip(df.select(scores.gamma(F.col("x"))).collect(), xs):
        assert got[0] == pytest.approx(math.gamma(x), rel=1e-12)


def gev_sample(k, location, scale, n, seed=1):
    u = np.random.default_rng(seed).uniform(size=n)
    return location + scale * (1 - (-np.log(u)) ** k) / k


def test_gev_recovers_parameters(spark):
    x = gev_sample(0.1, 30.0, 2.0, 4000)
    blocks = spark.createDataFrame([("S", "tmax", i, float(v)) for i, v in enumerate(x)],
                                   "station_id string, variable string, year int, value double")
    fit = extremes.fit(blocks).first()
    assert fit.shape_param == pytest.approx(0.1, abs=0.04) and fit.location_param == pytest.approx(30, abs=0.15)
    assert fit.scale_param == pytest.approx(2.0, abs=0.1)
    best = extremes.likelihood(blocks).first()

    def cost(row):
        return extremes._negative_log_likelihood(row.shape_param, row.location_param, math.log(row.scale_param), x)

    assert cost(best) <= cost(fit) + 1e-9
    for step in (-0.01, 0.01):
        assert cost(best) <= extremes._negative_log_likelihood(
            best.shape_param + step, best.location_param, math.log(best.scale_param), x)


def test_return_levels_grow_and_swap_for_minima(spark):
    params = spark.createDataFrame([("S", "tmax", 0.1, 30.0, 2.0, 50), ("S", "tmin", 0.0, 10.0, 2.0, 50)],
                                   "station_id string, variable string, shape_param double, location_param double, "
                                   "scale_param double, n_years int")
    out = extremes.return_levels(params).orderBy("variable", "return_period").collect()
    hot, cold = out[:4], out[4:]
    assert [r.return_period for r in hot] == [10, 25, 50, 100]
    assert all(a.return_level < b.return_level for a, b in zip(hot, hot[1:]))
    assert all(a.return_level > b.return_level for a, b in zip(cold, cold[1:]))
    assert all(r.lower_ci < r.return_level < r.upper_ci for r in out)
    assert cold[0].return_level == pytest.approx(-(10 - 2 * math.log(-math.log(0.9))), abs=0.01)


def test_weekly(spark):
    df = spark.createDataFrame([("S", d, float(i), None, None) for i, d in enumerate(days(14, dt.date(2024, 1, 1)))],
                               "station_id string, obs_date date, tmax double, tmin double, prcp double")
    out = daily.weekly(df).orderBy("week_end").collect()
    assert [(r.week_end, r.value) for r in out] == [(dt.date(2024, 1, 7), 3.0), (dt.date(2024, 1, 14), 10.0)]


def forecast_rows(spark, data):
    return spark.createDataFrame(data, "station_id string, forecast_date date, variable string, predicted_value double, "
                                       "lower_bound double, upper_bound double, model_type string, model_version string, "
                                       "mae double, rmse double")


def test_ensemble_weights(spark):
    day, alone = dt.date(2024, 1, 7), dt.date(2024, 1, 14)

    def row(model, d, x):
        return ("S", d, "tmax", x, x, x, model, "1.0", 0.5, 0.6)

    df = forecast_rows(spark, [row("arx", day, 10.0), row("harmonic", day, 20.0), row("statistical", day - dt.timedelta(2), 30.0),
                               row("harmonic", alone, 8.0)])
    out = {r.forecast_date: r for r in forecast.ensemble(df).collect()}
    assert out[day].predicted_value == pytest.approx(17.0) and out[alone].predicted_value == pytest.approx(8.0)
    literal = {r.forecast_date: r for r in forecast.ensemble(df, normalize=False).collect()}
    assert literal[alone].predicted_value == pytest.approx(2.4)
    assert out[day].mae == 0.5


def test_statistical_forecast_of_constant(spark):
    df = spark.createDataFrame([("S", d, 10.0, 10.0, 10.0) for d in days(730, dt.date(2021, 1, 1))],
                               "station_id string, obs_date date, tmax double, tmin double, prcp double")
    out = forecast.statistical(df).where("variable = 'tmax'").orderBy("forecast_date").collect()
    assert len(out) == 53 and all(r.predicted_value == 10.0 for r in out)
    last = max(days(730, dt.date(2021, 1, 1)))
    assert [(r.forecast_date - last).days for r in out] == list(range(1, 366, 7))


def test_projection_known_value(spark):
    df = spark.createDataFrame([("S", d, 45.0, 20.0, 10.0, None) for d in days(400)],
                               "station_id string, obs_date date, latitude double, tmax double, tmin double, prcp double")
    out = project.scenarios(df, years=(2025, 2030)).where("scenario = 'ssp585' AND variable = 'tmax'")
    first = out.where("projection_date = '2030-01-01'").first()
    assert out.count() == 72 and first.predicted_value == pytest.approx(20 + 0.06 * 1.25 * 10, abs=0.006)
    noisy = project.scenarios(df, years=(2025, 2030), noise=0.3)
    assert rows(noisy) == rows(project.scenarios(df.repartition(5), years=(2025, 2030), noise=0.3))


def test_latest_scores_take_last_rows_only(spark):
    df = spark.createDataFrame([("S", d, 1000.0 if i < 50 else float(i % 7)) for i, d in enumerate(days(415))],
                               "station_id string, obs_date date, tmax double")
    out = rolling.latest_scores(df, ["tmax"]).first()
    tail = [float(i % 7) for i in range(50, 415)]
    assert out.days == 365 and out.tmax_mean == pytest.approx(np.mean(tail)) and out.tmax_std == pytest.approx(np.std(tail, ddof=1))


def test_zero_is_a_value(spark):
    df = spark.createDataFrame([("S", d, 0.0 if i == 49 else -10.0 - i % 2, None, None) for i, d in enumerate(days(50))],
                               "station_id string, obs_date date, tmax double, tmin double, prcp double")
    alert = anomaly.recent_alerts(rolling.latest_scores(df, ["tmax", "tmin", "prcp"])).first()
    assert alert.anomaly_type == "heatwave" and alert.temp_deviation == pytest.approx(6.566830627505158)
    assert alert.description == "Live heatwave: 6.6 standard deviations from the station's recent days"


def test_subscriptions(spark):
    found = spark.createDataFrame([("S1", "heatwave", 0.6), ("S1", "cold_snap", 0.9), ("S2", "heatwave", 0.9)],
                                  "station_id string, anomaly_type string, severity double")
    wanted = spark.createDataFrame([("a", "S1", "any", 0.5), ("b", "S1", "heatwave", 0.9), ("c", "S2", "cold_snap", 0.1)],
                                   "id string, station_id string, alert_type string, min_severity double")
    out = anomaly.match_subscriptions(found, wanted).select("subscription_id", "anomaly_type")
    assert rows(out) == [("a", "cold_snap"), ("a", "heatwave")]


def test_read_queries(spark):
    kinds = ["heatwave", "cold_snap", "precip_extreme"]
    found = spark.createDataFrame([(f"a{i}", "ANOM001", dt.date(2020, 7, 10 + i), kinds[i % 3], 0.5 + 0.1 * i, i + 1, 1.0, None, "t")
                                   for i in range(5)], ", ".join(
        f"{c} {t}" for c, t in zip(serve.ANOMALY_COLUMNS, ["string", "string", "date", "string", "double", "int", "double", "double", "string"])))
    places = spark.createDataFrame([("ANOM001", "New_York", 40.7, -74.0, 10.0, "US", "NY", "dr5r", 1990, 2020, 5)],
                                   "id string, name string, latitude double, longitude double, elevation double, country string, "
                                   "state string, geohash string, first_year int, last_year int, record_count int")
    assert serve.get_anomalies(found, places, anomaly_type="heatwave").count() == 2
    assert serve.get_anomalies(found, places, min_severity=0.8).count() == 2
    assert serve.get_anomalies(found, places, box=geo.Box(40, 41, -75, -73)).count() == 5
    assert serve.get_anomalies(found, places, box=geo.Box(0, 1, 0, 1)).count() == 0
    assert [r.id for r in serve.get_anomalies(found, places, limit=2).collect()] == ["a4", "a3"]
    line = serve.geojson(serve.anomalies_on_map(found, places).where("id = 'a0'"), ["id", "anomaly_date", "precip_deviation"]).first()[0]
    assert line == ('{"type":"Feature","geometry":{"type":"Point","coordinates":[-74.0,40.7]},'
                    '"properties":{"id":"a0","anomaly_date":"2020-07-10","precip_deviation":null}}')
    assert serve.list_stations(places, search="w_y").count() == 1 and serve.list_stations(places, search="wxy").count() == 0
    detail = serve.station_details(places, found, "ANOM001").first()
    assert [a["id"] for a in detail.recent_anomalies] == ["a4", "a3", "a2", "a1", "a0"]
    with pytest.raises(ValueError):
        serve.index_series(found, "unknown")


def test_upsert_and_sample(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "id string, v int")
    assert rows(daily.upsert(old, new, "id")) == [("a", 1), ("b", 20), ("c", 30)]
    df = spark.range(20000)
    one = rows(daily.hash_sample(df, ["id"], 0.02))
    assert one == rows(daily.hash_sample(df.repartition(13), ["id"], 0.02)) and 300 < len(one) < 500


def test_wind_and_color(spark):
    df = spark.createDataFrame([(3.0, 4.0), (-1.0, 0.0), (0.0, -2.0)], "u double, v double")
    out = df.select(units.wind_speed(F.col("u"), F.col("v")), units.wind_direction(F.col("u"), F.col("v"))).collect()
    assert [tuple(r) for r in out] == [(5.0, pytest.approx(53.1301, abs=1e-3)), (1.0, 180.0), (2.0, 270.0)]
    colors = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double").select(
        scores.color_bin(F.col("x"), F.lit(0.0), F.lit(10.0))).collect()
    assert [r[0] for r in colors] == [0, 8, 15]


def test_geohash_of_a_missing_coordinate(spark):
    points = spark.createDataFrame([(float("nan"), 1.0), (1.0, None), (float("inf"), 1.0), (57.64911, 10.40744)], "lat double, lon double")
    assert [r[0] for r in points.select(geo.geohash(F.col("lat"), F.col("lon"))).collect()] == [None, None, None, "u4pruyd"]


def test_sample_keeps_small_shares(spark):
    df = spark.range(200000)
    assert 30 < daily.hash_sample(df, ["id"], 0.0003).count() < 95
    assert 99000 < daily.hash_sample(df, ["id"], 0.5).count() < 101000


def test_a_cell_is_one_tile(spark):
    months = spark.createDataFrame([("dr5r", dt.date(2020, 1, 1), 3, 0.5, "heatwave", 3, 0, 0, 40.7, -74.0),
                                    ("dr5r", dt.date(2020, 2, 1), 7, 0.5, "heatwave", 7, 0, 0, 40.699999999999996, -74.1)],
                                   "geohash string, tile_date date, anomaly_count int, avg_severity double, dominant_type string, "
                                   "heatwave_count int, cold_snap_count int, precip_extreme_count int, center_lat double, center_lon double")
    from skyframe.plans import serve

    found = serve.get_tiles(months).collect()
    assert len(found) == 1 and found[0].total_anomalies == 10 and found[0].center_lon == pytest.approx(-74.07)

"""Aggregations, windows, sorts, index series and per-station statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from skyframe import schemas
from skyframe.functions import geo, scores
from skyframe.operators import (anomaly, daily, decompose, extremes, forecast, indices, islands, joins, lookback,
                                project, rolling, trends)
from skyframe.plans import serve
from workload.registry import query
from workload.views import (INDEX_BOXES, MIN_YEARS, SPEC_30, Views, _box_sql, rolling_sql)

ELEMENT_COLUMNS = "tmax tmin tavg prcp snow snwd"

# ---- aggregations --------------------------------------------------------------------

_CLEAN = """
SELECT station_id, CAST(strptime(obs_date, '%Y%m%d') AS DATE) AS obs_date, element,
  CASE WHEN element IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') THEN value / 10 ELSE value END AS value
FROM obs_long WHERE q_flag IS NULL OR q_flag = ''"""


@query("agg_pivot", "SELECT station_id, obs_date, " + ", ".join(
    f"max(value) FILTER (WHERE element = '{e}') AS {e.lower()}" for e in schemas.ELEMENTS)
    + f" FROM ({_CLEAN}) GROUP BY 1, 2", doubles=ELEMENT_COLUMNS, dates="obs_date")
def _(v: Views):
    return daily.pivot_elements(daily.clean_long(v.obs_long))


@query("agg_duplicates", f"""
SELECT station_id, obs_date, element, count(*) AS copies FROM ({_CLEAN}) GROUP BY 1, 2, 3 HAVING count(*) > 1""",
       dates="obs_date")
def _(v):
    return daily.duplicates(daily.clean_long(v.obs_long))


@query("agg_grid_cell", """
SELECT geohash_prefix, obs_date, avg(temp_2m_c) AS temp, avg(precip_mm) AS precip, avg(pressure_hpa) AS pressure,
  avg(wind_speed_ms) AS wind FROM grid GROUP BY 1, 2""", doubles="temp precip pressure wind", dates="obs_date")
def _(v):
    return v.grid.groupBy("geohash_prefix", "obs_date").agg(
        F.avg("temp_2m_c").alias("temp"), F.avg("precip_mm").alias("precip"),
        F.avg("pressure_hpa").alias("pressure"), F.avg("wind_speed_ms").alias("wind"))


_ONI, _NAO = INDEX_BOXES[0], INDEX_BOXES[1]


@query("agg_region_month", f"SELECT year, month, avg(temp_2m_c) AS sst FROM grid WHERE {_box_sql(_ONI.box)} GROUP BY 1, 2",
       doubles="sst")
def _(v):
    return indices.region_months(v.grid, {"sst": ("temp_2m_c", _ONI.box)})


@query("join_region_pair", """
SELECT year, month, nao_a AS south, nao_b AS north, nao_a - nao_b AS difference FROM region_means
WHERE nao_a IS NOT NULL AND nao_b IS NOT NULL""", doubles="south north difference")
def _(v):
    months = indices.region_months(v.grid, {"south": (_NAO.column, _NAO.box), "north": (_NAO.column, _NAO.minus)})
    return months.withColumn("difference", F.col("south") - F.col("north")).where("difference is not null")


@query("agg_global_scalar", """
SELECT year, month, raw, avg(raw) OVER () AS overall, stddev_samp(raw) OVER () AS spread FROM index_raw
WHERE index_name = 'nao' AND raw IS NOT NULL""", doubles="raw overall spread")
def _(v):
    whole = Window.partitionBy("index_name")
    return indices.monthly_raw(v.grid, [_NAO]).select(
        "year", "month", "raw", F.avg("raw").over(whole).alias("overall"),
        F.stddev("raw").over(whole).alias("spread"))


@query("join_climatology", """
SELECT year, month, raw - avg(raw) OVER (PARTITION BY month) AS anomaly FROM index_raw
WHERE index_name = 'oni' AND raw IS NOT NULL""", doubles="anomaly")
def _(v):
    same = Window.partitionBy("index_name", "month")
    return indices.monthly_raw(v.grid, [_ONI]).select(
        "year", "month", (F.col("raw") - F.avg("raw").over(same)).alias("anomaly"))


_MONTHLY = """
SELECT a.year, a.month, count(*) AS total_anomalies, count(*) FILTER (WHERE anomaly_type = 'heatwave') AS heatwave_count,
  count(*) FILTER (WHERE anomaly_type = 'cold_snap') AS cold_snap_count,
  count(*) FILTER (WHERE anomaly_type = 'precip_extreme') AS precip_extreme_count, avg(severity) AS avg_severity
FROM anomalies a GROUP BY 1, 2"""


@query("agg_summary_month", _MONTHLY, doubles="avg_severity")
def _(v):
    return anomaly.monthly(v.anomalies)


@query("agg_summary_region", f"""
SELECT s.*, r.country AS top_region, g.global_temp_anomaly FROM ({_MONTHLY}) s
JOIN (SELECT year, month, country, row_number() OVER (PARTITION BY year, month ORDER BY count(*) DESC, country) AS rn
  FROM anomalies a JOIN stations t ON a.station_id = t.station_id GROUP BY 1, 2, 3) r
  ON r.year = s.year AND r.month = s.month AND rn = 1
LEFT JOIN (SELECT year, month, avg(temp_anomaly) AS global_temp_anomaly FROM month_grid GROUP BY 1, 2) g
  ON g.year = s.year AND g.month = s.month""", doubles="avg_severity global_temp_anomaly")
def _(v):
    placed = joins.with_stations(v.anomalies, v.stations.select("station_id", "country"))
    return anomaly.monthly_with_region(placed, v.month_grid)


@query("agg_tiles", "SELECT * FROM tiles", doubles="avg_severity center_lat center_lon")
def _(v):
    return v.tiles


_EVENTS = """
SELECT station_id, CAST(event_id AS BIGINT) AS event_id, min(obs_date) AS start_date, max(obs_date) AS end_date,
  count(*) AS duration_days, max(tmax) AS peak_value, avg(tmax_zscore_30d) AS mean_score
FROM (SELECT *, sum(start) OVER (PARTITION BY station_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS event_id
  FROM (SELECT *, CASE WHEN hot = 1 AND lag(hot, 1, 0) OVER (PARTITION BY station_id ORDER BY obs_date) = 0
      THEN 1 ELSE 0 END AS start
    FROM (SELECT *, CASE WHEN tmax_zscore_30d > 1.0 THEN 1 ELSE 0 END AS hot FROM features)))
WHERE hot = 1 GROUP BY 1, 2"""


@query("agg_islands", _EVENTS, doubles="peak_value mean_score", dates="start_date end_date")
def _(v):
    return islands.events(v.features, "tmax_zscore_30d", 1.0)


@query("agg_decade_floor", f"""
SELECT CAST(year(start_date) // 10 * 10 AS INTEGER) AS decade, count(*) AS total_events, avg(duration_days) AS avg_duration_days,
  max(duration_days) AS longest_days, avg(mean_score) AS avg_score FROM ({_EVENTS}) WHERE year(start_date) >= 2000 GROUP BY 1""",
       doubles="avg_duration_days avg_score")
def _(v):
    return islands.by_decade(islands.events(v.features, "tmax_zscore_30d", 1.0), floor=2000)


@query("agg_decade", f"""
SELECT CAST(year(start_date) // 10 * 10 AS INTEGER) AS decade, count(*) AS total_events, avg(duration_days) AS avg_duration_days,
  max(duration_days) AS longest_days, avg(mean_score) AS avg_score FROM ({_EVENTS}) GROUP BY 1""",
       doubles="avg_duration_days avg_score")
def _(v):
    return islands.by_decade(islands.events(v.features, "tmax_zscore_30d", 1.0))


@query("ts_extremes", """
SELECT station_id, CAST(run AS BIGINT) AS event_id, min(obs_date) AS start_date, max(obs_date) AS end_date,
  count(*) AS duration_days, min(tmin) AS peak_value, avg(tmin_zscore_30d) AS mean_score
FROM (SELECT *, sum(start) OVER (PARTITION BY station_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN obs_date - lag(obs_date) OVER (PARTITION BY station_id ORDER BY obs_date) = 1
      THEN 0 ELSE 1 END AS start FROM features WHERE tmin_zscore_30d < -0.8))
GROUP BY 1, 2""", doubles="peak_value mean_score", dates="start_date end_date")
def _(v):
    return islands.events(v.features, "tmin_zscore_30d", 0.8, sign=-1, peak="tmin", adjacency="calendar")


@query("agg_annual", "SELECT station_id, variable, year, value FROM annual_means", doubles="value")
def _(v):
    return daily.annual(v.obs)


@query("agg_annual_extreme", """
SELECT station_id, variable, CAST(year(obs_date) AS INTEGER) AS year,
  CASE WHEN variable = 'tmin' THEN min(value) ELSE max(value) END AS value, count(*) AS days
FROM long_values GROUP BY 1, 2, 3""", doubles="value")
def _(v):
    return daily.annual_extreme(v.obs)


def _clim(part, name):
    return f"""
SELECT station_id, variable, CAST({part}(obs_date) AS INTEGER) AS {name}, avg(value) AS clim_mean,
  stddev_samp(value) AS clim_std, count(*) AS days FROM long_values GROUP BY 1, 2, 3"""


@query("agg_clim_doy", _clim("dayofyear", "doy"), doubles="clim_mean clim_std")
def _(v):
    return daily.climatology(v.obs, "doy")


@query("agg_clim_month", _clim("month", "month"), doubles="clim_mean clim_std")
def _(v):
    return daily.climatology(v.obs, "month")


_WEEK = "obs_date + CAST((7 - dayofweek(obs_date)) % 7 AS INTEGER)"


@query("agg_weekly", f"SELECT station_id, variable, {_WEEK} AS week_end, avg(value) AS value FROM long_values GROUP BY 1, 2, 3",
       doubles="value", dates="week_end")
def _(v):
    return daily.weekly(v.obs)


_RESAMPLED = "tmax tmin tavg prcp tmax_rolling_30d tmin_rolling_30d prcp_rolling_30d"


def _resample_sql(unit):
    return f"""
SELECT station_id, date_trunc('{unit}', obs_date) AS obs_date, avg(tmax) AS tmax, avg(tmin) AS tmin, sum(prcp) AS prcp,
  avg(tavg) AS tavg, avg(tmax_rolling_30d) AS tmax_rolling_30d, avg(tmin_rolling_30d) AS tmin_rolling_30d,
  avg(prcp_rolling_30d) AS prcp_rolling_30d FROM served_observations GROUP BY 1, 2"""


@query("agg_resample", _resample_sql("month"), doubles=_RESAMPLED, dates="obs_date")
def _(v):
    means = [c for c in _RESAMPLED.split() if c != "prcp"]
    return daily.resample(v.served_observations, "monthly", means, ["prcp"])


_TILE_ROLLUP = """
SELECT geohash, sum(center_lat * anomaly_count) / sum(anomaly_count) AS center_lat, sum(center_lon * anomaly_count) / sum(anomaly_count) AS center_lon,
  CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, avg(avg_severity) AS avg_severity,
  CAST(sum(heatwave_count) AS BIGINT) AS heatwave_count, CAST(sum(cold_snap_count) AS BIGINT) AS cold_snap_count,
  CAST(sum(precip_extreme_count) AS BIGINT) AS precip_extreme_count FROM served_tiles
WHERE {} GROUP BY 1 HAVING sum(anomaly_count) > 0"""


@query("agg_tile_rollup", _TILE_ROLLUP.format("true"), doubles="center_lat center_lon avg_severity")
def _(v):
    return serve.get_tiles(v.served_tiles)


@query("q_tiles", _TILE_ROLLUP.format(
    "tile_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' AND dominant_type = 'heatwave'"),
       doubles="center_lat center_lon avg_severity")
def _(v):
    return serve.get_tiles(v.served_tiles, "1997-01-01", "2000-12-31", "heatwave")


_REGIONS = """
SELECT country, count(*) AS anomaly_count, avg(severity) AS avg_severity FROM served_anomalies a
JOIN served_stations s ON a.station_id = s.id GROUP BY 1"""


@query("agg_top_regions", f"{_REGIONS} ORDER BY anomaly_count DESC, country LIMIT 3", doubles="avg_severity")
def _(v):
    return serve.top_regions(v.served_anomalies, v.served_stations, 3)


@query("agg_share", f"""
SELECT country, anomaly_count, anomaly_count / max(anomaly_count) OVER () AS relative,
  anomaly_count / sum(anomaly_count) OVER () AS share FROM ({_REGIONS})""", doubles="relative share")
def _(v):
    return serve.region_shares(serve.region_counts(v.served_anomalies, v.served_stations))


_DASHBOARD = """
SELECT (SELECT count(*) FROM stations) AS total_stations, count(*) AS total_anomalies,
  count(*) FILTER (WHERE anomaly_type = 'heatwave') AS heatwave_count,
  count(*) FILTER (WHERE anomaly_type = 'cold_snap') AS cold_snap_count,
  count(*) FILTER (WHERE anomaly_type = 'precip_extreme') AS precip_extreme_count,
  coalesce(avg(severity), 0) AS avg_severity FROM anomalies"""


@query("agg_dashboard", _DASHBOARD, doubles="avg_severity")
def _(v):
    return serve.dashboard(v.anomalies, v.stations)


_SCENARIOS = """
SELECT scenario, count(DISTINCT station_id) AS station_count, count(*) AS total_points,
  min(projection_date) AS start_date, max(projection_date) AS end_date FROM projections GROUP BY 1"""


@query("agg_scenarios", _SCENARIOS, dates="start_date end_date")
def _(v):
    return serve.list_scenarios(v.projections)


_SCENARIO_NAMES = ["ssp126", "ssp585"]
_SHORT = {"val": "predicted_value", "upper": "upper_bound", "lower": "lower_bound"}
_PIVOT = ("SELECT station_id, CAST(year(projection_date) AS INTEGER) AS year, " + ", ".join(
    f"max_by({c}, projection_date) FILTER (WHERE scenario = '{s}') AS {s}_{n}"
    for s in _SCENARIO_NAMES for n, c in _SHORT.items())
    + " FROM projections WHERE variable = '{}' AND scenario IN ('ssp126', 'ssp585') GROUP BY 1, 2")
_PIVOT_COLUMNS = " ".join(f"{s}_{n}" for s in _SCENARIO_NAMES for n in _SHORT)


@query("agg_pivot_scenario", _PIVOT.format("tmax"), doubles=_PIVOT_COLUMNS)
def _(v):
    return serve.scenario_pivot(v.projections, "tmax", _SCENARIO_NAMES)


@query("q_scenario_pivot", _PIVOT.format("prcp"), doubles=_PIVOT_COLUMNS)
def _(v):
    return serve.scenario_pivot(v.projections, "prcp", _SCENARIO_NAMES)


@query("agg_nest_by_var", """
SELECT station_id, '{' || string_agg('"' || variable || '":[' || points || ']', ',' ORDER BY variable) || '}' AS years FROM (
  SELECT station_id, variable, string_agg('{"year":' || year || ',"days":' || days || '}', ',' ORDER BY year) AS points
  FROM (SELECT station_id, variable, year(obs_date) AS year, count(*) AS days FROM long_values GROUP BY 1, 2, 3)
  GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    return serve.nest_by_variable(daily.annual_extreme(v.obs), ["station_id"], ["year", "days"], "years")


@query("agg_eval", """
SELECT f.station_id, f.variable, avg(abs(f.predicted_value - g.predicted_value)) AS mae,
  sqrt(avg(pow(f.predicted_value - g.predicted_value, 2))) AS rmse, count(*) AS points
FROM row_forecasts f JOIN forecasts g ON f.station_id = g.station_id AND f.variable = g.variable
  AND f.forecast_date = g.forecast_date GROUP BY 1, 2""", doubles="mae rmse")
def _(v):
    actual = v.forecasts.select("station_id", "variable", "forecast_date", F.col("predicted_value").alias("actual_value"))
    return forecast.evaluate(v.row_forecasts, actual, ["station_id", "variable", "forecast_date"])


# ---- windows -------------------------------------------------------------------------

def _rolled(days):
    names = [f"{x}_rolling_{days}d_{stat}" for x, stats in rolling.DEFAULT_SPECS[days].items() for stat in stats]
    sql = (f"SELECT station_id, obs_date, {', '.join(names)} FROM (SELECT *, {rolling_sql(days)} FROM "
           "(SELECT *, obs_date - DATE '1970-01-01' AS dn FROM obs))")

    @query(f"win_rolling_{days}", sql, doubles=" ".join(names), dates="obs_date")
    def _(v):
        spec = {days: rolling.DEFAULT_SPECS[days]}
        return rolling.rolling(v.obs, spec).select("station_id", "obs_date", *names)
    return names, sql


_rolled(30)
_rolled(90)
_NAMES_365, _SQL_365 = _rolled(365)


@query("win_rolling_blocks", _SQL_365, doubles=" ".join(_NAMES_365), dates="obs_date")
def _(v):
    spec = {365: rolling.DEFAULT_SPECS[365]}
    return rolling.rolling(v.obs, spec, block_days=730).select("station_id", "obs_date", *_NAMES_365)


@query("win_rolling_events", _SQL_365, doubles=" ".join(_NAMES_365), dates="obs_date")
def _(v):
    return lookback.rolling(v.obs, {365: rolling.DEFAULT_SPECS[365]}).select("station_id", "obs_date", *_NAMES_365)


_DOY = "tmax_doy_mean tmax_doy_std tmin_doy_mean tmin_doy_std tmax_climatology_deviation tmin_climatology_deviation"


@query("win_doy", f"SELECT station_id, obs_date, day_of_year, {', '.join(_DOY.split())} FROM features",
       doubles=_DOY, dates="obs_date")
def _(v):
    return rolling.doy_deviation(v.obs, ["tmax", "tmin"]).select(
        "station_id", "obs_date", "day_of_year", *_DOY.split())


_STATE = """
SELECT *, CASE WHEN is_extreme = 1 AND prev_extreme = 0 THEN 1 ELSE 0 END AS event_start FROM (
  SELECT *, lag(is_extreme, 1, 0) OVER (PARTITION BY station_id ORDER BY obs_date) AS prev_extreme FROM (
    SELECT station_id, obs_date, CASE WHEN tmax > 80 THEN 1 ELSE 0 END AS is_extreme FROM obs))"""


@query("win_lag_state", _STATE, dates="obs_date")
def _(v):
    return islands.with_state(v.obs.select("station_id", "obs_date", "tmax"), F.col("tmax") > 80).drop("tmax")


@query("win_island_id", f"""
SELECT station_id, obs_date, CAST(sum(event_start) OVER (PARTITION BY station_id ORDER BY obs_date
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM ({_STATE})""", dates="obs_date")
def _(v):
    state = islands.with_state(v.obs.select("station_id", "obs_date", "tmax"), F.col("tmax") > 80)
    return islands.with_event_id(state).select("station_id", "obs_date", "event_id")


@query("win_date_island", """
SELECT station_id, obs_date, CAST(count(*) OVER (PARTITION BY station_id, run) AS INTEGER) AS duration_days FROM (
  SELECT *, sum(start) OVER (PARTITION BY station_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT station_id, obs_date, CASE WHEN obs_date - lag(obs_date) OVER (PARTITION BY station_id ORDER BY obs_date) = 1
      THEN 0 ELSE 1 END AS start FROM obs))""", dates="obs_date")
def _(v):
    return islands.calendar_runs(v.obs.select("station_id", "obs_date"))


for _name, _index in (("win_center_3", INDEX_BOXES[0]), ("win_center_11", INDEX_BOXES[3])):
    def _centred(v, index=_index):
        return indices.compute(v.grid, [index], digits=None).select("index_date", "value")
    query(_name, f"SELECT index_date, value FROM index_series WHERE index_name = '{_index.name}'",
          doubles="value", dates="index_date")(_centred)


_LATEST = "SELECT station_id, max(obs_date) AS obs_date, count(*) AS days, " + ", ".join(
    f"max({x}) FILTER (WHERE rn = 1) AS {x}, avg({x}) AS {x}_mean, stddev_samp({x}) AS {x}_std" for x in schemas.VARIABLES
) + """ FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_date DESC) AS rn FROM obs)
WHERE rn <= 365 GROUP BY 1"""
_LATEST_Z = "SELECT *, " + ", ".join(
    f"CASE WHEN {x}_std > 0 THEN ({x} - {x}_mean) / {x}_std END AS {x}_z" for x in schemas.VARIABLES) + f" FROM ({_LATEST})"
_LATEST_COLUMNS = " ".join(f"{x} {x}_mean {x}_std {x}_z" for x in schemas.VARIABLES)


@query("win_last_n", _LATEST_Z, doubles=_LATEST_COLUMNS, dates="obs_date")
def _(v):
    return rolling.latest_scores(v.obs, schemas.VARIABLES)


@query("join_scalar", f"SELECT station_id, obs_date, tmax, tmax_mean, tmax_std FROM ({_LATEST})",
       doubles="tmax tmax_mean tmax_std", dates="obs_date")
def _(v):
    return rolling.latest_scores(v.obs, ["tmax"]).select("station_id", "obs_date", "tmax", "tmax_mean", "tmax_std")


_NEWEST = """
SELECT index_name, value AS latest_value, index_date AS latest_date, source FROM index_series
QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY index_date DESC) = 1"""


@query("win_distinct_on", _NEWEST, doubles="latest_value", dates="latest_date")
def _(v):
    return serve.list_indices(v.index_series)


@query("q_indices", _NEWEST, doubles="latest_value", dates="latest_date")
def _(v):
    return serve.list_indices(v.index_series)


@query("win_quantile_flag", """
SELECT station_id, obs_date, tmax >= cut AS flag, cut FROM (SELECT station_id, obs_date, tmax,
  quantile_cont(tmax, 0.98) OVER (PARTITION BY station_id) AS cut FROM obs)""", doubles="cut", dates="obs_date")
def _(v):
    station = Window.partitionBy("station_id")
    cut = F.percentile("tmax", 0.98).over(station)
    return v.obs.select("station_id", "obs_date", (F.col("tmax") >= cut).alias("flag"), cut.alias("cut"))


@query("win_evweight", """
SELECT station_id, obs_date, CASE WHEN tmin > tail THEN 1 + ln(1 + tmin / tail) ELSE 1 END AS weight FROM (
  SELECT station_id, obs_date, tmin, coalesce(quantile_cont(CASE WHEN tmin > 0 THEN tmin END, 0.95)
    OVER (PARTITION BY station_id), 1) AS tail FROM obs)""", doubles="weight", dates="obs_date")
def _(v):
    positive = F.when(F.col("tmin") > 0, F.col("tmin"))
    tail = F.coalesce(F.percentile(positive, 0.95).over(Window.partitionBy("station_id")), F.lit(1.0))
    return v.obs.select("station_id", "obs_date", anomaly.extreme_weight(F.col("tmin"), tail).alias("weight"))


# ---- sorts, limits, set operations -----------------------------------------------------

@query("topk_severity", """
SELECT id, station_id, severity, anomaly_date FROM served_anomalies
ORDER BY severity DESC, anomaly_date DESC, id LIMIT 1000""", doubles="severity", dates="anomaly_date")
def _(v):
    return serve.get_anomalies(v.served_anomalies, v.served_stations).select(
        "id", "station_id", "severity", "anomaly_date")


@query("topk_recent", """
SELECT id, station_id, anomaly_date FROM served_anomalies
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY anomaly_date DESC, id) <= 50""", dates="anomaly_date")
def _(v):
    return serve.latest(v.served_anomalies.select("id", "station_id", "anomaly_date"), ["station_id"],
                        [F.col("anomaly_date").desc(), F.col("id")], 50)


@query("topk_records", "SELECT id, record_count FROM served_stations ORDER BY record_count DESC, id LIMIT 20")
def _(v):
    return serve.list_stations(v.served_stations, limit=20).select("id", "record_count")


_SERIES = """
SELECT index_date, value, anomaly FROM index_series WHERE lower(index_name) = '{}' {}
ORDER BY index_date DESC LIMIT {}"""


@query("sort_series", _SERIES.format("oni", "", 36), doubles="value anomaly", dates="index_date")
def _(v):
    return serve.index_series(v.index_series, "ONI", limit=36)


@query("q_index_series", _SERIES.format("pdo", "AND index_date >= DATE '1996-01-01' AND index_date <= DATE '2000-12-31'", 600),
       doubles="value anomaly", dates="index_date")
def _(v):
    return serve.index_series(v.index_series, "pdo", "1996-01-01", "2000-12-31")


@query("set_union_by_name", """
SELECT index_name, index_date, value FROM index_series WHERE index_name IN ('oni', 'nao', 'iod')""",
       doubles="value", dates="index_date")
def _(v):
    from functools import reduce
    parts = [indices.compute(v.grid, [d], digits=None) for d in INDEX_BOXES if d.name in ("oni", "nao", "iod")]
    return reduce(lambda a, b: a.unionByName(b), parts).select("index_name", "index_date", "value")


# ---- index series ----------------------------------------------------------------------

for _index in INDEX_BOXES:
    def _one(v, index=_index):
        return indices.compute(v.grid, [index], digits=None)
    query(f"idx_{_index.name}", f"SELECT * FROM index_series WHERE index_name = '{_index.name}'",
          doubles="value anomaly", dates="index_date")(_one)


@query("idx_all", "SELECT * FROM index_series", doubles="value anomaly", dates="index_date")
def _(v):
    return v.index_series


# ---- series statistics -----------------------------------------------------------------

_MK = """
WITH n AS (SELECT station_id, variable, count(*)::DOUBLE AS n FROM annual_means GROUP BY 1, 2),
t AS (SELECT station_id, variable, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (
  SELECT station_id, variable, value, count(*)::DOUBLE AS c FROM annual_means GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT station_id, variable, sum(sign(dv))::DOUBLE AS s FROM pairs GROUP BY 1, 2),
q AS (SELECT n.*, p.s, (n.n * (n.n - 1) * (2 * n.n + 5) - t.ties) / 18 AS var_s
  FROM n JOIN t ON n.station_id = t.station_id AND n.variable = t.variable
  JOIN p ON n.station_id = p.station_id AND n.variable = p.variable)
SELECT station_id, variable, CAST(n AS INTEGER) AS n, s, var_s, s / (n * (n - 1) / 2) AS tau,
  CASE WHEN var_s > 0 THEN (s - sign(s)) / sqrt(var_s) ELSE 0 END AS z_statistic FROM q"""


@query("ts_mann_kendall", _MK, doubles="s var_s tau z_statistic")
def _(v):
    series = trends.annual_arrays(daily.annual(v.obs))
    return trends.mann_kendall(series).select("station_id", "variable", "n", "s", "var_s", "tau", "z_statistic")


@query("join_pairs", """
SELECT station_id, variable, count(*) FILTER (WHERE dv > 0) AS rising, count(*) FILTER (WHERE dv < 0) AS falling,
  count(*) FILTER (WHERE dv = 0) AS tied FROM pairs GROUP BY 1, 2""")
def _(v):
    return trends.pair_counts(trends.annual_arrays(daily.annual(v.obs)))


_SEN = """
SELECT station_id, variable, median(slope) AS sens_slope,
  list_sort(list(slope))[CAST(floor(greatest((count(*) - 1.96::DOUBLE * sqrt(count(*)) / 2) / 2, 0)) AS BIGINT) + 1] AS ci_lower,
  list_sort(list(slope))[CAST(floor(least((count(*) + 1.96::DOUBLE * sqrt(count(*)) / 2) / 2, count(*) - 1)) AS BIGINT) + 1] AS ci_upper
FROM pairs GROUP BY 1, 2"""


@query("ts_sen", _SEN, doubles="sens_slope ci_lower ci_upper")
def _(v):
    return trends.sen(trends.annual_arrays(daily.annual(v.obs))).select(
        "station_id", "variable", "sens_slope", "ci_lower", "ci_upper")


_TREND = f"""
SELECT m.station_id, m.variable, a.period_start, a.period_end, CASE WHEN s.sens_slope > 0 THEN 'increasing'
    WHEN s.sens_slope < 0 THEN 'decreasing' ELSE 'no_trend' END AS trend_direction, s.sens_slope, m.z_statistic, m.tau,
  s.sens_slope * 10 AS slope_per_decade, s.ci_lower, s.ci_upper, abs(m.z_statistic) > 1.959963984540054 AS significant,
  CASE WHEN m.z_statistic = 0 THEN 1::DOUBLE ELSE 1 - 2 * exp(-m.z_statistic * m.z_statistic / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150),
    lambda k: exp((2 * k + 1) * ln(abs(m.z_statistic)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) END AS p_value
FROM ({_MK}) m JOIN ({_SEN}) s ON m.station_id = s.station_id AND m.variable = s.variable
JOIN (SELECT station_id, variable, min(year) AS period_start, max(year) AS period_end FROM annual_means GROUP BY 1, 2) a
  ON a.station_id = m.station_id AND a.variable = m.variable WHERE m.n >= {MIN_YEARS}"""
_TREND_COLUMNS = "sens_slope z_statistic tau slope_per_decade ci_lower ci_upper p_value"


@query("ts_trend", _TREND, doubles=_TREND_COLUMNS)
def _(v):
    return trends.trend(v.obs, MIN_YEARS, digits=False)


@query("q_trends", f"SELECT * FROM ({_TREND}) WHERE variable = 'tmax'", doubles=_TREND_COLUMNS)
def _(v):
    return serve.station_trends(trends.trend(v.obs, MIN_YEARS, digits=False), variable="tmax")


@query("ts_trend_p", f"SELECT station_id, variable, z_statistic, p_value FROM ({_TREND})", doubles="z_statistic p_value")
def _(v):
    return trends.trend(v.obs, MIN_YEARS, digits=False).select("station_id", "variable", "z_statistic", "p_value")


@query("ts_gev", "SELECT * FROM gev", doubles="b0 b1 b2 shape_param location_param scale_param")
def _(v):
    return v.gev


@query("ts_gev_likelihood")
def _(v):
    return extremes.likelihood(extremes.block_extremes(v.obs, min_years=MIN_YEARS))


@query("ts_return_level", "SELECT * FROM levels",
       doubles="return_level lower_ci upper_ci shape_param location_param scale_param")
def _(v):
    return v.levels


@query("q_extremes", "SELECT * FROM levels", doubles="return_level lower_ci upper_ci shape_param location_param scale_param")
def _(v):
    """The nested documents, taken apart again so that every field is compared."""
    entry = "array<struct<return_period: int, return_level: double, lower_ci: double, upper_ci: double>>"
    nested = serve.station_extremes(v.levels).withColumn("level", F.explode(F.from_json("return_levels", entry)))
    return nested.select("station_id", "variable", "distribution", "level.*", "shape_param", "location_param", "scale_param", "n_years")


@query("ts_interpolate", """
SELECT station_id, obs_date, CASE WHEN prcp IS NOT NULL THEN prcp
  WHEN pv IS NOT NULL AND nv IS NOT NULL AND rn - pr <= 30 THEN pv + (nv - pv) / (nr - pr) * (rn - pr)
  ELSE coalesce(nv, pv) END AS prcp FROM (
  SELECT *, last_value(prcp IGNORE NULLS) OVER b AS pv, last_value(kr IGNORE NULLS) OVER b AS pr,
    first_value(prcp IGNORE NULLS) OVER a AS nv, first_value(kr IGNORE NULLS) OVER a AS nr FROM (
    SELECT station_id, obs_date, prcp, rn, CASE WHEN prcp IS NOT NULL THEN rn END AS kr FROM (
      SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_date) AS rn FROM obs))
  WINDOW b AS (PARTITION BY station_id ORDER BY rn ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY station_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
       doubles="prcp", dates="obs_date")
def _(v):
    return decompose.interpolate(v.obs, ["prcp"]).select("station_id", "obs_date", "prcp")


@query("ts_decomp_classical", """
SELECT station_id, obs_date, trend, m - level AS seasonal, tmax - trend - (m - level) AS residual FROM (
  SELECT *, avg(m) FILTER (WHERE first_of_phase) OVER (PARTITION BY station_id) AS level FROM (
    SELECT *, avg(tmax - trend) OVER (PARTITION BY station_id, phase) AS m,
      row_number() OVER (PARTITION BY station_id, phase ORDER BY obs_date) = 1 AS first_of_phase FROM (
      SELECT station_id, obs_date, tmax, (row_number() OVER (PARTITION BY station_id ORDER BY obs_date) - 1) % 15 AS phase,
        CASE WHEN count(*) OVER c = 15 THEN avg(tmax) OVER c END AS trend FROM obs
      WINDOW c AS (PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))))""",
       doubles="trend seasonal residual", dates="obs_date")
def _(v):
    return decompose.classical(v.obs, "tmax", 15).select("station_id", "obs_date", "trend", "seasonal", "residual")


@query("ts_forecast_stat", "SELECT * FROM forecasts", doubles="predicted_value lower_bound upper_bound mae rmse",
       dates="forecast_date")
def _(v):
    return v.forecasts


@query("ts_forecast_stat_rows", "SELECT * FROM row_forecasts", doubles="predicted_value lower_bound upper_bound mae rmse",
       dates="forecast_date")
def _(v):
    return v.row_forecasts


@query("ts_projection", "SELECT * FROM projections", doubles="predicted_value lower_bound upper_bound",
       dates="projection_date")
def _(v):
    return v.projections


@query("ts_projection_noise")
def _(v):
    return project.scenarios(v.placed, noise=0.3).groupBy("station_id", "variable", "scenario").agg(
        F.avg("predicted_value").alias("mean_value"), F.count(F.lit(1)).alias("points"))

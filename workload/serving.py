"""Read queries, models and the live path."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe import schemas
from skyframe.functions import geo
from skyframe.operators import anomaly, daily, decompose, forecast, isolation, joins, rolling
from skyframe.plans import serve
from skyframe.sources import lake
from skyframe.streaming import live
from workload.basics import BOX, folder
from workload.registry import query
from workload.views import Views

# ---- read queries ----------------------------------------------------------------------

_ON_MAP = """
SELECT a.id, a.station_id, a.anomaly_date, a.anomaly_type, a.severity, a.duration_days, a.temp_deviation,
  a.precip_deviation, s.latitude, s.longitude, s.name AS station_name, s.country
FROM served_anomalies a JOIN served_stations s ON a.station_id = s.id"""
_ON_MAP_COLUMNS = "severity temp_deviation precip_deviation latitude longitude"


@query("q_anomalies", f"""{_ON_MAP} WHERE a.anomaly_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND a.severity >= 0.2 AND s.latitude BETWEEN {BOX.min_lat} AND {BOX.max_lat}
  AND s.longitude BETWEEN {BOX.min_lon} AND {BOX.max_lon} ORDER BY severity DESC, anomaly_date DESC, a.id LIMIT 500""",
       doubles=_ON_MAP_COLUMNS, dates="anomaly_date")
def _(v: Views):
    return serve.get_anomalies(v.served_anomalies, v.served_stations, limit=500, box=BOX, start="1996-01-01",
                               end="2000-12-31", min_severity=0.2).drop("description")


@query("q_stations", f"""
SELECT * FROM served_stations WHERE country = 'ASIA' AND (name ILIKE '%supplier%' OR id ILIKE '%supplier%')
  AND latitude BETWEEN -60 AND 60 AND longitude BETWEEN -180 AND 180 ORDER BY record_count DESC, id LIMIT 500""",
       doubles="latitude longitude elevation")
def _(v):
    return serve.list_stations(v.served_stations, "ASIA", "Supplier", geo.Box(-60, 60, -180, 180))


@query("q_station_detail", """
SELECT s.id, s.name, s.record_count, a.id AS anomaly_id, CAST(CAST(anomaly_date AS DATE) AS VARCHAR) AS anomaly_date, anomaly_type, severity,
  duration_days, temp_deviation, precip_deviation, CAST(rn AS INTEGER) AS place FROM served_stations s LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY anomaly_date DESC, id) AS rn FROM served_anomalies
    QUALIFY rn <= 50) a ON a.station_id = s.id""", doubles="severity temp_deviation precip_deviation")
def _(v):
    details = serve.station_details(v.served_stations, v.served_anomalies)
    entries = details.select("id", "name", "record_count", F.posexplode_outer("recent_anomalies").alias("at", "entry"))
    return entries.select("id", "name", "record_count", F.col("entry.id").alias("anomaly_id"), "entry.anomaly_date", "entry.anomaly_type",
                          "entry.severity", "entry.duration_days", "entry.temp_deviation", "entry.precip_deviation",
                          (F.col("at") + 1).alias("place"))


_SERIES_SQL = """
SELECT station_id, obs_date, {} FROM served_observations WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'"""
_SERIES_COLUMNS = " ".join(serve.SERIES_COLUMNS)


@query("q_timeseries", _SERIES_SQL.format(", ".join(serve.SERIES_COLUMNS)), doubles=_SERIES_COLUMNS, dates="obs_date")
def _(v):
    return serve.timeseries(v.served_observations, start="1996-01-01", end="2001-06-30")


@query("q_timeseries_limit", f"""
SELECT station_id, obs_date, {", ".join(serve.SERIES_COLUMNS)} FROM served_observations
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_date DESC) <= 20""", doubles=_SERIES_COLUMNS, dates="obs_date")
def _(v):
    return serve.timeseries(v.served_observations, limit=20)


for _resolution, _unit in (("monthly", "month"), ("yearly", "year")):
    _aggregated = ", ".join(f"{'sum' if c == 'prcp' else 'avg'}({c}) AS {c}" for c in serve.SERIES_COLUMNS)

    def _resampled(v, resolution=_resolution):
        return serve.timeseries(v.served_observations, start="1996-01-01", end="2001-06-30", resolution=resolution)
    query(f"q_timeseries_{_resolution}", f"""
SELECT station_id, date_trunc('{_unit}', obs_date) AS obs_date, {_aggregated} FROM served_observations
WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY 1, 2""",
          doubles=_SERIES_COLUMNS, dates="obs_date")(_resampled)


@query("q_summary", """
SELECT CAST((SELECT count(*) FROM served_stations) AS BIGINT) AS total_stations, count(*) AS total_anomalies,
  count(*) FILTER (WHERE anomaly_type = 'heatwave') AS heatwave_count,
  count(*) FILTER (WHERE anomaly_type = 'cold_snap') AS cold_snap_count,
  count(*) FILTER (WHERE anomaly_type = 'precip_extreme') AS precip_extreme_count,
  coalesce(avg(severity), 0) AS avg_severity FROM served_anomalies""", doubles="avg_severity")
def _(v):
    return serve.dashboard(v.served_anomalies, v.served_stations)


@query("q_summary_trend", """
SELECT year, month, count(*) AS total_anomalies FROM anomalies GROUP BY 1, 2 ORDER BY year DESC, month DESC LIMIT 24""")
def _(v):
    return serve.monthly_trend(anomaly.monthly(v.anomalies).select("year", "month", "total_anomalies"), 24)


@query("q_forecast", """
SELECT station_id, '{' || string_agg('"' || variable || '":[' || points || ']', ',' ORDER BY variable) || '}' AS dates FROM (
  SELECT station_id, variable, string_agg('{"forecast_date":"' || CAST(forecast_date AS VARCHAR) || '","model_type":"'
    || model_type || '"}', ',' ORDER BY forecast_date) AS points FROM forecasts WHERE variable IN ('tmax', 'tmin') GROUP BY 1, 2)
GROUP BY 1""")
def _(v):
    two = v.forecasts.where(F.col("variable").isin("tmax", "tmin"))
    return serve.nest_by_variable(two, ["station_id"], ["forecast_date", "model_type"], "dates")


def _points(nested, document: str, fields: str):
    """The points of nested documents as rows, so that every field is compared."""
    entries = nested.select("*", F.explode(F.from_json(document, f"map<string, array<struct<{fields}>>>")).alias("variable", "points"))
    return entries.withColumn("point", F.explode("points"))


@query("q_forecast_documents", """
SELECT station_id, variable, CAST(forecast_date AS VARCHAR) AS forecast_date, predicted_value, lower_bound, upper_bound, model_type, model_version
FROM forecasts""", doubles="predicted_value lower_bound upper_bound")
def _(v):
    fields = "forecast_date: string, predicted_value: double, lower_bound: double, upper_bound: double, model_type: string, model_version: string"
    return _points(serve.station_forecast(v.forecasts), "forecasts", fields).select("station_id", "variable", "point.*")


@query("q_projections", """
SELECT station_id, scenario, variable, CAST(CAST(projection_date AS DATE) AS VARCHAR) AS projection_date, predicted_value, lower_bound, upper_bound, model_name
FROM projections WHERE scenario = 'ssp245' AND variable = 'tmax'""", doubles="predicted_value lower_bound upper_bound")
def _(v):
    fields = "projection_date: string, predicted_value: double, lower_bound: double, upper_bound: double, model_name: string"
    nested = serve.station_projections(v.projections, "ssp245", variable="tmax")
    return _points(nested, "projections", fields).select("station_id", "scenario", "variable", "point.*")


@query("q_scenarios", """
SELECT scenario, count(DISTINCT station_id) AS station_count, count(*) AS total_points, min(projection_date) AS start_date,
  max(projection_date) AS end_date FROM projections GROUP BY 1""", dates="start_date end_date")
def _(v):
    return serve.list_scenarios(v.projections)


@query("q_wind_grid", """
SELECT (i + 0.5) * 9 - 90 AS lat, (j + 0.5) * 18 - 180 AS lon, u, v, sqrt(u * u + v * v) AS speed,
  CASE WHEN atan2(v, u) < 0 THEN degrees(atan2(v, u)) + 360 ELSE degrees(atan2(v, u)) END AS direction FROM (
  SELECT least(floor((latitude + 90) / 18.0), 9) AS i, least(floor((longitude + 180) / 36.0), 9) AS j, avg(u10) AS u, avg(v10) AS v
  FROM raw_grid GROUP BY 1, 2)""".replace("* 9 - 90", "* 18 - 90").replace("* 18 - 180", "* 36 - 180"),
       doubles="lat lon u v speed direction")
def _(v):
    return serve.wind_grid(v.grid, resolution=10)


_EXPORT = ("tmax tmin prcp snow snwd tavg tmax_rolling_30d tmin_rolling_30d prcp_rolling_30d tmax_rolling_365d "
           "tmin_rolling_365d prcp_rolling_365d tmax_stddev_30d tmin_stddev_30d prcp_stddev_30d")


@query("q_export_ts", "SELECT * FROM served_observations WHERE obs_date <= DATE '1999-12-31'", doubles=_EXPORT, dates="obs_date")
def _(v):
    return serve.export_timeseries(v.served_observations, end="1999-12-31")


@query("q_export_anom", f"""
SELECT station_id, station_name, country, latitude, longitude, anomaly_date, anomaly_type, severity, duration_days,
  temp_deviation, precip_deviation FROM ({_ON_MAP}) WHERE anomaly_type = 'cold_snap' AND severity >= 0.1""", doubles=_ON_MAP_COLUMNS, dates="anomaly_date")
def _(v):
    return serve.export_anomalies(v.served_anomalies, v.served_stations, anomaly_type="cold_snap",
                                  min_severity=0.1).drop("description")


# ---- models ------------------------------------------------------------------------------

def _given_scores(v):
    """Two score columns from features, standing in for the model scores."""
    return v.features.select(
        "station_id", "obs_date", (F.abs("tmax_zscore_30d") + F.abs("tmin_zscore_30d")).alias("iforest_score"),
        F.abs("prcp").alias("seq_score"))


@query("ml_ensemble_score", """
SELECT station_id, obs_date, raw_score, raw_score >= quantile_cont(raw_score, 0.98) OVER s OR outlier AS is_anomaly FROM (
  SELECT *, combined * CASE WHEN combined > tail THEN 1 + ln(1 + combined / tail) ELSE 1 END AS raw_score FROM (
    SELECT *, coalesce(quantile_cont(CASE WHEN combined > 0 THEN combined END, 0.95) OVER s, 1) AS tail FROM (
      SELECT *, CASE WHEN has_b THEN a * 0.6::DOUBLE + b * 0.4::DOUBLE ELSE a END AS combined FROM (
        SELECT station_id, obs_date,
          CASE WHEN max(p) OVER s > min(p) OVER s THEN (p - min(p) OVER s) / (max(p) OVER s - min(p) OVER s) ELSE 0.5 END AS a,
          CASE WHEN max(q) OVER s > min(q) OVER s THEN (q - min(q) OVER s) / (max(q) OVER s - min(q) OVER s) ELSE 0 END AS b,
          sum(q) OVER s > 0 AS has_b, p > quantile_cont(p, 0.98) OVER s AS outlier
        FROM (SELECT station_id, obs_date, abs(tmax_zscore_30d) + abs(tmin_zscore_30d) AS p, coalesce(abs(prcp), 0) AS q FROM features)
        WINDOW s AS (PARTITION BY station_id)))
    WINDOW s AS (PARTITION BY station_id)))
WINDOW s AS (PARTITION BY station_id)""", doubles="raw_score", dates="obs_date")
def _(v):
    given = _given_scores(v).withColumn("seq_score", F.coalesce("seq_score", F.lit(0.0)))
    return anomaly.ensemble_score(given).select("station_id", "obs_date", "raw_score", "is_anomaly")


@query("ml_zanomaly", "SELECT * EXCLUDE (description) FROM anomalies",
       doubles="latitude longitude severity temp_deviation precip_deviation", dates="obs_date")
def _(v):
    return v.anomalies.drop("description")


def _features_wide(v):
    nothing = {f"{x}_residual": F.lit(None).cast("double") for x in schemas.VARIABLES}
    return v.features.withColumns(nothing).select("station_id", "obs_date", *anomaly.FEATURES)


@query("ml_iforest")
def _(v):
    return isolation.model_scores(_features_wide(v), sequence=False).select("station_id", "obs_date", "iforest_score")


@query("ml_seq_recon")
def _(v):
    return isolation.model_scores(_features_wide(v), trees=1).select("station_id", "obs_date", "seq_score")


@query("ts_stl")
def _(v):
    return decompose.stl(v.obs, period=30, seasonal=13, trend=61, min_rows=200)


@query("ml_anomaly")
def _(v):
    """All eight features: the residuals come from a stored decomposition."""
    store = lake.Lake(v.spark, folder(v, "anomalies"))
    return isolation.detect_stored(store, v.features, min_rows=365, period=30, seasonal=13, trend=61)


@query("ml_forecast_harmonic")
def _(v):
    return forecast.harmonic(v.obs, min_rows=365)


@query("ml_forecast_arx")
def _(v):
    return forecast.arx(v.obs, min_rows=365)


_BLEND = """
SELECT station_id, variable, forecast_date + CAST((7 - dayofweek(forecast_date)) % 7 AS INTEGER) AS forecast_date,
  {} AS predicted_value, {} AS lower_bound, {} AS upper_bound, 'ensemble' AS model_type,
  'harmonic_0.7_statistical_0.3' AS model_version FROM (
  SELECT *, 0.3::DOUBLE AS w FROM forecasts UNION ALL SELECT *, 0.7::DOUBLE AS w FROM row_forecasts WHERE month(forecast_date) % 2 = 0) GROUP BY 1, 2, 3"""


def _blend_sql(normalize):
    parts = [f"sum({c} * w)" + (" / sum(w)" if normalize else "") for c in ("predicted_value", "lower_bound", "upper_bound")]
    return _BLEND.format(*parts)


for _name, _normalize in (("ml_ensemble_forecast", True), ("join_outer_ensemble", False)):
    def _blend(v, normalize=_normalize):
        # the second model is missing in odd months, so that the weights present differ
        both = v.forecasts.unionByName(v.row_forecasts.where(F.month("forecast_date") % 2 == 0))
        return forecast.ensemble(both, forecast.WEIGHTS_TWO, normalize).drop("mae", "rmse")
    query(_name, _blend_sql(_normalize), doubles="predicted_value lower_bound upper_bound", dates="forecast_date")(_blend)


@query("ml_registry", """
SELECT station_id, variable, 'statistical' AS model_name,
  CASE WHEN variable = 'tmax' THEN '1.1' ELSE '1.0' END AS version, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse,
  CASE WHEN variable = 'tmax' THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS trained_at, true AS is_active
FROM (SELECT DISTINCT station_id, variable FROM forecasts)""", doubles="mae rmse", dates="trained_at")
def _(v):
    first = forecast.registry_rows(v.forecasts, F.lit("2024-01-01").cast("date"))
    newer = v.forecasts.where("variable = 'tmax'").withColumn("model_version", F.lit("1.1"))
    return forecast.active_models(first.unionByName(forecast.registry_rows(newer, F.lit("2024-02-01").cast("date"))))


# ---- live path ---------------------------------------------------------------------------

CYCLES = 3


def _arrivals(df, day, repeat=True):
    """A table in the order it arrives, one frame for each cycle: by time, every tenth row up
    to three days late (so some come a cycle later), every seventh row a second time."""
    when = F.unix_timestamp(F.col(day).cast("timestamp"))
    low, high = df.agg(F.min(when), F.max(when)).first()
    key = F.xxhash64(*[c for c in df.columns if c != "props"])
    late = F.when(F.pmod(key, F.lit(10)) == 0, F.lit(3 * 86400)).otherwise(F.lit(0))
    cycle = F.least(F.floor((when + late - F.lit(low)) * CYCLES / F.lit(high - low + 1)), F.lit(CYCLES - 1))
    again = F.when(F.pmod(key, F.lit(7)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    every = df.withColumn("_again", F.explode(again)).drop("_again") if repeat else df
    return [every.where(cycle == k) for k in range(CYCLES)]


def _drain(v: Views, build, name: str, mode: str = "append", table=None, day: str = "ts", repeat: bool = True, handle=None):
    """Cycles of a live query over one checkpoint: each stores what has arrived and runs the
    query over it; a last cycle finds nothing new. Returns what was stored, by batch."""
    path, checkpoint, feed = folder(v, name), folder(v, f"{name}-checkpoint"), folder(v, f"{name}-feed")
    df = v.table("events") if table is None else table
    for k, arrived in enumerate([*_arrivals(df, day, repeat), None]):
        if arrived is not None:
            arrived.write.parquet(f"{feed}/cycle-{k}")
        stream = live.source(v.spark, f"{feed}/*", df.schema, files_per_batch=1000)
        live.run(build(stream), checkpoint, handle=(handle or live.store_batches)(path), mode=mode).awaitTermination()
    return v.spark.read.parquet(path)


def _records(v: Views):
    """Turns a stream of events into live records."""
    def build(stream):
        live_view = Views(v.spark, v.sf_dir)
        live_view.table = lambda name: stream if name == "events" else v.table(name)
        return live_view.live_records
    return build


@query("str_source", "SELECT station_id, obs_date, element, value FROM live_records", doubles="value", dates="obs_date")
def _(v):
    records = _records(v)
    return _drain(v, lambda s: records(s).select("station_id", "obs_date", "element", "value"), "records", repeat=False).drop("batch")


@query("str_dedup", "SELECT DISTINCT station_id, obs_date, element FROM live_records", dates="obs_date")
def _(v):
    records = _records(v)
    return _drain(v, lambda s: live.dedupe(records(s)).select("station_id", "obs_date", "element"), "dedup").drop("batch")


_WIDE = """
SELECT station_id, obs_date, max(value) FILTER (WHERE element = 'TMAX') AS tmax, max(value) FILTER (WHERE element = 'TMIN') AS tmin,
  max(value) FILTER (WHERE element = 'PRCP') AS prcp FROM live_records GROUP BY 1, 2"""


@query("str_pivot", _WIDE, doubles="tmax tmin prcp", dates="obs_date")
def _(v):
    records = _records(v)
    return live.newest(_drain(v, lambda s: live.pivot(records(s)), "pivot", "update"), ["station_id", "obs_date"])


def _z(x):
    return (f"CASE WHEN stddev_samp({x}) OVER w > 0 THEN ({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w END AS {x}_z")


_DETECT = f"""
SELECT station_id, obs_date AS anomaly_date, kind AS anomaly_type, least(abs(z) / 5, 1) AS severity, 1 AS duration_days,
  z AS temp_deviation FROM (
  SELECT *, CASE kind WHEN 'heatwave' THEN tmax_z WHEN 'cold_snap' THEN tmin_z ELSE prcp_z END AS z FROM (
    SELECT *, CASE WHEN tmax_z > 2.5 THEN 'heatwave' WHEN tmin_z < -2.5 THEN 'cold_snap'
      WHEN prcp_z > 2.5 THEN 'precip_extreme' END AS kind FROM (
      SELECT station_id, obs_date, {_z('tmax')}, {_z('tmin')}, {_z('prcp')} FROM ({_WIDE})
      WINDOW w AS (PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)))
  WHERE kind IS NOT NULL)"""


@query("str_detect", _DETECT, doubles="severity temp_deviation", dates="anomaly_date")
def _(v):
    path = folder(v, "wide")
    live.pivot(v.live_records, watermark=None).write.parquet(path)
    scored = _drain(v, live.score_stateful, "scores", table=v.spark.read.parquet(path), day="obs_date")
    return anomaly.recent_alerts(live.newest(scored, ["station_id", "obs_date"])).drop("description")


@query("str_detect_batch", """
SELECT station_id, obs_date AS anomaly_date, kind AS anomaly_type, least(abs(z) / 5, 1) AS severity, 1 AS duration_days,
  z AS temp_deviation FROM (SELECT *, CASE kind WHEN 'heatwave' THEN tmax_z WHEN 'cold_snap' THEN tmin_z ELSE prcp_z END AS z
  FROM (SELECT *, CASE WHEN tmax_z > 2.5 THEN 'heatwave' WHEN tmin_z < -2.5 THEN 'cold_snap'
      WHEN prcp_z > 2.5 THEN 'precip_extreme' END AS kind FROM (
    SELECT station_id, obs_date, (tmax - m1) / s1 AS tmax_z, (tmin - m2) / s2 AS tmin_z, (prcp - m3) / s3 AS prcp_z FROM (
      SELECT *, avg(tmax) OVER w AS m1, stddev_samp(tmax) OVER w AS s1, avg(tmin) OVER w AS m2, stddev_samp(tmin) OVER w AS s2,
        avg(prcp) OVER w AS m3, stddev_samp(prcp) OVER w AS s3 FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_date DESC) AS rn FROM obs) WHERE rn <= 365
      WINDOW w AS (PARTITION BY station_id)) WHERE rn = 1)) WHERE kind IS NOT NULL)""",
       doubles="severity temp_deviation", dates="anomaly_date")
def _(v):
    path = folder(v, "history")
    v.obs.write.parquet(path)

    def handle(out):
        return live.detect_batch(lambda: v.spark.read.parquet(path), live.store_batches(out))

    found = _drain(v, lambda s: s, "batch-alerts", table=v.spark.read.parquet(path), day="obs_date", handle=handle)
    return live.newest(found, ["station_id", "anomaly_date"]).drop("description")


@query("str_alerts", """
SELECT s.id AS subscription_id, a.id, a.station_id, a.anomaly_type, a.severity FROM served_anomalies a
JOIN subscriptions s ON a.station_id = s.station_id
WHERE (s.alert_type = 'any' OR s.alert_type = a.anomaly_type) AND a.severity >= s.min_severity""", doubles="severity")
def _(v):
    path = folder(v, "found")
    v.served_anomalies.select("id", "station_id", "anomaly_type", "severity", "anomaly_date").write.parquet(path)

    def build(stream):
        return live.alerts(stream, v.subscriptions).select("subscription_id", "id", "station_id", "anomaly_type", "severity")

    return _drain(v, build, "alerts", table=v.spark.read.parquet(path), day="anomaly_date", repeat=False).drop("batch")

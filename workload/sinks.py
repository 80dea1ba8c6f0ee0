"""Remaining sinks: plain and registered tables, serving shapes, a repeated live cycle."""

from __future__ import annotations

import uuid

from skyframe.operators import anomaly, islands, joins, trends
from skyframe.session import shared_dir
from skyframe.sources import lake
from skyframe.streaming import live
from workload.analytics import _EVENTS, _MONTHLY, _TREND, _TREND_COLUMNS
from workload.basics import folder, reloaded
from workload.registry import query
from workload.serving import _WIDE, _drain, _records
from workload.views import MIN_YEARS


@query("sink_plain", _EVENTS, doubles="peak_value mean_score", dates="start_date end_date")
def _(v):
    path = folder(v, "events")
    islands.events(v.features, "tmax_zscore_30d", 1.0).write.mode("overwrite").parquet(path)
    return v.spark.read.parquet(path)


@query("sink_table", "SELECT station_id, obs_date, tmax, CAST(year(obs_date) AS INTEGER) AS year FROM obs",
       doubles="tmax", dates="obs_date")
def _(v):
    name = f"observations_{uuid.uuid4().hex}"
    store = lake.Lake(v.spark, shared_dir(v.spark))
    store.write(v.placed.select("station_id", "obs_date", "tmax", "year"), "features", name, ["year"])
    for _ in range(2):  # registering again changes nothing
        store.register("features", name, name)
    return v.spark.table(name).select("station_id", "obs_date", "tmax", "year")


@query("sink_relational_trend_analysis", _TREND, doubles=_TREND_COLUMNS)
def _(v):
    return reloaded(v, trends.trend(v.obs, MIN_YEARS, digits=False), "trend_analysis")


@query("sink_relational_monthly_summary", f"""
SELECT s.* REPLACE (CAST(total_anomalies AS INTEGER) AS total_anomalies, CAST(heatwave_count AS INTEGER) AS heatwave_count,
  CAST(cold_snap_count AS INTEGER) AS cold_snap_count, CAST(precip_extreme_count AS INTEGER) AS precip_extreme_count),
  r.country AS top_region, g.global_temp_anomaly FROM ({_MONTHLY}) s
JOIN (SELECT year, month, country, row_number() OVER (PARTITION BY year, month ORDER BY count(*) DESC, country) AS rn
  FROM anomalies a JOIN stations t ON a.station_id = t.station_id GROUP BY 1, 2, 3) r
  ON r.year = s.year AND r.month = s.month AND rn = 1
LEFT JOIN (SELECT year, month, avg(temp_anomaly) AS global_temp_anomaly FROM month_grid GROUP BY 1, 2) g
  ON g.year = s.year AND g.month = s.month""", doubles="avg_severity global_temp_anomaly")
def _(v):
    placed = joins.with_stations(v.anomalies, v.stations.select("station_id", "country"))
    return reloaded(v, anomaly.monthly_with_region(placed, v.month_grid), "monthly_summary")


@query("str_cycle", _WIDE, doubles="tmax tmin prcp", dates="obs_date")
def _(v):
    """Cycles over one checkpoint with a stored table at their end: each revises and adds days,
    the last finds nothing new; every batch replaces its own rows when it is replayed."""
    records, path = _records(v), folder(v, "cycle-table")
    wide = _drain(v, lambda s: live.pivot(records(s)), "cycle", "update")
    live.newest(wide, ["station_id", "obs_date"]).write.mode("overwrite").parquet(path)
    return v.spark.read.parquet(path)

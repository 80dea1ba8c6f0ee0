"""Shapes of the serving tables and their distributed writers.

Each table is a declarative list of (output name, expression); publishing projects and
writes from the executors, nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Serving tables, output column -> Spark SQL expression over the lake table.
TABLES: dict[str, dict[str, str]] = {
    "stations": {
        "id": "station_id", "name": "coalesce(name, '')", "latitude": "latitude",
        "longitude": "longitude", "elevation": "elevation", "country": "coalesce(country, '')",
        "state": "coalesce(state, '')", "geohash": "geohash", "first_year": "cast(null as int)",
        "last_year": "cast(null as int)", "record_count": "cast(0 as bigint)"},
    "observations": {
        "station_id": "station_id", "obs_date": "obs_date", "tmax": "tmax", "tmin": "tmin",
        "prcp": "prcp", "snow": "snow", "snwd": "snwd", "tavg": "coalesce(tavg, (tmax + tmin) / 2)",
        "tmax_rolling_30d": "tmax_rolling_30d_mean", "tmin_rolling_30d": "tmin_rolling_30d_mean",
        "prcp_rolling_30d": "prcp_rolling_30d_mean", "tmax_rolling_365d": "tmax_rolling_365d_mean",
        "tmin_rolling_365d": "tmin_rolling_365d_mean", "prcp_rolling_365d": "prcp_rolling_365d_mean",
        "tmax_stddev_30d": "tmax_rolling_30d_std", "tmin_stddev_30d": "tmin_rolling_30d_std",
        "prcp_stddev_30d": "prcp_rolling_30d_std"},
    "anomalies": {
        "id": "concat(station_id, '-', cast(obs_date as string))", "station_id": "station_id",
        "anomaly_date": "obs_date", "anomaly_type": "anomaly_type", "severity": "severity",
        "duration_days": "coalesce(duration_days, 1)", "temp_deviation": "temp_deviation",
        "precip_deviation": "precip_deviation", "description": "coalesce(description, '')",
        "latitude": "coalesce(latitude, 0D)", "longitude": "coalesce(longitude, 0D)"},
    "forecasts": {c: c for c in (
        "station_id", "forecast_date", "variable", "predicted_value", "lower_bound", "upper_bound",
        "model_type", "model_version", "mae", "rmse")},
    "anomaly_tiles": {
        "geohash": "geohash_prefix", "tile_date": "make_date(year, coalesce(month, 1), 1)",
        "anomaly_count": "cast(coalesce(anomaly_count, 0) as int)",
        "avg_severity": "coalesce(avg_severity, 0D)", "dominant_type": "coalesce(dominant_type, '')",
        "heatwave_count": "cast(coalesce(heatwave_count, 0) as int)",
        "cold_snap_count": "cast(coalesce(cold_snap_count, 0) as int)",
        "precip_extreme_count": "cast(coalesce(precip_extreme_count, 0) as int)",
        "center_lat": "coalesce(center_lat, 0D)", "center_lon": "coalesce(center_lon, 0D)"},
    "monthly_summary": {
        "year": "year", "month": "month", "total_anomalies": "cast(total_anomalies as int)",
        "heatwave_count": "cast(heatwave_count as int)", "cold_snap_count": "cast(cold_snap_count as int)",
        "precip_extreme_count": "cast(precip_extreme_count as int)", "avg_severity": "avg_severity",
        "top_region": "top_region", "global_temp_anomaly": "global_temp_anomaly"},
    "climate_indices": {c: c for c in ("index_date", "index_name", "value", "anomaly", "source")},
    "extreme_value_stats": {c: c for c in (
        "station_id", "variable", "distribution", "return_period", "return_level", "lower_ci",
        "upper_ci", "shape_param", "location_param", "scale_param", "n_years")},
    "trend_analysis": {
        **{c: c for c in (
            "station_id", "variable", "period_start", "period_end", "trend_direction", "sens_slope",
            "p_value", "z_statistic", "tau", "slope_per_decade", "ci_lower", "ci_upper")},
        "significant": "coalesce(significant, false)"},
    "climate_projections": {
        **{c: c for c in (
            "station_id", "projection_date", "scenario", "variable", "predicted_value", "lower_bound",
            "upper_bound", "model_name", "ensemble_size")},
        "bias_corrected": "coalesce(bias_corrected, false)"},
}


def with_statistics(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Stations with the first and last year and the number of their daily rows."""
    spans = observations.groupBy("station_id").agg(
        F.year(F.min("obs_date")).alias("first_year"), F.year(F.max("obs_date")).alias("last_year"),
        F.count(F.lit(1)).alias("record_count"))
    return stations.join(spans, "station_id", "left")


def shape(df: DataFrame, table: str) -> DataFrame:
    """The serving columns of a table; statistics that the input carries are published."""
    known = {c: f"coalesce({c}, 0)" if c == "record_count" else c
             for c in ("first_year", "last_year", "record_count") if table == "stations" and c in df.columns}
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in {**TABLES[table], **known}.items()])


def to_parquet(df: DataFrame, table: str, root: str) -> None:
    """Replace the serving table stored as Parquet under ``root``."""
    shape(df, table).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{table}")


def to_jdbc(df: DataFrame, table: str, url: str, properties: dict[str, str], connections: int = 16) -> None:
    """Truncate and reload a database table from the executors, in batches over a bounded
    number of connections; the rows are shuffled into that many tasks, so that the work
    before keeps its own."""
    (shape(df, table).repartition(connections).write.mode("overwrite")
     .option("truncate", "true").option("batchsize", "5000")
     .jdbc(url, table, properties=properties))

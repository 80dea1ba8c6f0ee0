"""The read-side queries as parameterised DataFrame functions.

Tables carry the serving names: stations(id, ...), anomalies(id, station_id,
anomaly_date, ...), observations, tiles, monthly_summary, forecasts, indices, trends,
return levels, projections, annotations, users. Filters stay on plain columns so they
reach the scan; ordered reads use limit, which Spark runs as a distributed top-k.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions import geo, scores, units
from skyframe.operators import daily as daily_ops
from skyframe.operators.joins import lookup_join

WORLD = geo.Box(-90, 90, -180, 180)

# Descriptions of the index series and of the scenarios.
INDEX_NAMES = ["oni", "nao", "pdo", "amo", "iod"]

ANOMALY_COLUMNS = ["id", "station_id", "anomaly_date", "anomaly_type", "severity", "duration_days",
                   "temp_deviation", "precip_deviation", "description"]
STATION_COLUMNS = ["id", "name", "latitude", "longitude", "elevation", "country", "state", "geohash",
                   "first_year", "last_year", "record_count"]
SERIES_COLUMNS = ["tmax", "tmin", "prcp", "tavg", "tmax_rolling_30d", "tmin_rolling_30d",
                  "prcp_rolling_30d"]


def matching(**equal: str | None) -> Column:
    """Conjunction of the optional equality filters that were given."""
    given = [F.col(name) == value for name, value in equal.items() if value is not None]
    return reduce(and_, given, F.lit(True))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive containment of a literal text."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def latest(df: DataFrame, key: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each key, all rows without a limit. The rank filter also
    runs before the shuffle, so a hot key sends at most ``limit`` rows per input partition."""
    if limit is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def anomalies_on_map(anomalies: DataFrame, stations: DataFrame, box: geo.Box = WORLD,
                     start: str | None = None, end: str | None = None,
                     anomaly_type: str | None = None, min_severity: float = 0.0) -> DataFrame:
    """Anomalies with their station's place, filtered on both sides before the join."""
    wanted = anomalies.where(
        units.within(F.col("anomaly_date"), start, end) & (F.col("severity") >= min_severity)
        & matching(anomaly_type=anomaly_type)).select(*ANOMALY_COLUMNS)
    places = stations.where(geo.in_box(F.col("latitude"), F.col("longitude"), box)).select(
        F.col("id").alias("station_id"), "latitude", "longitude",
        F.col("name").alias("station_name"), "country")
    return lookup_join(wanted, places, ["station_id"], "inner")


def get_anomalies(anomalies: DataFrame, stations: DataFrame, limit: int = 1000, **filters) -> DataFrame:
    """Strongest anomalies first, then newest, then by id."""
    return anomalies_on_map(anomalies, stations, **filters).orderBy(
        F.col("severity").desc(), F.col("anomaly_date").desc(), "id").limit(limit)


def list_stations(stations: DataFrame, country: str | None = None, search: str | None = None,
                  box: geo.Box = WORLD, limit: int = 500) -> DataFrame:
    """Stations by number of records, filtered by country, text and box."""
    condition = geo.in_box(F.col("latitude"), F.col("longitude"), box) & matching(country=country)
    if search:
        condition = condition & (contains(F.col("name"), search) | contains(F.col("id"), search))
    return stations.where(condition).select(*STATION_COLUMNS).orderBy(
        F.col("record_count").desc(), "id").limit(limit)


def station_details(stations: DataFrame, anomalies: DataFrame, station_id: str | None = None,
                    recent: int = 50) -> DataFrame:
    """Stations with their newest anomalies nested, newest first: at most ``recent``
    entries each. Without ``station_id`` all stations are answered at once."""
    chosen = stations.where(matching(id=station_id)).select(*STATION_COLUMNS)
    newest = latest(anomalies.where(matching(station_id=station_id)), ["station_id"],
                    [F.col("anomaly_date").desc(), F.col("id")], recent)
    entry = F.struct(
        (-units.epoch_day(F.col("anomaly_date"))).alias("order"), "id",
        F.col("anomaly_date").cast("string").alias("anomaly_date"), "anomaly_type", "severity",
        "duration_days", "temp_deviation", "precip_deviation", "description")
    nested = newest.groupBy(F.col("station_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.dropFields("order"))
        .alias("recent_anomalies"))
    return chosen.join(nested, "id", "left").withColumn(
        "recent_anomalies", F.coalesce("recent_anomalies", F.array()))


def timeseries(observations: DataFrame, station_id: str | None = None, start: str | None = None,
               end: str | None = None, resolution: str = "daily", limit: int | None = None) -> DataFrame:
    """All or the newest ``limit`` points of a station's series, per day, month or year (per
    station when none is named): temperatures are averaged, precipitation is summed."""
    chosen = observations.where(matching(station_id=station_id) & units.within(F.col("obs_date"), start, end))
    if resolution != "daily":
        means = [c for c in SERIES_COLUMNS if c != "prcp"]
        chosen = daily_ops.resample(chosen, resolution, means, ["prcp"])
    return latest(chosen.select("station_id", "obs_date", *SERIES_COLUMNS), ["station_id"],
                  [F.col("obs_date").desc()], limit)


def get_tiles(tiles: DataFrame, start: str | None = None, end: str | None = None,
              anomaly_type: str | None = None) -> DataFrame:
    """Heat-map cells re-aggregated over time; empty cells are left out.

    A cell is its geohash: its centre in a month depends on where the month's anomalies
    lay, so centres are averaged, weighted by the number of anomalies."""
    counts = ["heatwave_count", "cold_snap_count", "precip_extreme_count"]
    wanted = tiles.where(units.within(F.col("tile_date"), start, end) & matching(dominant_type=anomaly_type))
    weight = F.col("anomaly_count")
    return (wanted.groupBy("geohash").agg(
        *[(F.sum(F.col(c) * weight) / F.nullif(F.sum(weight), F.lit(0))).alias(c) for c in ("center_lat", "center_lon")],
        F.sum("anomaly_count").alias("total_anomalies"), F.avg("avg_severity").alias("avg_severity"),
        *[F.sum(c).alias(c) for c in counts]).where("total_anomalies > 0")
        .orderBy(F.col("total_anomalies").desc(), "geohash"))


def dashboard(anomalies: DataFrame, stations: DataFrame) -> DataFrame:
    """All headline numbers in one row: both tables are counted in one aggregation
    over their union, not in six scalar queries."""
    both = anomalies.select("anomaly_type", "severity", F.lit(0).alias("is_station")).unionByName(
        stations.select(F.lit(None).cast("string").alias("anomaly_type"),
                        F.lit(None).cast("double").alias("severity"), F.lit(1).alias("is_station")))
    kinds = ["heatwave", "cold_snap", "precip_extreme"]
    return both.agg(
        F.count_if(F.col("is_station") == 1).alias("total_stations"),
        F.count_if(F.col("is_station") == 0).alias("total_anomalies"),
        *[F.count_if(F.col("anomaly_type") == k).alias(f"{k}_count") for k in kinds],
        F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"))


def region_counts(anomalies: DataFrame, stations: DataFrame) -> DataFrame:
    """Anomalies per country. Events are counted per station before the join, so the
    join sees one row per station however many events it has."""
    per_station = anomalies.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("severity").alias("severity_sum"))
    places = stations.where("country is not null").select(F.col("id").alias("station_id"), "country")
    return lookup_join(per_station, places, ["station_id"], "inner").groupBy("country").agg(
        F.sum("n").alias("anomaly_count"),
        (F.sum("severity_sum") / F.sum("n")).alias("avg_severity"))


def top_regions(anomalies: DataFrame, stations: DataFrame, limit: int = 10) -> DataFrame:
    return region_counts(anomalies, stations).orderBy(F.col("anomaly_count").desc(), "country").limit(limit)


def region_shares(regions: DataFrame) -> DataFrame:
    """Each region's count relative to the largest and to the total; one row per country."""
    everything = Window.partitionBy(F.lit(1))
    n = F.col("anomaly_count")
    return regions.select("country", "anomaly_count",
                          (n / F.max(n).over(everything)).alias("relative"),
                          (n / F.sum(n).over(everything)).alias("share"))


def monthly_trend(monthly_summary: DataFrame, limit: int = 120) -> DataFrame:
    """Newest months, oldest first."""
    newest = monthly_summary.orderBy(F.col("year").desc(), F.col("month").desc()).limit(limit)
    return newest.orderBy("year", "month")


def nest_by_variable(rows: DataFrame, keys: list[str], point: list[str], alias: str) -> DataFrame:
    """One JSON document per key: {variable: [points in order]}. Used on tables whose
    points per key are fixed by the horizon or the list of return periods."""
    entry = F.struct(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c)
                       for c, kind in rows.select(*point).dtypes])
    lists = rows.groupBy(*keys, "variable").agg(F.sort_array(F.collect_list(entry)).alias("points"))
    pairs = F.sort_array(F.collect_list(F.struct("variable", "points")))
    return lists.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias(alias))


def station_forecast(forecasts: DataFrame, station_id: str | None = None, variable: str | None = None,
                     model_type: str | None = None) -> DataFrame:
    wanted = forecasts.where(matching(station_id=station_id, variable=variable, model_type=model_type))
    return nest_by_variable(wanted, ["station_id"], [
        "forecast_date", "predicted_value", "lower_bound", "upper_bound", "model_type",
        "model_version"], "forecasts")


def list_indices(indices: DataFrame) -> DataFrame:
    """Latest value per index."""
    newest = F.max_by(F.struct("value", "index_date", "source"), F.col("index_date")).alias("row")
    return indices.groupBy("index_name").agg(newest).select(
        "index_name", F.col("row.value").alias("latest_value"),
        F.col("row.index_date").alias("latest_date"), "row.source")


def index_series(indices: DataFrame, name: str, start: str | None = None, end: str | None = None,
                 limit: int = 600) -> DataFrame:
    """Newest points of one index (any letter case), oldest first."""
    if name.lower() not in INDEX_NAMES:
        raise ValueError(f"unknown index: {name}")
    condition = F.lower("index_name") == name.lower()
    if start:
        condition = condition & (F.col("index_date") >= F.lit(start).cast("date"))
    if end:
        condition = condition & (F.col("index_date") <= F.lit(end).cast("date"))
    newest = indices.where(condition).orderBy(F.col("index_date").desc()).limit(limit)
    return newest.orderBy("index_date").select("index_date", "value", "anomaly")


def station_trends(trends: DataFrame, station_id: str | None = None, variable: str | None = None) -> DataFrame:
    return trends.where(matching(station_id=station_id, variable=variable)).orderBy("station_id", "variable")


def station_extremes(levels: DataFrame, station_id: str | None = None, variable: str | None = None) -> DataFrame:
    """Fitted parameters with the return levels nested, per station and variable."""
    wanted = levels.where(matching(station_id=station_id, variable=variable))
    entry = F.struct("return_period", "return_level", "lower_ci", "upper_ci")
    return wanted.groupBy("station_id", "variable").agg(
        *[F.max(c).alias(c) for c in ("distribution", "shape_param", "location_param", "scale_param", "n_years")],
        F.to_json(F.sort_array(F.collect_list(entry))).alias("return_levels"))


def station_projections(projections: DataFrame, scenario: str = "ssp245", station_id: str | None = None,
                        variable: str | None = None) -> DataFrame:
    wanted = projections.where(matching(scenario=scenario, station_id=station_id, variable=variable))
    return nest_by_variable(wanted, ["station_id", "scenario"], [
        "projection_date", "predicted_value", "lower_bound", "upper_bound", "model_name"], "projections")


def list_scenarios(projections: DataFrame) -> DataFrame:
    """Stations, points and period per scenario. Points are counted per station first,
    which also makes the distinct count a plain one."""
    per_station = projections.groupBy("scenario", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("projection_date").alias("first"),
        F.max("projection_date").alias("last"))
    return per_station.groupBy("scenario").agg(
        F.count("station_id").alias("station_count"), F.sum("n").alias("total_points"),
        F.min("first").alias("start_date"), F.max("last").alias("end_date")).orderBy("scenario")


def wind_grid(grid: DataFrame, box: geo.Box = WORLD, resolution: int = 10) -> DataFrame:
    """Mean wind vector of the grid points in each of resolution x resolution cells;
    points on the upper edge belong to the last cell."""
    lat_step = (box.max_lat - box.min_lat) / resolution
    lon_step = (box.max_lon - box.min_lon) / resolution

    def cell(value: Column, low: float, step: float) -> Column:
        return F.least(F.floor((value - F.lit(float(low))) / F.lit(step)), F.lit(resolution - 1))

    cells = grid.where(geo.in_box(F.col("latitude"), F.col("longitude"), box)).groupBy(
        cell(F.col("latitude"), box.min_lat, lat_step).alias("i"),
        cell(F.col("longitude"), box.min_lon, lon_step).alias("j")).agg(
            F.avg("u10").alias("u"), F.avg("v10").alias("v"))
    return cells.select(
        ((F.col("i") + 0.5) * lat_step + float(box.min_lat)).alias("lat"),
        ((F.col("j") + 0.5) * lon_step + float(box.min_lon)).alias("lon"), "u", "v",
        units.wind_speed(F.col("u"), F.col("v")).alias("speed"),
        units.wind_direction(F.col("u"), F.col("v")).alias("direction"))


def export_timeseries(observations: DataFrame, station_id: str | None = None, start: str | None = None,
                      end: str | None = None, limit: int | None = None) -> DataFrame:
    """Flat series for export: all days, or the oldest ``limit`` of each station."""
    chosen = observations.where(matching(station_id=station_id) & units.within(F.col("obs_date"), start, end))
    columns = ["station_id", "obs_date", "tmax", "tmin", "prcp", "snow", "snwd", "tavg",
               "tmax_rolling_30d", "tmin_rolling_30d", "prcp_rolling_30d",
               "tmax_rolling_365d", "tmin_rolling_365d", "prcp_rolling_365d",
               "tmax_stddev_30d", "tmin_stddev_30d", "prcp_stddev_30d"]
    return latest(chosen.select(*columns), ["station_id"], [F.col("obs_date")], limit)


def export_anomalies(anomalies: DataFrame, stations: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Flat anomalies with their station: all, or the newest ``limit`` first."""
    rows = anomalies_on_map(anomalies, stations, **filters)
    if limit is not None:
        rows = rows.orderBy(F.col("anomaly_date").desc(), "id").limit(limit)
    return rows.select(
        "station_id", "station_name", "country", "latitude", "longitude", "anomaly_date", "anomaly_type",
        "severity", "duration_days", "temp_deviation", "precip_deviation", "description")


def station_annotations(annotations: DataFrame, users: DataFrame, station_id: str | None = None,
                        limit: int = 100) -> DataFrame:
    """Newest annotations per station with the author's name, or 'anonymous'."""
    newest = latest(annotations.where(matching(station_id=station_id)), ["station_id"],
                    [F.col("annotation_date").desc(), F.col("created_at").desc(), F.col("id")], limit)
    named = lookup_join(newest, users.select(F.col("id").alias("user_id"), "username"), ["user_id"], "left")
    return named.select("id", "station_id", F.coalesce("username", F.lit("anonymous")).alias("author"),
                        "annotation_date", "note", "category", "created_at")


def stripes(daily: DataFrame) -> DataFrame:
    """Yearly means per station with their colour class between the station's extremes."""
    yearly = daily.groupBy("station_id", F.year("obs_date").alias("year")).agg(
        F.avg(F.coalesce("tmax", "tavg")).alias("value")).where("value is not null")
    station = Window.partitionBy("station_id")
    return yearly.withColumn("color_bin", scores.color_bin(
        F.col("value"), F.min("value").over(station), F.max("value").over(station)))


def scenario_pivot(projections: DataFrame, variable: str, scenarios: list[str]) -> DataFrame:
    """Per station and year one column triple per scenario, from the year's last row."""
    wanted = projections.where((F.col("variable") == variable) & F.col("scenario").isin(scenarios))
    names = {"val": "predicted_value", "upper": "upper_bound", "lower": "lower_bound"}
    return wanted.groupBy("station_id", F.year("projection_date").alias("year")).agg(*[
        F.max_by(F.when(F.col("scenario") == s, F.col(c)),
                 F.when(F.col("scenario") == s, F.col("projection_date"))).alias(f"{s}_{short}")
        for s in scenarios for short, c in names.items()])


def geojson(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON point feature per row (newline-delimited when written as text)."""
    values = [F.col(c).cast("string").alias(c) if kind == "date" else F.col(c)
              for c, kind in rows.select(*properties).dtypes]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*values).alias("properties"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))

"""Sources, scalar expressions, filters and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyframe import schemas
from skyframe.functions import geo, scores, units
from skyframe.operators import daily, joins, lookback, rolling
from skyframe.plans import serve
from skyframe.session import shared_dir
from skyframe.sources import lake, readers
from skyframe.sources.reload import Serving
from workload.registry import query
from workload.views import Views, geohash_sql

BOX = geo.Box(-40, 40, -120, 60)
PACIFIC = geo.Box(20, 60, 120, 260, wrap=True)


def folder(v: Views, name: str) -> str:
    """A fresh path in the shared folder for one run of a sink query."""
    return f"{shared_dir(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks -------------------------------------------------------------

@query("src_fixed", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS station_id, round(-60 + (s_suppkey % 49) * 2.5, 4)::DOUBLE AS latitude,
  round(-180 + (s_suppkey * 7 % 143) * 2.5, 4)::DOUBLE AS longitude, ((s_suppkey % 400) * 10)::DOUBLE AS elevation,
  upper(chr(CAST(65 + s_nationkey AS INTEGER)) || 'X') AS state, s_name AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'GSN' ELSE '' END AS gsn_flag, '' AS hcn_flag, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS wmo_id
FROM supplier""", doubles="latitude longitude elevation")
def _(v: Views):
    key = F.col("s_suppkey")
    line = F.format_string(
        "%011d %8.4f %9.4f %6.1f %2s %-30s %-3s %3s %05d", key,
        key % 49 * 2.5 - 60.0, key * 7 % 143 * 2.5 - 180.0, key % 400 * 10.0,
        F.concat(F.char(F.lit(65) + F.col("s_nationkey")), F.lit("X")), F.col("s_name"),
        F.when(key % 3 == 0, "GSN").otherwise(""), F.lit(""), F.col("s_nationkey"))
    padded = F.concat(F.substring(line, 1, 71), F.lit(" "), F.substring(line, 73, 20))
    return readers.fixed_width(v.table("supplier").select(padded.alias("value")), schemas.STATION_LAYOUT)


@query("src_parquet", "SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_quantity > 45",
       doubles="l_extendedprice")
def _(v):
    return v.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey", "l_extendedprice")


@query("src_csv_long", """
SELECT station_id, obs_date, element, value, coalesce(q_flag, '') AS q_flag FROM obs_long""", doubles="value")
def _(v):
    path = folder(v, "long")
    nothing = F.lit(None).cast("string")
    v.obs_long.select("station_id", "obs_date", "element", "value", nothing.alias("m"), "q_flag",
                      nothing.alias("s"), nothing.alias("t")).write.csv(path)
    back = readers.long_observations(v.spark, path)
    # A CSV cannot tell an empty flag from a missing one.
    return back.select("station_id", "obs_date", "element", "value",
                       F.coalesce("q_flag", F.lit("")).alias("q_flag"))


@query("src_csv_grid", "SELECT latitude, longitude, CAST(time AS VARCHAR) AS time, t2m, sp FROM raw_grid",
       doubles="latitude longitude t2m sp")
def _(v):
    path = folder(v, "grid")
    v.raw_grid.write.csv(path, header=True)
    return readers.grid(v.spark, path).select("latitude", "longitude", "time", "t2m", "sp")


@query("src_csv_monthgrid", "SELECT year, month, latitude, longitude, temp_anomaly FROM month_grid",
       doubles="latitude longitude temp_anomaly")
def _(v):
    path = folder(v, "monthgrid")
    v.raw_month_grid.write.csv(path, header=True)
    return readers.month_grid(v.spark, path)


@query("src_optional", "SELECT station_id, obs_date, tmax, CAST(NULL AS DOUBLE) AS tmax_residual FROM obs",
       doubles="tmax tmax_residual", dates="obs_date")
def _(v):
    missing = readers.optional_parquet(v.spark, f"{shared_dir(v.spark)}/never-written")
    return joins.with_optional(v.obs.select("station_id", "obs_date", "tmax"), missing,
                               ["station_id", "obs_date"], {"tmax_residual": "double"})


@query("sink_partitioned", "SELECT station_id, obs_date, tmax, tmin, geohash_prefix, year FROM placed",
       doubles="tmax tmin", dates="obs_date")
def _(v):
    path = folder(v, "observations")
    rows = v.placed.select("station_id", "obs_date", "tmax", "tmin", "geohash_prefix", "year")
    lake.partitioned(rows, path, ["year"], sort=["geohash_prefix", "station_id", "obs_date"])
    return v.spark.read.schema(rows.schema).parquet(path)


@query("sink_part_by_value", "SELECT index_name, index_date, value, source FROM index_series",
       doubles="value", dates="index_date")
def _(v):
    path = folder(v, "indices")
    lake.partitioned(v.index_series, path, ["index_name"])
    return v.spark.read.parquet(path).select("index_name", "index_date", "value", "source")


@query("sink_append", """
SELECT model_type, station_id, count(*) AS points FROM (SELECT model_type, station_id FROM forecasts
  UNION ALL SELECT model_type, station_id FROM row_forecasts) GROUP BY 1, 2""")
def _(v):
    path = folder(v, "forecasts")
    for rows in (v.forecasts, v.row_forecasts):
        rows.select("station_id", "model_type", "predicted_value").write.mode("append").partitionBy(
            "model_type").parquet(path)
    return v.spark.read.parquet(path).groupBy("model_type", "station_id").agg(F.count(F.lit(1)).alias("points"))


@query("sink_csv", "SELECT station_id, obs_date, tmax, tmin FROM obs", doubles="tmax tmin", dates="obs_date")
def _(v):
    path = folder(v, "csv")
    lake.write_csv(v.obs.select("station_id", "obs_date", "tmax", "tmin"), path)
    return v.spark.read.schema("station_id string, obs_date date, tmax double, tmin double").csv(path, header=True)


@query("sink_json", "SELECT station_id, obs_date, prcp FROM obs", doubles="prcp", dates="obs_date")
def _(v):
    path = folder(v, "json")
    lake.write_json(v.obs.select("station_id", "obs_date", "prcp"), path)
    return v.spark.read.schema("station_id string, obs_date date, prcp double").json(path)


@query("sink_geojson", """
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":['
  || CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR) || ']},"properties":{"station_id":"'
  || s.id || '","country":"' || country || '","anomaly_date":"' || CAST(anomaly_date AS VARCHAR)
  || '","anomaly_type":"' || anomaly_type || '","duration_days":' || duration_days || '}}' AS value
FROM (SELECT station_id, anomaly_date, anomaly_type, duration_days FROM served_anomalies) a
JOIN served_stations s ON a.station_id = s.id""")
def _(v):
    rows = serve.anomalies_on_map(v.served_anomalies, v.served_stations)
    return serve.geojson(rows, ["station_id", "country", "anomaly_date", "anomaly_type", "duration_days"])


@query("sink_upsert", f"""
SELECT id, CASE WHEN k % 3 = 0 THEN name || ' (new)' ELSE name END AS name,
  CASE WHEN k % 3 = 0 THEN elevation + 1 ELSE elevation END AS elevation
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM served_stations)""", doubles="elevation")
def _(v):
    current = v.served_stations.select("id", "name", "elevation")
    incoming = current.where(F.substring("id", 3, 20).cast("long") % 3 == 0).withColumns({
        "name": F.concat("name", F.lit(" (new)")), "elevation": F.col("elevation") + 1})
    return daily.upsert(current, incoming, "id")


_SAMPLE = """
SELECT * FROM obs WHERE CAST('0x' || substr(md5(station_id || '|' || CAST(CAST(obs_date AS DATE) AS VARCHAR)), 1, 12) AS BIGINT) < {} * 281474976710656"""
_SAMPLED = "tmax tmin prcp snow snwd tavg"


@query("sample", _SAMPLE.format(0.02), doubles=_SAMPLED, dates="obs_date")
def _(v):
    return daily.hash_sample(v.obs, ["station_id", "obs_date"], 0.02)


@query("sample_half", _SAMPLE.format(0.5), doubles=_SAMPLED, dates="obs_date")
def _(v):
    return daily.hash_sample(v.obs, ["station_id", "obs_date"], 0.5)


_SERVED = {
    "stations": (lambda v: v.stations, """
SELECT station_id AS id, name, latitude, longitude, elevation, country, state, geohash,
  CAST(NULL AS INTEGER) AS first_year, CAST(NULL AS INTEGER) AS last_year, CAST(0 AS BIGINT) AS record_count
FROM stations""", "latitude longitude elevation", ""),
    "anomalies": (lambda v: v.anomalies, "SELECT * EXCLUDE (description) FROM served_anomalies",
                  "severity temp_deviation precip_deviation latitude longitude", "anomaly_date"),
    "forecasts": (lambda v: v.forecasts, "SELECT * FROM forecasts",
                  "predicted_value lower_bound upper_bound mae rmse", "forecast_date"),
    "anomaly_tiles": (lambda v: v.tiles, "SELECT * FROM served_tiles",
                      "avg_severity center_lat center_lon", "tile_date"),
    "climate_indices": (lambda v: v.index_series, "SELECT * FROM index_series", "value anomaly", "index_date"),
    "extreme_value_stats": (lambda v: v.levels, "SELECT * FROM levels",
                            "return_level lower_ci upper_ci shape_param location_param scale_param", ""),
    "climate_projections": (lambda v: v.projections, "SELECT * FROM projections",
                            "predicted_value lower_bound upper_bound", "projection_date"),
}
def part(df):
    """About a third of the rows, whole stations where there are any: that choice reaches the scan, so that nothing is worked
    out for rows that are then left out."""
    keys = ["station_id"] if "station_id" in df.columns else df.columns
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(3)) == 0)


def reloaded(v, df, table):
    """The table as two reloads and a replay of the second leave it: the first load held a part of the rows."""
    serving = Serving(v.spark, folder(v, "served"))
    serving.reload(part(df), table, "first")
    for _ in range(2):
        serving.reload(df, table, "second")
    return serving.read(table)


for _name, (_source, _sql, _doubles, _dates) in _SERVED.items():
    def _publish(v, table=_name, source=_source):
        stored = reloaded(v, source(v), table)
        return stored.drop("description") if table == "anomalies" else stored
    query(f"sink_relational_{_name}", _sql, _doubles, _dates)(_publish)


@query("sink_relational_observations", "SELECT * FROM served_observations", doubles=(
    "tmax tmin prcp snow snwd tavg tmax_rolling_30d tmin_rolling_30d prcp_rolling_30d tmax_rolling_365d "
    "tmin_rolling_365d prcp_rolling_365d tmax_stddev_30d tmin_stddev_30d prcp_stddev_30d"), dates="obs_date")
def _(v):
    short = rolling.rolling(v.obs, {30: {x: ["mean", "std"] for x in schemas.VARIABLES}})
    return reloaded(v, lookback.means(short, 365, schemas.VARIABLES), "observations")


# ---- scalar expressions ------------------------------------------------------------

@query("proj_units_obs", """
SELECT station_id, strptime(obs_date, '%Y%m%d') AS obs_date, element,
  CASE WHEN element IN ('TMAX', 'TMIN', 'TAVG', 'PRCP') THEN value / 10 ELSE value END AS value
FROM obs_long WHERE q_flag IS NULL OR q_flag = ''""", doubles="value", dates="obs_date")
def _(v):
    return daily.clean_long(v.obs_long)


@query("filter_qflag", "SELECT element, count(*) AS n FROM obs_long WHERE q_flag IS NULL OR q_flag = '' GROUP BY 1")
def _(v):
    return v.obs_long.where(daily.passes_quality(F.col("q_flag"))).groupBy("element").agg(
        F.count(F.lit(1)).alias("n"))


@query("proj_units_grid", "SELECT latitude, longitude, obs_date, temp_2m_c, precip_mm, pressure_hpa FROM grid",
       doubles="latitude longitude temp_2m_c precip_mm pressure_hpa", dates="obs_date")
def _(v):
    return v.grid.select("latitude", "longitude", "obs_date", "temp_2m_c", "precip_mm", "pressure_hpa")


@query("proj_wind", """
SELECT round(u10, 6) AS u10, round(v10, 6) AS v10, sqrt(u10 * u10 + v10 * v10) AS speed,
  CASE WHEN d < 0 THEN d + 360 ELSE d END AS direction, n FROM (
  SELECT u10, v10, degrees(atan2(v10, u10)) AS d, n FROM (
    SELECT round(u10, 6) + 0.0 AS u10, round(v10, 6) + 0.0 AS v10, count(*) AS n FROM raw_grid GROUP BY 1, 2))""",
       doubles="u10 v10 speed direction")
def _(v):
    u, w = (F.round(c, 6) + 0.0 for c in ("u10", "v10"))
    return v.raw_grid.groupBy(u.alias("u10"), w.alias("v10")).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "speed": units.wind_speed(F.col("u10"), F.col("v10")),
        "direction": units.wind_direction(F.col("u10"), F.col("v10"))})


@query("proj_date", """
SELECT DISTINCT CAST(strptime(obs_date, '%Y%m%d') AS DATE) AS day,
  make_date(CAST(substr(obs_date, 1, 4) AS INTEGER), CAST(substr(obs_date, 5, 2) AS INTEGER), 1) AS month_day
FROM obs_long""", dates="day month_day")
def _(v):
    d = F.col("obs_date")
    return v.obs_long.select(F.to_date(d, "yyyyMMdd").alias("day"), F.make_date(
        F.substring(d, 1, 4).cast("int"), F.substring(d, 5, 2).cast("int"), F.lit(1)).alias("month_day")).distinct()


@query("proj_dateparts", """
SELECT DISTINCT obs_date, CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month,
  CAST(dayofyear(obs_date) AS INTEGER) AS doy, date_trunc('month', obs_date) AS month_day,
  date_trunc('year', obs_date) AS year_day, CAST(year(obs_date) // 10 * 10 AS INTEGER) AS decade FROM obs""",
       dates="obs_date month_day year_day")
def _(v):
    d = F.col("obs_date")
    return v.obs.select(d, F.year(d).alias("year"), F.month(d).alias("month"), F.dayofyear(d).alias("doy"),
                        units.month_start(d).alias("month_day"), F.trunc(d, "year").alias("year_day"),
                        units.decade(F.year(d)).alias("decade")).distinct()


@query("proj_country", "SELECT substr(station_id, 1, 2) AS country, count(*) AS n FROM obs GROUP BY 1")
def _(v):
    return v.obs.groupBy(F.substring("station_id", 1, 2).alias("country")).agg(F.count(F.lit(1)).alias("n"))


@query("geo_encode", f"""
SELECT lat, lon, {geohash_sql('lat', 'lon', 7)} AS g7, {geohash_sql('lat', 'lon', 5)} AS g5,
  {geohash_sql('lat', 'lon', 4)} AS g4 FROM (
  SELECT l_orderkey % 18000 / 100 - 90 AS lat, l_partkey * 37 % 36000 / 100 - 180 AS lon FROM lineitem)""",
       doubles="lat lon")
def _(v):
    points = v.table("lineitem").select((F.col("l_orderkey") % 18000 / 100 - 90).alias("lat"),
                                        (F.col("l_partkey") * 37 % 36000 / 100 - 180).alias("lon"))
    return points.select("lat", "lon", *[
        geo.geohash(F.col("lat"), F.col("lon"), p).alias(f"g{p}") for p in (7, 5, 4)])


@query("geo_prefix", """
SELECT substr(geohash, 1, 4) AS p4, substr(geohash, 1, 3) AS p3, count(*) AS n FROM grid GROUP BY 1, 2""")
def _(v):
    g = F.col("geohash")
    return v.grid.groupBy(geo.prefix(g, 4).alias("p4"), geo.prefix(g, 3).alias("p3")).agg(F.count(F.lit(1)).alias("n"))


@query("geo_bbox", f"""
SELECT latitude, longitude, count(*) AS n FROM grid WHERE latitude BETWEEN {BOX.min_lat} AND {BOX.max_lat}
  AND longitude BETWEEN {BOX.min_lon} AND {BOX.max_lon} GROUP BY 1, 2""", doubles="latitude longitude")
def _(v):
    inside = geo.in_box(F.col("latitude"), F.col("longitude"), BOX)
    return v.raw_grid.where(inside).groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))


@query("geo_lonwrap", """
SELECT lon360, count(*) AS n FROM (SELECT latitude, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END
  AS lon360 FROM raw_grid) WHERE latitude BETWEEN 20 AND 60 AND lon360 BETWEEN 120 AND 260 GROUP BY 1""",
       doubles="lon360")
def _(v):
    return v.raw_grid.where(geo.in_box(F.col("latitude"), F.col("longitude"), PACIFIC)).groupBy(
        geo.lon360(F.col("longitude")).alias("lon360")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_daterange", """
SELECT station_id, count(*) AS n FROM obs WHERE obs_date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' GROUP BY 1""")
def _(v):
    return v.obs.where(units.within(F.col("obs_date"), "1997-01-01", "1999-06-30")).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("filter_enum", """
SELECT id, station_id, severity FROM served_anomalies WHERE anomaly_type = 'heatwave' AND severity >= 0.5""",
       doubles="severity")
def _(v):
    rows = v.served_anomalies.where(serve.matching(anomaly_type="heatwave", station_id=None) & (F.col("severity") >= 0.5))
    return rows.select("id", "station_id", "severity")


@query("filter_ilike", "SELECT id, name FROM served_stations WHERE name ILIKE '%er#00000000%' OR id ILIKE '%er#00000000%'")
def _(v):
    text = "ER#00000000"
    return v.served_stations.where(serve.contains(F.col("name"), text) | serve.contains(F.col("id"), text)).select("id", "name")


@query("proj_tavg", "SELECT station_id, obs_date, coalesce(tavg, (tmax + tmin) / 2) AS tavg_computed FROM obs",
       doubles="tavg_computed", dates="obs_date")
def _(v):
    return v.obs.select("station_id", "obs_date", joins.mean_temperature().alias("tavg_computed"))


_PREFIX_JOIN = """
SELECT p.*, g.grid_temp FROM placed p LEFT JOIN (SELECT geohash_prefix, date_trunc('month', obs_date) AS m,
  avg(temp_2m_c) AS grid_temp FROM grid GROUP BY 1, 2) g
ON p.geohash_prefix = g.geohash_prefix AND date_trunc('month', p.obs_date) = g.m"""


@query("proj_deviation", f"""
SELECT station_id, obs_date, grid_temp, coalesce(tavg, (tmax + tmin) / 2) AS tavg_computed,
  CASE WHEN grid_temp IS NOT NULL THEN coalesce(tavg, (tmax + tmin) / 2) - grid_temp END AS deviation
FROM ({_PREFIX_JOIN})""", doubles="grid_temp tavg_computed deviation", dates="obs_date")
def _(v):
    grid = v.grid.withColumnRenamed("temp_2m_c", "grid_temp")
    wide = joins.derive(joins.with_grid(v.placed, grid, ["grid_temp"]))
    return wide.select("station_id", "obs_date", "grid_temp", "tavg_computed", "deviation")


@query("proj_zscore", "SELECT station_id, obs_date, tmax_zscore_30d, tmin_zscore_30d, prcp_zscore_30d FROM features",
       doubles="tmax_zscore_30d tmin_zscore_30d prcp_zscore_30d", dates="obs_date")
def _(v):
    return v.features.select("station_id", "obs_date", "tmax_zscore_30d", "tmin_zscore_30d", "prcp_zscore_30d")


@query("proj_classify", "SELECT station_id, obs_date, anomaly_type FROM flagged", dates="obs_date")
def _(v):
    return v.anomalies.select("station_id", "obs_date", "anomaly_type")


def _classify3(heat, cold, rain, scale):
    return f"""
SELECT station_id, obs_date, kind, least(abs(CASE kind WHEN 'heatwave' THEN tmax_zscore_30d
  WHEN 'cold_snap' THEN tmin_zscore_30d ELSE prcp_zscore_30d END) / {scale}, 1) AS severity FROM (
  SELECT *, CASE WHEN tmax_zscore_30d > {heat} THEN 'heatwave' WHEN tmin_zscore_30d < {cold} THEN 'cold_snap'
    WHEN prcp_zscore_30d > {rain} THEN 'precip_extreme' END AS kind FROM features) WHERE kind IS NOT NULL"""


def _extreme(v, heat, cold, rain, scale):
    z = [F.col(f"{x}_zscore_30d") for x in schemas.VARIABLES]
    kind = scores.classify_extreme(*z, heat, cold, rain)
    deciding = F.when(F.col("kind") == "heatwave", z[0]).when(F.col("kind") == "cold_snap", z[1]).otherwise(z[2])
    return v.features.withColumn("kind", kind).where("kind is not null").select(
        "station_id", "obs_date", "kind", scores.severity(deciding, scale).alias("severity"))


@query("proj_classify3", _classify3(1.5, -1.5, 1.5, 5.0), doubles="severity", dates="obs_date")
def _(v):
    return _extreme(v, 1.5, -1.5, 1.5, 5.0)


@query("proj_classify_test", _classify3(1.5, -1.5, 2.0, 10.0), doubles="severity", dates="obs_date")
def _(v):
    return _extreme(v, 1.5, -1.5, 2.0, 10.0)


@query("proj_describe")
def _(v):
    return v.anomalies.select("station_id", "obs_date", "description")


@query("proj_minmax", "SELECT station_id, obs_date, severity FROM anomalies", doubles="severity", dates="obs_date")
def _(v):
    return v.anomalies.select("station_id", "obs_date", "severity")


@query("proj_round", """
SELECT station_id, round(avg(tmax) + 1e-8, 2) AS r2, round(avg(tmin) + 1e-8, 4) AS r4 FROM obs GROUP BY 1""",
       doubles="r2 r4")
def _(v):
    return v.obs.groupBy("station_id").agg(F.round(F.avg("tmax") + 1e-8, 2).alias("r2"),
                                           F.round(F.avg("tmin") + 1e-8, 4).alias("r4"))


_STRIPES = """
SELECT station_id, year, value, CAST(floor((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 15 + 0.5) AS INTEGER) AS color_bin
FROM (SELECT *, min(value) OVER (PARTITION BY station_id) AS lo, max(value) OVER (PARTITION BY station_id) AS hi
  FROM (SELECT station_id, CAST(year(obs_date) AS INTEGER) AS year, avg(coalesce(tmax, tavg)) AS value FROM obs GROUP BY 1, 2))"""


@query("proj_colorbin", f"SELECT station_id, year, color_bin FROM ({_STRIPES})")
def _(v):
    return serve.stripes(v.obs).select("station_id", "year", "color_bin")


@query("agg_stripes", f"SELECT station_id, year, value FROM ({_STRIPES})", doubles="value")
def _(v):
    return serve.stripes(v.obs).select("station_id", "year", "value")


@query("q_stripes", _STRIPES, doubles="value")
def _(v):
    return serve.stripes(v.obs)


@query("proj_tiledate", "SELECT geohash, tile_date, anomaly_count FROM served_tiles", dates="tile_date")
def _(v):
    return v.served_tiles.select("geohash", "tile_date", "anomaly_count")


# ---- joins ---------------------------------------------------------------------------

@query("join_bcast_inner", """
SELECT o.*, s.name AS station_name, latitude, longitude, elevation, country, geohash,
  geohash_prefix, CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month
FROM obs o JOIN stations s ON o.station_id = s.station_id""",
       doubles="tmax tmin tavg prcp snow snwd latitude longitude elevation", dates="obs_date")
def _(v):
    places = v.stations.select("station_id", F.col("name").alias("station_name"), "latitude", "longitude",
                               "elevation", "country", "geohash", "geohash_prefix")
    return daily.with_date_parts(joins.with_stations(v.obs, places))


@query("join_bcast_left", "SELECT o.station_id, obs_date, geohash FROM obs o LEFT JOIN stations s ON o.station_id = s.station_id",
       dates="obs_date")
def _(v):
    return joins.with_stations(v.obs.select("station_id", "obs_date"), v.stations.select("station_id", "geohash"), "left")


@query("join_skew_salted", "SELECT country, count(*) AS n, sum(tmax) AS total FROM obs o JOIN stations s "
       "ON o.station_id = s.station_id GROUP BY 1", doubles="total")
def _(v):
    wide = joins.skew_join(v.obs, v.stations.select("station_id", "country"), ["station_id"], "inner")
    return wide.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("tmax").alias("total"))


@query("join_spatiotemporal", f"SELECT station_id, obs_date, grid_temp FROM ({_PREFIX_JOIN})",
       doubles="grid_temp", dates="obs_date")
def _(v):
    grid = v.grid.withColumnRenamed("temp_2m_c", "grid_temp")
    return joins.with_grid(v.placed, grid, ["grid_temp"]).select("station_id", "obs_date", "grid_temp")


@query("join_prefix", """
SELECT p.station_id, p.obs_date, g.anomaly AS grid_anomaly FROM placed p LEFT JOIN (
  SELECT year, month, geohash_prefix, avg(temp_anomaly) AS anomaly FROM month_grid GROUP BY 1, 2, 3) g
ON p.year = g.year AND p.month = g.month AND substr(p.geohash_prefix, 1, 3) = g.geohash_prefix""",
       doubles="grid_anomaly", dates="obs_date")
def _(v):
    grid = v.month_grid.withColumnRenamed("temp_anomaly", "grid_anomaly")
    return joins.with_month_grid(v.placed, grid, "grid_anomaly").select("station_id", "obs_date", "grid_anomaly")


@query("join_nearest_cell", """
SELECT p.station_id, p.obs_date, g.cell_temp FROM placed p LEFT JOIN (
  SELECT latitude, longitude, date_trunc('month', obs_date) AS m, avg(temp_2m_c) AS cell_temp FROM grid GROUP BY 1, 2, 3) g
ON g.latitude = least(floor((p.latitude + 90) / 5 + 0.5), 36) * 5 - 90
  AND g.longitude = (CAST(floor((p.longitude + 180) / 5 + 0.5) AS BIGINT) % 72) * 5 - 180
  AND date_trunc('month', p.obs_date) = g.m""", doubles="cell_temp", dates="obs_date")
def _(v):
    grid = v.grid.withColumnRenamed("temp_2m_c", "cell_temp")
    return joins.with_nearest_cell(v.placed, grid, ["cell_temp"], 5.0).select("station_id", "obs_date", "cell_temp")


@query("join_features", """
SELECT f.station_id, f.obs_date, f.tmax_zscore_30d, r.tmax_residual, r.tmin_residual, r.prcp_residual FROM features f LEFT JOIN (
  SELECT station_id, obs_date, tmax - 50 AS tmax_residual, tmin - 50 AS tmin_residual, prcp - 25 AS prcp_residual
  FROM obs WHERE prcp > 20) r ON f.station_id = r.station_id AND f.obs_date = r.obs_date""",
       doubles="tmax_zscore_30d tmax_residual tmin_residual prcp_residual", dates="obs_date")
def _(v):
    residuals = v.obs.where("prcp > 20").select(
        "station_id", "obs_date", (F.col("tmax") - 50).alias("tmax_residual"),
        (F.col("tmin") - 50).alias("tmin_residual"), (F.col("prcp") - 25).alias("prcp_residual"))
    return joins.with_residuals(v.features, residuals, schemas.VARIABLES).select(
        "station_id", "obs_date", "tmax_zscore_30d", "tmax_residual", "tmin_residual", "prcp_residual")


@query("join_unified", f"""
SELECT station_id, obs_date, grid_temp, deviation, grid_anomaly FROM (SELECT q.*, g.anomaly AS grid_anomaly,
    coalesce(tavg, (tmax + tmin) / 2) - grid_temp AS deviation FROM ({_PREFIX_JOIN}) q LEFT JOIN (
  SELECT year, month, geohash_prefix, avg(temp_anomaly) AS anomaly FROM month_grid GROUP BY 1, 2, 3) g
ON q.year = g.year AND q.month = g.month AND substr(q.geohash_prefix, 1, 3) = g.geohash_prefix)""",
       doubles="grid_temp deviation grid_anomaly", dates="obs_date")
def _(v):
    return joins.unify(v.obs, v.stations, v.grid, v.month_grid).select(
        "station_id", "obs_date", "grid_temp", "deviation", "grid_anomaly")


@query("join_bbox_anom", f"""
SELECT a.id, a.station_id, a.severity, s.latitude, s.longitude, s.country FROM served_anomalies a
JOIN served_stations s ON a.station_id = s.id WHERE a.anomaly_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND a.severity >= 0.2 AND a.anomaly_type = 'heatwave' AND s.latitude BETWEEN {BOX.min_lat} AND {BOX.max_lat}
  AND s.longitude BETWEEN {BOX.min_lon} AND {BOX.max_lon}""", doubles="severity latitude longitude")
def _(v):
    return serve.anomalies_on_map(v.served_anomalies, v.served_stations, BOX, "1996-01-01", "2000-12-31",
                                  "heatwave", 0.2).select("id", "station_id", "severity", "latitude", "longitude", "country")


_ANNOTATIONS = """
SELECT a.id, a.station_id, coalesce(u.username, 'anonymous') AS author, a.annotation_date, a.note, a.category, a.created_at
FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY annotation_date DESC, created_at DESC, id) AS rn
  FROM annotations) a LEFT JOIN users u ON a.user_id = u.id WHERE rn <= 100"""


@query("join_left_annot", """
SELECT a.id, coalesce(u.username, 'anonymous') AS author FROM annotations a LEFT JOIN users u ON a.user_id = u.id""")
def _(v):
    users = v.users.select(F.col("id").alias("user_id"), "username")
    return joins.lookup_join(v.annotations, users, ["user_id"], "left").select(
        "id", F.coalesce("username", F.lit("anonymous")).alias("author"))


@query("q_annotations", _ANNOTATIONS, dates="annotation_date created_at")
def _(v):
    return serve.station_annotations(v.annotations, v.users)


_COMPARE = """
SELECT coalesce(a.obs_date, b.obs_date) AS obs_date, a.tmax AS station_a, b.tmax AS station_b
FROM (SELECT * FROM obs WHERE station_id = 'ST000000000001') a
FULL JOIN (SELECT * FROM obs WHERE station_id = 'ST000000000002') b ON a.obs_date = b.obs_date"""


@query("join_compare", _COMPARE, doubles="station_a station_b", dates="obs_date")
def _(v):
    return joins.compare(v.obs, "ST000000000001", "ST000000000002", "tmax")


@query("q_compare", _COMPARE.replace("tmax", "prcp"), doubles="station_a station_b", dates="obs_date")
def _(v):
    return joins.compare(v.obs, "ST000000000001", "ST000000000002", "prcp")

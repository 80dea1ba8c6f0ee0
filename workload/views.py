"""Climate-shaped views over the driver's tables, in Spark and in SQL.

A supplier is a station, a line item one measurement of it, so the number of stations
and of measurements grows with the data. ``obs`` is the daily form: measurements are
aggregated to one row per station and day before anything else.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyframe.operators import anomaly, daily, forecast, indices, project, rolling
from skyframe.operators.extremes import block_extremes, fit, return_levels
from skyframe.functions.geo import ALPHABET, Box
from skyframe.sources import publish

MIN_YEARS = 5
THRESHOLD = 1.5
SPEC_30 = {30: rolling.DEFAULT_SPECS[30]}

# Wider than the published regions: the test grid has a cell every five degrees.
INDEX_BOXES = [
    indices.Index("oni", "temp_2m_c", "smooth", Box(-20, 20, -170, -120), half=1),
    indices.Index("nao", "pressure_hpa", "standard", Box(20, 50, -60, -5), Box(50, 80, -60, -5)),
    indices.Index("pdo", "temp_2m_c", "center", Box(20, 60, 120, 260, wrap=True)),
    indices.Index("amo", "temp_2m_c", "smooth", Box(0, 60, -80, 0), half=5),
    indices.Index("iod", "temp_2m_c", "gradient", Box(-30, 30, 40, 80), Box(-30, 30, 85, 125)),
]


def _floor_mod(a, n):
    return F.pmod(a, F.lit(n))


class Views:
    """Lazily built views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stations(self) -> DataFrame:
        s = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        placed = s.select(
            F.concat(F.lit("ST"), F.lpad(key.cast("string"), 12, "0")).alias("station_id"),
            F.col("s_name").alias("name"),
            (_floor_mod(key, 49) * 2.5 - 60.0).alias("latitude"),
            (_floor_mod(key * 7, 143) * 2.5 - 180.0).alias("longitude"),
            (_floor_mod(key, 400) * 10.0).alias("elevation"),
            F.col("r_name").alias("country"), F.col("n_name").alias("state"))
        return daily.with_geohash(placed, 7, 4)

    @cached_property
    def obs(self) -> DataFrame:
        price, line = F.col("l_extendedprice") / 1000.0, F.col("l_linenumber")
        day = F.to_date("l_shipdate").alias("obs_date")
        grouped = self.table("lineitem").groupBy("l_suppkey", day).agg(
                F.max(price).alias("tmax"),
                (F.min(price) - F.max("l_discount") * 100).alias("tmin"),
                F.avg(price).alias("mean_price"),
                F.sum(F.when(line % 4 != 0, F.col("l_quantity"))).alias("prcp"),
                F.sum(F.when(line % 2 == 0, F.col("l_tax") * 100)).alias("snow"),
                F.max(F.col("l_tax") * 50).alias("snwd"))
        odd = F.when(F.dayofmonth("obs_date") % 2 == 1, F.col("mean_price"))
        station = F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"))
        return grouped.select(station.alias("station_id"), "obs_date", "tmax", "tmin", odd.alias("tavg"),
                              "prcp", "snow", "snwd")

    @cached_property
    def placed(self) -> DataFrame:
        """Daily rows with their station's place and date parts."""
        from skyframe.operators.joins import with_stations

        places = self.stations.select("station_id", "latitude", "longitude", "geohash_prefix")
        return daily.with_date_parts(with_stations(self.obs, places))

    @cached_property
    def obs_long(self) -> DataFrame:
        names = F.array(*[F.lit(e) for e in ("TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "SNWD")])
        flag = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "A", "")
        return self.table("lineitem").select(
            F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("station_id"),
            F.date_format("l_shipdate", "yyyyMMdd").alias("obs_date"),
            F.get(names, _floor_mod(F.col("l_linenumber"), 6).cast("int")).alias("element"),
            F.round(F.col("l_extendedprice") / 100.0, 0).alias("value"), flag.alias("q_flag"))

    @cached_property
    def raw_grid(self) -> DataFrame:
        k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
        return self.table("lineitem").select(
            (_floor_mod(k, 37) * 5.0 - 90.0).alias("latitude"),
            (_floor_mod(F.floor(k / 37), 72) * 5.0 - 180.0).alias("longitude"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("time"),
            (F.col("l_quantity") / 2 + 270.0).alias("t2m"), (F.col("l_tax") / 100).alias("tp"),
            (F.col("l_extendedprice") / 10 + 95000.0).alias("sp"),
            (F.col("l_discount") * 100 - 5.0).alias("u10"), (F.col("l_tax") * 100 - 4.0).alias("v10"))

    @cached_property
    def grid(self) -> DataFrame:
        return daily.convert_grid(self.raw_grid)

    @cached_property
    def raw_month_grid(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
            (_floor_mod(k, 37) * 5.0 - 90.0).alias("latitude"),
            (_floor_mod(F.floor(k / 37), 72) * 5.0 - 180.0).alias("longitude"),
            (F.col("o_totalprice") / 100000.0 - 2.5).alias("temp_anomaly"))

    @cached_property
    def month_grid(self) -> DataFrame:
        return daily.convert_month_grid(self.raw_month_grid)

    @cached_property
    def features(self) -> DataFrame:
        return rolling.features(self.placed, SPEC_30)

    @cached_property
    def anomalies(self) -> DataFrame:
        return anomaly.event_rows(anomaly.threshold_score(self.features, THRESHOLD), "threshold")

    @cached_property
    def served_anomalies(self) -> DataFrame:
        return publish.shape(self.anomalies, "anomalies")

    @cached_property
    def served_stations(self) -> DataFrame:
        """Serving stations with record counts and years taken from the observations."""
        counts = self.obs.groupBy(F.col("station_id").alias("id")).agg(
            F.count(F.lit(1)).alias("record_count"), F.min(F.year("obs_date")).alias("first_year"),
            F.max(F.year("obs_date")).alias("last_year"))
        base = publish.shape(self.stations, "stations").drop("record_count", "first_year", "last_year")
        return base.join(counts, "id", "left").withColumn(
            "record_count", F.coalesce("record_count", F.lit(0).cast("bigint")))

    @cached_property
    def served_observations(self) -> DataFrame:
        return publish.shape(rolling.rolling(self.obs, rolling.DEFAULT_SPECS), "observations")

    @cached_property
    def tiles(self) -> DataFrame:
        return anomaly.tiles(self.anomalies)

    @cached_property
    def served_tiles(self) -> DataFrame:
        return publish.shape(self.tiles, "anomaly_tiles")

    @cached_property
    def index_series(self) -> DataFrame:
        return indices.compute(self.grid, INDEX_BOXES, "reanalysis", digits=None)

    @cached_property
    def forecasts(self) -> DataFrame:
        return forecast.statistical(self.obs, digits=False)

    @cached_property
    def row_forecasts(self) -> DataFrame:
        """A second native model: the same climatology with the row-number trend."""
        return forecast.statistical(self.obs, x="row", digits=False).withColumn(
            "model_type", F.lit("harmonic"))

    @cached_property
    def projections(self) -> DataFrame:
        return project.scenarios(self.placed, digits=False)

    @cached_property
    def gev(self) -> DataFrame:
        return fit(block_extremes(self.obs, min_years=MIN_YEARS))

    @cached_property
    def levels(self) -> DataFrame:
        return return_levels(self.gev, digits=False)

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").where(F.col("c_acctbal") > 0).select(
            F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("id"),
            F.col("c_name").alias("username"))

    @cached_property
    def annotations(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("id"),
            F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("user_id"),
            F.concat(F.lit("ST"), F.lpad((F.col("o_custkey") % 10).cast("string"), 12, "0")).alias("station_id"),
            F.to_date("o_orderdate").alias("annotation_date"),
            F.concat(F.lit("note "), F.col("o_orderpriority")).alias("note"),
            F.lower("o_orderstatus").alias("category"),
            F.to_date("o_orderdate").alias("created_at"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        c = F.col("c_custkey")
        kinds = F.array(*[F.lit(k) for k in ("any", "heatwave", "cold_snap", "precip_extreme")])
        return self.table("customer").select(
            F.concat(F.lit("A"), c.cast("string")).alias("id"),
            F.concat(F.lit("ST"), F.lpad(F.col("c_nationkey").cast("string"), 12, "0")).alias("station_id"),
            F.get(kinds, (c % 4).cast("int")).alias("alert_type"),
            ((c % 10) / 10.0).alias("min_severity"))

    @cached_property
    def live_records(self) -> DataFrame:
        """The event stream as live records: a user is a station, three of the event
        types are elements."""
        element = (F.when(F.col("event_type") == "click", "TMAX")
                   .when(F.col("event_type") == "view", "TMIN").otherwise("PRCP"))
        return self.table("events").select(
            F.concat(F.lit("EV"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("station_id"),
            F.to_date("ts").alias("obs_date"), element.alias("element"), "value",
            F.col("ts").cast("timestamp").alias("ts"))


def geohash_sql(lat: str, lon: str, precision: int) -> str:
    """The geohash of two SQL expressions, by interval arithmetic."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2

    def index(value, low, span, bits):
        return (f"greatest(least(CAST(floor(({value} - ({low})) / {span} * {1 << bits}) AS BIGINT),"
                f" {(1 << bits) - 1}), 0)")

    x, y = index(lon, -180.0, 360.0, lon_bits), index(lat, -90.0, 180.0, lat_bits)
    letters = []
    for c in range(precision):
        terms = []
        for j in range(5):
            k = 5 * c + j
            source, width = (x, lon_bits) if k % 2 == 0 else (y, lat_bits)
            terms.append(f"(({source} // {1 << (width - 1 - k // 2)}) % 2) * {16 >> j}")
        letters.append(f"substr('{ALPHABET}', CAST({' + '.join(terms)} + 1 AS BIGINT), 1)")
    return " || ".join(letters)


def _id(key: str) -> str:
    return f"'ST' || lpad(CAST({key} AS VARCHAR), 12, '0')"


_ROLL = "OVER (PARTITION BY station_id ORDER BY dn RANGE BETWEEN {days} PRECEDING AND CURRENT ROW)"
_SQL_STATS = {"mean": "avg({v})", "std": "stddev_samp({v})", "min": "min({v})", "max": "max({v})",
              "sum": "sum({v})"}


def rolling_sql(days: int) -> str:
    """Select list of all statistics of one look-back."""
    return ", ".join(
        f"{_SQL_STATS[stat].format(v=v)} {_ROLL.format(days=days)} AS {v}_rolling_{days}d_{stat}"
        for v, stats in rolling.DEFAULT_SPECS[days].items() for stat in stats)


def z_sql(x: str, mean: str, std: str) -> str:
    return f"CASE WHEN {std} > 0 THEN ({x} - {mean}) / {std} ELSE 0.0 END"


_CLASSIFY = """
CASE WHEN hz > 2 OR cz > 2 THEN 'heatwave' WHEN mz < -2 OR hz < -2 THEN 'cold_snap'
     WHEN pz > 2 THEN 'precip_extreme' WHEN hz > 1.5 THEN 'heatwave' WHEN mz < -1.5 THEN 'cold_snap'
     WHEN abs(pz) > abs(hz) THEN 'precip_extreme' ELSE 'heatwave' END"""

_BOXES = {f"{d.name}_{side}": (d.column, box) for d in INDEX_BOXES
          for side, box in (("a", d.box), ("b", d.minus)) if box}


def _box_sql(box: Box) -> str:
    lon = "CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END" if box.wrap else "longitude"
    return (f"latitude BETWEEN {box.min_lat} AND {box.max_lat} AND {lon} BETWEEN "
            f"{box.min_lon} AND {box.max_lon}")


def _stat_forecast_sql(axis: str) -> str:
    return f"""
WITH u AS (SELECT station_id, obs_date, 'tmax' AS variable, tmax AS value FROM obs WHERE tmax IS NOT NULL
  UNION ALL SELECT station_id, obs_date, 'tmin', tmin FROM obs WHERE tmin IS NOT NULL
  UNION ALL SELECT station_id, obs_date, 'prcp', prcp FROM obs WHERE prcp IS NOT NULL),
m AS (SELECT *, max(obs_date) OVER (PARTITION BY station_id, variable) AS last_day,
        row_number() OVER (PARTITION BY station_id, variable ORDER BY obs_date) AS rn,
        obs_date - DATE '1970-01-01' AS dn FROM u),
h AS (SELECT station_id, variable, max(last_day) AS last_day, count(*) AS n,
        count(*) FILTER (WHERE last_day - obs_date <= 3650) AS recent,
        regr_slope(value, {axis}) FILTER (WHERE last_day - obs_date <= 3650) AS slope
      FROM m GROUP BY ALL HAVING count(*) >= 365),
c AS (SELECT station_id, variable, dayofyear(obs_date) AS doy, avg(value) AS base,
        coalesce(stddev_samp(value), 2.0) AS spread FROM u GROUP BY ALL),
f AS (SELECT station_id, variable, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS forecast_date, step,
        CASE WHEN recent > 365 THEN coalesce(slope, 0.0) ELSE 0.0 END AS slope
      FROM (SELECT *, unnest(range(1, 366, 7)) AS step FROM h)),
v AS (SELECT f.*, c.spread, CASE WHEN f.variable = 'prcp' THEN greatest(c.base + f.slope * f.step, 0.0)
        ELSE c.base + f.slope * f.step END AS value
      FROM f JOIN c ON c.station_id = f.station_id AND c.variable = f.variable
        AND c.doy = dayofyear(f.forecast_date))
SELECT station_id, forecast_date, variable, value AS predicted_value, value - 1.645 * spread AS lower_bound,
  value + 1.645 * spread AS upper_bound, 'statistical' AS model_type, '1.0' AS model_version,
  CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse FROM v"""


SQL_VIEWS: dict[str, str] = {
    "stations": f"""
SELECT station_id, name, latitude, longitude, elevation, country, state, geohash,
  substr(geohash, 1, 4) AS geohash_prefix FROM (
  SELECT *, {geohash_sql('latitude', 'longitude', 7)} AS geohash FROM (
    SELECT {_id('s_suppkey')} AS station_id, s_name AS name, (s_suppkey % 49) * 2.5::DOUBLE - 60 AS latitude,
      (s_suppkey * 7 % 143) * 2.5::DOUBLE - 180 AS longitude, (s_suppkey % 400) * 10.0::DOUBLE AS elevation,
      r_name AS country, n_name AS state
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))""",
    "obs": f"""
SELECT station_id, obs_date, tmax, tmin, CASE WHEN day(obs_date) % 2 = 1 THEN mean_price END AS tavg,
  prcp, snow, snwd FROM (
  SELECT {_id('l_suppkey')} AS station_id, CAST(l_shipdate AS DATE) AS obs_date,
    max(l_extendedprice / 1000) AS tmax, min(l_extendedprice / 1000) - max(l_discount) * 100 AS tmin,
    avg(l_extendedprice / 1000) AS mean_price,
    sum(l_quantity) FILTER (WHERE l_linenumber % 4 <> 0) AS prcp,
    sum(l_tax * 100) FILTER (WHERE l_linenumber % 2 = 0) AS snow, max(l_tax * 50) AS snwd
  FROM lineitem GROUP BY 1, 2)""",
    "placed": """
SELECT o.*, s.latitude, s.longitude, s.geohash_prefix, CAST(year(obs_date) AS INTEGER) AS year,
  CAST(month(obs_date) AS INTEGER) AS month FROM obs o JOIN stations s ON o.station_id = s.station_id""",
    "obs_long": f"""
SELECT {_id('l_suppkey')} AS station_id, strftime(l_shipdate, '%Y%m%d') AS obs_date,
  (['TMAX', 'TMIN', 'TAVG', 'PRCP', 'SNOW', 'SNWD'])[l_linenumber % 6 + 1] AS element,
  round(l_extendedprice / 100, 0) AS value,
  CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN '' END AS q_flag FROM lineitem""",
    "raw_grid": """
SELECT (k % 37) * 5.0::DOUBLE - 90 AS latitude, (k // 37 % 72) * 5.0::DOUBLE - 180 AS longitude,
  CAST(l_shipdate AS DATE) AS time, 270 + l_quantity / 2 AS t2m, l_tax / 100 AS tp,
  95000 + l_extendedprice / 10 AS sp, l_discount * 100 - 5 AS u10, l_tax * 100 - 4 AS v10
FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)""",
    "grid": f"""
SELECT *, substr(geohash, 1, 4) AS geohash_prefix, CAST(year(obs_date) AS INTEGER) AS year,
  CAST(month(obs_date) AS INTEGER) AS month FROM (
  SELECT latitude, longitude, time AS obs_date, t2m - 273.15 AS temp_2m_c, tp * 1000 AS precip_mm,
    sp / 100 AS pressure_hpa, u10, v10, sqrt(u10 * u10 + v10 * v10) AS wind_speed_ms,
    {geohash_sql('latitude', 'longitude', 5)} AS geohash FROM raw_grid)""",
    "month_grid": f"""
SELECT *, make_date(year, month, 1) AS obs_date, {geohash_sql('latitude', 'longitude', 4)} AS geohash,
  substr({geohash_sql('latitude', 'longitude', 4)}, 1, 3) AS geohash_prefix FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    (o_orderkey % 37) * 5.0::DOUBLE - 90 AS latitude, (o_orderkey // 37 % 72) * 5.0::DOUBLE - 180 AS longitude,
    o_totalprice / 100000 - 2.5 AS temp_anomaly FROM orders)""",
    "rolled": f"""
SELECT *, {rolling_sql(30)} FROM (SELECT *, obs_date - DATE '1970-01-01' AS dn FROM placed)""",
    "features": f"""
SELECT * EXCLUDE (dn), {z_sql('tmax', 'tmax_rolling_30d_mean', 'tmax_rolling_30d_std')} AS tmax_zscore_30d,
  {z_sql('tmin', 'tmin_rolling_30d_mean', 'tmin_rolling_30d_std')} AS tmin_zscore_30d,
  {z_sql('prcp', 'prcp_rolling_30d_mean', 'prcp_rolling_30d_std')} AS prcp_zscore_30d,
  {z_sql('tmax', 'tmax_doy_mean', 'tmax_doy_std')} AS tmax_climatology_deviation,
  {z_sql('tmin', 'tmin_doy_mean', 'tmin_doy_std')} AS tmin_climatology_deviation
FROM (SELECT *, avg(tmax) OVER d AS tmax_doy_mean, stddev_samp(tmax) OVER d AS tmax_doy_std,
        avg(tmin) OVER d AS tmin_doy_mean, stddev_samp(tmin) OVER d AS tmin_doy_std
      FROM (SELECT *, CAST(dayofyear(obs_date) AS INTEGER) AS day_of_year FROM rolled)
      WINDOW d AS (PARTITION BY station_id, day_of_year))""",
    "flagged": f"""
SELECT *, {_CLASSIFY} AS anomaly_type FROM (
  SELECT *, greatest(abs(hz), abs(mz), abs(pz), abs(cz)) AS raw_score FROM (
    SELECT *, coalesce(tmax_zscore_30d, 0) AS hz, coalesce(tmin_zscore_30d, 0) AS mz,
      coalesce(prcp_zscore_30d, 0) AS pz, coalesce(tmax_climatology_deviation, 0) AS cz FROM features))
WHERE raw_score >= {THRESHOLD}""",
    "anomalies": """
SELECT station_id, obs_date, latitude, longitude, geohash_prefix, anomaly_type, severity,
  CAST(duration_days AS INTEGER) AS duration_days, tmax_zscore_30d AS temp_deviation,
  prcp_zscore_30d AS precip_deviation,
  CASE anomaly_type
    WHEN 'heatwave' THEN printf('Hot spell of severity %.2f over %d day(s), %+.1f standard deviations [threshold]',
      severity, duration_days, coalesce(tmax_zscore_30d, 0.0))
    WHEN 'cold_snap' THEN printf('Cold spell of severity %.2f over %d day(s), %+.1f standard deviations [threshold]',
      severity, duration_days, coalesce(tmax_zscore_30d, 0.0))
    ELSE printf('Heavy rain of severity %.2f over %d day(s), %+.1f standard deviations [threshold]',
      severity, duration_days, coalesce(prcp_zscore_30d, 0.0)) END AS description, year, month
FROM (SELECT *, count(*) OVER (PARTITION BY station_id, anchor) AS duration_days,
    least(greatest(CASE WHEN hi > lo THEN (raw_score - lo) / (hi - lo) ELSE 0.5 END, 0.1), 1.0) AS severity
  FROM (SELECT *, (obs_date - DATE '1970-01-01')
      - row_number() OVER (PARTITION BY station_id ORDER BY obs_date) AS anchor,
      min(raw_score) OVER (PARTITION BY station_id) AS lo, max(raw_score) OVER (PARTITION BY station_id) AS hi
    FROM flagged))""",
    "served_anomalies": """
SELECT station_id || '-' || CAST(obs_date AS VARCHAR) AS id, station_id, obs_date AS anomaly_date, anomaly_type,
  severity, duration_days, temp_deviation, precip_deviation, description, latitude, longitude FROM anomalies""",
    "served_stations": """
SELECT s.station_id AS id, name, latitude, longitude, elevation, country, state, geohash,
  CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year,
  coalesce(record_count, 0) AS record_count
FROM stations s LEFT JOIN (SELECT station_id, count(*) AS record_count, min(year(obs_date)) AS first_year,
  max(year(obs_date)) AS last_year FROM obs GROUP BY 1) c ON c.station_id = s.station_id""",
    "served_observations": f"""
SELECT station_id, obs_date, tmax, tmin, prcp, snow, snwd, coalesce(tavg, (tmax + tmin) / 2) AS tavg,
  tmax_rolling_30d_mean AS tmax_rolling_30d, tmin_rolling_30d_mean AS tmin_rolling_30d,
  prcp_rolling_30d_mean AS prcp_rolling_30d, tmax_rolling_365d_mean AS tmax_rolling_365d,
  tmin_rolling_365d_mean AS tmin_rolling_365d, prcp_rolling_365d_mean AS prcp_rolling_365d,
  tmax_rolling_30d_std AS tmax_stddev_30d, tmin_rolling_30d_std AS tmin_stddev_30d,
  prcp_rolling_30d_std AS prcp_stddev_30d
FROM (SELECT *, {rolling_sql(30)}, {rolling_sql(365)}
      FROM (SELECT *, obs_date - DATE '1970-01-01' AS dn FROM obs))""",
    "tiles": """
SELECT *, CASE WHEN heatwave_count >= cold_snap_count AND heatwave_count >= precip_extreme_count THEN 'heatwave'
    WHEN cold_snap_count >= precip_extreme_count THEN 'cold_snap' ELSE 'precip_extreme' END AS dominant_type
FROM (SELECT geohash_prefix, year, month, count(*) AS anomaly_count, avg(severity) AS avg_severity,
    count(*) FILTER (WHERE anomaly_type = 'heatwave') AS heatwave_count,
    count(*) FILTER (WHERE anomaly_type = 'cold_snap') AS cold_snap_count,
    count(*) FILTER (WHERE anomaly_type = 'precip_extreme') AS precip_extreme_count,
    avg(latitude) AS center_lat, avg(longitude) AS center_lon FROM anomalies GROUP BY 1, 2, 3)""",
    "served_tiles": """
SELECT geohash_prefix AS geohash, make_date(year, month, 1) AS tile_date,
  CAST(anomaly_count AS INTEGER) AS anomaly_count, avg_severity, dominant_type,
  CAST(heatwave_count AS INTEGER) AS heatwave_count, CAST(cold_snap_count AS INTEGER) AS cold_snap_count,
  CAST(precip_extreme_count AS INTEGER) AS precip_extreme_count, center_lat, center_lon FROM tiles""",
    "region_means": "SELECT year, month, " + ", ".join(
        f"avg({column}) FILTER (WHERE {_box_sql(box)}) AS {name}" for name, (column, box) in _BOXES.items())
    + " FROM grid GROUP BY 1, 2",
    "index_raw": " UNION ALL ".join(
        f"SELECT '{d.name}' AS index_name, year, month, "
        + (f"{d.name}_a - {d.name}_b" if d.minus else f"{d.name}_a") + " AS raw FROM region_means"
        for d in INDEX_BOXES),
    "index_series": """
SELECT make_date(year, month, 1) AS index_date, index_name,
  CASE index_name WHEN 'oni' THEN avg(seasonal) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
    WHEN 'amo' THEN avg(seasonal) OVER (o ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
    WHEN 'pdo' THEN seasonal - avg(seasonal) OVER (PARTITION BY index_name)
    WHEN 'nao' THEN (raw - overall) / CASE WHEN spread > 0 THEN spread ELSE 1 END
    ELSE raw - overall END AS value,
  CASE WHEN index_name IN ('nao', 'iod') THEN raw - overall ELSE seasonal END AS anomaly,
  'reanalysis' AS source
FROM (SELECT *, raw - avg(raw) OVER (PARTITION BY index_name, month) AS seasonal,
    avg(raw) OVER (PARTITION BY index_name) AS overall,
    stddev_samp(raw) OVER (PARTITION BY index_name) AS spread FROM index_raw WHERE raw IS NOT NULL)
WINDOW o AS (PARTITION BY index_name ORDER BY year, month)""",
    "long_values": """
SELECT station_id, obs_date, 'tmax' AS variable, tmax AS value FROM obs WHERE tmax IS NOT NULL
UNION ALL SELECT station_id, obs_date, 'tmin', tmin FROM obs WHERE tmin IS NOT NULL
UNION ALL SELECT station_id, obs_date, 'prcp', prcp FROM obs WHERE prcp IS NOT NULL""",
    "annual_means": """
SELECT station_id, variable, CAST(year(obs_date) AS INTEGER) AS year, avg(value) AS value
FROM long_values GROUP BY 1, 2, 3""",
    "pairs": """
SELECT a.station_id, a.variable, b.value - a.value AS dv, (b.value - a.value) / (b.year - a.year) AS slope
FROM annual_means a JOIN annual_means b ON a.station_id = b.station_id AND a.variable = b.variable
  AND a.year < b.year""",
    "forecasts": _stat_forecast_sql("dn"),
    "row_forecasts": "SELECT * REPLACE ('harmonic' AS model_type) FROM (" + _stat_forecast_sql("rn") + ")",
    "blocks": f"""
SELECT station_id, variable, year, value FROM (
  SELECT station_id, variable, CAST(year(obs_date) AS INTEGER) AS year,
    CASE WHEN variable = 'tmin' THEN -min(value) ELSE max(value) END AS value,
    sum(count(*)) OVER (PARTITION BY station_id, variable) AS days,
    count(*) OVER (PARTITION BY station_id, variable) AS years
  FROM long_values GROUP BY 1, 2, 3) WHERE days >= 365 AND years >= {MIN_YEARS}""",
    "gev": """
SELECT station_id, variable, n_years, b0, b1, b2, k AS shape_param,
  CASE WHEN abs(k) < 1e-6 THEN b0 - 0.5772156649015329 * scale
    ELSE b0 - scale * (1 - gamma(1 + k)) / k END AS location_param, scale AS scale_param
FROM (SELECT *, CASE WHEN abs(k) < 1e-6 THEN l2 / ln(2)
    ELSE l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) END AS scale
  FROM (SELECT *, 7.8590 * c + 2.9554 * c * c AS k
    FROM (SELECT *, 2 / (3 + (6 * b2 - 6 * b1 + b0) / l2) - ln(2) / ln(3) AS c
      FROM (SELECT *, 2 * b1 - b0 AS l2
        FROM (SELECT station_id, variable, CAST(max(n) AS INTEGER) AS n_years, sum(value) / max(n) AS b0,
            sum((j - 1) * value) / (max(n) * (max(n) - 1)) AS b1,
            sum((j - 1) * (j - 2) * value) / (max(n) * (max(n) - 1) * (max(n) - 2)) AS b2
          FROM (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY value) AS j,
              count(*) OVER (PARTITION BY station_id, variable) AS n FROM blocks) GROUP BY 1, 2))
      WHERE l2 > 1e-12)))""",
    "levels": """
SELECT station_id, variable, 'gev' AS distribution, CAST(t AS INTEGER) AS return_period,
  sgn * level AS return_level, sgn * level - margin AS lower_ci, sgn * level + margin AS upper_ci,
  shape_param, location_param, scale_param, n_years
FROM (SELECT *, CASE WHEN variable = 'tmin' THEN -1 ELSE 1 END AS sgn,
    CASE WHEN abs(shape_param) < 1e-6 THEN location_param - scale_param * ln(-ln(1 - 1.0::DOUBLE / t))
      ELSE location_param + scale_param * (1 - pow(-ln(1 - 1.0::DOUBLE / t), shape_param)) / shape_param END AS level,
    1.96::DOUBLE * scale_param / sqrt(n_years) * sqrt(ln(t)) AS margin
  FROM (SELECT *, unnest([10, 25, 50, 100]) AS t FROM gev))""",
    "projections": """
WITH c AS (SELECT *, sum(n) OVER (PARTITION BY station_id, variable) AS total FROM (
    SELECT l.station_id, variable, CAST(month(obs_date) AS INTEGER) AS month, avg(value) AS base,
      coalesce(stddev_samp(value), 2.0) AS spread, count(*) AS n, max(s.latitude) AS latitude
    FROM long_values l JOIN stations s ON s.station_id = l.station_id GROUP BY 1, 2, 3)),
r(scenario, variable, rate) AS (VALUES ('ssp126', 'tmax', 0.015), ('ssp126', 'tmin', 0.018), ('ssp126', 'prcp', 0.002),
  ('ssp245', 'tmax', 0.028), ('ssp245', 'tmin', 0.032), ('ssp245', 'prcp', 0.003),
  ('ssp370', 'tmax', 0.042), ('ssp370', 'tmin', 0.048), ('ssp370', 'prcp', 0.004),
  ('ssp585', 'tmax', 0.060), ('ssp585', 'tmin', 0.065), ('ssp585', 'prcp', 0.005)),
y AS (SELECT c.*, r.scenario, CAST(r.rate AS DOUBLE) * (1 + 0.5 * abs(latitude) / 90) AS rate, unnest(range(2025, 2101)) AS yr
  FROM c JOIN r ON c.variable = r.variable WHERE total >= 365),
v AS (SELECT *, CASE WHEN variable = 'prcp' THEN greatest(base + rate * (yr - 2020), 0) ELSE base + rate * (yr - 2020) END AS value,
    1.645 * (spread * 0.5 * (1 + (yr - 2020) / 80)) AS margin FROM y)
SELECT station_id, make_date(yr, month, 1) AS projection_date, scenario, variable, value AS predicted_value,
  CASE WHEN variable = 'prcp' THEN greatest(value - margin, 0) ELSE value - margin END AS lower_bound,
  value + margin AS upper_bound, 'cmip6-ensemble-bc' AS model_name, 5 AS ensemble_size, true AS bias_corrected FROM v""",
    "users": "SELECT 'U' || c_custkey AS id, c_name AS username FROM customer WHERE c_acctbal > 0",
    "annotations": f"""
SELECT 'N' || o_orderkey AS id, 'U' || o_custkey AS user_id, {_id('o_custkey % 10')} AS station_id,
  CAST(o_orderdate AS DATE) AS annotation_date, 'note ' || o_orderpriority AS note,
  lower(o_orderstatus) AS category, CAST(o_orderdate AS DATE) AS created_at FROM orders""",
    "subscriptions": f"""
SELECT 'A' || c_custkey AS id, {_id('c_nationkey')} AS station_id,
  (['any', 'heatwave', 'cold_snap', 'precip_extreme'])[c_custkey % 4 + 1] AS alert_type,
  (c_custkey % 10) / 10.0::DOUBLE AS min_severity FROM customer""",
    "live_records": """
SELECT 'EV' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS station_id, CAST(ts AS DATE) AS obs_date,
  CASE event_type WHEN 'click' THEN 'TMAX' WHEN 'view' THEN 'TMIN' ELSE 'PRCP' END AS element, value, ts
FROM events""",
}

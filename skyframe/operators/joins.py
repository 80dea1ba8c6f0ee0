"""Joins of the observation table with dimensions, grids and optional sources.

A lookup table whose size is known to be small is broadcast. Any other is joined as the
optimizer sees fit, which measures both sides at run time and splits skewed partitions; where
that is not enough, ``skew_join`` salts the hot keys itself.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyframe.session import cut

BROADCAST_LIMIT = 32 * 1024 * 1024
#: How many times larger than its Parquet files a table may be in memory.
EXPANSION = 4


def estimated_bytes(df: DataFrame) -> int:
    """Cautious estimate of a lookup table's size in memory.

    A lookup is made of filters, aggregates and many-to-one joins, none of which adds rows: it
    is no larger than its files as they unfold in memory. Where the plan holds an operator
    that does add rows, the optimizer's estimate counts if it is larger."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    files = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    adds = any(name in plan.toString() for name in ("Generate ", "Expand ", "Join FullOuter", "Join Cross"))
    own = int(str(plan.stats().sizeInBytes()))
    return max(EXPANSION * files, own) if adds else EXPANSION * files


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join to a smaller table: broadcast if it is certainly below ``limit`` bytes, else left
    to the optimizer and its handling of skew at run time."""
    if limit and estimated_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
              share: int = 64, tasks: int | None = None) -> DataFrame:
    """Inner or left equi-join that spreads each hot key over tasks in proportion to its share.

    The left side is computed once and stored; a stored row's file and number give its salt, so
    equal rows are spread too and a task that is run again deals the same salts. A key is hot
    when it holds more than 1/``share`` of the left rows, so there are fewer than ``share`` hot
    keys whatever the data: that list alone is broadcast. A key gets as many salts as it has
    shares of 1/``tasks`` (the shuffle partitions by default). Only the right rows of hot keys
    are copied, once per salt. A stream is joined plainly."""
    if how not in ("inner", "left"):
        raise ValueError("skew_join handles inner and left joins")
    if left.isStreaming:
        return left.join(right, on, how)
    spark = left.sparkSession
    stored = cut(left, f"skew-{uuid.uuid4().hex}")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = stored.count()
    salts = F.least(F.lit(tasks), F.ceil(F.col("_n") * tasks / F.lit(max(total, 1)))).cast("int")
    hot = (stored.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > F.lit(math.ceil(total / share))).select(*on, salts.alias("_salts")))
    meta = stored.metadataColumn("_metadata")
    placed = stored.withColumn("_place", F.xxhash64(meta["file_path"], meta["row_index"]))
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.when(unmatched, F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = (placed.join(F.broadcast(hot), on, "left")
              .withColumn("_salt", F.pmod("_place", spread).cast("int")).drop("_salts", "_place"))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread_right = (right.join(F.broadcast(hot), on, "left")
                    .withColumn("_salt", F.explode(copies)).drop("_salts"))
    joined = salted.join(spread_right, [*on, "_salt"], how).drop("_salt")
    return joined.select(*left.columns, *[c for c in right.columns if c not in on])


def with_stations(obs: DataFrame, stations: DataFrame, how: str = "inner") -> DataFrame:
    """Observations with their station's attributes."""
    return lookup_join(obs, stations, ["station_id"], how)


def grid_by_prefix(grid: DataFrame, values: list[str]) -> DataFrame:
    """Grid values averaged per geohash prefix and calendar month.

    Aggregating to the month before joining keeps the join one-to-one: a daily grid
    would otherwise multiply each observation by the days of its month.
    """
    return grid.groupBy("geohash_prefix", F.trunc("obs_date", "month").alias("grid_month")).agg(
        *[F.avg(v).alias(v) for v in values])


def with_grid(obs: DataFrame, grid: DataFrame, values: list[str],
              limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Left join of observations to a grid on (geohash prefix, calendar month)."""
    # a key that is never NULL needs no test for it, which would repeat the geohash in a filter
    monthly = grid_by_prefix(grid.withColumn("geohash_prefix", F.coalesce("geohash_prefix", F.lit(""))), values)
    keyed = obs.withColumn("grid_month", F.trunc("obs_date", "month"))
    return lookup_join(keyed, monthly, ["geohash_prefix", "grid_month"], "left", limit).drop(
        "grid_month")


def with_month_grid(obs: DataFrame, month_grid: DataFrame, value: str, length: int = 3,
                    limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Left join to a monthly grid on year, month and the first ``length`` letters of
    the observation's geohash prefix."""
    cells = month_grid.groupBy(
        "year", "month", F.coalesce("geohash_prefix", F.lit("")).alias("cell")).agg(F.avg(value).alias(value))
    keyed = obs.withColumn("cell", F.substring("geohash_prefix", 1, length))
    return lookup_join(keyed, cells, ["year", "month", "cell"], "left", limit).drop("cell")


def with_nearest_cell(obs: DataFrame, grid: DataFrame, values: list[str], step: float,
                      lat0: float = -90.0, lon0: float = -180.0,
                      limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Left join to the regular-grid cell nearest to each station, by month."""
    keys = ["cell_lat", "cell_lon", "grid_month"]
    lats, lons = round(180 / step) + 1, round(360 / step)

    def cell(value: Column, origin: float, count: int, wrap: bool) -> Column:
        index = F.floor((value - origin) / step + 0.5)
        return F.pmod(index, F.lit(count)) if wrap else F.least(index, F.lit(count - 1))

    def keyed(df: DataFrame) -> DataFrame:
        return (df.withColumn("cell_lat", cell(F.col("latitude"), lat0, lats, False))
                .withColumn("cell_lon", cell(F.col("longitude"), lon0, lons, True))
                .withColumn("grid_month", F.trunc("obs_date", "month")))

    cells = keyed(grid).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    return lookup_join(keyed(obs), cells, keys, "left", limit).drop(*keys)


def with_optional(df: DataFrame, other: DataFrame | None, on: list[str],
                  columns: dict[str, str]) -> DataFrame:
    """Left join when the other source exists, typed NULL columns when it does not."""
    if other is None:
        return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})
    return lookup_join(df, other.select(*on, *columns), on, "left")


def unify(obs: DataFrame, stations: DataFrame, grid: DataFrame | None = None,
          month_grid: DataFrame | None = None) -> DataFrame:
    """The wide fact table: observations, station attributes, grid values, deviation."""
    attributes = stations.select("station_id", F.col("name").alias("station_name"), "latitude",
                                 "longitude", "elevation", "country", "geohash")
    wide = with_stations(obs, attributes)
    wide = wide.withColumns({
        "geohash_prefix": F.substring("geohash", 1, 4),
        "year": F.year("obs_date"),
        "month": F.month("obs_date"),
    })
    values = {"grid_temp": "temp_2m_c", "grid_precip": "precip_mm",
              "grid_pressure": "pressure_hpa", "grid_wind_speed": "wind_speed_ms"}
    if grid is None:
        wide = with_optional(wide, None, [], {name: "double" for name in values})
    else:
        renamed = grid.select("geohash_prefix", "obs_date",
                              *[F.col(c).alias(name) for name, c in values.items()])
        wide = with_grid(wide, renamed, list(values))
    if month_grid is None:
        wide = with_optional(wide, None, [], {"grid_anomaly": "double"})
    else:
        renamed = month_grid.select("year", "month", "geohash_prefix",
                                    F.col("temp_anomaly").alias("grid_anomaly"))
        wide = with_month_grid(wide, renamed, "grid_anomaly")
    return derive(wide)


def mean_temperature() -> Column:
    return F.coalesce(F.col("tavg"), (F.col("tmax") + F.col("tmin")) / 2)


def derive(df: DataFrame, reference: str = "grid_temp") -> DataFrame:
    """Mean temperature and its deviation from the grid value where there is one."""
    with_mean = df.withColumn("tavg_computed", mean_temperature())
    return with_mean.withColumn(
        "deviation",
        F.when(F.col(reference).isNotNull(), F.col("tavg_computed") - F.col(reference)))


def with_residuals(features: DataFrame, residuals: DataFrame | None,
                   variables: list[str]) -> DataFrame:
    """Features with decomposition residuals, NULL when no decomposition was run.

    Both sides hold one row per station and day, so no key can be hot; they are
    shuffled by the same two columns and merged."""
    columns = [f"{v}_residual" for v in variables]
    if residuals is None:
        return with_optional(features, None, [], {c: "double" for c in columns})
    return features.join(residuals.select("station_id", "obs_date", *columns),
                         ["station_id", "obs_date"], "left")


def compare(series: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Two stations' values side by side on every date either has: one scan, one
    shuffle, instead of a full outer self-join."""
    picked = series.where(F.col("station_id").isin(first, second))

    def of(station: str) -> Column:
        return F.max(F.when(F.col("station_id") == station, F.col(value)))

    return picked.groupBy("obs_date").agg(of(first).alias("station_a"), of(second).alias("station_b"))

"""From raw long records to one row per station and day, and its roll-ups.

Every later per-station operator starts from this daily form. Building it is a plain
aggregation (combined map-side, so a station with a third of all raw rows is reduced
before the shuffle), and it bounds a station's rows by the days of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from skyframe import schemas
from skyframe.functions import geo, units
from skyframe.operators.grouped import spread


def passes_quality(flag: Column) -> Column:
    """True for records without a quality flag."""
    return flag.isNull() | (flag == "")


def clean_long(raw: DataFrame, divisors: dict[str, float] = schemas.ELEMENT_DIVISORS,
               date_format: str = "yyyyMMdd") -> DataFrame:
    """Parse dates, scale values and drop flagged records."""
    return raw.where(passes_quality(F.col("q_flag"))).select(
        "station_id",
        F.try_to_timestamp("obs_date", F.lit(date_format)).cast("date").alias("obs_date"),
        "element",
        units.scale_element(F.col("element"), F.col("value"), divisors).alias("value"),
    )


def pivot_elements(long: DataFrame, elements: list[str] = schemas.ELEMENTS) -> DataFrame:
    """One row per station and day with one column per element.

    Duplicate records of an element resolve to the largest value, which does not
    depend on row order."""
    return long.groupBy("station_id", "obs_date").agg(*[
        F.max(F.when(F.col("element") == e, F.col("value"))).alias(e.lower()) for e in elements])


def duplicates(long: DataFrame) -> DataFrame:
    """Station-days with more than one record of the same element."""
    return (long.groupBy("station_id", "obs_date", "element")
            .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))


def with_date_parts(df: DataFrame, day: str = "obs_date") -> DataFrame:
    return df.withColumns({"year": F.year(day), "month": F.month(day)})


def with_geohash(df: DataFrame, precision: int, prefix_length: int) -> DataFrame:
    """Geohash of latitude/longitude and its partitioning prefix."""
    coded = df.withColumn("geohash", geo.geohash(F.col("latitude"), F.col("longitude"), precision))
    return coded.withColumn("geohash_prefix", geo.prefix(F.col("geohash"), prefix_length))


def convert_grid(raw: DataFrame) -> DataFrame:
    """Reanalysis rows in display units, with wind components, speed and direction."""
    converted = raw.select(
        "latitude", "longitude", F.expr("try_to_date(time)").alias("obs_date"),
        units.celsius(F.col("t2m")).alias("temp_2m_c"),
        units.millimetres(F.col("tp")).alias("precip_mm"),
        units.hectopascal(F.col("sp")).alias("pressure_hpa"),
        "u10", "v10",
        units.wind_speed(F.col("u10"), F.col("v10")).alias("wind_speed_ms"),
        units.wind_direction(F.col("u10"), F.col("v10")).alias("wind_direction"),
    )
    return with_date_parts(with_geohash(converted, 5, 4))


def convert_month_grid(raw: DataFrame) -> DataFrame:
    dated = raw.withColumn("obs_date", F.make_date("year", "month", F.lit(1)))
    return with_geohash(dated, 4, 3)


def unpivot(daily: DataFrame, variables: list[str] = schemas.VARIABLES,
            keep: list[str] | None = None) -> DataFrame:
    """Wide to long: (station_id, obs_date, variable, value), NULL values dropped."""
    ids = ["station_id", "obs_date", *(keep or [])]
    return daily.unpivot(ids, variables, "variable", "value").where("value is not null")


def wide_groups(daily: DataFrame, part: Column, aggregates: Callable[[str], list[Column]],
                variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """(station_id, part, one struct for each variable): ``aggregates(v)`` over each part of a station's rows.

    The rows are dealt by station and aggregated wide, all variables beside each other, and only the groups become long
    (``long_groups``): a task holds one group for all variables, and the rows are moved once instead of once for each
    variable. ``aggregates(v)`` are named and must have equal types for all variables."""
    return spread(daily, ["station_id"]).groupBy("station_id", part).agg(*[
        F.struct(*aggregates(v), F.count(v).alias("_known")).alias(v) for v in variables])


def long_groups(groups: DataFrame, variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """(station_id, part, variable, aggregates); groups without a value of the variable are absent."""
    ids = [c for c in groups.columns if c not in variables]
    long = groups.unpivot(ids, variables, "variable", "_group").where("_group._known > 0")
    return long.select(*ids, "variable", "_group.*").drop("_known")


def annual(daily: DataFrame, variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """Mean per station, variable and year."""
    return unpivot(daily, variables).groupBy(
        "station_id", "variable", F.year("obs_date").alias("year")).agg(F.avg("value").alias("value"))


def annual_extreme(daily: DataFrame, variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """Yearly extreme of each variable (lowest for tmin, highest otherwise) with the
    number of days behind it."""
    extreme = F.when(F.col("variable") == "tmin", F.min("value")).otherwise(F.max("value"))
    return unpivot(daily, variables).groupBy(
        "station_id", "variable", F.year("obs_date").alias("year")).agg(
            extreme.alias("value"), F.count(F.lit(1)).alias("days"))


def climatology(daily: DataFrame, by: str = "doy",
                variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """Mean and sample deviation per station, variable and day of year or month."""
    part = {"doy": F.dayofyear("obs_date"), "month": F.month("obs_date")}[by]

    def aggregates(v: str) -> list[Column]:
        return [F.avg(v).alias("clim_mean"), F.stddev(v).alias("clim_std"), F.count(v).alias("days")]

    return long_groups(wide_groups(daily, part.alias(by), aggregates, variables), variables).select(
        "station_id", "variable", by, "clim_mean", "clim_std", "days")


def weekly(daily: DataFrame, variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """Means over weeks ending on Sunday; weeks without a value are absent."""
    week = units.week_ending_sunday(F.col("obs_date")).alias("week_end")
    return long_groups(wide_groups(daily, week, lambda v: [F.avg(v).alias("value")], variables), variables).select(
        "station_id", "variable", "week_end", "value")


def resample(daily: DataFrame, resolution: str, means: list[str], sums: list[str]) -> DataFrame:
    """Monthly or yearly series: means of some columns and totals of others."""
    unit = {"monthly": "month", "yearly": "year"}[resolution]
    return daily.groupBy("station_id", F.trunc("obs_date", unit).alias("obs_date")).agg(
        *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def hash_sample(df: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """Bernoulli-like sample by key hash: the same rows whatever the partitioning.

    The first 48 bits of the keys' md5 are compared with the fraction, so any fraction down
    to about 1e-14 is kept as asked; NULL keys are left out of the hashed text."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 12)
    return df.where(F.conv(digits, 16, 10).cast("double") < F.lit(fraction * 2.0 ** 48))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace current rows of the same key; others are kept.

    One aggregation instead of a join plus union: the struct with the higher rank wins."""
    columns = [c for c in current.columns if c != key]
    ranked = current.withColumn("_rank", F.lit(0)).unionByName(
        incoming.select(current.columns).withColumn("_rank", F.lit(1)))
    row = F.max_by(F.struct(*columns), F.col("_rank")).alias("_row")
    return ranked.groupBy(key).agg(row).select(key, *[f"_row.{c}" for c in columns])

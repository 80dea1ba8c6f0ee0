"""Scenario projections from a station's monthly climatology."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe import schemas
from skyframe.operators import daily as daily_ops

# Yearly change per scenario and variable, and the table's labels.
RATES = {
    "ssp126": {"tmax": 0.015, "tmin": 0.018, "prcp": 0.002},
    "ssp245": {"tmax": 0.028, "tmin": 0.032, "prcp": 0.003},
    "ssp370": {"tmax": 0.042, "tmin": 0.048, "prcp": 0.004},
    "ssp585": {"tmax": 0.060, "tmin": 0.065, "prcp": 0.005},
}
MODEL_NAME = "cmip6-ensemble-bc"
ENSEMBLE_SIZE = 5
BASE_YEAR = 2020


def month_climatology(daily: DataFrame, min_days: int = 365) -> DataFrame:
    """Monthly mean and deviation of series with enough days, with station latitude."""
    def aggregates(v: str) -> list[Column]:
        return [F.avg(v).alias("base"), F.coalesce(F.stddev(v), F.lit(2.0)).alias("spread"), F.count(v).alias("days"),
                F.max(F.when(F.col(v).isNotNull(), F.col("latitude"))).alias("latitude")]

    groups = daily_ops.wide_groups(daily, F.month("obs_date").alias("month"), aggregates)
    station = Window.partitionBy("station_id")
    summed = groups.withColumns({
        v: F.col(v).withField("total", F.sum(F.col(v)["days"]).over(station)) for v in schemas.VARIABLES})
    return daily_ops.long_groups(summed).where(F.col("total") >= min_days).drop("total", "days")


def _uniform(salt: int) -> Column:
    key = F.xxhash64("station_id", "variable", "scenario", "year", "month", F.lit(salt))
    return (F.pmod(key, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _gaussian() -> Column:
    """A repeatable standard normal number per output row, from its key."""
    return F.sqrt(-2 * F.log(_uniform(1))) * F.cos(2 * math.pi * _uniform(2))


def scenarios(daily: DataFrame, rates: dict[str, dict[str, float]] = RATES,
              years: tuple[int, int] = (2025, 2100), noise: float = 0.0,
              min_days: int = 365, digits: bool = True) -> DataFrame:
    """Monthly values and bounds per scenario and year.

    Scenario and year are expanded inside each climatology row (a thousandfold growth),
    so only the daily rows are shuffled, dealt by station over a fixed number of tasks
    because their own size says nothing about the output's. ``noise`` scales optional
    year-to-year variation (0.3 of the monthly deviation is customary)."""
    table = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.lit(by["tmax"]).alias("tmax"),
                 F.lit(by["tmin"]).alias("tmin"), F.lit(by["prcp"]).alias("prcp"))
        for name, by in rates.items()])
    rate = (F.when(F.col("variable") == "tmax", F.col("s.tmax"))
            .when(F.col("variable") == "tmin", F.col("s.tmin")).otherwise(F.col("s.prcp")))
    factor = F.lit(1.0) + F.abs(F.coalesce("latitude", F.lit(0.0))) / 90.0 * 0.5
    expanded = (
        month_climatology(daily, min_days)
        .withColumn("s", F.explode(table))
        .withColumn("rate", rate * factor)
        .withColumn("scenario", F.col("s.scenario"))
        .withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    )
    ahead = F.col("year") - BASE_YEAR
    floor = F.col("variable") == "prcp"

    def floored(c: Column) -> Column:
        return F.when(floor, F.greatest(c, F.lit(0.0))).otherwise(c)

    value = F.col("base") + F.col("rate") * ahead
    if noise:
        value = value + _gaussian() * F.col("spread") * noise
    margin = F.col("spread") * 0.5 * (ahead / 80.0 + 1) * 1.645

    def out(c: Column) -> Column:
        return F.round(c, 2) if digits else c

    return (expanded.withColumn("_value", floored(value)).withColumn("_margin", margin).select(
        "station_id", F.make_date("year", "month", F.lit(1)).alias("projection_date"),
        "scenario", "variable", out(F.col("_value")).alias("predicted_value"),
        out(floored(F.col("_value") - F.col("_margin"))).alias("lower_bound"),
        out(F.col("_value") + F.col("_margin")).alias("upper_bound"),
        F.lit(MODEL_NAME).alias("model_name"), F.lit(ENSEMBLE_SIZE).alias("ensemble_size"),
        F.lit(True).alias("bias_corrected")))

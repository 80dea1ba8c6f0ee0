"""Look-back windows, deviation scores and climatology features.

Input is the daily form (one row per station and day), so one window partition is at
most a station's calendar: about 55 000 rows for 150 years. Windows that share the
station key share one exchange and one sort; the day-of-year window reuses the same
hash partitioning, because rows of one station are already together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions import scores, units

AGGREGATES = {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "sum": F.sum}

# Which statistics are kept for each look-back in days.
DEFAULT_SPECS = {
    30: {"tmax": ["mean", "std", "min", "max"], "tmin": ["mean", "std", "min", "max"],
         "prcp": ["mean", "std", "sum", "max"]},
    90: {"tmax": ["mean", "std"], "tmin": ["mean", "std"], "prcp": ["mean", "sum"]},
    365: {"tmax": ["mean", "std"], "tmin": ["mean", "std"], "prcp": ["mean", "sum"]},
}


def _columns(spec: dict[str, list[str]], days: int, window) -> dict[str, Column]:
    return {f"{variable}_rolling_{days}d_{stat}": AGGREGATES[stat](variable).over(window)
            for variable, stats in spec.items() for stat in stats}


def rolling(daily: DataFrame, specs: dict[int, dict[str, list[str]]] = DEFAULT_SPECS,
            block_days: int | None = None) -> DataFrame:
    """Statistics over the last ``days`` days up to and including the row's own day.

    The frame is a date range (so ``days`` back plus today), ordered by an integer day
    number. With ``block_days`` one station's series is cut into blocks of that length
    and each block also receives the preceding look-back, so several tasks share a
    long series; the extra copies are dropped again and the result is the same.
    """
    keys = ["station_id"]
    frame = daily.withColumn("_day", units.epoch_day(F.col("obs_date")))
    if block_days:
        reach = max(specs)
        if block_days < reach:
            raise ValueError("block_days must be at least the longest look-back")
        own = F.floor(F.col("_day") / block_days)
        into_next = F.floor((F.col("_day") + reach) / block_days)
        frame = (frame.withColumn("_own", own)
                 .withColumn("_block", F.explode(F.sequence(own, into_next))))
        keys.append("_block")
    for days, spec in sorted(specs.items()):
        window = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-days, 0)
        frame = frame.withColumns(_columns(spec, days, window))
    if block_days:
        frame = frame.where(F.col("_block") == F.col("_own")).drop("_own", "_block")
    return frame.drop("_day")


def zscores(df: DataFrame, variables: list[str], days: int = 30) -> DataFrame:
    """Deviation of each value from its rolling mean in rolling deviations."""
    return df.withColumns({
        f"{v}_zscore_{days}d": scores.zscore(
            F.col(v), F.col(f"{v}_rolling_{days}d_mean"), F.col(f"{v}_rolling_{days}d_std"))
        for v in variables})


def doy_deviation(df: DataFrame, variables: list[str]) -> DataFrame:
    """Mean and deviation over all years of the same day of year, and the z-score."""
    window = Window.partitionBy("station_id", "day_of_year")
    frame = df.withColumn("day_of_year", F.dayofyear("obs_date")).withColumns({
        f"{v}_doy_{name}": AGGREGATES[name](v).over(window)
        for v in variables for name in ("mean", "std")})
    return frame.withColumns({
        f"{v}_climatology_deviation": scores.zscore(
            F.col(v), F.col(f"{v}_doy_mean"), F.col(f"{v}_doy_std"))
        for v in variables})


def features(daily: DataFrame, specs: dict[int, dict[str, list[str]]] = DEFAULT_SPECS,
             block_days: int | None = None) -> DataFrame:
    """All rolling statistics, 30-day z-scores and day-of-year deviations."""
    scored = zscores(rolling(daily, specs, block_days), ["tmax", "tmin", "prcp"])
    return doy_deviation(scored, ["tmax", "tmin"])


def latest_scores(daily: DataFrame, variables: list[str], rows: int = 365) -> DataFrame:
    """Each station's newest day scored against its last ``rows`` days, all stations
    at once. The rank filter is applied before the shuffle too, so at most ``rows``
    rows per station and input partition move."""
    order = Window.partitionBy("station_id").orderBy(F.col("obs_date").desc())
    recent = daily.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    newest = {v: F.max(F.when(F.col("_rank") == 1, F.col(v))) for v in variables}
    stats = recent.groupBy("station_id").agg(
        F.max("obs_date").alias("obs_date"),
        F.count(F.lit(1)).alias("days"),
        *[newest[v].alias(v) for v in variables],
        *[F.avg(v).alias(f"{v}_mean") for v in variables],
        *[F.stddev(v).alias(f"{v}_std") for v in variables])
    return stats.withColumns({
        f"{v}_z": F.when(F.col(f"{v}_std") > 0, (F.col(v) - F.col(f"{v}_mean")) / F.col(f"{v}_std"))
        for v in variables})

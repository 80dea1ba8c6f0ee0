"""Gaps and islands: runs of flagged days and their catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions import scores, units


def _order(key: list[str]):
    return Window.partitionBy(*key).orderBy("obs_date")


def with_state(daily: DataFrame, flag: Column) -> DataFrame:
    """The flag as 0/1, the previous row's flag and whether a run starts here."""
    order = _order(["station_id"])
    flagged = daily.withColumn("is_extreme", F.when(flag, 1).otherwise(0))
    lagged = flagged.withColumn("prev_extreme", F.lag("is_extreme", 1, 0).over(order))
    return lagged.withColumn(
        "event_start",
        F.when((F.col("is_extreme") == 1) & (F.col("prev_extreme") == 0), 1).otherwise(0))


def with_event_id(state: DataFrame) -> DataFrame:
    """Running number of the run each row belongs to."""
    order = _order(["station_id"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return state.withColumn("event_id", F.sum("event_start").over(order))


def calendar_runs(days: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Runs of adjacent calendar days among the given rows: day minus row number is
    constant inside a run, so one ordered window gives the run and its length."""
    key = key or ["station_id"]
    number = F.row_number().over(_order(key))
    anchored = days.withColumn("_anchor", units.epoch_day(F.col("obs_date")) - number)
    run = Window.partitionBy(*key, "_anchor")
    return anchored.withColumn("duration_days", F.count(F.lit(1)).over(run).cast("int")).drop("_anchor")


def events(daily: DataFrame, score: str, threshold: float = 2.0, sign: int = 1,
           peak: str = "tmax", adjacency: str = "row") -> DataFrame:
    """Catalogue of runs of days beyond a threshold.

    ``sign`` 1 looks for scores above the threshold, -1 for scores below its negative.
    ``adjacency`` "row" lets a run continue over missing days (rows follow each other),
    "calendar" ends it there.
    """
    known = daily.where(F.col(score).isNotNull())
    flag = scores.beyond(F.col(score) * sign, threshold)
    extreme = F.max(F.col(peak)) if sign > 0 else F.min(F.col(peak))
    if adjacency == "row":
        numbered = with_event_id(with_state(known, flag)).where("is_extreme = 1")
    else:
        hot = known.where(flag)
        order = _order(["station_id"])
        gap = F.datediff("obs_date", F.lag("obs_date").over(order))
        start = F.when(gap == 1, 0).otherwise(1)
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = hot.withColumn("_start", start).withColumn("event_id", F.sum("_start").over(running))
    return numbered.groupBy("station_id", "event_id").agg(
        F.min("obs_date").alias("start_date"),
        F.max("obs_date").alias("end_date"),
        F.count(F.lit(1)).alias("duration_days"),
        extreme.alias("peak_value"),
        F.avg(score).alias("mean_score"))


def by_decade(catalogue: DataFrame, floor: int | None = None) -> DataFrame:
    """Number, length and strength of events per decade, of those from ``floor`` on if given."""
    dated = catalogue.withColumn("decade", units.decade(F.year("start_date")))
    wanted = dated if floor is None else dated.where(F.col("decade") >= floor)
    return (wanted.groupBy("decade").agg(
                F.count(F.lit(1)).alias("total_events"),
                F.avg("duration_days").alias("avg_duration_days"),
                F.max("duration_days").alias("longest_days"),
                F.avg("mean_score").alias("avg_score"))
            .orderBy("decade"))

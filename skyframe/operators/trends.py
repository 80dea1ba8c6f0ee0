"""Monotonic-trend statistics of annual series: Mann-Kendall test and Sen's slope.

A series is first aggregated to one value per year, so it holds as many values as there
are calendar years. The statistics are then expressions over that short sorted array:
pairs are never emitted as rows and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyframe.functions import scores
from skyframe.operators import daily as daily_ops


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + term(x))


def annual_arrays(annual: DataFrame) -> DataFrame:
    """One row per series with its (year, value) pairs in year order; the array length
    is bounded by the number of calendar years, since ``annual`` has one row per year."""
    points = F.sort_array(F.collect_list(F.struct("year", "value")))
    return annual.groupBy("station_id", "variable").agg(points.alias("points")).withColumn(
        "n", F.size("points"))


def _pairs(points: Column) -> Column:
    """(value difference, year difference) of every earlier/later pair, inside the row."""
    def later(p, i):
        rest = F.slice(points, i + 2, F.greatest(F.size(points) - i - 1, F.lit(0)))
        return F.transform(rest, lambda q: F.struct(
            (q["value"] - p["value"]).alias("dv"), (q["year"] - p["year"]).alias("dt")))
    return F.flatten(F.transform(points, later))


def mann_kendall(series: DataFrame) -> DataFrame:
    """S, tau, tie-corrected variance, continuity-corrected z and two-sided p."""
    n = F.col("n").cast("double")
    values = F.transform("points", lambda p: p["value"])
    sizes = F.transform(F.array_distinct(values),
                        lambda v: F.size(F.filter(values, lambda x: x == v)).cast("double"))
    ties = _sum(sizes, lambda t: t * (t - 1) * (2 * t + 5))
    s, var = F.col("s"), F.col("var_s")
    shifted = F.when(s > 0, s - 1).when(s < 0, s + 1).otherwise(0.0)
    return (
        series.withColumn("s", _sum(_pairs(F.col("points")), lambda p: F.signum(p["dv"])))
        .withColumn("var_s", (n * (n - 1) * (2 * n + 5) - ties) / 18.0)
        .withColumn("tau", F.when(n > 1, s / (n * (n - 1) / 2)).otherwise(0.0))
        .withColumn("z_statistic", F.when(var > 0, shifted / F.sqrt(var)).otherwise(0.0))
        .withColumn("p_value", scores.two_sided_p(F.col("z_statistic")))
    )


def pair_counts(series: DataFrame) -> DataFrame:
    """How many earlier/later pairs rise, fall or tie."""
    def count(test):
        return F.size(F.filter(_pairs(F.col("points")), test)).cast("long")
    return series.select(
        "station_id", "variable", count(lambda p: p["dv"] > 0).alias("rising"),
        count(lambda p: p["dv"] < 0).alias("falling"), count(lambda p: p["dv"] == 0).alias("tied"))


def sen(series: DataFrame) -> DataFrame:
    """Median of all pair slopes, with bounds taken from the ordered slopes.

    The bounds use positions (N -/+ C) / 2 with C = 1.96 * sqrt(N) / 2, cut to whole
    numbers; this is narrower than the textbook interval and kept for equal results.
    """
    slopes = F.sort_array(F.transform(_pairs(F.col("points")), lambda p: p["dv"] / p["dt"]))
    count = F.size("slopes")
    half_width = F.lit(1.96) * F.sqrt(count.cast("double")) / 2
    lower = F.floor(F.greatest((count - half_width) / 2, F.lit(0.0))).cast("int")
    upper = F.floor(F.least((count + half_width) / 2, (count - 1).cast("double"))).cast("int")

    def at(position: Column) -> Column:
        return F.get(F.col("slopes"), position)

    median = (at(F.floor((count - 1) / 2).cast("int")) + at(F.floor(count / 2).cast("int"))) / 2
    empty = count == 0
    return series.withColumn("slopes", slopes).withColumns({
        "sens_slope": F.when(empty, 0.0).otherwise(median),
        "ci_lower": F.when(empty, 0.0).otherwise(at(lower)),
        "ci_upper": F.when(empty, 0.0).otherwise(at(upper)),
    }).drop("slopes")


def trend(daily: DataFrame, min_years: int = 10, digits: bool = True) -> DataFrame:
    """Trend table per station and variable; direction is the sign of the slope,
    whatever its significance."""
    series = annual_arrays(daily_ops.annual(daily)).where(F.col("n") >= min_years)
    full = sen(mann_kendall(series))
    slope = F.col("sens_slope")

    def out(name: Column, places: int) -> Column:
        return F.round(name, places) if digits else name

    return full.select(
        "station_id", "variable",
        F.col("points")[0]["year"].alias("period_start"),
        F.element_at("points", -1)["year"].alias("period_end"),
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("no_trend")
        .alias("trend_direction"),
        out(slope, 6).alias("sens_slope"),
        out(F.col("p_value"), 6).alias("p_value"),
        out(F.col("z_statistic"), 4).alias("z_statistic"),
        out(F.col("tau"), 4).alias("tau"),
        out(slope * 10, 4).alias("slope_per_decade"),
        out(F.col("ci_lower"), 6).alias("ci_lower"),
        out(F.col("ci_upper"), 6).alias("ci_upper"),
        (F.col("p_value") < 0.05).alias("significant"))

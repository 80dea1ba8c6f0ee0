"""Generalised extreme-value fits of yearly extremes, and return levels.

The default fit uses L-moments (Hosking 1990), a closed form over the ranked yearly
extremes that runs entirely as Spark expressions. ``likelihood`` refines it to the
maximum-likelihood fit with an Arrow UDF over one short array per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions import scores
from skyframe.operators import daily as daily_ops
from skyframe.operators.grouped import spread

# Return periods in years.
PERIODS = [10, 25, 50, 100]
EULER = 0.5772156649015329


def block_extremes(daily: DataFrame, min_days: int = 365, min_years: int = 10) -> DataFrame:
    """Yearly extremes oriented as maxima (tmin negated) of long enough series."""
    keys = ["station_id", "variable"]
    series = Window.partitionBy(*keys)
    blocks = daily_ops.annual_extreme(daily)
    oriented = F.when(F.col("variable") == "tmin", -F.col("value")).otherwise(F.col("value"))
    return (blocks.withColumn("value", oriented)
            .withColumn("_days", F.sum("days").over(series))
            .withColumn("_years", F.count(F.lit(1)).over(series))
            .where((F.col("_days") >= min_days) & (F.col("_years") >= min_years))
            .drop("_days", "_years", "days"))


def l_moments(blocks: DataFrame) -> DataFrame:
    """Probability-weighted moments b0, b1, b2 per series from the ascending ranks."""
    rank = F.row_number().over(Window.partitionBy("station_id", "variable").orderBy("value"))
    j, n = F.col("_rank").cast("double"), F.col("n_years").cast("double")
    x = F.col("value")
    sums = blocks.withColumn("_rank", rank).groupBy("station_id", "variable").agg(
        F.count(F.lit(1)).cast("int").alias("n_years"),
        F.sum(x).alias("s0"), F.sum((j - 1) * x).alias("s1"),
        F.sum((j - 1) * (j - 2) * x).alias("s2"))
    return sums.select(
        "station_id", "variable", "n_years", (F.col("s0") / n).alias("b0"),
        (F.col("s1") / (n * (n - 1))).alias("b1"),
        (F.col("s2") / (n * (n - 1) * (n - 2))).alias("b2"))


def fit(blocks: DataFrame) -> DataFrame:
    """GEV shape, location and scale per series. Positive shape means a bounded upper
    tail (Hosking's k). Constant series have no fit and are left out."""
    m = l_moments(blocks).withColumn("l2", 2 * F.col("b1") - F.col("b0")).where("l2 > 1e-12")
    l3 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    c = 2.0 / (F.lit(3.0) + l3 / F.col("l2")) - math.log(2) / math.log(3)
    shaped = m.withColumn("shape_param", 7.8590 * c + 2.9554 * c * c)
    k = F.col("shape_param")
    flat = F.abs(k) < 1e-6
    g = scores.gamma(k + 1)
    scale = F.when(flat, F.col("l2") / math.log(2)).otherwise(
        F.col("l2") * k / ((F.lit(1.0) - F.pow(F.lit(2.0), -k)) * g))
    scaled = shaped.withColumn("scale_param", scale)
    a = F.col("scale_param")
    location = F.when(flat, F.col("b0") - EULER * a).otherwise(
        F.col("b0") - a * (F.lit(1.0) - g) / k)
    return scaled.withColumn("location_param", location).select(
        "station_id", "variable", "n_years", "b0", "b1", "b2",
        "shape_param", "location_param", "scale_param")


def _negative_log_likelihoods(params: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One value for each row of ``params`` (shape, location, log of scale) and ``x`` (the extremes of a series)."""
    k, location, log_scale = (params[:, i, None] for i in range(3))
    with np.errstate(all="ignore"):
        y = (x - location) / np.exp(log_scale)
        flat = np.abs(k) < 1e-6
        inner = 1 - k * y
        reduced = np.where(flat, y, -np.log(inner) / np.where(flat, 1.0, k))
        total = x.shape[1] * log_scale[:, 0] + np.sum((1 - np.where(flat, 0.0, k)) * reduced + np.exp(-reduced), axis=1)
    return np.where(flat[:, 0] | (inner > 0).all(axis=1), total, math.inf)


def _negative_log_likelihood(k: float, location: float, log_scale: float, x: np.ndarray) -> float:
    return float(_negative_log_likelihoods(np.array([[k, location, log_scale]], dtype=float), np.asarray(x, dtype=float)[None, :])[0])


def _simplex_search(cost, start: np.ndarray, steps: int = 600) -> np.ndarray:
    """Downhill simplex for three parameters, for many problems in step: each row of ``start`` is one, and
    ``cost(which, points)`` gives a value for each point of the problems ``which``. A problem that has converged drops out."""
    best = start.copy()
    which = np.arange(len(start))
    points = start[:, None, :] + np.vstack([np.zeros(3), np.diag([0.1, 0.3, 0.2])])
    costs = np.stack([cost(which, points[:, i]) for i in range(4)], axis=1)
    for _ in range(steps):
        order = np.argsort(costs, axis=1)
        points, costs = np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(costs, order, axis=1)
        best[which] = points[:, 0]
        with np.errstate(invalid="ignore"):
            going = ~(costs[:, -1] - costs[:, 0] < 1e-10)
        which, points, costs = which[going], points[going], costs[going]
        if not len(which):
            return best
        centre = points[:, :-1].mean(axis=1)
        away = centre - points[:, -1]
        trial = centre + away
        trial_cost = cost(which, trial)
        good = np.flatnonzero(trial_cost < costs[:, 0])
        poor = np.flatnonzero(~(trial_cost < costs[:, 0]) & (trial_cost >= costs[:, -2]))
        further = centre[good] + 2 * away[good]
        further_cost = cost(which[good], further)
        lower = further_cost < trial_cost[good]
        trial[good[lower]], trial_cost[good[lower]] = further[lower], further_cost[lower]
        trial[poor] = centre[poor] + np.where(trial_cost[poor] < costs[poor, -1], 0.5, -0.5)[:, None] * away[poor]
        trial_cost[poor] = cost(which[poor], trial[poor])
        better = trial_cost < costs[:, -1]
        points[better, -1], costs[better, -1] = trial[better], trial_cost[better]
        shrunk = np.flatnonzero(~better)
        points[shrunk, 1:] = (points[shrunk, 1:] + points[shrunk, :1]) / 2
        for i in range(1, 4):
            costs[shrunk, i] = cost(which[shrunk], points[shrunk, i])
    best[which] = points[np.arange(len(which)), costs.argmin(axis=1)]
    return best


def _refine(values: pd.Series, k: pd.Series, location: pd.Series, scale: pd.Series) -> pd.DataFrame:
    """Fits of a batch of series; those with equally many years are searched together."""
    years = values.map(len).to_numpy()
    shape, place, width = (c.to_numpy(dtype=float) for c in (k, location, scale))
    found = np.empty((len(values), 3))
    for length in np.unique(years):
        at = np.flatnonzero(years == length)
        x = np.stack([np.asarray(values.iloc[i], dtype=float) for i in at])
        unit = np.stack([np.ones(len(at)), width[at], np.ones(len(at))], axis=1)
        shift = np.stack([np.zeros(len(at)), place[at], np.log(width[at])], axis=1)
        start = np.stack([shape[at], np.zeros(len(at)), np.zeros(len(at))], axis=1)
        best = _simplex_search(lambda which, p: _negative_log_likelihoods(p * unit[which] + shift[which], x[which]), start)
        found[at] = best * unit + shift
    found[:, 2] = np.exp(found[:, 2])
    return pd.DataFrame(found, columns=["shape_param", "location_param", "scale_param"])


def likelihood(blocks: DataFrame) -> DataFrame:
    """Maximum-likelihood fit started from the L-moment fit. Each UDF row carries one
    series' yearly extremes: as many numbers as calendar years."""
    start = fit(blocks).select("station_id", "variable", "n_years", F.struct(
        "shape_param", "location_param", "scale_param").alias("start"))
    arrays = blocks.groupBy("station_id", "variable").agg(
        F.sort_array(F.collect_list("value")).alias("values"))
    refine = F.pandas_udf(_refine, "shape_param double, location_param double, scale_param double")
    best = refine("values", "start.shape_param", "start.location_param", "start.scale_param")
    keys = ["station_id", "variable"]
    return (spread(start.join(arrays, keys), keys)
            .withColumn("best", best)
            .select("station_id", "variable", "n_years", "best.*"))


def quantile(k: Column, location: Column, scale: Column, period: Column) -> Column:
    """Level exceeded once in ``period`` years."""
    reduced = -F.log(F.lit(1.0) - F.lit(1.0) / period)
    gumbel = location - scale * F.log(reduced)
    return F.when(F.abs(k) < 1e-6, gumbel).otherwise(
        location + scale * (F.lit(1.0) - F.pow(reduced, k)) / k)


def return_levels(params: DataFrame, periods: list[int] = PERIODS, digits: bool = True) -> DataFrame:
    """Levels and simple intervals per return period; tmin is turned back into minima,
    which swaps its bounds."""
    spread = params.withColumn("return_period", F.explode(F.array(*[F.lit(p) for p in periods])))
    period = F.col("return_period").cast("double")
    level = quantile(F.col("shape_param"), F.col("location_param"), F.col("scale_param"), period)
    margin = (F.lit(1.96) * F.col("scale_param") / F.sqrt(F.col("n_years").cast("double"))
              * F.sqrt(F.log(period)))
    sign = F.when(F.col("variable") == "tmin", -1.0).otherwise(1.0)

    def out(c: Column, places: int) -> Column:
        return F.round(c, places) if digits else c

    return (spread.withColumn("_level", level * sign).withColumn("_margin", margin).select(
        "station_id", "variable", F.lit("gev").alias("distribution"), "return_period",
        out(F.col("_level"), 2).alias("return_level"),
        out(F.col("_level") - F.col("_margin"), 2).alias("lower_ci"),
        out(F.col("_level") + F.col("_margin"), 2).alias("upper_ci"),
        out(F.col("shape_param"), 6).alias("shape_param"),
        out(F.col("location_param"), 4).alias("location_param"),
        out(F.col("scale_param"), 4).alias("scale_param"), "n_years"))

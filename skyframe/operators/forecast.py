"""Forecasts per station and variable, their blend, evaluation and registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe import schemas
from skyframe.functions import units
from skyframe.operators import daily as daily_ops
from skyframe.operators.grouped import group_starts, spread, whole_groups

# Model weights of the blend, by the set of models present.
WEIGHTS = {"arx": 0.5, "harmonic": 0.3, "statistical": 0.2}
WEIGHTS_TWO = {"harmonic": 0.7, "statistical": 0.3}
KEYS = ["station_id", "forecast_date", "variable"]


def statistical(daily: DataFrame, horizon: int = 365, step: int = 7, min_days: int = 365,
                trend_days: int = 3650, x: str = "day", digits: bool = True) -> DataFrame:
    """Day-of-year climatology plus linear trend, entirely in Spark.

    The trend is the least-squares slope of the last ``trend_days`` days (0 with 365
    values or fewer), against the day number (``x="day"``) or the row number. Offsets
    1, 1+step, ... up to the horizon; days of year never observed are absent.

    One scan and one shuffle by station: the last days and the slopes are windows over the daily rows, all
    variables beside each other, and only the climatology becomes long. Each of its rows works out which forecast
    dates fall on its day of year, so the climatology is not joined back.
    """
    station = Window.partitionBy("station_id")
    so_far = station.orderBy("obs_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = schemas.VARIABLES
    marked = spread(daily.select("station_id", "obs_date", *found), ["station_id"]).withColumns(
        {f"_last_{v}": F.max(F.when(F.col(v).isNotNull(), F.col("obs_date"))).over(station) for v in found}
        | ({f"_row_{v}": F.count(v).over(so_far) for v in found} if x == "row" else {}))

    def slope(v: str) -> Column:
        recent = F.col(v).isNotNull() & (F.col("obs_date") >= F.date_sub(f"_last_{v}", trend_days))
        axis = F.col(f"_row_{v}") if x == "row" else units.epoch_day(F.col("obs_date"))
        in_trend = F.regr_slope(F.when(recent, F.col(v)), F.when(recent, axis))
        return F.when(F.count_if(recent).over(station) > 365, F.coalesce(in_trend.over(station), F.lit(0.0))).otherwise(0.0)

    described = marked.withColumns(
        {f"_slope_{v}": slope(v) for v in found} | {f"_days_{v}": F.count(v).over(station) for v in found})

    def aggregates(v: str) -> list[Column]:
        return [F.avg(v).alias("base"), F.coalesce(F.stddev(v), F.lit(2.0)).alias("spread"), F.max(f"_last_{v}").alias("last"),
                F.max(f"_slope_{v}").alias("slope"), F.max(f"_days_{v}").alias("days")]

    clim = daily_ops.long_groups(daily_ops.wide_groups(described, F.dayofyear("obs_date").alias("doy"), aggregates)).where(F.col("days") >= min_days)

    def wanted(date: Column) -> Column:
        ahead = F.datediff(date, F.col("last"))
        return ahead.between(1, horizon) & (F.pmod(ahead - 1, F.lit(step)) == 0) & (
            F.dayofyear(date) == F.col("doy"))

    years = F.sequence(F.year("last"), F.year(F.date_add("last", horizon)))
    dates = F.filter(F.transform(
        years, lambda y: F.date_add(F.make_date(y, F.lit(1), F.lit(1)), F.col("doy") - 1)), wanted)
    dated = clim.withColumn("forecast_date", F.explode(dates))
    value = F.col("base") + F.col("slope") * F.datediff("forecast_date", "last")
    floored = F.when(F.col("variable") == "prcp", F.greatest(value, F.lit(0.0))).otherwise(value)
    margin = F.col("spread") * 1.645

    def out(c: Column) -> Column:
        return F.round(c, 2) if digits else c

    return dated.withColumn("_value", floored).select(
        "station_id", "forecast_date", "variable", out(F.col("_value")).alias("predicted_value"),
        out(F.col("_value") - margin).alias("lower_bound"),
        out(F.col("_value") + margin).alias("upper_bound"),
        F.lit("statistical").alias("model_type"), F.lit("1.0").alias("model_version"),
        F.lit(None).cast("double").alias("mae"), F.lit(None).cast("double").alias("rmse"))


def _series(daily: DataFrame, min_days: int, min_rows: int) -> DataFrame:
    """Weekly means, one row for each week and usable variable, with the other variables' means
    beside it. Days are counted with the means, so the daily form is read and shuffled once;
    a station's weeks are bounded by the calendar."""
    week = units.week_ending_sunday(F.col("obs_date")).alias("week_end")
    weeks = daily.groupBy("station_id", week).agg(
        *[F.avg(v).alias(v) for v in schemas.VARIABLES],
        *[F.count(v).alias(f"_{v}") for v in schemas.VARIABLES], F.count(F.lit(1)).alias("_rows"))
    station = Window.partitionBy("station_id")
    usable = [F.when((F.sum(f"_{v}").over(station) >= min_days) & (F.sum("_rows").over(station) >= min_rows), F.lit(v))
              for v in schemas.VARIABLES]
    named = weeks.withColumn("_usable", F.array_compact(F.array(*usable))).withColumn("variable", F.explode("_usable"))
    return named.select("station_id", "week_end", *schemas.VARIABLES, "variable")


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * days[:, None] * np.arange(1, order + 1)[None, :] / period
    return np.hstack([np.sin(angle), np.cos(angle)])


def _solve(design: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(design.T @ design + np.diag(penalty), design.T @ y)


def _harmonic_fit(days: np.ndarray, y: np.ndarray, rainy: bool, knots: int = 25):
    """Piecewise-linear trend plus yearly (and for rain quarterly) waves, by ridge."""
    start, span = days[0], max(days[-1] - days[0], 1.0)
    hinges = np.linspace(0, 0.8, knots + 1)[1:]

    def design(at):
        t = (at - start) / span
        blocks = [np.ones((len(at), 1)), t[:, None], np.maximum(t[:, None] - hinges[None, :], 0),
                  _fourier(at, 365.25, 10)]
        if rainy:
            blocks.append(_fourier(at, 91.25, 5))
        return np.hstack(blocks)

    matrix = design(days)
    penalty = np.full(matrix.shape[1], 0.1)
    penalty[:2] = 1e-8
    penalty[2:2 + knots] = 20.0
    weights = _solve(matrix, y, penalty)
    return lambda at: design(at) @ weights


def _per_series(daily: DataFrame, min_days: int, min_rows: int, model: str, version: str, fit) -> DataFrame:
    """Forecast rows of every series for which ``fit(variable, days, columns)`` gives (days ahead, value, low, high, MAE,
    RMSE); a task hands on some series at a time. ``columns`` holds all variables' weekly means, by name."""
    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = group_starts(pdf["station_id"], pdf["variable"])
        columns = {c: pdf[c].to_numpy(dtype=float) for c in ("day", *schemas.VARIABLES)}
        found = []
        for low, high in zip(starts, [*starts[1:], len(pdf)]):
            variable = pdf["variable"].iloc[low]
            fitted = fit(variable, columns["day"][low:high], {v: columns[v][low:high] for v in schemas.VARIABLES})
            if fitted is not None:
                ahead, value, lower, upper, mae, rmse = fitted
                found.append((pdf["station_id"].iloc[low], variable, ahead, np.maximum(value, 0.0) if variable == "prcp" else value,
                              lower, upper, round(mae, 4), round(rmse, 4)))
        if not found:
            return _EMPTY
        station, variable, ahead, value, lower, upper, mae, rmse = zip(*found)
        steps = [len(a) for a in ahead]
        days = np.concatenate(ahead).astype(np.int64).astype("datetime64[D]")
        return pd.DataFrame({
            "station_id": np.repeat(np.array(station, dtype=object), steps), "forecast_date": days.astype(object),
            "variable": np.repeat(np.array(variable, dtype=object), steps),
            "predicted_value": np.round(np.concatenate(value), 2), "lower_bound": np.round(np.concatenate(lower), 2),
            "upper_bound": np.round(np.concatenate(upper), 2), "model_type": model, "model_version": version,
            "mae": np.repeat(mae, steps), "rmse": np.repeat(rmse, steps)})

    keys = ["station_id", "variable"]
    weeks = spread(_series(daily, min_days, min_rows), keys).withColumn("day", units.epoch_day(F.col("week_end"))).drop("week_end")
    return whole_groups(weeks, keys, "day", several, schemas.FORECAST)


def _errors(truth: np.ndarray, guess: np.ndarray) -> tuple[float, float]:
    return float(np.mean(np.abs(truth - guess))), float(np.sqrt(np.mean((truth - guess) ** 2)))


_EMPTY = pd.DataFrame(columns=schemas.FORECAST_COLUMNS)


def harmonic(daily: DataFrame, min_days: int = 365, weeks: int = 52, holdout: int = 52,
             min_rows: int = 730) -> DataFrame:
    """Weekly harmonic regression of stations with at least ``min_rows`` daily rows and 52
    weeks, scored on the last ``holdout`` weeks (fewer in a short series), then refitted
    and extended ``weeks`` weeks with a 90 % interval from the residual quantiles."""
    def one_series(variable, day, columns):
        known = ~np.isnan(columns[variable])
        day, y = day[known], columns[variable][known]
        if len(y) < 52:
            return None
        held, rainy = min(holdout, len(y) - 30), variable == "prcp"
        mae, rmse = _errors(y[-held:], _harmonic_fit(day[:-held], y[:-held], rainy)(day[-held:]))
        model = _harmonic_fit(day, y, rainy)
        low, high = np.quantile(y - model(day), [0.05, 0.95])
        ahead = day[-1] + 7.0 * np.arange(1, weeks + 1)
        value = model(ahead)
        return ahead, value, value + low, value + high, mae, rmse

    return _per_series(daily, min_days, min_rows, "harmonic", "1.0", one_series)


def _filled(x: np.ndarray) -> np.ndarray:
    """Gaps take the value before, those at the start the first one."""
    known = np.flatnonzero(~np.isnan(x))
    return x if not len(known) else x[known[np.maximum(np.searchsorted(known, np.arange(len(x)), side="right") - 1, 0)]]


def _lags(y: np.ndarray, others: np.ndarray, own: int, cross: int) -> np.ndarray:
    """One row per predictable step: own lags, the others' lags, constant."""
    first = max(own, cross)
    columns = [y[first - k:len(y) - k] for k in range(1, own + 1)]
    columns += [others[first - k:len(y) - k, j] for j in range(others.shape[1]) for k in range(1, cross + 1)]
    return np.column_stack([*columns, np.ones(len(y) - first)])


def arx(daily: DataFrame, min_days: int = 365, weeks: int = 52, holdout: int = 52,
        own: int = 12, cross: int = 4, min_rows: int = 730) -> DataFrame:
    """Weekly autoregression on 12 own lags, 4 lags of the other variables and yearly
    waves, by ridge; extended step by step with the others held at their last value.
    Bounds are the 5 % and 95 % residual quantiles."""
    def one_series(variable, day, columns):
        names = [v for v in schemas.VARIABLES if v != variable and not np.isnan(columns[v]).all()]
        known = ~np.isnan(columns[variable])
        day, y = day[known], columns[variable][known]
        if len(y) < 52:
            return None
        held = min(holdout, len(y) - 3 * own)
        others = np.column_stack([_filled(columns[v][known]) for v in names]) if names else np.empty((len(y), 0))

        def fit(stop):
            matrix = np.hstack([_lags(y[:stop], others[:stop], own, cross),
                                _fourier(day[own:stop], 365.25, 4)])
            weights = _solve(matrix, y[own:stop], np.full(matrix.shape[1], 1.0))
            return weights, y[own:stop] - matrix @ weights

        def extend(weights, stop, days):
            """Only the own lags depend on the steps before; what the rest adds is known for all steps."""
            side = np.vstack([others[stop - cross:stop], np.repeat(others[stop - 1:stop], len(days), axis=0)])
            lags = [side[cross - k:len(side) - k, j] for j in range(side.shape[1]) for k in range(1, cross + 1)]
            rest = np.column_stack([*lags, np.ones(len(days)), _fourier(days, 365.25, 4)]) @ weights[own:]
            past, backwards = np.r_[y[stop - own:stop], np.empty(len(days))], weights[own - 1::-1].copy()
            for i, more in enumerate(rest):
                past[own + i] = past[i:own + i] @ backwards + more
            return past[own:]

        cut = len(y) - held
        mae, rmse = _errors(y[cut:], extend(fit(cut)[0], cut, day[cut:]))
        weights, residual = fit(len(y))
        low, high = np.quantile(residual, [0.05, 0.95])
        ahead = day[-1] + 7.0 * np.arange(1, weeks + 1)
        value = extend(weights, len(y), ahead)
        return ahead, value, value + low, value + high, mae, rmse

    return _per_series(daily, min_days, min_rows, "arx", "2.0-multivariate", one_series)


def ensemble(forecasts: DataFrame, weights: dict[str, float] = WEIGHTS, normalize: bool = True,
             align_weeks: bool = True, version: str | None = None) -> DataFrame:
    """Weighted blend of the models' rows: one aggregation over their union.

    ``align_weeks`` moves every date to its closing Sunday so that models meet, and
    ``normalize`` divides by the weights present; without it a lone model contributes
    only its share. Errors are carried from the harmonic model.
    """
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("model_type") == name, w).otherwise(weight)
    date = units.week_ending_sunday(F.col("forecast_date")) if align_weeks else F.col("forecast_date")
    weighted = forecasts.withColumns({"_w": weight, "forecast_date": date}).where("_w is not null")

    def blend(name: str) -> Column:
        total = F.sum(F.coalesce(F.col(name), F.lit(0.0)) * F.col("_w"))
        return (total / F.sum("_w") if normalize else total).alias(name)

    def carried(name: str) -> Column:
        return F.max(F.when(F.col("model_type") == "harmonic", F.col(name))).alias(name)

    tag = version or "_".join(f"{name}_{w:g}" for name, w in weights.items())
    return weighted.groupBy(*KEYS).agg(
        blend("predicted_value"), blend("lower_bound"), blend("upper_bound"),
        carried("mae"), carried("rmse")).select(
            *KEYS, "predicted_value", "lower_bound", "upper_bound",
            F.lit("ensemble").alias("model_type"), F.lit(tag).alias("model_version"), "mae", "rmse")


def evaluate(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """MAE and RMSE per station and variable over matching keys."""
    error = F.col("predicted_value") - F.col("actual_value")
    return predicted.join(actual, keys).groupBy("station_id", "variable").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("points"))


def registry_rows(forecasts: DataFrame, trained_at: Column) -> DataFrame:
    """One registry row per model, station and variable."""
    return forecasts.groupBy(
        "station_id", "variable", F.col("model_type").alias("model_name"),
        F.col("model_version").alias("version")).agg(
            F.max("mae").alias("mae"), F.max("rmse").alias("rmse")).withColumn("trained_at", trained_at)


def active_models(registry: DataFrame) -> DataFrame:
    """The newest version of every (model, station, variable)."""
    columns = [c for c in registry.columns if c not in ("model_name", "station_id", "variable")]
    newest = F.max_by(F.struct(*columns), F.struct("trained_at", "version")).alias("_row")
    return registry.groupBy("model_name", "station_id", "variable").agg(newest).select(
        "model_name", "station_id", "variable", *[f"_row.{c}" for c in columns],
        F.lit(True).alias("is_active"))

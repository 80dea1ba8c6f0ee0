"""Gap filling and seasonal decomposition of daily series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe import schemas
from skyframe.operators.grouped import group_starts, spread, whole_groups


def interpolate(daily: DataFrame, variables: list[str], limit: int = 30) -> DataFrame:
    """Fill gaps by row position: linear for the first ``limit`` rows of a gap, then the
    next known value, and the last known value at the end of a series.

    "Next known" is a running last value in descending order: both directions cost one
    pass, where a frame reaching to the end of the partition would be quadratic.
    """
    forward = Window.partitionBy("station_id").orderBy("obs_date")
    backward = Window.partitionBy("station_id").orderBy(F.col("obs_date").desc())
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    frame = daily.withColumn("_row", F.row_number().over(forward))
    known = {v: F.when(F.col(v).isNotNull(), F.struct("_row", F.col(v).alias("value")))
             for v in variables}
    frame = frame.withColumns({f"_prev_{v}": F.last(known[v], True).over(forward.rowsBetween(*up_to_here))
                               for v in variables})
    frame = frame.withColumns({f"_next_{v}": F.last(known[v], True).over(backward.rowsBetween(*up_to_here))
                               for v in variables})

    def filled(v: str) -> Column:
        before, after = F.col(f"_prev_{v}"), F.col(f"_next_{v}")
        step = F.col("_row") - before["_row"]
        slope = (after["value"] - before["value"]) / (after["_row"] - before["_row"])
        inside = before.isNotNull() & after.isNotNull() & (step <= limit)
        return (F.when(F.col(v).isNotNull(), F.col(v))
                .when(inside, before["value"] + slope * step)
                .otherwise(F.coalesce(after["value"], before["value"])))

    result = frame.withColumns({v: filled(v) for v in variables})
    return result.drop("_row", *[f"_prev_{v}" for v in variables], *[f"_next_{v}" for v in variables])


def classical(daily: DataFrame, value: str, period: int) -> DataFrame:
    """Trend by centred moving average over one odd period, seasonal by phase means
    (averaging to zero), residual. Rows without a full window have no trend."""
    if period % 2 == 0:
        raise ValueError("classical needs an odd period")
    half = period // 2
    station = Window.partitionBy("station_id")
    centred = station.orderBy("obs_date").rowsBetween(-half, half)
    phase = Window.partitionBy("station_id", "phase")
    numbered = daily.withColumn(
        "phase", F.pmod(F.row_number().over(station.orderBy("obs_date")) - 1, F.lit(period)))
    trended = numbered.withColumn(
        "trend", F.when(F.count(F.lit(1)).over(centred) == period, F.avg(value).over(centred)))
    means = (trended.withColumn("_mean", F.avg(F.col(value) - F.col("trend")).over(phase))
             .withColumn("_rows", F.count(F.lit(1)).over(phase)))
    share = F.lit(1.0) / F.col("_rows")
    level = F.sum(F.col("_mean") * share).over(station) / F.sum(
        F.when(F.col("_mean").isNotNull(), share)).over(station)
    seasonal = means.withColumn("seasonal", F.col("_mean") - level)
    return seasonal.withColumn(
        "residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_mean", "_rows")


@lru_cache(maxsize=32)
def _kernels(n: int, q: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbourhood weights (rows: evaluation points low..high-1, columns: data
    positions), also times the offset from the point and its square."""
    at = np.arange(low, high)
    width = min(q, n)
    left = np.clip(at - (q - 1) // 2, 0, n - width)
    reach = np.maximum(at - left, left + width - 1 - at) + max(0, (q - n) // 2)
    position = np.arange(n)
    distance = np.abs(position[None, :] - at[:, None])
    inside = (position >= left[:, None]) & (position < (left + width)[:, None])
    ratio = distance / np.maximum(reach, 1)[:, None]
    weight = np.where(ratio <= 0.001, 1.0, (1 - np.minimum(ratio, 1) ** 3) ** 3)
    weight = np.where(inside & (ratio <= 0.999), weight, 0.0)
    offset = position[None, :] - at[:, None]
    return weight.T, (weight * offset).T, (weight * offset ** 2).T


def _line(s0, s1, s2, span):
    """What the weighted sums of values, plain and times the offset, count in a local linear fit at offset 0, from the
    sums of the weights; flat where offsets barely vary."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale, centre = 1 / s0, s1 / s0
        variance = s2 / s0 - centre ** 2
        sloped = np.sqrt(np.maximum(variance, 0)) > 0.001 * span
        tilt = np.where(sloped, centre * scale / variance, 0.0)
        return scale + centre * tilt, -tilt


def _dense(q: int, low: int, high: int, width: int, rw: np.ndarray | None):
    """The smoother of one or many series of ``width`` values, weighted by ``rw`` (1 without it), at the points low..high-1."""
    weights, first, second = _kernels(width, q, low, high)
    sums = [k.sum(axis=0) if rw is None else rw @ k for k in (weights, first, second)]
    plain, tilted = _line(*sums, max(width - 1, 1))

    def smooth(y: np.ndarray) -> np.ndarray:
        ry = y if rw is None else rw * y
        with np.errstate(invalid="ignore"):
            return plain * (ry @ weights) + tilted * (ry @ first)

    return smooth


@lru_cache(maxsize=32)
def _banded(q: int, step: int, powers: int) -> np.ndarray:
    """A matrix from ``step + q - 1`` values to the weighted sums around the middle ``step`` of them, one block a power."""
    kernels = _kernels(q, q, (q - 1) // 2, (q - 1) // 2 + 1)[:powers]
    out = np.zeros((step + q - 1, powers, step))
    for at in range(step):
        for power, kernel in enumerate(kernels):
            out[at:at + q, power, at] = kernel[:, 0]
    return out.reshape(step + q - 1, powers * step)


def _inner_sums(x: np.ndarray, q: int, powers: int) -> list[np.ndarray]:
    """Weighted sums of all windows of ``q`` values of each row: short blocks times one banded matrix."""
    step = max(32, q // 2)
    blocks = -(-(x.shape[1] - q + 1) // step)
    padded = np.pad(x, ((0, 0), (0, blocks * step + q - 1 - x.shape[1])))
    cut = np.lib.stride_tricks.sliding_window_view(padded, step + q - 1, axis=1)[:, ::step]
    sums = (cut.reshape(-1, step + q - 1) @ _banded(q, step, powers)).reshape(len(x), blocks, powers, step)
    return [sums[:, :, power].reshape(len(x), blocks * step)[:, :x.shape[1] - q + 1] for power in range(powers)]


def _smoother(n: np.ndarray, width: int, q: int, rw: np.ndarray | None):
    """Local linear smoother of many evenly spaced series: rows of ``width`` values, the first ``n`` of each and zero behind.
    Away from the ends the weights are the same everywhere, so the sums are convolutions. What depends on the weights
    alone is worked out once."""
    half, parts = (q - 1) // 2, []
    for length in np.unique(n[n <= q]):
        at = np.flatnonzero(n == length)
        parts.append((at, length, _dense(q, 0, length, length, None if rw is None else rw[at, :length])))
    at = np.flatnonzero(n > q)
    long, rows = n[at], np.arange(len(at))[:, None]
    inside, last = np.arange(width) < long[:, None], (long - q)[:, None] + np.arange(q)
    ends = (long - half)[:, None] + np.arange(half)
    if len(at):
        own = None if rw is None else rw[at]
        sums = [k.sum() for k in _kernels(q, q, half, half + 1)] if rw is None else _inner_sums(own, q, 3)
        plain, tilted = _line(*sums, (long - 1)[:, None])
        head = _dense(q, 0, half, q, None if rw is None else own[:, :q])
        tail = _dense(q, q - half, q, q, None if rw is None else own[rows, last])

    def smooth(y: np.ndarray) -> np.ndarray:
        out = np.zeros(y.shape)
        for few, length, dense in parts:
            out[few, :length] = dense(y[few, :length])
        if len(at):
            y = y[at]
            level, slope = _inner_sums(y if rw is None else own * y, q, 2)
            fit = np.zeros(y.shape)
            with np.errstate(invalid="ignore"):
                fit[:, half:half + level.shape[1]] = plain * level + tilted * slope
            fit[:, :half] = head(y[:, :q])
            fit[rows, ends] = tail(y[rows, last])
            out[at] = np.where(inside, fit, 0.0)
        return out

    return smooth


def _loess(y: np.ndarray, q: int, rw: np.ndarray) -> np.ndarray:
    """The smooth of one series."""
    return _smoother(np.array([len(y)]), len(y), q, rw[None, :])(y[None, :])[0]


def _phases(n: np.ndarray, width: int, period: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By length: the places of all phases of that length in rows of ``width`` values, and in rows that are
    one period longer at both ends."""
    lengths = (n[:, None] - np.arange(period) + period - 1) // period
    found = []
    for length in np.unique(lengths[lengths > 0]):
        row, phase = np.nonzero(lengths == length)
        steps = period * np.arange(length + 2)
        found.append((int(length), (row * width + phase)[:, None] + steps[:length],
                      (row * (width + 2 * period) + phase)[:, None] + steps))
    return found


def _cycle_smoother(rw: np.ndarray, phases: list, period: int, q: int):
    """The smoother of each phase over the years, one step beyond both ends."""
    parts = [(read, written, _dense(q, -1, length + 1, length, np.take(rw, read))) for length, read, written in phases]

    def smooth(detrended: np.ndarray) -> np.ndarray:
        out = np.zeros((len(detrended), detrended.shape[1] + 2 * period))
        for read, written, dense in parts:
            values = np.take(detrended, read)
            fit = dense(values)
            if not np.isfinite(fit).all():
                fit = np.where(np.isfinite(fit), fit, np.pad(values, ((0, 0), (1, 1)), mode="edge"))
            out.ravel()[written] = fit
        return out

    return smooth


def _moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    return (total[:, width:] - total[:, :-width]) / width


def seasonal_trends(series: list[np.ndarray], period: int, seasonal: int, trend: int,
                    robust: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seasonal-trend decomposition by LOESS (Cleveland et al. 1990) of several series, all in step: each operation
    works on rows padded to the longest series. Series that lie within one span of the smoothers go by equal lengths,
    as their kernels depend on the length."""
    n = np.array([len(y) for y in series])
    low_pass = period + 1 if period % 2 == 0 else period + 2
    if len(set(n)) > 1 and n.min() <= max(trend, low_pass):
        fitted = {}
        for length in sorted(set(n)):
            at = np.flatnonzero(n == length)
            fitted.update(zip(at, seasonal_trends([series[i] for i in at], period, seasonal, trend, robust)))
        return [fitted[i] for i in range(len(series))]
    inside = np.arange(n.max()) < n[:, None]
    y = np.zeros(inside.shape)
    y[inside] = np.concatenate(series)
    rounds, inner = (16, 2) if robust else (1, 5)
    rw, phases = inside.astype(float), _phases(n, y.shape[1], period)
    level, cycle = np.zeros(y.shape), np.zeros(y.shape)
    rows, below = np.arange(len(n)), _smoother(n, y.shape[1], low_pass, None)
    for turn in range(rounds):
        by_phase, over_time = _cycle_smoother(rw, phases, period, seasonal), _smoother(n, y.shape[1], trend, rw)
        for _ in range(inner):
            smooth = by_phase(y - level)
            low = np.where(inside, _moving_mean(_moving_mean(_moving_mean(smooth, period), period), 3), 0.0)
            cycle = np.where(inside, smooth[:, period:period + y.shape[1]] - below(low), 0.0)
            level = over_time(y - cycle)
        if turn + 1 < rounds:
            size = np.abs(y - cycle - level)
            ranked = np.sort(np.where(inside, size, np.inf), axis=1)
            scale = 6 * (ranked[rows, (n - 1) // 2] + ranked[rows, n // 2])[:, None] / 2
            ratio = np.where(scale > 0, size / np.where(scale > 0, scale, 1.0), 0.0)
            rw = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - ratio ** 2) ** 2, 0.0)) * inside
    rest = y - level - cycle
    return [(level[i, :k], cycle[i, :k], rest[i, :k]) for i, k in enumerate(n)]


def seasonal_trend(y: np.ndarray, period: int, seasonal: int, trend: int,
                   robust: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``seasonal_trends`` of one series."""
    return seasonal_trends([y], period, seasonal, trend, robust)[0]


def stl(daily: DataFrame, period: int = 365, seasonal: int = 365, trend: int = 731,
        robust: bool = True, min_rows: int = 730,
        variables: list[str] = schemas.VARIABLES) -> DataFrame:
    """Trend, seasonal and residual of each variable and station.

    Gaps are filled by ``interpolate`` in Spark; only the smoothing runs in Python, over
    the daily rows of some stations at a time (calendar-bounded). Short or constant
    series get NULL components."""
    parts = ["trend", "seasonal", "residual"]
    narrow = spread(daily.select("station_id", "obs_date", *variables), ["station_id"])
    filled = interpolate(narrow, variables)
    schema = "station_id string, obs_date date, " + ", ".join(
        f"{v} double" for v in variables) + ", " + ", ".join(
            f"{v}_{p} double" for v in variables for p in parts)

    def stations(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = group_starts(pdf["station_id"])
        fitted = {f"{v}_{p}": np.full(len(pdf), np.nan) for v in variables for p in parts}
        usable = [(v, slice(low, high)) for low, high in zip(starts, [*starts[1:], len(pdf)]) for v in variables
                  if high - low >= min_rows]
        series = [pdf[v].to_numpy(dtype=float)[rows] for v, rows in usable]
        kept = [i for i, y in enumerate(series) if not np.isnan(y).any() and np.ptp(y) > 0]
        for i, found in zip(kept, seasonal_trends([series[i] for i in kept], period, seasonal, trend, robust) if kept else ()):
            for name, component in zip(parts, found):
                fitted[f"{usable[i][0]}_{name}"][usable[i][1]] = component
        return pdf.assign(**fitted)

    fitted = whole_groups(filled, ["station_id"], "obs_date", stations, schema)
    components = [f"{v}_{p}" for v in variables for p in parts]
    return fitted.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in [*variables, *components]})

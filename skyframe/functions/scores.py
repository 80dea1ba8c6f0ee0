"""Scores, classification rules and special functions as Column expressions."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, functions as F


# Fixed value: scores closer than this are equal. Their sums differ in the last bits with the order of the rows, and short
# look-backs give exact ties (two days: 0.7071 for every variable; three equal days and another: 1.5).
ROUNDING = 1e-9


def beyond(x: Column, limit: Column | float) -> Column:
    """x > limit, where what is equal up to rounding is not beyond."""
    return x > (limit if isinstance(limit, Column) else F.lit(limit)) + ROUNDING


def at_least(x: Column, limit: Column | float) -> Column:
    """x >= limit, where what is equal up to rounding is enough."""
    return x >= (limit if isinstance(limit, Column) else F.lit(limit)) - ROUNDING


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, and 0 where std is zero or unknown."""
    return F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))


def min_max(x: Column, low: Column, high: Column, constant: float) -> Column:
    """x rescaled to 0..1, or ``constant`` when all values coincide."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(constant))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


class Limits(NamedTuple):
    """Thresholds of the six-branch rule, in standard deviations."""

    heat: float = 2.0
    cold: float = -2.0
    rain: float = 2.0
    mild_heat: float = 1.5
    mild_cold: float = -1.5


def classify(tmax_z: Column, tmin_z: Column, prcp_z: Column, tmax_clim: Column,
             limits: Limits = Limits()) -> Column:
    """Type of an already flagged day; unknown scores count as 0."""
    hot, cold, wet, clim = (F.coalesce(c, F.lit(0.0)) for c in (tmax_z, tmin_z, prcp_z, tmax_clim))
    return (
        F.when(beyond(hot, limits.heat) | beyond(clim, limits.heat), "heatwave")
        .when(beyond(-cold, -limits.cold) | beyond(-hot, -limits.cold), "cold_snap")
        .when(beyond(wet, limits.rain), "precip_extreme")
        .when(beyond(hot, limits.mild_heat), "heatwave")
        .when(beyond(-cold, -limits.mild_cold), "cold_snap")
        .when(beyond(F.abs(wet), F.abs(hot)), "precip_extreme")
        .otherwise("heatwave")
    )


def classify_extreme(tmax_z: Column, tmin_z: Column, prcp_z: Column, heat: float = 2.5,
                     cold: float = -2.5, rain: float = 2.5) -> Column:
    """Priority rule heat > cold > rain; NULL when no limit is passed."""
    return (
        F.when(beyond(tmax_z, heat), "heatwave")
        .when(beyond(-tmin_z, -cold), "cold_snap")
        .when(beyond(prcp_z, rain), "precip_extreme")
    )


def severity(z: Column, scale: float = 5.0) -> Column:
    return F.least(F.abs(z) / F.lit(scale), F.lit(1.0))


def describe(kind: Column, sev: Column, days: Column, temp_z: Column, rain_z: Column,
             method: str | Column) -> Column:
    """One readable sentence per event."""
    tail = F.concat(F.lit(" ["), F.lit(method), F.lit("]"))

    def text(template: str, z: Column) -> Column:
        return F.concat(F.format_string(template, sev, days, F.coalesce(z, F.lit(0.0))), tail)

    return (
        F.when(kind == "heatwave", text("Hot spell of severity %.2f over %d day(s), %+.1f standard deviations", temp_z))
        .when(kind == "cold_snap", text("Cold spell of severity %.2f over %d day(s), %+.1f standard deviations", temp_z))
        .otherwise(text("Heavy rain of severity %.2f over %d day(s), %+.1f standard deviations", rain_z))
    )


def color_bin(value: Column, low: Column, high: Column, classes: int = 16) -> Column:
    """Colour class 0..classes-1 of a value inside [low, high]."""
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    share = F.greatest(F.least((value - low) / span, F.lit(1.0)), F.lit(0.0))
    return F.floor(share * (classes - 1) + 0.5).cast("int")


def _horner(x: Column, coefficients: list[float]) -> Column:
    result = F.lit(coefficients[0])
    for c in coefficients[1:]:
        result = result * x + F.lit(c)
    return result


# Published rational approximation of the normal tail (Hart 1968).
_TAIL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376]
_TAIL_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def two_sided_p(z: Column) -> Column:
    """P(|N(0,1)| > |z|) to double precision, without a UDF."""
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    near = bell * _horner(x, _TAIL_TOP) / _horner(x, _TAIL_BOTTOM)
    chain = x + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        chain = x + F.lit(step) / chain
    far = bell / chain / F.lit(2.506628274631)
    return F.lit(2.0) * F.when(x < 7.07106781186547, near).when(x < 37, far).otherwise(0.0)


# Published Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012,
            9.9843695780195716e-6, 1.5056327351493116e-7]


def gamma(x: Column) -> Column:
    """Gamma function for x > -0.5 (shifted up once below 0.5)."""
    low = x < 0.5
    y = F.when(low, x + 1).otherwise(x) - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    value = F.lit(math.sqrt(2 * math.pi)) * F.pow(t, y + 0.5) * F.exp(-t) * series
    return F.when(low, value / x).otherwise(value)

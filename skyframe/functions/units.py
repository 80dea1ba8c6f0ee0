"""Unit conversions, wind vectors and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def scale_element(element: Column, value: Column, divisors: dict[str, float]) -> Column:
    """``value`` divided by the divisor of its element; others unchanged."""
    scaled = value
    for divisor in sorted(set(divisors.values())):
        names = [name for name, d in divisors.items() if d == divisor]
        scaled = F.when(element.isin(names), value / F.lit(divisor)).otherwise(scaled)
    return scaled


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(273.15)


def millimetres(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def hectopascal(pascal: Column) -> Column:
    return pascal / F.lit(100.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Angle of the vector in degrees, 0..360."""
    return F.pmod(F.degrees(F.atan2(v, u)), F.lit(360.0))


def epoch_day(day: Column) -> Column:
    """Days since 1970-01-01: the integer axis of every date-range frame."""
    return F.unix_date(day)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def week_ending_sunday(day: Column) -> Column:
    """The Sunday closing the week of ``day``; a Sunday maps to itself."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def within(day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive date range; defaults 1900-01-01 and the current date."""
    first = F.lit(start or "1900-01-01").cast("date")
    last = F.lit(end).cast("date") if end else F.current_date()
    return (day >= first) & (day <= last)

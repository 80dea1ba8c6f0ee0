"""Geohash, bounding boxes and regular grids as Column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

# Fixed value: the base-32 geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: The letter of three bits of one axis and two of the other, by the number they make one after the other.
INTERLEAVED = "".join(ALPHABET[(i >> 4 & 1) << 4 | (i >> 1 & 1) << 3 | (i >> 3 & 1) << 2 | (i & 1) << 1 | (i >> 2 & 1)] for i in range(32))


class Box(NamedTuple):
    """Inclusive bounding box; with ``wrap`` longitudes count 0..360."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    wrap: bool = False


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the half-open interval holding ``value`` among 2**bits equal ones."""
    top = float((1 << bits) - 1)
    place = (value - F.lit(low)) / F.lit(span) * F.lit(float(1 << bits))
    # bounded before the cast: NaN counts as the largest value and cannot overflow
    return F.floor(F.greatest(F.least(place, F.lit(top)), F.lit(0.0)))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash of a point; NULL if either coordinate is NULL or NaN.

    Longitude holds the even bits of the code and latitude the odd ones, so each
    character mixes five bits taken from the two interval indices.
    """
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x = _cell(lon, -180.0, 360.0, lon_bits)
    y = _cell(lat, -90.0, 180.0, lat_bits)

    def part(index: Column, width: int, after: int, size: int) -> Column:
        """``size`` bits of an index of ``width`` bits after its first ``after``."""
        return F.shiftright(index, width - after - size).bitwiseAND(F.lit((1 << size) - 1).cast("long"))

    def letter(c: int) -> Column:
        # the axis that holds the letter's first bit gives three of its bits, the other one two
        three, two = ((x, lon_bits), (y, lat_bits)) if c % 2 == 0 else ((y, lat_bits), (x, lon_bits))
        index = part(*three, 5 * c // 2, 3) * F.lit(4) + part(*two, (5 * c + 1) // 2, 2)
        return F.substring(F.lit(INTERLEAVED), (index + 1).cast("int"), F.lit(1))

    # greatest/least skip NULLs; this empty text is NULL when a coordinate is missing or NaN.
    known = F.when(lat * 0.0 + lon * 0.0 == 0.0, F.lit(""))
    return F.concat(*[letter(c) for c in range(precision)], known)


def prefix(code: Column, length: int) -> Column:
    return F.substring(code, 1, length)


def lon360(lon: Column) -> Column:
    """Longitude moved from -180..180 to 0..360."""
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    """Inclusive membership test; on plain columns it is pushed to the scan."""
    x = lon360(lon) if box.wrap else lon
    return lat.between(box.min_lat, box.max_lat) & x.between(box.min_lon, box.max_lon)


def snap(value: Column, origin: float, step: float) -> Column:
    """Centre of the nearest cell of a regular grid."""
    return F.floor((value - F.lit(origin)) / F.lit(step) + 0.5) * F.lit(step) + F.lit(origin)


def cover(box: Box, precision: int) -> list[str]:
    """All geohash cells of one precision that touch a box, for partition pruning.

    The list follows from the box alone (never from the data); large boxes want a
    lower precision.
    """
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2

    def span(low, high, start, width, bits):
        size = 1 << bits
        first = int((low - start) / width * size)
        last = min(int((high - start) / width * size), size - 1)
        return range(max(first, 0), last + 1)

    def code(x, y):
        letters = []
        for c in range(precision):
            index = 0
            for k in range(5 * c, 5 * c + 5):
                value, width = (x, lon_bits) if k % 2 == 0 else (y, lat_bits)
                index = 2 * index + ((value >> (width - 1 - k // 2)) & 1)
            letters.append(ALPHABET[index])
        return "".join(letters)

    xs = span(box.min_lon, box.max_lon, -180.0, 360.0, lon_bits)
    ys = span(box.min_lat, box.max_lat, -90.0, 180.0, lat_bits)
    if box.wrap:
        east = span(box.min_lon, 180.0, -180.0, 360.0, lon_bits)
        west = span(-180.0, box.max_lon - 360.0, -180.0, 360.0, lon_bits)
        xs = [*east, *west]
    return sorted({code(x, y) for x in xs for y in ys})

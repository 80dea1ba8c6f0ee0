"""Readers for the raw feeds: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from skyframe import schemas


def fixed_width(lines: DataFrame, layout=schemas.STATION_LAYOUT, column: str = "value") -> DataFrame:
    """Cut trimmed, typed columns out of fixed-width lines; unreadable numbers are NULL."""
    def field(start: int, length: int, kind: str):
        text = F.trim(F.substring(column, start, length))
        return text if kind == "string" else text.try_cast(kind)
    return lines.select(*[field(s, n, kind).alias(name) for name, s, n, kind in layout])


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station inventory with country code and geohash."""
    from skyframe.operators.daily import with_geohash

    parsed = fixed_width(spark.read.text(path))
    named = parsed.withColumn("country", F.substring("station_id", 1, 2))
    return with_geohash(named, 7, 4)


def long_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LONG_OBSERVATIONS).csv(path, header=False)


def grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRID).csv(path, header=True)


def month_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MONTH_GRID).csv(path, header=True)


def optional_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing is there; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise

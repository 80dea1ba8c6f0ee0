"""The batch stages from raw feeds to serving tables.

Each stage writes its table once and passes the stored table on, so no model is fitted
twice and a lost executor costs one stage at most. Row counts come from the stored
tables' footers when asked for, never from a second run of the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyframe import schemas
from skyframe.operators import (anomaly, daily, decompose, extremes, forecast, indices, islands,
                                isolation, joins, project, rolling, trends)
from skyframe.sources import publish, readers
from skyframe.sources.lake import Lake


def ingest(spark: SparkSession, lake: Lake, stations_path: str, observations_path: str,
           grid_path: str | None = None, month_grid_path: str | None = None) -> dict[str, DataFrame]:
    """Raw feeds to the processed zone; the two grids are optional."""
    tables = {"stations": lake.write(readers.stations(spark, stations_path), "processed", "stations")}
    wide = daily.with_date_parts(daily.pivot_elements(
        daily.clean_long(readers.long_observations(spark, observations_path))))
    tables["observations"] = lake.write(wide, "processed", "observations", ["year"])
    if grid_path:
        grid = daily.convert_grid(readers.grid(spark, grid_path))
        tables["grid"] = lake.write(grid, "processed", "grid", ["year", "month"])
    if month_grid_path:
        cells = daily.convert_month_grid(readers.month_grid(spark, month_grid_path))
        tables["month_grid"] = lake.write(cells, "processed", "month_grid", ["year"])
    return tables


def features(lake: Lake, tables: dict[str, DataFrame]) -> DataFrame:
    """Joined fact table and its rolling features."""
    unified = joins.unify(tables["observations"].drop("year", "month"), tables["stations"],
                          tables.get("grid"), tables.get("month_grid"))
    stored = lake.write(unified, "features", "unified", ["year"])
    return lake.write(rolling.features(stored), "features", "rolling", ["year"])


def analyse(lake: Lake, tables: dict[str, DataFrame], rolled: DataFrame, min_years: int = 10,
            residuals: bool = True, models: tuple[str, ...] = ("statistical", "harmonic", "arx")) -> dict[str, DataFrame]:
    """Every analysis of the rolling features, each stored under the output zone."""
    out = {}

    def keep(name: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        out[name] = lake.write(df, "output", name, by)
        return out[name]

    found = keep("anomalies", isolation.detect_stored(lake, rolled, residuals=residuals), ["year"])
    keep("tiles", anomaly.tiles(found), ["year"])
    placed = joins.with_stations(found, tables["stations"].select("station_id", "country"))
    keep("monthly_summary", anomaly.monthly_with_region(placed, tables.get("month_grid")))
    catalogue = keep("events", islands.events(rolled, "tmax_zscore_30d"))
    keep("events_by_decade", islands.by_decade(catalogue))
    if "grid" in tables:
        keep("indices", indices.compute(tables["grid"]), ["index_name"])
    keep("trends", trends.trend(rolled, min_years), ["variable"])
    keep("return_levels", extremes.return_levels(extremes.likelihood(
        extremes.block_extremes(rolled, min_years=min_years))), ["variable"])
    keep("projections", project.scenarios(rolled), ["scenario", "variable"])
    fits = {"statistical": forecast.statistical, "harmonic": forecast.harmonic, "arx": forecast.arx}
    base = rolled.select("station_id", "obs_date", *schemas.VARIABLES)
    for name in models:
        lake.write(fits[name](base), "output", "forecasts", ["model_type", "variable"])
    stored = lake.read("output", "forecasts").where(F.col("model_type").isin(*models))
    weights = forecast.WEIGHTS if "arx" in models else forecast.WEIGHTS_TWO
    blended = forecast.ensemble(stored, weights)
    out["forecasts"] = lake.write(blended, "output", "forecasts", ["model_type", "variable"])
    return out


SERVED = {"anomalies": "anomalies", "tiles": "anomaly_tiles", "monthly_summary": "monthly_summary",
          "forecasts": "forecasts", "indices": "climate_indices", "return_levels": "extreme_value_stats",
          "trends": "trend_analysis", "projections": "climate_projections"}


def export(lake: Lake, tables: dict[str, DataFrame], rolled: DataFrame, results: dict[str, DataFrame],
           root: str, sample: float | None = None) -> None:
    """All serving tables as Parquet: every observation, or a repeatable sample if asked for.
    Stations carry their first and last year and number of records."""
    publish.to_parquet(publish.with_statistics(tables["stations"], tables["observations"]), "stations", root)
    kept = rolled if sample is None else daily.hash_sample(rolled, ["station_id", "obs_date"], sample)
    publish.to_parquet(kept, "observations", root)
    for name, table in SERVED.items():
        if name in results:
            publish.to_parquet(results[name], table, root)

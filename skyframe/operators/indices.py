"""Regional index series from a grid: one scan, one aggregation, tiny windows.

All regions are averaged side by side by conditional aggregates in a single pass, so
neither five scans nor self-joins are needed. The windows run on the monthly result
(twelve rows per year and index), never on grid rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions.geo import Box, in_box


class Index(NamedTuple):
    """An index series. ``method`` is one of
    smooth: anomaly against the month's mean, centred mean over ``half`` months each side;
    center: anomaly against the month's mean, less its overall mean;
    standard: difference of two boxes, standardised over all months;
    gradient: difference of two boxes less its overall mean."""

    name: str
    column: str
    method: str
    box: Box
    minus: Box | None = None
    half: int = 0


# The published index regions.
DEFINITIONS = [
    Index("oni", "temp_2m_c", "smooth", Box(-5, 5, -170, -120), half=1),
    Index("nao", "pressure_hpa", "standard", Box(36, 40, -30, -25), Box(63, 66, -25, -15)),
    Index("pdo", "temp_2m_c", "center", Box(20, 60, 120, 260, wrap=True)),
    Index("amo", "temp_2m_c", "smooth", Box(0, 60, -80, 0), half=5),
    Index("iod", "temp_2m_c", "gradient", Box(-10, 10, 50, 70), Box(-10, 0, 90, 110)),
]


def _inside(box: Box) -> Column:
    return in_box(F.col("latitude"), F.col("longitude"), box)


def region_months(grid: DataFrame, regions: dict[str, tuple[str, Box]]) -> DataFrame:
    """Monthly mean of a column over each named box, one column per box."""
    wanted = grid.where(reduce(or_, [_inside(box) for _, box in regions.values()]))
    return wanted.groupBy("year", "month").agg(*[
        F.avg(F.when(_inside(box), F.col(column))).alias(name)
        for name, (column, box) in regions.items()])


def monthly_raw(grid: DataFrame, definitions: list[Index]) -> DataFrame:
    """(index_name, year, month, raw) for every index; months lacking a box are absent."""
    regions = {}
    for d in definitions:
        regions[f"{d.name}_a"] = (d.column, d.box)
        if d.minus:
            regions[f"{d.name}_b"] = (d.column, d.minus)
    months = region_months(grid, regions)
    raw = [F.struct(F.lit(d.name).alias("index_name"),
                    (F.col(f"{d.name}_a") - F.col(f"{d.name}_b") if d.minus
                     else F.col(f"{d.name}_a")).alias("raw")) for d in definitions]
    return (months.select("year", "month", F.explode(F.array(*raw)).alias("entry"))
            .select("entry.index_name", "year", "month", "entry.raw").where("raw is not null"))


def compute(grid: DataFrame, definitions: list[Index] = DEFINITIONS,
            source: str = "reanalysis", digits: int | None = 4) -> DataFrame:
    """All index series: (index_date, index_name, value, anomaly, source)."""
    raw = monthly_raw(grid, definitions)
    whole = Window.partitionBy("index_name")
    same_month = Window.partitionBy("index_name", "month")
    ordered = whole.orderBy("year", "month")
    scored = raw.withColumns({
        "overall": F.avg("raw").over(whole),
        "spread": F.stddev("raw").over(whole),
        "seasonal": F.col("raw") - F.avg("raw").over(same_month),
    })
    centred = F.col("raw") - F.col("overall")
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    value, anomaly = F.lit(None).cast("double"), F.lit(None).cast("double")
    for d in definitions:
        mine = F.col("index_name") == d.name
        if d.method == "smooth":
            smooth = F.avg("seasonal").over(ordered.rowsBetween(-d.half, d.half))
            parts = (smooth, F.col("seasonal"))
        elif d.method == "center":
            parts = (F.col("seasonal") - F.avg("seasonal").over(whole), F.col("seasonal"))
        elif d.method == "standard":
            parts = (centred / spread, centred)
        else:
            parts = (centred, centred)
        value, anomaly = F.when(mine, parts[0]).otherwise(value), F.when(mine, parts[1]).otherwise(anomaly)

    def out(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return scored.select(
        F.make_date("year", "month", F.lit(1)).alias("index_date"), "index_name",
        out(value).alias("value"), out(anomaly).alias("anomaly"), F.lit(source).alias("source"))

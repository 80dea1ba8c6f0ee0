"""Registration of queries and their SQL oracles.

Both sides end in the same presentation: doubles are rounded to four places after a tiny
offset (so that decimal ties do not depend on summation order), dates become text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyframe.session import ship
from workload.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates and timestamps as text; other types unchanged."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c + F.lit(1e-8), 4)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def _needed(body: str) -> list[str]:
    """Views a SQL text mentions, with the views those need first."""
    import re

    found: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                visit_name(name, sql)

    def visit_name(name: str, sql: str) -> None:
        for other, other_sql in SQL_VIEWS.items():
            if other != name and other not in found and re.search(rf"\b{other}\b", sql):
                visit_name(other, other_sql)
        if name not in found:
            found.append(name)

    visit(body)
    return found


def oracle(body: str, doubles: str = "", dates: str = "") -> str:
    """Complete SQL: needed views, the body, presentation of the named columns."""
    views = [f"{name} AS ({SQL_VIEWS[name]})" for name in _needed(body)]
    shown = [f"round({c} + 1e-8, 4) AS {c}" for c in doubles.split()]
    shown += [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(shown)})" if shown else ""
    return f"WITH {', '.join([*views, f'result_ AS ({body})'])} SELECT *{replace} FROM result_"


def query(name: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Register ``fn(views)`` under ``name`` with an optional SQL twin."""
    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return present(fn(Views(spark, sf_dir)))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql, doubles, dates)
        return fn
    return add

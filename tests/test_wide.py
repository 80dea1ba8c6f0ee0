"""Daily rows are aggregated wide."""

from skyframe.operators import daily, forecast, project


def test_daily_rows_are_shuffled_wide(spark):
    """Climatologies, weeks, forecasts and projections move a daily row once, not once for each variable, into a fixed number of tasks."""
    rows = spark.range(800).selectExpr(
        "concat('S', id % 2) AS station_id", "date_add(DATE '2020-01-01', CAST(id DIV 2 AS INT)) AS obs_date", "id * 1.0 AS tmax",
        "CASE WHEN id % 2 = 0 THEN id * 0.5 END AS tmin", "CASE WHEN id < 6 THEN 1.0 END AS prcp", "40.0 AS latitude")
    found = {"doy": daily.climatology(rows), "month": daily.climatology(rows, "month"), "weekly": daily.weekly(rows),
             "statistical": forecast.statistical(rows), "row": forecast.statistical(rows, x="row"), "scenarios": project.scenarios(rows)}
    for name, df in found.items():
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(station_id") == text.count("Exchange ") == 1, name
        assert "REPARTITION_BY_NUM" in text, name
        assert text.index("Expand") < text.index("Exchange "), name  # rows become long after the shuffle
    # a variable without a value in a group has no row: S1 has no tmin, prcp is known on three days
    assert {(r[0], r[1]): r[2] for r in found["doy"].groupBy("station_id", "variable").count().collect()} == {
        ("S0", "tmax"): 366, ("S1", "tmax"): 366, ("S0", "tmin"): 366, ("S0", "prcp"): 3, ("S1", "prcp"): 3}
    assert {r[0] for r in found["row"].select("variable").distinct().collect()} == {"tmax", "tmin"}

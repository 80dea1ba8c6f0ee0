"""Running totals instead of frames, and a first load that is cut at the scan."""

import datetime as dt
import math
import random

from skyframe.operators import forecast, lookback, rolling
from workload.basics import part

DAILY = "station_id string, obs_date date, tmax double, tmin double, prcp double"


def series(odd=True):
    rng = random.Random(4)
    strange = [None, math.nan, math.inf, -math.inf] if odd else [None]
    value = lambda mean: rng.choice(strange) if rng.random() < 0.02 else rng.gauss(mean, 9)
    found = [(f"S{s}", dt.date(1999, 12, 1) + dt.timedelta(days=d), value(15), value(1000), value(2))
             for s in range(3) for d in range(1500) if rng.random() < 0.4]
    return found + found[5:400:9] + [("S0", None, 3.0, 4.0, 5.0), ("none", dt.date(2020, 1, 1), None, None, None)]


def same(got, want):
    key = lambda r: (r.station_id, str(r.obs_date), str(r.tmax), str(r.tmin))
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        for c in want.columns:
            x, y = a[c], b[c]
            assert x == y or (isinstance(x, float) and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))), (c, a, b)


def test_totals_equal_frames(spark):
    daily = spark.createDataFrame(series(), DAILY)
    spec = {365: {v: ["mean"] for v in ("tmax", "tmin", "prcp")}}
    same(lookback.means(daily, 365, ["tmax", "tmin", "prcp"]), rolling.rolling(daily, spec))


def test_a_part_of_a_table_is_chosen_at_the_scan(spark):
    daily = spark.createDataFrame(series(odd=False), DAILY)
    for whole in (lookback.means(daily, 365, ["tmax"]), rolling.rolling(daily), forecast.statistical(daily, min_days=10)):
        some = part(whole)
        assert {r[0] for r in some.select("station_id").distinct().collect()} < {r[0] for r in whole.select("station_id").distinct().collect()}
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("pmod") > plan.rindex("Window ["), plan  # below all windows
    unnamed = spark.range(90).withColumnRenamed("id", "cell")
    assert 0 < part(unnamed).count() < 90

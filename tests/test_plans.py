"""What the plans look like: native, pruned, broadcast where small, combined early."""

import pytest

import __spark_entry__ as entry
from skyframe.operators import joins, rolling
from workload.views import Views

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"ml_iforest", "ml_seq_recon", "ml_anomaly", "ts_stl", "ml_forecast_harmonic", "ml_forecast_arx",
                  "ts_gev_likelihood"}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(("str_", "sink_", "src_"))))
def test_native_operators_hold_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    python = any(word in text for word in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"))
    assert python == (name in PYTHON_QUERIES)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["src_parquet"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double>" in text
    assert "GreaterThan(l_quantity,45.0)" in text


def test_rolling_features_shuffle_by_station_once(spark):
    views = Views(spark, SF)
    path_free = views.obs.select("station_id", "obs_date", "tmax", "tmin", "prcp")
    text = plan(rolling.features(path_free))
    # One exchange for the daily aggregation, one by station for all windows.
    assert text.split("(1) Scan")[0].count("Exchange") == 2


def test_lookup_broadcasts_only_below_the_limit(spark):
    views = Views(spark, SF)
    small = plan(joins.lookup_join(views.obs, views.stations, ["station_id"]))
    plain = plan(joins.lookup_join(views.obs, views.stations, ["station_id"], limit=0))
    assert small.split("(1) Scan")[0].count("SortMergeJoin") < plain.split("(1) Scan")[0].count("SortMergeJoin")


def test_no_geohash_text_in_a_filter(spark):
    for name in ("join_spatiotemporal", "join_prefix", "proj_deviation", "join_unified"):
        text = plan(entry.queries()[name](spark, SF))
        filters = [line for line in text.splitlines() if "Condition" in line]
        assert not any("0123456789bcdefghjkmnpqrstuvwxyz" in line for line in filters), name


def test_top_k_per_station_is_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["topk_recent"](spark, SF))
    assert "WindowGroupLimit" in text


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["topk_records"](spark, SF))

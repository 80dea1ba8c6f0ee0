"""Readers, writers, the stage chain and the live path."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe import schemas
from skyframe.operators import anomaly, daily
from skyframe.plans import stages
from skyframe.session import cut, shared_dir
from skyframe.sources import lake, publish, readers
from skyframe.streaming import live
from tests.conftest import rows


def station_line(key, lat, lon, elevation, state, name):
    return f"{key:<11} {lat:8.4f} {lon:9.4f} {elevation:6.1f} {state:<2} {name:<30} {'GSN':<3} {'':<3} {'72503':<5}"


def test_fixed_width_inventory(spark, tmp_path):
    lines = [station_line("US000000001", 40.7128, -174.006, 1010.0, "NY", "NEW YORK CENTRAL PARK"),
             station_line("GM000000002", -52.52, 13.405, -34.5, "", "BERLIN"), "US000000003  bad"]
    (tmp_path / "stations.txt").write_text("\n".join(lines) + "\n")
    out = {r.station_id: r for r in readers.stations(spark, str(tmp_path / "stations.txt")).collect()}
    first = out["US000000001"]
    assert (first.latitude, first.longitude, first.elevation) == (40.7128, -174.006, 1010.0)
    assert (first.state, first.name, first.gsn_flag, first.wmo_id, first.country) == (
        "NY", "NEW YORK CENTRAL PARK", "GSN", "72503", "US")
    assert len(first.geohash) == 7 and out["US000000003"].latitude is None and out["US000000003"].geohash is None


def test_partitioned_write_replaces_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.partitioned(spark.createDataFrame([(1, 2019), (2, 2020)], "v int, year int"), path, ["year"])
    lake.partitioned(spark.createDataFrame([(3, 2020)], "v int, year int"), path, ["year"], spread=4)
    back = spark.read.parquet(path)
    assert rows(back) == [(1, 2019), (3, 2020)]
    text = back.where("year = 2020")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in text


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    lake.partitioned(spark.range(4000).selectExpr("id", "if(id % 3 = 0, 1999, 2000 + id % 2) AS year"), path, ["year"], spread=8)
    files = [f for f in os.listdir(f"{path}/year=1999") if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(path).count() == 4000


def test_register_twice_and_zones(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    store.write(spark.createDataFrame([(1, 2019)], "v int, year int"), "features", "t", ["year"])
    for _ in range(2):
        store.register("features", "t", "registered_t")
    assert spark.table("registered_t").count() == 1
    spark.sql("DROP TABLE registered_t")
    with pytest.raises(ValueError):
        store.path("elsewhere", "t")


def test_optional_parquet(spark, tmp_path):
    assert readers.optional_parquet(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert readers.optional_parquet(spark, str(tmp_path / "some")).count() == 3


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("S", dt.date(2020, 1, 1), None)], "station_id string, obs_date date, tmax double")
    lake.write_csv(df, str(tmp_path / "csv"))
    lake.write_json(df, str(tmp_path / "json"))
    lake.write_lines(df.select(F.col("station_id").alias("value")), str(tmp_path / "lines"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["station_id", "obs_date", "tmax"]
    text = spark.read.text(str(tmp_path / "json")).first()[0]
    assert json.loads(text) == {"station_id": "S", "obs_date": "2020-01-01", "tmax": None}
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "S"


def test_cut_reads_back_from_the_shared_folder(spark):
    out = cut(spark.range(5), "numbers")
    assert rows(out) == [(i,) for i in range(5)] and shared_dir(spark) in out.inputFiles()[0]


def raw_feeds(tmp_path, years=3):
    rng = np.random.default_rng(0)
    names = ["US000000001", "GM000000002"]
    (tmp_path / "stations.txt").write_text("\n".join(
        station_line(n, 40.0 + i, -70.0 + i, 10.0, "", f"ST {i}") for i, n in enumerate(names)) + "\n")
    lines = []
    for n in names:
        for i in range(365 * years):
            d = dt.date(2018, 1, 1) + dt.timedelta(days=i)
            t = 150 + 100 * np.sin(2 * np.pi * i / 365) + rng.normal(scale=20)
            for element, value in (("TMAX", t + 50), ("TMIN", t - 50), ("PRCP", rng.gamma(1) * 30)):
                lines.append(f"{n},{d:%Y%m%d},{element},{value:.0f},,,S,")
    (tmp_path / "obs.csv").write_text("\n".join(lines) + "\n")
    months = [f"{2018 + m // 12},{m % 12 + 1},40,-70,{rng.normal():.3f}" for m in range(12 * years)]
    (tmp_path / "months.csv").write_text("year,month,latitude,longitude,temp_anomaly\n" + "\n".join(months) + "\n")


def test_stage_chain(spark, tmp_path):
    raw_feeds(tmp_path)
    store = lake.Lake(spark, str(tmp_path / "lake"))
    tables = stages.ingest(spark, store, str(tmp_path / "stations.txt"), str(tmp_path / "obs.csv"),
                           month_grid_path=str(tmp_path / "months.csv"))
    assert tables["observations"].count() == 2 * 1095
    rolled = stages.features(store, tables)
    assert rolled.count() == 2 * 1095 and rolled.where("grid_temp IS NOT NULL").count() == 0
    results = stages.analyse(store, tables, rolled, min_years=3, residuals=False)
    assert {r.model_type for r in results["forecasts"].select("model_type").distinct().collect()} == {
        "arx", "harmonic", "statistical", "ensemble"}
    assert results["anomalies"].count() > 0 and results["trends"].count() == 6
    assert results["monthly_summary"].where("top_region IS NOT NULL").count() > 0
    stages.export(store, tables, rolled, results, str(tmp_path / "served"))
    for table in ("stations", "anomalies", "forecasts", "anomaly_tiles", "monthly_summary", "climate_projections"):
        assert spark.read.parquet(str(tmp_path / "served" / table)).columns == list(publish.TABLES[table])


LIVE = "station_id string, obs_date date, element string, value double, ts timestamp"


def record(station, day, element, value, hour=6):
    d = dt.date(2024, 1, 1) + dt.timedelta(days=day)
    return station, d, element, value, dt.datetime(d.year, d.month, d.day, hour)


def feed(spark, path, *files):
    for number, data in enumerate(files):
        stamp = str(path / f"part-{number}")
        spark.createDataFrame(data, LIVE).coalesce(1).write.parquet(stamp)
    return str(path / "part-*")


def test_duplicates_and_late_records_are_dropped(spark, tmp_path):
    path = feed(spark, tmp_path, [record("A", 0, "TMAX", 1.0), record("A", 20, "TMAX", 2.0)],
                [record("A", 20, "TMAX", 99.0, 7), record("A", 21, "TMIN", 3.0)],
                [record("A", 1, "TMAX", 50.0), record("A", 22, "PRCP", 4.0)])
    stream = live.source(spark, path, LIVE, files_per_batch=1)
    out = str(tmp_path / "out")
    live.run(live.dedupe(stream), str(tmp_path / "cp"), out).awaitTermination()
    assert rows(spark.read.parquet(out).select("element", "value")) == [
        ("PRCP", 4.0), ("TMAX", 1.0), ("TMAX", 2.0), ("TMIN", 3.0)]


def test_stream_pivot_equals_batch(spark, tmp_path):
    data = [record(s, d, e, float(d + len(e))) for s in "AB" for d in range(12) for e in ("TMAX", "TMIN", "PRCP") if (d + len(s)) % 4]
    path = feed(spark, tmp_path, data[:30], data[30:])
    out, kept = str(tmp_path / "out"), []
    query = live.run(live.pivot(live.source(spark, path, LIVE, files_per_batch=1)), str(tmp_path / "cp"),
                     handle=live.store_batches(out), mode="update")
    query.awaitTermination()
    expected = daily.pivot_elements(spark.createDataFrame(data, LIVE), live.ELEMENTS)
    stored = live.newest(spark.read.parquet(out), ["station_id", "obs_date"])
    assert rows(stored) == rows(expected.select(*stored.columns))


def test_pivot_takes_the_day_of_the_record(spark, tmp_path):
    late = ("A", dt.date(2024, 1, 1), "TMAX", 5.0, dt.datetime(2024, 1, 5, 6))
    wide = live.pivot(spark.createDataFrame([late], LIVE), watermark=None)
    assert wide.first().obs_date == dt.date(2024, 1, 1)


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    handle = live.store_batches(str(tmp_path / "out"))
    for _ in range(2):
        handle(spark.range(5), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_late_day_is_inserted_and_later_days_are_scored_again(spark, tmp_path):
    schema = "station_id string, obs_date date, tmax double, tmin double, prcp double"
    data = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 90.0 if i == 45 else 20.0 + i % 3, 10.0 + i % 2, None) for i in range(50)]
    parts = ([r for i, r in enumerate(data) if i < 48 and i != 45], [data[45], data[2]], data[48:])
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{number}"))
    out = str(tmp_path / "out")
    wide = live.source(spark, str(tmp_path / "in" / "part-*"), schema, files_per_batch=1)
    live.run(live.score_stateful(wide), str(tmp_path / "cp"), handle=live.store_batches(out)).awaitTermination()
    scored = live.newest(spark.read.parquet(out), ["station_id", "obs_date"])
    found = {r.obs_date: r.tmax_z for r in scored.collect()}
    tmax = [r[2] for r in data]
    for i, r in enumerate(data[2:], 2):
        known = np.array(tmax[:i + 1])
        assert found[r[1]] == pytest.approx((known[-1] - known.mean()) / known.std(ddof=1)), i
    assert [r.anomaly_date for r in anomaly.recent_alerts(scored).collect()] == [dt.date(2024, 2, 15)]


def test_stateful_detection_resumes(spark, tmp_path):
    schema = "station_id string, obs_date date, tmax double, tmin double, prcp double"
    data = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 90.0 if i == 45 else 20.0 + i % 3, 10.0 + i % 2, None) for i in range(50)]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for number, part in enumerate((data[:40], data[40:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"part-{number}"))
        wide = live.source(spark, str(folder / "part-*"), schema)
        live.run(live.detect_stateful(wide), str(tmp_path / "cp"), out).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert [(r.anomaly_date, r.anomaly_type) for r in found] == [(dt.date(2024, 2, 15), "heatwave")]


def test_batch_detection_reads_history_of_changed_stations(spark, tmp_path):
    schema = "station_id string, obs_date date, tmax double, tmin double, prcp double"
    history = spark.createDataFrame([(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), 90.0 if i == 49 else 20.0 + i % 3, None, None)
                                     for s in "AB" for i in range(50)], schema)
    seen = []
    handle = live.detect_batch(lambda: history, lambda df, i: seen.extend(df.collect()))
    handle(history.where("station_id = 'A' AND tmax > 80"), 0)
    assert [r.station_id for r in seen] == ["A"]

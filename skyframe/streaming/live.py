"""Live path as Structured Streaming queries.

Records arrive long: (station_id, obs_date, element, value, ts). Late or repeated
records within seven days are handled by the watermark, state stays per key, and every
query takes a checkpoint folder so that it resumes after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyframe.operators import anomaly, rolling

LATENESS = "7 days"
ELEMENTS = ["TMAX", "TMIN", "PRCP"]
VARIABLES = ["tmax", "tmin", "prcp"]


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100,
           fmt: str = "parquet") -> DataFrame:
    """New files of a folder, a bounded number per micro-batch."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def dedupe(records: DataFrame, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """First record of each station, day and element within the lateness allowed."""
    return records.withWatermark(time, lateness).dropDuplicatesWithinWatermark(
        ["station_id", "obs_date", "element"])


def pivot(records: DataFrame, elements: list[str] = ELEMENTS, watermark: str | None = LATENESS) -> DataFrame:
    """Wide rows per station and day. The day is the record's own, and it carries the
    watermark: a day may change until one ``watermark`` newer has been seen, then it leaves
    the state. Aggregation is combined before the shuffle."""
    dated = records.withColumn("_day", F.col("obs_date").cast("timestamp"))
    source = dated.withWatermark("_day", watermark) if watermark else dated
    wide = source.groupBy("_day", "station_id").agg(*[
        F.max(F.when(F.col("element") == e, F.col("value"))).alias(e.lower()) for e in elements])
    return wide.select("station_id", F.to_date("_day").alias("obs_date"), *[e.lower() for e in elements])


def store_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each micro-batch in a folder of its own and replaces
    it when the batch is replayed, so nothing is stored twice."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return handle


def newest(stored: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """Of the rows that ``store_batches`` kept, the last batch's for each key."""
    rest = [c for c in stored.columns if c not in (*keys, batch)]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("_row"))
    return last.select(*keys, *[f"_row.{c}" for c in rest])


def detect_batch(history: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None],
                 rows: int = 365) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: stations with new days are scored against their last
    ``rows`` days of the stored table, and alerts are handed to ``emit``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("station_id").distinct()
        stored = history().join(changed, "station_id", "left_semi")
        emit(anomaly.recent_alerts(rolling.latest_scores(stored, VARIABLES, rows)), batch_id)
    return handle


def window_scores(values: np.ndarray, first: int, size: int) -> np.ndarray:
    """Deviation of the values from row ``first`` on from the known values of the ``size`` rows
    that end with each; missing where the value is, or where the window does not vary."""
    out = np.full((len(values) - first, values.shape[1]), np.nan)
    padded = np.vstack([np.full((size - 1, values.shape[1]), np.nan), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=0)
    for start in range(first, len(values), 512):
        part = windows[start:start + 512]
        known = ~np.isnan(part)
        n = known.sum(axis=2)
        filled = np.where(known, part, 0.0)
        mean = filled.sum(axis=2) / np.maximum(n, 1)
        spread = np.where(known, part - mean[:, :, None], 0.0)
        std = np.sqrt((spread ** 2).sum(axis=2) / np.maximum(n - 1, 1))
        ok = (n > 1) & (std > 0)
        out[start - first:start - first + len(part)] = np.where(
            ok, (values[start:start + 512] - mean) / np.where(ok, std, 1.0), np.nan)
    return out


def score_stateful(wide: DataFrame, size: int = 365, late_days: int = 7) -> DataFrame:
    """(station_id, obs_date, deviations, values) of each day against the ``size`` known days
    that end with it, kept as state.

    The state of a station is its last ``size + late_days`` days. A day that arrives late or
    again within ``late_days`` of the newest one is put in its place, and it and the days
    after it are scored anew: of several rows for a day the last counts (see ``newest``).
    Older days are left out."""
    state = "days array<int>, " + ", ".join(f"{v} array<double>" for v in VARIABLES)
    output = ("station_id string, obs_date date, " + ", ".join(f"{v}_z double" for v in VARIABLES)
              + ", " + ", ".join(f"{v} double" for v in VARIABLES))
    columns = ["station_id", "obs_date", *[f"{v}_z" for v in VARIABLES], *VARIABLES]
    epoch = np.datetime64("1970-01-01", "D")

    def update(key, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        days, values = np.empty(0, np.int64), np.empty((0, len(VARIABLES)))
        if group.exists:
            held, *series = group.get
            days = np.array(held, np.int64)
            values = np.array([[np.nan if x is None else x for x in v] for v in series], float).T.reshape(-1, len(VARIABLES))
        new = pd.concat(list(frames))
        arrived = (pd.to_datetime(new["obs_date"]).to_numpy().astype("datetime64[D]") - epoch).astype(np.int64)
        if len(days):
            new, arrived = new[arrived >= days[-1] - late_days], arrived[arrived >= days[-1] - late_days]
        if not len(arrived):
            return
        every = np.concatenate([days, arrived])
        rows = np.vstack([values, new[VARIABLES].to_numpy(dtype=float)])
        order = np.argsort(every, kind="stable")
        every, rows = every[order], rows[order]
        last = np.append(every[1:] != every[:-1], True)  # of a repeated day the later arrival
        every, rows = every[last], rows[last]
        first = int(np.searchsorted(every, arrived.min()))
        scores = window_scores(rows, first, size)
        keep = size + late_days
        held = rows[-keep:]
        group.update((every[-keep:].tolist(), *[[None if np.isnan(x) else float(x) for x in held[:, j]] for j in range(len(VARIABLES))]))
        out = pd.DataFrame(np.hstack([scores, rows[first:]]), columns=columns[2:])
        out.insert(0, "obs_date", (epoch + every[first:]).astype(object))
        out.insert(0, "station_id", key[0])
        yield out

    return wide.groupBy("station_id").applyInPandasWithState(
        update, output, state, "append", GroupStateTimeout.NoTimeout)


def detect_stateful(wide: DataFrame, size: int = 365, late_days: int = 7) -> DataFrame:
    """Alerts of the scored days as they are scored; a day scored again may be told again."""
    return anomaly.recent_alerts(score_stateful(wide, size, late_days))


def alerts(anomalies: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join: subscriptions met by the arriving anomalies."""
    return anomaly.match_subscriptions(anomalies, subscriptions)


def run(df: DataFrame, checkpoint: str, path: str | None = None,
        handle: Callable[[DataFrame, int], None] | None = None, mode: str = "append",
        every: str | None = None):
    """Start a query: all available data once, or ``every`` interval until stopped."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if handle:
        return writer.foreachBatch(handle).start()
    return writer.format("parquet").option("path", path).start()

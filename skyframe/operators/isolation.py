"""Per-station model scores: isolation forest and sequence reconstruction error.

Only the two scores are computed in Python, the daily rows of some stations at a time (an
amount bounded by the calendar); blending, flagging and labelling stay in Spark.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skyframe.operators import anomaly, decompose
from skyframe.operators.grouped import group_starts, spread, whole_groups
from skyframe.operators.joins import with_residuals
from skyframe.sources.lake import Lake

SEQUENCE = 30
SEQUENCE_FEATURES = ["tmax_zscore_30d", "tmin_zscore_30d", "prcp_zscore_30d"]


def _mean_path(size: np.ndarray) -> np.ndarray:
    """Average depth of an unsuccessful search among ``size`` items."""
    size = np.asarray(size, dtype=float)
    many = np.maximum(size, 3)
    depth = 2 * (np.log(many - 1) + 0.5772156649015329) - 2 * (many - 1) / many
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, depth))


def _ranges(flat: np.ndarray, d: int, rows: np.ndarray, starts: np.ndarray, count: np.ndarray, draw: np.ndarray) -> tuple:
    """For each group of rows the feature of the largest draw among those that vary in it, with its lowest and highest
    value; where none varies these are equal. ``flat`` holds the values row by row. Draws are used up."""
    pick = draw.argmax(axis=1)
    low, high = np.zeros(len(count)), np.zeros(len(count))
    open_ = np.flatnonzero((count > 1) & (draw.max(axis=1) >= 0))
    while len(open_):
        size = count[open_]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts[open_] - first, size)
        values = flat[rows[at] * d + np.repeat(pick[open_], size)]
        low[open_], high[open_] = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        same = open_[high[open_] <= low[open_]]
        draw[same, pick[same]] = -1.0
        open_ = same[draw[same].max(axis=1) >= 0]
        pick[open_] = draw[open_].argmax(axis=1)
    return pick, low, high


def forest_scores(x: np.ndarray, seed: int, trees: int = 200, sample: int = 256) -> np.ndarray:
    """Isolation forest (Liu et al. 2008): values near 1 are easily isolated rows.

    All trees grow together level by level in heap order."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    psi = min(sample, n)
    levels = int(np.ceil(np.log2(max(psi, 2))))
    nodes = (1 << (levels + 1)) - 1
    # a leaf is its own left child and lets no value pass to the right
    feature = np.zeros((trees, nodes), dtype=np.intp)
    cut = np.full((trees, nodes), np.inf)
    left = np.arange(trees * nodes, dtype=np.intp).reshape(trees, nodes)
    size = np.zeros((trees, nodes), dtype=np.intp)
    rows = np.concatenate([rng.choice(n, psi, replace=False) for _ in range(trees)])
    group = np.arange(trees) * nodes  # the nodes that are split next, in order; their rows lie side by side
    count = np.full(trees, psi)
    size[:, 0] = psi
    flat, columns = np.ascontiguousarray(x).ravel(), x.T.copy()
    varied = columns.min(axis=1) < columns.max(axis=1)
    for _ in range(levels):
        if not len(rows):
            break
        starts = np.cumsum(count) - count
        draw, share = rng.random((len(group), d)), rng.random(len(group))
        draw[:, ~varied] = -1.0
        pick, low, high = _ranges(flat, d, rows, starts, count, draw)
        point = low + share * (high - low)
        split = high > low
        feature.ravel()[group[split]] = pick[split]
        cut.ravel()[group[split]] = point[split]
        at = group - group % nodes + 2 * (group % nodes) + 1
        left.ravel()[group[split]] = at[split]
        keep = np.repeat(split, count)
        rows, at, count = rows[keep], at[split], count[split]
        right = flat[rows * d + np.repeat(pick[split], count)] > np.repeat(point[split], count)
        starts = np.cumsum(count) - count
        many = np.add.reduceat(right, starts, dtype=np.int64) if len(starts) else count
        # rows go to the left part or the right part of their group, in the order they had
        passed = np.cumsum(right) - right
        before = np.repeat(passed[starts], count) if len(starts) else passed
        inner = np.arange(len(rows)) - np.repeat(starts, count)
        place = np.repeat(starts, count) + np.where(right, np.repeat(count - many, count) + passed - before, inner - (passed - before))
        dealt = np.empty_like(rows)
        dealt[place] = rows
        group, count = np.column_stack([at, at + 1]).ravel(), np.column_stack([count - many, many]).ravel()
        size.ravel()[group] = count
        filled = count > 0
        rows, group, count = dealt, group[filled], count[filled]
    depth = np.repeat(np.arange(levels + 1), 1 << np.arange(levels + 1))
    path = (depth + _mean_path(np.arange(psi + 1))[size]).ravel()
    root = (np.arange(trees, dtype=np.intp) * nodes)[:, None]
    flat_feature, flat_cut, flat_left = feature.ravel(), cut.ravel(), left.ravel()
    total = np.empty(n)
    for start in range(0, n, 256):
        part = x[start:start + 256]
        values, row = np.ascontiguousarray(part).ravel(), (np.arange(len(part), dtype=np.intp) * d)[None, :]
        at = np.repeat(root, len(part), axis=1)
        for _ in range(levels):
            right = np.take(values, row + np.take(flat_feature, at)) > np.take(flat_cut, at)
            at = np.take(flat_left, at) + right
        total[start:start + 256] = path[at].mean(axis=0)
    return 2.0 ** (-total / _mean_path(np.array(psi)))


def reconstruction_scores(x: np.ndarray, length: int = SEQUENCE, components: int = 8) -> np.ndarray:
    """Squared error of each ``length``-day window rebuilt from its leading principal
    components, given to the window's last day; earlier days take the first error.
    Zero for series too short to learn from."""
    n = len(x)
    if x.shape[1] < 2 or n < 3 * length or n - length + 1 < 50:
        return np.zeros(n)
    spread = x.std(axis=0)
    scaled = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    windows = np.lib.stride_tricks.sliding_window_view(scaled, length, axis=0).reshape(n - length + 1, -1)
    centred = windows - windows.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    leading = vectors[:, -components:]
    error = np.mean((centred - centred @ leading @ leading.T) ** 2, axis=1)
    return np.r_[np.full(length - 1, error[0]), error]


def model_scores(features: DataFrame, names: list[str] = anomaly.FEATURES, min_rows: int = 365,
                 trees: int = 200, sequence: bool = True) -> DataFrame:
    """Adds ``iforest_score``, ``seq_score`` and by which of them a station was judged; stations with fewer rows are left out.

    Unknown features count as 0. Rows are ordered by date and the seed follows from the
    station id, so the result does not depend on partitioning."""
    used = [c for c in names if c in features.columns]
    if len(used) < 3:
        raise ValueError("at least three feature columns are needed")
    ordered = [c for c in SEQUENCE_FEATURES if c in used]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema)
    schema += ", iforest_score double, seq_score double, scored_by string"

    def stations(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = group_starts(pdf["station_id"])
        x = pdf[used].fillna(0.0).to_numpy(dtype=float)
        steps = pdf[ordered].fillna(0.0).to_numpy(dtype=float)
        forest, by_sequence = np.zeros(len(pdf)), np.zeros(len(pdf))
        judged, method = np.zeros(len(pdf), dtype=bool), np.full(len(pdf), "isolation_forest", dtype=object)
        for low, high in zip(starts, [*starts[1:], len(pdf)]):
            if high - low < min_rows:
                continue
            judged[low:high] = True
            seed = 42 + zlib.crc32(str(pdf["station_id"].iloc[low]).encode())
            forest[low:high] = forest_scores(x[low:high], seed, trees)
            if sequence and ordered:
                by_sequence[low:high] = reconstruction_scores(steps[low:high])
                if by_sequence[low:high].any():
                    method[low:high] = "forest + sequence"
        return pdf.assign(iforest_score=forest, seq_score=by_sequence, scored_by=method)[judged]

    return whole_groups(spread(features, ["station_id"]), ["station_id"], "obs_date", stations, schema)


def detect(features: DataFrame, residuals: DataFrame | None = None, min_rows: int = 365,
           trees: int = 200, sequence: bool = True) -> DataFrame:
    """Features to labelled anomaly rows: model scores, blend, flag, classify."""
    columns = ["station_id", "obs_date", "latitude", "longitude", "geohash_prefix"]
    complete = with_residuals(features, residuals, ["tmax", "tmin", "prcp"])
    narrow = complete.select(*columns, *[F.col(c) for c in anomaly.FEATURES])
    scored = anomaly.ensemble_score(model_scores(narrow, min_rows=min_rows, trees=trees, sequence=sequence))
    return anomaly.event_rows(scored, F.col("scored_by"))


def detect_stored(lake: Lake, features: DataFrame, residuals: bool = True, buckets: int | None = None, min_rows: int = 365,
                  trees: int = 200, sequence: bool = True, **stl) -> DataFrame:
    """``detect`` with the residuals of a seasonal-trend decomposition (its parameters by ``stl``).

    Features and components are stored once, dealt and sorted by station, so that the decomposition, the join of the two
    and the models by station all read what they need from the buckets; only the features are shuffled, once."""
    buckets = buckets or max(int(lake.spark.conf.get("spark.sql.shuffle.partitions")), lake.spark.sparkContext.defaultParallelism)
    columns = ["station_id", "obs_date", "latitude", "longitude", "geohash_prefix", *[c for c in anomaly.FEATURES if c in features.columns]]
    values = [c for c in ("tmax", "tmin", "prcp") if c not in columns]
    stored = lake.bucketed(features.select(*columns, *values), "features", "scored", ["station_id"], ["obs_date"], buckets)
    parts = None
    if residuals:
        parts = lake.bucketed(decompose.stl(stored, **stl), "features", "components", ["station_id"], ["obs_date"], buckets)
    return detect(stored, parts, min_rows, trees, sequence)

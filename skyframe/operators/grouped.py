"""Layout for steps whose work is out of proportion to their input size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by the group keys into a fixed number of tasks.

    Model input is small in bytes but heavy in CPU, so adaptive coalescing would pack it
    into a few tasks; an explicit count is left alone. Call it before the first window or
    group on the keys: what follows on the same keys needs no further shuffle (and a later
    call would be dropped by the planner as redundant)."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def group_starts(*keys: pd.Series) -> np.ndarray:
    """The first place of each run of equal keys; missing ones are equal."""
    codes = np.stack([pd.factorize(k)[0] for k in keys])
    return np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])[:codes.shape[1]]


def whole_groups(df: DataFrame, keys: list[str], order: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Like ``groupBy(*keys).applyInPandas``, but ``work`` gets several whole groups at once, one after the other and
    sorted, so that small groups share what each call costs.

    ``df`` must be dealt by the keys already (``spread``). Only an Arrow batch and the group that it cuts are held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if cut is None else pd.concat([cut, pdf], ignore_index=True)
            last = group_starts(*[pdf[k] for k in keys])[-1]
            cut = pdf.iloc[last:]
            if last:
                yield work(pdf.iloc[:last])
        if cut is not None:
            yield work(cut.reset_index(drop=True))

    return df.sortWithinPartitions(*keys, order).mapInPandas(run, schema)

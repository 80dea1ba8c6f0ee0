"""What the text operators share: row locators, stored intermediate tables, Arrow batches, size checks."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyframe.session import shared_dir

#: A table of this many rows (of at most about 150 bytes) may be broadcast, some 15 MB; beyond it joins shuffle.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once as Parquet in the shared folder and read back: consumers share one computation and a
    lost executor costs a re-read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ``more``, file, row): every row with the place it is stored at, which is a unique and stable key even
    where ``doc_id`` is null or repeated. A frame that is not a plain file scan is stored first."""
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select("doc_id", "text", *more, meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    except AnalysisException:
        return located(cut(docs.select("doc_id", "text", *more), "documents"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table is small enough to be broadcast; the count comes from the files' footers."""
    return df.count() <= rows


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast only if it is within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if fits(df, rows) else df


def content_key(text: Column | str = "text") -> Column:
    """The first 16 bytes of the SHA-256 of a text (null as empty): the identity of a distinct text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256), 1, 32))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers receive: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


_kept: list = []


def kept(fn: Callable) -> Callable:
    """``functools.cache`` for what is large: the worker process gives it back when it goes on with another operator."""
    cached = functools.cache(fn)
    _kept.append(cached)
    return cached


def release() -> None:
    """Give back what ``kept`` functions hold in this process."""
    held = [cached for cached in _kept if cached.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to a dict of columns."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        arrow = to_arrow_schema(out)
        for batch in batches:
            found = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if not isinstance(found[f.name], pa.Array)
                                              else found[f.name] for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def crc_share(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus

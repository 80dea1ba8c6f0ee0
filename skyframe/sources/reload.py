"""Truncate-and-reload of serving tables with commit.

A reload writes a new generation of the table from the executors, beside the one in use. Only when all its files are there does
a small manifest begin to name it, by a rename that replaces the old manifest at once. Readers follow the manifest, so they
see the table before or after a reload and never a part of it; a reload that fails leaves the table as it was. Each reload
has a batch name: a batch that the manifest already names is not loaded again, so replays change nothing."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skyframe.sources import publish

MANIFEST = "CURRENT"


class Serving:
    """The serving tables under one root that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _hadoop(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, conf, place, place.getFileSystem(conf)

    def manifest(self, table: str) -> dict:
        """What is in use: the batches loaded, newest last; empty before the first reload."""
        try:
            lines = self.spark.read.text(f"{self.root}/{table}/{MANIFEST}", wholetext=True).collect()
        except AnalysisException:
            return {"batches": []}
        return json.loads(lines[0][0])

    def _commit(self, table: str, manifest: dict) -> None:
        path = f"{self.root}/{table}/{MANIFEST}"
        jvm, conf, new, fs = self._hadoop(f"{path}.{manifest['batches'][-1]}")
        out = fs.create(new, True)
        out.writeBytes(json.dumps(manifest))
        out.close()
        replace = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(replace, 1)
        options[0] = replace.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)

    def reload(self, df: DataFrame, table: str, batch: str, keep: int = 2) -> bool:
        """Replace the table by the rows of ``df`` in its serving shape; False if the batch had been loaded before.

        The ``keep`` newest generations stay, for readers that have begun; older ones are removed after the commit."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a batch name: {batch}")
        manifest = self.manifest(table)
        if batch in manifest["batches"]:
            return False
        # what a failed attempt of the batch left is replaced; two generations lie side by side, so they are packed well
        publish.shape(df, table).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{table}/g-{batch}")
        batches = [*manifest["batches"], batch]
        self._commit(table, {"batches": batches})
        for old in batches[:-keep]:
            _, _, place, fs = self._hadoop(f"{self.root}/{table}/g-{old}")
            fs.delete(place, True)
        return True

    def read(self, table: str) -> DataFrame:
        """The table as the last reload left it."""
        batches = self.manifest(table)["batches"]
        if not batches:
            raise ValueError(f"{table} has not been loaded")
        return self.spark.read.parquet(f"{self.root}/{table}/g-{batches[-1]}")

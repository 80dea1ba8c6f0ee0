"""Lake zones and writers."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyframe.operators import grouped


class Lake:
    """Paths of the zones under one root that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, zone: str, table: str) -> str:
        if zone not in ("raw", "processed", "features", "output"):
            raise ValueError(f"unknown zone: {zone}")
        return f"{self.root}/{zone}/{table}"

    def read(self, zone: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(zone, table))

    def write(self, df: DataFrame, zone: str, table: str, by: list[str] | None = None,
              mode: str = "overwrite", spread: int | None = None) -> DataFrame:
        """Write once and hand back the stored table, so that later steps read it
        instead of computing it again."""
        path = self.path(zone, table)
        if by:
            partitioned(df, path, by, mode, spread)
        else:
            df.write.mode(mode).parquet(path)
        return self.spark.read.parquet(path)

    def _name(self, zone: str, table: str) -> str:
        return f"{zone}_{table}_{zlib.crc32(self.root.encode()):08x}"

    def bucketed(self, df: DataFrame, zone: str, table: str, by: list[str], sort: list[str], buckets: int) -> DataFrame:
        """Replace a table dealt into ``buckets`` by hash and sorted within them. Tables dealt alike meet and are grouped by station
        without a shuffle: a station's rows are in one bucket, at most one a day. The session may then join by more
        columns than the buckets' own. The catalog knows the table, by a name of its own for each root, only until its
        files and buckets are looked up, so that nothing of it is left there."""
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        name = self._name(zone, table)
        (df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by, *sort)
         .option("path", self.path(zone, table)).saveAsTable(name))
        found = self.spark.table(name)
        self.forget(zone, table)
        return found

    def forget(self, zone: str, table: str) -> None:
        """Take a bucketed table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(zone, table)}")

    def register(self, zone: str, table: str, name: str) -> None:
        """Catalog table over a stored path; running it again changes nothing."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{self.path(zone, table)}'")
        if "PARTITIONED" in self.spark.sql(f"SHOW CREATE TABLE {name}").first()[0]:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")


def partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite",
                spread: int | None = None, sort: list[str] | None = None) -> None:
    """Hive-partitioned Parquet with dynamic overwrite and few files per partition.

    Rows are shuffled by the partition columns and, with ``spread``, by a hash of the
    whole row into that many parts, so a partition holding a third of the data is
    written by several tasks. Without it AQE's rebalance splits oversized partitions.
    """
    if spread:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        shuffled = grouped.spread(df.withColumn("_part", part), [*by, "_part"]).drop("_part")
    else:
        shuffled = df.hint("rebalance", *[F.col(c) for c in by])
    if sort:
        shuffled = shuffled.sortWithinPartitions(*by, *sort)
    (shuffled.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_lines(df: DataFrame, path: str, column: str | Column = "value") -> None:
    """One line per row, for newline-delimited GeoJSON."""
    df.select(column).write.mode("overwrite").text(path)

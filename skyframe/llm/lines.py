"""Line deduplication with levelled sorted runs of line hashes.

The corpus is taken in batches. A batch's lines are counted by key; keys that the runs have already settled as common
are anti-joined away, the others are added as a new sorted run. A level that holds ``fanout`` runs is compacted into
one run of the next level, where keys that have reached the threshold move to the settled runs. Runs are bucketed and
sorted by the same hash, so the joins and merges between them need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyframe.llm.common import cut, folder, located, lookup

#: Fixed values of the key: the white space stripped at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z in lower case. ``lower`` agrees with that on ASCII and is cheaper."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column | str = "text") -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


class Runs:
    """Sorted runs of (h1, h2, n) in levels; a key is settled once a run counts it ``at_least`` times. Each run is a
    bucketed table in the shared folder with as many buckets as a shuffle has partitions, so an aggregation by key writes
    its buckets as they are."""

    def __init__(self, spark: SparkSession, at_least: int, fanout: int = 2):
        self.spark, self.at_least, self.fanout = spark, at_least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.levels, self.names = folder(spark, "runs"), {}, []

    def _store(self, df: DataFrame) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def _runs(self) -> list[DataFrame]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def add(self, counts: DataFrame) -> None:
        """A batch's keys (h1, h2, n): without those already settled they become a run of the lowest level."""
        for run in self._runs():
            counts = counts.join(run.where(F.col("n") >= self.at_least).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels.setdefault(0, []).append(self._store(counts))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self.levels.setdefault(level + 1, []).append(self._merged(self.levels.pop(level)))
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, merged two at a time by full joins of their buckets."""
        merged = runs[0]
        for run in runs[1:]:
            a, b = merged.alias("a"), run.hint("merge").alias("b")
            both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            merged = self._store(both.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), n.alias("n")))
        return merged

    def common(self) -> DataFrame:
        """(h1, h2) of all keys that are settled when all runs are one."""
        self.levels = {max(self.levels, default=0): [self._merged(self._runs())]}
        return self._runs()[0].where(F.col("n") >= self.at_least).select("h1", "h2")

    def forget(self) -> None:
        """Take the runs out of the catalog; no frame that reads them may be used afterwards."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.names = {}, []


def hashes(key: Column, position: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), position.alias("pos"), F.char_length(key).alias("length"))


def is_first(x: Column, i: Column) -> Column:
    before = F.get("lines", i - 1)
    return F.coalesce((before["h1"] != x["h1"]) | (before["h2"] != x["h2"]), F.lit(True))


def drop_common(docs: DataFrame, at_least: int = 10, shortest: int = 1, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines whose key is found in ``at_least`` rows.

    Null or empty texts are one empty line. Keys below ``shortest`` code points are never dropped. A key that repeats
    within a document counts once there; every row is a document of its own, so repeated rows and ids count each. No
    rows: no rows. Columns besides ``doc_id`` and ``text`` are not read. Keys are compared by 128 bits of hash."""
    spark = docs.sparkSession
    rows = located(docs)
    hashed = F.transform(split_lines(), lambda line, i: hashes(line_key(line), i))
    long_enough = F.filter(hashed, lambda x: x["length"] >= max(1, shortest))
    # sorted by key within the document: the first line of each key is the one that counts
    in_order = rows.select("file", "row", F.array_sort(long_enough).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), is_first(x, i).alias("first")))
    keyed = in_order.select("file", "row", F.explode(marked).alias("x")).select("file", "row", "x.*")
    path = folder(spark, "lines")
    keyed.write.parquet(path)
    stored = spark.read.schema(keyed.schema).parquet(path)
    files = sorted(stored.inputFiles())
    runs = Runs(spark, at_least, fanout)
    for k in range(min(batches, max(1, len(files)))):
        part = spark.read.schema(keyed.schema).parquet(*files[k::batches]) if files else stored
        runs.add(part.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    common = cut(runs.common(), "common")
    runs.forget()
    drops = cut(stored.join(lookup(common), ["h1", "h2"], "left_semi").groupBy("file", "row").agg(F.collect_list("pos").alias("drops")), "drops")
    joined = rows.join(drops.hint("merge"), ["file", "row"], "left").withColumn("lines", split_lines())
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))

"""Exact deduplication as a stateful stream.

The rows' digests flow through Structured Streaming into a keyed state on disk (RocksDB, no watermark, nothing
expires). For each digest the state retains the stable identifier of the row that stays, the locator of its content
(file and row) and the number of rows. Rows that hit an entry are then checked by their full bytes; a digest that
stands for different texts is resolved by the texts themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyframe.llm.common import cut, folder, fresh, located, lookup

#: Settings of the stream: the state on disk, in files that take the room they need (else some MB are reserved for each store).
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestStore:
    """The state, the digests it was fed and what it has told so far, in one folder. Each call to ``absorb`` adds rows, so
    the store can be kept and fed as a corpus grows; texts stay where they are and are found by their locators."""

    def __init__(self, spark: SparkSession, path: str, files_per_batch: int = 1000):
        self.spark, self.path, self.files_per_batch = spark, path, files_per_batch

    def has(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def absorb(self, keyed: DataFrame, call: str) -> DataFrame:
        """Feed (doc_id, digest, file, row) rows into the state and return them as stored. ``call`` names the rows: a call
        that is made again goes on where it failed and counts nothing twice."""
        spark, entry, path = self.spark, F.struct("doc_id", "file", "row"), f"{self.path}/digests/call={call}"
        if not self.has(f"{path}/_SUCCESS"):
            keyed.write.mode("overwrite").parquet(path)
        before = {setting: spark.conf.get(setting, None) for setting in STATE}
        for setting, value in STATE.items():
            spark.conf.set(setting, value)
        try:
            stream = (spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", self.files_per_batch)
                      .option("recursiveFileLookup", "true").parquet(f"{self.path}/digests")
                      .groupBy("digest").agg(F.max(entry).alias("best"), F.count(F.lit(1)).alias("n")))

            def told(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.path}/told/batch={number}")

            (stream.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/state")
             .trigger(availableNow=True).foreachBatch(told).start().awaitTermination())
        finally:
            for setting, value in before.items():
                spark.conf.set(setting, value) if value else spark.conf.unset(setting)
        return spark.read.schema(keyed.schema).parquet(path)

    def rows(self) -> DataFrame:
        """(doc_id, digest, file, row) of all calls."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/digests")

    def others(self, call: str, hits: DataFrame) -> DataFrame:
        """(digest, file, row): for each of the ``hits`` one row that an earlier call brought, where there is one."""
        rows = self.spark.read.parquet(f"{self.path}/digests").where(F.col("call").cast("string") != call)
        one = rows.join(lookup(hits), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("file", "row")).alias("x"))
        return one.select("digest", "x.file", "x.row")

    def clashes(self, found: DataFrame, call: str) -> DataFrame:
        """Remember the digests that stand for different texts; all those known by now."""
        found.write.mode("overwrite").parquet(f"{self.path}/clashes/call={call}")
        return self.spark.read.parquet(f"{self.path}/clashes").select("digest").distinct()

    def texts(self, places: DataFrame) -> DataFrame:
        """The stored ``places`` (digest, file, row, ...) with the texts that are there."""
        files = [r.file for r in places.select("file").distinct().collect()]
        if not files:
            return places.withColumn("text", F.lit(""))
        docs = self.spark.read.parquet(*files)
        meta = docs.metadataColumn("_metadata")
        return docs.select(F.coalesce("text", F.lit("")).alias("text"), meta["file_path"].alias("file"),
                           meta["row_index"].alias("row")).join(lookup(places), ["file", "row"])

    def entries(self) -> DataFrame:
        """(digest, best, n): the newest word of the state on each digest. Counts only grow, so the largest is it."""
        told = self.spark.read.parquet(f"{self.path}/told")
        newest = told.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("x"))
        return newest.select("digest", "x.n", "x.best")


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, store: DigestStore | None = None, call: str | None = None) -> DataFrame:
    """(doc_id, text_digest, keep_id, group_size, kept, file, row), one row for each row of ``docs``.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays, a
    null id being below all others; of rows that repeat an id and its text, the one stored last. No rows: no rows.
    Columns besides ``doc_id`` and ``text`` are not read. ``digest`` may be any function to binary; a weak one costs
    time, not correctness. With a ``store`` that was fed before, groups reach over all its calls; ``call`` names this one
    (see ``DigestStore.absorb``), and the files of earlier calls must still be where they were."""
    spark = docs.sparkSession
    rows = located(docs).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "file", "row")
    fed, call = store is not None, call or uuid.uuid4().hex
    store = store or DigestStore(spark, folder(spark, "exact"))
    if not fed or not store.has(f"{store.path}/told"):
        keyed = cut(keyed, "digests")
        if keyed.isEmpty():
            return keyed.select("doc_id", F.col("digest").alias("text_digest"), F.col("doc_id").alias("keep_id"),
                                F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "file", "row")
    stored = store.absorb(keyed, call)
    entries = cut(store.entries(), "entries")
    decided = stored.join(entries, "digest").select(
        "doc_id", F.col("digest").alias("text_digest"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), "file", "row")
    hits = entries.where("n > 1").select("digest")
    hits = cut(hits.join(stored.select("digest"), "digest", "left_semi") if fed else hits, "hits")
    texts = rows.select(digest(F.col("text")).alias("digest"), "text").join(lookup(hits), "digest", "left_semi")
    if fed:
        texts = texts.unionByName(store.texts(cut(store.others(call, hits), "others")).select("digest", "text"))
    clashes = cut(differing(texts), "clashes")
    if fed:
        clashes = cut(store.clashes(clashes, call).join(stored.select("digest"), "digest", "left_semi"), "clashes")
    if clashes.isEmpty():
        return decided
    if fed:
        places = cut(store.rows().join(lookup(clashes), "digest", "left_semi"), "places")
        mine = store.texts(places)
    else:
        mine = rows.withColumn("digest", digest(F.col("text"))).join(lookup(clashes), "digest", "left_semi")
    settled = by_text(mine)
    if fed:
        settled = settled.join(stored.select("file", "row"), ["file", "row"], "left_semi").select(decided.columns)
    return decided.join(lookup(clashes), F.col("text_digest") == F.col("digest"), "left_anti").unionByName(settled)


def differing(texts: DataFrame) -> DataFrame:
    """Digests whose (digest, text) rows are not all the same bytes: the smallest and the largest text of a group are
    equal exactly if all are, and both are aggregated before the shuffle, so a large group moves as a few rows."""
    return (texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
            .where(F.col("lo") != F.col("hi")).select("digest"))


def by_text(mine: DataFrame) -> DataFrame:
    """The groups of (doc_id, digest, text, file, row) rows by digest and whole text."""
    best = cut(mine.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("best"),
                                                  F.count(F.lit(1)).alias("n")), "texts")
    return mine.join(best, ["digest", "text"]).select(
        "doc_id", F.col("digest").alias("text_digest"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), "file", "row")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``docs`` must be a file scan (see ``located``)."""
    meta = docs.metadataColumn("_metadata")
    file, row = fresh(docs, "file"), fresh(docs, "row")
    dropped = cut(groups(docs).where(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row)), "dropped")
    return docs.join(lookup(dropped), (meta["file_path"] == F.col(file)) & (meta["row_index"] == F.col(row)), "left_anti")

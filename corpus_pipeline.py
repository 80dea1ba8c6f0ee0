"""The corpus pipeline: documents are filtered for toxicity, deduplicated exactly and nearly, freed of benchmark passages
and packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` stores what a stage returns as
Parquet in the shared folder and reads it again. All stages but the last return the columns of ``documents``. Null texts
count as empty, null and repeated ids are kept as they are, an empty table passes through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm import decontaminate, exact, neardup, packing, toxicity
from skyframe.llm.common import cut
from skyframe.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier is fitted on the labelled documents among them."""
    ship(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    ship(spark)
    return exact.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest id."""
    ship(spark)
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their token ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("decontamination", drop_contaminated), ("packing", pack)]

#: The stages that learn, sample or tokenise have no SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

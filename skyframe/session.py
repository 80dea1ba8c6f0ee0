"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def build(app: str = "skyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC dates; keyword conf uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df, name: str):
    """Write ``df`` once to the shared folder and read it back, so that several
    consumers share one computation and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that the grouped
    models can be imported there wherever the driver was started from."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = pathlib.Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/{package.name}", "zip",
                                      package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)

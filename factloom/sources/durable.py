"""Cutting lineage in a folder that all executors share, so that lost executors don't bring old stages back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, else spark.checkpoint.dir, else (local masters, tests) a new one."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, read from the shared folder from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``cut``, as Parquet, for what a loop joins again and again.

    A checkpoint keeps its plan's estimated size. Estimates of joins are products, so in a loop their digits multiply
    with each round, which fills the driver after a dozen; files have the size they have. How rows were dealt is lost.
    ``path``: a new folder within the shared one, for what is ``removed`` before the session ends.
    """
    path = path or f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``written`` rows that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Where results between jobs are written, and the end of a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset: a temporary folder if all run on one machine,
    as in tests, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"file://{tempfile.mkdtemp(prefix='parchment-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str = "stage", instead_of: DataFrame | None = None) -> DataFrame:
    """df as a written table: its plan is run once, and lost executors lose nothing of it. instead_of: a staged table that nothing reads once this one is written; it is
    deleted, so that a loop holds two tables, not one for each round."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for old in instead_of.inputFiles()[:1] if instead_of is not None else ():
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(old).getParent()
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return df.sparkSession.read.schema(df.schema).parquet(path)

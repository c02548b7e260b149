"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a folder of its
    own; on a cluster no folder of this machine would do, so that is an error.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{key} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession.sparkContext
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

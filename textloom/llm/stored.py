"""Cutting lineage with Parquet tables in the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder; the table stays as long as the folder."""
    return store_at(df)[0]


def store_at(df: DataFrame) -> tuple[DataFrame, str]:
    """And where, for :func:`drop`."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are stored: it does once the driver collects their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

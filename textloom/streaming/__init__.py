"""Incremental use of the operators: pages as they arrive, a manifest that only grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.html import metadata


def stream_metadata(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Metadata of pages from Parquet files as they are added to a folder; a stateless projection."""
    pages = spark.readStream.schema(schema).parquet(path)
    return pages.select("page_id", "url", metadata(F.col("html"), F.col("url")).alias("m")).select("page_id", "url", "m.*")


def grow_manifest(stream: DataFrame, manifest_path: str, checkpoint: str, key: str, added) -> StreamingQuery:
    """Appends each batch's new keys with the date they were added; a batch that runs again adds nothing."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.min(added).alias("added"))
        try:
            known = spark.read.parquet(manifest_path).select(key)
            new = new.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no manifest
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(manifest_path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

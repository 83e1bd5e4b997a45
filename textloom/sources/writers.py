"""Sinks. Overwrites go to a path of their own; the caller swaps it in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """With a partition column, only the partitions that the rows are in are replaced."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by) if partition_by else writer).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each key, with its text; folders of other keys stay."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def write_document(paragraphs: DataFrame, pages: DataFrame, metadata: DataFrame, tables: DataFrame, path: str) -> None:
    """What a run makes of documents, each in folders by document: the body as text, and its pages, metadata and tables as JSON.

    paragraphs: (doc_id, page, para_no, text). Folders of documents that aren't among the rows stay.
    """
    parts = F.array_sort(F.collect_list(F.struct("page", "para_no", "text")))
    body = paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
    write_texts(body, f"{path}/body", "doc_id", "text")
    for name, df in (("pages", pages), ("metadata", metadata), ("tables", tables)):
        write_json(df, f"{path}/{name}", "doc_id")


def observed(df: DataFrame, name: str, *counts) -> tuple[DataFrame, Observation]:
    """The rows, and what a run over them counts, for its report; read it once they are written."""
    report = Observation(name)
    return df.observe(report, F.count(F.lit(1)).alias("n_rows"), *counts), report


def write_index(index: DataFrame, gallery: DataFrame, path: str) -> bool:
    """An index (html) and a gallery of posters (html): the gallery is written only if it has rows, and else goes. Whether there is one."""
    index.select(F.col("html").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/index")
    some = not gallery.isEmpty()
    if some:
        gallery.select(F.col("html").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/posters")
    else:
        spark = index.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/posters")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return some


def transcript_text(turns: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, text): ``Name HH:MM:SS`` and the sentences of each turn, in order."""
    from textloom.functions.text import to_stamp

    block = F.concat_ws("\n", F.concat_ws(" ", "speaker", to_stamp(F.col("start"))), F.array_join("sents", " "))
    return turns.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("text"))


def append_new(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Insert-only merge: what is there, and rows of new keys."""
    return existing.unionByName(df.join(existing.select(*key), key, "left_anti"))

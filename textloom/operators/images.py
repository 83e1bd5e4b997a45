"""Images of an article: deduplicated, filtered, and anchored to the text block before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.html import NOISE_IMAGE, anchor_key, events, image_id, image_variant
from textloom.functions.text import found


def fill_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Adds the latest value that isn't null up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def anchor_images(docs: DataFrame, blocks: DataFrame, id_: str = "doc_id", html: str = "html") -> DataFrame:
    """(id, pos, url, alt, image_id, anchor_index, seq, is_hero) of images.

    blocks: (id, block_no, text). An image's anchor is the last block matched
    by its text before the image, -1 for none; noise is dropped first, then
    later images of the same id. Only the very first image can be the hero, if
    it has no anchor.
    """
    seq = docs.select(id_, F.posexplode(events(F.col(html))).alias("pos", "e")).select(id_, "pos", "e.*")
    index = blocks.select(id_, anchor_key(F.col("text")).alias("key"), "block_no").groupBy(id_, "key").agg(F.max("block_no").alias("block_no"))
    own = seq.withColumn("key", F.when(F.col("kind") == "text", anchor_key(F.col("value")))).join(index, [id_, "key"], "left")
    own = fill_forward(own, [id_], ["pos"], F.col("block_no"), "anchor_index")
    imgs = own.where("kind = 'img'").withColumn("alt", F.coalesce(found(F.col("raw"), r'alt="([^"]*)"'), F.lit("")))
    imgs = imgs.where(~(F.col("value").rlike(NOISE_IMAGE) | F.col("alt").rlike(NOISE_IMAGE))).withColumn("image_id", image_id(F.col("value")))
    imgs = imgs.withColumn("n", F.row_number().over(Window.partitionBy(id_, "image_id").orderBy("pos"))).where("n = 1")
    imgs = imgs.withColumn("anchor_index", F.coalesce("anchor_index", F.lit(-1))).withColumn("seq", F.row_number().over(Window.partitionBy(id_).orderBy("pos")))
    return imgs.select(id_, "pos", F.col("value").alias("url"), "alt", "image_id", "anchor_index", "seq", ((F.col("seq") == 1) & (F.col("anchor_index") < 0)).alias("is_hero"))


def size_filter(images: DataFrame, w: str = "w", h: str = "h", least: int = 100) -> DataFrame:
    """Adds variant and skip_reason: known sizes under the least are skipped, unknown ones (0) kept."""
    small = F.least(w, h)
    return images.withColumn("variant", image_variant(F.col(w), F.col(h))).withColumn("skip_reason", F.when((small > 0) & (small < least), "small"))


def image_coverage(images: DataFrame, id_: str = "doc_id", accepted: str = "accepted") -> DataFrame:
    """(id, candidates, downloaded, ratio)."""
    out = images.groupBy(id_).agg(F.count("*").alias("candidates"), F.count_if(accepted).alias("downloaded"))
    return out.withColumn("ratio", F.bround(F.when(F.col("candidates") > 0, F.col("downloaded") / F.col("candidates")).otherwise(1.0), 3))


def reuse(wanted: DataFrame, manifest: DataFrame, key: list[str], refresh: bool = False) -> DataFrame:
    """Adds reused: whether the manifest has the row already."""
    known = manifest.select(*key).distinct().withColumn("reused", F.lit(not refresh))
    return wanted.join(known, key, "left").fillna({"reused": False})


def first_accepted(log: DataFrame, accepted: Column, key: str = "url", attempt: str = "attempt") -> DataFrame:
    """The first accepted attempt for each key."""
    own = log.where(accepted)
    return own.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(attempt))).where("__n = 1").drop("__n")

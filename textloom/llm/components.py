"""Connected components over tables of links.

Each task first replaces its links by stars: each node linked to the least node
of its component among so many links. What is left is one task's work while it
is at most ``here`` links (16 bytes each), and is put through alternating
large-star and small-star steps beyond that. Both give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.stored import drop, release, store_at

ROUNDS = 60
#: Links that a task holds at once.
HERE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, node): all nodes of the links but the least of each component, with that."""
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, own = place[: len(u)], place[len(u) :], np.arange(len(node))
    label, before = own.copy(), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
    others = label != own
    return node[label[others]], node[others]


def _stars(links: DataFrame, here: int, whole: bool = False) -> DataFrame:
    """(u, v): the links of each task, ``here`` at a time, as stars; whole: of all links of a task, least nodes included."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def turned() -> pa.RecordBatch:
            least, node = stars(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
            if whole:
                roots = np.unique(least)
                least, node = np.concatenate([least, roots]), np.concatenate([node, roots])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["u", "v"])

        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            held += len(batch)
            if held > here and not whole:
                yield turned()
                us, vs, held = [], [], 0
        yield turned()

    return links.select("u", "v").where("u is not null and v is not null").mapInArrow(made, "u long, v long")


def _least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its v; only minima are gathered, never neighbours.

    Minima are combined before the shuffle, and the join may split a node with very many links over tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u2", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("u2")).select("u", "v", "m")


def components(links: DataFrame, here: int = HERE) -> DataFrame:
    """(node, component) of all nodes of the links (u, v); the component is its least node.

    Each step of the distributed form links nodes to the least node of their
    neighbourhood; stars are what no step changes. Steps are stored, so lineage
    stays short, and only a count and a checksum of each come to the driver.
    """
    links, path = store_at(_stars(links, max(here, 1)))
    spark, before = links.sparkSession, None
    if links.count() <= here:
        return _stars(links.coalesce(1), here, whole=True).toDF("node", "component")
    for _ in range(ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        links, now_at = store_at(small.where("u <> v").distinct())
        del both, large, near, small
        drop(spark, path)
        path = now_at
        release(spark)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

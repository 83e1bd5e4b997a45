"""Byte n-gram indicators, and what the classifiers share: label folds, bounded samples, scaling of margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.stored import store

#: Labels that may be broadcast to their documents; more are joined by shuffling.
BROADCAST_LABELS = 1_000_000


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(id, text, label) of the documents with a label; of several labels of an id the largest counts, once.

    Labels are broadcast only up to a checked number. Repeated documents are rows of their own.
    """
    labels = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    labels = store(labels)
    side = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(side, F.col("id") == F.col("__id")).drop("__id")


def bounded(rows: DataFrame, most: int, label: str = "label", id_: str = "id") -> DataFrame:
    """The ``most`` rows of each label whose ids have the least hashes (all, where there are fewer): never more, however many rows there are.

    Labels are counted, so that about twice as many rows as wanted lie under a
    bound on the hashes; only these are shuffled and ranked. Where too few do
    (rows that repeat an id lie all on one side), the bound is raised.
    """
    hashed = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(id_, F.lit(17)), 1))
    count = lambda df: {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    wanted = count(hashed)  # a row for each label
    share, got = {k: min(1.0, 2 * most / n) for k, n in wanted.items()}, {}
    while True:
        within = F.lit(False)
        for k, x in share.items():
            within = within | (F.col(label).eqNullSafe(F.lit(k)) & (F.col("__hash") <= F.lit(int(x * (2**63 - 1024)) if x < 1 else 2**63 - 1)))
        got = count(hashed.where(within))
        few = [k for k, n in wanted.items() if got.get(k, 0) < min(most, n)]
        if not few:
            break
        share |= {k: min(1.0, 4 * share[k]) for k in few}
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__hash"))
    return hashed.where(within).withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__hash", "__rank")


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a m + b))) fits the labels, by Newton steps with smoothed targets."""
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = margins.mean(), margins.std() or 1.0
    x = np.stack([(margins - mean) / spread, np.ones_like(margins)])

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * (w @ w))

    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(w @ x)
        slope = x @ (p - target) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

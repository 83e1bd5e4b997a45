"""Quality classifier (operator 3): linear support vectors over naive Bayes features.

Features are indicators of byte n-grams of a whole text (hashed to ``BUCKETS``
places). Document frequencies by class are counted over all labelled
training documents, on the cluster; their smoothed log-count ratios scale the
indicators. A hinge-loss linear model is then fitted by dual coordinate descent
on a bounded sample, at most ``sample`` documents of each class, chosen by a hash
of the id. A part of the sample is kept out of that fit and turns margins into
probabilities.

Results: empty and null texts have no n-grams and get the score of the
intercept. Without labelled rows, or with one class only, the score is that
class's share (0.5 without any). Of several labels of an id the largest counts;
repeated documents count as often as they are there and get equal scores, so
there are no ties to break. Very long texts are read whole. An empty table gets
an empty result. Labels, language, source and id are no inputs. Input columns
stay, but for those with the names of outputs (score, predicted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.features import bounded, labelled, platt, sigmoid
from textloom.llm.shared import Shared

BITS = 17
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3, 4)
SAMPLE = 1500


def features(text: str | None) -> np.ndarray:
    """Sorted places of the n-grams that occur."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = []
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    for n in ORDERS:
        if len(codes) < n:
            break
        gram = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            gram |= codes[k : len(codes) - n + 1 + k] << np.uint64(8 * k)
        gram = (gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((gram >> np.uint64(64 - BITS)).astype(np.int64))
    if not out:
        return np.zeros(0, np.int32)
    seen = np.zeros(BUCKETS, bool)
    for place in out:
        seen[place] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(places: np.ndarray) -> bytes:
    """At most BUCKETS / 8 bytes: the places, or a bit for each bucket."""
    if len(places) * 4 < BUCKETS // 8:
        return places.tobytes()
    bits = np.zeros(BUCKETS, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32) if len(data) == BUCKETS // 8 else np.frombuffer(data, np.int32)


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Document frequencies of all features in (2, BUCKETS) by label, and documents by label, over all rows (id, text, label)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[int(y == 1), features(t.as_py())] += 1
                docs[int(y == 1)] += 1
        there = np.flatnonzero(counts.any(axis=0))
        columns = [np.append(there, -1), np.append(counts[0, there], docs[0]), np.append(counts[1, there], docs[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["place", "n0", "n1"])

    found = rows.select("text", "label").mapInArrow(counted, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # BUCKETS rows at most
    counts, docs = np.zeros((2, BUCKETS)), np.zeros(2)
    for k, column in enumerate(("n0", "n1")):
        at, n = found["place"].to_numpy(), found[column].to_numpy()
        counts[k, at[at >= 0]] = n[at >= 0]
        docs[k] = n[at < 0].sum()
    return counts, docs


def log_count_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    shares = counts + smooth
    shares /= shares.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: np.ndarray, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model; rows are (places, values), labels +1 and -1, cost of each row."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            if not norm[i]:
                continue
            at, v = rows[i]
            slope = labels[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * labels[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


class Model:
    def __init__(self, weights: np.ndarray, intercept: float, a: float, b: float):
        self.weights, self.intercept, self.a, self.b = weights, intercept, a, b

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(max(len(places), 1))) + self.intercept

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.a * self.margin(features(text)) + self.b))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """From (id, text, label) rows: frequencies over all of them, support vectors over a bounded sample."""
    counts, docs = count_features(rows)
    if not docs.all():
        share = (docs[1] + 0.0) / docs.sum() if docs.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(counts)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(features(t.as_py())) for t in batch.column(1)], pa.binary()), batch.column(2)], ["id", "places", "label"])

    got = sorted(bounded(rows, sample).select("id", "text", "label").mapInArrow(chosen, "id long, places binary, label int").collect(), key=lambda r: r["id"])
    places = [unpacked(r["places"]) for r in got]
    labels = np.where([r["label"] == 1 for r in got], 1.0, -1.0)
    # the last place is the intercept
    vectors = [(np.append(p, BUCKETS), np.append(ratios[p] / np.sqrt(max(len(p), 1)), 1.0)) for p in places]
    share = np.array([(labels == -1).mean(), 0.0, (labels == 1).mean()])
    cost = np.array([1.0 / max(share[int(y) + 1], 0.01) for y in labels])
    kept_out = np.arange(len(got)) % 4 == 3
    if len(set(labels[kept_out])) < 2:
        kept_out[:] = False
    inside = np.flatnonzero(~kept_out)
    w = dual_coordinate_descent([vectors[i] for i in inside], labels[inside], BUCKETS + 1, cost[inside])
    model = Model(w[:BUCKETS] * ratios, float(w[BUCKETS]), 1.0, 0.0)
    used = np.flatnonzero(kept_out) if kept_out.any() else inside
    margins = np.array([model.margin(places[i]) for i in used])
    model.a, model.b = platt(margins, (labels[used] == 1).astype(int))
    return model


def score_column(shared: Shared, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.get()
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Adds score and predicted to all documents; learns from those that have a label and for which ``train`` holds."""
    model = fit(labelled(docs.where(train), labels, doc_id, text, label), sample)
    shared = Shared(docs.sparkSession, Model, model.weights.astype(np.float32), model.intercept, model.a, model.b)
    return docs.withColumn("score", score_column(shared, F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

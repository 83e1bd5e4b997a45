"""The trained queries against plain versions that use no cluster, and what they share."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import features, language_id, quality_svm, toxicity
from textloom.llm.queries import op3_quality_svm, op9_toxicity
from textloom.llm.shared import CHAIN, KEEP, Shared


def crc_fold(doc_id, of):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % of


@pytest.fixture(scope="module")
def tables(spark, small):
    middle = small.replace("sf0.001", "sf0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    labels = [r.asDict() for r in spark.read.parquet(f"{middle}/labels.parquet").collect()]
    return middle, docs, labels


def plain_buckets(text):
    """Buckets of the distinct byte n-grams, one by one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    grams = {(n, data[i : i + n]) for n in quality_svm.ORDERS for i in range(len(data) - n + 1)}
    return {((int.from_bytes(g, "little") + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality_svm.BITS) for n, g in grams}


def test_quality_scores(spark, tables):
    """All rows are in the sample, so the model can be fitted anew without a cluster."""
    middle, docs, labels = tables
    rows = sorted((r["doc_id"], r["quality"]) for r in labels if r["quality"] is not None and r["doc_id"] in docs and crc_fold(r["doc_id"], 5))
    sets = {i: plain_buckets(docs[i]) for i, _ in rows}
    counts = np.zeros((2, quality_svm.BUCKETS))
    for i, y in rows:
        counts[y, list(sets[i])] += 1
    shares = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    ratios = np.log(shares[1]) - np.log(shares[0])
    y = np.array([1.0 if y == 1 else -1.0 for _, y in rows])
    places = [np.array(sorted(sets[i]), np.int64) for i, _ in rows]
    vectors = [(np.append(p, quality_svm.BUCKETS), np.append(ratios[p] / math.sqrt(max(len(p), 1)), 1.0)) for p in places]
    cost = np.where(y > 0, 1 / max((y > 0).mean(), 0.01), 1 / max((y < 0).mean(), 0.01))
    inside = [k for k in range(len(rows)) if k % 4 != 3]
    w = quality_svm.dual_coordinate_descent([vectors[k] for k in inside], y[inside], quality_svm.BUCKETS + 1, cost[inside])
    weights, intercept = (w[:-1] * ratios).astype(np.float32), float(w[-1])
    margin = lambda p, own: float(own[p].sum() / math.sqrt(max(len(p), 1))) + intercept
    out = [k for k in range(len(rows)) if k % 4 == 3]
    a, b = features.platt(np.array([margin(places[k], w[:-1] * ratios) for k in out]), (y[out] > 0).astype(int))
    got = {r["doc_id"]: r["score"] for r in op3_quality_svm(spark, middle).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        p = np.array(sorted(plain_buckets(t)), np.int64)
        assert abs(got[i] - features.sigmoid(a * margin(p, weights) + b)) < 1e-4, i


def test_toxicity_scores(spark, tables):
    middle, docs, labels = tables
    counts = np.zeros(toxicity.SYMBOLS**3)
    for t in docs.values():
        c = toxicity.codes(f"  {t or ''} ")
        np.add.at(counts, (c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], 1)
    restorer = toxicity.Restorer(counts)

    def words(text):
        low = (text or "").lower()
        return {w for token in low.split() for w in restorer.words(token)} | set(restorer.spaced(low))

    word_features = lambda w: {f"{w}$"} | {f"^{w[:k]}" for k in (4, 5, 6, 7) if len(w) >= k} if w else set()
    seed = lambda i: xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
    apart = lambda i: (seed(i) - 2**64 if seed(i) >= 2**63 else seed(i)) % 4 == 0
    rows = [(r["doc_id"], r["toxic"]) for r in labels if r["toxic"] is not None and r["doc_id"] in docs and crc_fold(r["doc_id"], 5)]
    n, total = {0: Counter(), 1: Counter()}, Counter(y for i, y in rows if not apart(i))
    for i, y in rows:
        if not apart(i):
            n[y].update({f for w in words(docs[i]) for f in word_features(w)})
    odds = {f: math.log((c + 0.1) / (total[1] + 0.2)) - math.log((n[0][f] + 0.5) / (total[0] + 1)) - 1 / math.sqrt(c) for f, c in n[1].items() if c >= toxicity.MIN_TOXIC}
    share = {f: x for f, o in odds.items() if o > 0 and (x := int(math.expm1(toxicity.SHARP * o) * toxicity.UNITS + 0.5)) > 0}
    margin = lambda t: math.log1p(sum(share.get(f, 0) for w in words(t) for f in word_features(w)) / toxicity.UNITS) / toxicity.SHARP
    out = [(margin(docs[i]), y) for i, y in rows if apart(i)]
    a, b = features.platt(np.array([m for m, _ in out]), np.array([y for _, y in out]))
    got = {r["doc_id"]: r["score"] for r in op9_toxicity(spark, middle).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert abs(got[i] - 1 / (1 + math.exp(-(a * margin(t) + b)))) < 1e-6, i


def plain_labels(net, window):
    """Probabilities at each byte of one window, unit by unit."""
    p, size = net.p, language_id.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    states = {}
    for d in "fb":
        h, own = [0.0] * size, []
        for byte in window if d == "f" else window[::-1]:
            x = [sum(float(p["embed"][byte][e] * p[f"in_{d}"][e][k]) for e in range(language_id.EMBED)) + float(p[f"add_{d}"][k]) for k in range(3 * size)]
            r = [sum(h[j] * float(p[f"rec_{d}"][j][k]) for j in range(size)) for k in range(3 * size)]
            z, reset = [sig(x[k] + r[k]) for k in range(size)], [sig(x[size + k] + r[size + k]) for k in range(size)]
            new = [math.tanh(x[2 * size + k] + reset[k] * r[2 * size + k]) for k in range(size)]
            h = [z[k] * h[k] + (1 - z[k]) * new[k] for k in range(size)]
            own.append(h)
        states[d] = own if d == "f" else own[::-1]
    out = []
    for f, b in zip(states["f"], states["b"]):
        scores = [sum(v * float(p["out"][k][lang]) for k, v in enumerate([*f, *b])) + float(p["bias"][lang]) for lang in range(len(net.langs))]
        whole = sum(math.exp(s) for s in scores)
        out.append([math.exp(s) / whole for s in scores])
    return out


def test_every_position_is_labelled_in_both_directions():
    net = language_id.Network.new(["a", "b", "c"], 2)
    texts = ["ein Wort und noch eines", "漢字 é " * 40, "x" * (language_id.CORE + 5), "a", "", None, "123"]
    sums = language_id.Predictor(net.langs, net.p).sums(texts)
    for t, got in zip(texts, sums):
        expected = np.zeros(3)
        if t and re.search(r"[^\W\d_]", t):
            for data, first, last in language_id.windows(t):
                expected += np.array(plain_labels(net, data)[first:last]).sum(axis=0)
            assert abs(got.sum() - len(t.encode())) < 1e-2
        assert np.abs(got - expected).max() < 2e-2, t


def test_windows_hold_each_byte_once():
    for t in ("", "a", "é" * 500, "漢字" * 300 + "x", "\ud800" * 400, "ab" * 1000):
        data = t.encode("utf-8", "surrogatepass")
        own = language_id.windows(t)
        assert b"".join(w[a:b] for w, a, b in own) == data
        for w, a, b in own:
            w.decode("utf-8", "surrogatepass"), w[:a].decode("utf-8", "surrogatepass"), w[b:].decode("utf-8", "surrogatepass")
            assert a <= language_id.MARGIN + 3 and len(w) - b <= language_id.MARGIN + 3
        assert all(x.decode("utf-8", "surrogatepass") in t and len(x) <= language_id.SPAN for x in language_id.spans(t))


def test_sample_is_bounded_at_any_size(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit("t").alias("text"))
    rows = rows.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("id"), F.lit(1).alias("label"), F.lit("t").alias("text")))
    got = Counter(r["label"] for r in features.bounded(rows, 50).collect())
    assert got == {0: 50, 1: 50}
    assert features.bounded(rows, 10_000).count() == rows.count() and features.bounded(rows.limit(0), 5).count() == 0


def test_one_label_counts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((r["id"], r["text"], r["label"]) for r in features.labelled(docs, labels, "doc_id", "text", "toxic").collect())
    assert got == [(1, "a", 1), (2, "b", 0), (2, "c", 0)]


def test_what_a_chain_uses_is_made_once(spark, tmp_path):
    """Batch after batch through as many things as one pass may use."""
    assert CHAIN <= KEEP
    path = str(tmp_path / "made")

    def make(path, name):
        with open(path, "a") as f:
            f.write(name + "\n")
        return name

    df = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("x"))

    def adds(shared):
        @F.arrow_udf("string")
        def through(x: pa.Array) -> pa.Array:
            return pa.array([f"{v}{shared.get()[-1]}" for v in x.to_pylist()])

        return through

    for k in range(CHAIN):
        df = df.withColumn("x", adds(Shared(spark, make, path, f"thing {k}"))(F.col("x")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        assert sorted(r["x"] for r in df.collect())[0] == "0" + "".join(map(str, range(CHAIN)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    made = Counter(open(path).read().split("\n")[:-1])
    assert len(made) == CHAIN and max(made.values()) == 1


def test_words_behind_spaces_and_signs():
    text = "you stupid idiot moron scum trash loser worthless disgusting clown pathetic are the worst of this and that time " * 3
    c = toxicity.codes(f"  {text} ")
    counts = np.bincount((c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], minlength=toxicity.SYMBOLS**3).astype(float)
    own = toxicity.Restorer(counts)
    assert own.spaced("y o u s t u p i d i d i o t now") == ["you", "stupid", "idiot"]
    assert own.words("2024") == ("2024",) and own.words("plain") == ("plain",) and own.words("") == ("",)
    assert own.words("y0u.$tup1d") == ("youstupid",) or set(own.words("y0u.$tup1d")) >= {"you", "stupid"}


def test_vectors_are_packed():
    for n in (0, 1, 100, quality_svm.BUCKETS // 32, quality_svm.BUCKETS):
        places = np.sort(np.random.default_rng(n).choice(quality_svm.BUCKETS, n, replace=False)).astype(np.int32)
        data = quality_svm.packed(places)
        assert len(data) <= quality_svm.BUCKETS // 8 and (quality_svm.unpacked(data) == places).all()

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id, quality_svm, toxicity
from textloom.llm.features import fold, platt, sigmoid
from textloom.llm.queries import op3_quality_svm, op5_language_id, op9_toxicity


@pytest.fixture(scope="module")
def middle(small):
    return small.replace("sf0.001", "sf0.01")


def held_out(spark, sf_dir, query, label):
    got = query(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert got["score"].between(0, 1).all()
    return got["score"].to_numpy(), got[label].to_numpy(), got["predicted"].to_numpy()


def area(score, y):
    return (score[y == 1][:, None] > score[y == 0][None]).mean()


def test_quality_on_held_out_rows(spark, middle):
    score, y, predicted = held_out(spark, middle, op3_quality_svm, "quality")
    assert area(score, y) > 0.97 and (predicted == y).mean() > 0.93


def test_toxicity_on_held_out_rows(spark, middle):
    score, y, predicted = held_out(spark, middle, op9_toxicity, "toxic")
    assert area(score, y) > 0.8 and predicted[y == 0].mean() < 0.05


def test_language_on_held_out_rows(spark, middle):
    got = op5_language_id(spark, middle).where("held_out").join(spark.read.parquet(f"{middle}/documents.parquet"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


DOCS = "doc_id long, text string, lang string, score string, label int, extra int"
TEXTS = [(None, None, "x"), (1, "", None), (2, " 123 ...", "en"), (3, "wort " * 30, "de"), (3, "wort " * 30, "de"), (4, "z" * 100_000, "en"), (5, "the words of a text", "en")]


@pytest.mark.parametrize("labels", [[], [(3, 1, 1), (5, 1, 1)], [(3, 0, 0), (5, 1, 1), (None, 1, 0), (2, None, None)]])
def test_edges_of_the_scores(spark, labels):
    docs = spark.createDataFrame([(*t, "s", 1, 7) for t in TEXTS], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score in (quality_svm.score_quality, toxicity.score_toxicity):
        got = score(docs, known, F.lit(True)).collect()
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["extra"] == 7 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
        assert score(docs.limit(0), known, F.lit(True)).count() == 0


def test_edges_of_languages(spark):
    docs = spark.createDataFrame([(*t, "s", 1, 7) for t in TEXTS], DOCS)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify_language(docs, F.lit(True)).collect()}
    assert {(None, "und"), (1, "und"), (2, "und")} <= got and all(p in ("de", "en", "und", "x") for _, p in got)
    assert {r["lang_pred"] for r in language_id.identify_language(docs, F.lit(False)).collect()} == {"und"}
    assert language_id.identify_language(docs.limit(0), F.lit(True)).count() == 0


def test_gradients():
    """Backpropagation against differences."""
    net = language_id.Network.new(["a", "b", "c"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, there = language_id.pack([b"abc", b"z", b"hello"])
    lang = np.array([0, 1, 2])

    def loss():
        p = net.label(x, there)
        return -sum(np.log(p[t, n, lang[n]]) for n, size in enumerate((3, 1, 5)) for t in range(size)) / 9

    found = net.gradients(x, there, lang)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(4):
            at = (int(rng.choice(np.frombuffer(b"abczhelo", np.uint8))), int(rng.integers(value.shape[1]))) if name == "embed" else tuple(int(rng.integers(s)) for s in value.shape)
            before, step = value[at], 1e-3
            value[at] = before + step
            up = loss()
            value[at] = before - step
            down = loss()
            value[at] = before
            assert abs((up - down) / (2 * step) - found[name][at]) < 2e-4, name


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1, 2]), np.array([v := rng.standard_normal(), w := rng.standard_normal(), 1.0])) for _ in range(200)]
    labels = np.array([1.0 if v[0] > 0.5 * v[1] + 0.1 else -1.0 for _, v in rows])
    weights = quality_svm.dual_coordinate_descent(rows, labels, 3, np.full(200, 50.0), rounds=200)
    assert np.mean([np.sign(weights @ v) == y for (_, v), y in zip(rows, labels)]) > 0.97


def test_platt():
    m = np.concatenate([np.linspace(2, 9, 50), np.linspace(-1, 3, 400)])
    a, b = platt(m, np.array([1] * 50 + [0] * 400))
    assert a > 0 and sigmoid(a * 8 + b) > 0.9 > 0.1 > sigmoid(a * 0 + b)


def test_restoration():
    text = "you stupid idiot moron scum trash loser worthless disgusting clown pathetic are the worst of this and that time " * 3
    c = toxicity.codes(f"  {text} ")
    counts = np.bincount((c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], minlength=toxicity.SYMBOLS**3).astype(float)
    restorer = toxicity.Restorer(counts)
    for token, word in {"1d10t": "idiot", "m0r0n": "moron", "stuuupid": "stupid", "$cum": "scum", "tr@sh": "trash", "i.d.i.o.t": "idiot", "looooser": "loser", "clown***": "clown", "plain,": "plain", "226.203.165.104": "226.203.165.104"}.items():
        assert restorer.word(token) == word
    assert restorer.spaced("you i d i o t now, s-c-u-m") == ["idiot", "scum"] and restorer.spaced("a b and c") == []

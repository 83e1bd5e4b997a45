"""Toxicity with many features, and in shards."""

import time
from itertools import islice, product

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def scores(spark, texts, labels, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, LABELS), F.lit(True), **more).collect()
    return {r["doc_id"]: r["score"] for r in got}


def test_all_features_count(spark):
    """More than 50,000 features in two toxic documents each don't drive out one of more weight with clean documents too."""
    rare = " ".join("".join(x) for x in islice(product("abcdefgh", "aeiou", "bcdfgh", "klmnpr", "stvw", "uoie", "xyz"), 30_000))
    texts = [rare] * 6 + ["nasty"] * 20 + ["nasty"] * 5 + ["fine word"] * 40 + ["nasty", "fine"]
    labels = [(i, int(i < 26)) for i in range(71)]
    rows = spark.createDataFrame([(texts[i], toxic) for i, toxic in labels], "text string, label int")
    restorer = toxicity.Shared(spark, toxicity.Restorer, toxicity.trigram_counts(rows))
    kept = {k % 2**64 for (k,) in toxicity.feature_odds(rows, restorer, 2)[0].select("f").collect()}
    assert len(kept) > 50_000 and toxicity.key("nasty$") in kept
    got = scores(spark, texts, labels)
    assert got[71] > got[72]


def test_shards_give_equal_scores(spark):
    words = ["idiot", "moron", "scum", "trash", "loser", "clown"]
    texts = [f"you {words[i % 6]} and {words[i * 5 % 6]} number{i % 7}" for i in range(60)] + [f"a fine day number{i % 7} for all" for i in range(60)] + ["", None, "i d i o t you", "scum trash loser clown moron idiot"]
    labels = [(i, int(i < 60)) for i in range(120)]
    whole = scores(spark, texts, labels)
    assert len(set(whole.values())) > 4 and scores(spark, texts, labels, shard_features=10) == whole


def restorer():
    text = "you stupid idiot moron scum trash loser worthless disgusting clown pathetic are the worst of this and that time " * 3
    c = toxicity.codes(f"  {text} ")
    counts = np.bincount((c[:-2] * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], minlength=toxicity.SYMBOLS**3)
    return toxicity.Restorer(counts.astype(float))


def test_long_disguises_are_restored():
    own = restorer()
    cases = {"i" * 45 + "diot": "idiot", "stu" + "u" * 100 + "pid!!!": "stupid", ".".join("disgustingworthlessloser"): "disgustingworthlessloser", "l" + "o" * 20_000 + "ser": "loser"}
    cases["d1sgust1ng" + "g" * 50] = "disgusting"
    for token, word in cases.items():
        assert len(token) > 40 and own.word(token) == word, token[:50]


def test_very_long_tokens_take_linear_time():
    own = restorer()
    began = time.process_time()
    for token in ("z" * 200_000, "9f3a0c" * 10_000, "a1" + "1307" * 2_000 + "b"):
        own.word(token)
    assert time.process_time() - began < 30

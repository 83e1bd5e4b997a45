import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ngram_join
from textloom.llm.components import components


def plain(docs, n, num, den):
    sets = []
    for _, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None:
                common = len(sets[i] & sets[j])
                if docs[i][0] == docs[j][0] or (common and den * common >= num * (len(sets[i]) + len(sets[j]) - common)):
                    if sets[i] and sets[j]:
                        root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def some_documents(seed, groups=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 15, 40, 120]))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
                own = own or ["w"]
            docs.append((len(docs) * 3 % 101, " ".join(own) if rng.random() < 0.8 else "\t\n".join(own).upper()))
    return [*docs, (500, None), (501, ""), (502, " \n"), (None, docs[0][1]), (None, None), (503, docs[0][1]), (503, docs[0][1])]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100), (2, 100, 100)])
@pytest.mark.parametrize("limits", [{}, {"block_elements": 60, "block_sets": 3, "broadcast_ids": 0, "bloom_words": 8, "combine": 40, "here": 3}])
def test_against_brute_force(spark, n, num, den, limits):
    docs = some_documents(n * 7 + num)
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, n int, fp int")
    got = ngram_join.near_duplicates(df, n=n, num=num, den=den, **limits)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == plain(docs, n, num, den)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (50, 100), (30, 100)):
        bands = ngram_join.Bands(num, den)
        for _ in range(400):
            size = int(rng.integers(1, 300))
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            cut = rng.random(size) < rng.random() * (1 - num / den)
            other = np.unique(np.concatenate([base[~cut], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size * (den - num) // den)), dtype=np.uint64)]))
            a, b = np.unique(base), other
            common = len(np.intersect1d(a, b))
            if not len(b) or not bands.linked(common, len(a), len(b)):
                continue
            keys = []
            for s in (a, b):
                k = bands.band(len(s))
                keys.append(set(np.concatenate([bands.signatures(s, k), bands.signatures(s, k + 1)]).tolist()))
            assert keys[0] & keys[1], (num, len(a), len(b), common)


def test_shared_passage_makes_no_links(spark):
    """Documents of which half is one passage: candidates in one cluster, none of them linked, split by bitmaps."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(25))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + f" end{i}") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"block_sets": 4}):
        got = ngram_join.near_duplicates(df, **options).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain(docs, 5, 80, 100)


def test_chained_cluster_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Chance matches that chain all sets into one cluster: those that share nothing else don't meet again, and links are found."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(100)]
    docs += [(200 + i, docs[i][1] + f" end{i}") for i in range(10)]
    index, groups, dealt = ngram_join._index, ngram_join._groups, []

    def chained(*args):
        found = index(*args)
        return found.unionByName(found.select(F.lit(42).cast("long").alias("key"), "fp").distinct())

    def counted(*args):
        found = groups(*args)
        dealt.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_index", chained)
    monkeypatch.setattr(ngram_join, "_groups", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, block_sets=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain(docs, 5, 80, 100)
    assert max(dealt) < 3 * len(docs), dealt


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(2)
    bands = ngram_join.Bands(80, 100)
    ruled_out = 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64))
        keep = rng.random(len(a)) < rng.choice([0.5, 0.85, 0.95, 1.0])
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 10)), dtype=np.uint64)]))
        if len(b):
            linked = bands.linked(len(np.intersect1d(a, b)), len(a), len(b))
            maybe = ngram_join.maybe_within(bands, np.array([1, 2]), [ngram_join.bitmap(x, bands) for x in (a, b)], np.array([len(a), len(b)]), np.array([0, 0]))
            assert maybe or not linked
            ruled_out += not maybe
    assert ruled_out > 30


def test_long_text(spark):
    """Whole texts are compared: two long ones that differ in their last part only are no copies."""
    base = [f"w{i}" for i in range(30_000)]
    docs = [(1, " ".join(base)), (2, " ".join([*base[:28_000], *(f"x{i}" for i in range(2_000))])), (3, " ".join([*base[:15_000], *(f"y{i}" for i in range(15_000))]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 29996, 1), (2, 29996, 1), (3, 29996, 3)]


def test_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(alone).collect())) == [(1, 2, 1), (2, 0, 2)]


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (2, "a b c d e f", 2), (9, "other words here only once now", 3), (None, None, 4)], "doc_id long, text string, component_id int")
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns and sorted(r["component_id"] for r in out.collect()) == [2, 3, 4]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(5, 5)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for here in (1_000_000, 20):
        got = [(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "u long, v long"), here).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in root)

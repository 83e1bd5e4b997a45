import random
import re

import numpy as np
import pytest
from compare import rows, sql_rows

from textloom.llm import decontam, line_dedup, queries
from textloom.llm.mph import PerfectHash

DOCS = "doc_id long, text string, probed int, row int"
LONG = "A line that is shared by several documents"


def plain_dedup(docs, min_chars=20, min_docs=3):
    """Each row is a document; null ids are below all others."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -(1 << 63) if i is None else i
    held: dict = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(low(i))
    drop = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in drop or drop[key(x)] == low(i)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_documents():
    rng = random.Random(4)
    shared = [f"shared line number {i} of the collection" for i in range(30)] + ["short one", LONG, "  " + LONG.upper() + "\t", "é" * 20, "é" * 19]
    docs = [(i, "\n".join(rng.choice([*shared, f"own line {i} {k} with more words"]) for k in range(rng.randint(0, 12)))) for i in range(80)]
    return [*docs, (None, LONG), (None, None), (7, None), (5, ""), (79, LONG), (79, LONG), (200, LONG + "\n" + LONG), (3, "x" * 30000 + "\n" + LONG)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 3, "group_probes": 5}, {"shard_keys": 2}])
def test_line_dedup(spark, options):
    docs = some_documents()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    out = line_dedup.dedup_lines(df, **options)
    assert set(out.columns) == set(df.columns)
    got = sorted(((r["doc_id"], r["probed"]["n_lines"], r["probed"]["n_dropped"], r["probed"]["kept"]) for r in out.collect()), key=str)
    assert got == plain_dedup(docs)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS), broadcast_bytes=0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    made = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(made.places(keys)) == list(range(len(keys)))


def plain_hits(text, items, width=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hits, found = cut(text), set(), set()
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            part = w[k : k + width]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hits |= set(range(at, at + len(part)))
                    found.add(i)
    return len(own), sorted(hits), sorted(found)


@pytest.mark.parametrize("block_bytes", [4_000_000, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "été", "x1", "naïve"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "ALPHA beta"), (54, "alpha BETA")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(None, None), (3, ""), (3, items[0][1]), (3, items[0][1]), (9, "z " * 20000 + items[3][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    bench = spark.createDataFrame([*items, (None, "alpha")], "item_id long, text string")
    out = decontam.find_contamination(df, bench, block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["found"]["n_words"], r["found"]["hits"], r["found"]["items"]) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain_hits(t, items)) for i, t in docs), key=str)
    for r in out.collect():
        for s in r["found"]["spans"]:
            assert re.match(r"[0-9a-zA-Z\x80-\U0010ffff].*[0-9a-zA-Z\x80-\U0010ffff]$", r["text"][s["start"] : s["end"]], re.S)
    clean = decontam.without_contaminated(df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns and clean.count() == sum(not plain_hits(t, items)[1] for _, t in docs)
    assert decontam.find_contamination(df.limit(0), bench).count() == 0
    assert decontam.find_contamination(df, bench.limit(0)).where("size(found.hits) > 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, small, duck, name):
    assert rows(queries.queries()[name](spark, small)) == sql_rows(duck, queries.oracle_sql()[name])

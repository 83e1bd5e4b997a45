import public_tokenizers as P
import pytest

import corpus_pipeline
from textloom.llm import bpe
from llm_plain import keeps, plain_components, plain_dedup, plain_hits  # noqa: I001

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage got and gave."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{folder}/{k}")
        new = spark.read.parquet(f"{folder}/{k}")
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in new.collect()], new.columns))
        docs = new
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(stages):
    assert [s[0] for s in stages] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    assert all(sorted(s[3]) == sorted(COLUMNS) for s in stages[:-1])


def test_quality(stages):
    _, before, after, _ = stages[0]
    assert ids(after) == sorted(r["doc_id"] for r in before if keeps(r["text"]))


def test_lines(stages):
    _, before, after, _ = stages[1]
    expected = plain_dedup([(r["doc_id"], r["text"]) for r in before])
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((i, kept) for i, _, _, kept in expected)


def test_near_duplicates(stages):
    _, before, after, _ = stages[2]
    assert ids(after) == sorted(i for i, _, c in plain_components([(r["doc_id"], r["text"]) for r in before], 5, 80, 100) if i == c)


def test_decontamination(spark, small, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    _, before, after, _ = stages[3]
    assert ids(after) == sorted(r["doc_id"] for r in before if not plain_hits(r["text"], items)[1])


def test_tokens(stages):
    _, before, after, _ = stages[4]
    codec = bpe.ByteBPE(bpe.read_file(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert ids(after) == ids(before) and all(r["exact"] and r["ids"] == codec.encode(texts[r["doc_id"]]) for r in after)


def test_run(spark, small, stages):
    assert ids([r.asDict() for r in corpus_pipeline.run(spark, small).select("doc_id").collect()]) == ids(stages[-1][2])
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.oracle_sql() == {}


def test_stages_take_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_repeated_rows_and_extra_columns(spark, small):
    """Repeated rows of one id stay together; extra columns, and clashing ones, come through to the end."""
    words = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, words, "en", "s", 1, "x", 9), (1, words, "en", "s", 1, "y", 9), (2, words + " more", "en", "s", 1, "z", 9), (None, words, None, None, None, "w", 9), (5, "the long of " * 4 + " ".join(f"w{i} the" for i in range(20_000)), "en", "s", 1, "v", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, n_tokens int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "n_tokens"]
    assert sorted(r["row"] for r in docs.collect()) == ["v", "w", "x", "y"]
    out = corpus_pipeline.tokens(spark, docs, small)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "row", "n_tokens", "exact", "ids"]
    # the row without an id is below all others, so its line, which three rows hold, is gone
    assert {r["row"]: (r["exact"], r["n_tokens"]) for r in out.collect()} == {"x": (True, 240), "y": (True, 240), "v": (True, 79479), "w": (True, 0)}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_stages_take_odd_rows(spark, small):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", None, None, None, 1), (2, "words " * 30, "en", "s", 1, 1)], "doc_id long, text string, lang string, source string, n_chars long, row int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, small).count()
        assert got == (0 if name == "quality_rules" else 3), name


def test_queries_without_the_pipeline(monkeypatch):
    """The operators' queries don't go with corpus_pipeline.py."""
    import __spark_entry__ as entry

    real = entry.import_module

    def missing(name):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name)

    monkeypatch.setattr(entry, "import_module", missing)
    assert "pipeline" not in entry.queries() and sum(q.startswith("op") for q in entry.queries()) == 10


def test_no_own_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from textloom.llm import stored

    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.folder(session)

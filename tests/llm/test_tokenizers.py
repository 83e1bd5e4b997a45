import base64
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import bpe, token_count
from textloom.llm.merges import MergeOrder
from textloom.llm.queries import op2_byte_bpe, op4_token_count

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from("ab the  \n\t'sé▁漢🙂0123\x1c\x85​.,!?\x00ﬁ"), st.characters(exclude_categories=["Cs"])), max_size=120)


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE(bpe.read_file(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_count.CountTransducer(token_count.read_file(MODEL))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


LONG = ["", " ", "\n\n \n", "a" * 5000, " " * 3000, "x▁" * 50, "the" * 2000, "aaaaab" * 300, "!" * 999, "word " * 4000]


def test_bpe_long_texts(codec, library):
    for t in LONG:
        assert codec.encode(t) == library.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    import numpy as np

    assert codec.decode_flat(np.array(ids, np.int32))[0].tobytes() == text.encode()


def test_bpe_with_other_patterns(library):
    assert bpe.WORD_PATTERN == P.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    for pattern in (r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", r"(\p{L})+|\s+", r"[^ ]+ ?| +"):
        own, other = bpe.ByteBPE(bpe.read_file(RANKS), pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for t in ("the cat sat on the mat", "a  b, c. 12!", *LONG):
            assert own.encode(t) == other.encode_ordinary(t), (pattern, t[:30])


def test_counter_refuses_other_models(monkeypatch):
    """A model whose library counts by other rules than those compiled."""
    monkeypatch.setattr(token_count.CountTransducer, "word", lambda self, run: 1 + len(run))
    with pytest.raises(ValueError, match="not supported"):
        token_count.CountTransducer(token_count.read_file(MODEL))


def test_state_maps_compose(counter):
    texts = ["▁the▁quick", "brownfoxes", "jumping", "▁over", "漢字the", "▁" * 30]
    chunks = [counter.chunk(t) for t in texts]
    a, b, c, *_ = maps = counter.state_maps(chunks, counter.FRESH)
    assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))
    assert all(set(m) == {s for s, _ in before.values()} for before, m in zip(maps, maps[1:]))
    whole = maps[0]
    for m in maps[1:]:
        whole = counter.compose(whole, m)
    assert whole[counter.FRESH][0] == counter.run(counter.FRESH, "".join(texts))[1] and whole[counter.FRESH][1] == counter.run(counter.FRESH, "".join(texts))[0]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_counts(counter, pieces, text, chunk):
    assert counter.count(text, chunk) == counter.count(text) == len(pieces.encode(text))


def test_counts_long_texts(counter, pieces):
    for t in LONG:
        assert counter.count(t) == len(pieces.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=2, max_size=4), st.integers(0, 50), min_size=1, max_size=12), st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=8))
def test_apart_is_what_merging_gives(ranks, a, b):
    """For tokens that merges make, of any rank table without equal ranks in which longer tokens come later."""
    order = MergeOrder({t: i for i, t in enumerate(sorted(ranks, key=lambda t: (len(t), ranks[t], t)))})
    for left in order.merge(list(a))[-1:]:
        for right in order.merge(list(b))[:1]:
            assert order.apart(left, right) == (order.merge(list(left + right)) == [left, right])


def test_queries_match_the_libraries(spark, small, library, pieces):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: r for r in op2_byte_bpe(spark, small).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))
    counts = {r["doc_id"]: r for r in op4_token_count(spark, small).collect()}
    for i, t in texts.items():
        n = len(pieces.encode(t))
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens int, extra int"
    df = spark.createDataFrame([(None, None, "x", 1, 7), (1, "", "x", 1, 7), (1, "hi", None, 1, 7), (1, "hi", None, 1, 7)], schema)
    out = bpe.bpe_decode(bpe.bpe_encode(df, RANKS, P.PATTERN), RANKS)
    assert sorted((bytes(r["decoded"]), r["extra"], len(r["ids"])) for r in out.collect()) == [(b"", 7, 0), (b"", 7, 0), (b"hi", 7, 1), (b"hi", 7, 1)]
    assert sorted(r["n_tokens"] for r in token_count.count_tokens(df, MODEL).collect()) == [0, 0, 1, 1]
    for made in (out, token_count.count_tokens(df, MODEL)):
        assert made.where(F.lit(False)).count() == 0
    empty = df.limit(0)
    assert bpe.bpe_encode(empty, RANKS, P.PATTERN).count() == 0 and token_count.count_tokens(empty, MODEL).count() == 0

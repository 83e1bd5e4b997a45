"""Queries without SQL over all documents, against plain versions; the fixtures hold what the queries with SQL leave out."""

import hashlib
import re

import pytest
from compare import rows

from textloom.plans import catalog, texts


@pytest.fixture
def folder(spark, tmp_path):
    def write(values):
        spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def by_id(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def plain_corrections(text):
    """Character by character: at each place protected words before variants, the longest first."""
    entries = [x.split("|") for x in texts.GLOSSARY if x and not x.startswith("#")]
    kept = {e[0] for e in entries} | {w for w in texts.PROTECT if not w.startswith("#")}
    variants = {v: e[0] for e in reversed(entries) for v in e[2].split(",") if len(v) >= 4 and v not in kept}
    keys = [(k, k) for k in sorted(kept, key=len, reverse=True)] + sorted(variants.items(), key=lambda x: -len(x[0]))
    inside = lambda c: c.isascii() and c.isalnum()
    out, i = [], 0
    while i < len(text):
        for key, new in keys:
            end = i + len(key)
            if text.startswith(key, i) and not (inside(text[i - 1 : i]) and inside(key[0])) and not (inside(text[end : end + 1]) and inside(key[-1])):
                out.append(new)
                i = end
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def expected_corrections(documents):
    own = {i: plain_corrections(t) for i, t in documents.items()}
    return sorted((own[i] != t, i, hashlib.sha256(own[i].encode()).hexdigest()) for i, t in documents.items())


CORRECTED = {
    "Été: thention, ation_x éther ther": "Été: Thentian, Ationer_x éEdgetion Edgetion",
    "a thing in ationing": "a thing in Ationer",
    "restions restion thing thingin": "restions Restonor thing thingin",
    "ätion edition’s 漢thonting字 — xthention thention2": "ätion Edgetion’s 漢Thentian字 — xthention thention2",
    "\U0001f600ther_ther": "\U0001f600Edgetion_Edgetion",
}


def test_corrections_of_all_documents(spark, folder):
    assert {t: plain_corrections(t) for t in CORRECTED} == CORRECTED
    sf_dir = folder([*CORRECTED, "plain ation", "", None])
    got = catalog.queries()["glossary_apply"](spark, sf_dir)
    assert sorted((r["changed"], r["doc_id"], r["text_sha256"]) for r in got.collect()) == expected_corrections(by_id(spark, sf_dir))


def test_corrections_of_the_small_table(spark, small):
    documents = by_id(spark, small)
    got = catalog.queries()["glossary_apply"](spark, small)
    assert sorted((r["changed"], r["doc_id"], r["text_sha256"]) for r in got.collect()) == expected_corrections(documents)
    assert len(documents) == got.count()
    assert set(rows(catalog.queries()["glossary_apply"](spark, small))) <= set(rows(got))


def protected_places(text):
    """Places of marks that end nothing, and places where no sentence begins: of names of hosts, numbers with dots, titles, abbreviations and initials."""
    protected = (
        r"\b(?:[A-Za-z0-9-]+\.)+(?:com|org|net|io|co|ai|dev|app|edu|gov|so|me|fm)\b(?:/[A-Za-z0-9_\-./~%?&=#]*[A-Za-z0-9_\-/~%=#])?",
        r"\b\d+(?:\.\d+)+\b",
        r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|Inc|Ltd|Fig|No|Vol)\.",
        r"(?i:\b(?:e\.g|i\.e|a\.m|p\.m|U\.S|U\.K|Ph\.D)\.)",
        r"\b(?:[A-Za-z]\.){2,}",
    )
    out, starts = set(), set()
    for pattern in protected:
        for m in re.finditer(pattern, text):
            if not out & set(range(*m.span())):
                out |= {i for i in range(*m.span()) if text[i] in ".!?"}
                starts.add(m.start())
    return out, starts


def plain_sentences(text):
    """Character by character: a mark, closing quotes, white space, then a capital or digit, maybe after an opening quote."""
    text = text.strip()
    (hidden, starts), out, begin, i = protected_places(text), [], 0, 0
    while i < len(text):
        end = i + 1
        if text[i] in ".!?" and i not in hidden:
            while text[end : end + 1] and text[end] in "\"')]":
                end += 1
            after = end
            while text[after : after + 1].isspace():
                after += 1
            first = text[after + 1 : after + 2] if text[after : after + 1] and text[after] in "\"'([" else text[after : after + 1]
            quoted = text[after : after + 1] and text[after] in "\"'(["
            if after > end and first and after + bool(quoted) not in starts and (first in "0123456789" or "A" <= first <= "Z"):
                out.append(text[begin:end])
                begin = end = after
        i = end
    return [s.strip() for s in [*out, text[begin:]] if s.strip()]


SENTENCES = {
    'He said "this is it." Then he left.': 2,
    "Visit vanta.com/lenny. That is 2.0 and Dr. No came.": 2,
    "Mr. A. B. Smith vs. Jones Ltd. Corp. Next one.": 4,
    "At 5 p.m. They met in the U.S. Army. 3 of 1.5.3 left!": 2,
    "One. (Two?) [Three!] 'Four.' 5 six. seven": 5,
    "Él vino. Él no. Ya está! A la casa. ¿No? ok": 3,
    "No. 5 is etc. And e.g. This one.": 1,
    "Done. Dr. No came. (No. 5 too.) It ended. U.S. law!": 2,
    "  \n\t ": 0,
    "First.\u00a0Second.\n\nThird?Fourth": 3,
}


def test_sentences_of_all_documents(spark, folder):
    assert {t: len(plain_sentences(t)) for t in SENTENCES} == SENTENCES
    sf_dir = folder([*SENTENCES, None])
    got = {r["doc_id"]: r["n_sentences"] for r in catalog.queries()["sentence_counts"](spark, sf_dir).collect()}
    assert got == {i: len(plain_sentences(t)) for i, t in by_id(spark, sf_dir).items()}


def test_sentences_of_the_small_table(spark, small):
    got = catalog.queries()["sentence_counts"](spark, small)
    assert {r["doc_id"]: r["n_sentences"] for r in got.collect()} == {i: len(plain_sentences(t)) for i, t in by_id(spark, small).items()}
    assert set(rows(catalog.queries()["sentence_counts"](spark, small))) <= set(rows(got))


def test_scales_of_numbers(spark, folder):
    sf_dir = folder(["1.5 k and 20K, 3M", "2B or 2 B", "1700万 12:30 Speaker 7", "7 kM", None])
    got = {r["doc_id"]: (r["n_values"], r["largest"]) for r in catalog.queries()["numeric_facts"](spark, sf_dir).collect()}
    assert got == {0: (3, 3e6), 1: (1, 2e9), 2: (1, 1.7e7), 3: (1, 7e3), 4: (0, 0.0)}


def test_text_blocks_of_pages(spark, tmp_path):
    html = "<h1>On <b>x</b></h1><p>One <a href=\"u\">two</a> &amp; three</p><ul><li> four</li><li></li></ul><img src='i'><h2>five</h2><p>six\nseven</p>"
    spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in catalog.queries()["html_blocks"](spark, str(tmp_path)).collect()}
    assert [got[1][c] for c in ("n_blocks", "n_h1", "n_h2", "n_p", "n_li", "n_figcaption")] == [5, 1, 1, 2, 1, 0] and got[2]["n_blocks"] == 0
    blocks = [("h1", "On x"), ("p", "One [two](u) & three"), ("li", "four"), ("h2", "five"), ("p", "six\nseven")]
    assert got[1]["text_sha256"] == hashlib.sha256("\n".join("\t".join(b) for b in blocks).encode()).hexdigest()

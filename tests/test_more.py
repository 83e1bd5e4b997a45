"""Functions and operators that no query calls by itself, on small fixtures."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T
from textloom.operators import catalog, coverage, fragments, glossary, images, layout, turns
from textloom.sources import readers, writers


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, text, column, kind="string"):
    return values(spark, [(text,)], f"t {kind}", column)[0][0]


def test_all_entities(spark):
    rng = random.Random(3)
    names = list(html5)
    cases = ["&#8217;&eacute;&#x2014;&amp;lt;&ampfoo &notit; &#0;&#128;&#xD800;&#x110000;&#99999999999;&#xFFFE;&unknown;&#;&#x; & a&b; &nbsp;&copy &AMP;&#13;&#x1F600;", "", "none"]
    cases += ["".join(rng.choice(["&", "#", ";", "amp", "12", "&" + rng.choice(names), " ", "é", f"&#{rng.randint(0, 70000)};", f"&#x{rng.randint(0, 0x11FFFF):x}"]) for _ in range(12)) for _ in range(200)]
    assert [x for (x,) in values(spark, [(c,) for c in cases], "t string", T.unescape(F.col("t")))] == [html.unescape(c) for c in cases]
    assert one(spark, "It&#8217;s caf&eacute; &lt;b&gt;x", T.norm_words(F.col("t"), drop_tags=True)) == ["it", "s", "caf", "x"]
    assert one(spark, "<p>Caf&eacute; &#x2014; &lt;ok&gt;</p>", T.collapse(H.strip_tags(F.col("t")))) == "Café — <ok>"
    assert one(spark, '<p>See <a href="u?a=1&amp;b=2">caf&eacute;</a></p>', H.link_text(F.col("t"))) == "See [café](u?a=1&b=2)"


def test_metas(spark):
    assert one(spark, '<meta content="Caf&eacute;" property="og:title">', H.find_meta(F.col("t"), "og:title")) == "Café"
    assert one(spark, '<meta name="x" content="a > b"><meta name="y" content="c">', H.meta_tags(F.col("t"))) == '<meta name="x" content="a > b">\n<meta name="y" content="c">'


def test_titles_cut(spark):
    assert one(spark, "x" * 50, T.truncate_left(F.col("t"))) == "..." + "x" * 37 and one(spark, "short", T.truncate_left(F.col("t"))) == "short"
    assert one(spark, "A | B | Site", T.cut_site_suffix(F.col("t"))) == "A | B" and one(spark, "y" * 600, T.describe(F.col("t"))) == "y" * 500
    rows = [("essay", 25), ("essay", 121), ("podcast", 90), ("zh", 1100), ("zh", 10), ("other", 5)]
    assert values(spark, rows, "l string, k int", T.layout_band(F.col("l"), F.col("k"))) == [(True,), (False,), (True,), (True,), (False,), (None,)]


def test_content_segment(spark):
    cut = lambda text, marker="MARK": one(spark, text, H.content_segment(F.col("t"), marker))
    assert cut("ab MARK cd") == "MARK cd" and cut("x<article>y") == "<article>y" and cut("x<main>y") == "<main>y" and cut("xyz") == "xyz"


def test_image_files(spark):
    rows = [("https://x.org/a.JPEG?w=1", None), ("https://x.org/a", "image/webp; q=1"), ("https://x.org/a.gif", "text/html"), ("https://x.org/a", "")]
    assert [x for (x,) in values(spark, rows, "u string, c string", H.image_extension(F.col("u"), F.col("c")))] == ["jpg", "webp", "gif", "png"]
    assert values(spark, [(3, "Growth of the whole market today")], "n int, a string", H.image_name(F.col("n"), F.col("a"), F.lit("png"))) == [("03_growth-of-the-whole.png",)]
    tries = [(0, 5, "image/png", "u"), (0, 0, "image/png", "u"), (1, 5, "image/png", "u"), (0, 5, "text/html", "u.SVG"), (0, 5, "text/html", "u")]
    assert [x for (x,) in values(spark, tries, "r int, s int, c string, u string", H.accept_download(F.col("r"), F.col("s"), F.col("c"), F.col("u")))] == [True, False, False, True, False]


def test_image_tables(spark):
    own = spark.createDataFrame([(1, True), (1, False), (1, True), (2, True)], "doc_id int, accepted boolean")
    assert sorted(map(tuple, images.image_coverage(own).collect())) == [(1, 3, 2, 0.667), (2, 1, 1, 1.0)]
    wanted = spark.createDataFrame([("a", 1), ("b", 1)], "stem string, n int")
    assert {r["stem"]: r["reused"] for r in images.reuse(wanted, wanted.where("stem = 'a'"), ["stem", "n"]).collect()} == {"a": True, "b": False}
    assert not any(r["reused"] for r in images.reuse(wanted, wanted, ["stem", "n"], refresh=True).collect())
    log = spark.createDataFrame([("u", 1, False), ("u", 2, True), ("u", 3, True), ("v", 1, False)], "url string, attempt int, ok boolean")
    assert [tuple(r) for r in images.first_accepted(log, F.col("ok")).collect()] == [("u", 2, True)]


def test_ends_of_chapters(spark):
    chapters = spark.createDataFrame([("d", "0:00:00", 0), ("d", "0:10:00", 600), ("e", "0:00:00", 0)], "doc_id string, start_ts string, start_sec int")
    said = spark.createDataFrame([("d", 1, "0:01:00"), ("d", 2, "1:12:05")], "doc_id string, turn_no int, ts string")
    assert sorted((r["doc_id"], r["start_sec"], r["end_label"]) for r in turns.chapter_ends(chapters, said).collect()) == [("d", 0, "10:00"), ("d", 600, "12:05"), ("e", 0, "00:00")]


def test_ratios_and_deployment(spark):
    rows = [(85, 100, 100, 100), (84, 100, 100, 100), (0, 0, 0, 0)]
    assert [x for (x,) in values(spark, rows, "a int, b int, c int, d int", coverage.turn_ratio(*map(F.col, "abcd")))] == [True, False, True]
    built = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, text string")
    live = spark.createDataFrame([("a", "x"), ("b", "other")], "path string, text string")
    assert {r["path"]: r["same"] for r in coverage.same_content(live, built).collect()} == {"a": True, "b": False, "c": False}
    assert one(spark, '<li class="entry">a</li><li class="entry has-poster">b</li><li class="other">', catalog.linked_entries(F.col("t"))) == 2


def test_gate_run(spark):
    """Known errors of the source are no losses; a window that is lost is found."""
    fix = glossary.Corrections({"wrong name": "Right"}, {"Right"})
    words = [f"w{i}" for i in range(1500)]
    source = " ".join([*words[:10], "wrong name", *words[10:]])
    df = spark.createDataFrame([(1, source, source.replace("wrong name", "Right")), (2, source, " ".join([*words[:500], *words[1000:]]))], "doc_id int, source string, output string")
    windows = spark.createDataFrame([(i, k, " ".join(words[k * 500 : k * 500 + 500])) for i in (1, 2) for k in range(3)], "doc_id int, window int, text string")
    got = {r["doc_id"]: r for r in coverage.finalize(df, fix, windows).collect()}
    assert got[1]["ok"] and got[1]["coverage"] == 1.0 and not got[2]["ok"] and got[2]["worst_window"]["index"] == 1
    assert {r["doc_id"]: r["ok"] for r in coverage.finalize(df, fix).collect()} == {1: True, 2: False}


def test_many_keys_are_an_automaton(spark):
    """The automaton gives what the pattern gives, borders and protected words included."""
    rng = random.Random(2)
    parts = ["abcd", "abc", "bcde", "x1y2", "é", " ", "-", "漢字漢", "漢字", "cde", "_"]
    mapping = {"abcd": "A", "bcde": "B", "abcd-x1y2": "C", "漢字漢": "D", "x1y2": "E", "cde x1y2": "F", "\\E.*": "G"}
    fix = glossary.Corrections(mapping, {"abc", "abcd x1y2", "漢字漢字"})
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)] + ["\\E.* abcd", "", None]
    got = values(spark, [(t,) for t in texts], "t string", fix.apply_pattern(F.col("t")), fix.apply(F.col("t")))
    assert [a for a, _ in got] == [b for _, b in got] and any(a != t for (a, _), t in zip(got, texts))


def test_terms_in_blocks(spark):
    docs = spark.createDataFrame([(1, "An Alpha beta"), (2, "alphabet"), (3, None), (4, "x gam y")], "doc_id int, text string")
    entries = glossary.parse_entries(spark.createDataFrame(list(enumerate(["Alpha|5|", "Beta|5|gam,beta", "ab|5|alpha", "Gone|5|"])), "ord int, value string"))
    for block in (1, 100):
        assert sorted(map(tuple, glossary.scan_terms(docs, entries, block_keys=block).collect())) == [(1, "Alpha"), (1, "Beta"), (2, "Alpha"), (4, "Beta")]


LINES = ["# terms", "Alpha|5|alfa,alpa", "", "  # more", "Beta", "Gamma||gama"]


def test_dictionary_file_is_kept(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "ord int, value string")
    entries = glossary.parse_entries(lines)
    protected = glossary.protected_words(entries, spark.createDataFrame([("other",)], "word string"))
    batch = spark.createDataFrame([(0, "beta", ["betta"]), (1, "Delta", ["delda"]), (2, "ALPHA", ["alfa"])], "pos int, term string, seen_as array<string>")
    merged, _ = glossary.upsert(entries, protected, batch)
    got = [r["value"] for r in glossary.rewritten(lines, merged).orderBy("ord").collect()]
    assert got == ["# terms", "Alpha|5|alfa,alpa", "", "  # more", "Beta|5|betta", "Gamma||gama", "Delta|5|delda"]
    assert glossary.append_glossary(entries, protected, batch) == 1


def test_lint_and_wrappers(spark):
    entries = glossary.parse_entries(spark.createDataFrame(list(enumerate(["Alpha|5|alfalfa,ab", "Beta|5|alfalfa", "Big alfalfa field"])), "ord int, value string"))
    protected = glossary.protected_words(entries, spark.createDataFrame([], "word string"))
    assert glossary.lint(entries, protected).first().asDict() == {"n_entries": 3, "n_mappings": 1, "n_protected": 3, "n_rejected": 1, "n_conflicts": 1, "n_collisions": 1, "status": 1}
    assert glossary.glossary_mappings(entries) == {"alfalfa": "Alpha"}
    assert one(spark, "an alfalfa", glossary.apply_correct_table(F.col("t"), {"alfalfa": "Alpha"})) == "an Alpha"


def test_hot_words(spark):
    table = catalog.parse_hotwords(spark.createDataFrame([(0, "alpha|8"), (1, "beta")], "ord int, value string"))
    new = catalog.parse_hotwords(spark.createDataFrame([(0, "beta|3"), (1, "gamma")], "ord int, value string"))
    assert sorted((r["word"], r["weight"]) for r in catalog.hotword_add(table, new, most=3).collect()) == [("alpha", 8), ("beta", None), ("gamma", 4)]
    with pytest.raises(ValueError, match="at most 2"):
        catalog.hotword_add(table, new, most=2)
    assert [r["word"] for r in catalog.hotword_delete(table, new, must=True).collect()] == ["alpha"]
    with pytest.raises(ValueError, match="none"):
        catalog.hotword_delete(table, new.where("word = 'gamma'"), must=True)
    assert catalog.hotword_upload(None, new).count() == 2 and catalog.hotword_upload(table, new, overwrite=True).count() == 2
    with pytest.raises(ValueError, match="there already"):
        catalog.hotword_upload(table, new)
    with pytest.raises(ValueError, match="symbol"):
        catalog.hotword_upload(None, spark.createDataFrame([(0, "a-b", 1)], "ord int, word string, weight int"))
    assert catalog.whole_preview(table, 2).count() == 2
    with pytest.raises(ValueError, match="2 of 3"):
        catalog.whole_preview(table, 3)
    assert catalog.over_capacity(table, 1).first()["over"] and not catalog.over_capacity(table).first()["over"]
    known = spark.createDataFrame([(0, "t1", "name"), (1, "name", "t2")], "ord int, table_id string, table_name string")
    assert catalog.resolve_table(known, "name").first()["table_id"] == "t1"


def test_catalog_orders(spark):
    rows = [(0, "2024-02-01", "2024-03-01", ["a"], None, None), (1, "2024-05-01", None, ["a", "b"], "p.png", "c1"), (2, "2023-01-01", "2024-06-01", [], "q.png", "c2")]
    own = spark.createDataFrame(rows, "scan_no int, iso string, added string, tags array<string>, poster string, card string")
    order = lambda df: [(r["scan_no"], r["new_year"]) for r in df.orderBy("rank").collect()]
    assert order(catalog.client_order(own)) == [(1, True), (0, False), (2, True)] and order(catalog.client_order(own, "added")) == [(2, False), (0, False), (1, False)]
    assert order(catalog.client_order(own, tag="a")) == [(1, True), (0, False)]
    assert catalog.with_poster(own).count() == 2 and catalog.latest_card(own, "default").first()["card"] == "c1" and catalog.latest_card(own.limit(0), "default").first()["card"] == "default"
    assert [r["scan_no"] for r in catalog.catalog_order(own).collect()] == [1, 0, 2]


def test_archive(spark):
    page = """<script>window._preloads = JSON.parse("{\\"posts\\":[{\\"slug\\":\\"one\\",\\"title\\":\\"One\\"}]}")</script><a href="/p/one">x</a><a href="/p/two-b">y</a>"""
    posts = catalog.archive_posts(spark.createDataFrame([(page,)], "html string")).unionByName(spark.createDataFrame([("three", "Three words here", 3)], "slug string, title string, priority int"))
    merged = catalog.merge_posts(posts)
    assert sorted((r["slug"], r["title"]) for r in merged.collect()) == [("one", "One"), ("three", "Three words here"), ("two-b", None)]
    assert [r["slug"] for r in catalog.rank_matches(merged, "two of THREE words").collect()] == ["three", "two-b"]
    tracks = spark.createDataFrame([(1, "en-US"), (1, "en"), (2, "fr")], "doc_id int, lang string")
    assert [tuple(r) for r in catalog.choose_track(tracks, readers.EN_TRACKS).collect()] == [(1, "en")]
    files = spark.createDataFrame([(1, "ogg"), (1, "MP3"), (2, "txt")], "doc_id int, extension string")
    assert [tuple(r) for r in readers.first_audio(files).collect()] == [(1, "MP3")]


def test_pages_of_episodes(spark):
    data = '<script id="__NEXT_DATA__" type="x">{"a":{"shownotes":"short"},"b":[{"shownotes":"much longer\\nnotes"}]}</script>'
    ld = '<script type="application/ld+json">{"name":"Named","datePublished":"2024-01-02T00:00","associatedMedia":{"contentUrl":"https://x.org/ld.m4a"},"partOfSeries":{"name":"Series"}}</script>'
    metas = '<meta property="og:title" content="Shared"><meta property="og:audio" content="https://x.org/og.mp3"><meta property="og:description" content="About">'
    rows = [(1, metas + ld + data), (2, metas), (3, 'see https://x.org/a.mp3"'), (4, '"contentUrl": "https://x.org/b"')]
    got = {r["id"]: tuple(r["e"]) for r in spark.createDataFrame(rows, "id int, html string").select("id", readers.episode(F.col("html")).alias("e")).collect()}
    assert got[1] == ("Named", "Series", "2024-01-02", "https://x.org/ld.m4a", "much longer\nnotes") and got[2] == ("Shared", None, None, "https://x.org/og.mp3", "About")
    assert got[3][3] == "https://x.org/a.mp3" and got[4][3] == "https://x.org/b"


def test_small_readers(spark, tmp_path):
    assert one(spark, 'x Transcript: <a href="/p/the-one">, <a href="/p/first">', readers.post_url(F.col("t"))).asDict() == {"slug": "the-one", "source": "labelled"}
    assert one(spark, '<a href="/p/first">', readers.post_url(F.col("t")))["source"] == "first" and one(spark, "x", readers.post_url(F.col("t"))) is None
    assert one(spark, '{"id":"a","duration":5}', readers.video_metadata(F.col("t"))).asDict() | {} == {f: {"id": "a", "duration": "5"}.get(f) for f in readers.VIDEO_FIELDS}
    assert values(spark, [(499, "page"), (500, "page"), (99_999, "audio")], "s int, k string", readers.reject_reason(F.col("s"), F.col("k"))) == [("page too small",), (None,), ("audio too small",)]
    segments, names = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", None)], "doc_id string, speaker string"), spark.createDataFrame([("d", {"1": "Ann"})], "doc_id string, names map<string,string>")
    assert sorted(r["name"] for r in readers.named_segments(segments, names).collect()) == ["2", "Ann", "SPEAKER_?"]
    for name in ("a_b.html", "index.html", "x-poster.html"):
        (tmp_path / name).write_text("<p>")
    assert [r["path"].split("/")[-1] for r in readers.read_catalog(spark, str(tmp_path)).collect()] == ["a_b.html"]


def test_overwrites_keep_other_partitions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "stem string, v string")
    for write in (lambda df, at: writers.write_json(df, at, "stem"), lambda df, at: writers.write_texts(df, at, "stem", "v")):
        at = str(tmp_path / str(random.random()))
        write(rows(("a", "1"), ("b", "2")), at)
        write(rows(("a", "3")), at)
        left = spark.read.json(at) if "json" in write.__code__.co_names[1] else spark.read.text(at).withColumnRenamed("value", "v")
        assert sorted((r["stem"], r["v"]) for r in left.collect()) == [("a", "3"), ("b", "2")]
    known = rows(("a", "1"))
    assert sorted((r["stem"], r["v"]) for r in writers.append_new(rows(("a", "9"), ("c", "2")), known, ["stem"]).collect()) == [("a", "1"), ("c", "2")]


def test_documents_and_reports(spark, tmp_path):
    at = str(tmp_path / "out")
    paras = spark.createDataFrame([("d", 1, 2, "two"), ("d", 1, 1, "one"), ("d", 2, 1, "three"), ("e", 1, 1, "x")], "doc_id string, page int, para_no int, text string")
    pages, meta, tables = (spark.createDataFrame(rows, schema) for rows, schema in (([("d", 1), ("e", 1)], "doc_id string, page int"), ([("d", "T")], "doc_id string, title string"), ([("d", 1)], "doc_id string, index int")))
    writers.write_document(paras, pages, meta, tables, at)
    writers.write_document(paras.where("doc_id = 'e'"), pages.where("doc_id = 'e'"), meta.limit(0), tables.limit(0), at)
    body = spark.read.text(f"{at}/body", wholetext=True)
    assert sorted((r["doc_id"], r["value"].strip()) for r in body.collect()) == [("d", "one\n\ntwo\n\nthree"), ("e", "x")]
    assert spark.read.json(f"{at}/pages").count() == 2 and spark.read.json(f"{at}/metadata").first()["title"] == "T"
    rows, report = writers.observed(paras, "run", F.count_if(F.col("page") > 1).alias("later"))
    rows.collect()
    assert report.get == {"n_rows": 4, "later": 1}


def test_index_and_gallery(spark, tmp_path):
    page = spark.createDataFrame([("<html>",)], "html string")
    assert writers.write_index(page, page, str(tmp_path)) and spark.read.text(str(tmp_path / "posters")).count() == 1
    assert not writers.write_index(page, page.limit(0), str(tmp_path)) and not (tmp_path / "posters").exists() and (tmp_path / "index").exists()


def test_tables_and_report(spark):
    tables = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 9.0, 9.0), ("d", 2, 1, 0.0, 0.0, 9.0, 9.0), ("d", 2, 2, None, 0.0, 9.0, 9.0)], "doc_id string, page int, index int, x0 double, y0 double, x1 double, y1 double")
    sound, skipped = layout.sound_tables(tables)
    assert [(r["page"], r["index"]) for r in sound.collect()] == [(1, 1)] and [tuple(r) for r in skipped.collect()] == [("d", 2, 1)]
    line = lambda n: [("d", 1, k, f"t{k}") for k in range(n)]
    lines, kept = (spark.createDataFrame(x, "doc_id string, page int, line_no int, text string") for x in (line(10), [*line(6), ("d", 1, 9, "[[table:p1-1]]")]))
    pages = spark.createDataFrame([("d", p) for p in range(1, 6)], "doc_id string, page int")
    assert [tuple(r) for r in layout.run_report(lines, kept, pages, pages.where("page < 5")).collect()] == [("d", 10, 4, 1, 5, 1)]
    raw = spark.createDataFrame([("d", p, "Disclaimer" if p == 5 else "x") for p in range(1, 6)], "doc_id string, page int, raw_text string")
    assert layout.cut_notices(raw, layout.find_notice(raw, "(?m)^Disclaimer$")).count() == 4


def test_fragments(spark):
    df = spark.createDataFrame([(1,)], "x int").select(
        F.array(F.struct(F.lit("a<b").alias("quote"), F.lit("w&y").alias("why"))).alias("con"),
        F.array(F.struct(F.lit("**Bold** c").alias("claim"), F.lit("e").alias("explain"))).alias("tl"),
        F.struct(F.lit(3).alias("num"), F.lit("En").alias("en_title"), F.lit("中").alias("zh_title"), F.lit("00:01:02").alias("start_ts"), F.array(F.lit("k1"), F.lit("k2")).alias("keywords")).alias("c"),
        F.struct(F.lit("T").alias("en_title"), F.lit("S").alias("zh_summary"), F.lit("Q").alias("lede_quote"), F.lit("B").alias("lede_bg")).alias("h"),
    )
    pick = lambda column: df.select(column).first()[0]
    assert pick(fragments.contrarian(F.col("con"))).count("a&lt;b") == 1 and pick(fragments.contrarian(F.slice("con", 1, 0))) == ""
    assert pick(fragments.tldr(F.col("tl"))) == '<li><p class="tldr-claim">Bold c</p><p class="tldr-explain">e</p></li>'
    assert pick(fragments.toc(F.array("c"))) == '<li><a href="#ch3">03 · 中</a></li>'
    whole = pick(fragments.chapter(F.col("c"), F.lit("00:05:00"), F.lit("<body/>"), F.lit("<raw/>"), F.lit(2)))
    assert whole.startswith('<section class="chapter" id="ch3"><div class="ch-num">Chapter 03</div><h2>En</h2>') and "01:02 — 05:00 · k1 · k2" in whole and "（2 段）</summary><raw/>" in whole
    assert "details" not in pick(fragments.chapter(F.col("c"), F.lit("00:05:00"), F.lit(""), F.lit(""), F.lit(0)))
    assert pick(fragments.hero(F.col("h"), F.lit("P&Q"), F.lit(None).cast("string"), F.lit("note"))).startswith('<div class="hero-eyebrow">P&amp;Q ·  · 中文整理</div><h1>T</h1>')
    card = pick(fragments.poster_card(F.lit("2024-01-02"), F.lit("<em>t</em>"), F.lit(""), F.lit("h"), F.lit("s"), F.lit('p"q')))
    assert "2024—01—02" in card and "<h3><em>t</em></h3>" in card and "p&quot;q" in card and "poster-card-zh" not in card
    assert pick(fragments.og_meta(F.lit("T"), F.lit("D"), F.lit("I"), F.lit("U"), F.lit("Site"))).count('content="T"') == 2

import random

from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.operators import catalog, coverage, glossary, images, layout, turns
from textloom.sources import readers, writers


def entries(spark, lines, protect=()):
    own = glossary.parse_entries(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    return own, glossary.protected_words(own, spark.createDataFrame([(w,) for w in protect], "word string"))


def applied(spark, lines, protect, text):
    fix = glossary.Corrections.collect(*entries(spark, lines, protect))
    return spark.createDataFrame([(text,)], "t string").select(fix.apply(F.col("t")).alias("x")).first()["x"]


def test_corrections(spark):
    assert applied(spark, ["Term|5|ab,汉字"], [], "ab 汉字") == "ab 汉字"  # keys too short
    assert applied(spark, ["正确词|5|错误词"], [], "一个错误词。") == "一个正确词。"
    assert applied(spark, ["Codex|5|codeex"], ["codeexes"], "codeex codeexes mycodeex") == "Codex codeexes mycodeex"
    assert applied(spark, ["Open AI||opening eye", "Opening||opening"], [], "opening eye opening") == "Open AI Opening"
    assert applied(spark, ["First||same one", "Second||same one"], [], "same one") == "First"
    assert applied(spark, ["a+b(c)||a*b[c"], [], "x a*b[c y") == "x a+b(c) y"


def test_lint(spark):
    own, protected = entries(spark, ["Alpha||alfa", "Beta||alfa,betta"], ["alfabet"])
    assert [r.asDict() for r in glossary.conflicts(own).collect()] == [{"variant": "alfa", "term": "Beta", "kept": "Alpha"}]
    found = {(r["variant"], r["word"], r["kind"]) for r in glossary.collisions(glossary.corrections_table(own), protected).collect()}
    assert found == {("alfa", "alfabet", "variant in word")}


def test_upsert(spark):
    own, protected = entries(spark, ["# c", "Alpha|7|alfa", "Beta"], ["alphabet"])
    batch = spark.createDataFrame([(0, "ALPHA", ["alphaa", "alfa", "alph"]), (1, "Gamma", ["gama1", "alfa"]), (2, "gamma", ["gamma2"])], "pos int, term string, seen_as array<string>")
    merged, refused = glossary.upsert(own, protected, batch)
    lines = [r["value"] for r in glossary.to_lines(merged).orderBy("ord").collect()]
    assert lines == ["Alpha|7|alfa,alphaa", "Beta", "Gamma|5|gama1"]
    assert {(r["variant"], r["reason"]) for r in refused.collect()} == {("alph", "protected"), ("alfa", "mapped")}


def test_names(spark):
    got = spark.createDataFrame([('["A", {"term": "B", "seen_as": ["b1", " "]}]',)], "j string").select(glossary.normalize_names(F.col("j")).alias("x")).first()["x"]
    assert [(r["term"], r["seen_as"]) for r in got] == [("A", []), ("B", ["b1"])]


def test_coverage(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j", "a b c d e"), (2, "a b c d", "a b c d e f g h"), (3, "", ""), (4, "x [noise] y", "x y")], "doc_id int, source string, output string")
    got = {r["doc_id"]: (r["coverage"], r["added_ratio"], r["ok"]) for r in coverage.coverage(df).collect()}
    assert got == {1: (0.5, 0.0, False), 2: (1.0, 1.0, True), 3: (1.0, 0.0, True), 4: (1.0, 0.0, True)}


def test_window_coverage_finds_the_missing_window(spark):
    filler = " ".join(f"f{i}" for i in range(460))
    parts = [f"topic{i % 4} word{i % 4} {filler} only{i}" + " x y z" * 5 for i in range(8)]
    windows = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "doc_id int, window int, text string")
    out = spark.createDataFrame([(1, " ".join(p for i, p in enumerate(parts) if i != 4))], "doc_id int, text string")
    by_window = coverage.window_coverage(windows, out)
    whole = coverage.coverage(spark.createDataFrame([(1, " ".join(parts), out.first()["text"])], "doc_id int, source string, output string"))
    report = coverage.gate_report(whole, by_window).first()
    assert not report["ok"] and report["worst_window"]["index"] == 4 and len(report["windows"]) == 8


def test_audit(spark):
    df = spark.createDataFrame(
        [(1, "1700万 和 80 人", "一千七百万和八十人"), (2, "12 和 34", "无"), (3, "21年 1:26:23 Speaker 3", "2021 年"), (4, "Codeex Codeex once", "codex")], "id int, raw string, clean string"
    )
    got = {r["id"]: r for r in coverage.audit(df).collect()}
    assert got[1]["status"] == 0 and got[1]["missing_values"] == []
    assert got[2]["status"] == 1 and got[2]["missing_values"] == [12.0, 34.0]
    assert got[3]["status"] == 0 and got[3]["missing_years"] == [21.0]
    assert got[4]["missing_latin"] == ["codeex"] and got[4]["status"] == 0


def pdf(spark):
    lines, pages = [], []
    for page in range(1, 6):
        rows = [("Header text", 60, 20, 300, 32, 9.0), (f"{page} / 5", 280, 820, 320, 832, 9.0), ("Full width heading across", 60, 100, 540, 112, 12.0)]
        rows += [(f"left {page}.{i}", 60, 140 + 14 * i, 250, 152 + 14 * i, 10.0) for i in range(6)] + [(f"right {page}.{i}", 320, 140 + 14 * i, 510, 152 + 14 * i, 10.0) for i in range(6)]
        rows += [("Header text", 60, 400, 300, 412, 10.0)]  # in the body: stays
        if page == 1:
            rows.append(("Cover ​Title", 60, 60 + 20, 400, 98, 28.0))
        lines += [("d", page, n, float(a), float(b), float(c), float(d), t, s) for n, (t, a, b, c, d, s) in enumerate(rows)]
        pages.append(("d", page, 595.0, 842.0, True, ("2026年7月15日 " if page == 1 else "") + "text " * 30 + ("\nDisclaimer\n" if page in (1, 5) else "")))
    return (
        layout.clean_lines(spark.createDataFrame(lines, "doc_id string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double")),
        spark.createDataFrame(pages, "doc_id string, page int, width double, height double, has_fonts boolean, raw_text string"),
    )


def test_layout(spark):
    lines, pages = pdf(spark)
    headers = layout.find_repeated_headers(lines, pages)
    assert {r["norm"] for r in headers.collect()} == {"Header text", "# / #"}
    kept = layout.drop_headers(lines, pages, headers)
    assert kept.where("text = 'Header text'").count() == 5
    gutters = layout.find_gutter(kept.drop("width", "height", "band"), pages)
    assert {round(r["gutter"]) for r in gutters.collect()} == {310 - 25}
    ordered = layout.reading_order(kept.where("page = 2 and text <> 'Header text'"), gutters)
    assert [r["text"].split()[0] for r in ordered.orderBy("order_no").collect()] == ["Full"] + ["left"] * 6 + ["right"] * 6
    paras = [r["text"] for r in layout.paragraphs(ordered).orderBy("para_no").collect()]
    assert paras[0] == "Full width heading across" and paras[1].startswith("left 2.0 left 2.1") and paras[2].startswith("right 2.0")
    info = spark.createDataFrame([("d", "untitled", "Some Research", "D:20200101", False)], "doc_id string, title string, author string, creation_date string, encrypted boolean")
    meta = layout.document_metadata(info, lines, pages).first()
    assert (meta["title"], meta["date"], meta["source"], meta["source_slug"]) == ("Cover Title", "2026-07-15", "pdf:cover", "some-research")
    assert layout.run_status(pages, info).first()["exit_code"] == 0
    cut = layout.find_notice(pages, r"(?im)^disclaimer\s*$")
    assert [r["cut"] for r in cut.collect()] == [5] and layout.cut_notices(pages, cut).count() == 4


def test_tables(spark):
    lines = spark.createDataFrame([("d", 1, i, 10.0, 10.0 * i, 50.0, 10.0 * i + 8, f"l{i}", 10.0) for i in range(6)], "doc_id string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    tables = spark.createDataFrame([("d", 1, 2, 0.0, 15.0, 60.0, 40.0)], "doc_id string, page int, index int, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.strip_table_lines(lines, tables).orderBy("line_no").collect()] == ["l0", "l1", "[[table:p1-2]]", "l4", "l5"]


def test_turns(spark):
    text = "skip\nSpeaker 1 0:00:01\nHello\n\nthere\n**Speaker 2 00:01:02.5** inline **bold**\nSpeaker 1 1:00:00"
    got = turns.parse_turns(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("turn_no").collect()
    assert [(r["speaker"], r["sec"], r["paras"]) for r in got] == [("1", 1, ["Hello", "there"]), ("2", 62, ["inline bold"]), ("1", 3600, [])]
    segments = spark.createDataFrame([(1, 0, "A", 1.0, "One. Two."), (1, 1, "B", 2.0, " "), (1, 2, "A", 3.0, "Three."), (1, 3, None, 4.0, "Four.")], "doc_id int, seg_no int, speaker string, start double, text string")
    merged = turns.merge_turns(segments).orderBy("turn_no").collect()
    assert [(r["speaker"], r["start"], r["sents"]) for r in merged] == [("A", 1.0, ["One.", "Two.", "Three."]), (None, 4.0, ["Four."])]
    chapters = spark.createDataFrame([(1, 1, "00:00:10", 10.0), (1, 2, "00:00:20", 20.0)], "doc_id int, num int, start_ts string, start_sec double")
    own = spark.createDataFrame([(1, 0, 5), (1, 1, 10), (1, 2, 19), (1, 3, 20), (1, 4, 99)], "doc_id int, turn_no int, sec int")
    assert sorted((r["turn_no"], r["chapter"]["num"]) for r in turns.chapters_of(own, chapters).collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000 align:start\n<c>one two</c>\n\n00:00:02.000 --> 00:00:03.000\none two three\n\n00:00:03.000 --> 00:00:04.000\ntwo three four five six\n"
    df = spark.createDataFrame([(1, vtt)], "doc_id int, text string")
    assert turns.clean_captions(df).first()["text"] == "one two one two three two three four five six"
    stream = turns.word_stream(df)
    assert [(r["start_sec"], r["word"]) for r in stream.orderBy("pos").collect()] == [(1.0, "one"), (1.0, "two"), (2.0, "three"), (3.0, "four"), (3.0, "five"), (3.0, "six")]
    asked = spark.createDataFrame([(1, 0, "Three four five six!"), (1, 1, "One two three"), (1, 2, "nothing of this here")], "doc_id int, turn_no int, text string")
    assert [r["start_sec"] for r in turns.phrase_times(stream, asked).orderBy("turn_no").collect()] == [2.0, None, None]


def test_images(spark):
    from textloom.plans.pages import img_anchor

    got = [(r["image_id"], r["anchor_index"], r["is_hero"]) for r in img_anchor(spark, "").orderBy("pos").collect()]
    assert got == [("abcdef12-1", -1, True), ("s.png", -1, False), ("aaaabbbb1.png", 0, False)] or got[0] == ("abcdef12-1", -1, True)
    sized = images.size_filter(spark.createDataFrame([(0, 0), (50, 400), (900, 400), (300, 500)], "w int, h int")).collect()
    assert [(r["variant"], r["skip_reason"]) for r in sized] == [("wide", None), ("portrait", "small"), ("banner", None), ("portrait", None)]


SNIPPETS = [
    (1, "https://www.paulgraham.com/x.html", "<title>Essay</title><body>July 2024 and more</body>"),
    (2, "https://a.b.example.org/2023/04/05/x", "<title> A\n b </title>"),
    (3, "https://example.org/x", """<meta property="article:published_time" content="2022-01-02T03:04:05Z"><meta content="it's" name="author">"""),
    (4, "https://example.org/x", """<script type="application/ld+json">{"@graph":[{"dateModified":"2021-05-06"}],"datePublished":"2020-01-01","headline":"T","author":[{"name":"N"}]}</script>"""),
    (5, "https://example.org/x", "<time datetime='soon'></time><time datetime='20200102'></time>"),
    (6, "https://example.org/x", "".join(f"<img src='/wp-content/uploads/{m}/a.png'>" for m in ("2019/03", "2019/04", "2019/04", "2019/04"))),
    (7, "https://www.youtube.com/watch?v=1", "<title>Video</title>"),
    (8, "https://example.org/x", "<meta name='pubdate' content='2018/07/08'><link rel='canonical' href='https://c.example.org/'>"),
]


def test_metadata_strategies(spark):
    rows = spark.createDataFrame(SNIPPETS, "id int, url string, html string")
    got = {r["id"]: r["m"] for r in rows.select("id", H.metadata(F.col("html"), F.col("url")).alias("m")).collect()}
    assert [(got[i]["date"], got[i]["source"]) for i in range(1, 9)] == [
        ("2024-07-01", "body:month-year"), ("2023-04-05", "url"), ("2022-01-02", "og:article:published_time"), ("2021-05-06", "jsonld:dateModified"),
        ("2020-01-02", "html5:time"), ("2019-04-01", "wp-uploads"), (None, "youtube_skip"), ("2018-07-08", "meta:pubdate"),
    ]
    assert got[3]["author"] == "it" and got[4]["author"] == "N" and got[4]["title"] == "T" and got[8]["canonical"] == "https://c.example.org/" and got[2]["title"] == "A b"


def test_publication(spark):
    urls = ["https://www.anthropic.com/research/x", "https://anthropic.com/about", "https://a.substack.com/p", "https://www.my-site.co.uk/x", "nonsense"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r["id"]: r["source_slug"] for r in H.with_publication(df).collect()}
    assert got == {0: "anthropic-research", 1: "anthropic-blog", 2: "substack", 3: "my-site-co", 4: ""}


def test_reader_split(spark):
    html = '<p>八十</p><details class="x raw-transcript"><summary>(125)</summary>80</details>'
    got = spark.createDataFrame([(html,), ("<p>x</p>",)], "h string").select(H.split_reader(F.col("h")).alias("s")).collect()
    assert (got[0]["s"]["raw"].strip(), got[0]["s"]["clean"].strip()) == ("80", "八十") and got[1]["s"] is None


def test_catalog(spark):
    pages = spark.createDataFrame(
        [("2024-01-02_naval_on-wealth.html", '<h1>On <em>wealth</em> <b>x</b></h1><p class="zh-title">财富</p>'), ("sub/2024-02-03_20vc_scale-ai.html", '<meta name="tags" content="a, b">'), ("index.html", ""), ("x-poster.html", "")], "path string, html string"
    )
    got = {r["href"]: r for r in catalog.parse_entries(pages).collect()}
    assert len(got) == 2
    first, second = got["2024-01-02_naval_on-wealth.html"], got["sub/2024-02-03_20vc_scale-ai.html"]
    assert first["title"] == "On <em>wealth</em> x" and first["zh"] == "财富" and first["tags"] == ["philosophy"]
    assert second["title"] == "Scale Ai" and second["tags"] == ["a", "b"] and second["collection"] == "sub"
    filled = spark.createDataFrame([("junk<!DOCTYPE html>{{A}}{{B}}</html>tail",)], "t string").select(catalog.fill_template(F.col("t"), {"A": F.lit("x")}).alias("f")).first()["f"]
    assert (filled["html"], filled["left_over"]) == ("<!DOCTYPE html>x{{B}}</html>", True)


def test_hotwords(spark):
    lines = ["word|8", " word|3", "other", "", "bad|x", "A4L|4", "a" * 31, "一" * 11, "w|11", "x-y"]
    table = catalog.parse_hotwords(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    got = {r["word"]: (r["weight"], r["f"], r["w"]) for r in table.withColumn("f", catalog.hotword_fault(F.col("word"), F.col("weight"))).withColumn("w", catalog.hotword_warning(F.col("word"))).collect()}
    assert got["word"] == (8, None, False) and got["other"] == (None, None, False) and got["bad"] == (None, None, False) and got["A4L"] == (4, None, True)
    assert [got[k][1] for k in ("a" * 31, "一" * 11, "w", "x-y")] == ["bytes", "bytes", "weight", "symbol"]
    assert catalog.hotword_content(table.where("word in ('word', 'other')")).first()["content"] == "word|8\nother"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo|3\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "m.json").write_text('{"mappings": {"a": "b"}}')
    assert [r["value"] for r in readers.read_lines(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == ["one", "two|3", ""]
    assert readers.read_pdf_flags(spark, str(tmp_path / "b.pdf")).first()["is_pdf"] is True
    assert readers.read_mappings(spark, str(tmp_path / "m.json")).first().asDict() == {"variant": "a", "term": "b"}
    turns_df = spark.createDataFrame([(1, 1, "Ann", 1.0, ["Hi.", "You."])], "doc_id int, turn_no int, speaker string, start double, sents array<string>")
    assert writers.transcript_text(turns_df).first()["text"] == "Ann 00:00:01\nHi. You."
    writers.write_json(turns_df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream(spark, small, tmp_path):
    from textloom.streaming import grow_manifest, stream_metadata

    pages = tmp_path / "pages"
    spark.read.parquet(f"{small}/pages.parquet").limit(20).write.parquet(str(pages))
    for _ in range(2):
        stream = stream_metadata(spark, str(pages)).withColumn("day", F.lit("2024-01-01"))
        grow_manifest(stream, str(tmp_path / "manifest"), str(tmp_path / "checkpoint"), "url", F.col("day")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == spark.read.parquet(str(pages)).select("url").distinct().count()


def test_overlap_of_cues():
    rng = random.Random(4)
    for _ in range(500):
        said, words = (rng.choices("ab", k=rng.randint(0, 9)) for _ in range(2))
        assert turns.overlap(said, words) == max(k for k in range(min(len(said), len(words)) + 1) if k == 0 or said[-k:] == words[:k])

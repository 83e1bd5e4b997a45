"""Queries over constant samples, for operators whose inputs (captions, pages with boxes, readers) no table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T
from textloom.operators import catalog, coverage, layout, turns
from textloom.plans.tables import registry, values_sql

QUERIES, SQL, query = registry()

TRANSCRIPT = "skipped\nSpeaker 1 0:00:01\nHello there.\n\nSecond ⟨?paragraph⟩.\n**Speaker 2 00:01:02.5** Inline **bold** text.\nSpeaker 1 1:00:00\nBye."
CAPTIONS = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000 align:start\n<c>so we begin</c>\n\n00:00:02.000 --> 00:00:03.000\nso we begin with a short\n\n00:00:03.000 --> 00:00:04.000\nwith a short talk about words\n"


TURN = '<div class="turn"><div class="turn-head"><span class="speaker" data-role="{}">Speaker {}</span><span class="timestamp">{}</span></div><div class="turn-body">{}</div></div>'
MARK = '<mark class="asr-uncertain" title="ASR存疑">paragraph?</mark>'
TURNS = [
    (1, 1, "1", "0:00:01", 1, 2, TURN.format("host", 1, "0:00:01", f'<p class="zh">Hello there.</p><p class="zh">Second {MARK}.</p>')),
    (1, 2, "2", "00:01:02", 62, 1, TURN.format("guest", 2, "00:01:02", '<p class="zh">Inline bold text.</p>')),
    (1, 3, "1", "1:00:00", 3600, 1, TURN.format("host", 1, "1:00:00", '<p class="zh">Bye.</p>')),
]
STREAM = [(1, k, at, word) for k, (at, word) in enumerate([*((1.0, w) for w in ("so", "we", "begin")), *((2.0, w) for w in ("with", "a", "short")), *((3.0, w) for w in ("talk", "about", "words"))])]


@query(values_sql("doc_id INTEGER, turn_no BIGINT, speaker VARCHAR, ts VARCHAR, sec INTEGER, n_paras INTEGER, html VARCHAR", TURNS))
def turn_parse(spark, sf_dir):
    own = turns.parse_turns(spark.createDataFrame([(1, TRANSCRIPT)], "doc_id int, text string"))
    html = catalog.turn_html(F.when(F.col("speaker") == "1", "host").otherwise("guest"), F.concat(F.lit("Speaker "), "speaker"), F.col("ts"), F.col("paras"))
    return own.select("doc_id", "turn_no", "speaker", "ts", "sec", F.size("paras").alias("n_paras"), html.alias("html"))


@query(values_sql("doc_id INTEGER, pos INTEGER, start_sec DOUBLE, word VARCHAR", STREAM))
def caption_stream(spark, sf_dir):
    return turns.word_stream(spark.createDataFrame([(1, CAPTIONS)], "doc_id int, text string"))


@query(values_sql("doc_id INTEGER, turn_no INTEGER, text VARCHAR, stamp VARCHAR", [(1, 0, "So we begin with", "00:00:01"), (1, 1, "Short talk about words!", "00:00:02"), (1, 2, "nothing like this here", None)]))
def caption_stamps(spark, sf_dir):
    asked = spark.createDataFrame([(1, 0, "So we begin with"), (1, 1, "Short talk about words!"), (1, 2, "nothing like this here")], "doc_id int, turn_no int, text string")
    times = turns.phrase_times(caption_stream(spark, sf_dir), asked)
    return turns.with_stamps(asked, times)


def page_lines(spark):
    rows, pages = [], []
    for page in range(1, 6):
        own = [("Quarterly header", 60, 20, 300, 32, 9.0), (f"{page} / 5", 280, 820, 320, 832, 9.0), ("A heading across both columns", 60, 100, 540, 112, 12.0)]
        own += [(f"left line {page}.{i}", 60, 140 + 14 * i, 250, 152 + 14 * i, 10.0) for i in range(6)] + [(f"right line {page}.{i}", 320, 140 + 14 * i, 510, 152 + 14 * i, 10.0) for i in range(6)]
        if page == 1:
            own.append(("Cover title", 60, 76, 400, 98, 28.0))
        rows += [("d", page, n, float(a), float(b), float(c), float(d), t, s) for n, (t, a, b, c, d, s) in enumerate(own)]
        pages.append(("d", page, 595.0, 842.0, True, ("2026年7月15日 " if page == 1 else "") + "text " * 30 + ("\nDisclaimer\n" if page == 5 else "")))
    lines = spark.createDataFrame(rows, "doc_id string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    return layout.clean_lines(lines), spark.createDataFrame(pages, "doc_id string, page int, width double, height double, has_fonts boolean, raw_text string")


COLUMNS = [(p, " ".join(f"{side} line {p}.{i}" for i in range(6))) for p in range(1, 6) for side in ("left", "right")]
PARAGRAPHS = [("d", p, k, text) for p in range(1, 6) for k, text in enumerate(["Cover title"] * (p == 1) + ["A heading across both columns"] + [t for q, t in COLUMNS if q == p], 1)]
KEPT_LINES = [
    ("d", p, n, "[[table:p2-1]]" if (p, n) == (2, 4) else text)
    for p in range(1, 6)
    for n, text in enumerate(["Quarterly header", f"{p} / 5", "A heading across both columns", *(f"{side} line {p}.{i}" for side in ("left", "right") for i in range(6)), *["Cover title"] * (p == 1)])
    if (p, n) not in ((2, 5), (2, 6))
]


@query(values_sql("doc_id VARCHAR, page INTEGER, para_no BIGINT, text VARCHAR", PARAGRAPHS))
def page_layout(spark, sf_dir):
    """Paragraphs in reading order of two-column pages, without running headers."""
    lines, pages = page_lines(spark)
    kept = layout.drop_headers(lines, pages, layout.find_repeated_headers(lines, pages)).drop("width", "height", "band")
    return layout.paragraphs(layout.reading_order(kept, layout.find_gutter(kept, pages)))


@query(values_sql("doc_id VARCHAR, title VARCHAR, publication VARCHAR, source_slug VARCHAR, date VARCHAR, source VARCHAR, mode VARCHAR, exit_code INTEGER", [("d", "Cover title", "Some Research", "some-research", "2026-07-15", "pdf:cover", "text", 0)]))
def page_metadata(spark, sf_dir):
    lines, pages = page_lines(spark)
    info = spark.createDataFrame([("d", "untitled", "Some Research", "D:20200101", False)], "doc_id string, title string, author string, creation_date string, encrypted boolean")
    out = layout.document_metadata(info, lines, pages).join(layout.run_status(pages, info), "doc_id")
    return out.select("doc_id", "title", "publication", "source_slug", "date", "source", "mode", "exit_code")


@query(values_sql("doc_id VARCHAR, page INTEGER, line_no INTEGER, text VARCHAR", KEPT_LINES))
def page_tables(spark, sf_dir):
    lines, _ = page_lines(spark)
    tables = spark.createDataFrame([("d", 2, 1, 50.0, 150.0, 260.0, 200.0)], "doc_id string, page int, index int, x0 double, y0 double, x1 double, y1 double")
    return layout.strip_table_lines(lines, tables).select("doc_id", "page", "line_no", "text")


#: (reader page, missing values, years and Latin terms, ratio, status)
READERS = [
    ('<p>一千七百万人，八十家</p><details class="raw-transcript"><summary>展开（125 段）</summary>Speaker 1 1:26:23 1700万 人 80 家 12 个</details>', "12.0", "", "", 1 / 3, 1),
    ('<p>一千七百万人，八十家，十二个</p><details class="x raw-transcript y">1700万 80 12 12</details>', "", "", "", 0.0, 0),
    ('<p>二零二六年</p><details class="raw-transcript">2026 年 26年 3k</details>', "3000.0", "26.0", "", 1.0, 1),
    ('<p>OpenAI 80</p><details class="raw-transcript">Opnai opnai Other OpenAI openai and 80 speaker speaker 00:12:13</details>', "", "", "opnai", 0.0, 0),
    ('<p>a</p><details class="raw-transcript">one</details><details class="raw-transcript">5 6</details>', "5.0,6.0", "", "", 1.0, 1),
]


@query(values_sql("id INTEGER, missing VARCHAR, years VARCHAR, latin VARCHAR, missing_ratio DOUBLE, status INTEGER", [(i, *x[1:]) for i, x in enumerate(READERS)]))
def reader_audit(spark, sf_dir):
    own = spark.createDataFrame([(i, x[0]) for i, x in enumerate(READERS)], "id int, html string").select("id", H.split_reader(F.col("html")).alias("s")).select("id", "s.*")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return coverage.audit(own).select("id", listed("missing_values").alias("missing"), listed("missing_years").alias("years"), listed("missing_latin").alias("latin"), "missing_ratio", "status")


LISTED = [
    ("2024-01-02_naval_on-wealth.html", "2024-01-02", "naval", "On <em>wealth</em>", "财富", None, "philosophy", None, '<li data-date="2024-01-02" data-tags="philosophy"><a href="2024-01-02_naval_on-wealth.html">On <em>wealth</em></a></li>'),
    ("sub/2024-02-03_20vc_scale-ai.html", "2024-02-03", "20vc", "Scale Ai", None, None, "a,b", "sub", '<li data-date="2024-02-03" data-tags="a b"><a href="sub/2024-02-03_20vc_scale-ai.html">Scale Ai</a></li>'),
]


@query(values_sql("href VARCHAR, iso VARCHAR, source VARCHAR, title VARCHAR, zh VARCHAR, eyebrow VARCHAR, tags VARCHAR, collection VARCHAR, li VARCHAR", LISTED))
def catalog_entries(spark, sf_dir):
    rows = [("2024-01-02_naval_on-wealth.html", '<h1>On <em>wealth</em></h1><p class="zh-title">财富</p>'), ("sub/2024-02-03_20vc_scale-ai.html", '<meta name="tags" content="a, b">'), ("index.html", "")]
    own = catalog.parse_entries(spark.createDataFrame(rows, "path string, html string"))
    return own.withColumn("li", catalog.entry_html(F.col("href"), F.col("title"), F.col("iso"), F.col("tags"))).withColumn("tags", F.array_join("tags", ","))


@query(values_sql("ord INTEGER, word VARCHAR, weight INTEGER, fault VARCHAR", [(0, "word", 8, None), (2, "other", None, None), (4, "bad", None, None), (5, "A4L", 4, None), (6, "a" * 31, None, "bytes"), (7, "一" * 11, None, "bytes"), (8, "w", 11, "weight"), (9, "x-y", None, "symbol")]))
def hotword_lines(spark, sf_dir):
    lines = ["word|8", " word|3", "other", "", "bad|x", "A4L|4", "a" * 31, "一" * 11, "w|11", "x-y"]
    table = catalog.parse_hotwords(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    return table.withColumn("fault", catalog.hotword_fault(F.col("word"), F.col("weight")))


RIFF = b"RIFF\0\0\0\0WEBP"
#: (file header, width, height, variant)
IMAGES = [
    (bytes.fromhex("89504E470D0A1A0A0000000D4948445200000320000001F4"), 800, 500, "wide"), (b"GIF89a\x40\x01\xf0\x00", 320, 240, "square"), (b'<svg viewBox="0 0 300 150">', 300, 150, "banner"), (b"?", 0, 0, "wide"), (b"", 0, 0, "wide"),
    (b'<svg width="640" height="1000">', 640, 1000, "portrait"), (b"<svg>", 1200, 600, "banner"),
    (bytes.fromhex("FFD8FFE000046162FFFFC4000378FFC2001108025803200301"), 800, 600, "wide"), (bytes.fromhex("FFD8FFDB0002FFC00011080100020003"), 512, 256, "banner"), (bytes.fromhex("FFD8FFDB"), 0, 0, "wide"),
    (RIFF + b"VP8 " + bytes(7) + bytes.fromhex("9D012A80428001"), 640, 384, "square"), (RIFF + b"VP8L" + bytes(4) + b"\x2f" + (799 | 599 << 14).to_bytes(4, "little"), 800, 600, "wide"),
    (RIFF + b"VP8X" + bytes(8) + (1023).to_bytes(3, "little") + (499).to_bytes(3, "little"), 1024, 500, "banner"), (RIFF + b"ANIM", 0, 0, "wide"),
]


@query(values_sql("id INTEGER, w INTEGER, h INTEGER, variant VARCHAR", [(i, *x[1:]) for i, x in enumerate(IMAGES)]))
def html_images(spark, sf_dir):
    own = spark.createDataFrame([(i, x[0]) for i, x in enumerate(IMAGES)], "id int, content binary").select("id", H.image_size(F.col("content")).alias("s")).select("id", "s.*")
    return own.withColumn("variant", H.image_variant(F.col("w"), F.col("h")))


@query(values_sql("id INTEGER, mode VARCHAR", [(1, "captions"), (2, "turns"), (3, "stamped"), (4, "essay"), (5, "pdf")]))
def input_modes(spark, sf_dir):
    rows = [(1, CAPTIONS), (2, "Ann: hi\nBob: ho\n"), (3, "[00:01] a\n[00:02] b"), (4, "an essay"), (5, "%PDF-1.7")]
    return spark.createDataFrame(rows, "id int, text string").select("id", T.input_mode(F.col("text")).alias("mode"))

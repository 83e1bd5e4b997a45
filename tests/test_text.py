import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.numerals import numeral, numerals


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first()["x"]


def col(name="t"):
    return F.col(name)


def test_blocks_and_windows(spark):
    assert one(spark, T.parse_blocks(col()), t="&gt;&gt; one  >>two &gt;&gt;three ") == ["one", "two", "three"]
    assert one(spark, T.parse_blocks(col()), t=">> >> x") == ["x"]
    sizes = F.transform(T.windows(F.transform(F.sequence(F.lit(1), col()), lambda x: x.cast("string"))), F.size)
    assert one(spark, sizes, t=53) == [25, 25, 3]
    assert one(spark, F.size(T.windows(T.nonempty(F.split(col(), ",")))), t="") == 0


def test_norm_words(spark):
    assert one(spark, T.norm_words(col()), t="It&#39;s [noise] OK-ay, 3!") == ["it", "s", "ok", "ay", "3"]
    assert one(spark, T.norm_words(col(), drop_tags=True), t="<b>Hi</b> you") == ["hi", "you"]
    assert one(spark, T.norm_words(col()), t="漢字") == []


def test_join_lines(spark):
    join = T.join_lines(col("a"), col("b"))
    cases = [("exam-", "ple", "example"), ("Anglo-", "Saxon", "Anglo-Saxon"), ("汉字", "继续", "汉字继续"), ("two", "words", "two words"), ("", "x", "x"), ("x", "", "x")]
    for a, b, expected in cases:
        assert one(spark, join, a=a, b=b) == expected


def test_sentences(spark):
    text = 'Visit vanta.com/lenny. That is 2.0 and Dr. No said "this is it." Then A.I. won! It cost $1,000. (Really?) Yes.'
    assert one(spark, T.split_sentences(col()), t=text) == ["Visit vanta.com/lenny.", 'That is 2.0 and Dr. No said "this is it."', "Then A.I. won!", "It cost $1,000.", "(Really?)", "Yes."]
    assert one(spark, T.split_sentences(col()), t="") == []


def test_stamps(spark):
    assert one(spark, T.to_seconds(col()), t="01:02:03.500") == 3723.5
    assert one(spark, T.to_seconds(col()), t="02:03") == 123.0
    assert one(spark, T.to_stamp(F.lit(3723.9)), t="") == "01:02:03"


def test_language_and_mode(spark):
    assert one(spark, T.detect_language(col()), t="汉" * 80 + "a" * 30) == "zh"
    assert one(spark, T.detect_language(col()), t="汉" * 50) == "en"
    assert one(spark, T.input_mode(col()), t="WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nHi") == "captions"
    assert one(spark, T.input_mode(col()), t="Ann: hi\nBob: ho\n") == "turns"
    assert one(spark, T.input_mode(col()), t="just text") == "essay"


@pytest.mark.parametrize(
    ("text", "date"),
    [("于2026年7月5日发布", "2026-07-05"), ("2026年7月", "2026-07-01"), ("on 2024-05-07", "2024-05-07"), ("july 2023", "2023-07-01"), ("none", None)],
)
def test_cover_date(spark, text, date):
    assert one(spark, T.find_cover_date(col()), t=text) == date


def test_titles_and_names(spark):
    for title, junk in (("Microsoft Word - x", True), ("untitled", True), ("a.docx", True), (" ", True), ("Docs", True), ("Google Docs guide", False)):
        assert one(spark, T.is_junk_title(col()), t=title) is junk
    assert one(spark, T.slugify(col(), "pdf"), t="中文") == "pdf"
    assert one(spark, T.slugify(col(), "x", 4), t="A b, c d e") == "a-b-c-d"
    assert one(spark, T.parse_pdf_date(col()), t="D:20260801093000+08'00'") == "2026-08-01"
    assert one(spark, T.find_org_name(col()), t="line\nSome Research \nx") == "Some Research"
    assert one(spark, T.parse_filename(col()), t="2024-01-02_a_b_c.html").asDict() == {"date": "2024-01-02", "source": "a", "rest": "b_c"}
    assert one(spark, T.norm_running(col()), t=" Page １２ of 3 ") == "Page # of #"
    assert one(spark, T.mark_uncertain(col()), t="a ⟨?b⟩") == 'a <mark class="asr-uncertain" title="ASR存疑">b?</mark>'


NUMERALS = {
    "八十": 80, "三": 3, "十五": 15, "一千七百万": 17_000_000, "两亿": 200_000_000, "二零二六": 2026, "一二三": 123, "一百九": 190, "五百九": 590, "两千三": 2300, "一百零五": 105,
    "十万": 100_000, "十亿": 1_000_000_000, "一百二百": None, "三万五万": None, "百": None, "万": None, "十": None, "": None, "一亿三千万": 130_000_000, "零": 0, "百万": None, "三亿五千万零二十": 350_000_020,
    "九千九百九十九": 9999, "一千零一十": 1010, "abc": None, "三x": None,
}


def test_numerals(spark):
    df = spark.createDataFrame([(s, None if v is None else float(v)) for s, v in NUMERALS.items()], "s string, v double")
    assert df.where(~numeral(F.col("s")).eqNullSafe(F.col("v"))).collect() == []
    assert one(spark, numerals(F.split(col(), ",")), t="十,八十,三,百,三") == [3.0, 80.0]

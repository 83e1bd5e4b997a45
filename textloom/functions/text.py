"""Cleaning, splitting and formatting of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.entities import REFERENCE, chosen, decoded

# fixed values
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
CJK_IDEOGRAPHS = "\u4e00-\u9fff"
CJK_JOINED = "\u3000-\u303f\u4e00-\u9fff\uff00-\uffef"
CJK_KEYS = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def found_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def nonempty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Each match of a literal pattern changed by an expression: gaps and matches are zipped again."""
    gaps, hits = F.split(text, pattern, -1), F.transform(found_all(text, pattern), change)
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def unescape(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """All HTML5 character references, once, or only those by the names, closed by a semicolon; texts without an ampersand are left as they are."""
    pattern, change = chosen(names) if names else (REFERENCE, decoded)
    return F.when(F.contains(text, F.lit("&")), replace_each(text, pattern, change)).otherwise(text)


def escape(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quotes
    for char, entity in pairs:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def collapse(text: Column, space: str = r"(?U:\s)") -> Column:
    return F.trim(F.regexp_replace(text, f"{space}+", " "))


# the patterns are fixed values
def parse_blocks(raw: Column) -> Column:
    """Utterances between ``>>`` marks, which may be escaped."""
    return nonempty(F.transform(F.split(unescape(raw), r">>\s*"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))


def windows(items: Column, size: int = 25) -> Column:
    """An array in runs of ``size``; the last may be short."""
    n = F.ceil(F.size(items) / size).cast("int")
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(items, k * size + 1, F.lit(size))))


# the patterns are fixed values
def norm_words(text: Column, drop_tags: bool = False) -> Column:
    """Lower-case words of ASCII letters and digits, without bracketed notes (and without tags)."""
    return nonempty(F.split(F.lower(without_notes(text, drop_tags)), "[^a-z0-9]+"))


def spaced_words(text: Column) -> Column:
    """The same words as a text, with spaces between."""
    return F.regexp_replace(F.lower(without_notes(text)), "[^a-z0-9]+", " ")


def without_notes(text: Column, drop_tags: bool = False) -> Column:
    own = unescape(text)
    out = F.when(F.contains(own, F.lit("[")), F.regexp_replace(own, r"\[[^\]]*\]", " ")).otherwise(own)
    if drop_tags:
        out = F.regexp_replace(out, r"<[^>]+>", " ")
    return out


def word_count(text: Column) -> Column:
    return F.size(nonempty(F.split(text, r"(?U)\s+")))


# the patterns are fixed values
def norm_running(text: Column) -> Column:
    """Running headers alike but for their numbers."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\d+", "#")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{ZERO_WIDTH}]", ""), r"(?U)^\s+|\s+$", "")


def join_lines(before: Column, after: Column) -> Column:
    """Two lines of a paragraph: a hyphen goes before a small ASCII letter, no space beside CJK."""
    hyphen = before.endswith("-")
    cjk = before.rlike(f"[{CJK_JOINED}]$") | after.rlike(f"^[{CJK_JOINED}]")
    return (
        F.when(before == "", after).when(after == "", before)
        .when(hyphen & after.rlike("^[a-z]"), F.concat(F.left(before, F.length(before) - 1), after))
        .when(hyphen | cjk, F.concat(before, after))
        .otherwise(F.concat(before, F.lit(" "), after))
    )


def fold_lines(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(""), join_lines)


def to_seconds(stamp: Column) -> Column:
    """H:MM:SS(.fff), or with parts missing on the left."""
    parts = F.reverse(F.split(stamp, ":"))
    return F.aggregate(F.transform(parts, lambda p, i: p.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def to_stamp(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)))


#: What is no end of a sentence (fixed values).
PROTECTED = (
    r"\b(?:[A-Za-z0-9-]+\.)+(?:com|org|net|io|co|ai|dev|app|edu|gov|so|me|fm)\b(?:/[A-Za-z0-9_\-./~%?&=#]*[A-Za-z0-9_\-/~%=#])?"
    r"|\b\d+(?:\.\d+)+\b"
    r"|\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|Inc|Ltd|Fig|No|Vol)\."
    r"|\b(?i:e\.g|i\.e|a\.m|p\.m|U\.S|U\.K|Ph\.D)\."
    r"|\b(?:[A-Za-z]\.){2,}"
)
#: What stands for the marks of a protected form, and before it: no sentence begins with one.
HIDDEN, SHOWN, BEFORE = "\x01\x02\x03", ".!?", "\x05"


def split_sentences(text: Column) -> Column:
    """Sentences; their marks and closing quotes stay with them. URLs, decimals, titles and initials neither end nor begin one."""
    own = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    hidden = F.when(text.rlike(PROTECTED), replace_each(own, PROTECTED, lambda m: F.concat(F.lit(BEFORE), F.translate(m, SHOWN, HIDDEN)))).otherwise(own)
    marked = F.regexp_replace(hidden, "([.!?][\"')\\]]*)(?U:\\s)+(?=[\"'(\\[]?[A-Z0-9])", "$1\x04")
    return nonempty(F.transform(F.split(marked, "\x04"), lambda s: F.translate(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), HIDDEN + BEFORE, SHOWN)))


# the patterns are fixed values
def mark_uncertain(text: Column) -> Column:
    return F.regexp_replace(text, "⟨\\?([^⟩]*)⟩", '<mark class="asr-uncertain" title="ASR存疑">$1?</mark>')


# the patterns are fixed values
def detect_language(text: Column) -> Column:
    """zh if 60 % of CJK and Latin letters are CJK; en below 100 letters and otherwise."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK_IDEOGRAPHS}]", ""))
    total = cjk + F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(total < 100, "en").when(cjk / total >= 0.6, "zh").otherwise("en")


# the patterns are fixed values
def input_mode(text: Column) -> Column:
    """Captions, stamped or named turns, or an essay, by how many lines look so (two or more)."""
    lines = lambda pattern: F.size(found_all(text, pattern))
    return (
        F.when(text.startswith("%PDF-"), "pdf")
        .when(lines(r"(?m)^\d{1,2}:\d{2}:\d{2}[.,]\d{3}\s*-->") >= 1, "captions")
        .when(lines(r"(?m)^\s*\[\d{1,2}:\d{2}(?::\d{2})?\]") >= 2, "stamped")
        .when(lines(r"(?m)^[A-Z][A-Za-z .]{0,40}:\s") >= 2, "turns")
        .otherwise("essay")
    )


def size_bucket(n: Column) -> Column:
    return F.when(n < 1500, "short").when(n <= 6000, "medium").when(n <= 15000, "long").otherwise("very_long")


def size_advice(n: Column) -> Column:
    return F.when(n > 100_000, "split").when(n < 500, "confirm").otherwise("ok")


def layout_band(layout: Column, size_kb: Column) -> Column:
    """True if the size fits the layout's band."""
    return F.when(layout == "essay", size_kb.between(25, 120)).when(layout == "podcast", size_kb.between(90, 300)).when(layout == "zh", size_kb.between(250, 1100))


def slugify(text: Column, fallback: str, words: int | None = None) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if words:
        slug = F.array_join(F.slice(F.split(slug, "-"), 1, words), "-")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(name))


def truncate_left(value: Column, most: int = 40) -> Column:
    return F.when(F.length(value) > most, F.concat(F.lit("..."), F.right(value, F.lit(most - 3)))).otherwise(value)


def cut_site_suffix(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\|[^|]*$", ""))


def describe(text: Column, most: int = 500) -> Column:
    return F.left(text, F.lit(most))


#: Titles that exporters leave (fixed values).
JUNK_TITLES = ("docs", "doc", "document", "untitled", "untitled document", "无标题", "无标题文档", "未命名", "新建文档", "新建文件")


def is_junk_title(title: Column) -> Column:
    own = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.lower(own).isin(*JUNK_TITLES) | own.rlike(r"(?i)microsoft word|^untitled$|\.docx?$|\.pdf$|^\s*$")


# the patterns are fixed values
def parse_pdf_date(raw: Column) -> Column:
    day = F.regexp_extract(raw, r"^D:(\d{4})(\d{2})(\d{2})", 0)
    return F.when(day != "", F.concat_ws("-", F.substring(day, 3, 4), F.substring(day, 7, 2), F.substring(day, 9, 2)))


# the patterns are fixed values
def find_cover_date(text: Column) -> Column:
    two = lambda c: F.lpad(c, 2, "0")
    full, month, name = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})\s*年\s*(\d{1,2})\s*月", rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{4}})\b"
    return F.coalesce(
        F.when(text.rlike(full), F.concat_ws("-", F.regexp_extract(text, full, 1), two(F.regexp_extract(text, full, 2)), two(F.regexp_extract(text, full, 3)))),
        found(text, r"\d{4}-\d{2}-\d{2}", 0),
        F.when(text.rlike(month), F.concat_ws("-", F.regexp_extract(text, month, 1), two(F.regexp_extract(text, month, 2)), F.lit("01"))),
        F.when(text.rlike(name), F.concat_ws("-", F.regexp_extract(text, name, 2), two(month_number(F.regexp_extract(text, name, 1)).cast("string")), F.lit("01"))),
    )


# the patterns are fixed values
def find_org_name(text: Column) -> Column:
    return F.trim(found(text, r"(?im)^.{2,40}?(研究部|研究所|研究院|证券|Research|Capital|Institute)\s*$", 0))


# fixed values: date_source_rest.html
FILENAME = r"^(\d{4}-\d{2}-\d{2})_([^_]+)_(.+)\.html$"


def parse_filename(name: Column) -> Column:
    """Struct of date, source and rest, null if the name has another form."""
    part = lambda k: F.regexp_extract(name, FILENAME, k)
    return F.when(name.rlike(FILENAME), F.struct(part(1).alias("date"), part(2).alias("source"), part(3).alias("rest")))


def lint_filename(name: Column) -> Column:
    return F.struct(
        (name == F.lower(name)).alias("lower"), name.rlike(r"^[\x00-\x7f]*$").alias("ascii"), (F.length(name) <= 80).alias("short"), name.rlike(FILENAME).alias("pattern")
    )

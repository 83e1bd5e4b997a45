"""Metadata and text out of raw HTML, and slugs out of URLs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import MONTHS, collapse, found, found_all, let, month_number, slugify, unescape

# fixed values
META_DATES = (
    ("name", "pubdate"), ("name", "publishdate"), ("name", "publish-date"), ("name", "date"), ("name", "DC.date.issued"), ("name", "dc.date.issued"),
    ("name", "parsely-pub-date"), ("name", "sailthru.date"), ("name", "article:published"), ("itemprop", "datePublished"),
)
JSONLD_DATES = ("datePublished", "dateCreated", "uploadDate", "dateModified")
SLUGS = {
    "paulgraham.com": "paul-graham", "nav.al": "naval", "andrewchen.com": "andrew-chen", "stratechery.com": "stratechery", "ben-evans.com": "ben-evans",
    "lennysnewsletter.com": "lennys-podcast", "every.to": "every", "platformer.news": "platformer", "noahpinion.blog": "noahpinion",
    "anthropic.com": "anthropic-blog", "openai.com": "openai-blog", "deepmind.google": "deepmind-blog", "deepmind.com": "deepmind-blog",
    "blog.google": "google-blog", "huggingface.co": "huggingface-blog", "substack.com": "substack", "medium.com": "medium", "twitter.com": "twitter",
    "x.com": "twitter", "youtube.com": "youtube", "youtu.be": "youtube", "ycombinator.com": "y-combinator", "ycombinator.com/blog": "yc-blog",
    "anthropic.com/news": "anthropic-blog", "anthropic.com/research": "anthropic-research",
}
NOISE_IMAGE = "(?i)avatar|icon|logo|profile|button|badge|emoji|spacer|pixel|tracking"
MIME = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/svg+xml": "svg", "image/gif": "gif"}


def normalize_date(s: Column) -> Column:
    dash = lambda d, a, b: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, a, 2), F.substring(d, b, 2))

    def read(own: Column) -> Column:
        return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(own, F.lit(10))).when(own.rlike(r"^\d{8}$"), dash(own, 5, 7)).when(own.rlike(r"^\d{4}/\d{2}/\d{2}"), dash(own, 6, 9))

    return let(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), read)


def meta_tags(html: Column) -> Column:
    """All meta tags of a page, joined: what the lookups below read, once cut out, instead of the page."""
    return F.array_join(found_all(html, r"""(?i)<meta(?:"[^"]*+"|'[^']*+'|[^>"']++)*+>"""), "\n")


# the patterns are fixed values
def meta_content(html: Column, attr: str, value: str) -> Column:
    """content of the meta tag, whichever attribute comes first; it ends at the first quote of either kind."""
    attr, value = re.escape(attr), re.escape(value)
    return F.coalesce(
        found(html, rf"""(?i)<meta[^>]+{attr}=["']{value}["'][^>]+content=["']([^"']+)["']"""),
        found(html, rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+{attr}=["']{value}["']"""),
    )


def find_meta(html: Column, prop: str) -> Column:
    """Named by property or by name, unescaped."""
    return unescape(F.coalesce(meta_content(html, "property", prop), meta_content(html, "name", prop)))


# the patterns are fixed values
def jsonld_blocks(html: Column) -> Column:
    """array<string> of JSON objects of all ld+json scripts in order: members of a list or @graph come one by one, a graph before its container."""
    scripts = F.transform(found_all(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1), lambda x: F.trim(F.regexp_replace(x, r"(?s)<!--|-->", "")))

    def members(js: Column) -> Column:
        return F.when(js.startswith("["), F.from_json(js, "array<string>")).otherwise(F.array(js))

    def graph(js: Column) -> Column:
        inner = F.from_json(F.get_json_object(js, "$['@graph']"), "array<string>")
        return F.concat(F.coalesce(inner, F.array().cast("array<string>")), F.array(js))

    valid = F.filter(scripts, lambda x: F.try_parse_json(x).isNotNull())
    return F.flatten(F.transform(F.flatten(F.transform(valid, members)), graph))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def json_text(js: Column, key: str) -> Column:
    """The key's value if it is a string that isn't blank."""
    value = F.get_json_object(js, f"$.{key}")
    return F.when(F.get_json_object(js, f"$.{key}[0]").isNull() & ~value.startswith("{") & (F.trim(value) != ""), F.trim(value))


def date_from_jsonld(html: Column) -> Column:
    """Struct (date, source): of the first block with a date; there, of the first key."""
    by_key = lambda js: F.coalesce(*[_dated(normalize_date(F.get_json_object(js, f"$.{k}")), f"jsonld:{k}") for k in JSONLD_DATES])
    return _first(F.transform(jsonld_blocks(html), by_key))


def author_from_jsonld(html: Column) -> Column:
    of = lambda js, at: F.coalesce(F.get_json_object(js, f"{at}.name"), F.when(~F.get_json_object(js, at).rlike(r"^[\[{]"), F.get_json_object(js, at)))
    return _first(F.transform(jsonld_blocks(html), lambda js: F.nullif(F.trim(F.coalesce(of(js, "$.author"), of(js, "$.author[0]"))), F.lit(""))))


def title_from_jsonld(html: Column) -> Column:
    return _first(F.transform(jsonld_blocks(html), lambda js: F.coalesce(json_text(js, "headline"), json_text(js, "name"))))


def _dated(date: Column, source) -> Column:
    return let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(source).alias("source"))))


# the patterns are fixed values
def date_from_time(html: Column) -> Column:
    stamps = found_all(html, r"""(?i)<time[^>]+datetime=["']([^"']+)["']""", 1)
    return _first(F.transform(stamps, normalize_date))


# the patterns are fixed values
def date_from_url(url: Column) -> Column:
    day = found(url, r"/(\d{4}/\d{2}/\d{2})/", 1)
    return F.replace(day, F.lit("/"), F.lit("-"))


# the patterns are fixed values
def date_from_uploads(html: Column, least: int = 3) -> Column:
    """The month most often named by upload paths, of ties the first, if named often enough."""
    months = found_all(html, r"wp-content/uploads/(\d{4}/\d{2})/", 1)

    def modal(ms: Column) -> Column:
        counted = F.transform(F.array_distinct(ms), lambda m, i: F.struct(F.size(F.filter(ms, lambda x: x == m)).alias("n"), (-i).alias("order"), m.alias("m")))
        return F.array_max(counted)

    best = let(months, modal)
    return F.when(best["n"] >= least, F.concat(F.replace(best["m"], F.lit("/"), F.lit("-")), F.lit("-01")))


# the patterns are fixed values
def body_head(html: Column, chars: int = 1500) -> Column:
    body = F.coalesce(found(html, r"(?is)<body[^>]*>(.*)</body>"), html)
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    body = F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"(?U)&\w+;", " ")
    return F.left(collapse(body), F.lit(chars))


# the patterns are fixed values
def date_from_body(html: Column) -> Column:
    names = "|".join(MONTHS)
    day, month = rf"\b({names})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", rf"\b({names})\s+(\d{{4}})\b"

    def read(head: Column) -> Column:
        number = lambda p: F.lpad(month_number(F.regexp_extract(head, p, 1)).cast("string"), 2, "0")
        return F.coalesce(
            _dated(F.when(head.rlike(day), F.concat_ws("-", F.regexp_extract(head, day, 3), number(day), F.lpad(F.regexp_extract(head, day, 2), 2, "0"))), "body:month-day-year"),
            _dated(F.when(head.rlike(month), F.concat_ws("-", F.regexp_extract(head, month, 2), number(month), F.lit("01"))), "body:month-year"),
        )

    return let(body_head(html), read)


def title(html: Column, tags: Column | None = None) -> Column:
    return F.coalesce(F.trim(meta_content(html if tags is None else tags, "property", "og:title")), collapse(found(html, r"(?is)<title[^>]*>(.*?)</title>")))


def author_from_meta(html: Column) -> Column:
    plain = lambda v: F.when(~v.startswith("http"), F.trim(v))
    return F.coalesce(plain(meta_content(html, "name", "author")), plain(meta_content(html, "property", "article:author")))


# the patterns are fixed values
def canonical(html: Column, url: Column) -> Column:
    tag = found(html, r"""(?i)<link[^>]+rel=["']canonical["'][^>]*>""", 0)
    return F.coalesce(found(tag, r"""(?i)href=["']([^"']+)["']"""), url)


def _authority(url: Column, group: int = 1) -> Column:
    """What stands between // and the path (with any port), or the path after it."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)", group), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_authority(url)), r"^www\.", "")


def slug_from_domain(domain: Column) -> Column:
    own = F.regexp_replace(F.lower(domain), r"^www\.", "")
    base = F.regexp_replace(F.replace(F.regexp_replace(own, r"\.[^.]*$", ""), F.lit("."), F.lit("-")), "[^a-z0-9-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(base, "^-+|-+$", ""), F.lit("")), own)


def publication(url: Column, slugs: dict[str, str] = SLUGS) -> Column:
    """The slug of a URL: of the longest path that it begins with, of its host, of the host's last two labels, or made of the domain.

    The table is kept by hand and small: it is part of the expression.
    """
    known = F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair])
    paths = sorted((k for k in slugs if "/" in k), key=lambda k: (-len(k), k))

    def look_up(own: Column) -> Column:
        path = F.concat(own, _authority(url, 2))
        last_two = F.when(F.contains(own, F.lit(".")), F.substring_index(own, ".", -2))
        return F.coalesce(*[F.when(path.startswith(k), F.lit(slugs[k])) for k in paths], F.try_element_at(known, own), F.try_element_at(known, last_two), slug_from_domain(own))

    return let(host(url), look_up)


def with_publication(df: DataFrame, url: str = "url", slugs: dict[str, str] = SLUGS) -> DataFrame:
    """Adds host and source_slug."""
    return df.withColumn("host", host(F.col(url))).withColumn("source_slug", publication(F.col(url), slugs))


def is_video_host(url: Column) -> Column:
    own = _authority(url)
    return own.endswith("youtube.com") | own.endswith("youtu.be")


def metadata(html: Column, url: Column) -> Column:
    """Struct of date, source, title, author, canonical: the first strategy that gives a date wins and is named."""
    video = is_video_host(url)

    def read(tags: Column) -> Column:
        chain = F.coalesce(
            date_from_jsonld(html),
            _dated(normalize_date(meta_content(tags, "property", "article:published_time")), "og:article:published_time"),
            *[_dated(normalize_date(meta_content(tags, a, v)), f"meta:{v}") for a, v in META_DATES],
            _dated(date_from_time(html), "html5:time"),
            _dated(date_from_url(url), "url"),
            _dated(date_from_uploads(html), "wp-uploads"),
            date_from_body(html),
        )
        return let(
            chain,
            lambda d: F.struct(
                d["date"].alias("date"), F.coalesce(d["source"], F.lit("none")).alias("source"), F.coalesce(title_from_jsonld(html), title(html, tags)).alias("title"),
                F.coalesce(author_from_jsonld(html), author_from_meta(tags)).alias("author"), canonical(html, url).alias("canonical"),
            ),
        )

    nothing = F.struct(*[F.lit("youtube_skip" if c == "source" else None).cast("string").alias(c) for c in ("date", "source", "title", "author", "canonical")])
    return F.when(video, nothing).otherwise(let(meta_tags(html), read))


# the patterns are fixed values
def strip_tags(html: Column, names: tuple[str, ...] | None = None, hidden: tuple[str, ...] = ("script|style",)) -> Column:
    """Text without tags and without hidden elements, one pattern of these after the other; names as in ``unescape``."""
    for own in hidden:
        html = F.regexp_replace(html, rf"(?isu)<({own})\b.*?</\1>", " ")
    return unescape(F.regexp_replace(html, "<[^>]+>", " "), names)


def clean(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def first_heading(html: Column) -> Column:
    """Inner HTML of the first h1, all tags gone but em."""
    return collapse(F.regexp_replace(found(html, r"(?is)<h1[^>]*>(.*?)</h1>"), r"(?i)<(?!/?em\b)[^>]+>", ""))


# the patterns are fixed values
def field(html: Column, css_class: str) -> Column:
    """Text of the first element with the class."""
    return clean(found(html, rf"""(?is)<\w+[^>]*class=["'][^"']*\b{re.escape(css_class)}\b[^"']*["'][^>]*>(.*?)</"""))


# the patterns are fixed values
def split_reader(html: Column) -> Column:
    """Struct of raw (folded transcript, without summaries) and clean (all else); null if there is no transcript."""
    fold = r"""(?is)<details[^>]*class="[^"]*raw-transcript[^"]*"[^>]*>(.*?)</details>"""
    raw = F.array_join(found_all(html, fold, 1), "\n")
    return F.when(html.rlike(fold), F.struct(strip_tags(F.regexp_replace(raw, r"(?is)<summary\b.*?</summary>", " ")).alias("raw"), strip_tags(F.regexp_replace(html, fold, " ")).alias("clean")))


# the patterns are fixed values
def link_text(inner: Column, names: tuple[str, ...] | None = None, space: str = r"(?U:\s)") -> Column:
    """Links as [text](href), other tags gone, and space at both ends; names as in ``unescape``."""
    linked = F.regexp_replace(inner, r'(?s)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    return F.regexp_replace(unescape(F.regexp_replace(linked, "<[^>]+>", ""), names), rf"^{space}+|{space}+\z", "")


def anchor_key(text: Column) -> Column:
    return F.left(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(45))


# fixed values: image links and images, text blocks
IMAGE = r'<a\b[^>]*class="[^"]*image-link[^"]*"[^>]*>|<img\b[^>]*>'
BLOCK = r"(?s:<(h[1-6]|p|blockquote|li|figcaption)[^>]*>(.*?)</\1>)"


def events(segment: Column, images: bool = True, names: tuple[str, ...] | None = None, space: str = r"(?U:\s)") -> Column:
    """array<struct<kind, value, raw>> in document order: images (full size before plain) and text blocks.

    Without images, blocks are found within image tags as well; names and space as in ``link_text``."""
    block = r"(?s)^<(h[1-6]|p|blockquote|li|figcaption)[^>]*>(.*)</\1>$"

    def read(raw: Column) -> Column:
        href, src = unescape(found(raw, r'href="([^"]+)"'), names), unescape(found(raw, r'src="([^"]+)"'), names)
        is_link, is_img = raw.rlike(r"^<a\b"), raw.rlike(r"^<img\b")
        value = F.when(is_link, href).when(is_img, F.when(~src.startswith("data:"), src)).otherwise(F.nullif(link_text(F.regexp_extract(raw, block, 2), names, space), F.lit("")))
        return F.struct(F.when(is_link | is_img, "img").otherwise("text").alias("kind"), value.alias("value"), raw.alias("raw"))

    return F.filter(F.transform(found_all(segment, f"{IMAGE}|{BLOCK}" if images else BLOCK), read), lambda e: e["value"].isNotNull())


def content_segment(html: Column, marker: str, most: int = 600_000) -> Column:
    """From the marker's first place, else from article or main, else all; at most so many characters."""
    at = F.when(F.instr(html, marker) > 0, F.instr(html, marker)).otherwise(F.greatest(F.regexp_instr(html, F.lit("<article|<main")), F.lit(1)))
    return F.substr(html, at, F.lit(most))


# the patterns are fixed values
def image_id(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    return F.coalesce(found(url, r"images%2F([0-9a-fA-F-]{6,})"), found(url, r"/([0-9a-fA-F]{8,})[._]"), F.nullif(last, F.lit("")), F.right(url, F.lit(40)))


def image_variant(w: Column, h: Column) -> Column:
    return F.when((w <= 0) | (h <= 0), "wide").when(w / h >= 1.8, "banner").when(w / h < 0.8, "portrait").when(F.least(w, h) < 500, "square").otherwise("wide")


# the patterns are fixed values
def image_extension(url: Column, content_type: Column) -> Column:
    kind = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    named = F.replace(F.lower(found(url, r"(?i)\.(png|jpe?g|webp|svg|gif)(?:[?#]|$)")), F.lit("jpeg"), F.lit("jpg"))
    return F.coalesce(F.try_element_at(known, kind), named, F.lit("png"))


def image_name(number: Column, alt: Column, extension: Column) -> Column:
    return F.format_string("%02d_%s.%s", number, slugify(alt, "image", 4), extension)


def accept_download(rc: Column, size: Column, content_type: Column, url: Column) -> Column:
    return (rc == 0) & (size > 0) & (content_type.startswith("image/") | F.lower(url).endswith(".svg"))


def _little(content: Column, at: int, n: int) -> Column:
    return sum((F.conv(F.hex(F.substring(content, at + k, 1)), 16, 10).cast("int") * 256**k for k in range(n)), F.lit(0))


def _webp_size(content: Column) -> Column:
    """Lossy files have 14 bits for each side, lossless ones 14 bits in a row, extended ones three bytes (both less one)."""
    kind, bits = F.hex(F.substring(content, 13, 4)), _little(content, 22, 4).cast("long")
    side = lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    return (
        F.when(kind == "56503820", side(_little(content, 27, 2).bitwiseAND(0x3FFF), _little(content, 29, 2).bitwiseAND(0x3FFF)))
        .when(kind == "5650384C", side(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
        .when(kind == "56503858", side(_little(content, 25, 3) + 1, _little(content, 28, 3) + 1))
        .otherwise(side(F.lit(0), F.lit(0)))
    )


def jpeg_frame(content: bytes | None) -> tuple[int, int]:
    """Width and height in the first frame header, which is reached from segment to segment; zeros if there is none."""
    at, data = 2, content or b""
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        alone = kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8  # padding, and markers without a length
        at += 1 if kind == 0xFF else 2 if alone else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


@F.arrow_udf(T.StructType().add("w", T.IntegerType()).add("h", T.IntegerType()))
def _jpeg_size(content: pa.Array) -> pa.Array:
    return pa.array([dict(zip("wh", jpeg_frame(c.as_py()))) for c in content], pa.struct([("w", pa.int32()), ("h", pa.int32())]))


def image_size(content: Column) -> Column:
    """Struct of w and h in pixels from the headers of PNG, GIF, WebP and JPEG files and the attributes of SVG; 0 and 0 if unknown."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    swapped = lambda at: F.conv(F.concat(F.hex(F.substring(content, at + 1, 1)), F.hex(F.substring(content, at, 1))), 16, 10).cast("int")
    svg = F.left(F.decode(content, "ISO-8859-1"), F.lit(2000))
    box = F.split(found(svg, r"""(?i)viewBox=["']([^"']+)["']"""), r"[\s,]+")
    attr = lambda name: found(svg, rf"""(?i)<svg[^>]*\b{name}=["'](\d+)""").try_cast("int")
    side = lambda k, name, default: F.coalesce(F.get(box, F.lit(k)).try_cast("double").cast("int"), attr(name), F.lit(default))
    at = lambda k: F.hex(F.substring(content, k, 4))
    return (
        F.when((at(1) == "52494646") & (at(9) == "57454250"), _webp_size(content))
        .when(at(1).startswith("FFD8"), _jpeg_size(F.when(at(1).startswith("FFD8"), content)))
        .when(F.hex(F.substring(content, 1, 4)) == "89504E47", F.struct(number(17, 4).alias("w"), number(21, 4).alias("h")))
        .when(F.hex(F.substring(content, 1, 4)) == "47494638", F.struct(swapped(7).alias("w"), swapped(9).alias("h")))
        .when(svg.rlike("(?i)<svg"), F.struct(side(2, "width", 1200).alias("w"), side(3, "height", 600).alias("h")))
        .otherwise(F.struct(F.lit(0).alias("w"), F.lit(0).alias("h")))
    )

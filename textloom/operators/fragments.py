"""HTML fragments of reader pages and of the catalog, as column expressions over fixed forms.

A form is text with ``{names}``; :func:`fill` puts columns in their places.
Lists of fragments are arrays of structs, rendered in their order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import escape

# fixed values: the forms
CONTRARIAN_ITEM = '<div class="contrarian-item"><p class="contrarian-quote">“{quote}”</p><p class="contrarian-why"><strong>为什么非共识 · </strong>{why}</p></div>'
CONTRARIAN = '<section class="contrarian"><div class="contrarian-label">🔥 非共识 · Contrarian Takes</div>{items}</section>'
RAW = '<details class="raw-transcript"><summary>展开逐字原稿（{n} 段）</summary>{turns}</details>'
CHAPTER = '<section class="chapter" id="ch{num}"><div class="ch-num">Chapter {two}</div><h2>{en}</h2><div class="ch-zh">{zh}</div><div class="ch-range">{start} — {end} · {keywords}</div>{body}{raw}</section>'
TOC_ITEM = '<li><a href="#ch{num}">{two} · {zh}</a></li>'
HERO = '<div class="hero-eyebrow">{podcast} · {date} · 中文整理</div><h1>{en}</h1><div class="hero-zh">{zh}</div><div class="hero-lede">“{quote}”<br><br>{background}</div><div class="hero-meta">{note}</div>'
TLDR_ITEM = '<li><p class="tldr-claim">{claim}</p><p class="tldr-explain">{explain}</p></li>'
POSTER = """<article class="poster-card">
  <a class="poster-card-img" href="{poster}" aria-label="放大预览">
    <img src="{poster}" loading="lazy" alt="">
    <span class="poster-card-badge">📷 {date}</span>
  </a>
  <div class="poster-card-body">
    <div class="poster-card-source">{source}</div>
    <a class="poster-card-title" href="{href}"><h3>{title}</h3></a>
    {zh}
  </div>
</article>"""
OG = """<meta property="og:type" content="{kind}">
  <meta property="og:site_name" content="{site}">
  <meta property="og:title" content="{title}">
  <meta property="og:description" content="{description}">
  <meta property="og:image" content="{image}">
  <meta property="og:url" content="{url}">
  <meta name="twitter:card" content="summary_large_image">
  <meta name="twitter:title" content="{title}">
  <meta name="twitter:description" content="{description}">
  <meta name="twitter:image" content="{image}">"""


def fill(form: str, **values: Column) -> Column:
    """The form with each {name} replaced by its column; null columns leave nothing."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def each(items: Column, render) -> Column:
    """All items rendered and joined; nothing for no array."""
    return F.coalesce(F.array_join(F.transform(items, render), ""), F.lit(""))


def contrarian(items: Column) -> Column:
    """items: array<struct<quote, why>>; nothing if there are none."""
    own = each(items, lambda c: fill(CONTRARIAN_ITEM, quote=escape(c["quote"]), why=escape(c["why"])))
    return F.when(own != "", fill(CONTRARIAN, items=own)).otherwise("")


def two_digits(number: Column) -> Column:
    return F.format_string("%02d", number)


def chapter(c: Column, end: Column, body: Column, raw_turns: Column, n_raw: Column) -> Column:
    """c: struct<num, en_title, zh_title, start_ts, keywords>; end: the stamp it ends at; body and raw_turns: fragments of turns."""
    raw = F.when(n_raw > 0, fill(RAW, n=n_raw.cast("string"), turns=raw_turns)).otherwise("")
    tail = lambda stamp: F.substr(stamp, F.lit(4), F.length(stamp))
    return fill(
        CHAPTER, num=c["num"].cast("string"), two=two_digits(c["num"]), en=escape(c["en_title"]), zh=escape(c["zh_title"]), start=tail(c["start_ts"]), end=tail(end),
        keywords=escape(F.array_join(F.coalesce(c["keywords"], F.array().cast("array<string>")), " · ")), body=body, raw=raw,
    )


def toc(chapters: Column) -> Column:
    """chapters: array<struct<num, zh_title, ..>> in order."""
    return each(chapters, lambda c: fill(TOC_ITEM, num=c["num"].cast("string"), two=two_digits(c["num"]), zh=escape(c["zh_title"])))


def hero(h: Column, podcast: Column, date: Column, note: Column) -> Column:
    """h: struct<en_title, zh_summary, lede_quote, lede_bg>."""
    return fill(HERO, podcast=escape(podcast), date=escape(date), en=escape(h["en_title"]), zh=escape(h["zh_summary"]), quote=escape(h["lede_quote"]), background=escape(h["lede_bg"]), note=note)


def tldr(items: Column) -> Column:
    """items: array<struct<claim, explain>>; bold marks of claims go."""
    return each(items, lambda t: fill(TLDR_ITEM, claim=escape(F.regexp_replace(t["claim"], r"\*\*(.+?)\*\*", "$1")), explain=escape(t["explain"])))


def poster_card(iso: Column, title: Column, zh: Column, href: Column, source: Column, poster: Column) -> Column:
    own = lambda c: escape(c, quotes=True)
    date = F.concat_ws("—", F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2))
    block = F.when(F.coalesce(zh, F.lit("")) != "", F.concat(F.lit('<div class="poster-card-zh">'), own(zh), F.lit("</div>"))).otherwise("")
    return fill(POSTER, poster=own(poster), date=date, source=own(source), href=own(href), title=title, zh=block)


def og_meta(title: Column, description: Column, image: Column, url: Column, site: Column, kind: str = "website") -> Column:
    own = lambda c: escape(c, quotes=True)
    return fill(OG, kind=F.lit(kind), site=own(site), title=own(title), description=own(description), image=own(image), url=own(url))

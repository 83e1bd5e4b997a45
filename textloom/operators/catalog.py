"""The tagged catalog, the manifest of additions, hot-word tables, and HTML fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.html import clean, field, first_heading, meta_content
from textloom.functions.text import escape, mark_uncertain, parse_filename

# fixed values
FORMATS = {
    "lennys-podcast": "podcast", "20vc": "podcast", "dwarkesh-podcast": "podcast", "naval-podcast": "podcast", "training-data": "podcast", "sales-podcast": "podcast",
    "y-combinator": "talk", "ai-summit": "talk", "sequoia": "talk", "anthropic-blog": "essay", "naval-blog": "essay", "andrew-chen": "essay", "paul-graham": "essay", "pmarchive": "essay",
}
TOPICS = {
    "agent": ["agent", "agentic", "/loop", "loops", "claude code", "harness", "sub-agent"],
    "coding": ["coding", "code", "developer", "programmer", "software engineer"],
    "growth": ["growth", "arr", "ltv", "cac", "retention", "churn", "scale"],
    "product": ["product", "pm", "product manager", "ship", "shipping"],
    "ai-models": ["model", "gpt", "claude", "opus", "sonnet", "haiku", "llm", "foundation", "training"],
    "philosophy": ["philosophy", "specific knowledge", "leverage", "wealth", "free", "wisdom", "naval"],
    "leadership": ["team", "org", "leadership", "manager", "founder", "ceo"],
    "design": ["design", "designer", "ux", "ui"],
    "business": ["saas", "startup", "moat", "powers", "business", "revenue", "pricing"],
    "infra": ["infra", "infrastructure", "system", "architecture", "database", "sql"],
}
FORMAT_ORDER = ("podcast", "essay", "talk")
MAX_WORD_BYTES, MAX_WORD_CJK, MAX_TABLE_WORDS, MIN_WEIGHT, MAX_WEIGHT, DEFAULT_WEIGHT = 30, 10, 5000, 1, 10, 4


def topic_tags(text: Column, topics: dict[str, list[str]] = TOPICS, most: int = 3) -> Column:
    """The topics with the most keywords in the text, of ties in the table's order."""
    low = F.lower(text)
    score = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    scored = F.array(*[F.struct((-score(words)).alias("rank"), F.lit(i).alias("order"), F.lit(t).alias("topic")) for i, (t, words) in enumerate(topics.items())])
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["rank"] < 0)), 1, most), lambda s: s["topic"])


def infer_tags(text: Column, source: Column, topics: dict[str, list[str]] = TOPICS, formats: dict[str, str] = FORMATS) -> Column:
    """The source's format, then the topics."""
    known = F.create_map(*[F.lit(x) for pair in formats.items() for x in pair])
    return F.concat(F.array_compact(F.array(F.try_element_at(known, source))), topic_tags(text, topics))


def parse_entries(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """One row for each page whose file name has the catalog's form and that isn't excluded."""
    own = pages.where(~F.col(path).rlike(r"(^|/)(index|posters)\.html$|-poster\.html$|(^|/)(images|\.vercel|node_modules)/"))
    name = F.element_at(F.split(path, "/"), -1)
    own = own.withColumn("__f", parse_filename(name)).where("__f is not null")
    heading = F.coalesce(F.nullif(first_heading(F.col(html)), F.lit("")), F.initcap(F.replace(F.col("__f.rest"), F.lit("-"), F.lit(" "))))
    zh, eyebrow = field(F.col(html), "zh-title"), field(F.col(html), "eyebrow")
    explicit = F.transform(F.split(meta_content(F.col(html), "name", "tags"), ","), lambda x: F.trim(x))
    inferred = infer_tags(F.concat_ws(" ", clean(heading), zh, eyebrow), F.col("__f.source"))
    return own.select(
        F.col(path).alias("href"), F.col("__f.date").alias("iso"), F.col("__f.source").alias("source"), heading.alias("title"), zh.alias("zh"), eyebrow.alias("eyebrow"),
        F.coalesce(explicit, inferred).alias("tags"), F.when(F.col(path).contains("/"), F.element_at(F.split(path, "/"), -2)).alias("collection"),
    )


def merge_manifest(entries: DataFrame, manifest: DataFrame, birth: Column, key: str = "href") -> tuple[DataFrame, DataFrame]:
    """Entries with the date they were added (the manifest's, else their birth), and the manifest with the new ones; it is never overwritten."""
    known = manifest.select(key, F.col("added").alias("__known"))
    dated = entries.withColumn("__birth", birth).join(known, key, "left").withColumn("added", F.coalesce("__known", "__birth"))
    new = dated.where("__known is null").groupBy(key).agg(F.min("__birth").alias("added"))
    return dated.drop("__birth", "__known"), manifest.select(key, "added").unionByName(new)


def catalog_order(entries: DataFrame, iso: str = "iso", scan: str = "scan_no") -> DataFrame:
    return entries.orderBy(F.col(iso).desc(), scan)


def year_separators(entries: DataFrame, by: list[str], iso: str = "iso", scan: str = "scan_no") -> DataFrame:
    """Adds new_year: whether a row's year differs from the row before it in catalog order; by: what is listed apart (at least a constant)."""
    year = F.substring(iso, 1, 4)
    w = Window.partitionBy(*by).orderBy(F.col(iso).desc(), scan)
    return entries.withColumn("new_year", F.coalesce(year != F.lag(year).over(w), F.lit(True)))


def tag_counts(entries: DataFrame, tags: str = "tags", scan: str = "scan_no") -> DataFrame:
    """(tag, n, kind, rank): formats in their order, then topics by count, of ties the first seen."""
    n = entries.select(scan, F.posexplode(tags).alias("k", "tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct(scan, "k")).alias("first"))
    place = F.array_position(F.array(*map(F.lit, FORMAT_ORDER)), F.col("tag"))
    n = n.withColumn("kind", F.when(place > 0, "format").otherwise("topic"))
    order = Window.orderBy(F.col("kind"), F.when(place > 0, place).otherwise(-F.col("n")), "first")  # a row for each tag
    return n.select("tag", "n", "kind", F.row_number().over(order).alias("rank"))


def with_poster(entries: DataFrame, poster: str = "poster") -> DataFrame:
    return entries.where(F.col(poster).isNotNull())


def client_order(entries: DataFrame, mode: str = "iso", tag: str | None = None, iso: str = "iso", added: str = "added", scan: str = "scan_no") -> DataFrame:
    """Entries of a tag (all, without one) by date or by when they were added, with their rank and, by date only, whether a year begins."""
    own = entries if tag is None else with_tag(entries, tag)
    by = F.col(iso if mode == "iso" else added).desc_nulls_last()
    order = Window.orderBy(by, scan)  # the catalog of one site
    year = F.substring(iso, 1, 4)
    begins = F.coalesce(year != F.lag(year).over(order), F.lit(True)) if mode == "iso" else F.lit(False)
    return own.withColumn("rank", F.row_number().over(order)).withColumn("new_year", begins)


def with_tag(entries: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return entries.where(F.array_contains(tags, tag))


def latest_card(entries: DataFrame, default: str, iso: str = "iso", scan: str = "scan_no", card: str = "card") -> DataFrame:
    """One row: the first card in catalog order."""
    return entries.where(F.col(card).isNotNull()).agg(F.coalesce(F.max_by(card, F.struct(F.col(iso), -F.col(scan))), F.lit(default)).alias("card"))


def parse_hotword(line: Column) -> Column:
    """Struct of word and weight; null for blank lines."""
    own = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    bar = F.instr(own, "|")
    weight = F.trim(F.substr(own, bar + 1, F.length(own))).try_cast("int")
    return F.when(own != "", F.struct(F.when(bar > 0, F.trim(F.substr(own, F.lit(1), bar - 1))).otherwise(own).alias("word"), F.when(bar > 0, weight).alias("weight")))


def parse_hotwords(lines: DataFrame, line: str = "value", ord_: str = "ord") -> DataFrame:
    """(ord, word, weight): the first line of each word."""
    rows = lines.select(F.col(ord_).alias("ord"), parse_hotword(F.col(line)).alias("p")).where("p.word <> ''")
    return rows.groupBy("p.word").agg(F.min_by(F.struct("ord", "p.weight"), "ord").alias("f")).select("f.ord", "word", "f.weight")


def hotword_fault(word: Column, weight: Column) -> Column:
    """Why a word is refused; null if it isn't."""
    cjk = F.length(F.regexp_replace(word, "[^一-鿿]", ""))
    return (
        F.when(F.coalesce(word, F.lit("")) == "", "empty").when(F.octet_length(word) > MAX_WORD_BYTES, "bytes").when(cjk > MAX_WORD_CJK, "cjk")
        .when(weight.isNotNull() & ~weight.between(MIN_WEIGHT, MAX_WEIGHT), "weight").when(word.rlike(r"[^\p{L}\p{N}\s]"), "symbol")
    )


def hotword_warning(word: Column) -> Column:
    return word.rlike("[0-9]")


def hotword_content(words: DataFrame) -> DataFrame:
    """One row: the table as text, without a last line break. A table has at most MAX_TABLE_WORDS words."""
    line = F.concat_ws("|", "word", F.col("weight").cast("string"))
    return words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda s: s["line"]), "\n").alias("content"))


def hotword_add(table: DataFrame, new: DataFrame, weight: int = DEFAULT_WEIGHT, most: int | None = None) -> DataFrame:
    """The table with new words (ord, word, weight) after its own; words that are there stay as they are. Of over ``most`` words it is refused."""
    fresh = new.join(table.select("word"), "word", "left_anti")
    last = table.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))  # one row
    fresh = fresh.crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("ord")).cast(table.schema["ord"].dataType).alias("ord"), "word", F.coalesce("weight", F.lit(weight)).alias("weight"))
    out = table.select("ord", "word", "weight").unionByName(fresh)
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"a table has at most {most} words")
    return out


def hotword_upload(table: DataFrame | None, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """The new words as a table of their own: all of them must be fit, and a table that is there is replaced only if asked for."""
    if table is not None and not overwrite:
        raise ValueError("the table is there already")
    faults = new.withColumn("fault", hotword_fault(F.col("word"), F.col("weight"))).where("fault is not null").limit(1).collect()
    if faults:
        raise ValueError(f"{faults[0]['word']!r} is refused: {faults[0]['fault']}")
    return new.select("ord", "word", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"))


def whole_preview(preview: DataFrame, count: int) -> DataFrame:
    """The preview of a table, refused if it is shorter than the table: what isn't shown would be lost by writing it back."""
    shown = preview.count()
    if shown < count:
        raise ValueError(f"the preview shows {shown} of {count} words")
    return preview


def hotword_delete(table: DataFrame, words: DataFrame, must: bool = False) -> DataFrame:
    """The table without the words; must: refused if it has none of them."""
    if must and table.join(words.select("word"), "word", "left_semi").isEmpty():
        raise ValueError("none of the words is in the table")
    return table.join(words.select("word"), "word", "left_anti").select("ord", "word", "weight")


def over_capacity(table: DataFrame, most: int = MAX_TABLE_WORDS) -> DataFrame:
    return table.agg((F.count("*") > most).alias("over"))


def resolve_table(tables: DataFrame, name: str) -> DataFrame:
    """The first table with this id or name."""
    return tables.where((F.col("table_id") == name) | (F.col("table_name") == name)).orderBy("ord").limit(1)


def rank_matches(posts: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Posts by how many of the query's words (over two characters) their slug and title contain; the top of them."""
    words = [w for w in query.lower().split() if len(w) > 2]
    hay = F.lower(F.concat_ws(" ", "slug", "title"))
    score = sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0))
    return posts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("slug"), F.desc("title")).limit(most)


def merge_posts(posts: DataFrame) -> DataFrame:
    """(slug, title) of posts (slug, title, priority): the title of the highest priority that has one."""
    return posts.groupBy("slug").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("priority"))).alias("title"))


def archive_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(slug, title, priority) of the posts that archive pages name: in their data, with a title, or by a link alone."""
    from textloom.sources.readers import embedded_json

    posts = F.from_json(F.get_json_object(embedded_json(F.col(html)), "$.posts"), "array<struct<slug:string,title:string>>")
    named = pages.select(F.explode(posts).alias("p")).select("p.slug", "p.title", F.lit(2).alias("priority"))
    links = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r"/p/([\w-]+)"), F.lit(1)))).alias("slug"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("priority"))
    return named.where("slug is not null").unionByName(links)


def choose_track(tracks: DataFrame, priority: list[str], id_: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The track of each document whose language comes first in the list."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(lang))
    return tracks.where(rank > 0).groupBy(id_).agg(F.min_by(lang, rank).alias("track"))


def turn_html(role: Column, name: Column, stamp: Column, paras: Column) -> Column:
    body = F.array_join(F.transform(paras, lambda p: F.concat(F.lit('<p class="zh">'), mark_uncertain(escape(p)), F.lit("</p>"))), "")
    return F.concat(
        F.lit('<div class="turn"><div class="turn-head"><span class="speaker" data-role="'), role, F.lit('">'), escape(name), F.lit('</span><span class="timestamp">'), stamp,
        F.lit('</span></div><div class="turn-body">'), body, F.lit("</div></div>"),
    )


def entry_html(href: Column, title: Column, iso: Column, tags: Column) -> Column:
    return F.concat(F.lit('<li data-date="'), iso, F.lit('" data-tags="'), F.array_join(tags, " "), F.lit('"><a href="'), escape(href, quotes=True), F.lit('">'), title, F.lit("</a></li>"))


def join_fragments(df: DataFrame, by: list[str], order: str, fragment: str, name: str = "html") -> DataFrame:
    """Fragments of each group in order, joined."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(fragment).alias("x")))), lambda s: s["x"]), "").alias(name))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Struct of html and whether placeholders are left; what is before DOCTYPE and after the end goes."""
    out = F.regexp_replace(F.regexp_replace(template, r"(?is)^.*?(?=<!DOCTYPE)", ""), r"(?is)(</html>).*$", "$1")
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return F.struct(out.alias("html"), out.rlike(r"\{\{[A-Z_]+\}\}").alias("left_over"))


def linked_entries(index: Column) -> Column:
    """How many entries an index page links to."""
    return F.regexp_count(index, F.lit(r'<li class="entry[ "]'))


def topic_table(spark: SparkSession, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    return spark.createDataFrame([(i, t, w) for i, (t, ws) in enumerate(topics.items()) for w in ws], "ord int, topic string, keyword string")

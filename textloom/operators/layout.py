"""Page layout: repeated headers, columns, paragraphs, tables, notices, document metadata.

Lines are rows (doc_id, page, line_no, x0, y0, x1, y1, text, font_size); pages
are rows (doc_id, page, width, height, has_fonts, raw_text). Windows are by
page; what spans pages is an aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import find_cover_date, find_org_name, fold_lines, is_junk_title, norm_running, parse_pdf_date, slugify, strip_zero_width

PAGE = ["doc_id", "page"]
# fixed values: shares, ratios and sizes in points
TEXT_CHARS, TEXT_RATIO, SCAN_RATIO = 50, 0.8, 0.2
BAND, REPEATED, MIN_PAGES = 0.08, 0.6, 4
WIDE, PER_COLUMN, GUTTER = 0.40, 3, 8.0
LINE_GAP, TALL = 1.3, 1.12
#: Pages whose boxes may be broadcast.
MOST_PAGES = 10_000


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", strip_zero_width(F.col("text"))).where("text <> ''")


def page_has_text(text: Column, least: int = TEXT_CHARS) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) >= least


def text_ratio(pages: DataFrame, id_: str = "doc_id", text: str = "raw_text", least: int = TEXT_CHARS) -> DataFrame:
    """(id, n_pages, text_ratio, mode)."""
    out = pages.groupBy(id_).agg(F.count("*").alias("n_pages"), F.avg(page_has_text(F.col(text), least).cast("int")).alias("text_ratio"))
    ratio = F.col("text_ratio")
    return out.withColumn("mode", F.when(ratio >= TEXT_RATIO, "text").when(ratio <= SCAN_RATIO, "scanned").otherwise("mixed"))


def probe_access(pages: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, access): ok with any text, perm_locked with fonts but no text, else scanned."""
    some = pages.groupBy(id_).agg(F.bool_or(page_has_text(F.col("raw_text"))).alias("t"), F.bool_or("has_fonts").alias("f"))
    return some.select(id_, F.when(F.col("t"), "ok").when(F.col("f"), "perm_locked").otherwise("scanned").alias("access"))


def run_status(pages: DataFrame, info: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, access, mode, text_ratio, exit_code): 2 encrypted or not a document of this kind, 3 locked, scanned or with a page without text, else 0."""
    out = info.join(probe_access(pages, id_), id_, "left").join(text_ratio(pages, id_), id_, "left")
    bad = F.coalesce(F.col("encrypted"), F.lit(False)) | ~F.coalesce(F.col("is_pdf"), F.lit(True)) if "is_pdf" in info.columns else F.coalesce(F.col("encrypted"), F.lit(False))
    return out.select(id_, "access", "mode", "text_ratio", F.when(bad, 2).when((F.col("access") != "ok") | (F.col("text_ratio") < 1), 3).otherwise(0).alias("exit_code"))


def in_band(y0: Column, y1: Column, height: Column, share: float = BAND) -> Column:
    """Wholly in the top or the bottom band."""
    return (y1 <= height * share) | (y0 >= height * (1 - share))


def repeated_lines(lines: DataFrame, id_: str = "doc_id", page: str = "page", text: str = "text", share: float = REPEATED, min_pages: int = MIN_PAGES, pages: DataFrame | None = None) -> DataFrame:
    """(id, norm, n_on, n_pages): texts, but for their numbers, on at least so many of a document's pages."""
    norm = lines.select(id_, page, norm_running(F.col(text)).alias("norm")).distinct()
    total = (lines if pages is None else pages).select(id_, page).distinct().groupBy(id_).agg(F.count("*").alias("n_pages"))
    counted = norm.groupBy(id_, "norm").agg(F.count("*").alias("n_on")).join(total, id_)
    return counted.where((F.col("n_pages") >= min_pages) & (F.col("n_on") >= F.col("n_pages") * share))


def find_repeated_headers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, norm) of running headers and footers."""
    sized = lines.join(pages.select(*PAGE, "height"), PAGE)
    banded = sized.where(in_band(F.col("y0"), F.col("y1"), F.col("height")))
    return repeated_lines(banded, pages=pages).select("doc_id", "norm")


def find_ubiquitous(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, norm) of texts repeated anywhere on the pages, such as watermarks."""
    return repeated_lines(lines, min_pages=2, pages=pages).select("doc_id", "norm")


def drop_headers(lines: DataFrame, pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines without those that are repeated and in a band; equal lines in the body stay."""
    sized = lines.join(pages.select(*PAGE, "width", "height"), PAGE).withColumn("norm", norm_running(F.col("text"))).withColumn("band", in_band(F.col("y0"), F.col("y1"), F.col("height")))
    marked = sized.join(headers.withColumn("__h", F.lit(True)), ["doc_id", "norm"], "left")
    return marked.where(~(F.col("band") & F.coalesce("__h", F.lit(False)))).drop("norm", "__h")


def find_gap(intervals: DataFrame, by: list[str], x0: str = "x0", x1: str = "x1", each: int = PER_COLUMN, least: float = GUTTER) -> DataFrame:
    """(by, gap, middle): the widest gap between intervals, with so many on each side; of equals the leftmost."""
    w = Window.partitionBy(*by).orderBy(x0, x1)
    cut = intervals.select(*by, F.row_number().over(w).alias("k"), F.max(x1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("left"), F.lead(x0).over(w).alias("right"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    cut = cut.where((F.col("k") >= each) & (F.col("n") - F.col("k") >= each) & (F.col("right") - F.col("left") >= least))
    best = cut.groupBy(*by).agg(F.max_by(F.struct("left", "right"), F.struct(F.col("right") - F.col("left"), -F.col("k"))).alias("b"))
    return best.select(*by, (F.col("b.right") - F.col("b.left")).alias("gap"), ((F.col("b.left") + F.col("b.right")) / 2).alias("middle"))


def find_gutter(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) of pages with two columns."""
    sized = lines.join(pages.select(*PAGE, "width", "height"), PAGE)
    narrow = sized.where(~in_band(F.col("y0"), F.col("y1"), F.col("height")) & (F.col("x1") - F.col("x0") <= F.col("width") * WIDE))
    found = find_gap(narrow, PAGE).join(pages.select(*PAGE, "width"), PAGE)
    return found.where((F.col("middle") > F.col("width") * 0.25) & (F.col("middle") < F.col("width") * 0.75)).select(*PAGE, F.col("middle").alias("gutter"))


def reading_order(lines: DataFrame, gutters: DataFrame) -> DataFrame:
    """Adds order_no. Two columns: lines across the gutter cut the page into bands; in each, first these, then left, then right."""
    own = lines.join(gutters, PAGE, "left")
    across = F.col("gutter").isNotNull() & (F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter"))
    own = own.withColumn("__class", F.when(F.col("gutter").isNull() | across, 0).when(F.col("x1") <= F.col("gutter"), 1).otherwise(2)).withColumn("__cut", across.cast("int"))
    w = Window.partitionBy(*PAGE).orderBy("y0", F.col("__cut").desc(), "line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__band", F.sum("__cut").over(w))
    # all lines of one height share the band of the last cut at that height
    own = own.withColumn("__band", F.max("__band").over(Window.partitionBy(*PAGE, "y0")))
    single = F.col("gutter").isNull()
    order = Window.partitionBy(*PAGE).orderBy(F.when(single, 0).otherwise(F.col("__band")), "__class", F.when(single, F.bround("y0", 1)).otherwise(F.col("y0")), "x0", "line_no")
    return own.withColumn("order_no", F.row_number().over(order)).drop("__class", "__cut", "__band", "gutter")


def paragraphs(lines: DataFrame, by: list[str] = PAGE, order: str = "order_no") -> DataFrame:
    """(by, para_no, text): a new paragraph where the place jumps back, the gap is wide, or the height of lines changes."""
    w = Window.partitionBy(*by).orderBy(order)
    own = lines.withColumn("__dy", F.col("y0") - F.lag("y0").over(w)).withColumn("__h", F.col("y1") - F.col("y0"))
    every = Window.partitionBy(*by)
    own = own.withColumn("__gap", F.median(F.when(F.col("__dy") > 0, F.col("__dy"))).over(every)).withColumn("__mid", F.median("__h").over(every))
    own = own.withColumn("__tall", F.col("__h") > F.col("__mid") * TALL)
    breaks = F.col("__dy").isNull() | (F.col("__dy") <= 0) | (F.col("__dy") > F.col("__gap") * LINE_GAP) | (F.col("__tall") != F.lag("__tall").over(w))
    own = own.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn("para_no", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = own.groupBy(*by, "para_no").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "text"))).alias("ls"))
    return grouped.select(*by, "para_no", fold_lines(F.transform("ls", lambda x: x["text"])).alias("text"))


def cover_title(lines: DataFrame, ubiquitous: DataFrame) -> DataFrame:
    """(doc_id, cover_title): the first page's largest line that isn't on all pages; of equals the first."""
    first = lines.join(lines.groupBy("doc_id").agg(F.min("page").alias("page")), PAGE, "left_semi").withColumn("norm", norm_running(F.col("text")))
    own = first.join(ubiquitous, ["doc_id", "norm"], "left_anti")
    return own.where("font_size > 0").groupBy("doc_id").agg(F.max_by("text", F.struct("font_size", -F.col("line_no"))).alias("cover_title"))


def document_metadata(info: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title, publication, author, source_slug, date, source, confidence)."""
    first = pages.groupBy("doc_id").agg(F.min_by("raw_text", "page").alias("cover"))
    own = info.join(first, "doc_id", "left").join(cover_title(lines, find_ubiquitous(lines, pages)), "doc_id", "left")
    title = F.coalesce(F.when(~is_junk_title(F.col("title")), F.trim("title")), F.col("cover_title"))
    cover, made, cover_org = find_cover_date(F.col("cover")), parse_pdf_date(F.col("creation_date")), find_org_name(F.col("cover"))
    author = F.nullif(F.trim("author"), F.lit(""))
    org = F.coalesce(cover_org, author)
    level = lambda best, good: F.when(best, "high").when(good, "medium").otherwise("low")
    return own.select(
        "doc_id", title.alias("title"), org.alias("publication"), author.alias("author"), slugify(org, "pdf").alias("source_slug"), F.coalesce(cover, made).alias("date"),
        F.when(cover.isNotNull(), "pdf:cover").when(made.isNotNull(), "pdf:creation_date").otherwise("none").alias("source"),
        F.create_map(
            F.lit("title"), level(~is_junk_title(F.col("title")), F.col("cover_title").isNotNull()), F.lit("publication"), level(cover_org.isNotNull(), author.isNotNull()),
            F.lit("date"), level(cover.isNotNull(), made.isNotNull()),
        ).alias("confidence"),
    )


def boxes_of(points: DataFrame, boxes: DataFrame, by: list[str], x: str = "x", y: str = "y", box: str = "index") -> DataFrame:
    """Points with the first box (x0, y0, x1, y1, closed) of the same group they lie in, null for none. A group is a page: its boxes are few."""
    listed = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(box).alias("i"), "x0", "y0", "x1", "y1"))).alias("__boxes"))
    inside = F.filter("__boxes", lambda b: F.col(x).between(b["x0"], b["x1"]) & F.col(y).between(b["y0"], b["y1"]))
    few = listed.limit(MOST_PAGES + 1).count() <= MOST_PAGES  # a row for each page that has boxes
    return points.join(F.broadcast(listed) if few else listed, by, "left").withColumn(box, F.get(inside, F.lit(0))["i"]).drop("__boxes")


def table_anchor(page: Column, index: Column) -> Column:
    return F.format_string("[[table:p%d-%d]]", page, index)


def strip_table_lines(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines with each table's lines replaced by one anchor in the place of the first."""
    own = boxes_of(lines.withColumn("__x", (F.col("x0") + F.col("x1")) / 2).withColumn("__y", (F.col("y0") + F.col("y1")) / 2), tables, PAGE, "__x", "__y")
    order = "order_no" if "order_no" in lines.columns else "line_no"
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy(*PAGE, "index").orderBy(order))).where("index is null or __n = 1")
    return own.withColumn("text", F.when(F.col("index").isNotNull(), table_anchor(F.col("page"), F.col("index"))).otherwise(F.col("text"))).drop("__x", "__y", "__n", "index")


def find_notice(pages: DataFrame, pattern: str, id_: str = "doc_id", page: str = "page", text: str = "raw_text") -> DataFrame:
    """(id, cut): the first page in the last third that has a line which is a notice's heading, of documents with two pages or more."""
    place = Window.partitionBy(id_).orderBy(page)
    own = pages.withColumn("__i", F.row_number().over(place)).withColumn("__n", F.count("*").over(Window.partitionBy(id_)))
    return own.where((F.col("__n") >= 2) & (F.col("__i") * 3 > F.col("__n") * 2) & F.col(text).rlike(pattern)).groupBy(id_).agg(F.min(page).alias("cut"))


def cut_notices(pages: DataFrame, notices: DataFrame, id_: str = "doc_id", page: str = "page") -> DataFrame:
    """Pages before the notice."""
    return pages.join(notices, id_, "left").where(F.col("cut").isNull() | (F.col(page) < F.col("cut"))).drop("cut")


def sound_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with a whole box, and (doc_id, page, n_skipped) of pages with others, whose tables are left out with a warning."""
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))
    marked = tables.withColumn("__whole", F.coalesce(whole, F.lit(False)))
    skipped = marked.groupBy(*PAGE).agg(F.count_if(~F.col("__whole")).alias("n_skipped")).where("n_skipped > 0")
    return marked.where("__whole").drop("__whole").join(skipped.select(*PAGE), PAGE, "left_anti"), skipped


def run_report(lines: DataFrame, kept: DataFrame, pages: DataFrame, cut: DataFrame, anchor: str = r"^\[\[table:p\d+-\d+\]\]$") -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_anchors, n_pages, n_cut): all that a run leaves out of a document.

    kept: lines after headers and tables; cut: pages that stay after notices.
    """
    count = lambda df, name, what=F.count("*"): df.groupBy("doc_id").agg(what.alias(name))
    anchors = F.count_if(F.col("text").rlike(anchor))
    out = count(pages, "n_pages").join(count(lines, "n_lines"), "doc_id", "left").join(count(kept, "n_kept"), "doc_id", "left").join(count(kept, "n_anchors", anchors), "doc_id", "left").join(count(cut, "n_left"), "doc_id", "left")
    out = out.fillna(0)
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept") + F.col("n_anchors")).alias("n_dropped"), "n_anchors", "n_pages", (F.col("n_pages") - F.col("n_left")).alias("n_cut"))

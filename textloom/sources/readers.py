"""Scans. Each gives a table with position columns where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import found

VIDEO_FIELDS = ("id", "title", "uploader", "channel", "upload_date", "duration", "description", "webpage_url", "view_count", "thumbnail", "categories", "tags")
EN_TRACKS = ["en-orig", "en", "en-GB", "en-US"]
ZH_TRACKS = ["zh-CN", "zh-Hans", "zh", "ai-zh", "en"]
AUDIO = ["m4a", "mp3", "aac", "webm", "ogg"]


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of whole files."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, value) of the lines of files, numbered within each file."""
    return read_texts(spark, path).select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("ord", "value"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mappings(spark: SparkSession, path: str) -> Column | DataFrame:
    """(variant, term) of the key ``mappings`` of a JSON object."""
    return read_json(spark, path, "mappings map<string,string>").select(F.explode("mappings").alias("variant", "term"))


def read_pdf_flags(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_pdf): by the first five bytes."""
    return spark.read.format("binaryFile").load(path).select("path", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of the catalog's pages."""
    own = read_texts(spark, path, "*.html").withColumnRenamed("text", "html")
    return own.where(~F.col("path").rlike(r"(^|/)(index|posters)\.html$|-poster\.html$|/(images|\.vercel|node_modules)/"))


def video_metadata(dump: Column) -> Column:
    """Struct of named fields of a video's JSON; null where they miss."""
    return F.struct(*[F.get_json_object(dump, f"$.{f}").alias(f) for f in VIDEO_FIELDS])


def embedded_json(html: Column) -> Column:
    """The JSON text that a page passes to JSON.parse as a string literal, decoded once."""
    literal = found(html, r"""(?s)JSON\.parse\(("(?:[^"\\]|\\.)*")\)""")
    return F.get_json_object(F.concat(F.lit('{"x":'), literal, F.lit("}")), "$.x")


def post_url(html: Column) -> Column:
    """Struct of slug and provenance: of the link labelled as transcript, else of the first post."""
    labelled, first = found(html, r"""(?is)Transcript:.{0,300}?/p/([\w-]+)"""), found(html, r"/p/([\w-]+)")
    return F.coalesce(F.when(labelled.isNotNull(), F.struct(labelled.alias("slug"), F.lit("labelled").alias("source"))), F.when(first.isNotNull(), F.struct(first.alias("slug"), F.lit("first").alias("source"))))


def audio_url(html: Column) -> Column:
    """The first of three metas, the JSON content URL, or any audio URL."""
    from textloom.functions.html import find_meta

    return F.coalesce(*[find_meta(html, m) for m in ("og:audio", "og:audio:url", "twitter:player:stream")], found(html, r'"contentUrl"\s*:\s*"([^"]+)"'), found(html, r"""https?://[^\s"'<>]+\.(?:m4a|mp3)""", 0))


def episode_notes(html: Column) -> Column:
    """The longest show notes anywhere in a page's data script."""
    data = found(html, r"""(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>""")
    notes = F.transform(F.regexp_extract_all(data, F.lit(r'"shownotes"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1)), lambda s: F.get_json_object(F.concat(F.lit('{"x":'), s, F.lit("}")), "$.x"))
    return F.array_max(F.transform(notes, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]


def episode(html: Column) -> Column:
    """Struct of title, podcast, date, audio and notes of an episode's page: the page's metas, then what its JSON-LD has instead, then the longest notes in its data."""
    from textloom.functions.html import find_meta, json_text, jsonld_blocks, normalize_date, title

    blocks = jsonld_blocks(html)
    of = lambda read: F.get(F.filter(F.transform(blocks, read), lambda x: x.isNotNull()), F.lit(0))
    field = lambda path: (lambda js: F.nullif(F.trim(F.get_json_object(js, path)), F.lit("")))
    return F.struct(
        F.coalesce(of(lambda js: json_text(js, "name")), find_meta(html, "og:title"), title(html)).alias("title"),
        F.coalesce(of(field("$.partOfSeries.name")), find_meta(html, "og:site_name")).alias("podcast"),
        F.coalesce(of(lambda js: normalize_date(F.get_json_object(js, "$.datePublished"))), normalize_date(find_meta(html, "article:published_time"))).alias("date"),
        F.coalesce(of(field("$.associatedMedia.contentUrl")), audio_url(html)).alias("audio"),
        F.coalesce(episode_notes(html), of(lambda js: json_text(js, "description")), find_meta(html, "og:description")).alias("notes"),
    )


def first_audio(files: DataFrame, id_: str = "doc_id", extension: str = "extension") -> DataFrame:
    """(id, extension): where there is no caption track, the audio file whose kind comes first."""
    rank = F.array_position(F.array(*map(F.lit, AUDIO)), F.lower(extension))
    return files.where(rank > 0).groupBy(id_).agg(F.min_by(extension, rank).alias(extension))


def reject_reason(size: Column, kind: Column) -> Column:
    return F.when((kind == "page") & (size < 500), "page too small").when((kind == "audio") & (size < 100_000), "audio too small")


def named_segments(segments: DataFrame, names: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Segments with the speaker's name from (doc_id, names map)."""
    from textloom.operators.turns import speaker_name

    return segments.join(names, "doc_id", "left").withColumn("name", speaker_name(F.col(speaker), F.coalesce("names", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))).drop("names")

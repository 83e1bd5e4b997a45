"""Speaker turns, captions, and their alignment in time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.automata import BLOCK_KEYS, blocks, places_in
from textloom.functions.text import found, nonempty, norm_words, split_sentences, to_seconds, unescape

# fixed values: the header line of a turn
HEADER = r"^\**\s*Speaker\s+(\d+)\s+(\d{1,2}:\d{2}:\d{2})(?:\.\d+)?\s*\**\s*(.*)$"


def parse_turns(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, turn_no, speaker, ts, sec, paras): turns that begin with a header line; what is before the first goes."""
    lines = F.split(F.col(text), r"\r\n|\n|\r")
    rows = df.select(id_, F.posexplode(lines).alias("pos", "line")).withColumn("own", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    head = F.col("own").rlike(HEADER)
    rows = rows.withColumn("head", head).withColumn("turn_no", F.sum(head.cast("int")).over(Window.partitionBy(id_).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.when(F.col("head"), F.regexp_extract("own", HEADER, 3)).otherwise(F.col("line"))
    grouped = rows.where("turn_no > 0").withColumn("rest", rest).groupBy(id_, "turn_no").agg(
        F.max(F.when(F.col("head"), F.struct(F.regexp_extract("own", HEADER, 1).alias("speaker"), F.regexp_extract("own", HEADER, 2).alias("ts")))).alias("h"),
        F.array_sort(F.collect_list(F.struct("pos", "rest"))).alias("lines"),
    )
    blob = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["rest"]), "\n"), r"(?U)^\s+|\s+$", "")
    paras = F.transform(nonempty(F.transform(F.split(blob, r"\n(?U:\s)*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: F.replace(p, F.lit("**"), F.lit("")))
    return grouped.select(id_, "turn_no", "h.speaker", "h.ts", to_seconds(F.col("h.ts")).cast("int").alias("sec"), paras.alias("paras"))


def islands(df: DataFrame, by: list[str], order: list, value: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run of equal values that a row is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(value.eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def speaker_name(speaker: Column, names: Column) -> Column:
    label = F.coalesce(F.nullif(speaker, F.lit("")), F.lit("SPEAKER_?"))
    return F.coalesce(F.nullif(F.try_element_at(names, label), F.lit("")), label)


def merge_turns(segments: DataFrame, id_: str = "doc_id", seg: str = "seg_no", speaker: str = "speaker", start: str = "start", text: str = "text") -> DataFrame:
    """(id, turn_no, speaker, start, sents): consecutive segments of one speaker; blank ones go first."""
    own = segments.withColumn(text, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")).where(F.col(text) != "")
    run = islands(own, [id_], [seg], F.col(speaker), "turn_no")
    parts = F.array_sort(F.collect_list(F.struct(F.col(seg).alias("k"), F.col(start).alias("start"), split_sentences(F.col(text)).alias("sents"))))
    out = run.groupBy(id_, "turn_no", speaker).agg(parts.alias("parts"))
    return out.select(id_, "turn_no", F.col(speaker).alias("speaker"), F.coalesce(F.col("parts")[0]["start"], F.lit(0.0)).alias("start"), F.flatten(F.transform("parts", lambda p: p["sents"])).alias("sents"))


def chapters_of(turns: DataFrame, chapters: DataFrame, id_: str = "doc_id", sec: str = "sec", start: str = "start_sec") -> DataFrame:
    """Turns with the chapter they begin in; those before the first go.

    Both are put on one time line and the last chapter is carried forward, so
    no turn is compared with chapters.
    """
    kept = [c for c in chapters.columns if c != id_]
    mark = F.struct(*[F.col(c) for c in kept])
    line = turns.select(id_, F.col(sec).cast("double").alias("__t"), F.lit(1).alias("__turn"), F.struct(*[F.col(c) for c in turns.columns]).alias("__row"), F.lit(None).cast(chapters.select(mark.alias("c")).schema["c"].dataType).alias("__c"))
    line = line.unionByName(chapters.select(id_, F.col(start).cast("double").alias("__t"), F.lit(0).alias("__turn"), F.lit(None).cast(line.schema["__row"].dataType).alias("__row"), mark.alias("__c")))
    w = Window.partitionBy(id_).orderBy("__t", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("chapter", F.last("__c", ignorenulls=True).over(w)).where("__turn = 1 and chapter is not null").select("__row.*", "chapter")


def chapter_ends(chapters: DataFrame, turns: DataFrame, id_: str = "doc_id", start: str = "start_ts", sec: str = "start_sec", ts: str = "ts") -> DataFrame:
    """Chapters with their end label: the next one's start, else the last turn's stamp, else their own start; hours of zero go."""
    last = turns.groupBy(id_).agg(F.max_by(ts, "turn_no").alias("__last"))
    end = F.coalesce(F.lead(start).over(Window.partitionBy(id_).orderBy(sec)), F.col("__last"), F.col(start))
    return chapters.join(last, id_, "left").withColumn("end_label", F.regexp_replace(end, r"^\d+:(\d+:\d+)$", "$1")).drop("__last")


def clean_captions(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_chars, n_words): caption lines without headers, numbers, cues and tags; of equal lines only the first."""
    rows = df.select(id_, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    dropped = F.col("line").rlike(r"^WEBVTT|^Kind:|^Language:|-->|^(?U:\d)+$|align:|position:|size:") | (F.col("line") == "")
    rows = rows.where(~dropped).withColumn("line", F.regexp_replace(F.regexp_replace("line", "<[^>]+>", ""), r"(?U)^\s+|\s+$", "")).where("line <> ''")
    first = rows.groupBy(id_, "line").agg(F.min("pos").alias("pos"))
    joined = first.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), " ").alias("text"))
    out = df.select(id_).join(joined, id_, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out.select(id_, "text", F.length("text").alias("n_chars"), F.size(nonempty(F.split("text", r"(?U)\s+"))).alias("n_words"))


def cues(text: Column) -> Column:
    """array<struct<start_sec, words>> of the blocks of a caption file that have a time and words."""
    def read(block: Column) -> Column:
        payload = F.regexp_replace(block, r"^(?s:.*?)(?m:^.*-->.*$)", "")
        payload = F.replace(unescape(F.regexp_replace(payload, "<[^>]+>", "")), F.lit(">>"), F.lit(" "))
        return F.struct(to_seconds(found(block, r"(\d\d:\d\d:\d\d\.\d\d\d)\s*-->")).alias("start_sec"), norm_words(payload, drop_tags=True).alias("words"))

    return F.filter(F.transform(F.split(text, r"\n\n+"), read), lambda c: c["start_sec"].isNotNull() & (F.size(c["words"]) > 0))


def overlap(said: list[str], words: list[str]) -> int:
    """The most words that end ``said`` and begin ``words``, by the borders of prefixes: linear in ``words``."""
    border = [0] * (len(words) + 1)  # border[n]: the longest proper border of the first n words

    def grow(n: int, word: str) -> int:
        while n and (n == len(words) or words[n] != word):
            n = border[n]
        return n + (words[n] == word)

    for i in range(1, len(words)):
        border[i + 1] = grow(border[i], words[i])
    n = 0
    for word in said[max(0, len(said) - len(words)) :]:
        n = grow(n, word)
    return n


def rolled_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The word stream of one file's cues: each cue adds what it doesn't repeat of the end of the stream."""
    stream: list[str] = []
    new: list[int] = []
    for words in pdf["words"].map(list):
        fresh = words[overlap(stream, words) :]
        stream.extend(fresh)
        new.append(len(fresh))
    out = pdf.loc[pdf.index.repeat(new), ["id", "start_sec"]]
    return out.assign(pos=range(len(stream)), word=stream)[["id", "pos", "start_sec", "word"]]


def word_stream(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, start_sec, word) of roll-up captions. A file's cues are its own order, so each file is one group."""
    rows = df.select(F.col(id_).alias("id"), F.posexplode(cues(F.col(text))).alias("cue", "c")).select("id", "cue", "c.*")
    kind = df.schema[id_].dataType.simpleString()
    return rows.groupBy("id").applyInPandas(lambda p: rolled_up(p.sort_values("cue")), f"id {kind}, pos int, start_sec double, word string").withColumnRenamed("id", id_)


def phrase_times(stream: DataFrame, turns: DataFrame, id_: str = "doc_id", turn: str = "turn_no", text: str = "text") -> DataFrame:
    """(id, turn, start_sec): when each turn's first words are said; null if they aren't found.

    A turn's first 8, 6, 5 or 4 words are searched from where the turn before
    was found, else from the start; the place never goes back.
    """
    kind_id, kind_turn = (turns.schema[c].dataType.simpleString() for c in (id_, turn))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("pos"), right.sort_values("turn")
        words, starts = left["word"].tolist(), left["start_sec"].tolist()
        places: dict[tuple, list[int]] = {}
        for k in (8, 6, 5, 4):
            for i in range(len(words) - k + 1):
                places.setdefault(tuple(words[i : i + k]), []).append(i)
        at, out = 0, []
        for own in right["words"]:
            hit = None
            for k in (8, 6, 5, 4):
                key = tuple(own[:k])
                if len(key) < 4:
                    continue
                known = places.get(key) if len(key) in (8, 6, 5, 4) else [i for i in range(len(words) - len(key) + 1) if tuple(words[i : i + len(key)]) == key]
                if known:
                    hit = next((i for i in known if i >= at), known[0])
                    break
            out.append(None if hit is None else starts[hit])
            at = at if hit is None else max(at, hit)
        return pd.DataFrame({"id": right["id"], "turn": right["turn"], "start_sec": pd.array(out, "Float64").astype("float64") if out else []})

    a = stream.select(F.col(id_).alias("id"), "pos", "start_sec", "word")
    b = turns.select(F.col(id_).alias("id"), F.col(turn).alias("turn"), norm_words(F.col(text), drop_tags=True).alias("words"))
    out = a.groupBy("id").cogroup(b.groupBy("id")).applyInPandas(search, f"id {kind_id}, turn {kind_turn}, start_sec double")
    return out.select(F.col("id").alias(id_), F.col("turn").alias(turn), F.expr("nullif(start_sec, double('NaN'))").alias("start_sec"))


def first_places(texts: DataFrame, phrases: DataFrame, n: int = 4, id_: str = "doc_id", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(id, phrase columns, pos): before how many words the first n words of each phrase first occur, in the texts that have them.

    texts: (id, words array), phrases: any columns and a words array; shorter
    ones are in none. Each text is read once for each block of phrases.
    """
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    asked = phrases.where(F.size("words") >= n).withColumn("key", spaced(F.slice("words", 1, n))).drop("words")
    out = None
    for keys in blocks(asked.select("key", F.lit("").alias("value")).distinct(), block_keys):
        own = texts.select(id_, F.explode(places_in(keys)(spaced(F.col("words")))).alias("f")).select(id_, "f.*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = texts.select(id_, F.lit("").alias("key"), F.lit(0).alias("pos")).where("false")
    return out.join(asked, "key").drop("key").select(id_, *[c for c in phrases.columns if c != "words"], "pos")


def with_stamps(turns: DataFrame, times: DataFrame, id_: str = "doc_id", turn: str = "turn_no") -> DataFrame:
    """Turns with the stamp (HH:MM:SS) at which they were found, null for none; a stamp from before is replaced."""
    from textloom.functions.text import to_stamp

    own = times.select(id_, turn, F.when(F.col("start_sec").isNotNull(), to_stamp(F.col("start_sec"))).alias("stamp"))
    return turns.drop("stamp").join(own, [id_, turn], "left")

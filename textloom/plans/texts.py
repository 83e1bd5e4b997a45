"""Queries over documents and conversations: words, gates, captions, layout, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.numerals import numeral
from textloom.operators import coverage, glossary, layout, turns
from textloom.operators.catalog import join_fragments
from textloom.plans.tables import SQL_WORDS, registry, table, values_sql

QUERIES, SQL, query = registry()
LINES_SQL = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents"


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lines(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def reduced(docs: DataFrame) -> DataFrame:
    """source and output: the text, and it without every fifth line."""
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: i % 5 != 4), "\n")
    return docs.select("doc_id", F.col("text").alias("source"), kept.alias("output"))


REDUCED_SQL = "SELECT doc_id, coalesce(text, '') AS source, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: (i - 1) % 5 <> 4), chr(10)) AS output FROM documents"


@query(f"""
SELECT word, count(*) AS n FROM (SELECT unnest({SQL_WORDS.format("coalesce(text, '')")}) AS word FROM documents)
GROUP BY word ORDER BY n DESC, word LIMIT 100""")
def norm_word_freq(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(T.norm_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


COVERAGE_SQL = f"""
WITH r AS ({{r}}),
a AS (SELECT doc_id, word, count(*) AS a FROM (SELECT doc_id, unnest({SQL_WORDS.format("source")}) AS word FROM r) GROUP BY ALL),
b AS (SELECT doc_id, word, count(*) AS b FROM (SELECT doc_id, unnest({SQL_WORDS.format("output")}) AS word FROM r) GROUP BY ALL),
s AS (
  SELECT doc_id, sum(coalesce(a, 0)) AS n, sum(least(coalesce(a, 0), coalesce(b, 0))) AS kept, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0)) AS added
  FROM a FULL JOIN b USING (doc_id, word) GROUP BY doc_id)
SELECT r.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_source, {{columns}}
FROM r LEFT JOIN s USING (doc_id)"""
COV = "CASE WHEN n > 0 THEN kept / CAST(n AS DOUBLE) ELSE 1.0 END"


@query(COVERAGE_SQL.format(r=REDUCED_SQL, columns=f"CAST({COV} AS DOUBLE) AS coverage, {COV} >= CAST(0.98 AS DOUBLE) AS ok"))
def word_coverage(spark, sf_dir):
    return coverage.coverage(reduced(documents(spark, sf_dir))).select("doc_id", "n_source", "coverage", "ok")


@query(COVERAGE_SQL.format(r="SELECT doc_id, coalesce(text, '') AS source, coalesce(text, '') || chr(10) || string_split(coalesce(text, ''), chr(10))[1] AS output FROM documents", columns="CAST(CASE WHEN n > 0 THEN added / CAST(n AS DOUBLE) ELSE 0.0 END AS DOUBLE) AS added_ratio"))
def added_ratio(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("source"), F.concat("text", F.lit("\n"), F.split("text", "\n")[0]).alias("output"))
    return coverage.coverage(docs).select("doc_id", "n_source", "added_ratio")


def line_windows(spark, sf_dir, size: int) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", T.nonempty(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("ls"))
    return docs.select("doc_id", F.posexplode(T.windows(F.col("ls"), size)).alias("window", "ls"))


@query(f"""
WITH l AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM ({LINES_SQL}) WHERE trim(line) <> '')
SELECT doc_id, CAST(k // 25 AS INTEGER) AS "window", CAST(count(*) AS INTEGER) AS n_blocks, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY ALL""")
def window_split(spark, sf_dir):
    return line_windows(spark, sf_dir, 25).select("doc_id", "window", F.size("ls").alias("n_blocks"), F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query(f"""
WITH l AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM ({LINES_SQL}) WHERE trim(line) <> ''),
src AS (SELECT doc_id, CAST(k // 5 AS INTEGER) AS w, string_agg(line, ' ' ORDER BY k) AS t FROM l GROUP BY ALL),
r AS ({REDUCED_SQL}),
sw AS (SELECT doc_id, w, {SQL_WORDS.format("t")} AS words FROM src),
o AS (SELECT doc_id, {SQL_WORDS.format("output")} AS words FROM r),
ow AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM o),
p AS (
  SELECT sw.doc_id, w, sw.words, sum(len(sw.words)) OVER (PARTITION BY sw.doc_id ORDER BY w) AS b, len(sw.words) AS size,
         sum(len(sw.words)) OVER (PARTITION BY sw.doc_id) AS total, len(o.words) AS n FROM sw JOIN o ON o.doc_id = sw.doc_id),
q AS (SELECT *, CAST(floor((b - size) * n / greatest(total, 1)) AS BIGINT) AS lo0, CAST(floor(b * n / greatest(total, 1)) AS BIGINT) AS hi0 FROM p),
z AS (SELECT *, greatest(lo0 - greatest(20, (hi0 - lo0) // 2), 0) AS lo, least(hi0 + greatest(20, (hi0 - lo0) // 2), n) AS hi FROM q),
a AS (SELECT doc_id, w, lo, hi, word, count(*) AS a FROM (SELECT doc_id, w, lo, hi, unnest(words) AS word FROM z) GROUP BY ALL),
c AS (SELECT a.doc_id, a.w, a.word, a.a, count(ow.pos) AS b FROM a LEFT JOIN ow ON ow.doc_id = a.doc_id AND ow.word = a.word AND ow.pos >= a.lo AND ow.pos < a.hi GROUP BY ALL),
s AS (SELECT doc_id, w, sum(least(a, b)) AS kept, sum(a) AS n FROM c GROUP BY ALL)
SELECT src.doc_id, src.w AS "window", CAST(round_even(coalesce(kept / CAST(n AS DOUBLE), 1.0), 4) AS DOUBLE) AS coverage, coalesce(kept / CAST(n AS DOUBLE), 1.0) >= CAST(0.98 AS DOUBLE) AS ok
FROM src LEFT JOIN s ON s.doc_id = src.doc_id AND s.w = src.w""")
def window_coverage(spark, sf_dir):
    windows = line_windows(spark, sf_dir, 5).select("doc_id", "window", F.array_join("ls", " ").alias("text"))
    out = reduced(documents(spark, sf_dir)).select("doc_id", F.col("output").alias("text"))
    return coverage.window_coverage(windows, out, margin=20)


@query(f"""
WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM ({LINES_SQL}) WHERE trim(line) <> ''),
f AS (SELECT doc_id, line, min(pos) AS pos FROM l WHERE NOT regexp_matches(line, '^WEBVTT|^Kind:|^Language:|-->|^[0-9]+$|align:|position:|size:') GROUP BY ALL),
j AS (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(t), 0) AS INTEGER) AS n_chars,
       CAST(len(list_filter(string_split_regex(coalesce(t, ''), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN j USING (doc_id)""")
def vtt_clean(spark, sf_dir):
    return turns.clean_captions(documents(spark, sf_dir)).select("doc_id", "n_chars", "n_words", F.sha2("text", 256).alias("text_sha256"))


@query("""
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
i AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM e)
SELECT user_id, CAST(turn AS BIGINT) AS turn_no, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM i GROUP BY ALL""")
def turn_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    run = turns.islands(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), "turn_no")
    return run.groupBy("user_id", "turn_no", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""
SELECT conv_id, coalesce(nullif(role, ''), 'SPEAKER_?') AS speaker, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM conversations GROUP BY ALL""")
def turn_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("speaker", turns.speaker_name(F.col("role"), F.create_map(F.lit("-"), F.lit("-"))))
    return rows.groupBy("conv_id", "speaker").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.sum(T.word_count(F.col("text"))).alias("n_words"))


@query("""
WITH n AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS c, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN c + l < 100 THEN 'en' WHEN c / (c + l) >= 0.6 THEN 'zh' ELSE 'en' END AS language FROM n""")
def lang_detect(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("""
SELECT doc_id, CASE WHEN n_chars < 1500 THEN 'short' WHEN n_chars <= 6000 THEN 'medium' WHEN n_chars <= 15000 THEN 'long' ELSE 'very_long' END AS bucket,
       CASE WHEN n_chars > 100000 THEN 'split' WHEN n_chars < 500 THEN 'confirm' ELSE 'ok' END AS advice FROM documents""")
def size_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.size_bucket(F.col("n_chars")).alias("bucket"), T.size_advice(F.col("n_chars")).alias("advice"))


def source_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), F.size(F.split("text", "\n")).alias("n"))


REPEATED_SQL = f"""
WITH l AS (SELECT source, doc_id, pos, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS norm, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
c AS (SELECT source, norm, count(DISTINCT doc_id) AS n_on FROM l GROUP BY ALL),
t AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM l GROUP BY ALL),
rep AS (SELECT * FROM c JOIN t USING (source) WHERE n_pages >= 4 AND n_on >= n_pages * CAST(0.15 AS DOUBLE))"""


@query(REPEATED_SQL + " SELECT source, norm, n_on, n_pages FROM rep")
def repeated_lines(spark, sf_dir):
    return layout.repeated_lines(source_lines(spark, sf_dir), "source", "doc_id", "line", 0.15)


@query(REPEATED_SQL + """,
k AS (SELECT l.*, rep.norm IS NOT NULL AND (12 * pos + 12 <= 12 * n * CAST(0.08 AS DOUBLE) OR 12 * pos >= 12 * n * (1 - CAST(0.08 AS DOUBLE))) AS gone FROM l LEFT JOIN rep USING (source, norm))
SELECT source, count(*) AS n_lines, count(*) FILTER (NOT gone) AS n_kept, CAST(sum(CASE WHEN gone THEN 0 ELSE pos END) AS BIGINT) AS places FROM k GROUP BY source""")
def drop_repeated(spark, sf_dir):
    """Documents as pages of their source, lines 12 points high: repeated ones go in the bands at the top and bottom."""
    y = lambda k: (F.col("pos") * 12 + k).cast("double")
    own = source_lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "pos", F.col("line").alias("text"), y(0).alias("y0"), y(12).alias("y1"), (F.col("n") * 12.0).alias("height"))
    pages = own.groupBy("doc_id", "page").agg(F.first("height").alias("height")).withColumn("width", F.lit(595.0))
    headers = layout.repeated_lines(own, share=0.15).select("doc_id", "norm")
    kept = layout.drop_headers(own.drop("height"), pages, headers).groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum("pos").alias("places"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines")).join(kept, "doc_id").withColumnRenamed("doc_id", "source")


@query("""
WITH r AS (SELECT source, count(*) AS n_pages, avg(CASE WHEN length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) >= 600 THEN 1 ELSE 0 END) AS text_ratio FROM documents GROUP BY source)
SELECT source, n_pages, text_ratio, CASE WHEN text_ratio >= 0.8 THEN 'text' WHEN text_ratio <= 0.2 THEN 'scanned' ELSE 'mixed' END AS mode FROM r""")
def text_ratio_mode(spark, sf_dir):
    return layout.text_ratio(table(spark, sf_dir, "documents"), "source", "text", 600)


FOLD = f"""list_reduce(list_prepend('', {{0}}), lambda a, b: CASE
  WHEN a = '' THEN b WHEN b = '' THEN a WHEN a[-1] = '-' AND regexp_matches(b, '^[a-z]') THEN a[:-2] || b
  WHEN a[-1] = '-' OR regexp_matches(a, '[{T.CJK_JOINED}]$') OR regexp_matches(b, '^[{T.CJK_JOINED}]') THEN a || b ELSE a || ' ' || b END)"""


@query(f"""
WITH l AS (SELECT doc_id, pos, line, CAST(12 * (pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos)) AS DOUBLE) AS dy FROM ({LINES_SQL}) WHERE line <> ''),
g AS (SELECT *, median(dy) OVER (PARTITION BY doc_id) AS gap FROM l),
p AS (SELECT *, sum(CASE WHEN dy IS NULL OR dy > gap * CAST(1.3 AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM g)
SELECT doc_id, CAST(para AS BIGINT) AS para_no, sha256({FOLD.format("list(line ORDER BY pos)")}) AS text_sha256 FROM p GROUP BY ALL""")
def paragraph_breaks(spark, sf_dir):
    """Lines 10 points high every 12 points: an empty line makes a gap."""
    own = lines(spark, sf_dir).where("line <> ''").select("doc_id", "pos", F.col("line").alias("text"), (F.col("pos") * 12.0).alias("y0"), (F.col("pos") * 12.0 + 10).alias("y1"))
    return layout.paragraphs(own, ["doc_id"], "pos").select("doc_id", "para_no", F.sha2("text", 256).alias("text_sha256"))


@query(f"SELECT doc_id, {FOLD.format('list_filter(string_split(coalesce(text, chr(0)[1:0]), chr(10)), lambda x: x <> chr(0)[1:0])').replace('chr(0)[1:0]', chr(39) * 2)} AS text FROM documents")
def paragraph_fold(spark, sf_dir):
    """Lines folded into one paragraph each, by the hyphen and script rules."""
    return documents(spark, sf_dir).select("doc_id", T.fold_lines(T.nonempty(F.split("text", "\n"))).alias("text"))


NOTICE = "(?i)licen[sc]ed? |copyright"


@query(f"""
WITH l AS (SELECT doc_id, pos, line, pos + 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES_SQL})),
c AS (SELECT doc_id, min(pos) AS cut FROM l WHERE n >= 2 AND i * 3 > n * 2 AND regexp_matches(line, '{NOTICE}') GROUP BY doc_id)
SELECT l.doc_id, count(*) FILTER (cut IS NULL OR pos < cut) AS n_kept, CAST(max(cut) AS INTEGER) AS cut FROM l LEFT JOIN c USING (doc_id) GROUP BY l.doc_id""")
def tail_notice_cut(spark, sf_dir):
    own = lines(spark, sf_dir)
    cut = layout.find_notice(own, NOTICE, "doc_id", "pos", "line")
    return own.join(cut, "doc_id", "left").groupBy("doc_id").agg(F.count_if(F.col("cut").isNull() | (F.col("pos") < F.col("cut"))).alias("n_kept"), F.max("cut").cast("int").alias("cut"))


@query("""
WITH l AS (SELECT l_suppkey AS g, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem),
c AS (
  SELECT g, row_number() OVER w AS k, max(x1) OVER (w ROWS UNBOUNDED PRECEDING) AS "left", lead(x0) OVER w AS "right", count(*) OVER (PARTITION BY g) AS n
  FROM l WINDOW w AS (PARTITION BY g ORDER BY x0, x1)),
f AS (SELECT g, "left", "right", row_number() OVER (PARTITION BY g ORDER BY "right" - "left" DESC, k) AS r FROM c WHERE k >= 3 AND n - k >= 3 AND "right" - "left" >= 8)
SELECT g, "right" - "left" AS gap, ("left" + "right") / 2 AS middle FROM f WHERE r = 1""")
def gutter_gap(spark, sf_dir):
    intervals = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))
    return layout.find_gap(intervals, ["g"])


BOXES = [("A", 1, 0.0, 0.0, 20.0, 0.05), ("A", 2, 10.0, 0.02, 40.0, 0.08), ("R", 1, 5.0, 0.01, 25.0, 0.06), ("N", 1, 0.0, 0.0, 50.0, 0.03)]


@query(f"""
WITH b(f, i, x0, y0, x1, y1) AS (VALUES {", ".join(f"('{f}', {i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for f, i, a, b, c, d in BOXES)}),
h AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(i) AS i FROM lineitem LEFT JOIN b ON f = l_returnflag AND l_quantity BETWEEN x0 AND x1 AND l_discount BETWEEN y0 AND y1 GROUP BY ALL)
SELECT l_returnflag, CAST(i AS INTEGER) AS box, count(*) AS n FROM h GROUP BY ALL""")
def point_in_box(spark, sf_dir):
    boxes = spark.createDataFrame(BOXES, "l_returnflag string, box int, x0 double, y0 double, x1 double, y1 double")
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    inside = layout.boxes_of(points, boxes, ["l_returnflag"], box="box")
    rows = inside.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.min("box").alias("box"))
    return rows.groupBy("l_returnflag", "box").agg(F.count("*").alias("n"))


GLOSSARY = ["# terms", "Thentian|7|thention,thonting", "Ationer|5|ationing,thing in,ation", "Restonor|5|restion", "", "Edgetion||edition,ther"]
PROTECT = ["thing", "# kept", "restions"]


def dictionary(spark):
    entries = glossary.parse_entries(spark.createDataFrame(list(enumerate(GLOSSARY)), "ord int, value string"))
    return entries, glossary.protected_words(entries, spark.createDataFrame([(w,) for w in PROTECT], "word string"))


def corrected(spark, docs):
    out = docs.withColumn("u", glossary.Corrections.collect(*dictionary(spark)).apply(F.col("text")))
    return out.select("doc_id", F.sha2("u", 256).alias("text_sha256"), (F.col("u") != F.col("text")).alias("changed"))


#: Words between marks of their own, so that a key is a whole run of ASCII letters and digits. ``thing in`` begins with a protected word, so it never applies.
MARKED_SQL = "regexp_replace(coalesce(text, ''), '([0-9A-Za-z]+)', chr(57344) || '\\1' || chr(57345), 'g')"
for _variant, _term in (("thention", "Thentian"), ("thonting", "Thentian"), ("ationing", "Ationer"), ("ation", "Ationer"), ("restion", "Restonor"), ("edition", "Edgetion"), ("ther", "Edgetion")):
    MARKED_SQL = f"replace({MARKED_SQL}, chr(57344) || '{_variant}' || chr(57345), '{_term}')"


@query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, replace(replace({MARKED_SQL}, chr(57344), ''), chr(57345), '') AS u FROM documents)
SELECT doc_id, sha256(u) AS text_sha256, u <> text AS changed FROM t""")
def glossary_apply(spark, sf_dir):
    """A row for each document."""
    return corrected(spark, documents(spark, sf_dir))


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) >= 3 AND contains(lower(d.text), lower(b.text))""")
def glossary_scan(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark")
    entries = terms.select(F.col("item_id").alias("ord"), F.col("text").alias("term"), F.lit("").alias("weight"), F.array().cast("array<string>").alias("variants"))
    hits = glossary.scan_terms(documents(spark, sf_dir), entries)
    return hits.join(terms.select("item_id", F.col("text").alias("term")), "term").select("doc_id", "item_id")


@query("""
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''),
t AS (SELECT word, left(word, 4) AS variant FROM w WHERE length(word) > 4),
m AS (SELECT variant, min(word) AS term FROM t GROUP BY variant)
SELECT m.variant, m.term, w.word, 'variant in word' AS kind FROM m JOIN w ON contains(w.word, m.variant) AND w.word <> m.variant
UNION ALL SELECT m.variant, m.term, w.word, 'word in variant' FROM m JOIN w ON contains(m.variant, w.word) AND w.word <> m.variant""")
def glossary_lint(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''").distinct()
    entries = words.where("length(word) > 4").select(F.col("word").alias("ord"), F.col("word").alias("term"), F.lit("").alias("weight"), F.array(F.left("word", F.lit(4))).alias("variants"))
    return glossary.collisions(glossary.corrections_table(entries), words)


@query(values_sql("kind VARCHAR, term VARCHAR, detail VARCHAR", [
    ("entry", "Ationer", "ationing,thing in,ation,ationen"), ("entry", "Edgetion", "edition,ther"), ("entry", "Newtion", "neution"), ("entry", "Restonor", "restion"), ("entry", "Thentian", "thention,thonting"),
    ("refused", "Ationer", "ab:short"), ("refused", "Ationer", "thin:protected"), ("refused", "Newtion", "thention:mapped"),
]))
def glossary_upsert(spark, sf_dir):
    entries, protected = dictionary(spark)
    batch = spark.createDataFrame([(0, "ATIONER", ["ationen", "ab", "thin"]), (1, "Newtion", ["neution", "thention"]), (2, "newtion", ["nution"])], "pos int, term string, seen_as array<string>")
    merged, refused = glossary.upsert(entries, protected, batch)
    kept = merged.select(F.lit("entry").alias("kind"), "term", F.array_join("variants", ",").alias("detail"))
    return kept.unionByName(refused.select(F.lit("refused").alias("kind"), "term", F.concat_ws(":", "variant", "reason").alias("detail")))


def numbers_sql(text: str) -> str:
    """Distinct numbers of a text in SQL, multiplied by the scale after them."""
    clean = f"regexp_replace({text}, '{coverage.NOISE}', ' ', 'g')"
    scale = " ".join(f"WHEN '{k}' THEN {f:.0f}::DOUBLE" for k, f in coverage.SCALES.items())
    return f"list_distinct(list_transform(regexp_extract_all({clean}, '{coverage.ARABIC}'), lambda m: CAST(regexp_extract(m, '{coverage.ARABIC}', 1) AS DOUBLE) * CASE regexp_extract(m, '{coverage.ARABIC}', 2) {scale} ELSE 1::DOUBLE END))"


def years_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(regexp_replace({text}, '{coverage.NOISE}', ' ', 'g'), '{coverage.YEAR}', 1), lambda y: CAST(y AS DOUBLE)))"




@query(f"SELECT doc_id, CAST(len(v) AS INTEGER) AS n_values, coalesce(list_max(v), 0.0) AS largest FROM (SELECT doc_id, {numbers_sql("coalesce(text, '')")} AS v FROM documents)")
def numeric_facts(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", coverage.arabic_values(F.col("text")).alias("v"))
    return out.select("doc_id", F.size("v").alias("n_values"), F.coalesce(F.array_max("v"), F.lit(0.0)).alias("largest"))


@query(f"""
WITH r AS ({REDUCED_SQL}),
l AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(source, '[A-Za-z][A-Za-z0-9.+-]{{2,}}'), lambda x: lower(x))) AS t FROM r) WHERE length(t) >= 4 AND t NOT IN ({", ".join(f"'{w}'" for w in coverage.LATIN_STOP)}) GROUP BY ALL),
m AS (SELECT l.doc_id, count(*) AS n FROM l JOIN r USING (doc_id) WHERE l.n >= 2 AND NOT contains(lower(r.output), l.t) GROUP BY l.doc_id)
SELECT r.doc_id, CAST(coalesce(m.n, 0) AS INTEGER) AS n_missing_latin FROM r LEFT JOIN m USING (doc_id)""")
def entity_audit(spark, sf_dir):
    out = coverage.audit(reduced(documents(spark, sf_dir)), "source", "output")
    return out.select("doc_id", F.size("missing_latin").alias("n_missing_latin"))


@query(f"""
WITH r AS ({REDUCED_SQL}),
v AS (SELECT doc_id, {numbers_sql("source")} AS src, {years_sql("source")} AS years, {numbers_sql("output")} AS out FROM r),
m AS (SELECT doc_id, list_filter(src, lambda x: NOT list_contains(years, x)) AS src, years, out FROM v),
n AS (SELECT doc_id, len(src) AS n, len(list_filter(src, lambda x: NOT list_contains(out, x))) AS n_missing, len(list_filter(years, lambda x: NOT list_contains(out, x))) AS n_years FROM m)
SELECT doc_id, CAST(n_missing AS INTEGER) AS n_missing, CAST(n_years AS INTEGER) AS n_missing_years, CASE WHEN n > 0 THEN n_missing / CAST(n AS DOUBLE) ELSE 0.0 END AS missing_ratio,
       CASE WHEN n_missing > 0 THEN 1 ELSE 0 END AS status FROM n""")
def entity_audit_numbers(spark, sf_dir):
    """The tables hold no Chinese numerals, which the SQL leaves out; ``reader_audit`` and ``cn_numerals`` have them."""
    out = coverage.audit(reduced(documents(spark, sf_dir)), "source", "output")
    return out.select("doc_id", F.size("missing_values").alias("n_missing"), F.size("missing_years").alias("n_missing_years"), "missing_ratio", "status")


@query(f"""
SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9.+-]{{2,}}'), lambda x: lower(x))) AS term FROM documents)
WHERE length(term) >= 4 AND term NOT IN ({", ".join(f"'{w}'" for w in coverage.LATIN_STOP)}) GROUP BY term HAVING count(*) >= 5""")
def latin_terms(spark, sf_dir):
    terms = documents(spark, sf_dir).select(F.explode(coverage.latin_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).where("n >= 5")


def written(n):
    """Numerals of 1 to 9999: digits with their units, one zero for each run of zeros within."""
    digit = lambda place: F.floor(n / place) % 10
    shown = lambda place, unit: F.when(digit(place) == 0, "零").otherwise(F.concat(F.substring(F.lit("一二三四五六七八九"), digit(place).cast("int"), 1), F.lit(unit)))
    whole = F.concat(shown(1000, "千"), shown(100, "百"), shown(10, "十"), shown(1, ""))
    return F.regexp_replace(F.regexp_replace(whole, "零+", "零"), "^零|零$", "")


@query("""
SELECT n::BIGINT AS n, n::DOUBLE AS v, ((n % 9 + 1) * 10000 + n * 7919 % 10000)::DOUBLE AS large, ((n % 9 + 1) * 100000000 + (n % 8 + 1) * 10000 + n * 7919 % 10000)::DOUBLE AS larger,
       CASE WHEN n < 10000 AND n % 10 > 0 AND n // 10 % 10 > 0 THEN NULL ELSE n::DOUBLE END AS twice FROM range(1, 10000) t(n)""")
def cn_numerals(spark, sf_dir):
    """Numbers written out and read again, up to 10^9; and with a unit twice, which is no number."""
    own = spark.range(1, 10000).select(F.col("id").alias("n"), written(F.col("id")).alias("w"), (F.col("id") * 7919 % 10000).alias("low"))
    low = F.when(F.col("low") == 0, "").otherwise(F.concat(F.when(F.col("low") < 1000, "零").otherwise(""), written(F.col("low"))))
    one = lambda k: written(F.col("n") % k + 1)
    twice = F.when((F.col("n") % 10 > 0) & (F.floor(F.col("n") / 10) % 10 > 0), F.concat("w", F.lit("十"))).otherwise(F.col("w"))
    return own.select("n", numeral(F.col("w")).alias("v"), numeral(F.concat(one(9), F.lit("万"), low)).alias("large"), numeral(F.concat(one(9), F.lit("亿"), one(8), F.lit("万"), low)).alias("larger"), numeral(twice).alias("twice"))


PROTECTED_SQL = T.PROTECTED.replace("'", "''")
HIDDEN_SQL = "chr(1) || chr(2) || chr(3)"
SENTENCES_SQL = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, '{PROTECTED_SQL}') AS gaps, list_transform(regexp_extract_all(t, '{PROTECTED_SQL}'), lambda m: chr(5) || translate(m, '.!?', {HIDDEN_SQL})) AS hits FROM d),
h AS (SELECT doc_id, array_to_string(list_transform(gaps, lambda g, i: g || coalesce(hits[i], '')), '') AS t FROM p),
s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?][\"'')\\]]*)\\s+([\"''(\\[]?[A-Z0-9])', '\\1' || chr(4) || '\\2', 'g'), chr(4)) AS ss FROM h),
w AS (SELECT doc_id, list_filter(list_transform(ss, lambda x: translate(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), {HIDDEN_SQL} || chr(5), '.!?')), lambda x: x <> '') AS ss FROM s)"""


@query(SENTENCES_SQL + " SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS n, unnest(ss) AS sentence FROM w")
def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("n", "sentence"))


@query(SENTENCES_SQL + " SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sentences FROM w")
def sentence_counts(spark, sf_dir):
    """A row for each document."""
    return documents(spark, sf_dir).select("doc_id", F.size(T.split_sentences(F.col("text"))).alias("n_sentences"))


@query(f"""
WITH l AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM ({LINES_SQL}) WHERE trim(line) <> ''),
w AS (SELECT doc_id, CAST(k // 5 AS INTEGER) AS w, string_agg(line, chr(10) ORDER BY k) AS t FROM l GROUP BY ALL)
SELECT doc_id, w AS "window", regexp_matches(t, '[0-9]|⟨\\?') OR w % 3 = 0 AS checked FROM w""")
def sample_windows(spark, sf_dir):
    own = line_windows(spark, sf_dir, 5).withColumn("t", F.array_join("ls", "\n"))
    return own.select("doc_id", "window", coverage.must_check(F.col("t"), F.lit(0), F.col("window")).alias("checked"))


@query(f"""
WITH p AS (SELECT item_id, array_to_string(w[1:4], ' ') AS gram FROM (SELECT item_id, {SQL_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) >= 4),
d AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents)),
g AS (SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS gram, i - 1 AS pos FROM d)
SELECT g.doc_id, p.item_id, CAST(min(g.pos) AS INTEGER) AS pos FROM g JOIN p USING (gram) GROUP BY ALL""")
def phrase_align(spark, sf_dir):
    """First place of each item's first four words in the documents that have them."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.norm_words(F.col("text")).alias("words"))
    return turns.first_places(documents(spark, sf_dir).select("doc_id", T.norm_words(F.col("text")).alias("words")), items)


@query("""
SELECT conv_id, sha256(string_agg('<p class="' || role || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY turn)) AS html_sha256
FROM conversations GROUP BY conv_id""")
def render_fragment(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("x", F.concat(F.lit('<p class="'), "role", F.lit('">'), T.mark_uncertain(T.escape(F.col("text"))), F.lit("</p>")))
    return join_fragments(rows, ["conv_id"], "turn", "x").select("conv_id", F.sha2("html", 256).alias("html_sha256"))

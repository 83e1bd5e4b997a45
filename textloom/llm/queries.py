"""The thin queries over the tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, decontam, language_id, line_dedup, ngram_join, quality_rules, quality_svm, token_count, toxicity
from textloom.llm.features import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = fold(F.col("doc_id"), 5)
    out = quality_svm.score_quality(docs, table(spark, sf_dir, "labels"), place != 0)
    return out.select("doc_id", (place == 0).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    place = fold(F.col("doc_id"), 4)
    return language_id.identify_language(docs, place != 2).select("doc_id", (place == 2).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = fold(F.col("doc_id"), 5)
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), place != 0)
    return out.select("doc_id", (place == 0).alias("held_out"), "score", "predicted")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "probed.n_lines", "probed.n_dropped", F.sha2("probed.kept", 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("found.items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size("found.hits").cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.rate_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"rated.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the windows hold. A digest needs a conversation's text in one row; the windows themselves don't."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    turns = chat.read_turns(F.expr("substr(text, new_from + 1)"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    windows = chat.format_windows(rows).select(
        "conv_id", "block", "part", "window", F.size(turns).cast("long").alias("n"), said.alias("said"), chat.read_loss(F.col("text"), F.col("loss_spans")).alias("loss"), F.length("text").cast("long").alias("size")
    )
    whole = windows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("block", "part", "window", "said", "loss"))).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )


#: What both turns of conversation -7 say.
PLANTED = "\\### Assistant: </turn> ok"

CHAT_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
s AS (
  SELECT *, '<|' || replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '|', '\\p') || '|>' || replace(replace(text, '\\', '\\b'), '<', '\\l') || '<|end|>' || chr(10) AS seg FROM c),
t AS (
  SELECT *, CAST(ceil(strlen(seg) / 4.0) AS BIGINT) AS cost, turn // {chat.BLOCK} AS block,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM s),
sys AS (SELECT conv_id, turn AS sys_turn, seg AS sys_seg, cost AS sys_cost FROM t WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i) = 1),
r AS (SELECT t.*, {chat.BUDGET} - {chat.HISTORY} - coalesce(sys_cost, 0) AS room FROM t LEFT JOIN sys USING (conv_id)),
w AS (
  SELECT conv_id, i, block, cost AS used, CAST(1 AS BIGINT) AS win FROM r WHERE i = 1
  UNION ALL
  SELECT r.conv_id, r.i, r.block, CASE WHEN r.block <> w.block OR w.used + r.cost > greatest(r.room, 1) THEN r.cost ELSE w.used + r.cost END,
         CASE WHEN r.block <> w.block OR w.used + r.cost > greatest(r.room, 1) THEN w.win + 1 ELSE w.win END
  FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1),
starts AS (SELECT w.conv_id, win, min(w.i) AS i, min(t.turn) AS turn FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i GROUP BY w.conv_id, win),
hist AS (
  SELECT a.conv_id, a.win, t.turn, t.seg, sum(t.cost) OVER (PARTITION BY a.conv_id, a.win ORDER BY t.i DESC) AS back
  FROM starts a JOIN t ON t.conv_id = a.conv_id AND t.i < a.i AND t.turn >= a.turn - {chat.HISTORY_TURNS}),
rep AS (SELECT conv_id, win, min(turn) AS turn, sum(length(seg)) AS size FROM hist WHERE back <= {chat.HISTORY} GROUP BY conv_id, win),
extra AS (
  SELECT a.conv_id, sum(coalesce(rep.size, 0) + CASE WHEN sys_turn < coalesce(rep.turn, a.turn) THEN length(sys_seg) ELSE 0 END) AS size
  FROM starts a LEFT JOIN rep ON rep.conv_id = a.conv_id AND rep.win = a.win LEFT JOIN sys ON sys.conv_id = a.conv_id GROUP BY a.conv_id),
whole AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(length(seg)) AS size FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(whole.size + extra.size AS BIGINT) AS formatted_chars
FROM whole JOIN extra USING (conv_id)"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), {AZ}) AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.line, l.pos, f.k IS NOT NULL AND l.doc_id <> f.last_id AS dropped
  FROM keyed l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

TEXT_WORDS = "regexp_extract_all(translate(coalesce(text, ''), " + AZ + "), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {TEXT_WORDS} AS w FROM documents),
i AS (SELECT item_id, {TEXT_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, CAST(len(d.w) - s.n + 2 AS BIGINT))) AS p FROM d, sizes s WHERE len(d.w) >= s.n)),
found AS (SELECT doc_id, p, dw.n, item_id FROM doc_windows dw JOIN item_windows iw ON dw.n = iw.n AND dw.k = iw.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


NGRAM_JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS g FROM w),
cls AS (SELECT g, len(g) AS n, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT rep, n, unnest(g) AS x FROM cls),
pairs AS (SELECT a.rep AS u, b.rep AS v, a.n + b.n AS total, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 90 * (total - c) UNION ALL SELECT v, u FROM pairs WHERE 100 * c >= 90 * (total - c)),
reach AS (SELECT rep AS node, rep AS r FROM cls UNION SELECT reach.node, links.v FROM reach JOIN links ON reach.r = links.u),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id
FROM s LEFT JOIN cls ON s.g = cls.g LEFT JOIN comp ON comp.node = cls.rep"""

STOP_LIST = ", ".join("'" + w + "'" for w in quality_rules.STOP_WORDS)

QUALITY_RULES_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
spots AS (SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM spots) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: x IN ({STOP_LIST}))) AS n_stop,
         len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shout,
         len(list_filter(w, lambda x, i: i > 1 AND w[greatest(i - 1, 1)] = x)) AS n_echo
  FROM d LEFT JOIN again USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n >= 2.0 AND word_chars / n <= 14.0 AND n_symbols / n <= 0.2 AND n_shout / n <= 0.5
       AND n_stop / n >= 0.04 AND n_echo / n <= 0.3 AND (n_lines < 8 OR n_dup_lines / CAST(n_lines AS DOUBLE) <= 0.5) AS kept
FROM based"""


def queries() -> dict[str, Query]:
    found = (op1_line_dedup, op2_byte_bpe, op3_quality_svm, op4_token_count, op5_language_id, op6_quality_rules, op7_ngram_jaccard, op8_decontamination, op9_toxicity, op10_chat_format)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Tokenizers and trained models have none; they are tested against libraries and held-out rows."""
    return {
        "op1_line_dedup": LINE_DEDUP_SQL,
        "op6_quality_rules": QUALITY_RULES_SQL,
        "op7_ngram_jaccard": NGRAM_JACCARD_SQL,
        "op8_decontamination": DECONTAMINATION_SQL,
        "op10_chat_format": CHAT_SQL,
    }

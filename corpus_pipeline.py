"""The corpus pipeline: documents to token ids, in five stages, each an operator of ``textloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. What a stage decides takes effect: rejected, duplicate
and contaminated documents go, dropped lines are gone from the text.

A null text, or one without words, is rejected by the first stage. A text of
which line dedup leaves nothing stays as an empty document; the later stages
keep it. Very long texts are handled whole by each stage. Repeated rows (one id,
equal text) are one document to the near-duplicate stage, which keeps all rows
of the least id of a group; ties of an id thus stay together. Documents with a
null id are never near duplicates of others. An empty table stays empty. Extra
columns stay, whatever they are called, but for names that begin with two
underscores; the last stage replaces text by n_tokens, exact and ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, line_dedup, ngram_join, quality_rules
from textloom.llm.stored import drop, folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them only."""
    columns = docs.columns
    found = line_dedup.dedup_lines(docs, out="__probed")
    text = F.when(F.col("text").isNotNull(), F.col("__probed.kept"))
    changed = F.col("__probed.n_dropped") > 0
    new = {"text": text} | ({"n_chars": F.when(changed, F.length("__probed.kept")).otherwise(F.col("n_chars")).cast("long")} if "n_chars" in columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.bpe_round_trip(docs, path, pattern, ids="ids", decoded="__decoded")
    exact = F.col("__decoded") == F.coalesce("text", F.lit("")).cast("binary")
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "exact", "ids")]
    return out.select(*kept, F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("byte_bpe", tokens)]

#: SQL can't express the last stage; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with tables between them in the folder that all executors share; each goes once the next one is written."""
    place = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop(spark, before)
        before = at
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

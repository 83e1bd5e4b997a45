"""Corrections from a guarded dictionary: entries (ord, term, weight, variants) and protected words.

The dictionary is kept by hand and small; :class:`Corrections` collects it, up
to a checked number of keys, into one Aho-Corasick automaton, with which an
Arrow-batched function reads each text once. That takes a fifth of the time of a
literal pattern with a literal map, which gives equal results and is used within
lambdas, where no such function can be. Terms are looked for by automata as
well, a block of keys at a time. The other operators are joins.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.automata import BLOCK_KEYS, automaton, blocks, name_of, values_in
from textloom.functions.text import CJK_KEYS, nonempty, replace_each

#: Keys that a worker holds as one automaton.
MOST_KEYS = 1_000_000


def parse_entries(lines: DataFrame, line: str = "value", ord_: str = "ord") -> DataFrame:
    """(ord, term, weight, variants) of lines ``term|weight|v1,v2``; blanks and comments go."""
    own = F.trim(line)
    parts = F.split(own, r"\|")
    part = lambda k: F.trim(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    rows = lines.where((own != "") & ~own.startswith("#")).select(F.col(ord_).alias("ord"), part(0).alias("term"), part(1).alias("weight"), nonempty(F.transform(F.split(part(2), ","), lambda x: F.trim(x))).alias("variants"))
    return rows.where("term <> ''")


def protected_words(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(word): all terms and all protected words."""
    own = words.select(F.trim("word").alias("word")).where("word <> '' and not startswith(word, '#')")
    return entries.select(F.col("term").alias("word")).union(own).distinct()


def key_rejection(key: Column) -> Column:
    """Why a key may not be replaced; null if it may. Short keys hit ordinary words."""
    n, cjk = F.length(key), key.rlike(f"[{CJK_KEYS}]")
    return F.when(key == "", "empty").when(cjk & (n < 3), "short CJK").when(~cjk & (n < 4), "short")


def variants(entries: DataFrame) -> DataFrame:
    """(variant, term, ord, pos, rejection, first): each variant; of those with one spelling, which comes first."""
    rows = entries.select("ord", "term", F.posexplode("variants").alias("pos", "variant")).where("variant <> term").withColumn("rejection", key_rejection(F.col("variant")))
    order = Window.partitionBy("variant").orderBy("ord", "pos")
    usable = rows.where("rejection is null").withColumn("first", F.first("term").over(order))
    return usable.unionByName(rows.where("rejection is not null").withColumn("first", F.lit(None).cast("string")))


def corrections_table(entries: DataFrame) -> DataFrame:
    """(variant, term): what is replaced by what; the first entry wins."""
    order = Window.partitionBy("variant").orderBy("ord", "pos")
    return variants(entries).where("rejection is null").withColumn("n", F.row_number().over(order)).where("n = 1").select("variant", "term")


def conflicts(entries: DataFrame) -> DataFrame:
    """(variant, term, kept): mappings that lose to an earlier one."""
    return variants(entries).where("rejection is null and term <> first").select("variant", "term", F.col("first").alias("kept")).distinct()


def collisions(mappings: DataFrame, protected: DataFrame) -> DataFrame:
    """(variant, term, word, kind): a variant within a protected word, or the other way round.

    Both sides come from the dictionary. Instead of comparing all with all,
    each is looked up among the substrings of the other.
    """

    def substrings(c: Column) -> Column:
        n = F.length(c)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(c, i, k)))))

    in_word = mappings.join(protected.where("word <> ''").select("word", F.explode(substrings(F.col("word"))).alias("s")), F.col("variant") == F.col("s")).where("word <> variant")
    in_variant = mappings.where("variant <> ''").withColumn("s", F.explode(substrings(F.col("variant")))).join(protected, F.col("s") == F.col("word")).where("word <> variant")
    pick = lambda df, kind: df.select("variant", "term", "word", F.lit(kind).alias("kind"))
    return pick(in_word, "variant in word").unionByName(pick(in_variant, "word in variant"))


def _pattern(key: str) -> str:
    edge = lambda c, look: look if re.match("[0-9A-Za-z]", c) else ""
    return edge(key[0], "(?<![0-9A-Za-z])") + "\\Q" + key.replace("\\E", "\\E\\\\E\\Q") + "\\E" + edge(key[-1], "(?![0-9A-Za-z])")


class Corrections:
    """One left-to-right scan: protected words stay, variants become their terms; longest first, case-sensitive."""

    def __init__(self, mapping: dict[str, str], protected: set[str] = frozenset()):
        self.mapping = {k: v for k, v in mapping.items() if k not in protected}
        longest = lambda keys: sorted(keys, key=lambda k: (-len(k), k))
        self.keys = [*longest(w for w in protected if w), *longest(self.mapping)]

    @classmethod
    def collect(cls, entries: DataFrame, protected: DataFrame, legacy: dict[str, str] | None = None, most: int = MOST_KEYS) -> Corrections:
        """legacy: an older table, overridden by the entries."""
        rows = corrections_table(entries).limit(most + 1).collect()
        words = protected.limit(most + 1).collect()
        if max(len(rows), len(words)) > most:
            raise ValueError(f"a dictionary of over {most} keys is too large for a worker")
        return cls((legacy or {}) | {r["variant"]: r["term"] for r in rows}, {r["word"] for r in words})

    def apply(self, text: Column) -> Column:
        return _corrected(self)(text) if self.mapping else text

    def apply_pattern(self, text: Column) -> Column:
        if not self.mapping:
            return text
        pairs = F.create_map(*[F.lit(x) for pair in self.mapping.items() for x in pair])
        return replace_each(text, "|".join(map(_pattern, self.keys)), lambda m: F.coalesce(F.try_element_at(pairs, m), m))


def _ascii(c: str) -> bool:
    return c.isascii() and c.isalnum()


def corrected(text: str, found: list[tuple[int, int, str | None]]) -> str:
    """found: (start, end, replacement, or None for a protected word) of all keys in the text. At each place a protected word goes first, then the longest."""
    inner = lambda at: 0 < at < len(text) and _ascii(text[at - 1]) and _ascii(text[at])
    out, at = [], 0
    for start, end, new in sorted((x for x in found if not inner(x[0]) and not inner(x[1])), key=lambda x: (x[0], x[2] is not None, -x[1])):
        if start >= at:
            out += [text[at:start], text[start:end] if new is None else new]
            at = end
    return "".join([*out, text[at:]])


def _corrected(own: Corrections):
    keys = {k: (len(k), own.mapping.get(k)) for k in own.keys}
    name = name_of(keys)

    @F.arrow_udf(T.StringType())
    def correct(texts: pa.Array) -> pa.Array:
        scan, out = automaton(name, keys), []
        for t in texts:
            text = t.as_py()
            hits = [(end - n + 1, end + 1, new) for end, (n, new) in scan.iter(text)] if text else []
            out.append(corrected(text, hits) if hits else text)
        return pa.array(out, pa.string())

    return correct


def scan_terms(docs: DataFrame, entries: DataFrame, text: str = "text", id_: str = "doc_id", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(id, term): terms that occur in a text, by themselves or by a variant, in any case; terms under 3 characters are skipped.

    Each text is read once for each block of keys, and only hits are exploded.
    """
    rows = entries.where(F.length("term") >= 3).select("term", F.explode(F.array_distinct(F.concat(F.array("term"), "variants"))).alias("key")).where("key <> ''").select(F.col("term").alias("value"), F.lower("key").alias("key")).distinct()
    out = docs.select(id_, F.lit("").alias("term")).where("false")
    n = 0
    for keys in blocks(rows, block_keys):
        own = docs.select(id_, F.explode(values_in(keys)(F.lower(text))).alias("term"))
        out, n = (own if not n else out.unionByName(own)), n + 1
    return out.distinct() if n > 1 else out


def normalize_names(names: Column) -> Column:
    """array<struct<term, seen_as>> of a JSON list of strings or of objects with term and seen_as."""
    def one(js: Column) -> Column:
        is_object = js.startswith("{")
        term = F.trim(F.when(is_object, F.get_json_object(js, "$.term")).otherwise(js))
        seen = F.when(is_object, F.from_json(F.get_json_object(js, "$.seen_as"), "array<string>"))
        return F.struct(term.alias("term"), F.coalesce(nonempty(F.transform(seen, lambda x: F.trim(x))), F.array().cast("array<string>")).alias("seen_as"))

    return F.filter(F.transform(F.from_json(names, "array<string>"), one), lambda x: x["term"] != "")


def upsert(entries: DataFrame, protected: DataFrame, batch: DataFrame, weight: str = "5") -> tuple[DataFrame, DataFrame]:
    """The dictionary with a batch (pos, term, seen_as) merged in, and (variant, term, reason) of what was refused.

    A known term (in any case) gains variants that are fit; new terms are
    appended with theirs. A variant is fit if its key is long enough, isn't the
    term, isn't mapped to another term (before, or earlier in the batch) and is
    within no other protected word. The first of new terms in a batch counts.
    """
    known = entries.select(F.lower("term").alias("low"), F.col("term").alias("known"), F.col("ord").alias("at"))
    known = known.groupBy("low").agg(F.max_by("known", "at").alias("known"), F.max("at").alias("at"))
    named = batch.withColumn("low", F.lower("term")).join(known, "low", "left")
    first = F.row_number().over(Window.partitionBy("low").orderBy("pos"))
    named = named.withColumn("nth", first).where("known is not null or nth = 1").withColumn("to", F.coalesce("known", "term"))
    wanted = named.select("pos", "to", "at", F.posexplode("seen_as").alias("k", "variant")).where("variant <> to")
    have = entries.select(F.explode("variants").alias("variant"), F.col("term").alias("mapped")).groupBy("variant").agg(F.first("mapped").alias("mapped"))
    wanted = wanted.join(have, "variant", "left").where("mapped is null or mapped <> to").withColumn("reason", F.coalesce(key_rejection(F.col("variant")), F.when(F.col("mapped").isNotNull(), "mapped")))
    inside = collisions(wanted.select("variant", F.col("to").alias("term")).distinct(), protected).where("kind = 'variant in word'").select("variant", F.lit("protected").alias("inside")).distinct()
    wanted = wanted.join(inside, "variant", "left").withColumn("reason", F.coalesce("reason", "inside"))
    # existing terms are served before new ones; within each, in the batch's order
    order = Window.partitionBy("variant").orderBy(F.col("at").isNull(), "pos", "k")
    fit = wanted.where("reason is null").withColumn("taken", F.first("to").over(order)).withColumn("nth", F.row_number().over(Window.partitionBy("variant", "to").orderBy(F.col("at").isNull(), "pos", "k")))
    refused = wanted.where("reason is not null").select("variant", F.col("to").alias("term"), "reason").unionByName(fit.where("taken <> to").select("variant", F.col("to").alias("term"), F.lit("mapped").alias("reason")))
    gained = fit.where("taken = to and nth = 1").groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "variant"))), lambda s: s["variant"]).alias("fresh"))
    none = F.array().cast("array<string>")
    old = entries.join(gained, entries["term"] == gained["to"], "left").select("ord", "term", "weight", F.concat("variants", F.coalesce("fresh", none)).alias("variants"))
    last = entries.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    new = named.where("known is null").select("pos", "term").join(gained, F.col("term") == F.col("to"), "left").crossJoin(F.broadcast(last))  # one row
    new = new.select((F.col("last") + F.row_number().over(Window.orderBy("pos"))).cast(entries.schema["ord"].dataType).alias("ord"), "term", F.lit(weight).alias("weight"), F.coalesce("fresh", none).alias("variants"))
    return old.unionByName(new), refused


def to_lines(entries: DataFrame) -> DataFrame:
    """(ord, value) in the dictionary's own format."""
    tail = F.when(F.size("variants") > 0, F.concat(F.lit("|"), F.array_join("variants", ","))).otherwise("")
    return entries.select("ord", F.concat("term", F.when((F.col("weight") != "") | (F.size("variants") > 0), F.concat(F.lit("|"), "weight")).otherwise(""), tail).alias("value"))


def rewritten(lines: DataFrame, entries: DataFrame, weight: str = "5") -> DataFrame:
    """(ord, value): the dictionary's file after an upsert. Lines of entries that gained variants are written anew, new entries come last; all other lines, comments and blanks among them, stay as they are.

    lines: (ord, value) of the file; entries: of :func:`upsert`, known by the ord of their line.
    """
    before = parse_entries(lines).select("ord", F.col("variants").alias("__had"))
    own = entries.select("ord", "term", F.coalesce(F.nullif("weight", F.lit("")), F.lit(weight)).alias("weight"), "variants")
    line = F.concat_ws("|", "term", "weight", F.when(F.size("variants") > 0, F.array_join("variants", ",")))
    known = own.join(before, "ord")
    gained = known.where(F.size(F.array_except("variants", "__had")) > 0).select(F.col("ord").alias("__ord"), line.alias("__line"))
    kept = lines.join(gained, F.col("ord") == F.col("__ord"), "left").select("ord", F.coalesce("__line", "value").alias("value"))
    return kept.unionByName(own.join(before, "ord", "left_anti").select("ord", line.alias("value")))


def lint(entries: DataFrame, protected: DataFrame) -> DataFrame:
    """One row: numbers of entries, mappings, protected words, refused keys, conflicts and collisions, and status 1 if there are conflicts or collisions."""
    table = corrections_table(entries)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(entries, "n_entries")
    for df, name in (
        (table, "n_mappings"), (protected, "n_protected"), (variants(entries).where("rejection is not null"), "n_rejected"), (conflicts(entries), "n_conflicts"), (collisions(table, protected), "n_collisions"),
    ):
        out = out.crossJoin(one(df, name))  # one row each
    return out.withColumn("status", F.when((F.col("n_conflicts") > 0) | (F.col("n_collisions") > 0), 1).otherwise(0))


def glossary_mappings(entries: DataFrame) -> dict[str, str]:
    """The mappings as a dict, without warnings."""
    return {r["variant"]: r["term"] for r in corrections_table(entries).limit(MOST_KEYS).collect()}


def apply_correct_table(text: Column, mappings: dict[str, str], protected: set[str] = frozenset()) -> Column:
    return Corrections(mappings, protected).apply(text)


def append_glossary(entries: DataFrame, protected: DataFrame, batch: DataFrame) -> int:
    """How many entries a batch adds."""
    return upsert(entries, protected, batch)[0].count() - entries.count()

"""Quality rules (operator 6).

A table of measures and their bounds is compiled into one projection of
built-in functions; no user function runs. Words are runs of characters other
than ``[\\x20\\x09-\\x0D]``.

Words in repeated windows are found by sorting, not by comparing windows with
each other: each 8-word window becomes a 64-bit hash; if all of a text's hashes
differ there are none. Otherwise (hash, place) pairs are sorted, neighbours
with equal hashes give the places of repeated windows, and each place in order
adds the words that the one before didn't cover. So a text of n words costs
n log n, however often it repeats itself.

Results: a null text has no words and all counts 0; it fails the base rule, as
empty texts do. Ratios of texts without words are 0. Rows are rated one by one,
so ties, repeated rows and empty tables need nothing special; very long texts
are rated whole. Input columns stay, but for one with the name of the output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to a in is it that for was on with as be at by this from or an are which "
    "la le les de des et un une du dans que qui est pour sur avec par au en pas "
    "der die das und ist von den mit zu ein eine im auf für nicht dem des sich als auch "
    "el los las y del se por con para una su al lo como más no".split()
)


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose measure lies within the bounds (None: unbounded), or that has fewer lines with a word than ``min_lines``."""

    measure: str
    least: float | None = None
    most: float | None = None
    min_lines: int = 0


#: The threshold table. Ratios are to n_words, but for dup_line_ratio (to lines with a word).
#: Shouted words are in capitals; an echo is a word equal to the word before it.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", most=0.20),
    Rule("shout_ratio", most=0.50),
    Rule("stop_word_ratio", least=0.04),
    Rule("echo_ratio", most=0.30),
    Rule("dup_line_ratio", most=0.50, min_lines=8),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, also where body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows found twice or more in the text, the first one included."""
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        last = F.when(F.size(places) > 0, window).otherwise(0)
        steps = F.transform(F.sequence(F.lit(2), F.size(places)), lambda i: F.least(F.lit(window), F.element_at(places, i) - F.element_at(places, i - 1)))
        return F.when(F.size(places) > 1, F.aggregate(steps, none, lambda a, x: a + x) + window).otherwise(last.cast("long"))

    def from_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(pairs, twice))

    def from_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.when(F.size(w) <= window, none).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window))), from_hashes))

    return from_words(words)


def measures(words: Column, text: Column) -> Column:
    """One struct of all counts, from the words and the text (not null)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER))

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("distinct"))

    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_shouted"),
        F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))).cast("long").alias("n_echoes"),
        let(lines, of_lines).alias("lines"),
    )


def verdict(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if each rule of the table holds."""
    words = F.greatest(found["n_words"], F.lit(1))
    n_lines = F.greatest(found["lines"]["n"], F.lit(1))
    known = {
        "mean_word_chars": found["word_chars"] / words,
        "symbol_ratio": found["n_symbols"] / words,
        "shout_ratio": found["n_shouted"] / words,
        "stop_word_ratio": found["n_stop_words"] / words,
        "echo_ratio": found["n_echoes"] / words,
        "dup_line_ratio": (found["lines"]["n"] - found["lines"]["distinct"]) / n_lines,
    }
    held = F.lit(True)
    for rule in rules:
        within = F.lit(True)
        if rule.least is not None:
            within = within & (known[rule.measure] >= rule.least)
        if rule.most is not None:
            within = within & (known[rule.measure] <= rule.most)
        held = held & (within | (found["lines"]["n"] < rule.min_lines) if rule.min_lines else within)
    return held


def rate_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rated: str = "rated") -> DataFrame:
    """Adds ``rated``: the counts, base_failed and kept of each whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_shouted", "n_echoes")]
        return F.struct(*counts, (m["lines"]["n"] - m["lines"]["distinct"]).cast("long").alias("n_dup_lines"), base.alias("base_failed"), (~base & verdict(m, rules)).alias("kept"))

    return docs.withColumn(rated, let(word_array(whole), lambda w: let(measures(w, whole), judged)))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return rate_quality(docs, text, rules, "__rated").where("__rated.kept").select(*docs.columns)

"""Fidelity gates between a source text and its cleaned version.

Words are counted as multisets within a row that holds both texts, so nothing is
shuffled by words, however common they are; a row is one document's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.automata import shared_words
from textloom.functions.numerals import numerals
from textloom.functions.text import found_all, let, norm_words, spaced_words

# fixed values: the gates
GATE, ADDED, TOLERANCE = 0.98, 0.05, 0.0

# fixed values
NOISE = r"(?i)\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?|Speaker\s*\d+"
ARABIC = r"(\d+(?:\.\d+)?)\s*(千万|百万|万|亿|k|K|M|B)?"
SCALES = {"千万": 1e7, "百万": 1e6, "万": 1e4, "亿": 1e8, "k": 1e3, "K": 1e3, "M": 1e6, "B": 1e9}
NUMERAL = "[〇零一二三四五六七八九十百千万亿两]{1,16}"
YEAR = r"(\d{1,4})\s*年"
LATIN = r"[A-Za-z][A-Za-z0-9.+\-]{2,}"
LATIN_STOP = (
    "the", "and", "for", "you", "that", "this", "with", "have", "not", "okay", "yeah", "just", "like", "what", "then", "they", "was", "are", "http",
    "https", "com", "www", "speaker", "part", "call", "fine", "shop", "seed", "scale", "local", "cloud", "feel", "favor", "beats", "million", "benefit",
)


def coverage(df: DataFrame, id_: str = "doc_id", source: str = "source", output: str = "output", gate: float = GATE) -> DataFrame:
    """(id, n_source, coverage, added_ratio, ok): the share of source words kept, and words added; 1.0 and 0.0 for no words."""
    out = df.withColumn("__w", shared_words(spaced_words(F.col(source)), spaced_words(F.col(output))))
    n = F.col("__w.n")
    cov, added = F.when(n > 0, F.col("__w.kept") / n).otherwise(1.0), F.when(n > 0, F.col("__w.added") / n).otherwise(0.0)
    return out.select(id_, n.alias("n_source"), cov.alias("coverage"), added.alias("added_ratio"), (cov >= gate).alias("ok"))


def window_coverage(windows: DataFrame, output: DataFrame, id_: str = "doc_id", window: str = "window", text: str = "text", out_text: str = "text", gate: float = GATE, margin: int = 150) -> DataFrame:
    """(id, window, coverage, ok) of source windows against their place in the output.

    A window of source words [a, b) is compared with the output's slice
    [a n / T - m, b n / T + m), m the margin or half the slice if that is more.
    Each document's windows and output meet in one row, where the output is cut
    into the slices of all its windows; nothing is dealt by words.
    """
    own = windows.select(id_, window, F.trim(spaced_words(F.col(text))).alias("words")).withColumn("size", F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).cast("long"))
    upto = Window.partitionBy(id_).orderBy(window)
    own = own.withColumn("b", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    listed = own.groupBy(id_).agg(F.sum("size").alias("total"), F.collect_list(F.struct(window, "words", (F.col("b") - F.col("size")).alias("a"), "b")).alias("ws"))  # one document's windows
    out = output.select(id_, norm_words(F.col(out_text)).alias("out")).withColumn("n", F.size("out").cast("long"))

    def with_slice(w: Column) -> Column:
        place = lambda at: F.floor(at * F.coalesce("n", F.lit(0).cast("long")) / F.greatest("total", F.lit(1)))
        m = F.greatest(F.lit(margin).cast("long"), F.floor((place(w["b"]) - place(w["a"])) / 2))
        lo, hi = F.greatest(place(w["a"]) - m, F.lit(0).cast("long")), F.least(place(w["b"]) + m, F.col("n"))
        return F.struct(w[window].alias(window), w["words"].alias("words"), F.array_join(F.slice("out", lo.cast("int") + 1, F.greatest(hi - lo, F.lit(0).cast("long")).cast("int")), " ").alias("there"))

    cut = listed.join(out, id_, "left").select(id_, F.explode(F.transform("ws", with_slice)).alias("s"))
    counted = cut.select(id_, f"s.{window}", shared_words(F.col("s.words"), F.col("s.there")).alias("w"))
    cov = F.when(F.col("w.n") > 0, F.col("w.kept") / F.col("w.n")).otherwise(1.0)
    return counted.select(id_, window, F.bround(cov, 4).alias("coverage"), (cov >= gate).alias("ok"))


def gate_report(whole: DataFrame, by_window: DataFrame, id_: str = "doc_id", window: str = "window", gate: float = GATE) -> DataFrame:
    """One row for each document: both gates, all windows, and the worst (the first of equals)."""
    per = by_window.groupBy(id_).agg(
        F.array_sort(F.collect_list(F.struct(F.col(window).alias("index"), "coverage", "ok"))).alias("windows"), F.min(F.struct("coverage", F.col(window).alias("index"))).alias("w"), F.bool_and("ok").alias("all_ok")
    )
    out = whole.join(per, id_, "left")
    return out.select(id_, "coverage", "added_ratio", (F.col("added_ratio") > ADDED).alias("added_warning"), (F.col("ok") & F.coalesce("all_ok", F.lit(True))).alias("ok"), "windows", F.struct("w.index", "w.coverage").alias("worst_window"))


def finalize(df: DataFrame, corrections, windows: DataFrame | None = None, id_: str = "doc_id", source: str = "source", output: str = "output", gate: float = GATE) -> DataFrame:
    """The gate run: corrections on both sides, then coverage of whole texts and, if windows (id, window, text) of the source are given, of each.

    One row for each document, as in :func:`gate_report`. A window of the
    source is corrected like the source, so known errors are no losses.
    """
    own = df.select(id_, corrections.apply(F.col(source)).alias("source"), corrections.apply(F.col(output)).alias("output"))
    whole = coverage(own, id_, gate=gate)
    if windows is None:
        windows = own.select(id_, F.lit(0).alias("window"), F.lit("").alias("text")).where("false")
    else:
        windows = windows.withColumn("text", corrections.apply(F.col("text")))
    return gate_report(whole, window_coverage(windows, own.select(id_, F.col("output").alias("text")), id_, gate=gate), id_, gate=gate)


def denoise(text: Column) -> Column:
    return F.regexp_replace(text, NOISE, " ")


def arabic_values(text: Column) -> Column:
    """Distinct numbers, multiplied by the scale after them."""
    own = denoise(text)
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    pairs = F.zip_with(found_all(own, ARABIC, 1), found_all(own, ARABIC, 2), lambda n, s: n.try_cast("double") * F.coalesce(F.try_element_at(scales, s), F.lit(1.0)))
    return F.array_distinct(F.array_compact(pairs))


def year_values(text: Column) -> Column:
    return F.array_distinct(F.transform(found_all(denoise(text), YEAR, 1), lambda y: y.cast("double")))


def source_values(text: Column) -> Column:
    """What must not get lost: numbers, without those that stand before a year sign anywhere."""
    return F.array_except(arabic_values(text), year_values(text))


def target_values(text: Column) -> Column:
    """What may account for them: numbers and Chinese numerals."""
    return F.array_union(arabic_values(text), numerals(found_all(denoise(text), NUMERAL)))


def latin_terms(text: Column) -> Column:
    """Lower-case Latin terms of four characters or more, without the stop list, with repeats."""
    return F.filter(F.transform(found_all(text, LATIN), lambda t: F.lower(t)), lambda t: (F.length(t) >= 4) & ~t.isin(*LATIN_STOP))


def audit(df: DataFrame, raw: str = "raw", clean: str = "clean", report_most: int = 40) -> DataFrame:
    """Adds missing numbers (hard gate), years and Latin terms (soft), ratio and status; lists are cut for the report only."""
    src, out = source_values(F.col(raw)), target_values(F.col(clean))
    df = df.withColumn("__src", src).withColumn("__out", out).withColumn("__latin", latin_terms(F.col(raw)))
    # terms that occur twice stand side by side once sorted
    twice = let(F.sort_array("__latin"), lambda s: F.array_distinct(F.filter(s, lambda t, i: F.coalesce(F.get(s, i + 1) == t, F.lit(False)))))
    df = df.withColumn("missing_values", F.array_sort(F.array_except("__src", "__out"))).withColumn("missing_years", F.array_sort(F.array_except(year_values(F.col(raw)), "__out")))
    df = df.withColumn("missing_latin", let(F.lower(clean), lambda low: F.array_sort(F.filter(twice, lambda t: ~F.contains(low, t)))))
    df = df.withColumn("missing_ratio", F.when(F.size("__src") > 0, F.size("missing_values") / F.size("__src")).otherwise(0.0)).withColumn("status", F.when(F.col("missing_ratio") > TOLERANCE, 1).otherwise(0))
    for c in ("missing_values", "missing_years", "missing_latin"):
        df = df.withColumn(f"{c}_shown", F.slice(c, 1, report_most))
    return df.drop("__src", "__out", "__latin")


def turn_ratio(rendered_turns: Column, source_turns: Column, rendered_sents: Column, source_sents: Column, gate: float = 0.85) -> Column:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return F.least(ratio(rendered_turns, source_turns), ratio(rendered_sents, source_sents)) >= gate


def must_check(text: Column, n_terms: Column, window: Column) -> Column:
    """Windows that a fidelity check reads: with figures, terms or doubts, and every third other."""
    return text.rlike(r"\d|⟨\?") | (n_terms >= 2) | (window % 3 == 0)


def same_content(deployed: DataFrame, local: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, same): whether what is deployed is what was built, for all that was built."""
    a = local.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("a"))
    b = deployed.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("b"))
    return a.join(b, key, "left").select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))

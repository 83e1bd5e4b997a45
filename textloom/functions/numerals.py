"""Chinese numerals as column expressions.

A numeral is cut at its big units (10^4 and 10^8) into sections. A section is
worth the sum of its small units, each times the last digit before it (one if
there is none), and of the digit after the last of them. Each part is read off
with a pattern; nothing is read character by character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

# fixed values
DIGITS = ("〇零一二两三四五六七八九", "001223456789")
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
BIG_UNITS = {"万": 10_000, "亿": 100_000_000}


def _digit(section: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(section, pattern, 1), F.lit("")).cast("double")


def _section(section: Column) -> Column:
    """Worth of small units and digits, which may be 0."""
    worth = F.lit(0.0)
    for unit, value in SMALL_UNITS.items():
        worth = worth + F.when(section.contains(unit), F.coalesce(_digit(section, f"([1-9])0*{unit}"), F.lit(1.0)) * value).otherwise(0.0)
    # a digit after hundreds or thousands counts in the next lower unit, unless a zero stands in the section
    place = F.when(section.contains("0"), 1.0)
    for unit, value in SMALL_UNITS.items():
        place = place.when(section.rlike(f"{unit}[0-9]*$"), value / 10)
    return worth + F.coalesce(_digit(section, "([1-9])0*$") * place.otherwise(1.0), F.lit(0.0))


def _read(own: Column) -> Column:
    """The value of a run with digits as 0 to 9; null if it isn't one number."""
    parts = F.regexp_extract_all(own, F.lit("[0-9十百千]*[万亿]|[0-9十百千]+$"), F.lit(0))

    def worth(part: Column) -> Column:
        body = _section(F.regexp_replace(part, "[万亿]", ""))
        lifted = F.coalesce(F.nullif(body, F.lit(0.0)), F.lit(1.0))
        for unit, value in BIG_UNITS.items():
            body = F.when(part.endswith(unit), lifted * value).otherwise(body)
        return body

    repeated, bare = own.rlike(r"([十百千万亿]).*\1"), own.rlike("^(?!十.)[十百千万亿]+$")
    return (
        F.when(~own.rlike("^[0-9十百千万亿]+$") | repeated | bare, F.lit(None).cast("double"))
        .when(own.rlike("^[0-9]+$"), own.try_cast("double"))
        .otherwise(F.nullif(F.aggregate(F.transform(parts, worth), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))
    )


def numeral(run: Column) -> Column:
    """Value of a Chinese numeral; null for what isn't one number (bare units, a unit twice). Digits alone are read place by place."""
    return let(F.translate(run, *DIGITS), _read)


def numerals(runs: Column) -> Column:
    """Distinct values of an array of numerals, ascending."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(runs, numeral))))

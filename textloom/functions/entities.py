"""HTML5 character references as column expressions, by the standard's own table."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference: decimal, hexadecimal, or a name, which some may have without a semicolon.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def _char(number: Column) -> Column:
    """The character of a number; the replacement character beyond Unicode, nothing for what is no character."""
    own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    low = F.split(F.lit("\ue000".join(html.unescape(f"&#{n};") for n in range(0xA0))), "\ue000")  # control characters have a reading of their own
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "�")
        .when(number < 0xA0, F.get(low, number.cast("int"))).when(nothing, "").otherwise(own)
    )


@cache
def _names() -> tuple[str, str]:
    """Names with their characters, as one text, and a pattern of the names that need no semicolon, the longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "\ue001".join(f"{name}\ue000{chars}" for name, chars in html5.items()), "^&(" + "|".join(bare) + ")"


def _named(reference: Column) -> Column:
    """The whole name if there is one, else the longest name it begins with, with what follows; else as it is."""
    pairs, bare = _names()
    table = F.str_to_map(F.lit(pairs), F.lit("\ue001"), F.lit("\ue000"))  # one literal, made into a map once
    begins = F.regexp_extract(reference, bare, 1)
    return F.coalesce(
        F.try_element_at(table, F.substr(reference, F.lit(2), F.length(reference))),
        F.when(begins != "", F.concat(F.try_element_at(table, begins), F.substr(reference, F.length(begins) + 2, F.length(reference)))),
        reference,
    )


def decoded(reference: Column) -> Column:
    """What one reference stands for. Numbers of more than eight digits are beyond Unicode, whatever they are."""
    digits = lambda pattern: F.regexp_replace(F.regexp_extract(reference, pattern, 1), "^0+(?=.)", "")
    number = lambda text, base: F.when(F.length(text) <= 8, F.conv(text, base, 10).cast("long"))
    return (
        F.when(reference.rlike("^&#[xX]"), _char(number(digits("^&#[xX]([0-9a-fA-F]+)"), 16)))
        .when(reference.startswith("&#"), _char(number(digits("^&#([0-9]+)"), 10)))
        .otherwise(_named(reference))
    )


def chosen(names: tuple[str, ...]) -> tuple[str, Callable[[Column], Column]]:
    """A pattern of the references by these names, each closed by its semicolon, and what one of them stands for."""
    table = F.create_map(*[F.lit(x) for n in names for x in (f"&{n};", html5[f"{n};"])])
    return f"&(?:{'|'.join(names)});", lambda reference: F.element_at(table, reference)

"""Benchmark decontamination (operator 8).

Texts are normalised to words: runs of ASCII letters and digits and of all
characters beyond ASCII, with A-Z lower-cased. A benchmark item is cut into
windows of ``width`` consecutive words; an item with fewer words, but not none,
is one window. All windows go into one Aho-Corasick automaton over the
normalised text, in which each word of the benchmark is written as its number
and all other words as one character, so patterns are short, whatever their
words are. A document is scanned once; a match ends at a word, from which
offsets are mapped on to code points of the original.

The benchmark is a query set given from outside. It is read in blocks of at most
``block_bytes`` of text (about 250 bytes of automaton for each of them); each
block is an automaton of its own, broadcast, and scans of up to ``CHAIN`` blocks
follow one another in one pass over the documents, each adding to what the ones
before found. A benchmark of more blocks takes a pass for each ``CHAIN`` of them,
with a table between, so that workers build each automaton once. That needs no
shuffle, and no block outgrows a worker.

Results: a null text, of a document or an item, has no words; such documents
get zero counts and such items never occur. Items with equal texts are all
reported, in order of their ids. Null item ids are skipped. Repeated rows get
equal results; very long texts are scanned whole; empty tables of documents or
items give no rows and no hits. Input columns stay, but for one with the name of
the output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import CHAIN, Shared
from textloom.llm.stored import drop, store_at

WIDTH = 10
#: Characters that separate words, as a table for bytes: all ASCII but digits and letters become spaces.
TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() and chr(c).islower() or chr(c).isdigit() else c + 32 if chr(c).isupper() and c < 0x80 else 0x20 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}

FOUND = "struct<n_words:bigint,hits:array<int>,items:array<bigint>,spans:array<struct<start:int,end:int>>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("spans", pa.list_(_SPAN))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split(b" ")


#: A word of the benchmark is written as digits of this base, the first one from an alphabet of its own: no place in the automaton has more ways on.
BASE, FIRST, LATER = 32, 0x100, 0x80
OTHER = "\x01"


def code(number: int, digits: int) -> str:
    own = [number // BASE**k % BASE for k in range(digits - 1, -1, -1)]
    return chr(FIRST + own[0]) + "".join(chr(LATER + d) for d in own[1:])


class Scanner:
    """The automaton over one block of items, given as (item id, text)."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        listed = [(item, [w for w in words(text) if w]) for item, text in items]
        known = list(dict.fromkeys(w for _, own in listed for w in own))
        digits = next(d for d in range(1, 9) if BASE**d >= len(known))
        self.codes = {w: code(i, digits) for i, w in enumerate(known)}
        held: dict[str, tuple[int, ...]] = {}
        for item, own in listed:
            coded, alone = "".join([self.codes[w] for w in own]), (item,)
            for i in range(max(1, len(own) - width + 1) if own else 0):
                window = coded[i * digits : (i + width) * digits]
                before = held.get(window)
                held[window] = alone if before is None or before == alone else tuple(sorted({*before, item}))
        self.automaton = ahocorasick.Automaton()
        values: dict[tuple, tuple] = {}
        for window, found in held.items():
            key = (len(window) // digits, found)
            self.automaton.add_word(window, values.setdefault(key, key))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def scan(self, text: str | None) -> tuple[int, set[int], set[int]]:
        """How many words, the places of those hit, and the items found."""
        own = [w for w in words(text) if w]
        hits: set[int] = set()
        items: set[int] = set()
        if own and not self.empty:
            known = self.codes.get
            coded = [known(w, OTHER) for w in own]
            last: dict[int, int] = {}  # of the places where a word's code ends, the word
            for end, (n, found) in self.automaton.iter("".join(coded)):
                last = last or {at - 1: i for i, at in enumerate(accumulate(map(len, coded)))}
                hits.update(range(last[end] - n + 1, last[end] + 1))
                items.update(found)
        return len(own), hits, items


def spans(text: str, hits: set[int]) -> list[dict]:
    """Code points of the original from the first to past the last of each run of hit words."""
    out: list[dict] = []
    before = -2
    for i, m in enumerate(WORD.finditer(text.translate(TO_LOWER))):
        if i in hits:
            if i == before + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            before = i
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text, an item at a time; at least one block."""
    block: list[tuple[int, str]] = []
    room = block_bytes
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        size = len(row["t"].encode("utf-8", "surrogatepass"))
        if block and size > room:
            yield block
            block, room = [], block_bytes
        block.append((row["i"], row["t"]))
        room -= size
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = 400_000, found: str = "found"
) -> DataFrame:
    """Adds ``found``: number of words, places of words hit, items that occur, spans hit in code points of the text."""
    before, path = F.lit(None).cast(FOUND), None
    for k, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        if k and k % CHAIN == 0:
            docs, at = store_at(docs)
            if path:
                drop(docs.sparkSession, path)
            path = at
        docs = docs.withColumn(found, _scan_column(Shared(docs.sparkSession, Scanner, block, width), text, before))
        before = F.col(found)
    return docs


def _scan_column(shared: Shared, text: str, before):
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        scanner, out = shared.get(), []
        for t, e in zip(texts, earlier):
            own, was = t.as_py(), e.as_py()
            n, hits, items = scanner.scan(own)
            if was:
                hits |= set(was["hits"])
                items |= set(was["items"])
            out.append({"n_words": n, "hits": sorted(hits), "items": sorted(items), "spans": spans(own, hits) if hits else []})
        return pa.array(out, _FOUND)

    return scan(F.col(text), before)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    columns = docs.columns
    return find_contamination(docs, benchmark, found="__found", **options).where(F.size("__found.hits") == 0).select(*columns)

"""Aho-Corasick automata over many keys, and counts of words, in Arrow-batched functions."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a worker is given at a time.
BLOCK_KEYS = 100_000
_made: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, keys: dict[str, object]) -> ahocorasick.Automaton:
    """Made once in a worker; the latest few are kept."""
    if name not in _made:
        while len(_made) >= 4:
            _made.pop(next(iter(_made)))
        own = ahocorasick.Automaton()
        for key, value in keys.items():
            own.add_word(key, value)
        own.make_automaton()
        _made[name] = own
    return _made[name]


def name_of(keys: dict[str, object]) -> str:
    return hashlib.sha256("\x00".join(f"{k}={v}" for k, v in keys.items()).encode("utf-8", "surrogatepass")).hexdigest()


def blocks(rows: DataFrame, most: int) -> Iterator[dict[str, tuple[str, ...]]]:
    """Values by key, a block of keys at a time; rows: (key, value), which come in order of keys."""
    block: dict[str, tuple[str, ...]] = {}
    for r in rows.orderBy("key", "value").toLocalIterator():
        if r["key"] not in block and len(block) >= most:
            yield block
            block = {}
        block[r["key"]] = (*block.get(r["key"], ()), r["value"])
    if block:
        yield block


def values_in(keys: dict[str, tuple[str, ...]]):
    """Of a text, the values of all keys that occur in it."""
    name = name_of(keys)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(texts: pa.Array) -> pa.Array:
        own = automaton(name, keys)
        return pa.array([sorted({x for _, values in own.iter(t.as_py()) for x in values}) if t.as_py() else [] for t in texts], pa.list_(pa.string()))

    return found


def places_in(keys: dict[str, tuple[str, ...]]):
    """Of a text of words between single spaces, one before the first and one after the last: the keys (words with the spaces around them) that occur, and before how many words each does first."""
    name, coded = name_of(keys), {k: (len(k), k) for k in keys}

    @F.arrow_udf(T.ArrayType(T.StructType().add("key", T.StringType()).add("pos", T.IntegerType())))
    def found(texts: pa.Array) -> pa.Array:
        own, out = automaton(name, coded), []
        for t in texts:
            text, first = t.as_py() or "", {}
            for end, (size, key) in own.iter(text):
                first.setdefault(key, end - size + 1)
            out.append([{"key": k, "pos": text.count(" ", 0, at + 1) - 1} for k, at in sorted(first.items())])
        return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("pos", pa.int32())])))

    return found


SHARED = T.StructType().add("n", T.LongType()).add("kept", T.LongType()).add("added", T.LongType())


def shared_words(source, output):
    """Of texts of words between spaces: struct of n (words of the source), kept (those of them that the output has, as often as it has them) and added (words of the output beyond these)."""

    @F.arrow_udf(SHARED)
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            own, other = (x.as_py() or "").split(), (y.as_py() or "").split()
            kept = len(own) if own == other else (Counter(own) & Counter(other)).total()
            out.append((len(own), kept, len(other) - kept))
        return pa.array([dict(zip(("n", "kept", "added"), r)) for r in out], pa.struct([(c, pa.int64()) for c in ("n", "kept", "added")]))

    return counted(source, output)

"""Byte-level BPE encoding and decoding (operator 2).

Bytes are mapped to Latin-1 characters so that pyahocorasick can index the
vocabulary. One scan of a piece finds the longest token that begins at each
byte. From there the encoder walks forward with longest tokens and steps back
to shorter ones where two neighbours don't stand (``MergeOrder.apart``,
memoised); a byte position that leads nowhere is marked, so each is left at
most once per token that begins there and the walk is linear in the piece.

Results: a null text is encoded as an empty one (no ids). Empty texts give no
ids, which decode to no bytes. Parts of a text that the pattern doesn't match
have no ids. Rows are encoded one by one, so ties, repeated rows, very long
texts and empty tables need nothing special; input columns
stay, but for one with the name of the output, which is replaced.
"""

from __future__ import annotations

import base64
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.merges import MergeOrder
from textloom.llm.shared import Shared, read_file

#: Twice so many words, and pieces, at most are kept with their ids by each worker; with ``LONGEST`` (below) that bounds them to some 60 MB.
WORDS, PIECES = 100_000, 30_000
#: Longer keys are not kept.
LONGEST = 64
#: White space other than spaces and line breaks.
RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


#: The piece pattern (fixed) of which ``packed`` knows how it cuts at spaces and after letters; texts are cut piece by piece for any other.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Memo:
    """A bounded memo of strings in two generations: what is still asked for moves to the younger one."""

    def __init__(self, make, most: int):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def fill(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST:
                return found
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = found
        return found


def read_ranks(rank_file: bytes) -> dict[str, int]:
    """Ids by the tokens' bytes, as Latin-1 characters."""
    return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


class Decoder:
    """The bytes of all ids, in arrays."""

    def __init__(self, rank_file: bytes):
        text = {i: s for s, i in read_ranks(rank_file).items()}
        parts = [text.get(i, "").encode("latin-1") for i in range(max(text) + 1)]
        self.width = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each id has."""
        width = self.width[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(self.start[ids] - (ends - width), width)
        return self.bytes[place], width


class ByteBPE(Decoder):
    """Encoder, and decoder, for one rank file and one piece pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        super().__init__(rank_file)
        self.ids = read_ranks(rank_file)
        self.order = MergeOrder(self.ids)
        self.pieces = lambda text, cut=regex.compile(pattern).finditer: [m.group() for m in cut(text)]  # whatever groups the pattern has
        self.by_words = pattern == WORD_PATTERN
        self.pack = lambda ids: struct.pack(f"{len(ids)}i", *ids)
        self.index = ahocorasick.Automaton()
        for s in self.ids:
            if len(s) > 1:  # single bytes are all tokens, and are found without the index
                self.index.add_word(s, (len(s) - 1, s))
        self.index.make_automaton()
        self.by_piece = Memo(self.piece_ids, PIECES)
        self.by_word = Memo(self.word_ids, WORDS)
        self.cut: dict[str, str | None] = {}

    def shorter(self, token: str) -> str | None:
        """The longest token that is a proper prefix of the token."""
        if token not in self.cut:
            self.cut[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)
        return self.cut[token]

    def tokens(self, piece: str) -> list[str]:
        """The tokens of one piece, whose bytes are given as Latin-1 characters."""
        if piece in self.ids:
            return [piece]
        longest = list(piece)
        for end, (back, token) in self.index.iter(piece):
            longest[end - back] = token  # ends ascend: the last one is the longest
        known, apart, shorter, size = self.order.known, self.order.apart, self.cut, len(piece)
        out, at, dead, before = [], 0, set(), ""
        token: str | None = longest[0]
        while True:
            row = known.get(before) or {}
            while token is not None:
                end = at + len(token)
                if end not in dead and ((fit := row.get(token)) or fit is None and apart(before, token)):
                    break
                token = shorter[token] if token in shorter else self.shorter(token)
            if token is None:  # nothing fits here: take the token before it back and shorten that
                dead.add(at)
                token = out.pop()
                at -= len(token)
                before = out[-1] if out else ""
                continue
            out.append(token)
            if end == size:
                return out
            at, before = end, token
            token = longest[at]

    def piece_ids(self, piece: str) -> bytes:
        ids = self.ids
        return self.pack([ids[t] for t in self.tokens(piece if piece.isascii() else piece.encode().decode("latin-1"))])

    def word_ids(self, word: str) -> bytes:
        """Ids of a word with the space before it; letters alone are one piece, and a mark after letters is one."""
        if word.isalpha():
            return self.piece_ids(" " + word)
        letters, mark = word[:-1], word[-1]
        if mark in ".,;:!?" and letters.isalpha():
            return (self.by_word.young.get(letters) or self.by_word.fill(letters)) + self.piece_ids(mark)
        return self.by_pieces(" " + word)

    def by_pieces(self, text: str) -> bytes:
        known, fill = self.by_piece.young.get, self.by_piece.fill
        return b"".join([known(p) or fill(p) for p in self.pieces(text)])

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit numbers. Where each space stands alone between words, pieces begin at the spaces, and words are looked up whole."""
        if not self.by_words or "\n " in text or " \n" in text or RARE(text):
            return self.by_pieces(text)
        first, *words = text.split(" ")
        if not first or "" in words:
            return self.by_pieces(text)
        known, fill = self.by_word.young.get, self.by_word.fill
        return self.by_pieces(first) + b"".join([known(w) or fill(w) for w in words])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def share(spark: SparkSession, rank_path: str, pattern: str) -> Shared:
    return Shared(spark, ByteBPE, read_file(rank_path), pattern)


def encode_column(shared: Shared, text: Column) -> Column:
    """array<int> of the ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec, ends, flat = shared.get(), [0], []
        for t in texts:
            got = codec.packed(t.as_py() or "")
            flat.append(got)
            ends.append(ends[-1] + len(got) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))

    # not to be computed anew within each expression that uses the ids, such as their decoding
    return ids.asNondeterministic()(text)


def decode_column(shared: Shared, ids: Column) -> Column:
    """binary of the bytes of an array<int> column; null for null."""

    @F.arrow_udf("binary")
    def decoded(batch: pa.Array) -> pa.Array:
        codec, out = shared.get(), []
        offsets, values = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
        for i, there in enumerate(batch.is_valid().to_pylist()):
            out.append(codec.decode_flat(values[offsets[i] : offsets[i + 1]])[0].tobytes() if there else None)
        return pa.array(out, pa.binary())

    return decoded(ids)


def bpe_round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each whole text and the bytes that these ids stand for, by one codec in one pass."""
    shared = share(df.sparkSession, rank_path, pattern)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        codec, ends, flat, parts = shared.get(), [0], [], []
        for t in texts:
            flat.append(codec.packed(t.as_py() or ""))
            ends.append(ends[-1] + len(flat[-1]) // 4)
            parts.append(codec.decode_flat(np.frombuffer(flat[-1], np.int32))[0].tobytes())
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
        return pa.StructArray.from_arrays([listed, pa.array(parts, pa.binary())], ["ids", "decoded"])

    out = df.withColumn("__both", both.asNondeterministic()(F.col(text)))
    return out.withColumn(ids, F.col("__both.ids")).withColumn(decoded, F.col("__both.decoded")).drop("__both")


def bpe_encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text."""
    return df.withColumn(ids, encode_column(share(df.sparkSession, rank_path, pattern), F.col(text)))


def bpe_decode(df: DataFrame, rank_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    return df.withColumn(decoded, decode_column(Shared(df.sparkSession, Decoder, read_file(rank_path)), F.col(ids)))

"""Token counts by a compiled finite-state tokenizer (operator 4).

The model is a sentencepiece BPE vocabulary with byte fallback and without a
normaliser. It is compiled, as texts need it, into a deterministic transducer
over characters. Each transition is annotated with the tokens emitted: by how
much the token count of the text read so far changes (a character that joins
the token before it emits 0, and one that joins several of them fewer).

A state holds what later characters can depend on: the longest suffix read
that some longer token begins with, and for each place in it the last token of
the text up to there with its relative count. The token that ends at a new
character is the one token that stands next to the last token before it
(``MergeOrder.apart``); exactly one does.

Texts are cut into chunks. A chunk's state map says, for each state in which it
can be entered, in which state it is left and how many tokens are emitted. Few
states can be: no token spans the border before a run of spaces or at a line
break, so a chunk with such a border is left in one state, however it was
entered, and only the characters before its first border (the head) depend on
the entry. What comes after the head is run once for each chunk, on its own.
State maps of neighbouring chunks compose associatively; the prefix scan
composes them pair by pair.

Results: a null text counts as empty, with no tokens. Rows are counted one by
one, so ties, repeated rows and empty tables need nothing special; a very long
text is counted whole, in time linear in its length. Input columns stay, but for
those with the names of outputs (n_bytes, n_tokens, over_limit).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import Memo
from textloom.llm.merges import MergeOrder
from textloom.llm.shared import Shared, read_file

SPACE = "▁"
CHUNK = 4096
#: Bounds on what one worker keeps of the compiled transducer; past them it is compiled anew.
STATES, WORDS = 150_000, 250_000
#: Runs without a border inside: spaces with what follows them, or what follows a line break.
RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+").findall
BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}|\n")


#: What a model must count as its library does, to be compiled: no normaliser, a space put first, byte fallback, merges by score.
PROBES = ("a", " a", "a  b ", "\ufb01 \u2460\uff21 e\u0301", "\x01\U000f0000\n\n x", "Hello hello HELLO, wörld; 12345 + 67.", "aaaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over", "\t\u00a0\u3000.")


@dataclass(frozen=True)
class Chunk:
    """The head of a chunk, the tokens emitted after it, and the state that the chunk is left in (None: no border, all of it is head)."""

    head: str
    emitted: int = 0
    leaves: int | None = None


#: From the state entered in to the state left in and the tokens emitted.
StateMap = dict[int, tuple[int, int]]


class CountTransducer:
    FRESH = 0

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("tokens that continue past a space or line break are not supported")
        self.atoms = {p for p in pieces if len(p) == 1}
        by_score = sorted((-sp.get_score(i), i) for i in ids if len(sp.id_to_piece(i)) > 1)
        self.rank = {sp.id_to_piece(i): n for n, (_, i) in enumerate(by_score)}
        self.order = MergeOrder(self.rank)
        self.begins = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.words = Memo(self.word, WORDS)
        self.restart()
        for probe in PROBES:
            if self.count(probe, 3) != len(sp.encode(probe)):
                raise ValueError(f"a model that counts the tokens of {probe!r} by other rules is not supported")

    def restart(self) -> None:
        fresh = ("", (None,), (0,))
        self.states = [fresh]
        self.number = {fresh: self.FRESH}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def compile_move(self, state: int, char: str) -> tuple[int, int]:
        """The transition for one character, made when it is first needed."""
        if char not in self.atoms:  # byte fallback: a token for each byte
            move = (self.FRESH, len(char.encode("utf-8", "surrogatepass")))
            self.moves[state][char] = move
            return move
        suffix, lasts, counts = self.states[state]
        suffix += char
        n = len(suffix)
        for size in range(n, 0, -1):
            token, before = suffix[n - size :], lasts[n - size]
            if (token in self.rank or size == 1) and (self.order.reachable(token) if before is None else self.order.apart(before, token)):
                break
        emitted = counts[n - size] + 1
        lasts, counts = (*lasts, token), (*(c - emitted for c in counts), 0)
        while suffix and suffix not in self.begins:
            suffix, lasts, counts = suffix[1:], lasts[1:], counts[1:]
        gone = [i for i in range(1, len(suffix)) if suffix[i:] not in self.begins]
        if gone:  # no later token begins in these places
            lasts = tuple("" if i in gone else x for i, x in enumerate(lasts))
            counts = tuple(0 if i in gone else x for i, x in enumerate(counts))
        key = (suffix, lasts, counts)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][char] = (to, emitted)
        return to, emitted

    def run(self, state: int, text: str) -> tuple[int, int]:
        moves, total = self.moves, 0
        for char in text:
            move = moves[state].get(char) or self.compile_move(state, char)
            state = move[0]
            total += move[1]
        return total, state

    def word(self, run: str) -> int:
        """Tokens of a run between two borders, the smallest chunk."""
        return self.run(self.FRESH, run)[0]

    def chunk(self, text: str) -> Chunk:
        border = BORDER.search(text)
        if border is None:
            return Chunk(text)
        runs = RUNS(text, border.start())
        emitted, state = self.run(self.FRESH, runs.pop())
        known, fill = self.words.young.get, self.words.fill
        total = sum([(known(r) or fill(r)) if len(r) <= 48 else self.word(r) for r in runs])
        return Chunk(text[: border.start()], total + emitted, state)

    def state_map(self, chunk: Chunk, entries: set[int]) -> StateMap:
        out = {}
        for entry in entries:
            emitted, state = self.run(entry, chunk.head)
            out[entry] = (state if chunk.leaves is None else chunk.leaves, emitted + chunk.emitted)
        return out

    def state_maps(self, chunks: list[Chunk], entry: int) -> list[StateMap]:
        """Of each chunk, over the states in which the one before it can be left."""
        maps, entries = [], {entry}
        for chunk in chunks:
            maps.append(self.state_map(chunk, entries))
            entries = {state for state, _ in maps[-1].values()}
        return maps

    @staticmethod
    def compose(a: StateMap, b: StateMap) -> StateMap:
        return {entry: (b[state][0], emitted + b[state][1]) for entry, (state, emitted) in a.items()}

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.states) > STATES:
            self.restart()
        text = SPACE + text.replace(" ", SPACE)
        maps = self.state_maps([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)], self.FRESH)
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][self.FRESH][1]


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more tokens than the limit) of each whole text."""
    shared = Shared(df.sparkSession, CountTransducer, read_file(model_path))

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        made = shared.get()
        return pa.array([made.count(t.as_py() or "") for t in texts], pa.int64())

    out = df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", tokens(F.col(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Toxicity (operator 9): noisy-channel restoration of disguised words, then scoring of the restored text.

Texts are lattices of characters: a sign or digit among letters may stand for
letters or for itself, a mark may have been put in, a letter may have been
repeated, and in runs of single letters each space may be a border of words or
put in. All these have costs in the channel. A Viterbi search picks the
likeliest path under a character trigram model counted on the words of all
documents. Tokens of letters without repetitions have one path, and are restored
as they are without a search.

What is scored are all distinct restored words. A word's features are the word
and its prefixes of four to seven letters. Their document frequencies by class
are counted over all labelled training documents (on the cluster, map-side
combined). Features in enough toxic documents weigh their smoothed log odds
(less for few documents); all that weigh more than nothing are kept. A text's
margin is the soft maximum log(1 + sum(exp(SHARP w) - 1)) / SHARP over the
weights w of all features of all its words. The sums are of whole numbers, so
they don't depend on any order. Workers hold at most ``shard_features`` features
at once: where there are more, the documents are read once for each shard, and
each pass leaves a document's sum so far. Both give equal results. A quarter of
the training documents is kept out of the counts; a bounded sample of them turns
margins into probabilities.

Results: null and empty texts have no words and get the score of no features.
Without both classes among the labels, the score is the share of the class that
is there (0.5 without labels). Of several labels of an id the largest counts;
repeated documents count as often as they are there and get equal scores. Of
paths with equal costs the last in order of letters is taken. Very long texts
and tokens are read whole, in time linear in their length. An empty table gets
an empty result. Labels, language, source and id are no inputs. Input columns
stay, but for those with the names of outputs (score, predicted).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.features import bounded, labelled, platt
from textloom.llm.mph import mix
from textloom.llm.shared import Shared
from textloom.llm.stored import drop, store, store_at

SAMPLE, MIN_TOXIC = 1500, 2
#: Features in a worker at once, of 16 bytes each; results don't depend on it.
SHARD_FEATURES = 2_000_000
PREFIXES = (4, 5, 6, 7)
#: Tokens that a worker knows at most, and texts that are read together.
KNOWN, TOGETHER = 300_000, 256
#: How much stronger words count for more than weaker ones, and units of a weight's share in the sum.
SHARP, UNITS = 2.0, 1 << 16
MARKS = ".,;:!?*#$%&|<>()[]{}\"'“”‘’«»¿¡…-_~/\\=+^`"
#: What a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
#: Costs of the channel, as log probabilities: a sign for a letter, a star for one, a sign that is itself, what was put in, a letter that is doubled.
SIGN, STAR, ITSELF, DROPPED, MARK_DROPPED, DOUBLED = -1.0, -3.5, -4.0, -14.0, -0.5, -3.0
LETTER, THRICE = re.compile(r"[^\W\d_]").search, re.compile(r"([^\W\d_])\1\1").search
SPACED = re.compile(r"(?<![^\s.,;:!?])(?:[a-z0-9@$!|][ .\-_*~]){2,}[a-z0-9@$!|](?![^\s.,;:!?])")
SEPARATORS = " .-_*~"
CUT = str.maketrans(SEPARATORS, " " * len(SEPARATORS))
#: Symbols of the language model: 0 for what is no letter, a-z, and one for all other letters.
SYMBOLS = 28
_CODE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _low = chr(_c).lower()[:1]
    _CODE[_c] = ord(_low) - 96 if "a" <= _low <= "z" else 27 if chr(_c).isalpha() else 0


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 27)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams (by symbol) over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                c = codes(f"  {t.as_py() or ''} ")
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "n"])

    found = docs.select(text).mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # SYMBOLS**3 rows at most
    out = np.zeros(SYMBOLS**3)
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


def spelled(path: tuple | None) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Viterbi decoding of disguised tokens under the trigram model."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        pairs = cube.sum(axis=0) + 0.5
        after = pairs / pairs.sum(axis=1, keepdims=True)
        context = cube.sum(axis=2, keepdims=True)
        self.log = np.log((cube + 4 * after[None]) / (context + 4)).tolist()

    def options(self, c: str, run: int) -> list[tuple[str, float]]:
        """What a character may stand for that is the ``run``-th of equal ones."""
        if c.isalpha():
            return [(c, 0.0)] if run == 1 else [(c, 0.0), ("", DOUBLED)] if run == 2 else [("", MARK_DROPPED / run)]
        out = [(x, SIGN) for x in LEET.get(c, "")]
        if c == "*":
            out += [(x, STAR) for x in "aeiou"]
        return [*out, (c, ITSELF if out or c in SEPARATORS[1:] else 0.0), ("", MARK_DROPPED if c in SEPARATORS else DROPPED)]

    def restore(self, token: str) -> str:
        """Linear in the token: at most SYMBOLS**2 states for each character, whose paths are linked lists of letters."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        run, last = 0, ""
        for c in token:
            run, last = run + 1 if c == last else 1, c
            then: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, cost in self.options(c, run):
                code = ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0
                for (p, q), (total, path) in best.items():
                    key, value = ((q, code), total + cost + self.log[p][q][code]) if letter else ((p, q), total + cost)
                    if key not in then or then[key][0] < value:
                        then[key] = (value, (path, letter) if letter else path)
            best = then
        ends = [(total + self.log[p][q][0], path) for (p, q), (total, path) in best.items()]
        most = max(total for total, _ in ends)
        return max(spelled(path) for total, path in ends if total == most)

    def spaced(self, text: str) -> list[str]:
        """The words hidden in runs of single letters, whose spaces may go or stay; text in lower case."""
        restored = [w.strip(MARKS) for m in SPACED.finditer(text) for w in self.restore(m.group()).split()]
        return [w for w in restored if w]

    def parts(self, token: str) -> list[str]:
        """A token in lower case, without marks around it: restored, if it has more than one path, and cut where the path keeps what stands between letters."""
        whole = token.rstrip(".,;:?\"')").lstrip("\"'(")
        core = whole.strip(MARKS)
        # a sign at either end may be a letter (one of them) or a mark
        if len(core) < len(whole) <= len(core) + 1 and core and (whole[0] in LEET or whole[-1] in "$"):
            core = whole
        if not several_paths(core):
            return [core.strip(MARKS)]
        return [x for x in self.restore(core).strip(MARKS).translate(CUT).split() if x]

    def word(self, token: str) -> str:
        return "".join(self.parts(token))

    def words(self, token: str) -> tuple[str, ...]:
        """The restored token as one word, and its parts if there are several."""
        if token.isalpha() and not THRICE(token):
            return (token,)
        parts = self.parts(token)
        return ("".join(parts), *(parts if len(parts) > 1 else ()))


def several_paths(token: str) -> bool:
    """Letters with something else beside them, or with repetitions."""
    return bool(THRICE(token) or not token.isalpha() and LETTER(token))


def word_features(word: str) -> list[str]:
    return [f"{word}$", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)] if word else []


def word_keys(words: list[str]) -> np.ndarray:
    """(words, features): the keys of a word and of its prefixes, 0 for prefixes that are longer than it and for no word."""
    longest = PREFIXES[-1]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.array([w[:longest] for w in words], f"U{longest}").view(np.uint32).reshape(len(words), longest).astype(np.uint64)
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) | np.uint64(1)
    out[sizes == 0, 0] = 0
    h = np.zeros(len(words), np.uint64)
    for k in range(longest):
        h = mix(h + chars[:, k], k + 1)
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = np.where(sizes > k, h | np.uint64(1), np.uint64(0))
    return out


def key(feature: str) -> int:
    """Of one feature, written ``word$`` or ``^prefix``."""
    return int(word_keys([feature[:-1]])[0, 0] if feature.endswith("$") else word_keys([feature[1:]])[0, 1 + PREFIXES.index(len(feature) - 1)])


class KeyTable:
    """Keys of words by place."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.size, self.rows = 0, np.zeros((1024, 1 + len(PREFIXES)), np.uint64)

    def add(self, words: list[str]) -> range:
        if not words:
            return range(0)
        first, self.size = self.size, self.size + len(words)
        if self.size > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((2 * len(words) + first, self.rows.shape[1]), np.uint64)])
        self.rows[first : self.size] = word_keys(words)
        return range(first, self.size)


class Tokens:
    """What is known of tokens: of each word they are restored to, a value. Texts are read some at a time, so that values of new words are made together."""

    def __init__(self, restorer: Restorer, values, forget=lambda: None):
        """values: from a list of words to a list of a value each; forget: called when all known ones go."""
        self.restorer, self.values, self.forget, self.known = restorer, values, forget, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known = {}
            self.forget()
        fresh = [t for t in tokens if t not in self.known]
        own = [self.restorer.words(t) for t in fresh]
        found = iter(self.values([w for ws in own for w in ws]))
        self.known.update((t, tuple(v for _ in ws if (v := next(found)) is not None)) for t, ws in zip(fresh, own))

    def read(self, texts: list[str | None]) -> Iterator[list]:
        """The values of each text's tokens and spaced words."""
        for at in range(0, len(texts), TOGETHER):
            low = [(t or "").lower() for t in texts[at : at + TOGETHER]]
            split = [set(x.split()) for x in low]
            self.learn(set().union(*split))
            known = self.known
            for x, tokens in zip(low, split):
                found = [v for t in tokens for v in known[t]]
                spaced = self.restorer.spaced(x)
                yield found + [v for v in self.values(spaced) if v is not None] if spaced else found


def feature_odds(rows: DataFrame, shared: Shared, min_toxic: int) -> tuple[DataFrame, int, int]:
    """(f, share) of all features with log odds above 0, their shares in a text's sum, and documents by class, over all rows (text, label)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = KeyTable()
        tokens = Tokens(shared.get(), table.add, table.forget)
        for batch in batches:
            labels = np.array([int(y == 1) for y in batch.column(1).to_pylist()], np.int64)
            found: list[list[np.ndarray]] = [[], []]
            for own, toxic in zip(tokens.read(batch.column(0).to_pylist()), labels):
                keys = np.unique(np.append(table.rows[own].ravel(), np.uint64(0)))  # key 0: documents
                found[toxic].append(keys)
            by_class = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in found]
            columns = [np.concatenate([k for k, _ in by_class]).view(np.int64), *(np.concatenate([c * (k == y) for k, (_, c) in enumerate(by_class)]) for y in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["f", "n0", "n1"])

    found = rows.select("text", "label").mapInArrow(counted, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = store(found.where((F.col("n1") >= min_toxic) | (F.col("f") == 0)))
    totals = found.where("f = 0").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    n0, n1 = totals["n0"] or 0, totals["n1"] or 0
    odds = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.5) / (n0 + 1)) - 1 / F.sqrt("n1")
    return found.where("f <> 0").select("f", F.round(F.expm1(SHARP * odds) * UNITS).cast("long").alias("share")).where("share > 0"), n0, n1


def shards(odds: DataFrame, most: int) -> Iterator[tuple[bytes, bytes]]:
    """Keys in order and shares, of all features in shards of about ``most``; an empty one if there are none."""
    n = max(1, -(-odds.count() // most))
    for k in range(n):
        own = odds.where(F.pmod("f", F.lit(n)) == k).toArrow()
        keys, values = own["f"].to_numpy().view(np.uint64), own["share"].to_numpy()
        order = np.argsort(keys)
        yield keys[order].tobytes(), values[order].tobytes()


class Scorer:
    def __init__(self, counts: np.ndarray, keys: bytes, shares: bytes):
        self.keys, self.shares = np.frombuffer(keys, np.uint64), np.frombuffer(shares, np.int64)
        self.tokens = Tokens(Restorer(counts), self.with_shares)

    def with_shares(self, words: list[str]) -> list[tuple[str, int] | None]:
        """The words that have a share in a sum, with it."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        keys = word_keys(words)
        at = np.minimum(np.searchsorted(self.keys, keys.ravel()), len(self.keys) - 1).reshape(keys.shape)
        total = np.where(self.keys[at] == keys, self.shares[at], 0).sum(axis=1)
        out: list[tuple[str, int] | None] = [None] * len(words)
        for i in np.flatnonzero(total).tolist():
            out[i] = (words[i], int(total[i]))
        return out

    def totals(self, texts: list[str | None]) -> list[int]:
        """The shares of all distinct words of each text."""
        return [sum(dict(own).values()) for own in self.tokens.read(texts)]


def margin(total):
    return np.log1p(np.asarray(total, np.float64) / UNITS) / SHARP


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE, shard_features: int = SHARD_FEATURES, min_toxic: int = MIN_TOXIC
) -> DataFrame:
    """Adds score and predicted to all documents; learns from those that have a label and for which ``train`` holds."""
    spark = docs.sparkSession
    counts = trigram_counts(docs, text)
    rows = labelled(docs.where(train), labels, doc_id, text, label)
    kept_out = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    odds, n0, n1 = feature_odds(rows.where(~kept_out), Shared(spark, Restorer, counts), min_toxic)
    if n0 and n1:
        scorers = [Shared(spark, Scorer, counts, *shard) for shard in shards(odds, shard_features)]
        sampled = totals(bounded(rows.where(kept_out), sample).select("text", "label"), scorers, "text")
        found = sampled.select("label", F.col(TOTAL)).toPandas()
        a, b = platt(margin(found[TOTAL].to_numpy()), found["label"].to_numpy()) if found["label"].nunique() == 2 else (1.0, -5.0)
    else:
        share = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-6), 1 - 1e-6)
        scorers, a, b = [Shared(spark, Scorer, counts, b"", b"")], 0.0, float(np.log(share / (1 - share)))
    score = 1 / (1 + F.exp(-(F.lit(a) * F.log1p(F.col(TOTAL) / UNITS) / SHARP + F.lit(b))))
    return totals(docs, scorers, text).withColumn("score", score).drop(TOTAL).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


TOTAL = "__total"


def totals(docs: DataFrame, scorers: list[Shared], text: str) -> DataFrame:
    """Adds each text's sum over all shards; all passes but the last are tables that replace the one before, so that workers hold a shard at a time."""
    docs, path = docs.withColumn(TOTAL, F.lit(0).cast("long")), None
    for k, shared in enumerate(scorers):
        docs = docs.withColumn(TOTAL, F.col(TOTAL) + total_column(shared, F.col(text)))
        if k < len(scorers) - 1:
            docs, at = store_at(docs)
            if path:
                drop(docs.sparkSession, path)
            path = at
    return docs


def total_column(shared: Shared, text: Column) -> Column:
    @F.arrow_udf("bigint")
    def total(texts: pa.Array) -> pa.Array:
        return pa.array(shared.get().totals(texts.to_pylist()), pa.int64())

    return total(text)

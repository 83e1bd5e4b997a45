"""Language identification (operator 5): a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of ``CORE`` bytes, at code points, and each window is
read with up to ``MARGIN`` bytes of the text on either side of it. Two gated
recurrent layers read these bytes, forward and backward; a softmax over their
states labels every position. Each position of the text is in one core, whose
labels count; the margins are there for the states to settle. A document's
probabilities are the mean over all its positions.

Training is by backpropagation through time with Adam on a bounded sample of
the labelled documents: of at most ``sample`` documents of each language, chosen
by a hash of the id, at most ``SPANS`` spans of ``SPAN`` bytes each, evenly
spread, are cut out on the cluster. Prediction reads all bytes of all texts.

Results: a text that is null or has no letter is ``und`` with score 0. Without
labelled documents all texts are. Of languages with equal probabilities the
first by name is given. Repeated rows get equal results; very long texts are
read whole; an empty table gives an empty result. Language, source and id are
no inputs of a prediction. Input columns stay, but for those with the names of
outputs (lang_pred, score).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.features import bounded
from textloom.llm.shared import Shared

#: Bytes of a window of which the labels count, and bytes read on either side of it.
CORE, MARGIN = 240, 12
#: Labelled documents of each language that are learnt from, spans of each, and bytes of a span.
SAMPLE, SPANS, SPAN = 300, 16, 64
EMBED, HIDDEN = 8, 8
#: Windows that are labelled at a time; bounds a worker's memory, whatever the texts are.
TOGETHER = 1024
LETTER = re.compile(r"[^\W\d_]").search


def at_point(data: bytes, at: int) -> int:
    """The last place up to ``at`` where a code point begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(text: str) -> list[tuple[bytes, int, int]]:
    """The bytes of each window with its margins, and where its core begins and ends in them."""
    data = text.encode("utf-8", "surrogatepass")
    ends = [at_point(data, k) for k in range(CORE, len(data), CORE)] + [len(data)]
    out, first = [], 0
    for end in ends:
        lo, hi = at_point(data, max(0, first - MARGIN)), at_point(data, min(len(data), end + MARGIN))
        out.append((data[lo:hi], first - lo, end - lo))
        first = end
    return out


def spans(text: str) -> list[bytes]:
    """Parts of a text to learn from, evenly spread over it."""
    data = text.encode("utf-8", "surrogatepass")
    n = min(SPANS, -(-len(data) // SPAN))
    cuts = [at_point(data, k * (len(data) - SPAN) // max(n - 1, 1)) if len(data) > SPAN else 0 for k in range(n)]
    return [data[at : at_point(data, at + SPAN)] for at in cuts]


def pack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (steps, windows), and which are there."""
    sizes = np.array([len(p) for p in parts])
    steps = int(sizes.max(initial=1))
    flat = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in parts), np.uint8).reshape(len(parts), steps)
    return flat.T.copy(), (np.arange(steps)[:, None] < sizes[None]).astype(np.float32)[:, :, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; f and b are the two directions."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.p = langs, params

    @classmethod
    def new(cls, langs: list[str], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"embed": draw(256, EMBED) * 8, "out": draw(2 * HIDDEN, len(langs)), "bias": np.zeros(len(langs), np.float32)}
        for d in "fb":
            p |= {f"in_{d}": draw(EMBED, 3 * HIDDEN), f"rec_{d}": draw(HIDDEN, 3 * HIDDEN), f"add_{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(langs, p)

    def read(self, x: np.ndarray, there: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction; keep gets what the way back needs."""
        steps, n = x.shape
        table = self.p["embed"] @ self.p[f"in_{d}"] + self.p[f"add_{d}"]  # the input's part, by byte
        rec = self.p[f"rec_{d}"]
        whole = there.all(axis=(1, 2))
        h, states = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            own, from_h = np.take(table, x[t], axis=0), h @ rec
            gates = _sigmoid(own[:, : 2 * HIDDEN] + from_h[:, : 2 * HIDDEN])
            z, r, from_h = gates[:, :HIDDEN], gates[:, HIDDEN:], from_h[:, 2 * HIDDEN :]
            new = np.tanh(own[:, 2 * HIDDEN :] + r * from_h)
            step = (1 - z) * (new - h)
            after = h + step if whole[t] else h + there[t] * step
            if keep is not None:
                keep.append((t, h, z, r, new, from_h))
            h = states[t] = after
        return states

    def label(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position, 0 where no byte is."""
        out = self.p["out"]
        scores = self.read(x, there, "f") @ out[:HIDDEN] + self.read(x, there, "b") @ out[HIDDEN:] + self.p["bias"]
        np.exp(scores - scores.max(axis=2, keepdims=True), out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores * there

    def gradients(self, x: np.ndarray, there: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.read(x, there, d, kept[d]) for d in "fb"], axis=2)
        scores = both @ self.p["out"] + self.p["bias"]
        probs = np.exp(scores - scores.max(axis=2, keepdims=True))
        probs /= probs.sum(axis=2, keepdims=True)
        probs[:, np.arange(len(lang)), lang] -= 1
        slope = probs * there / there.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tnh,tnl->hl", both, slope)
        g["bias"] = slope.sum(axis=(0, 1))
        back = slope @ self.p["out"].T
        for side, d in enumerate("fb"):
            rec, into = self.p[f"rec_{d}"], self.p[f"in_{d}"]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            by_byte = np.zeros((256, 3 * HIDDEN), np.float32)
            for t, h, z, r, new, from_h in reversed(kept[d]):
                dh = dh + back[t][:, side * HIDDEN : (side + 1) * HIDDEN]
                step = dh * there[t]
                d_new = step * (1 - z) * (1 - new * new)
                d_z = -step * (new - h) * z * (1 - z)
                d_r = d_new * from_h * r * (1 - r)
                d_own = np.concatenate([d_z, d_r, d_new], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"rec_{d}"] += h.T @ d_rec
                np.add.at(by_byte, x[t], d_own)
                dh = dh - step * (1 - z) + d_rec @ rec.T
            g[f"add_{d}"] = by_byte.sum(axis=0)
            g[f"in_{d}"] = self.p["embed"].T @ by_byte
            g["embed"] += by_byte @ into.T
        return g


def train(parts: list[bytes], lang: np.ndarray, langs: list[str], rounds: int = 5, batch: int = 512, rate: float = 0.01, seed: int = 5) -> Network:
    net, rng = Network.new(langs), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, rounds * -(-len(parts) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(parts))
        for at in range(0, len(parts), batch):
            chosen = order[at : at + batch]
            g = net.gradients(*pack([parts[i] for i in chosen]), lang[chosen])
            step += 1
            speed = rate * (1 - 0.9 * step / total)
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                net.p[k] = net.p[k] - (speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int) -> Network | None:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("label"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [spans(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.binary())), batch.column(2)], ["id", "parts", "label"])

    # at most sample * SPANS * SPAN bytes of each language come to the driver
    kind = rows.schema["id"].dataType.simpleString()
    got = sorted(bounded(rows, sample).select("id", "text", "label").mapInArrow(cut, f"id {kind}, parts array<binary>, label string").collect(), key=lambda r: (r["id"] is None, r["id"], r["parts"]))
    langs = sorted({r["label"] for r in got})
    parts = [(bytes(x), langs.index(r["label"])) for r in got for x in r["parts"] if x]
    if not parts:
        return None
    return train([x for x, _ in parts], np.array([y for _, y in parts]), langs)


class Predictor:
    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.net = Network(langs, params)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Label probabilities of each text, added up over its positions. Windows of like size are labelled together."""
        total = np.zeros((len(texts), len(self.net.langs)))
        waiting: list[tuple[int, bytes, int, int]] = []

        def label(some: list[tuple[int, bytes, int, int]]) -> None:
            x, there = pack([w[1] for w in some])
            place = np.arange(len(x))[:, None]
            core = (place >= [w[2] for w in some]) & (place < [w[3] for w in some])
            np.add.at(total, [w[0] for w in some], (self.net.label(x, there) * core[:, :, None]).sum(axis=0))

        for i, t in enumerate(texts):
            for w in windows(t) if t and LETTER(t) else ():
                waiting.append((i, *w))
            while len(waiting) >= 8 * TOGETHER or (i + 1 == len(texts) and waiting):
                waiting.sort(key=lambda w: len(w[1]))
                label(waiting[-TOGETHER:])
                del waiting[-TOGETHER:]
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total = self.sums(texts)
        best, whole = total.argmax(axis=1), total.sum(axis=1)
        return [(self.net.langs[b], min(1.0, float(row[b] / n))) if n else ("und", 0.0) for b, row, n in zip(best, total, whole)]


_PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def identify_language(docs: DataFrame, train_on: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Adds lang_pred and score to all documents; learns from those for which ``train_on`` holds."""
    net = fit(docs.where(train_on), doc_id, text, lang, sample)
    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = Shared(docs.sparkSession, Predictor, net.langs, net.p)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array([{"lang_pred": a, "score": b} for a, b in shared.get().predict(texts.to_pylist())], _PREDICTED)

    found = docs.withColumn("__found", predict(F.col(text)))
    return found.withColumn("lang_pred", F.col("__found.lang_pred")).withColumn("score", F.col("__found.score")).drop("__found")

"""Line dedup across documents (operator 1).

Two passes. The first gives each document's distinct line keys as 128-bit
hashes, counted with map-side combining, so that a line that a third of all
documents hold is a row for each task. Half of the hash picks the shard; each
shard is built, in a task of its own, into a minimal perfect hash over its
distinct hashes with compact arrays beside it, by place: a 64-bit fingerprint
(the other half of the hash), the document count and the largest document id.
Hashes of lines in one document only, which no threshold could drop, are left
out, as they are by far the most.

The second pass reads the documents again and probes the arrays: the count
there decides whether a line is in ``min_docs`` documents. While all shards
together are at most ``broadcast_bytes``, they are broadcast and the documents
are probed where they are, without a shuffle. Beyond that, probes of 44 bytes
(not lines) go to their shards, each shard's probes dealt over several tasks,
and the hits come back to their documents: broadcast while they are few, else by
a join, the one shuffle of whole texts. All ways give equal results.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased; keys shorter than ``min_chars`` code points are never dropped.

Results: a null or empty text is one empty line. Each row is a document of its
own, so repeated rows count as often as they are there; of rows tied for the
largest id, each keeps its lines. A null id is below all others. Very long texts
are split and rebuilt whole, a row at a time. An empty table gives an empty
one. Input columns stay, but for one with the name of the output and names that
begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.mph import PerfectHash, mix
from textloom.llm.shared import Shared
from textloom.llm.stored import store

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, on average: some MB when built.
SHARD_KEYS = 250_000
BROADCAST_BYTES = 32_000_000
#: Probes that a task gets in one group where shards are not broadcast.
GROUP_PROBES = 500_000
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST = -(1 << 63)

PROBED = "struct<n_lines:bigint,n_dropped:bigint,kept:string>"
_PROBED = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def line_hashes(text: str | None, min_chars: int) -> tuple[list[int], bytes]:
    """Which lines have a key that is long enough, and the keys' 16-byte hashes, joined."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    places, digests = [], []
    for i, line in enumerate(data.split(b"\n")):
        key = line.strip(BLANK)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            places.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return places, b"".join(digests)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, n_docs, last_id) of the line keys in two documents or more."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                digests = line_hashes(t.as_py(), min_chars)[1]
                own = {digests[k : k + 16] for k in range(0, len(digests), 16)}
                keys += own
                ids.append(np.full(len(own), LEAST if i is None else i, np.int64))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["hi", "lo", "id"])

    lines = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(hashed, "hi long, lo long, id long")
    return lines.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id")).where("n_docs > 1")


def build_shards(frequent: DataFrame, n_shards: int) -> DataFrame:
    """(shard, n_keys, data) of each shard that has keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = pdf["hi"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64)
        seed = next(s for s in range(64) if len(np.unique(fold(hi, lo, s))) == len(hi))
        keys = fold(hi, lo, seed)
        made = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[made.places(keys)] = np.arange(len(keys))
        parts = [made.dump(), *(pdf[c].to_numpy(t)[order].tobytes() for c, t in (("lo", np.int64), ("n_docs", np.int64), ("last_id", np.int64)))]
        head = np.array([len(keys), len(parts[0]), seed], np.int64).tobytes()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_keys": [len(keys)], "data": [head + b"".join(parts)]})

    shard = F.pmod(F.col("lo"), F.lit(n_shards)).cast("int")
    return frequent.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, n_keys long, data binary")


def fold(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of the 128; the seed is chosen so that no two keys of a shard fall together."""
    return hi.view(np.uint64) ^ mix(lo.view(np.uint64), seed)


class Shard:
    def __init__(self, data: bytes):
        n, size, self.seed = map(int, np.frombuffer(data, np.int64, 3))
        self.hash = PerfectHash.load(data[24 : 24 + size])
        self.fingerprint, self.n_docs, self.last = np.frombuffer(data, np.int64, 3 * n, 24 + size).reshape(3, n)

    def drops(self, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, min_docs: int = MIN_DOCS) -> np.ndarray:
        """True where the key is in at least min_docs documents and the row's id isn't the largest that holds it."""
        place = self.hash.places(fold(hi, lo, self.seed))
        there = place >= 0
        there[there] = self.fingerprint[place[there]] == lo[there]
        there[there] = self.n_docs[place[there]] >= min_docs
        there[there] = self.last[place[there]] != ids[there]
        return there


class Shards:
    """All shards, where they are few enough to be in every worker."""

    def __init__(self, n_shards: int, data: dict[int, bytes], min_docs: int = MIN_DOCS):
        self.n, self.shards, self.min_docs = n_shards, {k: Shard(v) for k, v in data.items()}, min_docs

    def drops(self, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(hi), bool), np.mod(lo, self.n)
        for k, shard in self.shards.items():
            rows = np.flatnonzero(of == k)
            if len(rows):
                out[rows] = shard.drops(hi[rows], lo[rows], ids[rows], self.min_docs)
        return out


def _keep(text: str | None, dropped: set[int]) -> dict:
    lines = (text or "").split("\n")
    return {"n_lines": len(lines), "n_dropped": len(dropped), "kept": "\n".join([x for i, x in enumerate(lines) if i not in dropped]) if dropped else text or ""}


def _probe_here(docs: DataFrame, shared: Shared, doc_id: str, text: str, min_chars: int, out: str) -> DataFrame:
    @F.arrow_udf(PROBED)
    def probe(ids: pa.Array, texts: pa.Array) -> pa.Array:
        own = [line_hashes(t.as_py(), min_chars) for t in texts]
        sizes = [len(p) for p, _ in own]
        both = np.frombuffer(b"".join(d for _, d in own), np.int64).reshape(-1, 2)
        holders = np.repeat(np.array([LEAST if i is None else i for i in ids.to_pylist()], np.int64), sizes)
        drops, at, rows = shared.get().drops(both[:, 0].copy(), both[:, 1].copy(), holders), 0, []
        for t, (places, _), n in zip(texts, own, sizes):
            rows.append(_keep(t.as_py(), {p for p, d in zip(places, drops[at : at + n].tolist()) if d}))
            at += n
        return pa.array(rows, _PROBED)

    return docs.withColumn(out, probe(F.col(doc_id).cast("long"), F.col(text)))


def _probe_shards(docs: DataFrame, shards: DataFrame, n_shards: int, group_probes: int, broadcast_bytes: int, doc_id: str, text: str, min_chars: int, out: str, min_docs: int) -> DataFrame:
    """Probes go to their shards by (shard, salt); a row's hits come back by the row's own number."""
    docs = store(docs.withColumn("__row", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, at, keys = [], [], [], []
            for r, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                places, digests = line_hashes(t.as_py(), min_chars)
                rows += [r] * len(places)
                ids += [LEAST if i is None else i] * len(places)
                at += places
                keys.append(digests)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["row", "id", "line", "hi", "lo"])

    probes = docs.select("__row", F.col(doc_id).cast("long"), F.col(text)).mapInArrow(hashed, "row long, id long, line int, hi long, lo long")
    probes = probes.withColumn("shard", F.pmod("lo", F.lit(n_shards)).cast("int"))
    sizes = store(probes.groupBy("shard").agg((F.ceil(F.count("*") / group_probes)).cast("int").alias("salts")))  # a row for each shard
    own, other = (sizes.select(F.col("shard").alias(f"{x}_shard"), F.col("salts").alias(f"{x}_salts")) for x in "ab")
    salted = probes.join(F.broadcast(own) if n_shards < 10_000 else own, F.col("shard") == F.col("a_shard"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row", "line"), F.col("a_salts")).cast("int")).select("shard", "salt", "row", "id", "line", "hi", "lo")
    copies = shards.join(other, F.col("shard") == F.col("b_shard")).select("shard", F.explode(F.sequence(F.lit(0), F.col("b_salts") - 1)).alias("salt"), "data")

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return left[:0][["row", "line"]]
        return left.loc[Shard(right["data"].iloc[0]).drops(*(left[c].to_numpy(np.int64) for c in ("hi", "lo", "id")), min_docs), ["row", "line"]]

    hits = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "row long, line int")
    dropped = hits.groupBy(F.col("row").alias("__of")).agg(F.collect_list("line").alias("__lines"))  # at most the lines of one document
    dropped = store(dropped)
    few = dropped.agg(F.sum(F.size("__lines") + 4)).first()[0] or 0

    @F.arrow_udf(PROBED)
    def keep(texts: pa.Array, lines: pa.Array) -> pa.Array:
        return pa.array([_keep(t.as_py(), set(x.as_py() or ())) for t, x in zip(texts, lines)], _PROBED)

    side = F.broadcast(dropped) if 4 * few <= broadcast_bytes else dropped
    return docs.join(side, F.col("__row") == F.col("__of"), "left").withColumn(out, keep(F.col(text), F.col("__lines"))).drop("__row", "__of", "__lines")


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES, group_probes: int = GROUP_PROBES, out: str = "probed",
) -> DataFrame:
    """Adds ``out``: n_lines before dropping, n_dropped, and the kept lines joined by line breaks."""
    if min_docs < 2:
        raise ValueError("lines in a single document can't be repeated: min_docs must be 2 at least")
    repeated = store(repeated_lines(docs, doc_id, text, min_chars))
    n_shards = max(1, -(-repeated.count() // shard_keys))
    shards = store(build_shards(repeated, n_shards))
    size = shards.agg(F.sum(F.length("data"))).first()[0] or 0
    if size > broadcast_bytes:
        return _probe_shards(docs, shards, n_shards, group_probes, broadcast_bytes, doc_id, text, min_chars, out, min_docs)
    shared = Shared(docs.sparkSession, Shards, n_shards, {r["shard"]: bytes(r["data"]) for r in shards.collect()}, min_docs)
    return _probe_here(docs, shared, doc_id, text, min_chars, out)

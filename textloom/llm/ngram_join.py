"""N-gram Jaccard join (operator 7): exact links between documents whose sets of word n-grams are alike.

Method: universe-partition pigeonhole. Sizes fall into bands such that sets
that can link are in the same band or in neighbouring ones. For each band there
is a scheme: the universe of n-gram hashes is partitioned into segments by
hash. Sets that link differ in at most H elements, H from the band's sizes, so
they can't differ in as many segments as the scheme allows for. A segment
indexed by its whole subset weighs 1, one indexed by its subset and all its
one-deletion neighbours weighs 2 (it is missed only if two elements differ).
The weights add up to H + 1 + spare, so subsets of linked sets agree in
segments that weigh spare + 1 or more.

That lets each set leave out ``spare`` whole segments: those with the smallest
subsets, ties broken by signature, on which chance matches would be frequent.
Of the segments in which two linked sets agree, the one with the largest subset
is left out by neither: it is the same subset in both, and if one left it out,
so it would all the others they agree in, which are too many. How many segments
are of either kind, and the spare, are chosen for each band by the cost of index
rows and of chance matches. A subset's signature is a sum of mixed hashes, from
which one-deletion neighbours come by subtraction.

Sets with a common signature are linked to the least of them (within what a task
holds at once before the shuffle, so that a signature that very many sets share
is a row for each task), and the components of these candidate links are
clusters, outside of which no link can be. Large clusters are first split, as
chance matches chain ever more sets as a corpus grows: their sets are indexed
again, and those with a common signature (groups of equal sets of them once) are
compared by parity bitmaps (a bit flipped for each element). These differ in at
most as many bits as the sets in elements, so pairs whose bitmaps differ in more
than H bits are no links, and only components of the other pairs stay together.
A set that is reached is not compared again in a group, so near copies cost a
comparison each; a whole cluster is not compared pair by pair for its bitmaps.
Within clusters all pairs are verified on the whole sets, in groups: small
clusters are packed together; large ones are dealt by band and blocks, so that
each two blocks of compatible bands meet in one group of bounded size. A group
compares by sparse counts, writes no pairs, and returns a spanning forest of the
links found. Exact copies are one set throughout, so copies cost nothing.

Hashes have 64 bits; that no two sets share a fingerprint is checked with 64
more bits, and the run repeated with another seed if two do.

Results: words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. A text
with fewer than n words is one n-gram; a null text, or one without words, has
an empty set and no links: its component is its own id. Rows with one id are
one document with several sets: all their components become one; repeated rows
get a row each. A null id is in no component (null), and its row links nothing.
A component is named by its least id, so ties don't arise. Very long texts are
one set like others, never cut. An empty table gives an empty result. The
result has doc_id, n_shingles, component_id only, whatever other columns are
called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.components import HERE, components, stars
from textloom.llm.mph import mix
from textloom.llm.shared import clear
from textloom.llm.stored import drop, release, store, store_at

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A block of a large cluster has about so many elements and sets at most; a pack of small clusters two blocks' worth.
BLOCK_ELEMENTS, BLOCK_SETS = 120_000, 256
#: Blocks of bitmaps hold more, as a bitmap is so much smaller than its set.
BITMAP_SETS, BITMAP_ELEMENTS = 4, 32
#: Ids that may be broadcast to pick the documents whose sets are verified; beyond, a Bloom filter of ``BLOOM_WORDS`` words is.
BROADCAST_IDS, BLOOM_WORDS = 2_000_000, 1 << 22
#: Signatures that a task combines at once.
COMBINE = 250_000
#: The cost model: so many other sets share a twentieth of a set's elements with it; a chance match costs as much as an index row.
PARTNERS, SHARED = 1000.0, 0.05


def ngrams(text: str | None, n: int, seed: int = 0) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)
    n = min(n, len(words))
    m = len(words) - n + 1
    out = mix(hashes[:m], n)
    for k in range(1, n):
        out = mix(out + hashes[k : k + m], k)
    return np.unique(out)


class Bands:
    """Sizes and schemes for links of ``num / den`` or more."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.num, self.den, self.tops = num, den, [1]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    def most_apart(self, a, b):
        """Elements in which linked sets of these sizes can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, band: int) -> tuple[int, int, int]:
        """Segments with a whole subset, segments with one-deletion neighbours, and whole ones that a set leaves out."""
        while len(self.tops) <= band:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * self.den // self.num))
        size = self.tops[band]
        most = self.most_apart(size, size)
        found = []
        for deleted in sorted({(most + 1) * share // 8 for share in range(5)}):
            for spare in sorted({(most + 1 - 2 * deleted) * share // 8 for share in range(5)}):
                whole = most + 1 - 2 * deleted + spare
                found.append((self.cost(size, whole, deleted, spare), (whole, deleted, spare)))
        return min(found)[1]

    @staticmethod
    def cost(size: int, whole: int, deleted: int, spare: int) -> float:
        """Index rows of a set, and its chance matches with sets that share a part of its elements."""
        mean = size / (whole + deleted)
        apart, alike = 2 * (1 - SHARED) * mean, SHARED * mean
        left_out, least, share = spare / max(whole, 1), 0, exp(-mean)  # the subsets left out are the smallest: those under ``least``
        below = share
        while below <= left_out:
            least += 1
            share *= mean / least
            below += share
        term, matches = exp(-alike), 0.0  # a whole subset matches if all of it is shared and nothing else is there
        for k in range(least + 30):
            matches += term if k >= least else 0.0
            term *= alike / (k + 1)
        rows = whole - spare + deleted * (1 + mean)
        return rows + PARTNERS * (whole * matches * exp(-apart) + deleted * (1 + apart) * exp(-apart))

    def signatures(self, elements: np.ndarray, band: int) -> np.ndarray:
        """What the set indexes in a band's scheme."""
        whole, deleted, spare = self.scheme(band)
        segments = whole + deleted
        dealt = mix(elements, 101 + band)
        of = ((dealt >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        value = mix(elements, 7)
        order = np.argsort(of, kind="stable")
        of, value = of[order].astype(np.int64), value[order]
        there = np.flatnonzero(np.diff(of, prepend=-1))
        sums = np.zeros(segments, np.uint64)
        sums[of[there]] = np.add.reduceat(value, there)
        salt = mix(np.arange(segments, dtype=np.uint64), 1_000_003 + band)
        own = sums + salt
        if spare:  # the first segments are those with neighbours; of the others the smallest are left out
            sizes = np.bincount(of, minlength=segments)[deleted:]
            kept = own[deleted:][np.lexsort((own[deleted:], sizes))[spare:]]
            keys = [own[:deleted], kept]
        else:
            keys = [own]
        if deleted:
            near = of < deleted
            keys.append((sums[of] - value + salt[of])[near])
        return mix(np.concatenate(keys), 13)

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """What the set indexes: its signatures in the scheme of its own band and of the next."""
        band = self.band(len(elements))
        return np.concatenate([self.signatures(elements, band), self.signatures(elements, band + 1)])

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def _fingerprints(docs: DataFrame, n: int, seed: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                s = ngrams(t.as_py(), n, seed)
                rows.append((len(s), int(np.bitwise_xor.reduce(mix(s, 3))) if len(s) else 0, int(np.add.reduce(mix(s, 5))) if len(s) else 0))
            sizes, a, b = (np.array([r[i] for r in rows], np.uint64).view(np.int64) for i in range(3))
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(a, mask=empty), pa.array(b, mask=empty)], ["doc_id", "n", "fp", "check"])

    return docs.mapInArrow(made, "doc_id long, n long, fp long, check long")


def _index(docs: DataFrame, n: int, seed: int, bands: Bands, combine: int) -> DataFrame:
    """(key, fp): each set's signatures in the scheme of its own band and of the next."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        seen: set[int] = set()  # copies within what is combined
        keys, ids, held = [], [], 0
        for batch in batches:
            for t in batch.column(0):
                s = ngrams(t.as_py(), n, seed)
                if not len(s) or (fp := int(np.bitwise_xor.reduce(mix(s, 3)))) in seen:
                    continue
                seen.add(fp)
                own = bands.keys(s)
                keys.append(own)
                ids.append(np.full(len(own), fp, np.uint64))
                held += len(own)
                if held > combine:
                    yield _combined(keys, ids)
                    keys, ids, held = [], [], 0
                    seen.clear()
        yield _combined(keys, ids)
        clear()

    return docs.mapInArrow(made, "key long, fp long")


def _combined(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Of each signature the least set only. The sets of a component of what is combined are joined to its least by a signature of their own, once."""
    if not keys:
        return _two([], [])
    key, fp = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    least = np.minimum.reduceat(fp, starts)
    of = np.repeat(least, np.diff(np.append(starts, len(key))))
    others = np.flatnonzero(fp != of)
    root, leaf = stars(of[others], fp[others])
    joint = mix(mix(root, 17) ^ leaf, 19)
    return _two([key[starts], joint, joint], [least, root, leaf])


def _two(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda xs: pa.array(np.concatenate(xs).view(np.int64) if xs else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([cat(keys), cat(ids)], ["key", "fp"])


def common_counts(sets: list[np.ndarray], others: list[np.ndarray] | None = None, columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the elements that two sets or more hold."""
    every = sets + (others or [])
    flat, place, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    keep = counts[place] > 1
    row, col = row[keep], number[place][keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(others) if others else len(sets)), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        lo, hi = np.searchsorted(col, [first, first + columns])
        x = np.zeros((len(every), columns), np.float32)
        x[row[lo:hi], col[lo:hi] - first] = 1
        out += x[: len(sets)] @ (x[len(sets) :] if others else x).T
    return out.astype(np.int64)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of a symmetric link matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges += [(at, int(x)) for x in new]
            todo += new.tolist()
    return edges


def links_within(bands: Bands, fps: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one cluster or between two blocks of one (sides 1 and 2; 0: all with all)."""
    if len(sets) == 2:
        pairs = [(0, 1)] if bands.linked(len(np.intersect1d(*sets, assume_unique=True)), *sizes) else []
    elif (sides == 0).all():
        pairs = spanning(bands.linked(common_counts(sets), sizes[:, None], sizes[None]) & ~np.eye(len(sets), dtype=bool))
    else:
        a, b = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
        if not len(a) or not len(b):
            return []
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[np.ix_(a, b)] = bands.linked(common_counts([sets[i] for i in a], [sets[i] for i in b]), sizes[a][:, None], sizes[b][None])
        pairs = spanning(linked | linked.T)
    return [(int(fps[i]), int(fps[j])) for i, j in pairs]


def bitmap(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """A parity bitmap of a power of two bits, some for each element in which a linked set may differ; halves add up to the bitmap of half the size."""
    bits = 64
    while bits < 6 * bands.most_apart(len(elements), len(elements)):
        bits *= 2
    odd = np.bincount((mix(elements, 77) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def maybe_within(bands: Bands, fps: np.ndarray, bitmaps: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bitmaps don't rule out a link."""
    if len(sizes) == 2:  # most groups are
        a, b = sorted(bitmaps, key=len)
        apart = int.from_bytes(a.tobytes()) ^ int.from_bytes(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0).tobytes())
        near = apart.bit_count() <= bands.most_apart(*sizes.tolist()) and (sides[0] != sides[1] or sides[0] == 0)
        return [(int(fps[0]), int(fps[1]))] if near else []
    words = min(map(len, bitmaps))
    flat = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in bitmaps])
    left, edges = np.ones(len(sizes), bool), []
    for root in range(len(sizes)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            others = np.flatnonzero(left & (sides != sides[at]) if sides[at] else left)
            if len(others):
                apart = np.bitwise_count(flat[others] ^ flat[at]).sum(axis=1)
                new = others[apart <= bands.most_apart(sizes[others], sizes[at])]
                left[new] = False
                edges += [(int(fps[at]), int(fps[x])) for x in new]
                todo += new.tolist()
    return edges


def _meeting(rows: DataFrame) -> DataFrame:
    """(cluster, fp) of signatures (key, fp): the sets that have a signature in common, equal groups once. Groups are known by 64 bits; two that share them are one larger group."""
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    once = rows.withColumn("before", before).where("before is null or before <> fp")  # a row may repeat
    of_key = Window.partitionBy("key")
    several = once.select("fp", F.count("*").over(of_key).alias("sets"), F.bit_xor(F.xxhash64("fp")).over(of_key).alias("cluster")).where("sets > 1")
    return several.select("cluster", "fp").distinct()


def _groups(clusters: DataFrame, bands: Bands, block_elements: int, block_sets: int) -> DataFrame:
    """(fp, n, grp, sub, side): which groups a set is in. clusters: (fp, n, cluster)."""
    tops = bands.tops
    of_band = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t < F.col("n")))
    clusters = store(clusters.withColumn("band", of_band))
    whole = clusters.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count("*").alias("sets"))
    small = (F.col("elements") <= block_elements) & (F.col("sets") <= block_sets)
    total = whole.where(small).agg(F.sum("elements"), F.sum("sets")).first()
    packs = max(1, -(-(total[0] or 0) // block_elements), -(-(total[1] or 0) // block_sets))
    sized = clusters.join(whole.withColumn("small", small).select(F.col("cluster").alias("c2"), "small"), F.col("cluster") == F.col("c2")).drop("c2")
    packed = sized.where("small").select("fp", "n", F.struct(F.lit(0).cast("long").alias("a"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).alias("b"), F.lit(0).alias("k"), F.lit(0).alias("l")).alias("grp"), F.col("cluster").alias("sub"), F.lit(0).alias("side"))
    large = sized.where(~F.col("small"))
    blocks = large.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.sum("n") / block_elements), F.ceil(F.count("*") / block_sets)).cast("long").alias("blocks"))
    near = lambda shift, name: blocks.select(F.col("cluster").alias(f"c_{name}"), (F.col("band") + shift).alias(f"b_{name}"), F.col("blocks").alias(name))
    for shift, name in ((0, "own"), (-1, "above"), (1, "below")):
        other = near(shift, name)
        large = large.join(other, (F.col("cluster") == F.col(f"c_{name}")) & (F.col("band") == F.col(f"b_{name}")), "left").drop(f"c_{name}", f"b_{name}")
    i = F.pmod(F.xxhash64("fp"), F.col("own"))
    to = lambda n: F.when(n.isNotNull(), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    meet = lambda a, b, k, l, side: F.struct(F.col("cluster").alias("a"), (a * 1_000_000_007 + b).alias("b"), k.cast("int").alias("k"), l.cast("int").alias("l"), side.cast("int").alias("side"))  # noqa: E731, E741
    b = F.col("band")
    same = F.transform(to(F.col("own")), lambda j: meet(F.least(i, j), F.greatest(i, j), b + 1, b + 1, F.when(i == j, 0).when(i < j, 1).otherwise(2)))
    up = F.transform(to(F.col("above")), lambda j: meet(i, j, b + 1, b + 2, F.lit(1)))
    down = F.transform(to(F.col("below")), lambda j: meet(j, i, b, b + 1, F.lit(2)))
    dealt = large.withColumn("g", F.explode(F.concat(same, up, down)))
    dealt = dealt.select("fp", "n", F.struct("g.a", "g.b", "g.k", "g.l").alias("grp"), F.lit(0).cast("long").alias("sub"), F.col("g.side").alias("side"))
    return packed.unionByName(dealt)


def bloom(ids: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter of 64-bit words over ids (r): made by the tasks, at most ``words`` rows come to the driver."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _spots(batch.column(0).to_numpy(), words)
            yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(bit.ravel().view(np.int64))], ["word", "bit"])

    found = ids.select("r").mapInArrow(made, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _spots(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    dealt = np.stack([mix(ids.view(np.uint64), seed) for seed in (31, 32, 33)])
    return ((dealt >> np.uint64(32)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (dealt & np.uint64(63))


def _sets(docs: DataFrame, involved: DataFrame, n: int, seed: int, made_of, broadcast_ids: int, bloom_words: int, combine: int | None = None) -> DataFrame:
    """(f, elements): what ``made_of`` makes of each set that is involved; with combine (key, fp), a row for each of it. Texts stay where they are; what is made goes on."""
    ids = involved.select(F.col("rep").alias("r"), F.col("fp").alias("f"))
    filtered = None
    if involved.count() <= broadcast_ids:
        docs = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("r")).select("doc_id", "text", "f")
    else:
        filtered = docs.sparkSession.sparkContext.broadcast(bloom(ids, bloom_words))
        docs = docs.where("doc_id is not null").select("doc_id", "text", F.lit(None).cast("long").alias("f"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            here = range(len(batch))
            if filtered is not None:
                word, bit = _spots(batch.column(0).to_numpy(), bloom_words)
                here = np.flatnonzero((filtered.value[word] & bit != 0).all(axis=0)).tolist()
            fps, out = [], []
            for i in here:
                s = ngrams(batch.column(1)[i].as_py(), n, seed)
                fp = int(np.bitwise_xor.reduce(mix(s, 3)).view(np.int64)) if len(s) else None
                if fp is None or batch.column(2)[i].as_py() not in (None, fp):  # of rows with one id, the one meant
                    continue
                own = made_of(s)
                if combine is None:
                    fps.append(fp)
                    out.append(own.tobytes())
                    continue
                keys.append(own)
                ids.append(np.full(len(own), fp, np.int64))
                held += len(own)
                if held > combine:
                    yield _two(keys, ids)
                    keys, ids, held = [], [], 0
            if combine is None:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(out, pa.binary())], ["f", "elements"])
        if combine is not None:
            yield _two(keys, ids)
        clear()

    return docs.mapInArrow(made, "f long, elements binary" if combine is None else "key long, fp long")


def _compared(sets: DataFrame, involved: DataFrame, bands: Bands, limits: tuple[int, int], within) -> DataFrame:
    """(u, v): what ``within`` finds in each group of what was made of the sets. involved: (fp, n, cluster)."""
    groups = _groups(involved.select("fp", "n", "cluster"), bands, *limits)
    rows = groups.join(sets, F.col("fp") == F.col("f")).select("grp", "sub", "side", "fp", "n", "elements")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sub", "ascending"), ("fp", "ascending")]).combine_chunks()
        sub, side, fps, sizes = (table.column(c).to_numpy() for c in ("sub", "side", "fp", "n"))
        made = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        found: list[tuple[int, int]] = []
        ends = np.flatnonzero(np.diff(sub)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(sub)]):
            once = np.arange(lo, hi) if hi == lo + 2 and fps[lo] != fps[lo + 1] else lo + np.unique(fps[lo:hi], return_index=True)[1]  # rows may repeat
            if len(once) > 1:
                found += within(bands, fps[once], [made[i] for i in once], sizes[once], side[once])
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return rows.groupBy("grp").applyInArrow(compare, "u long, v long")


def _links(docs: DataFrame, members: DataFrame, clusters: DataFrame, n: int, seed: int, bands: Bands, limits: tuple[int, int], broadcast_ids: int, bloom_words: int, combine: int, here: int) -> DataFrame:
    """(u, v): links between sets, a spanning forest for each group. members: (fp, n, rep) of all sets."""
    involved = store(clusters.join(members, clusters["node"] == members["fp"]).select("fp", "n", "rep", F.col("component").alias("cluster")))
    made = lambda rows, of, *many: _sets(docs, rows, n, seed, of, broadcast_ids, bloom_words, *many)
    whole = involved.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count("*").alias("sets"))
    large = store(whole.where((F.col("elements") > limits[0]) | (F.col("sets") > limits[1])).select(F.col("cluster").alias("large")))
    if not large.isEmpty():
        on = F.col("cluster") == F.col("large")
        split = involved.join(large, on, "left_semi")
        sized = split.select(F.col("fp").alias("s"), "n")
        meeting, path = store_at(_meeting(made(split, bands.keys, combine)).join(sized, F.col("fp") == F.col("s")).select("fp", "n", "cluster"))
        release(docs.sparkSession)  # the signatures again
        maybe = store(_compared(made(split, lambda s: bitmap(s, bands)), meeting, bands, (limits[0] * BITMAP_ELEMENTS, limits[1] * BITMAP_SETS), maybe_within))
        drop(docs.sparkSession, path)
        parts = components(maybe, here)
        again = split.drop("cluster").join(parts, F.col("fp") == F.col("node")).select("fp", "n", "rep", F.col("component").alias("cluster"))
        involved = store(involved.join(large, on, "left_anti").select("fp", "n", "rep", "cluster").unionByName(again))
    return _compared(made(involved, lambda s: s), involved, bands, limits, links_within)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100,
    block_elements: int = BLOCK_ELEMENTS, block_sets: int = BLOCK_SETS, broadcast_ids: int = BROADCAST_IDS, bloom_words: int = BLOOM_WORDS, combine: int = COMBINE, here: int = HERE,
) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links of Jaccard num/den or more) of each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands = Bands(num, den)
    for seed in range(16):
        marked = store(_fingerprints(docs, n, seed))
        sets = marked.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"))
        sets = store(sets)
        most, clash = sets.agg(F.max("n"), F.bool_or("clash")).first()
        if not clash:
            break
    bands.band(int(most or 1) + 1)
    bands.scheme(len(bands.tops))  # the band after the last
    # each signature is here once for each ``combine`` rows of a task at most, so no task gets very many rows of one
    index = _index(docs.where("doc_id is not null").select("text"), n, seed, bands, combine)
    least = F.min("fp").over(Window.partitionBy("key").orderBy("fp"))
    candidates = index.withColumn("least", least).where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    candidates = store(candidates)
    release(docs.sparkSession)  # the signatures are the largest thing shuffled here, and done with
    clusters = components(candidates, here)
    links = components(store(_links(docs, sets, clusters, n, seed, bands, (block_elements, block_sets), broadcast_ids, bloom_words, combine, here)), here)
    # a document whose sets differ (several rows of one id) joins their components as well
    own = marked.where("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    if not own.isEmpty():
        several = marked.join(own.select(F.col("doc_id").alias("d"), "a"), F.col("doc_id") == F.col("d")).where("fp <> a").select(F.col("a").alias("u"), F.col("fp").alias("v")).distinct()
        links = components(store(links.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(several)), here)
    labelled = sets.select("fp", "rep").join(links, F.col("fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "fp"))
    least = labelled.groupBy("c").agg(F.min("rep").alias("component_id")).withColumnRenamed("c", "c2")
    by_set = labelled.join(least, F.col("c") == F.col("c2")).select(F.col("fp").alias("f"), "component_id")
    out = marked.join(by_set, (F.col("fp") == F.col("f")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of which no one with a smaller id is in their component, with their own columns."""
    found = near_duplicates(docs, doc_id, text, **options)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")

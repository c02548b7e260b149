"""Exact n-gram Jaccard self-join by universe partition.

A document's set is that of its distinct five-word shingles, as 64-bit hashes.
Two sets of sizes a and b link when their Jaccard similarity is 3/4 or more,
which bounds their symmetric difference by (a + b) / 7.

Candidates come from the pigeonhole principle. In each size band the universe
of hashes is cut into m segments. A pair that differs in at most t elements has
m - t identical segments at least, so if each set indexes its t + 1 first
segments in an order that depends on the segments' content only, one of those
is shared. The order puts segments with rare and many elements first: which
shingles are frequent is estimated on a bounded sample, and a wrong estimate
costs time, never a link. A set that has too few segments with rare elements
(it is mostly made of what many documents share) is allotted one-deletion
neighbourhoods instead: in a coarser partition t // 2 + 1 segments differ in at
most one element in a pair, and those share their content or one with an
element left out. Such sets still index their segments with rare elements for
pairs with others. What links by whole segments comes first; between two sets
of different components so far, elements that only one component has differ for
certain, and their numbers u rule out pairs with 7 (u + u') > n + n'.

Groups of sets with a common signature are never expanded into all pairs when
large: the members are compared with one centre (of least u) of the group. What
is then in one component needs no more; members of different components around
one centre, itself included, are compared in blocks of bounded size inside
tasks: by bit maps of their sets, and where these leave a link open on whole
sets, until what links is in one component. Only such links come out. All
candidates are verified exactly on whole sets. Equal sets (64-bit set hash) are
one node from the start.

Cases: null, empty and blank texts have no set, link with nothing and are their
own component; fewer than five words make one shingle; repeated rows are
repeated in the result; rows with a null id take part, and a component's id is
its smallest id that isn't null; an empty table gives an empty result; columns
beside id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, materialize, numbered_columns, partitions

#: Documents in the sample that tells frequent shingles (or one in so many, if
#: that is more), how often a shingle is in them to count as frequent, and how
#: many such are kept.
SAMPLE_DOCS, SAMPLE_SHARE, FREQUENT, FREQUENT_BOUND = 16_384, 32, 3, 2_000_000
#: Pairs for each member up to which a group is compared pairwise at once, and
#: members in a block around a centre and elements of their sets (about).
PAIRS_AT_ONCE, BLOCK, BLOCK_ELEMENTS = 4, 512, 1 << 20
#: Pairs up to which all are verified, whatever components they lie in.
AT_ONCE = 10_000
#: Bits of the map of documents whose sets verification needs, and of maps in plans.
MAP_BITS, LISTED_BITS = 1 << 24, 1 << 21
WORDS = 5
#: Bytes of a word up to which one polynomial is its hash.
CHUNK = 64
#: Bytes of text for each bucket of signatures (some 17 give one), and signatures that a task holds before it deals them out.
BUCKET_BYTES, SIGNED_AT_ONCE = 8 << 20, 1 << 17

U64, U8 = np.uint64, np.uint8
BASE = 0x9E3779B97F4A7C15
PLACE = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Sets(NamedTuple):
    """Sets of a block of texts: the sorted distinct hashes of one after the other, and where each begins (and the last ends)."""

    elements: np.ndarray
    at: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def some(self, take: np.ndarray) -> Sets:
        """Those of a boolean mask."""
        sizes = self.sizes()
        return Sets(self.elements[np.repeat(take, sizes)], offsets(sizes[take]))

    def each(self) -> list[np.ndarray]:
        return np.split(self.elements, self.at[1:-1]) if len(self.at) > 1 else []


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the parts of values that begin at `at` (and end at its last); 0 for empty parts."""
    out = np.zeros(len(at) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


class Shingler:
    """Shingle hashes of texts, by numpy over the bytes of whole blocks of texts."""

    def __init__(self, block_bytes: int = 1 << 18):
        self.block_bytes = block_bytes
        self._tables(block_bytes)

    def _tables(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n + 1, BASE, dtype=U64))
        self.inverse = np.cumprod(np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=U64))
        self.upto = np.zeros(n + 1, dtype=U64)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, Sets]]:
        """The sets of consecutive texts, block by block, each with the place of its first text."""
        binary = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", dtype=U8)
        lo = 0
        while lo < len(binary):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + self.block_bytes, side="right")) - 1)
            yield lo, self.sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lo = hi

    def sets(self, data: np.ndarray, at: np.ndarray) -> Sets:
        """The sets of the texts that begin at `at` in data."""
        if len(data) <= self.block_bytes:
            word, first = self.words(data, at)
        else:  # one long text
            word = np.concatenate([self.words(piece, np.array([0, len(piece)]))[0] for piece in self.pieces(data)])
            first = np.array([0, len(word)])
        n = np.diff(first)
        long = n >= WORDS
        count = np.where(long, n - WORDS + 1, n > 0)
        at = offsets(count)
        out = np.empty(at[-1], dtype=U64)
        if long.any():
            rolled = word[: len(word) - WORDS + 1] * PLACE[0]
            for k in range(1, WORDS):
                rolled += word[k : len(word) - WORDS + 1 + k] * PLACE[k]
            whole = np.arange(len(rolled)) + WORDS <= np.repeat(first[1:], n)[: len(rolled)]
            out[np.repeat(long, count)] = mixed(rolled[whole])
        for i in np.flatnonzero((n > 0) & ~long).tolist():  # the whole sequence; its length keeps it apart
            out[at[i]] = mixed((word[first[i] : first[i + 1]] * PLACE[: n[i]]).sum(keepdims=True) + U64(n[i]))[0]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[lo:hi].sort()
        fresh = np.ones(len(out), dtype=bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[at[:-1][count > 0]] = True
        return Sets(out[fresh], offsets(fresh)[at])

    def pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text, cut after blanks."""
        lo, width = 0, self.block_bytes
        while lo < len(data):
            hi = lo + width
            if hi < len(data):
                cut = np.flatnonzero(blank(data[lo:hi]))
                if not len(cut):
                    width *= 2
                    continue
                hi = lo + int(cut[-1]) + 1
            yield data[lo:hi]
            lo, width = hi, self.block_bytes

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and the number of each text's first."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=U64), np.zeros(len(at), dtype=np.int64)
        if n >= len(self.powers):
            self._tables(n)
        solid = ~blank(data)
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        inner, last = at[at < n], at[at > 0] - 1
        begin[inner], stop[last] = solid[inner], solid[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        lower = data + ((data - U8(65) < U8(26)).view(U8) << U8(5))  # A-Z
        upto = self.upto[: n + 1]
        np.multiply(lower, self.powers[:n], out=upto[1:])
        np.cumsum(upto, out=upto)
        word, size = (upto[ends] - upto[starts]) * self.inverse[starts], ends - starts
        if len(far := np.flatnonzero(size > CHUNK)):  # polynomials of long words can cancel (Thue-Morse): mixed piece by piece
            count = -(-size[far] // CHUNK)
            nth = np.arange(count.sum()) - np.repeat(offsets(count)[:-1], count)
            lo = np.repeat(starts[far], count) + nth * CHUNK
            hi = np.minimum(lo + CHUNK, np.repeat(ends[far], count))
            word[far] = sums(mixed((upto[hi] - upto[lo]) * self.inverse[lo] + nth.astype(U64) * U64(PLACE[0])), offsets(count))
        return mixed(word + size.astype(U64) * U64(BASE)), np.searchsorted(starts, at)


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are a blank or 9 to 13."""
    return (data == U8(32)) | (data - U8(9) < U8(5))


_SHINGLER: list[Shingler] = []


def shingler() -> Shingler:
    if not _SHINGLER:
        _SHINGLER.append(Shingler())
    return _SHINGLER[0]


def set_hashes(sets: Sets, spread: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of the sets; spread: their elements, mixed."""
    return mixed(mixed(sums(spread, sets.at) + U64(BASE)) + sets.sizes().astype(U64)).astype(np.int64)


def band_ends(upto: int) -> list[int]:
    """Largest sizes of the bands, each four times the one before, up to a size at least.

    Wide bands: few sets lie so near an end that a partner may be in the next
    band and they have to sign for both.
    """
    ends = [1]
    while ends[-1] < upto:
        ends.append(4 * ends[-1])
    return ends


class Signer:
    """Signatures of sets; two sets that link have one in common."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.ends = np.array(band_ends(1 << 32), dtype=np.int64)
        self.table = np.zeros(1 << 20, dtype=U8)  # which leading bits frequent elements have
        np.bitwise_or.at(self.table, frequent >> U64(44), U8(1) << ((frequent >> U64(41)) & U64(7)).astype(U8))

    def rare(self, x: np.ndarray) -> np.ndarray:
        """1 for elements that aren't frequent, else 0."""
        out = np.ones(len(x), dtype=np.int64)
        may = np.flatnonzero((self.table[x >> U64(44)] >> ((x >> U64(41)) & U64(7)).astype(U8)) & U8(1))
        if len(may):
            found = np.minimum(np.searchsorted(self.frequent, x[may]), len(self.frequent) - 1)
            out[may[self.frequent[found] == x[may]]] = 0
        return out

    def block(self, sets: Sets, rare: np.ndarray, spread: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of sets, their counts of signatures, these) by whole segments; and by one-deletion neighbourhoods in bands where those don't do. The lowest bit tells which: 0, 1."""
        n = sets.sizes()
        most = 4 * n // 3
        own, last = np.searchsorted(self.ends, n), np.searchsorted(self.ends, most)
        for which, band in ((n > 0, own), ((n > 0) & (last > own), last)):
            if not which.any():
                continue
            inside = np.repeat(which, n)
            sub, which, band = sets.some(which), np.flatnonzero(which), band[which]
            end = self.ends[band]
            differ = (n[which] + np.minimum(end, most[which])) // 7  # of a pair with the set in this band at most
            count, signed = self.whole(sub, rare[inside], spread[inside], band, end, differ)
            yield which, count, signed
            near = np.flatnonzero(count <= differ).tolist()
            if near:
                parts = [slice(sub.at[i], sub.at[i + 1]) for i in near]
                signed = [self.one_deletion(sub.elements[p], spread[inside][p], int(band[i]), int(end[i]), int(differ[i])) for i, p in zip(near, parts, strict=True)]
                yield which[near], np.array([len(x) for x in signed]), np.concatenate(signed).astype(np.int64) | 1

    @staticmethod
    def whole(sets: Sets, rare: np.ndarray, spread: np.ndarray, band: np.ndarray, end: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many signatures each set has, and these: of its first differ + 1 segments those with rare elements.

        First are segments with many rare elements, then with many elements (15 count as more do).
        """
        n = sets.sizes()
        m = (end + 3 * np.sqrt(end)).astype(U64) + U64(1)
        of = np.repeat(np.arange(len(n)), n)
        segment = ((sets.elements >> U64(32)) * m[of]) >> U64(32)
        fresh = np.ones(len(segment), dtype=bool)
        fresh[1:] = segment[1:] != segment[:-1]
        fresh[sets.at[:-1]] = True
        first = np.flatnonzero(fresh)
        content, rares, elements = np.add.reduceat(spread, first), np.add.reduceat(rare, first), np.diff(np.append(first, len(segment)))
        of, segment = of[first], segment[first]
        key = of.astype(U64) << U64(40) | (15 - np.minimum(rares, 15)).astype(U64) << U64(36) | (15 - np.minimum(elements, 15)).astype(U64) << U64(32) | np.arange(len(first)).astype(U64)
        key.sort()
        order = (key & U64(0xFFFFFFFF)).astype(np.int64)
        place = np.arange(len(order)) - offsets(np.bincount(of, minlength=len(n)))[of]  # keys keep the sets together
        order = order[(place <= differ[of]) & (rares[order] > 0)]
        of = of[order]
        signed = mixed(content[order] ^ mixed(segment[order] + (2 * band[of] + 1).astype(U64) * U64(1 << 40)))
        return np.bincount(of, minlength=len(n)), (signed & U64(2**64 - 2)).astype(np.int64)

    @staticmethod
    def one_deletion(x: np.ndarray, spread: np.ndarray, band: int, end: int, differ: int) -> np.ndarray:
        half = 2 * end // 7 // 2
        m = half + half * 3 // 10 + 1
        segment = (((x >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        count = np.bincount(segment, minlength=m)
        content = np.zeros(m, dtype=U64)
        np.add.at(content, segment, spread)
        use = np.ones(m, dtype=bool)
        if (thin := count < 2).sum() <= (m - differ // 2 - 1) // 2:  # both sets of a pair can do without their thin segments
            use = ~thin
        salt = mixed(np.arange(m, dtype=U64) + U64((2 * band + 2) << 40))
        inside = use[segment]
        return np.concatenate((mixed(content[use] ^ salt[use]), mixed((content[segment] - spread)[inside] ^ salt[segment][inside])))

    def __call__(self, x: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one set: signatures by whole segments, and by one-deletion neighbourhoods."""
        signed = [s for _, _, s in self.block(Sets(x, np.array([0, len(x)])), rare, mixed(x + U64(BASE)))]
        signed = np.concatenate(signed) if signed else np.zeros(0, dtype=np.int64)
        return signed[signed & 1 == 0], signed[signed & 1 == 1]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Sets]]:
    """Nodes and sets, block by block; a set that this task has seen is left out."""
    seen: set[int] = set()
    for b in batches:
        for _, sets in shingler().blocks(b.column("text")):
            nodes = set_hashes(sets, mixed(sets.elements + U64(BASE)))
            fresh = unseen(nodes, sets.sizes() > 0, seen)
            yield nodes[fresh], sets.some(fresh)


def unseen(nodes: np.ndarray, full: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the full sets are the first of their node; adds these to seen."""
    out = full.copy()
    for i in np.flatnonzero(full).tolist():
        if (h := int(nodes[i])) in seen:
            out[i] = False
        else:
            seen.add(h)
    return out


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def frequent_shingles(rows: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample share; the sample is drawn by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in new_sets(batches):
            yield batch(shingle=sets.elements.view(np.int64), node=np.repeat(nodes, sets.sizes()))

    chance = F.shiftrightunsigned(F.xxhash64(F.lit(3), "text"), 11) / F.lit(float(1 << 53))
    sample = rows.filter(F.col("text").isNotNull() & (chance < max(SAMPLE_DOCS / max(n, 1), 1 / SAMPLE_SHARE)))
    counts = sample.mapInArrow(run, "shingle long, node long").distinct().groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT_BOUND).select("shingle").toArrow()["shingle"]
    return np.sort(found.to_numpy().view(U64))


def signed_rows(rows: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Members and signatures in one pass over the texts.

    Rows with sigs null are members, one per input row: id, text_hash,
    n_shingles, node, and in the first row of a node in its task `rare`, if it
    needs one-deletion signatures: its elements that aren't frequent. Rows with
    a bucket hold signatures by whole segments of many sets and, side by side,
    their nodes; the bucket goes by the signature. The others hold a node's
    signatures by one-deletion neighbourhoods, whose lowest bit is 1. A node
    signs once per task.
    """
    held = rows.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_BOUND hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen, longs = Signer(held.value), set(), pa.list_(pa.int64())
        signed: list[tuple[np.ndarray, np.ndarray]] = []

        def out(n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
            kinds = dict(id=pa.int64(), text_hash=pa.int64(), n_shingles=pa.int64(), node=pa.int64(), rare=longs, bucket=pa.int32(), sigs=longs, nodes=longs)
            return batch(**{c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()})

        def dealt() -> Iterator[pa.RecordBatch]:
            sig, node = (np.concatenate(x) for x in zip(*signed, strict=True))
            signed.clear()
            bucket = ((sig.view(U64) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order, count = np.argsort(bucket, kind="stable"), np.bincount(bucket)
            full = np.flatnonzero(count)
            sig, node, at = sig[order], node[order], offsets(count[full])
            for i in range(0, len(full), 16):  # small batches: the JVM's native memory grows with the largest
                ends = at[i : i + 17]
                yield out(len(ends) - 1, bucket=full[i : i + 16].astype(np.int32), sigs=lists(sig[ends[0] : ends[-1]], ends - ends[0]), nodes=lists(node[ends[0] : ends[-1]], ends - ends[0]))

        for b in batches:
            for lo, sets in shingler().blocks(b.column("text")):
                spread = mixed(sets.elements + U64(BASE))
                sizes, nodes = sets.sizes(), set_hashes(sets, spread)
                fresh = unseen(nodes, sizes > 0, seen)
                inside, new = np.repeat(fresh, sizes), np.flatnonzero(fresh)
                sets, spread = sets.some(fresh), spread[inside]
                rare, hard = sign.rare(sets.elements), {}
                for which, count, sigs in sign.block(sets, rare, spread):
                    if len(sigs) and sigs[0] & 1:
                        for i in which.tolist():
                            part = slice(sets.at[i], sets.at[i + 1])
                            hard[int(new[i])] = sets.elements[part][rare[part] == 1].view(np.int64)
                        yield out(len(which), node=nodes[new[which]], sigs=lists(sigs, offsets(count)))
                    elif len(sigs):
                        signed.append((sigs, np.repeat(nodes[new[which]], count)))
                k = len(sizes)
                yield out(k, id=b.column("id").slice(lo, k), text_hash=b.column("text_hash").slice(lo, k), n_shingles=sizes, node=pa.array(nodes, mask=sizes == 0), rare=pa.array([hard.get(i) for i in range(k)], longs))
                if sum(len(x) for x, _ in signed) >= max(SIGNED_AT_ONCE, min(16 * buckets, 1 << 22)):
                    yield from dealt()
        if signed:
            yield from dealt()

    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, node long, rare array<bigint>, bucket int, sigs array<bigint>, nodes array<bigint>")


def certain_differences(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, f, comp) of the sets with one-deletion signatures: f = 7 u - n, where no such set of another component has u elements.

    Two of different components link only if f + f' <= 0.
    """
    hard = members.filter(F.col("rare").isNotNull()).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    hard = materialize(hard.select("node", "comp", "n_shingles", "rare"), "hard")
    element = hard.select("comp", F.explode("rare").alias("element")).groupBy("element").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    shared = element.filter(F.col("low") != F.col("high")).select("element")
    held = hard.select("node", F.explode("rare").alias("element")).distinct().join(shared, "element").groupBy("node").agg(F.count("*").alias("shared"))
    sizes = hard.groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("comp").alias("comp"), F.max(F.size("rare")).alias("rare"))
    return sizes.join(held, "node", "left").select("node", (7 * (F.col("rare") - F.coalesce("shared", F.lit(0))) - F.col("n")).alias("f"), "comp")


def group_candidates(nodes: np.ndarray, f: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool] | None:
    """Pairs to verify in a group (two arrays), and whether they are only those with a centre."""
    order = np.lexsort((nodes, f))
    nodes, f, comp = nodes[order], f[order], comp[order]
    upto = np.searchsorted(f, -f, side="right")  # partners have a smaller place
    left, right, total = [], [], 0
    for i in range(len(nodes)):
        if upto[i] <= i + 1:
            break
        mates = np.arange(i + 1, upto[i])
        mates = mates[comp[mates] != comp[i]]
        total += len(mates)
        if total > PAIRS_AT_ONCE * len(nodes):
            return np.full(upto[0] - 1, nodes[0]), nodes[1 : upto[0]], True
        left.append(np.full(len(mates), nodes[i]))
        right.append(nodes[mates])
    return (np.concatenate(left), np.concatenate(right), False) if total else None


PAIR, STAR, RAW = 0, 1, 2


CANDIDATES = "sig long, a long, b long, kind byte"


def paired(sig: np.ndarray, node: np.ndarray, f: np.ndarray | None = None, comp: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What sorted groups of nodes with a common signature give: (sig, a, b, kind)."""
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(first, len(sig)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    if f is None:
        near = sig[first] & 1 == 1
        raw = np.repeat(near & (size > 1), size)
        found.append((sig[raw], node[raw], node[raw], RAW))
        two = first[(size == 2) & ~near]
        found.append((sig[two], node[two], node[two + 1], PAIR))
        loop, f, comp = (size > 2) & ~near, np.full(len(sig), -1), node
    else:
        loop, f, comp = size > 1, f[fresh], comp[fresh]
    for at, n in zip(first[loop].tolist(), size[loop].tolist(), strict=True):
        here = slice(at, at + n)
        if pairs := group_candidates(node[here], f[here], comp[here]):
            found.append((np.full(len(pairs[0]), sig[at]), pairs[0], pairs[1], STAR if pairs[2] else PAIR))
    if found:
        s, a, b = (np.concatenate([x[i] for x in found]) for i in range(3))
        yield batch(sig=s, a=a, b=b, kind=np.repeat(np.array([x[3] for x in found], dtype=np.int8), [len(x[0]) for x in found]))


def candidates(groups: DataFrame, parts: int) -> DataFrame:
    """What groups of nodes with a common signature give: (sig, a, b, kind).

    PAIR: a pair to verify. STAR: one of centre a with b. RAW: b is in a group
    of one-deletion signatures, for which f isn't known yet.
    groups: sig, node; and f and comp if known.
    """
    has = [c for c in ("f", "comp") if c in groups.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in whole_groups(batches, ["sig"], ["sig", "node", *has]):
            yield from paired(*arrays)

    dealt = groups.select("sig", "node", *has).repartition(parts, "sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(run, CANDIDATES)


def bucket_candidates(signed: DataFrame, parts: int) -> DataFrame:
    """The same of buckets of signatures (bucket, sigs, nodes). Most signatures have one node only: a bucket, of bounded size, is sorted in its task and those are dropped first."""

    def groups(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sig, node = sig[shared], node[order][shared]
        if len(sig):
            order = np.lexsort((node, sig))
            yield from paired(sig[order], node[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            sigs, nodes = b.column("sigs"), b.column("nodes")
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                if held and bucket != now:
                    yield from groups(held)
                    held = []
                now = bucket
                held.append((sigs[i].values.to_numpy(), nodes[i].values.to_numpy()))
        if held:
            yield from groups(held)

    return signed.select("bucket", "sigs", "nodes").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, CANDIDATES)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the key changes; never without rows."""
    kept: list[np.ndarray] = []
    for b in batches:
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        kept = [np.concatenate(x) for x in zip(kept, now, strict=True)] if kept else now
        if len(kept[0]):
            same = np.ones(len(kept[0]), dtype=bool)
            for k in keys:
                same &= kept[columns.index(k)] == kept[columns.index(k)][-1]
            upto = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if upto:
                yield [x[:upto] for x in kept]
                kept = [x[upto:] for x in kept]
    if kept and len(kept[0]):
        yield kept


def around_centres(stars: DataFrame, known: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (a, b, d) around centres, as many as bring members that link into one component.

    stars: distinct (centre, node), the centre itself included; known: node,
    comp, f; sets: node, n, bits, shingles. The members of a centre are dealt to
    blocks, and each pair of blocks meets in one task, so that pairs are never
    rows: once with bit maps, which tell the members that may link with another,
    and then these with whole sets.
    """
    known = known.join(sets.select("node", "n"), "node")
    members = materialize(stars.join(known, "node"), "around")
    met = in_blocks(members, sets.select("node", "bits"), ["bits"], open_members, "centre long, node long", parts)
    members = materialize(met.join(known, "node"), "around-open", release=True)
    whole = listed(sets, F.xxhash64("node"), members, F.xxhash64("node")).filter("_listed").select("node", "bits", "shingles")
    return materialize(in_blocks(members, whole, ["bits", "shingles"], compare, "a long, b long, d double", parts), "around-links", release=True)


def in_blocks(members: DataFrame, sets: DataFrame, columns: list[str], compared: Callable[..., Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """Distinct rows that pairs of blocks of a centre's members give. members: centre, node, comp, f, n; sets: node and columns."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    open_ = members.groupBy("centre").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks.alias("blocks")).filter("low <> high").select("centre", "blocks")
    dealt = members.join(materialize(open_, "open"), "centre").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    dealt = dealt.select("centre", "node", "comp", "f", "n", "own", F.inline(meet)).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in whole_groups(batches, ["centre", "i", "j"], ["centre", "i", "j", "own", "node", "comp", "f", "n", *columns]):
            centre, i, j = arrays[:3]
            change = np.flatnonzero((centre[1:] != centre[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(centre)], strict=True):
                own, *values = (x[lo:hi] for x in arrays[3:])
                rows, cols = np.flatnonzero(own == i[lo]), np.flatnonzero(own == j[lo])
                if len(rows) and len(cols):
                    yield from compared(*values, rows, cols, *([centre[lo]] if compared is open_members else []))

    return dealt.repartition(parts, "centre", "i", "j").sortWithinPartitions("centre", "i", "j").mapInArrow(run, schema).distinct()


def open_mates(node: np.ndarray, comp: np.ndarray, f: np.ndarray, n: np.ndarray, bits: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the columns of other components for which neither f, nor sizes, nor bit maps rule a link out, the likest first."""
    words = min(min(len(bits[k]) for k in rows), min(len(bits[k]) for k in cols))

    def folded(k: int) -> np.ndarray:
        x = np.asarray(bits[k], dtype=np.int64).view(U64)  # of a negative number bitwise_count counts the bits of its absolute value
        while len(x) > words:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        return x

    right, one = np.stack([folded(k) for k in cols]), np.array_equal(rows, cols)
    for k in rows.tolist():
        fit = (comp[cols] != comp[k]) & (f[cols] + f[k] <= 0) & (4 * np.minimum(n[cols], n[k]) >= 3 * np.maximum(n[cols], n[k])) & (node[cols] != node[k])
        if one:
            fit &= cols > k
        at = np.flatnonzero(fit)
        differ = np.bitwise_count(right[at] ^ folded(k)).sum(axis=1)
        may = 7 * differ <= n[cols[at]] + n[k]
        yield k, cols[at[may][np.argsort(differ[may], kind="stable")]]


def open_members(node: np.ndarray, comp: np.ndarray, f: np.ndarray, n: np.ndarray, bits: np.ndarray, rows: np.ndarray, cols: np.ndarray, centre: int) -> Iterator[pa.RecordBatch]:
    """(centre, node) of rows and columns that have open mates."""
    held = np.zeros(len(node), dtype=bool)
    for k, mates in open_mates(node, comp, f, n, bits, rows, cols):
        held[mates] = True
        held[k] |= len(mates) > 0
    if held.any():
        yield batch(centre=np.full(held.sum(), centre), node=node[held])


def compare(node: np.ndarray, comp: np.ndarray, f: np.ndarray, n: np.ndarray, bits: np.ndarray, shingles: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b, d) of a row and a column; pairs that these links have brought into one component by then are not looked at."""
    comp, found = comp.copy(), []
    for k, mates in open_mates(node, comp, f, n, bits, rows, cols):
        for x in mates.tolist():
            if comp[x] != comp[k]:
                both = len(np.intersect1d(shingles[x], shingles[k], assume_unique=True))
                union = int(n[x]) + int(n[k]) - both
                if 100 * both >= 75 * union:
                    comp[comp == comp[x]] = comp[k]
                    found.append((*sorted((int(node[x]), int(node[k]))), 1 - both / union))
    if found:
        a, b, d = zip(*found, strict=True)
        yield batch(a=np.array(a, dtype=np.int64), b=np.array(b, dtype=np.int64), d=np.array(d))


def map_bit(key: Column, bits: int = MAP_BITS) -> Column:
    return F.pmod(key, F.lit(bits))


def key_map(rows: DataFrame, key: Column, bits: int = MAP_BITS) -> np.ndarray:
    """A bit map of fixed size of the keys of all rows."""
    rows = rows.select(map_bit(key, bits).alias("bit"))
    parts = rows.groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.collect():  # bits / 32768 rows of 4 KB at most
        at = r["part"] * 4096
        table[at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return table


def in_map(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def listed(df: DataFrame, value: Column, keys: DataFrame, key: Column) -> DataFrame:
    """df with `_listed`: whether `value` may be among the keys; false only where it isn't.

    The map has a fixed size (LISTED_BITS) and is broadcast as a small table:
    as a literal each plan that the driver keeps would hold it several times.
    """
    bit = map_bit(key, LISTED_BITS)
    table = keys.select(bit.alias("_bit")).groupBy((F.col("_bit") / 32768).cast("int").alias("_part")).agg(F.bitmap_construct_agg(F.pmod("_bit", F.lit(32768))).alias("_bits"))
    met = df.withColumn("_bit", map_bit(value, LISTED_BITS)).withColumn("_part", (F.col("_bit") / 32768).cast("int")).join(F.broadcast(table), "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.pmod("_bit", F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod("_bit", F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("_listed", F.coalesce(hit, F.lit(False))).drop("_bit", "_part", "_bits")


def needed_sets(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, n, bits, shingles) of the nodes in pairs, read again from the texts of one document each.

    A bit map of fixed size finds those documents; it may let others through.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    held = rows.sparkSession.sparkContext.broadcast(key_map(wanted, F.xxhash64("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_only = (b.filter(pa.array(in_map(held.value, b.column("bit").to_numpy()))) for b in batches)
        for nodes, sets in new_sets(wanted_only):
            yield batch(node=nodes, n=sets.sizes(), bits=lists(*bit_maps(sets)), shingles=lists(*sets))

    located = rows.select("text", map_bit(F.xxhash64("id")).alias("bit"))
    return located.mapInArrow(run, "node long, n long, bits array<bigint>, shingles array<bigint>")


def bit_maps(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Which of 4 to 8 bits per element are hit, and where each set's map begins; a map is a power of two of 64-bit words, so that a longer one folds into a shorter one."""
    n = sets.sizes()
    words = np.array([1 << max(0, (4 * k - 1).bit_length() - 6) for k in n.tolist()], dtype=np.int64)
    at = offsets(words)
    hit = np.zeros(64 * at[-1], dtype=bool)
    hit[(sets.elements & np.repeat((64 * words - 1).astype(U64), n)).astype(np.int64) + np.repeat(64 * at[:-1], n)] = True
    return np.packbits(hit, bitorder="little").view(U64), at


def _differing(a: str, b: str) -> Column:
    """Differing bits of two bit maps, the longer one folded: no more than the sets' differing elements."""

    def folded(x: str, n: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseOR(v))).otherwise(F.col(x))

    least = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, least), folded(b, least), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, n: total + n).cast("long")


def verified(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, d, linked): the exact Jaccard distance, or where sizes or bit maps rule a link out, a lower bound of it; and a table to discard after that.

    Bit maps are a small part of the sets; most pairs that don't link go no further.
    """

    def side(x: str, *more: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in more])

    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    met = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    near_size = 4 * small >= 3 * large
    met = met.withColumn("differ", F.when(near_size, _differing("bitsa", "bitsb"))).select("a", "b", "na", "nb", near_size.alias("sized"), "differ")
    met = materialize(met.withColumn("open", F.col("sized") & (7 * F.col("differ") <= F.col("na") + F.col("nb"))), "met", release=True)
    total = F.col("na") + F.col("nb")
    bound = F.when(F.col("sized"), 2 * F.col("differ") / (total + F.col("differ"))).otherwise(1 - small / large)
    out = met.filter(~F.col("open")).select("a", "b", bound.alias("d"), F.lit(False).alias("linked"))
    both = F.size(F.array_intersect("shinglesa", "shinglesb")).cast("long")
    open_nodes = met.filter("open").select(F.explode(F.array("a", "b")).alias("node"))
    sets = listed(sets, F.xxhash64("node"), open_nodes, F.xxhash64("node")).filter("_listed")
    exact = met.filter("open").select("a", "b", "na", "nb").join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").withColumn("both", both)
    union = total - F.col("both")
    return out.union(exact.select("a", "b", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= 75 * union).alias("linked"))), met


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b), and those of known: comp is the smallest node reachable.

    known: what components of earlier edges are; only edges across these count.
    Each node of the edges left points at its smallest neighbour, and these
    pointers are followed to their ends, which the edges join from then on:
    those within one end are gone. Two rounds at least halve the ends of
    each component (one that nobody points at has a smaller neighbour by
    then), so that all rounds together join little more than the edges once.
    """
    labels, left = None, _between(edges, known)
    while labels is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        ends = _followed(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
        labels = ends if labels is None else _relabelled(labels, ends)
        left = _between(left, ends)
    if known is None:
        return materialize(labels, "labels")
    fresh = labels.join(known, "node", "left_anti")
    return materialize(_relabelled(known, labels).union(fresh), "labels")


def _between(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Distinct edges between the components of labels, smaller end first; a node without a label is its own."""
    a, b = F.col("a"), F.col("b")
    if labels is not None:
        side_a, side_b = (labels.select(F.col("node").alias(x), F.col("comp").alias("comp_" + x)) for x in "ab")
        edges = edges.select("a", "b").join(side_a, "a", "left").join(side_b, "b", "left")
        a, b = F.coalesce("comp_a", "a"), F.coalesce("comp_b", "b")
    return materialize(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")


def _followed(pointers: DataFrame) -> DataFrame:
    """Where the pointers (node, comp) of each node end; their length halves in each round."""
    pointers = materialize(pointers.withColumn("moved", F.col("node") != F.col("comp")), "pointers")
    while not pointers.filter("moved").isEmpty():
        further = pointers.filter("node <> comp").select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        to = F.coalesce("next", "comp")
        pointers = materialize(pointers.join(further, "comp", "left").select("node", to.alias("comp"), F.col("next").isNotNull().alias("moved")), "pointers")
    return pointers.select("node", "comp")


def _relabelled(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """labels with their components' own labels, where these have some."""
    to = ends.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def link_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row (id, n_shingles, node, group, text_hash, component_id), and links between nodes (a, b, d) that make up the components.

    node: the hash of the row's set (null: none); rows of a node have equal
    sets. group: the smallest node of the component.
    """
    rows = _rows(docs, id_col, text_col)
    parts = partitions(docs.sparkSession)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequent = frequent_shingles(rows, n)
    made = materialize(signed_rows(rows, frequent, max(4 * parts, size // BUCKET_BYTES)), "signatures", release=True)
    members = materialize(made.filter(F.col("sigs").isNull()).drop("bucket", "sigs", "nodes"), "members")
    nodes = materialize(members.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    whole, near = made.filter(F.col("bucket").isNotNull()), made.filter(F.col("sigs").isNotNull() & F.col("bucket").isNull())
    signed = bucket_candidates(whole, parts).union(candidates(near.select("node", F.explode("sigs").alias("sig")), parts))
    signed = materialize(signed, "signed", release=True)
    discard(made)
    whole = signed.filter(F.col("kind") != RAW)
    first, labels = _resolved(whole, nodes.select("node", F.lit(-1).cast("long").alias("f"), F.col("node").alias("comp")), rows, nodes, None, parts)
    known = materialize(certain_differences(members, labels), "differences")
    near = signed.filter(F.col("kind") == RAW).select("sig", F.col("b").alias("node")).join(known, "node")
    near = materialize(candidates(near, parts), "near", release=True)
    discard(signed)
    second, labels = _resolved(near, known, rows, nodes, labels, parts)
    edges = materialize(first.union(second).distinct(), "links", release=True)
    low = materialize(labels.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("low")), "lowest")
    named = materialize(nodes.join(labels, "node", "left").join(low, "comp", "left").select("node", F.coalesce("comp", "node").alias("group"), F.coalesce("low", "rep").alias("component")), "named")
    out = members.join(named, "node", "left").select("id", "n_shingles", "node", "group", "text_hash", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumnRenamed("id", id_col), edges


def _linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, d) among pairs (a, b, star) that make up the components of all their links and of labels, and the labels then.

    First each node is compared with its first mate, then with a few: members of
    a large group of near copies come into one component by a link each. Of
    the other pairs only those across components are open, and all of these are
    verified. Few pairs are verified at once. Of many, those that only stars
    give go no further than first mates: they are left to around_centres.
    """
    rest, links = pairs, None
    for mates in (1, 4, None):
        last = mates is None or rest.count() <= AT_ONCE
        if last:
            now = rest.select("a", "b")
        elif mates == 1:
            now = materialize(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "mates")
        else:
            nth = F.row_number().over(Window.partitionBy("b").orderBy("a"))
            now = materialize(rest.withColumn("nth", nth).filter(F.col("nth") <= mates).select("a", "b"), "mates")
        found, met = verified(now, sets)
        found = materialize(found.filter("linked").select("a", "b", "d"), "links", release=True)
        discard(met)
        links = found if links is None else materialize(links.union(found), "links")
        labels = components(found, labels)
        if last:
            break
        side_a, side_b = (labels.select(F.col("node").alias(x), F.col("comp").alias("comp_" + x)) for x in "ab")
        across = rest.filter("not star").join(side_a, "a", "left").join(side_b, "b", "left").filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
        across = materialize(across.select("a", "b", "star").join(now, ["a", "b"], "left_anti"), "across", release=True)
        discard(now, *([rest] if rest is not pairs else []))
        rest = across
    if rest is not pairs:
        discard(rest)
    return links, labels


def _resolved(found: DataFrame, known: DataFrame, rows: DataFrame, nodes: DataFrame, labels: DataFrame | None, parts: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, d) among candidates and around their centres, as many as make up the components with those of labels, and the labels then; known: node, f, comp; labels: of earlier links."""
    pairs = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.col("kind") == STAR).alias("star"))
    pairs = materialize(pairs, "pairs", release=True)
    sets = materialize(needed_sets(rows, nodes, pairs), "sets", release=True)
    links, labels = _linked(pairs, sets, labels)
    discard(pairs)
    stars = found.filter(F.col("kind") == STAR).select(F.col("a").alias("centre"), F.col("b").alias("node")).distinct()
    stars = materialize(stars.union(stars.select("centre", F.col("centre").alias("node"))).distinct(), "stars")
    if stars.isEmpty():
        discard(sets)
        return links, labels
    known = known.join(labels.withColumnRenamed("comp", "now"), "node", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
    around = around_centres(stars, known, sets, parts)
    discard(sets)
    return links.union(around).distinct(), components(around, labels)


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id (nulls last). Texts without words all stay.

    Only texts whose key is in a bit map of the keys to drop are shuffled.
    """
    flat, names = numbered_columns(docs)
    id_, text = names[id_col], names[text_col]
    keyed = flat.withColumn("_text_hash", F.xxhash64(F.col(text).cast("string")))
    members = materialize(link_copies(flat.select(F.col(id_).alias("id"), F.col(text).alias("text")), id_col="id")[0], "groups").filter(F.col("node").isNotNull())
    order = F.struct(F.col("id").isNull(), F.col("id"), "text_hash")
    first = materialize(members.groupBy("group").agg(F.min(order).alias("first")), "first")
    drop = members.join(first, "group").filter(order != F.col("first")).select(F.col("id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash")).distinct()
    repeated = members.groupBy("id", "text_hash").count().filter(F.col("count") > 1).select(F.col("id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash"))
    drop = materialize(drop.withColumn("_all", F.lit(True)).unionByName(repeated.withColumn("_all", F.lit(False))).groupBy("_drop_id", "_drop_hash").agg(F.max("_all").alias("_all")), "drop")
    marked = listed(keyed, F.xxhash64(F.col(id_).cast("long"), "_text_hash"), drop, F.xxhash64("_drop_id", "_drop_hash"))
    looked_up = marked.filter("_listed").join(drop, F.col(id_).cast("long").eqNullSafe(F.col("_drop_id")) & (F.col("_text_hash") == F.col("_drop_hash")), "left").filter(~F.coalesce("_all", F.lit(False)))
    # of rows with equal id and text the first by all other columns, so that reruns agree
    others = [F.to_json(F.struct(n)) if "map<" in kind or kind == "variant" else F.col(n) for n, kind in flat.dtypes if n not in (id_, text)]
    nth = F.row_number().over(Window.partitionBy(id_, "_text_hash").orderBy(*others or [F.lit(0)]))
    looked_up = looked_up.withColumn("_nth", nth).filter(F.col("_all").isNull() | (F.col("_nth") == 1))
    rows = marked.filter(~F.col("_listed")).select(*names.values()).union(looked_up.select(*names.values()))
    return rows.toDF(*names)


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links)."""
    return link_copies(docs, id_col=id_col, text_col=text_col)[0].select(id_col, "n_shingles", "component_id")

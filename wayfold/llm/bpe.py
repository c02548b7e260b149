"""Byte-level BPE: encoding by folded ranked merges, decoding by joining pieces.

Two forms give the same ids. `encode_words` is the form in Spark's higher-order
functions: it folds the ranked merges over the byte arrays of distinct words,
with the ranks in a literal map that is split into small buckets (a literal map
is searched entry by entry). `encode_documents` is the form for whole corpora:
each Arrow batch is split into words, distinct words are folded once and kept
in a bounded cache of the worker, and the ids of a text are joined in order.
No dictionary of the corpus is shuffled or broadcast.

Cases: null and empty texts have no tokens and decode to no bytes; repeated
rows give repeated results; an empty table gives an empty result; other input
columns don't matter, whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

CACHE_ENTRIES = 120_000
BUCKETS = 8192
#: Characters of short texts that are encoded together, and bytes from which a word is folded by itself.
PART_CHARS, LONG_WORD = 1 << 19, 400
NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, path: str, pattern: str, cache_entries: int = CACHE_ENTRIES):
        import regex

        self.ranks = read_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.words = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []
        self.cache_entries = cache_entries
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = [(left << 32 | right, rank) for piece, rank in self.ranks.items() for left, right in self.splits(piece)]
        pairs.sort()
        self.keys, self.merged = np.array([k for k, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int64)

    def splits(self, piece: bytes) -> list[tuple[int, int]]:
        """The pairs of ranks whose pieces join to this one."""
        parts = ((self.ranks.get(piece[:i]), self.ranks.get(piece[i:])) for i in range(1, len(piece)))
        return [(a, b) for a, b in parts if a is not None and b is not None]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs; NONE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def fold(self, data: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else list(array("I", next(self.fold_words([data]))[1]))

    def fold_words(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(number, packed ids) of words that aren't empty, in any order.

        All words are folded side by side: each step joins in every word the
        adjacent pair of lowest rank, leftmost first, and words without any drop out.
        """
        if not words:
            return
        number = np.arange(len(words))
        size = np.array([len(w) for w in words])
        token = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        last = np.cumsum(size) - 1
        rank = np.full(len(token), NONE)
        rank[:-1] = self.joined(token[:-1], token[1:])
        rank[last] = NONE
        while len(number):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)  # the leftmost of the lowest
            done = best >> 32 == NONE
            if done.any():
                out = np.repeat(done, size)
                packed, end = token[out].astype("<u4").tobytes(), 4 * np.cumsum(size[done])
                for i, lo, hi in zip(number[done].tolist(), [0, *end[:-1].tolist()], end.tolist(), strict=True):
                    yield i, packed[lo:hi]
                shift = np.cumsum(np.repeat(done, size))
                best = best[~done]
                at = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
                token, rank, number, size = token[~out], rank[~out], number[~done], size[~done]
                if not len(number):
                    return
            else:
                at = best & 0xFFFFFFFF
            token[at] = best >> 32
            last = np.cumsum(size) - 1
            keep = np.ones(len(token), dtype=bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            at = at - np.arange(len(at))  # each word has lost one token
            token, rank, size = token[keep], rank[keep], size - 1
            last = np.cumsum(size) - 1
            right, left = at[at != last], at[at != last - size + 1]
            rank[right] = self.joined(token[right], token[right + 1])
            rank[left - 1] = self.joined(token[left - 1], token[left])
            rank[last] = NONE

    def fold_long(self, data: bytes) -> list[int]:
        """The same for one word with a heap, for words so long that a step for each joined pair would count."""
        import heapq

        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all these words into the cache, which keeps words that are still in use."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.cache_entries:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        self.long += [w for w in new if len(w) > 64]
        short, data = [], []
        for w in new:
            piece = w.encode()
            if (whole := self.ranks.get(piece)) is not None:
                self.cache[w] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_WORD:
                self.cache[w] = array("I", self.fold_long(piece)).tobytes()
            else:
                short.append(w)
                data.append(piece)
        for i, ids in self.fold_words(data):
            self.cache[short[i]] = ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        part, size = [], 0
        for t in texts:
            if len(t) > PART_CHARS:
                yield from self.encode_part(part)
                part, size = [], 0
                yield self.encode_long(t)
                continue
            if size + len(t) > PART_CHARS:
                yield from self.encode_part(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        yield from self.encode_part(part)

    def encode_part(self, texts: list[str]) -> list[bytes]:
        found = [self.words.findall(t) for t in texts]
        self.learn(set().union(*found))
        ids = [b"".join(map(self.cache.__getitem__, words)) for words in found]
        self.forget_long()
        return ids

    def encode_long(self, text: str) -> bytes:
        """A long text, some ten thousand words at a time."""
        out, matches = [], self.words.finditer(text)
        while words := [m.group() for m in itertools.islice(matches, PART_CHARS // 8)]:
            self.learn(set(words))
            out += map(self.cache.__getitem__, words)
            self.forget_long()
        return b"".join(out)

    def forget_long(self) -> None:
        """Long words aren't kept: they hardly come again, and the cache is bounded by entries."""
        for w in self.long:
            del self.cache[w]
        self.long.clear()

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if numbers.itemsize != 4:
            raise RuntimeError("no unsigned type of 32 bits")
        return b"".join(map(self.pieces.__getitem__, numbers))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, digests: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids (packed little-endian 32-bit), and with `decode` what the ids decode to.

    digests: ids_sha256 (and decoded_sha256) in their place, so that no ids leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_path, pattern)
        for b in batches:
            ids = list(bpe.encode(b.column("text").to_pylist()))
            out = {"ids": ids} | ({"decoded": map(bpe.decode, ids)} if decode else {})
            columns = [pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) if digests else pa.array(list(v), pa.binary()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), *columns], names=["id", "n_tokens", *(c + "_sha256" * digests for c in out)])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = "".join(f", {c}_sha256 string" if digests else f", {c} binary" for c in ("ids", "decoded")[: 1 + decode])
    return rows.mapInArrow(run, f"id {kind}, n_tokens long" + made).withColumnRenamed("id", id_col)


def rank_buckets(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as a literal array of small maps; a piece (hex) lies in the bucket that its CRC names."""
    import zlib

    parts: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


def encode_words(words: DataFrame, rank_path: str, *, word_col: str = "word") -> DataFrame:
    """Distinct words and their ids (array<int>), by higher-order functions only."""
    ranks = read_ranks(rank_path)
    table, none = rank_buckets(ranks), 1 << 30

    def rank(piece: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), F.hex(piece)), F.lit(none))

    def pair_ranks(pieces: Column) -> Column:
        return F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: rank(F.concat(a, b)))

    def merge(pieces: Column, _: Column) -> Column:
        found = pair_ranks(pieces)
        at = F.array_position(found, F.array_min(found)).cast("int")
        joined = F.concat(F.slice(pieces, 1, at - 1), F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))), F.slice(pieces, at + 2, F.greatest(F.size(pieces) - at - 1, F.lit(0))))
        return F.when((F.size(pieces) < 2) | (F.array_min(found) >= none), pieces).otherwise(joined)

    data = F.col(word_col).cast("binary")
    singles = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.substring(data, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), singles, merge)
    whole = rank(data)
    ids = F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).when(whole < none, F.array(whole)).otherwise(F.transform(folded, rank))
    return words.select(word_col).distinct().select(word_col, ids.alias("ids"))

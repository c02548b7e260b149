"""Token counts by byte-pair merging with a heap over a linked list.

A word starts as a doubly linked list of symbols. A heap holds the adjacent
pairs that have a merge rank, lowest rank first and leftmost first among equal
ranks; each pop joins a pair and pushes the two new neighbours. The count of a
word is its number of initial symbols minus its merges: token ids are never
made. White space separates words, so counts are remembered per white-space
free chunk, in a bounded cache of each Python worker.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give
repeated results; other columns of the input, also such as carry the names of
the result, don't matter; an empty table gives an empty result. Texts are
counted whole, however long.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries after which a worker's cache starts anew.
CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCounter:
    """Counts of a BPE vocabulary with word ends, lower case and NFC."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.base = 1 << 20
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[self.ids[left] * self.base + self.ids[right]] = (rank, self.ids[left + right])
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(alphabet[b], -1) for b in range(256)]
        self.final = [self.ids.get(alphabet[b] + self.suffix, -1) for b in range(256)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple(special)
        # str.split() also takes these four for white space; the vocabulary doesn't
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.cache: dict[str, int] = {}
        self.cache_entries = cache_entries

    def word(self, data: bytes) -> int:
        """Initial symbols minus merges of one pre-split word."""
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        if -1 in symbols:  # bytes without a symbol are left out
            symbols = [s for s in symbols if s >= 0]
        n = len(symbols)
        if n < 2:
            return n
        pairs, base = self.pairs, self.base
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] * base + symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = pairs.get(symbols[i] * base + symbols[j])
            if not found or found[0] != rank:  # one side was merged meanwhile
                continue
            symbols[i], symbols[j] = made, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(made * base + symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbols[h] * base + made)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return n - merges

    def chunk(self, chunk: str) -> int:
        text = unicodedata.normalize("NFC", chunk)
        if not text.isascii():  # lower case of each character alone: no final sigma
            text = text.replace("Σ", "σ")
        return sum(self.word(w.encode()) for w in self.words.findall(text.lower()))

    def plain(self, text: str) -> int:
        cache = self.cache
        chunks = self.space.split(text) if self.odd_space.search(text) else text.split()
        try:
            return sum([cache[c] for c in chunks])
        except KeyError:
            pass
        total = 0
        for c in chunks:
            n = cache.get(c)
            if n is None:
                if len(cache) >= self.cache_entries:
                    cache.clear()
                n = self.chunk(c)
                if len(c) <= 64:
                    cache[c] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


_COUNTERS: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    tokenizer_path must name a file that every executor has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer_path).count
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": [count(t) for t in batch["text"]]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

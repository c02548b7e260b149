"""Ranked lexical search with an inverted treap for each term.

The documents are indexed in shards of bounded size. A shard's postings of a
term form a treap: a search tree by document number and a heap by impact, so
that a subtree's root bounds every impact below. A search goes down the treaps
of all terms of an item at once: a piece of the document range has, for every
term, the highest node in that range, and the sum of these impacts is the most
that any of its documents can score. A piece whose sum can't enter the top k
goes with all its subtrees; of another the document with the largest single
contribution is scored, and parts the piece in two. Pieces of many items are
taken together, highest sums first, so that the bounds rise early.

Passes over the data: documents become shards of postings (restricted to the
terms asked for), staged; document frequencies and lengths are summed; a first
round searches a share of the shards, whose k-th best scores bound those of all
from below; the second searches the others. A task keeps k results of an item
over all its shards, and these are ranked at last. Items go in blocks, each with its own passes.

Impacts are exact 64-bit integers, those of the bounds too.

Cases: null texts have no terms; documents without terms don't count and are
never found; rows with a null doc_id take no part; rows that share a doc_id are
documents each; each row of items is answered by itself, also where the ids of
items repeat or are null; an item without terms, or with none that a document
holds, has no results; columns beside id and text don't matter. Texts are read
whole, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, materialize

#: Items in a block, and bytes of their texts after which a block ends.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Postings after which a shard ends; cells (pieces x terms) that are searched at once.
SHARD, CELLS = 1 << 20, 1 << 19
#: One shard in so many is searched first, for bounds.
FIRST = 8
INDEX = "shard long, docs long, words long, terms array<int>, df array<int>, doc_ids binary, sizes binary, ends binary, at binary, tf binary"

#: Terms: ASCII letters (in lower case) and digits, and all bytes of other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- index


def shards(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, most: int = SHARD) -> DataFrame:
    """Rows of INDEX: a shard's documents in the order of their ids, and for each of its terms the postings in that order; a shard ends with the document that brings it to `most` postings."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(number: int, ids: list[int], sizes: list[int], found: list[Counter], others: tuple[int, int]) -> pa.RecordBatch:
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        term = np.array([t for i in order for t in found[i]], dtype=np.int32)
        tf = np.array([n for i in order for n in found[i].values()], dtype=np.int32)
        at = np.repeat(np.arange(len(order), dtype=np.int32), [len(found[i]) for i in order])
        by_term = np.argsort(term, kind="stable")
        names, counts = np.unique(term, return_counts=True)
        data = [np.array(ids, dtype=np.int64)[order], np.array(sizes, dtype=np.int64)[order], np.cumsum(counts, dtype=np.int64), at[by_term], tf[by_term]]
        columns = [[number], [others[0]], [others[1]], [names.tolist()], [counts.tolist()], *[[x.tobytes()] for x in data]]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, look = TaskContext.get().partitionId() << 24, known.value.get
        ids: list[int] = []
        sizes: list[int] = []
        found: list[Counter] = []
        held = docs_ = words_ = 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                docs_, words_ = docs_ + 1, words_ + len(words)
                own = Counter(map(look, words))
                own.pop(None, None)
                if own:
                    ids.append(i)
                    sizes.append(len(words))
                    found.append(own)
                    held += len(own)
                if held >= most:
                    yield shard(number, ids, sizes, found, (docs_, words_))
                    number, held, docs_, words_, ids, sizes, found = number + 1, 0, 0, 0, [], [], []
        if docs_:
            yield shard(number, ids, sizes, found, (docs_, words_))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, INDEX)


class Treaps:
    """A shard's treaps, nodes of all terms in one line; node -1, at the end of the line, is none."""

    def __init__(self, row: dict, lengths: tuple[int, int], vocabulary: int):
        n_docs, n_words = lengths
        self.doc_ids, size = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        ends, tf = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        at = np.frombuffer(row["at"], np.int32)
        damp = 100 - 50 + (50 * size * n_docs) // n_words
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * damp[at])
        self.doc = np.append(at, np.int32(-1))
        self.impact = np.append(impact, 0)
        # equal impacts are ordered by a hash of the document, so that many equal ones make no deep tree
        mix = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
        roots, self.left, self.right = self._link((impact << 20 | mix.astype(np.int64)).tolist(), [0, *ends.tolist()])
        self.root = np.full(vocabulary + 1, -1, dtype=np.int32)
        self.root[row["terms"]] = roots

    @staticmethod
    def _link(priority: list[int], ends: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Roots of the terms, and both children of every node: in the order of documents, each node below the nearest higher ones."""
        left, right, roots = [-1] * (len(priority) + 1), [-1] * (len(priority) + 1), []
        for begin, end in zip(ends, ends[1:], strict=False):
            spine: list[int] = []
            for i in range(begin, end):
                p, below = priority[i], -1
                while spine and priority[spine[-1]] < p:
                    below = spine.pop()
                left[i] = below
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots.append(spine[0])
        return roots, np.array(left, dtype=np.int32), np.array(right, dtype=np.int32)

    def part(self, nodes: np.ndarray, low: np.ndarray, doc: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Down from the nodes towards each piece's document: its impacts, and the highest nodes of its two parts, between low and the document and from it to high."""
        impact = np.zeros(nodes.shape, dtype=np.int64)
        before, after = np.full(nodes.shape, -1, dtype=np.int32), np.full(nodes.shape, -1, dtype=np.int32)
        flat_impact, flat_before, flat_after = impact.ravel(), before.ravel(), after.ravel()
        cell = np.flatnonzero(nodes.ravel() >= 0)
        node, piece = nodes.ravel()[cell], cell // nodes.shape[1]
        while len(cell):
            own, goal = self.doc[node], doc[piece]
            less, more = own < goal, own > goal
            for into, fits in ((flat_before, less & (own > low[piece])), (flat_after, more & (own < high[piece]))):
                fits &= into[cell] < 0
                into[cell[fits]] = node[fits]
            hit = ~(less | more)
            c, n = cell[hit], node[hit]
            flat_impact[c] = self.impact[n]
            self._within(flat_before, c, self.left[n], self.right, low[piece[hit]], np.less_equal)
            self._within(flat_after, c, self.right[n], self.left, high[piece[hit]], np.greater_equal)
            node = np.where(less, self.right[node], self.left[node])
            on = (node >= 0) & ~hit
            cell, node, piece = cell[on], node[on], piece[on]
        return impact, before, after

    def _within(self, into: np.ndarray, cell: np.ndarray, node: np.ndarray, inward: np.ndarray, end: np.ndarray, outside: np.ufunc) -> None:
        """Set cells that hold nothing yet to the highest node, from the given ones inward, that isn't outside the range's end."""
        on = (into[cell] < 0) & (node >= 0)
        cell, node, end = cell[on], node[on], end[on]
        while len(cell):
            out = outside(self.doc[node], end)
            into[cell[~out]] = node[~out]
            cell, node, end = cell[out], inward[node[out]], end[out]
            on = node >= 0
            cell, node, end = cell[on], node[on], end[on]


# --- search


class Ranking:
    """The k best of each item so far: scores downwards, equal ones by document."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= self.least[item]
        if not fit.any():
            return
        item, score, doc = (np.concatenate([a, b[fit]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        top = nth < self.k
        self.item, self.score, self.doc = item[top], score[top], doc[top]
        last = nth[top] == self.k - 1
        self.least[self.item[last]] = np.maximum(self.least[self.item[last]], self.score[last])


def search_shard(treaps: Treaps, terms: np.ndarray, weights: np.ndarray, items: np.ndarray, best: Ranking) -> int:
    """Search one shard for items with equally many terms; the number of documents scored. terms: a row per item, padded by the last number of the vocabulary."""
    rows = max(1, CELLS // max(1, terms.shape[1]))
    low, high = np.full(len(items), -1, dtype=np.int32), np.full(len(items), len(treaps.doc_ids), dtype=np.int32)
    open_ = cut(rows, np.arange(len(items)), low, high, treaps.root[terms])
    scored = 0
    while open_:
        own, low, high, nodes = open_.pop()
        gain = weights[own] * treaps.impact[nodes]
        most = gain.sum(axis=1)
        keep = (most >= best.least[items[own]]) & (most > 0)
        if not keep.any():
            continue
        own, low, high, nodes, gain = own[keep], low[keep], high[keep], nodes[keep], gain[keep]
        doc = treaps.doc[nodes[np.arange(len(own)), np.where(nodes >= 0, gain, -1).argmax(axis=1)]]
        impact, before, after = treaps.part(nodes, low, doc, high)
        score = (weights[own] * impact).sum(axis=1)
        scored += len(own)
        best.add(items[own[score > 0]], score[score > 0], treaps.doc_ids[doc[score > 0]])
        own, low, high, nodes = np.concatenate([own, own]), np.concatenate([low, doc]), np.concatenate([doc, high]), np.concatenate([before, after])
        most = (weights[own] * treaps.impact[nodes]).sum(axis=1)
        held = np.flatnonzero((most > 0) & (most >= best.least[items[own]]))
        if len(held) > rows:  # the most promising pieces next
            held = held[np.argsort(most[held], kind="stable")]
        open_ += cut(rows, own[held], low[held], high[held], nodes[held])
    return scored


def cut(rows: int, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    return [tuple(c[i : i + rows] for c in columns) for i in range(0, len(columns[0]), rows)]


class Asked:
    """A block of items: their terms by number, weights, and groups of items with about equally many terms."""

    def __init__(self, items: list[list[int]], weights: list[int]):
        self.n, self.vocabulary = len(items), len(weights)
        w = np.append(np.array(weights, dtype=np.int64), 0)
        self.groups = []
        by_width: dict[int, list[int]] = {}
        for i, own in enumerate(items):
            if own:
                by_width.setdefault((len(own) - 1).bit_length(), []).append(i)
        for own in by_width.values():
            width = max(len(items[i]) for i in own)
            terms = np.full((len(own), width), len(weights), dtype=np.int64)
            for r, i in enumerate(own):
                terms[r, : len(items[i])] = items[i]
            self.groups.append((np.array(own, dtype=np.int64), terms, w[terms]))


def searched(index: DataFrame, asked: Asked, lengths: tuple[int, int], least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): every task's k best of each item."""
    held = index.sparkSession.sparkContext.broadcast((asked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = held.value
        best = Ranking(least, k)
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                if row["terms"]:
                    treaps = Treaps(row, lengths, asked.vocabulary)
                    for items, terms, weights in asked.groups:
                        search_shard(treaps, terms, weights, items, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    return index.select("terms", "doc_ids", "sizes", "ends", "at", "tf").mapInArrow(run, "item int, doc_id long, score long")


def kth(found: DataFrame, n: int, k: int) -> np.ndarray:
    """The k-th best score of each item, 0 where fewer were found."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    out = np.zeros(n, dtype=np.int64)
    for r in found.withColumn("nth", nth).filter(F.col("nth") <= k).filter(F.col("nth") == k).collect():
        out[r["item"]] = r["score"]
    return out


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items by blocks of bounded size: (id, text)."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        block.append((r["id"], r["text"]))
        size += len(r["text"] or "")
        if len(block) >= BLOCK or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", postings: int = SHARD) -> DataFrame:
    """Per item its k best documents: item id, rank (from 1), doc_id, score. postings: about how many a shard holds."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    done: DataFrame | None = None
    for number, block in enumerate(blocks(items, item_col, item_text_col)):
        words = [list(dict.fromkeys(terms_of(text))) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in words for t in own))}
        index = materialize(shards(docs, vocabulary, id_col, text_col, postings), "postings")
        n_docs, n_words = (v or 0 for v in index.agg(F.sum("docs"), F.sum("words")).first())
        if not n_docs:
            discard(index)
            break
        pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy("p.terms").agg(F.sum(F.col("p.df").cast("long")).alias("df"))
        df = {r["terms"]: r["df"] for r in pairs.collect()}  # a row per term of the block at most
        asked = Asked([[i for t in own if (i := vocabulary[t]) in df] for own in words], [weight(n_docs, df[i]) if i in df else 0 for i in range(len(vocabulary))])
        first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        found = materialize(searched(index.filter(first), asked, (n_docs, n_words), np.zeros(len(block), dtype=np.int64), k), "found")
        rest = materialize(searched(index.filter(~first), asked, (n_docs, n_words), kth(found, len(block), k), k), "found")
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, `{item_col}` {kind}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        best = found.union(rest).withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(named), "item").select(F.col(item_col), "rank", F.col("doc_id").alias(id_col), "score")
        best = materialize(best, "best")
        discard(index, found, rest)
        done = best if done is None else done.union(best)
    if done is None:
        return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    return done


def search_sql(k: int = 50) -> str:
    """The same ranking by brute force in DuckDB."""
    words = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""with t as (select doc_id, {words} term from documents where doc_id is not null), p as materialized (select doc_id, term, count(*) tf from t group by 1, 2), n as (select doc_id, sum(tf) n from p group by 1),
 g as materialized (select cast(count(*) as bigint) N_, cast(sum(n) as bigint) L_ from n), q as (select distinct item_id, term from (select item_id, {words} term from benchmark)),
 w as (select term, cast(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1))) as bigint) w from (select term, count(*) df from p group by 1), g),
 s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * N_) // L_)))) as bigint) score from q join w using (term) join p using (term) join n using (doc_id), g group by 1, 2),
 r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= {k}"""

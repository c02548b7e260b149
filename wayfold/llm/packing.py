"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest. The
pieces go from the longest to the shortest, each into the open window with the
least room that still takes it. A segment tree over the remaining capacity
finds that window: its leaves hold the windows with just that much room, its
nodes whether any lies below.

Pieces of equal length are interchangeable, so what the packing needs to know
of the corpus is how many pieces have each length: a histogram with a row per
length, however large the corpus is. The driver packs that histogram, runs of
equal pieces into runs of windows with equal room at a time, and each piece
finds its place by its number among the pieces of its length. So the packing is
that of the whole corpus, not of a task's share.

The plan is small whatever the corpus: a run of windows is made by a split or
by opening new ones, three times a length at most, and each time it takes
pieces throughout it keeps less than half its room. With windows of 2048 these
are some 70,000 runs at most, which is why they may be broadcast.

Cases: null and empty texts have the end token alone; repeated rows are packed
each; null ids too; a table without rows has no sequences; columns of the input
don't matter. Texts are encoded whole, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize
from .token_count import byte_alphabet

RUN = "length int, first long, last long, sequence long, per_sequence int, start int"


class Encoder:
    """Ids of a byte-level vocabulary, as the tokenizers library gives them.

    Its own regular expression and merges are run by tiktoken, several times as
    fast, from the ranks in the same file; special tokens in texts are known.
    """

    #: Fixed value: how byte-level vocabularies of this kind split texts.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special, self.all = tuple(special), set(special)
        self.encoding = tiktoken.Encoding("packing", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special=self.all)
        return self.encoding.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document: id, start, length, ids (little-endian unsigned 32-bit, binary) and doc_tokens. All pieces but a document's last fill a window.

    tokenizer_path must name a file that every executor has.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        for b in batches:
            at, start, data, total = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text), end], dtype="<u4")
                for s in range(0, len(ids), window):
                    at.append(i)
                    start.append(s)
                    data.append(ids[s : s + window].tobytes())
                    total.append(len(ids))
            length = [len(d) // 4 for d in data]
            own = b.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())], names=[id_col, "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")


class OpenWindows:
    """Open windows by remaining capacity, as runs of neighbouring numbers, under a segment tree."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def _mark(self, room: int) -> None:
        node = self.leaves + room
        self.any[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of `least` or more that an open window has."""
        node = self.leaves + least
        while not self.any[node]:
            while node & 1:  # a right child, or the root: nothing further right below the parent
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        return node - self.leaves

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def open(self, n: int) -> int:
        first, self.opened = self.opened, self.opened + n
        return first


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first and after the last number of its pieces, first sequence, pieces per sequence, start in them) of best-fit decreasing."""
    windows, out = OpenWindows(window), []
    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            room = windows.tightest(length)
            if room is None:  # as many new windows as the rest fills
                room, each = window, window // length
                first, many = windows.open(-(-(n - done) // each)), -(-(n - done) // each)
            else:
                first, many = windows.take(room)
                each = room // length
            # after its first piece a window is the tightest there is, so it fills up before the next is begun
            whole = min(many, (n - done) // each)
            if whole:
                out.append((length, done, done + whole * each, first, each, window - room))
                windows.put(room - each * length, first, whole)
                done += whole * each
            if whole < many and done < n:
                rest = n - done
                out.append((length, done, n, first + whole, rest, window - room))
                windows.put(room - rest * length, first + whole, 1)
                done, whole = n, whole + 1
            windows.put(room, first + whole, many - whole)
    return out


def pack(rows: DataFrame, *, window: int = 2048, length_col: str = "length") -> DataFrame:
    """rows, each of 1 to `window` tokens, with sequence_id (from 0 without gaps) and offset; columns of these names are replaced."""
    names = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    length = f"struct_.`{length_col}`"
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("struct_"))
    # numbers are written down: a task run again after a loss reads the same ones
    kept = materialize(kept.select("struct_", F.expr(length).cast("int").alias("length"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "pieces")
    by_task = kept.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = materialize(by_task, "lengths")  # a row per task and length of its pieces
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    spark = rows.sparkSession
    runs = spark.createDataFrame(plan(histogram, window), RUN)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "task").orderBy("at"))
    # merged on the exchange that the numbering needs anyway: `before` grows with the tasks and is never broadcast
    numbered = kept.withColumn("number", local).join(before.hint("merge"), ["length", "task"]).withColumn("number", F.col("number") - 1 + F.col("before"))
    r = F.broadcast(runs)
    found = numbered.join(r, (numbered["length"] == r["length"]) & (numbered["number"] >= r["first"]) & (numbered["number"] < r["last"]))
    sequence = F.col("sequence") + F.expr("(number - first) div per_sequence")
    offset = F.col("start") + F.expr("(number - first) % per_sequence") * r["length"]
    return found.select("struct_", sequence.alias("sequence_id"), offset.cast("long").alias("offset")).select(*[F.col(f"struct_.`{c}`") for c in names], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end: int = 1, **columns: str) -> DataFrame:
    """Pieces of whole documents with their ids, each with its sequence and offset."""
    return pack(pieces(docs, tokenizer_path, window=window, end=end, **columns), window=window)


def padding(packed: DataFrame, *, window: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the tokens of padding, where sequences as long as a power of two need none."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(window - F.col("n"))
    return own.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(pad), F.lit(0)).alias("padding"))

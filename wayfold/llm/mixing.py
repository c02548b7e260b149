"""Mixing sources to target weights with exact block quotas.

Each source's documents lie on a line of words in a permuted order (drawn by
hash, a fresh one per epoch), cut into blocks. Whole epochs give all their
blocks, the last one as many as the target leaves: these are a source's quotas.
A splitting tree halves the output shards again and again: at each node the
quotas are split between the two halves by a multivariate hypergeometric draw,
so every shard gets an exact number of blocks and of each source what a random
deal would give it. The quotas then choose the blocks: of whole epochs a shard
gets the next so many; the last epoch's line is dealt to the shards in
proportion to their quotas, and each draws its quota from the start of its own
part. Drawn blocks are disjoint, add up to the target's words exactly (one block
is cut), and inside a shard a hash order shuffles them. A shard's blocks of a
source are neighbours on the permuted line, so that few documents are cut.

The driver plans with one row per source; everything per document is DataFrame
work. Places on the lines come from three-level prefix sums over buckets of the
hash order, so that a source with a third of all rows is spread over tasks.

Cases: null and empty texts have size 0 and are never drawn; a null source is a
source of its own, ordered last; where all sizes are 0 all targets are 0;
repeated rows are drawn separately; very long texts are cut like others, by
blocks; equal draws are ordered by id, size and row; an empty table gives an
empty result; columns beside id, source and text don't matter, whatever their
names.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, numbered_columns, partitions

#: Rows of a source and epoch in a bucket of the prefix sums, about, and buckets in a group of them.
BUCKET_ROWS, GROUP_BUCKETS = 256, 4096
#: Words in a block.
BLOCK_WORDS = 64
#: Sources up to which the plan (some hundred bytes each) is broadcast.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above `most` times its source's size; the excess goes to the others by weight."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of `draws` from good + bad are good, by inversion outwards from the mode (some deviations' steps)."""
    least, most, total = max(0, draws - bad), min(good, draws), good + bad
    if least == most:
        return least
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    left = rng.random()
    up = down = math.exp(ways(good, mode) + ways(bad, draws - mode) - ways(total, draws))
    above = below = mode
    left -= up
    while left > 0 and (above < most or below > least) and (up > 0 or down > 0):
        if above < most:
            up *= (good - above) / (above + 1) * ((draws - above) / (bad - draws + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > least:
            down *= below / (good - below + 1) * ((bad - draws + below) / (draws - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Per shard the blocks of each source; sums over shards are the quotas, and shards' totals differ by one at most."""
    rng = random.Random(seed)

    def split(counts: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [counts]
        total, half = sum(counts), n // 2
        draws = left = total // n * half + min(total % n, half)
        first, rest = [], total
        for q in counts:
            x = hypergeometric(q, rest - q, left, rng)
            first.append(x)
            rest, left = rest - q, left - x
        assert sum(first) == draws
        return split(first, half) + split([q - x for q, x in zip(counts, first, strict=True)], n - half)

    return split(quotas, shards)


@dataclass
class Plan:
    """One row per source: its words, and the parts of its line that each shard draws."""

    rows: list[dict]

    def frame(self, spark: SparkSession) -> DataFrame:
        kind = "array<struct<nth:int,source:string,source_size:bigint,target:double,epochs:int,buckets:int,last:bigint,before:bigint,parts:array<struct<shard:int,lo:bigint,hi:bigint>>>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(self.rows)), kind)))


def quotas(words: int, size: int) -> tuple[int, int, int, int]:
    """Of a line that gives `words` to the mix: epochs, where the last begins, and the blocks drawn before and in it."""
    epochs = -(-words // size) if size else 0
    last = max(0, epochs - 1) * size
    return epochs, last, -(-last // BLOCK_WORDS), -(-(words - last) // BLOCK_WORDS)


def drawn_parts(words: int, size: int, whole: list[int], sampled: list[int]) -> list[dict]:
    """What each shard draws of a source's line, from its quotas of blocks of whole epochs and of the last one."""
    _, last, _, q = quotas(words, size)
    out, at = [], 0
    for shard, n in enumerate(whole):
        out.append({"shard": shard, "lo": at, "hi": min(last, at + n * BLOCK_WORDS)})
        at = min(last, at + n * BLOCK_WORDS)
    blocks = max(q, size // BLOCK_WORDS)  # the short block at the end is drawn only if all are
    at, ends = 0, []
    for shard, n in enumerate(sampled):
        lo = last + at * blocks // q * BLOCK_WORDS if q else last
        ends.append({"shard": shard, "lo": lo, "hi": lo + n * BLOCK_WORDS})
        at += n
    ends = [x for x in ends if x["hi"] > x["lo"]]
    if ends:
        ends[-1]["hi"] -= q * BLOCK_WORDS - (words - last)  # the block that is cut
    return [x for x in out if x["hi"] > x["lo"]] + ends


def plan_mix(sized: DataFrame, shards: int, seed: int) -> Plan:
    found = [(r["source"], r["n"], r["size"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([r[2] for r in found], [1 + i % 3 for i in range(len(found))])
    words = [min(int(t), 3 * r[2]) for t, r in zip(goal, found, strict=True)]
    counts = [n for w, r in zip(words, found, strict=True) for n in quotas(w, r[2])[2:]]
    share = splitting_tree(counts, shards, seed) if found else []
    rows = []
    for i, (source, n, size) in enumerate(found):
        epochs, last, before, _ = quotas(words[i], size)
        parts = drawn_parts(words[i], size, [s[2 * i] for s in share], [s[2 * i + 1] for s in share])
        rows.append({"nth": i, "source": source, "source_size": size, "target": goal[i], "epochs": epochs, "buckets": -(-n // BUCKET_ROWS), "last": last, "before": before, "parts": parts})
    return Plan(rows)


def mix(docs: DataFrame, *, shards: int = 16, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The mix: a row per piece of a document in a block, and one with n_words 0 for each epoch of a document from which nothing is drawn.

    Columns: row (a key of the input row, from row_col if given), id, source, size, source_size,
    target, epoch, shard, block, word_start and n_words (the piece's place in
    its document), mix_order (sorting by it shuffles a shard).
    """
    text = F.col(text_col).cast("string")
    sized = materialize(
        docs.select(
            (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw"),
        ),
        "mix-sizes",
    )
    spark = docs.sparkSession
    plan = plan_mix(sized, shards, seed)
    by_source = plan.frame(spark)
    if len(plan.rows) <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    counts = by_source.select("nth", F.col("source").alias("planned"), "epochs", "buckets")
    planned = sized.join(counts, F.col("source").eqNullSafe(F.col("planned"))).drop("planned")
    laid = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest("epochs", F.lit(1)) - 1)))
    laid = laid.withColumn("at", F.shiftrightunsigned(F.xxhash64("draw", "epoch"), 1))
    laid = laid.withColumn("bucket", F.least(F.floor(F.col("at") / F.lit(2.0**63) * F.col("buckets")).cast("int"), F.col("buckets") - 1))
    laid = laid.withColumn("group", (F.col("bucket") / GROUP_BUCKETS).cast("int"))
    laid = laid.drop("draw", "epochs", "buckets")
    groups, cell = ["nth", "epoch", "group"], ["nth", "epoch", "group", "bucket"]

    def starts(sizes: DataFrame, own: list[str], name: str) -> DataFrame:
        """Where each bucket (or group) begins, from the start of its group (or line)."""
        return sizes.withColumn(name, F.sum("sum").over(Window.partitionBy(own[:-1]).orderBy(own[-1])) - F.col("sum")).drop("sum")

    cells = laid.groupBy(cell).agg(F.sum("size").alias("sum"))
    before = starts(cells, cell, "cell_start").join(starts(cells.groupBy(groups).agg(F.sum("sum").alias("sum")), groups, "group_start"), groups)
    within = Window.partitionBy(cell).orderBy("at", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("upto", F.sum("size").over(within)).join(before, cell).join(by_source.drop("source", "epochs", "buckets"), "nth")
    stop = F.col("epoch") * F.col("source_size") + F.col("group_start") + F.col("cell_start") + F.col("upto")
    placed = placed.withColumns({"start": stop - F.col("size"), "stop": stop})
    width = BLOCK_WORDS

    def met(part: Column) -> Column:
        return F.struct(part["shard"].alias("shard"), F.greatest(part["lo"], "start").alias("lo"), F.least(part["hi"], "stop").alias("hi"))

    runs = F.filter(F.transform("parts", met), lambda x: x["hi"] > x["lo"])
    drawn = placed.withColumn("run", F.explode_outer(runs))
    # blocks of whole epochs are counted from the start of the line, those of the last from its own start
    drawn = drawn.withColumn("origin", F.when(F.col("run.lo") >= F.col("last"), F.col("last")).otherwise(0))
    blocks = F.sequence(F.expr(f"(run.lo - origin) div {width}"), F.expr(f"(run.hi - 1 - origin) div {width}"))
    drawn = drawn.withColumn("nth_block", F.explode_outer(F.when(F.col("run").isNotNull(), blocks)))
    from_ = F.greatest(F.col("run.lo"), F.col("origin") + F.col("nth_block") * width)
    upto = F.least(F.col("run.hi"), F.col("origin") + (F.col("nth_block") + 1) * width)
    return drawn.select(
        "row", F.col("id").alias(id_col), "source", "size", "source_size", "target", "epoch",
        F.col("run.shard").alias("shard"),
        (F.col("nth_block") + F.when(F.col("run.lo") >= F.col("last"), F.col("before")).otherwise(0)).alias("block"),
        (from_ - F.col("start")).alias("word_start"),
        F.coalesce(upto - from_, F.lit(0)).cast("long").alias("n_words"),
        F.xxhash64(F.lit(seed), "nth", "epoch", "at").alias("mix_order"),
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs as the mix takes them, all columns, in the order of the mix: by shard, and shuffled inside.

    A row per epoch and shard that takes words of a document: a whole copy, or
    where a block ends the part that was drawn. length_col, if there, is set anew.
    """
    spark = docs.sparkSession
    flat, names = numbered_columns(docs)
    id_, source, text, length = names[id_col], names[source_col], names[text_col], names.get(length_col)
    numbered = materialize(flat.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    mixed = mix(numbered, id_col=id_, source_col=source, text_col=text, row_col="_row", **options)
    runs = mixed.filter("n_words > 0").groupBy(F.col("row").alias("_row"), "epoch", F.col("shard").alias("_shard")).agg(
        F.first("size").alias("_size"), F.min("word_start").alias("_start"), F.sum("n_words").alias("_words"), F.min("mix_order").alias("_order")
    )
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("_start") + 1).cast("int"), F.col("_words").cast("int")), "")
    cut = F.col("_words") < F.col("_size")
    rows = numbered.join(runs, "_row").withColumn(text, F.when(cut, part).otherwise(F.col(text)))
    if length:
        rows = rows.withColumn(length, F.when(cut, F.char_length(text).cast(flat.schema[length].dataType)).otherwise(F.col(length)))
    rows = rows.repartition(partitions(spark), "_shard", F.pmod("_order", F.lit(max(1, partitions(spark) // options.get("shards", 16)))))
    return rows.sortWithinPartitions("_shard", "_order").select(*names.values()).toDF(*names)


def taken_by_document(mixed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per input row: id, size, source_size, target, the words that the mix takes of it, and what each shard draws of it: shards, shard_words and mix_orders side by side."""
    own = ["row", id_col, "source", "size", "source_size", "target"]
    by_shard = mixed.groupBy(*own, "epoch", "shard").agg(F.sum("n_words").alias("words"), F.min("mix_order").alias("mix_order"))
    run = F.when(F.col("shard").isNotNull(), F.struct("shard", "epoch", "words", "mix_order"))
    rows = by_shard.groupBy(own).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(run)).alias("runs"))
    return rows.select(id_col, "size", "source_size", "target", "taken", "source", F.col("runs.shard").alias("shards"), F.col("runs.words").alias("shard_words"), F.col("runs.mix_order").alias("mix_orders"))

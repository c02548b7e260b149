"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words, and single characters in scripts without blanks
between words. Every k-gram of units gets a 64-bit hash, rolled from the one
before it (a cyclic polynomial: turned by a bit, the unit that leaves taken out,
the one that enters put in); each block of grams begins anew. Of each window of
w neighbouring k-grams the smallest hash is kept, the rightmost one among
equals, with its position. Two texts that share a run of w + k - 1 units share a
fingerprint therefore. The fingerprint is written as a list of hash:position, in
hexadecimal digits.

Cases: null and empty texts, and texts without a unit, have the empty
fingerprint; with fewer than k units the whole sequence is one gram, with fewer
than w grams all are one window. Two empty fingerprints are alike (1), an empty
one and another are not (0). Repeated rows give repeated results; an empty
table gives an empty result; columns beside id and text don't matter. Texts are
read whole, however long; a text's hashes are held in one row. Ids are numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM, WINDOW = 5, 4
#: Grams in a block, within which hashes are rolled.
ROLLED = 32
SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
UNIT = rf"[{SINGLE}]|[^\x20\x09-\x0D{SINGLE}]+"
#: Documents in a bucket of neighbours, about, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 32, 1 << 17


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def neighbours(x: Column, gap: int, merge: Callable[[Column, Column], Column], y: Column | None = None) -> Column:
    """merge(x[i], y[i + gap]) for every i that has both (y: x, if not given)."""
    y = x if y is None else y
    n = F.greatest(F.least(F.size(x), F.size(y) - gap), F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(gap + 1), n), merge)


def spans(x: Column, length: int, merge: Callable[[Column, Column], Column], use: Callable[[Column], Column], overlap: bool = False) -> Column:
    """use(what merge makes of each `length` neighbours of x), by doubling; with `overlap` parts may share neighbours."""

    def grow(made: Column, have: int) -> Column:
        if have == length:
            return use(made)
        if 2 * have <= length:
            return let(neighbours(made, have, merge), lambda m: grow(m, 2 * have))
        if overlap:
            return let(neighbours(made, length - have, merge), use)
        return let(neighbours(made, have, merge, x), lambda m: grow(m, have + 1))

    return grow(x, 1)


def turned(x: Column, bits: int) -> Column:
    """The 64 bits of x turned left."""
    bits %= 64
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def rolled(units: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of unit hashes, each rolled from the one before it in its block."""

    def first(at: Column) -> Column:
        parts = [turned(F.get(units, at + j), k - 1 - j) for j in range(k)]
        return reduce(lambda x, y: x.bitwiseXOR(y), parts)

    def roll(made: Column, i: Column) -> Column:
        gone, come = turned(F.get(units, i - 1), k), F.get(units, i + (k - 1))
        return F.concat(made, F.array(turned(F.element_at(made, -1), 1).bitwiseXOR(gone).bitwiseXOR(come)))

    n = F.size(units) - (k - 1)
    starts = F.sequence(F.lit(0), n - 1, F.lit(ROLLED))
    rest = lambda at: F.slice(F.sequence(at, F.least(at + ROLLED, n) - 1), 2, ROLLED)
    return F.flatten(F.transform(starts, lambda at: F.aggregate(rest(at), F.array(first(at)), roll)))


def winnowed(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The kept k-grams of a text in order: array of (hash, at)."""
    none = F.array().cast("array<struct<hash:bigint,at:int>>")

    def kept(hashes: Column, places: Column) -> Column:
        return F.transform(places, lambda i: F.struct(F.get(hashes, i).alias("hash"), i.alias("at")))

    def windows(hashes: Column) -> Column:
        def least(a: Column, b: Column) -> Column:  # a comes before b: of equals b
            return F.when(F.get(hashes, b) <= F.get(hashes, a), b).otherwise(a)

        places = F.sequence(F.lit(0), F.size(hashes) - 1)
        best = F.aggregate(places, F.lit(0), least)
        whole = let(places, lambda p: spans(p, w, least, lambda found: kept(hashes, F.array_distinct(found)), overlap=True))
        return F.when(F.size(hashes) < w, kept(hashes, F.array(best))).otherwise(whole)

    def grams(units: Column) -> Column:
        hashed = let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: let(rolled(h, k), windows))
        short = let(F.array(F.xxhash64(F.array_join(units, " "))), windows)
        return F.when(F.size(units) == 0, none).when(F.size(units) < k, short).otherwise(hashed)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), grams)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: v["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes over all hashes of both."""
    return let(F.size(a) + F.size(b), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n))


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda v: F.concat_ws(":", F.hex(v["hash"]), F.hex(v["at"]))), " ")


def with_next(docs: DataFrame, id_col: str, text_col: str, own: Column) -> DataFrame:
    """(id, text, own, next_text, next_own) by ascending id, the first after the last. own: what is computed of each `text`, once for the row and the one before it.

    Documents are dealt to many small buckets between quantiles of the id; the
    first of each bucket is copied behind the bucket before it, so that no
    window needs more than a bucket. Rows of equal id follow by text hash.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    n = ids.count()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds = []
    if count > 1:
        quantiles = F.percentile_approx("id", [i / count for i in range(1, count)], F.lit(10 * count))
        bounds = sorted(set(ids.agg(quantiles).first()[0] or []))
    bucket = F.coalesce(_located(F.col("id"), bounds), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumns({"bucket": bucket, "tie": F.xxhash64("text")})
    firsts = [(r["bucket"], r["f"]["id"], r["f"]["tie"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("f")).orderBy("bucket").collect()]  # one per bucket
    before = [(firsts[i - 1][0], i_, t) for i, (_, i_, t) in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    copies = docs.sparkSession.createDataFrame(before, f"before int, first_id {kind}, first_tie long")
    marked = rows.join(F.broadcast(copies), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")), "left")
    both = F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy")))
    dealt = marked.select("id", "text", "tie", F.inline(F.when(F.col("first_tie").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    dealt = dealt.repartition("bucket").withColumn("own", own)  # computed behind the shuffle that the window needs
    order = Window.partitionBy("bucket").orderBy("copy", "id", "tie")
    after = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "own")})
    return after.filter(~F.col("copy")).select("id", "text", "own", "next_text", "next_own")


def _located(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are <= value, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(array, F.least(at + s, F.lit(len(bounds)))) <= value), at + s).otherwise(at)
    )


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is replaced by the start of the next document."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, id_col, text_col, winnowed(F.col("text"), k, w)).select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("next"))
    kept = rows.withColumn("other", winnowed(F.col("edited"), k, w))
    near = let(hashes(F.col("own")), lambda own: F.struct(likeness(own, hashes(F.col("other"))).alias("edited"), likeness(own, hashes(F.col("next"))).alias("next")))
    out = kept.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), near.alias("near"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))

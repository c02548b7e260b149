"""Ranked search, clustering and packing against brute force, and their defined results in odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wayfold.llm import centroids, packing, queries, treaps

from .test_operators import ODD, documents, prose

ITEMS = "item_id bigint, text string, doc_id bigint, score string, rank int, item int"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 1, 2) for i, t in rows], ITEMS)


# --- 11 ranked search


def ranked(docs, asked, k=50):
    """Every score by the formula, from the texts."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    known = [(i, Counter(own)) for i, t in docs if i is not None and (own := words(t))]
    n, total = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in asked:
        found = []
        for i, c in known:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [1, 300, 1 << 20])
def test_search_equals_brute_force(spark, postings):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(300)] + ["copy of BAB's tëxt, co-py 7"] * 120 + ODD
    ids = [i * 7 % 431 if i % 11 else None for i in range(len(texts))]  # some repeat, some are null
    asked = [(i, prose(rng, rng.randint(1, 30))) for i in range(20)] + [(3, "Copy of; bab"), (3, "copy 7"), (None, "tËxt tëxt"), (40, None), (41, ""), (42, "nowhere!"), (43, "x" * 5000), (44, "word " * 90)]
    docs = documents(spark, texts, ids=ids).repartition(5)
    for k in (50, 3):
        got = treaps.search(docs, items(spark, asked), k=k, postings=postings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(zip(ids, texts, strict=True), asked, k)


def test_search_of_empty_tables(spark):
    one = items(spark, [(1, "a b")])
    assert treaps.search(documents(spark, []), one).count() == 0
    assert treaps.search(documents(spark, [None, "", "!"]), one).count() == 0
    assert treaps.search(documents(spark, ["a b", "c"]), items(spark, [])).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(treaps, "BLOCK", 3)
    texts, asked = ["a b c", "b c d", "a a d", "e"], [(i, t) for i, t in enumerate(["a", "b", "c d", "e", "a e", "z", "d"])]
    got = treaps.search(documents(spark, texts), items(spark, asked))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(enumerate(texts), asked)


def test_treaps_are_search_trees_and_heaps():
    rng = random.Random(5)
    n = 400
    lists = [sorted(rng.sample(range(n), m)) for m in (1, 3, 100, 400)]
    row = {
        "terms": [0, 1, 2, 5], "doc_ids": np.arange(n, dtype=np.int64).tobytes(), "sizes": np.full(n, 20, dtype=np.int64).tobytes(), "ends": np.cumsum([len(x) for x in lists]).astype(np.int64).tobytes(),
        "at": np.concatenate(lists).astype(np.int32).tobytes(), "tf": np.array([rng.randint(1, 3) for x in lists for _ in x], dtype=np.int32).tobytes(),
    }
    t = treaps.Treaps(row, (n, 20 * n), 6)
    assert t.root[3] == t.root[4] == t.root[6] == -1

    def walk(node, low, high):
        if node < 0:
            return [], 0
        assert low < t.doc[node] < high
        (a, da), (b, db) = walk(t.left[node], low, t.doc[node]), walk(t.right[node], t.doc[node], high)
        assert all(t.impact[c] <= t.impact[node] for c in (t.left[node], t.right[node]) if c >= 0)
        return [*a, int(t.doc[node]), *b], 1 + max(da, db)

    for term, own in zip(row["terms"], lists, strict=True):
        found, depth = walk(t.root[term], -1, n)
        assert found == own and depth <= 40  # three different impacts only: equal ones make no chain


def test_search_prunes(monkeypatch):
    """A few documents with all rare terms among many with common ones: most documents are never scored, whatever the size of a step."""
    rng = random.Random(6)
    n = 3000
    found = [{0: 1, 1: rng.randint(1, 2), **({2: 3, 3: 2} if i % 100 == 0 else {})} for i in range(n)]
    term = [(t, i, tf) for i, own in enumerate(found) for t, tf in own.items()]
    term.sort()
    row = {"terms": [0, 1, 2, 3], "doc_ids": np.arange(n, dtype=np.int64).tobytes(), "sizes": np.full(n, 30, dtype=np.int64).tobytes(), "ends": np.cumsum([sum(t == x for t, _, _ in term) for x in range(4)]).astype(np.int64).tobytes(), "at": np.array([i for _, i, _ in term], dtype=np.int32).tobytes(), "tf": np.array([tf for *_, tf in term], dtype=np.int32).tobytes()}
    t = treaps.Treaps(row, (n, 30 * n), 4)
    asked = treaps.Asked([[0, 1, 2, 3]], [treaps.weight(n, n), treaps.weight(n, n), 4000, 4000])
    results = []
    for cells in (8, 1 << 19):
        monkeypatch.setattr(treaps, "CELLS", cells)
        best = treaps.Ranking(np.zeros(1, dtype=np.int64), 20)
        (own, terms, weights), *_ = asked.groups
        assert treaps.search_shard(t, terms, weights, own, best) < n / 4
        results.append(list(zip(best.score.tolist(), best.doc.tolist(), strict=True)))
    assert results[0] == results[1] and len(results[0]) == 20 and all(d % 100 == 0 for _, d in results[0])


# --- 12 centroid clustering

VECTORS = "vec_id bigint, embedding array<float>, id string, x int, cluster string, distance double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b", 2.0) for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, scale, width):
    """Plain rounds of assignment and means in Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else m for o, m in zip(own, c, strict=True)]
    got = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, j, d in got:
        inertia[j] += d
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got], key=str)


@pytest.mark.parametrize(("k", "scale", "spread"), [(5, 256, 1.0), (40, 256, 0.01), (7, 2, 1.0), (6, 4096, 20_000.0)])
def test_clusters_equal_plain_rounds(spark, k, scale, spread):
    """Ties (few different vectors), empty clusters (equal first centroids) and values beyond what doubles add exactly."""
    rng = random.Random(k)
    rows = [(i if i % 9 else 3, [rng.gauss(0, spread) for _ in range(8)]) for i in range(120)] + [(500 + i, [0.5] * 8) for i in range(40)] + [(500, [0.5] * 8)] * 3
    rows += [(None, [0.1] * 8), (700, None), (701, []), (702, [1.0] * 7), (703, [1.0] * 9), (704, [1.0] * 7 + [None]), (705, [math.nan] * 8), (706, [math.inf] + [1.0] * 7)]
    got = centroids.with_inertia(*centroids.cluster_vectors(vectors(spark, rows).repartition(3), k=k, scale=scale, width=8))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"]
    assert sorted(map(lambda r: tuple(r)[:-1], got.collect()), key=str) == lloyd(rows, k, 5, scale, 8)


def test_bounds_spare_scans(spark):
    """Vectors of groups far apart keep their clusters without being compared with all centroids again."""
    rng = random.Random(4)
    rows = [(i, [10.0 * (i % 6) + rng.random() / 10 for _ in range(8)]) for i in range(600)]
    out, found = centroids.cluster_vectors(vectors(spark, rows), k=6, rounds=6, width=8)
    assert out.agg(F.avg("scans")).first()[0] < 3.5 and len(found) == 6  # of seven
    assert out.filter("scans < 1").count() == 0


def test_clusters_of_few_vectors(spark):
    empty = centroids.with_inertia(*centroids.cluster_vectors(vectors(spark, [(1, None)])))
    assert empty.count() == 0
    one = centroids.with_inertia(*centroids.cluster_vectors(vectors(spark, [(1, [0.25] * 64)] * 2))).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in one] == [(0, 0, 0)] * 2
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e20] * 64)]))


# --- 13 packing


def best_fit(sizes, window):
    """The room that is left in each window, a piece at a time."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else window) - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(120))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 16, 20, 64, 100])
    sizes = [rng.randint(1, max(1, window // (1, 3, 8)[seed % 3])) for _ in range(rng.randint(0, 200))]
    filled, used = {}, Counter()
    for length, first, last, sequence, each, start in packing.plan(Counter(sizes), window):
        for j in range(last - first):
            filled.setdefault(sequence + j // each, []).append((start + j % each * length, length))
            used[length] += 1
    assert used == Counter(sizes) and sorted(filled) == list(range(len(filled)))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert sorted(window - sum(n for _, n in own) for own in filled.values()) == best_fit(sizes, window)


def test_plan_grows_with_the_window_only():
    rng = random.Random(1)
    few = packing.plan({n: rng.randint(1, 50) for n in range(1, 2049)}, 2048)
    many = packing.plan({n: rng.randint(1, 10**9) for n in range(1, 2049)}, 2048)
    assert len(few) < 70_000 and len(many) < 70_000


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(200)] + ["the same text"] * 50 + ODD + ["a <|endoftext|> b<|endoftext|>", "\x1c　 \xa0x 'S ſ’s İ ٣٤ ²", " " * 3000]
    ids = [i if i % 10 else None for i in range(len(texts))]
    docs = documents(spark, [None if t is None else t for t in texts], ids=ids).withColumn("offset", F.lit(1)).withColumn("sequence_id", F.lit("s")).withColumn("length", F.lit(0.5))
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in zip(ids, texts, strict=True))
    window = 64
    rows = packing.pack_documents(docs.repartition(3), P.path("byte_bpe_50k.json"), window=window).collect()
    assert all(r["length"] == len(r["ids"]) // 4 and 1 <= r["length"] <= window for r in rows)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][0] + own[-1][1] <= window and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sorted(window - sum(n for _, n in own) for own in by_sequence.values()) == best_fit([r["length"] for r in rows], window)
    whole = Counter()
    for (i, total, start), parts in by_doc.items():
        if start == 0 and i is not None:  # ids are those of one document
            data = b"".join(by_doc[(i, total, s)][0] for s in range(0, total, window))
            whole[(i, data)] += 1
    assert whole == Counter({k: n for k, n in want.items() if k[0] is not None})
    assert Counter(p for parts in by_doc.values() for p in parts) == Counter(k[1][s : s + 4 * window] for k, n in want.items() for _ in range(n) for s in range(0, len(k[1]), 4 * window))


def test_packing_query(spark):
    """Checksums of the registered query are those of the pieces, and little is padding."""
    rows = queries.op13_packing(spark, "/root/testdata/sf0.001")
    full = packing.pieces(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows.collect()) == sorted((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in full)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    sum_ = packing.padding(rows).first()
    assert sum_["tokens"] == sum(r["length"] for r in full) and sum_["padding"] <= 0.02 * sum_["tokens"]


def test_packing_of_no_rows(spark):
    assert packing.pack_documents(documents(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    assert packing.padding(packing.pack_documents(documents(spark, []), P.path("byte_bpe_50k.json"))).first().asDict() == {"sequences": 0, "tokens": 0, "padding": 0}

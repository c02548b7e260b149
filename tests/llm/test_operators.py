"""Corpus operators against brute force, and their defined results in odd cases."""

import functools
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import bpe, html_text, jaccard, mixing, sharding, token_count, topk, toxicity, url_rules, winnowing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, shard int, node string"


def documents(spark, texts, ids=None, sources=None):
    """Documents with odd extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, "z") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


WORDS = [f"{a}{b}" for a in "bcdfgh" for b in ("ab", "orn", "i", "ust", "é")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c d", "same text here and there again", "same text here and there again", "ÀÉ漢字 😀", "x" * 5000, "word " * 3000]


# --- 1 sharding


def test_shards_cover_all_rows_evenly(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(600)] + ["copy of a text " * 5] * 300 + ODD
    rows = sharding.shard_by_bytes(documents(spark, texts), 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= 2 * largest
    small = {r["shard"] for r in rows if texts[r["doc_id"]] == ODD[5]}
    assert len(small) == 1


def test_shards_of_odd_tables(spark):
    assert sharding.shard_by_bytes(documents(spark, [])).count() == 0
    same = sharding.shard_by_bytes(documents(spark, ["a"] * 20, ids=[None] * 20)).collect()
    assert len(same) == 20
    again = sharding.shard_by_bytes(documents(spark, ODD)).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.shard_by_bytes(documents(spark, ODD).repartition(3)).collect()))


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RECORDS_PER_RANGE", 8)
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(300)] + ["the same"] * 40 + [None] * 60 + ["x" * 900] * 5
    ids = [None if i % 7 == 0 else i for i in range(len(texts))]
    docs = documents(spark, texts, ids=ids)
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).distinct().collect()}
    rows = sorted((key[t], -(1 << 63) if i is None else i, len((t or "").encode()) + 1) for i, t in zip(ids, texts, strict=True))
    total, most = sum(r[2] for r in rows), max(r[2] for r in rows)
    limit, want, at = max(int(total / 8 / 32), 2 * most), [], 0
    for k in sorted(set(key.values())):
        own = [r for r in rows if r[0] == k]
        size, upto = sum(r[2] for r in own), at
        for _, i, n in own:
            middle = at + size / 2 if size <= limit else upto + n / 2
            want.append((None if i < 0 else i, n, min(int(middle * 8 // total), 7), size > limit))
            upto += n
        at += size
    got = sharding.shard_by_bytes(docs, 8).collect()
    assert sorted(map(str, ((r["doc_id"], r["size"], r["shard"], r["group_cut"]) for r in got))) == sorted(map(str, want))


def test_rows_without_size_or_id_are_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 < 3, F.xxhash64("id")).otherwise(0).alias("_key"), F.lit(sharding.LEAST).alias("_id"), F.col("id").alias("_nth"), F.when(F.col("id") % 10 < 3, 100).otherwise(1).cast("long").alias("_size"))
    total = rows.agg(F.sum("_size")).first()[0]
    counts = [r["count"] for r in sharding.with_range(rows, sharding.split_ranges(rows, 30_000, total)).groupBy("_range").count().collect()]
    assert len(counts) > 60 and max(counts) <= 4 * 30_000 / len(counts)


# --- 2 winnowing


def units(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(120)] + ODD[:7]
    rows = {r["doc_id"]: r for r in winnowing.fingerprint_edits(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(t or "" for t in texts):
        nxt, half = texts[(i + 1) % len(texts)] or "", len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        assert (rows[i]["fingerprint"] == "") == (not units(t))
    assert rows[125]["fingerprint"] == rows[126]["fingerprint"] and rows[125]["near_next"] == 1
    assert winnowing.fingerprint_edits(documents(spark, [])).count() == 0


def winnowed_by_hand(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    """Kept (hash, position) pairs by the definition: every gram hashed anew, every window looked through."""
    found = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\x20\x09-\x0D\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+", text or "")
    bits = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda u: xxhash.xxh64(u.encode(), seed=42).intdigest()
    if not found:
        return []
    grams = [one(" ".join(found))]
    if len(found) >= k:
        turn = lambda x, r: (x << r | x >> (64 - r)) & bits if r else x
        grams = [functools.reduce(lambda a, b: a ^ b, (turn(one(u), k - 1 - j) for j, u in enumerate(found[i : i + k]))) for i in range(len(found) - k + 1)]
    grams = [(signed(g), i) for i, g in enumerate(grams)]
    kept = {min(grams[i : i + w], key=lambda g: (g[0], -g[1])) for i in range(max(1, len(grams) - w + 1))}
    return sorted(kept, key=lambda g: g[1])


def test_fingerprints_by_hand(spark):
    rng = random.Random(12)
    texts = [prose(rng, n) for n in (*range(1, 14), 36, 37, 68, 69, 70, 300)] + ["汉字和片仮名カナ混合的文字 with words ไทยไทยไทย", "a " * 200, "汉" * 90, None, "", " \n", "x\u00a0y z"]
    rows = {r["doc_id"]: r for r in winnowing.fingerprint_edits(documents(spark, texts)).collect()}
    both = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    for i, t in enumerate(t or "" for t in texts):
        nxt, half = texts[(i + 1) % len(texts)] or "", len(t) // 2
        own, other, after = (winnowed_by_hand(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        written = lambda kept: " ".join(f"{h & (1 << 64) - 1:X}:{at:X}" for h, at in kept)
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (written(own), written(other))
        sets = [{h for h, _ in kept} for kept in (own, other, after)]
        assert rows[i]["near_edited"] == pytest.approx(both(sets[0], sets[1])) and rows[i]["near_next"] == pytest.approx(both(sets[0], sets[2]))


def test_winnowing_guarantee(spark):
    rng = random.Random(3)
    k, w = winnowing.GRAM, winnowing.WINDOW
    shared = prose(rng, k + w - 1)
    texts = [prose(rng, 30) + " " + shared + " " + prose(rng, 9), prose(rng, 4) + " " + shared + " " + prose(rng, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    a, b = ({v["hash"] for v in r["kept"]} for r in df.select(winnowing.winnowed(F.col("t")).alias("kept")).collect())
    assert a & b


# --- 3 token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(4)
    parts = ["a", "É", "Σ", "ς", "İ", "ß", " ", "́", "\n", "\x1c", "\x85", "\xa0", "1", "²", "'s", "!!", "😀", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ", "\x00", "가"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = {r["doc_id"]: r for r in token_count.count_tokens(documents(spark, texts), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(t or "" for t in texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len(t.encode()), n > 2048)
    assert token_count.count_tokens(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


# --- 4 mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    out = mixing.targets([100, 1, 1], [1, 2, 3])
    assert out == pytest.approx([96, 3, 3]) and mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_splitting_tree_is_exact():
    for seed in range(5):
        tree = mixing.splitting_tree([5, 0, 1000, 37], 8, seed)
        assert [sum(x) for x in zip(*tree, strict=True)] == [5, 0, 1000, 37]
        totals = [sum(x) for x in tree]
        assert max(totals) - min(totals) <= 1


def test_hypergeometric_draws():
    from math import comb

    rng = random.Random(6)
    for good, bad, draws in ((7, 9, 6), (3, 40, 20), (30, 2, 25), (5, 5, 10)):
        seen = [mixing.hypergeometric(good, bad, draws, rng) for _ in range(20_000)]
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(seen.count(k) / len(seen) - p) < 5 * (p * (1 - p) / len(seen)) ** 0.5 + 1e-9
    large = [mixing.hypergeometric(10**9, 2 * 10**9, 10**6, rng) for _ in range(200)]
    assert abs(sum(large) / len(large) - 10**6 / 3) < 300 and len(set(large)) > 100


def test_parts_of_a_line_add_up_and_are_disjoint():
    rng = random.Random(7)
    for _ in range(300):
        size = rng.randint(1, 5000)
        words = rng.randint(0, 3 * size)
        epochs, last, before, drawn = mixing.quotas(words, size)
        tree = mixing.splitting_tree([before, drawn], 8, rng.randint(0, 9999))
        parts = sorted((p["lo"], p["hi"]) for p in mixing.drawn_parts(words, size, [t[0] for t in tree], [t[1] for t in tree]))
        assert sum(hi - lo for lo, hi in parts) == words and all(a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert not parts or parts[0][0] >= 0 and parts[-1][1] <= epochs * size


def test_the_tree_chooses_the_blocks(spark, monkeypatch):
    rng = random.Random(8)
    docs = documents(spark, [prose(rng, 200) for _ in range(60)], sources=["a", "b", "c"] * 20)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_by_document(mixing.mix(docs, shards=4)).collect()}
    grow = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, n, seed: [[sum(x) for x in zip(*grow(counts, n, seed), strict=True)]] + [[0] * len(counts)] * (n - 1))
    other = mixing.taken_by_document(mixing.mix(docs, shards=4)).collect()
    assert {r["doc_id"]: r["taken"] for r in other} != taken and sum(taken.values()) == sum(r["taken"] for r in other)
    assert all(set(r["shards"]) <= {0} and sum(r["shard_words"]) == r["taken"] for r in other)


def test_mix(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(500)] + ODD
    sources = [rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.taken_by_document(mixing.mix(docs)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {}
    for i, s in enumerate(sources):
        size[s] = size.get(s, 0) + len(units(texts[i]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = {}
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == len(units(texts[i])) and r["source_size"] == size[sources[i]] and r["target"] == pytest.approx(goal[sources[i]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[sources[i]] = taken.get(sources[i], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)
    pieces = mixing.mix(docs).filter("n_words > 0").collect()
    assert len({(p["source"], p["block"], p["row"], p["epoch"]) for p in pieces}) == len(pieces)
    per_block = {}
    for p in pieces:
        per_block.setdefault((p["source"], p["block"]), set()).add(p["shard"])
    assert all(len(s) == 1 for s in per_block.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.taken_by_document(mixing.mix(docs.repartition(5))).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.taken_by_document(mixing.mix(documents(spark, []))).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(units(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)


# --- 5 top-k


def brute_topk(rows, k):
    live = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in live if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in live if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(None, [1.0] * 8), (2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2100, []), (2101, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int, v string" .split(", id")[0])
    for block in (1024, 3):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = topk.search(df, F.col("id") % 100 == 0).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_topk(rows, 10) and len(got) == len(brute_topk(rows, 10))
    few = topk.search(df.filter("vec_id < 5 or vec_id = 100"), F.col("id") % 100 == 0).collect()
    assert len([r for r in few if r["query_id"] == 0]) == 5
    assert topk.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e17, 0.0])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(large, F.col("id") == 0).orderBy("rank").collect()] == [1, 2]


# --- 6 html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line &lt;p&gt;</h1><script>var t="</p>";</script><p>First  <b>bo</b>ld<br>line.<p>Second &eacute;&nbsp;line.<aside>Side</aside>
<form><input>Form</form><div class=ad>Buy</div><section id="comments"><p>Reader says</p></section></article><footer>&copy; me</footer></body>"""


def test_extract_marked_article(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x/1", PAGE, 5), (2, None, None, 5), (3, "no url", "", 5), (4, "http://a.example/x/2", PAGE, 5), (4, "http://a.example/x/2", PAGE, 5), (5, "http://b.example", "<p>cut <b", 5)], "page_id bigint, url string, html string, lines int")
    rows = [tuple(r) for r in html_text.extract(pages).orderBy("page_id").collect()]
    text = "Head&line <p> First bold line. Second é line."
    assert rows == [(1, "http://a.example/x/1", text, len(text)), (2, None, "", 0), (3, "no url", "", 0), *[(4, "http://a.example/x/2", text, len(text))] * 2, (5, "http://b.example", "cut", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_differencing_deletes_the_sites_lines(spark):
    make = lambda body: f"<body><div>Site of things</div><div>{body}</div><div>Read more here</div></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/blog/{i}", make(f"Own text number {i}")) for i in range(6)], "page_id bigint, url string, html string")
    assert [r["text"] for r in html_text.extract(pages).orderBy("page_id").collect()] == [f"Own text number {i}" for i in range(6)]


def test_differencing_decides_on_marked_pages(spark):
    make = lambda i, end: f"<nav>Menu</nav><article><p>Own text {i}</p><p>Said by both</p>{end}</article>"
    widget = "<p>Write to us</p><p>Call us</p>"
    rows = [(1, "http://h.example/a/1", make(1, widget)), (2, "http://h.example/a/2", make(2, "") + widget), (3, "http://other.example/a", make(3, widget))]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in found] == ["Own text 1 Said by both", "Own text 2 Said by both", "Own text 3 Said by both Write to us Call us"]


def test_pages_at_range_ends_keep_their_neighbours(spark, monkeypatch):
    make = lambda i: f"<div>Site of things</div><div>Own text {i}</div><div>Group {i // 2}</div>"
    rows = [(None if i == 7 else i, f"http://{'ha'[i > 8]}.example/b/{i // 2}/{i}", make(i)) for i in range(13)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(str, html_text.extract(pages).collect()))
    monkeypatch.setattr(html_text, "PAGES_PER_RANGE", 1)
    for seed in (3, 4):
        assert sorted(map(str, html_text.extract(pages, seed=seed).collect())) == want
    assert len(want) == 13 and not any("Site" in r for r in want)


def test_class_names_inside_an_article(spark):
    body = "<p>One.</p><div class='related-work'>Two.</div><p id='comment-on-law'>Three.</p><div class='share-prices'>Four.</div><ul class='search-results'><li>Five.</ul>"
    gone = "<div class='cookie-notice'>x</div><div id=comment-list>x</div><div class='post ad-slot-3 share-bar'>x</div><div class='related-posts'>x</div>"
    pages = spark.createDataFrame([(1, "http://h.example/a", f"<article>{body}{gone}</article>")], "page_id bigint, url string, html string")
    assert html_text.extract(pages).first()["text"] == "One. Two. Three. Four. Five."


def test_names_nominate_inside_an_article(spark):
    make = lambda i, more: f"<article><p>Own text {i}</p>{more}</article>"
    text = "<section id='tags'><p>Tags are three.</p></section><figcaption class='social-bar'>A bar.</figcaption><ol class='responses'><li>One answer.</ol><p>He <span class='share'>said</span> so.</p>"
    bar = "<div class='share-bar'>Tell your friends</div>"
    rows = [(1, "http://a.example/x/1", make(1, text)), (2, "http://b.example/x/1", make(2, bar + text)), (3, "http://b.example/x/2", make(3, bar)), (4, "http://c.example/1", make(4, bar)), (4, "http://c.example/1", make(4, bar))]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    kept = "Tags are three. A bar. One answer. He said so."
    assert [r["text"] for r in found] == [f"Own text 1 {kept}", f"Own text 2 {kept}", "Own text 3", *["Own text 4 Tell your friends"] * 2]


def test_differencing_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES_PER_RANGE", 2)
    rng = random.Random(31)
    rows = []
    for i in range(120):
        host, path = f"h{rng.randint(0, 9)}.example", f"/{rng.choice('ab')}/{rng.choice('xyz')}{rng.randint(0, 30)}/{i}"
        lines = [f"site {host}", *[f"line {rng.randint(0, 40)}" for _ in range(rng.randint(0, 5))], f"foot {path[1]}"]
        rows.append((i, host, path, lines))
    pages = spark.createDataFrame([(i, f"http://{h}{p}", "".join(f"<div>{x}</div>" for x in lines)) for i, h, p, lines in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for i, h, p, lines in rows:
        own = sorted((q, j, other) for j, g, q, other in rows if g == h)
        at = [j for _, j, _ in own].index(i)
        sides = [own[k] for k in (at - 1, at + 1) if 0 <= k < len(own)]
        partner = max(sides, key=lambda s: len(html_text.os.path.commonprefix([p, s[0]])))[2] if sides else []
        shared = set(html_text.common_lines(lines, partner))
        assert got[i] == " ".join([x for k, x in enumerate(lines) if k not in shared] or lines)


def test_long_pages_align_in_bounded_memory(monkeypatch):
    rng = random.Random(32)
    for most in (1, 8, 40):
        for _ in range(100):
            monkeypatch.undo()
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
            whole = len(html_text.aligned(a, b))
            monkeypatch.setattr(html_text, "ALIGNED_BITS", most)
            found = html_text.aligned(a, b)
            assert len(found) == whole and all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(7)

    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        found = html_text.common_lines(a, b)
        it = iter(b)
        assert len(found) == length(a, b) and all(a[i] in it for i in found) and found == sorted(set(found))


# --- 7 url rules

RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in RULES:
        verdict, place = r.split(" ")
        h, p = place.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(place) > len(best[0])):
            best = (place, verdict)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "https://a.example.com/en/1", "http://b.net/es/", "http://b.net/de/", "http://com/x", "http://dotcom/x", "http://x.com", "http://É.com/", "a://b://c.com/d#://", "http://u.net/fr/x" + "y" * 3000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h")], "page_id bigint, url string, host string")
    rows = url_rules.filter_urls(pages, RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, best = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[0], best[1] if best else "allow")
    assert url_rules.filter_urls(pages.limit(0), RULES).count() == 0


def test_mined_rules_find_planted_tokens(spark):
    rng = random.Random(8)
    rows = []
    for i in range(800):
        spam = rng.random() < 0.3
        host = "casino" if spam and rng.random() < 0.9 else rng.choice(["news", "blog", "shop"])
        rows.append((i, f"http://{host}.site{rng.randint(0, 9)}.org/{rng.choice(['a', 'b'])}/{i}", spam))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, s) for i, _, s in rows if i % 2], "page_id bigint, block boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(pages, RULES, labels=labels).collect()}
    assert all((got[i] == "block") == ("casino" in u) for i, u, _ in rows)
    mined = spark.createDataFrame([(list("ab"), 1.0, 1.0), (["c"], 1.0, 1.0), (list("abd"), 1.0, 1.0)], url_rules.RULES)
    df = spark.createDataFrame([("0", ["a", "b"]), ("1", ["c", "x"]), ("2", ["a"]), ("3", [])], "_url string, _tokens array<string>")
    assert sorted((r["_url"], "".join(r["tokens"])) for r in url_rules.fired(df, mined).collect()) == [("0", "ab"), ("1", "c")]


def test_fired_and_simplest_rules_equal_brute_force(spark):
    rng = random.Random(43)
    tokens = [f"t{i}" for i in range(60)]
    rules = {tuple(sorted(rng.sample(tokens, rng.randint(1, 4)))): round(rng.uniform(0.8, 1), 2) for _ in range(3000)}
    urls = {f"u{i}": rng.sample(tokens, rng.randint(0, 12)) for i in range(200)}
    mined = spark.createDataFrame([(list(t), c, 0.1) for t, c in rules.items()], url_rules.RULES)
    rows = [(u, t) for u, t in urls.items() for _ in range(1 + (u == "u7"))] + [(None, [])]
    found = url_rules.fired(spark.createDataFrame(rows, "_url string, _tokens array<string>"), mined).collect()
    want = {(u, r) for u, t in urls.items() for r in rules if set(r) <= set(t)}
    assert len(found) == len(want) and {(r["_url"], tuple(r["tokens"])) for r in found} == want
    kept = {tuple(r["tokens"]) for r in url_rules.simplest(mined).collect()}
    assert kept == {r for r, c in rules.items() if not any(set(q) < set(r) and d >= c for q, d in rules.items())}


def test_repeated_and_null_urls_under_mined_rules(spark):
    rows = [(i, f"http://{'casino' if i % 3 == 0 else 'news'}.a.org/{i}") for i in range(90)] + [(200, "http://casino.b.org/x" + "y" * 5000)] * 3 + [(201, None), (None, "http://casino.c.org/"), (202, "http://casino.com/")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id bigint, url string, _url int, _hits int")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)], "page_id bigint, block boolean")
    got = url_rules.filter_urls(pages, RULES, labels=labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "allow" if r["page_id"] in (201, 202) else "block" if r["host"].startswith("casino") else "allow"
        assert r["verdict"] == want and (r["mined_hits"] > 0) == (want == "block")
    few = url_rules.filter_urls(pages, RULES, labels=labels.filter("page_id < 19")).collect()
    assert len(few) == len(rows) and all(r["mined_hits"] == 0 and r["verdict"] == "allow" for r in few)


def test_pages_get_labels_by_their_text(spark):
    rng = random.Random(41)
    bad = lambda: " ".join(f"{rng.choice(WORDS)}{rng.choice(['***', '%%%', '###'])}" for _ in range(60))
    texts = [bad() if i % 3 == 0 else prose(rng, 60) for i in range(200)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, i % 3 == 0) for i in range(150)], "doc_id bigint, block boolean")
    pages = spark.createDataFrame(
        [(i, f"http://{'farm' if i % 4 == 0 else f'h{i % 7}'}.example.org/en/{i}", f"<script>var x=1</script><p>{bad() if i % 4 == 0 else prose(rng, 60)}</p>") for i in range(300)] + [(None, None, None), (301, "", "")], "page_id bigint, url string, html string"
    )
    found = url_rules.labels_by_text(pages, docs, labels)
    told = {r["page_id"]: r["block"] for r in found.collect()}
    assert len(told) == 302 and sum(told[i] == (i % 4 == 0) for i in range(300)) >= 290
    rows = {r["page_id"]: r for r in url_rules.filter_urls(pages, RULES, labels=found).collect()}
    assert all((rows[i]["verdict"] == "block") == (i % 4 == 0) for i in range(300)) and rows[0]["mined_hits"] > 0 and rows[None]["verdict"] == "allow"
    assert url_rules.labels_by_text(pages, docs, labels.filter("block")).count() == 0
    assert url_rules.filter_urls(pages, RULES, labels=found.limit(0)).filter("mined_hits > 0").count() == 0


# --- 8 byte-level BPE


def test_bpe_equals_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(9)
    parts = ["a", "É", " ", "  ", "\n", "\x1c", "\xa0", "1", "'s", "!!", "😀", "漢", "th", "ing"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = {r["doc_id"]: r for r in bpe.encode_documents(documents(spark, texts), path, P.PATTERN, decode=True).collect()}
    for i, t in enumerate(t or "" for t in texts):
        ids = library.encode_ordinary(t)
        assert bytes(rows[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and rows[i]["n_tokens"] == len(ids) and bytes(rows[i]["decoded"]).decode() == t
    assert bpe.encode_documents(documents(spark, []), path, P.PATTERN).count() == 0


def test_higher_order_functions_give_the_same_ids(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.coder(path, P.PATTERN)
    words = ["", "a", " the", "thereabouts", "Éclair", "漢字", "zzzzqqqq", " unbelievable", "!!!", "été"]
    got = {r["word"]: r["ids"] for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), path).collect()}
    assert got == {w: coder.fold(w.encode()) if w else [] for w in words}


# --- 9 toxicity


def toxic_corpus(spark, n=400):
    rng = random.Random(10)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        toxic, threat = i % 4 == 0, i % 8 == 0
        if toxic:
            words[3:3] = ["vilexx", "nastyyy"]
        if threat:
            words[9:9] = ["threatzz"] * 2
        texts.append(" ".join(words))
        labels.append((i, int(toxic), int(threat)))
    return texts, spark.createDataFrame(labels + [(5, None, 0), (1, 0, 0)], "doc_id bigint, insult int, threat int")


def test_chain_finds_planted_categories(spark):
    texts, labels = toxic_corpus(spark)
    docs = documents(spark, texts + ODD)
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"), ["insult", "threat"])
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1
    rows = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i in range(400) if i % 3 == 0]
    assert np.mean([(rows[i]["p_insult"] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert np.mean([(rows[i]["p_threat"] >= 0.5) == (i % 8 == 0) for i in held]) > 0.97
    assert rows[400]["p_insult"] == rows[401]["p_threat"] == 0
    kept = toxicity.without(docs, chain, "insult")
    assert kept.columns == docs.columns and kept.count() == sum(r["p_insult"] < 0.5 for r in rows.values())


def test_later_models_learn_from_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(12)
    x, y, folds = rng.random((90, 40), dtype=np.float32), rng.integers(0, 2, (90, 2)).astype(np.float32), np.arange(90) % toxicity.FOLDS
    fit, calls = toxicity.fit_linear, []
    monkeypatch.setattr(toxicity, "fit_linear", lambda inputs, target: calls.append((inputs, fit(inputs, target))) or calls[-1][1])
    toxicity.fit_chain(x, y, folds, ["a", "b"], {})
    given = calls[-1][0][:, -1]  # what the model of the second category saw of the first
    for f in range(toxicity.FOLDS):
        assert len(calls[f][0]) == 60 and np.allclose(given[folds == f], calls[f][1].chance(x[folds == f]))
    assert not np.allclose(given, calls[toxicity.FOLDS][1].chance(x))


def test_several_texts_of_one_id_train_alike(spark):
    docs, labels = documents(spark, ["b a", "a b", "c c"], ids=[1, 1, 2]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    found = [sorted(map(str, toxicity.training_rows(d, labels, ["toxic"], "doc_id", "text", 10).collect())) for d in (docs, docs.orderBy(F.desc("text")))]
    assert found[0] == found[1] and len(found[0]) == 2


def test_chain_without_labels(spark):
    docs = documents(spark, ODD)
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["p_toxic"] for r in toxicity.toxic_documents(docs, empty).collect()] == pytest.approx([0.0] * len(ODD), abs=1e-12)
    assert toxicity.toxic_documents(documents(spark, []), empty).count() == 0


# --- 10 Jaccard join


def brute_components(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = units((t or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_corpus(seed, clusters=6, size=25, noise=60):
    """Clusters around base texts with edits of all rates, so that many pairs lie just on either side of the threshold; shared passages; short texts."""
    rng = random.Random(seed)
    texts, passage = [], prose(rng, 40)
    for _ in range(clusters):
        base = prose(rng, rng.choice([6, 30, 120, 200])).split()
        for _ in range(size):
            words, rate = list(base), rng.choice([0.005, 0.01, 0.02, 0.03, 0.05, 0.1])
            for i in range(len(words)):
                if rng.random() < rate:
                    words[i] = rng.choice(WORDS) + str(rng.randint(0, 3))
            texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randint(0, 60))} {passage} {prose(rng, rng.randint(0, 60))}" for _ in range(noise)]
    texts += [prose(rng, rng.randint(1, 7)) for _ in range(noise)] + [texts[0].upper(), texts[1]] * 10 + ODD
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "frequent", "at_once", "block"), [(11, 3, 4, 512), (12, 2, 1, 4), (13, 2, 0, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent, at_once, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_corpus(seed)
    rows = {r["doc_id"]: r for r in jaccard.near_copies(documents(spark, texts)).collect()}
    sizes, comps = brute_components(texts)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == comps


def test_members_around_a_centre_come_into_the_components_of_their_links():
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.where(rng.random(150) < rng.choice([0.05, 0.1, 0.12, 0.15]), rng.integers(0, 1 << 63, 150, dtype=np.uint64), base)) for _ in range(120)]
    each = jaccard.Sets(np.concatenate(sets), jaccard.offsets(np.array([len(x) for x in sets])))
    bits, shingles = (jaccard.lists(*x).to_numpy(zero_copy_only=False) for x in (jaccard.bit_maps(each), each))
    node = np.arange(120)

    def parts(links):
        comp = node.copy()
        for i, j in links:
            comp[comp == comp[i]] = comp[j]
        return {frozenset(np.flatnonzero(comp == c).tolist()) for c in comp}

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)

    true = {(i, j) for j in range(120) for i in range(j) if linked(i, j)}
    own, found = node % 3, []
    for i, j in [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]:
        rows = list(jaccard.compare(node, node, np.full(120, -1), each.sizes(), bits, shingles, np.flatnonzero(own == i), np.flatnonzero(own == j)))
        assert sum(b.num_rows for b in rows) < 80  # fewer than members, not the pairs that link
        found += [(a, b) for x in rows for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]
    assert set(found) <= true and len(true) > 1000
    assert parts(found) == parts(true) and len(parts(true)) > 1


def test_pairs_of_large_groups_are_not_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)
    verified, pairs = jaccard.verified, []
    monkeypatch.setattr(jaccard, "verified", lambda now, sets: pairs.append(now.count()) or verified(now, sets))
    texts = near_corpus(18, clusters=2, size=60, noise=5)
    rows = {r["doc_id"]: r for r in jaccard.near_copies(documents(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == brute_components(texts)[1]
    assert sum(pairs) <= 4 * len(texts)


def test_pairs_that_link_share_a_signature():
    rng = np.random.default_rng(14)
    checked = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
        b = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
        if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
            continue
        checked += 1
        for frequent in (np.array([], dtype=np.uint64), np.sort(both[: n // 2]), np.sort(both)):
            sign = jaccard.Signer(frequent)
            (wa, na), (wb, nb) = sign(a, sign.rare(a)), sign(b, sign.rare(b))
            assert np.intersect1d(wa, wb).size or np.intersect1d(na, nb).size
    assert checked > 150


def test_long_texts_are_shingled_in_pieces():
    import pyarrow as pa

    rng = random.Random(16)
    texts = [t.replace("\x00", "") if t else t for t in ODD] + [prose(rng, 400), "w" * 700 + " " + prose(rng, 50) + "  \n", " " * 300 + "end"]
    whole = [x.tolist() for _, s in jaccard.Shingler().blocks(pa.array(texts)) for x in s.each()]
    for size in (8, 64, 1000):
        assert [x.tolist() for _, s in jaccard.Shingler(size).blocks(pa.array(texts)) for x in s.each()] == whole
    for t, found in zip(texts, whole, strict=True):
        w = units((t or "").lower())
        assert len(found) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
        assert found == sorted(set(found))


def test_odd_tables_for_the_join(spark):
    assert jaccard.near_copies(documents(spark, [])).count() == 0
    rows = jaccard.near_copies(documents(spark, ["a b c d e f", "A B C D E F", None, "a b c d e f"], ids=[None, 7, 7, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows if r["n_shingles"]) == [(-1, 7), (7, 7), (9, 7)]


def test_without_copies_keeps_one_of_each_group(spark):
    texts = near_corpus(15, clusters=3, size=8, noise=10)
    docs = documents(spark, texts)
    kept = jaccard.without_copies(docs)
    assert kept.columns == docs.columns
    sizes, comps = brute_components(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in enumerate(comps) if c == i)
    twice = jaccard.without_copies(documents(spark, ["a b c", "a b c", "", ""], ids=[3, 3, 4, 4])).collect()
    assert sorted(r["doc_id"] for r in twice) == [3, 4, 4]

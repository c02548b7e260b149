"""Main text of web pages by structure and nearest-URL page differencing.

A page is cut into text lines, one per block element. Lines in elements that
never hold the article (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments, hidden parts) are left out; a class or
id tells so only if all its words do or stand around such (`cookie-notice`,
`comment-list`, but not `share-prices`). In a marked article only names of
adverts, comments, notices and navigation decide so; others (`tags`, `social`,
`responses`) nominate: a nominated line goes if the nearest page has it too and
not in its own text. The rest
is compared with the page nearest by URL path on the same host: the two pages'
lines, inside and outside the article, are aligned by their longest common
subsequence. Where a page doesn't mark its article (article, main), lines that
both pages have are the site's, not the article's, and go. In a marked article
runs of two lines or more go that the other page has in a run outside its own
text; a single line, which may be a sentence that an advert quotes, and lines
that both articles have stay, as does all of a page next to its exact copy, which
tells nothing. A page that would lose all its lines to a copy of
itself keeps them.

Pages are dealt to ranges of (host, path, id) between sampled splitters, so a
host with a third of all pages is spread over tasks; a range also gets the last
page before it and the first after it, without putting them out. A page's
partner is the neighbour on its host whose path has the longer start in common.

Cases: null and empty pages have the empty text; a null url, or one without
`://`, has an empty host and the url's own text as path; a page alone on its
host is not differenced; repeated rows are compared like other pages (and keep
their text, being copies); an empty table gives an empty result; columns beside
id, url and html don't matter. Pages are read whole, however long.
"""

from __future__ import annotations

import bisect
import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .sharding import SAMPLE_BOUND, SAMPLE_PER_RANGE, quantile_bounds

PAGES_PER_RANGE = 64
#: Bits of an alignment's table at most (32 MB).
ALIGNED_BITS = 1 << 28

# Names of the HTML standard, and words that sites use in class and id.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "svg", "canvas", "audio", "video", "map", "head", "fieldset", "datalist", "math"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "tags", "toolbar", "topbar", "trending", "widget",
}
OUTSIDE_NAMES = {"header"}
#: Names that in a marked article decide nothing by themselves.
NOMINATING = {
    "alert", "aside", "banner", "copyright", "disclaimer", "login", "masthead", "modal", "notification", "overlay", "pager", "pagination", "popup", "replies", "respond", "responses", "search", "share",
    "sharing", "signup", "skip", "social", "tags", "toolbar", "topbar", "trending", "widget",
}
AROUND = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "column", "container", "content", "first", "form", "global", "group", "icons", "inner", "item", "items", "last", "left",
    "articles", "level", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "stories", "right", "row", "secondary", "section", "site", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
NEVER_BY_NAME = {"html", "body", "article", "main"}
#: What a line is: left out, the article's, or the article's unless the nearest page has it outside its text; the signs they are shuffled under.
OUT, TEXT, NOMINATED = 0, 1, 2
SIGNS = "-+?"

OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+")


def role(name: str, attributes: str, inside: bool) -> int:
    """What an element's text is by its tag and attributes; inside: it lies in a marked article."""
    if name in LEFT_OUT or name == "header" and not inside:
        return OUT
    if not attributes or name in NEVER_BY_NAME and "comment" not in attributes and "hidden" not in attributes:
        return TEXT
    found = TEXT
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if key == "role" and value in ROLES:
            return OUT
        if key in ("class", "id"):
            names = {"comment", "comments"} if name in NEVER_BY_NAME else NAMES if inside else NAMES | OUTSIDE_NAMES
            for one in value.split():
                words = set(PARTS.findall(one))
                if words & names and words <= names | AROUND:
                    if not inside or name in NEVER_BY_NAME or words & names - NOMINATING:
                        return OUT
                    if name not in INLINE:  # a part of a line isn't told apart from it
                        found = NOMINATED
    return found


def page_lines(page: str) -> list[tuple[str, bool, int]]:
    """Lines of text in order; whether each lies in a marked article; what it is (OUT, TEXT, NOMINATED)."""
    lines: list[tuple[str, bool, int]] = []
    parts: tuple[list[str], ...] = ([], [], [])  # of the line at hand, by what they are
    stack: list[tuple[str, int, bool]] = []  # name, what its text is, inside a marked article
    kind, inside, at, end = TEXT, False, 0, len(page)

    def flush() -> None:
        for k in (TEXT, NOMINATED, OUT):
            if parts[k]:
                line = " ".join("".join(parts[k]).split())
                if line:
                    lines.append((line, inside, k))
                parts[k].clear()

    def close(i: int) -> None:
        nonlocal kind, inside
        if any(n not in INLINE for n, _, _ in stack[i:]):
            flush()
        del stack[i:]
        kind, inside = (stack[-1][1], stack[-1][2]) if stack else (TEXT, False)

    while at < end:
        found = OPENS.search(page, at)
        start = found.start() if found else end
        if start > at:
            run = page[at:start]
            parts[kind].append(html.unescape(run) if "&" in run else run)
        if not found:
            break
        if found[0] == "<!--":
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if found[0] in ("<!", "<?"):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        tag = TAG.match(page, start) or PLAIN_TAG.match(page, start)
        if not tag:  # cut off
            break
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush() if name != "script" and name != "style" else None
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if not stop:
                break
            close_ = page.find(">", stop.start())
            at = end if close_ < 0 else close_ + 1
            continue
        if name == "br":
            parts[kind].append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        marked = inside or name in ("article", "main") or 'role="main"' in tag[3]
        own = OUT if kind == OUT else role(name, tag[3], marked)
        stack.append((name, NOMINATED if own == TEXT and kind == NOMINATED else own, marked))
        kind, inside = stack[-1][1], stack[-1][2]
    flush()
    return lines


def candidate_lines(page: str) -> tuple[list[str], list[int], bool]:
    """All lines, what each is as a candidate (of the marked article, or of what isn't left out), and whether the article is marked."""
    lines = page_lines(page)
    marked = any(inside and kind for _, inside, kind in lines)
    return [line for line, _, _ in lines], [kind if inside or not marked else OUT for _, inside, kind in lines], marked


def rows_of(a: list[str], b: list[str]) -> Iterator[int]:
    """For each start of a, from the empty one: an integer with a bit per line of b, 0 where the longest common subsequence grows by that line."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    yield v
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each start of b."""
    for v in rows_of(a, b):
        last = v
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence (bit-parallel); long pages are halved first, so that memory is bounded."""
    if len(a) * len(b) > ALIGNED_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int((lengths(a[:half], b) + lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in aligned(a[half:], b[cut:])]
    rows = list(rows_of(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    return [i for i, _ in aligned(a, b)]


def own_lines(lines: list[str], kinds: list[int], marked: bool, other: tuple[list[str], list[int]] | None) -> list[str]:
    """The candidates among lines without the site's, as far as the nearest page (lines, kinds) tells them; all, if none were left."""
    own = [x for x, k in zip(lines, kinds, strict=True) if k]
    if not other or not own:
        return own
    if not marked:
        shared = set(common_lines(own, other[0]))
        return [x for i, x in enumerate(own) if i not in shared] or own
    if lines == other[0]:
        return own
    texts = {x for x, k in zip(*other, strict=True) if k == TEXT}
    pairs = {(i, j) for i, j in aligned(lines, other[0]) if kinds[i] and lines[i] not in texts}
    site = {i for i, j in pairs if kinds[i] == NOMINATED or (i - 1, j - 1) in pairs or (i + 1, j + 1) in pairs}
    return [x for i, x in enumerate(lines) if kinds[i] and i not in site] or own


def host_and_path(url: str | None) -> tuple[str, str]:
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", scheme
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]


def nearest(path: str, before: tuple | None, after: tuple | None) -> tuple[list[str], list[int]] | None:
    """The lines of the neighbour (path, lines and kinds) whose path has the longer start in common; the one before, if equal."""
    sides = [x for x in (before, after) if x]
    return max(sides, key=lambda x: len(os.path.commonprefix([path, x[0]])))[1] if sides else None


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seed: int = 3) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    n = rows.count()
    ranges = max(1, min(SAMPLE_BOUND // SAMPLE_PER_RANGE, n // PAGES_PER_RANGE))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "url"), 11) / F.lit(float(1 << 53))
    drawn = rows.filter(chance < ranges * SAMPLE_PER_RANGE / max(1, n)).select("id", "url").collect()
    keys = sorted((*host_and_path(r["url"]), -1 if r["id"] is None else r["id"]) for r in drawn)
    bounds = quantile_bounds(keys, [1.0] * len(keys), ranges)

    def key(url: str | None, i: int | None) -> tuple:
        return (*host_and_path(url), -1 if i is None or i is pd.NA else int(i))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = {}, {}
        for b in batches:
            for k in map(key, b["url"], b["id"].astype("Int64")):
                r = bisect.bisect_right(bounds, k)
                first[r], last[r] = min(k, first.get(r, k)), max(k, last.get(r, k))
        yield pd.DataFrame([(r, *first[r], *last[r]) for r in first], columns=["range", "h1", "p1", "i1", "h2", "p2", "i2"])

    edge = lambda n: F.struct(f"h{n}", f"p{n}", f"i{n}")
    found = rows.select("id", "url").mapInPandas(ends, "range int, h1 string, p1 string, i1 long, h2 string, p2 string, i2 long")
    found = sorted(tuple(r) for r in found.groupBy("range").agg(F.min(edge(1)), F.max(edge(2))).collect())
    also: dict[tuple, list[int]] = {}  # a page at a range's end: the ranges beside, where its host goes on
    for (r, _, last), (s, first, _) in zip(found, found[1:], strict=False):
        if last[0] == first[0]:
            also.setdefault(tuple(last), []).append(s)
            also.setdefault(tuple(first), []).append(r)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].astype("Int64")
            places = [host_and_path(u) for u in b["url"]]
            parsed = [candidate_lines(h) for h in b["html"]]
            keys = [(*p, -1 if i is pd.NA else int(i)) for p, i in zip(places, ids, strict=True)]
            out = pd.DataFrame({
                "range": [bisect.bisect_right(bounds, k) for k in keys], "host": [p[0] for p in places], "path": [p[1] for p in places], "place": [k[2] for k in keys], "id": ids, "url": b["url"],
                "marked": [m for _, _, m in parsed], "lines": ["\n".join(SIGNS[c] + x for x, c in zip(a, k, strict=True)) for a, k, _ in parsed], "context": False,
            })
            yield out
            beside = [(i, r) for i, k in enumerate(keys) for r in also.get(k, ())]
            if beside:
                yield out.iloc[[i for i, _ in beside]].assign(range=[r for _, r in beside], context=True)

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = now = None  # (range and host, path, lines and kinds, marked, id, url, context)

        def result(after: tuple | None) -> tuple:
            sides = [x[1:3] if x and x[0] == now[0] else None for x in (before, after)]
            return now[4], now[5], " ".join(own_lines(*now[2], now[3], nearest(now[1], *sides)))

        def frame(found: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(found, columns=["id", "url", "text"])
            out["id"], out["n_chars"] = out["id"].astype("Int64"), [len(t) for t in out["text"]]
            return out

        for b in batches:
            found = []
            for r, host, path, _, i, url, marked, lines, context in b.astype({"id": "Int64"}).itertuples(index=False, name=None):
                coded = lines.split("\n") if lines else []
                page = ((r, host), path, ([x[1:] for x in coded], [SIGNS.index(x[0]) for x in coded]), marked, i, url, context)
                if now and not now[6]:
                    found.append(result(page))
                before, now = now, page
            yield frame(found)
        if now and not now[6]:
            yield frame([result(None)])

    lines = rows.mapInPandas(read, "range int, host string, path string, place long, id long, url string, marked boolean, lines string, context boolean")
    dealt = lines.repartition(partitions(spark), "range").sortWithinPartitions("range", "host", "path", "place")
    out = dealt.mapInPandas(difference, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)

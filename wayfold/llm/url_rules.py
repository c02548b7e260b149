"""URL filtering: hand-written rules first, mined association rules for the rest.

A hand-written rule names a host and a path; it fits the host and its
subdomains where the url's path starts with the rule's; the longest wins.
For urls that none fits, FP-growth mines combinations of url tokens from
labelled urls; combinations that imply `block` with enough confidence and
support, and for which no part of them does so as surely, become rules. They
match by an inverted index from token to rules: urls' tokens meet its postings in
an equi-join, and a rule fires if the index names it as often as it has tokens.
The index is a table; Spark broadcasts it while it is small, and only urls with
a token in it are grouped, each url once however many rows have it.

FP-growth sees at most about `train_rows` of the labels, drawn by a hash of the
url. (What the hand-written rules judge is no use as labels: they choose by the
very tokens that would be mined, so that every other url looks blocked.) Rules
are pruned and matched as tables and never gathered on the driver; there is no
bound on their number or length.

Where only documents are labelled, `labels_by_text` labels pages: a logistic
regression on hashed words, fitted on a bounded sample of labelled documents,
judges the text of a bounded sample of pages, all in Spark's own functions.

Cases: a null url, or one without `://`, has an empty host and path and no
tokens, so no rule and the verdict `allow`; repeated rows give repeated
results; without any blocked label nothing is mined and the method allows all, as
with fewer labelled rows than the support of `min_rows` asks of a rule; urls are
read whole, however long; an empty table gives an empty result; columns beside id and url don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"
RULES = "tokens array<string>, confidence double, support double"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def rules_from(lines: list[str]) -> list[UrlRule]:
    """`allow com/` and the like: a verdict, then a host and a path from the first slash on."""
    out = []
    for line in lines:
        verdict, place = line.split(" ", 1)
        host, slash, path = place.partition("/")
        out.append(UrlRule(verdict, host, slash + path))
    return sorted(out, key=lambda r: (-len(r.text), r.text))


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host (the last one marked), path segments with digits masked, names in the query, the fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    names = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "0"))),
        F.transform(names, lambda x: F.concat(F.lit("name:"), x)),
        F.when(fragment != "", F.array(F.concat(F.lit("part:"), fragment))).otherwise(F.array().cast("array<string>")),
    ))


def judged_by_rules(urls: DataFrame, rules: list[UrlRule], url_col: str = "url") -> DataFrame:
    """urls with _host, _path, and _rule and _verdict of the longest rule that fits (else null)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    out = urls.withColumns({"_host": url_host(url), "_path": url_path(url)})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):  # sorted by falling length: the first that fits is looked at last
        fits = r.fits(F.col("_host"), F.col("_path"))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return out.withColumns({"_rule": rule, "_verdict": verdict, "_tokens": url_tokens(url, F.col("_host"), F.col("_path"))})


def mine_rules(labelled: DataFrame, *, min_support: float = 0.005, min_rows: int = 20, min_confidence: float = 0.8, train_rows: int = 50_000, seed: int = 5) -> DataFrame:
    """Token combinations that imply `block` (tokens, confidence, support), from rows with _tokens and _verdict; pruned by support (min_rows at least), confidence and simpler rules."""
    n = labelled.count()
    support = max(min_support, min_rows / max(1, min(n, train_rows)))
    if support > 1:  # fewer rows than a rule needs
        return labelled.sparkSession.createDataFrame([], RULES)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_tokens"), 11) / F.lit(float(1 << 53))
    sample = labelled.filter(chance < train_rows / n) if n > train_rows else labelled
    label = F.when(F.col("_verdict") == "block", F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(sample.select(F.concat("_tokens", label).alias("items")))
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK)))
    return simplest(materialize(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules"))


def simplest(rules: DataFrame) -> DataFrame:
    """The rules of which no part implies `block` as surely. A part's first token is one of the whole's, so they meet by it."""
    part = rules.select(F.get("tokens", F.lit(0)).alias("_token"), F.col("tokens").alias("_part"), F.col("confidence").alias("_sure"))
    whole = rules.withColumn("_token", F.explode("tokens"))
    within = (F.size("_part") < F.size("tokens")) & (F.col("_sure") >= F.col("confidence")) & (F.size(F.array_except("_part", "tokens")) == 0)
    longer = whole.join(part, "_token").filter(within).select("tokens").distinct()
    return rules.join(longer, "tokens", "left_anti")


def drawn(rows: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """About `most` rows, drawn by a hash of the key, or all if they are no more."""
    n = rows.count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return rows.filter(chance < most / n) if n > most else rows


def labels_by_text(pages: DataFrame, docs: DataFrame, labels: DataFrame, *, id_col: str = "page_id", html_col: str = "html", doc_id_col: str = "doc_id", text_col: str = "text", train_rows: int = 8_000, label_rows: int = 50_000, features: int = 1 << 16, seed: int = 9) -> DataFrame:
    """(id, block) for about label_rows pages, judged by a model of about train_rows labelled documents. labels: (doc id, `block` boolean).

    Without labels of both kinds no page is labelled.
    """
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True)

    def featured(rows: DataFrame, text: Column) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))
        return hashing.transform(rows.withColumn("words", words))

    known = labels.select(F.col(doc_id_col).alias("_id"), "block").filter(F.col("_id").isNotNull() & F.col("block").isNotNull()).distinct()
    known = drawn(known, F.col("_id"), train_rows, seed).join(docs.select(F.col(doc_id_col).alias("_id"), F.col(text_col).cast("string").alias("text")), "_id")
    known = featured(known, F.col("text")).select("features", F.col("block").cast("double").alias("label")).cache()
    plain = F.regexp_replace(F.regexp_replace(F.col(html_col).cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    some = drawn(pages.select(F.col(id_col), F.col(html_col)), F.col(id_col), label_rows, seed)
    if known.agg(F.count_distinct("label")).first()[0] < 2:
        return some.select(id_col, F.lit(False).alias("block")).limit(0)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(known)
    known.unpersist()
    return model.transform(featured(some, plain)).select(id_col, (F.col("prediction") > 0.5).alias("block"))


def fired(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(_url, tokens) of every url and mined rule all of whose tokens are among the url's _tokens, once each."""
    postings = mined.select("tokens", F.explode("tokens").alias("_token"))
    named = urls.select("_url", F.explode("_tokens").alias("_token")).join(postings, "_token")
    met = named.groupBy("_url", "tokens").agg(F.count_distinct("_token").alias("n"))
    return met.filter(F.col("n") == F.size("tokens")).select("_url", "tokens")


def filter_urls(pages: DataFrame, rules: list[str], *, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, **mining) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and how many mined rules fired (where no hand-written one fits).

    labels: (the id, `block` boolean); without them nothing is mined.
    """
    judged = judged_by_rules(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), rules_from(rules), "_url")
    hits = F.lit(0)
    if labels is not None:
        known = labels.select(F.col(id_col).alias("_id"), F.when(F.col("block"), "block").otherwise("allow").alias("label")).distinct()
        mined = materialize(mine_rules(judged.join(known, "_id").select("_tokens", F.col("label").alias("_verdict")), **mining), "url-rules")
        if not mined.isEmpty():
            open_ = judged.filter(F.col("_verdict").isNull()).select("_url", "_tokens")
            found = fired(open_, mined).groupBy("_url").agg(F.count("*").cast("int").alias("_hits"))
            judged = judged.join(found, "_url", "left")
            hits = F.when(F.col("_verdict").isNull(), F.coalesce("_hits", F.lit(0))).otherwise(0)
    return judged.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce(F.col("_verdict"), F.when(hits > 0, "block").otherwise("allow")).alias("verdict"), hits.alias("mined_hits"),
    )

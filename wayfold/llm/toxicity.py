"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the model of a category sees, in
addition to the words, the probabilities of the categories before it. In
training those are out-of-fold predictions, so that a later model learns from
probabilities as good as the ones it will get, and not from an earlier model's
memory of its training rows.

Features say whether a word, or the first 4, 5 or 6 letters of one, occurs in
the whole text once, twice or four times; a vocabulary of bounded size keeps
those that go with a category. A few shares (of signs, of repeated lines)
describe the text as such.
The chain is fitted on at most about `train_rows` labelled documents, drawn by
a hash of their id; every document is scored on its whole text.

Cases: null and empty texts have probability 0 in every category and are kept;
labels with a null are left out, several of one document count as their
largest, and of several texts of one document the smallest trains; a category that all or none of the training rows have gets its share
as probability; without any labels all probabilities are 0; repeated rows give
repeated results; an empty table gives an empty result; columns beside id and
text don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, numbered_columns

TRAIN_ROWS = 8000
FOLDS = 3
#: Features kept for each category, and the least deviation (in standard
#: deviations) and number of documents that let one in.
VOCABULARY, DEVIATION, LEAST_DOCS = 600, 4.0, 3
PREFIXES, TIMES = (4, 5, 6), (2, 4)
LETTERS = re.compile(r"[^\W\d_]+")
SHARES = 3


def names_of(word: str) -> list[str]:
    return [word, *[f"^{word[:n]}" for n in PREFIXES if len(word) > n]]


def text_features(text: str) -> list[str]:
    """The word, the starts of words, and those names with #2 or #4 if there are so many."""
    counts: Counter[str] = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        for name in names_of(word):
            counts[name] += n
    return [*counts, *[f"{name}#{n}" for n in TIMES for name, c in counts.items() if c >= n]]


def text_shares(text: str) -> list[float]:
    lines = [x for x in text.split("\n") if x.strip()]
    blanks = sum(map(text.count, " \n\t"))
    letters = sum(map(len, LETTERS.findall(text)))
    return [1 - letters / max(1, len(text) - blanks), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(text)) / 10]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -35, 35)))


def fit_linear(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, rounds: int = 150) -> Linear:
    """Logistic regression with a ridge, by accelerated gradient steps of fixed size."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(x.shape[1], dtype=np.float32), -35.0 if share == 0 else 35.0)
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest curvature, for the step
        v = x.T @ (x @ v)
        v /= max(1e-12, float(np.linalg.norm(v)))
    step = 1 / (0.25 * float(np.linalg.norm(x @ v)) ** 2 * 1.1 + ridge + 0.25 * n)
    w, b = np.zeros(x.shape[1], dtype=np.float32), math.log(share / (1 - share))
    w_old, b_old = w.copy(), b
    for t in range(rounds):
        m = t / (t + 3)
        ahead, ahead_b = w + m * (w - w_old), b + m * (b - b_old)
        off = Linear(ahead, ahead_b).chance(x) - y
        w_old, b_old = w, b
        w, b = ahead - np.float32(step) * (x.T @ off.astype(np.float32) + ridge * ahead), ahead_b - step * float(off.sum())
    return Linear(w, b)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]

    def vector(self, known: list[int], shares: list[float]) -> np.ndarray:
        x = np.zeros(len(self.vocabulary) + SHARES, dtype=np.float32)
        x[known] = 1
        x[len(self.vocabulary) :] = shares
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category, in order."""
        out = np.zeros((len(x), 0), dtype=np.float32)
        for model in self.models:
            out = np.column_stack((out, model.chance(np.column_stack((x, out)))))
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, categories: list[str], vocabulary: dict[str, int]) -> Chain:
    models, seen = [], np.zeros((len(x), 0), dtype=np.float32)
    for c in range(len(categories)):
        inputs = np.column_stack((x, seen)).astype(np.float32)
        held_out = np.zeros(len(x), dtype=np.float32)
        if c < len(categories) - 1:  # nothing follows the last
            for f in range(FOLDS):
                if (inside := folds == f).any():
                    held_out[inside] = fit_linear(inputs[~inside], y[~inside, c]).chance(inputs[inside])
        models.append(fit_linear(inputs, y[:, c]))
        seen = np.column_stack((seen, held_out))
    return Chain(categories, vocabulary, models)


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, train_rows: int) -> DataFrame:
    """Per labelled document drawn: its categories (0 or 1), fold, features and shares."""
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories)]).dropna()
    known = known.groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    n = known.count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(17), "id"), 11) / F.lit(float(1 << 53))
    drawn = known.filter(chance < train_rows / max(1, n)).withColumn("fold", F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [f"c{i}" for i in range(len(categories))]
    rows = rows.join(F.broadcast(drawn), "id").groupBy("id", "fold", *names).agg(F.min("text").alias("text"))  # about train_rows rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["fold", *names]].copy()
            out["features"] = [sorted(text_features(t)) for t in b["text"]]
            out["shares"] = [text_shares(t) for t in b["text"]]
            yield out

    return rows.mapInPandas(run, f"fold int, {', '.join(f'{c} int' for c in names)}, features array<string>, shares array<double>")


def choose_vocabulary(rows: DataFrame, n_categories: int) -> dict[str, int]:
    """The features whose documents deviate most from a category's share, at most VOCABULARY for each."""
    sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(n_categories)]).first()
    counts = rows.select(F.explode("features").alias("feature"), *[f"c{i}" for i in range(n_categories)]).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_categories)]).filter(F.col("n") >= LEAST_DOCS)
    counts = materialize(counts, "feature-counts")
    kept: set[str] = set()
    for i in range(n_categories):
        share = sums[1 + i] / max(1, sums[0])
        if 0 < share < 1:
            deviation = F.abs(F.col(f"c{i}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
            kept.update(r[0] for r in counts.filter(deviation >= DEVIATION).orderBy(deviation.desc(), "feature").limit(VOCABULARY).select("feature").collect())
    return {f: i for i, f in enumerate(sorted(kept))}


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Chain:
    rows = materialize(training_rows(docs, labels, categories, id_col, text_col, train_rows), "training")
    vocabulary = choose_vocabulary(rows, len(categories))
    names = [f"c{i}" for i in range(len(categories))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["fold", "shares", *names]].copy()
            out["known"] = [[vocabulary[f] for f in features if f in vocabulary] for features in b["features"]]
            yield out

    found = rows.mapInPandas(run, f"fold int, shares array<double>, {', '.join(f'{c} int' for c in names)}, known array<int>").collect()
    found = sorted(found, key=lambda r: (r["fold"], list(r["shares"]), list(r["known"])))
    empty = Chain(categories, vocabulary, [])
    x = np.stack([empty.vector(r["known"], r["shares"]) for r in found]) if found else np.zeros((0, len(vocabulary) + SHARES), dtype=np.float32)
    y = np.array([[r[c] for c in names] for r in found], dtype=np.float32).reshape(len(found), len(names))
    return fit_chain(x, y, np.array([r["fold"] for r in found], dtype=int), categories, vocabulary)


class Scorer:
    """Probabilities of texts; one for each task."""

    def __init__(self, chain: Chain, words_kept: int = 50_000):
        self.chain, self.words_kept = chain, words_kept
        self.words: dict[str, tuple[str, ...]] = {}  # names of words seen that count
        self.roots = {f.split("#")[0] for f in chain.vocabulary}

    def known(self, text: str) -> list[int]:
        counts: dict[str, int] = {}
        for w, n in Counter(LETTERS.findall(text.lower())).items():
            hit = self.words.get(w)
            if hit is None:
                hit = tuple(f for f in names_of(w) if f in self.roots)
                if len(self.words) >= self.words_kept:
                    self.words.clear()
                self.words[w] = hit
            for f in hit:
                counts[f] = counts.get(f, 0) + n
        marked = [*counts, *[f"{f}#{n}" for n in TIMES for f, c in counts.items() if c >= n]]
        return [self.chain.vocabulary[f] for f in marked if f in self.chain.vocabulary]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities for each text; zeros for null and empty ones."""
        out = np.zeros((len(texts), len(self.chain.categories)))
        for start in range(0, len(texts), 500):
            part = [t or "" for t in texts[start : start + 500]]
            p = self.chain.predict(np.stack([self.chain.vector(self.known(t), text_shares(t)) for t in part]))
            p[[not t for t in part]] = 0
            out[start : start + 500] = p
        return out


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and p_<category> for each category."""
    bounded_batches(docs.sparkSession)
    names = [f"p{i}" for i in range(len(chain.categories))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(chain)
        for b in batches:
            p = scorer(b["text"].tolist())
            yield pd.DataFrame({"id": b["id"]} | {n: p[:, i] for i, n in enumerate(names)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, {', '.join(f'{n} double' for n in names)}")
    return out.select(F.col("id").alias(id_col), *[F.col(n).alias(f"p_{c}") for n, c in zip(names, chain.categories, strict=True)])


def without(docs: DataFrame, chain: Chain, category: str, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose probability of the category stays below the threshold."""
    bounded_batches(docs.sparkSession)
    at, place = chain.categories.index(category), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(place).to_pylist())[:, at] < threshold))

    flat, names = numbered_columns(docs)
    return flat.mapInArrow(run, flat.schema).toDF(*names)


#: The categories of the labels table, in the order of the chain.
CATEGORIES = ["low_quality", "toxic"]


def corpus_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic"))


def corpus_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    return fit(docs, corpus_labels(labels), CATEGORIES)


def toxic_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic reaches the threshold)."""
    chain = corpus_chain(docs, labels)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= threshold)

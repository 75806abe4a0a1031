"""Toxicity by a classifier chain of linear models.

The categories come in order. Each has a logistic regression over counts of words and of their beginnings, and over the
probabilities of all earlier categories. In training, those are out-of-fold: a document's earlier probabilities come from models
that did not see it (nor its copies, as folds go by text), so later models learn how far earlier ones can be trusted.

The chain is fitted on the driver from at most MAX_LABELLED labelled documents, those of the least id hashes, reduced inside
Spark to counts of at most VOCABULARY words: both bounds hold at any input size. Scoring maps over all documents, whole texts.

A null or empty text has no words. Labels of unknown documents and null labels are not used. A category without both outcomes
among the labelled has its rate as constant probability. Rows with equal ids are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import hashed_sample

#: name -> condition on the labels' columns, in chain order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}
#: The category whose probability rejects a document.
REJECTS = "toxic"
MAX_LABELLED = 8_000
VOCABULARY = 1024
FOLDS = 4
#: Lengths of the beginnings of words that count as features beside the words.
PREFIXES = (3, 5, 7)
#: A word must stand in so many labelled documents.
LEAST_DOCUMENTS = 4
PENALTY, ROUNDS = 0.5, 150
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Linear:
    """A logistic regression: weights of words, then of earlier categories' probabilities, and a bias."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, x: "Counts", earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.times(self.words) + earlier @ self.earlier + self.bias, -30, 30)))


@dataclass
class Counts:
    """Rows of (word number, value) entries."""

    rows: np.ndarray
    words: np.ndarray
    values: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.words], self.n)

    def back(self, g: np.ndarray, n_words: int) -> np.ndarray:
        return np.bincount(self.words, self.values * g[self.rows], n_words)

    def pick(self, mask: np.ndarray) -> "Counts":
        number, keep = np.cumsum(mask) - 1, mask[self.rows]
        return Counts(number[self.rows[keep]], self.words[keep], self.values[keep], int(mask.sum()))


@dataclass
class Chain:
    vocabulary: dict[str, int]
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 1.0

    def probabilities(self, x: Counts) -> np.ndarray:
        out = np.zeros((x.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(x, out)])
        return out


def features_of(word: str) -> list[str]:
    """The word and its beginnings, since inflected words share them."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def count_rows(texts: list, vocabulary: dict[str, int]) -> Counts:
    """1 + log(count) of each vocabulary feature in each text."""
    rows, found, values = [], [], []
    known: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        counted: dict[int, int] = {}
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = [vocabulary[f] for f in features_of(word) if f in vocabulary]
            for f in ids:
                counted[f] = counted.get(f, 0) + n
        if len(known) > 500_000:
            known.clear()
        rows += [i] * len(counted)
        found += counted.keys()
        values += counted.values()
    return Counts(np.array(rows, np.int64), np.array(found, np.int64), 1 + np.log(np.array(values, np.float64)), len(texts))


def fit_linear(x: Counts, earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Accelerated gradient descent on the mean log-loss with an L2 penalty; a constant where y has one outcome only."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    out = Linear(np.zeros(n_words), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return out
    n, penalty = len(y), PENALTY / len(y)
    scale = np.maximum(x.back(np.ones(n) / n, n_words), 1e-2) ** -0.25  # rare features get somewhat more room than frequent ones
    spread = 0.25 * (np.bincount(x.rows, (x.values * scale[x.words]) ** 2, n).max(initial=0) + (earlier**2).sum(axis=1).max(initial=0) + 1)
    step = 1 / min(spread, 40.0)
    flat = np.concatenate([out.words, out.earlier, [out.bias]])
    ahead, m = flat, n_words
    for k in range(ROUNDS):
        odds = x.times(ahead[:m] * scale) + earlier @ ahead[m:-1] + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / n
        slope = np.concatenate([x.back(g, m) * scale, earlier.T @ g, [g.sum()]])
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - step * slope
        ahead, flat = new + k / (k + 3) * (new - flat), new
    return Linear(flat[:m] * scale, flat[m:-1], float(flat[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which rejecting has the best F1 on out-of-fold predictions; never under one half."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, score, -1)))
    below = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float(max(0.5, (p[order][at] + below) / 2))


def beginnings(tokens: Column, k: int) -> Column:
    """As in features_of, for an array of words."""
    return F.transform(F.filter(tokens, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("~")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", categories: dict[str, str] | None = None, rejects: str = REJECTS, most: int = MAX_LABELLED) -> Chain:
    categories = categories or CATEGORIES
    names = list(categories)
    wanted = [F.expr(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())]
    known = labels.select(F.col(key).alias("key"), *wanted).filter("key is not null").dropDuplicates(["key"])
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    # At most `most` short rows, so they are sent to the texts; no text is moved.
    picked = texts.join(F.broadcast(hashed_sample(known, F.col("key"), most)), "key")
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    tokens = F.array_distinct(F.concat(tokens, *(beginnings(tokens, k) for k in PREFIXES)))
    labels_of = [F.col(f"y{i}") for i in range(len(names))]
    picked = picked.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)))
    totals = picked.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(y), F.lit(0.0)) for y in labels_of]).first()
    n = totals[0]
    chain = Chain({}, names)
    if not n:
        chain.models = [Linear(np.zeros(0), np.zeros(i), -30.0) for i in range(len(names))]
        return chain
    held = picked.select(F.explode(tokens).alias("word"), *labels_of).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(f"s{i}") for i, y in enumerate(labels_of)]).filter(F.col("n") >= LEAST_DOCUMENTS)
    gain = F.lit(0.0)
    for i in range(len(names)):
        rate = totals[i + 1] / n
        if 0 < rate < 1:
            gain = F.greatest(gain, (F.coalesce(f"s{i}", F.lit(0.0)) - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate)))
    best = held.orderBy(gain.desc(), "word").limit(VOCABULARY).select("word").collect()
    chain.vocabulary = {r["word"]: i for i, r in enumerate(best)}
    vocabulary = chain.vocabulary

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = count_rows(b.column(0).to_pylist(), vocabulary)
            cuts = np.searchsorted(x.rows, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.words.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.values))], ["key", "fold", *(f"y{i}" for i in range(len(names))), "words", "values"])

    kind = picked.schema["key"].dataType.simpleString()
    ys = ", ".join(f"y{i} double" for i in range(len(names)))
    rows = picked.select("text", "key", "fold", *labels_of).mapInArrow(entries, f"key {kind}, fold long, {ys}, words array<int>, values array<double>").toPandas()
    rows = rows.sort_values("key", kind="stable")
    sizes = rows["words"].map(len).to_numpy()
    x = Counts(np.repeat(np.arange(len(rows)), sizes), np.concatenate([*rows["words"], np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*rows["values"], np.zeros(0)]), len(rows))
    folds, m = rows["fold"].to_numpy(), len(vocabulary)
    unseen = np.zeros((len(rows), 0))
    for i, name in enumerate(names):
        y = rows[f"y{i}"].to_numpy(np.float64)
        known_y = ~np.isnan(y)
        y = np.nan_to_num(y)
        p = np.zeros(len(rows))
        for k in range(FOLDS) if name == rejects or i < len(names) - 1 else ():
            train, test = known_y & (folds != k), folds == k
            p[test] = fit_linear(x.pick(train), unseen[train], y[train], m).probability(x.pick(test), unseen[test])
        chain.models.append(fit_linear(x.pick(known_y), unseen[known_y], y[known_y], m))
        if name == rejects and known_y.any():
            chain.threshold = best_threshold(p[known_y], y[known_y])
        unseen = np.column_stack([unseen, p])
    return chain


def scored(docs: DataFrame, chain: Chain, key: str = "doc_id", column: str = "text", rejects: str = REJECTS) -> DataFrame:
    """key, p_<category>..., toxic (the rejecting category's probability reaches its threshold); a row per input row."""
    at = chain.names.index(rejects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.round(chain.probabilities(count_rows(b.column(1).to_pylist(), chain.vocabulary)), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(p[:, at] >= chain.threshold)], ["key", *(f"p_{n}" for n in chain.names), "toxic"])

    rows = docs.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kinds = ", ".join(f"p_{n} double" for n in chain.names)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {kinds}, toxic boolean").withColumnRenamed("key", key)


def clean(docs: DataFrame, chain: Chain, column: str = "text", rejects: str = REJECTS) -> DataFrame:
    """The rows of docs that the chain does not reject, with all their columns; no shuffle."""
    at = chain.names.index(rejects)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        p = np.round(chain.probabilities(count_rows(list(texts), chain.vocabulary)), 6)
        return pd.Series(p[:, at] >= chain.threshold)

    return docs.filter(~toxic(F.col(column).cast("string")))

"""Operator 2: toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic examples and unlabelled text with the class-prior-corrected,
non-negative risk estimator (Kiryo et al., 2017): with loss l, prior p, positives P and unlabelled U,
    risk = p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g)),
and where the second term would go below zero, its gradient is followed the other way.

Features of a text: its words and word beginnings, each as presence and as rate. The model is fitted on a bounded sample
(MAX_POSITIVE confirmed toxic rows, MAX_UNLABELLED rows of any kind, both chosen by a hash of doc_id); every whole text is scored in one
pass without a shuffle. Labels are used only from the training fold; labels, lang, source and doc_id are no features.

Defined results: a null or empty text has no features and gets the score of the bias alone; without any confirmed toxic
training row every score is 0; repeated rows score alike; extra columns are ignored (kept by `keep`).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import pick, stream, stream_task

MAX_POSITIVE = 3000
MAX_UNLABELLED = 12000
#: Vocabulary of the classifier; each entry has a presence and a rate feature.
VOCABULARY = 384
#: Least number of positive sample rows with an entry.
LEAST_ROWS = 3
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
EPOCHS = 300

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def entries(word: str) -> list[str]:
    """A word and its proper beginnings; beginnings carry a mark so that they cannot equal a word."""
    return [word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float
    empty: bool = False
    memory: dict = field(default_factory=dict, repr=False)

    def features(self, text: str) -> tuple[list[int], list[float]]:
        """Indices and values: presence at i, rate (ten times, 1 at most) at i + size of the vocabulary."""
        counts, memory, found = word_counts(text), self.memory, {}
        for w, c in counts.items():
            hit = memory.get(w)
            if hit is None:
                if len(memory) > 500_000:
                    memory.clear()
                hit = memory[w] = tuple(self.vocabulary[e] for e in entries(w) if e in self.vocabulary)
            for i in hit:
                found[i] = found.get(i, 0) + c
        n = sum(counts.values())
        at = sorted(found)
        return [*at, *[i + len(self.vocabulary) for i in at]], [*[1.0] * len(at), *[min(1.0, 10 * found[i] / n) for i in at]]

    def score(self, text: str) -> float:
        if self.empty:
            return 0.0
        at, values = self.features(text)
        z = self.bias + float(np.dot(self.weights[at], values))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(positive.shape[1], np.float32), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, epochs + 1):
        gp, gu = sigmoid(positive @ w + b), sigmoid(unlabelled @ w + b)
        # l(-g) = log(1 + e^g), whose slope is sigmoid(g); l(g) = log(1 + e^-g), slope sigmoid(g) - 1
        negative = np.mean(-np.log1p(-np.minimum(gu, 1 - 1e-7))) - prior * np.mean(-np.log1p(-np.minimum(gp, 1 - 1e-7)))
        down_p, down_u = -prior * gp / len(gp), gu / len(gu)
        if negative < 0:
            slope_p, slope_u = -down_p, -down_u
        else:
            slope_p, slope_u = prior * (gp - 1) / len(gp) + down_p, down_u
        grad = np.append(slope_p @ positive + slope_u @ unlabelled + l2 * w, slope_p.sum() + slope_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fit on the training fold. prior: share of toxic text; by default the share among labelled training rows."""
    docs = pick(docs, ("doc_id", "long"), ("text", "string"))
    known = pick(labels, ("doc_id", "long"), ("toxic", "int")).filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return Model({}, np.zeros(0, np.float32), 0.0, empty=True)
    prior = min(0.9, max(1e-3, prior or toxic / n))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    positive = known.filter("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_POSITIVE).withColumn("p", F.lit(1))
    other = docs.filter(~held_out(F.col("doc_id"))).select("doc_id").orderBy(order, "doc_id").limit(MAX_UNLABELLED).distinct().withColumn("p", F.lit(0))
    # at most MAX_POSITIVE + MAX_UNLABELLED pairs of numbers: bounded, so broadcast
    # one row of each: repeated ids do not make the sample larger
    sample = docs.join(F.broadcast(positive.unionByName(other)), "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text")).select("doc_id", "text", "p")

    def count(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        seen: dict[str, list[int]] = {}
        rows = [0, 0]
        for _, texts, ps in slices:
            for t, p in zip(texts, ps):
                rows[p] += 1
                for e in {e for w in word_counts(t or "") for e in entries(w)}:
                    seen.setdefault(e, [0, 0])[p] += 1
        yield [("", rows[1], rows[0]), *[(e, c[1], c[0]) for e, c in seen.items()]]

    totals = stream_task(sample, count, "entry string, p long, u long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    row = totals.filter("entry = ''").first()
    if not row or not row["p"]:
        return Model({}, np.zeros(0, np.float32), 0.0, empty=True)
    n_p, n_u = row["p"], max(1, row["u"])
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share * 0.999))
    best = totals.filter((F.col("entry") != "") & (F.col("p") >= LEAST_ROWS)).select("entry", z.alias("z")).filter("z > 0").orderBy(F.desc("z"), "entry").limit(VOCABULARY).collect()
    model = Model({r["entry"]: i for i, r in enumerate(best)}, np.zeros(0, np.float32), 0.0)
    size = len(model.vocabulary)

    def featurize(ids: list, texts: list, ps: list) -> Iterator[tuple]:
        for t, p in zip(texts, ps):
            yield p, *model.features(t or "")

    rows = stream(sample, featurize, "p int, at array<int>, v array<float>").collect()  # bounded by the sample and the vocabulary
    x = np.zeros((len(rows), 2 * size), np.float32)
    for k, r in enumerate(rows):
        x[k, r["at"]] = r["v"]
    is_p = np.array([r["p"] == 1 for r in rows], bool)
    order = np.lexsort(x.T[::-1][: min(64, 2 * size)]) if size else np.arange(len(rows))  # sums do not depend on task order
    x, is_p = x[order], is_p[order]
    model.weights, model.bias = fit_nnpu(x[is_p], x[~is_p] if (~is_p).any() else x[:0].reshape(0, x.shape[1]), prior) if (~is_p).any() else (np.zeros(2 * size, np.float32), 0.0)
    model.memory = {}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            s = model.score(t or "")
            yield i, s, int(s >= 0.5)

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, that are not predicted toxic."""
    at = docs.columns.index("text")

    def run(*cols: list) -> Iterator[tuple]:
        for row in zip(*cols):
            if model.score(row[at] or "") < 0.5:
                yield row

    return stream(docs, run, docs.schema)

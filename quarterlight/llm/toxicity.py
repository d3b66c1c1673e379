"""Toxicity from bags of subwords.

A word is the mean of the vectors of its character n-grams, hashed into ``BUCKETS`` rows (bytes of the word between
two spaces); a text is the mean of its different words, so that repetition doesn't drown the rest; a linear softmax tells toxic from clean.  Vectors and softmax are
trained together in numpy, so that misspellings not seen in training get the vectors of the n-grams they share.
In scoring, the softmax is applied to the vectors first: each bucket is then one number.

Fitted on at most ``TOXIC`` and ``CLEAN`` labelled documents, taken by the hash of their id, of ``LONGEST`` characters at most;
the share of toxic documents among all labels corrects for that choice.  Scoring covers every text.  Defined
results: a text without words, a null one too, gets that share as its score; repeated rows are scored each on its own;
only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.line_field import bounded, fit_curve, scored

BUCKETS, SIZES, DIMENSIONS, EPOCHS, DAMPING = 1 << 17, (3, 4, 5, 6), 8, 150, 5e-4
TOXIC, CLEAN, LONGEST = 1000, 1600, 50_000
#: Words that are counted besides a text's own and lean to neither side, so that a few words don't decide alone.
NEUTRAL = 6
#: ASCII characters that aren't letters or digits separate words; other bytes stay.
_SPLIT = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and weight of every n-gram; the weights of a word sum to one over the number of words and ``NEUTRAL``."""
    raw = b" ".join([b"", *dict.fromkeys((text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()), b""])
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    space = a == 32
    words = int(space.sum()) - 1
    if words < 1:
        return np.empty(0, np.int64), np.empty(0)
    word_at = np.cumsum(space) - 1  # of each byte; a space belongs to the word after it
    keys, owners = [], []
    for n in SIZES:
        m = len(a) - n + 1
        if m < 1:
            continue
        key = np.full(m, n, np.uint32)
        inner = np.zeros(m, bool)
        for i in range(n):
            key = (key ^ a[i : i + m]) * np.uint32(0x01000193)
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        keep = ~inner
        key ^= key >> np.uint32(15)
        keys.append((key * np.uint32(0x85EBCA6B))[keep] >> np.uint32(32 - 17))
        owners.append(word_at[:m][keep])
    key, owner = np.concatenate(keys).astype(np.int64), np.concatenate(owners)
    grams = np.bincount(owner, minlength=words)
    return key, 1.0 / (np.maximum(grams, 1)[owner] * (words + NEUTRAL))


@dataclass
class Model:
    """One number for each bucket, the intercept, and the share of toxic documents."""

    numbers: np.ndarray
    intercept: float
    prior: float

    def score(self, text: str | None) -> float:
        key, weight = subwords(text)
        if not len(key):
            return self.prior
        return float(bounded((self.numbers[key] * weight).sum() + self.intercept))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, float]:
    """The softmax's difference for each bucket, and its intercept."""
    rows, columns, values = [], [], []
    for i, text in enumerate(texts):
        key, weight = subwords(text)
        unique, inverse = np.unique(key, return_inverse=True)
        columns.append(unique.astype(np.int32))
        values.append(np.bincount(inverse, weight, len(unique)).astype(np.float32))
        rows.append(np.full(len(unique), i, np.int32))
    row, column, value = map(np.concatenate, (rows, columns, values))
    del rows, columns, values
    # An n-gram is worth learning if it occurs in three documents at least.
    often = np.bincount(column, minlength=BUCKETS) >= 3
    keep = often[column]
    # Averages are small where few words matter; scaling them keeps the steps alike.
    row, column, value = row[keep], column[keep], value[keep] * np.float32(100)
    n, y = len(texts), np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (DIMENSIONS, BUCKETS)).astype(np.float32)
    softmax = rng.normal(0, 1, (2, DIMENSIONS)).astype(np.float32)
    softmax /= np.linalg.norm(softmax[1] - softmax[0])
    shift = np.zeros(2, np.float32)
    # Steps follow the evidence: they are divided by a bound of the curvature, damped so that rare n-grams stay small.
    curvature = np.bincount(column, value * value, BUCKETS).astype(np.float32) / (4 * n) + DAMPING
    moving = [np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(shift)]
    for _ in range(epochs):
        # With two classes, logits need only each bucket's difference, and all gradients only the error that falls on it.
        apart = softmax[1] - softmax[0]
        logits = np.bincount(row, (apart @ vectors)[column] * value, n) + (shift[1] - shift[0])
        error = ((bounded(logits) - y) / n).astype(np.float32)
        fallen = np.bincount(column, error[row] * value, BUCKETS).astype(np.float32)
        pull = vectors @ fallen
        gradients = (
            np.outer(apart, fallen) + 0.1 * DAMPING * vectors,
            np.stack([-pull, pull]) + 1e-3 * softmax,
            np.array([-error.sum(), error.sum()]),
        )
        for p, g, m, rate in zip((vectors, softmax, shift), gradients, moving, (0.02 / curvature, 0.01, 0.5)):
            m *= 0.9
            m += g
            p -= rate * m
    numbers = (softmax[1] - softmax[0]) @ vectors * 100
    numbers[~often] = 0
    return numbers.astype(np.float64), float(shift[1] - shift[0])


def fitted(texts: list[str], labels: list[int], prior: float) -> Model:
    """Every fifth text is kept from the fit; on those, a logistic curve is laid over the logits."""
    kept = [i for i in range(len(texts)) if i % 5 == 0]
    rest = [i for i in range(len(texts)) if i % 5]
    y = np.array([labels[i] for i in kept], float)
    base = float(np.log(prior / (1 - prior)))
    if len(set(y)) < 2 or len({labels[i] for i in rest}) < 2:
        return Model(np.zeros(BUCKETS), base, prior)
    numbers, shift = fit([texts[i] for i in rest], [labels[i] for i in rest])
    logits = []
    for i in kept:
        key, weight = subwords(texts[i])
        logits.append((numbers[key] * weight).sum() + shift)
    a, b = fit_curve(np.array(logits), y)
    share = float(y.mean())
    return Model(b * numbers, a + b * shift + base - float(np.log(share / (1 - share))), prior)


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, longest: int = LONGEST) -> Model:
    """``labels``: doc_id and label (0 or 1) that may be learned from."""
    labels = labels.filter("label in (0, 1) and doc_id is not null")
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = labels.filter("label = 1").orderBy(*order).limit(toxic).union(labels.filter("label = 0").orderBy(*order).limit(clean))
    # At most so many rows of two numbers: small enough to broadcast, whatever the tables' sizes.
    rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    got = sorted((r["doc_id"], r["text"], int(r["label"])) for r in rows.select("doc_id", "label", "text").collect())
    return fitted([r[1] for r in got], [r[2] for r in got], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; the model, of fixed size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda text: sent.value.score(text))

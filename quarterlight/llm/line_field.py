"""Document quality from a linear-chain conditional random field over lines.

Every line gets surface features of its own and of its neighbours; the field labels the lines of a document good or
bad together, and the length-weighted mean of the forward-backward marginals is the document's quality, which a
logistic curve turns into a probability.  Only documents carry labels: lines start with their document's label, and
after a first fit the lines of bad documents keep it only where the field agrees.

Fitted in numpy on at most ``SAMPLE`` labelled documents, taken by the hash of their id; only their features come to
the driver.  Scoring covers every text.  Defined results: a null, empty or blank text has no lines and gets the
share of good documents in the sample; repeated rows are scored each on its own; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import map_rows

SAMPLE, TRAIN_LINES, ROUNDS = 2000, 48, 60
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = (b"#*$%&<>{}[]\\^~_=+@", b"|", b"!", b"0123456789", b".,;:?", _UPPER, b"\"'()-/")
OWN = len(_CLASSES) + 9


def line_features(line: str) -> tuple:
    words = line.split()
    k, raw = len(words), line.encode("utf-8", "replace")
    ink = sum(map(len, words))
    n = len(raw)
    shares = [(n - len(raw.translate(None, c))) / n for c in _CLASSES]
    return (
        *shares, math.log(k), math.log(ink), ink / k / 10, len(set(words)) / k, sum(map(eq, words, words[1:])) / k, float(words[0][0].isupper()),
        float(words[-1][-1] in ".!?:;\"'"), sum(w[-1] in "*$%&#!" for w in words) / k, 1.0,
    )


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line with a word, with its neighbours' features beside its own; and the lines' lengths."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.empty((0, WIDTH)), np.empty(0)
    own = np.array([line_features(x) for x in lines])
    none = np.zeros((1, OWN))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    repeated = np.array([[0.0], *[[float(a == b)] for a, b in zip(lines, lines[1:])]])
    return np.hstack([own, before, after, repeated]), np.array([len(x) for x in lines], float)


WIDTH = 3 * OWN + 1


@dataclass
class Field:
    """Weights for good against bad, transitions [from, to], scaling of the features, curve of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]
    prior: float

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of good, for each line."""
        lean = ((features - self.mean) / self.scale) @ self.weights
        odds = np.exp(np.clip(lean, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        n, forward, backward = len(odds), [], [0.5] * len(odds)
        good = None
        for o in odds:
            b, g = (1.0, o) if good is None else ((1 - good) * bb + good * gb, ((1 - good) * bg + good * gg) * o)
            good = g / (b + g)
            forward.append(good)
        good = 0.5
        for t in range(n - 2, -1, -1):
            g0, b0 = good * odds[t + 1], 1 - good
            b, g = bb * b0 + bg * g0, gb * b0 + gg * g0
            good = g / (b + g)
            backward[t] = good
        f, r = np.array(forward), np.array(backward)
        return f * r / np.maximum(f * r + (1 - f) * (1 - r), 1e-300)

    def quality(self, text: str | None) -> float:
        features, lengths = document_features(text)
        if not len(lengths):
            return self.prior
        return float(bounded(self.curve[0] + self.curve[1] * logit(self.marginals(features) @ lengths / lengths.sum())))


def bounded(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the conditional likelihood; chains are cut at ``TRAIN_LINES``."""
    pieces = [(x[a : a + TRAIN_LINES], y[a : a + TRAIN_LINES]) for x, y in chains for a in range(0, len(x), TRAIN_LINES)]
    pieces.sort(key=lambda p: -len(p[0]))
    n, longest, width = len(pieces), len(pieces[0][0]), pieces[0][0].shape[1]
    x, y = np.zeros((longest, n, width), np.float32), np.zeros((longest, n), np.int64)
    alive = np.array([[t < len(p[0]) for p in pieces] for t in range(longest)])
    for i, (a, b) in enumerate(pieces):
        x[: len(a), i], y[: len(b), i] = a, b
    lines, both = alive.sum(), alive[1:] & alive[:-1]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:-1][both], y[1:][both]), 1)
    params = np.zeros(width + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, moves = params[:width], params[width:].reshape(2, 2)
        emit = np.stack([np.zeros((longest, n)), x @ w], axis=2)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = emit[0]
        for t in range(1, longest):
            alpha[t] = emit[t] + np.logaddexp(alpha[t - 1][:, :1] + moves[0], alpha[t - 1][:, 1:] + moves[1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[t + 1] + beta[t + 1]
            back = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[t] = np.where(alive[t + 1][:, None], back, 0)
        joint = alpha + beta
        total = np.logaddexp(joint[..., 0], joint[..., 1])
        good = np.exp(joint[..., 1] - total)
        pair = alpha[:-1, :, :, None] + moves[None, None] + (emit[1:] + beta[1:])[:, :, None, :] - total[1:, :, None, None]
        expected = np.exp(np.where(both[..., None, None], pair, -np.inf)).sum(axis=(0, 1))
        gap = np.where(alive, y - good, 0).astype(np.float32)
        gradient = np.concatenate([np.tensordot(gap, x, 2), (seen_moves - expected).ravel()]) / lines - penalty * params
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params = params + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params[:width], params[width:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Logistic regression on one input, by Newton steps with a small penalty."""
    a, b = 0.0, 1.0
    design = np.stack([np.ones_like(x), x])
    for _ in range(rounds):
        p = bounded(a + b * x)
        gradient = design @ (y - p) - np.array([0.0, 0.1 * b])
        hessian = (design * (p * (1 - p) + 1e-6)) @ design.T + np.diag([1e-3, 0.1])
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """examples: features, line lengths and label of each document."""
    prior = (sum(y for *_, y in examples) + 1) / (len(examples) + 2)
    used = [e for e in examples if len(e[1])]
    if not used or len({y for *_, y in used}) < 2:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH), (float(logit(prior)), 0.0), prior)
    every = np.vstack([x for x, *_ in used])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    scaled = [(x - mean) / scale for x, *_ in used]
    labels = [np.full(len(n), y) for _, n, y in used]
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)), mean, scale, (0.0, 1.0), prior)
    for turn in range(2):
        field.weights, field.moves = fit_chain(list(zip(scaled, labels)))
        if turn == 0:
            for i, (x, _, y) in enumerate(used):
                if y == 0:
                    p = field.marginals(x)
                    labels[i] = (p > max(0.5, p.min())).astype(int)
    means = np.array([field.marginals(x) @ n / n.sum() for x, n, _ in used])
    field.curve = fit_curve(logit(means), np.array([y for *_, y in used], float))
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """``labels``: doc_id and label (0 or 1) that may be learned from; the sample is the first by the ids' hashes."""
    chosen = labels.filter("label is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: small enough to broadcast, whatever the tables' sizes.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(rows):
        for doc_id, text, label in rows:
            x, n = document_features(text)
            yield doc_id, int(label), x.astype(np.float32).tobytes(), n.astype(np.float32).tobytes()

    got = map_rows(rows.select("doc_id", "text", "label"), run, "doc_id long, label int, x binary, n binary").collect()
    got.sort(key=lambda r: (r[0], r[2]))
    return fit([(np.frombuffer(r[2], np.float32).reshape(-1, WIDTH).astype(float), np.frombuffer(r[3], np.float32).astype(float), r[1]) for r in got])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of every document."""
    return scored(docs, field.quality)


def scored(docs: DataFrame, of_text: Callable[[str | None], float]) -> DataFrame:
    def run(rows):
        for doc_id, text in rows:
            yield doc_id, of_text(text)

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")


def verdicts(scores: DataFrame, modulus: int, held: int, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; ``held`` is the remainder whose labels were not learned from."""
    return scores.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def remainder(doc_id, modulus: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus

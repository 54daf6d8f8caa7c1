"""Quality classifier: naive Bayes support vectors on n-gram indicators.

A text's features are the distinct hashed byte n-grams it holds, its distinct hashed words, and n-grams of which words repeat one just
before. On a bounded sample of labelled rows the
log-count ratio of each feature between the classes is taken; indicators scaled by it, at unit length, are the input of a linear
classifier with hinge loss, fitted by dual coordinate descent. A logistic curve fitted on rows left out of the descent turns margins
into scores. Scoring reads whole texts and runs as one Arrow map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import crc_text, with_arrow_columns
from strandlake.llm.shingles import word_hashes

#: Labelled rows per class that the fit takes at most (those whose doc_id hashes lowest): the bound of what reaches the driver.
ROWS_PER_CLASS = 2000
#: Features: byte pairs, hashed byte triples, hashed words, and patterns of repeated words.
WIDTH = (2 << 16) + (1 << 15) + (1 << 10)
#: Passes of the descent and its cost bound.
PASSES, COST = 12, 1.0


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct features of each text, sorted."""
    words, bounds = word_hashes(texts)
    seen = np.zeros(WIDTH, bool)
    out = []
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        data = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
        two = (data[:-1] << 8) + data[1:]
        seen[two] = True
        three = ((two[:-1] << 8) + data[2:]) * 0x9E3779B1
        seen[((three >> 16) & 0xFFFF) + (1 << 16)] = True
        if b > a:
            w = words[a:b]
            seen[(w & np.uint64(0x7FFF)).astype(np.int64) + (2 << 16)] = True
            # n-grams of whether a word repeats the one, two or three before: bit patterns over 2, 4 and 8 words
            bits = np.zeros(len(w), np.int64)
            for back in (1, 2, 3):
                bits[back:] |= w[back:] == w[:-back]
            for n in (1, 2, 4):
                bits = bits[:-n] | (bits[n:] << n)
                seen[bits + (2 << 16) + (1 << 15) + (1 << 2 * n)] = True
        hit = np.flatnonzero(seen)
        seen[hit] = False
        out.append(hit)
    return out


def _flat(texts: list[str | None]) -> list[np.ndarray]:
    """The same as 32-bit numbers in one piece of memory, which is given back as a whole."""
    parts, sizes = [], []
    for i in range(0, len(texts), 128):
        got = features(texts[i : i + 128])
        sizes += [len(f) for f in got]
        parts.append(np.concatenate(got).astype(np.int32))
    return np.split(np.concatenate(parts), np.cumsum(sizes)[:-1])


@dataclass
class Model:
    weights: np.ndarray  # of plain indicators: ratio times fitted weight
    ratios: np.ndarray  # squared, for the length
    slope: float
    shift: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, f in enumerate(features(texts)):
            norm = np.sqrt(self.ratios[f].sum())
            out[i] = self.weights[f].sum() / norm if norm else 0.0
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, passes: int, seed: int = 1) -> np.ndarray:
    """Weights of the linear classifier with hinge loss: each step solves one row's dual variable within [0, cost].

    There is no intercept: a text with few features should stay near what is usual, which the logistic curve's shift says.
    """
    w = np.zeros(width)
    alpha = np.zeros(len(y))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            if not norm[i]:
                continue
            slope = y[i] * (w[f] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[f] += d * v
                alpha[i] = new
                largest = max(largest, abs(d))
        if largest < 1e-4:
            break
    return w


def fit(texts: list[str | None], labels: list[int], prior: float, passes: int = PASSES) -> Model:
    """Model from labelled texts; prior is the share of label 1 among all labelled rows (the sample may be balanced).

    With one class only, or without rows, every score is about that class's share.
    """
    y = np.where(np.array(labels, int) == 1, 1, -1) if labels else np.zeros(0, int)
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        share = min(0.99, max(0.01, (n1 + 1) / (n1 + n0 + 2)))
        return Model(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, float(np.log(share / (1 - share))))
    rows = _flat(texts)
    left = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    if len(set(y[~left])) < 2 or (left.any() and len(set(y[left])) < 2):
        left[:] = False
    train = np.flatnonzero(~left)
    counts = {s: 1.0 + np.bincount(np.concatenate([rows[i] for i in train if y[i] == s] or [np.zeros(0, int)]), minlength=WIDTH) for s in (1, -1)}
    ratio = np.log(counts[1] / (1 + (y[train] > 0).sum())) - np.log(counts[-1] / (1 + (y[train] < 0).sum()))
    ends = np.cumsum([len(f) for f in rows])
    flat = np.empty(int(ends[-1]), np.float32)
    values = np.split(flat, ends[:-1])
    for f, v in zip(rows, values):
        v[:] = ratio[f]
        v /= np.sqrt(v @ v) or 1.0
    share = {1: n1 / len(y), -1: n0 / len(y)}
    cost = np.array([COST * 0.5 / share[int(s)] for s in y[train]])
    w = dual_descent([rows[i] for i in train], [values[i] for i in train], y[train], cost, WIDTH, passes)
    margin = np.array([w[f] @ v for f, v in zip(rows, values)])
    held = np.flatnonzero(left) if left.any() else np.arange(len(y))
    slope, shift = _logistic(margin[held], y[held] > 0, prior, share[1])
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), slope, shift)


def _logistic(m: np.ndarray, positive: np.ndarray, prior: float, share: float) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, rows weighted so that label 1 has the prior's weight."""
    prior = min(0.99, max(0.01, prior))
    n = np.where(positive, prior / share, (1 - prior) / (1 - share))
    goal = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    x = np.stack([m, np.ones(len(m))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (goal - q)) - 1e-3 * w)
        w += step / max(1.0, np.abs(step).max() / 5)
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id is not."""
    return F.coalesce(F.pmod(crc_text(doc_id), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Model from at most rows_per_class labelled rows of each class.

    Learned from: rows of labels (doc_id, quality) with one known quality, not held out, and a row of docs. A doc_id with contradicting
    labels is left out; of a doc_id on several rows the smallest text counts, nulls last. Whole texts of the sample reach the driver: rows are bounded, bytes are not.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    shares = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for q in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * rows_per_class rows
    got = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).collect()
    return fit([r.text for r in got], [r.quality for r in got], shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. Null and empty texts get the score of a text without features, equal texts equal scores; long ones count whole. A column of that
    name is replaced; an empty table gives no rows."""

    def make():
        return lambda texts: [model.scores(texts).tolist()]

    return with_arrow_columns(docs, text, [T.StructField(column, T.DoubleType())], make)

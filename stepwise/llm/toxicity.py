"""Toxicity by non-negative positive-unlabelled learning.

The classifier knows confirmed toxic texts and unlabelled ones, never confirmed clean
ones. With the class prior p, the risk of calling everything unlabelled clean is corrected
by the part of it that toxic texts make up: p R+(toxic) + max(0, R-(unlabelled) -
p R-(toxic)). Where the second term turns negative, the step goes the other way, so that
it isn't driven below zero. The model is logistic over the presence of words and byte
n-grams that toxic texts hold significantly more often than unlabelled ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .grams import draw, frequencies, lowered, matrix, numbering, presence, remainder

#: Whole words (0) and n-grams of so many bytes.
SIZES = (0, 4, 5, 8)
WIDTH = 1536
#: The least likelihood ratio statistic of an n-gram that is used: one in two thousand by chance.
EVIDENCE = 12.0
#: The least estimated share of toxic texts among those that hold such an n-gram.
SHARE = 0.6
#: The documented bound of the training sample: expected rows, expected characters of each of
#: its two groups, and the longest text in it.
POSITIVES, UNLABELLED, CHARACTERS, LONGEST = 2000, 4000, 1 << 25, 60_000
#: Texts up to so many bytes are not damped.
PLAIN = 3000
THRESHOLD = 0.7
STEPS, RATE = 300, 0.05
#: Weight decay, for each toxic text of the sample.
DECAY = 0.04


@dataclass
class Model:
    columns: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        seen = presence(data, starts, SIZES, self.columns, len(self.weights))
        return sigmoid(damping(np.diff(starts)) * (seen @ self.weights) + self.offset)


def damping(size: np.ndarray) -> np.ndarray:
    """What features of a text of ``size`` bytes count: long texts hold more of them by chance."""
    return np.sqrt(np.minimum(1, PLAIN / np.maximum(size, 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk_step(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the non-negative risk by the two groups' outputs, and the risk.

    The loss is logistic: of calling an output g toxic log(1 + exp(-g)), clean log(1 + exp(g)).
    """
    clean = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, toxic).mean()
    right = prior * np.logaddexp(0, -toxic).mean()
    if clean >= 0:
        return -prior * sigmoid(-toxic) / len(toxic) - prior * sigmoid(toxic) / len(toxic), sigmoid(unlabelled) / len(unlabelled), right + clean
    return prior * sigmoid(toxic) / len(toxic), -sigmoid(unlabelled) / len(unlabelled), right


def surprise(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio statistic of a/n > b/m against one common rate; 0 where a/n is not larger."""
    rate = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * sum(np.where(x > 0, x * np.log(x / (k * rate)), 0) + np.where(x < k, (k - x) * np.log((k - x) / (k * (1 - rate))), 0) for x, k in ((a, n), (b, m)))
    return np.where(a * m > b * n, np.nan_to_num(out), 0)


def fit(toxic: list[str], unlabelled: list[str], prior: float) -> Model:
    """Learn from lowered texts; without toxic or unlabelled ones everything scores 0."""
    if not toxic or not unlabelled:
        return Model(numbering(np.empty(0, int)), np.zeros(1, np.float32), -30.0)
    prior = min(max(prior, 1e-3), 0.5)
    a, b = frequencies(toxic, SIZES), frequencies(unlabelled, SIZES)
    gain = surprise(a, len(toxic), b, len(unlabelled))
    # By the prior, of the texts that hold such an n-gram a fair part must be toxic.
    gain[prior * a * len(unlabelled) < SHARE * b * len(toxic)] = 0
    chosen = np.argsort(-gain, kind="stable")[:WIDTH]
    chosen = chosen[gain[chosen] >= EVIDENCE]
    width = max(1, len(chosen))
    columns = numbering(chosen)
    p, u = matrix(toxic, SIZES, columns, width), matrix(unlabelled, SIZES, columns, width)
    for rows, texts in ((p, toxic), (u, unlabelled)):
        rows *= damping(np.array([len(t.encode()) for t in texts]))[:, None].astype(np.float32)
    w, offset = np.zeros(width), -1.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        dp, du, _ = risk_step(p @ w.astype(np.float32) + offset, u @ w.astype(np.float32) + offset, prior)
        slope = np.append(p.T @ dp.astype(np.float32) + u.T @ du.astype(np.float32) + DECAY / len(toxic) * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, offset = w - move[:-1], offset - move[-1]
    return Model(columns, w.astype(np.float32), float(offset))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Model:
    """Fit on a bounded, reproducible sample of rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``.

    Rows that repeat both id and text count once.
    """
    allowed = remainder("doc_id", modulus) != held_out
    known = labels.filter(allowed & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & allowed & (F.length("text") <= LONGEST))
    total, length = short.agg(F.count("*"), F.coalesce(F.avg(F.length("text")), F.lit(0.0))).first()
    share = lambda rows, there: min(1.0, rows / max(1, there), CHARACTERS / max(1.0, length * there))
    ids = known.filter((F.col("toxic") == 1) & (draw(seed=1) < F.lit(share(POSITIVES, positive)))).select("doc_id").distinct().limit(2 * POSITIVES)
    toxic = short.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", lowered().alias("text")).distinct().collect()
    other = short.filter(draw(seed=2) < F.lit(share(UNLABELLED, total))).select("doc_id", lowered().alias("text")).distinct().collect()
    ordered = lambda rows: [r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))]
    return fit(ordered(toxic), ordered(other), positive / n if n else 0.0)


def scorer(model: Model):
    """An Arrow-batched function of the lowered text: its score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.scores(data, starts) for _, _, data, starts in text_blocks(pa.array(texts, pa.large_string()), rows=1024)]
        return pd.Series(np.concatenate(parts).astype(float) if parts else np.empty(0))

    return score


def toxicity(model: Model, text: Column | str = "text") -> Column:
    """The score of a text, 0 to 1; a null or empty text has the score of no evidence."""
    return scorer(model)(lowered(text))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) for toxicity.

    Learns from ``labels`` (doc_id, toxic), rows with another remainder than ``held_out``
    only. Equal texts score alike, null texts as empty ones; other columns are ignored. No
    usable label: every score is near 0. No documents: no rows.
    """
    model = train(docs, labels, modulus, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", modulus) == held_out).alias("held_out"), toxicity(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

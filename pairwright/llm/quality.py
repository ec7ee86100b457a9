"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import labelled_sample, shared, train_in_task

BITS = 18
#: A chunk of text without spaces, split in its word and the marks around it.
CHUNK = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Tokens(dict):
    """Chunk -> (hash of its word, hash of its shape), made on demand; cleared when it gets large."""

    def __missing__(self, chunk: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        before, word, after = CHUNK.match(chunk).groups()
        case = "-" if not word else "X" if word.isupper() and len(word) > 1 else "Xx" if word[:1].isupper() else "9" if any(c.isdigit() for c in word) else "x"
        size = min(len(word), 12) // 3
        shape = f"{before[:3]}{case}{size}{after[:3]}"
        self[chunk] = out = (zlib.crc32(word.lower().encode("utf-8", "replace")), zlib.crc32(shape.encode("utf-8", "replace")))
        return out


def features(text: str | None, tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and their weights, which have unit length.

    Words give unigrams and bigrams, shapes (case, size class, marks) give uni-, bi- and trigrams; a word that repeats
    the one before it takes the shape of a repeat. The weight of an n-gram is the root of its count, scaled.
    """
    chunks = (text or "").split()
    if not chunks:
        return np.zeros(1, np.int64), np.ones(1)
    pairs = np.array([tokens[c] for c in chunks], np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = np.uint64(7)
    grams = [word * MIX + np.uint64(1), shape * MIX + np.uint64(2)]
    if len(chunks) > 1:
        grams += [(word[:-1] * MIX + word[1:]) * MIX + np.uint64(3), (shape[:-1] * MIX + shape[1:]) * MIX + np.uint64(4)]
    if len(chunks) > 2:
        grams.append(((shape[:-2] * MIX + shape[1:-1]) * MIX + shape[2:]) * MIX + np.uint64(5))
    parts = []
    for g in grams:  # each kind of n-gram weighs the same
        slots, counts = np.unique(g >> np.uint64(64 - bits), return_counts=True)
        weights = np.sqrt(counts)
        parts.append((slots.astype(np.int64), weights / np.sqrt((weights**2).sum() * len(grams))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, bits: int = BITS, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias) after per-coordinate FTRL-proximal updates in a seeded order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    weights_at = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slots, x = rows[k]
            w = weights_at(slots)
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            error = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - labels[k]
            g = error * x
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            np.add.at(z, slots, g - sigma * w)
            np.add.at(n, slots, g * g)
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb += error * error
    return weights_at(np.arange(1 << bits)), float(-zb / ((beta + np.sqrt(nb)) / alpha))


def fit(sample: pd.DataFrame) -> bytes:
    """The model of a bounded sample (text, y), as bytes; without both classes it gives the smoothed share of ones."""
    tokens = Tokens()
    y = sample["y"].to_numpy(float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return pickle.dumps((np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))))
    weights, bias = train_ftrl([features(t, tokens) for t in sample["text"]], y)
    return pickle.dumps((weights.astype(np.float32), bias))


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> bytes:
    """Trained from at most ``per_class`` labelled documents of each class that aren't held out."""
    return train_in_task(labelled_sample(docs, labels, "quality", {0: per_class, 1: per_class}), fit)


def score_quality(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 if score >= ``threshold``) to every row of ``docs`` (text).

    Only the text counts. Null and empty texts have the score of the bias alone and one fixed feature; rows are kept as
    they are; other columns stay and those of the two names are replaced.
    """
    base = docs.drop("score", "predicted")
    held = shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = pickle.loads(held())
        tokens, out = Tokens(), np.empty(len(texts))
        for i, t in enumerate(texts):
            slots, x = features(t, tokens)
            out[i] = weights[slots] @ x + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    scored = base.withColumn("score", score("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

"""Logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words, mix, segment_sums, slices, tidy

BITS = 16
SIZE = 1 << BITS


def char_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3-grams of each text (joined, line ends included) and where each text's begin. A text
    has as many as characters: each text is seen with two line ends after it."""
    joined = np.frombuffer("".join([t + "\n\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    if not len(joined):
        return np.empty(0, np.uint32), starts
    x = joined * np.uint32(0x9E3779B1)
    h = x.copy()
    h[:-1] ^= (x[1:] << np.uint32(5)) * np.uint32(0x85EBCA6B)
    h[:-2] ^= (x[2:] << np.uint32(11)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS), starts


def word_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, and of each pair of neighbours within a text (the last word's is that of an end). A pair
    of equal words has the one bucket for that, whatever the word."""
    h = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    after = np.concatenate((h[1:], [np.uint64(1)])) if len(h) else h
    last = words.starts[1:][np.diff(words.starts) > 0] - 1
    after[last] = np.uint64(1)
    pair = mix(h * np.uint64(3) ^ mix(after))
    pair[h == after] = np.uint64(7) << np.uint64(64 - BITS)
    top = np.uint64(64 - BITS)
    return (mix(h) >> top).astype(np.int64), (pair >> top).astype(np.int64)


class Features:
    """Three mean-pooled groups of hashed features: words, pairs of words, character 3-grams."""

    def __init__(self, texts: pa.Array):
        raw = [t or "" for t in texts.to_pylist()]
        words = Words(texts)
        self.groups = [(b, words.starts) for b in word_buckets(words)] + [char_buckets(raw)]

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """weights: 3 x SIZE. A text's logit is the bias and the mean weight of each group."""
        out = bias
        for w, (b, starts) in zip(weights, self.groups, strict=True):
            out = out + segment_sums(w[b], starts) / np.maximum(1, np.diff(starts))
        return out


class Pooled:
    """The features of many texts, a slice of them at a time, as sparse rows: for each group, which text has which bucket,
    and with what share of the group's features."""

    def __init__(self, texts: list[str]):
        self.n, own, found = len(texts), pa.array(texts, pa.string()), ([], [], [])
        for begin, n in slices(own, 1 << 20):
            for group, (b, starts) in zip(found, Features(own.slice(begin, n)).groups, strict=True):
                sizes = np.diff(starts)
                key, times = np.unique(np.repeat(np.arange(n) << BITS, sizes) + b, return_counts=True)
                doc = key >> BITS
                group.append(((doc + begin).astype(np.int32), (key & (SIZE - 1)).astype(np.int32), times / sizes[doc]))
        self.groups = [[np.concatenate(x) for x in zip(*group, strict=True)] if group else [np.empty(0, np.int32)] * 2 + [np.empty(0)] for group in found]

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(self.n, float(bias))
        for w, (doc, bucket, share) in zip(weights, self.groups, strict=True):
            out += np.bincount(doc, weights=w[bucket] * share, minlength=self.n)
        return out

    def gradient(self, group: int, d: np.ndarray) -> np.ndarray:
        doc, bucket, share = self.groups[group]
        return np.bincount(bucket, weights=d[doc] * share, minlength=SIZE)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Calibrated log-odds that the label is 1."""
        return Features(texts).logits(self.weights, self.bias) * self.slope + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (positive) and shift of a one-feature logistic regression with a small ridge, by Newton's method with
    halved steps; targets are smoothed as Platt does."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    middle, spread = float(np.average(x, weights=weight)), float(np.sqrt(np.average((x - np.average(x, weights=weight)) ** 2, weights=weight))) or 1.0
    z = (x - middle) / spread

    def loss(a: float, b: float) -> float:
        return float((weight * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum() + 0.005 * (a * a + b * b))

    mean = float(np.average(t, weights=weight))
    a, b = 0.0, float(np.log(mean / (1 - mean)))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        d, v = (p - t) * weight, np.maximum(p * (1 - p), 1e-9) * weight
        g = np.array([(d * z).sum() + 0.01 * a, d.sum() + 0.01 * b])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-4 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    a = max(a, 1e-3)
    return float(a / spread), float(b - a * middle / spread)


def fit(rows: list[tuple[str, int]], prior: float | None = None, epochs: int = 80, rate: float = 0.5) -> Model:
    """Fits on (text, 0 or 1) rows with both classes given equal weight, then calibrates on every fifth row, which the
    fit leaves out. prior: the share of label 1 to calibrate for; the rows' own, if None. Without rows of both classes
    the model says the share of ones, or 1 without any rows: nothing is known against a text then."""
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((3, SIZE)), 20.0 if not len(y) or y[0] else -20.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = Pooled([r[0] for r, h in zip(rows, held, strict=True) if not h])
    t = y[~held]
    balance = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    weights, bias, seen = np.zeros((3, SIZE)), 0.0, np.full((3, SIZE), 1e-8)
    for _ in range(epochs):
        d = (sigmoid(train.logits(weights, bias)) - t) * balance
        bias -= rate * float(d.sum())
        for k in range(len(weights)):
            g = train.gradient(k, d) + 1e-7 * weights[k]
            seen[k] += g * g
            weights[k] -= rate * g / np.sqrt(seen[k])
    rest = [r for r, h in zip(rows, held, strict=True) if h] or rows
    x, t = Pooled([r[0] for r in rest]).logits(weights.astype(np.float32), bias), np.array([r[1] for r in rest], np.float64)
    share = prior if prior is not None else y.mean()
    w = np.where(t == 1, share / max(1, t.sum()), (1 - share) / max(1, (1 - t).sum())) * len(t)
    tidy()
    return Model(weights, bias, *platt(x, t, w))

"""Toxicity: maximal scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, in_arrow, label_share, labelled, mix, read, remainder, slices, tidy
from .hashed import platt, sigmoid

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Marks that don't count as part of a word.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”‘’…¿¡–—"
#: Lengths of the beginnings of a word whose evidence stands in where a word's own says nothing.
HEADS = (3, 4, 5, 6, 7)


def plain(word: str) -> str:
    return word.strip(MARKS).lower()


def units(word: str) -> list[str]:
    """What a word is evidence for: itself, and its beginnings (marked with a trailing star)."""
    return [word, *[word[:n] + "*" for n in HEADS if len(word) > n]]


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) of the sequence scores - drift, as (begin, end, score), in
    order. Linear time; the stretches of tokens without positive score are skipped by their sums."""
    total = np.concatenate(([0.0], np.cumsum(scores - drift)))
    found: list[tuple] = []  # begin, end, sum before, sum after, the last earlier one whose sum before is less
    for k in np.flatnonzero(scores > drift).tolist():
        begin, end, before, after = k, k + 1, total[k], total[k + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((begin, end, before, after, j))
                break
            begin, before = found[j][0], found[j][2]
            del found[j:]
    return [(f[0], f[1], float(f[3] - f[2])) for f in found]


class Model:
    """weights: unit to log-odds. decay, constant: lambda and K of the extreme-value law of the best segment in clean
    text of a given length. slope, shift: from minus log p-value to log-odds of the label."""

    def __init__(self, weights: dict[str, float], drift: float, decay: float, constant: float, slope: float, shift: float):
        self.weights, self.drift, self.decay, self.constant, self.slope, self.shift = weights, drift, decay, constant, slope, shift
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 200_000:
                self.known.clear()
            own, get = plain(word), self.weights.get
            w = get(own, 0.0) if own else 0.0
            if not w and own:
                w = max((get(u, 0.0) for u in units(own)[1:]), default=0.0)
            self.known[word] = w
        return w

    def scored(self, texts: pa.Array) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
        """The maximal segments of each text, and how many words it has."""
        words = Words(texts)
        w = np.array([self.weight(x) for x in words.vocabulary.to_pylist()], np.float64)
        each = w[words.codes] if len(words.codes) else np.empty(0)
        return [segments(each[a:b], self.drift) for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)], words.counts

    def surprise(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log10 of the chance that a clean text of n words has segments like these: of Karlin and Altschul's
        law for the sums of the r best segments, the least likely r."""
        best = np.sort([s for _, _, s in found])[::-1]
        if not len(best):
            return 0.0
        total, log_r = np.cumsum(self.decay * best - np.log(self.constant * max(n, 20))), np.log(np.arange(1, len(best) + 1))
        e = min(700.0, float(total[0]))
        least = min(0.0, float(np.log(-np.expm1(-np.exp(-e))) if e < 30 else -e))
        log_p = -total + np.arange(len(best)) * np.log(np.maximum(total, 1e-9)) - 2 * np.cumsum(log_r) + log_r
        more = log_p[1:][total[1:] > 0]
        return min(40.0, -min(least, float(more.min(initial=0.0))) / np.log(10))

    def logits(self, texts: pa.Array) -> np.ndarray:
        return self.judged(*self.scored(texts))

    def judged(self, found: list[list[tuple[int, int, float]]], n: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of label 1 from the segments and the counts of words."""
        return np.array([self.slope * self.surprise(f, int(k)) + self.shift for f, k in zip(found, n, strict=True)])


def unlike(rows: list[tuple[str, int]], hashes: int = 12, least: int = 4) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones of the same label: those that agree in `least` of some minimum
    hashes of four-word shingles. Copies of a text are evidence once."""
    seen: dict[tuple[int, int, int], int] = {}
    out = []
    for text, y in rows:
        words = Words(pa.array([text], pa.string()))
        h = words.hashes()[words.codes] if len(words.codes) else np.zeros(1, np.uint64)
        n = max(1, len(h) - 3)
        grams = mix(h[:n] + np.uint64(len(h) < 4))
        for k in range(1, min(4, len(h))):
            grams = mix(grams * np.uint64(3) ^ h[k : k + n])
        least_ones = [(y, k, int(mix(grams + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)).min())) for k in range(hashes)]
        met = Counter(seen[m] for m in least_ones if m in seen)
        if met and met.most_common(1)[0][1] >= least:
            continue
        for m in least_ones:
            seen.setdefault(m, len(out))
        out.append((text, y))
    return out


def log_odds(rows: list[tuple[str, int]], alpha: float = 0.5, z_word: float = 3.5, z_head: float = 4.0, least: float = 1.0) -> dict[str, float]:
    """Log-odds of each unit's document frequency in label 1 against label 0, under an informative Dirichlet prior (the
    unit's share of all rows, worth `alpha` documents of each class), drawn in by one standard deviation; units whose
    log-odds are within z of them, or under `least` then, get none. Only what remains is returned. A beginning counts only if at least four
    words with it occur in rows of label 1, none of them in half of its rows: else it says what that word says."""
    seen = (Counter(), Counter())
    sizes = [0, 0]
    for text, y in rows:
        own = {plain(w) for w in (text or "").split()}
        seen[y].update({u for w in own if w for u in units(w)})
        sizes[y] += 1
    under: dict[str, list[int]] = defaultdict(list)
    for u, c in seen[1].items():
        if not u.endswith("*"):
            for h in units(u)[1:]:
                under[h].append(c)
    out: dict[str, float] = {}
    if not min(sizes):
        return out
    for u in seen[0].keys() | seen[1].keys():
        c0, c1 = seen[0][u], seen[1][u]
        if c0 + c1 < 3 or u.endswith("*") and (len(under[u]) < 4 or 2 * max(under[u]) > c1):
            continue
        share = (c0 + c1) / sum(sizes)
        p = [(c + alpha * share + 0.05) / (n + alpha + 0.1) for c, n in zip((c0, c1), sizes, strict=True)]
        delta = np.log(p[1] / (1 - min(p[1], 0.9999))) - np.log(p[0] / (1 - min(p[0], 0.9999)))
        deviation = np.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5))
        z = z_head if u.endswith("*") else z_word
        w = np.sign(delta) * (abs(delta) - deviation if abs(delta) > z * deviation else 0.0)
        if w > least or w < -least and not u.endswith("*"):
            out[u] = float(w)
    return out


def tail(model: Model, clean: list[str]) -> None:
    """decay: the root of E[exp(decay * (score - drift))] = 1 over tokens of clean texts; constant: from the mean count
    of segments above what one in ten texts has."""
    words = Words(pa.array(clean, pa.string()))
    if not len(words.codes):
        return
    w = np.array([model.weight(x) for x in words.vocabulary.to_pylist()])[words.codes] - model.drift
    values, n = np.unique(np.append(w, np.log(1 + 1.0)), return_counts=True)
    share = n / n.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        if (share * np.exp(np.minimum(700, mid * values))).sum() > 1:
            high = mid
        else:
            low = mid
    model.decay = float(np.clip(low, 0.2, 5.0))
    best = np.array([max((s for _, _, s in f), default=0.0) for f in model.scored(pa.array(clean, pa.string()))[0]])
    at = max(float(np.quantile(best, 0.9)), 0.5)
    hits = max(1, int((best >= at).sum()))
    model.constant = float(np.clip(hits / max(1, len(words.codes)) * np.exp(model.decay * at), 1e-4, 10.0))


def fit(rows: list[tuple[str, int]], prior: float | None = None, drift: float = 0.1) -> Model:
    """prior: the share of label 1 where the model will be used; the rows' own, if None. Log-odds from four fifths of the rows, the extreme-value law and the calibration from the fifth that is held
    out; then log-odds anew from all rows. Without rows of both classes every score is the share of ones."""
    rows = unlike(rows)
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return Model({}, drift, 1.0, 1.0, 0.0, 20.0 if len(y) and y[0] else -20.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = True
    known = [r for r, h in zip(rows, held, strict=True) if not h] or rows
    rest = [r for r, h in zip(rows, held, strict=True) if h]
    model = Model(log_odds(known), drift, 1.0, 1.0, 1.0, 0.0)
    tail(model, [t for t, k in rest if k == 0])
    texts = pa.array([t for t, _ in rest], pa.string())
    x, t = model.logits(texts), np.array([k for _, k in rest], np.float64)
    share = min(max(y.mean() if prior is None else prior, 1e-3), 1 - 1e-3)
    model.slope, model.shift = platt(x, t, np.where(t == 1, share / max(1, t.sum()), (1 - share) / max(1, (1 - t).sum())) * len(t))
    model.weights, model.known = log_odds(rows), {}
    tidy()
    return model


PASSAGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
SCORES = "doc_id long, score double, n_passages int, worst_begin int, worst_end int, passages array<struct<begin:int,end:int,score:double>>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (the calibrated probability of label 1), n_passages (significant ones: expected less than once in
    a hundred clean texts), worst_begin and worst_end (words of the highest scoring segment; null if none), passages (the
    significant ones in order: begin and end in words, score). Each row of
    `docs` gives one row; a null text counts as empty, and an empty one has no passage. Nothing is shuffled."""

    def run(batches):
        for b in batches:
            for stretch in slices(b.column(1)):
                part = b.slice(*stretch)
                found, n = model.scored(part.column(1))
                p = sigmoid(model.judged(found, n))
                worst = [max(f, key=lambda s: s[2], default=None) for f in found]
                sure = [[x for x in f if model.decay * x[2] - np.log(model.constant * max(int(k), 20)) > np.log(100)] for f, k in zip(found, n, strict=True)]
                columns = [part.column(0), pa.array(p), pa.array([len(x) for x in sure], pa.int32()), *[pa.array([w and w[k] for w in worst], pa.int32()) for k in (0, 1)], pa.array([[dict(zip(("begin", "end", "score"), x, strict=True)) for x in own] for own in sure], PASSAGES)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "worst_begin", "worst_end", "passages"])
            tidy()

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), run, SCORES)


def rejected(model: Model, threshold: float = 0.5) -> Column:
    """Of column `text`: whether it is toxic. For filters that keep the other columns."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [sigmoid(model.logits(texts.slice(*x))) >= threshold for x in slices(texts)]
        tidy()
        return pa.array(np.concatenate(parts) if parts else np.empty(0, bool))

    return judge(F.col("text"))


def trained(docs: DataFrame, labels: DataFrame, eligible: Column | None = None) -> Model:
    """Fitted on a bounded sample of labelled documents, and calibrated for the share that the labels have."""
    return fit(labelled(docs, labels, "toxic", SAMPLE, eligible), label_share(labels, "toxic", eligible))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = trained(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages", "worst_begin", "worst_end")

"""Quality rules: fixed limits on a text's counts, then a calibrated classifier on hashed n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashed
from .common import Words, in_arrow, label_share, labelled, mix, read, segment_sums, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A document is kept from this probability of good quality on: one is rejected only if it is clearly poor.
THRESHOLD = 0.3
#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 1200
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def repeat_words(words: Words) -> np.ndarray:
    """For each text, how many of its words lie in windows of three words that occur twice or more in the text."""
    n, out = len(words.codes), np.zeros(len(words.counts), np.int64)
    if n < 4:
        return out
    h = words.hashes()[words.codes]
    doc = np.repeat(np.arange(len(words.counts), dtype=np.uint64), words.counts)
    own = doc[:-2] == doc[2:]
    key = mix(mix(mix(h[:-2] + doc[:-2] * np.uint64(0xD1342543DE82EF95)) ^ h[1:-1]) + h[2:])
    at = np.flatnonzero(own)
    order = np.argsort(key[at])
    sorted_keys = key[at][order]
    same = np.zeros(len(at), bool)
    equal = sorted_keys[1:] == sorted_keys[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    hit = at[order[same]]
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[hit + k] = True
    return segment_sums(cover.astype(np.int64), words.starts)


def counts(texts: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    words = words or Words(texts)
    raw = [t or "" for t in texts.to_pylist()]
    chars = [len(t) - sum(t.count(c) for c in SPACES) for t in raw]
    symbols = [sum(t.count(c) for c in SYMBOLS) for t in raw]
    dup = []
    for t in raw:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": words.counts, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat_words(words)}


def judged(docs: DataFrame, model: hashed.Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs` (see SCHEMA): the counts over the whole text, base_failed by the fixed limits,
    quality (the classifier's probability) and kept. A null text counts as empty, and fails. Nothing is shuffled."""

    def run(batches):
        for b in batches:
            for stretch in slices(b.column(1)):
                part = b.slice(*stretch)
                texts = pc.fill_null(part.column(1), "")
                c = counts(texts)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                p = hashed.sigmoid(model.logits(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in c.values()], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [x.split()[0] for x in SCHEMA.split(", ")])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), run, SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    return judged(docs, hashed.fit(labelled(docs, labels, "quality", SAMPLE), prior=label_share(labels, "quality")))

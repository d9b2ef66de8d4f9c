"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its distinct words, the stems of long words, word pairs
and pairs with one or two words skipped, hashed into BUCKETS. Each coordinate has its own learning rate;
the L1 term leaves few weights, which are broadcast for scoring.

Defined results: a null or wordless text is scored by the bias alone; without
labelled rows the model is empty and every score is the neutral 0.5 less a
margin (no toxicity seen); rows of equal or null doc_id are scored on their own
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .training import fit, held_out, labelled_sample

BITS = 20
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2 = 1.5, 1.0, 4.0, 0.1
EPOCHS = 5
#: Labelled rows learnt from, at most.
SAMPLE_ROWS = 12_000
#: Letters of a stem: an inflected form that was never seen may share one that was.
STEM = 5
THRESHOLD = 0.5
WORD = re.compile(r"\w+")


def features(text: str) -> np.ndarray:
    """Buckets of the text's n-grams and skip-grams, with repeats."""
    digest = xxhash.xxh64_intdigest
    found = WORD.findall((text or "").lower())
    words = np.array([digest(w) for w in found], np.uint64)
    stems = np.array([digest(w[:STEM], 1) for w in found if len(w) > STEM], np.uint64)
    turn = words * np.uint64(0x9E3779B97F4A7C15)
    grams = [words, stems]
    for gap in (1, 2, 3):
        if len(words) > gap:
            grams.append((turn[:-gap] ^ (words[gap:] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * gap))
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


def learn(sample: pd.DataFrame) -> np.ndarray:
    """FTRL-proximal weights; the last entry is the bias."""
    rows = [np.append(np.unique(features(t)), BUCKETS).astype(np.int32) for t in sample["text"]]
    labels = sample["label"].to_numpy()
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(z[at]) <= L1), 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    out = weights(np.arange(BUCKETS + 1))
    if not len(rows):
        out[-1] = -1.0
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        w = shared.value

        def one(text):
            at = features(text)
            at = np.unique(at[w[at] != 0])
            return 1 / (1 + np.exp(-np.clip(w[at].sum() + w[BUCKETS], -30, 30)))

        return texts.map(one).astype("float64")

    return docs.withColumn("score", of(whole_text()))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    return fit(labelled_sample(docs, labels, "toxic", rows), learn)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE_SQL = None

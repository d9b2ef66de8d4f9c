"""Quality classifier over supervised subword embeddings.

A text's features are its words, as written, its pairs of neighbouring words and the
character n-grams of its bytes, hashed into BUCKETS; a pair's hash is the exclusive or
of its words' hashes, so order does not tell pairs apart and a word next to itself is
one feature whatever the word. Each bucket has a learned vector; a document is the
mean of its features' vectors, and a softmax over two outputs gives the label.
Vectors and outputs are trained together by stochastic gradient descent on the log
loss in numpy, text by text. As output follows mean linearly, scoring needs one
number a bucket.

Defined results: a null or empty text is scored by the bias alone; without
labelled rows every score is 0.5; rows of equal or null doc_id are scored on
their own text; an empty table gives an empty result; other columns are
ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .training import fit, held_out, labelled_sample

BITS = 16
BUCKETS = 1 << BITS
DIMENSIONS = 16
EPOCHS = 6
#: Step sizes of the outputs, and of the vectors: a feature has a small share in a
#: document, so its gradient is small, too. A vector's step is at most CALM over the
#: squared length of the shares, so that short texts are not overshot.
OUTPUT_RATE, VECTOR_RATE, CALM = 0.5, 300.0, 0.5
#: Labelled rows learnt from, at most.
SAMPLE_ROWS = 4000
GRAMS = (2, 3, 4)
THRESHOLD = 0.3
#: Bytes whose n-grams are hashed at once.
CHUNK = 1 << 16


def features(text: str) -> np.ndarray:
    """Buckets of the text's words, word pairs and character n-grams, with repeats."""
    raw = (text or "").encode("utf-8", "replace")
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in raw.split()], np.uint64)
    out = [words, (words[1:] ^ words[:-1]) * np.uint64(0xBF58476D1CE4E5B9)]
    for at in range(0, len(raw), CHUNK):
        part = np.frombuffer(raw[at : at + CHUNK + max(GRAMS) - 1], np.uint8).astype(np.uint64)
        for n in GRAMS:
            m = min(CHUNK, len(part) - n + 1)
            if m > 0:
                h = np.full(m, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(257) + part[k : k + m]
                out.append((h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares in the document's features)."""
    at, n = np.unique(features(text), return_counts=True)
    return at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def gradients(vectors: np.ndarray, outputs: np.ndarray, bias: np.ndarray, at: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's log loss, by the vectors ``at``, the outputs and the bias."""
    mean = share @ vectors[at]
    raw = outputs @ mean + bias
    p = np.exp(raw - raw.max())
    p /= p.sum()
    p[label] -= 1
    return share[:, None] * (p @ outputs), np.outer(p, mean), p


def learn(sample: pd.DataFrame) -> np.ndarray:
    """One logit a bucket, then the bias."""
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    outputs, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    rows, labels = [shares(t) for t in sample["text"]], sample["label"].to_numpy()
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = 1 - done / steps
            done += 1
            at, share = rows[i]
            by_vectors, by_outputs, by_bias = gradients(vectors, outputs, bias, at, share, labels[i])
            outputs -= rate * OUTPUT_RATE * by_outputs
            bias -= rate * OUTPUT_RATE * by_bias
            vectors[at] -= rate * min(VECTOR_RATE, CALM / max(1e-9, float(share @ share))) * by_vectors
    if not len(rows):
        return np.zeros(BUCKETS + 1)
    return np.append(vectors @ (outputs[1] - outputs[0]), bias[1] - bias[0])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        w = shared.value

        def one(text):
            at = features(text)
            logit = w[BUCKETS] + (w[at].mean() if len(at) else 0.0)
            return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

        return texts.map(one).astype("float64")

    return docs.withColumn("score", of(whole_text()))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    return fit(labelled_sample(docs, labels, "quality", rows), learn)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, train(docs, labels)).filter(F.col("score") >= THRESHOLD).select("row.*")


ORACLE_SQL = None

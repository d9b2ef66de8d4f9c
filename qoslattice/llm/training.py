"""Bounded, reproducible training samples and models that fit in one task.

Defined results: null labels and held-out rows are not learnt from, a null text
counts as empty, ties go by hash; empty tables give an empty sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key, whole_text

#: Words of the labelled rows that a model is fitted on, at most.
SAMPLE_WORDS = 8_000_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(order, text, label): the ``rows`` labelled, not held-out documents of
    least hash. A doc_id labelled twice counts once, with its greater label; of the
    rows of one doc_id the text of least hash is taken, so ``rows`` bounds the sample."""
    order = F.xxhash64("doc_id")
    chosen = (
        labels.filter(F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
        .orderBy(order, "doc_id").limit(rows)
        .select(F.col("doc_id").alias("of"), order.alias("order"), "label")
    )
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    return found.groupBy("of").agg(F.min(F.struct(text_key().alias("k"), "order", whole_text().alias("text"), "label")).alias("x")).select("x.order", "x.text", "x.label")


def fit(sample: DataFrame, learn: Callable[[pd.DataFrame], np.ndarray], words: int = SAMPLE_WORDS) -> np.ndarray:
    """``learn`` applied to the sample in one task; returns its vector of weights.

    ``learn`` gets text and label in a fixed order. The sample is bounded by its
    rows, and is taken until ``words`` words are reached. What comes back is the
    vector's non-zero entries.
    """

    def run(batches):
        taken, total = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if total < words:
                    taken.append((row.text, row.label))
                    total += row.text.count(" ") + 1
        weights = learn(pd.DataFrame(taken, columns=["text", "label"]))
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"at": np.append(at, len(weights)), "weight": np.append(weights[at], 0.0)})

    found = materialize(sample).repartition(1).sortWithinPartitions("order", "text", "label").mapInPandas(run, "at long, weight double").toPandas()
    if found.empty:  # no sample, no task
        return learn(pd.DataFrame({"text": [], "label": []}))
    found = found.sort_values("at")
    out = np.zeros(int(found["at"].iloc[-1]))
    out[found["at"].iloc[:-1].to_numpy()] = found["weight"].iloc[:-1]
    return out

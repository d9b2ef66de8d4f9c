"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words, lower-cased, weighted by how often they
occur. For each of SAMPLES samples and each term, gamma variables r and c and a
uniform b, all drawn from the term's hash, give

    t = floor(ln(weight) / r + b),  y = exp(r (t - b)),  a = c / (y exp(r)),

and the term of least ``a`` is sampled together with its t. Two documents agree
in a sample with a probability equal to the generalised Jaccard similarity of
their weights, the sum of the lesser over the sum of the greater weights.

At weight 1, t is 0 and ``a`` is exponential: so the draws start from that
exponential, and r, c and b are split off from it only for heavier terms.

Defined results: a null text counts as empty; texts without words share one
fingerprint and are like each other alone; equal texts have equal fingerprints.
In ``edited_report`` a document's next is the following one by descending
doc_id (null ids last; equal ids by the hash of the text); a single document is
its own next; an empty table gives an empty result; other columns are ignored.

Scale: neighbours meet by one shuffle of the texts into ranges of doc_id. Each
range also gets the first document of the next one; rows stream through a task
in batches, so a range of any size fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, whole_text

SAMPLES = 128
SEED = 42
#: Terms of texts that are sampled together, at most by one text.
BATCH_TERMS = 1 << 15
#: Ranges for each shuffle partition: more of them even out what a task gets.
RANGES_EACH = 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SAMPLES, np.uint64)


FACTORS, OFFSETS = _draws()


def term_hashes(text: str, reuse: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """A hash for each word; ``reuse``: (k, hashes) of a text that starts with the same k words."""
    words = text.encode("utf-8", "replace").lower().split()
    known = min(reuse[0], len(words)) if reuse else 0
    fresh = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words[known:]], np.uint64)
    return np.concatenate([reuse[1][:known], fresh]) if known else fresh


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _heavy(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, t) of terms with hash ``h`` in this sample, by the formulas above."""
    least = -np.log1p(-_uniform(h))  # a at weight 1, which is c exp(-r (1 - b))
    c = least - np.log(_uniform(_mix(h, 1)))
    part = np.log(c) - np.log(least)  # r (1 - b)
    r = part - np.log(_uniform(_mix(h, 2)))
    b = 1 - part / r
    t = np.floor(np.log(weight) / r + b)
    return c / np.exp(r * (t - b) + r), t


def signatures(term_lists: list[np.ndarray]) -> np.ndarray:
    """(texts, SAMPLES) sampled terms, 64 bits each."""
    out = np.full((len(term_lists), SAMPLES), EMPTY)
    at = 0
    while at < len(term_lists):
        end, n = at, 0
        while end < len(term_lists) and (end == at or n + len(term_lists[end]) <= BATCH_TERMS):
            n += len(term_lists[end])
            end += 1
        _sample(term_lists[at:end], out[at:end])
        at = end
    return out


def _sample(term_lists: list[np.ndarray], out: np.ndarray) -> None:
    terms, weights, owner = [], [], []
    for i, x in enumerate(term_lists):
        if len(x):
            u, n = np.unique(x, return_counts=True)
            terms.append(u)
            weights.append(n)
            owner.append(np.full(len(u), i))
    if not terms:
        return
    term, weight, doc = map(np.concatenate, (terms, weights, owner))
    heavy = weight > 1
    light, of_light = term[~heavy], doc[~heavy]
    rows, first = np.unique(of_light, return_index=True)
    x, w, of = term[heavy], weight[heavy].astype(np.float64), doc[heavy]
    heavy_rows, heavy_first = np.unique(of, return_index=True)
    for k in range(SAMPLES):
        best = np.full(len(out), np.inf)
        if len(light):
            least = np.minimum.reduceat(light * FACTORS[k] + OFFSETS[k], first)
            out[rows, k] = least
            best[rows] = -np.log1p(-_uniform(least))
        if len(x):
            h = x * FACTORS[k] + OFFSETS[k]
            a, t = _heavy(h, w)
            low = np.minimum.reduceat(a, heavy_first)
            wins = (low < best[heavy_rows]) | (best[heavy_rows] == np.inf)
            # The first term that reaches its document's minimum.
            hit = np.flatnonzero(a == np.repeat(low, np.diff(np.append(heavy_first, len(a)))))
            _, where = np.unique(of[hit], return_index=True)
            chosen = hit[where]
            value = np.where(t[chosen] == 0, h[chosen], _mix(h[chosen] ^ t[chosen].astype(np.int64).view(np.uint64), 3))
            out[heavy_rows[wins], k] = value[wins]


def digests(signature: np.ndarray) -> np.ndarray:
    """16 bits of each sample: what a fingerprint holds."""
    # Least hashes are small numbers: their high bits say little, so they are mixed.
    return np.where(signature == EMPTY, np.uint64(0xFFFF), _mix(signature, 4) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last third, in code points, replaced by the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _report(rows: pd.DataFrame) -> pd.DataFrame:
    """All rows but the last of one run of neighbours, each judged with the row after it."""
    texts = rows["text"].tolist()
    terms = [term_hashes(t) for t in texts]
    changed, changed_terms = [], []
    for text, following, own in zip(texts, texts[1:], terms):
        new = edited(text, following)
        # Words that end before the cut, but for the last, which may be cut or grown.
        whole = max(0, len(text[: len(text) - len(text) // 3].encode("utf-8", "replace").split()) - 1)
        changed.append(new)
        changed_terms.append(term_hashes(new, (whole, own)))
    own, other = digests(signatures(terms)), digests(signatures(changed_terms))
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].iloc[:-1].array,
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
            "fingerprint": [x.tobytes().hex() for x in own[:-1]],
            "edited_fingerprint": [x.tobytes().hex() for x in other],
            "near_edited": likeness(own[:-1], other),
            "near_next": likeness(own[:-1], own[1:]),
        }
    )


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range and order; the last row of a range is lent from the next one."""
    held: pd.DataFrame | None = None
    for batch in batches:
        batch = batch.assign(doc_id=batch["doc_id"].astype("Int64"))
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cuts = np.flatnonzero(rows["range"].to_numpy()[1:] != rows["range"].to_numpy()[:-1]) + 1
        edges = [0, *cuts.tolist(), len(rows)]
        for a, b in zip(edges, edges[1:]):
            for low in range(a, b - 1, 256):
                yield _report(rows.iloc[low : min(low + 257, b)])
        held = rows.iloc[[-1]]


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    spark = docs.sparkSession
    count = RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 1 / (8 * count))
    limits = F.array(*[F.lit(int(x)) for x in sorted(set(bounds))]).cast("array<long>")
    where = F.when(F.col("doc_id").isNull(), F.size(limits) + 1).otherwise(F.size(F.filter(limits, lambda x: x > F.col("doc_id"))))
    rows = docs.select("doc_id", text_key().alias("text_key"), whole_text().alias("text"), where.alias("range"))

    firsts = rows.groupBy("range").agg(F.max("doc_id").alias("first_id"))  # a row for each range
    ranges = sorted(r["range"] for r in firsts.select("range").collect())
    before = dict(zip(ranges, [*ranges[-1:], *ranges[:-1]]))
    if not ranges:
        return spark.createDataFrame([], REPORT)
    lend_to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    lent = (
        rows.join(F.broadcast(firsts.withColumnRenamed("range", "of")), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("range").agg(F.min_by(F.struct("doc_id", "text_key", "text"), F.struct(F.col("text_key").isNotNull(), "text_key")).alias("x"))
        .select("x.*", lend_to.alias("range"), F.lit(True).alias("lent"))
    )
    every = rows.withColumn("lent", F.lit(False)).unionByName(lent)
    order = ["range", "lent", F.col("doc_id").desc_nulls_last(), "text_key"]
    dealt = every.repartition("range").sortWithinPartitions(*order).select("range", "doc_id", "text")
    return dealt.mapInPandas(_neighbours, REPORT)


ORACLE_SQL = None

"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

A fingerprint holds one majority bit for each bit of the shingles' hashes. Two
fingerprints that differ in ``radius`` bits or fewer are linked. Candidates share
some of the fingerprint's bands, all of them by the pigeonhole rule; candidates
are compared in bit-sliced form: plane j holds bit j of 64 fingerprints a word,
carry-save counters add up to 64 distances at once, and a word is abandoned once
all its distances exceed the radius.

Defined results: a null text counts as empty; a text without words has
fingerprint 0 and is linked like any other; equal texts share a fingerprint;
rows of equal or null doc_id each get a row, and a component whose doc_ids are
all null has a null id; an empty table gives an empty result; other columns are
ignored, or kept by ``near_dedup``.

Scale: copies are collapsed to distinct fingerprints before any comparison, so
a group of copies is one row. A band bucket with many fingerprints is split by
further bands; then its members agree in 48 bits, which bounds it at 65,536.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, text_key, whole_text
from .components import components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Buckets above this are split by further bands.
LARGE_BUCKET = 1024
#: Groups from this size on are compared block by block.
WIDE_GROUP = 128
#: Rows compared at once, at least; hashes counted at once.
BATCH_ROWS = 1 << 16
COUNTED = 1 << 14


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, A-Z lower-cased, repeats included."""
    # bytes.lower and bytes.split know ASCII letters and spaces only, as dealt.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - width + 1], ends[width - 1 :]
    del words
    digest, found = xxhash.xxh64_intdigest, np.empty(len(starts), np.uint64)
    # In steps, as Python's numbers take far more memory than the array's.
    for at in range(0, len(found), COUNTED):
        step = slice(at, at + COUNTED)
        found[step] = [digest(joined[a:b], SEED) for a, b in zip(starts[step].tolist(), ends[step].tolist())]
    return found


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.ascontiguousarray(hashes[at : at + COUNTED], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: majority(shingle_hashes(t, width))).astype("int64")

    return of(text)


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane j holds bit j of values 64w .. 64w+63; a zero word follows."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((64, (len(values) + 63) // 64 + 1), "<u8")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of values of one group within ``radius`` bits.

    ``groups`` is sorted.
    """
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(groups)))
    for a, n in zip(starts[sizes >= WIDE_GROUP], sizes[sizes >= WIDE_GROUP]):
        for i, j in _wide_pairs(values[a : a + n], radius):
            yield i + a, j + a
    kept = np.flatnonzero(np.repeat(sizes, sizes) < WIDE_GROUP)
    for i, j in _narrow_pairs(values[kept], groups[kept], radius):
        yield kept[i], kept[j]


def _wide_pairs(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large group: 64 members at a time against all that follow."""
    planes, width = _planes(values)[:, :-1], max(1, int(radius + 1).bit_length())
    for first in range(0, len(values), 64):
        mine = values[first : first + 64].astype(np.uint64)
        at = np.arange(first // 64, planes.shape[1])
        counters = np.zeros((width, len(mine), len(at)), "<u8")
        over = np.zeros((len(mine), len(at)), "<u8")
        for j in range(64):
            carry = planes[j, at][None, :] ^ (np.uint64(0) - ((mine >> np.uint64(j)) & np.uint64(1)))[:, None]
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if j % 16 == 15:
                live = (~(over | _above(counters, radius))).any(axis=0)
                if not live.any():
                    at = at[:0]
                    break
                if live.mean() < 0.7:
                    at, counters, over = at[live], counters[:, :, live], over[:, live]
        if len(at):
            hits = np.ascontiguousarray(~(over | _above(counters, radius)))
            bits = np.unpackbits(hits.view(np.uint8).reshape(len(mine), len(at), 8), axis=2, bitorder="little")
            row, word, bit = np.nonzero(bits)
            i, j = first + row, at[word] * 64 + bit
            fits = (j > i) & (j < len(values))
            yield i[fits], j[fits]


def _narrow_pairs(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of many small groups: each step compares all pairs (i, i+d) of one d."""
    planes, width = _planes(values), max(1, int(radius + 1).bit_length())
    for d in range(1, len(values)):
        same = np.zeros((planes.shape[1]) * 64, np.uint8)
        same[: len(values) - d] = groups[:-d] == groups[d:]
        mask = np.packbits(same, bitorder="little").view("<u8")
        at = np.flatnonzero(mask)
        if not len(at):
            return
        word, bit = divmod(d, 64)
        mask, last = mask[at], planes.shape[1] - 1
        counters = np.zeros((width, len(at)), "<u8")
        over = np.zeros(len(at), "<u8")
        for j in range(64):
            p = planes[j]
            near = p[np.minimum(at + word, last)]
            if bit:
                near = (near >> np.uint64(bit)) | (p[np.minimum(at + word + 1, last)] << np.uint64(64 - bit))
            carry = p[at] ^ near
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if j % 8 == 7:
                live = (mask & ~(over | _above(counters, radius))) != 0
                if not live.any():
                    at = at[:0]
                    break
                if live.mean() < 0.7:
                    at, mask, counters, over = at[live], mask[live], counters[:, live], over[live]
        if len(at):
            hits = mask & ~(over | _above(counters, radius))
            bits = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, column = np.nonzero(bits)
            yield at[row] * 64 + column, at[row] * 64 + column + d


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the positions whose counter exceeds ``radius``."""
    above, equal = np.zeros(counters.shape[1:], "<u8"), ~np.zeros(counters.shape[1:], "<u8")
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _mask(spans) -> int:
    """The signed long whose bits are those of the (low, high) ``spans``."""
    mask = sum((1 << high) - (1 << low) for low, high in spans)
    return mask - ((mask >> 63) << 64)


def _band_masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """Masks of which two values within ``radius`` bits share one at least; for
    each, masks over the bits that it leaves, of which they share one as well."""
    parts = radius + 2
    spans = [(64 * k // parts, 64 * (k + 1) // parts) for k in range(parts)]
    first, second = [], []
    for chosen in combinations(spans, parts - radius):
        halves = [h for low, high in spans if (low, high) not in chosen for h in ((low, (low + high) // 2), ((low + high) // 2, high))]
        first.append(_mask(chosen))
        second.append([_mask(x) for x in combinations(halves, len(halves) - radius)])
    return first, second


def links(fingerprints: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """(a, b): all pairs of distinct values of ``fp`` within ``radius`` bits, a < b."""
    fp = F.col("fp")
    first, second = _band_masks(radius)
    longs = lambda masks: F.array(*[F.lit(m).cast("long") for m in masks])
    banded = fingerprints.select("fp", F.posexplode(longs(first)).alias("band", "mask")).select("fp", "band", fp.bitwiseAND(F.col("mask")).alias("key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    banded = banded.join(sizes, ["band", "key"])
    small = banded.filter(F.col("n") <= large).select("fp", "band", "key", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("key2"))
    finer = F.posexplode(F.element_at(F.array(*map(longs, second)), F.col("band") + 1)).alias("band2", "mask2")
    split = (
        banded.filter(F.col("n") > large).select("fp", "band", "key", finer)
        .select("fp", "band", "key", "band2", fp.bitwiseAND(F.col("mask2")).alias("key2"))
    )
    dealt = small.unionByName(split)

    def pairs(part: pd.DataFrame, groups: np.ndarray) -> pd.DataFrame:
        values = part["fp"].to_numpy()
        found = list(close_pairs(values.view(np.uint64), groups, radius))
        a = np.concatenate([values[:0], *(values[i] for i, _ in found)])
        b = np.concatenate([values[:0], *(values[j] for _, j in found)])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return by_bucket(dealt, pairs, "a long, b long", BATCH_ROWS).distinct()


BUCKET = ["band", "key", "band2", "key2"]


def by_bucket(rows: DataFrame, judge, schema: str, batch_rows: int) -> DataFrame:
    """``judge(part, groups)`` over ``rows`` with the columns BUCKET, in parts of
    whole buckets; ``groups`` numbers the buckets of a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judged(part: pd.DataFrame) -> pd.DataFrame:
            edge = np.zeros(len(part), bool)
            for k in BUCKET:
                v = part[k].to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            return judge(part, np.cumsum(edge))

        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            if batch.empty:
                continue
            # The batch's last bucket may go on; it is the held one if that fills the batch.
            last = (batch[BUCKET] == batch[BUCKET].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))
            closed = cut > 0 or (held and (held[-1][BUCKET].iloc[-1] != batch[BUCKET].iloc[0]).any())
            if closed and count + cut >= batch_rows:
                yield judged(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held, count = [], 0
                batch = batch.iloc[cut:]
            held.append(batch)
            count += len(batch)
        if count:
            yield judged(pd.concat(held, ignore_index=True))

    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInPandas(run, schema)


def with_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with component_id, the smallest doc_id in reach."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    labels = components(links(distinct, radius))
    grouped = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    names = grouped.select("fp", "label").join(least, "label").select("fp", "component_id")
    return rows.join(names, "fp")


def fingerprinted(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    return materialize(docs.select("doc_id", fingerprint(whole_text(), width).alias("fp")))


def near_dup_report(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    found = with_components(fingerprinted(docs, width), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For whole documents: shingles of five words, alike from a Jaccard similarity of 0.8.
DOC_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of whole texts link as candidates up to this many bits.
DOC_RADIUS = 3
#: Shingles that many texts hold come last in a text's order, this many at most. They are counted in one of
#: SAMPLED texts, from SAMPLE_LEAST on; which ones they are decides the time alone, never the result.
COMMON, SAMPLED, SAMPLE_LEAST = 100_000, 16, 3
#: Rounds of further pivots, by number, that a bucket's members of other groups are
#: compared with before its open pairs are: the few that are still apart then get many.
#: Number 0 is the member in whose prefix the bucket's shingle stands earliest: it has the fewest
#: shingles of its own, so it is the nearest to what a group of near copies has in common.
PIVOT_ROUNDS = ((0, 1, 2), tuple(range(3, 15)))
#: Low bits of a key that hold a shingle's place in a prefix; the others name the bucket.
PLACE_BITS = 16
#: Texts of a bucket that one task compares with as many others, and partners that a text is sent to at once.
DOC_BLOCK = 1024
#: Bits of a parity sketch, at least.
SKETCH_BITS = 64
#: Sizes are multiplied by doubles; the slack only covers their rounding.
SLACK = 1e-9


def shingle_set(text: str, width: int = DOC_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def shingle_sets(texts: DataFrame, width: int = DOC_WORDS) -> DataFrame:
    """(text_key, set) of ``texts`` (text_key, text)."""
    return mapped(texts, lambda t: (shingle_set(t, width).view(np.int64),), [("set", pa.list_(pa.int64()))], "set array<long>")


def prefix(found: np.ndarray, common: np.ndarray, weights: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of the n shingles ``found``, the ``common``
    ones (sorted) last, by weight. Sets alike by ``similarity`` share at least
    ceil(similarity * n) shingles, so one of these at least, in any order held by all."""
    n = len(found)
    if not n:
        return np.zeros(1, np.uint64)
    count = n - int(np.ceil(similarity * n - SLACK * n)) + 1
    if not len(common):
        return found[:count]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    often = common[at] == found
    late = np.flatnonzero(often)
    late = late[np.lexsort((found[late], weights[at[late]]))]
    return np.concatenate([found[~often], found[late]])[:count]


def placed_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a prefix: a shingle's high bits, and its place from 0 in the low ones. Later places
    than fit are held as the last that does, which keeps more pairs than the true one."""
    places = np.minimum(np.arange(len(found), dtype=np.uint64), np.uint64((1 << PLACE_BITS) - 1))
    return ((found >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places).view(np.int64)


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, weights): those that a sample of ``texts`` holds most often."""

    sample = texts.filter(F.pmod("text_key", F.lit(SAMPLED)) == 0).dropDuplicates(["text_key"])
    counts = shingle_sets(sample, width).select(F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    # As Arrow: a Python object a row would take the driver many times these bytes.
    rows = counts.filter(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, weights = (np.array(rows[c], np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], weights[order]


def parities(found: np.ndarray) -> bytes:
    """Bit p: whether an odd number of the hashes ``found`` fall on p. There are as many
    bits as hashes, rounded up to a power of two."""
    bits = max(SKETCH_BITS, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the other's length.
    Each hash that only one set holds turns one bit: the sets differ in so many at least."""
    size = min(len(a), len(b))
    whole = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in (a, b)]
    return int.from_bytes((whole[0] ^ whole[1]).tobytes(), "little").bit_count()


def sketched(texts: DataFrame, common, similarity: float, width: int = DOC_WORDS) -> DataFrame:
    """(text_key, n, fp, parity, keys) of ``texts`` (text_key, text): the size of the shingle
    set, its fingerprint, its parity sketch, and the text's buckets: its prefix, by
    ``placed_keys``. ``common``: a broadcast of ``common_shingles``."""

    def of(text: str) -> tuple:
        # One set at a time; the keys are a copy of the prefix, which does not keep the whole set.
        found = shingle_set(text, width)
        return len(found), majority(found), parities(found), placed_keys(prefix(found, *common.value, similarity))

    fields = [("n", pa.int32()), ("fp", pa.int64()), ("parity", pa.binary()), ("keys", pa.list_(pa.int64()))]
    return mapped(texts, of, fields, "n int, fp long, parity binary, keys array<long>")


def paired(pairs: DataFrame, values: DataFrame, block: int) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``values`` (text_key, ...) for both ends, as
    <name>_a and <name>_b. A text with many partners is sent once for ``block`` of them."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / block)).alias("salt"))
    of = lambda end: values.select(F.col("text_key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in values.columns if c != "text_key"])
    left = dealt.select("a", "salt").distinct().join(of("a"), "a")
    return dealt.join(of("b"), "b").join(left, ["a", "salt"])


def within_reach(pairs: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """The ``pairs`` (a, b) whose parity sketches (text_key, n, parity) don't rule them out.

    Sets alike by ``similarity`` differ in (n_a + n_b) (1 - similarity) / (1 + similarity)
    hashes at most, hence in no more bits: no such pair is lost."""

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([parities_apart(x, y) for x, y in zip(a, b)], dtype="int64")

    share = (1 - similarity) / (1 + similarity) + SLACK
    found = paired(pairs, sketches, block).withColumn("most", F.lit(share) * (F.col("n_a") + F.col("n_b")))
    return found.filter(apart("parity_a", "parity_b") <= F.col("most")).select("a", "b")


def distances(pairs: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b, alike) of ``pairs`` (a, b): whether the Jaccard similarity of their
    ``sets`` (text_key, set) links them."""
    both = F.size(F.array_intersect("set_a", "set_b"))
    counted = paired(pairs, sets, block).select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("all"))
    return counted.select("a", "b", (F.col("both") >= F.lit(float(similarity)) * F.col("all")).alias("alike"))


def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``label``, the group of ``text_key`` by ``labels`` (node, label)."""
    return rows.join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))


def still_mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``shared`` (bucket, pos, text_key, n) whose bucket holds two
    groups by ``labels``, with ``label``. Groups only grow: what goes here is settled for good."""
    rows = materialize(named(shared.drop("label"), labels))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    kept = materialize(rows.join(mixed, "bucket"))
    discard(rows)
    return kept


def pivot_pairs(rows: DataFrame, similarity: float, turns: tuple[int, ...]) -> DataFrame:
    """(a, b), a < b: members of the buckets ``rows``, and their bucket's pivots of
    these ``turns``, where those are of another group and of a fitting size."""
    rank = lambda turn: F.xxhash64("text_key", F.lit(turn)) if turn else F.col("pos").cast("long")
    order = lambda turn: F.struct(rank(turn).alias("rank"), F.col("text_key").alias("p"), F.col("n").alias("n_p"), F.col("label").alias("label_p"))
    pivots = rows.groupBy("bucket").agg(F.array(*[F.min(order(t)) for t in turns]).alias("pivots"))
    a, b, most = F.col("text_key"), F.col("first.p"), F.greatest("n", "first.n_p")
    return (
        rows.join(pivots, "bucket").withColumn("first", F.explode(F.array_distinct("pivots")))
        .filter((F.col("label") != F.col("first.label_p")) & (F.least("n", "first.n_p") >= similarity * most - SLACK * most))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )


def open_pairs(shared: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b), a < b: pairs of one bucket and two groups that may yet be alike.

    A bucket is cut into blocks, and each two blocks are a task's. Sets alike by
    ``similarity`` are of like sizes, and share a number of shingles that follows from
    these. In an order held by all, the first one they share has the others behind it in
    both sets: so a pair meets in a bucket that stands early enough in both prefixes, and
    where it stands late in one of them, it need not meet. Members of a group of near copies
    that have too many shingles of their own, which come first, thus meet nobody.
    """
    a, b, n, most = F.col("text_key_a"), F.col("text_key_b"), F.col("n"), F.greatest("n_a", "n_b")
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("n").alias("least"))
    partner = F.greatest("least", similarity * n - SLACK * n)
    rows = shared.join(sizes, "bucket").filter(F.col("pos") <= last_place(n, partner, similarity)).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("text_key", "n", "pos", "label")]
    left = rows.select("bucket", *side("a"), F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("j"))
    right = rows.select("bucket", *side("b"), F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i"), F.col("mine").alias("j"))
    return (
        left.hint("merge").join(right, ["bucket", "i", "j"])
        .filter((F.col("i") < F.col("j")) | (a < b))
        .filter(F.col("label_a") != F.col("label_b"))
        .filter(F.least("n_a", "n_b") >= similarity * most - SLACK * most)
        .filter(F.col("pos_a") <= last_place(F.col("n_a"), F.col("n_b"), similarity))
        .filter(F.col("pos_b") <= last_place(F.col("n_b"), F.col("n_a"), similarity))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )


def last_place(n: Column, other: Column, similarity: float) -> Column:
    """The last place, from 0, in a set of ``n`` shingles at which the first one that it shares
    with an alike set of ``other`` shingles can stand, in an order held by both: all that they
    share, similarity / (1 + similarity) of both sizes at least, must fit from there on."""
    return n - F.ceil(similarity / (1 + similarity) * (n + other) - SLACK * (n + other))


def fingerprint_pairs(distinct: DataFrame, radius: int = DOC_RADIUS) -> DataFrame:
    """(a, b), a < b, of ``distinct`` (text_key, fp): texts whose fingerprints are linked,
    each text with the least of its fingerprint, and these with each other."""
    least = materialize(distinct.groupBy("fp").agg(F.min("text_key").alias("least")))
    same = distinct.join(least, "fp").filter("text_key <> least").select(F.col("least").alias("a"), F.col("text_key").alias("b"))
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"text_{side}"))
    near = links(least.select("fp"), radius).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.least("text_a", "text_b").alias("a"), F.greatest("text_a", "text_b").alias("b")))


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, width: int = DOC_WORDS, block: int = DOC_BLOCK) -> DataFrame:
    """(text_key, label) of texts that are not alone in their group of similar texts.

    Candidates are texts whose fingerprints link by bit-sliced comparison. As distant
    fingerprints do not prove sets unlike, those that share a shingle of their prefixes,
    a bucket, are candidates as well: no pair alike by ``similarity`` is lost. Each is
    compared with the bucket's least text, its pivot, which settles groups of near
    copies by one comparison a member, then with other pivots; what is not in one group
    then is compared in pairs, where the places of the bucket's shingle allow it. Parity sketches, an eighth to a quarter of a byte a shingle,
    rule out nearly all unlike pairs; the rest are judged by their shingle sets.

    A round without pairs, or whose pairs are all unlike, changes no group, and what would
    follow from it is not run: each shuffle or broadcast costs the driver a thread that
    stays for a minute, and on small tables a minute holds hundreds.
    """
    texts = docs.select(text_key().alias("text_key"), whole_text().alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    distinct = materialize(sketched(texts, common, similarity, width).dropDuplicates(["text_key"]))
    sketches = distinct.select("text_key", "n", "parity")
    # Dealt once, for the count of a bucket's texts and for the texts of those that have two.
    bucket, pos = F.shiftright("key", PLACE_BITS).alias("bucket"), F.col("key").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("pos")
    placed = distinct.select("text_key", "n", F.explode("keys").alias("key")).repartition(F.shiftright("key", PLACE_BITS)).select("text_key", "n", bucket, pos)
    order = F.struct("text_key", "n")
    sizes = placed.groupBy("bucket").agg(F.min(order).alias("first"), F.max("text_key").alias("last")).filter("first.text_key < last")
    met = materialize(placed.join(sizes, "bucket").select("bucket", "pos", "text_key", "n", F.col("first.text_key").alias("pivot"), F.col("first.n").alias("n_pivot")))

    def judge(pairs: DataFrame) -> DataFrame:
        asked = materialize(pairs)
        if asked.isEmpty():
            return asked
        near = materialize(within_reach(asked, sketches, similarity, block))
        discard(asked)
        if near.isEmpty():
            return near
        ends = near.select(F.explode(F.array("a", "b")).alias("end")).distinct()
        # Equal texts have equal sets; one is enough.
        one = texts.join(ends, F.col("text_key") == F.col("end"), "left_semi").dropDuplicates(["text_key"])
        sets = materialize(shingle_sets(one, width))
        judged = materialize(distances(near, sets, similarity, block).filter("alike").select("a", "b"))
        discard(sets)
        discard(near)
        return judged

    most = F.greatest("n", "n_pivot")
    pivots = (
        met.filter((F.col("text_key") != F.col("pivot")) & (F.least("n", "n_pivot") >= similarity * most - SLACK * most))
        .select(F.col("pivot").alias("a"), F.col("text_key").alias("b"))
    )
    alike = judge(fingerprint_pairs(distinct.select("text_key", "fp")).unionByName(pivots).distinct())
    labels = components(alike)
    joined = lambda links: components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
    shared = still_mixed(met.select("bucket", "pos", "text_key", "n"), labels)
    for pairs_of in [*(lambda rows, t=turns: pivot_pairs(rows, similarity, t) for turns in PIVOT_ROUNDS), lambda rows: open_pairs(rows, similarity, block)]:
        if shared.isEmpty():
            break
        found = judge(pairs_of(shared))
        if not found.isEmpty():
            labels = joined(found)
            shared = still_mixed(shared, labels)
    return labels.withColumnRenamed("node", "text_key")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, width: int = DOC_WORDS) -> DataFrame:
    """``docs`` with one document of each group of copies and near copies: the one
    of least doc_id (null ids last; then by the hash of the text)."""
    rows = materialize(docs.select("doc_id", text_key().alias("text_key")))
    groups = similar_texts(docs, similarity, width).select(F.col("text_key").alias("of"), "label")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = rows.groupBy("text_key").agg(F.min(order).alias("first"))
    kept = (
        first.join(groups, F.col("text_key") == F.col("of"), "left")
        .groupBy(F.coalesce("label", "text_key").alias("label")).agg(F.min("first").alias("first"))
        .select(F.xxhash64("first.doc_id", "first.text_key").alias("kept_key"))
    )
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", text_key()).alias("row_key"))
    # Rows of one doc_id and text share a key: the first by its other columns stays. The
    # window uses the join's own partitioning.
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != "text"]
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy(F.to_json(F.struct(*rest))))
    joined = keyed.join(kept, F.col("row_key") == F.col("kept_key"))
    return joined.withColumn("nth", nth).filter("nth = 1").select("row.*")


ORACLE_SQL = None

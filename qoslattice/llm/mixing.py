"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source's documents, in shuffled order, form a line that is cut
into blocks of equal length (to one word). Slots are dealt to sources by mapping
golden-ratio points through the cumulative quotas; the slots of a source are
ranked, and rank r takes block r modulo the number of blocks, so every word is
taken once before any is taken twice. The last slot of a source is trimmed so
that the source meets its target to the word.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own, the last; equal rows and rows of equal or null
doc_id are separate documents; an empty table gives an empty result; other
columns are ignored, or kept by ``mix``.

Scale: documents are laid out by windows over hash ranges of each source, not
over whole sources, so a source with a third of all rows spreads over many
tasks. Only the table of sources (one row each) visits the driver.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block at most, and slots that are ranked together.
BLOCK_WORDS = 1024
SLOT_CHUNK = 1 << 16
#: Weights of the sources in code point order, repeating; no source is taken more often than MOST_EPOCHS.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Documents of a source's range, about: the hash's first bits choose it, one bit at least.
RANGE_DOCS = 1 << 16


def with_size(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_key().alias("text_key"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row for each source.

    A source is above its limit if its share of what the sources before it (by
    limit over weight) leave exceeds that limit; these sources form a prefix.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("rank", rank)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("most", MOST_EPOCHS * F.col("source_size"))
        .withColumn("all", F.sum("source_size").over(whole))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("above", F.col("left") * F.col("weight") > F.col("most") * F.col("weights"))
        .withColumn("free", F.col("all") - F.sum(F.when(F.col("above"), F.col("most")).otherwise(0)).over(whole))
        .withColumn("shares", F.sum(F.when(F.col("above"), 0).otherwise(F.col("weight"))).over(whole))
        .select(
            "rank", "source", "source_size",
            F.when(F.col("above"), F.col("most").cast("double"))
            .otherwise(F.col("free").cast("double") * F.col("weight") / F.col("shares"))
            .alias("target"),
        )
    )


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds each source's blocks and how many slots meet its target.

    The first ``longer`` blocks hold ``base`` + 1 words, the others ``base``;
    ``rest`` is where the last, partial round over the line ends.
    """
    size, blocks = F.col("source_size"), F.col("blocks")
    take = F.least(F.round("target").cast("long"), MOST_EPOCHS * size)
    return (
        targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / block_words)))
        .withColumn("base", F.floor(size / blocks))
        .withColumn("longer", size % blocks)
        .withColumn("take", take)
        .withColumn("rounds", F.when(size > 0, F.floor(F.col("take") / size)).otherwise(0))
        .withColumn("rest", F.when(size > 0, F.col("take") % size).otherwise(0))
        .withColumn("slots", F.col("rounds") * blocks + F.when(F.col("rest") > 0, _block_of(F.col("rest") - 1) + 1).otherwise(0))
    )


def _block_of(at: Column) -> Column:
    base, longer = F.col("base"), F.col("longer")
    edge = longer * (base + 1)
    return F.when(at < edge, F.floor(at / (base + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(base, F.lit(1))))


def _block_start(block: Column) -> Column:
    return block * F.col("base") + F.least(block, F.col("longer"))


def _golden(i: Column) -> Column:
    """The fraction of i times the golden ratio, exact to 1e-9 below 2**40."""
    getcontext().prec = 40
    ratio = (Decimal(5).sqrt() - 1) / 2
    low, high = F.lit(float(ratio)), F.lit(float(ratio * (1 << 20) % 1))
    u = F.shiftright(i, 20) * high + i.bitwiseAND(F.lit((1 << 20) - 1)) * low
    return u - F.floor(u)


def slots(spark, sources: list, chunk: int = SLOT_CHUNK) -> DataFrame:
    """(rank, slot, turn): to which source each slot goes, and its turn there.

    ``sources``: rows of ``with_blocks``. Points past a source's quota are passed
    over; the few turns that the points leave open come at the end.
    """
    quotas = [(int(r["rank"]), int(r["slots"])) for r in sources if r["slots"]]
    total = sum(n for _, n in quotas)
    schema = "rank int, quota long, low double, high double"
    edges, at = [], 0
    for rank, n in quotas:
        edges.append((rank, n, at / total, (at + n) / total))
        at += n
    table = F.broadcast(spark.createDataFrame(edges, schema))
    # A source's stretch of [0, 1) meets few of the 4096 equal cells; joined by cell, points meet only those.
    cell = lambda u: F.floor(u * 4096).cast("int")
    stretches = table.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(4095)))))
    points = spark.range(total).select(F.col("id").alias("slot"), _golden(F.col("id")).alias("u"))
    dealt = (
        points.withColumn("cell", cell(F.col("u")))
        .join(F.broadcast(stretches), "cell")
        .filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .select("rank", "quota", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    )
    counts = dealt.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    ranked = (
        dealt.withColumn("within", within).join(offsets, ["rank", "chunk"])
        .withColumn("turn", F.col("offset") + F.col("within"))
        .filter(F.col("turn") < F.col("quota"))
        .select("rank", "slot", "turn")
    )
    dealt_to = dealt.groupBy("rank").agg(F.count("*").alias("n"))
    open_turns = (
        table.join(dealt_to, "rank", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < F.col("quota"))
        .select("rank", F.lit(total).alias("slot"), F.explode(F.sequence("n", F.col("quota") - 1)).alias("turn"))
    )
    return ranked.unionByName(open_turns)


def laid_out(sized: DataFrame, range_bits: int) -> DataFrame:
    """Adds ``start``: where each document begins on its source's shuffled line. The
    line is in order of hashes, so it does not depend on the number of ranges."""
    order = F.xxhash64("doc_id", "text_key")
    ranges = sized.withColumn("order", order).withColumn("range", F.shiftrightunsigned("order", 64 - range_bits))
    sums = ranges.groupBy("source", "range").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("of_source"), F.col("range").alias("of_range"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    before = Window.partitionBy("source", "range").orderBy("order", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range")))
        .withColumn("start", F.col("offset") + F.col("within"))
        .drop("of_source", "of_range", "offset", "within", "range", "order")
    )


def taken_words(sized: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS) -> DataFrame:
    """``sized`` (doc_id, source, text_key, size) with source_size, target and taken."""
    spark = sized.sparkSession
    sized = materialize(sized)
    targets = materialize(with_blocks(source_targets(sized, weights), block_words))
    schedule = slots(spark, targets.select("rank", "slots").collect())
    terms = F.broadcast(targets.select(*[F.col(c).alias("of_source") if c == "source" else c for c in targets.columns]))

    last = (F.col("turn") == F.col("slots") - 1) & (F.col("rest") > 0)
    uses = (
        schedule.join(terms, "rank")
        .groupBy("rank", (F.col("turn") % F.col("blocks")).alias("block"))
        .agg(F.count_if(~last).alias("uses"), F.max(F.when(last, F.col("rest"))).alias("until"))
    )
    # As if all documents were of one source: a range is never larger then.
    placed = laid_out(sized, max(1, (sized.count() // RANGE_DOCS).bit_length())).join(terms, F.col("source").eqNullSafe(F.col("of_source")))
    end = F.col("start") + F.col("size")
    pieces = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(end - 1))))
        .withColumn("low", F.greatest("start", _block_start(F.col("block"))))
        .withColumn("high", F.least(end, _block_start(F.col("block") + 1)))
        .join(uses, ["rank", "block"], "left")
    )
    trimmed = F.greatest(F.lit(0), F.least("high", "until") - F.col("low"))
    words = F.coalesce("uses", F.lit(0)) * (F.col("high") - F.col("low")) + F.when(F.col("until").isNotNull(), trimmed).otherwise(0)
    key = ["doc_id", "source", "text_key", "size", "source_size", "target"]
    full = pieces.groupBy(*key, "start").agg(F.sum(words).alias("taken")).drop("start")
    return full.unionByName(placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken")))


def mixing_report(docs: DataFrame) -> DataFrame:
    return taken_words(with_size(docs)).drop("source", "text_key")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken,
    which stand in for columns of these names; ``taken`` over ``size`` says how
    often a document is read."""
    added = ["size", "source_size", "target", "taken"]
    key = F.xxhash64("doc_id", "source", "text_key").alias("row_key")
    taken = taken_words(with_size(docs), block_words, weights).filter("taken > 0").select(key, F.struct("taken", *added[:-1]).alias("t"))
    # Equal rows share a key: the n-th of them gets the n-th share.
    shares = taken.groupBy("row_key").agg(F.sort_array(F.collect_list("t"), asc=False).alias("shares"))
    rest = [c for c in docs.columns if c not in added]
    keyed = docs.select(F.struct(*rest).alias("row"), "doc_id", "source", text_key().alias("text_key")).select("row", key)
    # The window uses the join's own partitioning: texts are shuffled once.
    others = [F.col(f"row.`{c}`") for c in rest if c != "text"]
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy(F.to_json(F.struct(*others)) if others else "row_key"))
    out = keyed.join(shares, "row_key").select("row", "shares", nth.alias("nth")).filter(F.col("nth") <= F.size("shares"))
    return out.select("row", F.element_at("shares", F.col("nth")).alias("t")).select("row.*", *[f"t.{c}" for c in added])


ORACLE_SQL = None

"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
Each benchmark item yields its windows of ``WINDOW`` words (a shorter item: its
whole sequence). The hashes of these windows are broadcast; every window of every
document is looked up by its hash where the document is read, and what is found
is verified word by word. Verified windows are united to spans of hit words.

Defined results: a null or wordless document has no words and no hits; an item
without words has no windows; items of equal text are all named; rows of equal
or null doc_id are judged on their own text; empty tables give an empty result
or no hits; other columns are ignored, or kept by ``remove_spans`` and
``drop_documents``.

Scale: a window that isn't in the set never leaves its task; what goes on is its
hash and place. The set is broadcast in portions of PORTION windows, counted
first: a larger benchmark means more passes over the documents by the same plan.
Spans come back to their texts by a broadcast where their counted number allows,
else by a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, text_key, whole_text, with_text

#: A word of a text whose letters are not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes in a broadcast, at most: two longs each, 32 MB or so in a task's memory.
PORTION = 1_000_000
#: Documents with spans that are broadcast, at most, and spans of them all.
BROADCAST_DOCS, BROADCAST_SPANS = 50_000, 200_000
#: The code points that end a word.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in order; the breaks around them leave empty strings that go."""
    return F.filter(F.split(lower_ascii(text), BREAK), lambda w: w != "")


def _window_count(words: Column, length) -> Column:
    return F.greatest(F.lit(0), F.size(words) - length + 1)


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, length, items): distinct windows and the ids of the items that hold them."""
    words = benchmark.select("item_id", words_of(whole_text()).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), _window_count(F.col("words"), length))
    return (
        words.withColumn("length", length)
        .select("item_id", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))).alias("gram"))
        .groupBy("gram", "length").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def _hash(words: Column, at: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(words, at, length))


def windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, words, first, length, h): all windows of the documents, ``first`` from 0."""
    words = docs.select("doc_id", text_key().alias("text_key"), words_of(whole_text()).alias("words"))

    def of(length: int) -> Column:
        # slice counts from 1, results from 0.
        starts = F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("first"), F.lit(length).alias("length"), _hash(F.col("words"), i, F.lit(length)).alias("h")))

    return words.select("doc_id", "text_key", "words", F.explode(F.concat(*map(of, lengths))).alias("w")).select("doc_id", "text_key", "words", "w.*")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, portion: int = PORTION) -> DataFrame:
    """(doc_id, text_key, first, after, items): the documents' windows that are test
    windows word by word; ``items``: the ids of the items that hold it, as strings.
    Equal rows give equal windows."""
    grams = materialize(test_windows(benchmark, window).withColumn("h", F.xxhash64(F.split("gram", " "))))
    counts = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, first int, after int, items array<string>")
    portions = -(-sum(counts.values()) // portion)
    every = windows(docs, sorted(counts))
    found = []
    for i in range(portions):
        known = grams.filter(F.pmod("h", F.lit(portions)) == i).select("h", "length").distinct()
        met = every.join(F.broadcast(known), ["h", "length"])
        gram = F.array_join(F.slice("words", F.col("first") + 1, F.col("length")), " ")
        # Each portion is a job of its own: its broadcast is gone before the next.
        found.append(materialize(met.select("doc_id", "text_key", "first", (F.col("first") + F.col("length")).alias("after"), gram.alias("gram")).distinct()))
    return reduce(DataFrame.unionByName, found).join(grams.select("gram", "items"), "gram").drop("gram")


def spans_of(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, n_hit): the windows of ``hits`` united to disjoint
    spans, an array of struct(first, after) by place, and the words in them."""
    mine = Window.partitionBy("doc_id", "text_key")
    before = F.max("after").over(mine.orderBy("first", "after").rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.select("doc_id", "text_key", "first", "after", (F.coalesce(before, F.lit(-1)) < F.col("first")).cast("int").alias("fresh"))
    island = F.sum("fresh").over(mine.orderBy("first", "after").rowsBetween(Window.unboundedPreceding, 0))
    islands = fresh.withColumn("island", island).groupBy("doc_id", "text_key", "island").agg(F.min("first").alias("first"), F.max("after").alias("after"))
    return islands.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("first", "after"))).alias("spans"), F.sum(F.col("after") - F.col("first")).alias("n_hit")
    )


def _joined(docs: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_of", "text_key": "_key"})
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("text_key") == F.col("_key")), "left").drop("_of", "_key")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    counted = docs.select("doc_id", text_key().alias("text_key"), F.size(words_of(whole_text())).cast("long").alias("n_words"))
    found = hits(docs, benchmark)
    named = found.select("doc_id", "text_key", F.explode("items").alias("item")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    both = spans_of(found).select("doc_id", "text_key", "n_hit").join(named.withColumnsRenamed({"doc_id": "i", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).drop("i", "k")
    return _joined(counted, both).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, text, spans, n_hit): ``docs`` as struct ``row``, with their spans of hit words."""
    spans = materialize(spans_of(hits(docs, benchmark)))
    size = spans.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    small = size["docs"] <= BROADCAST_DOCS and size["spans"] <= BROADCAST_SPANS
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", text_key().alias("text_key"))
    return _joined(rows, F.broadcast(spans) if small else spans.hint("merge")).select("row", "text", "spans", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0) -> DataFrame:
    """``docs`` without those of whose words more than ``most_share`` are hit."""
    share = F.when(F.col("n_hit") > 0, F.col("n_hit") / F.size(words_of(F.col("text")))).otherwise(0.0)
    return _marked(docs, benchmark).filter(share <= most_share).select("row.*")


def without(text: Column, spans: Column) -> Column:
    """``text`` less the words of the disjoint ``spans`` (one at least, by place), from a
    span's first letter to its last."""
    # Word and gap alternate: gap 0, word 0, gap 1, word 1 ... gap n. A word's mark:
    # 0 it stays, 1 it goes, 2 it goes with the gap before it.
    marks = F.flatten(F.transform(spans, lambda s, i: F.concat(
        F.array_repeat(F.lit(0), s["first"] - F.when(i > 0, spans[i - 1]["after"]).otherwise(0)), F.array(F.lit(1)), F.array_repeat(F.lit(2), s["after"] - s["first"] - 1)
    )))
    pieces = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word"), marks.alias("mark"))
    mark = lambda p: F.coalesce(p["mark"], F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(mark(p) == 0, F.concat(p["gap"], F.coalesce(p["word"], F.lit("")))).when(mark(p) == 1, p["gap"]).otherwise("")), "")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with hit words cut out of ``text``, from a span's first letter to
    its last; ``n_chars`` follows the text. Texts without hits stay as they are."""
    rows = _marked(docs, benchmark)
    clean = F.col("n_hit") == 0
    return with_text(rows, docs.columns, F.when(clean, F.col("text")).otherwise(without(F.col("text"), F.col("spans"))), clean)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
x AS (SELECT n, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT x.n, x.k, x.i, g.item_id FROM x JOIN g USING (gram, k)),
c AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT n, i, k FROM h)) GROUP BY n),
t AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT n, item_id::VARCHAR AS item_id FROM h) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)"""

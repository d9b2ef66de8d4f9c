"""Spelling variants: words of one edit's distance, found by their rarest letter pairs.

An edit touches two of a word's positional bigrams at most. So of two words one edit
apart, each word's three bigrams that come first in any order of bigrams by text include
one that the other's first three hold, too, at the same place or, where the other word
is longer by a letter, at the same place or the next. Bigrams are ordered by the number
of words that have them, rarest first; words meet by length, bigram and place, and each
pair that meets is verified.

Defined results: a null text has no words; a null doc_id hashes as an empty string; rows
count one by one, repeated ones too; words as frequent as each other are ordered by
code points; no words, no rows; other columns are ignored.

Scale: words are counted where texts are read, so a frequent word is one row a task. All
that follows works on distinct words. Words that share length, bigram and place are split
into blocks of BLOCK, and a word is sent to each block of its meeting places, so no task
holds all pairs of a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, whole_text

#: Code points of a word and its occurrences at least; how many times more
#: frequent than a word its form is.
LEAST_LENGTH, LEAST_TIMES, TIMES_MORE = 6, 5, 5
#: Bigrams of two letters, of which an edit touches two at most: three are looked up.
PREFIX = 3
#: Words of one length, bigram and place that one key of the join holds.
BLOCK = 2048
#: Of so many runs one is misspelt for the query.
MISSPELT = 199


def runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, run): the runs of letters in the texts, A-Z lower-cased, shorter ones left out."""
    found = F.regexp_extract_all(lower_ascii(whole_text()), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(run: Column, doc_id: Column, one_of: int = MISSPELT) -> Column:
    """``run`` with a letter left out in about one of ``one_of`` cases, by a hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_of == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): distinct words, long and frequent enough."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def prefixes(words: DataFrame) -> DataFrame:
    """(id, gram, at): the PREFIX positional bigrams of each word (id, word) that fewest
    words have; ties by the bigram's text, then by place."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring("word", i, F.lit(2)).alias("gram"), i.alias("at")))
    grams = words.select("id", F.explode(places).alias("x")).select("id", "x.*")
    # A letter pair counts once a place; the order only has to be the same for all words.
    frequent = grams.groupBy("gram").agg(F.count("*").alias("words"))
    rare = Window.partitionBy("id").orderBy("words", "gram", "at")
    return grams.join(frequent, "gram").withColumn("nth", F.row_number().over(rare)).filter(F.col("nth") <= PREFIX).select("id", "gram", "at")


def _half(word: Column, length: Column) -> Column:
    """Hashes of the first half and of the rest of ``length`` letters, counted from the
    start and from the end: one edit leaves one of them as it is."""
    half = F.floor(length / 2).cast("int")
    return F.named_struct(F.lit("head"), F.hash(F.substring(word, F.lit(1), half)), F.lit("tail"), F.hash(F.right(word, length - half)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n) that is one edit apart, once."""
    known = materialize(words.select("word", "n", F.monotonically_increasing_id().alias("id")))
    entries = materialize(prefixes(known).join(known, "id").select("word", "n", F.length("word").alias("len"), "gram", "at"))
    key = ["len", "gram", "at"]
    # Meeting places of more than a block, and their blocks.
    large = materialize(entries.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select(*key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    stored = entries.join(large, key, "left").select(
        *key, F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.col("word").alias("b"), F.col("n").alias("b_n"),
        _half(F.col("word"), F.col("len")).alias("b_same"), _half(F.col("word"), F.col("len") - 1).alias("b_more"),
    )
    place = lambda more, step: F.named_struct(F.lit("len"), F.col("len") + more, F.lit("gram"), F.col("gram"), F.lit("at"), F.col("at") + step, F.lit("more"), F.lit(more == 1))
    asked = (
        entries.select("word", "n", _half(F.col("word"), F.col("len")).alias("a_half"), F.explode(F.array(place(0, 0), place(1, 0), place(1, 1))).alias("x"))
        .select(F.col("word").alias("a"), F.col("n").alias("a_n"), "a_half", "x.*").join(large, key, "left")
        .select(*key, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "a", "a_n", "a_half", "more")
    )
    half = lambda of: (F.col("a_half.head") == F.col(f"{of}.head")) | (F.col("a_half.tail") == F.col(f"{of}.tail"))
    alike = F.when(F.col("more"), half("b_more")).otherwise(half("b_same") & (F.col("a") < F.col("b")))
    met = asked.join(stored, [*key, "block"]).filter(alike & (F.levenshtein("a", "b", 1) == 1))
    # A pair may meet at several places.
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that ``forms`` (word, form) lead to. Forms grow more
    frequent at each step, so chains end; each round doubles what a word has seen."""
    reached = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = after.drop("moved")
        if after.filter("moved").isEmpty():
            return reached


def variants(words: DataFrame, times_more: int = TIMES_MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n): its near words'
    number, the most frequent of them where that is ``times_more`` times as frequent as the
    word, and where following forms ends."""
    words = materialize(words.select("word", "n"))
    pairs = near_words(words)
    ends = lambda a, b: F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("near")).alias("near"))
    both = pairs.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times_more * F.col("n"), F.col("best")).alias("best"))
    found = materialize(found.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    ends_at = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends_at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` as they are written, grouped by spelling."""
    return variants(counted(runs(docs).select(F.col("run").alias("word"))))


def variants_report(docs: DataFrame) -> DataFrame:
    return variants(counted(runs(docs).select(misspelt(F.col("run"), F.col("doc_id")).alias("word"))))


ORACLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), keys AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS times FROM found WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM keys, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS rn FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND rn = 1
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""

"""Quality rules, line first: lines that are no prose go, then texts that lose too much.

A line fails by its punctuation (symbols in place of letters, cries, long runs of words
without a stop), as navigation (entries between separators, words of menus) or as
boilerplate (legal and technical phrases of pages). Failing lines are removed; a text that
loses more than LOST percent of its characters is rejected, as is one that the plain
rules on the whole text reject.

Defined results: a null text has no words and is rejected, as is an empty one; a blank line
passes, and so stays; repeated rows get a row each; an empty table gives an empty
result; other columns go along untouched, whatever their names.

Scale: each row is judged where it is read, without a shuffle. Rules are expressions on
the array of lines; only repeated windows of words, which need a table of what a text
holds, are counted in Python, one text at a time.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WORD, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: Characters that count as symbols; braces are code.
SYMBOLS = "#*$%&|<>"
#: Rules on whole texts: words at least, and the percentage of them in repeated windows of WINDOW words at most.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Percentage of a line's characters that may be symbols; words of which one may cry; words
#: after which a line needs a stop; words of an entry of a menu; words of a line that a phrase spoils.
MOST_SYMBOLS, CRY_WORDS, STOP_WORDS, ENTRY_WORDS, PHRASE_WORDS = 10, 4, 40, 3, 40
#: Percentage of a text's characters in failing lines from which on the text is rejected.
LOST = 50

CRIES = r"[!?][!?]+"
STOPS = "[.,;:!?…。।؟，]"
SEPARATORS = "[|»›•·]"
MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign (in|up)|register|search|next|previous|prev|back to top|read more|share|print|contact( us)?|about( us)?|site ?map|skip to content|click here|subscribe)[\x20\x09-\x0D.!:>]*$"
PHRASES = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|(uses?|accept( all)?) cookies|enable javascript|lorem ipsum"
    r"|powered by [a-z]|subscribe to our|copyright (\(c\)|\x{A9}|[12][0-9]{3})|released under the [a-z0-9 .-]+ licen[sc]e|licensed under the [a-z])"
)


def _count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, ""))


def bad_punctuation(line: Column) -> Column:
    words = _count(line, WORD)
    endless = (words > STOP_WORDS) & ~line.rlike(STOPS)
    return (100 * symbols(line) > MOST_SYMBOLS * word_chars(line)) | (CRY_WORDS * _count(line, CRIES) > words) | endless


def navigation(line: Column) -> Column:
    """Separators with few words between them, or a menu's words alone."""
    found = _count(line, SEPARATORS)
    return line.rlike(MENU) | ((found > 1) & (_count(line, WORD) - found <= ENTRY_WORDS * (found + 1)))


def boilerplate(line: Column) -> Column:
    return line.rlike(PHRASES) & (_count(line, WORD) <= PHRASE_WORDS)


def passes(line: Column) -> Column:
    return (F.trim(line) == "") | ~(bad_punctuation(line) | navigation(line) | boilerplate(line))


def good_lines(text: Column) -> Column:
    """``text`` without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), passes), "\n")


def repeated(text: str, window: int = WINDOW) -> int:
    """Words of ``text`` in windows of words that occur twice or more, the first included."""
    words = re.findall(WORD, text)
    of = lambda: zip(*(words[i:] for i in range(window)), strict=False)
    times, total, upto = Counter(of()), 0, 0
    for i, w in enumerate(of()):
        if times[w] > 1:
            total += i + window - max(i, upto)
            upto = i + window
    return total


def repeated_words(text: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(repeated).astype("int64"), "long")(text)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return F.size(full) - F.size(F.array_distinct(full))


def judged(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    chars_cut, kept, cleaned): ``row`` holds the columns of ``docs``, ``cleaned`` the
    text without failing lines."""
    text = whole_text()
    counted = docs.select(
        F.struct("*").alias("row"), _count(text, WORD).cast("long").alias("n_words"), word_chars(text).cast("long").alias("word_chars"), symbols(text).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"), repeated_words(text).alias("n_repeat_words"), good_lines(text).alias("cleaned"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    cut = F.col("word_chars") - word_chars(F.col("cleaned"))
    return counted.withColumn("base_failed", failed).withColumn("chars_cut", cut.cast("long")).withColumn("kept", ~failed & (100 * F.col("chars_cut") <= LOST * F.col("word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected rows, failing lines removed from the texts of the others
    (and ``n_chars`` told anew where there is one)."""
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return judged(docs).filter("kept").select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def rules_report(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_cut"
    )


_SQL_CHARS = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_SQL_WORDS = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"
_SQL_SYMBOLS = "length({0}) - length(translate({0}, '#*$%&|<>', ''))"
_SQL_LINE = f"""trim(l) = '' OR NOT (
    100 * ({_SQL_SYMBOLS.format('l')}) > {MOST_SYMBOLS} * {_SQL_CHARS.format('l')} OR {CRY_WORDS} * len(regexp_extract_all(l, '{CRIES}')) > {_SQL_WORDS.format('l')}
    OR ({_SQL_WORDS.format('l')} > {STOP_WORDS} AND NOT regexp_matches(l, '{STOPS}')) OR regexp_matches(l, '{MENU}')
    OR (len(regexp_extract_all(l, '{SEPARATORS}')) > 1 AND {_SQL_WORDS.format('l')} - len(regexp_extract_all(l, '{SEPARATORS}')) <= {ENTRY_WORDS} * (len(regexp_extract_all(l, '{SEPARATORS}')) + 1))
    OR (regexp_matches(l, '{PHRASES}') AND {_SQL_WORDS.format('l')} <= {PHRASE_WORDS}))"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
n AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS twice FROM n),
h AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM t),
p AS (SELECT r, count(*) FILTER (hit) AS repeats FROM h GROUP BY r),
c AS (
  SELECT doc_id, {_SQL_WORDS.format('t')} AS n_words, {_SQL_CHARS.format('t')} AS word_chars, {_SQL_SYMBOLS.format('t')} AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
    coalesce(repeats, 0) AS n_repeat_words, array_to_string(list_filter(string_split(t, chr(10)), lambda l: {_SQL_LINE}), chr(10)) AS cleaned
  FROM d LEFT JOIN p USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars - {_SQL_CHARS.format('cleaned')} AS chars_cut, NOT base_failed AND 100 * chars_cut <= {LOST} * word_chars AS kept FROM c
"""

"""Fill-in-the-middle: a text is cut at two ranks of its units and put together anew.

Units are runs of ASCII letters, and every other code point by itself. A first pass
counts them; a second one advances a lazy iterator over the matches to the lower rank
and on to the higher one. No list of units is ever made, so beside the text itself a
row takes the same memory however long it is.

Where a text is cut, and in what order its parts come, hangs on the hash of
``<seed>:<doc_id>`` alone, so reruns and lost executors change nothing.

Defined results: a null text counts as empty and an empty one stays plain, as does one
that holds a marker; a null doc_id hashes as an empty string; rows of equal doc_id are
cut at the same draws, each by its own number of units; an empty table gives an empty
result; other columns go along under their own names, whatever those are.

Scale: rows are transformed where they are read, without a shuffle. Results leave a task
every CHUNK characters, so that a batch of very long texts is never held twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many are rearranged, and of a hundred of those so many start with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Characters of results that a task holds at most, but for a single longer text.
CHUNK = 1 << 22

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cut_points(text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` units of ``text`` end."""
    units, passed, at, ends = UNIT.finditer(text), 0, 0, []
    for rank in (low, high):
        if rank > passed:
            at, passed = next(islice(units, rank - passed - 1, None)).end(), rank
        ends.append(at)
    return ends[0], ends[1]


def draws(key: str, seed: int) -> list[int]:
    """Four whole numbers below 2**32 that ``key`` and ``seed`` determine."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, key: str, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    n = count_units(text)
    first, second, chance, order = draws(key, seed)
    if not text or chance % 100 >= REARRANGED or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = cut_points(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _arrange(docs: DataFrame, seed: int) -> DataFrame:
    """(row, RESULT): ``row`` holds the columns of ``docs`` but for the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            start, held, size = 0, [], 0

            def taken() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _FIELDS, strict=True)]
                return pa.RecordBatch.from_arrays([rows.slice(start, len(held)), *columns], ["row", *(name for name, _ in _FIELDS)])

            for i in range(batch.num_rows):
                held.append(arranged(texts[i].as_py(), keys[i].as_py(), seed))
                size += len(held[-1][-1])
                if size >= CHUNK:
                    yield taken()
                    start, held, size = i + 1, [], 0
            if held:
                yield taken()

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(others, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), whole_text().alias("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, {RESULT}")


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with each text rearranged (and ``n_chars`` told anew where there is one)."""
    new = {"text": F.col("output"), "n_chars": F.length("output").cast("long")}
    return _arrange(docs, seed).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Texts that hold a marker stay plain, and none
    can arise where a part ends, so each marker of the other forms occurs once."""
    left = lambda c, mark: F.substring_index(c, mark, 1)
    right = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(right(left(output, SUFFIX), PREFIX), right(output, MIDDLE), left(right(output, SUFFIX), MIDDLE))
    spm = F.concat(left(right(output, PREFIX), MIDDLE), right(output, MIDDLE), right(left(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle_report(docs: DataFrame, seed: int = 1) -> DataFrame:
    return _arrange(docs.select("doc_id", "text"), seed).select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, len(u) AS n,
    ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS chance, ('0x' || h[25:32])::BIGINT % 100 AS ord FROM hashed
), parts AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR chance >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN ord < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

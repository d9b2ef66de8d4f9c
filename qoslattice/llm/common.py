"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only on
    one machine (tests) a temporary folder takes its place where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Tables lie under ``<shared>/<application id>/``, which ``clean_up`` deletes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    home = f"{spark.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if home in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has written by ``materialize``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts and results that a task of ``mapped`` holds about at once, but for a single larger row.
PORTION_BYTES = 4 << 20


def mapped(rows: DataFrame, of: Callable[[str], tuple], fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """(text_key, ``fields``) for ``rows`` (text_key, text): what ``of`` makes of each text.

    Texts are taken from a batch one by one and results leave as soon as PORTION_BYTES are
    there, so memory does not grow with the rows of a batch. Arrays come as numpy arrays."""

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        offsets = [0]
        for v in values:
            offsets.append(offsets[-1] + len(v))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_joined(values), kind.value_type))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, start, held, size = batch.column(0), batch.column(1), 0, [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                held.append(of(text))
                size += len(text) + sum(x.nbytes if hasattr(x, "nbytes") else len(x) if isinstance(x, bytes) else 8 for x in held[-1])
                if size >= PORTION_BYTES or i == batch.num_rows - 1:
                    columns = [column(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(held)), *columns], ["text_key", *(n for n, _ in fields)])
                    start, held, size = i + 1, [], 0

    return rows.select("text_key", "text").mapInArrow(work, f"text_key long, {schema}")


def _joined(arrays):
    import numpy as np

    return np.concatenate(arrays) if arrays else np.array([], np.int64)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key() -> Column:
    """With doc_id, tells rows of different text apart; equal rows share it. A null
    text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_text(rows: DataFrame, columns: list[str], text: Column, same: Column) -> DataFrame:
    """The struct ``row`` of ``rows``, spread out, with its text replaced; an
    ``n_chars`` follows, unless ``same`` says that the text stays."""
    row = F.col("row").withField("text", text)
    if "n_chars" in columns:
        row = row.withField("n_chars", F.when(same, F.col("row.n_chars")).otherwise(F.length(text).cast("long")))
    return rows.select(row.alias("row")).select("row.*")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does that on pure ASCII and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of ``op`` over each value and all before it; ``values``: an array of
    ints, not empty. A step of an aggregate copies its state: so runs of about sqrt(n)
    values are gone through by themselves, and then moved by what came before."""
    none = F.array().cast("array<int>")

    def grown(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), x)).otherwise(x)))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda at: F.aggregate(F.slice(v, at, width), none, grown))
        return bound(runs, lambda r: bound(
            F.aggregate(F.transform(r, lambda x: F.element_at(x, -1)), none, grown),
            lambda ends: F.flatten(F.transform(r, lambda x, i: F.when(i > 0, F.transform(x, lambda y: op(ends[i - 1], y))).otherwise(x))),
        ))

    return bound(values, of)


SPAN = "struct<start:int,end:int,match:string,value:string,before:string,after:string>"


def regex_spans(text: Column, regex: str, whole: Column, values: Column, context: int = 0) -> Column:
    """Spans of all matches of ``regex`` in ``text``: see ``spans_between``."""
    return spans_between(gaps_of(text, regex, whole), whole, values, context)


def gaps_of(text: Column, regex: str, whole: Column) -> Column:
    """What lies between the matches ``whole``, if there are any."""
    return F.when(F.size(whole) > 0, F.split(text, regex, -1)).otherwise(F.array().cast("array<string>"))


def spans_between(found_gaps: Column, whole: Column, values: Column, context: int = 0) -> Column:
    """Spans of matches ``whole``: the gaps between them give the offsets, in code
    points, the end exclusive. ``values``: the group that a rule judges. ``before`` and
    ``after`` hold ``context`` characters around a match, those beyond the matches
    next to it left out.
    """
    blank, n = F.array(F.lit("")), F.size(whole)

    def steps(gaps: Column) -> Column:
        parts = [F.slice(gaps, F.lit(1), n).alias("gap"), whole.alias("match"), values.alias("value")]
        if context:
            parts += [
                F.concat(blank, F.slice(whole, F.lit(1), n - 1)).alias("last"), F.slice(gaps, F.lit(2), n).alias("rest"),
                F.concat(F.slice(whole, F.lit(2), n - 1), blank).alias("next"),
            ]
        return F.arrays_zip(*parts)

    def around(x: Column) -> list[Column]:
        if not context:
            return [F.lit("").alias("before"), F.lit("").alias("after")]
        return [F.right(F.concat(x["last"], x["gap"]), F.lit(context)).alias("before"), F.left(F.concat(x["rest"], x["next"]), F.lit(context)).alias("after")]

    def spans(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: F.length(y["gap"]) + F.length(y["match"])), lambda a, b: a + b)
        return bound(ends, lambda e: F.transform(x, lambda y, i: F.struct(
            (e[i] - F.length(y["match"])).alias("start"), e[i].alias("end"), y["match"].alias("match"), y["value"].alias("value"), *around(y)
        )))

    joined = lambda gaps: bound(steps(gaps), spans)
    return F.when(n > 0, bound(found_gaps, joined)).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Code points of the blocks in which places of a text are found.
BLOCK = 4096


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the ``spans`` (one at least, sorted by start) replaced by
    its kind in brackets; of overlapping spans the first names the whole.

    Finding a place in a text means counting from its start: so the text is cut into
    blocks first, and a place is found in its block."""
    blocks = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(BLOCK)), lambda at: F.substring(text, at + 1, F.lit(BLOCK)))

    def between(b: Column, low: Column, high: Column) -> Column:
        i, j = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
        start = low - i * BLOCK
        return F.when(i == j, F.substring(b[i], start + 1, high - low)).otherwise(
            F.concat(F.substring(b[i], start + 1, F.lit(BLOCK)), F.array_join(F.slice(b, i + 2, j - i - 1), ""), F.substring(b[j], F.lit(1), high - j * BLOCK))
        )

    def out(b: Column) -> Column:
        def of(upto: Column) -> Column:
            # What a span covers that starts before the end of an earlier one is gone with that.
            before = lambda i: F.when(i > 0, upto[i - 1]).otherwise(0)
            parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(b, before(i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), between(b, F.element_at(upto, -1), F.length(text)))

        return bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)

    return bound(blocks, out)


def span_digest(spans: Column, by_kind: bool) -> Column:
    """``kind:start:end`` comma-joined, by start then kind or the other way round.

    ``spans``: array of struct(start, end, rank, kind).
    """
    first, second = ("rank", "start") if by_kind else ("start", "rank")
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s[first].alias("a"), s[second].alias("b"), s["end"].alias("end"),
                s["kind"].alias("kind"), s["start"].alias("start"),
            ),
        )
    )
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )

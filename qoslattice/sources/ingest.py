"""CSV ingest: stage, clean, validate, merge into the star schema.

Files are read as strings and mapped to canonical fields; nothing is inferred.
The merge is idempotent: a fact that is already stored stays as it is.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import header_key, name_similarity, numbered, parsed_date, place_key, token_overlap
from .star import MEASURES

FIELDS = ("date", "cell", "site", "district", "region", *MEASURES)
#: Names of summary rows, which are not places.
SUMMARY_WORDS = ("total", "avg", "average", "sum", "grand total")
#: How texts begin that a cast takes for numbers.
NUMBER_START = r"^[\x00-\x20]*(?:[-+.0-9]|(?i:inf|nan))"
CORRUPT = "_rejected"
#: Lines of a header at most.
HEADER_LINES = 100
#: Letters that tell the buckets of new names apart.
NAME_PREFIX = 8


class IngestError(ValueError):
    pass


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of the files in order; a byte order mark is no part
    of them. ``line`` orders rows by file, by place of the split in it, and within
    the split, whatever tasks read them."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    return spark.read.text(path).select("value", place.alias("line"))


def _odd(value: Column) -> Column:
    """1 if ``value`` holds an odd number of quotes: a field is left open, or closed."""
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the records of the files; one whose quoted fields hold line breaks
    takes several lines, joined by a line feed, and has the place of its first.

    A parity scan: a record begins where an even number of quotes lies behind it. Of a split
    only its number of odd lines and the last of them are added up over the file, so a field
    may go over any edge; lines are sorted in splits that hold or continue such a field, and
    no others. A quote that nothing closes to the end of its file opens no field: from
    there on each line stands alone.
    """
    lines = _lines(spark, path)
    if lines.filter(_odd(F.col("value")) == 1).isEmpty():
        return lines
    of = {c: F.col(f"line.{c}").alias(c) for c in ("file", "split", "nth")}
    odd = _odd(F.col("value")).alias("odd")
    sums = lines.select(of["file"], of["split"], of["nth"], odd).groupBy("file", "split").agg(F.sum("odd").alias("turns"), F.max(F.when(F.col("odd") == 1, F.col("nth"))).alias("last"))
    # A row a split from here: the record that goes on into a split began at the last odd line before it.
    file = Window.partitionBy("file")
    before = file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("last").isNotNull(), F.struct("split", F.col("last").alias("nth")))
    splits = sums.select(
        "file", "split", "turns", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).alias("behind"), F.last(turn, ignorenulls=True).over(before).alias("began"),
        F.when(F.sum("turns").over(file) % 2 == 1, F.max(turn).over(file)).alias("unclosed"),
    )
    rows = lines.select("value", *of.values(), odd).join(splits, ["file", "split"])
    calm = (F.col("turns") == 0) & (F.col("behind") == 0)
    in_split = Window.partitionBy("file", "split").orderBy("nth")
    place = F.struct("split", "nth")
    behind = F.col("behind") + F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.coalesce(place >= F.col("unclosed"), F.lit(False))
    marked = rows.filter(~calm).withColumn("begins", (behind % 2 == 0) | alone)
    first = F.last(F.when(F.col("begins"), place), ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("first", F.coalesce(first, "began"))
    whole = marked.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("split", "nth", "value"))).alias("lines"))
    line = lambda at: F.struct("file", F.col(f"{at}split").alias("split"), F.col(f"{at}nth").alias("nth")).alias("line")
    return rows.filter(calm).select("value", line("")).unionByName(whole.select(F.array_join("lines.value", "\n").alias("value"), line("first.")))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file (of a folder: of one of its files)."""
    first = _first_record(spark, path)
    if first is None:
        return []
    names = [x.strip() for x in next(csv.reader([first]), [])]
    doubles = sorted({n for n in names if names.count(n) > 1})
    if doubles:
        raise IngestError(f"duplicate header: {', '.join(doubles)}")
    return names


def _first_record(spark: SparkSession, path: str) -> str | None:
    """The header: the first line, and those after it that a quoted name goes on in."""
    lines = _lines(spark, path).filter("line.split = 0")
    first = lines.limit(1).collect()
    if not first or first[0]["value"].count('"') % 2 == 0:
        return first[0]["value"] if first else None
    file = first[0]["line"]["file"]
    found = ""
    for row in lines.filter(F.col("line.file") == file).orderBy("line").limit(HEADER_LINES).collect():
        found = f"{found}\n{row['value']}" if found else row["value"]
        if found.count('"') % 2 == 0:
            return found
    raise IngestError("the header has a quote that nothing closes")


def stage_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, the malformed text of a rejected row, and the row's
    place in its file (``line``). Headers and blank lines are no rows; quoted fields
    may hold line breaks and doubled quotes."""
    names = header_of(spark, path)
    if not names:
        raise IngestError("the file has no header")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + f", {CORRUPT} string"
    header = _first_record(spark, path)
    rows = records(spark, path).filter((F.trim("value") != "") & (F.col("value") != F.lit(header)))
    parsed = F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("row"), "line").select("row.*", "line")


def file_checksum(spark: SparkSession, path: str) -> str:
    """Names a file's content, to find it imported again: lines' hashes, summed so
    that the order of tasks does not matter, and their number."""
    row = _lines(spark, path).agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("total")).first()
    return f"{row['n']:x}-{int(row['total'] or 0) % (1 << 64):016x}"


def split_rejects(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return staged.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), staged.filter(F.col(CORRUPT).isNotNull())


def reject_counts(staged: DataFrame) -> DataFrame:
    """(good, rejected): numbers of rows, in one pass."""
    return staged.agg(F.count_if(F.col(CORRUPT).isNull()).alias("good"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected"))


def sample(spark: SparkSession, path: str, rows: int = 30) -> DataFrame:
    return split_rejects(stage_csv(spark, path))[0].drop("line").limit(rows)


#: Canonical field: header keys that mean it.
ALIASES = {
    "date": ("date", "datetime", "time", "day", "timestamp", "start time", "period"),
    "cell": ("cell", "cell name", "cellname", "cell id", "eutrancell", "lte cell"),
    "site": ("site", "site name", "basestation", "base station", "enodeb", "node b", "bts"),
    "district": ("district", "city", "municipality", "area"),
    "region": ("region", "province", "zone"),
    "prb": ("prb utilization", "4g peak hour traffic utilization nca", "peak prb utilization", "dl prb utilization"),
    "volume_mb": ("data volume mb", "4g data volume std mb", "data volume", "traffic volume mb"),
    "users": ("connected users", "rrc connected ues avg std", "users", "rrc connected users"),
    "throughput_kbps": ("dl throughput kbps", "e utran ip throughput ue dl std kbps", "dl throughput", "user throughput kbps"),
    "availability_pct": ("cell availability", "4g cell availability std", "availability"),
}


def key_of(header: str) -> str:
    """The driver's twin of ``header_key``, for single names."""
    return re.sub(r"[^a-z0-9]+", " ", header.lower().replace("utilisation", "utilization")).strip()


def auto_map(headers: list[str]) -> dict[str, str]:
    """Canonical field to header, by exact aliases; the first header wins."""
    keys = {}
    for h in headers:
        keys.setdefault(key_of(h), h)
    return {f: keys[a] for f, names in ALIASES.items() if (a := next((n for n in names if n in keys), None))}


def mapping_confidence(mapping: dict[str, str], headers: list[str]) -> float:
    if not {"date", "cell"} <= set(mapping):
        return 0.2
    found = sum(m in mapping for m in MEASURES)
    return round(0.5 + min(0.5, found / max(3, len(headers) - 2) * 0.5), 2)


def header_fingerprint(headers: list[str]) -> str:
    """Names a header set, whatever its order: two 32-bit FNV-1a hashes, the second of the reversed text."""
    text = "|".join(sorted(map(key_of, headers)))

    def fnv(data: bytes) -> int:
        h = 0x811C9DC5
        for b in data:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    return f"{fnv(text.encode()):08x}{fnv(text[::-1].encode()):08x}"


#: Words that speak for a technology, in headers or file names.
TECHNOLOGY_WORDS = {
    "2G": ("tch", "sdcch", "gsm", "gprs", "edge", "2g"), "3G": ("hsdpa", "hsupa", "wcdma", "umts", "rnc", "rab", "3g"),
    "4G": ("lte", "prb", "eutran", "utran", "erab", "enodeb", "volte", "4g"),
}


def technology_of(headers: list[str], filename: str = "") -> str | None:
    """By the number of words found; a file name's word counts double."""
    words = " ".join(map(key_of, headers)).split()
    name = key_of(filename).split()
    scores = {t: sum(w in ws for w in words) + 2 * sum(w in ws for w in name) for t, ws in TECHNOLOGY_WORDS.items()}
    best = max(scores.values())
    return next((t for t in scores if scores[t] == best), None) if best else None


def discover_kpis(headers: DataFrame, kpis: DataFrame, least: float = 0.5) -> DataFrame:
    """(header, kpi_key, overlap): the KPI of each header. A name (label, key or alias)
    that equals the header wins, else the one that shares most words, by ``least`` at
    least; ties go to the first key. Words are joined, so only names that share one meet."""
    aliases = F.col("aliases") if "aliases" in kpis.columns else F.array().cast("array<string>")
    names = kpis.select("kpi_key", F.explode(F.concat(F.array("label", "kpi_key"), aliases)).alias("name")).select("kpi_key", header_key("name").alias("k")).distinct()
    mine = headers.select("header", header_key("header").alias("h")).distinct()
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
    pairs = mine.select("header", "h", word("h")).join(names.select("kpi_key", "k", word("k")), "word").filter("word <> ''").select("header", "h", "kpi_key", "k").distinct()
    scored = pairs.select("header", "kpi_key", token_overlap("h", "k").alias("overlap"), (F.col("h") == F.col("k")).alias("same")).filter(F.col("overlap") >= least)
    best = Window.partitionBy("header").orderBy(F.desc("same"), F.desc("overlap"), "kpi_key")
    return scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "same")


def _place(c: Column) -> Column:
    """Null for numbers, summary words and names without a letter."""
    text = F.trim(c)
    # A cast that fails is dear, so it is tried on texts that begin as numbers do.
    number = text.rlike(NUMBER_START) & text.try_cast("double").isNotNull()
    bad = number | F.lower(text).isin(*SUMMARY_WORDS) | ~text.rlike("[a-zA-Z]")
    return F.when(~bad, text)


def remap(values: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``column`` with misspelt names replaced: ``aliases`` holds alias and name."""
    known = aliases.select(place_key("alias").alias("_alias"), F.col("name").alias("_name"))
    return values.join(known, place_key(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_name", column)).drop("_alias", "_name")


def typed(raw: DataFrame, mapping: dict[str, str] | None = None, usable: str | None = None) -> DataFrame:
    """Canonical columns of every row, ``line`` and the unmapped columns as a map
    ``extra``; where the column ``usable`` says no, date and cell are null."""
    mapping = mapping or {f: f for f in FIELDS if f in raw.columns}
    rest = [c for c in raw.columns if c not in mapping.values() and c not in ("line", CORRUPT, usable)]
    of = lambda f: F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")
    kept = lambda c: F.when(F.col(usable), c) if usable else c
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]) if rest else F.create_map().cast("map<string,string>")
    return raw.select(
        kept(parsed_date(of("date"))).alias("date"), kept(_place(of("cell"))).alias("cell"), *[_place(of(f)).alias(f) for f in ("site", "district", "region")],
        *[F.trim(of(m)).try_cast("double").alias(m) for m in MEASURES], extra.alias("extra"), "line",
    )


def is_real() -> Column:
    return F.col("date").isNotNull() & F.col("cell").isNotNull()


def real_rows(rows: DataFrame) -> DataFrame:
    """Without rows that have no date or no real cell name."""
    return rows.filter(is_real())


def clean(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Typed rows of real cells."""
    return real_rows(typed(raw, mapping))


def dedupe(rows: DataFrame) -> DataFrame:
    """The first row of the file for each cell and day."""
    first = Window.partitionBy("date", "cell").orderBy("line")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def validation_counts(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """All checks in one pass: one row of counts."""
    mapping = mapping or {f: f for f in FIELDS if f in raw.columns}
    of = lambda f: F.trim(F.col(f"`{mapping[f]}`")) if f in mapping else F.lit(None).cast("string")
    number = lambda f: of(f).try_cast("double")
    blank = lambda f: of(f).isNull() | (of(f) == "")
    checks = {
        "rows": F.lit(True), "no_date": blank("date"), "bad_date": ~blank("date") & parsed_date(of("date")).isNull(), "no_cell": blank("cell"),
        **{f"bad_{m}": ~blank(m) & number(m).isNull() for m in MEASURES},
        **{f"range_{m}": (number(m) < 0) | (number(m) > 100) for m in ("prb", "availability_pct")},
        **{f"negative_{m}": number(m) < 0 for m in ("volume_mb", "users", "throughput_kbps")},
    }
    return raw.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])


def place_rows(rows: DataFrame, *fields: str) -> DataFrame:
    """(fields, times): how often the rows name the same places; one row each."""
    return rows.groupBy(*fields).agg(F.count("*").alias("times"))


def majority_parent(rows: DataFrame, child: str, parent: str, times: str | None = None) -> DataFrame:
    """(child, parent): each child's most frequent parent, ties by name; a row counts
    once, or as often as its column ``times`` says."""
    counts = rows.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(child, parent).agg((F.sum(times) if times else F.count("*")).alias("n"))
    order = Window.partitionBy(child).orderBy(F.desc("n"), parent)
    return counts.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(child, parent)


def with_ids(names: DataFrame, column: str, known: DataFrame, id_column: str) -> DataFrame:
    """New names of a dimension with ids that follow the largest known id.

    New names are numbered by the letters that they start with, those of one start in one task."""
    new = names.select(column).filter(F.col(column).isNotNull()).distinct().join(known, column, "left_anti")
    top = known.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))  # one row
    placed = numbered(new, F.substring(column, 1, NAME_PREFIX), [column], "nth")
    return placed.join(top).select((F.col("top") + F.col("nth")).cast("long").alias(id_column), column)


def backfill(cells: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``cells`` with null ``columns`` filled from ``parents``."""
    right = parents.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = cells.join(right, key, "left")
    return filled.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in cells.columns])


def new_facts(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet: the oldest wins."""
    return rows.join(stored, keys, "left_anti")


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key by ``version``; at equal versions the change."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_new")


def replace_partitions(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with all rows of the keys in ``recomputed`` replaced."""
    return stored.join(recomputed.select(*keys).distinct(), keys, "left_anti").unionByName(recomputed)


def unpivot_kpis(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(date, cell, kpi_key, value) from the map ``extra``; ``names``: header, kpi_key."""
    long = rows.select("date", "cell", F.explode("extra").alias("header", "raw"))
    # As many names as a file has columns.
    return long.join(F.broadcast(names), "header").select("date", "cell", "kpi_key", F.trim("raw").try_cast("double").alias("value")).filter("value IS NOT NULL")


@dataclass(frozen=True)
class DerivedKpi:
    """``operation``: SUM, AVERAGE, RATIO (first over second) or CUSTOM, which sums."""

    key: str
    operation: str
    sources: tuple[str, ...]
    missing_as_zero: bool = False
    scale: float = 1.0


def derived_value(kpi: DerivedKpi, extra: Column) -> Column:
    values = [F.trim(F.element_at(extra, F.lit(s))).try_cast("double") for s in kpi.sources]
    if kpi.missing_as_zero:
        values = [F.coalesce(v, F.lit(0.0)) for v in values]
    if kpi.operation == "RATIO":
        return F.when(values[1] > 0, values[0] / values[1] * kpi.scale)
    total = reduce(Column.__add__, values)
    return (total / len(values) if kpi.operation == "AVERAGE" else total) * kpi.scale


def derived(rows: DataFrame, kpis: list[DerivedKpi]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(k.key).alias("kpi_key"), derived_value(k, F.col("extra")).alias("value")) for k in kpis])
    return rows.select("date", "cell", F.explode(values).alias("x")).select("date", "cell", "x.*").filter("value IS NOT NULL")


def derivable(kpis: list[DerivedKpi], headers: list[str]) -> list[str]:
    return [k.key for k in kpis if set(k.sources) <= set(headers)]


def derivable_of(files: DataFrame, kpis: list[DerivedKpi]) -> DataFrame:
    """(source, kpi_key): which ``kpis`` the headers of each of many ``files`` (source, headers) suffice for."""
    wanted = F.array(*[F.struct(F.lit(k.key).alias("kpi_key"), F.array(*[F.lit(s) for s in k.sources]).alias("sources")) for k in kpis])
    met = F.filter(wanted, lambda k: F.size(F.array_except(k["sources"], F.col("headers"))) == 0)
    return files.select("source", F.explode(met).alias("k")).select("source", "k.kpi_key")


#: Names up to this length are matched by letters, longer ones by pairs of letters.
SHORT_NAME = 10


def _name_tokens(name: Column, least: float) -> Column:
    """Tokens of which two names as similar as ``least`` share one. Names of distance
    d share all but 2 d of the longer one's pairs of letters, which leaves one from 11
    letters on at 0.55; shorter ones share the ``least`` part of their letters (the
    n-th of a kind is a letter of its own), so one of the first that are left when
    the rest is fewer than that."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - 1))
    pairs = F.transform(at, lambda i: F.substring(name, i, F.lit(2)))
    letters = F.array_sort(F.split(name, ""))
    nth = F.transform(letters, lambda c, i: F.concat(F.lit("1"), c, (i - F.array_position(letters, c) + 1).cast("string")))
    short = F.slice(nth, 1, (F.length(name) - F.ceil(least * F.length(name)) + 1).cast("int"))
    return F.array_distinct(F.when(F.length(name) <= SHORT_NAME, F.concat(pairs, short)).otherwise(pairs))


def similar_names(unknown: DataFrame, known: DataFrame, least: float = 0.55) -> DataFrame:
    """(name, candidate, similarity): the best known name for each unknown one, by
    edit distance; names that are equal but for case and blanks need none. Names meet
    by the tokens that such a similarity implies (for ``least`` of 0.55 and more), so no pair is lost."""
    if least < 0.55:
        raise ValueError("tokens are only implied from 0.55 on")
    a = unknown.select(F.col("name"), place_key("name").alias("a")).filter("a <> ''").distinct()
    b = known.select(F.col("name").alias("candidate"), place_key("name").alias("b")).filter("b <> ''").distinct()
    pairs = (
        a.withColumn("token", F.explode(_name_tokens(F.col("a"), least))).join(b.withColumn("token", F.explode(_name_tokens(F.col("b"), least))), "token")
        .filter(F.least(F.length("a"), F.length("b")) >= least * F.greatest(F.length("a"), F.length("b"))).filter("a <> b").drop("token").distinct()
    )
    scored = pairs.withColumn("similarity", name_similarity("a", "b")).filter(F.col("similarity") >= least)
    best = Window.partitionBy("name").orderBy(F.desc("similarity"), "candidate")
    return scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("name", "candidate", "similarity")


def dim_duplicates(cells: DataFrame, name: str = "cell") -> DataFrame:
    return cells.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def repair(cells: DataFrame, facts: DataFrame, name: str = "cell") -> tuple[DataFrame, DataFrame]:
    """One cell a name, the one of least id, and facts re-pointed to it: of several
    on a day the one with most measures, then of the least old id."""
    kept = cells.groupBy(name).agg(F.min("cell_id").alias("kept_id"))
    moves = cells.select("cell_id", name).join(kept, name).select("cell_id", "kept_id")
    present = reduce(Column.__add__, [F.col(m).isNotNull().cast("int") for m in MEASURES])
    best = Window.partitionBy("kept_id", "date").orderBy(F.desc(present), "cell_id")
    moved = facts.join(moves, "cell_id").withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    survivors = cells.join(kept.select(F.col("kept_id").alias("cell_id")), "cell_id", "left_semi")
    return survivors, moved.drop("rn", "cell_id").withColumnRenamed("kept_id", "cell_id").select(*facts.columns)


def integrity(cells: DataFrame, facts: DataFrame, extras: DataFrame) -> DataFrame:
    """(problem, n): broken keys of a store."""
    doubles = lambda df, keys: df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n"))
    checks = {
        "duplicate_facts": doubles(facts, ["cell_id", "date"]), "duplicate_kpis": doubles(extras, [*(["technology"] if "technology" in extras.columns else []), "cell_id", "date", "kpi_key"]),
        "duplicate_cells": doubles(cells, ["cell_id"]), "orphan_facts": facts.join(cells, "cell_id", "left_anti").agg(F.count("*").alias("n")),
        "cells_without_site": cells.filter("site_id IS NULL").agg(F.count("*").alias("n")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("problem"), "n") for k, df in checks.items()])


def place_stats(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(field, distinct, matched, unmatched): how a file's places meet the stored ones (field, name)."""
    fields = ("cell", "site", "district", "region")
    names = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in fields])).alias("x")).select("x.field", place_key("x.name").alias("key"))
    names = names.filter("key IS NOT NULL").distinct()
    stored = known.select("field", place_key("name").alias("key")).distinct().withColumn("hit", F.lit(1))
    return names.join(stored, ["field", "key"], "left").groupBy("field").agg(
        F.count("*").alias("distinct"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched")
    )


def place_values(rows: DataFrame, known: DataFrame, field: str, top: int = 8) -> DataFrame:
    """(name, rows, matched): a file's most frequent values of ``field``."""
    stored = known.filter(F.col("field") == field).select(place_key("name").alias("key")).distinct().withColumn("hit", F.lit(True))
    counts = rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("name")).agg(F.count("*").alias("rows")).withColumn("key", place_key("name"))
    return counts.join(stored, "key", "left").select("name", "rows", F.coalesce("hit", F.lit(False)).alias("matched")).orderBy(F.desc("rows"), "name").limit(top)


def place_suggestions(rows: DataFrame, known: DataFrame, field: str) -> DataFrame:
    """(name, candidate, similarity): stored names that a file's unknown ones may mean."""
    stored = known.filter(F.col("field") == field).select("name")
    keys = stored.select(place_key("name").alias("key")).distinct()
    unknown = rows.select(F.col(field).alias("name")).filter("name IS NOT NULL").distinct().withColumn("key", place_key("name")).join(keys, "key", "left_anti")
    return similar_names(unknown.select("name"), stored)

"""Repair of a dimension and of every table that refers to it.

Names that mean one place, by an alias or because they are written alike, become one row.
Aliases may lead to names that are aliases themselves: chains are followed to their ends by
doubling steps. Facts, KPIs, notes and states of work then move to the ids that stay, and
of rows that meet there each table keeps one, by its own rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import place_key
from .ingest import IngestError
from .star import MEASURES

LEVELS = ("cell", "site", "district", "region")
#: A chain of 2 to this power aliases is a mistake.
ROUNDS = 30


def alias_ends(aliases: DataFrame) -> DataFrame:
    """(level, alias, name): ``aliases`` of the same columns, each led to the end of its
    chain. Names meet by ``place_key``, which the aliases come as; an alias of itself is
    none, of two names for one alias the first by order counts, and a circle is an error."""
    own = aliases.select("level", place_key("alias").alias("alias"), F.col("name"), place_key("name").alias("at")).filter("alias <> at")
    reached = own.groupBy("level", "alias").agg(F.min(F.struct("name", "at")).alias("to")).select("level", "alias", "to.*")
    for _ in range(ROUNDS):
        step = reached.select("level", F.col("alias").alias("at"), F.col("name").alias("next"), F.col("at").alias("next_at"))
        # A table of aliases is small; each round reads what the one before has found.
        after = reached.join(step, ["level", "at"], "left").select("level", "alias", F.coalesce("next", "name").alias("name"), F.coalesce("next_at", "at").alias("at"), F.col("next").isNotNull().alias("moved")).cache()
        if not after.filter("alias = at").isEmpty():
            raise IngestError("aliases go round in a circle")
        if after.filter("moved").isEmpty():
            return after.select("level", "alias", "name")
        reached = after.drop("moved")
    raise IngestError("aliases go round in a circle")


def _renamed(cells: DataFrame, ends: DataFrame) -> DataFrame:
    for level in LEVELS:
        known = ends.filter(F.col("level") == level).select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
        cells = cells.join(known, place_key(level) == F.col("_alias"), "left").withColumn(level, F.coalesce("_name", level)).drop("_alias", "_name")
    return cells


def repaired_cells(cells: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, moves): one row a name, and (level, id, kept) for every id of every level.
    The least id of a name stays; a cell's gaps are filled from its doubles in order of ids."""
    named = _renamed(cells, alias_ends(aliases)) if aliases is not None else cells
    moves = []
    for level in LEVELS:
        same = Window.partitionBy(place_key(level))
        # The row that bears the name itself gives the spelling and the id; the least id decides.
        kept, name = F.min(f"{level}_id").over(same), F.min_by(level, f"{level}_id").over(same)
        ids = named.filter(F.col(f"{level}_id").isNotNull()).select(F.col(f"{level}_id").alias("id"), level).distinct() if level != "cell" else named.select(F.col("cell_id").alias("id"), level)
        per_id = ids.withColumnRenamed("id", f"{level}_id").select(F.lit(level).alias("level"), F.col(f"{level}_id").alias("id"), kept.alias("kept"), name.alias("name"))
        moves.append(per_id)
    every = reduce(DataFrame.unionByName, moves)
    for level in LEVELS[1:]:
        of = every.filter(F.col("level") == level).groupBy(F.col("id").alias(f"{level}_id")).agg(F.min("kept").alias("_kept"), F.min("name").alias("_name"))
        named = named.join(of, f"{level}_id", "left").withColumn(f"{level}_id", F.coalesce("_kept", f"{level}_id")).withColumn(level, F.coalesce("_name", level)).drop("_kept", "_name")
    of = every.filter("level = 'cell'").select(F.col("id").alias("cell_id"), "kept", "name")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("cell_id"))).alias(c)
    rest = [c for c in cells.columns if c not in ("cell_id", "cell")]
    one = named.drop("cell").join(of, "cell_id").groupBy("kept").agg(F.first("name").alias("cell"), *[first(c) for c in rest])
    return one.withColumnRenamed("kept", "cell_id").select(*cells.columns), every.groupBy("level", "id").agg(F.min("kept").alias("kept"))


def moved(rows: DataFrame, moves: DataFrame, keys: list[str], better: list[Column], of: Column | None = None, id_column: str = "cell_id") -> DataFrame:
    """``rows`` under the ids that stay, one for each of ``keys``: the first in order of
    ``better``, then the one that had the id all along, then by least old id. Rows whose id
    the dimension doesn't know go. ``of``: the level of a row's id, a cell's if not given."""
    to = moves.select(F.col("level").alias("_level"), F.col("id").alias("_old"), F.col("kept").alias("_kept"))
    met = rows.join(to, (F.col(id_column) == F.col("_old")) & (F.col("_level") == (F.lit("cell") if of is None else of)))
    order = Window.partitionBy(*[F.col("_kept") if k == id_column else F.col(k) for k in keys]).orderBy(*better, F.col("_old") != F.col("_kept"), "_old")
    best = met.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    return best.select(*[F.col("_kept").alias(c) if c == id_column else F.col(c) for c in rows.columns])


def moved_facts(facts: DataFrame, moves: DataFrame) -> DataFrame:
    present = reduce(Column.__add__, [F.col(m).isNotNull().cast("int") for m in MEASURES])
    return moved(facts, moves, ["cell_id", "date"], [F.desc(present)])


def moved_extras(extras: DataFrame, moves: DataFrame) -> DataFrame:
    return moved(extras, moves, ["cell_id", "date", "technology", "kpi_key"], [F.col("value").isNull()])


def moved_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    return moved(notes, moves, ["cell_id", "at", "author", "note"], [])


def moved_status(status: DataFrame, moves: DataFrame) -> DataFrame:
    return moved(status, moves, ["scope", "id"], [F.desc_nulls_last("review_date")], F.col("scope"), "id")

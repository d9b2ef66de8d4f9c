"""Stored period tables of a workspace, kept up to date by what imports touched.

``cell_<grain>`` and ``lifecycle_<grain>`` lie in folders by period and slice of cells.
After an import only the touched periods of its cells are aggregated anew. A cell's later
lifecycle rows follow from its row before the first touched period, whose streak and
measures they carry on, and from its stored rows after that: no earlier day is read.
Folders that hold a changed row are rewritten, with the other cells of their slice.

A new ruleset or KPI registry, and a store whose folders were rewritten, change every row:
then the tables are built as a whole. ``state.json`` names what the tables were made of and
is written last, so a refresh that fails is made again: its input is the workspace, and
stored rows that no import has touched. One refresh runs at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import period_start
from ..operators.aggregates import cell_period
from ..operators.intelligence import lifecycle_of
from .star import Star
from .workspace import Workspace

#: Folders of cells in a period, if not told.
SLICES = 32
CELL_ROW = (
    "period date, cell_id long, observed_days long, breach_days long, prb_avg double, prb_max double, volume_mb double, users double, "
    "throughput_kbps double, availability_pct double, is_nc boolean, slice int"
)
LIFE_ROW = (
    "period date, cell_id long, is_nc boolean, streak long, lifecycle string, trend string, severity string, severity_score long, observed_days long, "
    "breach_days long, prb_avg double, throughput_kbps double, users double, volume_mb double, availability_pct double, slice int"
)


@dataclass
class Refreshed:
    """What a refresh did: ``whole`` tables, or so many rows of cells and of lifecycles."""

    version: str
    whole: bool
    cell_rows: int = 0
    lifecycle_rows: int = 0


class Derived:
    """``slices``: folders of cells in a period, so many that one holds a few million cells at most."""

    def __init__(self, ws: Workspace, path: str | None = None, grains: tuple[str, ...] = ("weekly", "monthly"), slices: int = SLICES):
        self.ws, self.path, self.grains, self.slices = ws, (path or f"{ws.path}/derived").rstrip("/"), grains, slices

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64("cell_id"), F.lit(self.slices)).cast("int")

    def table(self, name: str) -> DataFrame:
        return self._stored(name).drop("slice")

    def _stored(self, name: str) -> DataFrame:
        return self.ws.spark.read.schema(CELL_ROW if name.startswith("cell") else LIFE_ROW).parquet(f"{self.path}/{name}")

    def state(self) -> dict | None:
        place = self.ws._path(f"{self.path}/state.json")
        if not self.ws._fs.exists(place):
            return None
        stream = self.ws._fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def refresh(self) -> Refreshed:
        """Bring the tables to the workspace's present version."""
        version = self.ws.version
        manifest, state = self.ws.manifest(version), self.state()
        now = {"version": version, "rules": manifest["rules"], "grains": list(self.grains), "slices": self.slices, "folders": {n: manifest["folders"][n] for n in ("facts", "extras", "kpis")}}
        grown = state is not None and all(set(state["folders"][n]) <= set(now["folders"][n]) for n in ("facts", "extras"))
        star = self.ws.star(version)
        if grown and all(state[k] == now[k] for k in ("rules", "grains", "slices")) and state["folders"]["kpis"] == now["folders"]["kpis"]:
            added = {n: [f for f in now["folders"][n] if f not in state["folders"][n]] for n in ("facts", "extras")}
            done = self._partial(star, version, added)
        else:
            for grain in self.grains:
                self._write(cell_period(star, grain), f"cell_{grain}")
                # From the stored rows: facts are read once.
                self._write(lifecycle_of(self.table(f"cell_{grain}").drop("prb_max"), star, grain), f"lifecycle_{grain}")
            done = Refreshed(version, True)
        stream = self.ws._fs.create(self.ws._path(f"{self.path}/state.json"), True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        return done

    def _write(self, rows: DataFrame, name: str, mode: str = "static") -> None:
        rows = rows.drop("slice").withColumn("slice", self._slice())
        dealt = rows.repartition("period", "slice").sortWithinPartitions("period", "slice", "cell_id")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("period", "slice").parquet(f"{self.path}/{name}")

    def _partial(self, star: Star, version: str, added: dict[str, list[str]]) -> Refreshed:
        days = None
        for name, folders in added.items():
            if folders:
                found = self.ws._table(name, folders).select("cell_id", "date")
                days = found if days is None else days.unionByName(found)
        done = Refreshed(version, False)
        if days is None:
            return done
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        for grain in self.grains:
            # A month's compliance is that of the weeks that start in it, one of which may hold a day of the next month.
            hit = [period_start("date", grain)] + ([period_start(period_start("date", "weekly"), "monthly")] if grain == "monthly" else [])
            days.select("cell_id", F.explode(F.array_distinct(F.array(*hit))).alias("period")).distinct().write.parquet(f"{staging}/{grain}")
            touched = self.ws.spark.read.schema("cell_id long, period date").parquet(f"{staging}/{grain}")
            cells, lives = self._partial_grain(star, grain, touched)
            done.cell_rows += cells
            done.lifecycle_rows += lives
        self.ws._fs.delete(self.ws._path(staging), True)
        return done

    def _partial_grain(self, star: Star, grain: str, touched: DataFrame) -> tuple[int, int]:
        """Rewrite what the periods ``touched`` (cell_id, period) change; returns numbers of rows."""
        span = touched.agg(F.min("period").alias("low"), F.max("period").alias("high")).first()
        if span["low"] is None:
            return 0, 0
        # As many numbers as there are slices at most.
        slices = [r["slice"] for r in touched.select(self._slice().alias("slice")).distinct().collect()]
        firsts = touched.groupBy("cell_id").agg(F.min("period").alias("first"))
        fresh = self._aggregated(star, grain, span, firsts).join(touched, ["cell_id", "period"], "left_semi")
        cells, lives = self._stored(f"cell_{grain}").filter(F.col("slice").isin(slices)), self._stored(f"lifecycle_{grain}").filter(F.col("slice").isin(slices))
        n_cells = self._merge(fresh, cells, f"cell_{grain}")
        # The rows are stored now: the lifecycle reads them instead of the facts.
        fresh = self._stored(f"cell_{grain}").filter(F.col("slice").isin(slices)).join(touched, ["cell_id", "period"], "left_semi").drop("prb_max", "slice")
        of_cells = lives.join(firsts, "cell_id")
        columns = fresh.columns
        seeded = F.struct(*[c for c in columns if c != "cell_id"], F.col("streak").alias("seed"))
        before = of_cells.filter(F.col("period") < F.col("first")).groupBy("cell_id").agg(F.max_by(seeded, "period").alias("last")).select("cell_id", "last.*")
        later = of_cells.filter((F.col("period") >= F.col("first")) & (F.col("period") >= F.lit(span["low"]))).join(touched, ["cell_id", "period"], "left_anti").select(*columns, F.lit(None).cast("long").alias("seed"))
        rows = fresh.withColumn("seed", F.lit(None).cast("long")).unionByName(later).unionByName(before)
        judged = lifecycle_of(rows, star, grain).join(firsts, "cell_id").filter(F.col("period") >= F.col("first")).drop("first")
        return n_cells, self._merge(judged, lives, f"lifecycle_{grain}")

    def _aggregated(self, star: Star, grain: str, span, firsts: DataFrame) -> DataFrame:
        """Cells by period from the facts of the touched cells between the first and the
        last touched period. A month also needs the weeks that start in it as a whole."""
        low, high = F.lit(span["low"]), F.last_day(F.lit(span["high"])) if grain == "monthly" else F.date_add(F.lit(span["high"]), 6)
        low, high = (F.date_sub(low, 6), F.date_add(high, 6)) if grain == "monthly" else (low, high)
        within = (F.col("date").between(low, high)) & (F.col("month").between(F.trunc(low, "month"), F.trunc(high, "month")))
        near = lambda df: df.filter(within).join(firsts.select("cell_id"), "cell_id", "left_semi")
        return cell_period(replace(star, facts=near(star.facts), extras=near(star.extras), _periods={}), grain)

    def _merge(self, changed: DataFrame, stored: DataFrame, name: str) -> int:
        """Rewrite the folders that ``changed`` falls into; other rows of theirs stay."""
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        changed.drop("slice").withColumn("slice", self._slice()).write.parquet(staging)
        changed = self.ws.spark.read.parquet(staging)
        folders = changed.select("period", "slice").distinct()
        others = stored.join(folders, ["period", "slice"], "left_semi").join(changed.select("cell_id", "period"), ["cell_id", "period"], "left_anti")
        self._write(changed.unionByName(others.select(*changed.columns)), name, "dynamic")
        n = changed.count()
        self.ws._fs.delete(self.ws._path(staging), True)
        return n

"""Workspaces: append-only Parquet folders, versions that list them, and imports.

``data/<table>/<id>`` holds what one change added; nothing there is ever changed.
``versions/<number>.json`` names the folders that make up a version, with its
rules, its KPI registry and the import that made it. Readers take the highest
number, so a failed import leaves no trace and a new ruleset writes one small
file. Facts and KPIs lie in folders by month, which scans prune. Paths go through
Hadoop's file systems, so a workspace may lie in any store.

Writers don't wait for each other. Each builds the version after the one that it
read, and creates that number's file only if it isn't there; who comes second builds
anew on what the first has made. While a writer works, ``running/<token>`` keeps
``maintenance.purge`` from the folders that it has written.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules, as_row, updated
from ..operators import aggregates
from ..operators.investigate import NOTES
from . import ingest, kpis, repair
from .star import DEFAULT_TECHNOLOGY, MEASURES, Star

CELLS = "cell_id long, cell string, site_id long, site string, district_id long, district string, region_id long, region string"
FACTS = "cell_id long, date date, " + ", ".join(f"{m} double" for m in MEASURES)
EXTRAS = "cell_id long, date date, technology string, kpi_key string, value double"
STATUS = "scope string, id long, status string, owner string, review_date date"
SCHEMAS = {"cells": CELLS, "facts": FACTS, "extras": EXTRAS, "kpis": kpis.SCHEMA, "status": STATUS, "notes": NOTES}
#: Rules that are a KPI's target, too.
KPI_TARGETS = {
    "prb_threshold_pct": ("prb_utilization",), "tch_congestion_pct": ("tch_congestion",), "sdcch_congestion_pct": ("sdcch_congestion",),
    "cssr_pct": ("call_setup_success_2g", "call_setup_success_3g", "call_setup_success_4g"),
    "call_drop_pct": ("call_drop_rate_2g", "call_drop_rate_3g", "call_drop_rate_4g"),
    "data_access_pct": ("data_access_success_3g",), "data_failure_pct": ("data_service_failure_4g",),
}
#: Tables that lie in folders by month.
DATED = ("facts", "extras")


#: How often a writer builds anew because another came first.
ATTEMPTS = 20
#: Seconds after which an empty version file is what a dead writer has left.
STUCK = 600


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class ImportResult:
    import_id: str
    source_rows: int
    inserted: int
    duplicates: int
    rejected: int
    new_cells: int


@dataclass
class Change:
    """One try at the next version: what it is built on, and what it has written."""

    ws: Workspace
    token: str
    base: str | None
    folders: dict[str, list[str]]
    rules: Rules
    written: list[str] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.ws._table(name, self.folders[name])

    def append(self, name: str, rows: DataFrame) -> str:
        """A new folder with ``rows``; its path below the workspace."""
        folder = f"data/{name}/batch={self.token}-{uuid.uuid4().hex}"
        self.written.append(folder)
        self.ws._write(name, rows, folder)
        return folder

    def replace(self, name: str, rows: DataFrame) -> None:
        self.folders[name] = [self.append(name, rows)]

    def add(self, name: str, rows: DataFrame) -> None:
        self.folders[name] = [*self.folders[name], self.append(name, rows)]


def _rules(manifest: dict) -> Rules:
    return Rules(**manifest["rules"] | {"priority_weights": tuple(manifest["rules"]["priority_weights"])})


class Workspace:
    def __init__(self, spark: SparkSession, path: str, rules: Rules | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path
        if self.version is None:
            if self._fs.exists(self._path(f"{self.path}/data")):
                raise ValueError(f"{self.path} holds data, but no complete version")
            first = Change(self, "", None, {n: [] for n in SCHEMAS}, rules or Rules())
            try:
                self._commit(first, None)
            except Conflict:
                pass  # another writer made the workspace just now

    def versions(self) -> list[str]:
        """Complete versions: a file that is still being written has no length yet."""
        folder = self._path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder) if s.getLen() > 0] if self._fs.exists(folder) else []
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    @property
    def version(self) -> str | None:
        return (self.versions() or [None])[-1]

    def manifest(self, version: str | None = None) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/versions/{version or self.version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def rules_of(self, version: str | None = None) -> Rules:
        return _rules(self.manifest(version))

    @property
    def rules(self) -> Rules:
        return self.rules_of()

    def _commit(self, change: Change, made_by: dict | None) -> str:
        """The version after the change's base; ``Conflict`` if that is there already."""
        row = {"folders": change.folders, "rules": as_row(change.rules), "made_by": made_by, "base": change.base, "at": datetime.now(UTC).isoformat()}
        name = f"{int(change.base or 0) + 1:012d}"
        if not self._create(f"versions/{name}.json", json.dumps(row).encode()):
            raise Conflict(f"another writer committed version {name}")
        return name

    def _create(self, name: str, content: bytes) -> bool:
        """A new file below the workspace; False if there is one of this name. The store
        decides, in one step: no look beforehand can tell."""
        goal = self._path(f"{self.path}/{name}")
        if goal.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
            # Hadoop's local files can't be created so; a link to a whole file can.
            place = goal.toUri().getPath()
            part = f"{place}.{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(part, "wb") as f:
                f.write(content)
            try:
                os.link(part, place)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            stream = self._fs.createFile(goal).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", True).build()
            stream.write(bytearray(content))
            stream.close()
            return True
        except Py4JJavaError:
            if not self._fs.exists(goal):
                raise
            status = self._fs.getFileStatus(goal)
            if status.getLen() == 0 and datetime.now(UTC).timestamp() - status.getModificationTime() / 1000 > STUCK:
                self._fs.delete(goal, False)
            return False

    def update(self, build: Callable[[Change], dict | None], token: str | None = None) -> tuple[str, dict | None]:
        """The version that ``build`` makes of the latest one, and what it returns, which
        the history keeps. ``build`` runs again on the new latest version whenever another
        writer was first, so no change is lost and none is made on what it has not seen."""
        token = token or uuid.uuid4().hex
        running = self._path(f"{self.path}/running/{token}")
        self._create(f"running/{token}", b"running")
        try:
            for _ in range(ATTEMPTS):
                base = self.version
                change = None
                try:
                    manifest = self.manifest(base)
                    change = Change(self, token, base, {n: list(manifest["folders"].get(n, [])) for n in SCHEMAS}, _rules(manifest))
                    made_by = build(change)
                    if not self._fs.exists(running):
                        raise RuntimeError("the running change was purged")
                    return self._commit(change, made_by), made_by
                except Exception:
                    for folder in change.written if change else ():
                        self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                    # On a base that is no longer the latest, folders may have been purged meanwhile.
                    if self.version == base:
                        raise
            raise Conflict(f"other writers were first {ATTEMPTS} times")
        finally:
            self._fs.delete(running, False)

    def running(self, stale_hours: float = 24.0) -> set[str]:
        """Tokens of the changes under way; one without an end for so long is dead."""
        folder = self._path(f"{self.path}/running")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else ()
        since = datetime.now(UTC).timestamp() - 3600 * stale_hours
        return {s.getPath().getName() for s in found if s.getModificationTime() / 1000 >= since}

    def _write(self, name: str, rows: DataFrame, folder: str) -> None:
        if name in DATED:
            rows = rows.withColumn("month", F.trunc("date", "month"))
            # One task a month and slice of cells: few files, sorted for the readers' statistics.
            rows.repartition("month", F.pmod(F.xxhash64("cell_id"), F.lit(16))).sortWithinPartitions("month", "cell_id", "date").write.partitionBy("month").parquet(f"{self.path}/{folder}")
        else:
            rows.write.parquet(f"{self.path}/{folder}")

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self._table(name, self.manifest(version)["folders"][name])

    def _table(self, name: str, folders: list[str]) -> DataFrame:
        schema = SCHEMAS[name] + (", month date" if name in DATED else "")
        if not folders:
            # Known to be empty to the planner, which leaves out joins with it.
            return kpis.seeds(self.spark) if name == "kpis" else self.spark.createDataFrame([], schema).limit(0)
        return self._read(name, folders)

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        return self._batches(name, folders).drop("batch")

    def _batches(self, name: str, folders: list[str]) -> DataFrame:
        schema = SCHEMAS[name] + (", month date" if name in DATED else "") + ", batch string"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{name}").parquet(*[f"{self.path}/{f}" for f in folders])

    def star(self, version: str | None = None) -> Star:
        """The state of ``version``, under the rules of that version."""
        version = version or self.version
        t = {n: self.table(n, version) for n in ("cells", "facts", "extras", "kpis")}
        return Star(self.spark, t["cells"], t["facts"], t["extras"], t["kpis"], self.rules_of(version))

    def snapshot(self) -> str:
        """A name under which the present state stays readable."""
        return self.version

    def set_rules(self, **patch) -> Rules:
        """The next ruleset; facts stay, everything derived follows when read. KPIs
        whose target a changed rule is get that target."""
        def build(change: Change) -> dict:
            change.rules = updated(change.rules, **patch)
            synced = [(key, float(patch[name])) for name, keys in KPI_TARGETS.items() if name in patch for key in keys]
            if synced:
                target = F.col("target")
                for key, value in synced:
                    target = F.when(F.col("kpi_key") == key, value).otherwise(target)
                change.replace("kpis", change.table("kpis").withColumn("target", target))
            return {"kind": "rules", "patch": patch}

        return self.rules_of(self.update(build)[0])

    def rulesets(self) -> DataFrame:
        """(ruleset, version, at, rules): every ruleset, rules as JSON; the latest has the greatest number."""
        rows = {}
        for v in self.versions():
            m = self.manifest(v)
            rows.setdefault(m["rules"]["version"], (m["rules"]["version"], v, m["at"], json.dumps(m["rules"])))
        return self.spark.createDataFrame(list(rows.values()), "ruleset long, version string, at string, rules string")

    def set_status(self, rows: DataFrame) -> None:
        """The state of work of any number of entities (STATUS): new, or in the place of the old."""
        changes = rows.select("scope", "id", "status", "owner", "review_date")
        self._replace("status", lambda stored: ingest.replace_partitions(stored, changes, ["scope", "id"]))

    def add_notes(self, rows: DataFrame) -> None:
        """Append ``rows`` (NOTES) to the notes on cells."""

        def build(change: Change) -> dict:
            change.add("notes", rows.select("cell_id", F.col("at").cast("date").alias("at"), "author", "note"))
            return {"kind": "notes"}

        self.update(build)

    def set_kpis(self, changes: DataFrame) -> None:
        """Add KPIs to the registry, or change them."""
        self._replace("kpis", lambda stored: kpis.save(stored, changes))

    def remove_kpi(self, technology: str, key: str) -> None:
        self._replace("kpis", lambda stored: kpis.remove(stored, technology, key))

    def reset_kpis(self) -> None:
        self._replace("kpis", lambda stored: kpis.reset(stored, self.spark))

    def _replace(self, name: str, rows: Callable[[DataFrame], DataFrame]) -> None:
        """The table ``name`` as ``rows`` makes it of the stored one."""

        def build(change: Change) -> dict:
            change.replace(name, rows(change.table(name)))
            return {"kind": name}

        self.update(build)

    def history(self) -> DataFrame:
        """(version, at, kind, file, checksum, source_rows, inserted, duplicates, rejected, new_cells, score): what made each version."""
        rows = []
        for v in self.versions():
            m = self.manifest(v)
            by = m["made_by"] or {}
            rows.append((v, m["at"], by.get("kind", "start"), by.get("file"), by.get("checksum"), *(by.get(c) for c in ("source_rows", "inserted", "duplicates", "rejected", "new_cells", "score"))))
        return self.spark.createDataFrame(rows, "version string, at string, kind string, file string, checksum string, source_rows long, inserted long, duplicates long, rejected long, new_cells long, score double")

    def import_rows(self, raw: DataFrame, mapping: dict[str, str], kpi_names: DataFrame | None = None, derived: list | None = None, source: dict | None = None, technology: str = DEFAULT_TECHNOLOGY) -> ImportResult:
        """Clean, merge and commit staged rows; re-importing inserts nothing.

        ``raw`` may hold rejected rows (``ingest.CORRUPT``). It is read once: the
        cleaned rows, and the first ones of cells and days named twice, are staged in the
        workspace's folder until the commit."""
        bad = F.col(ingest.CORRUPT).isNotNull() if ingest.CORRUPT in raw.columns else F.lit(False)
        token = uuid.uuid4().hex
        staging = f"{self.path}/staging/{token}"
        # Rejected and unusable rows stay as nulls, to be counted.
        every = self._staged(ingest.typed(raw.withColumn("usable", ~bad), mapping, "usable"), f"{staging}/every")
        # One row a cell and day; a file that names none twice needs no sort.
        days, real = every.groupBy("date", "cell").agg(F.count("*").alias("n")), ingest.is_real()
        told = days.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("usable"), F.count_if(real).alias("first"),
            F.trunc(F.min(F.when(real, F.col("date"))), "month").alias("low"), F.trunc(F.max(F.when(real, F.col("date"))), "month").alias("high"),
        ).first()
        total, usable = told["total"], told["usable"]
        rows = ingest.real_rows(every).drop("line")
        if told["first"] < usable:
            rows = self._staged(ingest.dedupe(ingest.real_rows(every)).drop("line"), f"{staging}/rows")
        places = self._staged(ingest.place_rows(rows, "cell", "site", "district", "region"), f"{staging}/places")
        within = lambda df: df.filter(F.col("month").between(told["low"], told["high"]))
        present = [F.avg(F.col(m).isNotNull().cast("double")) for m in MEASURES]
        seen = rows.agg((100 * sum(present[1:], present[0]) / len(present)).alias("complete")).first()
        seen_cells = places.select("cell").distinct().count()
        more = [df for df in (ingest.unpivot_kpis(rows, kpi_names) if kpi_names is not None else None, ingest.derived(rows, derived) if derived else None) if df is not None]

        def build(change: Change) -> dict:
            """Ids and anti-joins against the version that the change is built on."""
            stored_cells, facts, extras = change.table("cells"), within(change.table("facts")), within(change.table("extras"))
            change.replace("cells", self._merged_cells(stored_cells, places, f"{staging}/{uuid.uuid4().hex}"))
            merged = change.table("cells")
            known = merged.select("cell_id", "cell")
            keyed = rows.join(known, "cell")
            added = change.append("facts", ingest.new_facts(keyed.select("cell_id", "date", *MEASURES), facts, ["cell_id", "date"]))
            inserted = self._table("facts", [added]).count()
            change.folders["facts"] += [added] if inserted else []
            for df in more:
                found = df.join(known, "cell").select("cell_id", "date", F.lit(technology).alias("technology"), "kpi_key", "value")
                # Other technologies' rows share no key with these, and statistics tell where they lie.
                stored = extras.filter(F.col("technology") == technology)
                change.add("extras", ingest.new_facts(found, stored, ["cell_id", "date", "technology", "kpi_key"]))
                extras = extras.unionByName(self._table("extras", change.folders["extras"][-1:]))
            cells = merged.count()
            counts = {
                "source_rows": total, "inserted": inserted, "duplicates": usable - inserted, "rejected": total - usable,
                "new_cells": cells - stored_cells.count(),
            }
            score = aggregates.quality_score(
                F.lit(100.0 * seen_cells / max(1, cells)), F.lit(seen["complete"] or 0.0), F.lit(ingest.mapping_confidence(mapping, raw.columns)),
                F.lit((total - usable) / max(1, total)), F.lit((usable - inserted) / max(1, total)),
            )
            return {"kind": "import", **(source or {}), **counts, "score": self.spark.range(1).select(score).first()[0]}

        try:
            version, made_by = self.update(build, token)
        finally:
            self._fs.delete(self._path(staging), True)
        return ImportResult(version, *(made_by[c] for c in ("source_rows", "inserted", "duplicates", "rejected", "new_cells")))

    def _staged(self, rows: DataFrame, path: str) -> DataFrame:
        """``rows`` written once, where several plans read them."""
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _merged_cells(self, stored: DataFrame, rows: DataFrame, staging: str) -> DataFrame:
        """``stored`` cells with gaps filled, and new ones under their majority parents;
        ``rows``: ``ingest.place_rows``. Each level's ids follow from the staged names
        alone, so plans don't nest."""
        names = rows.select("cell").distinct()
        for child, parent in (("cell", "site"), ("site", "district"), ("district", "region")):
            names = names.join(ingest.majority_parent(rows, child, parent, "times"), child, "left")
        names = place = self._staged(names, f"{staging}/names")
        for level in ("region", "district", "site"):
            known = stored.filter(F.col(level).isNotNull()).select(level, f"{level}_id").distinct()
            place = place.join(known.unionByName(ingest.with_ids(names, level, known, f"{level}_id").select(level, f"{level}_id")), level, "left")
        place = self._staged(place, f"{staging}/place")
        ids = ingest.with_ids(names, "cell", stored.select("cell", "cell_id"), "cell_id")
        new = place.join(ids, "cell").select(*stored.columns)
        gaps = ["site_id", "site", "district_id", "district", "region_id", "region"]
        return ingest.backfill(stored, place, "cell", gaps).select(*stored.columns).unionByName(new)

    def repair(self, aliases: DataFrame | None = None) -> dict[str, int]:
        """One row a place, by ``aliases`` (level, alias, name) and by names written alike,
        with every table moved to the ids that stay, in one version; returns how many ids
        of each level went. Of facts and KPIs only imports that hold a changed cell are rewritten."""

        def build(change: Change) -> dict:
            cells, moves = repair.repaired_cells(change.table("cells"), aliases)
            home = f"{self.path}/staging/{change.token}-{uuid.uuid4().hex}"
            moves.write.parquet(home)
            moves = self.spark.read.schema("level string, id long, kept long").parquet(home)
            gone = {r["level"]: r["n"] for r in moves.filter("id <> kept").groupBy("level").agg(F.count("*").alias("n")).collect()}
            change.replace("cells", cells)
            changed = moves.filter("level = 'cell' AND id <> kept").select(F.explode(F.array("id", "kept")).alias("cell_id")).distinct()
            for name, of in (("facts", repair.moved_facts), ("extras", repair.moved_extras)):
                if change.folders[name] and gone.get("cell"):
                    batches = {r["batch"] for r in self._batches(name, change.folders[name]).join(changed, "cell_id", "left_semi").select("batch").distinct().collect()}
                    hit = [f for f in change.folders[name] if f.rpartition("batch=")[2] in batches]
                    if hit:
                        new = change.append(name, of(self._table(name, hit).drop("month"), moves))
                        change.folders[name] = [*(f for f in change.folders[name] if f not in hit), new]
            for name, of in (("notes", repair.moved_notes), ("status", repair.moved_status)):
                if change.folders[name]:
                    change.replace(name, of(change.table(name), moves))
            self._fs.delete(self._path(home), True)
            return {"kind": "repair", "gone": gone}

        return self.update(build)[1]["gone"]

    def import_csv(self, path: str, mapping: dict[str, str] | None = None, **more) -> ImportResult:
        """Merge a CSV file; a file whose content was imported before inserts nothing,
        and the history says so by its checksum."""
        staged = ingest.stage_csv(self.spark, path)
        headers = [c for c in staged.columns if c not in ("line", ingest.CORRUPT)]
        found = mapping or self.profile(headers) or ingest.auto_map(headers)
        if not {"date", "cell"} <= set(found):
            raise ingest.IngestError("no date or cell column")
        technology = more.pop("technology", None) or ingest.technology_of(headers, path.rpartition("/")[2]) or DEFAULT_TECHNOLOGY
        rest = [h for h in headers if h not in found.values()]
        if rest and "kpi_names" not in more:
            registry = self.table("kpis").filter((F.col("technology") == technology) & F.col("active"))
            more["kpi_names"] = ingest.discover_kpis(self.spark.createDataFrame([(h,) for h in rest], "header string"), registry)
        source = {"file": path, "checksum": ingest.file_checksum(self.spark, path), "headers": ingest.header_fingerprint(headers), "mapping": found}
        return self.import_rows(staged, found, source=source, technology=technology, **more)

    def profile(self, headers: list[str]) -> dict[str, str] | None:
        """The mapping by which a file with these headers was imported last, in whatever order they came."""
        wanted = ingest.header_fingerprint(headers)
        for v in reversed(self.versions()):
            by = self.manifest(v)["made_by"] or {}
            if by.get("headers") == wanted and set(by["mapping"].values()) <= set(headers):
                return by["mapping"]
        return None

    def imported_before(self, path: str) -> bool:
        """Whether a file of this content was imported already."""
        return not self.history().filter(F.col("checksum") == ingest.file_checksum(self.spark, path)).isEmpty()

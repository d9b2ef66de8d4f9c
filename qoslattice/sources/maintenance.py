"""Upkeep of a workspace: sizes, old versions, archived sources, due times."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from .ingest import integrity
from .workspace import SCHEMAS, Change, Workspace

#: Days for which an imported source file is kept.
RETENTION_DAYS = 90


def sizes(ws: Workspace) -> dict[str, int]:
    """Bytes that each version reads."""
    size = {}

    def of(folder: str) -> int:
        if folder not in size:
            size[folder] = ws._fs.getContentSummary(ws._path(f"{ws.path}/{folder}")).getLength()
        return size[folder]

    return {v: sum(of(f) for folders in ws.manifest(v)["folders"].values() for f in folders) for v in ws.versions()}


def catalog(ws: Workspace) -> DataFrame:
    """(table, rows): what the current version holds."""
    return ws.spark.createDataFrame([(n, ws.table(n).count()) for n in SCHEMAS], "table string, rows long")


def purge(ws: Workspace, keep: tuple[str, ...] = (), stale_hours: float = 24.0) -> list[str]:
    """Delete versions that are neither current nor in ``keep``, and folders that no
    version names; returns the versions' names. Folders of changes under way stay: what is
    there is listed first, then what runs, then what versions name, so a change that ends
    or starts meanwhile loses nothing. A change that runs for ``stale_hours`` is dead."""
    found = {}
    for name in SCHEMAS:
        table = ws._path(f"{ws.path}/data/{name}")
        for s in ws._fs.listStatus(table) if ws._fs.exists(table) else ():
            batch = s.getPath().getName()
            found[f"data/{name}/{batch}"] = batch.removeprefix("batch=").partition("-")[0]
    staged = ws._path(f"{ws.path}/staging")
    for s in ws._fs.listStatus(staged) if ws._fs.exists(staged) else ():
        found[f"staging/{s.getPath().getName()}"] = s.getPath().getName()
    running = ws.running(stale_hours)
    gone = [v for v in ws.versions() if v not in {ws.version, *keep}]
    for v in gone:
        ws._fs.delete(ws._path(f"{ws.path}/versions/{v}.json"), False)
    used = {f for v in ws.versions() for folders in ws.manifest(v)["folders"].values() for f in folders}
    for folder, token in found.items():
        if folder not in used and token not in running:
            ws._fs.delete(ws._path(f"{ws.path}/{folder}"), True)
    return gone


def compact(ws: Workspace) -> str:
    """The current state rewritten to one folder a table; the next imports add to it."""

    def build(change: Change) -> dict:
        for name in SCHEMAS:
            if len(change.folders[name]) > 1:
                change.replace(name, change.table(name).drop("month"))
        return {"kind": "compact"}

    return ws.update(build)[0]


def archive(lines: DataFrame, path: str) -> None:
    """A staged source as compressed text."""
    lines.write.mode("errorifexists").option("compression", "gzip").option("header", True).csv(path)


def expired(archived_at: datetime, now: datetime, days: int = RETENTION_DAYS) -> bool:
    return now - archived_at > timedelta(days=days)


def next_run(last: datetime | None, every_days: int, now: datetime) -> tuple[datetime, bool]:
    """(next run, whether it is due)."""
    following = now if last is None else last + timedelta(days=every_days)
    return following, following <= now


def check(ws: Workspace) -> DataFrame:
    star = ws.star()
    return integrity(star.cells, star.facts, star.extras)

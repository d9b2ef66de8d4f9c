"""Writers that meet: no import, note, status or rule is lost, and none is half there."""

import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from qoslattice.sources import maintenance
from qoslattice.sources.workspace import Change, Conflict, Workspace

MAPPING = {"date": "date", "cell": "cell", "site": "site", "prb": "prb"}


def rows(spark, *found):
    return spark.createDataFrame([(d, c, f"S{c[1]}", "50", i) for i, (d, c) in enumerate(found)], "date string, cell string, site string, prb string, line long")


def held(ws):
    return sorted((str(r["date"]), r["cell"]) for r in ws.table("facts").join(ws.table("cells"), "cell_id").collect())


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, f"file://{tmp_path}/store")


def meanwhile(monkeypatch, ws, other, name="facts"):
    """``other`` runs once, just when ``ws`` is about to write the table ``name``."""
    write, done = ws._write, []

    def held_up(table, df, folder):
        if table == name and not done:
            done.append(1)
            other()
        write(table, df, folder)

    monkeypatch.setattr(ws, "_write", held_up)


def test_interleaved_imports_keep_both(spark, ws, monkeypatch):
    second = Workspace(spark, ws.path)
    # Both bring a cell of their own, and one fact alike.
    meanwhile(monkeypatch, ws, lambda: second.import_rows(rows(spark, ("2026-01-05", "C2"), ("2026-01-06", "C3")), MAPPING))
    result = ws.import_rows(rows(spark, ("2026-01-05", "C1"), ("2026-01-06", "C3")), MAPPING)
    assert held(ws) == [("2026-01-05", "C1"), ("2026-01-05", "C2"), ("2026-01-06", "C3")]
    assert (result.inserted, result.duplicates, result.new_cells) == (1, 1, 1)
    ids = [r["cell_id"] for r in ws.table("cells").collect()]
    assert len(ids) == len(set(ids)) == 3
    assert [(r["inserted"], r["new_cells"]) for r in ws.history().filter("kind = 'import'").orderBy("version").collect()] == [(2, 2), (1, 1)]
    assert all(r["n"] == 0 for r in maintenance.check(ws).collect())
    # What the lost try had written is gone, and nothing runs any more.
    folders = {f"data/facts/{s.getPath().getName()}" for s in ws._fs.listStatus(ws._path(f"{ws.path}/data/facts"))}
    assert folders == set(ws.manifest()["folders"]["facts"]) and not ws.running()


def test_status_notes_rules_and_registry_survive_each_other(spark, ws, monkeypatch):
    at = datetime(2026, 1, 5, tzinfo=UTC)
    status = lambda i, s: spark.createDataFrame([("cell", i, s, "me", None)], "scope string, id long, status string, owner string, review_date date")
    note = lambda i: spark.createDataFrame([(i, at, "me", "seen")], "cell_id long, at timestamp, author string, note string")
    second = Workspace(spark, ws.path)
    meanwhile(monkeypatch, ws, lambda: (second.set_status(status(2, "open")), second.add_notes(note(2)), second.set_rules(prb_threshold_pct=70.0)), "status")
    ws.set_status(status(1, "done"))
    ws.add_notes(note(1))
    assert {(r["id"], r["status"]) for r in ws.table("status").collect()} == {(1, "done"), (2, "open")}
    assert {r["cell_id"] for r in ws.table("notes").collect()} == {1, 2} and ws.rules.prb_threshold_pct == 70.0
    monkeypatch.undo()
    meanwhile(monkeypatch, ws, lambda: second.set_rules(weekly_breach_days=2), "kpis")
    # A rule that is a KPI's target writes the registry, too.
    assert ws.set_rules(prb_threshold_pct=90.0).weekly_breach_days == 2 and ws.rules.version == 4
    assert ws.table("kpis").filter("kpi_key = 'prb_utilization'").first()["target"] == 90.0
    rulesets = ws.rulesets().orderBy("ruleset").collect()
    assert [r["ruleset"] for r in rulesets] == [1, 2, 3, 4] and [r["kind"] for r in ws.history().orderBy("version").collect()].count("rules") == 3
    changed = ws.table("kpis").filter("kpi_key = 'mos'").withColumn("target", F.lit(4.0))
    ws.set_kpis(changed)
    assert ws.table("kpis").filter("kpi_key = 'mos'").first()["target"] == 4.0


def test_a_base_that_has_moved_on_is_refused(ws):
    manifest = ws.manifest()
    change = Change(ws, "t", ws.version, manifest["folders"], ws.rules)
    ws.set_rules(prb_threshold_pct=71.0)
    with pytest.raises(Conflict):
        ws._commit(change, None)
    assert len(ws.versions()) == 2 and ws.rules.prb_threshold_pct == 71.0


def test_many_writers_at_once(spark, ws):
    days = [(f"2026-01-{d:02d}", f"C{d}") for d in range(1, 7)]
    threads = [threading.Thread(target=lambda d=d: Workspace(spark, ws.path).import_rows(rows(spark, d), MAPPING)) for d in days]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(ws) == days and len(ws.versions()) == 7
    assert len({r["cell_id"] for r in ws.table("cells").collect()}) == 6


def test_purge_spares_what_runs(spark, ws, monkeypatch):
    ws.import_rows(rows(spark, ("2026-01-05", "C1")), MAPPING)
    dead = f"{ws.path}/data/facts/batch=dead-1"
    ws._fs.mkdirs(ws._path(dead))
    second = Workspace(spark, ws.path)
    gone = []
    # When the facts are about to be written, the folder of cells is there but in no version.
    meanwhile(monkeypatch, ws, lambda: gone.extend(maintenance.purge(second)))
    ws.import_rows(rows(spark, ("2026-01-06", "C2")), MAPPING)
    assert held(ws) == [("2026-01-05", "C1"), ("2026-01-06", "C2")]
    assert gone and not ws._fs.exists(ws._path(dead)) and not ws._fs.exists(ws._path(f"{ws.path}/staging/{gone[0]}"))


def test_a_failed_import_leaves_no_trace(spark, ws, monkeypatch):
    def broken(*_):
        raise OSError("full")

    monkeypatch.setattr(ws, "_write", broken)
    with pytest.raises(OSError):
        ws.import_rows(rows(spark, ("2026-01-05", "C1")), MAPPING)
    assert len(ws.versions()) == 1 and not ws.running() and not ws._fs.listStatus(ws._path(f"{ws.path}/staging"))


def test_catalog_profile_and_checksum(spark, ws, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Cell Name,Peak\n2026-01-05,C1,80\n")
    path = f"file://{tmp_path}/a.csv"
    assert not ws.imported_before(path)
    ws.import_csv(path, {"date": "Date", "cell": "Cell Name", "prb": "Peak"})
    assert ws.imported_before(path) and ws.profile(["Peak", "Cell Name", "Date"]) == {"date": "Date", "cell": "Cell Name", "prb": "Peak"} and ws.profile(["x"]) is None
    assert {r["table"]: r["rows"] for r in maintenance.catalog(ws).collect()} == {"cells": 1, "facts": 1, "extras": 0, "kpis": 31, "status": 0, "notes": 0}

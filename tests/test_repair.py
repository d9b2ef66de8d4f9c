"""Repair of a workspace: chains of aliases, doubles by spelling, and no dead id in any table."""

import datetime

import pytest
from pyspark.sql import functions as F

from qoslattice.sources import ingest, maintenance, repair
from qoslattice.sources.workspace import CELLS, Workspace

ALIASES = "level string, alias string, name string"


def test_chains_end(spark):
    rows = [("cell", "A", "B"), ("cell", " b ", "C"), ("cell", "c", "D"), ("site", "a", "Z"), ("cell", "x", "X"), *[("cell", f"n{i}", f"N{i + 1}") for i in range(40)]]
    got = {(r["level"], r["alias"]): r["name"] for r in repair.alias_ends(spark.createDataFrame(rows, ALIASES)).collect()}
    assert got[("cell", "a")] == got[("cell", "b")] == got[("cell", "c")] == "D" and got[("site", "a")] == "Z" and ("cell", "x") not in got
    assert {got[("cell", f"n{i}")] for i in range(40)} == {"N40"}
    for circle in ([("cell", "a", "b"), ("cell", "b", "a")], [("cell", "a", "b"), ("cell", "b", "c"), ("cell", "c", "b")]):
        with pytest.raises(ingest.IngestError):
            repair.alias_ends(spark.createDataFrame(circle, ALIASES))


def test_cells_and_moves(spark):
    cells = spark.createDataFrame([
        (1, "C1", 1, "S1", 1, "D1", 1, "R"), (2, "c1 ", 2, "s1", None, None, None, None), (3, "C3", None, None, 2, "D2", 1, "R"), (4, "Old", 1, "S1", 1, "D1", 1, "R"), (5, "Older", 3, "S9", 1, "D1", 1, "R"),
    ], CELLS)
    aliases = spark.createDataFrame([("cell", "older", "Old"), ("cell", "old", "C3"), ("site", "S9", "S1"), ("region", "none", "R")], ALIASES)
    kept, moves = repair.repaired_cells(cells, aliases)
    assert {r["id"]: r["kept"] for r in moves.filter("level = 'cell'").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert {r["id"]: r["kept"] for r in moves.filter("level = 'site'").collect()} == {1: 1, 2: 1, 3: 1}
    rows = {r["cell_id"]: r for r in kept.collect()}
    # The gaps of the third cell are filled by its double's site.
    assert set(rows) == {1, 3} and (rows[3]["cell"], rows[3]["site_id"], rows[3]["site"], rows[3]["district"]) == ("C3", 1, "S1", "D2") and rows[1]["cell"] == "C1"
    assert repair.repaired_cells(cells.limit(0), aliases)[0].count() == 0


def test_workspace_repair(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/store")
    mapping = {c: c for c in ("date", "cell", "site", "prb", "users")}
    bring = lambda *rows: ws.import_rows(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "date string, cell string, site string, prb string, users string, k string, line long"), mapping, spark.createDataFrame([("k", "mos")], "header string, kpi_key string"))
    bring(("2026-01-05", "A", "S", "50", None, "3"), ("2026-01-05", "X", "S", "10", "1", "1"))
    bring(("2026-01-05", "B", "S", "60", "7", "4"), ("2026-01-06", "B", "T", "61", "8", None))
    bring(("2026-02-05", "X", "S", "11", "1", "1"))
    ids = {r["cell"]: r["cell_id"] for r in ws.table("cells").collect()}
    ws.add_notes(spark.createDataFrame([(ids["A"], datetime.date(2026, 1, 5), "me", "seen"), (ids["B"], datetime.date(2026, 1, 5), "me", "seen"), (ids["B"], datetime.date(2026, 1, 6), "me", "again")], "cell_id long, at date, author string, note string"))
    ws.set_status(spark.createDataFrame([("cell", ids["A"], "open", "me", None), ("cell", ids["B"], "done", "me", datetime.date(2026, 3, 1)), ("site", 1, "open", "me", None)], "scope string, id long, status string, owner string, review_date date"))
    before, untouched = ws.version, ws.manifest()["folders"]["facts"][2]
    assert ws.repair(spark.createDataFrame([("cell", "B", "A")], ALIASES)) == {"cell": 1}
    assert int(ws.version) == int(before) + 1 and untouched in ws.manifest()["folders"]["facts"]
    facts = {(r["cell_id"], str(r["date"])): (r["prb"], r["users"]) for r in ws.table("facts").collect()}
    a, x = ids["A"], ids["X"]
    # Of two rows on a day the one with more measures stays.
    assert facts == {(a, "2026-01-05"): (60.0, 7.0), (a, "2026-01-06"): (61.0, 8.0), (x, "2026-01-05"): (10.0, 1.0), (x, "2026-02-05"): (11.0, 1.0)}
    assert {(r["cell_id"], str(r["date"]), r["value"]) for r in ws.table("extras").collect()} == {(a, "2026-01-05", 3.0), (x, "2026-01-05", 1.0), (x, "2026-02-05", 1.0)}
    assert sorted((r["cell_id"], r["note"]) for r in ws.table("notes").collect()) == [(a, "again"), (a, "seen")]
    assert {(r["scope"], r["id"], r["status"]) for r in ws.table("status").collect()} == {("cell", a, "done"), ("site", 1, "open")}
    for name, column in (("facts", "cell_id"), ("extras", "cell_id"), ("notes", "cell_id")):
        assert ws.table(name).join(ws.table("cells"), column, "left_anti").count() == 0
    assert all(r["n"] == 0 for r in maintenance.check(ws).collect()) and ws.repair() == {}
    assert ws.star(before).facts.filter(F.col("cell_id") == ids["B"]).count() == 2

"""The worked example of the fixture tables: import, lifecycle, priority, rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from qoslattice.operators import aggregates, intelligence, views
from qoslattice.sources import ingest
from qoslattice.sources.workspace import Workspace

HEADER = "DATETIME,DISTRICT,REGION,CELL,BASESTATION,4G Peak Hour Traffic Utilization_NCA,RRC Connected UEs (Avg)_STD(#),4G Data Volume_STD(MB),4G Cell Availability_STD(%),E-UTRAN IP Throughput UE DL_STD(kbps)"
SEED = [
    ("2026-07-01", "Accra Metro", "Greater Accra", "ACC-001-A", "ACC-001", 82, 45, 1200.5, 99.8, 18000),
    ("2026-07-01", "Accra Metro", "Greater Accra", "ACC-001-B", "ACC-001", 75, 30, 800.2, 99.5, 15000),
    ("2026-07-01", "Kumasi", "Ashanti", "KUM-001-A", "KUM-001", 90, 60, 1500, 98.9, 22000),
    ("2026-07-02", "Accra Metro", "Greater Accra", "ACC-001-A", "ACC-001", 84, 50, 1300, 99.7, 18500),
    ("2026-07-02", "Accra Metro", "Greater Accra", "ACC-001-B", "ACC-001", 72, 28, 700, 99.6, 14000),
    ("2026-07-02", "Kumasi", "Ashanti", "KUM-001-A", "KUM-001", 91, 65, 1600, 98.8, 23000),
]
FILE = [
    ("2026-07-05", "Accra Metro", "Greater Accra", "ACC-001-A", "ACC-001", 88, 52, 1400, 99.7, 19500),
    ("2026-07-05", "Accra Metro", "Greater Accra", "ACC-001-B", "ACC-001", 76, 33, 900, 99.6, 16000),
    ("2026-07-05", "Kumasi", "Ashanti", "KUM-001-A", "KUM-001", 92, 68, 1700, 98.8, 24000),
    ("2026-07-06", "Accra Metro", "Greater Accra", "ACC-001-A", "ACC-001", 89, 55, 1450, 99.8, 19800),
    ("2026-07-06", "Accra Metro", "Greater Accra", "ACC-001-B", "ACC-001", 74, 31, 850, 99.5, 15500),
    ("2026-07-06", "Kumasi", "Ashanti", "KUM-002-A", "KUM-002", 93, 70, 1750, 98.9, 24500),
]


def csv(rows, end="\n"):
    return end.join([HEADER, *(",".join(map(str, r)) for r in rows)]) + end


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    (folder / "seed.csv").write_text(csv(SEED))
    (folder / "file.csv").write_text(csv(FILE), encoding="utf-8-sig")
    ws = Workspace(spark, f"file://{folder}/store")
    ws.folder = folder
    ws.first = ws.import_csv(f"file://{folder}/seed.csv")
    ws.result = ws.import_csv(f"file://{folder}/file.csv")
    return ws


def test_import_is_idempotent(ws):
    assert (ws.first.inserted, ws.first.new_cells) == (6, 3)
    assert (ws.result.inserted, ws.result.new_cells, ws.result.duplicates) == (6, 1, 0)
    again = ws.import_csv(f"file://{ws.folder}/file.csv")
    assert (again.inserted, again.duplicates, again.new_cells) == (0, 6, 0)
    assert ws.star().facts.count() == 12
    assert ws.star().cells.filter("site_id IS NULL OR region_id IS NULL").count() == 0


def test_lifecycle_of_the_last_week(ws):
    rows = {r["cell"]: r for r in intelligence.latest(intelligence.nc_lifecycle(ws.star())).join(ws.star().cells, "cell_id").collect()}
    assert {k: r["lifecycle"] for k, r in rows.items()} == {"ACC-001-A": "Recurring", "ACC-001-B": "Healthy", "KUM-002-A": "New"}
    a = rows["ACC-001-A"]
    assert (a["trend"], a["severity"], a["severity_score"], a["prb_avg"]) == ("Worsening", "Critical", 82, 89.0)
    week = aggregates.cell_weekly(ws.star()).filter(F.col("period") == datetime.date(2026, 6, 29)).join(ws.star().cells, "cell_id").filter("cell = 'ACC-001-A'").first()
    assert round(week["prb_avg"], 2) == 84.67 and week["breach_days"] == 3


def test_priority_and_rules(ws):
    queue = intelligence.priority_queue(ws.star(), limit=50).join(ws.star().cells, "cell_id").orderBy(F.desc("score")).collect()
    assert queue[0]["cell"] == "ACC-001-A" and all(0 <= r["score"] <= 100 for r in queue)
    before = ws.snapshot()
    rules = ws.set_rules(prb_threshold_pct=90.0)
    assert rules.version == 2 and sum(rules.priority_weights) == 100
    rows = {r["cell"]: r["is_nc"] for r in intelligence.latest(intelligence.nc_lifecycle(ws.star())).join(ws.star().cells, "cell_id").collect()}
    assert rows == {"ACC-001-A": False, "ACC-001-B": False, "KUM-002-A": True}
    assert ws.star(before).facts.count() == ws.star().facts.count() == 12
    with pytest.raises(ValueError):
        ws.set_rules(weekly_breach_days=9)
    assert Workspace(ws.spark, ws.path).rules.prb_threshold_pct == 90.0


def test_transitions(ws):
    rows = {r["name"]: r["transition"] for r in views.compare_periods(ws.star(), "cell").filter("metric = 'prb_avg'").collect()}
    assert rows["KUM-002-A"] == "new" and rows["KUM-001-A"] in ("recovered", "ok")


@pytest.mark.parametrize("text,rows", [(csv(FILE[:3]), 3), (csv(FILE[:3]).rstrip("\n"), 3), (csv(FILE[:3], "\r\n"), 3), (csv(FILE[:1]), 1)])
def test_newlines(spark, tmp_path, text, rows):
    (tmp_path / "x.csv").write_bytes(text.encode())
    good, bad = ingest.split_rejects(ingest.stage_csv(spark, f"file://{tmp_path}/x.csv"))
    assert (good.count(), bad.cache().count()) == (rows, 0)


def test_rejects_and_double_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Cell,Cell\n1,2,3\n")
    with pytest.raises(ingest.IngestError):
        ingest.stage_csv(spark, f"file://{tmp_path}/x.csv")
    (tmp_path / "y.csv").write_text('Date,Cell\n2026-07-05,A1\n2026-07-06,A1,too,many\n')
    good, bad = ingest.split_rejects(ingest.stage_csv(spark, f"file://{tmp_path}/y.csv").cache())
    assert (good.count(), bad.count()) == (1, 1)


def test_mapping_helpers():
    headers = HEADER.split(",")
    found = ingest.auto_map(headers)
    assert set(found) == set(ingest.FIELDS)
    assert ingest.mapping_confidence(found, headers) == 0.81
    assert ingest.mapping_confidence({}, headers) == 0.2
    assert ingest.header_fingerprint(headers) == ingest.header_fingerprint(headers[::-1])
    assert ingest.technology_of(headers) == "4G" and ingest.technology_of(["TCH Congestion"]) == "2G" and ingest.technology_of(["x"]) is None


def test_similar_names_and_discovery(spark):
    known = spark.createDataFrame([("Greater Accra",), ("Ashanti",)], "name string")
    rows = ingest.similar_names(spark.createDataFrame([("greter accra",), ("zzz",)], "name string"), known).collect()
    assert [(r["name"], r["candidate"]) for r in rows] == [("greter accra", "Greater Accra")]
    kpis = spark.createDataFrame([("call_drop", "Call drop rate")], "kpi_key string, label string")
    rows = ingest.discover_kpis(spark.createDataFrame([("Call Drop (%)",), ("Other",)], "header string"), kpis).collect()
    assert [(r["header"], r["kpi_key"]) for r in rows] == [("Call Drop (%)", "call_drop")]

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from qoslattice.functions.exprs import add_periods, in_words, period_label
from qoslattice.operators import dossier, overview, reports
from qoslattice.operators.investigate import NOTES
from qoslattice.sources.star import Star, from_orders, kpi_registry


def small(spark, prb):
    """Three cells of two sites in two districts, by day and load."""
    cells = spark.createDataFrame(
        [(1, "C1", 1, "S1", 1, "D1", 1, "R"), (2, "C2", 1, "S1", 1, "D1", 1, "R"), (3, "C3", 2, "S2", 2, "D2", 1, "R")],
        "cell_id long, cell string, site_id long, site string, district_id long, district string, region_id long, region string",
    )
    facts = spark.createDataFrame(
        [(c, date(2026, 1, d), float(v), 100.0, 5.0, 2000.0, 99.9) for c, d, v in prb], "cell_id long, date date, prb double, volume_mb double, users double, throughput_kbps double, availability_pct double"
    )
    extras = facts.select("cell_id", "date", F.lit("4G").alias("technology"), F.lit("call_drop").alias("kpi_key"), (F.col("prb") / 50).alias("value"))
    return Star(spark, cells, facts, extras, kpi_registry(spark))


@pytest.fixture(scope="module")
def star(spark):
    return small(spark, [(c, d, 90 if c == 1 else 40) for c in (1, 2, 3) for d in (5, 12)])


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), dossier.ASKED)


def test_unknown_null_and_repeated_entities(spark, star):
    rows = dossier.identities(star, asked(spark, ("site", 1), ("site", 1), ("site", 99), ("network", None), ("planet", 1), (None, 1))).collect()
    assert {(r["scope"], r["id"]): (r["path"], r["cells"]) for r in rows} == {("site", 1): ("Network > R > D1 > S1", 2), ("network", 0): ("Network", 3)}
    assert dossier.investigation(star, asked(spark, ("cell", 99))).count() == 0
    assert dossier.investigation(star, asked(spark)).count() == 0


def test_evidence_is_the_entitys_own(spark, star):
    rows = {(r["scope"], r["metric"]): (r["current"], r["previous"], r["delta"]) for r in dossier.entity_evidence(star, asked(spark, ("site", 1), ("cell", 1))).collect()}
    assert rows["cell", "prb_avg"] == (90.0, 90.0, 0.0) and rows["site", "prb_avg"] == (65.0, 65.0, 0.0) and rows["site", "users"][0] == 10.0


def test_peers_leave_the_entity_out(spark, star):
    rows = dossier.entity_peers(star, asked(spark, ("cell", 2), ("district", 1), ("region", 1), ("cell", 3)), limit=1).collect()
    assert {(r["scope"], r["id"]): (r["peer"], r["place"]) for r in rows} == {("cell", 2): ("C1", 1), ("district", 1): ("D2", 1)}


def test_parts_of_one_site(spark, star):
    notes = spark.createDataFrame([(1, date(2026, 1, 6), "ops", "visited"), (3, date(2026, 1, 6), "ops", "elsewhere")], NOTES)
    rows = dossier.investigation(star, asked(spark, ("site", 1)), notes=notes).collect()
    assert {r["section"] for r in rows} == {"identity", "series", "evidence", "finding", "hypothesis", "note"}
    assert [r["note"] for r in rows if r["section"] == "note"] == ["ops: visited"]
    assert {(r["item"], r["value"], r["reference"]) for r in rows if r["section"] == "finding"} >= {("prb_high", 1.0, 2.0)}
    assert [(r["value"], r["reference"]) for r in rows if r["item"] == "nc_cells"] == [(1.0, 2.0)] * 2


def test_recommendations_follow_the_state(spark):
    kinds = lambda s: [r["kind"] for r in overview.recommendations(s).orderBy("place").collect()]
    lasting = [(1, d, 95) for d in (5, 12, 19, 26)]
    assert "districts" in kinds(small(spark, lasting)) and "districts" not in kinds(small(spark, [(1, 5, 10)]))
    report = overview.priority_report(small(spark, lasting)).collect()
    assert [(r["cell_id"], r["breached_kpis"]) for r in report] == [(1, 1)] and report[0]["kpi_breach"] > 0


def test_technologies(spark, star):
    (row,) = overview.technology_cards(star).collect()
    # Call drops average (1.8 + 0.8 + 0.8) / 3, below the target: one of three cells is in breach.
    assert (row["technology"], row["cells"], row["nc_cells"], row["breached_cards"], row["compliance_pct"]) == ("4G", 3, 1, 0, 66.7) and row["health"] == 66.7
    (line,) = overview.sparklines(star).collect()
    assert line["dates"] == [date(2026, 1, 5), date(2026, 1, 12)] and len(line["values"]) == 2


def test_labels_and_units(spark):
    rows = spark.createDataFrame([(date(2027, 1, 1), 2048.0, "MB"), (date(2026, 7, 27), 12.34, "%"), (None, None, "kbps"), (date(2026, 3, 2), -1500.0, "kbps"), (date(2026, 3, 1), 3.0, None), (date(2026, 3, 1), 1234567.0, "-")], "d date, v double, u string")
    got = rows.select(period_label("d", "weekly").alias("w"), add_periods("d", 1, "monthly").alias("m"), add_periods("d", -1, "weekly").alias("b"), in_words("v", "u").alias("t")).collect()
    assert [r["w"] for r in got[:3]] == ["W53", "W31", None] and got[0]["m"] == date(2027, 2, 1) and got[1]["b"] == date(2026, 7, 20)
    assert [r["t"] for r in got] == ["2.0 GB", "12.3%", "—", "-1.5 Mbps", "3.0", "1234567.0"]


def test_report_history(spark, sf_dir, tmp_path):
    star, folder = from_orders(spark, sf_dir), f"file://{tmp_path}/reports"
    first = reports.publish(star, folder, "planning", datetime(2026, 7, 1), ("md", "html"), "weekly")
    second = reports.publish(star, folder, "planning", datetime(2026, 7, 9), ("csv",), "weekly")
    (tmp_path / "reports" / "history" / "part-stray.json").write_text("{not json\n")
    rows = reports.history(spark, folder).collect()
    assert [(r["id"], list(r["formats"])) for r in rows] == [(second, ["csv"]), (first, ["md", "html"])] and rows[0]["rows"] > 4
    assert spark.read.text(f"{folder}/packs/{first}.md").filter("value LIKE '## Summary%'").count() == 1
    (due,) = reports.due_reports(reports.history(spark, folder), date(2026, 7, 20)).collect()
    assert (due["last"], due["next_due"], due["days_overdue"]) == (date(2026, 7, 9), date(2026, 7, 16), 4)

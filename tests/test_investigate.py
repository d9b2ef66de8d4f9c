"""Rules by technology, rules of one's own, and interventions with gaps in the weeks."""

from datetime import date, timedelta

import pytest

from qoslattice.operators import investigate
from qoslattice.sources.star import Star, kpi_registry
from qoslattice.sources.workspace import CELLS, EXTRAS, FACTS

MONDAY = date(2026, 1, 5)


@pytest.fixture(scope="module")
def star(spark):
    cells = [(i, f"C{i}", 1, "S", i % 2, f"D{i % 2}", 1, "R") for i in range(1, 5)]
    # Weeks 3 and 4 are missing; the fourth cell starts late.
    weeks = [w for w in range(10) if w not in (3, 4)]
    facts = [(c, MONDAY + timedelta(7 * w), 60.0 + c, 100.0 * (w + 1), 50.0, 9000.0, 99.9) for c in range(1, 5) for w in weeks if c < 4 or w > 6]
    last = MONDAY + timedelta(63)
    extras = [(1, last, "2G", "sdcch_congestion", 9.0), (2, last, "3G", "sdcch_congestion", 9.0), (3, last, "4G", "call_drop_rate_4g", 9.0), (3, last, "2G", "call_drop_rate_2g", 0.1), (4, last, "2G", "call_drop_rate_2g", 9.0)]
    return Star(spark, spark.createDataFrame(cells, CELLS), spark.createDataFrame(facts, FACTS), spark.createDataFrame(extras, EXTRAS).select("cell_id", "date", "technology", "kpi_key", "value"), kpi_registry(spark))


def test_conditions_of_a_technology(star):
    rows = {(r["cell_id"], r["hypothesis"]): r for r in investigate.diagnosis(star).collect()}
    assert "signalling blocks" in rows[(1, "congestion")]["supporting"] and "signalling blocks" not in rows[(2, "congestion")]["supporting"]
    # The newest technology that is measured tells an input; a value of another one decides nothing then.
    assert rows[(3, "retainability")]["supporting"] == "drops" and rows[(3, "retainability")]["opposing"] == "" and rows[(4, "retainability")]["supporting"] == "drops"
    assert rows[(1, "retainability")]["score"] == 30 and len(rows) == 4 * 6


def test_own_rules(spark, star):
    rules = [("idle", "base", 0, "", 10, 0, None, "always", ">=", 0.0), ("idle", "support", 1, "few users", 60, 0, None, "users", "<", 60.0), ("idle", "support", 1, "few users", 60, 1, "4G", "call_drop_rate_4g", ">", 1.0)]
    rows = {r["cell_id"]: (r["score"], r["advice"]) for r in investigate.diagnosis(star, spark.createDataFrame(rules, investigate.RULE_ROW), {"idle": "look"}).collect()}
    assert rows == {1: (10, None), 2: (10, None), 3: (70, "look"), 4: (10, None)}


def test_interventions_reach_over_gaps(spark, star):
    asked = [("cell", 1, MONDAY + timedelta(30)), ("cell", 4, MONDAY), ("district", 1, None), ("network", 0, MONDAY + timedelta(700)), ("cell", 99, MONDAY)]
    found = investigate.interventions_before_after(star, spark.createDataFrame(asked, investigate.INTERVENTION), most=2)
    rows = {(r["scope"], r["id"]): r for r in found.filter("metric = 'volume_mb'").collect()}
    # Of weeks 0, 1, 2, 5, ...: 1 and 2 before day 30, 5 and 6 after.
    assert (rows[("cell", 1)]["before"], rows[("cell", 1)]["after"]) == (250.0, 650.0)
    assert (rows[("cell", 4)]["before"], rows[("cell", 4)]["after"]) == (None, 850.0)
    middle = rows[("district", 1)]
    assert middle["at"] == MONDAY + timedelta(42) and (middle["before"], middle["after"]) == (900.0, 1500.0)
    assert rows[("network", 0)]["after"] is None and rows[("network", 0)]["before"] == 3800.0 and ("cell", 99) not in rows
    one = {r["metric"]: r["before"] for r in investigate.before_after(star, str(MONDAY + timedelta(30)), "cell", 1, most=2).collect()}
    assert one["volume_mb"] == 250.0

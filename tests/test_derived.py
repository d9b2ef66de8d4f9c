"""Stored period tables: after an import they equal a whole rebuild, and no other folder is written."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from qoslattice.operators import intelligence
from qoslattice.operators.aggregates import cell_period
from qoslattice.sources import maintenance
from qoslattice.sources.derived import Derived
from qoslattice.sources.workspace import Workspace

MAPPING = {"date": "date", "cell": "cell", "site": "site", "prb": "prb", "volume_mb": "mb", "users": "users"}
SCHEMA = "date string, cell string, site string, prb string, mb string, users string, drop string, line long"
FIRST = date(2026, 1, 5)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    days = [(c, FIRST + timedelta(d)) for c in range(12) for d in range(0, 84, 2) if rng.random() < 0.8]
    rows = {(c, d): (str(d), f"C{c}", "S", str(rng.choice([60, 70, 85, 95])), str(rng.randint(1, 99)), str(rng.randint(1, 99)), str(rng.choice([0.5, 0.6, 2.0]))) for c, d in days}
    return rows, Workspace(spark, f"file://{tmp_path_factory.mktemp('ws')}/store")


def bring(ws, spark, rows):
    names = spark.createDataFrame([("drop", "call_drop_rate_4g")], "header string, kpi_key string")
    ws.import_rows(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA), MAPPING, kpi_names=names)


def same(derived, ws):
    for grain in derived.grains:
        for name, of in ((f"cell_{grain}", cell_period), (f"lifecycle_{grain}", intelligence.nc_lifecycle)):
            want, got = of(ws.star(), grain), derived.table(name)
            assert set(want.columns) == set(got.columns)
            got = got.select(*want.columns)
            assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()


def files(derived, name):
    return set(derived._stored(name).select(F.input_file_name().alias("f")).distinct().toPandas()["f"])


def test_late_days_change_their_weeks_and_what_follows(spark, made):
    rows, ws = made
    late = {k: r for k, r in rows.items() if k[0] in (3, 7) and 20 <= (k[1] - FIRST).days < 24}
    more = {k: r for k, r in rows.items() if (k[1] - FIRST).days >= 80}
    bring(ws, spark, [r for k, r in rows.items() if k not in late and k not in more])
    derived = Derived(ws)
    assert derived.refresh().whole
    same(derived, ws)
    before = files(derived, "lifecycle_weekly")
    bring(ws, spark, late.values())
    done = derived.refresh()
    assert not done.whole and derived.state()["version"] == ws.version
    same(derived, ws)
    kept = before & files(derived, "lifecycle_weekly")
    # Weeks before the late ones are as they were, and so are the other cells' slices.
    slices = {r["s"] for r in ws.table("cells").filter("cell IN ('C3', 'C7')").select(F.pmod(F.xxhash64("cell_id"), F.lit(32)).alias("s")).collect()}
    first = FIRST + timedelta(14)
    untouched = {f for f in before if not (f.split("period=")[1][:10] >= str(first) and int(f.split("slice=")[1].split("/")[0]) in slices)}
    assert untouched and untouched <= kept
    weekly = [k for k in late if k[0] == 3]
    assert 0 < done.lifecycle_rows < len(rows) and weekly
    # Days at the end, a cell that is new, and a refresh without anything new.
    new = {(99, FIRST + timedelta(40)): (str(FIRST + timedelta(40)), "C99", "S", "90", "1", "1", "0.1")}
    bring(ws, spark, [*more.values(), *new.values()])
    assert not derived.refresh().whole
    same(derived, ws)
    again = derived.refresh()
    assert (again.whole, again.cell_rows, again.lifecycle_rows) == (False, 0, 0)


def test_rules_registry_and_compaction_rebuild(spark, made):
    _, ws = made
    derived = Derived(ws, grains=("weekly",))
    assert derived.refresh().whole
    ws.set_rules(prb_threshold_pct=90.0)
    assert derived.refresh().whole
    same(derived, ws)
    ws.set_kpis(ws.table("kpis").filter("kpi_key = 'call_drop_rate_4g'").withColumn("target", F.lit(0.55)))
    assert derived.refresh().whole
    same(derived, ws)
    maintenance.compact(ws)
    assert derived.refresh().whole

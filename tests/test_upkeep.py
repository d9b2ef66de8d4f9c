from datetime import datetime

from pyspark.sql import functions as F

from qoslattice.operators import intelligence, investigate
from qoslattice.sources import ingest, kpis, maintenance, synthetic
from qoslattice.sources.star import Star, kpi_registry
from qoslattice.sources.workspace import Workspace


def test_registry(spark):
    seeds = kpis.seeds(spark)
    assert {r["technology"]: r["count"] for r in seeds.groupBy("technology").count().collect()} == {"2G": 8, "3G": 10, "4G": 13}
    change = seeds.filter("kpi_key = 'mos'").withColumn("target", F.lit(4.0))
    changed = kpis.save(seeds, change)
    assert changed.count() == 31 and changed.filter("kpi_key = 'mos'").first()["target"] == 4.0
    assert kpis.remove(changed, "4G", "mos").count() == 30
    assert kpis.reset(changed, spark).filter("kpi_key = 'mos'").first()["target"] == 3.5


def test_faults_are_diagnosed(spark):
    rows = synthetic.rows(spark, cells=22, weeks=10).cache()
    cells = rows.select("cell_id", "cell", F.lit(1).cast("long").alias("site_id"), "site", F.lit(1).cast("long").alias("district_id"), "district", F.lit(1).cast("long").alias("region_id"), "region").distinct()
    star = Star(spark, cells, rows.select("cell_id", "date", "prb", "volume_mb", "users", "throughput_kbps", "availability_pct"), synthetic.kpi_rows(rows), kpis.seeds(spark))
    states = {r["cell_id"]: r["lifecycle"] for r in intelligence.latest(intelligence.nc_lifecycle(star)).collect()}
    assert states[2] == states[22] == "Chronic" and states[5] in ("Persistent", "Recurring") and states[12] == "Healthy" and states[17] in ("Recovering", "Healthy")
    top = lambda s: {r["cell_id"]: r["hypothesis"] for r in investigate.diagnosis(s).orderBy("score").collect()}
    # A sleeping cell is told by its fall, in the week in which it begins: the seventh of ten.
    onset = top(star.where(F.col("date") < F.lit("2026-02-23").cast("date")))
    assert onset[8] == "sleeping_cell" and onset[2] == "congestion"
    top = top(star)
    assert top[2] == "congestion" and top[11] == "retainability" and top[14] in ("transport", "interference", "accessibility")


def test_made_up_values_are_the_same_again(spark):
    days = synthetic.rows(spark, cells=20, weeks=2)
    values = synthetic.kpi_rows(days)
    again = synthetic.kpi_rows(synthetic.rows(spark, cells=20, weeks=2).repartition(3, "date"))
    assert values.exceptAll(again).count() == 0 and values.count() == 20 * 14 * 5
    assert {r["technology"] for r in values.select("technology").distinct().collect()} == {"2G", "3G", "4G"}
    assert {r["fault"] for r in days.select("fault").distinct().collect()} == {None, *synthetic.FAULTS}


def test_maintenance(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/store")
    first = ws.version
    maintenance.compact(ws)
    assert set(maintenance.sizes(ws)) == {first, ws.version}
    assert maintenance.purge(ws) == [first] and set(maintenance.sizes(ws)) == {ws.version}
    assert all(r["n"] == 0 for r in maintenance.check(ws).collect())
    now = datetime(2026, 7, 10)
    assert maintenance.next_run(datetime(2026, 7, 1), 7, now) == (datetime(2026, 7, 8), True)
    assert maintenance.expired(datetime(2026, 1, 1), now) and not maintenance.expired(datetime(2026, 7, 1), now)


def test_archive_and_suggestions(spark, tmp_path):
    lines = spark.createDataFrame([("2026-01-05", "C1"), ("2026-01-06", "C\n2")], "date string, cell string")
    maintenance.archive(lines, f"file://{tmp_path}/archive")
    assert {f.suffix for f in (tmp_path / "archive").glob("part-*")} == {".gz"}
    assert spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/archive").count() == 2
    known = spark.createDataFrame([("district", "Greater Accra"), ("district", "Ashanti"), ("site", "Greter Accra")], "field string, name string")
    rows = spark.createDataFrame([("Greter Accra",), ("ashanti",), (None,)], "district string")
    assert [(r["name"], r["candidate"]) for r in ingest.place_suggestions(rows, known, "district").collect()] == [("Greter Accra", "Greater Accra")]

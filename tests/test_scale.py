"""Plans that must not grow: rows are read, cleaned and sorted once, and no file is one task's."""

import glob

import pytest
from pyspark.sql import functions as F

from qoslattice.functions.exprs import DATE_PATTERNS, date_shape, parsed_date
from qoslattice.plans import loading
from qoslattice.sources import ingest
from qoslattice.sources.derived import Derived
from qoslattice.sources.workspace import Workspace

MAPPING = {f: f for f in ("date", "cell", "site", "district", "region", "prb")}


def scans(df, of="Relation ["):
    return df._jdf.queryExecution().optimizedPlan().toString().count(of)


@pytest.fixture
def rows(spark, tmp_path):
    found = [(f"2026-01-{d:02d}", f"C{c}", f"S{c // 2}", "D", "R", str(10 * c), 100 * d + c) for d in range(5, 20) for c in range(5)]
    spark.createDataFrame(found, "date string, cell string, site string, district string, region string, prb string, line long").write.parquet(f"{tmp_path}/rows")
    return spark.read.parquet(f"{tmp_path}/rows")


def test_csv_files_are_many_and_in_order(spark, sf_dir):
    files = sorted(glob.glob(f"{loading._file(spark, sf_dir).removeprefix('file://')}/part-*"))
    heads = [open(f).readline() for f in files]
    assert len(files) > 8 and set(heads) == {heads[0]} and heads[0].startswith('"date","cell"')
    # Rows that stand there again come after all first ones.
    staged = ingest.stage_csv(spark, files[0].rpartition("/")[0])
    again = F.col("prb") == "1"
    last = staged.agg(F.max_by(again, "line").alias("again"), F.count("*").alias("n")).first()
    assert last["again"] and last["n"] == loading.raw_rows(spark, sf_dir).count()


def test_raw_rows_add_facts_up_once(spark, sf_dir):
    assert scans(loading.raw_rows(spark, sf_dir), "Aggregate [") == 1


def test_rejects_are_counted_in_one_pass(spark, sf_dir):
    assert scans(loading._rejects(spark, sf_dir)) == 1


def test_backfill_cleans_rows_once(spark, sf_dir):
    assert "l_shipdate" not in loading._backfilled(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_import_plans_stay_small(spark, rows, tmp_path, monkeypatch):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    ws.import_rows(rows.filter("cell < 'C3'"), MAPPING)
    seen, write = {}, ws._write
    monkeypatch.setattr(ws, "_write", lambda name, df, folder: (seen.update({name: df}), write(name, df, folder)))
    assert ws.import_rows(rows, MAPPING).inserted == 30
    # Once it read the sorted rows 81 times for one new level below another.
    assert scans(seen["cells"]) < 12 and scans(seen["facts"], "row_number") == 0


def test_only_files_that_name_a_day_twice_are_sorted(spark, rows, tmp_path, monkeypatch):
    seen, dedupe = [], ingest.dedupe
    monkeypatch.setattr(ingest, "dedupe", lambda df: seen.append(1) or dedupe(df))
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    assert ws.import_rows(rows, MAPPING).inserted == 75 and not seen
    twice = rows.unionByName(rows.filter("cell = 'C1'").withColumn("line", F.col("line") - 10_000).withColumn("prb", F.lit("77")))
    result = Workspace(spark, f"file://{tmp_path}/again").import_rows(twice, MAPPING)
    assert (result.inserted, result.duplicates, result.source_rows) == (75, 15, 90) and seen
    assert Workspace(spark, f"file://{tmp_path}/again").table("facts").filter("prb = 77").count() == 15


def test_names_of_kpis_are_sent_to_the_rows(spark, rows):
    names = spark.createDataFrame([("site", "x")], "header string, kpi_key string")
    plan = ingest.unpivot_kpis(ingest.typed(rows, {"date": "date", "cell": "cell"}), names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stored_lifecycles_follow_from_stored_weeks(spark, rows, tmp_path, monkeypatch):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    ws.import_rows(rows, MAPPING)
    derived = Derived(ws, grains=("weekly",), slices=1)
    read, write = {}, derived._write
    monkeypatch.setattr(derived, "_write", lambda df, name, *more: (read.update({name: df.inputFiles()}), write(df, name, *more)))
    derived.refresh()
    assert read["cell_weekly"] and all("/derived/cell_weekly/" in f for f in read["lifecycle_weekly"])


def test_dates_as_by_all_patterns_in_turn(spark):
    texts = ["2026-07-05T10:00:00+02:00", "05/07/26", "5/7/26 06:30", "12/28/26", "12/28/2026", "31-02-2026", "2026-7-8", "2026-02-30", "05-Jul-26", "05-Jul-2026", "6.7.69", "6.7.68", "06.07.2070", "20260710", "20261340", "46000", "46000.5", "2026/07/09", "2026-07-28 00:00:00", "2026-07-28 00:00", " 2026 ", "soon", "", None, "12", "1/2", "2026-07", "10000101"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tries = []
    for p in DATE_PATTERNS:
        date = F.try_to_timestamp(F.trim("t"), F.lit(p)).cast("date")
        if "yy" in p and "yyyy" not in p:
            date = F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)
        tries.append(F.when(F.trim("t").rlike(date_shape(p)), date))
    serial = F.when(F.trim("t").rlike(r"^[1-9][0-9]{4}(\.[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.trim("t").try_cast("double").cast("int")))
    for r in df.select("t", parsed_date("t").alias("got"), F.coalesce(*tries, serial, F.trim("t").try_cast("date")).alias("want")).collect():
        assert r["got"] == r["want"], r


def test_places_that_are_numbers(spark):
    names = ["12", "1e5", "NaN", "inf", "-Infinity", "0x1p3", "\t12", "1d", "+.5f", "Infinity Road", "1st", "N12", "nantes", "Total", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    bad = F.trim("n").try_cast("double").isNotNull() | F.lower(F.trim("n")).isin(*ingest.SUMMARY_WORDS) | ~F.trim("n").rlike("[a-zA-Z]")
    for r in df.select("n", ingest._place(F.col("n")).alias("got"), F.when(~bad, F.trim("n")).alias("want")).collect():
        assert r["got"] == r["want"], r

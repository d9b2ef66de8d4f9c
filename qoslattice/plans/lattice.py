"""Queries over the aggregate lattice and the derived intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import MODES
from ..operators import aggregates as A
from ..operators import intelligence as I
from ..sources.star import calendar, from_orders
from . import oracle as O

QUERIES, ORACLE_SQL = {}, {}


def add(name: str, query, sql: str | None = None) -> None:
    """``query`` takes a Star."""
    QUERIES[name] = lambda spark, d, q=query: q(from_orders(spark, d))
    if sql:
        ORACLE_SQL[name] = sql


add("cell_daily", A.cell_daily, O.sql(
    "SELECT date AS period, cell_id, round(prb, 4) AS prb, round(volume_mb, 4) AS volume_mb, round(users, 4) AS users, "
    "round(throughput_kbps, 4) AS throughput_kbps, round(availability_pct, 4) AS availability_pct, is_breach FROM flagged", "flagged"))
add("cell_weekly", A.cell_weekly, O.sql("SELECT * FROM cw", "cw"))
add("cell_monthly", A.cell_monthly, O.sql("SELECT * FROM cm", "cm"))
add("cell_weekly_complete", lambda s: A.cell_weekly(s, complete_weeks_only=True), O.sql("SELECT * FROM cw WHERE period + 6 <= (SELECT max(date) FROM facts)", "cw", "facts"))
for g in ("weekly", "monthly"):
    add(f"kpi_{g}", lambda s, g=g: A.kpi_period(s, g), O.sql(
        f"SELECT {O.start('date', g)} AS period, cell_id, technology, kpi_key, round(avg(value), 4) AS avg, round(sum(value), 4) AS sum, round(max(value), 4) AS max, "
        "round(min(value), 4) AS min, count(value) AS observed_days FROM extras GROUP BY 1, 2, 3, 4", "extras"))
for g in A.GRAINS:
    for level in ("site", "district", "region", "network"):
        add(f"entity_{level}_{g}", lambda s, v=level, g=g: A.entity_period(s, v, g), O.sql(f"SELECT * FROM ent_{level}_{g}", f"ent_{level}_{g}"))
    add(f"nc_lifecycle_{g}", lambda s, g=g: I.nc_lifecycle(s, g), O.sql(f"SELECT * FROM life_{g}", f"life_{g}"))
    add(f"health_network_{g}", lambda s, g=g: I.health_network(s, g), O.health_network(g))
add("entity_cube", A.entity_cube, O.sql(
    "SELECT period, region_id, district_id, site_id, CASE WHEN grouping(site_id) = 0 THEN 'site' WHEN grouping(district_id) = 0 THEN 'district' WHEN grouping(region_id) = 0 THEN 'region' ELSE 'network' END AS level, "
    f"{O.NC_COUNTS}, round(avg(prb), 4) AS prb_avg FROM placed_weekly GROUP BY GROUPING SETS ((period), (period, region_id), (period, region_id, district_id), (period, region_id, district_id, site_id))", "placed_weekly"))


def data_calendar(star):
    """The calendar of the years that the facts cover."""
    span = star.facts.agg(F.min("date").alias("low"), F.max("date").alias("high")).first()
    return calendar(star.spark, f"{span['low'].year}-01-01", f"{span['high'].year}-12-31")


add("calendar", data_calendar, O.sql("""
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_id, date, CAST(extract('isoyear' FROM date) AS INTEGER) AS iso_year, CAST(extract('week' FROM date) AS INTEGER) AS iso_week,
  CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter
FROM (SELECT CAST(unnest(range((SELECT make_date(year(min(date)), 1, 1) FROM facts), (SELECT make_date(year(max(date)) + 1, 1, 1) FROM facts), INTERVAL 1 DAY)) AS DATE) AS date)""", "facts"))
COVERAGE = """
SELECT date, observed, coalesce(max(observed) OVER (ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), observed) AS expected
FROM (SELECT date, count(DISTINCT cell_id) AS observed FROM facts GROUP BY 1)"""
O.define("cov", ("facts",), f"SELECT *, round(100.0 * observed / expected, 1) AS coverage_pct FROM ({COVERAGE})")
O.define("compl", ("facts",), "SELECT date, round(100 * (" + " + ".join(f"avg(CASE WHEN {m} IS NULL THEN 0.0 ELSE 1.0 END)" for m in ("prb", "volume_mb", "users", "throughput_kbps", "availability_pct")) + ") / 5, 1) AS completeness_pct FROM facts GROUP BY 1")


def with_gaps(star):
    """The star with some measures missing, for completeness."""
    f = star.facts
    for m, every in (("prb", 5), ("users", 7)):
        f = f.withColumn(m, F.when(F.col("cell_id") % every != 0, F.col(m)))
    star.facts, star.wide = f, None
    return star


O.define("gaps", ("facts",), "SELECT * REPLACE (CASE WHEN cell_id % 5 <> 0 THEN prb END AS prb, CASE WHEN cell_id % 7 <> 0 THEN users END AS users) FROM facts")
O.define("compl_gaps", ("gaps",), O.CTES["compl"][1].replace("FROM facts", "FROM gaps"))
add("coverage_daily", A.coverage_daily, O.sql("SELECT * FROM cov", "cov"))
add("completeness_daily", lambda s: A.completeness_daily(with_gaps(s)), O.sql("SELECT * FROM compl_gaps", "compl_gaps"))
add("quality_daily", lambda s: A.quality_daily(with_gaps(s)), O.sql(
    "SELECT date, coverage_pct, completeness_pct, round(0.5 * coverage_pct + 0.5 * completeness_pct, 0) AS score FROM cov JOIN compl_gaps USING (date)", "cov", "compl_gaps"))
add("nc_lifecycle_reference_mode", lambda s: I.nc_lifecycle(s, streak_mode="opening"), O.sql("SELECT * FROM life_opening", "life_opening"))
for g in ("weekly", "monthly"):
    add("nc_movement" if g == "weekly" else f"nc_movement_{g}", lambda s, g=g: I.nc_movement(s, g), O.sql(
        "SELECT period, " + ", ".join(f"count(*) FILTER (WHERE lifecycle = '{a}') AS {b}" for a, b in (("New", "new_nc"), ("Recurring", "recurring"), ("Persistent", "persistent"), ("Chronic", "chronic"), ("Recovering", "recovering")))
        + f", count(*) FILTER (WHERE is_nc) AS nc_cells, count(*) AS total_cells, round(100.0 * count(*) FILTER (WHERE is_nc) / count(*), 1) AS nc_rate FROM life_{g} GROUP BY 1 ORDER BY 1 DESC LIMIT 8", f"life_{g}"))
for c in ("lifecycle", "trend", "severity"):
    add(f"{c}_histogram", lambda s, c=c: I.histogram(s, c), O.sql(f"SELECT period, {c}, count(*) AS cells FROM last GROUP BY 1, 2", "last"))
COMPONENTS = ", ".join(I.COMPONENTS)
for m in MODES:
    add(f"priority_{m}", lambda s, m=m: I.priority_queue(s, m), O.sql(f"SELECT period, cell_id, {COMPONENTS}, '{m}' AS mode, {m} AS score, {O.BAND.format(m)} AS band FROM prio", "prio"))
add("priority_queue_top50", lambda s: I.priority_queue(s, limit=50), O.sql(
    f"SELECT period, cell_id, {COMPONENTS}, 'balanced' AS mode, balanced AS score, {O.BAND.format('balanced')} AS band FROM prio ORDER BY balanced DESC, cell_id LIMIT 50", "prio"))
add("priority_bands", I.priority_bands, O.sql(
    f"SELECT mode, {O.BAND.format('score')} AS band, count(*) AS cells, round(avg(score), 4) AS score_avg FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, {m} AS score FROM prio" for m in MODES) + ") GROUP BY 1, 2", "prio"))
add("health_cell", I.health_cell, O.sql("SELECT * FROM hcell", "hcell"))
add("health_snapshot", I.health_snapshot, O.sql("SELECT * FROM hcell WHERE period = (SELECT max(period) FROM hcell) ORDER BY score, cell_id LIMIT 200", "hcell"))
for scope in ("cell", "district", "region"):
    weeks = ", ".join(f"round(avg(score) FILTER (WHERE back = {i}), 1) AS w{i}" for i in range(12))
    add(f"health_matrix_{scope}", lambda s, v=scope: I.health_matrix(s, v), O.sql(
        f"SELECT {scope}_id AS id, {scope} AS name, {weeks} FROM hcell JOIN (SELECT period, row_number() OVER (ORDER BY period DESC) - 1 AS back FROM (SELECT DISTINCT period FROM hcell)) USING (period) "
        f"JOIN cells USING (cell_id) WHERE back < 12 GROUP BY 1, 2 ORDER BY w0 NULLS LAST, id LIMIT 60", "hcell", "cells"))

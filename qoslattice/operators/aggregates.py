"""The aggregate lattice: cells, KPIs and entities by day, week and month.

Averages are over cell-day rows. Doubles are rounded to DIGITS here, once, so
that what is derived from them does not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import breach, period_start, rounded
from ..sources.star import MEASURES, Star

DIGITS = 4
GRAINS = ("daily", "weekly", "monthly")
#: What identifies an entity of each level.
ENTITY = {
    "cell": ("cell_id", "cell"), "site": ("site_id", "site"), "district": ("district_id", "district"),
    "region": ("region_id", "region"), "network": (None, None),
}


def _r(c: Column, digits: int = DIGITS) -> Column:
    return rounded(c, digits)


def _measures() -> list[Column]:
    return [
        _r(F.avg("prb")).alias("prb_avg"), _r(F.max("prb")).alias("prb_max"), _r(F.sum("volume_mb")).alias("volume_mb"),
        _r(F.sum("users")).alias("users"), _r(F.avg("throughput_kbps")).alias("throughput_kbps"),
        _r(F.avg("availability_pct")).alias("availability_pct"),
    ]


def kpi_breach_days(star: Star) -> DataFrame:
    """(cell_id, date) once for each day on which any breaching KPI is past its target."""
    past = breach("value", "target", "worse_is_higher")
    return star.extras.join(star.breaching_kpis, ["technology", "kpi_key"]).filter(past).select("cell_id", "date").distinct()


def flagged_facts(star: Star) -> DataFrame:
    """Facts with ``prb_breach`` and ``is_breach`` (by utilization or any breaching KPI)."""
    high = F.coalesce(F.col("prb") >= star.rules.prb_threshold_pct, F.lit(False))
    if star.wide is not None:
        rows = star.wide.withColumn("kpi_breach", star.wide_breach)
    else:
        rows = star.facts.join(kpi_breach_days(star).withColumn("kpi_breach", F.lit(True)), ["cell_id", "date"], "left")
    return rows.select("cell_id", "date", *MEASURES, high.alias("prb_breach"), (high | F.coalesce("kpi_breach", F.lit(False))).alias("is_breach"))


def cell_daily(star: Star) -> DataFrame:
    rounded = [_r(F.col(m)).alias(m) for m in MEASURES]
    return flagged_facts(star).select(F.col("date").alias("period"), "cell_id", *rounded, "is_breach")


def cell_weekly(star: Star, complete_weeks_only: bool = False) -> DataFrame:
    week = period_start("date", "weekly").alias("period")
    out = (
        flagged_facts(star).groupBy(week, "cell_id")
        .agg(F.count("*").alias("observed_days"), F.count_if("is_breach").alias("breach_days"), *_measures())
        .withColumn("is_nc", F.col("breach_days") >= star.rules.weekly_breach_days)
    )
    if complete_weeks_only:
        last = star.facts.agg(F.max("date").alias("last"))
        out = out.join(last, F.date_add("period", 6) <= F.col("last")).drop("last")
    return out


def cell_monthly(star: Star) -> DataFrame:
    """A month is non-compliant if a non-compliant week starts in it."""
    month = period_start("date", "monthly").alias("period")
    days = (
        flagged_facts(star).groupBy(month, "cell_id")
        .agg(F.countDistinct("date").alias("observed_days"), F.count_if("prb_breach").alias("breach_days"), *_measures())
    )
    return days.join(nc_months(star), ["period", "cell_id"], "left").withColumn("is_nc", F.coalesce("is_nc", F.lit(False)))


def nc_months(star: Star) -> DataFrame:
    weeks = cell_weekly(star).select("cell_id", period_start("period", "monthly").alias("period"), "is_nc")
    return weeks.groupBy("period", "cell_id").agg(F.bool_or("is_nc").alias("is_nc"))


def cell_period(star: Star, grain: str) -> DataFrame:
    """Cells by ``grain`` in one shape; a day observes itself."""
    if grain == "weekly":
        return cell_weekly(star)
    if grain == "monthly":
        return cell_monthly(star)
    days = flagged_facts(star)
    return days.select(
        F.col("date").alias("period"), "cell_id", F.lit(1).cast("long").alias("observed_days"), F.col("is_breach").cast("long").alias("breach_days"),
        _r(F.col("prb")).alias("prb_avg"), _r(F.col("prb")).alias("prb_max"), *[_r(F.col(m)).alias(m) for m in MEASURES[1:]],
        F.col("is_breach").alias("is_nc"),
    )


def kpi_period(star: Star, grain: str) -> DataFrame:
    return (
        star.extras.groupBy(period_start("date", grain).alias("period"), "cell_id", "technology", "kpi_key")
        .agg(
            _r(F.avg("value")).alias("avg"), _r(F.sum("value")).alias("sum"), _r(F.max("value")).alias("max"),
            _r(F.min("value")).alias("min"), F.count("value").alias("observed_days"),
        )
    )


def cell_sums(star: Star, grain: str) -> DataFrame:
    """Cells by ``grain``, once each, with the sums and counts that any roll-up of
    cell-day means needs, and ``is_nc``."""
    period = period_start("date", grain).alias("period")
    if grain == "daily":
        sums = [F.col("prb").alias("prb_max"), *[F.col(m).alias(f"{m}_sum") for m in MEASURES], *[F.col(m).isNotNull().cast("long").alias(f"{m}_n") for m in MEASURES]]
        return flagged_facts(star).select(period, "cell_id", F.col("is_breach").alias("is_nc"), *sums)
    rows = flagged_facts(star).groupBy(period, "cell_id").agg(
        F.count_if("is_breach").alias("breach_days"), F.max("prb").alias("prb_max"),
        *[F.sum(m).alias(f"{m}_sum") for m in MEASURES], *[F.count(m).alias(f"{m}_n") for m in MEASURES],
    )
    if grain == "weekly":
        return rows.withColumn("is_nc", F.col("breach_days") >= star.rules.weekly_breach_days)
    return rows.join(nc_months(star), ["period", "cell_id"], "left").withColumn("is_nc", F.coalesce("is_nc", F.lit(False)))


def _rolled_up() -> list[Column]:
    """Figures of an entity from ``cell_sums``: a cell is one row a period."""
    cells, nc = F.count("*"), F.count_if("is_nc")
    mean = lambda m: F.sum(f"{m}_sum") / F.when(F.sum(f"{m}_n") > 0, F.sum(f"{m}_n"))
    return [
        cells.alias("cells"), nc.alias("nc_cells"), rounded(100 * nc / cells, 1).alias("nc_rate"), _r(mean("prb")).alias("prb_avg"), _r(F.max("prb_max")).alias("prb_max"),
        _r(F.sum("volume_mb_sum")).alias("volume_mb"), _r(F.sum("users_sum")).alias("users"), _r(mean("throughput_kbps")).alias("throughput_kbps"),
        _r(mean("availability_pct")).alias("availability_pct"),
    ]


def entity_period(star: Star, level: str, grain: str) -> DataFrame:
    """Measures and non-compliant cells of each entity of ``level`` and period."""
    key, _ = ENTITY[level]
    entity = F.col(key) if key else F.lit(0).cast("long")
    rows = cell_sums(star, grain).join(star.cells, "cell_id").withColumn("entity_id", entity)
    return rows.groupBy("period", "entity_id").agg(*_rolled_up())


def entity_cube(star: Star, grain: str = "weekly") -> DataFrame:
    """Extension: all levels of the hierarchy in one pass."""
    level = F.when(F.grouping("site_id") == 0, "site").when(F.grouping("district_id") == 0, "district").when(F.grouping("region_id") == 0, "region").otherwise("network")
    keys = ["region_id", "district_id", "site_id"]
    # Weeks lead every grouping, so the rollup never mixes them.
    return (
        cell_sums(star, grain).join(star.cells, "cell_id").rollup("period", *keys).agg(level.alias("level"), *_rolled_up()[:4])
        .filter(F.col("period").isNotNull())
    )


def coverage_daily(star: Star, before: int = 30) -> DataFrame:
    """Observed against expected cells: the most on any of the ``before`` days ahead."""
    days = star.facts.groupBy("date").agg(F.countDistinct("cell_id").alias("observed"))
    # One row a day: the window is small whatever the number of cells.
    prior = Window.orderBy(F.unix_date("date")).rangeBetween(-before, -1)
    expected = F.coalesce(F.max("observed").over(prior), F.col("observed"))
    return days.withColumn("expected", expected).withColumn("coverage_pct", rounded(100 * F.col("observed") / F.col("expected"), 1))


def completeness_daily(star: Star) -> DataFrame:
    """Mean share of measures that are present, in percent."""
    present = [F.avg(F.col(m).isNotNull().cast("double")) for m in MEASURES]
    return star.facts.groupBy("date").agg(rounded(100 * sum(present[1:], present[0]) / len(present), 1).alias("completeness_pct"))


def quality_daily(star: Star) -> DataFrame:
    both = coverage_daily(star).join(completeness_daily(star), "date")
    return both.select("date", "coverage_pct", "completeness_pct", rounded(0.5 * F.col("coverage_pct") + 0.5 * F.col("completeness_pct"), 0).alias("score"))


def quality_score(coverage, completeness, confidence, rejected_rate, duplicate_rate) -> Column:
    return rounded(0.35 * coverage + 0.25 * completeness + 15 * confidence + 15 * (1 - rejected_rate) + 10 * (1 - duplicate_rate), 0)

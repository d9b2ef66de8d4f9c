"""Read endpoints: KPI overview, distributions, comparison, drill-down, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    LIFECYCLES, SEVERITIES, band, breach, by_agg, card_trend, compliance, contains_folded, delta, delta_pct, dual_quadrant,
    magnitude, nc_transition, numbered, quadrant, rank_of, rounded, severity_pct,
)
from ..functions.rules import MODES
from ..functions.selection import quantiles
from ..sources.star import Star
from .aggregates import ENTITY, cell_weekly, kpi_period
from .intelligence import health_network, last_week, latest, nc_lifecycle, recent_weeks, scored, with_back

#: Metric: label, unit, whether a rise is bad (None: neither).
METRICS = {
    "prb_avg": ("PRB utilization", "%", True), "throughput_kbps": ("DL throughput", "kbps", False), "users": ("Connected users", "-", None),
    "volume_mb": ("Data volume", "MB", None), "availability_pct": ("Availability", "%", False),
}
AVERAGED = ("prb_avg", "throughput_kbps", "availability_pct")


def kpi_values(star: Star, grain: str = "weekly") -> DataFrame:
    """KPI rows with the value that the KPI's aggregation names, breach and severity."""
    rows = kpi_period(star, grain).join(star.active_kpis, ["technology", "kpi_key"]).withColumn("value", by_agg("agg", "avg", "sum", "max", "min"))
    return rows.withColumn("breached", breach("value", "target", "worse_is_higher")).withColumn("severity", severity_pct("value", "target", "worse_is_higher"))


def last_kpis(star: Star) -> DataFrame:
    """KPI rows of the last week with KPI values: no other day is read."""
    week = star.last_period(of_kpis=True)
    return kpi_values(star.since(week)).filter(F.col("period") == F.lit(week))


def recent_kpis(star: Star, n: int) -> DataFrame:
    weeks = star.periods(n, of_kpis=True)
    return with_back(kpi_values(star.since(weeks[-1] if weeks else None)), weeks)


def kpi_overview(star: Star) -> DataFrame:
    rows = last_kpis(star)
    return rows.groupBy("technology", "kpi_key", "label", "unit", "target", "worse_is_higher").agg(
        F.countDistinct(F.when(F.col("breached"), F.col("cell_id"))).alias("breached_cells"), F.countDistinct("cell_id").alias("observed_cells"),
        rounded(F.avg(F.when(F.col("breached"), F.col("severity"))), 1).alias("avg_severity"),
    )


def kpi_breach_by_cell(star: Star) -> DataFrame:
    rows = last_kpis(star).filter("breached")
    return rows.groupBy("cell_id").agg(rounded(F.avg("severity"), 1).alias("breach_score"), F.count("*").alias("breached_kpis"))


def kpi_worst_cells(star: Star, limit: int = 8) -> DataFrame:
    rows = kpi_breach_by_cell(star).join(star.cells.select("cell_id", "cell", "site", "district"), "cell_id")
    return rows.orderBy(F.desc("breach_score"), "cell_id").limit(limit)


def kpi_trend(star: Star, weeks: int = 12) -> DataFrame:
    recent = recent_kpis(star, weeks).groupBy("technology", "kpi_key", "period", "target", "worse_is_higher").agg(rounded(F.avg("value")).alias("value"))
    return recent.select("technology", "kpi_key", "period", "value", breach("value", "target", "worse_is_higher").alias("breached"))


def metric_values(star: Star) -> DataFrame:
    """(cell_id, technology, metric, value): measures, which have no technology, and KPIs
    of the last week, long."""
    wide = last_week(star).unpivot(["cell_id"], list(METRICS), "metric", "value").withColumn("technology", F.lit(None).cast("string"))
    return wide.unionByName(last_kpis(star).select("cell_id", "technology", F.col("kpi_key").alias("metric"), "value"))


#: Cells up to which a metric's values of a week fit in one task with ease.
FEW_CELLS = 100_000


def few_cells(star: Star) -> bool:
    return star.cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS


def distributions(star: Star, points: int = 21) -> DataFrame:
    """(technology, metric, q, value): exact, interpolated quantiles at equal steps."""
    steps = [i / (points - 1) for i in range(points)]
    return quantiles(metric_values(star), ["technology", "metric"], "value", steps, few_cells(star)).withColumn("value", rounded("value"))


def distribution_summary(star: Star) -> DataFrame:
    """(technology, metric, n, mean, min, max, p50, p90) over the cells of the last week."""
    v, keys = F.col("value"), ["technology", "metric"]
    values = metric_values(star)
    base = values.groupBy(*keys).agg(F.count(v).alias("n"), rounded(F.avg(v)).alias("mean"), rounded(F.min(v)).alias("min"), rounded(F.max(v)).alias("max"))
    at = lambda q: rounded(F.max(F.when(F.col("q") == q, v)))
    points = quantiles(values, keys, "value", [0.5, 0.9], few_cells(star)).groupBy(F.col("technology").alias("_t"), F.col("metric").alias("_m")).agg(at(0.5).alias("p50"), at(0.9).alias("p90"))
    return base.join(points, base.technology.eqNullSafe(points["_t"]) & (base.metric == points["_m"]), "left").drop("_t", "_m")


def throughput_median(star: Star) -> DataFrame:
    return last_week(star).agg(F.count("*").alias("cells"), rounded(F.median("throughput_kbps")).alias("throughput_median_kbps"))


def scatter(star: Star) -> DataFrame:
    """Cells of the last week by load and speed."""
    rows = last_week(star)
    median = rows.agg(F.median("throughput_kbps").alias("median"))  # one row
    kind = quadrant("prb_avg", "throughput_kbps", F.lit(star.rules.prb_threshold_pct), "median")
    return rows.join(median).select("cell_id", "prb_avg", "throughput_kbps", "users", "is_nc", kind.alias("quadrant"))


def correlations(star: Star) -> DataFrame:
    """(a_technology, a, b_technology, b, pearson, n): Pearson's r of every pair of metrics
    that some cell of the last week has both of, over the ``n`` cells that do. A cell's
    values are paired where they lie; pairs are added up as moments, so what is shuffled
    is a row a pair and task, however many cells and metrics there are."""
    vector = F.array_sort(F.collect_list(F.struct("metric", F.coalesce("technology", F.lit("")).alias("technology"), "value")))
    cells = metric_values(star).filter("value IS NOT NULL").groupBy("cell_id").agg(vector.alias("v"))
    pairs = F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    names = [F.nullif(F.col("x.a.technology"), F.lit("")).alias("a_technology"), F.col("x.a.metric").alias("a"), F.nullif(F.col("x.b.technology"), F.lit("")).alias("b_technology"), F.col("x.b.metric").alias("b")]
    return cells.select(F.explode(F.flatten(pairs)).alias("x")).groupBy(*names).agg(rounded(F.corr("x.a.value", "x.b.value")).alias("pearson"), F.count("*").alias("n"))


def dual_breach_quadrants(star: Star, x: str = "call_drop", y: str = "congestion", technology: str | None = None) -> DataFrame:
    """Cells by two KPIs' breaches; a KPI without target is judged by its upper median
    over the cells that have both. ``technology``: needed where several share a key."""
    rows = last_kpis(star).filter(F.col("kpi_key").isin(x, y) & F.col("value").isNotNull())
    if technology:
        rows = rows.filter(F.col("technology") == technology)
    both = rows.groupBy("cell_id").agg(F.countDistinct("kpi_key").alias("n")).filter("n = 2")
    rows = rows.join(both, "cell_id", "left_semi")
    # Of the values in falling order the lower median: in rising order the upper one.
    medians = rows.groupBy("kpi_key").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("median"))
    rows = rows.join(medians, "kpi_key").withColumn("breached", breach("value", F.coalesce("target", "median"), "worse_is_higher"))
    flag = lambda k: F.max(F.when(F.col("kpi_key") == k, F.col("breached")))
    cells = rows.groupBy("cell_id").agg(flag(x).alias("x_bad"), flag(y).alias("y_bad")).filter("x_bad IS NOT NULL AND y_bad IS NOT NULL")
    return cells.groupBy(dual_quadrant("x_bad", "y_bad").alias("quadrant")).agg(F.count("*").alias("cells"))


def two_weeks(star: Star) -> DataFrame:
    """Cells of the last two weeks, with ``back`` 0 or 1."""
    return recent_weeks(star, 2)


def _per_entity(rows: DataFrame, scope: str) -> DataFrame:
    key, name = ENTITY[scope]
    sides = []
    for back, tag in ((0, "current"), (1, "previous")):
        here = F.col("back") == back
        value = lambda m: (F.avg if m in AVERAGED else F.sum)(F.when(here, F.col(m)))
        sides += [rounded(value(m)).alias(f"{tag}_{m}") for m in METRICS]
        sides += [F.count_if(here & F.col("is_nc")).alias(f"{tag}_nc"), F.count_if(here).alias(f"{tag}_cells")]
    return rows.groupBy(F.col(key).alias("id"), F.col(name).alias("name")).agg(*sides)


def compare_periods(star: Star, scope: str = "cell") -> DataFrame:
    """Last week against the one before, long by metric: both weeks come from one
    pass, and entities of either week appear."""
    wide = _per_entity(two_weeks(star).join(star.cells, "cell_id"), scope)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"current_{m}").alias("current"), F.col(f"previous_{m}").alias("previous")) for m in METRICS])
    long = wide.select("id", "name", "current_nc", "previous_nc", "current_cells", F.explode(rows).alias("x"))
    return long.select(
        "id", "name", "x.metric", "x.current", "x.previous", delta("x.current", "x.previous").alias("delta"), delta_pct("x.current", "x.previous").alias("delta_pct"),
        F.col("current_nc").alias("nc_cells"), F.col("current_cells").alias("cells"), nc_transition("current_nc", "previous_nc").alias("transition"),
    )


def compare_regions(star: Star) -> DataFrame:
    """Regions of the last week against the network, with each metric's best and worst."""
    rows = last_week(star).join(star.cells, "cell_id")
    values = [rounded((F.avg if m in AVERAGED else F.sum)(m)).alias(m) for m in METRICS]
    regions = rows.groupBy(F.col("region_id").alias("id"), F.col("region").alias("name")).agg(*values).unpivot(["id", "name"], list(METRICS), "metric", "value")
    network = rows.agg(*values).unpivot([], list(METRICS), "metric", "baseline")
    each = Window.partitionBy("metric")
    return regions.join(network, "metric").select(
        "id", "name", "metric", "value", "baseline", delta("value", "baseline").alias("delta"), delta_pct("value", "baseline").alias("delta_pct"),
        (F.col("value") == F.max("value").over(each)).alias("is_max"), (F.col("value") == F.min("value").over(each)).alias("is_min"),
    )


def index_100(star: Star, weeks: int = 12) -> DataFrame:
    """Network metrics of the last weeks, indexed to the first of them."""
    recent = recent_weeks(star, weeks).groupBy("period").agg(*[rounded((F.avg if m in AVERAGED else F.sum)(m)).alias(m) for m in METRICS])
    long = recent.unpivot(["period"], list(METRICS), "metric", "value")
    base = F.first("value").over(Window.partitionBy("metric").orderBy("period"))
    return long.select("period", "metric", "value", rounded(F.col("value") / F.when(base != 0, base) * 100, 1).alias("index"))


def rank_changes(star: Star, scope: str = "district", metric: str = "prb_avg") -> DataFrame:
    """Worst change first, by the metric's bad direction; without a baseline last."""
    rows = compare_periods(star, scope).filter(F.col("metric") == metric)
    worse = F.col("delta") if METRICS[metric][2] is not False else -F.col("delta")
    rows = rows.withColumn("worse", worse)
    placed = numbered(rows, F.coalesce(-magnitude("worse"), F.lit(1 << 20)), [F.desc_nulls_last("worse"), "id"], "place")
    return placed.select("id", "name", "current", "previous", "delta", F.col("place").cast("long").alias("place"))


def state(star: Star) -> DataFrame:
    """Cells of the last week with their place, state, priority and health."""
    kept = ("period", "cell_id", "is_nc", "lifecycle", "trend", "severity", "breach_days", "prb_avg", "throughput_kbps", "users", "volume_mb", "availability_pct")
    rows = scored(star, last_only=True).select(*kept, *[F.col(m).alias(f"by_{m}") for m in MODES], F.col("balanced").alias("priority_score"), "health_score")
    return rows.join(star.cells, "cell_id").withColumn("priority_band", band("priority_score"))


def _rollup() -> list[Column]:
    return [
        F.countDistinct("cell_id").alias("cells"), F.count_if("is_nc").alias("nc_cells"), rounded(F.avg("health_score"), 1).alias("health_score"),
        rounded(F.avg("prb_avg")).alias("prb_avg"), rounded(F.avg("throughput_kbps")).alias("throughput_kbps"), rounded(F.sum("users")).alias("users"),
        rounded(F.sum("volume_mb")).alias("volume_mb"), rounded(F.avg("availability_pct")).alias("availability_pct"), F.max("priority_score").alias("priority_score"),
    ]


PARENT = {"district": "region_id", "site": "district_id", "cell": "site_id"}
CELL_COLUMNS = ("is_nc", "lifecycle", "severity", "health_score", "prb_avg", "throughput_kbps", "users", "volume_mb", "availability_pct", "priority_score", "priority_band")


def explorer(star: Star, level: str, parent_id: int | None = None, q: str | None = None) -> DataFrame:
    """One level of the hierarchy, below ``parent_id`` if given, named like ``q``."""
    key, name = ENTITY[level]
    rows = state(star)
    if parent_id is not None and level in PARENT:
        rows = rows.filter(F.col(PARENT[level]) == parent_id)
    if q:
        rows = rows.filter(contains_folded(q, name))
    rows = rows.withColumnsRenamed({key: "id", name: "name"})
    if level == "cell":
        return rows.select("id", "name", *CELL_COLUMNS)
    return rows.groupBy("id", "name").agg(*_rollup()).withColumn("priority_band", F.when(F.col("priority_score").isNotNull(), band("priority_score")))


def place_map(star: Star, level: str = "region", region_id: int | None = None) -> DataFrame:
    """Regions, or a region's districts, worst first, with ``kpis``: mean and number of breaches by
    ``technology:kpi_key``. What is not measured has no entry."""
    key, name = ENTITY[level]
    rows = state(star)
    if region_id is not None:
        rows = rows.filter(F.col("region_id") == region_id)
    base = rows.groupBy(F.col(key).alias("id"), F.col(name).alias("name")).agg(*_rollup()[:-1])
    figures = F.struct(rounded(F.avg("value")).alias("avg"), F.count_if("breached").alias("nc"))
    values = last_kpis(star).join(star.cells, "cell_id").groupBy(F.col(key).alias("kpi_of"), _kpi_name()).agg(figures.alias("figures"))
    mapped = base.join(_as_map(values, "kpi_of", "figures"), F.col("id") == F.col("kpi_of"), "left").drop("kpi_of")
    return mapped.orderBy(F.asc_nulls_last("health_score"), "id")


def _kpi_name() -> Column:
    return F.concat_ws(":", "technology", "kpi_key").alias("kpi")


def _as_map(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, kpis): the rows of each key as a map from ``technology:kpi_key``; there are
    no more of these than KPIs."""
    return values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kpi", value))).alias("kpis"))


def breadcrumbs(star: Star) -> DataFrame:
    return star.cells.select("cell_id", F.concat_ws(" > ", F.lit("Network"), "region", "district", "site", "cell").alias("path"))


def cell_table(star: Star, search=None, lifecycle=None, trend=None, severity=None, min_priority=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of cells, worst first, with ``kpis``: their KPI values by ``technology:kpi_key``."""
    rows = state(star)
    if search:
        rows = rows.filter(contains_folded(search, "cell", "site", "district", "region"))
    for c, wanted in (("lifecycle", lifecycle), ("trend", trend), ("severity", severity)):
        if wanted:
            rows = rows.filter(F.col(c) == wanted)
    if min_priority is not None:
        rows = rows.filter(F.col("priority_score") >= min_priority)
    page = rows.orderBy(F.desc_nulls_last("priority_score"), "cell_id").limit(max(1, min(500, limit)) + offset).offset(offset)
    values = last_kpis(star).join(page.select("cell_id"), "cell_id", "left_semi").select("cell_id", _kpi_name(), "value")
    spread = _as_map(values, "cell_id", "value")
    return page.select("cell_id", "cell", "site", "district", "region", "is_nc", "lifecycle", "trend", "severity", "prb_avg", "breach_days", "throughput_kbps", "users", "volume_mb", "availability_pct", "priority_score", "priority_band").join(spread, "cell_id", "left")


def cell_detail(star: Star, cell_id: int, grain: str = "weekly") -> DataFrame:
    """A cell's history; empty if the cell is unknown. The filter reaches the facts' scan."""
    rows = nc_lifecycle(star.where(F.col("cell_id") == cell_id), grain).join(star.cells, "cell_id")
    return rows.select("period", "cell_id", "cell", "site", "district", "region", "prb_avg", "throughput_kbps", "users", "volume_mb", "availability_pct", "breach_days", "is_nc", "lifecycle", "severity")


def entity_search(star: Star, scope: str, q: str, limit: int = 100) -> DataFrame:
    """Entities named like ``q``, most pressing first."""
    key, name = ENTITY[scope]
    rows = state(star).filter(contains_folded(q, name)).groupBy(F.col(key).alias("id"), F.col(name).alias("name")).agg(
        F.max("priority_score").alias("score"), F.min(rank_of("severity", SEVERITIES)).alias("severity_rank"), F.min(rank_of("lifecycle", LIFECYCLES)).alias("lifecycle_rank"),
    )
    return rows.orderBy("severity_rank", F.desc_nulls_last("score"), "id").limit(limit)


def priority_center(star: Star, status: DataFrame, as_of: str, scope: str = "cell", mode: str = "balanced", wanted=None, band_name=None, search=None, overdue_only=False, limit: int = 100, offset: int = 0) -> DataFrame:
    """The work queue of ``scope``: ``status`` has id, status, owner, review_date."""
    key, name = ENTITY[scope]
    rows = state(star).withColumn("score", F.col(f"by_{mode}"))
    queue = rows.groupBy(F.col(key).alias("id"), F.col(name).alias("name")).agg(
        F.max("score").alias("priority_score"), F.count_if("is_nc").alias("nc_cells"), F.countDistinct(F.col("cell_id") if scope != "cell" else F.lit(1)).alias("cells"), rounded(F.avg("prb_avg")).alias("prb_avg"),
    )
    late = (F.col("review_date") < F.lit(as_of).cast("date")) & ~F.col("status").isin("Resolved", "Deferred")
    queue = (
        queue.join(status, "id", "left").withColumn("priority_band", band("priority_score"))
        .withColumn("overdue", F.coalesce(late, F.lit(False))).withColumn("status", F.coalesce("status", F.lit("unset")))
    )
    if wanted:
        queue = queue.filter(F.col("status") == wanted)
    if band_name:
        queue = queue.filter(F.col("priority_band") == band_name)
    if search:
        queue = queue.filter(contains_folded(search, "name"))
    if overdue_only:
        queue = queue.filter("overdue")
    return queue.orderBy(F.desc("priority_score"), "id").limit(limit + offset).offset(offset)


def status_rollup(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("entities"), F.count_if("overdue").alias("overdue"))


def summary(star: Star, weeks: int = 4) -> DataFrame:
    """One row: what is stored, and the last ``weeks`` weeks up to the last fact."""
    facts = star.facts.agg(F.count("*").alias("row_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    places = star.cells.agg(*[F.countDistinct(k).alias(n) for k, n in (("cell_id", "cells"), ("site_id", "sites"), ("district_id", "districts"), ("region_id", "regions"))])
    recent = recent_weeks(star, weeks).agg(
        F.min("period").alias("period_start"), F.date_add(F.max("period"), 6).alias("period_end"),
        F.countDistinct(F.when(F.col("is_nc"), F.col("cell_id"))).alias("nc_cells"), F.count_if("is_nc").alias("nc_cell_weeks"), F.count("*").alias("cell_weeks"),
        rounded(F.avg("prb_avg")).alias("avg_prb"), rounded(F.sum("volume_mb")).alias("volume_mb"), rounded(F.sum("users")).alias("users"),
        rounded(F.avg("throughput_kbps")).alias("throughput_kbps"), rounded(F.avg("availability_pct")).alias("availability_pct"),
    )
    return facts.join(places).join(recent)  # one row each


def executive_cards(star: Star, length: int = 12) -> DataFrame:
    """One card a KPI: last value, change, compliance and trend over a sparkline."""
    recent = recent_kpis(star, length)
    names = ["technology", "kpi_key", "label", "unit", "target", "warning", "critical", "worse_is_higher"]
    weekly = recent.groupBy(*names, "period", "back").agg(rounded(F.avg("value")).alias("value"), F.countDistinct(F.when(F.col("breached"), F.col("cell_id"))).alias("nc"), F.countDistinct("cell_id").alias("n"))
    at = lambda c, back: F.max(F.when(F.col("back") == back, F.col(c)))
    cards = weekly.groupBy(*names).agg(at("value", 0).alias("current"), at("value", 1).alias("previous"), at("nc", 0).alias("nc_cells"), at("n", 0).alias("cells"), rounded(F.avg("value")).alias("sparkline_mean"))
    change = delta("current", "previous")
    return cards.select(
        "technology", "kpi_key", "label", "current", "previous", delta("current", "previous").alias("delta"), delta_pct("current", "previous").alias("delta_pct"),
        compliance("current", "target", "warning", "critical", "worse_is_higher").alias("compliance"), card_trend("kpi_key", "current", change, "warning", "target", "worse_is_higher").alias("trend"),
        "nc_cells", rounded(100 * F.col("nc_cells") / F.col("cells"), 1).alias("nc_pct"), "sparkline_mean",
    )


def executive_health(star: Star) -> DataFrame:
    """Network health, its change on the week before, and counts of the gravest states."""
    # Growth looks one week further back.
    weeks = star.periods(3)
    both = with_back(health_network(star.since(weeks[-1] if weeks else None)), weeks[:2]).agg(F.max(F.when(F.col("back") == 0, F.col("score"))).alias("score"), F.max(F.when(F.col("back") == 1, F.col("score"))).alias("previous"))
    states = latest(nc_lifecycle(star), star).agg(
        F.count_if(F.col("severity") == "Critical").alias("critical_cells"), F.count_if(F.col("lifecycle") == "Chronic").alias("chronic_cells"),
        F.count_if(F.col("lifecycle") == "Persistent").alias("persistent_cells"),
    )
    return both.join(states).withColumn("delta", delta("score", "previous", 1))


def worst_districts(star: Star, limit: int = 3) -> DataFrame:
    return explorer(star, "district").orderBy(F.asc_nulls_last("health_score"), "id").limit(limit).select("id", "name", "health_score", "nc_cells", "cells")

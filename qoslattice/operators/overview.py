"""Executive overview: cards with their series, technologies, and what to do first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import breach, clamp_round, rounded
from ..sources.star import Star
from .intelligence import health_network, health_snapshot, last_week, priority_queue, with_back
from .views import executive_cards, executive_health, kpi_breach_by_cell, recent_kpis, worst_districts

#: Points off for a breached card, least health of a technology, cards of
#: one without core KPIs, and the health from which a network counts as stable.
CARD_PENALTY, LEAST_HEALTH, FIRST_CARDS, STABLE = 5, 20, 4, 80
WEEKS = 12


def sparklines(star: Star, length: int = WEEKS) -> DataFrame:
    """(technology, kpi_key, dates, values): a KPI's weekly means, oldest first, as two arrays."""
    weekly = recent_kpis(star, length).groupBy("technology", "kpi_key", "period").agg(rounded(F.avg("value")).alias("value"))
    points = weekly.groupBy("technology", "kpi_key").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("p"))
    return points.select("technology", "kpi_key", F.col("p.period").alias("dates"), F.col("p.value").alias("values"))


def kpi_cards(star: Star, length: int = WEEKS) -> DataFrame:
    """``executive_cards`` with ``dates``, ``values``, ``is_core`` and ``is_breached``."""
    kpis = star.active_kpis.select("technology", "kpi_key", "is_core", "target", "worse_is_higher")
    cards = executive_cards(star, length).drop("sparkline_mean").join(kpis, ["technology", "kpi_key"])
    breached = breach("current", "target", "worse_is_higher").alias("is_breached")
    return cards.select(*[c for c in cards.columns if c not in ("target", "worse_is_higher")], breached).join(sparklines(star, length), ["technology", "kpi_key"])


def technology_cards(star: Star, length: int = WEEKS) -> DataFrame:
    """(technology, cards, primary_cards, breached_cards, cells, nc_cells, compliance_pct, health).

    Compliance is that of the cells of the last week; each breached primary card takes
    CARD_PENALTY off. Primary are a technology's core KPIs or, without one, its first
    FIRST_CARDS by key. ``cells`` are those with a KPI of the technology."""
    cards = kpi_cards(star, length).groupBy("technology").agg(
        F.count("*").alias("cards"), F.count_if("is_core").alias("core"), F.count_if(F.col("is_core") & F.col("is_breached")).alias("core_breached"),
        F.slice(F.array_sort(F.collect_list(F.struct("kpi_key", "is_breached"))), 1, FIRST_CARDS).alias("first"),
    )
    first_breached = F.size(F.filter("first", lambda x: x["is_breached"]))
    chosen = cards.select(
        "technology", "cards", F.when(F.col("core") > 0, F.col("core")).otherwise(F.size("first")).cast("long").alias("primary_cards"),
        F.when(F.col("core") > 0, F.col("core_breached")).otherwise(first_breached).cast("long").alias("breached_cards"),
    )
    measured = recent_kpis(star, 1).select("technology", "cell_id").distinct()
    cells = last_week(star).select("cell_id", "is_nc").join(measured, "cell_id").groupBy("technology").agg(F.count("*").alias("cells"), F.count_if("is_nc").alias("nc_cells"))
    share = rounded(100 * (F.col("cells") - F.col("nc_cells")) / F.col("cells"), 1)
    rows = chosen.join(cells, "technology", "left").withColumn("compliance_pct", F.coalesce(share, F.lit(100.0)))
    health = clamp_round(F.col("compliance_pct") - CARD_PENALTY * F.col("breached_cards"), LEAST_HEALTH, 100)
    return rows.select("technology", "cards", "primary_cards", "breached_cards", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("nc_cells", F.lit(0)).alias("nc_cells"), "compliance_pct", health.alias("health"))


def recommendations(star: Star, districts: int = 3) -> DataFrame:
    """(place, kind, figure, advice), most pressing first: visits to chronic cells, the
    least healthy districts, then an audit or, for a stable network, watching on."""
    state = executive_health(star).select("score", "chronic_cells")
    worst = worst_districts(star, districts).filter("nc_cells > 0").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("health_score", "id", "name"))).alias("named"))
    stable = F.col("score") >= STABLE
    found = F.array(
        F.when(F.col("chronic_cells") > 0, F.struct(F.lit(1).alias("place"), F.lit("chronic").alias("kind"), F.col("chronic_cells").cast("double").alias("figure"), F.lit("visit the sites of cells that have been non-compliant for long").alias("advice"))),
        F.when(F.col("n") > 0, F.struct(F.lit(2).alias("place"), F.lit("districts").alias("kind"), F.col("n").cast("double").alias("figure"), F.concat(F.lit("add capacity in "), F.concat_ws(", ", "named.name")).alias("advice"))),
        F.struct(F.lit(3).alias("place"), F.when(stable, "stable").otherwise("audit").alias("kind"), F.col("score").alias("figure"), F.when(stable, "keep watching").otherwise("audit the parameters of loaded clusters").alias("advice")),
    )
    return state.join(worst).select(F.explode(F.array_compact(found)).alias("x")).select("x.*")  # one row each


def health_report(star: Star, cells: int = 200, weeks: int = WEEKS) -> DataFrame:
    """(kind, period, cell_id, score): the worst cells of the last week, and the network's last weeks."""
    series = with_back(health_network(star), star.periods(weeks)).select(F.lit("network").alias("kind"), "period", F.lit(None).cast("long").alias("cell_id"), "score")
    return health_snapshot(star, cells).select(F.lit("cell").alias("kind"), "period", "cell_id", "score").unionByName(series)


def priority_report(star: Star, mode: str = "balanced", limit: int = 50) -> DataFrame:
    """The queue's head with ``kpi_breach``, the mean severity of a cell's breached KPIs: it
    is told, not weighed. 0 if none is breached."""
    queue = priority_queue(star, mode, limit)
    breaches = kpi_breach_by_cell(star).select("cell_id", F.col("breach_score").alias("kpi_breach"), "breached_kpis")
    rows = queue.join(breaches, "cell_id", "left")
    return rows.select(*queue.columns, F.coalesce("kpi_breach", F.lit(0.0)).alias("kpi_breach"), F.coalesce("breached_kpis", F.lit(0)).alias("breached_kpis"))

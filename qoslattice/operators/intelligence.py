"""Derived intelligence: lifecycle, trend, severity, priority and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import band, clamp, clamp_round, pct_change, per_day, rounded
from ..functions.rules import MODES
from ..sources.star import Star
from .aggregates import ENTITY, cell_period, cell_weekly, entity_period

#: What a state of the lifecycle is worth in a cell's health, and in its priority.
NC_HEALTH = {"Healthy": 100.0, "Recovering": 90.0, "New": 60.0, "Recurring": 50.0, "Persistent": 40.0, "Chronic": 30.0}
PERSISTENCE = {"Chronic": 100.0, "Persistent": 90.0, "Recurring": 70.0, "New": 35.0}
TREND_SCORE = {"Worsening": 100.0, "Stable": 50.0, "Improving": 0.0}
SEVERITY_BASE = {"Recurring": 60, "Persistent": 80, "Chronic": 90}
COMPONENTS = ("prb_severity", "persistence_score", "user_impact", "traffic_impact", "throughput_deficit", "trend_score")
FULL_THROUGHPUT_KBPS = 25_000


def _choose(of: str, values: dict, otherwise) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(F.col(of) == name, value) if out is None else out.when(F.col(of) == name, value)
    return out.otherwise(otherwise)


def nc_lifecycle(star: Star, grain: str = "weekly", streak_mode: str = "consecutive") -> DataFrame:
    """One row a cell and period: streak, lifecycle, trend and severity.

    ``streak_mode``: "consecutive" counts non-compliant periods alone; "opening"
    also counts the compliant period that opens a streak.
    """
    return lifecycle_of(cell_period(star, grain), star, grain, streak_mode)


def lifecycle_of(rows: DataFrame, star: Star, grain: str = "weekly", streak_mode: str = "consecutive") -> DataFrame:
    """The lifecycle of ``rows`` in the shape of ``cell_period``. Where they are not a
    cell's whole history, ``seed`` on its first row is the streak there."""
    by_cell = Window.partitionBy("cell_id").orderBy("period")
    bad = F.coalesce("is_nc", F.lit(False))
    rows = (
        rows.withColumn("is_nc", bad)
        .withColumn("volume_day", per_day("volume_mb", "observed_days")).withColumn("users_day", per_day("users", "observed_days"))
    )
    carried = ("is_nc", "prb_avg", "breach_days", "throughput_kbps", "volume_day", "users_day")
    rows = rows.select("*", *[F.lag(c).over(by_cell).alias(f"was_{c}") for c in carried], F.row_number().over(by_cell).alias("nth"))
    island = F.sum(F.when(F.col("is_nc"), 0).otherwise(1)).over(by_cell.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", island)
    place = F.row_number().over(Window.partitionBy("cell_id", "island").orderBy("period"))
    # Island 0 has no compliant period in front.
    opened = F.when(F.col("island") > 0, 1).otherwise(0) if streak_mode == "consecutive" else F.lit(0)
    streak = place - opened
    if "seed" in rows.columns:
        streak = streak + F.when(F.col("island") == 0, F.coalesce(F.first("seed").over(by_cell) - 1, F.lit(0))).otherwise(0)
    rows = rows.withColumn("streak", F.when(F.col("is_nc"), streak).otherwise(0))
    return _judged(rows.withColumn("lifecycle", _lifecycle(star, grain)).withColumn("trend", _trend()), star)


def _lifecycle(star: Star, grain: str) -> Column:
    chronic, persistent = star.rules.streak_limits(grain)
    streak = F.col("streak")
    recovering = F.when(F.coalesce("was_is_nc", F.lit(False)), "Recovering").otherwise("Healthy")
    return (
        F.when(~F.col("is_nc"), recovering).when(streak >= chronic, "Chronic").when(streak >= persistent, "Persistent")
        .when(streak == 1, "New").otherwise("Recurring")
    )


def _trend() -> Column:
    def signal(moved: Column, tolerance: float, more_is_worse: bool) -> Column:
        up, down = F.when(moved >= tolerance, 1).otherwise(0), F.when(moved <= -tolerance, 1).otherwise(0)
        return down - up if more_is_worse else up - down

    net = (
        signal(F.coalesce(F.col("prb_avg") - F.col("was_prb_avg"), F.lit(0.0)), 3, True)
        + signal(F.col("breach_days") - F.col("was_breach_days"), 1, True)
        + signal(pct_change("throughput_kbps", "was_throughput_kbps"), 10, False)
        + signal(pct_change("volume_day", "was_volume_day"), 10, True)
        + signal(pct_change("users_day", "was_users_day"), 10, True)
    )
    return F.when(F.col("nth") == 1, "Stable").when(net >= 2, "Improving").when(net <= -2, "Worsening").otherwise("Stable")


def _judged(rows: DataFrame, star: Star) -> DataFrame:
    limit = F.lit(star.rules.prb_threshold_pct)
    excess = F.coalesce("prb_avg", limit) - limit
    score = (
        _choose("lifecycle", SEVERITY_BASE, 40)
        + F.when(excess >= 20, 25).when(excess >= 10, 15).when(excess >= 5, 10).when(excess >= 0, 5).otherwise(0)
        + F.least(F.lit(15), 2 * F.col("breach_days")) + F.when(F.col("trend") == "Worsening", 10).otherwise(0)
        + F.when(F.col("availability_pct") < 99, 5).otherwise(0)
    )
    severity = F.when(F.col("severity_score") == 0, "Normal").when(F.col("severity_score") >= 75, "Critical").when(F.col("severity_score") >= 45, "High").otherwise("Watch")
    rows = rows.withColumn("severity_score", F.when(F.col("is_nc"), F.least(F.lit(100), score)).otherwise(0).cast("long")).withColumn("severity", severity)
    return rows.select(
        "period", "cell_id", "is_nc", F.col("streak").cast("long").alias("streak"), "lifecycle", "trend", "severity", "severity_score",
        "observed_days", "breach_days", "prb_avg", "throughput_kbps", "users", "volume_mb", "availability_pct",
    )


def latest(rows: DataFrame, star: Star | None = None, grain: str = "weekly") -> DataFrame:
    """Rows of the last period: that of the facts of ``star``, read beforehand, so
    that ``rows`` is evaluated once; without a star, the last of ``rows`` itself."""
    if star is None:
        return rows.join(rows.agg(F.max("period").alias("period")), "period")
    return rows.filter(F.col("period") == F.lit(star.last_period(grain)))


def last_week(star: Star) -> DataFrame:
    """Cells of the last week alone: no other day is read."""
    return latest(cell_weekly(star.since(star.last_period())), star)


def with_back(rows: DataFrame, periods: list) -> DataFrame:
    """``rows`` of ``periods`` (newest first) with ``back``, 0 the newest."""
    if not periods:
        return rows.withColumn("back", F.lit(0)).limit(0)
    back = F.when(F.col("period") == F.lit(periods[0]), 0)
    for i, p in enumerate(periods[1:], 1):
        back = back.when(F.col("period") == F.lit(p), i)
    return rows.filter(F.col("period").isin(periods)).withColumn("back", back)


def recent_weeks(star: Star, n: int) -> DataFrame:
    """Cells of the last ``n`` weeks, with ``back``: no earlier day is read."""
    weeks = star.periods(n)
    return with_back(cell_weekly(star.since(weeks[-1] if weeks else None)), weeks)


def nc_movement(star: Star, grain: str = "weekly", limit: int = 8) -> DataFrame:
    """Lifecycle counts of the last ``limit`` periods."""
    count = lambda s: F.count_if(F.col("lifecycle") == s)
    nc, total = F.count_if("is_nc"), F.count("*")
    return (
        with_back(nc_lifecycle(star, grain), star.periods(limit, grain)).groupBy("period")
        .agg(
            count("New").alias("new_nc"), count("Recurring").alias("recurring"), count("Persistent").alias("persistent"), count("Chronic").alias("chronic"),
            count("Recovering").alias("recovering"), nc.alias("nc_cells"), total.alias("total_cells"), rounded(100 * nc / total, 1).alias("nc_rate"),
        )
        .orderBy(F.desc("period"))
    )


def histogram(star: Star, column: str, grain: str = "weekly") -> DataFrame:
    """How many cells of the last period are in each state of ``column``."""
    return latest(nc_lifecycle(star, grain), star, grain).groupBy("period", column).agg(F.count("*").alias("cells"))


def scored(star: Star, last_only: bool = False, lifecycle: DataFrame | None = None) -> DataFrame:
    """Weekly lifecycle rows with the components of priority and of health, and a
    priority for each mode. Both come from one pass: they share the cell's windows
    and the week's peers, all its cells, the cell itself included. ``last_only``:
    of the last week, whose peers alone are read then. ``lifecycle``: weekly rows as they
    are stored, in place of the facts."""
    rules = star.rules
    rows = (nc_lifecycle(star) if lifecycle is None else lifecycle).withColumn("was_volume", F.lag("volume_mb").over(Window.partitionBy("cell_id").orderBy("period")))
    weeks = lifecycle if lifecycle is not None else last_week(star) if last_only else cell_weekly(star)
    peers = (latest(weeks, star) if last_only else weeks).groupBy("period").agg(*[rounded(F.avg(c), 4).alias(f"peer_{c}") for c in ("users", "volume_mb", "throughput_kbps")])
    rows = (latest(rows, star) if last_only else rows).join(peers, "period")
    above = lambda c: F.when(F.col(f"peer_{c}") > 0, clamp_round(100 * (F.col(c) - F.col(f"peer_{c}")) / F.col(f"peer_{c}"))).otherwise(0.0)
    peer, speed = F.col("peer_throughput_kbps"), F.col("throughput_kbps")
    limit = F.lit(rules.prb_threshold_pct)
    growth = pct_change("volume_mb", "was_volume")
    parts = rows.select(
        "*",
        clamp_round(100 * (F.coalesce("prb_avg", limit) - limit) / 40).alias("prb_severity"),
        _choose("lifecycle", PERSISTENCE, 0.0).alias("persistence_score"),
        above("users").alias("user_impact"), above("volume_mb").alias("traffic_impact"),
        F.when(peer > 0, clamp_round(100 * (peer - speed) / peer)).otherwise(0.0).alias("throughput_deficit"),
        _choose("trend", TREND_SCORE, 50.0).alias("trend_score"),
        _capacity(star).alias("capacity"),
        F.when(peer > 0, clamp_round(100 * speed / peer)).otherwise(100.0).alias("throughput"),
        clamp_round(F.coalesce("availability_pct", F.lit(100.0))).alias("availability"),
        _choose("lifecycle", NC_HEALTH, 100.0).alias("nc_health"),
        F.when(growth.isNotNull(), clamp_round(100 - clamp(growth) / 0.3)).otherwise(100.0).alias("growth"),
    )
    score = lambda mode: rounded(sum(F.lit(float(w)) * F.col(c) for w, c in zip(rules.mode_weights(mode), COMPONENTS)) / 100, 1)
    health = _weighted({"capacity": 0.25, "throughput": 0.2, "availability": 0.2, "nc_health": 0.25, "growth": 0.1})
    return parts.select("*", *[score(m).alias(m) for m in MODES], health.alias("health_score"))


def priority(star: Star, include_stale: bool = False, lifecycle: DataFrame | None = None) -> DataFrame:
    """Components of each cell's priority in its last week (by default, only cells
    that the last week of all has), with a score for each mode."""
    rows = scored(star, not include_stale, lifecycle)
    if include_stale:
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("period")))).filter("rn = 1")
    return rows.select("period", "cell_id", "lifecycle", "severity", *COMPONENTS, *MODES)


def priority_queue(star: Star, mode: str = "balanced", limit: int | None = None, lifecycle: DataFrame | None = None) -> DataFrame:
    """``lifecycle``: weekly rows as a workspace's period tables hold them; then no fact is read."""
    rows = priority(star, lifecycle=lifecycle).select("period", "cell_id", *COMPONENTS, F.lit(mode).alias("mode"), F.col(mode).alias("score"), band(F.col(mode)).alias("band"))
    return rows.orderBy(F.desc("score"), "cell_id").limit(limit) if limit else rows


def priority_bands(star: Star) -> DataFrame:
    """Cells by mode and band: the modes unfold without a join."""
    long = priority(star).unpivot(["cell_id"], list(MODES), "mode", "score")
    return long.groupBy("mode", band("score").alias("band")).agg(F.count("*").alias("cells"), rounded(F.avg("score"), 4).alias("score_avg"))


def _capacity(star: Star) -> Column:
    limit = F.lit(star.rules.prb_threshold_pct)
    return clamp_round(100 - 100 * (F.coalesce("prb_avg", limit) - limit) / 40)


def _weighted(weights: dict) -> Column:
    return rounded(sum(F.lit(w) * F.col(c) for c, w in weights.items()), 1)


def health_network(star: Star, grain: str = "weekly") -> DataFrame:
    # One row a period: the window is small.
    rows = entity_period(star, "network", grain).withColumn("was", F.lag("volume_mb").over(Window.orderBy("period")))
    growth = F.coalesce(pct_change("volume_mb", "was"), F.lit(0.0))
    return rows.select(
        "period", _capacity(star).alias("capacity"),
        clamp_round(100 * F.coalesce("throughput_kbps", F.lit(0.0)) / FULL_THROUGHPUT_KBPS).alias("throughput"),
        clamp_round(F.coalesce("availability_pct", F.lit(100.0))).alias("availability"),
        clamp_round(100 - 3 * F.coalesce("nc_rate", F.lit(0.0))).alias("nc_recurrence"),
        clamp_round(100 - 2 * clamp(growth)).alias("growth"),
    ).withColumn("score", _weighted({"capacity": 0.25, "throughput": 0.2, "availability": 0.2, "nc_recurrence": 0.2, "growth": 0.15}))


def health_cell(star: Star) -> DataFrame:
    """Weekly, against the mean throughput of the week's cells; dated by the week's last day."""
    return _health(scored(star))


def health_last(star: Star) -> DataFrame:
    return _health(scored(star, last_only=True))


def _health(rows: DataFrame) -> DataFrame:
    parts = ("capacity", "throughput", "availability", "nc_health", "growth")
    return rows.select("period", F.date_add("period", 6).alias("as_of"), "cell_id", *parts, F.col("health_score").alias("score"))


def health_matrix(star: Star, scope: str = "cell", weeks: int = 12, limit: int = 60) -> DataFrame:
    """Entities by the last ``weeks`` weeks, worst latest score first; one column a week, w0 the newest."""
    weeks, limit = max(2, min(26, weeks)), max(1, min(200, limit))
    key, name = ENTITY[scope]
    recent = with_back(health_cell(star), star.periods(weeks)).join(star.cells, "cell_id")
    wide = recent.groupBy(F.col(key).alias("id"), F.col(name).alias("name")).pivot("back", list(range(weeks))).agg(rounded(F.avg("score"), 1))
    wide = wide.select("id", "name", *[F.col(str(i)).alias(f"w{i}") for i in range(weeks)])
    return wide.orderBy(F.asc_nulls_last("w0"), "id").limit(limit)


def health_snapshot(star: Star, limit: int = 200) -> DataFrame:
    """Worst cells of the last week."""
    return health_last(star).orderBy("score", "cell_id").limit(limit)

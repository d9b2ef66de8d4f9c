"""Forecasts: damped Holt by week or month, seasonal Holt-Winters by day, risk.

A series is one array per key, in order of time; the smoothing recursion runs
inside ``aggregate`` on the JVM, so keys are the parallel axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rank_of, rounded
from ..sources.star import Star
from .aggregates import cell_weekly, entity_period

ALPHA, BETA, FIT_PHI, PHI = 0.40, 0.15, 0.90, 0.92
SEASON_ALPHA, SEASON_BETA, SEASON_GAMMA = 0.35, 0.15, 0.25
RISKS = ("Already Breached", "Likely Breach", "At Risk", "Watch", "Stable")
#: Metric: threshold (None: none), whether a rise is bad.
THRESHOLDS = {"prb_avg": (80.0, True), "availability_pct": (99.5, False), "throughput_kbps": (10_000.0, False), "users": (None, True), "volume_mb": (None, True)}
PERCENT = ("prb_avg", "availability_pct")


def series(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, v, n, last_period): values in order of time, without nulls."""
    points = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))))
    out = rows.groupBy(*keys).agg(points.alias("points"))
    return out.select(*keys, F.transform("points", lambda p: p["v"]).alias("v"), F.size("points").alias("n"), F.element_at("points", -1)["t"].alias("last_period"), "points")


def _slope(v: Column, n: Column) -> Column:
    """Least squares over 0 .. n-1."""
    mean_t = (n - 1) / 2.0
    total = lambda f: F.aggregate(F.transform(v, f), F.lit(0.0), lambda a, x: a + x)
    cov = total(lambda x, i: (i - mean_t) * x)
    var = n * (n * n - 1) / 12.0
    return F.when(var > 0, cov / var).otherwise(0.0)


def holt(rows: DataFrame) -> DataFrame:
    """Adds level, slope and the one-step errors of damped Holt; ``rows`` as from ``series``."""
    rows = rows.withColumn("start_slope", _slope(F.col("v"), F.col("n")))
    # The first point predicts itself and moves level and trend like any other.
    state = F.struct(
        F.lit(0).alias("i"), F.col("v")[0].alias("level"), F.col("start_slope").alias("slope"), F.lit(0.0).alias("abs"),
        F.lit(0.0).alias("sq"), F.lit(0).alias("hits"), F.col("v")[0].alias("was"),
    )

    def step(s: Column, x: Column) -> Column:
        expected = s["level"] + FIT_PHI * s["slope"]
        level = ALPHA * x + (1 - ALPHA) * expected
        slope = BETA * (level - s["level"]) + (1 - BETA) * FIT_PHI * s["slope"]
        off = F.when(s["i"] > 0, x - expected).otherwise(0.0)
        hit = (s["i"] > 0) & ((expected - s["was"]) * (x - s["was"]) > 0)
        return F.struct(
            (s["i"] + 1).alias("i"), level.alias("level"), slope.alias("slope"), (s["abs"] + F.abs(off)).alias("abs"),
            (s["sq"] + off * off).alias("sq"), (s["hits"] + hit.cast("int")).alias("hits"), x.alias("was"),
        )

    return _finished(rows.withColumn("s", F.aggregate("v", state, step)).withColumn("seasonal", F.lit(0.0)), F.col("n") - 1)


def _finished(rows: DataFrame, errors: Column) -> DataFrame:
    n = F.when(errors > 0, errors)
    return rows.select(
        "*", F.col("s.level").alias("level"), F.col("s.slope").alias("slope"), (F.col("s.abs") / n).alias("mae"),
        F.sqrt(F.col("s.sq") / n).alias("rmse"), (100 * F.col("s.hits") / n).alias("directional"), F.element_at("v", -1).alias("latest"),
    ).drop("s")


def holt_winters(rows: DataFrame) -> DataFrame:
    """Daily series of seven points or more: additive weekly seasons, Sunday first.

    ``rows`` as from ``series`` by date. Starts from a least squares line and the
    centred means of its residuals by weekday.
    """
    days = F.transform("points", lambda p: F.dayofweek(p["t"]) - 1)
    rows = rows.filter("n >= 7").withColumn("dow", days).withColumn("start_slope", _slope(F.col("v"), F.col("n")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("base", total / F.col("n") - F.col("start_slope") * (F.col("n") - 1) / 2.0)
    flat = F.transform("v", lambda x, i: F.struct(F.col("dow")[i].alias("d"), (x - F.col("base") - F.col("start_slope") * i).alias("r")))
    rows = rows.withColumn("flat", flat)

    def mean_of(d: Column) -> Column:
        own = F.transform(F.filter("flat", lambda x: x["d"] == d), lambda x: x["r"])
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)).otherwise(0.0)

    def centred(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 7.0
        return F.transform(a, lambda x: x - mean)

    rows = rows.withColumn("profile", centred(F.transform(F.sequence(F.lit(0), F.lit(6)), mean_of)))
    pairs = F.arrays_zip(F.col("dow").alias("d"), F.col("v").alias("x"))
    state = F.struct(
        F.lit(0).alias("i"), (F.col("v")[0] - F.col("profile")[F.col("dow")[0]]).alias("level"), F.col("start_slope").alias("slope"),
        F.col("profile").alias("season"), F.lit(0.0).alias("abs"), F.lit(0.0).alias("sq"), F.lit(0).alias("hits"), F.col("v")[0].alias("was"),
    )

    def step(s: Column, p: Column) -> Column:
        d, x = p["d"], p["x"]
        carried = s["level"] + PHI * s["slope"]
        expected = carried + s["season"][d]
        level = SEASON_ALPHA * (x - s["season"][d]) + (1 - SEASON_ALPHA) * carried
        slope = SEASON_BETA * (level - s["level"]) + (1 - SEASON_BETA) * PHI * s["slope"]
        moved = F.transform(s["season"], lambda z, i: F.when(i == d, SEASON_GAMMA * (x - level) + (1 - SEASON_GAMMA) * z).otherwise(z))
        off = F.when(s["i"] > 0, x - expected).otherwise(0.0)
        hit = (s["i"] > 0) & ((expected - s["was"]) * (x - s["was"]) > 0)
        return F.struct(
            (s["i"] + 1).alias("i"), level.alias("level"), slope.alias("slope"), centred(moved).alias("season"), (s["abs"] + F.abs(off)).alias("abs"),
            (s["sq"] + off * off).alias("sq"), (s["hits"] + hit.cast("int")).alias("hits"), x.alias("was"),
        )

    rows = rows.withColumn("s", F.aggregate(pairs, state, step))
    following = F.dayofweek(F.date_add("last_period", 1)) - 1
    rows = rows.withColumn("seasonal", F.col("s.season")[following]).withColumn("season", F.col("s.season"))
    return _finished(rows, F.col("n") - 1).drop("flat", "profile", "base", "dow")


def outlook(fitted: DataFrame, percent: Column, seasonal: bool = False) -> DataFrame:
    """Adds the next value with its band, confidence, quality and method; series of
    fewer than two points are suppressed. ``percent``: values lie within 0 and 100."""
    bounded = lambda x: F.when(percent, F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))).otherwise(F.greatest(F.lit(0.0), x))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = fitted.filter("n >= 2").withColumn("next", bounded(F.col("level") + PHI * F.col("slope") + F.col("seasonal"))).withColumn("scale", F.greatest(F.lit(1e-6), F.abs(mean)))
    band = F.greatest(0.03 * F.col("scale"), 1.645 * F.col("rmse"))
    ratio = F.col("mae") / F.col("scale")
    confidence = rounded(F.least(F.lit(95.0), F.greatest(F.lit(20.0), 100 - 200 * ratio)), 0)
    method = F.lit("seasonal-holt-winters") if seasonal else F.when(F.abs("slope") > 1e-4, "linear-trend").otherwise("moving-average")
    return rows.select(
        "*", bounded(F.col("next") - band).alias("lower"), bounded(F.col("next") + band).alias("upper"),
        F.when(F.col("n") < 4, F.least(F.lit(60.0), confidence)).otherwise(confidence).alias("confidence"),
        F.when(F.col("n") < 3, "low").when(ratio <= 0.05, "high").when(ratio <= 0.15, "medium").otherwise("low").alias("quality"), method.alias("method"),
    )


SUMMARY = ("next", "lower", "upper", "mae", "rmse", "directional", "latest")


def _report(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.col("n").cast("long").alias("n"), "last_period", *[rounded(c, 2).alias(c) for c in SUMMARY], "confidence", "quality", "method")


def weekly_forecasts(star: Star, metric: str = "prb_avg") -> DataFrame:
    """Each cell's next week."""
    fitted = holt(series(cell_weekly(star), ["cell_id"], "period", metric))
    return _report(outlook(fitted, F.lit(metric in PERCENT)), ["cell_id"])


def network_series(star: Star, grain: str = "weekly") -> DataFrame:
    wide = entity_period(star, "network", grain)
    return series(wide.unpivot(["period"], list(THRESHOLDS), "metric", "value"), ["metric"], "period", "value")


def network_forecast(star: Star, grain: str = "weekly") -> DataFrame:
    fitted = holt(network_series(star, grain))
    return _report(outlook(fitted, F.col("metric").isin(*PERCENT)), ["metric"])


def entity_forecast(star: Star, level: str, metric: str = "prb_avg", grain: str = "weekly") -> DataFrame:
    """The next period of each site, district or region."""
    rows = entity_period(star, level, grain)
    return _report(outlook(holt(series(rows, ["entity_id"], "period", metric)), F.lit(metric in PERCENT)), ["entity_id"])


def trajectory(star: Star, horizon: int = 6) -> DataFrame:
    """(metric, h, value, lower, upper) of the network for the next weeks."""
    fitted = outlook(holt(network_series(star)), F.col("metric").isin(*PERCENT))
    bounded = lambda x: F.when(F.col("metric").isin(*PERCENT), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))).otherwise(F.greatest(F.lit(0.0), x))
    rows = fitted.select("metric", "level", "slope", "rmse", "latest", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    damped = PHI * (1 - F.pow(F.lit(PHI), F.col("h"))) / (1 - PHI)  # sum of PHI**i for i = 1 .. h
    spread = F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(0.05 * F.abs("latest")) * F.sqrt(1 + 0.15 * (F.col("h") - 1)) * 1.645
    rows = rows.withColumn("value", bounded(F.col("level") + F.col("slope") * damped)).withColumn("margin", F.greatest(0.02 * F.col("value"), spread))
    return rows.select("metric", "h", rounded("value", 2).alias("value"), rounded(bounded(F.col("value") - F.col("margin")), 2).alias("lower"), rounded(bounded(F.col("value") + F.col("margin")), 2).alias("upper"))


def risk(latest, following, threshold, worse_is_higher: bool) -> Column:
    """Where a series stands to its threshold; without one, by its growth."""
    if threshold is None:
        growth = (following - latest) / F.when(latest != 0, F.abs(latest)) * 100
        return F.when(growth >= 15, "Watch").otherwise("Stable")
    past = (lambda x: x >= threshold) if worse_is_higher else (lambda x: x <= threshold)
    margin = ((threshold - following) if worse_is_higher else (following - threshold)) / threshold
    return F.when(past(latest), RISKS[0]).when(past(following), RISKS[1]).when(margin <= 0.1, RISKS[2]).when(margin <= 0.2, RISKS[3]).otherwise(RISKS[4])


def risk_rows(star: Star, metric: str = "prb_avg", limit: int | None = 60) -> DataFrame:
    """Cells by risk, gravest first."""
    rows = weekly_forecasts(star, metric)
    threshold, up = THRESHOLDS[metric]
    rows = rows.select("cell_id", F.col("latest").alias("current"), F.col("next").alias("forecast"), risk(F.col("latest"), F.col("next"), threshold, up).alias("risk"))
    return rows.orderBy(rank_of("risk", RISKS), F.desc("current"), "cell_id").limit(limit) if limit else rows


def risk_counts(star: Star, metric: str = "prb_avg") -> DataFrame:
    return risk_rows(star, metric, None).groupBy("risk").agg(F.count("*").alias("cells"))


def daily_forecasts(rows: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Holt-Winters of dense daily series, such as events by user."""
    fitted = holt_winters(series(rows, [key], date, value))
    return _report(outlook(fitted, F.lit(False), seasonal=True), [key])

"""Investigation of cells: evidence, diagnosis, events, peers and what-ifs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp_round, delta, delta_pct, pct_change, rounded
from ..functions.rules import Rules
from ..sources.star import Star
from .aggregates import ENTITY, cell_weekly, flagged_facts
from .intelligence import health_last, last_week, latest, nc_lifecycle, scored
from .views import AVERAGED, METRICS


def evidence(star: Star) -> DataFrame:
    """Each cell's metrics in its last two weeks, long."""
    by_cell = Window.partitionBy("cell_id").orderBy(F.desc("period"))
    rows = cell_weekly(star).withColumn("rn", F.row_number().over(by_cell)).filter("rn <= 2")
    at = lambda m, rn: F.max(F.when(F.col("rn") == rn, F.col(m)))
    wide = rows.groupBy("cell_id").agg(*[at(m, 1).alias(f"c_{m}") for m in METRICS], *[at(m, 2).alias(f"p_{m}") for m in METRICS])
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"c_{m}").alias("current"), F.col(f"p_{m}").alias("previous")) for m in METRICS])
    long = wide.select("cell_id", F.explode(items).alias("x")).select("cell_id", "x.*")
    return long.select("*", delta("current", "previous").alias("delta"), delta_pct("current", "previous").alias("delta_pct"))


def tail_streaks(star: Star) -> DataFrame:
    """Consecutive non-compliant weeks at the end of each cell's series."""
    rows = cell_weekly(star).groupBy("cell_id").agg(
        F.max(F.when(~F.col("is_nc"), F.col("period"))).alias("good"), F.collect_list(F.when(F.col("is_nc"), F.col("period"))).alias("bad")
    )
    after = F.filter("bad", lambda p: F.col("good").isNull() | (p > F.col("good")))
    return rows.select("cell_id", F.size(after).cast("long").alias("tail_weeks"))


def findings(star: Star) -> DataFrame:
    """(cell_id, finding) of the last week against each cell's week before."""
    by_cell = Window.partitionBy("cell_id").orderBy("period")
    rows = nc_lifecycle(star).select("*", *[F.lag(m).over(by_cell).alias(f"was_{m}") for m in METRICS], F.lag("is_nc").over(by_cell).alias("was_nc"))
    rows = latest(rows, star)
    limit = star.rules.prb_threshold_pct
    change = lambda m: pct_change(m, f"was_{m}")
    tests = {
        "prb_high": F.col("prb_avg") >= limit, "prb_rising": F.col("prb_avg") - F.col("was_prb_avg") >= 3, "throughput_drop": change("throughput_kbps") <= -10,
        "users_growth": change("users") >= 10, "volume_growth": change("volume_mb") >= 10, "availability_low": F.col("availability_pct") < 99.5,
        "persistent": F.col("streak") >= 2, "entered_nc": F.col("streak") == 1, "recovered": F.col("was_nc") & ~F.col("is_nc"),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]).cast("array<string>"))
    return rows.select("cell_id", F.explode(found).alias("finding"))


#: What the rules look at, and the KPIs that may tell it, the first that is measured.
KPI_INPUTS = {
    "call_drop": ("call_drop", "call_drop_rate_4g", "call_drop_rate_3g", "call_drop_rate_2g"),
    "congestion": ("congestion", "tch_congestion"),
    "sdcch": ("sdcch_congestion", "congestion"),
    "setup": ("call_setup", "call_setup_success_4g", "call_setup_success_3g", "call_setup_success_2g"),
    "data_access": ("data_access", "data_access_success_3g"),
    "data_failure": ("data_failure", "data_service_failure_4g"),
}

#: A row is a condition on a metric of a cell. Conditions of one clause are alternatives, and
#: a term holds if each of its clauses does; then it adds ``points`` to its hypothesis (side
#: "base" or "support") or takes them away ("contra"). ``technology``: whose KPI it is, null
#: for measures, inputs and KPIs of any. ``nth`` orders terms. A missing value meets nothing.
RULE_ROW = "hypothesis string, side string, nth int, term string, points int, clause int, technology string, metric string, comparison string, limit double"
COMPARISONS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}
#: What every cell has, for conditions that always hold.
ALWAYS = (None, "always", ">=", 0.0)
#: What to do about each hypothesis.
ADVICE = {
    "congestion": "add capacity or move load", "accessibility": "check random access, signalling links and licences", "retainability": "check coverage edges, neighbours and hardware",
    "sleeping_cell": "reset the cell and check its radio chain", "transport": "check the backhaul's rate and errors", "interference": "scan the uplink and check tilts",
}


def diagnosis_rules(r: Rules) -> list[tuple]:
    """The rows (RULE_ROW) of six hypotheses under the thresholds ``r``.

    Fixed values: bases, points and limits."""
    of = lambda metric, comparison, limit, technology=None: (technology, metric, comparison, float(limit))
    low = [of("volume_mb", "<", 10), of("users", "<", 2)]
    terms = [
        ("congestion", "base", 35, "", [[ALWAYS]]),
        ("congestion", "support", 30, "load", [[of("prb_avg", ">=", r.prb_threshold_pct)]]),
        ("congestion", "support", 30, "blocking", [[of("congestion", ">=", r.tch_congestion_pct)]]),
        ("congestion", "support", 25, "signalling blocks", [[of("sdcch_congestion", ">=", r.sdcch_congestion_pct, "2G")]]),
        ("congestion", "support", 15, "users grow", [[of("users_pct", ">=", 10)]]),
        ("congestion", "support", 15, "volume grows", [[of("volume_pct", ">=", 10)]]),
        ("congestion", "support", 15, "lasting", [[of("streak", ">=", r.persistent_weeks)]]),
        ("congestion", "contra", 25, "load far below threshold", [[of("prb_avg", "<", r.prb_threshold_pct - 15)]]),
        ("accessibility", "base", 30, "", [[ALWAYS]]),
        ("accessibility", "support", 30, "setup", [[of("setup", "<", r.cssr_pct)]]),
        ("accessibility", "support", 25, "data access", [[of("data_access", "<", r.data_access_pct)]]),
        ("accessibility", "support", 30, "data failures", [[of("data_failure", ">", r.data_failure_pct)]]),
        ("accessibility", "support", 20, "signalling blocked", [[of("sdcch", ">", r.sdcch_congestion_pct)]]),
        ("accessibility", "contra", 20, "setup healthy", [[of("setup", ">=", r.cssr_pct)]]),
        ("retainability", "base", 30, "", [[ALWAYS]]),
        ("retainability", "support", 35, "drops", [[of("call_drop", ">", r.call_drop_pct)]]),
        ("retainability", "support", 15, "availability", [[of("availability_pct", "<", 99)]]),
        ("retainability", "contra", 20, "drops healthy", [[of("call_drop", "<=", r.call_drop_pct)]]),
        ("sleeping_cell", "base", 20, "", [[ALWAYS]]),
        ("sleeping_cell", "support", 50, "available, yet idle", [[of("availability_pct", ">=", 99)], low, [of("was_volume_mb", ">", 100), of("was_users", ">", 20)]]),
        ("sleeping_cell", "contra", 20, "unavailable", [low, [of("availability_pct", "<", 99)]]),
        ("sleeping_cell", "contra", 40, "carries traffic", [[of("volume_mb", ">=", 10)], [of("users", ">=", 2)]]),
        ("transport", "base", 30, "", [[ALWAYS]]),
        ("transport", "support", 25, "speed fell", [[of("throughput_pct", "<=", -15)]]),
        ("transport", "support", 20, "slow", [[of("throughput_kbps", "<", 2000)]]),
        ("transport", "support", 10, "available", [[of("availability_pct", ">=", 99.5)]]),
        ("transport", "support", 25, "slow without load", [[of("prb_avg", "<", 40)], [of("throughput_kbps", "<", 2000)]]),
        ("transport", "contra", 20, "unavailable", [[of("availability_pct", "<", 95)]]),
        ("interference", "base", 30, "", [[ALWAYS]]),
        ("interference", "support", 30, "slow at low load", [[of("prb_avg", "<", 60)], [of("throughput_kbps", "<", 4000)]]),
        ("interference", "support", 25, "drops without load", [[of("call_drop", ">", r.call_drop_pct)], [of("prb_avg", "<", r.prb_threshold_pct)]]),
        ("interference", "support", 10, "availability", [[of("availability_pct", "<", 99)]]),
        ("interference", "contra", 20, "loaded", [[of("prb_avg", ">=", r.prb_threshold_pct)]]),
    ]
    return [(name, side, nth, term, points, clause, *condition) for nth, (name, side, points, term, clauses) in enumerate(terms) for clause, conditions in enumerate(clauses) for condition in conditions]


def cell_signs(star: Star) -> DataFrame:
    """(cell_id, technology, metric, value): what the rules may ask about the cells of the
    last week, long: measures and their changes, the streak, each KPI under its technology
    and under none, and the inputs of KPI_INPUTS."""
    by_cell = Window.partitionBy("cell_id").orderBy("period")
    rows = nc_lifecycle(star).select("*", *[F.lag(m).over(by_cell).alias(f"was_{m}") for m in ("users", "volume_mb", "throughput_kbps")])
    rows = latest(rows, star).select("*", pct_change("users", "was_users").alias("users_pct"), pct_change("volume_mb", "was_volume_mb").alias("volume_pct"), pct_change("throughput_kbps", "was_throughput_kbps").alias("throughput_pct"))
    names = ("prb_avg", "throughput_kbps", "users", "volume_mb", "availability_pct", "streak", "users_pct", "volume_pct", "throughput_pct", "was_users", "was_volume_mb")
    signs = rows.select("cell_id", F.lit(0.0).alias("always"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["cell_id"], ["always", *names], "metric", "value").select("cell_id", F.lit(None).cast("string").alias("technology"), "metric", "value")
    week = star.since(star.last_period()).extras.withColumn("period", F.trunc("date", "week")).filter(F.col("period") == F.lit(star.last_period()))
    known = week.groupBy("cell_id", "technology", F.col("kpi_key").alias("metric")).agg(rounded(F.avg("value")).alias("value")).filter("value IS NOT NULL").join(rows.select("cell_id"), "cell_id", "left_semi")
    # An input is the first of its KPIs that is measured; of technologies that share a key, the newest.
    inputs = [F.struct(F.lit(name).alias("input"), F.lit(nth).alias("nth"), F.lit(key).alias("key")) for name, keys in KPI_INPUTS.items() for nth, key in enumerate(keys)]
    asked = known.select("*", F.explode(F.filter(F.array(*inputs), lambda x: x["key"] == F.col("metric"))).alias("x"))
    first = asked.groupBy("cell_id", "x.input").agg(F.min_by("value", F.struct("x.nth", -F.substring("technology", 1, 1).try_cast("int"))).alias("value"))
    return signs.unionByName(known).unionByName(first.select("cell_id", F.lit(None).cast("string").alias("technology"), F.col("input").alias("metric"), "value"))


def diagnosis(star: Star, rules: DataFrame | None = None, advice: dict[str, str] | None = None) -> DataFrame:
    """(cell_id, hypothesis, score, verdict, confidence, supporting, opposing, advice) for
    the cells of the last week, by the conditions ``rules`` (RULE_ROW; six hypotheses if not
    given). Advice is given from a score of 45 on. Signs meet conditions by metric; a cell's
    conditions are added up to terms, and these to scores, so a new rule is a new row."""
    rules = star.spark.createDataFrame(diagnosis_rules(star.rules), RULE_ROW) if rules is None else rules
    term = ["hypothesis", "side", "nth", "term", "points"]
    clauses = rules.groupBy(*term).agg(F.expr("bit_or(shiftleft(1L, clause))").alias("needed"))
    conditions = rules.join(clauses, term).withColumnRenamed("technology", "of_technology")
    met = F.lit(False)
    for sign, holds in COMPARISONS.items():
        met = met | ((F.col("comparison") == sign) & holds(F.col("value"), F.col("limit")))
    signs = cell_signs(star)
    hits = signs.join(conditions, "metric").filter(F.col("of_technology").eqNullSafe(F.col("technology")) & met)
    terms = hits.groupBy("cell_id", *term, "needed").agg(F.expr("bit_or(shiftleft(1L, clause))").alias("met")).filter("met = needed")
    seen = lambda side: F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("nth", "term")))), lambda x: x["term"]))
    total = F.sum(F.when(F.col("side") == "contra", -F.col("points")).otherwise(F.col("points")))
    found = terms.groupBy("cell_id", "hypothesis").agg(F.least(F.lit(95), F.greatest(F.lit(5), total)).cast("long").alias("score"), seen("support").alias("supporting"), seen("contra").alias("opposing"))
    told = F.create_map(*[F.lit(x) for pair in (advice or ADVICE).items() for x in pair])
    score = F.col("score")
    return found.select(
        "cell_id", "hypothesis", "score", F.when(score >= 65, "consistent").when(score >= 45, "suggests").otherwise("weak").alias("verdict"),
        F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low").alias("confidence"), "supporting", "opposing", F.when(score >= 45, told[F.col("hypothesis")]).alias("advice"),
    )


NOTES = "cell_id long, at date, author string, note string"


def events_timeline(star: Star, notes: DataFrame | None = None, score_step: float = 5.0) -> DataFrame:
    """(cell_id, period, kind, note): changes of lifecycle, changes of the balanced
    priority by ``score_step`` or more week by week, and the ``notes`` of people (NOTES)."""
    by_cell = Window.partitionBy("cell_id").orderBy("period")
    rows = scored(star).withColumn("was", F.lag("lifecycle").over(by_cell)).withColumn("was_score", F.lag("balanced").over(by_cell))
    moved = F.abs(F.col("balanced") - F.col("was_score")) >= score_step
    found = F.array(
        F.when(F.col("was") != F.col("lifecycle"), F.struct(F.lit("lifecycle").alias("kind"), F.concat_ws(" -> ", "was", "lifecycle").alias("note"))),
        F.when(moved, F.struct(F.lit("priority").alias("kind"), F.when(F.col("balanced") > F.col("was_score"), "up").otherwise("down").alias("note"))),
    )
    events = rows.select("cell_id", "period", F.explode(F.array_compact(found)).alias("e")).select("cell_id", "period", "e.*")
    if notes is None:
        return events
    return events.unionByName(notes.select("cell_id", F.col("at").alias("period"), F.lit("note").alias("kind"), F.concat_ws(": ", "author", "note").alias("note")))


INTERVENTION = "scope string, id long, at date"


def interventions_before_after(star: Star, interventions: DataFrame, most: int = 8) -> DataFrame:
    """(scope, id, at, metric, before, after, delta_pct) for any number of ``interventions``
    (INTERVENTION): metrics of the entity in up to ``most`` weeks with data on each side.
    Weeks that start on ``at`` or later are after it; without a date it is the entity's middle week.

    Weeks are added up by entity once. An intervention's windows become a row a week, and
    meet the entity's weeks by scope, id and week. Where weeks are missing, windows reach
    further: each side keeps its nearest ``most`` of all weeks of the entity."""
    weekly = cell_weekly(star).join(star.cells, "cell_id")
    levels = [F.struct(F.lit(level).alias("scope"), (F.col(key) if key else F.lit(0)).cast("long").alias("id")) for level, (key, _) in ENTITY.items()]
    figures = [(F.avg if m in AVERAGED else F.sum)(m).alias(m) for m in METRICS]
    asked = interventions.select("scope", F.coalesce("id", F.lit(0).cast("long")).alias("id"), "at").distinct()
    # Only the entities that are asked for are added up.
    by_entity = weekly.select("period", *METRICS, F.explode(F.array(*levels)).alias("e")).select("period", *METRICS, "e.*")
    by_entity = by_entity.join(asked.select("scope", "id").distinct(), ["scope", "id"], "left_semi").groupBy("scope", "id", "period").agg(*figures)
    # A week's number among those of its entity: windows are ranges of these numbers.
    own = Window.partitionBy("scope", "id").orderBy("period")
    numbered_weeks = by_entity.withColumn("nth", F.row_number().over(own)).withColumn("weeks", F.count("*").over(Window.partitionBy("scope", "id")))
    middle = numbered_weeks.filter(F.col("nth") == F.floor(F.col("weeks") / 2) + 1).select("scope", "id", F.col("period").alias("middle"))
    dated = asked.join(middle, ["scope", "id"]).withColumn("from", F.coalesce("at", "middle"))
    # The number of the first week after: one more than the weeks before. Weeks meet an entity's dates by its key.
    starts = dated.join(numbered_weeks.select("scope", "id", "period", "nth"), ["scope", "id"]).groupBy("scope", "id", "at", "from").agg((F.count_if(F.col("period") < F.col("from")) + 1).cast("int").alias("start"))
    window = F.explode(F.sequence(F.col("start") - most, F.col("start") + most - 1)).alias("nth")
    met = starts.select("scope", "id", "at", "from", "start", window).join(numbered_weeks, ["scope", "id", "nth"])
    side = lambda m, after: rounded(F.avg(F.when((F.col("nth") >= F.col("start")) == after, F.col(m))))
    wide = met.groupBy("scope", "id", "at", "from").agg(*[side(m, False).alias(f"b_{m}") for m in METRICS], *[side(m, True).alias(f"a_{m}") for m in METRICS])
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after")) for m in METRICS])
    long = wide.select("scope", "id", F.col("from").alias("at"), F.explode(items).alias("x")).select("scope", "id", "at", "x.*")
    return long.withColumn("delta_pct", delta_pct("after", "before"))


def before_after(star: Star, intervention: str | None = None, scope: str = "network", entity_id: int = 0, most: int = 8) -> DataFrame:
    """Metrics of an entity in up to ``most`` weeks on each side of a date, of the network if not told."""
    one = star.spark.createDataFrame([(scope, entity_id)], "scope string, id long").select("*", F.lit(intervention).cast("date").alias("at"))
    return interventions_before_after(star, one, most).select("metric", "before", "after", "delta_pct")


def peers(star: Star, cell_id: int, limit: int = 10) -> DataFrame:
    """Cells of the same district, least healthy first."""
    district = star.cells.filter(F.col("cell_id") == cell_id).select("district_id")
    others = star.cells.join(district, "district_id").filter(F.col("cell_id") != cell_id).select("cell_id", "cell")
    rows = latest(nc_lifecycle(star), star).select("cell_id", "prb_avg", "throughput_kbps", "is_nc").join(others, "cell_id")
    health = health_last(star).select("cell_id", F.col("score").alias("health_score"))
    return rows.join(health, "cell_id", "left").orderBy(F.asc_nulls_last("health_score"), "cell_id").limit(limit)


def history_stats(star: Star) -> DataFrame:
    """Per cell: days seen, days in breach, and how its load stands to the threshold."""
    t = star.rules.prb_threshold_pct
    n, bad = F.count("*"), F.count_if("prb_breach")
    return flagged_facts(star).groupBy("cell_id").agg(
        n.alias("days"), bad.alias("breach_days"), rounded(100 * bad / n, 1).alias("breach_rate"), rounded(F.avg("prb")).alias("prb_avg"),
        rounded(F.max("prb")).alias("prb_max"), rounded(F.avg("prb") - t).alias("to_threshold"),
    ).withColumn("insight", F.when(F.col("breach_rate") >= 50, "overloaded").when(F.col("breach_rate") >= 20, "often loaded").when(F.col("prb_max") >= t, "peaks").otherwise("calm"))


def peak_weekday(star: Star, least_days: int = 7) -> DataFrame:
    """The weekday of highest mean load (0 is Sunday) of cells with enough days."""
    days = star.facts.groupBy("cell_id", (F.dayofweek("date") - 1).alias("dow")).agg(rounded(F.avg("prb")).alias("prb"), F.count("*").alias("n"))
    best = F.max(F.struct("prb", (-F.col("dow")).alias("d"), "dow")).alias("best")
    rows = days.groupBy("cell_id").agg(F.sum("n").alias("days"), best).filter(F.col("days") >= least_days)
    return rows.select("cell_id", "days", F.col("best.dow").alias("peak_dow"), F.col("best.prb").alias("peak_prb"))


@dataclass(frozen=True)
class Scenario:
    """A capacity change: bandwidths in MHz, offload in percent."""

    base_mhz: float = 10.0
    added_mhz: float = 10.0
    carrier_aggregation: bool = False
    mimo_4x4: bool = False
    offload_pct: float = 0.0

    @property
    def gain(self) -> float:
        return (self.base_mhz + self.added_mhz) / self.base_mhz * (1.25 if self.carrier_aggregation else 1) * (1.35 if self.mimo_4x4 else 1)


#: Loads below this count as resolved, whatever the ruleset says.
RESOLVED_PRB = 80.0


def what_if(star: Star, scenario: Scenario = Scenario()) -> DataFrame:
    """Every cell-week under ``scenario``."""
    g, kept = scenario.gain, (100 - scenario.offload_pct) / 100
    prb = F.coalesce("prb_avg", F.lit(0.0))
    rows = cell_weekly(star).select(
        "cell_id", "period", prb.alias("prb"), clamp_round(prb * kept / g).alias("sim_prb"),
        rounded(F.col("throughput_kbps") / 1000 * g, 1).alias("sim_throughput_mbps"), rounded(F.col("volume_mb") / 1024 * g, 1).alias("sim_volume_gb"),
    )
    return rows.select("*", rounded(F.col("prb") - F.col("sim_prb"), 1).alias("reduction"), (F.col("sim_prb") < RESOLVED_PRB).alias("resolved"))


def snapshot_figures(star: Star) -> DataFrame:
    """(key, value): what a store holds and how its last week stands."""
    stored = star.facts.agg(F.count("*").cast("double").alias("rows"))
    week = last_week(star).agg(
        F.count("*").cast("double").alias("cells"), F.count_if("is_nc").cast("double").alias("nc_cells"),
        *[rounded((F.avg if m in AVERAGED else F.sum)(m)).alias(m) for m in METRICS],
    )
    health = health_last(star).agg(rounded(F.avg("score"), 1).alias("health_score"))
    row = stored.join(week).join(health).withColumn("ruleset_version", F.lit(float(star.rules.version)))  # one row each
    return row.unpivot([], ["rows", "cells", "nc_cells", *METRICS, "health_score", "ruleset_version"], "key", "value")


#: Figures of a snapshot of which more is worse.
WORSE_IS_HIGHER = ("nc_cells", "prb_avg")


def snapshot_compare(a: Star, b: Star) -> DataFrame:
    """(key, a, b, delta, delta_pct, worse_is_higher): the figures of two stores."""
    both = snapshot_figures(a).withColumnRenamed("value", "a").join(snapshot_figures(b).withColumnRenamed("value", "b"), "key", "full")
    return both.select("key", "a", "b", delta("b", "a").alias("delta"), delta_pct("b", "a").alias("delta_pct"), F.col("key").isin(*WORSE_IS_HIGHER).alias("worse_is_higher"))


def investigation_scope(star: Star, scope: str, entity_id: int) -> DataFrame:
    """Weekly series of one entity of any scope."""
    key, _ = ENTITY[scope]
    rows = cell_weekly(star).join(star.cells.filter(F.col(key) == entity_id).select("cell_id"), "cell_id", "left_semi")
    return rows.groupBy("period").agg(F.count("*").alias("cells"), F.count_if("is_nc").alias("nc_cells"), *[rounded((F.avg if m in AVERAGED else F.sum)(m)).alias(m) for m in METRICS])

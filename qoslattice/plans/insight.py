"""Queries of forecasts, risk, diagnosis and investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as P
from ..operators import investigate as V
from ..operators.views import AVERAGED, METRICS
from ..sources.star import from_orders
from . import endpoints  # noqa: F401  (defines shared table expressions)
from . import oracle as O

QUERIES, ORACLE_SQL = {}, {}
AGG = {m: ("avg" if m in AVERAGED else "sum") for m in METRICS}


def add(name, query, sql=None):
    QUERIES[name] = lambda spark, d, q=query: q(from_orders(spark, d))
    if sql:
        ORACLE_SQL[name] = sql


def _holt(points: str, key: str) -> tuple[str, str, str]:
    """Table expressions p (numbered points), h (recursion), o (outlook); ``points``: key, t, v."""
    p = f"SELECT {key}, t, v, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM ({points}) WHERE v IS NOT NULL"
    e, level = "(level + 0.9::DOUBLE * slope)", "(0.4::DOUBLE * p.v + 0.6::DOUBLE * {e})"
    level = level.format(e=e)
    h = f"""
SELECT {key}, CAST(-1 AS BIGINT) AS i, first(v ORDER BY i)::DOUBLE AS level, coalesce(regr_slope(v, i), 0)::DOUBLE AS slope, 0::DOUBLE AS abs, 0::DOUBLE AS sq, 0::BIGINT AS hits, first(v ORDER BY i)::DOUBLE AS was
FROM p GROUP BY 1
UNION ALL
SELECT h.{key}, p.i, {level}, 0.15::DOUBLE * ({level} - level) + 0.85::DOUBLE * 0.9::DOUBLE * slope, abs + CASE WHEN p.i > 0 THEN abs(p.v - {e}) ELSE 0 END,
  sq + CASE WHEN p.i > 0 THEN (p.v - {e}) * (p.v - {e}) ELSE 0 END, hits + CASE WHEN p.i > 0 AND ({e} - was) * (p.v - was) > 0 THEN 1 ELSE 0 END, p.v
FROM h JOIN p ON p.{key} = h.{key} AND p.i = h.i + 1"""
    return p, h, _outlook(key, "level + 0.92 * slope", "CASE WHEN abs(slope) > 1e-4 THEN 'linear-trend' ELSE 'moving-average' END")


def _outlook(key: str, following: str, method: str) -> str:
    return f"""
SELECT *, CASE WHEN pct THEN least(100, greatest(0, next - band)) ELSE greatest(0, next - band) END AS lower, CASE WHEN pct THEN least(100, greatest(0, next + band)) ELSE greatest(0, next + band) END AS upper,
  CASE WHEN n < 4 THEN least(60, conf) ELSE conf END AS confidence, CASE WHEN n < 3 THEN 'low' WHEN mae / scale <= 0.05 THEN 'high' WHEN mae / scale <= 0.15 THEN 'medium' ELSE 'low' END AS quality
FROM (SELECT *, greatest(0.03 * scale, 1.645 * rmse) AS band, round(least(95, greatest(20, 100 - 200 * mae / scale)), 0) AS conf
  FROM (SELECT h.*, n, last_period, pct, CASE WHEN pct THEN least(100, greatest(0, {following})) ELSE greatest(0, {following}) END AS next, greatest(1e-6, abs(mean)) AS scale, abs / (n - 1) AS mae, sqrt(sq / (n - 1)) AS rmse,
      100 * hits / (n - 1) AS directional, was AS latest, {method} AS method
    FROM h JOIN (SELECT {key}, max(n) AS n, max(t) AS last_period, avg(v) AS mean, any_value(PCT) AS pct FROM p GROUP BY 1) USING ({key}) WHERE i = n - 1 AND n >= 2))"""


REPORT = "n, last_period, " + ", ".join(f"round({c}, 2) AS {c}" for c in P.SUMMARY) + ", confidence, quality, method"


def _recursive(p: str, h: str, o: str, pct: str, body: str, *needs: str) -> str:
    head = O.sql("", *needs).rstrip()
    return O.half_up(f"{head.replace('WITH ', 'WITH RECURSIVE ', 1)},\np AS ({p}),\nh AS ({h}),\no AS ({o.replace('PCT', pct)})\n{body}")


_w = _holt("SELECT cell_id, period AS t, prb_avg AS v FROM cw", "cell_id")
add("forecast_weekly", P.weekly_forecasts, _recursive(*_w, "true", f"SELECT cell_id, {REPORT} FROM o", "cw"))
RISK = "CASE WHEN latest >= 80 THEN 'Already Breached' WHEN next >= 80 THEN 'Likely Breach' WHEN (80 - next) / 80 <= 0.1 THEN 'At Risk' WHEN (80 - next) / 80 <= 0.2 THEN 'Watch' ELSE 'Stable' END"
RISKS = f"SELECT cell_id, latest AS current, next AS forecast, {RISK} AS risk FROM (SELECT cell_id, round(latest, 2) AS latest, round(next, 2) AS next FROM o)"
ORDER = "CASE risk WHEN 'Already Breached' THEN 0 WHEN 'Likely Breach' THEN 1 WHEN 'At Risk' THEN 2 WHEN 'Watch' THEN 3 ELSE 4 END"
add("risk_rows", P.risk_rows, _recursive(*_w, "true", f"SELECT * FROM ({RISKS}) ORDER BY {ORDER}, current DESC, cell_id LIMIT 60", "cw"))
add("risk_counts", P.risk_counts, _recursive(*_w, "true", f"SELECT risk, count(*) AS cells FROM ({RISKS}) GROUP BY 1", "cw"))
for g in ("weekly", "monthly"):
    _n = _holt(" UNION ALL ".join(f"SELECT '{m}' AS metric, period AS t, {m} AS v FROM ent_network_{g}" for m in P.THRESHOLDS), "metric")
    add(f"forecast_network_{g}", lambda s, g=g: P.network_forecast(s, g), _recursive(*_n, "metric IN ('prb_avg', 'availability_pct')", f"SELECT metric, {REPORT} FROM o", f"ent_network_{g}"))
    if g == "weekly":
        bound = lambda x: f"CASE WHEN pct THEN least(100, greatest(0, {x})) ELSE greatest(0, {x}) END"
        add("forecast_trajectory", P.trajectory, _recursive(
            *_n, "metric IN ('prb_avg', 'availability_pct')",
            f"SELECT metric, h, round(value, 2) AS value, round({bound('value - margin')}, 2) AS lower, round({bound('value + margin')}, 2) AS upper FROM (SELECT *, greatest(0.02 * value, CASE WHEN rmse > 0 THEN rmse ELSE 0.05 * abs(latest) END * sqrt(1 + 0.15 * (h - 1)) * 1.645) AS margin "
            f"FROM (SELECT *, {bound('level + slope * (SELECT sum(pow(0.92, i)) FROM range(1, 7) r(i) WHERE i <= o2.h)')} AS value FROM (SELECT *, CAST(unnest(range(1, 7)) AS INTEGER) AS h FROM o) o2))", "ent_network_weekly"))

for level in ("site", "district", "region"):
    _n = _holt(f"SELECT entity_id, period AS t, prb_avg AS v FROM ent_{level}_weekly", "entity_id")
    add(f"forecast_{level}_weekly", lambda s, v=level: P.entity_forecast(s, v), _recursive(*_n, "true", f"SELECT entity_id, {REPORT} FROM o", f"ent_{level}_weekly"))


def _daily(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    return P.daily_forecasts(days, "user_id", "date", "value")


QUERIES["forecast_daily_hw"] = _daily
_DAYS = "SELECT user_id, CAST(ts AS DATE) AS t, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY 1, 2"
_c = "(level + 0.92::DOUBLE * slope)"
_e = f"({_c} + season[dow + 1])"
_l = f"(0.35::DOUBLE * (p.v - season[dow + 1]) + 0.65::DOUBLE * {_c})"
_m = f"list_transform(season, lambda z, k: CASE WHEN k = dow + 1 THEN 0.25::DOUBLE * (p.v - {_l}) + 0.75::DOUBLE * z ELSE z END)"
ORACLE_SQL["forecast_daily_hw"] = O.half_up(f"""
WITH RECURSIVE d AS ({_DAYS}),
p AS (SELECT * FROM (SELECT user_id, t, v, dayofweek(t) AS dow, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE v IS NOT NULL) WHERE n >= 7),
fit AS (SELECT user_id, regr_slope(v, i) AS m, avg(v) - regr_slope(v, i) * (count(*) - 1) / 2 AS b FROM p GROUP BY 1),
raw AS (SELECT user_id, k, coalesce(avg(p.v - b - m * i), 0) AS r FROM (SELECT user_id, unnest(range(7)) AS k FROM fit) JOIN fit USING (user_id) LEFT JOIN p ON p.user_id = fit.user_id AND p.dow = k GROUP BY 1, 2),
prof AS (SELECT user_id, list(r - a ORDER BY k) AS season FROM (SELECT *, avg(r) OVER (PARTITION BY user_id) AS a FROM raw) GROUP BY 1),
h AS (
SELECT p.user_id, CAST(-1 AS BIGINT) AS i, (p.v - season[dow + 1])::DOUBLE AS level, m::DOUBLE AS slope, season::DOUBLE[] AS season, 0::DOUBLE AS abs, 0::DOUBLE AS sq, 0::BIGINT AS hits, p.v::DOUBLE AS was
FROM p JOIN fit USING (user_id) JOIN prof USING (user_id) WHERE i = 0
UNION ALL
SELECT h.user_id, p.i, {_l}, 0.15::DOUBLE * ({_l} - level) + 0.85::DOUBLE * 0.92::DOUBLE * slope, list_transform({_m}, lambda y: y - list_sum({_m}) / 7),
  abs + CASE WHEN p.i > 0 THEN abs(p.v - {_e}) ELSE 0 END, sq + CASE WHEN p.i > 0 THEN (p.v - {_e}) * (p.v - {_e}) ELSE 0 END, hits + CASE WHEN p.i > 0 AND ({_e} - was) * (p.v - was) > 0 THEN 1 ELSE 0 END, p.v
FROM h JOIN p ON p.user_id = h.user_id AND p.i = h.i + 1),
o AS ({_outlook('user_id', 'level + 0.92 * slope + season[dayofweek(last_period + 1) + 1]', "'seasonal-holt-winters'").replace('PCT', 'false')})
SELECT user_id, {REPORT} FROM o""")

TWO = ", ".join(f"max({m}) FILTER (WHERE rn = 1) AS c_{m}, max({m}) FILTER (WHERE rn = 2) AS p_{m}" for m in METRICS)
O.define("ev", ("cw",), f"SELECT cell_id, {TWO} FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY period DESC) AS rn FROM cw) WHERE rn <= 2 GROUP BY 1")
PAIR = "round({0} - {1}, 2) AS delta, round(({0} - {1}) / nullif(abs({1}), 0) * 100, 1) AS delta_pct"
add("evidence", V.evidence, O.sql(
    f"SELECT cell_id, metric, current, previous, {PAIR.format('current', 'previous')} FROM (" + " UNION ALL ".join(f"SELECT cell_id, '{m}' AS metric, c_{m} AS current, p_{m} AS previous FROM ev" for m in METRICS) + ")", "ev"))
add("nc_tail_streak", V.tail_streaks, O.sql(
    "SELECT cell_id, count(*) FILTER (WHERE is_nc AND good_after = 0) AS tail_weeks FROM (SELECT *, count(*) FILTER (WHERE NOT is_nc) OVER (PARTITION BY cell_id ORDER BY period DESC) AS good_after FROM cw) GROUP BY 1", "cw"))
O.define("lagged", ("life",), "SELECT *, " + ", ".join(f"lag({m}) OVER w AS was_{m}" for m in METRICS) + ", lag(is_nc) OVER w AS was_nc FROM life WINDOW w AS (PARTITION BY cell_id ORDER BY period)")
O.define("laglast", ("lagged",), "SELECT * FROM lagged WHERE period = (SELECT max(period) FROM lagged)")
CH = "(CASE WHEN was_{0} > 0 THEN ({0} - was_{0}) / was_{0} * 100 END)"
TESTS = {
    "prb_high": "prb_avg >= 80", "prb_rising": "prb_avg - was_prb_avg >= 3", "throughput_drop": CH.format("throughput_kbps") + " <= -10", "users_growth": CH.format("users") + " >= 10",
    "volume_growth": CH.format("volume_mb") + " >= 10", "availability_low": "availability_pct < 99.5", "persistent": "streak >= 2", "entered_nc": "streak = 1", "recovered": "was_nc AND NOT is_nc",
}
add("findings", V.findings, O.sql(" UNION ALL ".join(f"SELECT cell_id, '{k}' AS finding FROM laglast WHERE {t}" for k, t in TESTS.items()), "laglast"))
_pt = lambda terms: " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in terms) or "0"
LOW = "(volume_mb < 10 OR users < 2)"
DIAG = {
    "congestion": (35, [(30, "prb_avg >= 80"), (30, "congestion >= 2"), (15, "up >= 10"), (15, "vp >= 10"), (15, "streak >= 3")], [(25, "prb_avg < 65")]),
    "accessibility": (30, [(30, "call_setup < 98.5"), (25, "data_access < 98"), (30, "data_failure > 1"), (20, "congestion > 2")], [(20, "call_setup >= 98.5")]),
    "retainability": (30, [(35, "call_drop > 1.5"), (15, "availability_pct < 99")], [(20, "call_drop <= 1.5")]),
    "sleeping_cell": (20, [(50, f"availability_pct >= 99 AND {LOW} AND (was_volume_mb > 100 OR was_users > 20)")], [(20, f"{LOW} AND availability_pct < 99"), (40, f"NOT {LOW}")]),
    "transport": (30, [(25, "tp <= -15"), (20, "throughput_kbps < 2000"), (10, "availability_pct >= 99.5"), (25, "prb_avg < 40 AND throughput_kbps < 2000")], [(20, "availability_pct < 95")]),
    "interference": (30, [(30, "prb_avg < 60 AND throughput_kbps < 4000"), (25, "call_drop > 1.5 AND prb_avg < 80"), (10, "availability_pct < 99")], [(20, "prb_avg >= 80")]),
}
O.define("diag", ("laglast", "kw"), "SELECT *, " + ", ".join(f"{CH.format(m)} AS {n}" for m, n in (("users", "up"), ("volume_mb", "vp"), ("throughput_kbps", "tp"))) + """ FROM laglast
LEFT JOIN (SELECT period, cell_id, """ + ", ".join(f"max(avg) FILTER (WHERE kpi_key = '{k}') AS {k}" for k in O.KEYS) + """ FROM kw GROUP BY 1, 2) USING (period, cell_id)""")
# What the rules say they saw, for and against, in the order of DIAG's conditions.
SAID = {
    "congestion": (["load", "blocking", "users grow", "volume grows", "lasting"], ["load far below threshold"]), "accessibility": (["setup", "data access", "data failures", "signalling blocked"], ["setup healthy"]),
    "retainability": (["drops", "availability"], ["drops healthy"]), "sleeping_cell": (["available, yet idle"], ["unavailable", "carries traffic"]),
    "transport": (["speed fell", "slow", "available", "slow without load"], ["unavailable"]), "interference": (["slow at low load", "drops without load", "availability"], ["loaded"]),
}
ADVICE = {
    "congestion": "add capacity or move load", "accessibility": "check random access, signalling links and licences", "retainability": "check coverage edges, neighbours and hardware",
    "sleeping_cell": "reset the cell and check its radio chain", "transport": "check the backhaul''s rate and errors", "interference": "scan the uplink and check tilts",
}
_said = lambda terms, names: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for (_, c), n in zip(terms, names)) + ")"
add("diagnosis", V.diagnosis, O.sql(
    "SELECT cell_id, hypothesis, score, supporting, opposing, CASE WHEN score >= 45 THEN advice END AS advice, CASE WHEN score >= 65 THEN 'consistent' WHEN score >= 45 THEN 'suggests' ELSE 'weak' END AS verdict, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS confidence FROM ("
    + " UNION ALL ".join(f"SELECT cell_id, '{k}' AS hypothesis, CAST(least(95, greatest(5, {b} + {_pt(s)} - ({_pt(c)}))) AS BIGINT) AS score, {_said(s, SAID[k][0])} AS supporting, {_said(c, SAID[k][1])} AS opposing, '{ADVICE[k]}' AS advice FROM diag" for k, (b, s, c) in DIAG.items()) + ")", "diag"))
O.define("prio_all", ("life", "peers"), O.CTES["prio"][1].replace("FROM last JOIN", "FROM life JOIN"))
add("events_timeline", lambda s: V.events_timeline(s, s.cells.filter("cell_id % 10 = 3").select("cell_id", F.lit("2001-05-07").cast("date").alias("at"), F.lit("ops").alias("author"), F.concat(F.lit("checked "), "cell").alias("note"))), O.sql(
    "SELECT cell_id, period, 'lifecycle' AS kind, was || ' -> ' || lifecycle AS note FROM (SELECT *, lag(lifecycle) OVER (PARTITION BY cell_id ORDER BY period) AS was FROM life) WHERE was <> lifecycle "
    "UNION ALL SELECT cell_id, period, 'priority', CASE WHEN balanced > was THEN 'up' ELSE 'down' END FROM (SELECT *, lag(balanced) OVER (PARTITION BY cell_id ORDER BY period) AS was FROM prio_all) WHERE abs(balanced - was) >= 5 "
    "UNION ALL SELECT cell_id, DATE '2001-05-07', 'note', 'ops: checked ' || cell FROM cells WHERE cell_id % 10 = 3", "life", "prio_all", "cells"))
BA = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg(x) FILTER (WHERE NOT after), 4) AS before, round(avg(x) FILTER (WHERE after), 4) AS after FROM (SELECT period, after, {AGG[m]}({m}) AS x FROM cw JOIN sides USING (period) WHERE rn <= 8 GROUP BY 1, 2)" for m in METRICS)
O.define("sides", ("cw",), "SELECT period, period >= DATE '2000-06-05' AS after, row_number() OVER (PARTITION BY period >= DATE '2000-06-05' ORDER BY abs(period - DATE '2000-06-05')) AS rn FROM (SELECT DISTINCT period FROM cw)")
add("before_after", lambda s: V.before_after(s, "2000-06-05"), O.sql(f"SELECT metric, before, after, round((after - before) / nullif(abs(before), 0) * 100, 1) AS delta_pct FROM ({BA})", "cw", "sides"))


def interventions(star):
    """Every district on a date and at its middle, some cells, and the network."""
    day = lambda d: F.lit(d).cast("date").alias("at")
    districts = star.cells.select(F.lit("district").alias("scope"), F.col("district_id").alias("id")).distinct()
    cells = star.cells.filter("cell_id % 10 = 3").select(F.lit("cell").alias("scope"), F.col("cell_id").alias("id"))
    network = star.spark.range(1).select(F.lit("network").alias("scope"), "id")
    return districts.select("*", day("2000-06-05")).unionByName(districts.select("*", day(None))).unionByName(cells.select("*", day("1999-03-03"))).unionByName(network.select("*", day(None)))


O.define("entweeks", ("cw", "cells"), " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, {key} AS id, period, " + ", ".join(f"{AGG[m]}({m}) AS {m}" for m in METRICS) + " FROM cw JOIN cells USING (cell_id) GROUP BY 1, 2, 3" for scope, key in (("district", "district_id"), ("cell", "cell_id"), ("network", "0::BIGINT"))))
O.define("asked", ("entweeks", "cells"), """
SELECT scope, id, at_day FROM (SELECT DISTINCT 'district' AS scope, district_id AS id, DATE '2000-06-05' AS at_day FROM cells UNION ALL SELECT 'cell', cell_id, DATE '1999-03-03' FROM cells WHERE cell_id % 10 = 3)
UNION ALL SELECT scope, id, period FROM (SELECT scope, id, period, row_number() OVER (PARTITION BY scope, id ORDER BY period) AS i, count(*) OVER (PARTITION BY scope, id) AS n FROM entweeks WHERE scope <> 'cell') WHERE i = n // 2 + 1""")
O.define("sided", ("entweeks", "asked"), "SELECT a.at_day, e.*, e.period >= a.at_day AS after, row_number() OVER (PARTITION BY scope, id, a.at_day, e.period >= a.at_day ORDER BY abs(e.period - a.at_day)) AS rn FROM entweeks e JOIN asked a USING (scope, id)")
add("before_after_many", lambda s: V.interventions_before_after(s, interventions(s)).filter("before IS NOT NULL OR after IS NOT NULL"), O.sql(
    "SELECT scope, id, at_day AS \"at\", metric, before, after, round((after - before) / nullif(abs(before), 0) * 100, 1) AS delta_pct FROM (" + " UNION ALL ".join(
        f"SELECT scope, id, at_day, '{m}' AS metric, round(avg({m}) FILTER (WHERE NOT after), 4) AS before, round(avg({m}) FILTER (WHERE after), 4) AS after FROM sided WHERE rn <= 8 GROUP BY 1, 2, 3" for m in METRICS) + ") WHERE before IS NOT NULL OR after IS NOT NULL", "sided"))
OWN_RULE = [
    ("growth", "base", 0, "", 40, 0, None, "always", ">=", 0.0), ("growth", "support", 1, "both grow", 30, 0, None, "volume_pct", ">=", 20.0), ("growth", "support", 1, "both grow", 30, 1, None, "users_pct", ">=", 20.0),
    ("growth", "contra", 2, "3G or 4G is well", 15, 0, "3G", "data_access", ">=", 98.0), ("growth", "contra", 2, "3G or 4G is well", 15, 0, "4G", "call_drop", "<", 1.0), ("growth", "support", 3, "of another technology", 50, 0, "2G", "data_access", ">=", 0.0),
]
add("diagnosis_own_rule", lambda s: V.diagnosis(s, s.spark.createDataFrame(OWN_RULE, V.RULE_ROW), {"growth": "plan ahead"}).select("cell_id", "hypothesis", "score", "supporting", "opposing", "advice"), O.sql(
    "SELECT cell_id, 'growth' AS hypothesis, score, CASE WHEN g THEN 'both grow' ELSE '' END AS supporting, CASE WHEN w THEN '3G or 4G is well' ELSE '' END AS opposing, CASE WHEN score >= 45 THEN 'plan ahead' END AS advice FROM ("
    "SELECT *, CAST(40 + CASE WHEN g THEN 30 ELSE 0 END - CASE WHEN w THEN 15 ELSE 0 END AS BIGINT) AS score FROM (SELECT cell_id, coalesce(vp >= 20 AND up >= 20, false) AS g, coalesce(data_access >= 98, false) OR coalesce(call_drop < 1, false) AS w FROM diag))", "diag"))
add("peers", lambda s: V.peers(s, 7), O.sql(
    "SELECT l.cell_id, l.prb_avg, l.throughput_kbps, l.is_nc, c.cell, h.score AS health_score FROM last l JOIN cells c USING (cell_id) LEFT JOIN hcell h ON h.cell_id = l.cell_id AND h.period = l.period "
    "WHERE c.district_id = (SELECT district_id FROM cells WHERE cell_id = 7) AND l.cell_id <> 7 ORDER BY h.score NULLS LAST, l.cell_id LIMIT 10", "last", "cells", "hcell"))
add("cell_history_stats", V.history_stats, O.sql(
    "SELECT *, CASE WHEN breach_rate >= 50 THEN 'overloaded' WHEN breach_rate >= 20 THEN 'often loaded' WHEN prb_max >= 80 THEN 'peaks' ELSE 'calm' END AS insight FROM (SELECT cell_id, count(*) AS days, count(*) FILTER (WHERE prb_breach) AS breach_days, "
    "round(100.0 * count(*) FILTER (WHERE prb_breach) / count(*), 1) AS breach_rate, round(avg(prb), 4) AS prb_avg, round(max(prb), 4) AS prb_max, round(avg(prb) - 80, 4) AS to_threshold FROM flagged GROUP BY 1)", "flagged"))
add("peak_day_of_week", V.peak_weekday, O.sql(
    "SELECT cell_id, CAST(days AS BIGINT) AS days, CAST(dow AS INTEGER) AS peak_dow, prb AS peak_prb FROM (SELECT *, sum(n) OVER (PARTITION BY cell_id) AS days, row_number() OVER (PARTITION BY cell_id ORDER BY prb DESC, dow) AS rn "
    "FROM (SELECT cell_id, dayofweek(date) AS dow, round(avg(prb), 4) AS prb, count(*) AS n FROM facts GROUP BY 1, 2)) WHERE rn = 1 AND days >= 7", "facts"))
for name, sc in (("what_if_simulation", V.Scenario()), ("what_if_full_upgrade", V.Scenario(10, 20, True, True, 15))):
    g, k = f"{sc.gain!r}::DOUBLE", f"{(100 - sc.offload_pct) / 100!r}::DOUBLE"
    add(name, lambda s, c=sc: V.what_if(s, c), O.sql(
        f"SELECT *, round(prb - sim_prb, 1) AS reduction, sim_prb < 80 AS resolved FROM (SELECT cell_id, period, coalesce(prb_avg, 0) AS prb, {O.r1(f'coalesce(prb_avg, 0) * {k} / {g}')}::DOUBLE AS sim_prb, "
        f"round(throughput_kbps / 1000 * {g}, 1) AS sim_throughput_mbps, round(volume_mb / 1024 * {g}, 1) AS sim_volume_gb FROM cw)", "cw"))


def _cut(star):
    """The star as it was at the end of 2000."""
    return star.where(F.col("date") < F.lit("2001-01-01").cast("date"))


def _figures(cut: str) -> str:
    """The twin of snapshot_figures; ``cut`` limits facts and weeks alike."""
    last = f"(SELECT max(period) FROM cw WHERE period < {cut})"
    rows = f"(SELECT * FROM cw WHERE period = {last})"
    parts = [f"SELECT 'rows' AS key, count(*)::DOUBLE AS v FROM facts WHERE date < {cut}", f"SELECT 'cells', count(*)::DOUBLE FROM {rows}", f"SELECT 'nc_cells', count(*) FILTER (WHERE is_nc)::DOUBLE FROM {rows}"]
    parts += [f"SELECT '{m}', round({AGG[m]}({m}), 4) FROM {rows}" for m in METRICS]
    return " UNION ALL ".join(parts + [f"SELECT 'health_score', round(avg(score), 1) FROM hcell WHERE period = {last}", "SELECT 'ruleset_version', 1.0::DOUBLE"])


# 2000-12-31 is a Sunday: the cut ends a whole week.
add("snapshot_compare", lambda s: V.snapshot_compare(_cut(s), s), O.sql(
    f"SELECT key, a.v AS a, b.v AS b, {PAIR.format('b.v', 'a.v')}, key IN ('nc_cells', 'prb_avg') AS worse_is_higher FROM ({_figures('DATE ' + chr(39) + '2001-01-01' + chr(39))}) a JOIN ({_figures('DATE ' + chr(39) + '9999-01-01' + chr(39))}) b USING (key)", "cw", "facts", "hcell"))
add("investigation_region", lambda s: V.investigation_scope(s, "region", 2), O.sql(
    "SELECT period, count(*) AS cells, count(*) FILTER (WHERE is_nc) AS nc_cells, " + ", ".join(f"round({a}({m}), 4) AS {m}" for m, a in AGG.items()) + " FROM cw JOIN cells USING (cell_id) WHERE region_id = 2 GROUP BY 1", "cw", "cells"))

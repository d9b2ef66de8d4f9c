"""SQL twins: shared table expressions, and a builder that lists those needed."""

from __future__ import annotations

T = 80.0

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql)


def sql(body: str, *needs: str) -> str:
    """``body`` behind the table expressions that it needs, each once."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    return half_up("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body)


def half_up(text: str) -> str:
    """Every round(x, n) spelt out as the library rounds."""
    out, at = "", 0
    while (i := text.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            if depth == 1 and text[j] == ",":
                comma = j
            j += 1
        scale = f"{10 ** int(text[comma + 1 : j - 1])}.0::DOUBLE"
        out += text[at:i] + f"(floor(({half_up(text[i + 6 : comma])}) * {scale} + 0.500001::DOUBLE) / {scale})"
        at = j
    return out + text[at:]


def clamp(x: str, low: float = 0, high: float = 100) -> str:
    return f"least({high}.0, greatest({low}.0, {x}))"


def r1(x: str) -> str:
    return f"round({clamp(x)}, 1)"


def start(x: str, grain: str) -> str:
    return x if grain == "daily" else f"CAST(date_trunc('{'week' if grain == 'weekly' else 'month'}', {x}) AS DATE)"


MEASURES = (
    "round(avg(prb), 4) AS prb_avg, round(max(prb), 4) AS prb_max, round(sum(volume_mb), 4) AS volume_mb, round(sum(users), 4) AS users, "
    "round(avg(throughput_kbps), 4) AS throughput_kbps, round(avg(availability_pct), 4) AS availability_pct"
)
NC_COUNTS = (
    "count(DISTINCT cell_id) AS cells, count(DISTINCT CASE WHEN is_nc THEN cell_id END) AS nc_cells, "
    "round(100.0 * count(DISTINCT CASE WHEN is_nc THEN cell_id END) / nullif(count(DISTINCT cell_id), 0), 1) AS nc_rate"
)

define("cells", (), """
SELECT s_suppkey AS cell_id, s_name AS cell, CAST(n_nationkey * 4 + s_suppkey % 4 AS BIGINT) AS site_id, n_name || '-' || CAST(s_suppkey % 4 AS VARCHAR) AS site,
  CAST(n_nationkey AS BIGINT) AS district_id, n_name AS district, CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
define("wide", (), f"""
SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS date, {MONEY.format('l_quantity')} / count(*) * 2 AS prb, {MONEY.format('l_extendedprice')} / 1000 AS volume_mb,
  {MONEY.format('l_quantity')} AS users, {MONEY.format('l_extendedprice')} / count(*) / 2 AS throughput_kbps, 100 - {MONEY.format('l_tax')} / count(*) * 25 AS availability_pct,
  {MONEY.format('l_discount')} / count(*) * 20 AS call_drop, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 5 AS congestion,
  100 - count(*) FILTER (WHERE l_linestatus = 'F') / count(*) * 4 AS call_setup, {MONEY.format('l_tax')} / count(*) * 30 AS data_failure,
  100 - {MONEY.format('l_discount')} / count(*) * 40 AS data_access, {MONEY.format('l_extendedprice')} / 500 AS payload
FROM lineitem GROUP BY ALL""")
define("facts", ("wide",), "SELECT cell_id, date, prb, volume_mb, users, throughput_kbps, availability_pct FROM wide")
KEYS = ("call_drop", "congestion", "call_setup", "data_failure", "data_access", "payload")
define("extras", ("wide",), " UNION ALL ".join(f"SELECT cell_id, date, '{'3G' if k in ('data_access', 'payload') else '4G'}' AS technology, '{k}' AS kpi_key, {k} AS value FROM wide" for k in KEYS))
define("kpis", (), """
SELECT * FROM (VALUES ('4G', 'call_drop', 'Call drop rate', '%', true, 'Retainability', 1.5::DOUBLE, 1.0::DOUBLE, 1.9::DOUBLE, 'avg', true, true),
  ('4G', 'congestion', 'Congestion', '%', true, 'Congestion', 2.0, 1.5, 4.0, 'avg', false, false), ('4G', 'call_setup', 'Call setup success', '%', false, 'Accessibility', 98.5, 99.0, 95.0, 'avg', false, false),
  ('4G', 'data_failure', 'Data failure', '%', true, 'Accessibility', 1.0, 0.8, 2.0, 'max', false, false), ('3G', 'data_access', 'Data access success', '%', false, 'Accessibility', 98.0, 98.5, 95.0, 'min', false, false),
  ('3G', 'payload', 'Payload', 'MB', false, 'Integrity', NULL, NULL, NULL, 'sum', false, false))
  AS t(technology, kpi_key, label, unit, worse_is_higher, category, target, warning, critical, agg, is_core, persistent)""")
define("flagged", ("wide",), f"SELECT *, prb >= {T} AS prb_breach, (prb >= {T} OR call_drop > 1.5) AS is_breach FROM wide")
define("cw", ("flagged",), f"""
SELECT {start('date', 'weekly')} AS period, cell_id, count(*) AS observed_days, count(*) FILTER (WHERE is_breach) AS breach_days, {MEASURES},
  count(*) FILTER (WHERE is_breach) >= 1 AS is_nc FROM flagged GROUP BY 1, 2""")
define("ncm", ("cw",), f"SELECT {start('period', 'monthly')} AS period, cell_id, bool_or(is_nc) AS is_nc FROM cw GROUP BY 1, 2")
define("cm", ("flagged", "ncm"), f"""
SELECT a.*, coalesce(b.is_nc, false) AS is_nc FROM (SELECT {start('date', 'monthly')} AS period, cell_id, count(DISTINCT date) AS observed_days,
  count(*) FILTER (WHERE prb_breach) AS breach_days, {MEASURES} FROM flagged GROUP BY 1, 2) a LEFT JOIN ncm b USING (period, cell_id)""")
define("cd", ("flagged",), """
SELECT date AS period, cell_id, CAST(1 AS BIGINT) AS observed_days, CAST(is_breach AS BIGINT) AS breach_days, round(prb, 4) AS prb_avg, round(prb, 4) AS prb_max,
  round(volume_mb, 4) AS volume_mb, round(users, 4) AS users, round(throughput_kbps, 4) AS throughput_kbps, round(availability_pct, 4) AS availability_pct, is_breach AS is_nc
FROM flagged""")
PERIOD = {"daily": "cd", "weekly": "cw", "monthly": "cm"}
FLAGS = {"daily": "cd", "weekly": "cw", "monthly": "ncm"}
LIMITS = {"daily": (49, 21), "weekly": (7, 3), "monthly": (2, 2)}


def _placed(grain: str) -> str:
    return f"""
SELECT f.*, c.* EXCLUDE (cell_id), coalesce(n.is_nc, false) AS is_nc FROM (SELECT *, {start('date', grain)} AS period FROM facts) f
JOIN cells c USING (cell_id) LEFT JOIN {FLAGS[grain]} n USING (period, cell_id)"""


def _lifecycle(grain: str, opening: bool) -> str:
    chronic, persistent = LIMITS[grain]
    signal = lambda x, t, more_is_worse: (
        f"(CASE WHEN {x} <= -{t} THEN 1 ELSE 0 END - CASE WHEN {x} >= {t} THEN 1 ELSE 0 END)" if more_is_worse
        else f"(CASE WHEN {x} >= {t} THEN 1 ELSE 0 END - CASE WHEN {x} <= -{t} THEN 1 ELSE 0 END)"
    )
    change = lambda x: f"(CASE WHEN was_{x} > 0 THEN ({x} - was_{x}) / was_{x} * 100 END)"
    net = " + ".join([
        signal("coalesce(prb_avg - was_prb, 0)", 3, True), signal("(breach_days - was_breach)", 1, True),
        signal(change("throughput_kbps"), 10, False), signal(change("vd"), 10, True), signal(change("ud"), 10, True),
    ])
    return f"""
SELECT period, cell_id, is_nc, streak, lifecycle, trend,
  CASE WHEN score = 0 THEN 'Normal' WHEN score >= 75 THEN 'Critical' WHEN score >= 45 THEN 'High' ELSE 'Watch' END AS severity, score AS severity_score,
  observed_days, breach_days, prb_avg, throughput_kbps, users, volume_mb, availability_pct
FROM (SELECT *, CAST(CASE WHEN NOT is_nc THEN 0 ELSE least(100,
    CASE lifecycle WHEN 'Recurring' THEN 60 WHEN 'Persistent' THEN 80 WHEN 'Chronic' THEN 90 ELSE 40 END
    + CASE WHEN e >= 20 THEN 25 WHEN e >= 10 THEN 15 WHEN e >= 5 THEN 10 WHEN e >= 0 THEN 5 ELSE 0 END + least(15, 2 * breach_days)
    + CASE WHEN trend = 'Worsening' THEN 10 ELSE 0 END + CASE WHEN availability_pct < 99 THEN 5 ELSE 0 END) END AS BIGINT) AS score
  FROM (SELECT *, prb_avg - {T} AS e,
      CASE WHEN nth = 1 THEN 'Stable' WHEN {net} >= 2 THEN 'Improving' WHEN {net} <= -2 THEN 'Worsening' ELSE 'Stable' END AS trend,
      CASE WHEN NOT is_nc THEN CASE WHEN coalesce(was_nc, false) THEN 'Recovering' ELSE 'Healthy' END
        WHEN streak >= {chronic} THEN 'Chronic' WHEN streak >= {persistent} THEN 'Persistent' WHEN streak = 1 THEN 'New' ELSE 'Recurring' END AS lifecycle
    FROM (SELECT *, CAST(CASE WHEN is_nc THEN row_number() OVER (PARTITION BY cell_id, island ORDER BY period){'' if opening else ' - CASE WHEN island > 0 THEN 1 ELSE 0 END'} ELSE 0 END AS BIGINT) AS streak
      FROM (SELECT *, lag(is_nc) OVER w AS was_nc, lag(prb_avg) OVER w AS was_prb, lag(breach_days) OVER w AS was_breach, lag(throughput_kbps) OVER w AS was_throughput_kbps,
          lag(vd) OVER w AS was_vd, lag(ud) OVER w AS was_ud, row_number() OVER w AS nth,
          sum(CASE WHEN is_nc THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, volume_mb / observed_days AS vd, users / observed_days AS ud FROM {PERIOD[grain]})
        WINDOW w AS (PARTITION BY cell_id ORDER BY period)))))"""


for _g in PERIOD:
    define(f"placed_{_g}", ("facts", "cells", FLAGS[_g]), _placed(_g))
    define(f"life_{_g}", (PERIOD[_g],), _lifecycle(_g, False))
    define(f"ent_network_{_g}", (f"placed_{_g}",), f"SELECT period, CAST(0 AS BIGINT) AS entity_id, {NC_COUNTS}, {MEASURES} FROM placed_{_g} GROUP BY 1")
    for _level in ("site", "district", "region"):
        define(f"ent_{_level}_{_g}", (f"placed_{_g}",), f"SELECT period, {_level}_id AS entity_id, {NC_COUNTS}, {MEASURES} FROM placed_{_g} GROUP BY 1, 2")
define("life_opening", ("cw",), _lifecycle("weekly", True))
define("life", ("life_weekly",), "SELECT * FROM life_weekly")
define("last", ("life",), "SELECT * FROM life WHERE period = (SELECT max(period) FROM life)")

WEIGHTS = {
    "balanced": (25, 20, 15, 15, 15, 10), "customer": (10, 15, 30, 25, 20, 0), "congestion": (45, 15, 5, 10, 15, 10),
    "persistence": (15, 45, 10, 10, 10, 10), "deterioration": (20, 15, 10, 10, 15, 30),
}
BAND = "CASE WHEN {0} >= 90 THEN 'Critical' WHEN {0} >= 75 THEN 'High' WHEN {0} >= 50 THEN 'Medium' WHEN {0} >= 25 THEN 'Watch' ELSE 'Low' END"
_above = lambda c: f"CASE WHEN peer_{c} > 0 THEN {r1(f'100 * ({c} - peer_{c}) / peer_{c}')} ELSE 0.0 END"
_score = lambda m: "round((" + " + ".join(
    f"{float(w)} * {c}" for w, c in zip(WEIGHTS[m], ("prb_severity", "persistence_score", "user_impact", "traffic_impact", "throughput_deficit", "trend_score"))
) + f") / 100, 1) AS {m}"
define("peers", ("life",), "SELECT period, round(avg(users), 4) AS peer_users, round(avg(volume_mb), 4) AS peer_volume_mb, round(avg(throughput_kbps), 4) AS peer_throughput_kbps FROM life GROUP BY 1")
define("prio", ("last", "peers"), f"""
SELECT *, {', '.join(map(_score, WEIGHTS))} FROM (SELECT period, cell_id, lifecycle, severity, {r1(f'100 * (prb_avg - {T}) / 40')}::DOUBLE AS prb_severity,
  CASE lifecycle WHEN 'Chronic' THEN 100.0 WHEN 'Persistent' THEN 90.0 WHEN 'Recurring' THEN 70.0 WHEN 'New' THEN 35.0 ELSE 0.0 END::DOUBLE AS persistence_score,
  ({_above('users')})::DOUBLE AS user_impact, ({_above('volume_mb')})::DOUBLE AS traffic_impact,
  (CASE WHEN peer_throughput_kbps > 0 THEN {r1('100 * (peer_throughput_kbps - throughput_kbps) / peer_throughput_kbps')} ELSE 0.0 END)::DOUBLE AS throughput_deficit,
  CASE trend WHEN 'Worsening' THEN 100.0 WHEN 'Improving' THEN 0.0 ELSE 50.0 END::DOUBLE AS trend_score
  FROM last JOIN peers USING (period))""")
_capacity = r1(f"100 - 100 * (coalesce(prb_avg, {T}) - {T}) / 40")
define("hcell", ("life", "peers"), f"""
SELECT *, round(0.25 * capacity + 0.2 * throughput + 0.2 * availability + 0.25 * nc_health + 0.1 * growth, 1) AS score
FROM (SELECT period, period + 6 AS as_of, cell_id, ({_capacity})::DOUBLE AS capacity,
  (CASE WHEN peer_throughput_kbps > 0 THEN {r1('100 * throughput_kbps / peer_throughput_kbps')} ELSE 100.0 END)::DOUBLE AS throughput,
  ({r1('coalesce(availability_pct, 100)')})::DOUBLE AS availability,
  CASE lifecycle WHEN 'Recovering' THEN 90.0 WHEN 'New' THEN 60.0 WHEN 'Recurring' THEN 50.0 WHEN 'Persistent' THEN 40.0 WHEN 'Chronic' THEN 30.0 ELSE 100.0 END::DOUBLE AS nc_health,
  (CASE WHEN was > 0 THEN {r1(f"100 - {clamp('(volume_mb - was) / was * 100')} / 0.3")} ELSE 100.0 END)::DOUBLE AS growth
  FROM (SELECT *, lag(volume_mb) OVER (PARTITION BY cell_id ORDER BY period) AS was FROM life) JOIN peers USING (period))""")


HEALTH_NETWORK = f"""
SELECT *, round(0.25 * capacity + 0.2 * throughput + 0.2 * availability + 0.2 * nc_recurrence + 0.15 * growth, 1) AS score
FROM (SELECT period, ({_capacity})::DOUBLE AS capacity, ({r1('100 * coalesce(throughput_kbps, 0) / 25000')})::DOUBLE AS throughput,
  ({r1('coalesce(availability_pct, 100)')})::DOUBLE AS availability, ({r1('100 - 3 * coalesce(nc_rate, 0)')})::DOUBLE AS nc_recurrence,
  ({r1(f"100 - 2 * {clamp('coalesce(CASE WHEN was > 0 THEN (volume_mb - was) / was * 100 END, 0)')}")})::DOUBLE AS growth
  FROM (SELECT *, lag(volume_mb) OVER (ORDER BY period) AS was FROM {{}}))"""


def health_network(grain: str) -> str:
    return sql(HEALTH_NETWORK.format(f"ent_network_{grain}"), f"ent_network_{grain}")

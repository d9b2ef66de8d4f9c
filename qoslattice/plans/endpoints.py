"""Queries over the read endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..sources.star import KPIS, from_orders
from . import oracle as O

QUERIES, ORACLE_SQL = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = lambda spark, d, q=query: q(from_orders(spark, d))
    if sql:
        ORACLE_SQL[name] = sql


def spread(rows, parts={"": ""}):
    """The adapter's KPIs out of the map ``kpis`` into columns, whose keys are unique there."""
    entry = lambda t, k, field: F.col("kpis")[f"{t}:{k}"][field[1:]] if field else F.col("kpis")[f"{t}:{k}"]
    return rows.select("*", *[entry(t, k, field).alias(k + end) for t, k, *_ in KPIS for end, field in parts.items()]).drop("kpis")


O.define("kw", ("extras",), f"""
SELECT {O.start('date', 'weekly')} AS period, cell_id, technology, kpi_key, round(avg(value), 4) AS avg, round(sum(value), 4) AS sum, round(max(value), 4) AS max, round(min(value), 4) AS min
FROM extras GROUP BY 1, 2, 3, 4""")
O.define("kv", ("kw", "kpis"), f"""
SELECT *, coalesce(CASE WHEN worse_is_higher THEN value > target ELSE value < target END, false) AS breached,
  CASE WHEN target <> 0 THEN {O.clamp('CASE WHEN worse_is_higher THEN value - target ELSE target - value END / target * 100')} END AS severity
FROM (SELECT *, CASE agg WHEN 'sum' THEN sum WHEN 'max' THEN max WHEN 'min' THEN min ELSE avg END AS value FROM kw JOIN kpis USING (technology, kpi_key))""")
O.define("klast", ("kv",), "SELECT * FROM kv WHERE period = (SELECT max(period) FROM kv)")
O.define("cwlast", ("cw",), "SELECT * FROM cw WHERE period = (SELECT max(period) FROM cw)")
O.define("backs", ("cw",), "SELECT period, row_number() OVER (ORDER BY period DESC) - 1 AS back FROM (SELECT DISTINCT period FROM cw)")
O.define("mv", ("cwlast", "klast"), "SELECT cell_id, metric, value FROM (UNPIVOT (SELECT cell_id, prb_avg, throughput_kbps, users, volume_mb, availability_pct FROM cwlast) ON prb_avg, throughput_kbps, users, volume_mb, availability_pct INTO NAME metric VALUE value) UNION ALL SELECT cell_id, kpi_key, value FROM klast")
add("kpi_overview", V.kpi_overview, O.sql(
    "SELECT technology, kpi_key, label, unit, target, worse_is_higher, count(DISTINCT CASE WHEN breached THEN cell_id END) AS breached_cells, count(DISTINCT cell_id) AS observed_cells, "
    "round(avg(CASE WHEN breached THEN severity END), 1) AS avg_severity FROM klast GROUP BY 1, 2, 3, 4, 5, 6", "klast"))
BREACHES = "SELECT cell_id, round(avg(severity), 1) AS breach_score, count(*) AS breached_kpis FROM klast WHERE breached GROUP BY 1"
add("kpi_breach_by_cell", V.kpi_breach_by_cell, O.sql(BREACHES, "klast"))
add("kpi_worst_cells", V.kpi_worst_cells, O.sql(f"SELECT b.*, cell, site, district FROM ({BREACHES}) b JOIN cells USING (cell_id) ORDER BY breach_score DESC, cell_id LIMIT 8", "klast", "cells"))
add("kpi_trend_12w", V.kpi_trend, O.sql(
    "SELECT technology, kpi_key, period, value, coalesce(CASE WHEN worse_is_higher THEN value > target ELSE value < target END, false) AS breached FROM (SELECT technology, kpi_key, period, target, worse_is_higher, round(avg(value), 4) AS value "
    "FROM kv WHERE period IN (SELECT period FROM backs WHERE back < 12) GROUP BY 1, 2, 3, 4, 5)", "kv", "backs"))
add("perf_percentiles", lambda s: V.distributions(s).drop("technology"), O.sql(
    "SELECT metric, i / 20 AS q, round(v[i + 1], 4) AS value FROM (SELECT metric, v, unnest(range(21)) AS i FROM (SELECT metric, quantile_cont(value, ["
    + ", ".join(str(i / 20) for i in range(21)) + "]) AS v FROM mv GROUP BY 1))", "mv"))
add("perf_summary", lambda s: V.distribution_summary(s).drop("technology"), O.sql(
    "SELECT metric, count(value) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM mv GROUP BY 1", "mv"))
add("perf_median", V.throughput_median, O.sql("SELECT count(*) AS cells, round(median(throughput_kbps), 4) AS throughput_median_kbps FROM cwlast", "cwlast"))
add("perf_scatter_quadrants", V.scatter, O.sql(
    f"SELECT cell_id, prb_avg, throughput_kbps, users, is_nc, CASE WHEN prb_avg >= {O.T} AND throughput_kbps < m THEN 'congested' WHEN prb_avg >= {O.T} THEN 'busy' WHEN throughput_kbps < m THEN 'quiet' ELSE 'healthy' END AS quadrant "
    "FROM cwlast, (SELECT median(throughput_kbps) AS m FROM cwlast)", "cwlast"))
add("perf_correlations", lambda s: V.correlations(s).drop("a_technology", "b_technology"), O.sql(
    "SELECT x.metric AS a, y.metric AS b, round(corr(x.value, y.value), 4) AS pearson, count(*) AS n FROM mv x JOIN mv y ON x.cell_id = y.cell_id AND x.metric < y.metric GROUP BY 1, 2", "mv"))
add("dual_breach_quadrants", V.dual_breach_quadrants, O.sql(
    "SELECT CASE WHEN x AND y THEN 'critical' WHEN x THEN 'x_impaired' WHEN y THEN 'y_impaired' ELSE 'optimal' END AS quadrant, count(*) AS cells FROM "
    "(SELECT a.breached AS x, b.breached AS y FROM klast a JOIN klast b USING (cell_id) WHERE a.kpi_key = 'call_drop' AND b.kpi_key = 'congestion') GROUP BY 1", "klast"))
add("dual_breach_upper_median", lambda s: V.dual_breach_quadrants(s, "call_drop", "payload"), O.sql(
    "SELECT CASE WHEN x AND y THEN 'critical' WHEN x THEN 'x_impaired' WHEN y THEN 'y_impaired' ELSE 'optimal' END AS quadrant, count(*) AS cells FROM "
    "(SELECT a.breached AS x, b.value < m AS y FROM klast a JOIN klast b USING (cell_id), (SELECT value AS m FROM (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM klast WHERE kpi_key = 'payload') WHERE i = n // 2 + 1) "
    "WHERE a.kpi_key = 'call_drop' AND b.kpi_key = 'payload') GROUP BY 1", "klast"))
AGG = {m: ("avg" if m in V.AVERAGED else "sum") for m in V.METRICS}


def _compare(scope: str) -> str:
    side = lambda back, tag: ", ".join(f"round({AGG[m]}(CASE WHEN back = {back} THEN {m} END), 4) AS {tag}_{m}" for m in V.METRICS)
    O.define(f"cmp_{scope}", ("cw", "backs", "cells"), f"""
SELECT {scope}_id AS id, {scope} AS name, {side(0, 'c')}, {side(1, 'p')}, count(*) FILTER (WHERE back = 0 AND is_nc) AS nc_cells, count(*) FILTER (WHERE back = 1 AND is_nc) AS was_nc, count(*) FILTER (WHERE back = 0) AS cells
FROM cw JOIN backs USING (period) JOIN cells USING (cell_id) WHERE back < 2 GROUP BY 1, 2""")
    each = " UNION ALL ".join(f"SELECT id, name, '{m}' AS metric, c_{m} AS current, p_{m} AS previous, nc_cells, was_nc, cells FROM cmp_{scope}" for m in V.METRICS)
    O.define(f"cmpl_{scope}", (f"cmp_{scope}",), f"""
SELECT id, name, metric, current, previous, round(current - previous, 2) AS delta, round((current - previous) / nullif(abs(previous), 0) * 100, 1) AS delta_pct, nc_cells, cells,
  CASE WHEN nc_cells > 0 AND was_nc > 0 THEN 'nc' WHEN nc_cells > 0 THEN 'new' WHEN was_nc > 0 THEN 'recovered' ELSE 'ok' END AS transition FROM ({each})""")
    return O.sql(f"SELECT * FROM cmpl_{scope}", f"cmpl_{scope}")


for scope in ("cell", "site", "district", "region"):
    add(f"compare_period_{scope}", lambda s, v=scope: V.compare_periods(s, v), _compare(scope))
add("compare_rank", V.rank_changes, O.sql(
    "SELECT id, name, current, previous, delta, row_number() OVER (ORDER BY delta DESC NULLS LAST, id) AS place FROM cmpl_district WHERE metric = 'prb_avg'", "cmpl_district"))
REG = " UNION ALL ".join(f"SELECT region_id AS id, region AS name, '{m}' AS metric, round({a}({m}), 4) AS value FROM cwlast JOIN cells USING (cell_id) GROUP BY 1, 2" for m, a in AGG.items())
NET = " UNION ALL ".join(f"SELECT '{m}' AS metric, round({a}({m}), 4) AS baseline FROM cwlast JOIN cells USING (cell_id)" for m, a in AGG.items())
add("compare_region_baseline", V.compare_regions, O.sql(
    "SELECT id, name, metric, value, baseline, round(value - baseline, 2) AS delta, round((value - baseline) / nullif(abs(baseline), 0) * 100, 1) AS delta_pct, "
    f"value = max(value) OVER (PARTITION BY metric) AS is_max, value = min(value) OVER (PARTITION BY metric) AS is_min FROM ({REG}) JOIN ({NET}) USING (metric)", "cwlast", "cells"))
IDX = " UNION ALL ".join(f"SELECT period, '{m}' AS metric, round({a}({m}), 4) AS value FROM cw WHERE period IN (SELECT DISTINCT period FROM cw ORDER BY period DESC LIMIT 12) GROUP BY 1" for m, a in AGG.items())
add("compare_index100", V.index_100, O.sql(
    f"SELECT period, metric, value, round(value / nullif(first(value) OVER (PARTITION BY metric ORDER BY period), 0) * 100, 1) AS index FROM ({IDX})", "cw", "backs"))
O.define("state", ("last", "cells", "prio", "hcell"), f"""
SELECT l.* EXCLUDE (observed_days, streak, severity_score), c.* EXCLUDE (cell_id), p.balanced AS priority_score, h.score AS health_score, {O.BAND.format('p.balanced')} AS priority_band
FROM last l JOIN cells c USING (cell_id) LEFT JOIN prio p USING (cell_id) LEFT JOIN hcell h ON h.cell_id = l.cell_id AND h.period = l.period""")
ROLL = (
    "count(DISTINCT cell_id) AS cells, count(*) FILTER (WHERE is_nc) AS nc_cells, round(avg(health_score), 1) AS health_score, round(avg(prb_avg), 4) AS prb_avg, "
    "round(avg(throughput_kbps), 4) AS throughput_kbps, round(sum(users), 4) AS users, round(sum(volume_mb), 4) AS volume_mb, round(avg(availability_pct), 4) AS availability_pct"
)
for level in ("region", "district", "site"):
    O.define(f"exp_{level}", ("state",), f"SELECT {level}_id AS id, {level} AS name, {ROLL}, max(priority_score) AS priority_score, {O.BAND.format('max(priority_score)')} AS priority_band FROM state GROUP BY 1, 2")
    add(f"explorer_{level}", lambda s, v=level: V.explorer(s, v), O.sql(f"SELECT * FROM exp_{level}", f"exp_{level}"))
add("explorer_cell", lambda s: V.explorer(s, "cell", q="00"), O.sql(f"SELECT cell_id AS id, cell AS name, {', '.join(V.CELL_COLUMNS)} FROM state WHERE contains(lower(cell), '00')", "state"))
add("explorer_children", lambda s: V.explorer(s, "district", parent_id=1), O.sql(
    f"SELECT district_id AS id, district AS name, {ROLL}, max(priority_score) AS priority_score, {O.BAND.format('max(priority_score)')} AS priority_band FROM state WHERE region_id = 1 GROUP BY 1, 2", "state"))
for level, of in (("region", None), ("district", 1)):
    K = ", ".join(f"round(avg(value) FILTER (WHERE kpi_key = '{k}'), 4) AS {k}_avg, count(*) FILTER (WHERE kpi_key = '{k}' AND breached) AS {k}_nc" for k in O.KEYS)
    add(f"{level}_map", lambda s, v=level, r=of: spread(V.place_map(s, v, r), {"_avg": ".avg", "_nc": ".nc"}), O.sql(
        f"SELECT a.*, b.* EXCLUDE (kid) FROM (SELECT {level}_id AS id, {level} AS name, {ROLL} FROM state {'WHERE region_id = 1' if of else ''} GROUP BY 1, 2) a "
        f"LEFT JOIN (SELECT {level}_id AS kid, {K} FROM klast JOIN cells USING (cell_id) GROUP BY 1) b ON id = kid", "state", "klast", "cells"))
add("breadcrumbs", V.breadcrumbs, O.sql("SELECT cell_id, concat_ws(' > ', 'Network', region, district, site, cell) AS path FROM cells", "cells"))
PAGE = "cell_id, cell, site, district, region, is_nc, lifecycle, trend, severity, prb_avg, breach_days, throughput_kbps, users, volume_mb, availability_pct, priority_score, priority_band"
KPI_PAGE = "LEFT JOIN (SELECT cell_id, " + ", ".join(f"max(value) FILTER (WHERE kpi_key = '{k}') AS {k}" for k in O.KEYS) + " FROM klast GROUP BY 1) k USING (cell_id)"
PAGE_KPIS = ", ".join(O.KEYS)
add("cell_table_paged", lambda s: spread(V.cell_table(s, limit=20, offset=10)), O.sql(
    f"SELECT {PAGE}, {PAGE_KPIS} FROM (SELECT * FROM state ORDER BY priority_score DESC NULLS LAST, cell_id LIMIT 20 OFFSET 10) {KPI_PAGE}", "state", "klast"))
add("cell_table_filtered", lambda s: spread(V.cell_table(s, search="nation", severity="Critical", min_priority=25)), O.sql(
    f"SELECT {PAGE}, {PAGE_KPIS} FROM (SELECT * FROM state WHERE severity = 'Critical' AND priority_score >= 25 AND (contains(lower(cell), 'nation') OR contains(lower(site), 'nation') OR contains(lower(district), 'nation') OR contains(lower(region), 'nation')) "
    f"ORDER BY priority_score DESC NULLS LAST, cell_id LIMIT 100) {KPI_PAGE}", "state", "klast"))
for g in ("daily", "weekly"):
    add(f"cell_detail_{g}", lambda s, g=g: V.cell_detail(s, 7, g), O.sql(
        f"SELECT period, cell_id, cell, site, district, region, prb_avg, throughput_kbps, users, volume_mb, availability_pct, breach_days, is_nc, lifecycle, severity FROM life_{g} JOIN cells USING (cell_id) WHERE cell_id = 7", f"life_{g}", "cells"))
SEV = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Watch' THEN 2 WHEN 'Normal' THEN 3 ELSE 4 END"
LIF = "CASE lifecycle WHEN 'Chronic' THEN 0 WHEN 'Persistent' THEN 1 WHEN 'Recurring' THEN 2 WHEN 'New' THEN 3 WHEN 'Recovering' THEN 4 WHEN 'Healthy' THEN 5 ELSE 6 END"
for scope, q in (("cell", "1"), ("district", "n_2")):
    q = q.replace("n_2", "_1")
    add(f"entity_search_{scope}", lambda s, v=scope, q=q: V.entity_search(s, v, q), O.sql(
        f"SELECT {scope}_id AS id, {scope} AS name, max(priority_score) AS score, CAST(min({SEV}) AS INTEGER) AS severity_rank, CAST(min({LIF}) AS INTEGER) AS lifecycle_rank FROM state WHERE contains(lower({scope}), '{q}') GROUP BY 1, 2 "
        "ORDER BY severity_rank, score DESC NULLS LAST, id LIMIT 100", "state"))
STATUSES = ("Open", "In Progress", "Resolved", "Deferred")


def demo_status(star, scope):
    """A made-up state of work for every third entity or so."""
    key, _ = V.ENTITY[scope]
    ids = star.cells.select(F.col(key).alias("id")).distinct().filter(F.col("id") % 3 != 0)
    names = F.array(*[F.lit(x) for x in STATUSES])
    return ids.select("id", F.element_at(names, (F.col("id") % 4 + 1).cast("int")).alias("status"), F.concat(F.lit("team"), (F.col("id") % 5).cast("string")).alias("owner"),
                      F.date_add(F.lit("2001-11-01").cast("date"), (F.col("id") % 20).cast("int")).alias("review_date"))


for scope in ("cell", "site", "district", "region"):
    O.define(f"pc_{scope}", ("state", "prio", "cells"), f"""
SELECT q.*, {O.BAND.format('priority_score')} AS priority_band, coalesce(review_date < DATE '2001-11-10' AND status NOT IN ('Resolved', 'Deferred'), false) AS overdue, coalesce(status, 'unset') AS status, owner, review_date
FROM (SELECT {scope}_id AS id, {scope} AS name, max(balanced) AS priority_score, count(*) FILTER (WHERE is_nc) AS nc_cells, count(DISTINCT cell_id) AS cells, round(avg(prb_avg), 4) AS prb_avg FROM state JOIN (SELECT cell_id, balanced FROM prio) USING (cell_id) GROUP BY 1, 2) q
LEFT JOIN (SELECT id, ['Open', 'In Progress', 'Resolved', 'Deferred'][id % 4 + 1] AS status, 'team' || CAST(id % 5 AS VARCHAR) AS owner, DATE '2001-11-01' + CAST(id % 20 AS INTEGER) AS review_date FROM (SELECT DISTINCT {scope}_id AS id FROM cells) WHERE id % 3 <> 0) s USING (id)
ORDER BY priority_score DESC, id LIMIT 100""")
    add(f"priority_center_{scope}", lambda s, v=scope: V.priority_center(s, demo_status(s, v), "2001-11-10", v), O.sql(f"SELECT * FROM pc_{scope}", f"pc_{scope}"))
add("priority_status_rollup", lambda s: V.status_rollup(V.priority_center(s, demo_status(s, "cell"), "2001-11-10", limit=10_000_000)), O.sql(
    "SELECT status, count(*) AS entities, count(*) FILTER (WHERE overdue) AS overdue FROM pc_cell GROUP BY 1", "pc_cell").replace("LIMIT 100)", ")"))
add("summary", V.summary, O.sql(
    "SELECT * FROM (SELECT count(*) AS row_count, min(date) AS min_date, max(date) AS max_date FROM facts), "
    "(SELECT count(DISTINCT cell_id) AS cells, count(DISTINCT site_id) AS sites, count(DISTINCT district_id) AS districts, count(DISTINCT region_id) AS regions FROM cells), "
    "(SELECT min(period) AS period_start, max(period) + 6 AS period_end, count(DISTINCT CASE WHEN is_nc THEN cell_id END) AS nc_cells, count(*) FILTER (WHERE is_nc) AS nc_cell_weeks, count(*) AS cell_weeks, "
    "round(avg(prb_avg), 4) AS avg_prb, round(sum(volume_mb), 4) AS volume_mb, round(sum(users), 4) AS users, round(avg(throughput_kbps), 4) AS throughput_kbps, round(avg(availability_pct), 4) AS availability_pct "
    "FROM cw JOIN backs USING (period) WHERE back < 4)", "facts", "cells", "cw", "backs"))
add("executive_cards", V.executive_cards, O.sql(
    "SELECT technology, kpi_key, label, current, previous, round(current - previous, 2) AS delta, round((current - previous) / nullif(abs(previous), 0) * 100, 1) AS delta_pct, "
    "CASE WHEN current IS NULL THEN 'unavailable' WHEN target IS NULL OR NOT sign * current > sign * target THEN 'compliant' WHEN sign * current > sign * critical THEN 'non_compliant' WHEN sign * current > sign * warning THEN 'warning' ELSE 'non_compliant' END AS compliance, "
    "CASE WHEN previous IS NULL OR abs(round(current - previous, 2)) < 0.001 THEN 'stable' WHEN sign * round(current - previous, 2) > 0 THEN 'worsening' ELSE 'improving' END AS trend, "
    "nc_cells, round(100.0 * nc_cells / cells, 1) AS nc_pct, sparkline_mean FROM (SELECT technology, kpi_key, label, target, warning, critical, CASE WHEN worse_is_higher THEN 1 ELSE -1 END AS sign, max(value) FILTER (WHERE back = 0) AS current, max(value) FILTER (WHERE back = 1) AS previous, "
    "max(nc) FILTER (WHERE back = 0) AS nc_cells, max(n) FILTER (WHERE back = 0) AS cells, round(avg(value), 4) AS sparkline_mean FROM "
    "(SELECT technology, kpi_key, label, target, warning, critical, worse_is_higher, period, back, round(avg(value), 4) AS value, count(DISTINCT CASE WHEN breached THEN cell_id END) AS nc, count(DISTINCT cell_id) AS n FROM kv JOIN backs USING (period) WHERE back < 12 GROUP BY ALL) GROUP BY ALL)", "kv", "backs"))
O.define("hnet", ("ent_network_weekly",), O.HEALTH_NETWORK.format("ent_network_weekly"))
add("executive_health", V.executive_health, O.sql(
    "SELECT score, previous, critical_cells, chronic_cells, persistent_cells, round(score - previous, 1) AS delta FROM "
    "(SELECT max(score) FILTER (WHERE back = 0) AS score, max(score) FILTER (WHERE back = 1) AS previous FROM hnet JOIN backs USING (period)), "
    "(SELECT count(*) FILTER (WHERE severity = 'Critical') AS critical_cells, count(*) FILTER (WHERE lifecycle = 'Chronic') AS chronic_cells, count(*) FILTER (WHERE lifecycle = 'Persistent') AS persistent_cells FROM last)", "hnet", "backs", "last"))
add("worst_districts", V.worst_districts, O.sql("SELECT id, name, health_score, nc_cells, cells FROM exp_district ORDER BY health_score NULLS LAST, id LIMIT 3", "exp_district"))

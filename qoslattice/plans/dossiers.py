"""Queries of investigations as a whole, the executive overview, names of periods, and figures in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import add_periods, in_words, period_label
from ..operators import aggregates as A
from ..operators import dossier as D
from ..operators import overview as W
from ..operators.investigate import NOTES
from ..operators.views import METRICS
from ..sources.star import from_orders
from . import oracle as O
from .insight import AGG, DIAG, TESTS, _pt

QUERIES, ORACLE_SQL = {}, {}


def add(name, query, sql):
    QUERIES[name] = lambda spark, d, q=query: q(from_orders(spark, d))
    ORACLE_SQL[name] = sql


def everyone(star):
    """Every entity of every scope is asked for."""
    return D.unfolded(star).select("scope", "id").distinct()


def notes(star):
    """A note on each site's first cell."""
    first = star.cells.groupBy("site").agg(F.min("cell_id").alias("cell_id"))
    return first.select("cell_id", F.lit("2001-05-07").cast("date").alias("at"), F.lit("ops").alias("author"), F.concat(F.lit("seen at "), "site").alias("note")).to(_schema(star, NOTES))


def _schema(star, ddl):
    return star.spark.createDataFrame([], ddl).schema


LEVELS = {
    "cell": ("cell_id", "cell", "district_id"), "site": ("site_id", "site", "district_id"), "district": ("district_id", "district", "region_id"), "region": ("region_id", "region", "0::BIGINT"),
}
_path = {"cell": "region, district, site, cell", "site": "region, district, site", "district": "region, district", "region": "region"}
O.define("ent", ("cells",), " UNION ALL ".join(
    f"SELECT cell_id, '{s}' AS scope, {k} AS id, {n} AS name, concat_ws(' > ', 'Network', {_path[s]}) AS path, {p} AS parent FROM cells" for s, (k, n, p) in LEVELS.items())
    + " UNION ALL SELECT cell_id, 'network', 0::BIGINT, 'Network', 'Network', 0::BIGINT FROM cells")
O.define("entid", ("ent",), "SELECT scope, id, min(name) AS name, min(path) AS path, count(DISTINCT cell_id) AS cells FROM ent GROUP BY 1, 2")
O.define("entw", ("ent", "cw"), "SELECT scope, id, period, count(*) AS cells, count(*) FILTER (WHERE is_nc) AS nc_cells, " + ", ".join(f"round({a}({m}), 4) AS {m}" for m, a in AGG.items()) + " FROM cw JOIN ent USING (cell_id) GROUP BY 1, 2, 3")
_two = ", ".join(f"max({m}) FILTER (WHERE rn = 1) AS c_{m}, max({m}) FILTER (WHERE rn = 2) AS p_{m}" for m in METRICS)
O.define("entlast", ("entw",), f"SELECT scope, id, {_two} FROM (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY period DESC) AS rn FROM entw) WHERE rn <= 2 GROUP BY 1, 2")
O.define("entev", ("entlast",), " UNION ALL ".join(f"SELECT scope, id, '{m}' AS metric, c_{m} AS current, p_{m} AS previous FROM entlast" for m in METRICS))
O.define("entfind", ("laglast", "ent"), "SELECT scope, id, finding, count(DISTINCT cell_id) AS cells FROM (" + " UNION ALL ".join(f"SELECT cell_id, '{k}' AS finding FROM laglast WHERE {t}" for k, t in TESTS.items()) + ") JOIN ent USING (cell_id) GROUP BY 1, 2, 3")
O.define("enthyp", ("diag", "ent"), "SELECT scope, id, hypothesis, max(score) AS score, count(*) FILTER (WHERE score >= 45) AS cells FROM (" + " UNION ALL ".join(
    f"SELECT cell_id, '{k}' AS hypothesis, CAST(least(95, greatest(5, {b} + {_pt(s)} - ({_pt(c)}))) AS BIGINT) AS score FROM diag" for k, (b, s, c) in DIAG.items()) + ") JOIN ent USING (cell_id) GROUP BY 1, 2, 3")
O.define("enthealth", ("last", "hcell", "ent"), """
SELECT scope, parent, id AS peer_id, min(name) AS peer, round(avg(h.score), 1) AS health_score
FROM last l JOIN ent USING (cell_id) LEFT JOIN hcell h ON h.cell_id = l.cell_id AND h.period = l.period WHERE scope <> 'network' GROUP BY 1, 2, 3""")
O.define("entpeer", ("enthealth", "ent"), """
SELECT scope, id, peer_id, peer, health_score, CAST(place AS INTEGER) AS place FROM (SELECT e.scope, e.id, peer_id, peer, health_score, row_number() OVER (PARTITION BY e.scope, e.id ORDER BY health_score NULLS LAST, peer_id) AS place
  FROM (SELECT DISTINCT scope, id, parent FROM ent) e JOIN enthealth h ON e.scope = h.scope AND e.parent = h.parent AND h.peer_id <> e.id) WHERE place <= 10""")

add("investigation_identity", lambda s: D.identities(s, everyone(s)), O.sql("SELECT * FROM entid", "entid"))
add("investigation_series", lambda s: D.entity_weeks(s, everyone(s)), O.sql("SELECT * FROM entw", "entw"))
add("investigation_evidence", lambda s: D.entity_evidence(s, everyone(s)), O.sql(
    "SELECT *, round(current - previous, 2) AS delta, round((current - previous) / nullif(abs(previous), 0) * 100, 1) AS delta_pct FROM entev", "entev"))
add("investigation_findings", lambda s: D.entity_findings(s, everyone(s)), O.sql("SELECT * FROM entfind", "entfind"))
add("investigation_hypotheses", lambda s: D.entity_hypotheses(s, everyone(s)), O.sql(
    "SELECT *, CAST(row_number() OVER (PARTITION BY scope, id ORDER BY score DESC, cells DESC, hypothesis) AS INTEGER) AS place FROM enthyp", "enthyp"))
add("investigation_peers", lambda s: D.entity_peers(s, everyone(s)), O.sql("SELECT * FROM entpeer", "entpeer"))
_none = {"period": "NULL::DATE", "value": "NULL::DOUBLE", "reference": "NULL::DOUBLE", "note": "NULL::VARCHAR"}
_part = lambda table, section, item, **given: f"SELECT scope, id, '{section}' AS section, {item} AS item, " + ", ".join(f"{given.get(c, n)}{'::DOUBLE' if c in given and c in ('value', 'reference') else ''} AS {c}" for c, n in _none.items()) + f" FROM {table}"
add("investigation", lambda s: D.investigation(s, everyone(s), notes=notes(s)), O.sql(" UNION ALL ".join([
    _part("entid", "identity", "name", value="cells", note="path"),
    *[_part(f"entw WHERE {m} IS NOT NULL", "series", f"'{m}'", period="period", value=m) for m in METRICS],
    _part("entw", "series", "'nc_cells'", period="period", value="nc_cells", reference="cells"),
    _part("entev", "evidence", "metric", value="current", reference="previous"),
    _part("(SELECT f.*, i.cells AS n FROM entfind f JOIN entid i USING (scope, id))", "finding", "finding", value="cells", reference="n"),
    _part("enthyp", "hypothesis", "hypothesis", value="score", reference="cells"),
    _part("entpeer", "peer", "peer", value="health_score"),
    _part("(SELECT site, min(cell_id) AS cell_id FROM cells GROUP BY 1) n JOIN ent USING (cell_id)", "note", "CAST(cell_id AS VARCHAR)", period="DATE '2001-05-07'", note="'ops: seen at ' || site"),
]), "entid", "entw", "entev", "entfind", "enthyp", "entpeer", "ent", "cells"))

# The executive overview.
O.define("kweekly", ("kv", "backs"), """
SELECT technology, kpi_key, target, worse_is_higher, is_core, period, back, round(avg(value), 4) AS value FROM kv JOIN backs USING (period) WHERE back < 12 GROUP BY ALL""")
add("executive_sparklines", lambda s: W.sparklines(s).select("technology", "kpi_key", F.posexplode(F.arrays_zip("dates", "values")).alias("nth", "p")).select("technology", "kpi_key", "nth", F.col("p.dates").alias("date"), F.col("p.values").alias("value")), O.sql(
    "SELECT technology, kpi_key, CAST(row_number() OVER (PARTITION BY technology, kpi_key ORDER BY period) - 1 AS INTEGER) AS nth, period AS date, value FROM kweekly", "kweekly"))
_bad = "coalesce(CASE WHEN worse_is_higher THEN value > target ELSE value < target END, false)"
O.define("techcards", ("kweekly",), f"""
SELECT technology, kpi_key, is_core, bool_or({_bad} AND back = 0) AS breached FROM kweekly GROUP BY 1, 2, 3""")
O.define("techcells", ("klast", "cwlast"), "SELECT technology, count(*) AS cells, count(*) FILTER (WHERE is_nc) AS nc_cells FROM (SELECT DISTINCT technology, cell_id FROM klast) JOIN cwlast USING (cell_id) GROUP BY 1")
add("executive_technologies", W.technology_cards, O.sql("""
SELECT technology, cards, primary_cards, breached_cards, coalesce(cells, 0) AS cells, coalesce(nc_cells, 0) AS nc_cells, compliance_pct, round(least(100.0, greatest(20.0, compliance_pct - 5 * breached_cards)), 1) AS health
FROM (SELECT *, coalesce(round(100.0 * (cells - nc_cells) / cells, 1), 100.0) AS compliance_pct FROM (
  SELECT technology, count(*) AS cards, count(*) FILTER (WHERE CASE WHEN core THEN is_core ELSE nth <= 4 END) AS primary_cards, count(*) FILTER (WHERE breached AND CASE WHEN core THEN is_core ELSE nth <= 4 END) AS breached_cards
  FROM (SELECT *, bool_or(is_core) OVER (PARTITION BY technology) AS core, row_number() OVER (PARTITION BY technology ORDER BY kpi_key) AS nth FROM techcards) GROUP BY 1) LEFT JOIN techcells USING (technology))""", "techcards", "techcells"))
O.define("worst3", ("exp_district",), "SELECT * FROM (SELECT id, name, health_score, nc_cells FROM exp_district ORDER BY health_score NULLS LAST, id LIMIT 3) WHERE nc_cells > 0")
O.define("nowhealth", ("hnet",), "SELECT score FROM hnet WHERE period = (SELECT max(period) FROM hnet)")
add("executive_recommendations", W.recommendations, O.sql("""
SELECT 1 AS place, 'chronic' AS kind, n::DOUBLE AS figure, 'visit the sites of cells that have been non-compliant for long' AS advice FROM (SELECT count(*) AS n FROM last WHERE lifecycle = 'Chronic') WHERE n > 0
UNION ALL SELECT 2, 'districts', n::DOUBLE, 'add capacity in ' || named FROM (SELECT count(*) AS n, string_agg(name, ', ' ORDER BY health_score, id) AS named FROM worst3) WHERE n > 0
UNION ALL SELECT 3, CASE WHEN score >= 80 THEN 'stable' ELSE 'audit' END, score, CASE WHEN score >= 80 THEN 'keep watching' ELSE 'audit the parameters of loaded clusters' END FROM nowhealth""", "last", "worst3", "nowhealth"))
add("health_report", W.health_report, O.sql("""
SELECT 'network' AS kind, period, NULL::BIGINT AS cell_id, score FROM hnet JOIN backs USING (period) WHERE back < 12
UNION ALL SELECT * FROM (SELECT 'cell', period, cell_id, score FROM hcell WHERE period = (SELECT max(period) FROM hcell) ORDER BY score, cell_id LIMIT 200)""", "hnet", "backs", "hcell"))
add("priority_report", W.priority_report, O.sql(
    "SELECT period, cell_id, prb_severity, persistence_score, user_impact, traffic_impact, throughput_deficit, trend_score, 'balanced' AS mode, balanced AS score, " + O.BAND.format("balanced") + " AS band, coalesce(b.s, 0.0) AS kpi_breach, coalesce(b.n, 0) AS breached_kpis "
    "FROM (SELECT * FROM prio ORDER BY balanced DESC, cell_id LIMIT 50) LEFT JOIN (SELECT cell_id, round(avg(severity), 1) AS s, count(*) AS n FROM klast WHERE breached GROUP BY 1) b USING (cell_id)", "prio", "klast"))


# Names of periods, and figures in words.
def period_names(star):
    """Every period with facts, by grain, with its label and those two on and one back."""
    rows = None
    for g in A.GRAINS:
        starts = star.facts.select(A.period_start("date", g).alias("period")).distinct()
        part = starts.select(F.lit(g).alias("grain"), "period", period_label("period", g).alias("label"), add_periods("period", 2, g).alias("two_on"), add_periods("period", -1, g).alias("one_back"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


_label = {"daily": "strftime(period, '%m-%d')", "weekly": "'W' || CAST(weekofyear(period) AS VARCHAR)", "monthly": "strftime(period, '%Y-%m')"}
_unit = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}
add("period_names", period_names, O.sql(" UNION ALL ".join(
    f"SELECT '{g}' AS grain, period, {_label[g]} AS label, CAST(period + INTERVAL 2 {_unit[g]} AS DATE) AS two_on, CAST(period - INTERVAL 1 {_unit[g]} AS DATE) AS one_back FROM (SELECT DISTINCT {O.start('date', g)} AS period FROM facts)" for g in A.GRAINS), "facts"))


def figures_in_words(star):
    """Every district's week, figures with their units."""
    rows = A.entity_period(star, "district", "weekly")
    return rows.select("entity_id", "period", in_words("volume_mb", F.lit("MB")).alias("volume"), in_words("throughput_kbps", F.lit("kbps")).alias("speed"), in_words("prb_avg", F.lit("%")).alias("load"), in_words("users", F.lit("-"), 0).alias("users"))


_word = lambda m, unit, large, factor: f"CASE WHEN {m} IS NULL THEN '—' WHEN abs({m}) >= {factor} THEN printf('%.1f', round({m} / {factor}, 1)) || ' {large}' ELSE printf('%.1f', round({m}, 1)) || ' {unit}' END"
add("figures_in_words", figures_in_words, O.sql(
    f"SELECT entity_id, period, {_word('volume_mb', 'MB', 'GB', 1024)} AS volume, {_word('throughput_kbps', 'kbps', 'Mbps', 1000)} AS speed, coalesce(printf('%.1f', round(prb_avg, 1)) || '%', '—') AS load, coalesce(printf('%.0f', round(users, 0)), '—') AS users FROM ent_district_weekly", "ent_district_weekly"))

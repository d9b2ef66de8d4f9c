"""Queries over a workspace, where several technologies share KPI keys and a KPI is switched off.

The store is filled by imports of two technologies; its period tables are built, and days
that come late are merged and the tables brought up to date.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import intelligence as I
from ..operators import views as V
from ..operators.aggregates import cell_weekly
from ..sources.derived import Derived
from ..sources.ingest import FIELDS
from ..sources.maintenance import check
from ..sources.star import MEASURES, cells_from_orders, facts_from_orders
from ..sources.workspace import Workspace
from . import oracle as O
from .loading import _t, shared_dir

QUERIES, ORACLE_SQL = {}, {}
KPI_COLUMNS = ("call_drop", "congestion", "payload")
_stores: dict = {}


def store(spark, d) -> tuple[Workspace, Derived]:
    """One store for an application and input: it is only read after it is made."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        _stores[key] = _made(spark, d)
    return _stores[key]


def _made(spark, d) -> tuple[Workspace, Derived]:
    path = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
    text = lambda c: rounded(c, 2).cast("decimal(18,2)").cast("string").alias(c)
    wide = facts_from_orders(spark, d).join(cells_from_orders(spark, d), "cell_id")
    late = (F.dayofyear("date") % 7 == 3) & (F.col("cell_id") % 5 == 0)
    wide.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "cell", "site", "district", "region", *[text(m) for m in (*MEASURES, *KPI_COLUMNS)], late.alias("late"), F.col("cell_id").alias("line")
    ).write.parquet(f"{path}-rows")
    rows, mapping = spark.read.parquet(f"{path}-rows"), {f: f for f in FIELDS}
    names = lambda *pairs: spark.createDataFrame(pairs, "header string, kpi_key string")
    lte, gsm = names(("call_drop", "call_drop_rate_4g"), ("payload", "connected_users")), names(("congestion", "tch_congestion"), ("call_drop", "connected_users"))
    ws = Workspace(spark, path)
    ws.import_rows(rows.filter("not late").drop("late"), mapping, lte)
    ws.import_rows(rows.filter("not late").drop("late"), mapping, gsm, technology="2G")
    ws.set_kpis(ws.table("kpis").filter("kpi_key = 'tch_congestion'").withColumn("active", F.lit(False)))
    derived = Derived(ws, grains=("weekly",), slices=2)
    derived.refresh()
    ws.import_rows(rows.filter("late").drop("late"), mapping, lte)
    if derived.refresh().whole:
        raise AssertionError("late days change some weeks alone")
    return ws, derived


def add(name, query, sql):
    QUERIES[name] = lambda spark, d, q=query: q(*store(spark, d))
    ORACLE_SQL[name] = sql


O.define("stwide", ("wide", "cells"), "SELECT w.cell_id, w.date, c.* EXCLUDE (cell_id), dayofyear(w.date) % 7 = 3 AND w.cell_id % 5 = 0 AS late, " + ", ".join(f"CAST({_t(f'w.{m}')} AS DOUBLE) AS {m}" for m in (*MEASURES, *KPI_COLUMNS)) + " FROM wide w JOIN cells c USING (cell_id)")
O.define("stflagged", ("stwide",), f"SELECT *, prb >= {O.T} AS prb_breach, (prb >= {O.T} OR call_drop > 1.5) AS is_breach FROM stwide")
O.define("stcw", ("stflagged",), O.CTES["cw"][1].replace("FROM flagged", "FROM stflagged"))
O.define("stlife", ("stcw",), O.CTES["life_weekly"][1].replace("FROM cw)", "FROM stcw)"))
O.define("stextras", ("stwide",), "SELECT cell_id, date, '4G' AS technology, 'call_drop_rate_4g' AS kpi_key, call_drop AS value FROM stwide UNION ALL SELECT cell_id, date, '4G', 'connected_users', payload FROM stwide "
         "UNION ALL SELECT cell_id, date, '2G', 'connected_users', call_drop FROM stwide WHERE NOT late")
O.define("stkpis", ("stextras",), f"""
SELECT *, coalesce(kpi_key = 'call_drop_rate_4g' AND value > 1.5, false) AS breached FROM (SELECT cell_id, technology, kpi_key, round(avg(value), 4) AS value FROM stextras
WHERE {O.start('date', 'weekly')} = (SELECT max({O.start('date', 'weekly')}) FROM stextras) GROUP BY 1, 2, 3)""")
O.define("stvalues", ("stcw", "stkpis"), " UNION ALL ".join(f"SELECT cell_id, NULL AS technology, '{m}' AS metric, {m} AS value FROM stcw WHERE period = (SELECT max(period) FROM stcw)" for m in V.METRICS) + " UNION ALL SELECT cell_id, technology, kpi_key, value FROM stkpis")
named = lambda rows, ws: rows.join(ws.table("cells").select("cell_id", "cell"), "cell_id").drop("cell_id")
BY_NAME = "SELECT x.* EXCLUDE (cell_id), cell FROM {} x JOIN cells USING (cell_id)"
add("ws_cell_weekly", lambda ws, _: named(cell_weekly(ws.star()), ws), O.sql(BY_NAME.format("stcw"), "stcw", "cells"))
add("ws_cell_weekly_late_days", lambda ws, derived: named(derived.table("cell_weekly"), ws), O.sql(BY_NAME.format("stcw"), "stcw", "cells"))
add("ws_lifecycle_late_days", lambda ws, derived: named(derived.table("lifecycle_weekly"), ws), O.sql(BY_NAME.format("stlife"), "stlife", "cells"))
O.define("stlast", ("stlife",), "SELECT * FROM stlife WHERE period = (SELECT max(period) FROM stlife)")
O.define("stpeers", ("stlife",), O.CTES["peers"][1].replace("FROM life ", "FROM stlife "))
O.define("stprio", ("stlast", "stpeers"), O.CTES["prio"][1].replace("FROM last JOIN peers", "FROM stlast JOIN stpeers"))
add("ws_priority_stored", lambda ws, derived: named(I.priority_queue(ws.star(), lifecycle=derived.table("lifecycle_weekly")), ws), O.sql(
    f"SELECT period, cell, {', '.join(I.COMPONENTS)}, 'balanced' AS mode, balanced AS score, {O.BAND.format('balanced')} AS band FROM stprio JOIN cells USING (cell_id)", "stprio", "cells"))
add("ws_priority_stale", lambda ws, derived: named(I.priority(ws.star(), include_stale=True), ws).groupBy("period").agg(F.count("*").alias("cells")), O.sql(
    "SELECT period, count(*) AS cells FROM (SELECT cell_id, max(period) AS period FROM stlife GROUP BY 1) GROUP BY 1", "stlife"))
add("ws_kpi_overview", lambda ws, _: V.kpi_overview(ws.star()).select("technology", "kpi_key", "target", "breached_cells", "observed_cells"), O.sql(
    "SELECT technology, kpi_key, CASE WHEN kpi_key = 'call_drop_rate_4g' THEN 1.5::DOUBLE END AS target, count(*) FILTER (WHERE breached) AS breached_cells, count(*) AS observed_cells FROM stkpis GROUP BY ALL", "stkpis"))
add("ws_correlations", lambda ws, _: V.correlations(ws.star()), O.sql(
    "SELECT x.technology AS a_technology, x.metric AS a, y.technology AS b_technology, y.metric AS b, round(corr(x.value, y.value), 4) AS pearson, count(*) AS n FROM stvalues x JOIN stvalues y "
    "ON x.cell_id = y.cell_id AND (x.metric, coalesce(x.technology, '')) < (y.metric, coalesce(y.technology, '')) WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2, 3, 4", "stvalues"))
add("ws_percentiles", lambda ws, _: V.distributions(ws.star()), O.sql(
    "SELECT technology, metric, i / 20 AS q, round(v[i + 1], 4) AS value FROM (SELECT technology, metric, v, unnest(range(21)) AS i FROM (SELECT technology, metric, quantile_cont(value, ["
    + ", ".join(str(i / 20) for i in range(21)) + "]) AS v FROM stvalues GROUP BY 1, 2))", "stvalues"))
add("ws_region_map", lambda ws, _: V.place_map(ws.star()).select("name", F.explode("kpis").alias("kpi", "x")).select("name", "kpi", "x.avg", "x.nc"), O.sql(
    "SELECT region AS name, technology || ':' || kpi_key AS kpi, round(avg(value), 4) AS avg, count(*) FILTER (WHERE breached) AS nc FROM stkpis JOIN cells USING (cell_id) GROUP BY 1, 2", "stkpis", "cells"))
add("ws_cell_table", lambda ws, _: V.cell_table(ws.star(), search="00000001").select("cell", F.explode("kpis").alias("kpi", "value")), O.sql(
    "SELECT cell, technology || ':' || kpi_key AS kpi, value FROM stkpis JOIN cells USING (cell_id) WHERE contains(cell, '00000001')", "stkpis", "cells"))
add("ws_integrity", lambda ws, _: check(ws), "SELECT unnest(['duplicate_facts', 'duplicate_kpis', 'duplicate_cells', 'orphan_facts', 'cells_without_site']) AS problem, 0::BIGINT AS n")

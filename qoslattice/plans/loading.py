"""Queries of ingest, merge, repair and streaming."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import header_key, parsed_date, rounded
from ..operators.aggregates import cell_weekly
from ..sources import ingest as I
from ..sources import kpis
from ..sources import repair as R
from ..sources.star import MEASURES, cells_from_orders, facts_from_orders, from_orders
from ..sources.workspace import Workspace
from ..streaming import windows as S
from . import insight  # noqa: F401  (defines shared table expressions)
from . import oracle as O

QUERIES, ORACLE_SQL = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def shared_dir(spark) -> str:
    """Where driver and executors both can write: the cluster names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def raw_rows(spark, d):
    """Daily facts as a file would hold them: all strings, some of them broken, some rows twice."""
    rows = facts_from_orders(spark, d).join(cells_from_orders(spark, d), "cell_id")
    day, text = F.datediff("date", F.lit("1995-01-01").cast("date")), lambda c: rounded(c, 2).cast("decimal(18,2)").cast("string")
    form = F.when(day % 4 == 0, F.date_format("date", "yyyy-MM-dd")).when(day % 4 == 1, F.date_format("date", "dd/MM/yyyy")).when(day % 4 == 2, F.date_format("date", "dd.MM.yy")).otherwise(F.date_format("date", "yyyyMMdd"))
    raw = rows.select(
        F.when((day + F.col("cell_id")) % 29 == 0, "soon").otherwise(form).alias("date"), F.when((day + F.col("cell_id")) % 31 == 0, "TOTAL").otherwise(F.concat(F.lit(" "), "cell")).alias("cell"),
        F.when(day % 13 == 0, "12").otherwise(F.col("site")).alias("site"), F.when(day % 17 == 0, F.lit("Avg")).when(day % 19 == 0, "NATION_0").otherwise(F.col("district")).alias("district"), F.col("region"),
        F.when(day % 23 == 0, "n/a").when(day % 37 == 0, "-5").otherwise(text("prb")).alias("prb"), *[text(m).alias(m) for m in MEASURES[1:]], text("call_drop").alias("Call Drop"), text("congestion").alias("TCH Congestion"),
        (day.cast("long") * 100_000 + F.col("cell_id")).alias("line"),
    )
    # Each fifth row stands there twice: facts are added up once.
    nth = F.explode(F.when(F.col("line") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth")
    prb, line = F.when(F.col("nth") == 1, "1").otherwise(F.col("prb")).alias("prb"), (F.col("line") + F.col("nth") * 10_000_000_000).alias("line")
    return raw.select("*", nth).select(*[prb if c == "prb" else line if c == "line" else c for c in raw.columns])


_t = lambda c: f"CAST(CAST(round({c}, 2) AS DECIMAL(18,2)) AS VARCHAR)"
O.define("raw1", ("wide", "cells"), f"""
SELECT CASE WHEN (day + cell_id) % 29 = 0 THEN 'soon' WHEN day % 4 = 0 THEN strftime(date, '%Y-%m-%d') WHEN day % 4 = 1 THEN strftime(date, '%d/%m/%Y') WHEN day % 4 = 2 THEN strftime(date, '%d.%m.%y') ELSE strftime(date, '%Y%m%d') END AS dt,
  date AS real_date, CASE WHEN (day + cell_id) % 31 = 0 THEN 'TOTAL' ELSE ' ' || cell END AS cell, CASE WHEN day % 13 = 0 THEN '12' ELSE site END AS site,
  CASE WHEN day % 17 = 0 THEN 'Avg' WHEN day % 19 = 0 THEN 'NATION_0' ELSE district END AS district, region, CASE WHEN day % 23 = 0 THEN 'n/a' WHEN day % 37 = 0 THEN '-5' ELSE {_t('prb')} END AS prb,
  {', '.join(f'{_t(m)} AS {m}' for m in MEASURES[1:])}, {_t('call_drop')} AS cd, {_t('congestion')} AS tc, day * 100000 + cell_id AS line
FROM (SELECT w.*, c.* EXCLUDE (cell_id), CAST(date - DATE '1995-01-01' AS BIGINT) AS day FROM wide w JOIN cells c USING (cell_id))""")
O.define("raw", ("raw1",), "SELECT * FROM raw1 UNION ALL SELECT * REPLACE (line + 10000000000 AS line, '1' AS prb) FROM raw1 WHERE line % 5 = 0")
# The file's dates are written from real ones; a pattern must give the same back.
O.define("cleaned", ("raw",), "SELECT real_date AS date, trim(cell) AS cell, CASE WHEN site <> '12' THEN site END AS site, CASE WHEN district <> 'Avg' THEN district END AS district, region, "
         + ", ".join(f"TRY_CAST({m} AS DOUBLE) AS {m}" for m in MEASURES) + ", cd, tc, line FROM raw WHERE dt <> 'soon' AND cell <> 'TOTAL'")
O.define("deduped", ("cleaned",), "SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY date, cell ORDER BY line) = 1")
COLUMNS = ["date", "cell", "site", "district", "region", *MEASURES, "line"]
LIST = ", ".join(COLUMNS)
cleaned = lambda spark, d: I.clean(raw_rows(spark, d))
deduped = lambda spark, d: I.dedupe(cleaned(spark, d))
add("ingest_clean", lambda s, d: cleaned(s, d).select(*COLUMNS), O.sql(f"SELECT {LIST} FROM cleaned", "cleaned"))
add("ingest_dedupe", lambda s, d: deduped(s, d).select(*COLUMNS), O.sql(f"SELECT {LIST} FROM deduped", "deduped"))
add("validation_counts", lambda s, d: I.validation_counts(raw_rows(s, d)), O.sql(
    "SELECT count(*) AS rows, 0::BIGINT AS no_date, count(*) FILTER (WHERE dt = 'soon') AS bad_date, 0::BIGINT AS no_cell, " + ", ".join(f"count(*) FILTER (WHERE TRY_CAST({m} AS DOUBLE) IS NULL) AS bad_{m}" for m in MEASURES) + ", "
    + ", ".join(f"count(*) FILTER (WHERE TRY_CAST({m} AS DOUBLE) < 0 OR TRY_CAST({m} AS DOUBLE) > 100) AS range_{m}" for m in ("prb", "availability_pct")) + ", "
    + ", ".join(f"count(*) FILTER (WHERE TRY_CAST({m} AS DOUBLE) < 0) AS negative_{m}" for m in ("volume_mb", "users", "throughput_kbps")) + " FROM raw", "raw"))
MAJ = "SELECT {0}, {1} FROM (SELECT {0}, {1}, count(*) AS n FROM deduped WHERE {0} IS NOT NULL AND {1} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY n DESC, {1}) = 1"
add("dim_majority_parent", lambda s, d: I.majority_parent(deduped(s, d), "site", "district"), O.sql(MAJ.format("site", "district"), "deduped"))
known_sites = lambda s, d: cells_from_orders(s, d).filter("district_id < 10").select("site", "site_id").distinct()
add("dim_surrogate_ids", lambda s, d: I.with_ids(deduped(s, d), "site", known_sites(s, d), "site_id"), O.sql(
    "SELECT (SELECT max(site_id) FROM cells WHERE district_id < 10) + row_number() OVER (ORDER BY site) AS site_id, site FROM (SELECT DISTINCT site FROM deduped WHERE site IS NOT NULL AND site NOT IN (SELECT site FROM cells WHERE district_id < 10))", "deduped", "cells"))


def gappy_cells(spark, d):
    hole = lambda c: F.when(F.col("cell_id") % 3 != 0, F.col(c)).alias(c)
    return cells_from_orders(spark, d).select("cell_id", "cell", hole("site"), hole("district"))


def _backfilled(spark, d):
    # Written, as both kinds of parents are counted from it: rows are cleaned once.
    path = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    I.place_rows(deduped(spark, d), "cell", "site", "district").write.parquet(path)
    rows = spark.read.parquet(path)
    parents = I.majority_parent(rows, "cell", "site", "times").join(I.majority_parent(rows, "site", "district", "times"), "site", "left")
    return I.backfill(gappy_cells(spark, d), parents, "cell", ["site", "district"])


add("dim_backfill", _backfilled, O.sql(
    f"SELECT cell_id, c.cell, coalesce(CASE WHEN cell_id % 3 <> 0 THEN c.site END, a.site) AS site, coalesce(CASE WHEN cell_id % 3 <> 0 THEN c.district END, b.district) AS district FROM cells c "
    f"LEFT JOIN ({MAJ.format('cell', 'site')}) a ON a.cell = c.cell LEFT JOIN ({MAJ.format('site', 'district')}) b ON b.site = a.site", "cells", "deduped"))
stored = lambda s, d: facts_from_orders(s, d).filter("date < '2000-01-01'").join(cells_from_orders(s, d).select("cell_id", "cell"), "cell_id")
add("facts_anti_merge", lambda s, d: I.new_facts(deduped(s, d), stored(s, d).select("cell", "date"), ["cell", "date"]).select(*COLUMNS), O.sql(f"SELECT {LIST} FROM deduped WHERE date >= DATE '2000-01-01'", "deduped"))
NAMES = [("Call Drop", "call_drop"), ("TCH Congestion", "tch_congestion")]
add("kpi_unpivot", lambda s, d: I.unpivot_kpis(deduped(s, d), s.createDataFrame(NAMES, "header string, kpi_key string")), O.sql(
    "SELECT date, cell, 'call_drop' AS kpi_key, TRY_CAST(cd AS DOUBLE) AS value FROM deduped UNION ALL SELECT date, cell, 'tch_congestion', TRY_CAST(tc AS DOUBLE) FROM deduped", "deduped"))
SOURCES = ("Call Drop", "TCH Congestion")
for key, op, sql in (
    ("derived_sum", "SUM", "CAST(cd AS DOUBLE) + CAST(tc AS DOUBLE)"), ("derived_avg", "AVERAGE", "(CAST(cd AS DOUBLE) + CAST(tc AS DOUBLE)) / 2"),
    ("derived_ratio", "RATIO", "CASE WHEN CAST(tc AS DOUBLE) > 0 THEN CAST(cd AS DOUBLE) / CAST(tc AS DOUBLE) * 100 END"),
):
    add(key, lambda s, d, k=I.DerivedKpi(key, op, SOURCES, scale=100.0 if op == "RATIO" else 1.0): I.derived(deduped(s, d), [k]).withColumn("value", F.round("value", 6)), O.sql(
        f"SELECT * FROM (SELECT date, cell, '{key}' AS kpi_key, ROUND({sql}, 6) AS value FROM deduped) WHERE value IS NOT NULL", "deduped"))
DATES = (
    ("2026-07-05T10:00:00+02:00", "2026-07-05"), ("2026-07-05T10:00:00", "2026-07-05"), ("05/07/26", "2026-07-05"), ("05/07/26 06:30:00", "2026-07-05"), ("5/7/26 06:30", "2026-07-05"), ("05-07-26", "2026-07-05"), ("05.07.26", "2026-07-05"),
    ("05-Jul-26", "2026-07-05"), ("12/28/26", "2026-12-28"), ("2026-07-28 00:00:00", "2026-07-28"), ("2026-07-28 00:00", "2026-07-28"), ("2026-7-8", "2026-07-08"), ("07/05/2026", "2026-05-07"), ("12/28/2026", "2026-12-28"),
    ("06.07.2026", "2026-07-06"), ("2026/07/09", "2026-07-09"), ("20260710", "2026-07-10"), ("05-Jul-2026", "2026-07-05"), ("05/07/95", "1995-07-05"), ("soon", None), ("", None),
)
#: How an order's date may be written: a Spark pattern, DuckDB's, and what stands around it.
FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "+00:00"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", ""), ("dd/MM/yy", "%d/%m/%y", " 06:30"), ("dd-MM-yy", "%d-%m-%y", ""), ("dd.MM.yy", "%d.%m.%y", ""), ("dd-MMM-yyyy", "%d-%b-%Y", ""),
    ("yyyy/MM/dd", "%Y/%m/%d", ""), ("yyyyMMdd", "%Y%m%d", ""), ("dd.MM.yyyy", "%d.%m.%Y", ""), ("dd/MM/yyyy", "%d/%m/%Y", ""),
)
_nth = f"o_orderkey % {len(FORMS) + 1}"


def _written_dates(spark, d):
    """(o_orderkey, raw): order dates in many forms, one in eleven of them no date, and the literals of DATES beside."""
    forms = F.lit("soon")
    for i, (spark_form, _, end) in enumerate(FORMS):
        forms = F.when(F.expr(_nth) == i, F.concat(F.date_format("o_orderdate", spark_form), F.lit(end))).otherwise(forms)
    literals = spark.createDataFrame([(-i, a) for i, (a, _) in enumerate(DATES, 1)], "o_orderkey long, raw string")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), forms.alias("raw")).unionByName(literals)


add("date_parse", lambda s, d: _written_dates(s, d).select("o_orderkey", "raw", parsed_date("raw").alias("date")),
    "SELECT o_orderkey::BIGINT AS o_orderkey, CASE " + " ".join(f"WHEN {_nth} = {i} THEN strftime(o_orderdate, '{form}') || '{end}'" for i, (_, form, end) in enumerate(FORMS)) + f" ELSE 'soon' END AS raw, CASE WHEN {_nth} < {len(FORMS)} THEN o_orderdate::DATE END AS date FROM orders "
    "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, '{a}', {'NULL::DATE' if b is None else 'DATE ' + chr(39) + b + chr(39)})" for i, (a, b) in enumerate(DATES, 1)) + ") AS t(o_orderkey, raw, date)")
parts = lambda s, d: s.read.parquet(f"{d}/part.parquet")
add("header_normalize", lambda s, d: parts(s, d).select("p_partkey", header_key(F.concat("p_name", F.lit("  UTILISATION_(%) "), "p_type")).alias("key")),
    "SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || '  UTILISATION_(%) ' || p_type), 'utilisation', 'utilization'), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
misspelt = lambda s, d: cells_from_orders(s, d).select(F.regexp_replace(F.regexp_replace("site", "^(.)(.)", "$2$1"), "[02468]", "").alias("name")).distinct()
add("name_similarity", lambda s, d: I.similar_names(misspelt(s, d), cells_from_orders(s, d).select(F.col("site").alias("name"))).withColumn("similarity", F.round("similarity", 6)), O.sql(
    "SELECT name, candidate, ROUND(s, 6) AS similarity FROM (SELECT name, candidate, 1 - levenshtein(lower(name), lower(candidate))::DOUBLE / greatest(length(name), length(candidate)) AS s "
    "FROM (SELECT DISTINCT regexp_replace(regexp_replace(site, '^(.)(.)', '\\2\\1'), '[02468]', '', 'g') AS name FROM cells), (SELECT DISTINCT site AS candidate FROM cells) WHERE lower(name) <> lower(candidate)) "
    "WHERE s >= 0.55 QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, candidate) = 1", "cells"))


#: Files that first rows, and repeated ones, are written to, and the days of each; the last takes all later days.
FILES, FILE_DAYS = 64, 40


def _file(spark, d):
    """The raw rows as CSV files of one folder in the shared one, with lines of too many fields among them."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = raw_rows(spark, d)
    fields = [c for c in rows.columns if c != "line"]
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.regexp_replace(c, '"', '""'), F.lit("")), F.lit('"'))
    line = F.concat_ws(",", *[quoted(c) for c in fields], *[F.when(F.col("line") % 7 == 0, F.lit("more"))])
    # Files in the order of lines, which decides between rows of one cell and day: the n-th
    # holds the n-th stretch of days, of rows that stand there first or again, under a header of its own.
    again, day = F.col("line") >= 10_000_000_000, (F.col("line") % 10_000_000_000 / 100_000).cast("long")
    body = rows.select(line.alias("value"), F.col("line").alias("i"), (F.least(F.floor(day / FILE_DAYS), F.lit(FILES - 1)) + again.cast("long") * FILES).cast("int").alias("file"))
    header = spark.range(2 * FILES).select(F.lit(",".join(f'"{c}"' for c in fields)).alias("value"), F.lit(-1).cast("long").alias("i"), F.col("id").cast("int").alias("file"))
    body.unionByName(header).repartitionById(2 * FILES, "file").sortWithinPartitions("i").select("value").write.text(path)
    return path


def _imported(spark, d):
    """A file staged, merged into an empty workspace, and what it holds then."""
    ws = Workspace(spark, f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}")
    ws.import_csv(_file(spark, d), {f: f for f in I.FIELDS})
    rows = ws.table("facts").join(ws.table("cells"), "cell_id")
    return rows.select("date", "cell", "district", *MEASURES)


def _rejects(spark, d):
    counts = I.reject_counts(I.stage_csv(spark, _file(spark, d)))
    return counts.unpivot([], ["good", "rejected"], "kind", "rows")


GOOD = "SELECT * FROM raw WHERE line % 7 <> 0"
O.define("graw", ("raw",), GOOD)
O.define("gcleaned", ("graw",), O.CTES["cleaned"][1].replace("FROM raw ", "FROM graw "))
O.define("gdeduped", ("gcleaned",), O.CTES["deduped"][1].replace("FROM cleaned ", "FROM gcleaned "))
_gmaj = lambda child, parent: MAJ.format(child, parent).replace("FROM deduped", "FROM gdeduped")
add("csv_import", _imported, O.sql(
    f"SELECT g.date, g.cell, p.district, {', '.join('g.' + m for m in MEASURES)} FROM gdeduped g LEFT JOIN ({_gmaj('cell', 'site')}) s ON s.cell = g.cell LEFT JOIN ({_gmaj('site', 'district')}) p ON p.site = s.site", "gdeduped"))
add("csv_rejects", _rejects, O.sql("SELECT 'good' AS kind, count(*) FILTER (WHERE line % 7 <> 0) AS rows FROM raw UNION ALL SELECT 'rejected', count(*) FILTER (WHERE line % 7 = 0) FROM raw", "raw"))


def _two_writers(spark, d):
    """Two workspaces on one store: while the first merges the even days, the second merges
    all days of odd cells. Both commit, and a fact that both bring is held once."""
    path = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
    first, second = Workspace(spark, path), Workspace(spark, path)
    mapping = {f: f for f in I.FIELDS}
    deduped(spark, d).select(*[F.col(f).cast("string").alias(f) for f in I.FIELDS], "line").write.parquet(f"{path}-rows")
    rows = spark.read.parquet(f"{path}-rows")
    write, waiting = first._write, [lambda: second.import_rows(rows.filter("cell LIKE '%1' OR cell LIKE '%3' OR cell LIKE '%5'"), mapping)]

    def interrupted(name, df, folder):
        if waiting:
            waiting.pop()()
        write(name, df, folder)

    first._write = interrupted
    first.import_rows(rows.filter("dayofmonth(date) % 2 = 0"), mapping)
    return first.table("facts").join(first.table("cells"), "cell_id").select("date", "cell", *MEASURES)


add("import_two_writers", _two_writers, O.sql(f"SELECT date, cell, {', '.join(MEASURES)} FROM deduped WHERE day(date) % 2 = 0 OR right(cell, 1) IN ('1', '3', '5')", "deduped"))


def _noted_file(spark, d):
    """Orders as a CSV file whose notes hold line breaks, commas and doubled quotes."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{d}/orders.parquet")
    parts = [F.lit('"order '), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("\n\nof, ")).otherwise(F.lit(" of ")), F.lit('""'), F.col("o_orderpriority"), F.lit('"""')]
    body = orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(*parts)).otherwise(F.col("o_orderstatus")), F.col("o_custkey").cast("string")).alias("value"), F.col("o_orderkey").alias("i"))
    header = spark.range(1).select(F.lit('key,"note\nof it",customer').alias("value"), F.lit(-1).cast("long").alias("i"))
    body.unionByName(header).repartitionByRange(4, "i").sortWithinPartitions("i").select("value").coalesce(1).write.text(path)
    return path


def _noted(spark, d):
    good, _ = I.split_rejects(I.stage_csv(spark, _noted_file(spark, d)))
    return good.select(F.col("key").cast("long").alias("o_orderkey"), F.col("`note\nof it`").alias("note"), F.col("customer").cast("long").alias("o_custkey"))


add("csv_records", _noted, """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'order ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'of, ' ELSE ' of ' END || '"' || o_orderpriority || '"' ELSE o_orderstatus END AS note, o_custkey FROM orders""")
HEADERS = [("TCH Congestion (%)", "tch_congestion"), ("2G CSSR", "call_setup_success_2g"), ("SDCCH Blocking", "sdcch_congestion"), ("Call Drop Rate 2G", "call_drop_rate_2g"), ("Weather", None)]


def _headers(spark, d):
    """(header): names of counters that a file of every part might have, a few of which are KPIs'."""
    known = F.array(*[F.lit(h) for h, _ in HEADERS])
    nth = F.col("p_partkey") % 9
    name = F.when(nth < len(HEADERS), known[nth.cast("int")]).otherwise(F.col("p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.when(nth % 2 == 0, F.upper(name)).otherwise(F.regexp_replace(name, " ", "_")).alias("header"), "p_partkey")


_name = "CASE " + " ".join(f"WHEN p_partkey % 9 = {i} THEN '{h}'" for i, (h, _) in enumerate(HEADERS)) + " ELSE p_type END"
O.define("headers", (), f"SELECT DISTINCT CASE WHEN p_partkey % 9 % 2 = 0 THEN upper({_name}) ELSE replace({_name}, ' ', '_') END AS header, p_partkey % 9 AS nth FROM part")
add("kpi_discover", lambda s, d: I.discover_kpis(_headers(s, d).select("header"), kpis.seeds(s).filter("technology = '2G'")).select("header", "kpi_key"), O.sql(
    "SELECT DISTINCT header, CASE nth " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(HEADERS) if k) + " END AS kpi_key FROM headers WHERE nth IN (" + ", ".join(str(i) for i, (_, k) in enumerate(HEADERS) if k) + ")", "headers"))


def _derivable(spark, d):
    """(source, kpi_key): the derived KPIs that a supplier's counters suffice for. Which counters
    it has follows from its key."""
    counters = [c for b in kpis.BUILTINS for c in b.sources]
    has = F.filter(F.array(*[F.when(F.col("s_suppkey") % (i + 2) != 0, F.lit(c)) for i, c in enumerate(counters)]), lambda x: x.isNotNull())
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("source"), has.alias("headers"))
    return I.derivable_of(rows, list(kpis.BUILTINS))


add("derived_detect", _derivable, "SELECT s_suppkey::BIGINT AS source, kpi_key FROM supplier, (VALUES " + ", ".join(f"('{b.key}', {3 * i + 2})" for i, b in enumerate(kpis.BUILTINS)) + ") AS b(kpi_key, m) WHERE s_suppkey % m <> 0 AND s_suppkey % (m + 1) <> 0 AND s_suppkey % (m + 2) <> 0")
add("dim_duplicates", lambda s, d: I.dim_duplicates(doubled_cells(s, d)), O.sql("SELECT cell, 2::BIGINT AS n FROM cells WHERE cell_id % 3 = 0", "cells"))
add("place_values", lambda s, d: I.place_values(deduped(s, d), cells_from_orders(s, d).filter("district_id < 12").select(F.lit("district").alias("field"), F.col("district").alias("name")).distinct(), "district"), O.sql(
    "SELECT district AS name, count(*) AS rows, district IN (SELECT district FROM cells WHERE district_id < 12) AS matched FROM deduped WHERE district IS NOT NULL GROUP BY 1 ORDER BY rows DESC, name LIMIT 8", "deduped", "cells"))
ALIAS = [(" nation_3", "NATION_1"), ("NATION_0", "NATION_2")]
add("alias_remap", lambda s, d: I.remap(deduped(s, d), "district", s.createDataFrame(ALIAS, "alias string, name string")).groupBy("district").agg(F.count("*").alias("rows")), O.sql(
    "SELECT CASE lower(trim(district)) WHEN 'nation_3' THEN 'NATION_1' WHEN 'nation_0' THEN 'NATION_2' ELSE district END AS district, count(*) AS rows FROM deduped GROUP BY 1", "deduped"))


def doubled_cells(spark, d):
    """Every third cell a second time, under a larger id."""
    cells = cells_from_orders(spark, d)
    return cells.unionByName(cells.filter("cell_id % 3 = 0").withColumn("cell_id", F.col("cell_id") + 100_000))


def doubled_facts(spark, d):
    facts = facts_from_orders(spark, d).select("cell_id", "date", *MEASURES)
    moved = facts.filter("cell_id % 3 = 0").withColumn("cell_id", F.col("cell_id") + 100_000)
    return facts.withColumn("prb", F.when(F.dayofmonth("date") % 2 == 0, F.col("prb"))).unionByName(moved.filter("dayofmonth(date) % 3 <> 0"))


O.define("dfacts", ("facts",), "SELECT * REPLACE (CASE WHEN day(date) % 2 = 0 THEN prb END AS prb) FROM facts UNION ALL SELECT * REPLACE (cell_id + 100000 AS cell_id) FROM facts WHERE cell_id % 3 = 0 AND day(date) % 3 <> 0")
add("dim_repair", lambda s, d: I.repair(doubled_cells(s, d), doubled_facts(s, d))[1].select("cell_id", "date", *[rounded(m, 4).alias(m) for m in MEASURES]), O.sql(
    "SELECT kept AS cell_id, date, " + ", ".join(f"round({m}, 4) AS {m}" for m in MEASURES) + " FROM (SELECT *, cell_id % 100000 AS kept FROM dfacts) QUALIFY row_number() OVER (PARTITION BY kept, date ORDER BY (prb IS NOT NULL)::INT DESC, cell_id) = 1", "dfacts"))


def _repaired(spark, d):
    """Doubled cells, and cells that are aliases of the next one, whose own name may be one
    again: facts, KPIs, notes and states by the cells that stay."""
    cells, name = doubled_cells(spark, d), lambda i: F.col(f"{i}.cell")
    own = cells_from_orders(spark, d)
    chain = own.filter("cell_id % 10 IN (1, 2)").alias("a").join(own.alias("b"), F.expr("b.cell_id = a.cell_id + 1"))
    aliases = chain.select(F.lit("cell").alias("level"), F.concat(F.lit(" "), F.lower(name("a"))).alias("alias"), name("b").alias("name"))
    _, moves = R.repaired_cells(cells, aliases)
    extras = from_orders(spark, d).extras.filter("kpi_key = 'congestion'")
    extras = extras.unionByName(extras.filter("cell_id % 3 = 0").withColumn("cell_id", F.col("cell_id") + 100_000).withColumn("value", F.col("value") + 1))
    notes = cells.select("cell_id", F.lit("2000-01-01").cast("date").alias("at"), F.lit("me").alias("author"), F.lit("seen").alias("note"))
    status = cells.select(F.lit("cell").alias("scope"), F.col("cell_id").alias("id"), F.col("cell_id").cast("string").alias("status"), F.lit("me").alias("owner"), F.expr("date_add(DATE'2000-01-01', CAST(cell_id % 7 AS INT))").alias("review_date"))
    facts = R.moved_facts(doubled_facts(spark, d), moves)
    out = [
        facts.select(F.lit("facts").alias("tab"), "cell_id", F.col("date"), rounded("users", 4).alias("x"), F.col("prb").isNotNull().cast("string").alias("y")),
        R.moved_extras(extras, moves).select(F.lit("extras").alias("tab"), "cell_id", "date", rounded("value", 4).alias("x"), F.col("kpi_key").alias("y")),
        R.moved_notes(notes, moves).select(F.lit("notes").alias("tab"), "cell_id", F.col("at").alias("date"), F.lit(None).cast("double").alias("x"), F.col("note").alias("y")),
        R.moved_status(status, moves).select(F.lit("status").alias("tab"), F.col("id").alias("cell_id"), F.col("review_date").alias("date"), F.lit(None).cast("double").alias("x"), F.col("status").alias("y")),
    ]
    return reduce(DataFrame.unionByName, out)


O.define("known", ("cells",), "SELECT cell_id AS id FROM cells UNION ALL SELECT cell_id + 100000 FROM cells WHERE cell_id % 3 = 0")
# Where aliases end, and the least id of all that end there.
O.define("ends", ("known", "cells"), """
SELECT id, CASE WHEN id % 100000 % 10 = 1 AND id % 100000 + 2 IN (SELECT cell_id FROM cells) THEN id % 100000 + 2 WHEN id % 100000 % 10 IN (1, 2) AND id % 100000 + 1 IN (SELECT cell_id FROM cells) THEN id % 100000 + 1 ELSE id % 100000 END AS e FROM known""")
O.define("moves", ("ends",), "SELECT id, min(id) OVER (PARTITION BY e) AS kept FROM ends")
_first = lambda what, key, better, old: f"SELECT {what} FROM ({{}}) JOIN moves ON {old} = moves.id QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {better}{old} <> kept, {old}) = 1"
O.define("dextras", ("extras",), "SELECT cell_id, date, kpi_key, value FROM extras WHERE kpi_key = 'congestion' UNION ALL SELECT cell_id + 100000, date, kpi_key, value + 1 FROM extras WHERE kpi_key = 'congestion' AND cell_id % 3 = 0")
add("dim_repair_all_tables", _repaired, O.sql(" UNION ALL ".join("(" + q + ")" for q in (
    _first("'facts' AS tab, kept AS cell_id, date, round(users, 4) AS x, CASE WHEN prb IS NOT NULL THEN 'true' ELSE 'false' END AS y", "kept, date", "(prb IS NOT NULL)::INT DESC, ", "cell_id").format("SELECT * FROM dfacts"),
    _first("'extras', kept, date, round(value, 4), kpi_key", "kept, date", "", "cell_id").format("SELECT * FROM dextras"),
    _first("'notes', kept, DATE '2000-01-01', NULL::DOUBLE, 'seen'", "kept", "", "old").format("SELECT id AS old FROM known"),
    _first("'status', kept, DATE '2000-01-01' + (old % 7)::INT, NULL::DOUBLE, old::VARCHAR", "kept", "old % 7 DESC, ", "old").format("SELECT id AS old FROM known"),
)), "dfacts", "dextras", "known", "moves"))
add("integrity_duplicates", lambda s, d: I.integrity(doubled_cells(s, d), doubled_facts(s, d).unionByName(doubled_facts(s, d).filter("cell_id = 5")), from_orders(s, d).extras), O.sql(
    "SELECT 'duplicate_facts' AS problem, count(*) AS n FROM facts WHERE cell_id = 5 UNION ALL SELECT 'duplicate_kpis', 0 UNION ALL SELECT 'duplicate_cells', 0 UNION ALL SELECT 'orphan_facts', 0 UNION ALL SELECT 'cells_without_site', 0", "facts"))
kpi_rows = lambda s, d: from_orders(s, d).extras.filter("kpi_key = 'call_drop'").select("cell_id", "date", "value", F.lit(1).alias("version"))
add("upsert_latest", lambda s, d: I.upsert(kpi_rows(s, d), kpi_rows(s, d).filter("cell_id % 4 = 0").withColumn("value", F.lit(9.0)).withColumn("version", F.when(F.dayofmonth("date") < 15, 2).otherwise(0)), ["cell_id", "date"], "version").select("cell_id", "date", F.round("value", 6).alias("value"), "version"), O.sql(
    "SELECT cell_id, date, CASE WHEN cell_id % 4 = 0 AND day(date) < 15 THEN 9.0::DOUBLE ELSE ROUND(call_drop, 6) END AS value, CAST(CASE WHEN cell_id % 4 = 0 AND day(date) < 15 THEN 2 ELSE 1 END AS INTEGER) AS version FROM wide", "wide"))


def _replaced(spark, d):
    weeks = cell_weekly(from_orders(spark, d)).select("period", "cell_id", "observed_days", "is_nc")
    return I.replace_partitions(weeks, weeks.filter("period >= '2001-06-04' AND cell_id % 2 = 0").withColumn("observed_days", F.lit(7).cast("long")), ["period"])


add("delete_insert_partition", _replaced, O.sql(
    "SELECT period, cell_id, CASE WHEN period >= DATE '2001-06-04' THEN 7 ELSE observed_days END AS observed_days, is_nc FROM cw WHERE period < DATE '2001-06-04' OR cell_id % 2 = 0", "cw"))
add("place_stats", lambda s, d: I.place_stats(deduped(s, d), cells_from_orders(s, d).filter("district_id < 12").select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in ("cell", "site", "district", "region")])).alias("x")).select("x.*")), O.sql(
    "SELECT field, count(*) AS distinct, count(hit) AS matched, count(*) - count(hit) AS unmatched FROM (" + " UNION ALL ".join(
        f"SELECT DISTINCT '{f}' AS field, r.{f}, k.{f} AS hit FROM deduped r LEFT JOIN (SELECT DISTINCT {f} FROM cells WHERE district_id < 12) k ON lower(trim(r.{f})) = lower(k.{f}) WHERE r.{f} IS NOT NULL" for f in ("cell", "site", "district", "region")) + ") GROUP BY 1", "deduped", "cells"))
stream_dir = lambda s: f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
add("stream_events_tumbling", lambda s, d: S.replay(s, d, stream_dir(s)), """
SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, ROUND(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS value FROM events GROUP BY 1, 2""")
add("batch_events_tumbling", lambda s, d: S.tumbling(s.read.parquet(f"{d}/events.parquet")), ORACLE_SQL["stream_events_tumbling"])
add("stream_events_followed", lambda s, d: S.replay_followed(s, d, stream_dir(s), "click", "purchase", "2 HOURS"), """
SELECT a.user_id, a.ts AS first_ts, b.ts AS second_ts, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
add("batch_events_sliding", lambda s, d: S.sliding(s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))), """
SELECT w AS window_start, event_type, count(*) AS n, ROUND(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS value
FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE for i in [0, 1, 2, 3]])::TIMESTAMP AS w FROM events) GROUP BY 1, 2""")

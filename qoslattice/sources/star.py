"""The star schema, and an adapter that reads order data as one.

A ``Star`` holds the dimension ``cells`` (region > district > site > cell), the
wide daily facts and the long table of further KPIs. ``from_orders`` maps the
TPC-H-like tables: suppliers are cells, nations districts, a line item's ship
date the day, and prices, quantities and flags stand in for the measures. Sums
go through whole hundredths, so that every engine gets the same doubles.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import breach, period_start
from ..functions.rules import Rules

MEASURES = ("prb", "volume_mb", "users", "throughput_kbps", "availability_pct")
LEVELS = ("site", "district", "region", "network")

#: The registry's columns, and the KPIs of the adapter.
KPI_SCHEMA = (
    "technology string, kpi_key string, label string, unit string, worse_is_higher boolean, category string, target double, "
    "warning double, critical double, agg string, is_core boolean, persistent boolean"
)
KPIS = (
    ("4G", "call_drop", "Call drop rate", "%", True, "Retainability", 1.5, 1.0, 1.9, "avg", True, True),
    ("4G", "congestion", "Congestion", "%", True, "Congestion", 2.0, 1.5, 4.0, "avg", False, False),
    ("4G", "call_setup", "Call setup success", "%", False, "Accessibility", 98.5, 99.0, 95.0, "avg", False, False),
    ("4G", "data_failure", "Data failure", "%", True, "Accessibility", 1.0, 0.8, 2.0, "max", False, False),
    ("3G", "data_access", "Data access success", "%", False, "Accessibility", 98.0, 98.5, 95.0, "min", False, False),
    ("3G", "payload", "Payload", "MB", False, "Integrity", None, None, None, "sum", False, False),
)
DEFAULT_TECHNOLOGY = "4G"


@dataclass
class Star:
    spark: SparkSession
    cells: DataFrame
    facts: DataFrame
    extras: DataFrame
    kpis: DataFrame
    rules: Rules = field(default_factory=Rules)
    #: Where a source has facts and KPIs side by side: both, and which of its rows breach a KPI.
    wide: DataFrame | None = None
    wide_breach: Column | None = None
    #: The days of the facts, where reading them is cheaper than reading facts.
    dates: DataFrame | None = None
    _periods: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        if "technology" not in self.extras.columns:
            self.extras = self.extras.withColumn("technology", F.lit(DEFAULT_TECHNOLOGY))

    @property
    def active_kpis(self) -> DataFrame:
        """The registry without KPIs that are switched off."""
        return self.kpis.filter(F.coalesce("active", F.lit(True))) if "active" in self.kpis.columns else self.kpis

    @property
    def breaching_kpis(self) -> DataFrame:
        """KPIs whose breach makes a day non-compliant."""
        return self.active_kpis.filter(F.col("target").isNotNull() & (F.col("is_core") | F.col("persistent")))

    def where(self, condition: Column) -> Star:
        """The star of the days that meet ``condition`` (on date, cell_id or month)."""
        part = lambda df: None if df is None else df.filter(condition)
        return replace(self, facts=part(self.facts), extras=part(self.extras), wide=part(self.wide), dates=None, _periods={})

    def since(self, first: date | None) -> Star:
        """From ``first`` on: the filter reaches the scan, and folders by month where there are any."""
        if first is None:
            return self
        day = F.col("date") >= F.lit(first)
        if "month" in self.facts.columns and "month" in self.extras.columns:
            day = day & (F.col("month") >= F.lit(first.replace(day=1)))
        return replace(self.where(day), _periods=dict(self._periods))

    def periods(self, n: int = 1, grain: str = "weekly", of_kpis: bool = False) -> list[date]:
        """The last ``n`` periods with facts (or KPI values), newest first. One column is read."""
        days = self.extras if of_kpis and self.wide is None else self.facts if self.dates is None else self.dates
        key = (days is self.extras, grain)
        known = self._periods.get(key, ([], 0))
        if known[1] < n:
            start = period_start("date", grain).alias("period")
            rows = days.select(start).filter("period IS NOT NULL").distinct().orderBy(F.desc("period")).limit(n).collect()
            known = self._periods[key] = ([r["period"] for r in rows], n)
        return known[0][:n]

    def last_period(self, grain: str = "weekly", of_kpis: bool = False) -> date | None:
        return (self.periods(1, grain, of_kpis) or [None])[0]


def kpi_registry(spark: SparkSession, rows=KPIS) -> DataFrame:
    return spark.createDataFrame(list(rows), KPI_SCHEMA)


#: The columns that the adapter reads; stated, so that no file is opened to infer them.
ORDER_TABLES = {
    "supplier": "s_suppkey long, s_name string, s_nationkey long", "nation": "n_nationkey long, n_name string, n_regionkey long", "region": "r_regionkey long, r_name string",
    "lineitem": "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(ORDER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _money(name: str):
    """An exact sum of hundredths: whole numbers add up fast and in any order."""
    return F.sum(F.round(F.col(name) * 100).cast("long")) / 100.0


def cells_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    nth = F.col("s_suppkey") % 4
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("cell"),
            (F.col("n_nationkey") * 4 + nth).cast("long").alias("site_id"), F.concat_ws("-", "n_name", nth.cast("string")).alias("site"),
            F.col("n_nationkey").cast("long").alias("district_id"), F.col("n_name").alias("district"),
            F.col("r_regionkey").cast("long").alias("region_id"), F.col("r_name").alias("region"),
        )
    )


def facts_from_orders(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """One row a cell and day, wide, with the further KPIs beside the measures."""
    n = F.count("*")
    items = _table(spark, sf_dir, "lineitem") if items is None else items
    return (
        items.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (_money("l_quantity") / n * 2).alias("prb"), (_money("l_extendedprice") / 1000).alias("volume_mb"), _money("l_quantity").alias("users"),
            (_money("l_extendedprice") / n / 2).alias("throughput_kbps"), (100 - _money("l_tax") / n * 25).alias("availability_pct"),
            (_money("l_discount") / n * 20).alias("call_drop"), (F.count_if(F.col("l_returnflag") == "R") / n * 5).alias("congestion"),
            (100 - F.count_if(F.col("l_linestatus") == "F") / n * 4).alias("call_setup"), (_money("l_tax") / n * 30).alias("data_failure"),
            (100 - _money("l_discount") / n * 40).alias("data_access"), (_money("l_extendedprice") / 500).alias("payload"),
        )
    )


def from_orders(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> Star:
    items = _table(spark, sf_dir, "lineitem")
    wide = facts_from_orders(spark, sf_dir, items)
    keys = ["cell_id", "date"]
    technology = F.create_map(*[F.lit(x) for t, k, *_ in KPIS for x in (k, t)])[F.col("kpi_key")]
    past = F.lit(False)
    for _, key, _, _, worse_is_higher, _, target, _, _, _, core, persistent in KPIS:
        if target is not None and (core or persistent):
            past = past | breach(key, F.lit(target), F.lit(worse_is_higher))
    return Star(
        spark, cells_from_orders(spark, sf_dir), wide.select(*keys, *MEASURES),
        wide.unpivot(keys, [k[1] for k in KPIS], "kpi_key", "value").withColumn("technology", technology), kpi_registry(spark), rules or Rules(),
        wide, past, items.select(F.col("l_shipdate").cast("date").alias("date")),
    )


def calendar(spark: SparkSession, first: str = "2020-01-01", last: str = "2035-12-31") -> DataFrame:
    day = F.col("date")
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS date")
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_id"), day, F.extract(F.lit("yearofweek"), day).cast("int").alias("iso_year"),
        F.weekofyear(day).alias("iso_week"), F.trunc(day, "week").alias("week_start"), F.month(day).alias("month"),
        F.year(day).alias("year"), F.quarter(day).alias("quarter"),
    )

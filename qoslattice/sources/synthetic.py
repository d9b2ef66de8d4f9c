"""Seeded daily rows of a made-up network with known faults, for trials and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of every PERIOD cells one has each fault, so faults grow with the network. The value is the
#: cell's number within its PERIOD and the share of weeks after which the fault begins.
PERIOD = 20
FAULTS = {"chronic": (2, 0.0), "congestion": (5, 0.5), "sleeping": (8, 0.6), "high_drops": (11, 0.0), "backhaul": (14, 0.0), "recovering": (17, 0.0)}
#: (technology, KPI, healthy least and most, fault, faulty least and most): what ``kpi_rows`` makes up.
KPI_RANGES = (
    ("4G", "call_drop_rate_4g", 0.2, 1.0, "high_drops", 2.5, 4.5), ("3G", "call_drop_rate_3g", 0.3, 1.1, "high_drops", 2.5, 5.0), ("2G", "call_drop_rate_2g", 0.3, 1.2, "high_drops", 2.6, 5.5),
    ("2G", "tch_congestion", 0.0, 1.0, "busy", 2.5, 4.5), ("3G", "data_access_success_3g", 98.4, 99.9, "backhaul", 92.0, 97.0),
)


def rows(spark: SparkSession, cells: int = 40, weeks: int = 12, first: str = "2026-01-05", seed: int = 7) -> DataFrame:
    """One row a cell and day, with measures, two KPIs, the fault's name and whether the cell is busy."""
    days = weeks * 7
    base = spark.range(cells * days).select((F.floor(F.col("id") / days) + 1).alias("cell_id"), (F.col("id") % days).cast("int").alias("day"), "id")
    # Hashes of the row's number: the same whatever the partitioning.
    u = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000
    week = F.floor(F.col("day") / 7)

    def of(name: str) -> Column:
        nth, begins = FAULTS[name]
        return (F.col("cell_id") % PERIOD == nth) & (week >= int(begins * weeks))

    fault = F.lit(None).cast("string")
    for name, (nth, _) in FAULTS.items():
        fault = F.when(F.col("cell_id") % PERIOD == nth, name).otherwise(fault)
    busy = of("chronic") | of("congestion") | (of("recovering") & (week < weeks / 2))
    asleep = of("sleeping")
    return base.select(
        F.date_add(F.lit(first).cast("date"), F.col("day")).alias("date"), "cell_id", F.concat(F.lit("CELL-"), F.lpad(F.col("cell_id").cast("string"), 4, "0")).alias("cell"),
        F.concat(F.lit("SITE-"), F.floor(F.col("cell_id") / 3).cast("string")).alias("site"), F.concat(F.lit("District "), (F.col("cell_id") % 7).cast("string")).alias("district"),
        F.concat(F.lit("Region "), (F.col("cell_id") % 7 % 3).cast("string")).alias("region"),
        F.when(asleep, 1.0).when(busy, 84 + 12 * u(1)).otherwise(35 + 30 * u(1)).alias("prb"),
        F.when(asleep, 2.0 * u(2)).otherwise(800 + 900 * u(2)).alias("volume_mb"), F.when(asleep, 0.0).otherwise(F.floor(20 + 50 * u(3))).cast("double").alias("users"),
        F.when(of("backhaul"), 900 + 600 * u(4)).when(busy, 6000 + 4000 * u(4)).otherwise(15_000 + 10_000 * u(4)).alias("throughput_kbps"), (99.2 + 0.8 * u(5)).alias("availability_pct"),
        F.when(of("high_drops"), 2.5 + 2 * u(6)).otherwise(0.2 + 0.8 * u(6)).alias("call_drop"), F.when(busy, 2.5 + 2 * u(7)).otherwise(u(7)).alias("congestion"), fault.alias("fault"), busy.alias("busy"),
    )


def kpi_rows(days: DataFrame, seed: int = 7) -> DataFrame:
    """(cell_id, date, technology, kpi_key, value) of three technologies for ``rows``."""
    out = []
    for k, (technology, key, low, high, fault, bad_low, bad_high) in enumerate(KPI_RANGES):
        u = F.pmod(F.xxhash64("cell_id", "date", F.lit(seed), F.lit(100 + k)), F.lit(1_000_000)) / 1_000_000
        faulty = F.col("busy") if fault == "busy" else F.coalesce(F.col("fault") == fault, F.lit(False))
        value = F.when(faulty, bad_low + (bad_high - bad_low) * u).otherwise(low + (high - low) * u)
        out.append(F.struct(F.lit(technology).alias("technology"), F.lit(key).alias("kpi_key"), value.alias("value")))
    return days.select("cell_id", "date", F.explode(F.array(*out)).alias("x")).select("cell_id", "date", "x.*")

"""The KPI registry: seeds, changes, and derived KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import DerivedKpi, upsert
from .star import KPI_SCHEMA

SCHEMA = KPI_SCHEMA + ", is_congestion boolean, executive boolean, decimals int, aliases array<string>, active boolean"

LOWER, HIGHER = True, False
#: Technology, key, label, unit, better direction, category, target, warning, critical, aggregation,
#: core, persistent, congestion, executive, decimals, short names in headers.
SEEDS = (
    ("2G", "tch_congestion", "TCH Congestion", "%", LOWER, "Congestion", 2.0, 1.5, 3.0, "avg", True, True, True, True, 2, ["tch blocking"]),
    ("2G", "sdcch_congestion", "SDCCH Congestion", "%", LOWER, "Congestion", 2.0, 1.5, 3.0, "avg", True, True, True, True, 2, ["sdcch blocking"]),
    ("2G", "call_setup_success_2g", "2G Call Connection Success Rate", "%", HIGHER, "Accessibility", 98.5, 99.0, 95.0, "avg", True, True, False, True, 2, ["2g cssr"]),
    ("2G", "call_drop_rate_2g", "2G Call Drop Rate", "%", LOWER, "Retainability", 1.5, 1.0, 2.5, "avg", True, True, False, True, 2, ["2g cdr"]),
    ("2G", "tch_availability", "TCH Availability", "%", HIGHER, "Availability", 99.5, 99.0, 95.0, "avg", False, False, False, False, 2, []),
    ("2G", "gprs_traffic", "GPRS Traffic", "MB", HIGHER, "Integrity", None, None, None, "sum", False, False, False, False, 1, ["2g data volume"]),
    ("2G", "gprs_throughput", "GPRS/EDGE Throughput", "kbps", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 1, ["edge throughput"]),
    ("2G", "connected_users", "Connected Users", "-", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 0, ["2g users"]),
    ("3G", "call_setup_success_3g", "3G Call Connection Success Rate", "%", HIGHER, "Accessibility", 98.5, 99.0, 95.0, "avg", True, True, False, True, 2, ["3g cssr"]),
    ("3G", "call_drop_rate_3g", "3G Call Drop Rate", "%", LOWER, "Retainability", 1.5, 1.0, 2.5, "avg", True, True, False, True, 2, ["3g cdr"]),
    ("3G", "data_access_success_3g", "3G Data Access Success Rate", "%", HIGHER, "Accessibility", 98.0, 98.5, 95.0, "avg", True, True, False, True, 2, ["3g ps setup success rate"]),
    ("3G", "ce_utilization", "CE Utilization", "%", LOWER, "Congestion", 70.0, 65.0, 85.0, "avg", False, True, True, False, 2, ["channel element utilization"]),
    ("3G", "hsdpa_throughput", "HSDPA Throughput", "kbps", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 1, ["3g dl throughput"]),
    ("3G", "hsupa_throughput", "HSUPA Throughput", "kbps", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 1, ["3g ul throughput"]),
    ("3G", "data_volume", "Data Volume", "MB", HIGHER, "Integrity", None, None, None, "sum", False, False, False, False, 1, ["3g data volume"]),
    ("3G", "peak_hour_traffic_utilization_3g", "3G Peak Hour Traffic Utilization", "%", LOWER, "Congestion", 80.0, 75.0, 90.0, "avg", False, True, True, False, 2, []),
    ("3G", "availability_3g", "3G Cell Availability", "%", HIGHER, "Availability", 99.5, 99.0, 95.0, "avg", False, False, False, False, 2, []),
    ("3G", "connected_users", "Connected Users", "-", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 0, ["3g users"]),
    ("4G", "call_setup_success_4g", "4G Call Connection Success Rate", "%", HIGHER, "Accessibility", 98.5, 99.0, 95.0, "avg", True, True, False, True, 2, ["4g cssr", "volte cssr", "erab setup success rate"]),
    ("4G", "call_drop_rate_4g", "4G Call Drop Rate", "%", LOWER, "Retainability", 1.5, 1.0, 2.5, "avg", True, True, False, True, 2, ["4g cdr", "erab drop rate"]),
    ("4G", "data_service_failure_4g", "4G Data Service Access Failure Rate", "%", LOWER, "Accessibility", 1.0, 0.8, 2.0, "avg", True, True, False, True, 2, ["erab setup failure rate"]),
    ("4G", "prb_utilization", "4G Peak Hour PRB Utilization", "%", LOWER, "Congestion", 80.0, 75.0, 90.0, "avg", True, True, True, True, 2, ["prb", "4g peak hour traffic utilization nca"]),
    ("4G", "dl_throughput", "DL Throughput", "kbps", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 1, ["e utran ip throughput ue dl"]),
    ("4G", "connected_users", "Connected Users", "-", HIGHER, "Integrity", None, None, None, "avg", False, False, False, False, 0, ["rrc connected ues avg"]),
    ("4G", "data_volume", "Data Volume", "MB", HIGHER, "Integrity", None, None, None, "sum", False, False, False, False, 1, ["4g data volume"]),
    ("4G", "availability", "Availability", "%", HIGHER, "Availability", 99.5, 99.0, 95.0, "avg", False, False, False, False, 2, ["4g cell availability"]),
    ("4G", "mos", "MOS (Voice Quality)", "MOS", HIGHER, "Integrity", 3.5, 3.8, 3.0, "avg", False, False, False, False, 2, ["mos"]),
    ("4G", "vqi", "VQI (Voice Quality Index)", "VQI", HIGHER, "Integrity", 3.5, 3.8, 3.0, "avg", False, False, False, False, 2, ["vqi"]),
    ("4G", "rtp_jitter", "RTP Jitter", "ms", LOWER, "Integrity", 20.0, 10.0, 30.0, "avg", False, False, False, False, 1, ["jitter"]),
    ("4G", "rtp_packet_loss", "RTP Packet Loss", "%", LOWER, "Integrity", 1.0, 0.5, 2.0, "avg", False, False, False, False, 2, ["packet loss"]),
    ("4G", "volte_drop_call_rate", "VoLTE Call Drop Rate", "%", LOWER, "Retainability", 1.5, 1.0, 2.5, "avg", False, True, False, False, 2, ["volte drop rate"]),
)

#: 3G counters that sum to a KPI; a missing counter makes it null.
BUILTINS = (
    DerivedKpi("3g_dl_power_congestion", "SUM", ("VS.RRC.Rej.DLPower.Cong", "VS.RAB.FailEstabPS.DLPower.Cong", "VS.RAB.FailEstabCS.DLPower.Cong")),
    DerivedKpi("3g_ul_ce_congestion", "SUM", ("VS.RRC.Rej.ULCE.Cong", "VS.RAB.FailEstabPS.ULCE.Cong", "VS.RAB.FailEstabCS.ULCE.Cong")),
    DerivedKpi("3g_phych_failures", "SUM", ("VS.RAB.FailEstabPS.PhyChFail", "VS.FailRBRecfg.PhyChFail", "VS.FailRBSetup.PhyChFail")),
)
#: Target, warning and critical counts of the above.
BUILTIN_LIMITS = {"3g_dl_power_congestion": (100, 80, 200), "3g_ul_ce_congestion": (50, 40, 100), "3g_phych_failures": (30, 25, 60)}


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, True) for row in SEEDS], SCHEMA)


def save(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """``registry`` with ``changes`` added, or put in the place of the same technology and key."""
    versioned = lambda df: df.withColumn("version", F.lit(0))
    return upsert(versioned(registry), versioned(changes), ["technology", "kpi_key"], "version").drop("version")


def remove(registry: DataFrame, technology: str, key: str) -> DataFrame:
    return registry.filter(~((F.col("technology") == technology) & (F.col("kpi_key") == key)))


def reset(registry: DataFrame, spark: SparkSession) -> DataFrame:
    """Seeds as they were; KPIs of one's own stay."""
    return save(registry, seeds(spark))
